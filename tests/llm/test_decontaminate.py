import hashlib
import random

from midbase.llm import common, decontaminate

from .conftest import prose


def brute(text, items, window=8):
    w = common.fold_words(text)
    hit, found = set(), set()
    for item, body in items:
        b = common.fold_words(body)
        if item is None or not b:
            continue
        m = min(window, len(b))
        grams = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in grams:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


def cases():
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 8, 9, 30]), 30)) for i in range(40)] + [(None, "w1x"), (50, None), (51, ""), (3, prose(rng, 12, 30))]
    texts = [prose(rng, rng.randrange(200), 30) for _ in range(60)]
    texts += [f"{prose(rng, 20)} {(items[6][1] or '').upper()}, {items[8][1]} {prose(rng, 9)}"]
    return items, list(enumerate(texts, 100))


def test_equals_brute_force_in_one_slice_and_in_many(spark, make_docs, odd_rows):
    items, rows = cases()
    rows = odd_rows + rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str((i, *brute(t, items))) for i, t in rows)
    for chars in (16_000_000, 600):
        got = decontaminate.scan_benchmark(make_docs(rows), bench, slice_chars=chars).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got) == want


def test_filter_keeps_whole_rows(spark, make_docs):
    items, rows = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(i for i, t in rows if brute(t, items)[2] < 3)
    for chars in (16_000_000, 600):
        kept = decontaminate.drop_contaminated(make_docs(rows), bench, min_items=3, slice_chars=chars)
        assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == make_docs([]).columns


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan_benchmark(make_docs([]), none).count() == 0
    row = decontaminate.scan_benchmark(make_docs([(1, "a b")]), none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
