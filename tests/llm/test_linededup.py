import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from midbase.llm import common
from midbase.llm import linededup as L

from .conftest import prose


def covered(texts, run):
    """Words of each text that lie in a run of `run` words that an earlier place has too."""
    seen, out = set(), []
    for text in texts:
        w = (text or "").split()
        own = [False] * len(w)
        for i in range(len(w) - run + 1):
            key = tuple(w[i : i + run])
            if key in seen:
                own[i : i + run] = [True] * run
            seen.add(key)
        out.append(own)
    return out


def check_exact(cut, rows):
    """What goes is what lies in a run of LEAST words that an earlier place has, or in a stored line that one has, and no word more."""
    must = covered([t for _, t in rows], L.LEAST)
    got = {r.doc_id: r for r in cut.collect()}
    seen = set()
    for (i, text), gone in zip(rows, must):
        at = 0
        for line in (text or "").split("\n"):
            words = line.split()
            if words and tuple(words) in seen:
                gone[at : at + len(words)] = [True] * len(words)
            seen.add(tuple(words))
            at += len(words)
        assert (got[i].text or "").split() == [w for w, g in zip((text or "").split(), gone) if not g], i
        assert got[i]["__cut"].removed == sum(gone)


def planted():
    rng = random.Random(11)
    passage = prose(rng, 60, 10**6)
    short = prose(rng, 20, 10**6)
    rows = []
    for i in range(30):
        body = prose(rng, 90, 10**6).split()
        at = rng.randrange(90)
        rows.append((i, " ".join(body[:at] + (passage if i % 3 == 0 else short).split() + body[at:])))
    return passage, short, rows


def test_passages_go_from_later_texts_only(spark, make_docs):
    passage, short, rows = planted()
    got = {r.doc_id: r for r in L.cut_repeats(make_docs(rows)).collect()}
    for i, text in rows:
        want = text if i == 0 or i % 3 else text.replace(passage, "").replace("  ", " ")
        assert got[i].text.split() == want.split()
        assert got[i]["__cut"].removed == len(text.split()) - len(want.split())
        assert short in got[i].text or i % 3 == 0


def test_what_goes_is_what_an_earlier_text_has(spark, make_docs, odd_rows):
    rng = random.Random(12)
    base = [prose(rng, 300, 10**6) for _ in range(4)]
    rows = [(i, t) for i, t in odd_rows if i not in (5, None)]
    for i in range(40):
        a, b = rng.choice(base).split(), rng.choice(base).split()
        x, y = rng.randrange(250), rng.randrange(250)
        rows.append((100 + i, "\n".join([" ".join(a[x : x + rng.randrange(10, 200)]), prose(rng, 5, 10**6), "  ".join(b[y : y + rng.randrange(10, 200)])])))
    rows.sort()
    check_exact(L.cut_repeats(make_docs(rows)), rows)


def test_stored_lines_repeat(spark, make_docs):
    """Each stored line but its first copy goes, however short, and nothing else does."""
    rng = random.Random(14)
    pool = ["Les.", "All rights  reserved.", *(prose(rng, n, 10**6) for n in (1, 4, 9, 23, 24, 30, 46))]
    rows, seen, want = [], set(), {}
    for i in range(40):
        lines = [rng.choice([*pool, "", "\t ", prose(rng, 7, 10**6)]) for _ in range(rng.randrange(12))]
        rows.append((i, rng.choice(["\n", "\r\n", " \n\n  "]).join(lines) + rng.choice(["", "\n"])))
        want[i] = []
        for words in map(str.split, lines):
            if tuple(words) not in seen:
                want[i] += words
            seen.add(tuple(words))
    for r in L.cut_repeats(make_docs(rows)).collect():
        text = dict(rows)[r.doc_id]
        assert r.text.split() == want[r.doc_id] and r["__cut"].removed == len(text.split()) - len(want[r.doc_id])
        assert r["__cut"].emptied == (bool(text.split()) and not want[r.doc_id])
        assert r["__cut"].removed or r.text == text


def test_odd_rows(spark, make_docs, odd_rows):
    got = L.cut_repeats(make_docs(odd_rows))
    rows = got.collect()
    assert len(rows) == len(odd_rows) and set(make_docs([]).columns) < set(got.columns)
    base = odd_rows[0][1]
    assert sum(r.text == base for r in rows) == 1 and next(r.doc_id for r in rows if r.text == base) == 1
    assert sum(r["__cut"].removed == 120 and r.text == "" and r["__cut"].emptied for r in rows) == 3 == sum(r["__cut"].emptied for r in rows)
    assert next(r for r in rows if r.doc_id == 2).text is None
    assert next(r for r in rows if r.doc_id == 4).text == odd_rows[3][1]
    assert L.cut_repeats(make_docs([])).count() == 0


def test_texts_repeat_within_themselves(spark, make_docs):
    rng = random.Random(13)
    once = prose(rng, 70, 10**6)
    text = f"{once} {prose(rng, 9, 10**6)} {once}"
    (row,) = L.cut_repeats(make_docs([(1, text)])).collect()
    assert row["__cut"].removed == 70 and row.text.split() == text.split()[:79]


def test_passages_that_earlier_texts_have_in_part(spark, make_docs):
    """An excerpt that comes first takes fingerprints of a passage; the passage's later copies go all the same."""
    rng = random.Random(15)
    rows = []
    for i in range(0, 400, 4):
        passage = prose(rng, rng.randrange(L.LEAST, 71), 10**6).split()
        for k, n in enumerate((rng.randrange(24, 47), rng.randrange(24, 47), len(passage), len(passage))):
            at = rng.randrange(len(passage) - n + 1)
            rows.append((i + k, " ".join([prose(rng, 20, 10**6), *passage[at : at + n], prose(rng, 20, 10**6)])))
    must = covered([t for _, t in rows], L.LEAST)
    got = {r.doc_id: r for r in L.cut_repeats(make_docs(rows)).collect()}
    assert sum(map(any, must)) >= 100
    for (i, text), sure in zip(rows, must):
        if i % 4 == 3:
            assert got[i].text.split() == [w for w, own in zip(text.split(), sure) if not own], i


def test_nothing_of_a_long_copy_is_lost(spark, make_docs, odd_rows):
    rng = random.Random(16)
    base = [prose(rng, 300, 10**6).split() for _ in range(3)]
    rows = [(i, t) for i, t in odd_rows if i not in (5, None)]
    for i in range(80):
        cuts = []
        for words in rng.sample(base, 2):
            at = rng.randrange(250)
            cuts.append("  ".join(words[at : at + rng.randrange(10, 120)]))
        rows.append((100 + i, f"{cuts[0]}\n{prose(rng, 5, 10**6)} {cuts[1]}" + rng.choice(["", " \n"])))
    check_exact(L.cut_repeats(make_docs(rows)), rows)


def test_hubs_that_hold_the_fingerprint_lines_only(spark, make_docs):
    """Earlier texts that each hold a line of the passage take nothing from its copies; neither do frequent lines."""
    rng = random.Random(17)
    rows = []
    for i in range(0, 90, 9):
        passage = prose(rng, rng.choice([L.LEAST, 60, 90]), 10**6).split()
        for k in range(7):
            at = rng.randrange(len(passage) - 24)
            rows.append((i + k, " ".join([prose(rng, 15, 10**6), *passage[at : at + 24], prose(rng, 15, 10**6)])))
        rows += [(i + k, " ".join([prose(rng, 15, 10**6), *passage, prose(rng, 15, 10**6)])) for k in (7, 8)]
    check_exact(L.cut_repeats(make_docs(rows)), rows)


def test_periodic_texts(spark, make_docs):
    """Equal lines and contexts next to each other: of a text that repeats itself the first run stays."""
    texts = ["spam " * n for n in (46, 47, 48, 70, 300)] + ["a b c " * 40, "x " + "spam " * 60, ("p q " * 30 + "r ") * 4]
    rows = [(i, t.strip()) for i, t in enumerate(texts)]
    check_exact(L.cut_repeats(make_docs(rows)), rows)
    check_exact(L.cut_repeats(make_docs(rows[3:4])), rows[3:4])


def test_columns_of_any_name_and_ids_of_any_type(spark):
    rng = random.Random(18)
    once = prose(rng, 60, 10**6)
    rows = [(f"id{i}", once if i else once + " x", 99, [1], "kept", i) for i in range(3)]
    names = ["doc_id", "text", "__key", "__runs", "row", "__w"]
    got = L.cut_repeats(spark.createDataFrame(rows, names)).orderBy("doc_id").collect()
    assert [tuple(r)[2:6] for r in got] == [(99, [1], "kept", i) for i in range(3)]
    assert [r["__cut"].removed for r in got] == [0, 60, 60]
    got = L.cut_repeats(spark.createDataFrame(rows, names), report="__key")
    assert got.columns == ["doc_id", "text", "__runs", "row", "__w", "__key"]


def test_sizes_that_leave_gaps_are_refused(spark, make_docs):
    with pytest.raises(ValueError):
        L.cut_repeats(make_docs([(1, "a")]), line=12, window=16)


def test_a_window_is_cut_out_and_searched_once(spark, make_docs):
    own = make_docs([(1, "a b")]).select(F.col("doc_id").alias("__key"), "text")
    plan = L.fingerprints(own)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(") == 1


def test_hashes_are_written_without_dictionaries(spark, make_docs, tmp_path):
    common.write(make_docs([(1, "a")]).select("doc_id"), f"{tmp_path}/t", dictionary=False)
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(0) for f in tmp_path.glob("t/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert columns and not any(c.has_dictionary_page for c in columns)


def test_white_space_stays_with_the_lines_that_stay(spark, make_docs):
    rows = [(1, "one two\nthree\n"), (2, " \n\tone  two \n\n  keep this \r\n\x0b\nthree\n\n last\t"), (3, "three\n\none two"), (4, "x\nthree \n"), (5, "three\n y z")]
    cut = L.cut_repeats(make_docs(rows))
    got = {r.doc_id: (r.text, r["__cut"].removed, r["__cut"].emptied) for r in cut.collect()}
    assert got == {
        1: (rows[0][1], 0, False), 2: ("one  two \n\n  keep this \r\n\x0b\nlast\t", 1, False), 3: ("", 3, True), 4: ("x\n", 1, False), 5: ("y z", 1, False),
    }


def test_first_places_are_found_by_hashing(spark):
    """Where keys are small, also negative ones, a place is one long; the result is that of structs, which are sorted."""
    rng = random.Random(19)
    keys = [-(2**27) + 1, -1, 0, 7, 2**27 - 1]
    rows = [(rng.randrange(4), rng.choice(keys), p := rng.randrange(32, 2**31), p - rng.randrange(32)) for _ in range(300)]
    rows += [(9, -3, 40, 40 - j) for j in (3, 9, 0)]
    found = spark.createDataFrame(rows, "a int, __key long, p int, i int")
    assert L.small_keys(found) and not L.small_keys(found.withColumn("__key", -F.lit(2**27).cast("long")))
    fast = L.firsts(found, ["a"], True, L.WINDOW)
    assert sorted(fast.collect()) == sorted(L.firsts(found, ["a"], False, L.WINDOW).collect())
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_ids_too_large_for_one_long(spark, make_docs):
    _, _, rows = planted()
    rows = [(2**62 + i, t + "\nthe end of it\n") for i, t in rows]
    check_exact(L.cut_repeats(make_docs(rows)), rows)
