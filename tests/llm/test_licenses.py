import random
import re

from midbase.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = fold(text)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(spark, make_docs, odd_rows):
    rng = random.Random(1)
    bits = ["MIT", "license", "mit", "License.", "Apache", "general", "GENERAL", "public", "public", "été", "x", "Key", "İ"]
    rows = odd_rows + [(100 + i, " ".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(60)]
    got = licenses.scan_licenses(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str((i, *brute(t))) for i, t in rows))
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want


def test_notice_with_words_left_out_and_put_in(spark, make_docs):
    words = licenses.NOTICES["gpl-notice"].split()
    changed = " ".join(words[:9] + ["really"] + words[9:15] + words[16:])
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs([(1, changed), (2, " ".join(words)), (3, " ".join(words[::-1]))])).collect()}
    assert got[2].labels == "gpl,gpl-notice" and got[2].score == 1.0
    assert "gpl-notice" in got[1].labels
    assert got[3].labels == "" and got[3].score == 0


def test_empty_table(spark, make_docs):
    assert licenses.scan_licenses(make_docs([])).count() == 0
