import hashlib
import random
import re

import numpy as np

from midbase.llm import secrets


def brute(text):
    out = []
    for m in re.finditer(secrets.ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def test_base_spans_equal_their_definition(spark, make_docs, odd_rows):
    rng = random.Random(2)
    bits = ["password", "Passwd", "token", "API_KEY", "apikey", "secret", "=", ":", " = '", '": "', " ", "\n", "abc", "AKIA", "ABCDEFGHIJ012345", "0123456789abcdef", "deadbeef", "é", "ſecret"]
    rows = odd_rows + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(300)]
    got = secrets.scan_secrets(make_docs(rows)).collect()
    assert len(got) == len(rows)

    def line(i, t):
        spans = brute(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        return str((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()))

    assert sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got) == sorted(line(i, t) for i, t in rows)
    assert secrets.scan_secrets(make_docs([])).count() == 0


def test_field_on_held_out_sentences():
    crf = secrets.model()
    right = found = missed = wrong = 0
    for tokens, tags, whole in secrets._generated(np.random.default_rng(123), 300):
        got = crf.decode(secrets.features(tokens, whole))
        right += sum(a == b for a, b in zip(got, tags))
        found += sum(a == b == 0 for a, b in zip(got, tags))
        missed += sum(b == 0 != a for a, b in zip(got, tags))
        wrong += sum(a == 0 != b for a, b in zip(got, tags))
    assert found / (found + missed) > 0.95 and found / (found + wrong) > 0.95


def test_viterbi_equals_search_of_all_paths():
    crf = secrets.model()
    rng = np.random.default_rng(3)
    for _ in range(20):
        rows = [tuple(rng.choice(len(secrets.FEATURES), 4, replace=False)) for _ in range(5)]
        score = np.array([crf.emit[list(r)].sum(axis=0) for r in rows])
        paths = np.stack(np.meshgrid(*[range(3)] * 5, indexing="ij"), -1).reshape(-1, 5)
        total = [crf.move[2, p[0]] + crf.move[p[-1], 2] + score[range(5), p].sum() + crf.move[p[:-1], p[1:]].sum() for p in paths]
        assert list(paths[int(np.argmax(total))]) == crf.decode(rows)


def test_stretches_decode_as_the_whole_text():
    crf = secrets.model()
    assert crf.margin > 0
    rng = random.Random(4)
    bits = ["the", "word", "is", "ab12cd34ef56", "token:", "2024-01-02", "Zx9Qy8Wv7Ut6Sr5Po4", "été", "(", ")", '"', "internationalisation", "k=v", "password", "x1", "\n"]
    for _ in range(200):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
        whole = secrets.Model(crf.emit, crf.move)
        whole.margin = -1.0
        assert secrets.crf_spans(text, crf) == secrets.crf_spans(text, whole), text


def test_words_after_any_cue_decode_as_in_the_whole_text():
    crf = secrets.model()
    whole = secrets.Model(crf.emit, crf.move)
    whole.margin = -1.0
    rng = random.Random(5)
    cues = [*sorted(secrets.CUES), "Authorization", "KEY", "pwd", "key=", "_auth_", "to\u212aen", "my_key", "keys"]
    bits = [":", "=", " = ", ": ", ":=", '"', "'", " '", "correcthorsebattery", "hunterhunter", "swordfishes", "for", "admin", "the", "(", "ab12cd34ef56", "word-word", "\n", "été", "20240102", "k=v"]
    decoded = 0
    for _ in range(4000):
        text = "".join(rng.choice(cues if rng.random() < 0.2 else bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 40)))
        want = secrets.crf_spans(text, whole)
        assert secrets.crf_spans(text, crf) == want, text
        decoded += len(want)
    assert decoded > 1000
    for text in ("then Authorization: correcthorsebattery", "the key: hunterhunter", "set auth = swordfishes", "pwd: swordfishes", "password for admin: correcthorse", "bearer = 'swordfishes'"):
        filled = " ".join(["word"] * 50)
        text = f"{filled} {text} {filled}"
        (got,) = secrets.crf_spans(text, crf)
        assert text[got[0] : got[2]] == text.split(filled)[1].split()[-1].strip("'")


def test_field_finds_a_secret_the_detectors_miss():
    text = "and then the key is Zx9Qy8Wv7Ut6Sr5Po4Nm3Lk2, as we said in chapter 12 of the 2019-11-12 report"
    assert brute(text) == []
    assert [text[a:b] for a, _, b in secrets.crf_spans(text, secrets.model())] == ["Zx9Qy8Wv7Ut6Sr5Po4Nm3Lk2"]
