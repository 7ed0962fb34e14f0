import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from midbase.llm import packing
from midbase.llm.ordered import running_total

from .conftest import prose


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_every_id_lies_in_one_piece(spark, make_docs, odd_rows):
    rng = random.Random(1)
    odd = ["<|endoftext|> plain", "end <|endoftext|> of<|endoftext|>", "<|endoftext",  "tab\tnew\n\n\nline  é ß 漢字 🙂 don't I'LL 12345", "a" * 3000, "\u0000​ x"]
    rows = [(i, t) for i, t in odd_rows if i not in (5, None)] + [(100 + i, t) for i, t in enumerate(odd)]
    rows += [(200 + i, prose(rng, rng.randrange(400))) for i in range(60)]
    got = packing.pack(make_docs(rows)).collect()
    ids = dict(zip([i for i, _ in rows], reference_ids([t for _, t in rows])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[doc])
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes))) and sorted(sizes)[1:] == [2048] * (len(sizes) - 1)


def round_robin(queues, quanta, rounds, phases, length):
    """Plain deficit round-robin: shares of every window by source. queues: tokens left by source."""
    left, deficit, windows, at = dict(queues), {s: phases[s] * quanta[s] for s in queues}, [defaultdict(int)], 0
    sent = {s: -1 for s in queues}  # blocks so far
    n = 0
    while any(left.values()):
        n += 1
        for s in sorted(left):
            deficit[s] += quanta[s]
            size = quanta[s] * rounds[s]
            if left[s] and deficit[s] >= size:
                deficit[s] -= size
                sent[s] += 1
                m = min(left[s], ((sent[s] + 1) * size >> 16) - (sent[s] * size >> 16))
                left[s] -= m
                while m:
                    now = min(m, length - at)
                    windows[-1][s] += now
                    at, m = at + now, m - now
                    if at == length:
                        windows.append(defaultdict(int))
                        at = 0
    return [dict(w) for w in windows if w]


def shares(got, source):
    out = defaultdict(lambda: defaultdict(int))
    for r in got:
        out[r.sequence_id]["s" + source(r.doc_id)] += r.length
    return [dict(out[k]) for k in sorted(out)]


def test_windows_are_those_of_a_round_robin(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([30, 300, 3000]), 50)) for i in range(150)]
    source = lambda i: "hot" if i % 3 == 0 else "rare" if i % 75 == 1 else f"s{i % 17}"
    docs = make_docs(rows, source)
    phase = {r.s: r.h for r in docs.selectExpr("'s' || source as s", "xxhash64('s' || source) as h").distinct().collect()}
    for targets in (None, {"hot": 0.5, "s1": 0.25, "s2": 0.2, "rare": 0.05}):
        got = packing.pack(docs, targets=targets, least_block=16).collect()
        total = defaultdict(int)
        for r in got:
            total["s" + source(r.doc_id)] += r.length
        every = sum(total.values())
        share = {s: total[s] / every if targets is None else targets.get(s[1:], 1 / 2048) for s in total}
        quanta = {s: max(1, int(share[s] * 2048 * 65536)) for s in total}
        rounds = {s: -(-16 * 65536 // q) for s, q in quanta.items()}
        want = round_robin(total, quanta, rounds, {s: phase[s] % rounds[s] for s in total}, 2048)
        found = shares(got, source)
        assert found == want
        if targets is None:  # queues end together, and every full window is within a few tokens of every target
            assert len(total) >= 18 and "srare" in total and rounds["srare"] > 1
            for w in found[:-2]:
                for s in total:
                    assert abs(w.get(s, 0) - share[s] * 2048) <= 2 * max(16, 3), (s, w.get(s, 0), share[s] * 2048)


def test_targets_and_odd_rows(spark, make_docs, odd_rows):
    got = packing.pack(make_docs(odd_rows), targets={"src0": 3.0, "src1": 1.0}).collect()
    assert sum(r.length for r in got) == sum(map(len, reference_ids([t for _, t in odd_rows])))
    assert packing.pack(make_docs([])).count() == 0


def test_running_total(spark):
    rng = random.Random(3)
    rows = [(g if g != 1 else 0, i, rng.randrange(9)) for i in range(500) for g in [rng.randrange(3)]]
    got = running_total(spark.createDataFrame(rows, "g int, i int, v int"), ["i"], "v", "t", ["g"]).collect()
    want, at = {}, defaultdict(int)
    for g, i, v in sorted(rows):
        want[i] = at[g]
        at[g] += v
    assert {r.i: r.t for r in got} == want
