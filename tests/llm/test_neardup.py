import random

import numpy as np

from midbase.llm import neardup
from midbase.llm.components import components

from .conftest import prose


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = [shingle_set(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    smallest = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            smallest[x] = min(i, smallest.get(x, i))
    return [(i, len(s), smallest.get(x)) for (i, _), s, x in zip(rows, sets, label)]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force(spark, make_docs, odd_rows):
    rng = random.Random(5)
    rows = list(odd_rows)
    for g in range(12):
        base = prose(rng, rng.choice([5, 9, 40, 150]), 5000)
        rows += [(1000 + 100 * g + j, edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 20))) for j in range(14)]
    got = neardup.near_duplicates(make_docs(rows), k=4).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(str(x) for x in brute(rows, 4))
    unique = [r for r in got if r.doc_id not in (None, 5)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in unique)
    assert sum(r.kept for r in got if r.doc_id in (1, 5, None)) == 1


def test_one_of_each_group_stays(spark, make_docs, odd_rows):
    kept = neardup.drop_near_duplicates(make_docs(odd_rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "8"]
    assert kept.columns == make_docs([]).columns
    assert neardup.near_duplicates(make_docs([])).count() == 0


def test_registers_are_mergeable_and_as_alike_as_the_sets():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64)) for _ in range(2))
    shared = np.unique(rng.integers(0, 2**63, 9000, dtype=np.uint64))
    x, y = np.union1d(a, shared), np.union1d(b, shared)
    sx, sy = neardup.sketch(x), neardup.sketch(y)
    assert (np.maximum(sx, sy) == neardup.sketch(np.union1d(x, y))).all()
    assert abs((sx == sy).mean() - 9000 / 15000) < 0.12
    n = np.array([len(x)]), np.array([len(y)])
    assert neardup.likely(sx[None], sy[None], *n, 0.6)[0] and not neardup.likely(sx[None], sy[None], *n, 0.95)[0]


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
