import numpy as np

from midbase.llm import ann


def brute(ids, x, k=5):
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x * x[i]).sum(axis=1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.integers(0, 60, 4000)] + 0.6 * rng.normal(size=(4000, 32))).astype(np.float32)
    x[1000:1400] = x[7]  # a hot group of copies
    ids = np.arange(4000)
    want = brute(ids, x.astype(np.float64))
    got = {}
    for r in ann.search(frame(spark, ids.tolist(), x.tolist())).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want]) >= 0.9
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - exact[q][a]) < 1e-12 for q, v in got.items() for a, s in v if a in exact[q])
    assert all(v == sorted(v, key=lambda z: (-z[1], z[0])) for v in got.values())


def test_two_levels_of_parts(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[200:900] = x[3]  # a part that no classifier can cut
    want = brute(np.arange(3000), x.astype(np.float64))
    got = {}
    for r in ann.search(frame(spark, list(range(3000)), x.tolist()), fine=260).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e300, -1e300]), (3, [5e-324, 0.0])]
    got = [(r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert [a for a, _ in got] == [1, 3, 2] and np.allclose([s for _, s in got], [1, 0.5**0.5, 0])


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (50, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (100, [0.0, 2.0])]
    df = frame(spark, [i for i, _ in rows], [v for _, v in rows])
    for c in ("id", "x", "part", "vb", "qb", "score", "rank"):
        df = df.withColumn(c, df.vec_id)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 100, 0.0), (100, 1, 3, 1.0), (100, 2, 0, 0.0), (100, 3, 1, 0.0), (100, 4, 2, 0.0)]
    assert ann.search(frame(spark, [], [])).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = ann.unit(rng.normal(size=(1024, 16)))
    graph = ann.nearest(x, x, 10, own=True)
    part = ann.balanced_parts(x, graph, 8, rng)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 128)
    assert (part[graph] == part[:, None]).mean() > 2 / 8
