"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Fit, on at most SAMPLE vectors chosen by a hash of the id: the graph of nearest neighbours is cut into
balanced parts (median splits, then moves of nodes to the part of most of their neighbours under a
capacity), and a small two-layer classifier learns which parts a vector's neighbours lie in. Held-out vectors
tell how many of the most probable parts must be probed for the wanted recall.

Search: the classifier puts every vector into its most probable part and routes every query to its
`probes` most probable parts. Parts of more than FINE vectors are partitioned once more in the same way, by a classifier
fitted on a sample of their own, so there are up to 4,096 parts, their number grows with the vectors, and what a query is compared
with stays about FINE vectors a probe up to some 250 million vectors. Parts are split into blocks of about BLOCK vectors and
QUERY_BLOCK queries by hashes of the ids, so a part that holds a third of all rows (copies of one vector, say) is many tasks; every
query meets all blocks of its parts. Blocks of queries are large, so it is the few queries that are sent to several
blocks and hardly ever a vector. A block keeps the best k per query, so rows grow with the queries.
Scores are cosines in double precision, summed in one fixed order, so equal vectors get equal scores.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components,
and rows without an id, take no part; very large or small components are fine (vectors are scaled by a power of two first, which
changes no cosine); rows that repeat an id are one vector (the smallest); ties go to
the smaller id; with fewer candidates than k all are returned; an empty table has no queries; ids must be whole numbers (an error
otherwise); further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from . import common

SAMPLE, HELD_OUT, NEIGHBOURS, HIDDEN = 8192, 512, 10, 128
MOST_PARTS, ROWS_A_PART = 64, 128
RECALL = 0.985  # of either level, on held-out vectors
FINE, BLOCK, QUERY_BLOCK = 65_536, 16_384, 65_536


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings their largest component to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(q: np.ndarray, x: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Row numbers of the k nearest of x for each unit vector of q; own: q is x, skip the row itself."""
    out = np.empty((len(q), k), np.int64)
    for i in range(0, len(q), 1024):
        s = q[i : i + 1024] @ x.T
        if own:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Part of each node: median splits along random directions, then capacity-bound moves that cut fewer edges."""
    part = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        side = np.zeros(len(x), np.int64)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            a, b = x[own[rng.integers(len(own))]], x[own[rng.integers(len(own))]]
            order = np.argsort(x[own] @ (a - b), kind="stable")
            side[own[order[len(own) // 2 :]]] = 1
        part = 2 * part + side
    size, most = np.bincount(part, minlength=parts), int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(len(x)):
            votes = np.bincount(part[graph[v]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != part[v])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[v]]:
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return part


@dataclass
class Router:
    """The classifier's weights, and how many parts to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 30, batch: int = 128, rate: float = 3e-3) -> Router:
    """Cross entropy to the shares of each vector's neighbours in the parts, by Adam."""
    parts = target.shape[1]
    w = [rng.normal(0, 1.5, (x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(0, 1, (HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            own = order[i : i + batch]
            a, y = x[own], target[own]
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - y) / len(own)
            back = (g @ w[2].T) * (h > 0)
            step += 1
            for v, d, (m, s) in zip(w, (a.T @ back, back.sum(0), h.T @ g, g.sum(0)), moments):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Router(*w)


def fit(x: np.ndarray, k: int = 5, recall: float = RECALL, seed: int = 3) -> Router:
    """Partition the sample's neighbour graph and learn the routing."""
    rng = np.random.default_rng(seed)
    x = unit(x)
    parts = 1 << max(0, min(MOST_PARTS, len(x) // ROWS_A_PART).bit_length() - 1) if len(x) >= ROWS_A_PART else 1
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    order = rng.permutation(len(x))
    held, x = x[order[: min(HELD_OUT, len(x) // 8)]], x[order[min(HELD_OUT, len(x) // 8) :]]
    graph = nearest(x, x, min(NEIGHBOURS, len(x) - 1), own=True)
    part = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    for column in [part, *part[graph].T]:
        np.add.at(target, (np.arange(len(x)), column), 1)
    router = _train(x, target / target.sum(axis=1, keepdims=True), rng)
    where = router.logits(x).argmax(axis=1)[nearest(held, x, min(k, len(x)))]
    logits = router.logits(held)
    rank = (logits[:, None, :] > np.take_along_axis(logits, where, 1)[:, :, None]).sum(axis=2)
    router.probes = next((p for p in range(1, parts) if (rank < p).mean() >= recall), parts)
    return router


def _routed(router: Router, dim: int, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = scaled(batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim))
            logits = router.logits(unit(x))
            times = router.probes if query else 1
            part = np.argsort(-logits, axis=1, kind="stable")[:, :times].ravel()
            ids = np.repeat(batch.column("id").to_numpy(), times)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([r for r in raw for _ in range(times)], pa.binary()), pa.array(part.astype(np.int32))],
                names=["id", "x", "part"],
            )

    return run


def _refined(routers: dict[int, Router], query: bool):
    """Rows of parts that have a router of their own go to their most probable parts there, numbered behind all first parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            take, to = [np.flatnonzero(~np.isin(part, list(routers)))], []
            to.append(part[take[0]])
            for p, router in routers.items():
                if len(own := np.flatnonzero(part == p)):
                    x = np.frombuffer(b"".join(batch.column("x").take(pa.array(own)).to_pylist()), "<f8").reshape(len(own), -1)
                    times = router.probes if query else 1
                    best = np.argsort(-router.logits(unit(x)), axis=1, kind="stable")[:, :times]
                    take.append(np.repeat(own, times))
                    to.append((MOST_PARTS * (p + 1) + best).ravel())
            rows = batch.take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("x"), pa.array(np.concatenate(to).astype(np.int32))], names=["id", "x", "part"])

    return run


def _fine_routers(index: DataFrame, sizes: dict[int, int], k: int, recall: float, fine: int) -> dict[int, Router]:
    """A router for each part of more than `fine` vectors, fitted on about SAMPLE of its own. At most MOST_PARTS come to the driver."""
    large = {p: n for p, n in sizes.items() if n > fine}
    if not large:
        return {}
    share = F.create_map(*[F.lit(v) for p, n in large.items() for v in (p, min(1.0, SAMPLE / n))])
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.try_element_at(share, F.col("part")) * (1 << 20)

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        r = fit(np.frombuffer(b"".join(rows["x"]), "<f8").reshape(len(rows), -1), k, recall)
        weights = [w.astype(np.float32) for w in (r.w1, r.b1, r.w2, r.b2)]
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "probes": [r.probes], "w": [[w.tobytes() for w in weights]]})

    models = index.filter(drawn).groupBy("part").applyInPandas(own, "part int, probes int, w array<binary>").collect()
    out = {}
    for m in models:
        w1, b1, w2, b2 = (np.frombuffer(w, np.float32).astype(np.float64) for w in m["w"])
        out[m["part"]] = Router(w1.reshape(-1, len(b1)), b1, w2.reshape(len(b1), -1), b2, m["probes"])
    return out


def _best(k: int):
    """The k best of a block's vectors for each of its queries, ties to the smaller id."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(queries) or not len(vectors):
            return pd.DataFrame({n: [] for n in names}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        q, x = (np.frombuffer(b"".join(d["x"]), "<f8").reshape(len(d), -1) for d in (queries, vectors))
        qid, vid = queries["id"].to_numpy(), vectors["id"].to_numpy()
        nq, nx = (np.sqrt((a * a).sum(axis=1)) for a in (q, x))
        out = []
        for i in range(0, len(q), 256):
            s = (q[i : i + 256] / nq[i : i + 256, None]) @ (x / nx[:, None]).T
            s[qid[i : i + 256, None] == vid[None, :]] = -9
            cut = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            for j in range(len(s)):
                near = np.flatnonzero((s[j] >= cut[j] - 1e-9) & (s[j] > -5))
                exact = (x[near] * q[i + j]).sum(axis=1) / (nx[near] * nq[i + j])
                order = np.lexsort((vid[near], -exact))[:k]
                out.append((np.full(len(order), qid[i + j]), vid[near[order]], exact[order]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*out))})

    return run


@common.owned
def search(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, fine: int = FINE
) -> DataFrame:
    """The k nearest of each vector whose id is divisible by `every`: query_id, rank, id, score."""
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise ValueError("ids must be whole numbers")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter("id is not null and size(x) > 0")
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.filter(usable)
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    rows = rows.filter(F.size("x") == dim)
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("x").alias("x"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    router = fit(scaled(np.array(sample["x"].tolist(), dtype=np.float64).reshape(-1, dim)), k, recall)
    kind = "id long, x binary, part int"
    index = common.staged(rows.mapInArrow(_routed(router, dim, False), kind), "index")
    asked = common.staged(rows.filter(F.col("id") % every == 0).mapInArrow(_routed(router, dim, True), kind), "asked")

    def sizes_of(df: DataFrame) -> dict[int, int]:  # one row per part, of which there is a bounded number
        return {r["part"]: r["n"] for r in df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    if routers := _fine_routers(index, sizes_of(index), k, recall, fine):
        coarse = index, asked
        index, asked = common.staged(index.mapInArrow(_refined(routers, False), kind), "index"), common.staged(asked.mapInArrow(_refined(routers, True), kind), "asked")
        common.release(*coarse)

    def spread(df: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, theirs: str) -> DataFrame:
        count = lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v).cast("int") for kv in (d or {-1: 1}).items() for v in kv]), F.col("part")), F.lit(1))
        return df.withColumn(mine, F.pmod(F.xxhash64("id"), count(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), count(other) - 1)))

    vb = {p: -(-n // BLOCK) for p, n in sizes_of(index).items()}
    qb = {p: -(-n // QUERY_BLOCK) for p, n in sizes_of(asked).items()}
    keys = ["part", "vb", "qb"]
    left = spread(asked, qb, vb, "qb", "vb").groupBy(*keys)
    right = spread(index, vb, qb, "vb", "qb").groupBy(*keys)
    found = left.cogroup(right).applyInPandas(_best(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


@common.owned
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
