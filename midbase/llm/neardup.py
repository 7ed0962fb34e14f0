"""Near-duplicate documents by SetSketch registers, joint likelihood and exact verification.

1. Each document's set of word shingles gives a digest of the whole set and a SetSketch: per register
   the smallest of exponentially distributed hash values, truncated to powers of a base. Registers of
   a union are the maxima of the parts' registers, and equal registers are as likely as the sets are
   alike. Documents with equal sets form one class; only the class's first document goes on.
2. Bands of register values are hashed into buckets. In each bucket every class is paired with the
   bucket's smallest one, so pairs grow with the rows of a bucket and not with their square.
3. For each pair the similarity is estimated jointly by maximum likelihood from the registers above,
   below and equal and the two set sizes. Pairs whose likelihood speaks clearly against the threshold
   go; the rest are confirmed on their full sets.
4. Confirmed links give connected components. Buckets whose classes then lie in several components are
   compared once more in blocks, members of different components only, each pair in the first band that it
   shares: first by their sketches, then those members that may have a link bring their full sets.
   Pairs that pass the likelihood test are confirmed on these, the likeliest first,
   and a pair whose components have meanwhile been joined is passed over, so a block emits fewer links than
   it has components. So no pair that shares a bucket is left unjudged.

With 40 bands of 5 registers a pair at similarity 0.8 shares no bucket with probability 1e-7.

Cases: a null, empty or wordless text has an empty set, is linked with nothing and stays; a text of
fewer words than a shingle has its whole word sequence as one shingle; documents with equal sets are
linked; a very long text is one set, made by one worker in a row of its own, 8 bytes a shingle; rows that repeat an id are documents
of their own, of which the first stays; rows without an
id are linked by their sets, but a component is named by its smallest id (null if it has none); ids may be of any type that has an
order; an empty table stays empty; further columns are ignored, or kept where rows are filtered, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and the number of values above which registers are truncated.
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
#: A pair is dropped if its best likelihood exceeds that at the threshold by so many nats.
AGAINST = 15.0
BLOCK = 256

_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


class _WordHashes(dict):
    """Word to 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word k-shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[j : j + n]
    return np.unique(common.mix(out))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS truncated exponential minima as uint16."""
    short = (common.mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(least, (short[i : i + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def bands(registers: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of each sketch (rows x BANDS)."""
    x = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
    for j in range(ROWS):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return out.view(np.int64)


def _likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, above, below, equal) -> np.ndarray:
    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)

    up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1.0))


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair of sketches (rows of a and b) may have the similarity `threshold`."""
    u, v = na / (na + nb), nb / (na + nb)
    above, equal = (a > b).sum(axis=1), (a == b).sum(axis=1)
    below = a.shape[1] - above - equal
    most = np.minimum(u / v, v / u)
    low, high = np.zeros(len(u)), most.copy()
    for _ in range(30):  # the likelihood is concave
        third = (high - low) / 3
        left = _likelihood(low + third, u, v, above, below, equal) < _likelihood(high - third, u, v, above, below, equal)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    best = (low + high) / 2
    lost = _likelihood(best, u, v, above, below, equal) - _likelihood(
        np.full(len(u), threshold), u, v, above, below, equal
    )
    return (most >= threshold - 1e-9) & ((best >= threshold) | (lost <= AGAINST))


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), k)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) > 3 else None)
            yield pa.RecordBatch.from_pydict({
                "__key": batch.column("__key"), "id": batch.column("id"), "n": pa.array(sizes, pa.int64()),
                "digest": pa.array(digests, pa.binary()), "sketch": pa.array(sketches, pa.binary()),
            })
        _hashes.clear()  # the worker lives on and runs other stages

    return run


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            found = bands(_matrix(part.column("sketch").to_pylist()))
            key = np.repeat(part.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(found.ravel()), "rep": pa.array(key)})


def _estimator(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keep = likely(
                    _matrix(part.column("s1").to_pylist()), _matrix(part.column("s2").to_pylist()),
                    part.column("n1").to_numpy(), part.column("n2").to_numpy(), threshold,
                )
                yield part.select(["u", "v"]).filter(pa.array(keep))

    return run


def _judged(rows: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, equal registers): pairs of a bucket's members (or of two of its blocks), sorted by n, that lie in different components,
    share no earlier band and may be alike by their sketches."""
    regs, n = _matrix(rows["sketch"]), rows["n"].to_numpy()
    label, block = rows["label"].to_numpy(), rows["block"].to_numpy()
    banded = bands(regs)
    band = int((banded[0] == rows["bucket"].iloc[0]).argmax())
    two = rows["i"].iloc[0] != rows["j"].iloc[0]
    xs, ys, es = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, int)]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def judge() -> None:
        a, b = (np.concatenate(c) for c in zip(*held))
        keep = likely(regs[a], regs[b], n[a], n[b], threshold)
        xs.append(a[keep])
        ys.append(b[keep])
        es.append((regs[a[keep]] == regs[b[keep]]).sum(axis=1))
        held.clear()

    for x in range(len(rows) - 1):
        y = np.arange(x + 1, np.searchsorted(n, n[x] / threshold + 1e-6, "right"))
        y = y[label[y] != label[x]]
        if two:
            y = y[block[y] != block[x]]
        if band and len(y):
            y = y[~(banded[y, :band] == banded[x, :band]).any(axis=1)]
        held.append((np.full(len(y), x), y))
        if sum(len(v) for _, v in held) > 20_000:
            judge()
    if held:
        judge()
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(es)


def _possible(threshold: float):
    """(bucket, rep) of the members that may have a link to another component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "rep"], ignore_index=True)
        x, y, _ = _judged(rows, threshold)
        return rows.loc[np.union1d(x, y), ["bucket", "rep"]]

    return run


def _across(threshold: float, percent: int):
    """Links of one bucket (or of two of its blocks) between members of different components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "rep"], ignore_index=True)
        label, rep = rows["label"].to_numpy(), rows["rep"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["s"]]
        x, y, equal = _judged(rows, threshold)
        now = {k: k for k in label.tolist()}

        def root(k: int) -> int:
            while now[k] != k:
                now[k] = now[now[k]]
                k = now[k]
            return k

        out = []
        for i in np.argsort(-equal, kind="stable").tolist():
            p, q = root(int(label[x[i]])), root(int(label[y[i]]))
            if p != q and _alike(sets[x[i]], sets[y[i]], percent):
                now[max(p, q)] = min(p, q)
                out.append((min(rep[x[i]], rep[y[i]]), max(rep[x[i]], rep[y[i]])))
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch, "text"):
                sets = [shingles(t.as_py(), k).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(part.num_columns - 1)), pa.array(sets, pa.binary())],
                    names=[*part.schema.names[:-1], "s"],
                )
        _hashes.clear()

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s1"), batch.column("s2")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_alike(a, b, percent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike; the sets are made again for the documents concerned only."""
    partners = common.staged(pairs.groupBy("v").agg(F.collect_list("u").alias("us")), "partners")
    many = common.join_sized(docs, partners.withColumnRenamed("v", "__key"), ["__key"], "inner")
    many = many.select("__key", "us", "text").mapInArrow(_setter(k), "__key long, us array<long>, s binary")
    many = many.select(F.col("__key").alias("v"), F.explode("us").alias("u"), F.col("s").alias("s2"))
    firsts = common.staged(pairs.select(F.col("u").alias("__key")).distinct(), "firsts")
    few = common.join_sized(docs, firsts, ["__key"], "left_semi").select("__key", "text")
    few = few.mapInArrow(_setter(k), "__key long, s binary").select(F.col("__key").alias("u"), F.col("s").alias("s1"))
    return many.join(few.hint("merge"), "u").mapInArrow(_confirmer(percent), "u long, v long")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(docs with __key, one row per document: __key, id, n, comp), comp being the smallest __key reached.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets, percent >= 76
    (below that, sets of three shingles could be alike, which get no sketch).
    """
    if percent <= 75:
        raise ValueError("percent must be over 75")
    threshold = percent / 100
    keyed = common.row_keyed(docs, id_col, text_col)
    texts = keyed.select("__key", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    made = common.staged(
        keyed.select("__key", F.col("row").getField(id_col).alias("id"), "text").mapInArrow(
            _sketcher(k), f"__key long, id {kind}, n long, digest binary, sketch binary"
        ), "sketches")
    classes = common.staged(
        made.filter("digest is not null").groupBy("digest").agg(F.min("__key").alias("rep")), "classes"
    )
    reps = made.filter("sketch is not null").join(classes.select(F.col("rep").alias("__key")).hint("merge"), "__key")
    reps = common.staged(reps.select(F.col("__key").alias("rep"), "n", "sketch"), "reps")
    rows = reps.select("rep", "sketch").mapInArrow(_banded, "bucket long, rep long")
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = common.staged(rows.join(shared.hint("merge"), "bucket"), "members")

    def judged(pairs: DataFrame) -> DataFrame:
        side = lambda i, c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}")).hint("merge")
        both = pairs.join(side(2, "v"), "v").join(side(1, "u"), "u")
        size = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
        return both.filter(size).select("u", "v", "n1", "s1", "n2", "s2").mapInArrow(_estimator(threshold), "u long, v long")

    pairs = members.filter("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct()
    links = common.staged(_confirm(common.staged(judged(pairs), "pairs"), texts, k, percent), "links")
    comps = common.staged(components(links), "comps")

    open_ = members.filter("size > 2").join(comps.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    open_ = common.staged(open_.select("bucket", "rep", "pivot", "size", F.coalesce("label", "rep").alias("label")), "open")
    mixed = open_.filter("rep <> pivot").groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    mixed = open_.filter("rep <> pivot").join(mixed.select("bucket").hint("merge"), "bucket", "left_semi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mixed = mixed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    mixed = mixed_rows = common.staged(mixed.select("bucket", "rep", "label", "blocks", "block"), "mixed")

    def blocked(members: DataFrame) -> DataFrame:
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        # numbered, since these tasks are long for their bytes and should not be put together
        return members.repartition(_tasks(docs), "bucket", "i", "j")

    # sketches tell which members may have a link in another component; only those bring their sets
    sketched = blocked(mixed.join(reps.hint("merge"), "rep")).groupBy("bucket", "i", "j")
    likely_ = common.staged(sketched.applyInPandas(_possible(threshold), "bucket long, rep long").distinct(), "possible")
    mixed = mixed.join(likely_.hint("merge"), ["bucket", "rep"], "left_semi")
    concerned = common.staged(likely_.select(F.col("rep").alias("__key")).distinct(), "concerned")
    sets = common.join_sized(texts, concerned, ["__key"], "left_semi").select("__key", "text")
    sets = sets.mapInArrow(_setter(k), "__key long, s binary").withColumnRenamed("__key", "rep")
    mixed_sets = blocked(mixed.join(reps.join(sets.hint("merge"), "rep").hint("merge"), "rep")).groupBy("bucket", "i", "j")
    more = common.staged(mixed_sets.applyInPandas(_across(threshold, percent), "u long, v long").distinct(), "more")
    if more.limit(1).count():
        comps = common.staged(components(links.union(more)), "comps")
    common.release(members, open_, mixed_rows)
    out = made.select("__key", "id", "n", "digest").join(classes, "digest", "left")
    out = out.join(comps.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return keyed, out.select("__key", "id", "n", F.coalesce("label", "rep", "__key").alias("comp"))


@common.owned
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (its smallest id reached), kept."""
    _, out = link(docs, id_col, text_col, k, percent)
    names = out.filter("__key = comp").select("comp", F.col("id").alias("component_id"))
    return out.join(names, "comp").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        (F.col("__key") == F.col("comp")).alias("kept"),
    )


@common.owned
def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest id."""
    keyed, out = link(docs, id_col, text_col, k, percent)
    gone = common.staged(out.filter("__key <> comp").select("__key"), "gone")
    return common.join_sized(keyed, gone, ["__key"], "left_anti").select(*common.unpacked(docs.columns))


@common.owned
def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4)


#: All pairs that share a shingle, by a join over shingles.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT u, v FROM link UNION SELECT r.a, link.v FROM r JOIN link ON r.b = link.u) SELECT * FROM r),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
