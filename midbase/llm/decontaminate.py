"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark items' word windows. For each pattern length m there is a table of
shifts indexed by a block of two words: how far the search may move on when it has seen that block at
the end of its window. Blocks that end a pattern have shift 0 and lead, by their suffix hash, to a
bucket of patterns; those are compared word for word. Texts are searched in many lanes at once, so each
step of the search is one vector operation; lanes overlap in no end position, so nothing is seen twice.

Cases: a null or empty text has no words, no hits and is clean; a null or empty item, or one without
an id, has no windows; items that share an id count once; repeated rows each get their row; further
columns are ignored, whatever their names, or kept where rows are filtered; an empty table of documents stays empty, without
items all documents are clean. A very long text is searched whole, by one worker, which holds its words' numbers.

Benchmarks of any size are compiled in slices of about SLICE_CHARS bytes, each searched in its own pass over the documents, so
what is compiled and sent to the executors has a fixed bound; an item longer than that is a slice of its own size. The price
of a large benchmark are as many passes as it has slices.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
LANE = 64  # end positions per lane
#: Benchmark text that is compiled and sent to the executors at a time, and so what bounds both sides' memory (figures in the README).
SLICE_CHARS = 8_000_000


@dataclass
class Patterns:
    """One pattern length: shifts by block; patterns sorted by the key of the block they end with; the items of each, as
    owners[begin[p] : begin[p + 1]]."""

    m: int
    shift: np.ndarray
    keys: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    owners: np.ndarray


@dataclass
class Compiled:
    vocabulary: dict[bytes, int]
    items: list[str]
    groups: list[Patterns]


def _block(a: np.ndarray, b: np.ndarray, mask: int) -> np.ndarray:
    return ((a.astype(np.int64) * 0x9E3779B1 + b) * 0x85EBCA6B >> 7) & mask


def compile_patterns(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> Compiled:
    """Tables in arrays throughout; besides the vocabulary nothing takes a Python object a word or window."""
    vocabulary: dict[bytes, int] = {}
    numbers: dict[str, int] = {}
    by_length: dict[int, tuple[list[np.ndarray], list[int]]] = {}
    for item_id, text in items:
        words = common.fold_words(text)
        if item_id is None or not words:
            continue
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), np.int32, len(words))
        texts, owners = by_length.setdefault(min(window, len(ids)), ([], []))
        texts.append(ids)
        owners.append(numbers.setdefault(str(item_id), len(numbers)))
    return Compiled(vocabulary, list(numbers), [_group(m, *by_length[m]) for m in sorted(by_length)])


def _group(m: int, texts: list[np.ndarray], owners: list[int]) -> Patterns:
    rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(t, m) for t in texts])
    owner = np.repeat(np.array(owners, np.int32), [len(t) - m + 1 for t in texts])
    order = np.lexsort((owner, *rows.T[::-1]))
    rows, owner = rows[order], owner[order]
    other = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
    pattern = np.cumsum(other) - 1
    once = other | np.concatenate(([True], owner[1:] != owner[:-1]))  # an item counts once for a pattern
    words, owner, pattern = rows[other], owner[once], pattern[once]
    del rows
    distinct = len(np.unique(words[:, -2].astype(np.int64) << 32 | words[:, -1])) if m > 1 else len(words)
    mask = (1 << max(10, (8 * distinct).bit_length())) - 1
    shift = np.full(mask + 1, max(1, m - 1), dtype=np.uint8 if m < 256 else np.int32)
    last = max(m - 1, 1) - 1  # blocks end at the words 1 to m - 1, at the only word of a pattern of one
    for j in range(last + 1):  # a block that ends j words in lets the window move on by the rest
        left, right = (words[:, j], words[:, j + 1]) if m > 1 else (np.zeros(len(words), np.int32), words[:, 0])
        block = _block(left, right, mask)
        shift[block] = np.minimum(shift[block], last - j)
    keys = block.astype(np.int32)
    order = np.argsort(keys, kind="stable")
    # the items of the patterns in their new order
    count = np.bincount(pattern, minlength=len(words))
    first = np.cumsum(count) - count
    begin = np.concatenate(([0], np.cumsum(count[order])))
    at = np.repeat(first[order] - begin[:-1], count[order]) + np.arange(begin[-1])
    return Patterns(m, shift, keys[order], words[order], begin, owner[at])


def search(ids: np.ndarray, g: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """End positions and pattern numbers of all occurrences; 0 in ids separates texts and unknown words."""
    last = np.arange(g.m - 1, len(ids), LANE, dtype=np.int64)
    until = np.minimum(last + LANE, len(ids))
    ends: list[np.ndarray] = []
    mask = len(g.shift) - 1
    while len(last):
        block = _block(ids[last - 1] if g.m > 1 else np.zeros(len(last), np.int32), ids[last], mask)
        move = g.shift[block]
        if len(here := last[move == 0]):
            ends.append(here)
        last = last + np.maximum(move, 1)
        if not (inside := last < until).all():
            last, until = last[inside], until[inside]
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.concatenate(ends)
    block = _block(ids[at - 1] if g.m > 1 else np.zeros(len(at), np.int32), ids[at], mask).astype(np.int32)
    first = np.searchsorted(g.keys, block, "left")
    left = np.searchsorted(g.keys, block, "right") - first
    at, first, left = at[left > 0], first[left > 0], left[left > 0]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rank = 0
    while len(at):
        same = np.ones(len(at), bool)
        for j in range(g.m - 1, -1, -1):
            same &= ids[at - (g.m - 1 - j)] == g.words[first + rank, j]
            if not same.any():
                break
        if same.any():
            found.append((at[same], (first + rank)[same]))
        rank += 1
        more = left > rank
        at, first, left = at[more], first[more], left[more]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def hits(texts: list[str | None], compiled: Compiled) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text its number of words, its maximal hit ranges of words, and the items that occur."""
    get = compiled.vocabulary.get
    ids: list[int] = [0]
    begins, sizes = [], []
    for text in texts:
        words = common.fold_words(text)
        begins.append(len(ids))
        sizes.append(len(words))
        ids += [get(w, 0) for w in words]
        ids.append(0)
    row = np.array(ids, dtype=np.int32)
    edge = np.zeros(len(row) + 1, dtype=np.int64)
    items: dict[int, set[int]] = {}
    start = np.array(begins, dtype=np.int64)
    for g in compiled.groups:
        at, pattern = search(row, g)
        np.add.at(edge, at - g.m + 1, 1)
        np.add.at(edge, at + 1, -1)
        for doc, p in zip((np.searchsorted(start, at, "right") - 1).tolist(), pattern.tolist()):
            items.setdefault(doc, set()).update(g.owners[g.begin[p] : g.begin[p + 1]].tolist())
    covered = np.cumsum(edge)[:-1] > 0
    for doc, (begin, n) in enumerate(zip(begins, sizes)):
        ranges: list[tuple[int, int]] = []
        if doc in items:
            turn = np.flatnonzero(np.diff(np.concatenate(([0], covered[begin : begin + n].view(np.int8), [0]))))
            ranges = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
        yield n, ranges, {compiled.items[i] for i in items.get(doc, ())}


def _digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _flagger(compiled: object, min_items: int):
    def flag(texts: pd.Series) -> pd.Series:
        c: Compiled = compiled.value  # type: ignore[attr-defined]
        out: list[bool] = []
        begin = chars = 0
        for i, text in enumerate(texts):
            if i > begin and chars > 4_000_000:
                out += [len(items) >= min_items for _, _, items in hits(list(texts[begin:i]), c)]
                begin, chars = i, 0
            chars += len(text or "")
        out += [len(items) >= min_items for _, _, items in hits(list(texts[begin:]), c)]
        return pd.Series(out, dtype=bool)

    return flag


def _scanner(compiled: object, id_col: str, text_col: str, whole: bool) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Compiled = compiled.value  # type: ignore[attr-defined]
        for batch in batches:
            for part in common.parts(batch, text_col):
                rows = list(hits(part.column(text_col).to_pylist(), c))
                out = {id_col: part.column(id_col), "n_words": pa.array([n for n, _, _ in rows], pa.int64())}
                if whole:
                    out |= {
                        "n_hit": pa.array([sum(e - b for b, e in r) for _, r, _ in rows], pa.int64()),
                        "n_items": pa.array([len(i) for _, _, i in rows], pa.int64()),
                        "items_sha256": pa.array([_digest(i) for _, _, i in rows], pa.string()),
                    }
                else:
                    out |= {
                        "ranges": pa.array([[list(x) for x in r] for _, r, _ in rows], pa.list_(pa.list_(pa.int64()))),
                        "items": pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string())),
                    }
                yield pa.RecordBatch.from_pydict(out)

    return scan


def sliced(benchmark: DataFrame, window: int, slice_chars: int) -> list[Callable[[], object]]:
    """For each slice of the benchmark what compiles and broadcasts it; a slice has about slice_chars characters."""
    spark = benchmark.sparkSession
    bench = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    chars = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / slice_chars))

    def compiled(k: int) -> object:
        own = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else bench
        return spark.sparkContext.broadcast(compile_patterns(((r[0], r[1]) for r in own.toLocalIterator()), window))

    return [partial(compiled, k) for k in range(n)]


@common.owned
def scan_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_items: int = 2,
    window: int = WINDOW,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    slices = sliced(benchmark, window, slice_chars)
    kind = docs.schema[id_col].dataType.simpleString()
    if len(slices) == 1:
        out = docs.select(id_col, text_col).mapInArrow(
            _scanner(slices[0](), id_col, text_col, True),
            f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string",
        )
        return out.withColumn("contaminated", F.col("n_items") >= min_items)
    keyed = common.row_keyed(docs.select(id_col, text_col), id_col, text_col)
    found = None
    for compiled in slices:
        one = keyed.select("__key", "text").mapInArrow(
            _scanner(compiled(), "__key", "text", False),
            "__key long, n_words long, ranges array<array<long>>, items array<string>",
        )
        found = one if found is None else found.unionByName(one)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("ranges"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, r: F.struct(
            (s.n + F.greatest(F.lit(0), r[1] - F.greatest(r[0], s.end))).cast("long").alias("n"),
            F.greatest(s.end, r[1]).alias("end"),
        ),
        lambda s: s.n,
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    per = found.groupBy("__key").agg(
        F.max("n_words").alias("n_words"), merged.alias("n_hit"), items.alias("items")
    )
    return keyed.select("__key", F.col("row").getField(id_col).alias("id")).join(per, "__key").select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


@common.owned
def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_items: int = 2, window: int = WINDOW, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """The rows of docs that hold windows of fewer than min_items items. Over one slice the texts are judged in
    place; over more, a document's items are counted over all slices and contaminated rows are joined away."""
    slices = sliced(benchmark, window, slice_chars)
    if len(slices) == 1:
        flagged = F.pandas_udf(_flagger(slices[0](), min_items), "boolean")
        return docs.filter(~flagged(F.col(text_col)))
    rows = docs.select(F.monotonically_increasing_id().alias("__key"), F.struct("*").alias("row"), F.col(common.quoted(text_col)).alias("text"))
    keyed = common.staged(rows, "rows")
    found = scan_benchmark(keyed, benchmark, "__key", "text", min_items, window, slice_chars)
    gone = common.staged(found.filter("contaminated").select("__key"), "contaminated")
    return common.join_sized(keyed, gone, ["__key"], "left_anti").select(*common.unpacked(docs.columns))


@common.owned
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_benchmark(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The same windows by hash join of word 8-grams.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
      WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
         SELECT item_id, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i
         FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
         SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
         FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
occ AS (SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
