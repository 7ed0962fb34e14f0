"""Population analytics on allele counts and genotypes: kc(variant, sample, a1, a2), or a Matrix of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Matrix:
    """Counts with a row per variant: arrays a1 and a2 with a place for every sample, as call sites and VCF lines have them."""

    rows: DataFrame
    samples: list


def of_cells(rows: DataFrame, samples: list, first: str = "kc_ref", second: str = "kc_alt") -> Matrix:
    """The matrix in rows' `cells`, which hold a struct per sample in the order of `samples`; no shuffle."""
    of = lambda f: F.transform("cells", lambda c: F.coalesce(c[f], F.lit(0)).cast("double"))
    return Matrix(rows.select(of(first).alias("a1"), of(second).alias("a2")), samples)


def of_long(kc: DataFrame) -> Matrix:
    """The matrix of kc (variant, sample, a1, a2): a variant without a row for a sample has no counts there."""
    samples = sorted(r[0] for r in kc.select("sample").distinct().collect())
    kind = kc.schema["sample"].dataType.simpleString()
    place = F.broadcast(kc.sparkSession.createDataFrame(list(enumerate(samples)), f"i int, sample {kind}"))  # one row a sample
    own = kc.join(place, "sample").groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("a1", "a2")))).alias("own"))
    at = lambda f: F.transform(F.sequence(F.lit(0), F.lit(max(len(samples) - 1, 0))), lambda i: F.coalesce(F.try_element_at("own", i)[f], F.lit(0)).cast("double"))
    return Matrix(own.select(at("a1").alias("a1"), at("a2").alias("a2")), samples)


def features(kc: DataFrame) -> DataFrame:
    """comp: share of the first allele. log_depth: log of one plus both counts."""
    depth = F.col("a1") + F.col("a2")
    return kc.withColumn("comp", F.col("a1") / (depth + F.lit(1e-10))).withColumn("log_depth", F.log1p(depth.cast("double")))


def _pair_sums(matrix: Matrix, names: list[str], value: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(s1, s2, names) for sample pairs s1 < s2: what value(a1, a2) gives for the pairs, summed over variants.

    value gets a block of variants x samples and returns a samples x samples matrix for each name. A task adds up its blocks and
    emits each matrix once, so rows grow with tasks and pairs of samples, not with variants; the matrices are summed by one
    grouped aggregation.
    """
    n = len(matrix.samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                a1, a2 = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in ("a1", "a2"))
                for k in range(0, len(a1), 2048):
                    own = value(a1[k : k + 2048], a2[k : k + 2048])
                    total = own if total is None else [t + x for t, x in zip(total, own)]
        if total is not None:
            i, j = (x.astype(np.int32) for x in np.triu_indices(n, 1))
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                yield pa.RecordBatch.from_pydict({"i": pa.array(x), "j": pa.array(y)} | {c: pa.array(t[x, y]) for c, t in zip(names, total)})

    parts = matrix.rows.select("a1", "a2").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names))
    if not n:
        return sums.select(F.col("i").alias("s1"), F.col("j").alias("s2"), *names)
    spark = sums.sparkSession
    named = lambda i, s: F.broadcast(spark.createDataFrame(list(enumerate(matrix.samples))).toDF(i, s))  # noqa: E731  one row a sample
    return sums.join(named("i", "s1"), "i").join(named("j", "s2"), "j").select("s1", "s2", *names)


def mixed_distance(kc: DataFrame | Matrix, inner: str = "manhattan", w_comp: float = 1.0, w_depth: float = 0.01) -> DataFrame:
    """(s1, s2, distance) for sample pairs s1 < s2, summed over variants: weighted differences of comp and log_depth, added
    (manhattan) or as the two sides of a right angle (euclidean)."""
    if inner not in ("manhattan", "euclidean"):
        raise ValueError("inner must be manhattan or euclidean")

    def value(a1: np.ndarray, a2: np.ndarray) -> list[np.ndarray]:
        c, d = w_comp * a1 / (a1 + a2 + 1e-10), w_depth * np.log1p(a1 + a2)
        out = np.zeros((a1.shape[1], a1.shape[1]))
        wide = max(1, 2_000_000 // max(1, a1.size))  # samples at a time, so that a block's differences stay small
        for i in range(0, len(out), wide):
            x, y = (np.abs(f[:, i : i + wide, None] - f[:, None, :]) for f in (c, d))
            out[i : i + wide] = (x + y if inner == "manhattan" else np.hypot(x, y)).sum(axis=0)
        return [out]

    return _pair_sums(kc if isinstance(kc, Matrix) else of_long(kc), ["distance"], value)


def jaccard_distance(counts: DataFrame | Matrix) -> DataFrame:
    """(s1, s2, distance): one less the share of variants present in both of those present in either.

    counts: (variant, sample, count), or a matrix, of which the second allele counts; present means not zero. Of two samples
    without any variant the distance is 0.
    """
    if not isinstance(counts, Matrix):
        counts = of_long(counts.select("variant", "sample", F.lit(0).alias("a1"), F.col("count").alias("a2")))

    def value(a1: np.ndarray, a2: np.ndarray) -> list[np.ndarray]:
        on = (a2 != 0).astype(np.float64)
        both, n = on.T @ on, on.sum(axis=0)
        return [both, n[:, None] + n[None, :] - both]

    rows = _pair_sums(counts, ["both", "either"], value)
    return rows.select("s1", "s2", F.when(F.col("either") == 0, 0.0).otherwise(1 - F.col("both") / F.col("either")).alias("distance"))


def depth_by_contig(kc: DataFrame) -> DataFrame:
    """(sample, chrom, depth): log of one plus all counts of a sample on a contig. kc has chrom."""
    return kc.groupBy("sample", "chrom").agg(F.log1p(F.sum(F.col("a1") + F.col("a2")).cast("double")).alias("depth"))


def wide(rows: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """One column per value of `column`; the largest where a key has several, so that every run gives the same."""
    return rows.groupBy(key).pivot(column).agg(F.max(value))


MOST_SAMPLES = 5_000


def _matrix(distances: DataFrame) -> tuple[list, np.ndarray]:
    """Samples and their distance matrix on the driver, where it is small by nature: n x n for a cohort of n genomes. Refused
    beyond MOST_SAMPLES, and if it is no distance matrix: each pair once, finite and not negative."""
    ends = distances.select(F.explode(F.array("s1", "s2")).alias("s")).distinct()
    samples = sorted(r[0] for r in ends.limit(MOST_SAMPLES + 1).collect())
    if len(samples) > MOST_SAMPLES:
        raise ValueError("too many samples to cluster on the driver")
    named = ends.sparkSession.createDataFrame(list(enumerate(samples)), f"n int, s {distances.schema['s1'].dataType.simpleString()}") if samples else None
    d = np.full((len(samples), len(samples)), np.nan)
    if named is not None:
        of = lambda c, n: F.broadcast(named.select(F.col("s").alias(c), F.col("n").alias(n)))  # noqa: E731  one row a sample
        pairs = distances.join(of("s1", "i"), "s1").join(of("s2", "j"), "s2").select("i", "j", F.col("distance").cast("double").alias("d"))
        found = pairs.toArrow()  # 16 bytes a pair
        if found.num_rows != len(samples) * (len(samples) - 1) // 2:
            raise ValueError("the distances are not those of all pairs, each once")
        i, j, x = (found.column(c).to_numpy() for c in ("i", "j", "d"))
        d[i, j] = d[j, i] = x
    np.fill_diagonal(d, 0)
    if not (np.isfinite(d).all() and (d >= 0).all()):
        raise ValueError("distances must be finite and not negative, with one for each pair")
    np.fill_diagonal(d, np.inf)
    return samples, d


def _agglomerate(samples: list, d: np.ndarray, method: str, height: float = np.inf, count: int = 1) -> dict:
    """Merge the nearest clusters until they are farther apart than `height` or only `count` are left; clusters are
    numbered in order of their smallest sample."""
    size, groups, left = np.ones(len(d)), [[s] for s in samples], len(d)
    while left > count:
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        if not d[i, j] <= height or not np.isfinite(d[i, j]):
            break
        if method == "complete":
            new = np.maximum(d[i], d[j])
        else:
            with np.errstate(invalid="ignore"):
                new = np.sqrt(((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * d[i, j] ** 2) / (size[i] + size[j] + size))
            new[np.isnan(new)] = np.inf
        groups[i] += groups[j]
        groups[j] = []
        size[i] += size[j]
        new[i] = new[j] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        left -= 1
    return {s: n for n, g in enumerate(sorted((g for g in groups if g), key=min), 1) for s in g}


def clusters_at(distances: DataFrame, height: float) -> dict:
    """Complete-linkage clusters cut at a height."""
    return _agglomerate(*_matrix(distances), "complete", height=height)


def ward_clusters(distances: DataFrame, counts: range = range(2, 21)) -> dict[int, dict]:
    """Ward clusters of a distance matrix cut to each number of clusters."""
    samples, d = _matrix(distances)
    return {k: _agglomerate(samples, d.copy(), "ward", count=k) for k in counts if k <= len(samples)}


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row, nmi: mutual information of two labellings over the larger of their entropies (1 if both are constant)."""
    table = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def entropy(n: str) -> Column:
        p = F.col(n) / F.col("total")
        return F.sum(-p * F.log(p))

    total = table.agg(F.sum("n").alias("total"))
    of = lambda keys, name: table.groupBy(*keys).agg(F.sum("n").alias("k")).crossJoin(total).agg(entropy("k").alias(name))  # noqa: E731  one row each
    one = of([a], "ha").crossJoin(of([b], "hb")).crossJoin(of([a, b], "hab"))
    larger = F.greatest("ha", "hb")
    return one.select(F.when(larger == 0, 1.0).otherwise((F.col("ha") + F.col("hb") - F.col("hab")) / larger).alias("nmi"))


#: Haplotype names and their numbers.
HAPLOTYPES = {"pat": "1", "hap1": "1", "mat": "2", "hap2": "2", "pri": "0"}


def normalised_sample(sample: Column) -> Column:
    """The second part of an id split at _, with haplotype names in it as numbers; an id without _ as it is."""
    part = F.get(F.split(sample, "_"), F.lit(1))
    for name, number in HAPLOTYPES.items():
        part = F.replace(part, F.lit(name), F.lit(number))
    return F.coalesce(part, sample)


def renamed(rows: DataFrame, pattern: str = r"^.*files/(.*)\.fa\.gz$", column: str = "sample") -> DataFrame:
    """Sample names cut to the pattern's group; names that do not fit stay."""
    return rows.withColumn(column, F.regexp_replace(column, pattern, "$1"))


def chromosome_order(chrom: Column) -> list[Column]:
    """Sort keys: numbered chromosomes first, by number, then the rest by name."""
    bare = F.replace(chrom, F.lit("chr"), F.lit(""))
    number = F.when(bare.rlike("^[0-9]+$"), bare.cast("long"))
    return [number.asc_nulls_last(), bare.asc()]


def shared_groups(matrix: DataFrame, keys: list[str], count: str, most: int = 170, least: int = 5) -> DataFrame:
    """Rows of groups whose counts sum to less than `most` and are all at least `least`."""
    good = matrix.groupBy(*keys).agg(F.sum(count).alias("__s"), F.min(count).alias("__m"))
    return matrix.join(good.filter((F.col("__s") < most) & (F.col("__m") >= least)).select(*keys), keys, "left_semi")
