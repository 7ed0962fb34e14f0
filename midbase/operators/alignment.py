"""Alignments from genotypes: per-sample strings over loci.

Loci are rows (snp_no, ref, alt, gts): snp_no of any type that has an order, alt comma-separated, gts an array of genotype
texts (0, 1, 0/1, . and so on) with a place for every sample. All tests on a locus are made in its row, without shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: IUPAC codes of base sets.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K",
    "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N",
}


def iupac(alleles: Column) -> Column:
    """The code of a set of alleles (sorted, distinct): lower case if a gap (*) or N is among others, N for all four
    bases, - for a gap alone, N for N alone; null for what has no code."""
    bases = F.array_join(F.filter(alleles, lambda b: b.isin("A", "C", "G", "T")), "")
    extra = F.exists(alleles, lambda b: b.isin("*", "N"))
    known = F.forall(alleles, lambda b: b.isin("A", "C", "G", "T", "N", "*"))
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv]), bases)
    joined = F.array_join(alleles, "")
    return (
        F.when(~known | (joined == "ACGNT"), None)
        .when(bases == "ACGT", "N")
        .when(bases != "", F.when(extra, F.lower(code)).otherwise(code))
        .when(joined == "*", "-").when(joined == "N", "N").when(joined == "*N", "n")
    )


def called(gt: Column) -> Column:
    return ~F.startswith(gt, F.lit("."))


def single_bases(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & F.forall(F.split(alt, ","), lambda a: F.length(a) == 1)


def by_locus(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Loci and sample names of rows (snp_no, sample, gt, ref, alt); a sample without a row at a locus has no call there."""
    samples = sorted(r[0] for r in rows.select("sample").distinct().collect())
    own = rows.groupBy("snp_no", "ref", "alt").agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("own"))
    names = F.array(*(F.lit(x) for x in samples)).cast("array<string>")
    return own.select("snp_no", "ref", "alt", F.transform(names, lambda x: F.coalesce(F.try_element_at("own", x), F.lit("."))).alias("gts")), samples


def n_called(gts: Column) -> Column:
    return F.size(F.filter(gts, called))


def loci(rows: DataFrame, min_samples: int = 4) -> DataFrame:
    """Loci with at least min(min_samples, samples) called genotypes and single-base alleles only."""
    enough = n_called(F.col("gts")) >= F.least(F.lit(min_samples), F.size("gts"))
    return rows.filter(single_bases(F.col("ref"), F.col("alt")) & enough)


def letter(alleles: set[str | None]) -> str | None:
    """What `iupac` gives for a set of alleles; None stands for an allele that the locus lacks."""
    known = alleles - {None}
    joined = "".join(sorted(known))
    bases = "".join(b for b in joined if b in "ACGT")
    if joined == "ACGNT" or any(b not in ("A", "C", "G", "T", "N", "*") for b in known):
        return None
    if bases == "ACGT":
        return "N"
    if bases:
        return IUPAC[bases].lower() if known & {"*", "N"} else IUPAC[bases]
    return {"*": "-", "N": "N", "*N": "n"}.get(joined)


def choices(ref: str | None, alt: str | None, gt: str | None, resolve: bool) -> list[str | None]:
    """The code of a genotype, or with resolve that of each of its alleles."""
    if gt is None or gt.startswith("."):
        return ["N"]
    nuc = [] if alt is None else [x and x.replace("-", "*") for x in (ref, *alt.split(","))]
    number = lambda g: int(g) if re.fullmatch("[0-9]{1,3}", g) else len(nuc)
    picks = ["N" if g == "." else nuc[number(g)] if number(g) < len(nuc) else None for g in re.split("[/|]", gt)]
    return [letter({x}) for x in picks] if resolve else [letter(set(picks))]


def bases(rows: DataFrame, resolve: bool = False) -> DataFrame:
    """Loci plus `bases`, a code per sample. Loci with an allele that has no code are left out whole. resolve: one allele of each
    heterozygote, chosen by a hash of locus and sample, so every run gives the same.

    Codes are made once for each combination of alleles and genotype in an Arrow batch and taken from there for its cells.
    """
    own = rows.drop("bases")
    names = own.columns
    pick = [F.transform("gts", lambda _, i: F.xxhash64("snp_no", i)).alias("__pick")] if resolve else []

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gts = batch.column("gts")
            size = pc.fill_null(pc.list_value_length(gts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cells = [batch.column(c).dictionary_encode() for c in ("ref", "alt")] + [gts.flatten().dictionary_encode()]
            at = [pc.fill_null(c.indices, len(c.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for c in cells]
            values = [[*c.dictionary.to_pylist(), None] for c in cells]
            row = np.repeat(np.arange(batch.num_rows), size)
            pair, cell = at[0] * len(values[1]) + at[1], len(values[2])
            found, which = np.unique(pair[row] * cell + at[2], return_inverse=True)
            parts = [choices(values[0][p // len(values[1])], values[1][p % len(values[1])], values[2][g], resolve) for p, g in zip((found // cell).tolist(), (found % cell).tolist())]
            many = np.array([len(x) for x in parts], np.int64)
            place = (np.cumsum(many) - many)[which]
            if resolve:
                place += np.mod(batch.column("__pick").flatten().to_numpy(zero_copy_only=False), many[which])
            codes = pa.array([x for part in parts for x in part], pa.string()).take(pa.array(place))
            whole = pc.is_valid(gts).to_numpy(zero_copy_only=False)
            whole[row[pc.is_null(codes).to_numpy(zero_copy_only=False)]] = False
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), codes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "bases"]).filter(pa.array(whole))

    kind = StructType([*own.schema.fields, StructField("bases", ArrayType(StringType()))])
    return own.select("*", *pick).mapInArrow(coded, kind)


def variable(rows: DataFrame) -> DataFrame:
    """Loci at which more than one of A, C, G, T occurs."""
    return rows.filter(F.size(F.array_distinct(F.filter("bases", lambda b: b.isin("A", "C", "G", "T")))) > 1)


def binary(rows: DataFrame) -> DataFrame:
    """Bi-allelic loci with the number of alternative alleles of each diploid genotype, or ?, as `bases`."""

    def code(gt: Column) -> Column:
        n = F.substring(gt, 1, 1).try_cast("int") + F.substring(gt, 3, 1).try_cast("int")
        return F.when(F.rlike(gt, F.lit(r"^[01][/|][01]")), n.cast("string")).otherwise("?")

    return rows.filter(F.length("alt") == 1).withColumn("bases", F.transform("gts", code))


def sequences(rows: DataFrame, samples: list[str]) -> DataFrame:
    """(sample, seq): each sample's bases in locus order.

    Loci are sorted over all tasks; each batch of them is turned into a stretch of every sample's sequence, so what is gathered for
    a sample are stretches and not single loci.
    """
    n = len(samples)
    kind = rows.schema["snp_no"].dataType.simpleString()

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.frombuffer("".join(batch.column("line").to_pylist()).encode(), "S1").reshape(-1, n)
                parts = [cells[:, i].tobytes().decode() for i in range(n)]
                first = batch.column("snp_no").take(pa.array([0] * n))
                yield pa.RecordBatch.from_arrays([first, pa.array(samples, pa.string()), pa.array(parts, pa.string())], names=["first", "sample", "part"])

    lines = rows.select("snp_no", F.array_join("bases", "").alias("line")).repartitionByRange("snp_no").sortWithinPartitions("snp_no")
    parts = lines.mapInArrow(turned, f"first {kind}, sample string, part string")
    ordered = F.array_sort(F.collect_list(F.struct("first", "part")))
    return parts.groupBy("sample").agg(F.array_join(F.transform(ordered, lambda x: x.part), "").alias("seq"))
