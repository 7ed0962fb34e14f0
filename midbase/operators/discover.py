"""SNP-mer discovery: flanks with exactly two centres, present in enough genomes, unique enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import CallOptions

MASKED = 62  # genomes that one long can mark


def present_enough(present: Column, n: int, min_freq: float) -> Column:
    """The threshold in the doubles that define it: 1 - m is rounded before it is compared."""
    return ~(((F.lit(n) - present) / F.lit(float(n))) > F.lit(1.0 - min_freq + 1e-9))


def _genome_masks(occ: DataFrame) -> DataFrame:
    """One grouped pass: per centre the set of genomes as bits. For at most MASKED genomes."""
    bit = F.expr("shiftleft(1L, genome_idx)")
    sets = [F.coalesce(F.bit_or(F.when(F.col("center") == c, bit)), F.lit(0)).alias(f"b{c}") for c in range(4)]
    rows = occ.groupBy("flanks").agg(F.count(F.lit(1)).alias("n"), *sets)
    either = F.expr("bit_count(b0 | b1 | b2 | b3)")
    return rows.select(
        "flanks", either.cast("long").alias("present"),
        F.filter(F.array(*(F.when(F.col(f"b{c}") != 0, c) for c in range(4))), lambda c: c.isNotNull()).alias("centers"),
        (F.expr("bit_count(b0) + bit_count(b1) + bit_count(b2) + bit_count(b3)") == either).alias("one_allele"),
        (F.col("n") == either).alias("unique"),
    )


def _genome_rows(occ: DataFrame) -> DataFrame:
    """Two grouped passes, for any number of genomes: counts by flanks and genome, then by flanks."""
    per = occ.groupBy("flanks", "genome_idx").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1, center)")).alias("mask"))
    rows = per.groupBy("flanks").agg(
        F.count(F.lit(1)).alias("present"), F.bit_or("mask").alias("mask"), F.max("n").alias("n"), F.max(F.expr("bit_count(mask)")).alias("alleles")
    )
    return rows.select(
        "flanks", "present", F.filter(F.array(*(F.when(F.expr(f"mask & {1 << c}") != 0, c) for c in range(4))), lambda c: c.isNotNull()).alias("centers"),
        (F.col("alleles") == 1).alias("one_allele"), (F.col("n") == 1).alias("unique"),
    )


def flank_presence(occ: DataFrame, n_genomes: int) -> DataFrame:
    """By flanks: present (genomes with either allele), centers, one_allele (in every genome), unique (in every genome)."""
    return _genome_masks(occ) if n_genomes <= MASKED else _genome_rows(occ)


def snpmers(occ: DataFrame, n_genomes: int, options: CallOptions) -> DataFrame:
    """(flanks, c_lo, c_hi, present) of the SNP-mers."""
    rows = flank_presence(occ, n_genomes)
    if n_genomes == 1 and options.single_genome:
        return rows.select("flanks", F.col("centers")[0].alias("c_lo"), F.coalesce(F.get("centers", F.lit(1)), F.lit(0)).alias("c_hi"), "present")
    rows = rows.filter(F.size("centers") == 2).filter(present_enough(F.col("present"), n_genomes, options.min_freq))
    rows = rows.filter({0: F.lit(True), 1: F.col("one_allele"), 2: F.col("unique")}[options.filt_type])
    return rows.select("flanks", F.col("centers")[0].alias("c_lo"), F.col("centers")[1].alias("c_hi"), "present")
