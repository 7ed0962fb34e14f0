"""Exact hits of SNP-mers in genomes: an equi-join on packed flanks and centre, both strands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna
from . import staging


def exact_hits(mers: DataFrame, occ: DataFrame, k: int, most: int = 50) -> DataFrame:
    """(mer, genome_idx, contig_idx, pos, strand): where each mer of k bases stands, at most `most` places each (a
    report limit), the first in genome, contig and position order. Mers with palindromic flanks have no hits. The mers are staged, and
    broadcast if they are few."""
    half = k // 2
    flank = lambda c: F.concat(F.substring(c, 1, half), F.substring(c, half + 2, half))
    rows = mers.select("mer").distinct().withColumn("rc", dna.reverse_complement(F.col("mer")))
    rows = rows.withColumn("own", flank("mer") < flank("rc")).withColumn("y", F.when(F.col("own"), F.col("mer")).otherwise(F.col("rc")))
    names = occ.select("genome_idx", "contig_idx", "pos", "fwd", "center", "flanks")
    packed = F.aggregate(
        F.split(flank("y"), ""), F.lit(0).cast("long"),
        lambda a, b: F.when(b == "", a).otherwise(a * 4 + F.instr(F.lit("ACGT"), b).cast("long") - 1),
    )
    rows = rows.select("mer", "own", packed.alias("flanks"), (F.instr(F.lit("ACGT"), F.substring("y", half + 1, 1)) - 1).alias("center"))
    found = names.hint("merge").join(staging.hold(rows, "mers").table, ["flanks", "center"])
    found = found.select("mer", "genome_idx", "contig_idx", "pos", F.when(F.col("fwd") == F.col("own"), "+").otherwise("-").alias("strand"))
    rank = F.row_number().over(Window.partitionBy("mer").orderBy("genome_idx", "contig_idx", "pos"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
