"""Regions: merging, restriction of contigs, interval semi and anti joins. Half-open, 0-based, as in BED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 1 << 14


def merge(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and book-ended regions of one contig joined: a gap starts where a region begins after all ends so far."""
    along = Window.partitionBy(*keys).orderBy("start", "end")
    furthest = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = regions.withColumn("__new", F.when(F.col("start") <= furthest, 0).otherwise(1))
    rows = rows.withColumn("__island", F.sum("__new").over(along))
    return rows.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def binned(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows once per bin that [start, end) touches: makes an interval join an equi-join on (contig, bin)."""
    return rows.withColumn("__bin", F.explode(F.sequence((start / BIN).cast("long"), ((end - 1) / BIN).cast("long"))))


def pieces(contigs: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """The parts of contigs (genome_idx, contig_idx, contig, seq) that lie in their merged regions, with `start`, where each begins in
    its contig: a k-mer lies in one of them if its whole window lies in one region. Contigs without regions drop out; regions are
    clamped to the contig, parts of fewer than k bases left out.

    Done before k-mers are encoded, so only bases inside regions are. A contig's regions travel as one array to its row, and are cut
    out of its bytes, which takes time in proportion to what is cut.
    """
    merged = merge(regions.filter("end > start and end > 0"), ["genome_idx", "contig"])
    per = merged.groupBy("genome_idx", "contig").agg(F.collect_list(F.struct("start", "end")).alias("__regions"))
    rows = contigs.join(per, ["genome_idx", "contig"]).withColumn("__bytes", F.encode("seq", "UTF-8"))
    rows = rows.select("genome_idx", "contig_idx", "contig", "__bytes", F.explode("__regions").alias("r"))
    start, end = F.greatest("r.start", F.lit(0)), F.least(F.col("r.end"), F.octet_length("__bytes"))
    rows = rows.select("genome_idx", "contig_idx", "contig", "__bytes", start.cast("long").alias("start"), end.cast("long").alias("end")).filter(F.col("end") - F.col("start") >= k)
    seq = F.decode(F.substr("__bytes", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return rows.select("genome_idx", "contig_idx", "contig", seq.alias("seq"), "start")


def _overlap(variants: DataFrame, regions: DataFrame, how: str) -> DataFrame:
    """Left semi or anti join on overlap of a variant's reference bases with a region, by (chrom, bin).

    A variant is looked up in the first bin of its span and regions in all of theirs plus the one before
    the first, so spans of up to a bin cannot miss. Longer variants are looked up in all bins of their span; those
    found, which are whole rows and few, are then told from the others by their chrom, pos and length.
    """
    marked = regions.select(F.col("chrom").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e")).filter("__e > __s")
    begin, n = F.col("pos") - 1, F.length("ref")
    wide = binned(marked, F.greatest(F.col("__s") - BIN, F.lit(0)), F.col("__e")).withColumnRenamed("__bin", "__b")
    on = (F.col("chrom") == F.col("__c")) & ((begin / BIN).cast("long") == F.col("__b")) & (begin < F.col("__e")) & (begin + n > F.col("__s"))
    # nulls overlap nothing and stay with the short ones
    short = variants.filter(F.coalesce(n <= BIN, F.lit(True))).join(wide, on, how)
    long = variants.filter(n > BIN)
    spans = long.select(F.col("chrom").alias("__vc"), F.col("pos").alias("__vp"), n.alias("__n")).filter("__vp is not null").distinct()
    start, end = F.col("__vp") - 1, F.col("__vp") - 1 + F.col("__n")
    own = binned(marked, F.col("__s"), F.col("__e")).withColumnRenamed("__bin", "__b")
    hit = binned(spans, F.greatest(start, F.lit(0)), end).join(
        own, (F.col("__vc") == F.col("__c")) & (F.col("__bin") == F.col("__b")) & (start < F.col("__e")) & (end > F.col("__s")), "left_semi"
    )
    hit = hit.select("__vc", "__vp", "__n").distinct()
    return short.union(long.join(hit, (F.col("chrom") == F.col("__vc")) & (F.col("pos") == F.col("__vp")) & (n == F.col("__n")), how))


def intersecting(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Variants (chrom, 1-based pos, ref) that overlap any region, each once."""
    return _overlap(variants, regions, "left_semi")


def outside(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Variants that overlap no region."""
    return _overlap(variants, regions, "left_anti")


#: Name prefixes of annotation classes.
CENTROMERIC = ("hor_", "dhor_")
PERICENTROMERIC = ("hsat1A_", "hsat1B_", "hsat2_", "hsat3_", "bsat_", "gsat_", "mon_", "ct_", "censat_", "rDNA_")


def annotation_classes(regions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions off chrX and chrY: all, centromeric, pericentromeric, by the prefix of their name."""
    rows = regions.filter(~F.col("chrom").rlike("chrX|chrY") & ~F.coalesce(F.col("name"), F.lit("")).rlike("chrX|chrY"))
    of = lambda prefixes: rows.filter(F.col("name").rlike("^(" + "|".join(prefixes) + ")"))
    return rows, of(CENTROMERIC), of(PERICENTROMERIC)
