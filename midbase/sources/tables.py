"""BED files, BED lists and metadata tables."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of header-less sample tables.
SAMPLE_COLUMNS = ("sample_id", "hap_chrom", "individual", "sex", "continent", "pop_code", "country")


def bed_lines(value: Column) -> dict[str, Column]:
    parts = F.split(F.regexp_replace(value, r"\r$", ""), r"[\t ]+")
    return {
        "contig": F.get(parts, F.lit(0)), "start": F.try_to_number(F.get(parts, F.lit(1)), F.lit("9999999999")).cast("long"),
        "end": F.try_to_number(F.get(parts, F.lit(2)), F.lit("9999999999")).cast("long"), "name": F.get(parts, F.lit(3)),
    }


def read_bed(spark: SparkSession, path: str, genome_idx: int = 0) -> DataFrame:
    """Regions of a BED file. Comments, blank, track and browser lines are skipped, as are lines without three
    columns or with end <= start, of which a warning tells the number. A missing file is an error."""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    rows = rows.select(F.lit(genome_idx).alias("genome_idx"), *(c.alias(n) for n, c in bed_lines(F.col("value")).items()))
    fit = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    if skipped := rows.filter(~fit).count():
        warnings.warn(f"{path}: {skipped} lines without a region are skipped", stacklevel=2)
    return rows.filter(fit)


def read_bed_list(spark: SparkSession, path: str, n_genomes: int) -> DataFrame | None:
    """Regions of all genomes from a file with one BED path a line; None if it names none (no restriction)."""
    paths = [r[0].strip() for r in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n"))).collect() if r[0].strip()]
    if not paths:
        return None
    if len(paths) < n_genomes:
        raise ValueError(f"{path} names {len(paths)} BED files for {n_genomes} genomes")
    if len(paths) > n_genomes:
        warnings.warn(f"{path} names more BED files than genomes; the rest are ignored", stacklevel=2)
    out = None
    for i, one in enumerate(paths[:n_genomes]):
        own = read_bed(spark, one, i)
        out = own if out is None else out.union(own)
    return out


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A header-less sample table of seven string columns; a dot is null."""
    schema = ", ".join(f"{c} string" for c in SAMPLE_COLUMNS)
    return spark.read.csv(path, sep="\t", schema=schema, nullValue=".")


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header that has SampleID and PrimaryLineage at least."""
    return spark.read.csv(path, sep="\t", header=True)
