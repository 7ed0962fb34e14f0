"""What is done with a call set: clean-up and region split, alignment, population tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, population, regions
from ..sources import alignments, vcf


@dataclass
class Split:
    """Variants over centromeric and pericentromeric regions and outside all annotated ones."""

    centromeric: DataFrame
    pericentromeric: DataFrame
    outside: DataFrame


def split_by_annotation(variants: DataFrame, annotation: DataFrame, prefix: str = "CHM13#0#") -> Split:
    """Clean variants (chrom, pos, ref, ...) and split them by an annotation (chrom, start, end, name)."""
    rows = vcf.cleaned(variants, prefix)
    every, centre, near = regions.annotation_classes(annotation)
    return Split(regions.intersecting(rows, centre), regions.intersecting(rows, near), regions.outside(rows, every))


def alignment_of(loci: DataFrame, samples: list[str], min_samples: int = 4, resolve: bool = False, variable_only: bool = False) -> DataFrame:
    """(sample, seq) of loci (snp_no, ref, alt, gts)."""
    rows = alignment.bases(alignment.loci(loci, min_samples), resolve)
    return alignment.sequences(alignment.variable(rows) if variable_only else rows, samples)


def vcf_loci(rows: DataFrame) -> DataFrame:
    """Loci of VCF rows, in the order of chromosome and place."""
    place = F.struct("chrom", "pos", "ref", "alt", F.xxhash64("line").alias("line"))
    return rows.select(place.alias("snp_no"), "ref", "alt", F.transform("cells", lambda c: F.coalesce(c.gt, F.lit("."))).alias("gts"))


def write_alignment(
    spark: SparkSession, vcf_path: str, out: str, forms: tuple[str, ...] = ("phylip",), min_samples: int = 4, outgroup: str = "", resolve: bool = False
) -> DataFrame:
    """Alignments of a VCF as <out>.min<m>.<ending> folders, m being at most the number of samples; returns the sequences."""
    rows, samples = vcf.read(spark, vcf_path)
    loci, least = vcf_loci(rows), min(min_samples, len(samples))
    found = alignment_of(loci, samples, least, resolve)
    for form in forms:
        if form == "nexus-binary":
            own = alignment.sequences(alignment.binary(alignment.loci(loci, least)), samples)
            alignments.write(own, f"{out}.min{least}.bin.nexus", "nexus", outgroup, binary=True)
        else:
            alignments.write(found, f"{out}.min{least}.{ {'phylip': 'phy'}.get(form, form) }", form, outgroup)
    return found


def sample_table(metadata: DataFrame, depths: DataFrame, clusters: DataFrame) -> DataFrame:
    """Metadata with a depth per chromosome and a cluster per chromosome and kind, by left joins on sample_id."""
    rows = metadata.withColumn("sample_id", population.normalised_sample(F.col("sample_id")))
    wide = population.wide(depths.withColumnRenamed("sample", "sample_id"), "sample_id", "chrom", "depth")
    labels = population.wide(clusters.withColumnRenamed("sample", "sample_id"), "sample_id", "kind", "cluster")
    return rows.join(wide, "sample_id", "left").join(labels, "sample_id", "left")


def cluster_agreement(counts: DataFrame, lineages: DataFrame, reference: str, height: float = 0.1) -> DataFrame:
    """nmi of Jaccard clusters against lineages; the reference sample is left out."""
    spark = counts.sparkSession
    rows = counts.filter(F.col("sample") != reference)
    found = population.clusters_at(population.jaccard_distance(rows), height)
    labels = spark.createDataFrame(sorted(found.items()), "SampleID string, ClusterID int")
    return population.mutual_information(labels.join(lineages, "SampleID", "left"), "ClusterID", "PrimaryLineage")
