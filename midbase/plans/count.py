"""The caller: genomes in, SNP-mer sites out. Every step is a DataFrame that can be queried by itself."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import calls, discover, kmers, regions, staging
from ..options import CallOptions, check_genomes
from ..sources import sequences, tables, vcf


@dataclass
class Result:
    """contigs, occurrences, SNP-mers, sites (with cells of all genomes) and, if asked for, hit positions. clear() deletes the staged
    SNP-mers, which all the others but contigs and occurrences are made of."""

    contigs: DataFrame
    occurrences: DataFrame
    snpmers: DataFrame
    sites: DataFrame
    positions: DataFrame | None
    n_genomes: int
    options: CallOptions
    held: staging.Held

    def clear(self) -> None:
        self.held.clear()

    def genotypes(self) -> DataFrame:
        return calls.genotypes(self.sites, self.n_genomes)

    def lines(self) -> DataFrame:
        return vcf.lines(self.sites, self.positions)

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL: contigs, occurrences, snpmers, sites, genotypes (and positions)."""
        views = {"contigs": self.contigs, "occurrences": self.occurrences, "snpmers": self.snpmers, "sites": self.sites, "genotypes": self.genotypes()}
        for name, df in (views | ({"positions": self.positions} if self.positions is not None else {})).items():
            df.createOrReplaceTempView(prefix + name)


def call_contigs(
    contigs: DataFrame, n_genomes: int, ref_idx: int = 0, options: CallOptions | None = None, bed: DataFrame | None = None, tiled: bool = False
) -> Result:
    """Call SNP-mers of contigs (genome_idx, contig_idx, contig, seq), within the regions of `bed` if given.

    K-mers are encoded twice, once without places for discovery and once with them for the joins to the SNP-mers: reading
    is cheaper than keeping every occurrence. SNP-mers are staged, so that they are found once and broadcast only if they are few. Regions are cut out of the contigs before that. tiled: cut contigs into pieces first, for long
    ones.
    """
    options = options or CallOptions()
    if n_genomes == 1 and not options.single_genome:
        raise ValueError("give two genomes or more")
    pieces = contigs if bed is None else regions.pieces(contigs, bed, options.k)
    pieces = kmers.tiles(pieces, options.k, options.tile) if tiled else pieces
    full = kmers.occurrences(pieces, options.k)
    slim = kmers.occurrences(pieces, options.k, places=False)
    held = staging.hold(discover.snpmers(slim, n_genomes, options), "snpmers")
    snp = held.table
    sites = calls.call(full, contigs, snp, n_genomes, ref_idx, options)
    positions = None
    if options.positions:
        positions = calls.positions(calls.hits(full, snp), held.per_row(sites, calls.ANCHOR_BYTES), ref_idx, contigs, options.kpos_by_name)
    return Result(contigs, full, snp, sites, positions, n_genomes, options, held)


def count(
    spark: SparkSession, paths: list[str], ref: str | None = None, bed_list: str | None = None, output: str | None = None, **options: object
) -> Result:
    """Call SNP-mers of FASTA or FASTQ files, one genome each; write a VCF folder if `output` is given, - being standard output.

    For a folder the lines are staged beside it first, so the caller runs once, however often sorting and the header read them.
    """
    own = CallOptions(**options)  # type: ignore[arg-type]
    ref_idx = check_genomes(paths, ref, own.single_genome)
    contigs = sequences.read_genomes(spark, paths)
    bed = tables.read_bed_list(spark, bed_list, len(paths)) if bed_list else None
    result = call_contigs(contigs, len(paths), ref_idx, own, bed, tiled=True)
    if output:
        named = spark.createDataFrame([(p,) for p in paths], "path string")
        samples = [r[0] for r in named.select(dna.sample_name(F.col("path"))).collect()]
        if output == "-":
            lines = result.lines().persist(StorageLevel.DISK_ONLY)
            vcf.show(lines, reference_contigs(lines), samples)
            lines.unpersist()
            return result
        held = f"{output.rstrip('/')}.lines-{uuid.uuid4().hex}"
        try:
            result.lines().write.parquet(held)
            lines = spark.read.parquet(held)
            vcf.write(lines, output, reference_contigs(lines), samples)
        finally:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return result


def reference_contigs(lines: DataFrame) -> list[str]:
    """Contigs of the reference that hold a site."""
    return [r[0] for r in lines.filter("chrom <> '.'").select("chrom").distinct().orderBy("chrom").collect()]
