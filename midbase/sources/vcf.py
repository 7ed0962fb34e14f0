"""VCF text of calls: writing, reading, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

#: The header lines of the format's own fields.
HEADER = (
    "##fileformat=VCFv4.2",
    "##source=midbase",
    '##INFO=<ID=KPOS,Number=1,Type=String,Description="Hits of the k-mer over all genomes as contig|strand|pos, comma-separated">',
    '##INFO=<ID=SNPMER,Number=1,Type=String,Description="SNP-mer around the variant on the + strand">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="0=REF allele only, 1=ALT allele only, .=both or neither">',
    '##FORMAT=<ID=KC,Number=2,Type=Integer,Description="K-mer counts of the REF and ALT alleles">',
    '##INFO=<ID=AC,Number=A,Type=Integer,Description="Genomes called with the ALT allele">',
    '##INFO=<ID=AN,Number=1,Type=Integer,Description="Genomes with a call">',
    '##INFO=<ID=AF,Number=A,Type=Float,Description="AC over AN, 0 without calls">',
)
FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def info(af: Column, kpos: Column | None = None) -> Column:
    """AC, AN, AF, SNPMER and, where there are hits, KPOS."""
    parts = [
        F.concat(F.lit("AC="), F.col("ac").cast("string")), F.concat(F.lit("AN="), F.col("an").cast("string")),
        F.concat(F.lit("AF="), af), F.concat(F.lit("SNPMER="), F.col("snpmer")),
    ]
    return F.concat_ws(";", *parts, *([F.concat(F.lit("KPOS="), kpos)] if kpos is not None else []))


def gather_positions(hits: DataFrame) -> DataFrame:
    """(flanks, kpos): hits of a site in genome, contig and position order, 1-based."""
    ordered = F.array_sort(F.collect_list(F.struct("genome_idx", "contig_idx", "pos", "contig", "strand")))
    text = F.transform(ordered, lambda h: F.concat_ws("|", h.contig, h.strand, (h.pos + 1).cast("string")))
    return hits.groupBy("flanks").agg(F.array_join(text, ",").alias("kpos"))


def lines(sites: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, flanks, line): a VCF line per site, samples in genome order."""
    kpos = None
    if positions is not None:
        sites, kpos = sites.join(gather_positions(positions), "flanks", "left"), F.col("kpos")
    cell = lambda c: F.concat(F.coalesce(c.gt.cast("string"), F.lit(".")), F.lit(":"), c.kc_ref.cast("string"), F.lit(","), c.kc_alt.cast("string"))
    chrom = F.coalesce("chrom", F.lit("."))
    line = F.concat_ws(
        "\t", chrom, F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("."), info(dna.short_float(F.col("af")), kpos),
        F.lit("GT:KC"), F.array_join(F.transform("cells", cell), "\t"),
    )
    return sites.select(chrom.alias("chrom"), "pos", "flanks", line.alias("line"))


def header(contigs: list[str], samples: list[str]) -> list[str]:
    named = [f"##contig=<ID={c}>" for c in [*contigs, "."]]
    return [*HEADER[:6], *named, *HEADER[6:], "#" + "\t".join([*FIXED, *samples])]


def write(rows: DataFrame, path: str, contigs: list[str], samples: list[str]) -> None:
    """Write a VCF folder whose first part starts with the header; parts are in chrom and position order.

    Lines are range-partitioned, so a large call set is sorted and written by many tasks.
    """
    spark = rows.sparkSession
    top = spark.createDataFrame([(0, "", 0, i, h) for i, h in enumerate(header(contigs, samples))], "k int, chrom string, pos long, flanks long, line string")
    body = rows.select(F.lit(1).alias("k"), "chrom", F.col("pos").cast("long").alias("pos"), "flanks", "line")
    top.union(body).orderBy("k", "chrom", "pos", "flanks").select("line").write.mode("overwrite").text(path)


def show(rows: DataFrame, contigs: list[str], samples: list[str]) -> None:
    """Print a VCF; lines reach the driver a partition at a time."""
    for line in header(contigs, samples):
        print(line)
    for row in rows.orderBy("chrom", "pos", "flanks").select("line").toLocalIterator():
        print(row[0])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(rows, samples): a row per variant with fields, info, and one {gt, a1, a2} per sample found by FORMAT's place of KC."""
    text = spark.read.text(path).withColumnRenamed("value", "line")
    names = text.filter(F.startswith("line", F.lit("#CHROM"))).first()
    samples = [s.replace("./", "") for s in names[0].split("\t")[9:]] if names else []  # some callers put ./ before names
    f = F.split("line", "\t")
    rows = text.filter(~F.startswith("line", F.lit("#")) & (F.col("line") != "")).select("line", f.alias("f"))
    place, own = (F.array_position(F.split(F.col("f")[8], ":"), n).cast("int") for n in ("KC", "GT"))
    kc = lambda x, i: F.get(F.split(F.get(F.split(x, ":"), place - 1), ","), F.lit(i)).cast("long")
    cells = F.transform(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))), lambda x: F.struct(F.get(F.split(x, ":"), own - 1).alias("gt"), kc(x, 0).alias("a1"), kc(x, 1).alias("a2")))
    return rows.select(
        F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[2].alias("id"), F.col("f")[3].alias("ref"),
        F.col("f")[4].alias("alt"), F.col("f")[7].alias("info"), cells.alias("cells"), "line",
    ), samples


def counts(rows: DataFrame, samples: list[str]) -> DataFrame:
    """Long form: variant (chrom:pos:snpmer), chrom, sample, gt, ref, alt, a1, a2."""
    variant = F.concat_ws(":", "chrom", F.col("pos").cast("string"), info_field(F.col("info"), "SNPMER"))
    long = rows.select(variant.alias("variant"), "chrom", "ref", "alt", F.posexplode("cells").alias("i", "c"))
    names = F.array(*(F.lit(s) for s in samples))
    return long.select("variant", "chrom", names[F.col("i")].alias("sample"), "c.gt", "ref", "alt", "c.a1", "c.a2")


def info_field(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?:^|;){name}=([^;]*)", 1), F.lit(""))


def snpmer_rows(rows: DataFrame) -> DataFrame:
    """(snpmer, ref, alt) of variants that name their SNP-mer."""
    return rows.select(info_field(F.col("info"), "SNPMER").alias("snpmer"), "ref", "alt").filter("snpmer is not null")


def cleaned(rows: DataFrame, prefix: str = "CHM13#0#") -> DataFrame:
    """Variants with a place in the reference, the prefix taken from all text."""
    drop = lambda c: F.replace(F.col(c), F.lit(prefix), F.lit(""))
    rows = rows.withColumns({c: drop(c) for c in ("chrom", "info", "line") if c in rows.columns})
    return rows.filter((F.col("chrom") != ".") & (F.col("pos") != 0))


def sorted_by_place(rows: DataFrame, contigs: list[str]) -> DataFrame:
    """In the order of the header's contigs, then by position; contigs that the header lacks come last, by name."""
    rank = F.array_position(F.array(*(F.lit(c) for c in contigs)), F.col("chrom")) if contigs else F.lit(0)
    return rows.orderBy(F.nullif(rank, F.lit(0)).asc_nulls_last(), "chrom", "pos")
