"""Registered queries of readers, writers and workflow operators, and the SQL that checks them.

Files are written from the driver's tables to a folder that all executors share, and read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import CallOptions
from . import queries as base
from .functions import dna
from .operators import alignment, calls, discover, kmers, population, regions, staging
from .plans import workflows
from .plans.count import call_contigs
from .sources import alignments, sequences, tables, vcf

Query = Callable[[SparkSession, str], DataFrame]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or on one machine among its temporary files."""
    top = staging.shared_folder(spark)
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str) -> list[str]:
    """The part files of a written folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-"))


def _written(spark: SparkSession, lines: DataFrame, name: str, compression: str = "none") -> list[str]:
    path = folder(spark, name)
    lines.write.option("compression", compression).text(path)
    return files(spark, path)


def _fasta(table: Callable[[SparkSession, str], DataFrame], compression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir)
        body = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
        paths = _written(spark, rows.select(F.concat(F.lit(">"), "contig", F.lit(" of "), F.col("genome_idx").cast("string"), F.lit("\n\n"), body)), "fasta", compression)
        return sequences.read_genomes(spark, paths).select("contig", F.upper("seq").alias("seq"))

    return run


def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.conversation_contigs(spark, sf_dir)
    record = F.concat(F.lit("@"), "contig", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))
    return sequences.read_genomes(spark, _written(spark, rows.coalesce(4).select(record), "fastq")).select("contig", "seq")


def _bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "documents")
    start, gap = F.col("doc_id") * 37 % 5000, F.when(F.col("doc_id") % 3 == 0, " ").otherwise("\t")
    end = start + F.col("doc_id") % 7 * 10 - 10
    line = F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string"), gap, start.cast("string"), gap, end.cast("string"))
    other = F.array(F.lit("# note"), F.lit("track x"), F.lit("browser y"), F.lit(""), F.lit("c1\t5"))
    return rows.select(F.when(F.col("doc_id") % 11 == 0, other[(F.col("doc_id") % 5).cast("int")]).otherwise(line).alias("value"))


def bed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "bed")
    _bed_lines(spark, sf_dir).write.text(path)
    return tables.read_bed(spark, path).select("contig", "start", "end")


def bed_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second, names = (folder(spark, n) for n in ("bed", "bed", "beds"))
    _bed_lines(spark, sf_dir).write.text(first)
    base._table(spark, sf_dir, "supplier").select(F.concat(F.lit("s\t0\t"), (F.col("s_suppkey") + 1).cast("string"))).write.text(second)
    spark.createDataFrame([("\n".join(["", first, "", second, "more"]),)], "value string").coalesce(1).write.text(names)
    return base._longs(tables.read_bed_list(spark, names, 2).select("genome_idx", "contig", "start", "end"))


def _vcf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    result = base._result(spark, sf_dir)
    lines = result.lines()
    path = folder(spark, "vcf")
    vcf.write(lines, path, [], base.SAMPLES)
    return vcf.read(spark, path)


def vcf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, samples = _vcf(spark, sf_dir)
    return vcf.counts(rows, samples)


def snpmer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.snpmer_rows(_vcf(spark, sf_dir)[0])


def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "samples")
    _metadata(spark, sf_dir).write.text(path)
    return tables.read_samples(spark, path)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "supplier")
    dot = F.when(F.col("s_suppkey") % 3 == 0, ".").otherwise(F.col("s_suppkey").cast("string"))
    return rows.select(F.concat_ws("\t", _sample_id(), dot, "s_name", F.lit("."), dot, F.lit("P"), F.lit("C")).alias("value"))


def _sample_id() -> Column:
    part = F.array(*(F.lit(x) for x in ("pat", "mat.v1", "hap1", "hap2", "pri", "other")))[(F.col("s_suppkey") % 6).cast("int")]
    return F.when(F.col("s_suppkey") % 10 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("HG_"), F.col("s_suppkey").cast("string"), part, F.lit("_x")))


def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._table(spark, sf_dir, "supplier").select("s_suppkey", population.normalised_sample(_sample_id()).alias("sample_id"))


def renamed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("s_suppkey") % 4 > 0, ".fa.gz").otherwise(".fa")
    rows = base._table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("x/files/"), "s_name", ending).alias("sample"))
    return population.renamed(rows)


def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "samples")
    _metadata(spark, sf_dir).write.text(path)
    rows = base._table(spark, sf_dir, "supplier").select(population.normalised_sample(_sample_id()).alias("sample"), (F.col("s_nationkey") % 3).cast("string").alias("n"), "s_suppkey")
    chrom = F.concat(F.lit("chr"), "n").alias("chrom")
    clusters = rows.filter("s_suppkey % 2 = 0").select("sample", F.concat(chrom, F.lit("_tree")).alias("kind"), (F.col("s_suppkey") % 4).alias("cluster"))
    own = workflows.sample_table(tables.read_samples(spark, path), rows.select("sample", chrom, F.col("s_suppkey").alias("depth")), clusters)
    columns = {c for c in own.columns if c.startswith("chr")}
    added = [F.col(c) if c in columns else F.lit(None).cast("long").alias(c) for i in range(3) for c in (f"chr{i}", f"chr{i}_tree")]
    return own.select("sample_id", "hap_chrom", "individual", *added)


def label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("k"), (F.col("n_nationkey") % 2).cast("string")).alias("kind"), "n_nationkey")
    return population.wide(rows.groupBy("n_regionkey", "kind").agg(F.max("n_nationkey").alias("label")), "n_regionkey", "kind", "label").na.fill(-1)


def chromosome_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"))).otherwise(F.concat(F.lit("chr"), "n_name"))
    rows = base._table(spark, sf_dir, "nation").select(name.alias("chrom"))  # a row per chromosome
    return base._longs(rows.select("chrom", F.row_number().over(Window.orderBy(*population.chromosome_order(F.col("chrom")))).alias("rank")))


def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("double").alias("pangenome"))
    return base._longs(population.shared_groups(rows, ["l_orderkey"], "pangenome").select("l_orderkey", "l_linenumber"))


PREFIXES = ("hor_1", "dhor_2", "hsat1A_3", "ct_4", "rDNA_5", "xhor_6", "other", "")


def _annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "supplier")
    start = F.col("s_suppkey") * 379 % 40000
    name = F.array(*(F.lit(p) for p in PREFIXES))[(F.col("s_suppkey") % 8).cast("int")]
    chrom = F.array(F.lit("chr0"), F.lit("chr1"), F.lit("chrX"))[(F.col("s_nationkey") % 3).cast("int")]
    return rows.select("s_suppkey", chrom.alias("chrom"), start.alias("start"), (start + 500).alias("end"), name.alias("name"))


def annotation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = zip(("all", "centromeric", "pericentromeric"), regions.annotation_classes(_annotation(spark, sf_dir)))
    frames = [df.select(F.lit(k).alias("kind"), "s_suppkey") for k, df in kinds]
    return frames[0].union(frames[1]).union(frames[2])


def region_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    chrom = F.array(F.lit("CHM13#0#chr0"), F.lit("chr1"), F.lit("."))[(F.col("l_orderkey") % 3).cast("int")]
    rows = base._table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chrom.alias("chrom"), (F.col("l_partkey") * 20 + 1).alias("pos"), F.lit("AC").alias("ref"))
    own = workflows.split_by_annotation(rows, _annotation(spark, sf_dir))
    frames = [df.select(F.lit(k).alias("kind"), "l_orderkey", "l_linenumber", "chrom") for k, df in vars(own).items()]
    return base._longs(frames[0].union(frames[1]).union(frames[2]))


def interval_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "supplier")
    wide = rows.select("s_suppkey", F.lit("c").alias("chrom"), (F.col("s_suppkey") * 7919 % 1_000_000 + 1).alias("pos"), F.repeat(F.lit("A"), (20_000 + F.col("s_suppkey") * 911 % 80_000).cast("int")).alias("ref"))
    spans = base._table(spark, sf_dir, "nation").select(F.lit("c").alias("chrom"), (F.col("n_nationkey") * 43_000).alias("start"), (F.col("n_nationkey") * 43_000 + 10).alias("end"))
    both = [df.select("s_suppkey", F.lit(k).alias("inside")) for k, df in ((True, regions.intersecting(wide, spans)), (False, regions.outside(wide, spans)))]
    return both[0].union(both[1])


def _diploid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of three samples with genotypes of one or two alleles, gaps and missing calls."""
    rows, n = base._table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda values, k: F.array(*(F.lit(v) for v in values))[(k % len(values)).cast("int")]
    gts = [pick(GENOTYPES, n * m + F.lit(a)) for m, a in STEPS]
    return rows.select(n.alias("snp_no"), pick(("A", "C", "G", "T"), n).alias("ref"), pick(ALTS, F.expr("p_partkey div 4")).alias("alt"), F.array(*gts).alias("gts"))


GENOTYPES = ("0/0", "0/1", "1|1", "./.", "1/0", ".", "0|1")
STEPS = ((1, 0), (3, 1), (5, 2))
ALTS = ("A", "C", "G", "T", "-", "CC")


def iupac_diploid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.bases(alignment.loci(_diploid(spark, sf_dir), 2)).select("snp_no", F.array_join("bases", "").alias("site"))


def resolved_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each resolved base is one of its genotype's alleles, and homozygotes' is theirs."""
    rows = alignment.bases(alignment.loci(_diploid(spark, sf_dir), 2), resolve=True)
    fits = F.forall(F.arrays_zip("gts", "bases"), lambda x: F.when(F.startswith(x.gts, F.lit(".")), x.bases == "N").otherwise(
        (F.contains(x.gts, F.lit("0")) & (x.bases == F.col("ref"))) | (F.contains(x.gts, F.lit("1")) & (x.bases == F.col("alt")))
    ))
    return rows.select("snp_no", fits.alias("fits"))


def binary_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.binary(alignment.loci(_diploid(spark, sf_dir), 2)).select("snp_no", F.array_join("bases", "").alias("site"))


def _alignment_file(form: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, path = base.alignment_rows(spark, sf_dir), folder(spark, form)
        alignments.write(found, path, form, outgroup="g3,x")
        return spark.read.text(path).select(F.col("value").alias("line"))

    return run


def _nation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("x"))
    pair = rows.select(F.col("s").alias("s1"), F.col("x").alias("x1")).join(rows.select(F.col("s").alias("s2"), F.col("x").alias("x2")), F.col("s1") < F.col("s2"))
    return pair.select("s1", "s2", F.abs(F.col("x1") - F.col("x2")).cast("double").alias("distance"))


def _clusters(of: Callable[[DataFrame], dict]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = of(_nation_distances(spark, sf_dir))
        return spark.createDataFrame(sorted((int(s), int(c)) for s, c in found.items()), "n_nationkey long, cluster long")

    return run


def snpmers_single_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = base.conversation_contigs(spark, sf_dir).filter("genome_idx = 0")
    rows = discover.snpmers(kmers.occurrences(contigs, base.K, places=False), 1, CallOptions(k=base.K, single_genome=True))
    return rows.select(base._flanks(), dna.base(F.col("c_lo")).alias("c_lo"), dna.base(F.col("c_hi")).alias("c_hi"), "present")


def genome_allele_counts_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = base._result(spark, sf_dir)
    rows = calls.allele_counts(calls.hits(own.occurrences, own.snpmers), saturate=True)
    return base._longs(rows.select(base._flanks(), "genome_idx", "n_lo", "n_hi"))


def kpos_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = base.conversation_contigs(spark, sf_dir).withColumn("contig", F.concat(F.lit("v"), (F.col("contig_idx") % 2).cast("string")))
    own = call_contigs(contigs, base.GENOMES, 0, CallOptions(k=base.K, min_freq=0.5, filt_type=0, positions=True, kpos_by_name=True))
    return base._longs(own.positions.select(base._flanks(), "genome_idx", "contig_idx", "contig", (F.col("pos") + 1).alias("pos"), "strand"))


def kc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = population.features(base._kc(spark, sf_dir).withColumn("flanks", dna.unpack(F.col("variant"), base.K - 1)))
    return rows.select("flanks", "sample", F.round("comp", 9).alias("comp"), F.round("log_depth", 9).alias("log_depth"), (F.col("a2") != 0).cast("long").alias("present"))


def queries() -> dict[str, Query]:
    return {
        "fasta_scan": _fasta(base.document_contigs, "none"), "fasta_gzip_scan": _fasta(base.conversation_contigs, "gzip"), "fastq_scan": fastq_scan,
        "bed_scan": bed_scan, "bed_list_scan": bed_list_scan, "vcf_scan": vcf_scan, "snpmer_extract": snpmer_extract, "metadata_scan": metadata_scan,
        "sample_ids": sample_ids, "renamed_samples": renamed_samples, "sample_table": sample_table, "label_pivot": label_pivot,
        "chromosome_ranks": chromosome_ranks, "group_filter": group_filter, "annotation_classes": annotation_classes, "region_split": region_split,
        "interval_long": interval_long, "iupac_diploid": iupac_diploid, "resolved_alleles": resolved_alleles, "binary_matrix": binary_matrix,
        "phylip_file": _alignment_file("phylip"), "nexus_file": _alignment_file("nexus"), "fasta_alignment_file": _alignment_file("fasta"),
        "clusters_complete": _clusters(lambda d: population.clusters_at(d, 30.0)), "clusters_ward": _clusters(lambda d: population.ward_clusters(d, range(5, 6))[5]),
        "snpmers_single_genome": snpmers_single_genome, "genome_allele_counts_saturated": genome_allele_counts_saturated,
        "kpos_by_name": kpos_by_name, "kc_features": kc_features,
    }


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def oracle_sql() -> dict[str, str]:
    occ = f"WITH {base._FROM_CONVERSATIONS}, {base._OCC}"
    site = occ + base._snp(0, 0.5) + base._SITES
    fit = site + ", fit AS (SELECT *, count(gt) OVER (PARTITION BY flanks) AS called FROM gt), seqs AS (SELECT 'g' || g AS sample, string_agg(CASE gt WHEN 0 THEN ref WHEN 1 THEN alt ELSE 'N' END, '' ORDER BY flanks) AS seq FROM fit WHERE called >= 6 GROUP BY g), size AS (SELECT max(length(seq)) AS m FROM seqs)"
    bed = """bed AS (SELECT 'c' || doc_id % 5 AS contig, doc_id * 37 % 5000 AS s, doc_id * 37 % 5000 + doc_id % 7 * 10 - 10 AS e FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 > 1)"""
    part = f"({_listed(('pat', 'mat.v1', 'hap1', 'hap2', 'pri', 'other'))})[s_suppkey % 6 + 1]"
    own_id = f"CASE WHEN s_suppkey % 10 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'HG_' || s_suppkey || {part} || '_x' END"
    number = "".join(["replace("] * 5) + "{}" + "".join(f", '{a}', '{b}')" for a, b in population.HAPLOTYPES.items())
    normal = f"CASE WHEN s_suppkey % 10 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE {number.format(f'(s_suppkey || {part})')} END"
    notes = f"""notes AS (SELECT s_suppkey, (['chr0', 'chr1', 'chrX'])[s_nationkey % 3 + 1] AS chrom, s_suppkey * 379 % 40000 AS b, s_suppkey * 379 % 40000 + 500 AS e,
  ({_listed(PREFIXES)})[s_suppkey % 8 + 1] AS name FROM supplier),
kinds AS (SELECT 'all' AS kind, * FROM notes WHERE chrom <> 'chrX' UNION ALL SELECT 'centromeric', * FROM notes WHERE chrom <> 'chrX' AND regexp_matches(name, '^(hor_|dhor_)')
  UNION ALL SELECT 'pericentromeric', * FROM notes WHERE chrom <> 'chrX' AND regexp_matches(name, '^(hsat1A_|ct_|rDNA_)'))"""
    diploid = f"""WITH p AS (SELECT p_partkey AS snp_no, (['A', 'C', 'G', 'T'])[p_partkey % 4 + 1] AS ref, ({_listed(ALTS)})[(p_partkey // 4) % 6 + 1] AS alt,
  [{", ".join(f"({_listed(GENOTYPES)})[(p_partkey * {m} + {a}) % 7 + 1]" for m, a in STEPS)}] AS gts FROM part),
fit AS (SELECT * FROM p WHERE length(alt) = 1 AND len(list_filter(gts, lambda g: NOT starts_with(g, '.'))) >= 2),
cell AS (SELECT snp_no, ref, replace(alt, '-', '*') AS alt, i, gts[i] AS g FROM fit, (SELECT unnest([1, 2, 3]) AS i)),
code AS (SELECT snp_no, i, g, list_sort(list_distinct(CASE WHEN starts_with(g, '.') THEN ['N'] ELSE [CASE WHEN g[1] = '0' THEN ref ELSE alt END, CASE WHEN g[3] = '0' THEN ref ELSE alt END] END)) AS a FROM cell)"""
    names = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "*": "-"}
    iupac = "CASE array_to_string(a, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " ELSE CASE WHEN len(a) = 2 THEN lower(a[2]) ELSE a[1] END END"
    by_region = "SELECT n_nationkey, dense_rank() OVER (ORDER BY m) AS cluster FROM (SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS m FROM nation)"
    wide = ", ".join(f"max(s_suppkey) FILTER (n = {i}) AS chr{i}, max(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 4 END) FILTER (n = {i}) AS chr{i}_tree" for i in range(3))
    return {
        "fasta_scan": f"WITH {base._FROM_DOCUMENTS} SELECT name AS contig, seq FROM contigs",
        "fasta_gzip_scan": f"WITH {base._FROM_CONVERSATIONS} SELECT name AS contig, seq FROM contigs",
        "fastq_scan": f"WITH {base._FROM_CONVERSATIONS} SELECT name AS contig, seq FROM contigs",
        "bed_scan": f'WITH {bed} SELECT contig, s AS start, e AS "end" FROM bed',
        "bed_list_scan": f'WITH {bed} SELECT CAST(0 AS BIGINT) AS genome_idx, contig, s AS start, e AS "end" FROM bed UNION ALL SELECT 1, \'s\', 0, s_suppkey + 1 FROM supplier',
        "vcf_scan": site + " SELECT chrom || ':' || pos || ':' || snpmer AS variant, chrom, 'g' || g AS sample, coalesce(CAST(gt AS VARCHAR), '.') AS gt, ref, alt, kc_ref AS a1, kc_alt AS a2 FROM gt",
        "snpmer_extract": site + " SELECT snpmer, ref, alt FROM shown",
        "metadata_scan": f"""SELECT {own_id} AS sample_id, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS VARCHAR) END AS hap_chrom, s_name AS individual, CAST(NULL AS VARCHAR) AS sex,
            CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS VARCHAR) END AS continent, 'P' AS pop_code, 'C' AS country FROM supplier""",
        "sample_ids": f"SELECT s_suppkey, {normal} AS sample_id FROM supplier",
        "renamed_samples": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE 'x/files/' || s_name || '.fa' END AS sample FROM supplier",
        "sample_table": f"""WITH s AS (SELECT *, {normal} AS sample_id, s_nationkey % 3 AS n FROM supplier)
            SELECT sample_id, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS VARCHAR) END AS hap_chrom, s_name AS individual, w.* EXCLUDE (id) FROM s JOIN (SELECT sample_id AS id, {wide} FROM s GROUP BY 1) w ON id = sample_id""",
        "label_pivot": "SELECT n_regionkey, coalesce(max(n_nationkey) FILTER (n_nationkey % 2 = 0), -1) AS k0, coalesce(max(n_nationkey) FILTER (n_nationkey % 2 = 1), -1) AS k1 FROM nation GROUP BY 1",
        "chromosome_ranks": """SELECT 'chr' || c AS chrom, row_number() OVER (ORDER BY try_cast(c AS BIGINT) NULLS LAST, c) AS rank
            FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS c FROM nation)""",
        "group_filter": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
            WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) < 170 AND min(l_quantity) >= 5)""",
        "annotation_classes": f"WITH {notes} SELECT kind, s_suppkey FROM kinds",
        "region_split": f"""WITH {notes}, v AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (['chr0', 'chr1'])[l_orderkey % 3 + 1] AS chrom, l_partkey * 20 AS p FROM lineitem WHERE l_orderkey % 3 < 2)
            SELECT k.kind, l_orderkey, l_linenumber, v.chrom FROM v, (SELECT unnest(['centromeric', 'pericentromeric']) AS kind) k
            WHERE EXISTS (SELECT 1 FROM kinds WHERE kinds.kind = k.kind AND kinds.chrom = v.chrom AND p < e AND p + 2 > b)
            UNION ALL SELECT 'outside', l_orderkey, l_linenumber, chrom FROM v WHERE NOT EXISTS (SELECT 1 FROM kinds WHERE kind = 'all' AND kinds.chrom = v.chrom AND p < e AND p + 2 > b)""",
        "interval_long": """SELECT s_suppkey, EXISTS (SELECT 1 FROM nation WHERE s_suppkey * 7919 % 1000000 < n_nationkey * 43000 + 10
            AND s_suppkey * 7919 % 1000000 + 20000 + s_suppkey * 911 % 80000 > n_nationkey * 43000) AS inside FROM supplier""",
        "iupac_diploid": diploid + f" SELECT snp_no, string_agg({iupac}, '' ORDER BY i) AS site FROM code GROUP BY 1",
        "resolved_alleles": diploid + " SELECT snp_no, true AS fits FROM fit",
        "binary_matrix": diploid + """ SELECT snp_no, string_agg(CASE WHEN starts_with(g, '.') THEN '?' ELSE CAST(CAST(g[1] AS INT) + CAST(g[3] AS INT) AS VARCHAR) END, '' ORDER BY i) AS site FROM cell GROUP BY 1""",
        "phylip_file": fit + " SELECT (SELECT count(*) FROM seqs) || ' ' || coalesce(m, 0) AS line FROM size UNION ALL SELECT sample || '   ' || seq FROM seqs",
        "nexus_file": fit + r""" SELECT unnest(['#NEXUS', '', 'BEGIN DATA;', chr(9) || 'DIMENSIONS NTAX=' || (SELECT count(*) FROM seqs) || ' NCHAR=' || coalesce(m, 0) || ';', chr(9) || 'FORMAT DATATYPE=DNA MISSING=N GAP=- ;', 'MATRIX', ';', 'END;']) AS line FROM size
            UNION ALL SELECT sample || '   ' || seq FROM seqs""",
        "fasta_alignment_file": fit + " SELECT unnest(['>' || sample, seq]) AS line FROM seqs",
        "clusters_complete": by_region, "clusters_ward": by_region,
        "snpmers_single_genome": occ + """ SELECT flanks, c[1] AS c_lo, coalesce(c[2], 'A') AS c_hi, CAST(1 AS BIGINT) AS present
            FROM (SELECT flanks, list_sort(list(DISTINCT ctr)) AS c FROM occ WHERE g = 0 GROUP BY 1)""",
        "genome_allele_counts_saturated": site + " SELECT flanks, g AS genome_idx, least(n_lo, 8191) AS n_lo, least(n_hi, 8191) AS n_hi FROM cnt",
        "kpos_by_name": site + """, named AS (SELECT DISTINCT anchor.c % 2 AS n FROM site WHERE anchor IS NOT NULL),
            ranked AS (SELECT hit.flanks, hit.g, hit.c, hit.pos, hit.fwd, row_number() OVER (PARTITION BY flanks, g ORDER BY c, pos) AS r FROM hit)
            SELECT flanks, ranked.g AS genome_idx, ranked.c AS contig_idx, 'v' || ranked.c % 2 AS contig, ranked.pos + 1 AS pos, CASE WHEN ranked.fwd = site.fwd THEN '+' ELSE '-' END AS strand
            FROM ranked JOIN site USING (flanks) WHERE NOT (r = 1 AND ranked.c % 2 IN (SELECT n FROM named))""",
        "kc_features": site + """ SELECT flanks, g AS sample, round(kc_ref / (kc_ref + kc_alt + CAST(1e-10 AS DOUBLE)), 9) AS comp, round(ln(CAST(1 + kc_ref + kc_alt AS DOUBLE)), 9) AS log_depth,
            CAST(kc_alt <> 0 AS BIGINT) AS present FROM kc""",
    }
