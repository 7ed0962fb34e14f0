"""The registered queries over the driver's tables, and the SQL that checks them.

No table holds DNA, so contigs are made from the texts of `conversations` (and of `documents` for the flagship): letters
become ACGT by their place in the alphabet, the rest is left out; the genome is the id modulo 8, genome 0 the reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import CallOptions
from .functions import dna
from .operators import alignment, calls, discover, kmers, population, regions, search
from .plans.count import Result, call_contigs
from .sources import sequences, vcf

GENOMES, K, HALF = 8, 11, 5
SITES = CallOptions(k=K, min_freq=0.5, filt_type=0, positions=True)
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return rows.select(
        (F.col("conv_id") % GENOMES).cast("int").alias("genome_idx"), (F.col("conv_id") * 1000 + F.col("turn")).alias("contig_idx"),
        F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("contig"),
        dna.from_text(F.coalesce("text", F.lit(""))).alias("seq"),
    )


def document_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    return rows.select(
        (F.col("doc_id") % GENOMES).cast("int").alias("genome_idx"), F.col("doc_id").alias("contig_idx"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("contig"), dna.from_text(F.coalesce("text", F.lit("")), keep_gaps=True).alias("seq"),
    )


def _result(spark: SparkSession, sf_dir: str) -> Result:
    return call_contigs(conversation_contigs(spark, sf_dir), GENOMES, 0, SITES)


def _flanks() -> Column:
    return dna.unpack(F.col("flanks"), K - 1).alias("flanks")


def _longs(df: DataFrame) -> DataFrame:
    """Integers as long, as the checking SQL has them."""
    return df.select(*(F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.occurrences(conversation_contigs(spark, sf_dir), K)


def kmer_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(_occurrences(spark, sf_dir).select("genome_idx", "contig_idx", "pos", _flanks(), dna.base(F.col("center")).alias("center"), "fwd"))


def kmer_canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = kmers.occurrences(conversation_contigs(spark, sf_dir), K, places=False)
    rows = occ.groupBy("flanks", "genome_idx", "center").agg(F.count(F.lit(1)).alias("n"))
    return _longs(rows.select(_flanks(), "genome_idx", dna.base(F.col("center")).alias("center"), "n"))


def palindromic_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = conversation_contigs(spark, sf_dir)
    windows = contigs.groupBy("genome_idx").agg(F.sum(F.greatest(F.length("seq") - K + 1, F.lit(0))).alias("windows"))
    kept = kmers.occurrences(contigs, K, places=False).groupBy("genome_idx").agg(F.count(F.lit(1)).alias("kept"))
    rows = windows.join(kept, "genome_idx", "left")
    return _longs(rows.select("genome_idx", "windows", (F.col("windows") - F.coalesce("kept", F.lit(0))).alias("palindromic")))


def _snpmers(filt_type: int, min_freq: float, contigs: Callable = conversation_contigs) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        occ = kmers.occurrences(contigs(spark, sf_dir), K, places=False)
        rows = discover.snpmers(occ, GENOMES, CallOptions(k=K, min_freq=min_freq, filt_type=filt_type))
        return rows.select(_flanks(), dna.base(F.col("c_lo")).alias("c_lo"), dna.base(F.col("c_hi")).alias("c_hi"), "present")

    return run


def snpmer_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("c_first") == F.col("c_lo"), F.col("c_hi")).otherwise(F.col("c_lo"))
    return _result(spark, sf_dir).sites.select(_flanks(), dna.base(F.col("c_first")).alias("first_seen"), dna.base(other).alias("second_seen"))


def genome_allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _result(spark, sf_dir)
    rows = calls.allele_counts(calls.hits(own.occurrences, own.snpmers))
    return _longs(rows.select(_flanks(), "genome_idx", "n_lo", "n_hi"))


def genotype_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(_result(spark, sf_dir).genotypes().select(_flanks(), "genome_idx", "kc_ref", "kc_alt", "gt"))


def site_stats_ac_an_af(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).sites.select(_flanks(), "ref", "alt", "ac", "an", "af")


def anchor_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).sites.select(_flanks(), F.coalesce("chrom", F.lit(".")).alias("chrom"), "pos", "fwd")


def snpmer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).sites.select(_flanks(), "snpmer")


def kpos_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result(spark, sf_dir).positions
    return _longs(rows.select(_flanks(), "genome_idx", "contig", (F.col("pos") + 1).alias("pos"), "strand"))


def _text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    start = F.col("doc_id") * 37 % 5000
    return rows.select(F.coalesce("source", F.lit("")).alias("contig"), start.alias("start"), (start + F.col("doc_id") % 7 * 10).alias("end")).filter("end > start")


def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.merge(_text_regions(spark, sf_dir), ["contig"])


def region_restricted_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = conversation_contigs(spark, sf_dir)
    start = F.col("contig_idx") % 97
    beds = contigs.select("genome_idx", "contig", F.explode(F.array(F.struct(start.alias("start"), (start + 60).alias("end")), F.struct((start + 60).alias("start"), (start + 90).alias("end")), F.struct((start + 200).alias("start"), (start + 300).alias("end")))).alias("r"))
    occ = kmers.occurrences(regions.pieces(contigs, beds.select("genome_idx", "contig", "r.start", "r.end"), K), K)
    return _longs(occ.select("genome_idx", "contig_idx", "pos", _flanks()))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("chrom"), (F.col("l_partkey") * 20 + 1).alias("pos"), F.repeat(F.lit("A"), F.col("l_linenumber")).alias("ref"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    start = F.col("s_suppkey") * 379 % 40000
    chrom = F.array(F.lit("AF"), F.lit("NO"), F.lit("RF"))[(F.col("s_suppkey") % 3).cast("int")]
    return rows.select(chrom.alias("chrom"), start.alias("start"), (start + 50 + F.col("s_nationkey")).alias("end"))


def interval_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(regions.intersecting(_variants(spark, sf_dir), _spans(spark, sf_dir)).select("l_orderkey", "l_linenumber", "chrom", "pos"))


def interval_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(regions.outside(_variants(spark, sf_dir), _spans(spark, sf_dir)).select("l_orderkey", "l_linenumber", "chrom", "pos"))


def call_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result(spark, sf_dir).sites
    cell = lambda i: F.concat(F.coalesce(F.col("cells")[i].gt.cast("string"), F.lit(".")), F.lit(":"), F.col("cells")[i].kc_ref.cast("string"), F.lit(","), F.col("cells")[i].kc_alt.cast("string"))
    return rows.select(_flanks(), *(cell(i).alias(f"g{i}") for i in range(GENOMES)))


SAMPLES = [f"g{i}" for i in range(GENOMES)]


def _loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    gts = F.transform("cells", lambda c: F.coalesce(c.gt.cast("string"), F.lit(".")))
    return _result(spark, sf_dir).sites.select(_flanks().alias("snp_no"), "ref", "alt", gts.alias("gts"))


def locus_missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.loci(_loci(spark, sf_dir), min_samples=6)
    return _longs(rows.select("snp_no", alignment.n_called(F.col("gts")).alias("called")))


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.sequences(alignment.bases(alignment.loci(_loci(spark, sf_dir), min_samples=6)), SAMPLES)


def variable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.variable(alignment.bases(alignment.loci(_loci(spark, sf_dir), min_samples=6))).select("snp_no")


def _kc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result(spark, sf_dir).sites
    return rows.select(F.col("flanks").alias("variant"), F.coalesce("chrom", F.lit(".")).alias("chrom"), F.posexplode("cells").alias("sample", "c")).select(
        "variant", "chrom", F.col("sample").cast("long").alias("sample"), F.col("c.kc_ref").alias("a1"), F.col("c.kc_alt").alias("a2")
    )


def _counts(spark: SparkSession, sf_dir: str) -> population.Matrix:
    return population.of_cells(_result(spark, sf_dir).sites, list(range(GENOMES)))


def jaccard_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = population.jaccard_distance(_counts(spark, sf_dir))
    return rows.withColumn("distance", F.round("distance", 9))


def _mixed(inner: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return population.mixed_distance(_counts(spark, sf_dir), inner).withColumn("distance", F.round("distance", 6))

    return run


def depth_by_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.depth_by_contig(_kc(spark, sf_dir)).withColumn("depth", F.round("depth", 9))


def nmi_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.mutual_information(_table(spark, sf_dir, "documents"), "lang", "source").withColumn("nmi", F.round("nmi", 9))


def vcf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).lines().select("line")


def vcf_unanchored_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result(spark, sf_dir).sites.withColumn("chrom", F.coalesce("chrom", F.lit(".")))
    return vcf.cleaned(rows).select(_flanks(), "chrom", "pos")


def snpmer_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.snpmer_records(_result(spark, sf_dir).sites)


def snpmer_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _result(spark, sf_dir)
    return _longs(search.exact_hits(sequences.snpmer_records(own.sites), own.occurrences, K))


def sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", dna.sample_name(F.coalesce("url", F.lit(""))).alias("name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNP-mers of the documents' genomes with their calls' statistics."""
    own = call_contigs(document_contigs(spark, sf_dir), GENOMES, 0, CallOptions(k=K, min_freq=0.25))
    return own.sites.select(_flanks(), F.coalesce("chrom", F.lit(".")).alias("chrom"), "pos", "ref", "alt", "snpmer", "ac", "an", "af")


def queries() -> dict[str, Query]:
    return {
        "kmer_occurrences": kmer_occurrences, "kmer_canonical_counts": kmer_canonical_counts, "palindromic_flanks": palindromic_flanks,
        "snpmers_f0": _snpmers(0, 0.0), "snpmers_f1": _snpmers(1, 0.0), "snpmers_f2": _snpmers(2, 0.0), "snpmers_minfreq": _snpmers(0, 0.5),
        "snpmers_documents": _snpmers(2, 0.25, document_contigs), "snpmer_alleles": snpmer_alleles, "genome_allele_counts": genome_allele_counts,
        "genotype_calls": genotype_calls, "site_stats_ac_an_af": site_stats_ac_an_af, "anchor_loci": anchor_loci, "kpos_hits": kpos_hits,
        "region_merge": region_merge, "region_restricted_kmers": region_restricted_kmers, "interval_semi": interval_semi,
        "interval_anti": interval_anti, "call_matrix_pivot": call_matrix_pivot, "snpmer_context": snpmer_context,
        "locus_missing_filter": locus_missing_filter, "alignment_rows": alignment_rows, "variable_sites": variable_sites,
        "jaccard_distance": jaccard_distance, "mixed_distance": _mixed("manhattan"), "mixed_distance_hypot": _mixed("euclidean"),
        "depth_by_contig": depth_by_contig, "nmi_labels": nmi_labels, "vcf_text": vcf_text, "vcf_unanchored_dropped": vcf_unanchored_dropped,
        "snpmer_fasta": snpmer_fasta, "snpmer_exact_hits": snpmer_exact_hits, "sample_names": sample_names, "snpmer_calls": flagship,
    }


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_BASES = f"translate(lower(coalesce(text, '')), '{dna.LETTERS}', '{('ACGT' * 7)[:26]}')"
_FROM_CONVERSATIONS = f"""
contigs AS (SELECT conv_id % 8 AS g, conv_id * 1000 + turn AS c, 'v' || conv_id || '_' || turn AS name,
                   regexp_replace({_BASES}, '[^ACGT]', '', 'g') AS seq FROM conversations)"""
_FROM_DOCUMENTS = f"""
contigs AS (SELECT doc_id % 8 AS g, doc_id AS c, 'd' || doc_id AS name, regexp_replace({_BASES}, '[^ACGT]', 'N', 'g') AS seq FROM documents)"""
_OCC = f"""
windows AS (SELECT g, c, i + 4 AS pos, substr(seq, i, 11) AS f FROM (
              SELECT *, unnest(range(1, length(seq) - 9)) AS i FROM contigs WHERE length(seq) >= 11)),
turned AS (SELECT g, c, pos, f, {_RC.format("f")} AS r FROM windows WHERE NOT contains(f, 'N')),
occ AS MATERIALIZED (SELECT g, c, pos, f < r AS fwd, substr(y, 1, 5) || substr(y, 7) AS flanks, substr(y, 6, 1) AS ctr
        FROM (SELECT *, least(f, r) AS y FROM turned) WHERE substr(y, 1, 5) <> {_RC.format("substr(y, 7)")})"""


def _snp(filt_type: int, min_freq: float) -> str:
    having = ("", " AND max(n_ctr) = 1", " AND max(n_occ) = 1")[filt_type]
    return f""",
two AS (SELECT flanks, min(ctr) AS lo, max(ctr) AS hi FROM occ GROUP BY flanks HAVING count(DISTINCT ctr) = 2),
per AS (SELECT flanks, g, count(*) AS n_occ, count(DISTINCT ctr) AS n_ctr FROM occ GROUP BY 1, 2),
snp AS MATERIALIZED (SELECT flanks, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS present FROM per JOIN two USING (flanks) GROUP BY flanks
        HAVING NOT ((8 - count(*)) / CAST(8 AS DOUBLE) > CAST(1.0 AS DOUBLE) - CAST({min_freq} AS DOUBLE) + CAST(1e-9 AS DOUBLE)){having})"""


_SITES = f""",
hit AS MATERIALIZED (SELECT occ.*, lo, hi FROM occ JOIN snp USING (flanks)),
cnt AS (SELECT flanks, g, count(*) FILTER (ctr = lo) AS n_lo, count(*) FILTER (ctr = hi) AS n_hi FROM hit GROUP BY 1, 2),
seen AS (SELECT flanks, lo, hi, arg_min(ctr, {{'g': g, 'c': c, 'p': pos}}) AS cb1,
                min({{'c': c, 'p': pos, 'f': fwd}}) FILTER (g = 0) AS anchor FROM hit GROUP BY 1, 2, 3),
refs AS (SELECT seen.*, CASE WHEN cb1 = lo THEN hi ELSE lo END AS cb2, coalesce(n_lo, 0) AS r_lo, coalesce(n_hi, 0) AS r_hi
         FROM seen LEFT JOIN cnt ON cnt.flanks = seen.flanks AND cnt.g = 0),
sited AS (SELECT *, CASE WHEN (CASE WHEN cb1 = lo THEN r_lo ELSE r_hi END) > (CASE WHEN cb1 = lo THEN r_hi ELSE r_lo END) THEN cb1 ELSE cb2 END AS rb,
                 coalesce(anchor.f, false) AS fwd FROM refs),
site AS MATERIALIZED (SELECT *, CASE WHEN rb = lo THEN hi ELSE lo END AS ab, coalesce(anchor.p + 1, 0) AS pos,
         CASE WHEN anchor IS NULL THEN '.' ELSE (SELECT name FROM contigs WHERE contigs.g = 0 AND contigs.c = sited.anchor.c) END AS chrom FROM sited),
shown AS (SELECT *, CASE WHEN fwd THEN rb ELSE translate(rb, 'ACGT', 'TGCA') END AS ref, CASE WHEN fwd THEN ab ELSE translate(ab, 'ACGT', 'TGCA') END AS alt,
          CASE WHEN fwd THEN substr(flanks, 1, 5) || rb || substr(flanks, 6) ELSE {_RC.format("substr(flanks, 1, 5) || rb || substr(flanks, 6)")} END AS snpmer FROM site),
kc AS MATERIALIZED (SELECT shown.flanks, gs.g, chrom, shown.pos, ref, alt, snpmer, CASE WHEN rb = lo THEN coalesce(n_lo, 0) ELSE coalesce(n_hi, 0) END AS kc_ref,
              CASE WHEN rb = lo THEN coalesce(n_hi, 0) ELSE coalesce(n_lo, 0) END AS kc_alt
       FROM shown CROSS JOIN (SELECT unnest(range(8)) AS g) gs LEFT JOIN cnt ON cnt.flanks = shown.flanks AND cnt.g = gs.g),
gt AS (SELECT *, CASE WHEN kc_ref > 0 AND kc_alt = 0 THEN 0 WHEN kc_ref = 0 AND kc_alt > 0 THEN 1 END AS gt FROM kc),
stats AS (SELECT flanks, chrom, pos, ref, alt, snpmer, count(*) FILTER (gt = 1) AS ac, count(gt) AS an,
                 CASE WHEN count(gt) > 0 THEN count(*) FILTER (gt = 1) / CAST(count(gt) AS DOUBLE) ELSE 0.0 END AS af FROM gt GROUP BY ALL),
kpos AS (SELECT hit.flanks, hit.g, name, hit.c, hit.pos, CASE WHEN hit.fwd = site.fwd THEN '+' ELSE '-' END AS strand
         FROM hit JOIN site USING (flanks) JOIN contigs ON contigs.g = hit.g AND contigs.c = hit.c
         WHERE NOT (hit.g = 0 AND anchor IS NOT NULL AND hit.c = anchor.c AND hit.pos = anchor.p))"""


def oracle_sql() -> dict[str, str]:
    occ = f"WITH {_FROM_CONVERSATIONS}, {_OCC}"
    site = occ + _snp(0, 0.5) + _SITES
    # loci with at least six called genotypes
    loci = site + ", loci AS (SELECT *, count(gt) OVER (PARTITION BY flanks) AS called FROM gt), fit AS (SELECT * FROM loci WHERE called >= 6)"
    snp = " SELECT flanks, lo AS c_lo, hi AS c_hi, present FROM snp"
    cell = "coalesce(CAST(gt AS VARCHAR), '.') || ':' || kc_ref || ',' || kc_alt"
    spans = """WITH v AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag || l_linestatus AS chrom, l_partkey * 20 + 1 AS pos FROM lineitem),
s AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' ELSE 'RF' END AS chrom, s_suppkey * 379 % 40000 AS b, s_suppkey * 379 % 40000 + 50 + s_nationkey AS e FROM supplier)
SELECT * FROM v WHERE {} (SELECT 1 FROM s WHERE s.chrom = v.chrom AND v.pos - 1 < e AND v.pos - 1 + l_linenumber > b)"""
    pairs = site + """, x AS (SELECT *, kc_ref / (kc_ref + kc_alt + CAST(1e-10 AS DOUBLE)) AS comp, ln(CAST(1 + kc_ref + kc_alt AS DOUBLE)) AS dep FROM kc)
SELECT p.g AS s1, q.g AS s2, round(@, 6) AS distance FROM x p JOIN x q ON p.flanks = q.flanks AND p.g < q.g GROUP BY 1, 2"""
    merge = """m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {0} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY {0} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
merged AS (SELECT {0}, min(s) AS s, max(e) AS e FROM i GROUP BY {0}, isl)"""
    return {
        "kmer_occurrences": occ + " SELECT g AS genome_idx, c AS contig_idx, pos, flanks, ctr AS center, fwd FROM occ",
        "kmer_canonical_counts": occ + " SELECT flanks, g AS genome_idx, ctr AS center, count(*) AS n FROM occ GROUP BY ALL",
        "palindromic_flanks": occ + """ SELECT g AS genome_idx, CAST(sum(greatest(length(seq) - 10, 0)) AS BIGINT) AS windows,
            CAST(sum(greatest(length(seq) - 10, 0)) - (SELECT count(*) FROM occ WHERE occ.g = contigs.g) AS BIGINT) AS palindromic FROM contigs GROUP BY g""",
        "snpmers_f0": occ + _snp(0, 0.0) + snp, "snpmers_f1": occ + _snp(1, 0.0) + snp, "snpmers_f2": occ + _snp(2, 0.0) + snp, "snpmers_minfreq": occ + _snp(0, 0.5) + snp,
        "snpmers_documents": f"WITH {_FROM_DOCUMENTS}, {_OCC}" + _snp(2, 0.25) + snp,
        "snpmer_alleles": site + " SELECT flanks, cb1 AS first_seen, cb2 AS second_seen FROM site",
        "genome_allele_counts": site + " SELECT flanks, g AS genome_idx, n_lo, n_hi FROM cnt",
        "genotype_calls": site + " SELECT flanks, g AS genome_idx, kc_ref, kc_alt, CAST(gt AS BIGINT) AS gt FROM gt",
        "site_stats_ac_an_af": site + " SELECT flanks, ref, alt, ac, an, CAST(af AS DOUBLE) AS af FROM stats",
        "anchor_loci": site + " SELECT flanks, chrom, pos, fwd FROM site",
        "snpmer_context": site + " SELECT flanks, snpmer FROM shown",
        "kpos_hits": site + " SELECT flanks, g AS genome_idx, name AS contig, pos + 1 AS pos, strand FROM kpos",
        "region_merge": "WITH r AS (SELECT coalesce(source, '') AS contig, doc_id * 37 % 5000 AS s, doc_id * 37 % 5000 + doc_id % 7 * 10 AS e FROM documents WHERE doc_id % 7 > 0), "
        + merge.format("contig") + ' SELECT contig, s AS start, e AS "end" FROM merged',
        "region_restricted_kmers": occ + ", r AS (SELECT g, c, c % 97 + o[1] AS s, c % 97 + o[2] AS e FROM contigs, (SELECT unnest([[0, 60], [60, 90], [200, 300]]) AS o)), "
        + merge.format("g, c") + " SELECT occ.g AS genome_idx, occ.c AS contig_idx, pos, flanks FROM occ JOIN merged ON occ.g = merged.g AND occ.c = merged.c AND s <= pos - 5 AND pos + 5 < e",
        "interval_semi": spans.format("EXISTS"), "interval_anti": spans.format("NOT EXISTS"),
        "call_matrix_pivot": site + " SELECT flanks, " + ", ".join(f"max({cell}) FILTER (g = {i}) AS g{i}" for i in range(GENOMES)) + " FROM gt GROUP BY flanks",
        "locus_missing_filter": loci + " SELECT DISTINCT flanks AS snp_no, called FROM fit",
        "alignment_rows": loci + " SELECT 'g' || g AS sample, string_agg(CASE gt WHEN 0 THEN ref WHEN 1 THEN alt ELSE 'N' END, '' ORDER BY flanks) AS seq FROM fit GROUP BY g",
        "variable_sites": loci + " SELECT flanks AS snp_no FROM fit GROUP BY flanks HAVING count(DISTINCT gt) > 1",
        "jaccard_distance": site + """ SELECT p.g AS s1, q.g AS s2, round(CASE WHEN count(*) FILTER (p.kc_alt > 0 OR q.kc_alt > 0) = 0 THEN 0.0 ELSE
            1 - count(*) FILTER (p.kc_alt > 0 AND q.kc_alt > 0) / CAST(count(*) FILTER (p.kc_alt > 0 OR q.kc_alt > 0) AS DOUBLE) END, 9) AS distance
            FROM kc p JOIN kc q ON p.flanks = q.flanks AND p.g < q.g GROUP BY 1, 2""",
        "mixed_distance": pairs.replace("@", "sum(abs(p.comp - q.comp) + 0.01 * abs(p.dep - q.dep))"),
        "mixed_distance_hypot": pairs.replace("@", "sum(sqrt(pow(p.comp - q.comp, 2) + pow(0.01 * (p.dep - q.dep), 2)))"),
        "depth_by_contig": site + " SELECT g AS sample, chrom, round(ln(CAST(1 + sum(kc_ref + kc_alt) AS DOUBLE)), 9) AS depth FROM kc GROUP BY ALL",
        "nmi_labels": """WITH t AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
s AS (SELECT sum(n) AS t FROM t), h AS (SELECT
  (SELECT sum(-k / t * ln(k / t)) FROM (SELECT CAST(sum(n) AS DOUBLE) AS k FROM t GROUP BY a), s) AS ha,
  (SELECT sum(-k / t * ln(k / t)) FROM (SELECT CAST(sum(n) AS DOUBLE) AS k FROM t GROUP BY b), s) AS hb,
  (SELECT sum(-n / t * ln(n / t)) FROM t, s) AS hab)
SELECT round(CASE WHEN greatest(ha, hb) = 0 THEN 1.0 ELSE (ha + hb - hab) / greatest(ha, hb) END, 9) AS nmi FROM h""",
        "vcf_text": site + f""", cells AS (SELECT flanks, string_agg({cell}, chr(9) ORDER BY g) AS body FROM gt GROUP BY flanks),
where_ AS (SELECT flanks, string_agg(name || '|' || strand || '|' || (pos + 1), ',' ORDER BY g, c, pos) AS kp FROM kpos GROUP BY flanks)
SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), '.', ref, alt, '.', '.', 'AC=' || ac || ';AN=' || an || ';AF=' || printf('%.4g', CAST(af AS DOUBLE)) ||
  ';SNPMER=' || snpmer || coalesce(';KPOS=' || kp, ''), 'GT:KC', body) AS line FROM stats JOIN cells USING (flanks) LEFT JOIN where_ USING (flanks)""",
        "vcf_unanchored_dropped": site + " SELECT flanks, chrom, pos FROM site WHERE chrom <> '.' AND pos <> 0",
        "snpmer_fasta": site + " SELECT unnest([substr(snpmer, 1, 5) || ref || substr(snpmer, 7), substr(snpmer, 1, 5) || alt || substr(snpmer, 7)]) AS mer FROM shown",
        "snpmer_exact_hits": site + f""", mers AS (SELECT DISTINCT unnest([substr(snpmer, 1, 5) || ref || substr(snpmer, 7), substr(snpmer, 1, 5) || alt || substr(snpmer, 7)]) AS mer FROM shown),
both_ AS (SELECT mer, mer AS f, '+' AS strand FROM mers UNION ALL SELECT mer, {_RC.format("mer")}, '-' FROM mers),
ranked AS (SELECT mer, g AS genome_idx, c AS contig_idx, pos, strand, row_number() OVER (PARTITION BY mer ORDER BY g, c, pos) AS n FROM both_ JOIN windows USING (f))
SELECT mer, genome_idx, contig_idx, pos, strand FROM ranked WHERE n <= 50""",
        "sample_names": r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^.*/', ''), '(.)\.(gz|bz2|xz|zst)$', '\1'), '\.[^.]*$', '') AS name FROM pages""",
        "snpmer_calls": f"WITH {_FROM_DOCUMENTS}, {_OCC}" + _snp(2, 0.25) + _SITES + " SELECT flanks, chrom, pos, ref, alt, snpmer, ac, an, CAST(af AS DOUBLE) AS af FROM stats",
    }
