"""Calls: allele counts per genome, the reference anchor, orientation, genotypes and site statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..options import CallOptions

ANCHOR_BYTES = 96  # of a site's flanks, strand and anchor in a broadcast


def hits(occ: DataFrame, snp: DataFrame) -> DataFrame:
    """Occurrences of SNP-mers with their two centres. snp is broadcast if it is marked so, see staging; otherwise both are shuffled."""
    return occ.hint("merge").join(snp.select("flanks", "c_lo", "c_hi"), "flanks")


def allele_counts(found: DataFrame, saturate: bool = False) -> DataFrame:
    """By flanks and genome: n_lo, n_hi and the first hit in contig order."""
    cap = (lambda c: F.least(c, F.lit(8191))) if saturate else (lambda c: c)
    rows = found.groupBy("flanks", "c_lo", "c_hi", "genome_idx").agg(
        cap(F.count_if(F.col("center") == F.col("c_lo"))).alias("n_lo"),
        cap(F.count_if(F.col("center") == F.col("c_hi"))).alias("n_hi"),
        F.min(F.struct("contig_idx", "pos", "center", "fwd")).alias("first"),
    )
    return rows


def sites(counts: DataFrame, ref_idx: int, k: int) -> DataFrame:
    """One row per SNP-mer: flanks, c_first (seen first over genomes), anchor, ref and alt codes, strand, text forms
    and `counts`, a map from genome to (lo, hi).

    REF is the majority allele of the reference genome; ties, so also absence, go to the allele seen second. Without
    a hit in the reference there is no anchor and the site is written on the reverse strand.
    """
    rows = counts.groupBy("flanks", "c_lo", "c_hi").agg(
        F.min(F.struct("genome_idx", "first")).alias("seen"),
        F.max(F.when(F.col("genome_idx") == ref_idx, F.struct("first.contig_idx", "first.pos", "first.fwd"))).alias("anchor"),
        F.map_from_entries(F.collect_list(F.struct("genome_idx", F.struct("n_lo", "n_hi")))).alias("counts"),
    )
    seen_lo = F.col("seen.first.center") == F.col("c_lo")
    own = F.try_element_at("counts", F.lit(ref_idx))
    lo, hi = F.coalesce(own.n_lo, F.lit(0)), F.coalesce(own.n_hi, F.lit(0))
    ref_is_lo = F.when(seen_lo, lo > hi).otherwise(lo >= hi)
    rows = rows.withColumns({
        "ref_is_lo": ref_is_lo, "fwd": F.coalesce("anchor.fwd", F.lit(False)), "c_first": F.col("seen.first.center"),
    })
    rows = rows.withColumns({
        "ref_code": F.when(F.col("ref_is_lo"), F.col("c_lo")).otherwise(F.col("c_hi")),
        "alt_code": F.when(F.col("ref_is_lo"), F.col("c_hi")).otherwise(F.col("c_lo")),
    })
    return rows.withColumns(oriented(k)).drop("seen")


def oriented(k: int) -> dict[str, Column]:
    """REF, ALT and the SNP-mer on the forward strand of the reference."""
    half = k // 2
    fwd, r, a = F.col("fwd"), dna.base(F.col("ref_code")), dna.base(F.col("alt_code"))
    both = dna.unpack(F.col("flanks"), k - 1)
    left, right = F.substring(both, 1, half), F.substring(both, half + 1, half)
    mer = F.concat(left, r, right)
    return {
        "ref": F.when(fwd, r).otherwise(dna.complement(r)), "alt": F.when(fwd, a).otherwise(dna.complement(a)),
        "snpmer": F.when(fwd, mer).otherwise(dna.reverse_complement(mer)),
    }


def genotype(ref_count: Column, alt_count: Column) -> Column:
    """0 for the reference allele only, 1 for the other only, else null."""
    return F.when((ref_count > 0) & (alt_count == 0), 0).when((ref_count == 0) & (alt_count > 0), 1)


def genotypes(site: DataFrame, n_genomes: int) -> DataFrame:
    """One row per site and genome, absent genomes with zero counts: flanks, genome_idx, kc_ref, kc_alt, gt."""
    rows = site.select("flanks", "ref_is_lo", "counts", F.explode(F.sequence(F.lit(0), F.lit(n_genomes - 1))).alias("genome_idx"))
    rows = rows.withColumn("own", F.try_element_at("counts", F.col("genome_idx")))
    lo, hi = F.coalesce("own.n_lo", F.lit(0)).cast("long"), F.coalesce("own.n_hi", F.lit(0)).cast("long")
    rows = rows.select("flanks", "genome_idx", F.when(F.col("ref_is_lo"), lo).otherwise(hi).alias("kc_ref"), F.when(F.col("ref_is_lo"), hi).otherwise(lo).alias("kc_alt"))
    return rows.withColumn("gt", genotype(F.col("kc_ref"), F.col("kc_alt")))


def cells(n_genomes: int) -> Column:
    """All genomes' (gt, kc_ref, kc_alt) of a site in input order, in the row: no shuffle and no pivot."""

    def cell(i: Column) -> Column:
        own = F.try_element_at("counts", i)
        lo, hi = F.coalesce(own.n_lo, F.lit(0)).cast("long"), F.coalesce(own.n_hi, F.lit(0)).cast("long")
        r, a = F.when(F.col("ref_is_lo"), lo).otherwise(hi), F.when(F.col("ref_is_lo"), hi).otherwise(lo)
        return F.struct(genotype(r, a).alias("gt"), r.alias("kc_ref"), a.alias("kc_alt"))

    return F.transform(F.sequence(F.lit(0), F.lit(n_genomes - 1)), cell)


def statistics(cell: Column) -> dict[str, Column]:
    """AC, AN and AF over called genotypes."""
    called = F.filter(cell, lambda c: c.gt.isNotNull())
    an = F.size(called).cast("long")
    ac = F.size(F.filter(called, lambda c: c.gt == 1)).cast("long")
    return {"ac": ac, "an": an, "af": F.when(an > 0, ac / an).otherwise(F.lit(0.0))}


def positions(found: DataFrame, site: DataFrame, ref_idx: int, contigs: DataFrame, by_name: bool = False) -> DataFrame:
    """(flanks, genome_idx, contig_idx, pos, contig, strand) of all hits but the reference's anchor; the strand is
    relative to the anchor's. Long form: positions of repeats are gathered at the sink only. site is broadcast if it is marked so.

    by_name: left out are instead the first hits of all genomes on contigs called like one that holds an anchor.
    """
    rows = found.select("flanks", "genome_idx", "contig_idx", "pos", F.col("fwd").alias("own"))
    rows = rows.hint("merge").join(site.select("flanks", "fwd", "anchor"), "flanks")
    names = contigs.select("genome_idx", "contig_idx", "contig").distinct()
    strand = F.when(F.col("own") == F.col("fwd"), "+").otherwise("-").alias("strand")
    if by_name:
        anchored = names.filter(F.col("genome_idx") == ref_idx).join(site.select(F.col("anchor.contig_idx").alias("contig_idx")).distinct(), "contig_idx", "left_semi")
        anchored = anchored.select("contig", F.lit(True).alias("known")).distinct()
        first = found.groupBy("flanks", "genome_idx").agg(F.min(F.struct("contig_idx", "pos")).alias("first"))
        rows = rows.join(names.join(anchored, "contig", "left"), ["genome_idx", "contig_idx"]).join(first, ["flanks", "genome_idx"])
        leads = (F.col("contig_idx") == F.col("first.contig_idx")) & (F.col("pos") == F.col("first.pos"))
        return rows.filter(~(leads & F.col("known").isNotNull())).select("flanks", "genome_idx", "contig_idx", "pos", "contig", strand)
    is_anchor = (F.col("genome_idx") == ref_idx) & (F.col("contig_idx") == F.col("anchor.contig_idx")) & (F.col("pos") == F.col("anchor.pos"))
    rows = rows.filter(~F.coalesce(is_anchor, F.lit(False)))
    return rows.join(names, ["genome_idx", "contig_idx"]).select("flanks", "genome_idx", "contig_idx", "pos", "contig", strand)


def call(occ: DataFrame, contigs: DataFrame, snp: DataFrame, n_genomes: int, ref_idx: int, options: CallOptions) -> DataFrame:
    """Site rows with chrom, 1-based pos (null and 0 without anchor), cells and statistics."""
    found = hits(occ, snp)
    site = sites(allele_counts(found, options.saturate), ref_idx, options.k)
    names = contigs.filter(F.col("genome_idx") == ref_idx).select(F.col("contig_idx").alias("c"), F.col("contig").alias("chrom")).distinct()
    site = site.withColumn("cells", cells(n_genomes))
    site = site.withColumns(statistics(F.col("cells"))).join(names, F.col("anchor.contig_idx") == F.col("c"), "left").drop("c")
    return site.withColumn("pos", F.coalesce(F.col("anchor.pos") + 1, F.lit(0)))
