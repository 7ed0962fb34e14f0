import gzip
import math
import warnings

import pytest
from pyspark.sql import functions as F

from midbase.functions import dna
from midbase.operators import alignment, kmers, population, regions, search
from midbase.plans import workflows
from midbase.sources import alignments, sequences, tables, vcf


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_text_forms(spark):
    assert column(spark, [1 / 3, 0.0, 1.0, 5e-05, 0.15625, 2 / 3, 0.12375], dna.short_float, "double") == ["0.3333", "0", "1", "5e-05", "0.1562", "0.6667", "0.1237"]
    assert column(spark, ["x/H37Rv.fa.gz", "a.b.fasta", "noext", "d.e/f", ".gz"], dna.sample_name) == ["H37Rv", "a.b", "noext", "f", ""]
    assert column(spark, [0b0001101100, 0], lambda c: dna.unpack(c, 5), "long") == ["ACGTA", "AAAAA"]
    assert column(spark, ["AACGN"], dna.reverse_complement) == ["NCGTT"]


def test_sequences_of_text(spark):
    """As lower, translate and a regular expression give them, for letters of any alphabet too; made once where k-mers are encoded."""
    texts = ["Hello, World_9!", "", None, "\u212a\u0130\u00df\u1e9e \U0001f600x\ud55c\u0301", "az\x00\x7fAZ[`{@", "\u03a3\u03c2"]
    for keep in (True, False):
        plain = lambda c: F.regexp_replace(F.translate(F.lower(c), dna.LETTERS, ("ACGT" * 7)[:26]), "[^ACGT]", "N" if keep else "")  # noqa: B023, E731
        assert column(spark, texts, lambda c: dna.from_text(c, keep)) == column(spark, texts, plain)  # noqa: B023
    rows = spark.createDataFrame([(0, 0, "some text and more"), (0, 1, None), (1, 0, "ab")], "genome_idx int, contig_idx long, text string")
    found = kmers.occurrences(rows.select("genome_idx", "contig_idx", dna.from_text(F.col("text")).alias("seq")), 5)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and found.count() > 5


def test_fasta_and_fastq(spark, tmp_path):
    lines = ["junk\n", ">a b c\n", "AC\n", "\n", "GT\r\n", "@q x\n", "ACG\n", "+\n", ">>>\n", ">z\n", "T\n", "@cut\n", "ACGT\n", "+\n", "II\n"]
    assert list(sequences.records(iter(lines))) == [("a", "ACGT"), ("q", "ACG"), ("z", "T")]
    with gzip.open(tmp_path / "g.fa.gz", "wt") as f:
        f.write(">one\nAC\nGT\n>two x\nT")
    (tmp_path / "p.fa").write_text("junk\n>three a > b\r\nA C\r\n\r\nG\n>\n>four\n")
    (tmp_path / "q.fq").write_text("@r1 x\nAC\n+\n>@\n@r2\nG\n+r2\nI\n")
    (tmp_path / "none.fa").write_text("")
    rows = sequences.read_genomes(spark, [f"{tmp_path}/{n}" for n in ("g.fa.gz", "p.fa", "q.fq", "none.fa")]).collect()
    order = {}
    for r in sorted(rows, key=lambda r: (r.genome_idx, r.contig_idx)):
        order.setdefault(r.genome_idx, []).append((r.contig, r.seq))
    assert order == {0: [("one", "ACGT"), ("two", "T")], 1: [("three", "ACG"), ("", ""), ("four", "")], 2: [("r1", "AC"), ("r2", "G")]}


def test_fasta_in_many_splits(spark, tmp_path):
    want = [(f"c{i}", "ACGT" * (i % 7)) for i in range(300)]
    (tmp_path / "m.fa").write_text("".join(f">{n} d\n{s}\n" for n, s in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        df = sequences.read_fasta(spark, f"{tmp_path}/m.fa")
        assert df.rdd.getNumPartitions() > 3
        assert [(r.contig, r.seq) for r in sorted(df.collect(), key=lambda r: r.contig_idx)] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_in_many_splits(spark, tmp_path):
    """Read apart, a FASTQ file gives what `records` gives in one pass, whatever its qualities hold and wherever splits fall."""
    import random

    rng = random.Random(6)
    for trial in range(6):
        text = rng.choice(["", "junk\n+\n\n"])
        for i in range(rng.randrange(40, 90)):
            size = rng.choice([0, 1, 5, 70, 400])
            seq, quality = ("".join(rng.choice(x) for _ in range(size)) for x in ("ACGTn", "@>+I! "))
            cut = lambda s: "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + "\n"
            wide = rng.random() < 0.5
            quality = quality.replace(" ", "I") if size else ""
            text += rng.choice([f"@r{i} x\n{cut(seq) if wide else seq + chr(10)}+\n{cut(quality) if wide else quality + chr(10)}", f">f{i}\n{cut(seq)}\n"])
        text += ["", "@cut\nACGT\n+\nII", "@bad\nAC\n+\nIIII\n@after\nA\n+\nI\n", "@end\n", ">last\nAC\nGT", "\n\n"][trial]
        (tmp_path / f"{trial}.fq").write_text(text)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = list(sequences.records(iter(text.splitlines(keepends=True))))
        for split in (97, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                df = sequences.read_fastq(spark, f"{tmp_path}/{trial}.fq", 3)
                assert df.rdd.getNumPartitions() > 3
                got = sorted(map(tuple, df.collect()))
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert got == [(3, i, *x) for i, x in enumerate(want)]


def regions_frame(spark, rows):
    return spark.createDataFrame(rows, "genome_idx int, contig string, start long, end long")


def test_merge_and_pieces(spark):
    beds = regions_frame(spark, [(0, "c", 31, 400), (0, "c", 10, 20), (0, "c", 20, 30), (0, "c", 12, 15), (0, "c", -5, 3), (1, "c", 0, 500)])
    merged = regions.merge(beds, ["genome_idx", "contig"])
    assert sorted(tuple(r)[2:] for r in merged.filter("genome_idx = 0").collect()) == [(-5, 3), (10, 30), (31, 400)]
    s = "ACGT" * 9
    contigs = spark.createDataFrame([(0, 0, "c", s), (1, 0, "c", "ACGT"), (1, 1, "d", "ACGT")], "genome_idx int, contig_idx long, contig string, seq string")
    got = sorted((r.genome_idx, r.contig, r.start, r.seq) for r in regions.pieces(contigs, beds, 4).collect())
    assert got == [(0, "c", 10, s[10:30]), (0, "c", 31, s[31:]), (1, "c", 0, "ACGT")]
    whole = {(r.genome_idx, r.pos) for r in kmers.occurrences(contigs, 5).collect()}
    cut = kmers.tiles(regions.pieces(contigs, beds, 5), 5, 7)
    assert sorted((r.genome_idx, r.pos) for r in kmers.occurrences(cut, 5).collect()) == sorted(x for x in whole if x[0] == 0 and (12 <= x[1] < 28 or 33 <= x[1] < 34))


def test_regions_are_cut_before_encoding(spark):
    contigs = spark.createDataFrame([(0, 0, "c", "ACGT" * 9)], "genome_idx int, contig_idx long, contig string, seq string")
    plan = kmers.occurrences(regions.pieces(contigs, regions_frame(spark, [(0, "c", 0, 9)]), 5), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and plan.count("Join") == 1


def test_many_files_are_one_scan(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"g{i}.fa").write_text(f"{'junk' * (i % 2)}\n>a{i} x\nAC\n>b\nG\n")
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir/z.fa").write_text(">only\nACGT")
    df = sequences.read_genomes(spark, [f"{tmp_path}/g{i}.fa" for i in range(20)] + [f"{tmp_path}/sub dir/z.fa"])
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan text") == 1
    want = [(i, n, s) for i in range(20) for n, s in ((f"a{i}", "AC"), ("b", "G"))] + [(20, "only", "ACGT")]
    assert [(r.genome_idx, r.contig, r.seq) for r in df.orderBy("genome_idx", "contig_idx").collect()] == want


def test_interval_borders(spark):
    spans = spark.createDataFrame([("x", 10, 20), ("x", 40_000, 90_000), ("y", 5, 5)], "chrom string, start long, end long")
    rows = [("x", 10, "A"), ("x", 10, "AA"), ("x", 11, "A"), ("x", 20, "A"), ("x", 21, "A"), ("x", 39_999, "AAA"), ("x", 60_000, "A"), ("x", 90_000, "A"), ("x", 90_001, "A"), ("y", 6, "A"), ("z", 11, "A")]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string")
    inside = {(r.chrom, r.pos, r.ref) for r in regions.intersecting(df, spans).collect()}
    assert inside == {("x", 10, "AA"), ("x", 11, "A"), ("x", 20, "A"), ("x", 39_999, "AAA"), ("x", 60_000, "A"), ("x", 90_000, "A")}
    assert {(r.chrom, r.pos, r.ref) for r in regions.outside(df, spans).collect()} == set(rows) - inside


def test_intervals_of_long_variants(spark):
    """Reference bases of any length: a region far behind the variant's start is met too, and each row stays one row."""
    bin_ = regions.BIN
    spans = spark.createDataFrame([("x", 35_000, 35_100), ("x", 36_000, 90_000), ("x", 200_000, 200_001), ("y", 0, 2)], "chrom string, start long, end long")
    rows = [("x", p, n) for p in (1, 1, 100, 20_000, 90_000, 90_001, 150_001) for n in (1, bin_, bin_ + 1, 34_999, 35_000, 40_000, 50_000, 50_001)]
    rows += [("y", 1, 40_000), ("y", 3, 40_000), ("z", 1, 40_000), (None, 1, 40_000), ("x", None, 40_000), ("x", 1, None)]
    df = spark.createDataFrame([(c, p, n and "A" * n) for c, p, n in rows], "chrom string, pos long, ref string")
    bounds = [tuple(r) for r in spans.collect()]
    want = [c is not None and p is not None and n is not None and any(c == k and p - 1 < e and p - 1 + n > s for k, s, e in bounds) for c, p, n in rows]
    got = lambda d: sorted(((r.chrom, r.pos, r.ref and len(r.ref)) for r in d.collect()), key=str)
    assert got(regions.intersecting(df, spans)) == sorted((r for r, w in zip(rows, want) if w), key=str)
    assert got(regions.outside(df, spans)) == sorted((r for r, w in zip(rows, want) if not w), key=str)


def test_annotation_split(spark):
    notes = spark.createDataFrame([("chr1", 0, 10, "hor_1"), ("chr1", 20, 30, "ct_2"), ("chr1", 40, 50, "other"), ("chrX", 0, 99, "hor_2")], "chrom string, start long, end long, name string")
    calls = spark.createDataFrame([("CHM13#0#chr1", p, "A") for p in (5, 25, 45, 60)] + [(".", 0, "A"), ("chrX", 5, "A")], "chrom string, pos long, ref string")
    split = workflows.split_by_annotation(calls, notes)
    places = [sorted((r.chrom, r.pos) for r in df.collect()) for df in (split.centromeric, split.pericentromeric, split.outside)]
    assert places == [[("chr1", 5)], [("chr1", 25)], [("chr1", 60), ("chrX", 5)]]


def genotypes(spark, rows):
    return spark.createDataFrame(rows, "snp_no int, sample string, gt string, ref string, alt string")


def test_alignment(spark):
    rows = [(1, s, g, "A", "C,G") for s, g in zip("abcd", ["0", "1", "2", "."])] + [(2, s, g, "A", "CC") for s, g in zip("abcd", "0101")]
    rows += [(3, s, g, "T", "-") for s, g in zip("abcd", ["0/1", "1/1", "./.", "0|0"])] + [(4, s, g, "A", "C") for s, g in zip("abcd", ["7", "0", "0", "0"])]
    rows += [(5, s, g, "A", "C") for s, g in zip("abcd", ["1", ".", ".", "."])]
    df = genotypes(spark, rows)
    df, samples = alignment.by_locus(df)
    found = {r.sample: r.seq for r in workflows.alignment_of(df, samples, min_samples=3).collect()}
    assert found == {"a": "At", "b": "C-", "c": "GN", "d": "NT"}
    assert {r.seq for r in workflows.alignment_of(df, samples, min_samples=3, variable_only=True).collect()} == {"A", "C", "G", "N"}
    resolved = alignment.bases(df.filter("snp_no = 3"), resolve=True).first().bases
    assert resolved[0] in "T-" and resolved[1:] == ["-", "N", "T"]
    assert alignment.binary(df.filter("snp_no = 3")).first().bases == ["1", "2", "?", "0"]


@pytest.mark.parametrize("alleles,code", [("A", "A"), ("AC", "M"), ("ACGT", "N"), ("*A", "a"), ("ANT", "w"), ("*CN", None), ("*", "-"), ("N", "N"), ("*N", "n"), ("*ACGNT", "N"), ("ACGNT", None), ("AX", None)])
def test_ambiguity_codes(spark, alleles, code):
    if alleles == "*CN":
        code = "c"
    assert column(spark, [list(alleles)], alignment.iupac, "array<string>") == [code]


def test_codes_are_made_once_a_combination(spark):
    """Genotypes of any kind, with the code of each set of alleles as `iupac` has it; no expression is evaluated for every cell again."""
    import itertools

    sets = [list(x) for n in range(1, 5) for x in itertools.combinations(["*", "A", "C", "CC", "G", "N", "T"], n)]
    assert column(spark, sets, alignment.iupac, "array<string>") == [alignment.letter(set(x)) for x in sets]
    rows = [(1, "A", "C,-", ["0/1", "1|2", "0/7", "./1", None, "0/."]), (2, "A", "C", ["0/"]), (3, "A", "C", ["7"]), (4, "A", None, ["./."]), (5, "A", "C", []), (6, "A", "C", None)]
    df = spark.createDataFrame(rows, "snp_no int, ref string, alt string, gts array<string>")
    found = alignment.bases(df)
    assert {r.snp_no: r.bases for r in found.collect()} == {1: ["M", "c", "A", "N", "N", "a"], 2: ["A"], 4: ["N"], 5: []}
    assert {r.snp_no: len(r.bases) for r in alignment.bases(df, resolve=True).filter("snp_no > 2").collect()} == {4: 1, 5: 0}
    plan = alignment.bases(df, resolve=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "array_sort" not in plan


def test_alignment_files(spark):
    seqs = spark.createDataFrame([("b", "AC"), ("long", "GT"), ("a", "NN")], "sample string, seq string")
    text = lambda *a, **k: [r.line for r in alignments.render(seqs, *a, **k).orderBy("n", "sample").collect()]
    assert text("phylip", "long,x") == ["3 2", "long   GT", "a      NN", "b      AC"]
    assert text("fasta") == [">a\nNN", ">b\nAC", ">long\nGT"]
    assert text("nexus", binary=True)[0].endswith("NTAX=3 NCHAR=2;\n\tFORMAT DATATYPE=SNP MISSING=? GAP=- ;\nMATRIX") and text("nexus")[-1] == ";\nEND;"


def test_distances_and_clusters(spark):
    counts = {"v1": {"a": (3, 0), "b": (0, 2), "c": (0, 2)}, "v2": {"a": (1, 1), "b": (1, 1), "c": (0, 0)}}
    kc = spark.createDataFrame([(v, s, *x) for v, own in counts.items() for s, x in own.items()], "variant string, sample string, a1 long, a2 long")
    for inner in ("manhattan", "euclidean"):
        got = {(r.s1, r.s2): r.distance for r in population.mixed_distance(kc, inner, 1.0, 0.5).collect()}
        for (p, q), d in got.items():
            want = 0
            for own in counts.values():
                (a, b), (c, e) = own[p], own[q]
                dc, dd = abs(a / (a + b + 1e-10) - c / (c + e + 1e-10)), 0.5 * abs(math.log1p(a + b) - math.log1p(c + e))
                want += dc + dd if inner == "manhattan" else math.hypot(dc, dd)
            assert d == pytest.approx(want)
        assert len(got) == 3
    with pytest.raises(ValueError):
        population.mixed_distance(kc, "other")
    near = {(r.s1, r.s2): r.distance for r in population.jaccard_distance(kc.withColumn("count", F.col("a2"))).collect()}
    assert near == {("a", "b"): 0.5, ("a", "c"): 1.0, ("b", "c"): 0.5}
    flat = spark.createDataFrame([("a", "b", 0.05), ("a", "c", 0.5), ("b", "c", 0.08)], "s1 string, s2 string, distance double")
    assert population.clusters_at(flat, 0.1) == {"a": 1, "b": 1, "c": 2}
    line = spark.createDataFrame([(i, j, float(abs(x - y))) for i, x in enumerate([0, 1, 5, 6, 20]) for j, y in enumerate([0, 1, 5, 6, 20]) if i < j], "s1 int, s2 int, distance double")
    assert population.ward_clusters(line, range(2, 9)) == {2: {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}, 3: {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}, 4: {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}, 5: {i: i + 1 for i in range(5)}}
    assert population.clusters_at(line, 6.0) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}
    for bad in (flat.limit(2), flat.union(flat.limit(1)), flat.withColumn("distance", -F.col("distance")), flat.withColumn("distance", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            population.clusters_at(bad, 0.1)
    same = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "a string, b string")
    assert population.mutual_information(same, "a", "b").first()[0] == pytest.approx(1)
    assert population.mutual_information(same.filter("a = '1'"), "a", "b").first()[0] == 1


def test_sample_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("HG1_pat\t.\tHG1\tM\tAFR\tX\tY\n")
    meta = tables.read_samples(spark, f"{tmp_path}/s.tsv")
    assert meta.first().hap_chrom is None
    assert column(spark, ["HG1_pat", "HG1_hap2", "A_pri", "B", "x_mat.v2_y", "x_"], population.normalised_sample) == ["1", "2", "0", "B", "2.v2", ""]
    depths = spark.createDataFrame([("1", "chr1", 2.0)], "sample string, chrom string, depth double")
    clusters = spark.createDataFrame([("1", "chr1_tree", 4)], "sample string, kind string, cluster int")
    row = workflows.sample_table(meta, depths, clusters).first()
    assert (row.sample_id, row.chr1, row.chr1_tree) == ("1", 2.0, 4)
    names = spark.createDataFrame([("chrX",), ("chr10",), ("chr2",), ("2b",)], "c string")
    assert [r.c for r in names.orderBy(*population.chromosome_order(F.col("c"))).collect()] == ["chr2", "chr10", "2b", "chrX"]


def test_repeated_samples(spark):
    """Ids that become the same share the largest of their values, in whatever order these come."""
    meta = spark.createDataFrame([("HG_4pri_x", "a"), ("40", "b")], "sample_id string, individual string")
    values = [("40", "chr0", float(x)) for x in (7, 40, 4)]
    for own in (values, values[::-1]):
        depths = spark.createDataFrame(own, "sample string, chrom string, depth double").coalesce(1)
        clusters = depths.selectExpr("sample", "'chr0_tree' as kind", "cast(depth as int) as cluster")
        rows = workflows.sample_table(meta, depths, clusters).collect()
        assert sorted((r.sample_id, r.individual, r.chr0, r.chr0_tree) for r in rows) == [("40", "a", 40.0, 40), ("40", "b", 40.0, 40)]


def test_vcf_round_trip_and_workflows(spark, tmp_path):
    body = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tr", "c\t3\t.\tC\tT\t.\t.\tAC=1;SNPMER=AACGG;KPOS=q\tGT:KC\t0:1,0\t1:0,2\t0:1,0", ".\t0\t.\tA\tG\t.\t.\tAC=1\tKC:GT\t3,4:.\t0,0:.\t1,0:0"]
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write("\n".join(body))
    rows, samples = vcf.read(spark, f"{tmp_path}/v.vcf.gz")
    assert samples == ["a", "b", "r"]
    long = vcf.counts(rows, samples)
    assert {(r.chrom, r.sample): (r.gt, r.a1, r.a2) for r in long.collect()}[".", "a"] == (".", 3, 4)
    assert [tuple(r) for r in vcf.snpmer_rows(rows).collect()] == [("AACGG", "C", "T")]
    assert [r.mer for r in sequences.snpmer_records(vcf.snpmer_rows(rows)).collect()] == ["AACGG", "AATGG"]
    assert vcf.cleaned(rows).count() == 1
    place = vcf.sorted_by_place(spark.createDataFrame([("a", 2), ("z", 1), ("b", 9), ("b", 3)], "chrom string, pos int"), ["b", "a"])
    assert [tuple(r) for r in place.collect()] == [("b", 3), ("b", 9), ("a", 2), ("z", 1)]
    found = workflows.write_alignment(spark, f"{tmp_path}/v.vcf.gz", f"{tmp_path}/out", ("phylip", "nexus-binary"), min_samples=-100)
    assert {r.sample: len(r.seq) for r in found.collect()} == {"a": 2, "b": 2, "r": 2}
    assert (tmp_path / "out.min-100.phy").exists() and (tmp_path / "out.min-100.bin.nexus").exists()
    lineages = spark.createDataFrame([("a", "L1"), ("b", "L2")], "SampleID string, PrimaryLineage string")
    counts = long.select("variant", "sample", F.col("a2").alias("count"))
    assert workflows.cluster_agreement(counts, lineages, "r").first()[0] == pytest.approx(1)


def test_exact_hits(spark):
    contigs = spark.createDataFrame([(0, 0, "c", "AACGGTTCCGTTA")], "genome_idx int, contig_idx long, contig string, seq string")
    mers = spark.createDataFrame([("AACGG",), ("CCGTT",), ("AAAAC",)], "mer string")
    got = sorted(tuple(r) for r in search.exact_hits(mers, kmers.occurrences(contigs, 5), 5).collect())
    assert got == [("AACGG", 0, 0, 2, "+"), ("AACGG", 0, 0, 9, "-"), ("CCGTT", 0, 0, 2, "-"), ("CCGTT", 0, 0, 9, "+")]
    assert search.exact_hits(mers, kmers.occurrences(contigs, 5), 5, most=1).count() == 2


def test_exact_hits_never_broadcast_kmers(spark):
    contigs = spark.createDataFrame([(0, 0, "c", "AACGGTTCCGTTA")], "genome_idx int, contig_idx long, contig string, seq string")
    many = spark.range(10**6).selectExpr("if(id = 5, 'AACGG', concat('AA', id)) as mer").filter("length(mer) = 5")
    found = search.exact_hits(many, kmers.occurrences(contigs, 5), 5)
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("AACGG", 0, 0, 2, "+"), ("AACGG", 0, 0, 9, "-")]


def test_contigs_as_a_stream(spark, tmp_path):
    from midbase.streaming import contigs as stream

    rows = spark.createDataFrame([(0, 0, "c", "AACGGTTCCA"), (1, 0, "d", "AATGGTTCCA")], "genome_idx int, contig_idx long, contig string, seq string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.append(stream.read_contigs(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", 5).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, kmers.occurrences(rows, 5).collect()))
