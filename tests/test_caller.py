import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from midbase import CallOptions
from midbase.operators import calls, discover, kmers, staging
from midbase.plans.count import call_contigs, count


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def windows(seq, k):
    """(start, flanks, centre, forward) by the definition."""
    h = k // 2
    for i in range(len(seq) - k + 1):
        f = seq[i : i + k].upper().replace("U", "T")
        if set(f) <= set("ACGT") and f[:h] != rc(f[h + 1 :]):
            y = min(f, rc(f))
            yield i, y[:h] + y[h + 1 :], y[h], f < rc(f)


def number(s):
    return sum("ACGT".index(c) << (2 * i) for i, c in enumerate(reversed(s)))


@pytest.mark.parametrize("k", [3, 5, 7, 11, 21, 31])
def test_encoder(k):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGTacgtUuN") if rng.random() < 0.3 else rng.choice("ACGT") for _ in range(600))
    want = [(i, number(f), "ACGT".index(c), s) for i, f, c, s in windows(seq, k)]
    assert list(zip(*(x.tolist() for x in kmers.encode(seq.encode(), k)))) == want and len(want) > 0
    assert [len(x) for x in kmers.encode(b"ACG"[: k - 1], k)] == [0, 0, 0, 0]


def contigs(spark, genomes):
    rows = [(g, i, f"g{g}c{i}", s) for g, seqs in enumerate(genomes) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "genome_idx int, contig_idx long, contig string, seq string")


def random_genomes(rng, n, length=60):
    base = "".join(rng.choice("ACGT") for _ in range(length))
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(4):
            s[rng.randrange(length)] = rng.choice("ACGTN")
        own = "".join(s)
        out.append([own[:35], own[25:] if rng.random() < 0.5 else rc(own[25:])])
    return out


def test_native_and_tiled_occurrences_agree(spark):
    rng = random.Random(1)
    df = contigs(spark, random_genomes(rng, 3))
    k = 7
    key = lambda r: (r.genome_idx, r.contig_idx, r.pos, r.fwd)
    plain = {key(r): (r.flanks, r.center) for r in kmers.occurrences(df, k).collect()}
    native = {key(r): (number(r.flanks), "ACGT".index(r.center)) for r in kmers.occurrences_native(df, k).collect()}
    tiled = [(key(r), (r.flanks, r.center)) for r in kmers.occurrences(kmers.tiles(df, k, 11), k).collect()]
    assert plain == native == dict(tiled) and len(tiled) == len(plain)


def state_machine(genomes, k, m, f):
    """Presence and filters genome by genome, in input order."""
    n, centres, present, dropped = len(genomes), defaultdict(list), Counter(), set()
    for seqs in genomes:
        own = defaultdict(Counter)
        for s in seqs:
            for _, flanks, c, _ in windows(s, k):
                own[flanks][c] += 1
                if c not in centres[flanks]:
                    centres[flanks].append(c)
        for flanks, cs in own.items():
            present[flanks] += 1
            if f == 1 and len(cs) > 1 or f == 2 and sum(cs.values()) > 1:
                dropped.add(flanks)
    return {x for x in present if len(centres[x]) == 2 and x not in dropped and not (n - present[x]) / n > 1 - m + 1e-9}


def test_discovery_against_the_state_machine(spark):
    rng = random.Random(2)
    for trial in range(3):
        genomes = random_genomes(rng, rng.randrange(2, 7))
        df = contigs(spark, genomes)
        for f in (0, 1, 2):
            for m in (0.0, 0.6, 1.0):
                options = CallOptions(k=5, min_freq=m, filt_type=f)
                occ = kmers.occurrences(df, 5, places=False)
                got = {r.flanks for r in discover.snpmers(occ, len(genomes), options).collect()}
                assert got == {number(x) for x in state_machine(genomes, 5, m, f)}
        both = [sorted(map(str, rows(occ).collect())) for rows in (discover._genome_masks, discover._genome_rows)]
        assert both[0] == both[1]


def test_reverse_complement_of_inputs_changes_no_site(spark):
    rng = random.Random(3)
    genomes = random_genomes(rng, 4)
    turned = [genomes[0], *[[rc(s.replace("N", "Z")).replace("Z", "N") for s in seqs] for seqs in genomes[1:]]]
    own = CallOptions(k=7, min_freq=0.0, filt_type=0)
    a, b = ({(r.snpmer, r.ref, r.alt, r.ac, r.an) for r in call_contigs(contigs(spark, g), 4, 0, own).sites.collect()} for g in (genomes, turned))
    assert a == b and a


GOLDEN = [
    (["AACGG", "AATGG"], 1.0, 2, "c0 3 C T AC=1;AN=2;AF=0.5;SNPMER=AACGG;KPOS=c1|+|3 0:1,0 1:0,1"),
    (["CCGTT", "AATGG"], 1.0, 2, "c0 3 G A AC=1;AN=2;AF=0.5;SNPMER=CCGTT;KPOS=c1|-|3 0:1,0 1:0,1"),
    (["AACGG", "CCATT"], 1.0, 2, "c0 3 C T AC=1;AN=2;AF=0.5;SNPMER=AACGG;KPOS=c1|-|3 0:1,0 1:0,1"),
    (["TTTTT", "AACGG", "AATGG"], 0.6, 2, ". 0 A G AC=1;AN=2;AF=0.5;SNPMER=CCATT;KPOS=c1|-|3,c2|-|3 .:0,0 1:0,1 0:1,0"),
    (["TTTTT", "AACGG", "AATGG"], 0.95, 2, None),
    (["AACGG", "AATGG", "AAGGG"], 1.0, 0, None),
    (["AAATT", "AACTT"], 1.0, 0, None),
    (["AACGGNAATGG", "AACGG", "AATGG"], 1.0, 0, "c0 3 T C AC=1;AN=2;AF=0.5;SNPMER=AATGG;KPOS=c0|+|9,c1|+|3,c2|+|3 .:1,1 1:0,1 0:1,0"),
    (["AACGGNAATGG", "AACGG", "AATGG"], 1.0, 1, None),
    (["AACGGNAACGG", "AACGG", "AATGG"], 1.0, 1, "c0 3 C T AC=1;AN=3;AF=0.3333;SNPMER=AACGG;KPOS=c0|+|9,c1|+|3,c2|+|3 0:2,0 0:1,0 1:0,1"),
    (["AACGGNAACGG", "AACGG", "AATGG"], 1.0, 2, None),
    (["aacgg", "AANGG", "AATGG"], 0.6, 2, "c0 3 C T AC=1;AN=2;AF=0.5;SNPMER=AACGG;KPOS=c2|+|3 0:1,0 .:0,0 1:0,1"),
]


@pytest.mark.parametrize("genomes,m,f,want", GOLDEN)
def test_golden_cases(spark, genomes, m, f, want):
    df = spark.createDataFrame([(i, 0, f"c{i}", s) for i, s in enumerate(genomes)], "genome_idx int, contig_idx long, contig string, seq string")
    lines = call_contigs(df, len(genomes), 0, CallOptions(k=5, min_freq=m, filt_type=f, positions=True)).lines().collect()
    fields = [r.line.split("\t") for r in lines]
    assert [" ".join([*x[:2], *x[3:5], x[7], *x[9:]]) for x in fields] == ([want] if want else [])


def test_files_in_vcf_out(spark, tmp_path):
    for name, text in {"r.fa": ">c0 first\nAAC\nGG\n", "x.fasta": ">c1\r\nAATGG\r\n\r\n>c2\nA\n"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "beds").write_text(f"{tmp_path}/a.bed\n\n{tmp_path}/b.bed\n")
    (tmp_path / "a.bed").write_text("#x\ntrack y\nc0\t0\t3\nc0 3 9\nc0\t7\t7\n")
    (tmp_path / "b.bed").write_text("c1\t0\t5\tname\n")
    paths = [f"{tmp_path}/r.fa", f"{tmp_path}/x.fasta"]
    result = count(spark, paths, bed_list=f"{tmp_path}/beds", output=f"{tmp_path}/vcf", k=5, min_freq=1.0)
    text = "".join(p.read_text() for p in sorted((tmp_path / "vcf").glob("part*")))
    assert text.splitlines()[-2:] == ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tr\tx", "c0\t3\t.\tC\tT\t.\t.\tAC=1;AN=2;AF=0.5;SNPMER=AACGG\tGT:KC\t0:1,0\t1:0,1"]
    result.register("t_")
    assert spark.sql("select count(*) from t_sites join t_snpmers using (flanks)").first()[0] == 1
    (tmp_path / "b.bed").write_text("c1\t0\t4\n")
    assert count(spark, paths, bed_list=f"{tmp_path}/beds", k=5, min_freq=1.0).sites.count() == 0


def test_refusals(spark, tmp_path):
    for bad in ({"k": 4}, {"k": 33}, {"k": 1}, {"filt_type": 3}):
        with pytest.raises(ValueError):
            CallOptions(**bad)
    for paths, ref in ((["a"], None), (["a", "a"], None), (["a", "b"], "c"), (["a", "-"], None)):
        with pytest.raises(ValueError):
            count(spark, paths, ref)
    (tmp_path / "beds").write_text("one\n")
    (tmp_path / "a.fa").write_text(">a\nA\n")
    (tmp_path / "b.fa").write_text(">a\nA\n")
    with pytest.raises(ValueError, match="BED"):
        count(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"], bed_list=f"{tmp_path}/beds")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kmers_are_never_broadcast(spark):
    """Occurrences look small to the optimiser, as the text that they come from is; what stands beside them may look larger."""
    df = contigs(spark, random_genomes(random.Random(4), 4))
    occ = kmers.occurrences(df, 7)
    many = spark.range(10**7).selectExpr("id as flanks", "0 as c_lo", "1 as c_hi")
    assert "BroadcastExchange" not in plan_of(calls.hits(occ, many))
    few = staging.hold(many.limit(10), "few")
    assert few.rows == 10 and "BuildRight" in plan_of(calls.hits(occ, few.table))
    found = call_contigs(df, 4, 0, CallOptions(k=7, min_freq=0.0, filt_type=0, positions=True))
    assert found.held.rows == found.snpmers.count() > 0
    for own in (found.sites, found.positions, calls.allele_counts(calls.hits(found.occurrences, found.snpmers)), found.lines()):
        assert "BuildLeft" not in plan_of(own)
    places = sorted(map(tuple, found.positions.collect()))
    merged = calls.positions(calls.hits(occ, spark.createDataFrame(found.snpmers.collect()).hint("merge")), found.sites.hint("merge"), 0, df)
    assert sorted(map(tuple, merged.collect())) == places and places and "BuildLeft" not in plan_of(merged)
    found.clear()


def test_names_of_anchored_contigs(spark):
    """By name, the first hit of every genome on a contig called like an anchor's is left out, as is the anchor."""
    df = contigs(spark, [["AACGG", "TTTTT"], ["AATGG", "AATGGNAATGG"], ["TTTTT", "AACGG"]])
    own = {n: call_contigs(df.withColumn("contig", F.expr(f"concat('v', contig_idx % {n})")), 3, 0, CallOptions(k=5, min_freq=0.5, filt_type=0, positions=True, kpos_by_name=True)) for n in (1, 2)}
    places = {n: sorted((r.genome_idx, r.contig_idx, r.pos) for r in x.positions.collect()) for n, x in own.items()}
    assert places == {1: [(1, 1, 2), (1, 1, 8)], 2: [(1, 1, 2), (1, 1, 8), (2, 1, 2)]}
