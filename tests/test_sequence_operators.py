"""Sequence, classification, coverage and alignment operators, and the text formats."""

import gzip
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.config import Overlap
from kinloom.functions import sequence as seqfn
from kinloom.operators import alignment, bands, classify, consensus, coverage, graph, overlap, projection, sketch
from kinloom.plans import pipelines
from kinloom.sources import readers, writers
from kinloom.streaming.reads import sketch_stream

RND = random.Random(9)
dna = lambda n: "".join(RND.choices("ACGT", k=n))
turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_splitmix():
    assert int(sketch.splitmix64(np.zeros(1, np.uint64))[0]) == 0xE220A8397B1DCDAF


def slow_minimizers(seq, k, w):
    code, mask = {c: i for i, c in enumerate("ACGT")}, (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    pack = lambda s: sum(code[c] << 2 * (k - 1 - i) for i, c in enumerate(s))
    out, window = set(), []
    for i in range(len(seq) - k + 1):
        kmer = seq[i : i + k].upper()
        if set(kmer) - set("ACGT"):
            window = []
            continue
        f, b = mix(pack(kmer)), mix(pack(turned(kmer)))
        window = [*window, (min(f, b), i, int(f > b))][-w:]
        if len(window) == w:
            out.add(min(window, key=lambda x: (x[0], x[1])))
    return out


@pytest.mark.parametrize("seq", ["", "ACGT" * 30, dna(300), dna(60) + "N" + dna(90).lower(), "A" * 100, dna(38), dna(39)])
def test_minimizers(seq):
    h, p, s = sketch.minimizers(seq.encode(), 21, 19)
    assert set(zip(h.tolist(), p.tolist(), s.tolist())) == slow_minimizers(seq, 21, 19)


def test_sketches_agree(spark):
    reads = spark.createDataFrame([(i, dna(200)) for i in range(3)] + [(3, "acgtn" * 40), (4, None), (5, "")], "read_id long, seq string")
    n = sketch.sketch(reads).count()
    packed = sketch.sketch_packed(reads).select(F.sum(F.size("hash"))).head()[0]
    assert n == packed > 0
    native = sketch.sketch_native(reads)
    assert {r.read_id for r in native.collect()} == {0, 1, 2}


def test_overlaps(spark):
    shared, flank = dna(7000), [dna(8000) for _ in range(2)]
    reads = [(0, flank[0] + shared), (1, shared + flank[1]), (2, dna(400) + shared[:2000]), (3, turned(shared[:2000]) + dna(400)), (4, "ACGTTGCA" * 600), (5, "ACGTTGCA" * 500)]
    df = spark.createDataFrame(reads, "read_id long, seq string")
    got = {(r.read_a, r.read_b): r for r in overlap.overlaps(df).collect()}
    assert abs(got[0, 1].offset_a - 8000) <= 200 and got[0, 1].offset_b == 0 and 6500 < got[0, 1].overlap_len <= 7000 and got[0, 1].strand == 0
    assert got[2, 3].strand == 1 and got[0, 3].strand == 1
    rows = overlap.cluster(overlap.matches(sketch.sketch(df))).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in got.values()}
    assert overlap.overlaps(df, Overlap(max_overlaps=1)).count() == 1
    assert (4, 5) not in {(r.read_a, r.read_b) for r in overlap.overlaps(df, Overlap(max_bucket=4)).collect()}


def test_functions(spark):
    c = F.lit
    assert one(spark, seqfn.reverse_complement(c("acgtXa")))[0] == "TNACGT" and one(spark, seqfn.reverse_complement(c("")))[0] == ""
    assert one(spark, *[seqfn.base_code(c(x)) for x in "AcgTN"])[:] == (0, 1, 2, 3, 4)
    assert one(spark, seqfn.mismatches(c("ACGT"), c("acga")), seqfn.mismatches(c("A"), c("AC")))[:] == (1, 2)
    assert one(spark, seqfn.hamming(F.array(c(1), c(2)), F.array(c(1), c(3))), seqfn.hamming(F.array(c(1)), F.array(c(1), c(3))))[:] == (1, 2147483647)
    assert one(spark, seqfn.gc_content(c("GCatN")), seqfn.gc_content(c("")))[:] == (0.5, 0.0)
    assert one(spark, seqfn.jaccard(seqfn.kmers(c("ACGTA"), 3), seqfn.kmers(c("CGTAC"), 3)), seqfn.jaccard(seqfn.kmers(c("A"), 3), seqfn.kmers(c(""), 3)))[:] == (0.5, 0.0)
    assert one(spark, seqfn.iqr(F.array(*map(c, (10, 40, 20, 30)))), seqfn.iqr(F.array(c(1), c(2))))[:] == (15.0, 0.0)
    w = one(spark, seqfn.wilson(c(80), c(100)), seqfn.wilson(c(0), c(0)))
    assert tuple(w[0]) == pytest.approx((0.80, 0.71, 0.87), abs=0.01) and tuple(w[1]) == (0.5, 0.0, 1.0)
    v = [-0.1, 0.0, 1e-6, 0.05, 0.0500001, 0.10, 0.10001, 0.50, 0.75, 1.0, 1.01, float("nan")]
    assert one(spark, *[seqfn.band(c(x)) for x in v])[:] == (None, None, 0, 0, 1, 1, 2, 3, 4, 4, None, None)


def feature_rows(spark, rows):
    return spark.createDataFrame([(i, *map(float, r), 0.0, 0.0) for i, r in enumerate(rows)], "bubble_id long, flank double, depth double, span double, length double, segdup double, repeat double")


def test_decisions(spark):
    df = feature_rows(spark, [(0.99, 1.0, 0.95, 2000), (0.40, 2.10, 0.30, 2000), (0.85, 1.60, 0.50, 2000), (0.99, 1.0, 0.95, 100), (0, 0, 0, 900)])
    got = [(r.label, r.confidence) for r in classify.disambiguate(df).orderBy("bubble_id").collect()]
    assert [x for x, _ in got] == ["Split", "Duplication", "Mixed", "NonSeparable", "NonSeparable"]
    assert got[0][1] >= 0.9 and got[1][1] >= 0.85 and 0.4 <= got[2][1] <= 0.85 and got[3][1] == got[4][1] == 0
    cascade = feature_rows(spark, [(0.99, 3, 0, 900), (0.5, 2.4, 0, 900), (0.5, 1, 0.6, 900), (0.75, 1.6, 0.1, 900), (0.1, 1, 0.1, 900), (0.1, 1, 0.1, 400)])
    rows = [(r.label, round(r.confidence, 3), r.stage) for r in classify.cascade(cascade).orderBy("bubble_id").collect()]
    assert rows == [("Split", 0.99, 0), ("Duplication", 0.8, 1), ("Split", 0.6, 2), ("Mixed", 0.75, 3), ("NonSeparable", 0.5, 3), ("NonSeparable", 0.0, 0)]


def test_decomposition(spark):
    assert classify.two_clusters(["AAA"] * 3 + ["TTT"] * 3) == [([0, 1, 2], 0.5), ([3, 4, 5], 0.5)]
    assert classify.two_clusters(["AAA"] * 5) == [] and classify.two_clusters(["AAAA"] * 5 + ["TTTT"]) == []
    df = feature_rows(spark, [(0.85, 1.60, 0.50, 2000), (0.99, 1.0, 0.95, 2000)])
    snps = spark.createDataFrame([(b, i, "AAA" if i < 3 else "TTT") for b in (0, 1) for i in range(6)], "bubble_id long, read_id long, snps string")
    got = {r.bubble_id: r for r in classify.hierarchical(df, "bubble_id", snps).collect()}
    assert got[0].label == "Mixed" and got[0].decomposed and not got[1].decomposed
    part = classify.disambiguate(feature_rows(spark, [(0.85, 1.60, 0.50, 2000)])).head()
    assert got[0].confidence == pytest.approx(part.confidence)


def test_consensus(spark):
    df = spark.createDataFrame([("a", s) for s in ("ACGT", "ACGA", "AGGA")] + [("b", "acgtn"), ("c", "AC"), ("c", "TC"), ("c", "")], "g string, seq string")
    assert {r.g: r.consensus for r in consensus.majority(df, "g").collect()} == {"a": "ACGA", "b": "acgtn", "c": "AC"}
    voted = {r.g: r for r in consensus.vote(df.where("g = 'a'"), "g").collect()}["a"]
    assert voted.consensus == "ACGA" and voted.depths == [3, 3, 3, 3] and voted.majority_fraction[1] == pytest.approx(2 / 3)
    tie = spark.createDataFrame([("x", "A-"), ("x", "T-")], "g string, seq string")
    assert consensus.vote(tie, "g").head().consensus == "NN"
    with pytest.raises(Exception, match="differ in length"):
        consensus.vote(df, "g").collect()


def test_repeat_families(spark):
    repeats = spark.createDataFrame([("c", 0, 100, "L1"), ("c", 200, 300, "L1"), ("c", 400, 500, "Alu"), ("c", 900, 999, "gone")], "chrom string, start long, end long, family string")
    regions = spark.createDataFrame([(0, "c", 0, 350, 60.0), (1, "c", 350, 600, 14.6)], "row_idx long, chrom string, start long, end long, mean_coverage double")
    got = {r.family: (r.total_bp, r.mean_cov, r.cn) for r in coverage.family_cn(repeats, regions, 30.0).collect()}
    assert got == {"L1": (200, 60.0, 4.0), "Alu": (100, 15.0, 1.0)}


def test_intervals_over_bins(spark):
    rows = [(RND.choice("xy"), a := RND.randrange(3000), a + RND.randrange(1, 900)) for _ in range(60)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long").withColumn("id", F.monotonically_increasing_id())
    want = sum(a[0] == b[0] and a[1] < b[2] and a[2] > b[1] for a in rows for b in rows)
    assert coverage.overlapping(df, df, bin_bp=128).count() == want


def test_bands(spark):
    truth = spark.createDataFrame([("s", i, v, c) for i, (v, c) in enumerate([(0.10, 0), (0.50, 2), (0.25, 4), (0.15, 6)])], "sample string, row_idx long, vaf_target double, copy_count int")
    calls = spark.createDataFrame([("s", i, v, c) for i, (v, c) in enumerate([(0.48, 2), (0.26, 4), (0.16, 6), (0.11, 1), (0.03, 1)])], "sample string, row_idx long, est_vaf double, est_copy_count int")
    got = {r.lo: r for r in bands.band_stats(truth, calls).collect()}
    assert sum(r.tp for r in got.values()) == 4 and got[0.0].fp == 1 and got[0.0].recall is None and got[0.05].copy_count_accuracy == 0.0 and got[0.25].recall == 1.0
    stats = [r.asDict() for r in bands.band_stats(truth, calls).orderBy("lo").collect()]
    assert '"precision": null' in writers.band_json(stats, "s", 4, 5) and writers.band_table(stats).count("\n") == 5
    nodes = spark.createDataFrame([(0, 5, 1000, 2, 0), (1, 3, 1100, 2, 0), (2, 9, 4000, 1, 0)], "row_idx long, node_id long, length_bp long, est_copy_count int, read_support long")
    assert {(r.node_id, r.est_copy_count, r.length_bp) for r in bands.calls_from_nodes(nodes).collect()} == {(3, 2, 1050), (9, 1, 4000)}


def test_scripts():
    for _ in range(300):
        path = dna(RND.randint(0, 40))
        read = list(path)
        for _ in range(RND.randint(0, 4)):
            at = RND.randint(0, len(read))
            RND.choice([lambda: read.insert(at, RND.choice("ACGT")), lambda: read and read.pop(min(at, len(read) - 1)), lambda: read and read.__setitem__(min(at, len(read) - 1), RND.choice("ACGT"))])()
        read = "".join(read)
        script = alignment.edit_script(read, path)
        assert alignment.apply_script(path, script) == read
    assert alignment.edit_script("A" * 100, "A" * 10) is None and alignment.edit_script("A" * 1500, "C" * 1500) is None and alignment.edit_script("AC", "AC") == []
    assert [x[1] for x in alignment.edit_script("ACGT", "ACGGT")] == ["D"]


def slow_affine(q, t):
    best = {}

    def add(k, score, edits):
        best[k] = max(best.get(k, (-(10**9), 0)), (score, -edits))

    add((0, 0, "m"), 0, 0)
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            for s in "mxy":
                if (i, j, s) not in best:
                    continue
                score, edits = best[i, j, s][0], -best[i, j, s][1]
                if i < len(q) and j < len(t):
                    same = q[i] == t[j]
                    add((i + 1, j + 1, "m"), score + (0 if "N" in (q[i], t[j]) else 1 if same else -2), edits + (not same))
                if i < len(q):
                    add((i + 1, j, "x"), score - 2 - (0 if s == "x" else 4), edits + 1)
                if j < len(t):
                    add((i, j + 1, "y"), score - 2 - (0 if s == "y" else 4), edits + 1)
    score, edits = max(best[len(q), len(t), s] for s in "mxy" if (len(q), len(t), s) in best)
    return -edits, score


def test_affine_edits():
    assert alignment.affine_edits("", "ACG") == (3, 0) and alignment.affine_edits("ACGT", "ACGT")[0] == 0
    for _ in range(150):
        q, t = ("".join(RND.choices("ACGTN", k=RND.randint(1, 12))) for _ in range(2))
        assert q == t or alignment.affine_edits(q, t) == slow_affine(q, t), (q, t)
    s = dna(30)
    assert alignment.affine_edits(s, s[:15] + ("A" if s[15] != "A" else "C") + s[16:])[0] == 1


def test_amplicons(spark):
    reads = spark.createDataFrame([("r1", "ACGTACGT" + "N" * 9 + "GGGGTTTT"), ("r2", "ACGTACGTGGGGTTTT"), ("r3", None)], "read_id string, seq string")
    got = alignment.scan_amplicons(reads, [("p", "ACGTACGT", "AAAACCCC")], 0).collect()
    assert [(r.read_id, r.start, r.end) for r in got] == [("r1", 0, 25)]
    primers = spark.createDataFrame([("p", "ACGTACGT", "AAAACCCC"), ("q", "CGTA", "CC")], "primer string, fwd string, rev string")
    exact = {(r.primer, r.read_id, r.start, r.end, r.amplicon) for r in alignment.scan_exact(reads, primers).collect()}
    assert exact == {(r.primer, r.read_id, r.start, r.end, r.amplicon) for r in alignment.scan_amplicons(reads, [("p", "ACGTACGT", "AAAACCCC"), ("q", "CGTA", "CC")], 0).collect()}


def test_projection(spark):
    m = spark.createDataFrame([("b1", "r2", 30), ("b1", "r1", 30), ("b2", "r1", 5)], "query string, ref_name string, mapq int").select("*", *[F.lit(0).cast("long").alias(c) for c in ("query_start", "query_end", "target_start", "target_end")], F.lit("t").alias("target"), F.lit("+").alias("strand"), F.lit(1.0).alias("identity"))
    assert {(r.query, r.ref_name) for r in projection.best_mappings(m, {"r1": 0, "r2": 1}).collect()} == {("b1", "r1"), ("b2", "r1")}
    rows, head = pipelines.project(spark.createDataFrame([("b1", 10), ("b2", 20), ("b3", 30)], "contig_id string, length_bp long"), m, "x/s.json", 20)
    assert tuple(head.head()) == ("s", "0.2.0", 3, 2)
    lines = [r.line for r in writers.report_json(rows, "s", "0.2.0").orderBy("part", "pos").collect()]
    import json

    made = json.loads("\n".join(lines))
    assert made["n_contigs"] == 3 and [b["unannotated"] for b in made["contigs"]] == [False, True, True] and made["contigs"][2]["vaf"] is None


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\n????\n@r2\tz\r\nAC\r\n+r2\r\n??\r\n@bad\nACG\n+\n?\n@r4\nA\n+\n?\n")
    assert [(r["name"], r.seq) for r in readers.fastq(spark, str(tmp_path / "a.fq")).orderBy("record").collect()] == [("r1", "ACGT"), ("r2", "AC")]
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">x one\nACG\nT\n>y\nGG\n")
    assert {(r["name"], r.seq) for r in readers.fasta(spark, str(tmp_path / "a.fa.gz")).collect()} == {("x", "ACGT"), ("y", "GG")}
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + "".join(f"{n}\t{f}\t*\t0\t0\t*\t*\t0\t0\t{s}\t*\n" for n, f, s in (("p", 0, "ACGR"), ("q", 16, "AACG"), ("s", 256, "A"), ("t", 2048, "A"), ("u", 4, "GG"))))
    want = {("p", "ACGN"), ("q", "CGTT"), ("u", "GG")}
    assert {(r["name"], r.seq) for r in readers.sam(spark, str(tmp_path / "a.sam")).collect()} == want
    body = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99)
    for n, f, s in (("p", 0, "ACGR"), ("q", 16, "AACG"), ("s", 256, "A"), ("t", 2048, "A"), ("u", 4, "GG")):
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in s] + [0] * (len(s) % 2)
        rec = struct.pack("<iiBBHHHiiii", -1, -1, len(n) + 1, 0, 0, 0, f, len(s), -1, -1, 0) + n.encode() + b"\0" + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + b"\xff" * len(s)
        body += struct.pack("<i", len(rec)) + rec
    (tmp_path / "a.bam").write_bytes(gzip.compress(body[:40]) + gzip.compress(body[40:]))
    assert {(r["name"], r.seq) for r in readers.bam(spark, str(tmp_path / "a.bam")).collect()} == want
    (tmp_path / "m.bed").write_text("#c\n\nchr1\t0\t10\tg\t5.5\nchr1\t10\t20\t7\nchr1\tx\t3\t4\nchr2\t1\t2\n")
    assert [(r.start, r["name"], r.mean_coverage) for r in readers.mosdepth_regions(spark, str(tmp_path / "m.bed")).orderBy("row_idx").collect()] == [(0, "g", 5.5), (10, "", 7.0)]
    (tmp_path / "r.bed").write_text("c 1 2 LINE/L1 0.5\nc 3 4 Alu .\nc 5 6\n")
    assert {(r.start, r["class"], r.family) for r in readers.repeat_bed(spark, str(tmp_path / "r.bed")).collect()} == {(1, "LINE", "L1"), (3, "Alu", "Alu")}
    assert {(r.start, r["name"], r.confidence) for r in readers.bed(spark, str(tmp_path / "r.bed")).collect()} == {(1, "LINE/L1", 0.5), (3, "Alu", None), (5, "", None)}
    (tmp_path / "a.paf").write_text("q\t10\t0\t9\t+\tt\t99\t5\t14\t8\t9\t60\nq\t10\t0\t9\t-\tt\t99\t5\t14\t8\t0\t3\nbad\t1\n")
    assert [(r.mapq, round(r.identity, 3)) for r in readers.paf(spark, str(tmp_path / "a.paf"), "r", 2).orderBy("mapq").collect()] == [(3, 0.0), (60, 0.889)]
    assert readers.gaf(spark, str(tmp_path / "a.paf"), "r", 10).head().path == "t"
    (tmp_path / "t.tsv").write_text("#allele\nx\t2\t0.5\t10\t500\n")
    assert readers.truth_tsv(spark, str(tmp_path / "t.tsv")).head().vaf_target == 0.5
    assert readers.ref_spec("n=/a/b.fa") == ("n", "/a/b.fa") and readers.ref_spec("/a/b.fa.gz")[0] == "b" and readers.comma_list("a,,b") == ["a", "b"]
    assert readers.safe_shell_path("/a b/c") and not readers.safe_shell_path("a$b")


def test_gfa_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 100, 2, 0.5, 7, "ACGT"), (1, 50, 1, 1.0, 0, ""), (3, 9, 1, 1.0, 2, "")], "id long, length_bp long, copy_count int, cn_conf float, read_support long, consensus string")
    edges = spark.createDataFrame([(0, 0, 1, 3, 0.25, 0.5, 1), (1, 1, 3, 4, 1.0, 0.0, 16), (2, 0, 1, 9, 1.0, 0.0, 8)], "edge_idx long, src long, dst long, read_support long, vaf float, vaf_conf float, flags int")
    g = graph.Graph(graph.node_columns(nodes), graph.edge_columns(edges))
    writers.write_lines(writers.gfa_lines(g), str(tmp_path / "g"), files=1)
    (part,) = [p for p in (tmp_path / "g").iterdir() if p.suffix == ".txt"]
    text = part.read_text()
    assert text.startswith("H\tVN:Z:1.2\nS\t0\tACGT\tLN:i:100\tRC:i:7\tCN:i:2\tCV:f:0.500\n") and "\t-\t0M\tVC:i:4" in text and text.count("BT:A:") == 2
    n, e = readers.gfa(spark, str(part))
    assert {(r.id, r.length_bp, r.consensus) for r in n.collect()} == {(0, 100, "ACGT"), (1, 50, ""), (2, 0, ""), (3, 9, "")}
    assert [(r.src, r.dst, r.read_support, r["flags"]) for r in e.orderBy("edge_idx").collect()] == [(0, 1, 3, 1), (1, 3, 4, 0), (0, 1, 9, 8)]
    assert {(r.node_id, r.read_support) for r in readers.gfa_calls(spark, str(part)).collect()} == {(0, 7), (1, 0), (3, 2)}
    assert [r.line for r in writers.consensus_lines(g).collect()] == [">node_0\nACGT"]
    assert writers.summary(spark.read.text(str(part)), spark.createDataFrame([(2.0,)], "relative_cn double")).head()[:2] == (3, 3)
    long = spark.createDataFrame([("n", "A" * 170)], "name string, seq string")
    assert [len(x) for x in writers.fasta_lines(long).head().line.split("\n")] == [2, 80, 80, 10]


def test_assembly_does_not_depend_on_partitions(spark):
    genome = dna(6000)
    reads = [(i, genome[i * 300 : i * 300 + 900]) for i in range(16)] + [(16, dna(50))]
    got = []
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = pipelines.assemble(spark.createDataFrame(reads, "read_id long, seq string").repartition(parts))
        got.append([r.line for r in writers.gfa_lines(out.graph).orderBy("part", "pos").collect()] + [r.line for r in writers.path_lines(out.paths, spark.createDataFrame([(i, f"r{i}") for i, _ in reads], "read_id long, name string")).orderBy("read_id").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got[0] == got[1] and 1 <= sum(x.startswith("S") for x in got[0]) <= 17
    decided = pipelines.analyze_graph(out.graph).decided
    assert writers.bubble_lines(decided).count() == decided.count()


def test_stream_of_reads(spark, tmp_path):
    reads = spark.createDataFrame([(i, dna(200)) for i in range(6)], "read_id long, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        sketch_stream(stream, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == sketch.sketch(reads).count()


def test_band_table_shows_what_the_json_has():
    """A residual's last bits don't decide its third place: the table rounds the six places of the JSON."""
    stats = [{"name": "(0.10, 0.25]", "lo": 0.1, "hi": 0.25, "n_truth": 1, "n_called": 1, "tp": 1, "fp": 0, "recall": 1.0, "precision": 1.0, "median_abs_vaf_residual": 0.04749999999999999, "copy_count_accuracy": None}]
    assert '"median_abs_vaf_residual": 0.0475,' in writers.band_json(stats, "s", 1, 1)
    assert writers.band_table(stats).split("\n")[1].split()[-2:] == ["0.048", "-"]
