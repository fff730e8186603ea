"""The command line from files to files, mapping without an aligner, crowded minimizers, the hook for sub-bubbles."""

import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from kinloom import __version__, cli
from kinloom.config import Overlap, cleared, new_path, settled, written
from kinloom.functions.sequence import reverse_complement  # noqa: F401
from kinloom.operators import alignment, classify, mapping, overlap, sketch

RND = random.Random(9)
TURN = str.maketrans("ACGT", "TGCA")


def genome(n):
    return "".join(RND.choices("ACGT", k=n))


def test_assemble_and_project(spark, tmp_path):
    ref = genome(6000)
    reads = [(f"toy_{i}", ref[i * 500 : i * 500 + 1000]) for i in range(10)]
    (tmp_path / "r.fq").write_text("".join(f"@{n} c\n{s}\n+\n{'?' * len(s)}\n" for n, s in reads))
    (tmp_path / "ref.fa").write_text(f">chr1 x\n{ref}\n")
    out = lambda x: str(tmp_path / x)
    code = cli.main(["assemble", "--fastq", out("r.fq"), "--out", out("g.gfa"), "--fasta", out("r.fa"), "--fasta-consensus", out("c.fa"), "--bed", out("n.bed"), "--paf", out("o.paf"), "--paths", out("p.tsv"), "--ref-linear", f"ref={out('ref.fa')}"], spark)
    assert code == 0
    gfa = (tmp_path / "g.gfa").read_text().splitlines()
    assert gfa[0] == "H\tVN:Z:1.2" and 1 <= sum(x.startswith("S") for x in gfa) <= 10 and all("CN:i:" in x and "CV:f:" in x for x in gfa if x.startswith("S"))
    assert (tmp_path / "r.fa").read_text().count(">") == 10 and "".join((tmp_path / "r.fa").read_text().split("\n")[1:14]) == reads[0][1]
    paf = [x.split("\t") for x in (tmp_path / "o.paf").read_text().splitlines()]
    assert len(paf) >= 9 and all(len(x) == 12 for x in paf)
    assert len((tmp_path / "p.tsv").read_text().splitlines()) == 10
    bed = [x.split("\t") for x in (tmp_path / "n.bed").read_text().splitlines()]
    assert bed and all(x[0] in ("chr1", "NA") and len(x) == 6 for x in bed)
    assert (tmp_path / "c.fa").read_text().startswith(">node_")
    assert cli.main(["project", "--fasta", out("r.fa"), "--ref-linear", f"ref={out('ref.fa')}", "--out-prefix", out("s.json")], spark) == 0
    made = json.loads((tmp_path / "s.json.json").read_text())
    assert made["sample"] == "s" and made["n_contigs"] == 10 and made["unannotated_count"] == 0
    first = next(c for c in made["contigs"] if c["contig_id"] == "toy_3")["linear_mappings"][0]
    assert first["target"] == "chr1" and 1500 <= first["target_start"] < 1540 and first["strand"] == "+"


def test_analyze(spark, tmp_path):
    out = lambda x: str(tmp_path / x)
    (tmp_path / "cov.bed").write_text("chr1\t0\t100\tA1\t30\nchr1\t100\t200\tA2\t60\nchr2\t0\t50\tB1\t15\n")
    (tmp_path / "rep.bed").write_text("chr1\t0\t50\tLINE/L1\n")
    code = cli.main(["analyze", "--regions", out("cov.bed"), "--baseline-cov", "30", "--cluster", "a:A1,A2", "--out", out("cn.tsv"), "--repeat-bed", out("rep.bed"), "--out-repeats", out("rep.tsv")], spark)
    assert code == 0
    lines = (tmp_path / "cn.tsv").read_text().splitlines()
    assert lines[0].startswith("chr1\t0\t100\tA1\t30.000\t1.000") and lines[-1] == "# cluster\ta\t2\t3.000\t1.500"
    assert (tmp_path / "rep.tsv").read_text() == "L1\t50\t30.000\t2.000\n"
    nodes = "".join(f"S\t{i}\t*\tLN:i:3000\tRC:i:40\n" for i in range(4))
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1.2\n" + nodes + "".join(f"L\t{a}\t+\t{b}\t+\t0M\tVC:i:10\n" for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))))
    assert cli.main(["analyze", "--graph", out("g.gfa"), "--out-bed", out("b.bed")], spark) == 0
    assert (tmp_path / "b.bed").read_text().split("\t")[3] == "bubble_0_n0_3"


def test_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "none.fq").write_text("")
    assert cli.main(["assemble", "--out", "x"], spark) == 2 and cli.main(["analyze"], spark) == 2
    assert cli.main(["assemble", "--fastq", str(tmp_path / "none.fq"), "--out", str(tmp_path / "x")], spark) == 4
    assert cli.main(["assemble", "--fastq", str(tmp_path / "missing.fq"), "--out", str(tmp_path / "x")], spark) == 3
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip().endswith(__version__)


def test_mapping(spark):
    ref = genome(5000)
    seqs = [("a", ref[700:1900]), ("b", ref[3000:4200].translate(TURN)[::-1]), ("c", genome(800)), ("d", ref[:30])]
    q, t = spark.createDataFrame(seqs, "name string, seq string"), spark.createDataFrame([("chr1", ref)], "name string, seq string")
    got = {r.query: r for r in mapping.map_sequences(q, t).collect()}
    assert set(got) == {"a", "b"} and got["a"].strand == "+" and got["b"].strand == "-"
    assert 700 <= got["a"].target_start < 740 and 1860 < got["a"].target_end <= 1900 and got["a"].query_len == 1200 and got["a"].mapq > 30
    hurt = list(ref[700:1900])
    hurt[600] = {"A": "C", "C": "G", "G": "T", "T": "A"}[hurt[600]]
    q = spark.createDataFrame([("a", "".join(hurt)), ("b", seqs[1][1])], "name string, seq string")
    best = {r.query: r for r in mapping.align_to_reference(q, t).collect()}
    assert best["a"].edits == 1 and best["b"].edits == 0 and best["b"].identity == 1.0


@pytest.mark.parametrize("crowded", [1, 5, 10**6])
def test_crowded_minimizers_lose_no_pair(spark, crowded):
    """Whatever counts as crowded, the pairs are those of the plain join."""
    rows = []
    for read in range(60):
        for h in range(25):  # hash h is in about every (1 + h // 3)th read
            if RND.random() < 1 / (1 + h // 3):
                rows.append((h, read, RND.choice([1, 1, 1, 2, 6])))
    each = spark.createDataFrame(rows, "hash long, read_id long, n long")
    shared = each.groupBy("hash").agg(F.count("*").alias("reads"), F.max("n").alias("most")).where("reads > 1")
    for least in (1, 5, 20):
        plain, by = {}, {}
        for h, r, n in rows:
            by.setdefault(h, []).append((r, n))
        for many in by.values():
            for x, n in many:
                for y, m in many:
                    if x < y:
                        plain[x, y] = plain.get((x, y), 0) + n * m
        got = {(r.read_a, r.read_b) for r in overlap.sharing(each, shared, Overlap(min_matches=least, crowded=crowded)).collect()}
        want = {p for p, m in plain.items() if m >= least}
        assert want <= got and (crowded < 10**6 or got == want)


def test_a_minimizer_in_all_reads(spark):
    """100,000 reads hold one hash: no pair comes from it, and those that share five others are found."""
    every = spark.range(100_000).selectExpr("0L AS hash", "id AS read_id", "1L AS n")
    own = spark.range(100_000).selectExpr("id div 2 AS pair", "id AS read_id").selectExpr("explode(transform(sequence(1L, IF(pair % 1000 = 0, 5L, 2L)), x -> x + pair * 10)) AS hash", "read_id", "1L AS n")
    each = every.union(own)
    shared = each.groupBy("hash").agg(F.count("*").alias("reads"), F.max("n").alias("most")).where("reads > 1")
    got = overlap.sharing(each, shared, Overlap())
    assert sorted((r.read_a, r.read_b) for r in got.collect()) == [(2000 * k, 2000 * k + 1) for k in range(50)]


def test_a_limit_of_overlaps_is_told(spark):
    ref = genome(3000)
    reads = spark.createDataFrame([(i, ref[i * 300 : i * 300 + 1200]) for i in range(6)], "read_id long, seq string")
    every = overlap.overlaps(reads)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert overlap.overlaps(reads, Overlap(max_overlaps=3)).count() == 3
    assert any(f"{every.count() - 3} overlaps are left out" in str(w.message) for w in told)
    assert sketch.sketch(reads).count() > 0


def test_scripts_that_are_too_long(spark):
    rows = spark.createDataFrame([("ACGT", "ACGT"), ("A" * 200, "A" * 100), ("ACGT" * 300, "TGCA" * 300)], "read_seq string, path_seq string")
    got = alignment.reconstruct(alignment.encode_deltas(rows)).collect()
    assert {(r.read_seq[:4], None if r.deltas is None else len(r.deltas), r.rebuilt) for r in got} == {("ACGT", 0, "ACGT"), ("AAAA", None, None), ("ACGT", None, None)}


def test_parts_are_reclassified(spark):
    features = {"flank": 0.85, "depth": 1.6, "span": 0.5, "length": 2000, "segdup": 0.0, "repeat": 0.0}
    df = spark.createDataFrame([(1, *features.values())], "bubble_id long, " + ", ".join(f"{k} {'long' if k == 'length' else 'double'}" for k in features))
    snps = spark.createDataFrame([(1, i, "AAAA" if i < 4 else "TTTT") for i in range(8)], "bubble_id long, read_id long, snps string")
    assert classify.disambiguate(df).head().label == "Mixed"
    seen = []

    def hook(parts):
        seen.append(set(parts.columns))
        return parts.withColumn("label", F.lit("Split")).withColumn("confidence", F.col("vaf") / 2)

    row = classify.hierarchical(df, "bubble_id", snps, reclassify=hook).head()
    assert row.label == "Mixed" and row.decomposed and row.confidence == 0.25 and {"cluster", "read_ids", "vaf"} <= seen[0]


def test_written_tables_are_deleted(spark):
    import os

    kept = settled(spark, lambda: written(spark.range(5), "inner").where("id > 1"), "outer")
    folder = os.path.dirname(kept.inputFiles()[0]).removeprefix("file://")
    assert kept.count() == 3 and not any("inner" in x for x in os.listdir(os.path.dirname(folder)))
    new_path(spark, "x")
    cleared(spark)
    assert not os.path.exists(folder)
