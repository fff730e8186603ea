"""Writers: each makes a table of lines, (key columns..., line), and write_lines puts them in files by key."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import drop_path, few_or_all, new_path, written
from ..functions.sequence import mapq
from ..operators.graph import OPPOSITE, Graph


def write_lines(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Text files in the order of all columns but `line`; the files' names sort as the lines do."""
    keys = [c for c in lines.columns if c != "line"]
    ordered = lines.orderBy(*keys).select("line")
    (ordered if files is None else ordered.coalesce(files)).write.mode("overwrite").text(path)


def write_file(lines: DataFrame, path: str) -> None:
    """One text file: written in parts by all tasks, which are then copied together in order, as bytes."""
    spark = lines.sparkSession
    parts = new_path(spark, "parts")
    write_lines(lines, parts)
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    there, here = fs.Path(parts), fs.Path(path)
    source, target = there.getFileSystem(conf), here.getFileSystem(conf)
    out = target.create(here, True)
    try:
        for name in sorted(x.getPath().getName() for x in source.listStatus(there) if x.getPath().getName().startswith("part-")):
            part = source.open(fs.Path(parts, name))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    drop_path(spark, parts)


def _tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def gfa_lines(graph: Graph) -> DataFrame:
    """(part, pos, line): the header, S lines by id, L lines in the edges' order."""
    header = graph.nodes.sparkSession.createDataFrame([(0, 0, "H\tVN:Z:1.2")], "part int, pos long, line string")
    seq = F.when(F.length("consensus") > 0, F.col("consensus")).otherwise("*")
    s = graph.nodes.select(F.lit(1).alias("part"), F.col("id").alias("pos"), F.format_string("S\t%d\t%s\tLN:i:%d\tRC:i:%d\tCN:i:%d\tCV:f:%.3f", "id", seq, "length_bp", "read_support", "copy_count", "cn_conf").alias("line"))
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    kind = F.when(flag(1), "\tBT:A:B").when(flag(2), "\tBT:A:D").when(flag(4), "\tBT:A:M").when(flag(8), "\tBT:A:N").otherwise("")
    line = F.format_string("L\t%d\t+\t%d\t%s\t0M\tVC:i:%d\tVF:f:%.4f\tCT:f:%.4f%s", "src", "dst", F.when(flag(OPPOSITE), "-").otherwise("+"), "read_support", "vaf", "vaf_conf", kind)
    edges = graph.edges.select(F.lit(2).alias("part"), F.col("edge_idx").alias("pos"), line.alias("line"))
    return header.union(s).union(edges)


def fasta_lines(seqs: DataFrame, name: str = "name", seq: str = "seq", order: str | None = None, width: int = 80) -> DataFrame:
    """(pos, line): a line holds a whole record, cut at `width` characters."""
    cut = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?!$)", "$1\n")
    return seqs.select(F.col(order or name).alias("pos"), F.concat(F.lit(">"), F.col(name), F.lit("\n"), cut).alias("line"))


def consensus_lines(graph: Graph) -> DataFrame:
    """FASTA of the nodes that have a consensus, as node_<id>."""
    some = graph.nodes.where(F.length("consensus") > 0).select("id", F.concat(F.lit("node_"), F.col("id").cast("string")).alias("name"), F.col("consensus").alias("seq"))
    return fasta_lines(some, order="id")


def interval_lines(intervals: DataFrame) -> DataFrame:
    """BED of (chrom, start, end, name, score, strand), by place and then name."""
    return intervals.select("chrom", "start", "name", _tabbed("chrom", "start", "end", "name", "score", "strand").alias("line"))


def paf_lines(overlaps: DataFrame, reads: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """(read_a, read_b, line): starts and lengths are kept within the reads."""
    sized = written(reads.select("read_id", F.col(name).alias("name"), F.length(seq).alias("len")), "names")  # texts are read once
    of = lambda c: few_or_all(sized.withColumnsRenamed({"read_id": f"read_{c}", "name": f"name_{c}", "len": f"len_{c}"}))
    o = overlaps.join(of("a"), "read_a").join(of("b"), "read_b").withColumn("qs", F.least("offset_a", "len_a")).withColumn("ts", F.least("offset_b", "len_b"))
    o = o.withColumn("aln", F.least("overlap_len", F.col("len_a") - F.col("qs"), F.col("len_b") - F.col("ts"))).withColumn("m", F.greatest(F.lit(0), F.col("aln") - F.col("diff_count")))
    strand = F.when(F.col("strand") == 0, "+").otherwise("-")
    line = _tabbed("name_a", "len_a", "qs", F.col("qs") + F.col("aln"), strand, "name_b", "len_b", "ts", F.col("ts") + F.col("aln"), "m", "aln", mapq(F.col("m"), F.col("aln")))
    return o.select("read_a", "read_b", line.alias("line"))


def path_lines(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(read_id, line): the read's name, its nodes, how many deltas."""
    named = paths.join(names.select("read_id", "name"), "read_id")
    n = F.coalesce(F.size("deltas"), F.lit(0)) if "deltas" in paths.columns else F.lit(0)
    return named.select("read_id", _tabbed("name", F.array_join("path", ","), n).alias("line"))


def cn_lines(estimates: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(part, pos, line): the table of copy numbers, then a comment for each cluster."""
    rows = estimates.select(F.lit(0).alias("part"), F.concat_ws(":", "chrom", F.lpad(F.col("start").cast("string"), 12, "0"), "name").alias("pos"), F.format_string("%s\t%d\t%d\t%s\t%.3f\t%.3f", "chrom", "start", "end", "name", "mean_coverage", "relative_cn").alias("line"))
    if clusters is None:
        return rows
    return rows.union(clusters.select(F.lit(1), F.col("cluster"), F.format_string("# cluster\t%s\t%d\t%.3f\t%.3f", "cluster", "n", "total_cn", "mean_cn")))


def repeat_lines(families: DataFrame) -> DataFrame:
    """(family, line) of copy numbers by repeat family."""
    return families.select("family", F.format_string("%s\t%d\t%.3f\t%.3f", "family", "total_bp", "mean_cov", "cn").alias("line"))


def bubble_lines(decided: DataFrame) -> DataFrame:
    """(entry, exit, line): BED of bubbles with their confidence, a point where it is unknown. Needs bubble_id."""
    name = F.format_string("bubble_%d_n%d_%d", "bubble_id", "entry", "exit")
    confidence = F.when(F.col("confidence").isNull(), ".").otherwise(F.format_string("%.3f", "confidence"))
    return decided.select("entry", "exit", _tabbed(F.lit("graph"), F.lit(0), "length", name, confidence).alias("line"))


def report_json(projected: DataFrame, sample: str, version: str) -> DataFrame:
    """(part, pos, line): the report as JSON, an entry a line, so that no entry waits for another."""
    counts = projected.agg(F.count("*").alias("n"), F.count_if("unannotated").alias("u"))
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("pos"), F.concat(F.lit('{"sample": ' + json.dumps(sample) + ', "version": ' + json.dumps(version) + ', "n_contigs": '), F.col("n").cast("string"), F.lit(', "unannotated_count": '), F.col("u").cast("string"), F.lit(', "contigs": [')).alias("line"))
    last = projected.agg(F.max("contig_id").alias("last"))
    body = F.to_json(F.struct(*[c for c in projected.columns]), {"ignoreNullFields": "false"})
    rows = projected.crossJoin(F.broadcast(last)).select(F.lit(1), F.col("contig_id"), F.concat(body, F.when(F.col("contig_id") < F.col("last"), ",").otherwise("")))  # one row
    foot = projected.sparkSession.createDataFrame([(2, "", "]}")], "part int, pos string, line string")
    return head.union(rows).union(foot)


def _tidy(v):
    """Six places, so that the last bits of a sum don't decide what is shown."""
    return round(v, 6) if isinstance(v, float) else v


def band_json(stats: list[dict], sample: str, n_truth: int, n_called: int) -> str:
    """The report of one sample's five bands."""
    keys = ("name", "lo", "hi", "n_truth", "n_called", "tp", "fp", "recall", "precision", "median_abs_vaf_residual", "copy_count_accuracy")
    return json.dumps({"schema_version": "1", "sample": sample, "n_truth": n_truth, "n_called": n_called, "bands": [{k: _tidy(s[k]) for k in keys} for s in stats]}, indent=2)


def band_table(stats: list[dict]) -> str:
    """The same values as a table of fixed width."""
    keys = ("n_truth", "n_called", "tp", "fp", "recall", "precision", "median_abs_vaf_residual", "copy_count_accuracy")
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = [("band", "n_truth", "n_called", "tp", "fp", "recall", "precision", "residual", "cn_ok"), *((s["name"], *(show(_tidy(s[k])) for k in keys)) for s in stats)]
    return "\n".join("".join(f"{x:<14}" if i == 0 else f"{x:>10}" for i, x in enumerate(r)) for r in rows)


def summary(gfa: DataFrame, cn: DataFrame) -> DataFrame:
    """One row: n_segments and n_links of GFA lines (value), n_cn_rows and mean_cn of a table."""
    lines = gfa.agg(F.count_if(F.col("value").startswith("S\t")).alias("n_segments"), F.count_if(F.col("value").startswith("L\t")).alias("n_links"))
    return lines.crossJoin(cn.agg(F.count("*").alias("n_cn_rows"), F.avg("relative_cn").alias("mean_cn")))  # one row each
