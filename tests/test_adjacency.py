"""Packed edges against brute force; what is done with them takes little space and no row for a pair of edges."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.config import Overlap, shared_dir
from kinloom.operators import adjacency, graph
from kinloom.plans import pipelines, tables
from test_graph_operators import slow_contained, slow_transitive


def crowd(seed, n, most):
    """Reads of which nearly all follow each other, with edges left out and some repeated, rings and loops."""
    r = random.Random(seed)
    lengths = [r.randrange(most) for _ in range(n)]
    edges = [(a, b) for b in range(n) for a in range(b) if r.random() > 0.03 * (a % 3)]
    return lengths, edges + [(r.randrange(n), r.randrange(n)) for _ in range(n // 4)]


def made(spark, lengths, edges):
    """The graph with its edges packed, numbered by source and successor."""
    rows = spark.createDataFrame([(a, b, (a + b) % 2) for a, b in edges], "src long, dst long, strand int").repartition(5)
    packed = adjacency.adjacent(rows)
    return graph.Graph(graph.node_columns(spark.createDataFrame(list(enumerate(lengths)), "id long, length_bp long")), graph.unpacked(packed), packed)


@pytest.mark.parametrize("n", [1, 7, 300])
@pytest.mark.parametrize("high", [90, 1 << 40])
def test_successors_are_packed(n, high):
    r = np.random.default_rng(n)
    dst, strand = np.sort(r.integers(0, high, n)), r.integers(0, 2, n)
    again = adjacency.unpack(adjacency.pack(dst, strand), n)
    assert (again[0] == dst).all() and (again[1] == strand).all()


@pytest.mark.parametrize("seed,n,most,held", [(1, 6, 3, 1 << 21), (2, 40, 60, 50), (3, 90, 9, 1 << 21), (4, 90, 900, 300), (5, 120, 200, 64)])
def test_packed_graph_against_brute_force(spark, monkeypatch, seed, n, most, held):
    monkeypatch.setattr(adjacency, "HELD", held)
    monkeypatch.setattr(adjacency, "TRIED", 7)
    lengths, edges = crowd(seed, n, most)
    g, ordered = made(spark, lengths, edges), sorted(edges)
    rows = g.edges.orderBy("edge_idx").collect()
    assert [(r.edge_idx, r.src, r.dst, r.flags) for r in rows] == [(i, a, b, (a + b) % 2 * graph.OPPOSITE) for i, (a, b) in enumerate(ordered)]
    gone = slow_contained(lengths, ordered)
    assert sorted(r.id for r in graph.contained(g).collect()) == sorted(gone)
    left = [(i, e) for i, e in enumerate(ordered) if e[0] not in gone and e[1] not in gone]
    red = {left[k][0] for k in slow_transitive(lengths, [e for _, e in left], 100)}
    kept, stats = graph.filter_graph(g)
    assert {r.edge_idx for r in kept.edges.collect()} == {i for i, _ in left} - red
    assert stats == {"edges_before": len(edges), "edges_after": len(left) - len(red), "nodes_dropped_contained": len(gone), "transitive_edges_removed": len(red)}


def test_no_edges(spark):
    g, _ = graph.build_graph(spark.range(3).select(F.col("id").alias("read_id"), F.lit(5).alias("length_bp")), spark.createDataFrame([], "read_a long, read_b long, strand int"))
    assert g.edges.count() == 0 and graph.contained(g).count() == 0 and graph.filter_graph(g)[1]["edges_after"] == 0


def bytes_written(spark) -> int:
    top = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)


def test_a_crowd_of_reads_takes_little_space(spark):
    """F8: the edges were written three times, whole."""
    n = 1200
    reads = spark.range(n).select(F.col("id").alias("read_id"), (1000 - F.col("id") % 7).alias("length_bp"))
    pairs = reads.select(F.col("read_id").alias("read_a")).crossJoin(reads.select(F.col("read_id").alias("read_b"))).where("read_a < read_b").withColumn("strand", F.lit(0))
    before = bytes_written(spark)
    g, _ = graph.build_graph(reads, pairs)
    assert g.edges.count() == n * (n - 1) // 2
    assert bytes_written(spark) - before < 400_000  # 719,400 edges


def test_contained_makes_no_row_for_edges(spark):
    """each edge met all successors of its end, the cube of the reads that share a passage."""
    n = 1500
    lengths = [1000 - i % 7 for i in range(n)]
    rows = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"), F.lit(0).alias("strand")).where("src < dst")
    packed = adjacency.adjacent(rows)
    nodes = graph.node_columns(spark.createDataFrame(list(enumerate(lengths)), "id long, length_bp long"))
    assert sorted(r.id for r in graph.contained(graph.Graph(nodes, None, packed)).collect()) == [i for i in range(n) if i % 7]


def test_overlaps_of_an_assembly_can_be_left_unwritten(spark):
    """overlaps were kept, whole, for a query that reads none of them."""
    reads = tables.reads(spark, "/root/testdata/sf0.001").select("read_id", "seq")
    found = [pipelines.assemble(reads, overlapping=Overlap(max_overlaps=None), keep=k) for k in (True, False)]
    assert [any("overlaps" in f for f in a.overlaps.inputFiles()) for a in found] == [True, False]
    for get in (lambda a: a.overlaps, lambda a: a.graph.nodes, lambda a: a.paths):
        one, two = (sorted(map(str, get(a).collect())) for a in found)
        assert one == two and one
