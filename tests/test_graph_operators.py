"""Graph operators against brute force on random graphs, and known shapes."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.config import Conservation
from kinloom.operators import bubbles, compaction, conservation, graph
from kinloom.operators.numbering import numbered

RND = random.Random(5)
EDGES = "edge_idx long, src long, dst long, read_support long"


def make(spark, lengths, edges, support=None):
    nodes = spark.createDataFrame([(i, n, (support or {}).get(i, 1)) for i, n in enumerate(lengths)], "id long, length_bp long, read_support long")
    rows = [(k, *e, 1) if len(e) == 2 else (k, *e) for k, e in enumerate(edges)]
    return graph.Graph(graph.node_columns(nodes), graph.edge_columns(spark.createDataFrame(rows, EDGES)))


def random_graph(n, m):
    return [RND.choice([50, 80, 500, 900]) for _ in range(n)], [(RND.randrange(n), RND.randrange(n), RND.randint(1, 9)) for _ in range(m)]


def slow_contained(lengths, edges):
    after = {v: {e[1] for e in edges if e[0] == v} for v in range(len(lengths))}
    return {v for p, v, *_ in edges if p != v and lengths[p] > lengths[v] and all(w == p or w in after[p] for w in after[v])}


def slow_transitive(lengths, edges, fuzz):
    last = {(a, c): i for i, (a, c, *_) in enumerate(edges)}
    return {last[a, c] for a, b, *_ in edges for x, c, *_ in edges if x == b and c not in (a, b) and (a, c) in last and lengths[b] <= fuzz}


@pytest.mark.parametrize("n,m", [(8, 20), (15, 40), (30, 60)])
def test_filter_against_brute_force(spark, n, m):
    lengths, edges = random_graph(n, m)
    g = make(spark, lengths, edges)
    assert {r.id for r in graph.contained(g).collect()} == slow_contained(lengths, edges)
    assert {r.edge_idx for r in graph.transitive(g, 100).collect()} == slow_transitive(lengths, edges, 100)
    kept, stats = graph.filter_graph(g)
    gone = slow_contained(lengths, edges)
    left = [(i, e) for i, e in enumerate(edges) if e[0] not in gone and e[1] not in gone]
    red = {left[k][0] for k in slow_transitive(lengths, [e for _, e in left], 100)}
    assert {r.edge_idx for r in kept.edges.collect()} == {i for i, _ in left} - red
    assert stats == {"edges_before": m, "edges_after": len(left) - len(red), "nodes_dropped_contained": len(gone), "transitive_edges_removed": len(red)}


def test_filter_shapes(spark):
    assert {r.id for r in graph.contained(make(spark, [5000, 500, 5000], [(0, 1), (0, 2)])).collect()} == {1}
    g = make(spark, [1000] * 3, [(0, 1), (1, 2), (0, 2)])
    assert {r.edge_idx for r in graph.transitive(g, 2000).collect()} == {2}
    assert graph.transitive(make(spark, [500] * 3, [(0, 1), (1, 2), (0, 2)]), 10).count() == 0
    assert graph.filter_graph(make(spark, [], []))[1]["edges_after"] == 0


def slow_chains(n, edges):
    out, into = [0] * n, [0] * n
    for a, b, *_ in edges:
        out[a] += 1
        into[b] += 1
    step = {a: b for a, b, *_ in edges if out[a] == 1 and into[b] == 1}
    back = {b: a for a, b in step.items()}
    found, seen = {}, set()
    for v in range(n):
        if v not in back:
            u, k = v, 0
            while u is not None:
                found[u], k = (v, k, False), k + 1
                seen.add(u)
                u = step.get(u)
    for v in range(n):
        if v not in seen:
            u, k = v, 0
            while u not in seen:
                found[u], k = (v, k, True), k + 1
                seen.add(u)
                u = step[u]
    return found


@pytest.mark.parametrize("n,m", [(20, 14), (40, 36), (60, 50)])
def test_chains(spark, n, m):
    targets = RND.sample(range(n), m)
    edges = list(zip(RND.sample(range(n), m), targets)) + [(0, 1), (2, 2)]
    got = {r.node: (r["head"], r.place, r.in_cycle) for r in compaction.linear_chains(make(spark, [100] * n, edges)).collect()}
    assert got == slow_chains(n, edges)


def test_ring_of_chains(spark):
    edges = [(i, (i + 1) % 7) for i in range(7)] + [(10, 11), (11, 12)]
    got = {r.node: (r["head"], r.place, r.in_cycle) for r in compaction.linear_chains(make(spark, [9] * 13, edges)).collect()}
    assert got == slow_chains(13, edges)


def tournament(n):
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


@pytest.mark.parametrize("lengths,edges,count", [([19000] * 6, tournament(6), 1), ([9000, 19000, 19000, 19000], tournament(4), 2), ([4000] * 3 + [9000] * 5, [], 2), ([7], [], 1)])
def test_compaction_shapes(spark, lengths, edges, count):
    out, to = compaction.compact(make(spark, lengths, edges))
    assert out.nodes.count() == count and to.count() == len(lengths)
    if count == 1:
        assert out.edges.count() == 0


def test_compaction_sums(spark):
    g = make(spark, [100, 200, 300, 100], [(0, 1), (1, 2), (2, 3)], {0: 3, 1: 5, 2: 1, 3: 4})
    seqs = spark.createDataFrame([(0, "ACGT"), (1, "ACGA"), (2, "ACCA"), (3, "TC")], "id long, seq string")
    out, _ = compaction.compact(g, seqs)
    assert [(r.length_bp, r.read_support, r.consensus) for r in out.nodes.collect()] == [(700, 13, "ACGA")]


def slow_bubbles(edges, most=8):
    after = {}
    for a, b, s in edges:
        after.setdefault(a, []).append((b, s))

    def reach(start):
        out, stack = {}, [(start, (), 0)]
        while stack:
            node, path, support = stack.pop()
            if node != start:
                out.setdefault(node, (path, support))
            if len(path) < most:
                stack += [(b, (*path, b), support + s) for b, s in after.get(node, ())]
        return out

    found = {}
    for entry, ways in after.items():
        within = [reach(b) for b, _ in ways]
        for i in range(len(ways)):
            for j in range(i + 1, len(ways)):
                for exit_ in within[i].keys() & within[j].keys() - {entry}:
                    b = found.setdefault((entry, exit_), [0, {}])
                    b[0] = ways[i][1] + ways[j][1]
                    for k in (i, j):
                        path, support = within[k][exit_]
                        nodes = (ways[k][0], *path)
                        b[1][nodes] = max(b[1].get(nodes, 0), ways[k][1] + support)
    return {k: (s, sorted(alts.items())) for k, (s, alts) in found.items()}


@pytest.mark.parametrize("n,m,most", [(9, 16, 8), (12, 20, 4), (8, 14, 3)])
def test_bubbles(spark, n, m, most):
    edges = [(a, b, RND.randint(1, 9)) for a, b in ((RND.randrange(n), RND.randrange(n)) for _ in range(m))]
    edges = [(min(a, b), max(a, b), s) for a, b, s in edges if a != b]  # without cycles
    got = {(r.entry, r.exit): (r.total_read_support, [(tuple(x.nodes), x.support) for x in r.alts]) for r in bubbles.detect_bubbles(make(spark, [1] * n, edges), most).collect()}
    assert got == slow_bubbles(edges, most)


def test_bubble_shapes(spark):
    diamond = bubbles.detect_bubbles(make(spark, [9] * 4, [(0, 1, 10), (0, 2, 10), (1, 3, 10), (2, 3, 10)])).collect()
    assert [(r.entry, r.exit, len(r.alts)) for r in diamond] == [(0, 3, 2)]
    arms = [(0, 1), *((i, i + 1) for i in range(1, 21)), (0, 30), *((i, i + 1) for i in range(30, 50)), (21, 60), (50, 60)]
    assert bubbles.detect_bubbles(make(spark, [1] * 61, arms), 4).count() == 0
    assert bubbles.detect_bubbles(make(spark, [1] * 3, [(0, 1), (1, 2), (0, 2)])).count() == 0


def slow_sweeps(n, edges, cn, c):
    flow = [float(e[2]) for e in edges]
    out, into = [sum(e[0] == v for e in edges) for v in range(n)], [sum(e[1] == v for e in edges) for v in range(n)]

    def residuals():
        return [sum(f for f, e in zip(flow, edges) if e[0] == v) - cn[v] * sum(f for f, e in zip(flow, edges) if e[1] == v) for v in range(n)]

    total = lambda r: sum(abs(x) for v, x in enumerate(r) if out[v] and into[v])
    now, k = residuals(), 0
    while k < c.max_sweeps and total(now) >= c.epsilon:
        flow = [max(0.0, f - c.damping * now[e[0]] / out[e[0]]) if out[e[0]] and into[e[0]] and abs(now[e[0]]) >= c.node_tolerance else f for f, e in zip(flow, edges)]
        before, now, k = total(now), residuals(), k + 1
        if not total(now) < before:
            break
    return flow, k, total(now)


def test_conservation(spark):
    edges = [(RND.randrange(7), RND.randrange(7), RND.randint(1, 30)) for _ in range(15)]
    g = make(spark, [1] * 7, edges)
    flow, sweeps, left = slow_sweeps(7, edges, [1.0] * 7, Conservation())
    report = conservation.conserve(g)
    assert report.sweeps == sweeps and report.residual == pytest.approx(left)
    assert [r.flow for r in report.edge_flow.orderBy("edge_idx").collect()] == pytest.approx(flow)


def test_conservation_hints(spark):
    edges = [(0, 1, 10), (1, 2, 10), (1, 3, 10), (2, 4, 10), (3, 4, 10), (4, 5, 20)]
    g = make(spark, [1000] * 6, edges)
    found = bubbles.detect_bubbles(g)
    plain = conservation.conserve(g, found)
    assert {r.node for r in plain.node_violations.collect()} == {1}
    hinted = conservation.conserve(g, found, spark.createDataFrame([(1, 2.0)], "id long, relative_cn double"))
    assert hinted.node_violations.count() == 0 and hinted.converged
    assert {(r.entry, r.exit) for r in hinted.bubble_violations.collect()} == {(1, 4), (1, 5)}


def test_graph_from_overlaps(spark):
    reads = spark.createDataFrame([(7, 100), (42, 200), (50, 5)], "read_id long, length_bp long")
    found = spark.createDataFrame([(7, 42, 30, 0, 70, 0, 1), (7, 99, 0, 0, 9, 0, 0), (42, 50, 9, 0, 5, 0, 0)], "read_a long, read_b long, offset_a int, offset_b int, overlap_len int, diff_count int, strand int")
    g, to = graph.build_graph(reads, found)
    assert {(r.read_id, r.node) for r in to.collect()} == {(7, 0), (42, 1), (50, 2)}
    assert [(r.src, r.dst, r["flags"]) for r in g.edges.orderBy("edge_idx").collect()] == [(0, 1, 16), (1, 2, 0)]
    paths = {r.read_id: r.path for r in graph.read_paths(reads, to, found).collect()}
    assert paths == {7: [0, 1], 42: [1, 0, 2], 50: [2, 1]}
    assert graph.reads_of_nodes(graph.read_paths(reads, to, found)).where("node = 1").count() == 3


@pytest.mark.parametrize("parts", [1, 8])
def test_numbers_do_not_depend_on_partitions(spark, parts):
    df = spark.range(0, 5000, 1, 5).select((F.col("id") * 7919 % 5003).alias("k")).repartition(parts)
    got = numbered(df, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(5000))
