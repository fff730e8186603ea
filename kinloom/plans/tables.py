"""The tables as reads, regions, graphs, candidates and calls; in Spark, and as common table expressions that
give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import dealt
from ..operators.graph import Graph, edge_columns, node_columns
from ..operators.numbering import numbered

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
PART_ID, BRAND_ID = 1_000_000_000_000, 2_000_000_000_000  # what parts' and brands' node ids begin at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq, lang, source): each document's letters as bases."""
    seq = F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]+", "")), LETTERS, BASES)
    return dealt(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("read_id"), seq.alias("seq"), "lang", "source")


READS = f"reads AS (SELECT doc_id AS read_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq, lang, source FROM documents)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, chrom, start, end, name, mean_coverage): a region for each part and return flag."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    mean = lines.groupBy("l_returnflag", "l_partkey").agg(F.avg("l_quantity").alias("mean_coverage"))
    start = F.col("l_partkey") * 100
    return mean.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("row_idx"), F.col("l_returnflag").alias("chrom"), start.alias("start"), (start + 150).alias("end"), F.col("p_type").alias("name"), "mean_coverage")


REGIONS = """regions AS (SELECT l_partkey AS row_idx, l_returnflag AS chrom, l_partkey * 100 AS "start", l_partkey * 100 + 150 AS "end", p_type AS name, mean_coverage
    FROM (SELECT l_returnflag, l_partkey, avg(l_quantity) AS mean_coverage FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey)"""


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end, class, family): a repeat for each part, on two chroms, reaching over two regions."""
    part = table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 100 + 30
    return part.select(F.explode(F.array(F.lit("A"), F.lit("N"))).alias("chrom"), start.alias("start"), (start + F.col("p_size") * 5 + 20).alias("end"), F.col("p_type").alias("class"), F.col("p_brand").alias("family"))


REPEATS = """repeats AS (SELECT unnest(['A', 'N']) AS chrom, p_partkey * 100 + 30 AS "start", p_partkey * 100 + 50 + p_size * 5 AS "end", p_type AS class, p_brand AS family FROM part)"""


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders to their parts (support: the quantity), parts to their brands (support: the lines)."""
    lines, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    brand = (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long") + BRAND_ID).alias("brand")
    nodes = orders.select(F.col("o_orderkey").alias("id"), (1000 + F.col("o_orderkey") % 1000).alias("length_bp"), F.lit(60).alias("read_support"), F.lit(1).alias("copy_count"))
    nodes = nodes.union(part.select(F.col("p_partkey") + PART_ID, F.col("p_size") * 40, F.lit(10), F.lit(1)))
    nodes = nodes.union(part.select(brand).distinct().select("brand", F.lit(700), F.lit(20), F.lit(2)))
    first = lines.groupBy(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + PART_ID).alias("dst")).agg(F.sum("l_quantity").cast("long").alias("read_support"))
    second = lines.groupBy("l_partkey").agg(F.count("*").alias("read_support")).join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_partkey") + PART_ID).alias("src"), brand.alias("dst"), "read_support")
    return Graph(node_columns(nodes), edge_columns(numbered(first.unionByName(second), ["src", "dst"], "edge_idx")))


ORDER_GRAPH = f"""nodes AS (SELECT o_orderkey AS id, 1000 + o_orderkey % 1000 AS length_bp, 60 AS read_support, 1 AS copy_count FROM orders
        UNION ALL SELECT p_partkey + {PART_ID}, p_size * 40, 10, 1 FROM part
        UNION ALL SELECT DISTINCT {BRAND_ID} + regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT, 700, 20, 2 FROM part),
    links AS (SELECT l_orderkey AS src, l_partkey + {PART_ID} AS dst, sum(l_quantity)::BIGINT AS read_support FROM lineitem GROUP BY ALL
        UNION ALL SELECT l_partkey + {PART_ID}, {BRAND_ID} + regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey),
    edges AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_idx, * FROM links)"""


def triangle_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The order graph, and an edge from each order to the brand of each of its parts (some are parallel)."""
    g = order_graph(spark, sf_dir)
    lines, part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct(), table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long") + BRAND_ID
    direct = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), brand.alias("dst"), (F.col("l_partkey") + 1).alias("tag"))
    every = g.edges.select("src", "dst", F.lit(0).cast("long").alias("tag")).unionByName(direct)
    return Graph(g.nodes, edge_columns(numbered(every, ["src", "dst", "tag"], "edge_idx")))


TRIANGLES = f"""{ORDER_GRAPH},
    direct AS (SELECT DISTINCT l_orderkey AS src, {BRAND_ID} + regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS dst, l_partkey + 1 AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
    tri AS (SELECT row_number() OVER (ORDER BY src, dst, tag) - 1 AS edge_idx, src, dst FROM (SELECT src, dst, 0 AS tag FROM edges UNION ALL SELECT src, dst, tag FROM direct))"""


def chain_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders as nodes; each customer's orders, in turn, as a chain; urgent orders that are open in part have a second successor."""
    orders = table(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    nodes = orders.select(F.col("o_orderkey").alias("id"), (500 + F.col("o_orderkey") % 3 * 100).alias("length_bp"), (1 + F.col("o_orderkey") % 7).alias("read_support"), (1 + F.col("o_orderkey") % 2).alias("copy_count"))
    step = orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(by).alias("dst"), F.lead("o_orderkey", 3).over(by).alias("far"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("twice"))
    edges = step.where("dst IS NOT NULL").select("src", "dst").union(step.where("far IS NOT NULL AND twice").select("src", "far"))
    return Graph(node_columns(nodes), edge_columns(numbered(edges.withColumn("read_support", F.col("src") % 5 + 1), ["src", "dst"], "edge_idx")))


CHAIN_GRAPH = """nodes AS (SELECT o_orderkey AS id, 500 + o_orderkey % 3 * 100 AS length_bp, 1 + o_orderkey % 7 AS read_support, 1 + o_orderkey % 2 AS copy_count FROM orders),
    step AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS dst, lead(o_orderkey, 3) OVER w AS far, o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS twice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    links AS (SELECT src, dst FROM step WHERE dst IS NOT NULL UNION ALL SELECT src, far FROM step WHERE far IS NOT NULL AND twice),
    edges AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_idx, src, dst, src % 5 + 1 AS read_support FROM links)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bubble's features for each user and hour of events: shares and means of the values."""
    e = table(spark, sf_dir, "events")
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)).alias(kind)
    g = e.groupBy("user_id", F.hour("ts").alias("hour")).agg(n("click"), n("view"), n("error"), n("signup"), F.count("*").alias("n"), F.sum("value").alias("v"), F.max("value").alias("m"))
    r = lambda x, name: F.round(x, 9).alias(name)
    return g.select(
        (F.col("user_id") * 24 + F.col("hour")).alias("bubble_id"), F.col("click").alias("support_first"), F.col("view").alias("support_alt"),
        r(F.col("click") / F.greatest(F.lit(1), F.col("n") - F.col("error")), "flank"), r(F.col("v") / F.col("n") / 25, "depth"), r(F.col("view") / F.greatest(F.lit(1), F.col("click") + F.col("view")), "span"),
        F.when(F.col("signup") > 1, 1.0).otherwise(0.0).alias("segdup"), F.when(F.col("error") > 2, 1.0).otherwise(0.0).alias("repeat"), F.floor(F.col("m") * 10).cast("long").alias("length"),
    )


CANDIDATES = """candidates AS (SELECT user_id * 24 + hour AS bubble_id, click AS support_first, view_ AS support_alt,
        round(click / greatest(1, n - error), 9) AS flank, round(v / n / 25, 9) AS depth, round(view_ / greatest(1, click + view_), 9) AS span,
        CASE WHEN signup > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS segdup, CASE WHEN error > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS repeat_, floor(m * 10)::BIGINT AS length
    FROM (SELECT user_id, hour(ts) AS hour, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view_, count(*) FILTER (event_type = 'error') AS error,
        count(*) FILTER (event_type = 'signup') AS signup, count(*) AS n, sum(value) AS v, max(value) AS m FROM events GROUP BY ALL))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, node_id, length_bp, est_copy_count, read_support): parts as called nodes."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), F.col("p_partkey").alias("node_id"), (F.col("p_size") * 137).cast("long").alias("length_bp"), (F.col("p_partkey") % 4).cast("int").alias("est_copy_count"), F.floor("p_retailprice").cast("long").alias("read_support"))


CALLS = "calls AS (SELECT p_partkey AS row_idx, p_partkey AS node_id, p_size * 137 AS length_bp, p_partkey % 4 AS est_copy_count, floor(p_retailprice)::BIGINT AS read_support FROM part)"


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): each part's name, its letters as bases."""
    seq = F.translate(F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")), LETTERS, BASES)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("read_id"), seq.alias("seq"))


PART_NAMES = f"names AS (SELECT p_partkey AS read_id, translate(lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM part)"
