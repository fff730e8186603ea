"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, token ids.

Each stage takes all documents that its predecessor kept, and what it decides takes effect. n_chars is that
of the text as it stands after the stage. In all stages a null text is an empty one, which the quality rules reject; a
null id is no document for what is counted over documents, and its row stays unless the stage rejects the text itself;
rows that repeat an id are judged each by its text, but for near-duplicates, where they are one document; an empty table
gives an empty table; columns besides COLUMNS are left behind.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.config import Written, dealt, drop_path, few_or_all, settled
from kinloom.llm import bpe_codec, decontamination, line_dedup, quality_rules, simhash
from kinloom.llm.common import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, a row at a time: those with null or empty texts among them."""
    return quality_rules.quality(docs, carry=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but from the last of these. A null text stays null; rows with a null id
    keep all lines; rows that repeat an id count once and lose lines each."""
    told = docs.select(*COLUMNS, F.col("text").isNull().alias("none"))
    out = line_dedup.line_dedup(told, carry=("lang", "source", "n_chars", "none"))
    text = F.when(~F.col("none"), F.col("kept_text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, similarity of 0.8 or more) that with the least
    id stays. Rows with a null id stay; texts without words are alike."""
    gone = Written(simhash.similar_groups(docs).where("component_id <> doc_id").select("doc_id"), "gone", few=True)
    return docs.select(*COLUMNS).join(few_or_all(gone.df), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: all rows of an id if one of them does. Rows with a null id stay."""
    held = Written(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "held", few=True)
    return docs.select(*COLUMNS).join(few_or_all(held.df), "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: their number and digest, and the digest of the text decoded from them. A row for each row;
    a null text has none."""
    return bpe_codec.round_trip(docs)


STAGES = [("quality", quality), ("lines", lines), ("near-duplicates", near_duplicates), ("decontamination", benchmark_free), ("tokens", tokens)]
#: The automaton and the sets of shingles can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what its predecessor kept, with a written table between stages. What a stage wrote on its way,
    and the table that it read, are deleted when its own is there."""
    docs, before = dealt(table(spark, sf_dir, "documents")).select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name)
        if before is not None:
            drop_path(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
