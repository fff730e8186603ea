"""What the text operators share: input columns, shared folders, shipping of the code, word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Written, few_or_all, new_path, settled, ship  # noqa: F401

#: Texts that an Arrow function takes at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone: other columns, whatever their names, are left behind."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def opened(uri: str, write: bool = False):
    """A file of the shared folder, from any task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None) if write else system.open_input_file(path)


_kept: dict = {}


def kept(name, make):
    """What an operator keeps in a Python worker from task to task: make() when it is first asked for. A worker keeps
    the state of one operator alone; that of another one is let go."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


class WordHashes(dict):
    """word (bytes) -> XXH64, unsigned; remembers up to `limit` words."""

    def __init__(self, seed: int = 0, limit: int = 1 << 16):
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h


def texts(column) -> Iterable[str]:
    """The texts of an Arrow column, null as empty."""
    return ("" if x is None else x for x in column.to_pylist())


def by_batch(make) -> callable:
    """mapInArrow's function from one that maps (id column, texts) to a dict of further columns."""
    import pyarrow as pa

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # few texts at a time are Python objects
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_pydict({"id": part.column(0)} | make(list(texts(part.column(1)))))

    return mapped


def field_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
