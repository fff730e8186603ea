"""Parameters of the operators with their defaults, and the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sketch:
    k: int = 21
    w: int = 19


@dataclass(frozen=True)
class Overlap:
    min_matches: int = 5
    offset_tolerance: int = 100
    strand_majority: float = 0.80
    #: Overlaps kept, in the order of the reads' ids (None: all). A limit that leaves some out says how many.
    max_overlaps: int | None = None
    #: Minimizers found in more reads than this are left out (None: none are).
    max_bucket: int | None = None
    #: Minimizers found in more reads than this are crowded: no pair is made for them where a rarer one tells as much.
    crowded: int = 1000


@dataclass(frozen=True)
class Cascade:
    min_length: float = 500
    flank_exit: float = 0.99
    depth_dup: float = 2.0
    span: float = 0.5
    prior: float = 0.5
    mixed_flank: float = 0.70
    mixed_depth: float = 1.50
    emit: float = 0.50


@dataclass(frozen=True)
class Disambiguator:
    flank_mid: float = 0.80
    depth_one: float = 1.0
    depth_two: float = 2.0
    span_mid: float = 0.50
    prior: float = 0.50
    slope: float = 12.0
    w_flank: float = 0.35
    w_depth: float = 0.35
    w_span: float = 0.20
    w_prior: float = 0.10
    split_flank: float = 0.90
    split_span: float = 0.60
    split_depth: float = 0.40
    dup_depth: float = 1.50
    mixed_flank: float = 0.70
    mixed_depth: float = 1.30
    emit: float = 0.50
    depth_limit: int = 1
    min_length: float = 500


@dataclass(frozen=True)
class Conservation:
    max_sweeps: int = 10
    epsilon: float = 1e-3
    node_tolerance: float = 0.5
    bubble_tolerance: float = 1.0
    damping: float = 0.5


#: (name, lower end, not included, upper end, included) of each band of allele fractions.
BANDS = (("(0, 0.05]", 0.0, 0.05), ("(0.05, 0.10]", 0.05, 0.10), ("(0.10, 0.25]", 0.10, 0.25), ("(0.25, 0.50]", 0.25, 0.50), ("(0.50, 1.0]", 0.50, 1.0))
VAF_MATCH = 0.10
LENGTH_BUCKET = 500
FLANK_BP, FLANK_K = 155, 31
MAX_ALT_PATH = 8
FUZZ = 100
UINT32 = 4_294_967_295


_ROOT = Path(__file__).resolve().parents[1]
PACKAGE = __package__.split(".")[0]
_shipped: set[str] = set()


#: Rows in an Arrow batch, where the session has Spark's default: rows hold whole texts or sequences, and a batch is
#: in memory several times over, in the JVM and in Python.
BATCH_ROWS = 1024
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors that don't share the driver's folders, and Arrow batches small."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    roots = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    here = str(_ROOT)
    app = spark.sparkContext.applicationId
    if app in _shipped or here in roots or os.path.realpath(os.getcwd()) == here:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted((_ROOT / PACKAGE).rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    at = Path(tempfile.mkdtemp()) / f"{__package__.split('.')[0]}.zip"  # Spark's file server hands it out
    at.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. One of our own only where that is unset and all tasks run
    in this machine's session (local mode), as in tests; a cluster without a shared folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix=f"{PACKAGE}-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    return named.rstrip("/")


_kept: dict[str, list[str]] = {}  # by application, the folders written and not yet deleted


_open = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; cleared() deletes it, if drop_path() hasn't before."""
    path = f"{shared_dir(spark)}/{PACKAGE}-{name}-{uuid.uuid4().hex}"
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths = _kept.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)


def cleared(spark: SparkSession) -> None:
    """Deletes every folder this application has written for itself: to be called once results have been saved, as
    tables that were returned may still be read from there."""
    for path in list(_kept.get(spark.sparkContext.applicationId, [])):
        drop_path(spark, path)


class Written:
    """A table written to the shared folder and read again: its lineage ends here, and lost executors do not
    matter to what comes after. One of few bytes a task is written by no more tasks than run at once, as many
    small files cost more than what is in them."""

    def __init__(self, df: DataFrame, name: str, few: bool = False):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        (df.coalesce(self.spark.sparkContext.defaultParallelism) if few else df).write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str, few: bool = False) -> DataFrame:
    """What make() returns, written; the tables that it wrote on its way are deleted."""
    _open.scopes = [*getattr(_open, "scopes", []), []]
    try:
        out = Written(make(), name, few)
    finally:
        scope = _open.scopes.pop()
    for path in scope:
        if path != out.path:
            drop_path(spark, path)
    if _open.scopes:
        _open.scopes[-1].append(out.path)
    return out.df


#: Bytes up to which a table is broadcast by Spark's own estimate, where the estimate can't be trusted.
ESTIMATED = 256 * 1024
_THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@contextmanager
def counted_broadcasts(spark: SparkSession):
    """While this is open, hardly more than what is counted (few_or_all) is broadcast. Spark takes a written table for as large
    as its files, an array for one element, and a table whose rows are exploded for no larger than before: what it then
    broadcasts below its default of 10 MB may be a hundred times that, on the driver first."""
    before = spark.conf.get(_THRESHOLD)
    if _bytes(spark, before) <= ESTIMATED:
        yield
        return
    spark.conf.set(_THRESHOLD, str(ESTIMATED))
    try:
        yield
    finally:
        spark.conf.set(_THRESHOLD, before)


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size.lstrip("-")) * (-1 if size.startswith("-") else 1)


def few_or_all(ids: DataFrame, most: int = 1 << 19) -> DataFrame:
    """A written table of ids for a join: broadcast if they are counted to be at most so many, else as it is."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as there are: for work that costs far more than the shuffle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def dealt(df: DataFrame) -> DataFrame:
    """A table as it was read; but if it is in fewer files than there are cores, its rows dealt out evenly, as
    a small file is one task however long its rows take. Large tables are in many files and aren't moved."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df
