"""Session helpers shared by every operator: building a session, shared-folder materialisation, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of values a side may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def build_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioform")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session; a temporary one only where that is unset (local tests)."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    at = tempfile.mkdtemp(prefix="folioform-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{at}")
    return f"file://{at}"


#: Tables this process has written to the shared folder.
_written: list[str] = []


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables materialize() has written from the ``since``-th on; call it once their results are stored. Returns how many were deleted."""
    n, jvm = 0, spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it results are made and stored; at its end the tables written within it are deleted, and no others."""
    before = len(_written)
    try:
        yield
    finally:
        release(spark, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(name: str, kind: str):
    """Bytes of a column's value, 16 for each item of an array."""
    c = F.col(f"`{name}`")
    return F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 16 if kind.startswith("array") else F.lit(16), F.lit(0)).cast("bigint")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows and the bytes of their values: beyond ``rows`` or ``size`` the side is left to a
    shuffle join with adaptive skew handling. The side is read for it, so a costly one is materialised before."""
    width = sum((_bytes(n, k) for n, k in df.dtypes), F.lit(0))
    n, b = df.select(width.alias("_w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("_w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= size else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
