"""A Spark session with the settings the plans expect."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Staged tables that have not been dropped: the session and the path.
_STAGED: list[tuple[SparkSession, str]] = []


def session(app: str = "folioscope", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = 100_000, size: int = 64 << 20) -> DataFrame:
    """Marks df for broadcast if it has at most `rows` rows of at most `size` bytes, about; beyond that Spark joins by shuffle.

    Meant for sides that are cheap to count: staged tables, dimension tables, batches of queries, aggregates.
    """
    width = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
            item = F.length(F.array_join(f.name, "")) if isinstance(inner, T.StringType) else F.lit(16) * F.size(f.name)
            width = width + F.coalesce(item, F.lit(0))
    some = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("size")).first()
    return F.broadcast(df) if some.n <= rows and (some["size"] or 0) <= size else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it; a local one is set only where none is named (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped_at_exit(spark: SparkSession, path: str) -> None:
    if not _STAGED:
        atexit.register(release)
    _STAGED.append((spark, path))


def release() -> None:
    """Drops what has been staged so far. A long session calls it when the results that rest on it have been written."""
    while _STAGED:
        _drop(*_STAGED.pop())


def drop_staged(df: DataFrame) -> None:
    """Drops the staged table that df reads, of which nothing is read any more, before the others."""
    names = {x for file in df.inputFiles() for x in file.split("/")}
    for x in [x for x in _STAGED if x[1].rpartition("/")[2] in names]:
        _STAGED.remove(x)
        _drop(*x)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass
