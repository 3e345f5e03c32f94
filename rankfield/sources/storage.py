"""Where intermediate tables and stream logs go."""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ONCE: dict[tuple[str, str, str], DataFrame] = {}
_HELD: dict[tuple[str, str, str], object] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the cluster's shared folder; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rankfield-")
    return f"{folder.rstrip('/')}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later steps do not compute it again.

    The files are deleted when the session's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of the tables in ``sf_dir``, kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ONCE:
        _ONCE[key] = kept(build(), name)
    return _ONCE[key]


def held[T](spark: SparkSession, sf_dir: str, name: str, build: Callable[[], T]) -> T:
    """The fitted model, or other small value of the driver, that ``build`` makes once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _HELD:
        _HELD[key] = build()
    return _HELD[key]
