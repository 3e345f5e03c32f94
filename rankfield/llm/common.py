"""Shared column expressions and storage helpers of the corpus operators.

Words everywhere are maximal runs of characters outside space, tab, line feed,
vertical tab, form feed and carriage return.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain alias can be inlined by the optimizer into a lambda, where it would
    be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of words; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    """Number of words, as a long, without building the words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def text_key(text: Column) -> Column:
    """64-bit key of a text; null and empty texts differ."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def md5_place(*parts: Column) -> Column:
    """A 60-bit hash that other SQL engines can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def row_name(key: Column, text_key: Column) -> Column:
    """What a row is dealt by: its id, or its text's key where the id is null."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("#"), text_key.cast("string")))


def group_key(column: Column) -> Column:
    """A non-null equi-join key for a nullable string column."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


def storage_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def temporary(spark: SparkSession, path: str) -> str:
    """``path``, which exists, is deleted when the session's process ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are removed as it ends, not when the driver
    happens to collect garbage; the result is written, so nobody reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result no longer depends on any executor."""
    storage_dir(df.sparkSession)
    with _shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made in here is released


def first_row(df: DataFrame) -> Row | None:
    """The first row of a small result."""
    with _shuffles_released(df.sparkSession):
        return df.select("*").first()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{storage_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(temporary(spark, path))


def join_split(big: DataFrame, small: DataFrame, keys: list[str], count: str, spread: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join on ``keys``, each once in ``small``, with keys of many rows dealt over several tasks.

    ``count`` in ``small`` is how many of the ``rows`` rows of ``big`` a key has. A key
    with more than 1 in 4,096 of them (1,000 at least) is split by a hash of ``spread``,
    so at most 4,096 such keys, a proven bound, are broadcast.
    """
    most = max(1_000, rows // 4_096)
    splits = F.ceil(F.col(count) / most).cast("int")
    hot = small.where(F.col(count) > most).select(*keys, splits.alias("_splits"))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_split", F.pmod(F.xxhash64(*spread), F.coalesce("_splits", F.lit(1))).cast("int")).drop("_splits")
    right = small.withColumn("_split", F.explode(F.sequence(F.lit(0), splits - 1))).drop(count)
    return left.join(right.hint("merge"), [*keys, "_split"], how).drop("_split")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
