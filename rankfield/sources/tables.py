"""Stored tables that jobs keep between runs: bucketed, choose-once, content-addressed, copied.

All of them are Parquet under a path in the cluster's shared folder. A table that is not
there yet is empty.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.operators.features import group_split


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def bucketed(df: DataFrame, name: str, path: str, by: str, sort: list[str], buckets: int = 32) -> DataFrame:
    """``df`` as a table of ``buckets`` files by ``by``, each sorted by ``sort``.

    An equality on ``by`` then reads one file, and in it the row groups that hold the
    value; joins on ``by`` with a table of as many buckets need no shuffle.
    """
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(*sort).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def publisher_table(apps: DataFrame, name: str, path: str, buckets: int = 32) -> DataFrame:
    """The apps with a publisher, for ``state.publisher_catalogue`` to look up."""
    return bucketed(apps.where(F.trim("developer") != ""), name, path, "developer", ["developer", "pkg"], buckets)


def stored_holdout(rows: DataFrame, path: str, fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """``rows`` with ``held_out`` by keyword, chosen on the first run and kept at ``path``.

    The first run splits the keywords that it has. A later run appends its new keywords
    to the store as keywords that train, so that the holdout never changes. A keyword
    that two runs append at once is there twice with the same answer.
    """
    spark, schema = rows.sparkSession, "keyword string, held_out boolean"
    known = read_or_empty(spark, path, schema)
    words = rows.select("keyword").where("keyword is not null").distinct()
    if known.isEmpty():
        group_split(words, fraction, seed).select("keyword", "held_out").write.mode("append").parquet(path)
    else:
        words.join(known, "keyword", "left_anti").withColumn("held_out", F.lit(False)).write.mode("append").parquet(path)
    chosen = read_or_empty(spark, path, schema).groupBy("keyword").agg(F.bool_or("held_out").alias("held_out"))
    return rows.join(chosen, "keyword", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def encode_cached(texts: DataFrame, text: str, path: str, encode: Callable[[DataFrame, str], DataFrame], encoder: str, prefix: str = "") -> tuple[DataFrame, int]:
    """((key, text, vector) of each distinct text, how many were encoded now).

    ``encode`` gives (text, vector) of the texts that the store at ``path`` does not hold
    for ``encoder``; these are appended under the hash of ``prefix`` and the text.
    """
    spark, schema = texts.sparkSession, "key string, vector array<double>, encoder string"
    keyed = texts.select(text).where(F.col(text).isNotNull()).distinct().withColumn("key", F.sha2(F.concat(F.lit(prefix), F.col(text)), 256))
    held = lambda: read_or_empty(spark, path, schema).where(F.col("encoder") == encoder).select("key", "vector")
    before = held()
    unseen = keyed.join(before.select("key").hint("merge"), "key", "left_anti")
    n = unseen.count()
    if n:
        vectors = encode(unseen, text).join(unseen.hint("merge"), text).select("key", F.col("vector").cast("array<double>").alias("vector"), F.lit(encoder).alias("encoder"))
        vectors.write.mode("append").partitionBy("encoder").parquet(path)
    # two runs that append one key at once wrote the same vector twice
    return keyed.join(held().groupBy("key").agg(F.first("vector").alias("vector")).hint("merge"), "key").select("key", text, "vector"), n


def copy_tables(tables: dict[str, DataFrame], targets: dict[str, list[str]], path: str) -> DataFrame:
    """Replace each table under ``path`` by the columns that it shares with its target.

    ``targets`` has the columns of each target table. Reports (table_name, copied_rows,
    copied_columns, skipped_columns), the rows as counted in the target; a table that has
    no target, or none of whose columns is shared, is reported with none copied.
    """
    spark, report = next(iter(tables.values())).sparkSession, []
    for name, source in sorted(tables.items()):
        wanted = targets.get(name, [])
        shared, skipped = sorted(set(source.columns) & set(wanted)), sorted(set(source.columns) ^ set(wanted))
        n = 0
        if shared:
            source.select(*shared).write.mode("overwrite").parquet(f"{path}/{name}")
            n = spark.read.parquet(f"{path}/{name}").count()
        report.append((name, n, shared, skipped))
    return spark.createDataFrame(report, "table_name string, copied_rows long, copied_columns array<string>, skipped_columns array<string>")


def read_database(spark: SparkSession, url: str, table: str, column: str, partitions: int, **options: str) -> DataFrame:
    """A database table by JDBC, read in ``partitions`` ranges of a whole-number ``column``."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    ends = spark.read.format("jdbc").options(url=url, query=f"SELECT min({name}) AS lo, max({name}) AS hi FROM {table}", **options).load().first()
    if ends[0] is None:
        return reader.option("dbtable", table).load()
    return reader.options(dbtable=table, partitionColumn=column, lowerBound=str(int(ends[0])), upperBound=str(int(ends[1]) + 1), numPartitions=str(partitions)).load()


def replace_in_database(df: DataFrame, url: str, table: str, target: list[str], **options: str) -> list[str]:
    """Write the columns that ``df`` shares with ``target`` in place of a table's rows; returns what was skipped."""
    df.select(*sorted(set(df.columns) & set(target))).write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode("overwrite").save()
    return sorted(set(df.columns) ^ set(target))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables agree in the columns that they share, by count and an order-free checksum."""
    columns = sorted(set(a.columns) & set(b.columns))
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return digest(a) == digest(b)
