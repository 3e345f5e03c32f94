"""Structured Streaming over dated observation rows (keyword, pkg, observed_at, ...)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rankfield.operators.ingest import upsert
from rankfield.sources.versioned import VersionedTable


def as_stream_time(rows: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def stream_observations(rows: DataFrame, key: list[str], time: str = "observed_at", late: str = "1 day") -> DataFrame:
    """First row of each key; rows later than the watermark are dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def latest_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table that ``stream_latest_apps`` writes, as it was ``before`` a batch if one of the kept versions is."""
    rows = VersionedTable(spark, path).read(before)
    if rows is None:
        raise ValueError(f"no batch has been written to {path}")
    return rows.drop("version", "part")


def stream_latest_apps(rows: DataFrame, path: str, checkpoint: str, key: list[str], version: str, parts: int = 64, keep: int = 8):
    """Last write wins, batch by batch, on a table dealt into ``parts`` by its key.

    A batch reads the parts that it touches and writes new copies of them; copies that the
    newest ``keep`` versions do not name go. A batch that runs again after a failure reads the
    version before it and writes the same result.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, keep)
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), version).alias("_x"))
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
        new = last.select(*key, "_x.*").select(*batch.columns)
        touched = [r.part for r in new.select(part.alias("part")).distinct().collect()]  # at most ``parts``
        if touched:
            old = table.read(number, touched)
            both = new if old is None else upsert(old.select(*new.columns), new, key, version)
            table.replace(both.withColumn("part", part), number)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def stream_field_state(rows: DataFrame, time: str = "observed_at", late: str = "1 day", width: str = "7 days", slide: str | None = None) -> DataFrame:
    """Page aggregates of each keyword in tumbling or sliding windows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = rows.withWatermark(time, late).groupBy(window, "keyword")
    return grouped.agg(F.count("*").alias("n"), F.percentile("installs", 0.5).alias("installs_p50"), F.max("installs").alias("installs_max")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "keyword", "n", "installs_p50", "installs_max")


class PageTransitions(StatefulProcessor):
    """Keeps a keyword's last page; tells entries, exits and moves when the next arrives.

    A page may come in several batches of rows; it is compared once a row with a later
    observation date arrives. The rows of the page being read are held in the state too.
    """

    def __init__(self, min_gap: int = 3):
        self.min_gap = min_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = StructType([StructField("day", IntegerType()), StructField("pkg", StringType()), StructField("position", IntegerType())])
        self.last, self.reading = handle.getListState("last", kinds), handle.getListState("reading", kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new["day"] = (new["observed_at"].astype("datetime64[s]").astype("int64") // 86_400).astype(int)
        held = [tuple(r) for r in self.reading.get()]
        known = [*held, *[(int(d), p, int(n)) for d, p, n in zip(new["day"], new["pkg"], new["position"], strict=True)]]
        last = {p: (d, n) for d, p, n in self.last.get()}
        out, days = [], sorted({r[0] for r in known})
        for day in days[:-1]:
            last = self._compare(key, last, {p: (d, n) for d, p, n in known if d == day}, out)
        self._keep(self.last, last)
        self._keep(self.reading, {p: (d, n) for d, p, n in known if d == days[-1]})
        yield pd.DataFrame(out, columns=["keyword", "pkg", "event", "from_position", "to_position", "gap_days"])

    def _compare(self, key, last: dict, page: dict, out: list) -> dict:
        if not last:
            return page
        gap = next(iter(page.values()))[0] - next(iter(last.values()))[0]
        if gap >= self.min_gap:
            for p in sorted(last.keys() | page.keys()):
                was, now = last.get(p, (0, None))[1], page.get(p, (0, None))[1]
                if was != now:
                    out.append((key[0], p, "entered" if was is None else "left" if now is None else "moved", was, now, gap))
        return page

    @staticmethod
    def _keep(state, page: dict) -> None:
        state.clear()
        if page:
            state.put([(d, p, n) for p, (d, n) in page.items()])

    def close(self) -> None:
        pass


def stream_transitions(rows: DataFrame, min_gap: int = 3) -> DataFrame:
    """Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    out = "keyword string, pkg string, event string, from_position int, to_position int, gap_days int"
    return rows.groupBy("keyword").transformWithStateInPandas(PageTransitions(min_gap), outputStructType=out, outputMode="Append", timeMode="None")


def stream_measured_growth(rows: DataFrame) -> DataFrame:
    """Running least and most installs of each app, for update mode."""
    return rows.groupBy("pkg").agg(F.min("installs").alias("least"), F.max("installs").alias("most"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("n"))


def stream_page_sessions(rows: DataFrame, time: str = "observed_at", gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Rows of one fetch grouped into a page by a gap in time."""
    grouped = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), "keyword")
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "keyword", "n")
