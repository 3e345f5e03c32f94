import datetime as dt

from pyspark.sql import functions as F

from rankfield.sources.versioned import VersionedTable
from rankfield.streaming import jobs

SCHEMA = "keyword string, pkg string, observed_at timestamp, position int, installs double"


def stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    (tmp_path / "in").mkdir()
    for i in range(len(batches)):
        for part in sorted((tmp_path / f"in{i}").glob("part-*")):
            part.rename(tmp_path / "in" / f"{i}-{part.name}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def at(day, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, minutes=minute)


def drain(rows, tmp_path, mode="append"):
    spark = rows.sparkSession
    name = f"out{abs(hash(str(tmp_path)))}"
    rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_transitions_across_batches(spark, tmp_path):
    pages = [{"a": 1, "b": 2}, {"a": 2, "c": 1}, {"a": 2}]
    rows = stream(spark, tmp_path, [[("k", p, at(7 * i), n, 1.0) for p, n in page.items()] for i, page in enumerate(pages)])
    got = sorted((r.pkg, r.event, r.from_position, r.to_position, r.gap_days) for r in drain(jobs.stream_transitions(rows), tmp_path))
    assert got == [("a", "moved", 1, 2, 7), ("b", "left", 2, None, 7), ("c", "entered", None, 1, 7)], "the last page waits for the next"


def test_observations_once_each(spark, tmp_path):
    rows = stream(spark, tmp_path, [[("k", "a", at(0), 1, 1.0), ("k", "a", at(0), 9, 1.0)], [("k", "a", at(0), 2, 1.0), ("k", "b", at(0), 1, 1.0)]])
    assert sorted(r.pkg for r in drain(jobs.stream_observations(rows, ["keyword", "pkg"]), tmp_path)) == ["a", "b"]


def test_latest_apps_last_write_wins(spark, tmp_path):
    rows = stream(spark, tmp_path, [[("k", "a", at(0), 1, 1.0)], [("k", "a", at(2), 1, 3.0), ("k", "b", at(0), 1, 5.0)], [("k", "a", at(1), 1, 2.0)]])
    running = jobs.stream_latest_apps(rows.select("pkg", "observed_at", "installs"), str(tmp_path / "out"), str(tmp_path / "log"), ["pkg"], "observed_at").trigger(availableNow=True).start()
    running.awaitTermination()
    assert sorted((r.pkg, r.installs) for r in jobs.latest_table(spark, f"{tmp_path}/out").collect()) == [("a", 3.0), ("b", 5.0)]
    assert jobs.latest_table(spark, f"{tmp_path}/out", 1).count() == 1, "the table as it was before the second batch"


def test_windows_growth_and_sessions(spark, tmp_path):
    batches = [[("k", "a", at(0), 1, 1.0), ("k", "b", at(0, 5), 2, 3.0)], [("k", "a", at(0, 60), 1, 5.0)], [("k", "a", at(40), 1, 9.0)]]
    rows = stream(spark, tmp_path, batches)
    (tmp_path / "w").mkdir()
    closed = drain(jobs.stream_field_state(rows), tmp_path / "w")
    assert [(r.n, r.installs_p50) for r in closed] == [(3, 3.0)]
    (tmp_path / "s").mkdir()
    assert sorted(r.n for r in drain(jobs.stream_page_sessions(rows), tmp_path / "s")) == [1, 2]
    (tmp_path / "g").mkdir()
    grown = {r.pkg: (r.least, r.most, r.n) for r in drain(jobs.stream_measured_growth(rows), tmp_path / "g", "complete")}
    assert grown == {"a": (1.0, 9.0, 3), "b": (3.0, 3.0, 1)}
    assert jobs.as_stream_time(spark.range(1).select(F.lit("2024-01-01").alias("t")), "t").dtypes == [("t", "timestamp")]


def test_fifty_batches_leave_one_copy_of_each_part(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.versions() == []
    part = F.pmod(F.xxhash64("k"), F.lit(4)).cast("int")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    want = {}
    for i in range(50):
        rows = [(f"k{(i + j) % 12}", i) for j in range(2)]
        want |= dict(rows)
        new = frame(rows)
        touched = [r.p for r in new.select(part.alias("p")).distinct().collect()]
        old = table.read(i, touched)
        both = new if old is None else old.select("k", "v").join(new, "k", "left_anti").unionByName(new)
        table.replace(both.withColumn("part", part), i)
    assert {r.k: r.v for r in table.read().collect()} == want
    files = [f for f in (tmp_path / "t/data").rglob("*.parquet")]
    assert len(table.read().inputFiles()) <= 4 and len(files) <= 8 and table.versions() == [48, 49]


def test_a_killed_batch_runs_again_to_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, part int")
    table.replace(frame([("a", 1, 0), ("b", 1, 1)]), 0)
    # batch 1 wrote a copy and died before its manifest
    frame([("a", 99, 0), ("half", 2, 0)]).write.partitionBy("part").parquet(f"{path}/data/version=1")
    assert {(r.k, r.v) for r in table.read().collect()} == {("a", 1), ("b", 1)}
    for _ in range(2):  # again, and once more after its manifest
        assert {(r.k, r.v) for r in table.read(1, [0]).collect()} == {("a", 1)}
        table.replace(frame([("a", 2, 0)]), 1)
        assert {(r.k, r.v) for r in table.read().collect()} == {("a", 2), ("b", 1)}
