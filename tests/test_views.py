"""The derivation of the pages in Spark against the text that SQL engines run."""

import random
from datetime import datetime

from rankfield.sources import views


def write_tables(spark, folder):
    """Names of one word, none and many spaces, null names, keys and dates, repeated keys, tied sums."""
    rng = random.Random(3)
    names = [f"{a} {b}" for a in ("hot", "blue", "red") for b in ("bolt", "ring", "hot")] + ["hot", "", None, "a  b", "red ring large", " bolt"]
    parts = [(i, names[i % len(names)]) for i in range(600)] + [(5, "blue ring"), (5, "hot"), (None, "hot bolt")]
    dates = [datetime(y, 5, 1) for y in (1995, 1996, 2001)] + [None]
    lines = [(rng.choice([None, *range(500)]), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice(dates)) for _ in range(4_000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")


def test_pages_are_ranked_by_word_before_parts_meet_keywords(spark, tmp_path):
    write_tables(spark, tmp_path)
    got, want = views._derived(spark, str(tmp_path), "fx_observations"), views._of_text(spark, str(tmp_path), "fx_observations")
    assert got.dtypes == want.dtypes and got.count() > 500
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, "exploded words are joined by key"
    assert "WindowGroupLimit [t#" in plan, "a word's rows are cut to a page in the tasks that read them"
