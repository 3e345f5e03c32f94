"""Sources, sinks and normalisation of listings and archived pages."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.functions import parse

PAGE_KEY = ["keyword", "country", "observed_at", "source"]
# Names under which session documents keep a page's apps: fixed values.
LIST_NAMES = ("apps", "top_apps", "results", "semantic_matches", "top_apps_sample")
GROUPED_NAMES = ("qualifying", "non_qualifying")


def normalize_listings(raw: DataFrame) -> DataFrame:
    """Either payload shape to one: installs, rating and reviews from the first usable column."""
    return raw.select(
        "pkg", "title",
        parse.first_truthy(F.col("installs_real"), F.col("installs_min"), F.col("installs_shown")).alias("installs"),
        F.coalesce(F.nullif("score", F.lit(0.0)), F.col("rating"), F.lit(0.0)).alias("rating"),
        parse.first_truthy(F.col("ratings_count"), F.col("reviews_count")).alias("reviews"),
        parse.parse_store_date(F.col("released_text")).alias("released_at"),
    )


def assign_organic_positions(results: DataFrame) -> DataFrame:
    """Only the leading run of featured entries has no position; the rest count from 1."""
    order = Window.partitionBy("page").orderBy("ordinal")
    lead = F.bool_and("featured").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = results.withColumn("_lead", lead)
    place = F.sum((~F.col("_lead")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("position", F.when(~F.col("_lead"), place)).drop("_lead")


def merge_details(results: DataFrame, details: DataFrame, key: str = "pkg") -> DataFrame:
    """A detail value wins wherever it is not null."""
    d = details.select(key, *[F.col(c).alias(f"_d_{c}") for c in details.columns if c != key])
    joined = results.join(d, key, "left")
    shared = set(details.columns) - {key}
    return joined.select(*[F.coalesce(f"_d_{c}", c).alias(c) if c in shared else F.col(c) for c in results.columns])


def supplement_thin_results(primary: DataFrame, fallback: DataFrame, thin: int = 5) -> DataFrame:
    """Pages with fewer than ``thin`` rows gain the fallback's other packages, if it is longer."""
    have = primary.groupBy("page").agg(F.count("*").alias("_have"))
    more = fallback.groupBy("page").agg(F.count("*").alias("_more"))
    short = more.join(have, "page", "left").where((F.coalesce("_have", F.lit(0)) < thin) & (F.col("_more") > F.coalesce("_have", F.lit(0))))
    extra = fallback.join(short.select("page"), "page", "left_semi").join(primary.select("page", "pkg"), ["page", "pkg"], "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(extra.withColumn("origin", F.lit("fallback")))


def _walk(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every (doc, path, variant node) of JSON documents, at any depth."""
    # LIMIT ALL: the default stops at a million nodes, which a large archive passes
    return spark.sql(
        """
        WITH RECURSIVE nodes(doc, path, key, v) AS (
            SELECT doc, '$', CAST(NULL AS STRING), v FROM {parsed}
            UNION ALL
            SELECT n.doc, concat(n.path, '/', coalesce(e.key, CAST(e.pos AS STRING))), e.key, e.value FROM nodes n, LATERAL variant_explode(n.v) e
        ) SELECT doc, path, key, v FROM nodes LIMIT ALL""",
        parsed=docs.select("doc", F.try_parse_json("json").alias("v")),
    )


def extract_session_pages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc, path, keyword, ordered, ordinal, pkg, title, installs) of every page found.

    A page is a node that holds a keyword beside a list of apps under a known name,
    directly or in ``market_proof``; else beside grouped lists, which carry no order.
    """
    nodes = _walk(spark, docs)
    text = lambda p: F.try_variant_get("v", p, "string")
    holders = nodes.withColumn("keyword", F.lower(F.trim(F.coalesce(text("$.keyword"), text("$.seed_keyword"))))).where("keyword is not null")
    listed = lambda p: F.try_variant_get("v", p, "array<variant>")
    ordered = F.coalesce(*[listed(f"$.{n}") for n in LIST_NAMES], listed("$.market_proof.semantic_matches"))
    grouped = F.concat(*[F.coalesce(listed(f"$.{n}"), F.array().cast("array<variant>")) for n in GROUPED_NAMES])
    found = holders.withColumn("_o", ordered).withColumn("_g", grouped)
    found = found.select("doc", "path", "keyword", F.col("_o").isNotNull().alias("ordered"), F.coalesce("_o", "_g").alias("_apps")).where(F.size("_apps") > 0)
    rows = found.select("doc", "path", "keyword", "ordered", F.posexplode("_apps").alias("ordinal", "a"))
    of = lambda p, kind="string": F.try_variant_get("a", p, kind)
    return rows.select("doc", "path", "keyword", "ordered", "ordinal", F.coalesce(of("$.package"), of("$.appId")).alias("pkg"), of("$.title").alias("title"), parse.parse_compact_count(of("$.installs")).alias("installs"))


def parse_text_sample(rows: DataFrame, sample: str) -> DataFrame:
    """'Name 5M, Other 1M' to ordered rows; parts without a count are dropped."""
    parts = rows.select("*", F.posexplode(F.split(sample, ",")).alias("ordinal", "_part"))
    pattern = r"^\s*(.*\S)\s+([0-9][0-9.,]*\s*[kKmMbB]?\+?)\s*$"
    read = parts.withColumn("title", F.regexp_extract("_part", pattern, 1)).withColumn("installs", parse.parse_compact_count(F.regexp_extract("_part", pattern, 2)))
    return read.where("title <> '' and installs is not null").drop("_part", sample)


def dedupe_page_apps(rows: DataFrame) -> DataFrame:
    """First row of each app on a page; the key is the package, else the title."""
    keyed = rows.withColumn("_key", F.coalesce(F.nullif("pkg", F.lit("")), F.nullif(F.lower("title"), F.lit("")))).where("_key is not null")
    order = Window.partitionBy("page", "_key").orderBy("ordinal")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_key")


def prefer_measured_installs(real: Column, shown: Column, display: Column) -> Column:
    count = lambda c: F.nullif(parse.parse_compact_count(c.cast("string")), F.lit(0).cast("long"))
    return F.coalesce(count(real), count(shown), count(display))


def widest_copy_wins(pages: DataFrame) -> DataFrame:
    """One page per (keyword, day): most apps, then the first."""
    order = Window.partitionBy("keyword", "day").orderBy(F.desc("n_apps"), "seq")
    return pages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def infer_order_is_rank(rows: DataFrame) -> DataFrame:
    """Per page: null below three counts or where installs never rise, else true; grouped lists false."""
    order = Window.partitionBy("page").orderBy("ordinal")
    steps = rows.where("installs is not null").withColumn("_fall", F.col("installs") <= F.lag("installs").over(order))
    marks = steps.groupBy("page").agg(F.count("*").alias("_n"), F.bool_and(F.coalesce("_fall", F.lit(True))).alias("_sorted"))
    flat = rows.groupBy("page").agg(F.bool_and("ordered").alias("_ordered")).join(marks, "page", "left")
    return flat.select("page", F.when(~F.col("_ordered"), False).when((F.coalesce("_n", F.lit(0)) < 3) | F.col("_sorted"), F.lit(None).cast("boolean")).otherwise(True).alias("order_is_rank"))


def replace_pages(archive: DataFrame, pages: DataFrame) -> DataFrame:
    """The archive with the given pages' rows replaced; writing twice changes nothing."""
    return archive.join(pages.select(*PAGE_KEY).distinct(), PAGE_KEY, "left_anti").unionByName(pages)


def archive_scraped_pages(observations: DataFrame, apps: DataFrame) -> DataFrame:
    """Observed pages as archive rows; rank is counted again from 1."""
    rows = observations.where("position is not null").join(apps.select("pkg", "title", "installs"), "pkg")
    order = Window.partitionBy("keyword", "country", "observed_at").orderBy("position", "pkg")
    return rows.select("keyword", "country", "observed_at", F.lit("scrape").alias("source"), "pkg", "title", "installs", F.row_number().over(order).alias("rank"), F.lit(True).alias("order_is_rank"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last write per key replaces all columns; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in old.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(version, "_new")).alias("_x"))
    return last.select(*key, *[F.col(f"_x.{c}").alias(c) for c in columns]).select(*old.columns)


def append_once(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """First write per key wins."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def clean_keyword(keyword: Column) -> Column:
    return F.lower(F.trim(keyword))


def lookup_override(rows: DataFrame, overrides: DataFrame, field: str, value: str) -> DataFrame:
    """A hand-set value of ``field`` in place of the computed one."""
    o = overrides.where(F.col("field") == field).select("keyword", F.col("value").alias("_v"))
    return rows.join(o, "keyword", "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


OVERRIDE_KEY = ["keyword", "country", "field"]


def upsert_overrides(overrides: DataFrame, new: DataFrame, at: str = "set_at") -> DataFrame:
    """Hand-set values, the last one set for each (keyword, country, field)."""
    return upsert(overrides, new.withColumn("keyword", clean_keyword(F.col("keyword"))), OVERRIDE_KEY, at)


def replace_suggestions(old: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """A query's ordered list replaces its rows; ``fetched`` has (query, suggestions)."""
    query = F.trim(F.regexp_replace(F.lower("query"), r"\s+", " "))
    new = fetched.select(query.alias("query"), F.posexplode("suggestions").alias("position", "suggestion"))
    new = new.select("query", F.lit("us").alias("country"), F.col("position").cast("long").alias("position"), F.lower(F.trim("suggestion")).alias("suggestion"), F.lit(as_of).cast("date").alias("fetched_at"))
    return old.join(new.select("query").distinct().hint("merge"), "query", "left_anti").select(*new.columns).unionByName(new)


def copy_intersecting(source: DataFrame, target_columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns both sides have, and the ones left out."""
    shared = sorted(set(source.columns) & set(target_columns))
    return source.select(*shared), sorted(set(source.columns) ^ set(target_columns))


def import_dated_cache(cache: DataFrame, current: DataFrame, as_of: str) -> DataFrame:
    """Cached rows at their own date, with the current row of the same apps."""
    now = current.join(cache.select("pkg").distinct(), "pkg", "left_semi").select("pkg", F.lit(as_of).cast("date").alias("observed_at"), "installs", F.lit("scrape").alias("source"))
    return cache.select("pkg", "observed_at", "installs", F.lit("research").alias("source")).unionByName(now).dropDuplicates(["pkg", "observed_at"])


def import_report(merged: DataFrame) -> DataFrame:
    """One row: dated points after an import, apps, and apps with two points or more, whose growth can be measured."""
    per_app = merged.groupBy("pkg").agg(F.count_distinct("observed_at").alias("_n"), F.count("*").alias("_rows"))
    return per_app.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("points"), F.count("*").alias("apps"), F.count_if(F.col("_n") > 1).alias("apps_with_two_points"))


def fill_missing(apps: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Set ``column`` only where it is null, from the lowest value found for the app."""
    first = found.where(F.col(column).isNotNull()).groupBy("pkg").agg(F.min(column).alias("_f"))
    return apps.join(first, "pkg", "left").withColumn(column, F.coalesce(column, "_f")).drop("_f")


def publisher_targets(listing: DataFrame) -> DataFrame:
    """(keyword, pkg) of a publisher's titles; the first package of each keyword."""
    rows = listing.where("pkg is not null and pkg <> ''").select(parse.keyword_from_title(F.col("headline")).alias("keyword"), "pkg", "ordinal").where("keyword is not null")
    return rows.groupBy("keyword").agg(F.min_by("pkg", "ordinal").alias("pkg"))
