"""Ranked-page inputs derived from the star-schema test tables.

An app is a part, a keyword a two-word part name, a snapshot a ship year. The text of
every view says its rows in any SQL engine, so that both sides of a comparison read the
same; Spark runs the text too, but for ``fx_observations``, which it gets by
``observed_pages``. ``AS_OF`` is the clock: nothing calls the current date.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.sources.storage import once

AS_OF = "2001-12-31"

VIEWS = {
    "fx_apps": """
WITH s AS (SELECT l_partkey, CAST(SUM(l_quantity) AS BIGINT) AS q, COUNT(*) AS n,
                  MAX(CAST(l_shipdate AS DATE)) AS mx
           FROM lineitem GROUP BY l_partkey)
SELECT concat('p', CAST(p_partkey AS VARCHAR(20))) AS pkg, p_partkey,
       p_name AS title, lower(p_type) AS short_desc,
       concat(p_name, ' ', lower(p_brand), ' ', lower(p_type)) AS description,
       p_brand AS developer, p_type AS category,
       CAST(COALESCE(q, 0) * (1 + (p_partkey * 7919) % 1000) AS BIGINT) AS installs,
       CAST(10 + p_size % 41 AS DOUBLE) / 10 AS rating,
       CAST(COALESCE(n, 0) AS BIGINT) AS reviews,
       CASE WHEN p_partkey % 11 = 0 THEN NULL
            ELSE DATE '1995-01-01' + CAST((p_partkey * 37) % 2550 AS INT) END AS released_at,
       mx AS updated_at
FROM part LEFT JOIN s ON l_partkey = p_partkey""",
    "fx_observations": """
WITH kw AS (SELECT DISTINCT p_name AS keyword FROM part),
tok AS (SELECT keyword, split_part(keyword, ' ', 1) AS t FROM kw
        UNION SELECT keyword, split_part(keyword, ' ', 2) FROM kw),
pt AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS t FROM part
       UNION SELECT p_partkey, split_part(p_name, ' ', 2) FROM part),
cand AS (SELECT DISTINCT keyword, p_partkey FROM tok JOIN pt ON tok.t = pt.t),
yr AS (SELECT l_partkey, year(l_shipdate) AS y, SUM(l_quantity) AS q
       FROM lineitem GROUP BY l_partkey, year(l_shipdate)),
r AS (SELECT keyword, y, p_partkey,
             row_number() OVER (PARTITION BY keyword, y ORDER BY q DESC, p_partkey) AS rn,
             CASE WHEN length(keyword) % 5 = 0 THEN 1 ELSE 0 END AS promo
      FROM cand JOIN yr ON l_partkey = p_partkey),
-- the second country ranks a third of these apps, in an order of its own
c AS (SELECT keyword, 'us' AS country, y, p_partkey, rn, promo FROM r WHERE rn <= 30
      UNION ALL
      SELECT keyword, 'de', y, p_partkey, row_number() OVER (PARTITION BY keyword, y ORDER BY p_partkey), promo
      FROM r WHERE rn <= 30 AND p_partkey % 3 = 0)
SELECT keyword, country, concat('p', CAST(p_partkey AS VARCHAR(20))) AS pkg,
       CASE WHEN promo = 1 AND rn = 1 THEN NULL
            WHEN p_partkey % 89 = 0 THEN CAST(251 AS BIGINT)
            ELSE CAST(rn - promo AS BIGINT) END AS position,
       CASE WHEN p_partkey % 97 = 0 THEN 'review'
            WHEN p_partkey % 89 = 0 THEN 'owned' ELSE 'serp' END AS source,
       CASE WHEN promo = 1 AND rn = 1 THEN 1 ELSE 0 END AS featured,
       make_date(CAST(y AS INT), 12, 31) AS observed_at
FROM c""",
    "fx_app_snapshots": """
WITH m AS (SELECT l_partkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS observed_at,
                  SUM(l_quantity) AS q, COUNT(*) AS n
           FROM lineitem GROUP BY l_partkey, CAST(date_trunc('quarter', l_shipdate) AS DATE))
SELECT concat('p', CAST(l_partkey AS VARCHAR(20))) AS pkg, observed_at,
       CAST(SUM(q) OVER (PARTITION BY l_partkey ORDER BY observed_at
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS installs,
       CAST(SUM(n) OVER (PARTITION BY l_partkey ORDER BY observed_at
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS reviews
FROM m""",
    "fx_suggestions": """
WITH kw AS (SELECT DISTINCT p_name AS query FROM part),
s AS (SELECT concat(p_name, ' ', lower(p_type)) AS suggestion, COUNT(*) AS n FROM part
      GROUP BY concat(p_name, ' ', lower(p_type))
      UNION ALL SELECT p_name, COUNT(*) FROM part GROUP BY p_name),
c AS (SELECT query, suggestion,
             row_number() OVER (PARTITION BY query ORDER BY n DESC, suggestion) - 1 AS position
      FROM kw JOIN s ON contains(suggestion, query)
           OR split_part(suggestion, ' ', 2) = split_part(query, ' ', 2)
      WHERE NOT (suggestion = query AND length(query) % 4 = 0))
SELECT query, 'us' AS country, CAST(position AS BIGINT) AS position, suggestion,
       DATE '2001-12-30' AS fetched_at
FROM c WHERE position < 10""",
    # raw store payloads: counts and dates as the pages spell them, some of them dirty
    "fx_raw": """
SELECT concat('p', CAST(p_partkey AS VARCHAR(20))) AS pkg, p_partkey AS ordinal, p_name AS title, p_brand AS page,
       CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(p_size AS VARCHAR(9)), 'M')
            WHEN 2 THEN concat(CAST(p_size AS VARCHAR(9)), '.5k+') WHEN 3 THEN concat(CAST(p_size AS VARCHAR(9)), ',000+')
            WHEN 4 THEN 'soon' WHEN 5 THEN concat(' ', CAST(p_size AS VARCHAR(9)), '.2B+ ') ELSE CAST(p_size * 1000 AS VARCHAR(9)) END AS installs_text,
       CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE concat(' ', CAST(p_size % 5 AS VARCHAR(9)), '.', CAST(p_size % 10 AS VARCHAR(9))) END AS rating_text,
       CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN CAST(1990 + p_size AS VARCHAR(9))
            WHEN 3 THEN concat(CAST(1990 + p_size % 20 AS VARCHAR(9)), '-0', CAST(1 + p_size % 9 AS VARCHAR(9)), '-1', CAST(p_size % 10 AS VARCHAR(9)))
            ELSE concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(1 + 3 * (p_size % 12) AS INT), 3), ' ', CAST(1 + p_size % 28 AS VARCHAR(9)), ', ', CAST(1995 + p_size % 8 AS VARCHAR(9))) END AS released_text,
       CASE p_partkey % 4 WHEN 0 THEN concat('https://store.example/details?id=com.', lower(replace(p_name, ' ', '.')), '&hl=en')
            WHEN 1 THEN concat('https://store.example/apps/com.', lower(replace(p_name, ' ', '.'))) WHEN 2 THEN concat('com.', lower(replace(p_name, ' ', '.'))) ELSE 'plain' END AS url,
       CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size * 100 END AS BIGINT) AS installs_real,
       CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size * 90 END AS BIGINT) AS installs_min,
       CAST(p_size * 80 AS BIGINT) AS installs_shown,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) END AS score,
       CAST(p_size % 4 AS DOUBLE) AS rating,
       CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS BIGINT) AS ratings_count, CAST(p_size * 2 AS BIGINT) AS reviews_count,
       CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= length(p_brand) % 3 OR p_partkey % 13 = 0 THEN true ELSE false END AS featured,
       concat(CASE p_partkey % 3 WHEN 0 THEN 'The ' ELSE '' END, p_name, CASE p_partkey % 4 WHEN 0 THEN ': ' WHEN 1 THEN ' - ' WHEN 2 THEN ' (' ELSE ' ' END, lower(p_type), ' app free') AS headline
FROM part""",
}
TABLES = ("lineitem", "part", "orders", "customer", "events", "documents", "embeddings")
PAGE_ROWS = 30


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables in ``sf_dir``, derived once a session."""
    return once(spark, sf_dir, name, lambda: _derived(spark, sf_dir, name))


def observed_pages(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The rows of ``fx_observations``.

    A page holds the first 30 parts that share a word with its keyword. The first 30 of
    several words are among the first 30 of each, so parts are ranked word by word, and
    only those meet the keywords: not every part each keyword that shares a word with it.
    """
    words = F.explode(F.array_distinct(F.array(*[F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2)]))).alias("t")
    tok = part.select(F.col("p_name").alias("keyword")).distinct().withColumn("p_name", F.col("keyword")).select("keyword", words)
    pt = part.select("p_partkey", words).distinct()
    yr = lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))
    place = [F.desc("q"), F.col("p_partkey")]
    first = lambda rows, *page: rows.withColumn("rn", F.row_number().over(Window.partitionBy(*page, "y").orderBy(*place))).where(F.col("rn") <= PAGE_ROWS)
    top = first(pt.hint("merge").join(yr.hint("merge"), "p_partkey").select("t", "y", "q", "p_partkey"), "t").drop("rn")
    r = first(tok.hint("merge").join(top.hint("merge"), "t").select("keyword", "y", "q", "p_partkey").distinct(), "keyword")
    promo = F.when(F.length("keyword") % 5 == 0, 1).otherwise(0)
    r = r.select("keyword", "y", "p_partkey", "rn", promo.alias("promo"))
    other = F.row_number().over(Window.partitionBy("keyword", "y").orderBy("p_partkey"))
    c = r.withColumn("country", F.lit("us")).unionByName(r.where("p_partkey % 3 = 0").withColumns({"rn": other, "country": F.lit("de")}))
    promoted, absent = (F.col("promo") == 1) & (F.col("rn") == 1), F.col("p_partkey") % 89 == 0
    return c.select(
        "keyword", "country", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pkg"),
        F.when(promoted, F.lit(None)).when(absent, F.lit(251)).otherwise(F.col("rn") - F.col("promo")).cast("long").alias("position"),
        F.when(F.col("p_partkey") % 97 == 0, "review").when(absent, "owned").otherwise("serp").alias("source"),
        F.when(promoted, 1).otherwise(0).alias("featured"), F.make_date("y", F.lit(12), F.lit(31)).alias("observed_at"),
    )


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "fx_observations":
        return observed_pages(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")])
    return _of_text(spark, sf_dir, name)


def _of_text(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """``sql`` as one statement: every view that it names, in front."""
    named = [n for n in VIEWS if n in sql]
    heads = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in named)
    if not heads:
        return sql
    body = sql.strip()
    return f"WITH {heads},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {heads}\n{body}"
