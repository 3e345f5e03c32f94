"""Raw listings and session documents, and the SQL that reads their texts."""

from pyspark.sql import functions as F

from rankfield.sources.views import view

DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
COUNT = f"coalesce(TRY_CAST(nullif({DIGITS.format('{0}')}, '') AS BIGINT), 0)"
UNIT = "regexp_extract(lower(trim({0})), '^([0-9]+(?:\\.[0-9]+)?)\\s*([kmb])\\+?$', {1})"
COMPACT = (
    "coalesce(CAST(round(TRY_CAST(nullif(" + UNIT.format("{0}", 1) + ", '') AS DOUBLE) * CASE " + UNIT.format("{0}", 2) + " WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 END) AS BIGINT), TRY_CAST(nullif("
    + DIGITS.format("{0}") + ", '') AS BIGINT))"
)
STORE_DATE = "CAST(try_strptime(nullif(regexp_extract(trim({0}), '^([A-Z][a-z][a-z] [0-9]+, [0-9]+)$', 1), ''), '%b %d, %Y') AS DATE)"
ISO_DATE = "TRY_CAST(nullif(regexp_extract(trim({0}), '^([0-9]+-[0-9]+-[0-9]+)', 1), '') AS DATE)"
YEAR_ONLY = "nullif(regexp_extract(trim({0}), '^((?:19|20)[0-9][0-9])$', 1), '')"


def raw(spark, sf_dir):
    return view(spark, sf_dir, "fx_raw")


def sessions(spark, sf_dir):
    """Nested session documents: a page a brand, some of them grouped, some deep."""
    row = F.struct(F.col("pkg").alias("package"), "title", F.col("installs_text").alias("installs"))
    lists = raw(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ordinal", row.alias("r")))).alias("x"))
    listed = F.transform("x", lambda x: x["r"])
    plain = F.to_json(F.struct(F.struct(F.col("page").alias("keyword"), listed.alias("apps")).alias("found")))
    deep = F.to_json(F.struct(F.array(F.struct(F.col("page").alias("seed_keyword"), F.struct(listed.alias("semantic_matches")).alias("market_proof"))).alias("steps")))
    grouped = F.to_json(F.struct(F.col("page").alias("keyword"), listed.alias("qualifying")))
    kind = F.length("page") + F.ascii(F.substring("page", -1, 1))
    return lists.select(F.col("page").alias("doc"), F.when(kind % 3 == 0, plain).when(kind % 3 == 1, deep).otherwise(grouped).alias("json"))
