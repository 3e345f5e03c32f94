"""Tokens, title relevance and vector expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELEVANT = 0.40


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def exact_match(title: Column, keyword: Column) -> Column:
    """Every keyword token is a title token; an empty keyword is true."""
    return F.size(F.array_except(tokens(keyword), tokens(title))) == 0


def lexical_relevance(title: Column, short: Column, long: Column, keyword: Column) -> Column:
    """Mean token score (title 1, short 0.6, long 0.35) times the share of tokens found."""

    def score(t: Column) -> Column:
        return F.when(F.array_contains(tokens(title), t), 1.0).when(F.array_contains(tokens(short), t), 0.6).when(F.array_contains(tokens(long), t), 0.35).otherwise(0.0)

    per = F.transform(tokens(keyword), score)
    total = F.aggregate(per, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(per) == 0, 0.0).otherwise(total / F.size(per) * (F.size(F.filter(per, lambda x: x > 0)) / F.size(per)))


def blended_relevance(lexical: Column, keyword_vector: Column, app_vector: Column) -> Column:
    semantic = F.greatest(F.lit(0.0), dot(keyword_vector, app_vector))
    return F.when(keyword_vector.isNull() | app_vector.isNull(), lexical).otherwise(0.6 * lexical + 0.4 * semantic)


def title_position_features(title: Column, short: Column, long: Column, keyword: Column) -> dict[str, Column]:
    kw, ti, sd, de = tokens(keyword), tokens(title), tokens(short), tokens(long)
    n = F.greatest(F.size(ti), F.lit(1))
    hits = F.filter(ti, lambda t: F.array_contains(kw, t))
    first = F.array_min(F.transform(F.array_distinct(kw), lambda t: F.nullif(F.array_position(ti, t), F.lit(0).cast("long"))))
    found = F.size(F.filter(de, lambda t: F.array_contains(kw, t))).cast("double")
    all_in = lambda where: F.when((F.size(kw) > 0) & (F.size(F.array_except(kw, where)) == 0), 1.0).otherwise(0.0)
    return {
        "kw_in_title": all_in(ti),
        "kw_title_pos": F.when(first.isNull(), 0.0).otherwise(1.0 - (first - 1) / n),
        "kw_density_title": F.size(hits) / n,
        "kw_in_short": all_in(sd),
        "kw_desc_tf": found / (found + 1.5),
    }


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 if either is missing."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def embedding_text(title: Column, short: Column, long: Column) -> Column:
    body = F.substring(F.trim(F.regexp_replace(F.coalesce(long, F.lit("")), r"\s+", " ")), 1, 240)
    return F.concat_ws(". ", title, F.concat_ws(" ", short, body))


def title_contains_phrase(title: Column, keyword: Column) -> Column:
    return F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lower(F.trim(keyword)))


def hashed_trigram_vectors(texts: DataFrame, text: str, size: int = 384) -> DataFrame:
    """(text, vector): signed hashing of trigrams, unit length; one row per distinct text.

    The place and the sign of a trigram come from its MD5, which other engines know.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    known = texts.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_t", plain)
    grams = F.when(F.length("_t") < 3, F.array("_t")).otherwise(F.transform(F.sequence(F.lit(1), F.length("_t") - 2), lambda i: F.substring(F.col("_t"), i, F.lit(3))))
    hashed = known.select(text, F.explode(grams).alias("_g")).withColumn("_h", F.md5("_g"))
    number = lambda a, n: F.conv(F.substring("_h", a, n), 16, 10).cast("long")
    at, sign = F.pmod(number(1, 15), F.lit(size)), F.when(number(16, 2) % 2 == 1, 1.0).otherwise(-1.0)
    sums = hashed.groupBy(text, at.alias("_at")).agg(F.sum(sign).alias("_x"))
    packed = sums.groupBy(text).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_x"))).alias("_m"), F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    cell = lambda i: F.coalesce(F.try_element_at(F.col("_m"), i.cast("long")), F.lit(0.0)) / F.greatest(F.col("_norm"), F.lit(1e-9))
    return packed.select(text, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell).alias("vector"))


def uncached(texts: DataFrame, cache: DataFrame, text: str, prefix: str = "", encoder: str = "trigram") -> DataFrame:
    """(key, text) of the distinct texts that the cache does not hold for this encoder."""
    keyed = texts.select(text).where(F.col(text).isNotNull()).distinct().withColumn("key", F.sha2(F.concat(F.lit(prefix), F.col(text)), 256))
    return keyed.join(cache.where(F.col("encoder") == encoder).select("key"), "key", "left_anti").select("key", text)
