"""Autocomplete analytics over (query, position, suggestion, fetched_at) rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULTS = {"sugg_returned": 0.0, "sugg_self_listed": 0.0, "sugg_self_rank": 1.0, "sugg_is_canonical": 0.0, "sugg_extends": 0.0, "sugg_extra_words": 0.0, "sugg_unrelated": 0.0}


def plain_query(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))


def suggestion_list(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", "suggestion")))
    return rows.groupBy("query").agg(F.transform(ordered, lambda x: x["suggestion"]).alias("suggestions"))


def suggestion_age(rows: DataFrame, as_of: str, ttl_hours: float = 24.0) -> DataFrame:
    """Whole days x 24 since the last fetch, and whether that is within the limit."""
    age = F.datediff(F.lit(as_of).cast("date"), F.max("fetched_at")) * 24.0
    return rows.groupBy("query").agg(age.alias("age_hours"), (age < ttl_hours).alias("is_fresh"))


def fresh_or_stale(stored: DataFrame, fetched: DataFrame, as_of: str, ttl_hours: float = 24.0) -> DataFrame:
    """A query's stored rows while fresh, else the fetched ones if there are any."""
    state = suggestion_age(stored, as_of, ttl_hours).select("query", F.col("is_fresh").alias("_fresh"))
    news = fetched.select("query").distinct().withColumn("_new", F.lit(True))
    pick = state.join(news, "query", "full").select("query", (~F.coalesce("_fresh", F.lit(False)) & F.coalesce("_new", F.lit(False))).alias("_use_new"))
    old = stored.join(pick.where("not _use_new"), "query", "left_semi").withColumn("origin", F.lit("stored"))
    return old.unionByName(fetched.join(pick.where("_use_new"), "query", "left_semi").withColumn("origin", F.lit("fetched")))


def suggestion_signals(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """Counts and proportions of each keyword's own list; keywords without one get defaults."""
    q, s, n = F.col("query"), F.col("suggestion"), F.count("*")
    extends = (s != q) & s.contains(q)
    extra = F.size(F.split(s, r"\s+")) - F.size(F.split(q, r"\s+"))
    self_rank = F.min(F.when(s == q, F.col("position")))
    found = rows.groupBy("query").agg(
        (n / 10.0).alias("sugg_returned"), self_rank.isNotNull().cast("double").alias("sugg_self_listed"), F.coalesce(self_rank / n, F.lit(1.0)).alias("sugg_self_rank"),
        F.coalesce((self_rank == 0).cast("double"), F.lit(0.0)).alias("sugg_is_canonical"), (F.count_if(extends) / n).alias("sugg_extends"),
        F.coalesce(F.avg(F.when(extends, extra)), F.lit(0.0)).alias("sugg_extra_words"), (F.count_if(~s.contains(q)) / n).alias("sugg_unrelated"),
    ).withColumnRenamed("query", "keyword")
    return keywords.select("keyword").distinct().join(found, "keyword", "left").fillna(DEFAULTS)


def suggestion_detail(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", "suggestion")))
    lists = rows.groupBy("query").agg(F.min(F.when(F.col("suggestion") == F.col("query"), F.col("position"))).alias("self_rank"), F.transform(ordered, lambda x: x["suggestion"]).alias("_all"))
    q = F.col("query")
    return lists.select("query", "self_rank", F.filter("_all", lambda s: (s != q) & s.contains(q)).alias("extends"), F.filter("_all", lambda s: ~s.contains(q)).alias("unrelated"))


def expansion_seeds(keywords: DataFrame) -> DataFrame:
    """(keyword, seed): the phrase and its head, alone and with each letter."""
    kw, words = F.col("keyword"), F.split("keyword", " ")
    heads = F.when(F.size(words) > 1, F.array(kw, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))).otherwise(F.array(kw))
    letters = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: F.concat(F.lit(" "), F.char(i)))
    tails = F.concat(F.array(F.lit("")), letters)
    return keywords.select("keyword", F.explode(heads).alias("_h")).select("keyword", F.explode(F.transform(tails, lambda t: F.concat(F.col("_h"), t))).alias("seed"))


def harvest_family(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, phrase): every suggestion of every seed, without the keyword."""
    seeds = expansion_seeds(keywords)
    return seeds.join(rows.hint("merge"), seeds["seed"] == rows["query"]).select("keyword", F.col("suggestion").alias("phrase")).where("phrase <> keyword").distinct()


def next_words(family: DataFrame, most: int = 12) -> DataFrame:
    """Words that follow the keyword in its family, by count, then word."""
    kw, words = F.split("keyword", " "), F.split("phrase", " ")
    follows = family.where((F.size(words) > F.size(kw)) & (F.slice(words, 1, F.size(kw)) == kw)).select("keyword", F.element_at(words, F.size(kw) + 1).alias("word"))
    counts = follows.groupBy("keyword", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("keyword").orderBy(F.desc("n"), "word")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def partition_family(family: DataFrame) -> DataFrame:
    """Class of each phrase: longer, contains, siblings or other; the first that fits."""
    kw, p, words = F.col("keyword"), F.col("phrase"), F.split("keyword", " ")
    head = F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(kw)
    kind = F.when(p.startswith(F.concat(kw, F.lit(" "))), "longer").when(p.contains(kw), "contains").when(p.startswith(F.concat(head, F.lit(" "))) | (p == head), "siblings").otherwise("other")
    return family.withColumn("kind", kind)
