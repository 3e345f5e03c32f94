"""Queries over raw listings, archived pages, texts and vectors."""

import uuid

from pyspark.sql import functions as F

from rankfield.functions import parse
from rankfield.functions import text as tx
from rankfield.operators import ingest
from rankfield.plans.pages import app_vectors, apps, keyword_vectors, observations, rounded, slots
from rankfield.plans.raw import COMPACT, COUNT, ISO_DATE, STORE_DATE, YEAR_ONLY, raw, sessions
from rankfield.plans.registry import query
from rankfield.sources import tables
from rankfield.sources.storage import scratch
from rankfield.sources.views import AS_OF, view


@query(f"""SELECT pkg, title, coalesce(nullif(installs_real, 0), nullif(installs_min, 0), nullif(installs_shown, 0), 0) AS installs, coalesce(nullif(score, 0), rating, 0) AS rating,
coalesce(nullif(ratings_count, 0), nullif(reviews_count, 0), 0) AS reviews, {STORE_DATE.format('released_text')} AS released_at FROM fx_raw""")
def s1_normalize_listings(spark, sf_dir):
    return ingest.normalize_listings(raw(spark, sf_dir))


@query(f"""SELECT pkg, {COUNT.format('installs_text')} AS installs, coalesce(TRY_CAST(trim(rating_text) AS DOUBLE), 0) AS rating, {STORE_DATE.format('released_text')} AS released, {COMPACT.format('installs_text')} AS compact,
coalesce({STORE_DATE.format('released_text')}, {ISO_DATE.format('released_text')}, make_date(TRY_CAST({YEAR_ONLY.format('released_text')} AS INT), 7, 1)) AS flexible,
CASE WHEN coalesce({STORE_DATE.format('released_text')}, {ISO_DATE.format('released_text')}) IS NOT NULL THEN 'day' WHEN {YEAR_ONLY.format('released_text')} IS NOT NULL THEN 'year' END AS precision FROM fx_raw""")
def s2_s6_parsers(spark, sf_dir):
    date, precision = parse.parse_flexible_date(F.col("released_text"))
    return raw(spark, sf_dir).select("pkg", parse.parse_count(F.col("installs_text")).alias("installs"), parse.parse_float(F.col("rating_text")).alias("rating"), parse.parse_store_date(F.col("released_text")).alias("released"), parse.parse_compact_count(F.col("installs_text")).alias("compact"), date.alias("flexible"), precision.alias("precision"))


@query("""SELECT pkg, coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), ''), CASE WHEN contains(l, '.') THEN l END, trim(url)) AS package FROM (SELECT pkg, url, list_last(string_split(regexp_replace(trim(url), '[?#].*$', ''), '/')) AS l FROM fx_raw)""")
def s7_package_from_url(spark, sf_dir):
    return raw(spark, sf_dir).select("pkg", parse.package_from_url(F.col("url")).alias("package"))


@query("""SELECT page, pkg, CASE WHEN NOT lead THEN sum(CASE WHEN lead THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY ordinal ROWS UNBOUNDED PRECEDING) END::BIGINT AS position
FROM (SELECT *, bool_and(featured) OVER (PARTITION BY page ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS lead FROM fx_raw)""")
def s8_assign_organic_positions(spark, sf_dir):
    return ingest.assign_organic_positions(raw(spark, sf_dir)).select("page", "pkg", "position")


@query("SELECT w.pkg, coalesce(d.title, w.title) AS title, coalesce(d.score, w.score) AS score FROM fx_raw w LEFT JOIN (SELECT pkg, CASE WHEN p_partkey % 2 = 0 THEN upper(title) END AS title, rating AS score FROM fx_apps WHERE p_partkey % 3 = 0) d ON d.pkg = w.pkg")
def s9_merge_details(spark, sf_dir):
    details = apps(spark, sf_dir).where("p_partkey % 3 = 0").select("pkg", F.when(F.col("p_partkey") % 2 == 0, F.upper("title")).alias("title"), F.col("rating").alias("score"))
    return ingest.merge_details(raw(spark, sf_dir).select("pkg", "title", "score"), details)


@query("""WITH a AS (SELECT title AS page, pkg FROM fx_raw WHERE featured AND score >= 4), b AS (SELECT title AS page, pkg FROM fx_raw),
s AS (SELECT b.page FROM (SELECT page, count(*) AS n FROM b GROUP BY page) b LEFT JOIN (SELECT page, count(*) AS n FROM a GROUP BY page) a ON a.page = b.page WHERE coalesce(a.n, 0) < 5 AND b.n > coalesce(a.n, 0))
SELECT page, pkg, 'primary' AS origin FROM a UNION ALL SELECT page, pkg, 'fallback' FROM b WHERE page IN (SELECT page FROM s) AND NOT EXISTS (SELECT 1 FROM a WHERE a.page = b.page AND a.pkg = b.pkg)""")
def s10_supplement_thin_results(spark, sf_dir):
    """The best featured listings of a title, filled up from all of it."""
    rows = raw(spark, sf_dir)
    listing = lambda df: df.select(F.col("title").alias("page"), "pkg")
    return ingest.supplement_thin_results(listing(rows.where("featured and score >= 4")), listing(rows))


@query(f"""SELECT page AS doc, lower(page) AS keyword, (length(page) + ascii(right(page, 1))) % 3 <> 2 AS ordered, CAST(row_number() OVER (PARTITION BY page ORDER BY ordinal) - 1 AS INT) AS ordinal, pkg, {COMPACT.format('installs_text')} AS installs FROM fx_raw""")
def s11_s12_session_pages(spark, sf_dir):
    return ingest.extract_session_pages(spark, sessions(spark, sf_dir)).select("doc", "keyword", "ordered", "ordinal", "pkg", "installs")


@query("""SELECT keyword, CAST(slot - 1 AS INT) AS ordinal, title, installs FROM (SELECT keyword, slot, title || ' ' || pkg AS title, CAST(slot * 1000 AS BIGINT) AS installs FROM t_slots) WHERE slot % 3 <> 0""")
def s13_parse_text_sample(spark, sf_dir):
    part = F.concat_ws(" ", "title", "pkg", F.when(F.col("slot") % 3 != 0, F.concat(F.col("slot").cast("string"), F.lit("k"))))
    samples = slots(spark, sf_dir).groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", part.alias("p")))), lambda x: x["p"]), ", ").alias("sample"))
    return ingest.parse_text_sample(samples, "sample")


@query("SELECT page, pkg, ordinal FROM (SELECT page, pkg, ordinal, row_number() OVER (PARTITION BY page, coalesce(pkg, lower(title)) ORDER BY ordinal) AS n FROM (SELECT page, ordinal, title, CASE WHEN ordinal % 2 = 0 THEN pkg END AS pkg FROM fx_raw)) WHERE n = 1")
def s14_dedupe_page_apps(spark, sf_dir):
    return ingest.dedupe_page_apps(raw(spark, sf_dir).select("page", "ordinal", "title", F.when(F.col("ordinal") % 2 == 0, F.col("pkg")).alias("pkg"))).select("page", "pkg", "ordinal")


@query(f"SELECT pkg, coalesce(nullif(installs_real, 0), nullif(installs_min, 0), nullif({COMPACT.format('installs_text')}, 0)) AS installs FROM fx_raw")
def s15_prefer_measured_installs(spark, sf_dir):
    return raw(spark, sf_dir).select("pkg", ingest.prefer_measured_installs(F.col("installs_real"), F.col("installs_min"), F.col("installs_text")).alias("installs"))


@query("SELECT keyword, day, n_apps, seq FROM (SELECT *, row_number() OVER (PARTITION BY keyword, day ORDER BY n_apps DESC, seq) AS n FROM (SELECT keyword, make_date(CAST(year(observed_at) - year(observed_at) % 2 AS INT), 1, 1) AS day, observed_at AS seq, count(*) AS n_apps FROM fx_observations WHERE position < 20 + length(keyword) % 7 GROUP BY ALL)) WHERE n = 1")
def s16_widest_copy_wins(spark, sf_dir):
    y = F.year("observed_at")
    pages = observations(spark, sf_dir).where("position < 20 + length(keyword) % 7").groupBy("keyword", F.make_date(y - y % 2, F.lit(1), F.lit(1)).alias("day"), F.col("observed_at").alias("seq")).agg(F.count("*").alias("n_apps"))
    return ingest.widest_copy_wins(pages)


@query("""WITH p AS (SELECT keyword AS page, slot AS ordinal, CASE WHEN slot % 5 <> 0 AND slot <= 2 + length(keyword) % 6 THEN installs END AS installs, length(keyword) % 4 <> 0 AS ordered FROM t_slots)
SELECT page, CASE WHEN NOT bool_and(ordered) THEN false WHEN count(installs) < 3 OR bool_and(fall) THEN NULL ELSE true END AS order_is_rank FROM (SELECT p.page, p.ordinal, p.ordered, p.installs, CASE WHEN p.installs IS NULL THEN NULL ELSE coalesce(p.installs <= q.prev, true) END AS fall
FROM p LEFT JOIN (SELECT page, ordinal, lag(installs) OVER (PARTITION BY page ORDER BY ordinal) AS prev FROM p WHERE installs IS NOT NULL) q ON q.page = p.page AND q.ordinal = p.ordinal) GROUP BY page""")
def s17_infer_order_is_rank(spark, sf_dir):
    """Counts of a page are known to different depths; all of its rows are read."""
    known = (F.col("slot") % 5 != 0) & (F.col("slot") <= 2 + F.length("keyword") % 6)
    rows = slots(spark, sf_dir).select(F.col("keyword").alias("page"), F.col("slot").alias("ordinal"), F.when(known, F.col("installs")).alias("installs"), (F.length("keyword") % 4 != 0).alias("ordered"))
    return ingest.infer_order_is_rank(rows)


ARCHIVE = "SELECT o.keyword, o.country, o.observed_at, 'scrape' AS source, o.pkg, row_number() OVER (PARTITION BY o.keyword, o.country, o.observed_at ORDER BY o.position, o.pkg) AS rank FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg WHERE o.position IS NOT NULL"


@query(f"WITH a AS ({ARCHIVE}) SELECT keyword, observed_at, pkg, rank FROM a WHERE year(observed_at) <> 1996 UNION ALL SELECT keyword, observed_at, pkg, rank FROM a WHERE year(observed_at) = 1996 AND rank <= 3")
def s18_archive_pages(spark, sf_dir):
    archive = ingest.archive_scraped_pages(observations(spark, sf_dir), apps(spark, sf_dir))
    return ingest.replace_pages(archive, archive.where("year(observed_at) = 1996 and rank <= 3")).select("keyword", "observed_at", "pkg", "rank")


@query(f"SELECT keyword, observed_at, pkg, rank, true AS order_is_rank FROM ({ARCHIVE})")
def s19_archive_scraped_pages(spark, sf_dir):
    return ingest.archive_scraped_pages(observations(spark, sf_dir), apps(spark, sf_dir)).select("keyword", "observed_at", "pkg", "rank", "order_is_rank")


@query("SELECT a.pkg, CASE WHEN a.p_partkey % 3 = 0 THEN upper(a.title) ELSE a.title END AS title, CASE WHEN a.p_partkey % 3 = 0 THEN a.installs + 1 ELSE a.installs END AS installs, a.updated_at FROM fx_apps a")
def s20_upsert_apps(spark, sf_dir):
    old = apps(spark, sf_dir).select("pkg", "title", "installs", "updated_at", "p_partkey")
    new = old.where("p_partkey % 3 = 0").withColumn("title", F.upper("title")).withColumn("installs", F.col("installs") + 1)
    stale = old.where("p_partkey % 3 = 1").withColumn("title", F.lit("stale")).withColumn("updated_at", F.date_sub("updated_at", 1))
    return ingest.upsert(old.drop("p_partkey"), new.unionByName(stale).drop("p_partkey"), ["pkg"], "updated_at")


@query("SELECT keyword, pkg, observed_at, position FROM fx_observations WHERE year(observed_at) <= 1997 UNION ALL SELECT keyword, pkg, observed_at, position + 1 FROM fx_observations WHERE year(observed_at) > 1997")
def s21_append_observations(spark, sf_dir):
    rows = observations(spark, sf_dir)
    old = rows.where("year(observed_at) <= 1997")
    new = rows.where("year(observed_at) >= 1997").withColumn("position", F.col("position") + 1).withColumn("keyword", ingest.clean_keyword(F.concat(F.lit(" "), F.upper("keyword"))))
    return ingest.append_once(old, new, ["keyword", "country", "pkg", "observed_at"]).select("keyword", "pkg", "observed_at", "position")


@query("SELECT pkg, observed_at, installs FROM fx_app_snapshots")
def s22_append_snapshots(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_app_snapshots")
    return ingest.append_once(rows.where("observed_at < date'1997-01-01'"), rows, ["pkg", "observed_at"]).select("pkg", "observed_at", "installs")


@query("SELECT keyword, country, observed_at, CASE WHEN year(observed_at) = 1998 THEN 'research' ELSE 'scrape' END AS source, count(*) AS n_apps FROM fx_observations GROUP BY ALL")
def s23_upsert_field_history(spark, sf_dir):
    old = observations(spark, sf_dir).groupBy("keyword", "country", "observed_at").agg(F.lit("scrape").alias("source"), F.count("*").alias("n_apps"), F.lit(0).alias("version"))
    new = old.where("year(observed_at) = 1998").withColumn("source", F.lit("research")).withColumn("version", F.lit(1))
    return ingest.upsert(old, new, ["keyword", "country", "observed_at"], "version").drop("version")


@query("SELECT keyword, CASE WHEN length(keyword) % 3 = 0 THEN 77.0 ELSE CAST(count(*) AS DOUBLE) END::DOUBLE AS crowding FROM t_slots GROUP BY keyword")
def s24_lookup_override(spark, sf_dir):
    pages = slots(spark, sf_dir).groupBy("keyword").agg(F.count("*").cast("double").alias("crowding"))
    overrides = pages.where("length(keyword) % 3 = 0").select("keyword", F.lit("crowding").alias("field"), F.lit(77.0).alias("value"))
    return ingest.lookup_override(pages, overrides, "crowding", "crowding")


@query("""WITH k AS (SELECT keyword, count(*) AS n FROM t_slots GROUP BY keyword)
SELECT keyword, CASE WHEN length(keyword) % 2 = 0 THEN 5.0 ELSE CAST(n AS DOUBLE) END::DOUBLE AS value, CASE WHEN length(keyword) % 2 = 0 THEN DATE '2001-02-01' ELSE DATE '2001-01-01' END AS set_at, CASE WHEN length(keyword) % 2 = 0 THEN 5.0 ELSE CAST(n AS DOUBLE) END::DOUBLE AS crowding FROM k""")
def s24_upsert_overrides(spark, sf_dir):
    """Values set for every page, half of them set again, and what a lookup then finds."""
    pages = slots(spark, sf_dir).groupBy("keyword").agg(F.count("*").cast("double").alias("n"))
    values = lambda rows, value, day: rows.select("keyword", F.lit("us").alias("country"), F.lit("crowding").alias("field"), value.alias("value"), F.lit(day).cast("date").alias("set_at"))
    again = pages.where("length(keyword) % 2 = 0").withColumn("keyword", F.concat(F.lit(" "), F.upper("keyword")))
    held = ingest.upsert_overrides(values(pages, F.col("n"), "2001-01-01"), values(again, F.lit(5.0), "2001-02-01"))
    found = ingest.lookup_override(pages.select("keyword", F.lit(-1.0).alias("crowding")), held, "crowding", "crowding")
    return held.select("keyword", "value", "set_at").join(found.hint("merge"), "keyword")


@query(f"SELECT query, CAST(position AS BIGINT) AS position, suggestion, DATE '{AS_OF}' AS fetched_at FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY position DESC) - 1 AS position, suggestion FROM fx_suggestions WHERE length(query) % 2 = 0) UNION ALL SELECT query, position, suggestion, fetched_at FROM fx_suggestions WHERE length(query) % 2 <> 0")
def s25_replace_suggestions(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_suggestions")
    lists = rows.where("length(query) % 2 = 0").groupBy(F.concat(F.lit(" "), F.upper(F.regexp_replace("query", " ", "  "))).alias("query")).agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("position", "suggestion")))), lambda x: x["suggestion"]).alias("suggestions"))
    return ingest.replace_suggestions(rows, lists, AS_OF).select("query", "position", "suggestion", "fetched_at")


@query("SELECT installs, pkg, title FROM fx_apps")
def s26_copy_intersecting_columns(spark, sf_dir):
    return ingest.copy_intersecting(apps(spark, sf_dir), ["pkg", "title", "installs", "icon"])[0]


COPIED = {"customer": ["c_custkey", "c_name", "c_icon"], "orders": ["o_orderkey", "o_totalprice", "o_orderdate"], "part": ["p_partkey", "p_name", "released_at", "icon"]}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS copied_rows, array_to_string(list_sort(list(c) FILTER (has AND wanted)), ',') AS copied_columns, array_to_string(list_sort(list(c) FILTER (has <> wanted)), ',') AS skipped_columns, (SELECT CAST(sum({k}) AS BIGINT) FROM {t}) AS key_sum "
        f"FROM (SELECT c, bool_or(has) AS has, bool_or(wanted) AS wanted FROM (SELECT column_name AS c, true AS has, false AS wanted FROM (DESCRIBE {t}) UNION ALL SELECT unnest({COPIED[t]}), false, true) GROUP BY c)"
        for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))
    )
)
def s26_copy_tables(spark, sf_dir):
    """Three tables replaced by what they share with their targets, the report, and a sum read back from each copy."""
    path = scratch(spark, f"copies-{uuid.uuid4().hex}")
    report = tables.copy_tables({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in COPIED}, COPIED, path)
    sums = [spark.read.parquet(f"{path}/{t}").agg(F.lit(t).alias("table_name"), F.sum(k).cast("long").alias("key_sum")) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))]
    read_back = sums[0].unionAll(sums[1]).unionAll(sums[2])
    told = report.join(read_back.hint("merge"), "table_name")
    return told.withColumns({c: F.array_join(c, ",") for c in ("copied_columns", "skipped_columns")})


@query(f"SELECT pkg, count(*) AS points FROM (SELECT pkg, observed_at FROM fx_app_snapshots WHERE year(observed_at) = 1996 UNION SELECT DISTINCT a.pkg, DATE '{AS_OF}' FROM fx_apps a JOIN fx_app_snapshots s ON s.pkg = a.pkg WHERE year(s.observed_at) = 1996) GROUP BY pkg HAVING count(*) > 1")
def s27_import_dated_cache(spark, sf_dir):
    cache = view(spark, sf_dir, "fx_app_snapshots").where("year(observed_at) = 1996")
    merged = ingest.import_dated_cache(cache, apps(spark, sf_dir), AS_OF)
    return merged.groupBy("pkg").agg(F.count("*").alias("points")).where("points > 1")


@query(f"""WITH m AS (SELECT pkg, observed_at FROM fx_app_snapshots WHERE year(observed_at) = 1996 UNION SELECT DISTINCT a.pkg, DATE '{AS_OF}' FROM fx_apps a JOIN fx_app_snapshots s ON s.pkg = a.pkg WHERE year(s.observed_at) = 1996), n AS (SELECT pkg, count(*) AS n FROM m GROUP BY pkg)
SELECT CAST(sum(n) AS BIGINT) AS points, count(*) AS apps, count(*) FILTER (n > 1) AS apps_with_two_points FROM n""")
def s27_import_report(spark, sf_dir):
    cache = view(spark, sf_dir, "fx_app_snapshots").where("year(observed_at) = 1996")
    return ingest.import_report(ingest.import_dated_cache(cache, apps(spark, sf_dir), AS_OF))


@query("SELECT a.pkg, coalesce(CASE WHEN a.p_partkey % 4 = 0 THEN 'own' END, f.icon) AS icon FROM fx_apps a LEFT JOIN (SELECT pkg, min('i' || keyword) AS icon FROM fx_observations GROUP BY pkg) f ON f.pkg = a.pkg")
def s28_fill_missing_icons(spark, sf_dir):
    held = apps(spark, sf_dir).select("pkg", F.when(F.col("p_partkey") % 4 == 0, "own").alias("icon"))
    return ingest.fill_missing(held, observations(spark, sf_dir).select("pkg", F.concat(F.lit("i"), "keyword").alias("icon")), "icon")


WORDS = "list_filter(string_split(regexp_replace(regexp_extract(lower(headline), '^([^-:|–—(]*)', 1), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('app', 'free', 'pro', 'the'))"


@query(f"SELECT keyword, arg_min(pkg, ordinal) AS pkg FROM (SELECT CASE WHEN len(w) = 0 THEN NULL WHEN len(w) > 5 THEN array_to_string(w[1:4], ' ') ELSE array_to_string(w, ' ') END AS keyword, pkg, ordinal FROM (SELECT {WORDS} AS w, pkg, ordinal FROM fx_raw)) WHERE keyword IS NOT NULL GROUP BY keyword")
def s29_s30_publisher_targets(spark, sf_dir):
    return ingest.publisher_targets(raw(spark, sf_dir))


KT, TT, ST, DT = (f"regexp_extract_all(lower({c}), '[a-z0-9]+')" for c in ("keyword", "title", "short_desc", "description"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens FROM documents")
def t1_tokens(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"))


@query(f"""SELECT keyword, pkg, list_has_all({TT}, {KT}) AS exact, contains(lower(title), lower(trim(keyword))) AS phrase, CASE WHEN list_has_all({TT}, {KT}) THEN 1.0 ELSE 0.0 END::DOUBLE AS kw_in_title,
round(coalesce(1 - (list_min(list_filter(list_transform({KT}, lambda t: coalesce(list_position({TT}, t), 0)), lambda x: x > 0)) - 1) / CAST(len({TT}) AS DOUBLE), 0), 6) AS kw_title_pos,
round(len(list_filter({TT}, lambda t: list_contains({KT}, t))) / CAST(len({TT}) AS DOUBLE), 6) AS kw_density_title, CASE WHEN list_has_all({ST}, {KT}) THEN 1.0 ELSE 0.0 END::DOUBLE AS kw_in_short,
round(len(list_filter({DT}, lambda t: list_contains({KT}, t))) / (len(list_filter({DT}, lambda t: list_contains({KT}, t))) + 1.5::DOUBLE), 6) AS kw_desc_tf FROM t_slots""")
def t2_t5_t10_title_features(spark, sf_dir):
    c = [F.col(x) for x in ("title", "short_desc", "description", "keyword")]
    features = tx.title_position_features(*c)
    return rounded(slots(spark, sf_dir).select("keyword", "pkg", tx.exact_match(c[0], c[3]).alias("exact"), tx.title_contains_phrase(c[0], c[3]).alias("phrase"), *[v.alias(k) for k, v in features.items()]))


TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(f"""WITH w AS (SELECT keyword, pkg, {", ".join(TOKENS.format(c) + f" AS {c[:2]}" for c in ("keyword", "title", "short_desc", "description"))} FROM t_slots),
p AS (SELECT keyword, pkg, list_transform(ke, lambda t: CASE WHEN list_contains(ti, t) THEN 1.0::DOUBLE WHEN list_contains(sh, t) THEN 0.6::DOUBLE WHEN list_contains(de, t) THEN 0.35::DOUBLE ELSE 0::DOUBLE END) AS per FROM w),
l AS MATERIALIZED (SELECT keyword, pkg, list_sum(per) / len(per) * (len(list_filter(per, lambda x: x > 0)) / len(per)) AS lexical FROM p)
SELECT l.keyword, l.pkg, round(list_dot_product(k.v, e.v), 4) AS dot, round(list_cosine_similarity(k.v, e.v), 4) AS cosine, round(0.6 * lexical + 0.4 * greatest(0, list_dot_product(k.v, e.v)), 4) AS blended
FROM l JOIN t_app_vectors e ON e.pkg = l.pkg JOIN t_keyword_vectors k ON k.keyword = l.keyword""")
def t3_t4_t6_blended_relevance(spark, sf_dir):
    c = [F.col(x) for x in ("title", "short_desc", "description", "keyword")]
    rows = slots(spark, sf_dir).join(app_vectors(spark, sf_dir), "pkg").join(keyword_vectors(spark, sf_dir), "keyword")
    dot = tx.dot(F.col("keyword_vector"), F.col("vector"))
    return rounded(rows.select("keyword", "pkg", dot.alias("dot"), tx.cosine(F.col("keyword_vector"), F.col("vector")).alias("cosine"), tx.blended_relevance(tx.lexical_relevance(*c), F.col("keyword_vector"), F.col("vector")).alias("blended")), 4)


@query("""WITH t AS (SELECT DISTINCT text, trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g')) AS p FROM conversations WHERE text IS NOT NULL),
g AS (SELECT text, md5(unnest(CASE WHEN length(p) < 3 THEN [p] ELSE list_transform(range(1, length(p) - 1), lambda i: substr(p, i::INT, 3)) END)) AS h FROM t),
c AS (SELECT text, CAST(('0x' || substr(h, 1, 15))::BIGINT % 384 AS INT) AS place, sum(CASE WHEN ('0x' || substr(h, 16, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE) AS x FROM g GROUP BY ALL)
SELECT sha256(text) AS key, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY text)), 6) AS x FROM c WHERE x <> 0""")
def t7_hashed_trigram_vectors(spark, sf_dir):
    """The vectors' components other than zero."""
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text")
    vectors = tx.hashed_trigram_vectors(docs, "text").select(F.sha2("text", 256).alias("key"), F.posexplode("vector").alias("place", "x"))
    return rounded(vectors.where("x <> 0"))


@query("SELECT pkg, concat(title, '. ', concat_ws(' ', short_desc, substr(trim(regexp_replace(description, '\\s+', ' ', 'g')), 1, 240))) AS text FROM fx_apps")
def t8_embedding_text(spark, sf_dir):
    return apps(spark, sf_dir).select("pkg", tx.embedding_text(F.col("title"), F.col("short_desc"), F.col("description")).alias("text"))


@query("SELECT sha256('t:' || text) AS key FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL) WHERE text NOT IN (SELECT text FROM conversations WHERE turn = 0 AND text IS NOT NULL)")
def t9_uncached_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text", "turn")
    cache = rows.where("turn = 0").select(F.sha2(F.concat(F.lit("t:"), "text"), 256).alias("key"), F.lit("trigram").alias("encoder"))
    return tx.uncached(rows, cache, "text", "t:").select("key")


@query("""WITH t AS (SELECT DISTINCT text, trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g')) AS p FROM conversations WHERE text IS NOT NULL),
g AS (SELECT text, md5(unnest(CASE WHEN length(p) < 3 THEN [p] ELSE list_transform(range(1, length(p) - 1), lambda i: substr(p, i::INT, 3)) END)) AS h FROM t),
c AS (SELECT text, CAST(('0x' || substr(h, 1, 15))::BIGINT % 384 AS INT) AS place, sum(CASE WHEN ('0x' || substr(h, 16, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE) AS x FROM g GROUP BY ALL)
SELECT sha256('t:' || text) AS key, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY text)), 6) AS x FROM c WHERE x <> 0""")
def t9_stored_vectors(spark, sf_dir):
    """First turns are encoded into the store; then all texts, of which only the others are."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text", "turn")
    path = scratch(spark, f"vectors-{uuid.uuid4().hex}")
    tables.encode_cached(rows.where("turn = 0"), "text", path, tx.hashed_trigram_vectors, "trigram", "t:")
    found, _ = tables.encode_cached(rows, "text", path, tx.hashed_trigram_vectors, "trigram", "t:")
    return rounded(found.select("key", F.posexplode("vector").alias("place", "x")).where("x <> 0"))
