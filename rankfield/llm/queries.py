"""One query for each operator, over its whole table, with production parameters."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.llm import clustering, filter_audit, license_scan, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_records, topk, url_filter
from rankfield.llm.common import storage_dir, table, temporary

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# publishers whose pages are listed: a parameter of the query
LISTED_PUBLISHERS = ("spam-farm.example.com", "ads-track.example.com", "cheap-pills.example.com", "casino-win.example.com", "free-bets.example.com", "adult-x.example.net")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicate_report(table(spark, sf_dir, "documents"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list: URLs of the pages that name a listed publisher in their imprint."""
    imprint = F.regexp_replace(F.regexp_extract("html", r"&copy; (\S+)", 1), r"^(www|m|blog)\.", "")
    return pages.where(imprint.isin(*LISTED_PUBLISHERS)).select("url")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages.select("page_id", "url"), listed_urls(pages), RULES)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(table(spark, sf_dir, "documents"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{storage_dir(spark).rstrip('/')}/token-records-{uuid.uuid4().hex}"
    index = token_records.export(table(spark, sf_dir, "documents"), path)
    temporary(spark, path)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, starts = F.filter("notices", lambda x: x["base"]), F.transform("base", lambda x: x["word"])
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents")).withColumn("base", base)
    own = F.concat(F.transform("notices", lambda x: x["label"]), F.flatten(F.transform("expressions", lambda x: x["labels"])))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        license_scan.joined_labels(F.transform("base", lambda x: x["label"])).alias("base_labels"), license_scan.joined_labels(own).alias("labels"), "score",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_quality_rules, op3_quality_classifier, op4_packing, op5_line_dedup,
        op6_simhash_dedup, op7_url_filter, op8_source_mixing, op9_token_records, op10_suffix_dedup,
        op11_centroid_clustering, op12_filter_audit, op13_license_scan,
    )
}

SPACE = r"[\x20\x09-\x0D]"
WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# lines with a word, and their normal form
LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))"
NORMAL = f"trim(regexp_replace(translate({{0}}, '{UPPER}123456789', '{UPPER.lower()}000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
EXACT = "trim(regexp_replace({0}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"

# op4's least padded size of lengths 0 to j in at most k + 1 buckets, and where the last but one ends
BOUNDS = ",\n".join(
    f"""b{k} AS MATERIALIZED (SELECT p.j, CASE WHEN s.c < p.c THEN s.c ELSE p.c END AS c, CASE WHEN s.c < p.c THEN s.i END AS pick
  FROM b{k - 1} p LEFT JOIN (SELECT x.j, min(y.c + x.n * (x.upto - z.upto)) AS c, arg_min(y.j, (y.c + x.n * (x.upto - z.upto), y.j)) AS i FROM h x JOIN b{k - 1} y ON y.j < x.j JOIN h z ON z.j = y.j GROUP BY x.j) s ON s.j = p.j)"""
    for k in range(1, 8)
)
BACK = ",\n".join(f"e{k} AS (SELECT coalesce(b.pick, e.j) AS j FROM e{k + 1} e JOIN b{k + 1} b ON b.j = e.j)" for k in range(6, -1, -1))

# op11: c{r} are the centroids after r rounds, a{r} what they are assigned
ROUND = """a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := list_dot_product(v, v) - 2 * list_dot_product(v, m) + list_dot_product(m, m), c := c)) AS best FROM k, c{r} GROUP BY vec_id)"""
MOVED = """c{s} AS MATERIALIZED (SELECT c.c, coalesce(n.m, c.m) AS m FROM c{r} c LEFT JOIN (SELECT c, list(m ORDER BY i) AS m FROM (SELECT best.c AS c, i, floor(sum(x) / count(*)) AS m FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY best.c, i) GROUP BY c) n ON n.c = c.c)"""
ROUNDS = ",\n".join(x for r in range(6) for x in ([MOVED.format(r=r - 1, s=r)] if r else []) + [ROUND.format(r=r)])

ORACLES: dict[str, str] = {
    "op1_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op2_quality_rules": f"""
WITH d AS (SELECT doc_id, source, text, coalesce({WORDS}, []) AS w, {LINES} AS l FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT doc_id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM y WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM z WHERE n > 1) GROUP BY doc_id),
k AS (SELECT doc_id, source, unnest(list_transform(l, lambda t: {NORMAL.format("t")})) AS m FROM d),
f AS (SELECT source, m, count(DISTINCT doc_id) AS n FROM k GROUP BY source, m HAVING count(DISTINCT doc_id) > 20),
h AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
o AS (SELECT f.source, f.m FROM f JOIN h ON h.source = f.source WHERE f.n > 0.01 * h.docs OR f.n > 1000),
g AS (SELECT k.doc_id, sum(length(k.m) - length(replace(k.m, ' ', '')) + 1) AS n FROM k JOIN o ON o.source = k.source AND o.m = k.m GROUP BY k.doc_id),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept FROM c""",
    "op4_packing": f"""
WITH d AS (SELECT doc_id, CAST(coalesce(len({WORDS}), 0) AS BIGINT) AS n, row_number() OVER (PARTITION BY doc_id, text) - 1 AS use FROM documents),
g AS (SELECT doc_id, use, n AS whole, unnest(range(greatest(1, CAST(ceil(n / 4096.0) AS BIGINT)))) AS piece FROM d),
p AS (SELECT doc_id, piece, least(4096, whole - piece * 4096) AS n, ('0x' || substr(md5(doc_id || '|' || piece || '|' || use), 1, 15))::BIGINT AS place FROM g),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n) - 1 AS j, n, CAST(sum(count(*)) OVER (ORDER BY n) AS BIGINT) AS upto FROM p GROUP BY n),
b0 AS MATERIALIZED (SELECT j, n * upto AS c FROM h),
{BOUNDS},
e7 AS (SELECT max(j) AS j FROM h),
{BACK},
t AS (SELECT row_number() OVER (ORDER BY n) - 1 AS bucket, n AS padded FROM h WHERE j IN ({" UNION ".join(f"SELECT j FROM e{k}" for k in range(8))})),
m AS (SELECT p.*, (SELECT min(bucket) FROM t WHERE t.padded >= p.n) AS bucket, place % greatest(1, CAST(ceil((SELECT count(*) FROM p) / 20000.0) AS BIGINT)) AS shard FROM p),
o AS (SELECT m.*, t.padded, row_number() OVER (PARTITION BY m.bucket ORDER BY shard, place, doc_id, piece) - 1 AS k, CAST(greatest(1, floor(65536.0 / greatest(1, t.padded))) AS BIGINT) AS fit FROM m JOIN t ON t.bucket = m.bucket)
SELECT doc_id, piece, piece * 4096 AS start_token, n AS n_tokens, CAST(bucket AS INT) AS bucket, padded AS padded_tokens, k // fit AS batch, k % fit AS slot FROM o""",
    "op5_line_dedup": f"""
WITH d AS (SELECT doc_id, text, {LINES} AS l FROM documents),
k AS (SELECT doc_id, unnest(list_transform(l, lambda t: {EXACT.format("t")})) AS m, generate_subscripts(l, 1) AS i FROM d),
w AS (SELECT doc_id, i, m, lead(m) OVER o AS m2, lead(m, 2) OVER o AS m3 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m, m2, m3 ORDER BY doc_id, i) AS n FROM w WHERE m3 IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list([i, i + 1, i + 2])))) AS gone FROM n WHERE n > 1 GROUP BY doc_id),
j AS (SELECT d.doc_id, d.text, d.l, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed, CAST(len(list_filter(gone, lambda x: NOT list_contains(gone, x - 1))) AS BIGINT) AS n_runs,
sha256(CASE WHEN len(gone) = 0 THEN coalesce(text, '') ELSE array_to_string(list_filter(l, lambda t, i: NOT list_contains(gone, i)), chr(10)) END) AS kept_sha256 FROM j""",
    "op7_url_filter": f"""
WITH u AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS q FROM u),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)[.]', ''), ':[0-9]+$', '') || regexp_replace(path, '([.]html?|/+)$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS name,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c),
b AS (SELECT DISTINCT name FROM k WHERE regexp_replace(regexp_extract(html, '&copy; ([^[:space:]]+)', 1), '^(www|m|blog)[.]', '') IN {LISTED_PUBLISHERS} AND name IS NOT NULL)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN name IN (SELECT name FROM b) THEN 'block' ELSE 'allow' END AS verdict, rule IS NULL AND coalesce(name IN (SELECT name FROM b), false) AS listed FROM k""",
    "op8_source_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, '=' || source AS s, CAST(len({WORDS}) AS BIGINT) AS n FROM documents),
t AS (SELECT s, sum(n) AS m FROM d GROUP BY s), p AS (SELECT s, m, m / CAST(sum(m) OVER () AS DOUBLE) AS p, max(m) OVER () / CAST(sum(m) OVER () AS DOUBLE) AS most FROM t WHERE m > 0),
h(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p) >= 0.95 * (SELECT ln(count(*)) FROM p) THEN (lo + hi) / 2 ELSE lo END,
  CASE WHEN (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p) >= 0.95 * (SELECT ln(count(*)) FROM p) THEN hi ELSE (lo + hi) / 2 END FROM h WHERE i < 40),
r(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN (SELECT max(pow(p / most, (lo + hi) / 2 - 1)) FROM p) <= 2.0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN (SELECT max(pow(p / most, (lo + hi) / 2 - 1)) FROM p) <= 2.0 THEN (lo + hi) / 2 ELSE hi END FROM r WHERE i < 40),
e AS (SELECT CASE WHEN (SELECT count(*) FROM p) > 1 THEN (SELECT lo FROM h WHERE i = 40) ELSE 1 END AS a),
a AS (SELECT round(CASE WHEN (SELECT max(pow(p / most, a - 1)) FROM p) > 2.0 THEN greatest(a, (SELECT hi FROM r WHERE i = 40)) ELSE a END, 6) AS a FROM e),
q AS (SELECT s, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM p), 6) AS weight, round(pow(p / most, a - 1), 6) AS epochs, CAST(greatest(1, ceil(m / 200000.0)) AS BIGINT) AS blocks FROM p, a),
x AS (SELECT d.doc_id, d.source, d.s, d.n, q.weight, q.epochs, ('0x' || substr(md5(d.doc_id || '|block'), 1, 15))::BIGINT % q.blocks AS block, ('0x' || substr(md5(d.doc_id || '|place'), 1, 15))::BIGINT AS place FROM d JOIN q ON q.s = d.s),
y AS (SELECT *, sum(n) OVER (PARTITION BY s, block ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY s, block) AS total, row_number() OVER (PARTITION BY s, block ORDER BY place, doc_id) AS position FROM x),
z AS (SELECT *, unnest(range(CAST(floor(epochs) AS BIGINT) + CASE WHEN before + n / 2.0 < (epochs - floor(epochs)) * total THEN 1 ELSE 0 END)) AS epoch FROM y)
SELECT doc_id, source, n AS n_tokens, weight, epoch, block, ('0x' || substr(md5(s || '|' || block || '|' || epoch), 1, 15))::BIGINT AS block_order, position FROM z""",
    "op11_centroid_clustering": f"""
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('2:' || vec_id) AS h FROM k ORDER BY h LIMIT 40)),
{ROUNDS},
s AS (SELECT best.c AS c, sum(best.d) AS d FROM a5 GROUP BY best.c)
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(s.d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM s) AS BIGINT) AS inertia,
sha256(array_to_string(list_transform(c5.m, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a5 JOIN s ON s.c = best.c JOIN c5 ON c5.c = best.c""",
    "op12_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce({WORDS}, []) AS w FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > e.least THEN 16 ELSE 0 END AS mask
  FROM d JOIN e ON e.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS MATERIALIZED (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
