"""Registered queries and the SQL that says the same."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankfield.sources.views import AS_OF, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Common table expressions that several oracle statements share.
PARTS = {
    "t_latest": f"""SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY keyword, country, pkg ORDER BY observed_at DESC, CASE source WHEN 'review' THEN 0 WHEN 'serp' THEN 1 ELSE 2 END) AS rn
FROM fx_observations o WHERE position IS NOT NULL AND country = 'us') WHERE rn = 1""",
    "t_slots": """SELECT l.keyword, l.country, l.pkg, l.position, l.source, l.observed_at, a.title, a.short_desc, a.description, a.installs, a.rating, a.reviews, a.released_at, a.updated_at, l.featured,
row_number() OVER (PARTITION BY l.keyword, l.country ORDER BY l.position, CASE WHEN l.source = 'review' THEN 0 ELSE 1 END, a.installs DESC, l.pkg) AS slot
FROM t_latest l JOIN fx_apps a ON a.pkg = l.pkg WHERE l.position < 251""",
    "t_growth": """SELECT pkg, (max(installs) - min(installs)) / CAST(date_diff('day', min(observed_at), max(observed_at)) AS DOUBLE) AS measured_per_day
FROM fx_app_snapshots GROUP BY pkg HAVING count(*) > 1 AND date_diff('day', min(observed_at), max(observed_at)) >= 7""",
    "t_breadth": "SELECT pkg, count(DISTINCT keyword) AS breadth FROM fx_observations WHERE position IS NOT NULL GROUP BY pkg",
    "t_norms": f"""SELECT CAST(least(floor(age) + 1, 21) AS INT) AS bucket, quantile_cont(installs / greatest(age, 0.25), 0.5) AS rate, count(*) AS n
FROM (SELECT installs, date_diff('day', released_at, DATE '{AS_OF}') * 86400.0::DOUBLE / 31557600.0::DOUBLE AS age FROM fx_apps WHERE installs > 0 AND released_at IS NOT NULL) WHERE age > 0 GROUP BY 1 HAVING count(*) >= 20""",
    "t_context0": f"""SELECT s.*, coalesce(b.breadth, 0) AS breadth, g.measured_per_day,
coalesce(greatest(date_diff('day', s.released_at, DATE '{AS_OF}'), 0), 0) AS days, coalesce(greatest(date_diff('day', s.updated_at, DATE '{AS_OF}'), 0), 0) AS stale_days,
regexp_extract_all(lower(s.keyword), '[a-z0-9]+') AS kt, regexp_extract_all(lower(s.title), '[a-z0-9]+') AS tt, regexp_extract_all(lower(s.short_desc), '[a-z0-9]+') AS st, regexp_extract_all(lower(s.description), '[a-z0-9]+') AS dt
FROM t_slots s LEFT JOIN t_growth g ON g.pkg = s.pkg LEFT JOIN t_breadth b ON b.pkg = s.pkg""",
    "t_context1": """SELECT c.*, days / 365.0::DOUBLE AS age, CASE WHEN days > 0 THEN installs / greatest(days / 365.0::DOUBLE, 1 / 365.0::DOUBLE) ELSE 0 END AS rate,
CASE WHEN days > 0 THEN installs / greatest(days / 365.0::DOUBLE, 0.25) END AS floor_rate,
list_transform(kt, lambda t: CASE WHEN list_contains(tt, t) THEN 1.0::DOUBLE WHEN list_contains(st, t) THEN 0.6::DOUBLE WHEN list_contains(dt, t) THEN 0.35::DOUBLE ELSE 0::DOUBLE END) AS per, list_has_all(tt, kt) AS exact
FROM t_context0 c""",
    # vectors by number: an app has its part's, a keyword its place in the alphabet
    "t_vectors": "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "t_app_vectors": "SELECT a.pkg, e.v FROM fx_apps a JOIN t_vectors e ON e.vec_id = a.p_partkey % (SELECT count(*) FROM embeddings)",
    "t_keyword_vectors": "SELECT keyword, v FROM (SELECT keyword, row_number() OVER (ORDER BY keyword) - 1 AS i FROM (SELECT DISTINCT keyword FROM fx_observations)) k JOIN t_vectors e ON e.vec_id = k.i",
    "t_leads": "SELECT s.keyword, max(v.v) FILTER (slot = 1) AS v1, max(v.v) FILTER (slot = 2) AS v2 FROM t_slots s JOIN t_app_vectors v ON v.pkg = s.pkg WHERE slot <= 2 GROUP BY s.keyword",
    "t_context2": """SELECT c.* EXCLUDE (lexical), lexical, CASE WHEN a.v IS NULL OR k.v IS NULL THEN lexical ELSE 0.6 * lexical + 0.4 * greatest(0, list_dot_product(k.v, a.v)) END AS relevance,
coalesce(list_cosine_similarity(k.v, a.v), 0) AS cosine, coalesce(list_cosine_similarity(a.v, l.v1), 0) AS sim_first, coalesce(list_cosine_similarity(a.v, l.v2), 0) AS sim_second
FROM (SELECT c.*, list_sum(per) / len(per) * (len(list_filter(per, lambda x: x > 0)) / len(per)) AS lexical FROM t_context1 c) c
LEFT JOIN t_app_vectors a ON a.pkg = c.pkg LEFT JOIN t_keyword_vectors k ON k.keyword = c.keyword LEFT JOIN t_leads l ON l.keyword = c.keyword""",
    "t_context": """SELECT c.*, CASE WHEN age > 0 THEN coalesce((SELECT min_by(n.rate, abs(n.bucket - least(greatest(CAST(floor(c.age) AS INT) + 1, 1), 20)) * 100 + n.bucket) FROM t_norms n), 0) ELSE 0 END AS norm
FROM t_context2 c""",
    "t_peers": """SELECT a.keyword, a.pkg, median(p.rate) AS peer FROM t_context a JOIN t_context p ON p.keyword = a.keyword AND p.pkg <> a.pkg AND p.days > 0 AND p.age BETWEEN 0.5 * a.age AND 2.0 * a.age
WHERE a.norm <= 0 AND a.days > 0 GROUP BY a.keyword, a.pkg""",
    "t_gap": """SELECT c.*, CASE WHEN c.norm > 0 THEN c.norm ELSE coalesce(p.peer, 0) END AS age_norm FROM t_context c LEFT JOIN t_peers p ON p.keyword = c.keyword AND p.pkg = c.pkg""",
    "t_ready": """SELECT g.*, CASE WHEN days > 0 AND age_norm > 0 THEN ln(1 + rate) - ln(1 + age_norm) ELSE 0 END AS rate_vs_age,
CASE WHEN days > 0 AND age_norm > 0 AND rate > age_norm THEN 1 - exp(-(ln(1 + rate) - ln(1 + age_norm)) / 3) ELSE 0 END AS advantage, relevance >= 0.40 AS on_intent FROM t_gap g""",
    "t_loo": """SELECT o.keyword, o.pkg AS own_pkg, o.slot AS own_slot, r.slot - CASE WHEN r.slot > o.slot THEN 1 ELSE 0 END AS idx, abs(r.slot - o.slot) AS gap, r.* EXCLUDE (keyword)
FROM t_ready o JOIN t_ready r ON r.keyword = o.keyword AND r.pkg <> o.pkg""",
    "t_states": """SELECT keyword, country, observed_at, count(*) FILTER (t) AS n_apps, quantile_cont(CAST(installs AS DOUBLE), 0.5) FILTER (t) AS installs_p50, quantile_cont(CAST(installs AS DOUBLE), 0.9) FILTER (t) AS installs_p90,
quantile_cont(rating, 0.5) FILTER (t) AS rating_p50, count(*) FILTER (t AND exact) AS exact_match, count(*) FILTER (t AND days > 0 AND age <= 1.0) AS newcomers,
quantile_cont(age, 0.5) FILTER (t AND days > 0) AS age_p50, coalesce(quantile_cont(installs / greatest(age, 0.25), 0.5) FILTER (t AND days > 0), 0) AS velocity_p50,
count(*) FILTER (t AND days > 0) / CAST(greatest(count(*) FILTER (t), 1) AS DOUBLE) AS age_known_frac
FROM (SELECT *, days / 365.0::DOUBLE AS age FROM (SELECT o.keyword, o.country, o.observed_at, o.position <= 10 AS t, a.installs, a.rating, coalesce(greatest(date_diff('day', a.released_at, o.observed_at), 0), 0) AS days,
list_has_all(regexp_extract_all(lower(a.title), '[a-z0-9]+'), regexp_extract_all(lower(o.keyword), '[a-z0-9]+')) AS exact
FROM fx_observations o JOIN fx_apps a ON a.pkg = o.pkg WHERE o.position < 251)) GROUP BY keyword, country, observed_at""",
    "t_events": """SELECT keyword, pkg, CASE WHEN was IS NULL THEN 'entered' WHEN now IS NULL THEN 'left' WHEN was <> now THEN 'moved' END AS event, was AS from_position, now AS to_position, gap_days, newer AS observed_at, title,
was IS NULL AND coalesce(date_diff('day', released_at, newer) / 365.0 BETWEEN 0 AND 1.5, false) AS is_new
FROM (SELECT keyword, older, newer, gap_days, pkg, max(was) AS was, max(now) AS now FROM (
  SELECT p.keyword, p.older, p.newer, p.gap_days, o.pkg, o.position AS was, NULL AS now FROM t_pairs p JOIN fx_observations o ON o.keyword = p.keyword AND o.observed_at = p.older WHERE o.source = 'serp' AND o.country = 'us' AND o.position IS NOT NULL
  UNION ALL SELECT p.keyword, p.older, p.newer, p.gap_days, o.pkg, NULL, o.position FROM t_pairs p JOIN fx_observations o ON o.keyword = p.keyword AND o.observed_at = p.newer WHERE o.source = 'serp' AND o.country = 'us' AND o.position IS NOT NULL)
  GROUP BY ALL) JOIN fx_apps USING (pkg) WHERE was IS NULL OR now IS NULL OR was <> now""",
    "t_pairs": """SELECT keyword, older, newer, abs(date_diff('day', older, newer)) AS gap_days FROM (SELECT keyword, observed_at AS older, lead(observed_at) OVER (PARTITION BY keyword ORDER BY observed_at) AS newer
FROM (SELECT DISTINCT keyword, observed_at FROM fx_observations WHERE source = 'serp' AND country = 'us')) WHERE newer IS NOT NULL AND date_diff('day', older, newer) >= 3""",
}


def statement(sql: str) -> str:
    """``sql`` with the parts and views it needs in front, each once, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in PARTS.items():
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(body)
                need.append(name)

    visit(sql)
    heads = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in need)
    body = sql.strip()
    if heads:
        body = f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
    return with_views(body)


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can say it."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = statement(sql)
        return run

    return add
