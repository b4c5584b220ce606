"""The registered queries over the given tables, each beside its equivalent in SQL.

Floats are rounded to six digits, times are whole seconds since 1970, lists are joined; every limit has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import fixtures as X
from cairn.operators import base as B
from cairn.operators import entities as E
from cairn.operators import graph as G
from cairn.operators import linking as L
from cairn.operators import maintain as M
from cairn.operators import reports as R
from cairn.operators import rerank as K
from cairn.operators import search as S
from cairn.operators import triples as T
from cairn.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "TIMESTAMP '2024-04-15 00:00:00'"


def query(oracle: str | None = None, fixtures: str = "", **values):
    """Registers a function under its name, with SQL over the named fixtures."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLE[f.__name__] = sql(fixtures, oracle, **values)
        return f

    return add


def secs(c) -> F.Column:
    return F.unix_seconds(c)


def r6(c) -> F.Column:
    return F.round(c, 6)


def mem(s, d, embedding=False):
    return X.memories(s, d, embedding)


# --- filters and reports


@query("SELECT id, profile, source, access_count, round(importance, 6) AS importance, CAST(epoch(created_at) AS BIGINT) AS created_at FROM active WHERE profile IN ('en', 'fr') AND list_has_any(tags, ['topic:1', 'topic:2'])", "active")
def active_memories(s, d):
    return B.active_memories(mem(s, d), X.as_of(), ["en", "fr"], ["topic:1", "topic:2"]).select("id", "profile", "source", "access_count", r6("importance").alias("importance"), secs("created_at").alias("created_at"))


@query("SELECT profile, count(*) AS n FROM active GROUP BY profile", "active")
def profile_counts(s, d):
    return R.profile_counts(mem(s, d), X.as_of())


@query("SELECT * FROM (SELECT profile, tag, n, row_number() OVER (PARTITION BY profile ORDER BY n DESC, tag) AS rank FROM (SELECT profile, tag, count(*) AS n FROM (SELECT profile, unnest(tags) AS tag FROM active) GROUP BY ALL)) WHERE rank <= 20", "active")
def top_tags(s, d):
    return R.top_tags(mem(s, d), X.as_of())


@query("SELECT profile, coalesce(source, 'unknown') AS source, count(*) AS n FROM active GROUP BY ALL", "active")
def source_counts(s, d):
    return R.source_counts(mem(s, d), X.as_of())


@query(f"""
    WITH linked AS (SELECT DISTINCT a.id FROM (SELECT source_id AS x, target_id AS y FROM rel WHERE source_id <> target_id UNION SELECT target_id, source_id FROM rel WHERE source_id <> target_id) e
      JOIN active a ON a.id = e.x JOIN active b ON b.id = e.y AND b.profile = a.profile),
    tg AS (SELECT profile, count(DISTINCT tag) AS distinct_tags FROM (SELECT profile, unnest(tags) AS tag FROM active) GROUP BY profile)
    SELECT a.profile, count(*) AS total, count(*) FILTER (WHERE len(tags) = 0) AS untagged, count(*) FILTER (WHERE l.id IS NULL) AS orphans,
      count(*) FILTER (WHERE (last_accessed_at IS NULL OR last_accessed_at < {NOW} - INTERVAL 7 DAY) AND importance > 0.05) AS decay_eligible,
      count(*) FILTER (WHERE importance <= 0.05) AS at_floor, any_value(tg.distinct_tags) AS distinct_tags
    FROM active a LEFT JOIN linked l USING (id) LEFT JOIN tg ON tg.profile = a.profile GROUP BY a.profile""", "active rel")
def memory_stats(s, d):
    return R.memory_stats(mem(s, d), X.relationships(s, d), X.as_of())


@query(f"""
    WITH alone AS (SELECT a.* FROM active a WHERE created_at < {NOW} - INTERVAL 5 MINUTE AND NOT EXISTS (SELECT 1 FROM rel WHERE source_id = a.id) AND NOT EXISTS (SELECT 1 FROM rel WHERE target_id = a.id))
    SELECT * FROM (SELECT id, profile, CAST(epoch(created_at) AS BIGINT) AS created_at, count(*) OVER (PARTITION BY profile) AS total, row_number() OVER (PARTITION BY profile ORDER BY created_at DESC, id) AS rank FROM alone) WHERE rank <= 10""", "active rel")
def orphans(s, d):
    return R.orphans(mem(s, d), X.relationships(s, d), X.as_of()).withColumn("created_at", secs("created_at"))


@query(f"""SELECT * FROM (SELECT memory_id, profile, CAST(epoch(stage_entered_at) AS BIGINT) AS entered, count(*) OVER (PARTITION BY profile) AS total, row_number() OVER (PARTITION BY profile ORDER BY stage_entered_at, memory_id) AS rank
    FROM life WHERE stage = 'stable' AND stage_entered_at < {NOW} - INTERVAL 90 DAY AND memory_id IN (SELECT id FROM active)) WHERE rank <= 10""", "life active")
def stale_lifecycle(s, d):
    return R.stale_lifecycle(X.lifecycle(s, d), mem(s, d), X.as_of()).select("memory_id", "profile", secs("stage_entered_at").alias("entered"), "total", "rank")


SOURCES = """ts0 AS (SELECT profile, topic_key, list_sort(list(DISTINCT id)) AS ids FROM (SELECT profile, unnest(tags) AS topic_key, CAST(id AS VARCHAR) AS id FROM active) GROUP BY ALL),
    ts AS (SELECT profile, topic_key, len(ids) AS source_count, ids[-1] AS source_cursor, sha256(array_to_string(ids, chr(10))) AS source_hash FROM ts0)"""


@query(f"WITH {SOURCES} SELECT profile, topic_key, source_count, source_cursor, source_hash FROM ts", "active")
def topic_sources(s, d):
    return M.topic_sources(mem(s, d), X.as_of())


def summaries(s, d):
    """A summary for each topic tag: every fourth one drifted, every fifth stale."""
    n = F.expr("cast(split_part(topic_key, ':', 2) as int)")
    rows = M.topic_sources(mem(s, d), X.as_of()).filter(F.col("topic_key").startswith("topic:"))
    return rows.select(
        "profile", "topic_key", F.concat(F.lit("about "), "topic_key").alias("content"), "source_count", F.when(n % 4 == 0, F.sha2(F.lit(""), 256)).otherwise(F.col("source_hash")).alias("source_hash"),
        F.when(n % 5 == 0, "stale").otherwise("fresh").alias("status"), F.lit(1).alias("version"), F.when(n % 5 == 0, "old").alias("stale_reason"), F.timestamp_seconds(F.unix_seconds(X.as_of()) - n * 864000).alias("updated_at"),
    )


SUMMARIES = SOURCES + """, su AS (SELECT profile, topic_key, 'about ' || topic_key AS content, source_count, CASE WHEN n % 4 = 0 THEN sha256('') ELSE source_hash END AS source_hash, CASE WHEN n % 5 = 0 THEN 'stale' ELSE 'fresh' END AS status, n,
    CASE WHEN n % 5 = 0 THEN 'old' END AS stale_reason FROM (SELECT *, CAST(string_split(topic_key, ':')[2] AS INTEGER) AS n FROM ts WHERE topic_key LIKE 'topic:%'))"""


@query(f"WITH {SUMMARIES} SELECT su.profile, su.topic_key FROM su LEFT JOIN ts USING (profile, topic_key) WHERE status = 'fresh' AND su.source_hash <> coalesce(ts.source_hash, sha256(''))", "active")
def summary_drift(s, d):
    return R.summary_drift(summaries(s, d), M.topic_sources(mem(s, d), X.as_of()))


@query(f"""WITH {SUMMARIES} SELECT coalesce(ts.profile, su.profile) AS profile, coalesce(ts.topic_key, su.topic_key) AS topic_key,
    CASE WHEN coalesce(ts.source_count, 0) = 0 THEN 'no_sources' WHEN ts.source_count > 100 THEN 'skipped_oversize' WHEN status = 'fresh' AND su.source_hash = ts.source_hash THEN 'skipped' ELSE 'recompute' END AS action
    FROM ts FULL JOIN su ON su.profile = ts.profile AND su.topic_key = ts.topic_key""", "active")
def topics_to_recompute(s, d):
    return M.topics_to_recompute(M.topic_sources(mem(s, d), X.as_of()), summaries(s, d))


@query(f"""WITH {SUMMARIES}, nw AS (SELECT profile, topic_key, 'new ' || topic_key AS content, source_hash FROM ts WHERE topic_key IN ('topic:0', 'topic:5', 'band:1'))
    SELECT coalesce(nw.profile, su.profile) AS profile, coalesce(nw.topic_key, su.topic_key) AS topic_key, coalesce(nw.content, su.content) AS content, coalesce(nw.source_hash, su.source_hash) AS source_hash,
      CASE WHEN nw.topic_key IS NULL THEN 1 WHEN su.topic_key IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN nw.topic_key IS NULL THEN su.status ELSE 'fresh' END AS status, CASE WHEN nw.topic_key IS NULL THEN su.stale_reason END AS stale_reason
    FROM su FULL JOIN nw ON su.profile = nw.profile AND su.topic_key = nw.topic_key""", "active")
def upsert_summaries(s, d):
    new = M.topic_sources(mem(s, d), X.as_of()).filter(F.col("topic_key").isin("topic:0", "topic:5", "band:1")).select("profile", "topic_key", F.concat(F.lit("new "), "topic_key").alias("content"), "source_hash")
    return M.upsert_summaries(summaries(s, d), new)


@query("SELECT DISTINCT profile, topic_key FROM (SELECT id, profile, unnest(tags) AS topic_key FROM active) WHERE id IN (SELECT source_id FROM rel WHERE relationship = 'contradicts')", "active rel")
def affected_summaries(s, d):
    m = B.active_memories(mem(s, d), X.as_of())
    return M.affected_summaries(X.relationships(s, d).filter("relationship = 'contradicts'").select(F.col("source_id").alias("id")), m.select("profile", F.explode("tags").alias("topic_key"), F.col("id").alias("memory_id")))


@query(f"WITH {SUMMARIES} SELECT profile, topic_key, CASE WHEN status = 'fresh' AND n > 3 THEN 'stale' ELSE status END AS status, CASE WHEN status = 'fresh' AND n > 3 THEN 'idle for 30 days' ELSE stale_reason END AS stale_reason FROM su", "active")
def sweep_stale(s, d):
    return M.sweep_stale(summaries(s, d), X.as_of()).select("profile", "topic_key", "status", "stale_reason")


@query(f"WITH {SUMMARIES} SELECT profile, topic_key, row_number() OVER (PARTITION BY profile ORDER BY n DESC, topic_key) AS position FROM su WHERE status = 'stale'", "active")
def list_stale(s, d):
    return M.list_stale(summaries(s, d)).select("profile", "topic_key", "position")


@query(f"""
    WITH {SUMMARIES}, o AS (SELECT profile FROM active a WHERE created_at < {NOW} - INTERVAL 5 MINUTE AND NOT EXISTS (SELECT 1 FROM rel WHERE source_id = a.id OR target_id = a.id)),
    drift AS (SELECT su.profile FROM su LEFT JOIN ts USING (profile, topic_key) WHERE status = 'fresh' AND su.source_hash <> coalesce(ts.source_hash, sha256(''))),
    st AS (SELECT profile FROM life WHERE stage = 'stable' AND stage_entered_at < {NOW} - INTERVAL 90 DAY AND memory_id IN (SELECT id FROM active)),
    con AS (SELECT a.profile FROM rel JOIN mem a ON a.id = source_id JOIN mem b ON b.id = target_id AND b.profile = a.profile WHERE relationship = 'contradicts'),
    c AS (SELECT profile, 1 AS k FROM o UNION ALL SELECT profile, 2 FROM drift UNION ALL SELECT profile, 3 FROM st UNION ALL SELECT profile, 4 FROM con UNION ALL SELECT profile, 5 FROM su WHERE status = 'stale')
    SELECT profile, count(*) FILTER (WHERE k = 1) AS orphans, count(*) FILTER (WHERE k = 2) AS drift, count(*) FILTER (WHERE k = 3) AS stale_memories, count(*) FILTER (WHERE k = 4) AS contradictions, count(*) FILTER (WHERE k = 5) AS stale_summaries,
      count(*) AS total, CAST(count(*) = 0 AS INTEGER) AS healthy FROM c GROUP BY profile""", "active rel life")
def lint_report(s, d):
    m, e, now, every = mem(s, d), X.relationships(s, d), X.as_of(), 2**31 - 1
    su = summaries(s, d)
    return R.lint_report({
        "orphans": R.orphans(m, e, now, every), "drift": R.summary_drift(su, M.topic_sources(m, now)), "stale_memories": R.stale_lifecycle(X.lifecycle(s, d), m, now, every),
        "contradictions": G.contradictions(e, m, every), "stale_summaries": su.filter("status = 'stale'"),
    })


@query(f"""
    WITH {SUMMARIES}, w AS (SELECT profile, count(*) AS topics, count(*) FILTER (WHERE status = 'fresh') AS fresh, count(*) FILTER (WHERE status = 'stale') AS stale FROM su GROUP BY profile),
    linked AS (SELECT DISTINCT id FROM (SELECT source_id AS id FROM rel WHERE source_id <> target_id UNION ALL SELECT target_id FROM rel WHERE source_id <> target_id)),
    b AS (SELECT m.profile, count(*) AS n, epoch({NOW}) / 3600 - epoch(max(created_at)) / 3600 AS h, avg(len(tags)) AS t, 100.0::DOUBLE * count(*) FILTER (WHERE l.id IS NULL) / count(*) AS o FROM mem m LEFT JOIN linked l USING (id) GROUP BY m.profile),
    x AS (SELECT b.profile, CASE WHEN h <= 24 THEN 10.0::DOUBLE WHEN h <= 72 THEN 7.99::DOUBLE - (h - 24) * 2.99::DOUBLE / 48 ELSE greatest(0.0::DOUBLE, 4.99::DOUBLE - least(h - 72, 720) * 4.99::DOUBLE / 720) END AS freshness,
      CASE WHEN n >= 100 THEN 10.0::DOUBLE WHEN n >= 10 THEN 5 + (n - 10)::DOUBLE / 89 * 2.99::DOUBLE ELSE n::DOUBLE / 9 * 4.99::DOUBLE END AS size,
      CASE WHEN coalesce(topics, 0) = 0 THEN 10.0::DOUBLE WHEN stale > 0 THEN least(fresh::DOUBLE / topics * 10, 7.9::DOUBLE) ELSE fresh::DOUBLE / topics * 10 END AS coverage,
      least(t / 2, 1.0::DOUBLE) * 5 + greatest(0.0::DOUBLE, 1 - o / 50) * 5 AS shape FROM b LEFT JOIN w USING (profile))
    SELECT profile, round(freshness, 6) AS freshness, round(size, 6) AS size, round(coverage, 6) AS coverage, round(shape, 6) AS shape, round((freshness + size + coverage + shape) / 4, 6) AS mean,
      CASE WHEN (freshness + size + coverage + shape) / 4 >= 8 THEN 'GREEN' WHEN (freshness + size + coverage + shape) / 4 >= 5 THEN 'AMBER' ELSE 'RED' END AS zone FROM x""", "mem active rel")
def health_scores(s, d):
    h = R.health_scores(mem(s, d), X.relationships(s, d), summaries(s, d), X.as_of())
    return h.select("profile", *[r6(c).alias(c) for c in ("freshness", "size", "coverage", "shape", "mean")], "zone")


@query("SELECT * FROM (SELECT event_id, profile, operation, CAST(epoch_us(event_time) AS BIGINT) AS at, row_number() OVER (PARTITION BY profile ORDER BY event_time DESC, event_id DESC) AS rank FROM au WHERE operation = 'error') WHERE rank <= 50", "au")
def audit_query(s, d):
    return R.audit_query(X.audit(s, d), 50, "error").select("event_id", "profile", "operation", F.unix_micros("event_time").alias("at"), "rank")


@query("""SELECT profile, operation, strftime(event_time, '%Y-%m-%d') AS day, embedding_model, count(*) AS events, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost,
    grouping(profile, operation, strftime(event_time, '%Y-%m-%d'), embedding_model) AS level FROM au GROUP BY ROLLUP (profile, operation, strftime(event_time, '%Y-%m-%d'), embedding_model)""", "au")
def audit_usage(s, d):
    return R.audit_usage(X.audit(s, d)).withColumn("cost", F.col("cost").cast("double"))


@query("SELECT * FROM (SELECT profile, strftime(created_at, '%Y-%m-%d') AS day, round(avg(importance), 3) AS avg_importance, count(*) AS n, row_number() OVER (PARTITION BY profile ORDER BY strftime(created_at, '%Y-%m-%d') DESC) AS rank FROM mem GROUP BY profile, day) WHERE rank <= 30", "mem")
def importance_by_day(s, d):
    return R.importance_by_day(mem(s, d))


# --- ageing


@query(f"""SELECT id, CAST(e AS INTEGER) AS eligible, round(CASE WHEN e THEN greatest(0.05, importance * pow(CASE WHEN access_count >= 10 THEN 0.99::DOUBLE ELSE 0.95::DOUBLE END, (epoch({NOW}) - epoch(coalesce(last_accessed_at, created_at))) / 86400 / 30)) ELSE importance END, 6) AS importance
    FROM (SELECT *, (expires_at IS NULL OR expires_at > {NOW}) AND importance > 0.05 AND (last_accessed_at IS NULL OR last_accessed_at < {NOW} - INTERVAL 7 DAY) AS e FROM mem)""", "mem")
def hebbian_decay(s, d):
    return M.hebbian_decay(mem(s, d), X.as_of()).select("id", "eligible", r6("importance").alias("importance"))


MOVED = f"((stage = 'fresh' AND stage_entered_at <= {NOW} - INTERVAL 1 HOUR AND (surprise >= 0.3::DOUBLE OR importance >= 0.5::DOUBLE)) OR (stage = 'editing' AND stage_entered_at <= {NOW} - INTERVAL 30 MINUTE))"


@query(f"SELECT memory_id, CASE WHEN {MOVED} THEN 'stable' ELSE stage END AS stage, CAST(epoch(CASE WHEN {MOVED} THEN {NOW} ELSE stage_entered_at END) AS BIGINT) AS entered, CAST({MOVED} AS INTEGER) AS moved FROM life l JOIN mem m ON m.id = l.memory_id", "life mem")
def advance_lifecycle(s, d):
    return M.advance_lifecycle(X.lifecycle(s, d), mem(s, d), X.as_of()).select("memory_id", "stage", secs("stage_entered_at").alias("entered"), "moved")


@query(f"SELECT memory_id, CASE WHEN memory_id % 4 = 0 AND stage = 'stable' THEN 'editing' ELSE stage END AS stage, CAST(epoch(CASE WHEN memory_id % 4 = 0 AND stage = 'stable' THEN {NOW} ELSE stage_entered_at END) AS BIGINT) AS entered FROM life", "life")
def open_editing(s, d):
    return M.open_editing(X.lifecycle(s, d), mem(s, d).filter("id % 4 = 0").select("id"), X.as_of()).select("memory_id", "stage", secs("stage_entered_at").alias("entered"))


@query("SELECT m.id AS memory_id, m.profile, coalesce(l.stage, 'fresh') AS stage, CAST(epoch(coalesce(l.stage_entered_at, m.created_at)) AS BIGINT) AS entered FROM mem m LEFT JOIN (SELECT * FROM life WHERE memory_id % 3 <> 0) l ON l.memory_id = m.id", "mem life")
def init_lifecycle(s, d):
    return M.init_lifecycle(X.lifecycle(s, d).filter("memory_id % 3 <> 0"), mem(s, d)).select("memory_id", "profile", "stage", secs("stage_entered_at").alias("entered"))


@query("SELECT profile, count(*) FILTER (WHERE stage = 'fresh') AS fresh, count(*) FILTER (WHERE stage = 'stable') AS stable, count(*) FILTER (WHERE stage = 'editing') AS editing FROM life GROUP BY profile", "life")
def lifecycle_counts(s, d):
    return M.lifecycle_counts(X.lifecycle(s, d))


@query(f"""SELECT id, CASE WHEN h >= 720 * r THEN 2 WHEN h >= 168 * r THEN 1 ELSE 0 END AS target_level FROM (SELECT id, (epoch({NOW}) - epoch(created_at)) / 3600 AS h,
    (CASE WHEN importance > 0.7::DOUBLE THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN confidence > 0.8::DOUBLE THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN access_count > 10 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS r FROM mem)""", "mem")
def compression_target(s, d):
    return M.compression_target(mem(s, d), X.as_of()).select("id", "target_level")


@query(f"SELECT profile, count(*) FILTER (WHERE expires_at < {NOW}) AS expired FROM mem GROUP BY profile", "mem")
def count_expired(s, d):
    return M.count_expired(mem(s, d), X.as_of())


@query(f"SELECT id, profile FROM mem WHERE NOT coalesce(expires_at < {NOW}, false)", "mem")
def expire(s, d):
    return M.expire(mem(s, d), X.as_of()).select("id", "profile")


@query("SELECT id, CAST(epoch(created_at) AS BIGINT) + ttl_days * 86400 AS expires_at FROM mem LEFT JOIN settings USING (profile)", "mem settings")
def apply_ttl(s, d):
    return M.apply_ttl(mem(s, d), X.profile_settings(s)).select("id", secs("expires_at").alias("expires_at"))


ACCESS = "acc AS (SELECT event_id // 3 AS call_id, (event_id * 7) % nd.n AS id, date_trunc('second', ts) AS seen FROM events, nd)"


def accesses(s, d):
    n = X.read(s, d, "documents").count()
    return X.read(s, d, "events").select(F.floor(F.col("event_id") / 3).alias("call_id"), (F.col("event_id") * 7 % n).alias("id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))


@query(f"WITH {ACCESS}, c AS (SELECT id, count(DISTINCT call_id) AS calls, max(seen) AS last_at FROM acc GROUP BY id) SELECT m.id, access_count + coalesce(calls, 0) AS access_count, CAST(epoch(greatest(last_accessed_at, last_at)) AS BIGINT) AS last_accessed_at FROM mem m LEFT JOIN c USING (id)", "mem nd")
def record_access(s, d):
    return M.record_access(mem(s, d), accesses(s, d)).select("id", "access_count", secs("last_accessed_at").alias("last_accessed_at"))


@query("""
    WITH sig AS (SELECT event_id % nd.n AS id, row_number() OVER (PARTITION BY event_id % nd.n ORDER BY ts, event_id) AS k, CASE WHEN event_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0.85::DOUBLE END AS s FROM events, nd),
    f AS (SELECT id, 0::BIGINT AS k, confidence AS c FROM mem UNION ALL SELECT f.id, f.k + 1, 0.95::DOUBLE * (c * s / (c * s + (1 - c) * (1 - s))) + 0.025::DOUBLE FROM f JOIN sig ON sig.id = f.id AND sig.k = f.k + 1)
    SELECT id, round(arg_max(c, k), 6) AS confidence FROM f GROUP BY id""", "mem nd")
def update_confidence(s, d):
    n = X.read(s, d, "documents").count()
    signals = X.read(s, d, "events").select((F.col("event_id") % n).alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, 0.15).otherwise(0.85).alias("signal"))
    return M.update_confidence(mem(s, d), signals).select("id", r6("confidence").alias("confidence"))


@query(f"""SELECT id, round(CASE WHEN a < 3 THEN exp(-coalesce(decay_lambda, 0.1) * a) ELSE pow(a / 3, -coalesce(decay_beta, 0.4)) END, 6) AS decay FROM (SELECT id, profile, (epoch({NOW}) - epoch(created_at)) / 86400 AS a FROM mem) LEFT JOIN settings USING (profile)""", "mem settings")
def hybrid_decay(s, d):
    return M.hybrid_decay_score(mem(s, d), X.profile_settings(s), X.as_of()).select("id", r6("decay").alias("decay"))


# --- search


@query("SELECT query_id, id, similarity, rank FROM vtop", "vtop", k=10)
def vector_topk(s, d):
    return S.vector_topk(X.queries(s, d), mem(s, d, True), X.as_of(), 10).select("query_id", "id", "similarity", "rank")


KEYWORD = r"""tok AS (SELECT id, profile, list_filter(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}_]+'), lambda x: len(x) > 0) AS words FROM active),
    qt AS (SELECT query_id, profile, unnest(t) AS term, len(t) AS n_terms FROM (SELECT query_id, profile, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: len(x) > 0)) AS t FROM q)),
    tf AS (SELECT id, profile, n_words, w AS term, count(*) AS tf FROM (SELECT id, profile, len(words) AS n_words, unnest(words) AS w FROM tok) WHERE w IN (SELECT term FROM qt) GROUP BY ALL),
    km AS (SELECT query_id, id, n_words, sum(tf)::DOUBLE / n_words AS r FROM qt JOIN tf USING (profile, term) GROUP BY query_id, id, n_words, n_terms HAVING count(*) = n_terms),
    kr AS (SELECT query_id, id, round(r / (r + 1), 6) AS keyword_rank FROM km),
    ktop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_rank DESC, id) AS rank FROM kr) WHERE rank <= {k})"""


def keyword_sql(k: int) -> str:
    return KEYWORD.format(k=k)


@query(f"WITH {keyword_sql(10)} SELECT query_id, id, keyword_rank, rank FROM ktop", "active q")
def keyword_topk(s, d):
    return S.keyword_topk(X.queries(s, d), mem(s, d), X.as_of(), 10)


@query(f"WITH {keyword_sql(10)} SELECT query_id, id, keyword_rank, rank FROM ktop", "active q")
def keyword_index(s, d):
    """The same by a stored index; the search itself gets memories without their contents."""
    m = mem(s, d)
    return S.keyword_topk(X.queries(s, d), m.drop("content"), X.as_of(), 10, index=S.KeywordIndex.build(m)).select("query_id", "id", "keyword_rank", "rank")


@query("SELECT id, round(graph_boost, 6) AS graph_boost FROM boost", "boost")
def graph_boost(s, d):
    return S.graph_boost(X.relationships(s, d)).select("id", r6("graph_boost").alias("graph_boost"))


def boosted(importance: bool) -> str:
    return f"""* {'importance' if importance else '1.0::DOUBLE'} * (1 + 0.1::DOUBLE * ln(access_count + 1)) * confidence * (1 + 0.2::DOUBLE * coalesce(graph_boost, 0))
      * (1 + len(list_filter(q.tags, lambda x: list_contains(m.tags, x)))::DOUBLE / len(q.tags) * 0.4::DOUBLE)"""


HYBRID = f"""{keyword_sql(30)},
    fu AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, 0.7::DOUBLE / (10 + coalesce(v.rank, 30)) + 0.3::DOUBLE / (10 + coalesce(k.rank, 30)) AS score, similarity, keyword_rank FROM vtop v FULL JOIN ktop k ON v.query_id = k.query_id AND v.id = k.id),
    hs0 AS (SELECT fu.query_id, fu.id, round(score {boosted(True)}, 9) AS relevance FROM fu JOIN mem m USING (id) JOIN q ON q.query_id = fu.query_id LEFT JOIN boost b ON b.id = fu.id),
    hs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM hs0) WHERE rank <= 10)"""


@query(f"WITH {HYBRID} SELECT query_id, id, relevance, rank FROM hs", "vtop q active boost", k=30)
def hybrid_search(s, d):
    return S.hybrid_search(X.queries(s, d), mem(s, d, True), X.relationships(s, d), X.as_of(), 10)


@query(f"""WITH {HYBRID}, lf AS (SELECT fu.query_id, fu.id, round((0.7::DOUBLE * coalesce(similarity, 0) + 0.3::DOUBLE * coalesce(keyword_rank, 0)) {boosted(False)}, 9) AS relevance FROM fu JOIN mem m USING (id) JOIN q ON q.query_id = fu.query_id LEFT JOIN boost b ON b.id = fu.id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM lf) WHERE rank <= 10""", "vtop q active boost", k=30)
def linear_fusion_search(s, d):
    return S.linear_fusion_search(X.queries(s, d), mem(s, d, True), X.relationships(s, d), X.as_of(), 10)


@query(f"""WITH mm AS (SELECT s.query_id, s.id, similarity, round(similarity * ln(1 + exp(ln(access_count + 1) - 0.5::DOUBLE * ln(greatest((epoch({NOW}) - epoch(coalesce(last_accessed_at, created_at))) / 86400, 0.01) / (access_count + 1)))) * confidence * (1 + 0.2::DOUBLE * coalesce(graph_boost, 0)), 6) AS relevance
      FROM sims s JOIN mem m USING (id) LEFT JOIN boost b ON b.id = s.id WHERE similarity > 0.3)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM mm) WHERE rank <= 10""", "sims boost")
def match_memories(s, d):
    return S.match_memories(X.queries(s, d), mem(s, d, True), X.relationships(s, d), X.as_of(), 0.3, 10)


@query("""WITH sp AS (SELECT q.query_id, m.id, round(list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN active m ON m.profile IN ('de', 'fr'))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sp) WHERE rank <= 5""", "q active")
def multi_profile_search(s, d):
    return S.vector_topk(X.queries(s, d).withColumn("profiles", F.array(F.lit("de"), F.lit("fr"))), mem(s, d, True), X.as_of(), 5).select("query_id", "id", "similarity", "rank")


@query("""WITH a AS (SELECT query_id AS anchor_id, profile, w FROM (SELECT query_id, profile, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM q) WHERE len(w) > 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(w) DESC, i) = 1)
    SELECT * FROM (SELECT anchor_id, id, CAST(epoch(created_at) AS BIGINT) AS created_at, 0.5::DOUBLE AS relevance, row_number() OVER (PARTITION BY anchor_id ORDER BY created_at DESC, id) AS rank FROM a JOIN active m USING (profile) WHERE contains(lower(content), w)) WHERE rank <= 10""", "q active")
def content_contains(s, d):
    return S.content_contains(mem(s, d), X.queries(s, d).select(F.col("query_id").alias("anchor_id"), "profile", F.col("text").alias("anchor")), X.as_of()).withColumn("created_at", secs("created_at"))


def hybrid(s, d, k=10):
    return S.hybrid_search(X.queries(s, d), mem(s, d, True), X.relationships(s, d), X.as_of(), k)


@query(f"WITH {HYBRID}, g AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id), h AS (SELECT hs.query_id, hs.rank FROM hs JOIN gold USING (query_id, id)),"
       " x AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) AS h10, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY query_id)"
       " SELECT q.query_id, round(CASE WHEN n_gold IS NULL THEN 0 ELSE coalesce(h5, 0)::DOUBLE / n_gold END, 6) AS recall5, round(CASE WHEN n_gold IS NULL THEN 0 ELSE coalesce(h10, 0)::DOUBLE / n_gold END, 6) AS recall10,"
       " round(CASE WHEN n_gold IS NULL THEN 0 ELSE coalesce(1.0::DOUBLE / f, 0) END, 6) AS mrr, round(CASE WHEN n_gold IS NULL THEN 0 ELSE coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_gold, 10) + 1) t(i)) END, 6) AS ndcg10"
       " FROM q LEFT JOIN g USING (query_id) LEFT JOIN x USING (query_id)", "vtop q active boost gold", k=30)
def retrieval_metrics(s, d):
    questions = X.queries(s, d).select("query_id", F.lit("fact").alias("category"))
    return R.retrieval_metrics(hybrid(s, d), X.gold(s, d), questions, (5, 10)).select("query_id", *[r6(c).alias(c) for c in ("recall5", "recall10", "mrr", "ndcg10")])


# --- graph


@query(f"""WITH e AS (SELECT source_id AS x, target_id AS y, strength FROM rel WHERE strength >= 0.5 UNION ALL SELECT target_id, source_id, strength FROM rel WHERE strength >= 0.5 AND source_id <> target_id),
    st AS (SELECT id AS start FROM active),
    d1 AS (SELECT start, y AS id, max(strength) AS strength FROM st JOIN e ON x = start WHERE y IN (SELECT id FROM active) AND y <> start GROUP BY ALL),
    d2 AS (SELECT d1.start, y AS id, max(e.strength) AS strength FROM d1 JOIN e ON x = d1.id WHERE y IN (SELECT id FROM active) AND y <> start AND NOT EXISTS (SELECT 1 FROM d1 o WHERE o.start = d1.start AND o.id = y) GROUP BY ALL),
    u AS (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2)
    SELECT * FROM (SELECT start, id, depth, round(strength, 6) AS strength, row_number() OVER (PARTITION BY start ORDER BY depth, strength DESC, id) AS rank FROM u) WHERE rank <= 20""", "rel active")
def related_memories(s, d):
    starts = B.active_memories(mem(s, d), X.as_of()).select(F.col("id").alias("start"))
    return G.related_memories(starts, X.relationships(s, d), mem(s, d), X.as_of(), 2).withColumn("strength", r6("strength"))


@query("""WITH e AS (SELECT source_id AS x, target_id AS y, strength FROM rel WHERE strength >= 0.5 UNION ALL SELECT target_id, source_id, strength FROM rel WHERE strength >= 0.5 AND source_id <> target_id),
    h0 AS (SELECT query_id, id, similarity AS relevance, 0 AS depth FROM vtop),
    h1 AS (SELECT query_id, y AS id, max(relevance * strength) AS relevance, 1 AS depth FROM h0 JOIN e ON x = h0.id WHERE y IN (SELECT id FROM active) GROUP BY query_id, y),
    h2 AS (SELECT query_id, y AS id, max(relevance * strength) AS relevance, 2 AS depth FROM h1 JOIN e ON x = h1.id WHERE y IN (SELECT id FROM active) GROUP BY query_id, y)
    SELECT query_id, id, round(relevance, 9) AS relevance, depth FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY relevance DESC, depth) AS n FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)) WHERE n = 1""", "vtop rel active", k=5)
def explore_graph(s, d):
    seeds = S.vector_topk(X.queries(s, d), mem(s, d, True), X.as_of(), 5).select("query_id", "id", F.col("similarity").alias("relevance"))
    return G.explore_graph(seeds, X.relationships(s, d), mem(s, d), X.as_of(), 2).select("query_id", "id", F.round("relevance", 9).alias("relevance"), "depth")


@query("""WITH st AS (SELECT DISTINCT id AS start FROM mem),
    d1 AS (SELECT start, target_id AS id, start AS connected_from, strength FROM st JOIN rel ON source_id = start WHERE target_id <> start QUALIFY row_number() OVER (PARTITION BY start, target_id ORDER BY strength DESC) = 1),
    d2 AS (SELECT start, target_id AS id, d1.id AS connected_from, rel.strength FROM d1 JOIN rel ON source_id = d1.id WHERE target_id <> start AND NOT EXISTS (SELECT 1 FROM d1 o WHERE o.start = d1.start AND o.id = target_id)
      QUALIFY row_number() OVER (PARTITION BY start, target_id ORDER BY rel.strength DESC, d1.id) = 1),
    u AS (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2)
    SELECT * FROM (SELECT start, id, depth, connected_from, 'outgoing' AS direction_used, round(strength, 6) AS strength, row_number() OVER (PARTITION BY start ORDER BY depth, strength DESC, id) AS rank FROM u) WHERE rank <= 50""", "rel mem")
def walk_graph(s, d):
    return G.walk_graph(mem(s, d).select(F.col("id").alias("start")), X.relationships(s, d), 2, "outgoing").withColumn("strength", r6("strength"))


@query("""SELECT * FROM (SELECT source_id, target_id, a.profile, CAST(epoch(r.created_at) AS BIGINT) AS created_at, count(*) OVER (PARTITION BY a.profile) AS total, row_number() OVER (PARTITION BY a.profile ORDER BY r.created_at DESC, source_id, target_id) AS rank
    FROM rel r JOIN mem a ON a.id = source_id JOIN mem b ON b.id = target_id AND b.profile = a.profile WHERE relationship = 'contradicts') WHERE rank <= 10""", "rel mem")
def contradictions(s, d):
    return G.contradictions(X.relationships(s, d), mem(s, d)).select("source_id", "target_id", "profile", secs("created_at").alias("created_at"), "total", "rank")


def nearest(s, d, k=30):
    return S.vector_topk(X.queries(s, d), mem(s, d, True), X.as_of(), k)


@query("""SELECT DISTINCT a.query_id, CASE WHEN ma.created_at < mb.created_at THEN a.id ELSE b.id END AS stale_id, CASE WHEN ma.created_at < mb.created_at THEN b.id ELSE a.id END AS newer_id
    FROM rel JOIN vtop a ON a.id = source_id JOIN vtop b ON b.id = target_id AND b.query_id = a.query_id JOIN mem ma ON ma.id = a.id JOIN mem mb ON mb.id = b.id WHERE relationship = 'contradicts' AND ma.created_at <> mb.created_at""", "vtop rel mem", k=100)
def in_result_contradictions(s, d):
    return G.in_result_contradictions(nearest(s, d, 100), X.relationships(s, d), mem(s, d))


OUTSIDE = """c AS (SELECT source_id AS x, target_id AS y, strength FROM rel WHERE relationship = 'contradicts' UNION ALL SELECT target_id, source_id, strength FROM rel WHERE relationship = 'contradicts' AND source_id <> target_id),
    outside AS (SELECT v.query_id, v.id AS in_id, y AS other_id, strength FROM vtop v JOIN c ON x = v.id WHERE NOT EXISTS (SELECT 1 FROM vtop w WHERE w.query_id = v.query_id AND w.id = y))"""


@query(f"WITH {OUTSIDE} SELECT query_id, in_id, other_id, round(strength, 6) AS strength FROM outside", "vtop rel", k=30)
def out_of_result_contradictions(s, d):
    return G.out_of_result_contradictions(nearest(s, d), X.relationships(s, d)).withColumn("strength", r6("strength"))


GAPS = f"""{OUTSIDE}, f AS (SELECT query_id, min(a) AS newest_age, count(*) FILTER (WHERE a > 90) AS n_old, count(*) FILTER (WHERE confidence < 0.5) AS n_low, max(confidence) AS max_confidence
      FROM (SELECT v.query_id, confidence, CAST(greatest(floor((epoch({NOW}) - epoch(created_at)) / 86400), 0) AS BIGINT) AS a FROM vtop v JOIN mem USING (id)) GROUP BY query_id),
    o AS (SELECT query_id, count(*) AS n FROM outside GROUP BY query_id),
    gap AS (SELECT f.*, coalesce(o.n, 0) AS n_contradictions, CAST(coalesce(o.n, 0) > 0 OR n_low > 0 OR newest_age > 90 AS INTEGER) AS material FROM f LEFT JOIN o USING (query_id))"""


def gaps(s, d):
    top5 = nearest(s, d, 5)
    return R.gap_signals(top5, mem(s, d), G.out_of_result_contradictions(top5, X.relationships(s, d)), X.as_of())


@query(f"WITH {GAPS} SELECT query_id, newest_age, n_old, n_low, round(max_confidence, 6) AS max_confidence, n_contradictions, material FROM gap", "vtop rel mem", k=5)
def gap_signals(s, d):
    return gaps(s, d).withColumn("max_confidence", r6("max_confidence"))


@query(f"""WITH {GAPS} SELECT query_id, CASE WHEN material = 1 THEN 'Gaps: ' || concat_ws('; ', CASE WHEN newest_age > 90 THEN 'newest result is ' || newest_age || ' days old' END, CASE WHEN n_low > 0 THEN n_low || ' of low confidence' END,
    CASE WHEN n_contradictions > 0 THEN n_contradictions || ' contradicted by memories not shown' END) || '.' ELSE '' END AS note FROM gap""", "vtop rel mem", k=5)
def gap_note(s, d):
    return R.gap_note(gaps(s, d)).select("query_id", "note")


@query("""WITH p AS (SELECT a.memory_id AS start, b.memory_id AS id, count(*) AS shared FROM me a JOIN me b ON a.entity_id = b.entity_id AND a.memory_id <> b.memory_id GROUP BY ALL HAVING count(*) >= 2)
    SELECT * FROM (SELECT start, p.id, shared, row_number() OVER (PARTITION BY start ORDER BY shared DESC, om.created_at DESC, p.id) AS rank FROM p JOIN om ON om.id = p.id WHERE NOT EXISTS (SELECT 1 FROM rel WHERE (source_id = start AND target_id = p.id) OR (target_id = start AND source_id = p.id))) WHERE rank <= 10""", "me om rel")
def suggest_connections(s, d):
    return G.suggest_connections(X.memory_entities(s, d), X.relationships(s, d), X.order_memories(s, d)).select("start", "id", "shared", "rank")


# --- re-ranking


@query("""WITH w AS (SELECT a.query_id, a.id, max_by(other, (mo.created_at, other)) AS superseded_by FROM vtop a JOIN (SELECT source_id AS x, target_id AS other FROM rel WHERE relationship = 'contradicts' UNION ALL SELECT target_id, source_id FROM rel WHERE relationship = 'contradicts') c ON x = a.id
      JOIN mem m ON m.id = a.id JOIN mem mo ON mo.id = other WHERE mo.created_at > m.created_at GROUP BY a.query_id, a.id)
    SELECT v.query_id, v.id, CASE WHEN superseded_by IS NULL THEN similarity ELSE -1 END AS relevance, superseded_by, row_number() OVER (PARTITION BY v.query_id ORDER BY CASE WHEN superseded_by IS NULL THEN similarity ELSE -1 END DESC, similarity DESC, v.id) AS rank FROM vtop v LEFT JOIN w USING (query_id, id)""", "vtop rel mem", k=20)
def supersede(s, d):
    results = nearest(s, d, 20).select("query_id", "id", F.col("similarity").alias("relevance"))
    return K.supersede(results, X.relationships(s, d), mem(s, d)).select("query_id", "id", "relevance", "superseded_by", "rank")


@query("""WITH x AS (SELECT v.query_id, v.id, similarity, (epoch_us(created_at) - (epoch_us(TIMESTAMP '2024-02-10') + epoch_us(TIMESTAMP '2024-02-17')) / 2) / 86400e6::DOUBLE AS d, CASE v.query_id % 3 WHEN 0 THEN 'future' WHEN 1 THEN 'past' ELSE 'near' END AS dir FROM vtop v JOIN mem USING (id)),
    y AS (SELECT query_id, id, round(similarity * CASE WHEN (dir = 'future' AND d < -0.5) OR (dir = 'past' AND d > 0.5) THEN 0.1::DOUBLE WHEN abs(d) < 0.5 THEN 1.5::DOUBLE ELSE 1 + 0.5::DOUBLE * exp(-d * d / 18) END, 9) AS relevance FROM x)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM y""", "vtop mem", k=20)
def temporal_rerank(s, d):
    results = nearest(s, d, 20).join(mem(s, d).select("id", F.col("created_at").alias("at")), "id").select("query_id", "id", F.col("similarity").alias("relevance"), "at")
    way = F.element_at(F.array(F.lit("future"), F.lit("past"), F.lit("near")), (F.col("query_id") % 3 + 1).cast("int"))
    day = lambda x: F.lit(x).cast("timestamp")
    anchors = X.queries(s, d).select("query_id", day("2024-02-10").alias("start"), day("2024-02-17").alias("stop"), way.alias("direction"))
    return K.temporal_rerank(results, anchors)


@query("""WITH r AS (SELECT v.query_id, v.id, similarity, CASE WHEN v.id % 6 = 0 THEN 1 + v.id % 28 END AS day FROM vtop v),
    a AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, count(day) OVER (PARTITION BY query_id) AS dated, row_number() OVER (PARTITION BY query_id ORDER BY day NULLS LAST, id) - 1 AS seq FROM r),
    b AS (SELECT *, CASE WHEN day IS NOT NULL THEN least(seq // greatest(dated // least(8, dated), 1), least(8, dated) - 1) END AS bucket FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY similarity DESC, id) AS turn FROM b),
    e AS (SELECT query_id, id, similarity AS relevance, CASE WHEN total > 8 THEN row_number() OVER (PARTITION BY query_id ORDER BY bucket IS NULL, CASE WHEN bucket IS NOT NULL THEN turn END NULLS FIRST, bucket NULLS FIRST, similarity DESC, id) ELSE row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) END AS rank FROM c)
    SELECT * FROM e WHERE rank <= 8""", "vtop", k=30)
def strided_select(s, d):
    day = F.when(F.col("id") % 6 == 0, F.date_add(F.lit("2024-02-01").cast("date"), (F.col("id") % 28).cast("int")))
    return K.strided_select(nearest(s, d, 30).select("query_id", "id", F.col("similarity").alias("relevance"), day.alias("day")), 8)


# --- entities


@query("SELECT entity_id, count(DISTINCT CAST(created_at AS DATE)) AS session_count, round(ln(1 + count(DISTINCT CAST(created_at AS DATE))), 6) AS temporal_span FROM me JOIN om ON om.id = memory_id GROUP BY entity_id", "me om")
def temporal_span(s, d):
    return E.temporal_span(X.memory_entities(s, d), X.order_memories(s, d)).withColumn("temporal_span", r6("temporal_span"))


@query("SELECT profile, count(DISTINCT entity_id) AS n_entities, count(*) AS n_edges, round(count(*)::DOUBLE / count(DISTINCT entity_id), 6) AS density, round(CASE WHEN count(*)::DOUBLE / count(DISTINCT entity_id) <= 1.5 THEN 0.3 WHEN count(*)::DOUBLE / count(DISTINCT entity_id) >= 3.5 THEN 0.05 ELSE 0.3 - (count(*)::DOUBLE / count(DISTINCT entity_id) - 1.5) / 2 * 0.25 END, 6) AS weight FROM me GROUP BY profile", "me")
def graph_density(s, d):
    g = E.graph_density(X.memory_entities(s, d))
    return g.withColumn("weight", r6(E.activation_weight(F.col("density")))).withColumn("density", r6("density"))


@query("""WITH fac AS (SELECT entity_id, 0.65::DOUBLE * least(temporal_span, 3) / ln(1 + greatest(mention_count, 1)) AS f FROM ent WHERE entity_type <> 'person'),
    sd AS (SELECT DISTINCT o_orderkey AS query_id, me.profile, me.entity_id FROM orders JOIN me ON me.memory_id = o_orderkey WHERE o_orderkey % 100 = 0),
    h1 AS (SELECT query_id, sd.profile, b.entity_id, least(max(f), 1) AS a FROM sd JOIN me a ON a.profile = sd.profile AND a.entity_id = sd.entity_id JOIN me b ON b.memory_id = a.memory_id AND b.entity_id <> a.entity_id JOIN fac ON fac.entity_id = b.entity_id WHERE f > 0.1 GROUP BY ALL),
    h2 AS (SELECT query_id, h1.profile, b.entity_id, least(max(h1.a * f), 1) AS a FROM h1 JOIN me a ON a.profile = h1.profile AND a.entity_id = h1.entity_id JOIN me b ON b.memory_id = a.memory_id AND b.entity_id <> a.entity_id JOIN fac ON fac.entity_id = b.entity_id WHERE h1.a * f > 0.1 GROUP BY ALL),
    ev AS (SELECT query_id, profile, entity_id, max(a) AS a FROM (SELECT query_id, profile, entity_id, 1.0::DOUBLE AS a FROM sd UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
    ma AS (SELECT query_id, memory_id AS id, round(max(a), 6) AS activation FROM ev JOIN me USING (profile, entity_id) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, id) AS rank FROM ma) WHERE rank <= 50""", "ent me")
def spread_activation(s, d):
    me = X.memory_entities(s, d)
    seeds = me.filter("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "profile", "entity_id")
    return E.spread_activation(seeds, me, X.entities(s, d))


@query("""WITH t AS (SELECT DISTINCT id AS memory_id, string_split(tag, ':')[1] AS entity_type, string_split(tag, ':')[2] AS canonical_name FROM (SELECT id, unnest(tags) AS tag FROM active) WHERE string_split(tag, ':')[2] <> '')
    SELECT entity_type, canonical_name, count(*) AS mention_count, CASE WHEN entity_type IN ('entity', 'file', 'error', 'quantity') THEN 'syntactic' ELSE 'inferred' END AS evidence_class FROM t GROUP BY ALL""", "active")
def link_entities(s, d):
    m = B.active_memories(mem(s, d), X.as_of()).select(F.col("id").alias("memory_id"), "profile", "tags")
    none = s.createDataFrame([], "canonical_name string, entity_type string, mention_count long, evidence_class string")
    links = s.createDataFrame([], "memory_id long, profile string, canonical_name string, entity_type string")
    return E.link_entities(m, none, links)[0]


# --- typed edges


VOCABULARY = ["OWNED_BY", "PART_OF", "DEPENDS_ON"]


@query("""WITH a AS (SELECT o_orderkey AS id, 'customer:' || o_custkey AS subject, 'PART_OF' AS predicate, 'nation:' || (o_custkey % 25) AS object, o_orderdate AS seen FROM orders)
    SELECT id, subject, object, CAST(epoch(seen) AS BIGINT) AS valid_from, CAST(epoch(lead(seen) OVER w) AS BIGINT) AS valid_to, lead(id) OVER w AS superseded_by FROM a WINDOW w AS (PARTITION BY subject, predicate, object ORDER BY seen, id)""", "")
def store_triples(s, d):
    return history(s, d).select("id", "subject", "object", secs("valid_from").alias("valid_from"), secs("valid_to").alias("valid_to"), "superseded_by")


def history(s, d):
    o = X.read(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("PART_OF").alias("predicate"),
        F.concat(F.lit("nation:"), (F.col("o_custkey") % 25).cast("string")).alias("object"), F.lit("p").alias("profile"), F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    return T.store_triples(o, VOCABULARY)


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS seen, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS till FROM orders)
    SELECT id, 'customer:' || o_custkey AS subject FROM a WHERE seen <= TIMESTAMP '1998-06-01' AND (till IS NULL OR TIMESTAMP '1998-06-01' < till)""", "")
def edges_as_of(s, d):
    return T.edges_as_of(history(s, d), F.lit("1998-06-01").cast("timestamp")).select("id", "subject")


@query("SELECT max(o_orderkey) FILTER (WHERE rn = 1) AS id, 'customer:' || o_custkey AS subject FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) GROUP BY o_custkey", "")
def current_edges(s, d):
    return T.current_edges(history(s, d)).select("id", "subject")


@query("""WITH st AS (SELECT 'order:' || o_orderkey AS start FROM orders),
    a AS (SELECT start, f.subject, f.predicate, f.object, 1 AS hop FROM st JOIN facts f ON f.subject = start AND f.predicate = 'OWNED_BY'),
    b AS (SELECT start, f.subject, f.predicate, f.object, 2 AS hop FROM a JOIN facts f ON f.subject = a.object AND f.predicate = 'PART_OF'),
    c AS (SELECT start, f.subject, f.predicate, f.object, 3 AS hop FROM b JOIN facts f ON f.subject = b.object AND f.predicate = 'PART_OF')
    SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) u WHERE start IN (SELECT start FROM c)""", "facts")
def query_join(s, d):
    starts = X.read(s, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("start"), F.lit("p").alias("profile"))
    return T.query_join(starts, ["OWNED_BY", "PART_OF", "PART_OF"], X.typed_edges(s, d)).select("start", "hop", "subject", "predicate", "object")


def tree(s, d):
    """Edge k derives from edge k // 2 and memory k % 100."""
    o = X.read(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    source = F.struct(F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("source_edge_id"), (F.col("id") % 100).cast("string").alias("source_memory_id"), F.lit(None).cast("string").alias("reasoning"))
    return o.select("id", F.array(source).alias("derived_from"), F.lit(None).cast("string").alias("fact_id"))


@query("""WITH t AS (SELECT o_orderkey AS start, o_orderkey AS edge_id, 0 AS depth FROM orders UNION ALL SELECT start, edge_id // 2, depth + 1 FROM t WHERE edge_id > 0 AND depth < 10 AND edge_id // 2 IN (SELECT o_orderkey FROM orders))
    SELECT start, edge_id, min(depth) AS depth FROM t GROUP BY ALL""", "")
def trace_provenance(s, d):
    starts = X.read(s, d, "orders").select(F.col("o_orderkey").alias("start"))
    return T.trace_provenance(starts, tree(s, d))


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey // 2 AS p FROM orders WHERE o_orderkey > 0),
    t AS (SELECT p AS start, id AS edge_id, 1 AS depth FROM k WHERE p IN (SELECT o_orderkey FROM orders) UNION ALL SELECT start, k.id, depth + 1 FROM t JOIN k ON k.p = t.edge_id WHERE depth < 10)
    SELECT start, edge_id, min(depth) AS depth FROM t GROUP BY ALL""", "")
def find_derivatives(s, d):
    sources = X.read(s, d, "orders").select(F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("edge_id"), F.lit(None).cast("string").alias("memory_id"))
    return T.find_derivatives(sources, tree(s, d))


# --- links and ingest


@query("""WITH p AS (SELECT a.id AS source_id, b.id AS target_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS strength FROM active a JOIN active b ON a.profile = b.profile AND a.id <> b.id)
    SELECT source_id, target_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, target_id) AS n FROM p WHERE strength > 0.3) WHERE n <= 5""", "active")
def auto_link(s, d):
    m = mem(s, d, True)
    return L.auto_link(B.active_memories(m, X.as_of()), m, X.as_of(), 0.3).select("source_id", "target_id", "strength")


@query("""WITH p AS (SELECT a.id AS source_id, b.id AS target_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS strength FROM active a JOIN active b ON a.profile = b.profile AND a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM rel WHERE created_by = 'auto' AND source_id = a.id))
    SELECT source_id, target_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, target_id) AS n FROM p WHERE strength > 0.3) WHERE n <= 5""", "active rel")
def link_unlinked(s, d):
    return L.link_unlinked(mem(s, d, True), X.relationships(s, d), X.as_of(), 0.3).select("source_id", "target_id", "strength")


CANDIDATES = "cand AS (SELECT vec_id, embedding, list_extract(['en', 'fr', 'de', 'es'], CAST(vec_id % 4 + 1 AS INTEGER)) AS profile FROM embeddings)"


def candidates(s, d):
    """Every given vector as a candidate, dealt over the profiles."""
    profile = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return X.read(s, d, "embeddings").select(F.col("vec_id").alias("candidate_id"), profile.alias("profile"), F.lit("text").alias("content"), "embedding")


@query(f"WITH {CANDIDATES} SELECT c.vec_id AS candidate_id, CAST(max(round(list_cosine_similarity(c.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6)) > 0.3 AS INTEGER) AS duplicate FROM cand c JOIN active m USING (profile) GROUP BY c.vec_id", "active")
def near_duplicates(s, d):
    return L.near_duplicates(candidates(s, d), mem(s, d, True), X.as_of(), 0.3)


@query(f"""WITH {CANDIDATES}, k AS (SELECT c.vec_id AS id, c.profile, max(round(list_cosine_similarity(c.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6)) AS top FROM cand c JOIN active m USING (profile) GROUP BY c.vec_id, c.profile)
    SELECT id, profile, CAST(epoch({NOW}) AS BIGINT) + ttl_days * 86400 AS expires_at FROM k LEFT JOIN settings USING (profile) WHERE top <= 0.3""", "active settings")
def import_memories(s, d):
    return L.import_memories(candidates(s, d), mem(s, d, True), X.profile_settings(s), X.as_of(), 0.3).select("id", "profile", secs("expires_at").alias("expires_at"))


@query(f"""WITH n AS (SELECT doc_id + 7 AS id, lang AS profile, 'new ' || source AS source FROM documents WHERE doc_id % 4 = 0)
    SELECT coalesce(m.id, n.id) AS id, coalesce(m.profile, n.profile) AS profile, coalesce(n.source, m.source) AS source, CAST(epoch(coalesce(m.created_at, {NOW})) AS BIGINT) AS created_at, coalesce(m.access_count, 0) AS access_count, round(coalesce(m.confidence, 0.5), 6) AS confidence FROM mem m FULL JOIN n ON n.id = m.id""", "mem")
def upsert_memories(s, d):
    new = X.read(s, d, "documents").filter("doc_id % 4 = 0").select((F.col("doc_id") + 7).alias("id"), F.col("lang").alias("profile"), F.col("text").alias("content"), F.concat(F.lit("new "), "source").alias("source"), F.array().cast("array<string>").alias("tags"), F.array(F.lit(1.0)).alias("embedding"))
    return L.upsert_memories(mem(s, d), new, X.as_of()).select("id", "profile", "source", secs("created_at").alias("created_at"), "access_count", r6("confidence").alias("confidence"))


def records(s, d):
    e = F.col("event_id")
    key = F.when(e % 23 != 0, F.concat_ws(":", "event_type", (e % 500).cast("string")))
    return X.read(s, d, "events").select(e.alias("seq"), "event_type", key.alias("key"), F.when(e % 19 == 0, " ").otherwise("text").alias("content"))


@query("""WITH r AS (SELECT event_id AS seq, event_type, CASE WHEN event_id % 23 <> 0 THEN event_type || ':' || (event_id % 500) END AS key, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'text' END AS content FROM events),
    o AS (SELECT seq, event_type, CASE WHEN content = '' THEN 'ignored' WHEN key IS NULL THEN 'error' WHEN key LIKE '%:1__' OR row_number() OVER (PARTITION BY key, (content <> '' AND key IS NOT NULL) ORDER BY seq) > 1 THEN 'duplicate' ELSE 'stored' END AS outcome FROM r)
    SELECT event_type, count(*) AS scanned, count(*) FILTER (WHERE outcome = 'stored') AS stored, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate, count(*) FILTER (WHERE outcome = 'ignored') AS ignored, count(*) FILTER (WHERE outcome = 'error') AS error FROM o GROUP BY event_type""", "")
def ingest_dedup(s, d):
    r = records(s, d)
    return L.ingest_counts(L.ingest_dedup(r, r.filter(F.col("key").like("%:1__")).select("key")), ["event_type"])


@query("SELECT channel, m.s AS sec, m.u AS usec FROM (SELECT event_type AS channel, max({'s': CAST(epoch(ts) AS BIGINT) * 0 + epoch_us(ts) // 1000000, 'u': epoch_us(ts) % 1000000}) AS m FROM events GROUP BY event_type)", "")
def channel_cursor(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = X.read(s, d, "events").select(F.col("event_type").alias("channel"), F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.concat_ws(".", F.floor(us / 1000000).cast("string"), F.lpad((us % 1000000).cast("string"), 6, "0"))).alias("ts"))
    good = X.read(s, d, "events").select(F.col("event_type").alias("channel"), F.concat_ws(".", F.floor(us / 1000000).cast("string"), F.lpad((us % 1000000).cast("string"), 6, "0")).alias("ts"))
    return L.channel_cursor(rows.filter("ts = 'bad'").unionByName(good))


@query("""WITH p AS (SELECT a.id AS source_id, b.id AS target_id, count(*) AS n FROM vtop a JOIN vtop b ON a.query_id = b.query_id AND a.id < b.id GROUP BY ALL), o AS (SELECT source_id, target_id, strength FROM rel WHERE relationship = 'related')
    SELECT coalesce(p.source_id, o.source_id) AS source_id, coalesce(p.target_id, o.target_id) AS target_id, round(CASE WHEN n IS NULL THEN strength WHEN strength IS NULL THEN least(1, 0.1 * pow(1.01, n - 1)) ELSE least(1, strength * pow(1.01, n)) END, 6) AS strength FROM o FULL JOIN p ON o.source_id = p.source_id AND o.target_id = p.target_id""", "vtop rel", k=10)
def strengthen_edges(s, d):
    return L.strengthen_edges(nearest(s, d, 10).select(F.col("query_id").alias("set_id"), "id"), X.relationships(s, d)).withColumn("strength", r6("strength"))
