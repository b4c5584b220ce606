"""The fixtures as DuckDB SQL, for the queries' equivalents."""

from __future__ import annotations

ACTIVE = "(expires_at IS NULL OR expires_at > TIMESTAMP '2024-04-15 00:00:00')"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ne": ((), "SELECT count(*) AS e FROM embeddings"),
    "nd": ((), "SELECT count(*) AS n FROM documents"),
    "mem": (("ne",), """
        SELECT d.doc_id AS id, d.lang AS profile, d.source, d.text AS content, v.embedding, v.label,
          TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 7919) % 129600) AS created_at,
          CAST(d.doc_id % 13 AS INTEGER) AS access_count,
          CASE WHEN d.doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 7919) % 129600) + to_days(CAST(d.doc_id % 20 AS INTEGER)) END AS last_accessed_at,
          0.3::DOUBLE + (d.doc_id % 7) * 0.1::DOUBLE AS confidence, 0.05::DOUBLE + (d.doc_id % 10) * 0.1::DOUBLE AS importance, (d.doc_id % 11) / 10.0::DOUBLE AS surprise,
          CASE WHEN d.doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 7919) % 129600) + to_days(10) END AS expires_at,
          CASE WHEN d.doc_id % 8 = 0 THEN []::VARCHAR[] ELSE ['lang:' || d.lang, 'topic:' || (d.doc_id % 9), 'band:' || (d.n_chars // 1000)] END AS tags,
          CASE WHEN d.doc_id % 6 = 0 THEN '{"dates":["2024-02-' || lpad(CAST(1 + d.doc_id % 28 AS VARCHAR), 2, '0') || '"]}' ELSE '{}' END AS metadata
        FROM documents d CROSS JOIN ne LEFT JOIN embeddings v ON v.vec_id = d.doc_id % ne.e"""),
    "active": (("mem",), f"SELECT * FROM mem WHERE {ACTIVE}"),
    "rel": (("nd",), """
        SELECT source_id, target_id, list_extract(['similar','related','contradicts','supports','follows','derived_from'], CAST((source_id + j) % 6 + 1 AS INTEGER)) AS relationship,
          0.3::DOUBLE + ((source_id * j) % 8) * 0.1::DOUBLE AS strength, CASE WHEN j = 1 AND source_id % 3 <> 0 THEN 'auto' ELSE 'user' END AS created_by,
          TIMESTAMP '2024-01-01' + to_minutes((source_id * 7919) % 129600) AS created_at
        FROM (SELECT doc_id AS source_id, j, (doc_id * (2 * j + 1) + j) % nd.n AS target_id FROM documents, nd, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) t(j))
        WHERE source_id <> target_id AND source_id % 10 <> 9 AND target_id % 10 <> 9"""),
    "life": (("mem",), """
        SELECT id AS memory_id, profile, list_extract(['fresh','stable','editing'], CAST(id % 3 + 1 AS INTEGER)) AS stage,
          CASE WHEN id % 3 = 1 THEN created_at ELSE TIMESTAMP '2024-04-15' - to_minutes(id * 53 % 240) END AS stage_entered_at FROM mem"""),
    "settings": ((), "SELECT * FROM (VALUES ('en', 30, 0.1::DOUBLE, 0.4::DOUBLE), ('fr', 60, 0.1::DOUBLE, 0.4::DOUBLE), ('de', 90, 0.1::DOUBLE, 0.4::DOUBLE), ('es', NULL, 0.1::DOUBLE, 0.4::DOUBLE)) t(profile, ttl_days, decay_lambda, decay_beta)"),
    "q": (("ne",), """
        SELECT b.item_id AS query_id, 'en' AS profile, array_to_string(string_split(trim(regexp_replace(lower(b.text), '[^a-z]+', ' ', 'g')), ' ')[1:3], ' ') AS text,
          ['topic:' || (b.item_id % 9)] AS tags, v.embedding, v.label
        FROM benchmark b CROSS JOIN ne JOIN embeddings v ON v.vec_id = (b.item_id * 13 + 5) % ne.e"""),
    "boost": (("rel",), "SELECT id, sum(strength) AS graph_boost FROM (SELECT source_id AS id, strength FROM rel UNION ALL SELECT target_id, strength FROM rel WHERE target_id <> source_id) GROUP BY id"),
    "sims": (("q", "active"), "SELECT q.query_id, m.id, round(list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN active m USING (profile)"),
    "vtop": (("sims",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims) WHERE rank <= {k}"),
    "gold": (("q", "active"), "SELECT q.query_id, m.id FROM q JOIN active m USING (profile, label)"),
    "om": ((), "SELECT o_orderkey AS id, o_orderpriority AS profile, o_orderdate AS created_at FROM orders"),
    "me": (("om",), "SELECT l.memory_id, l.entity_id, om.profile FROM (SELECT DISTINCT l_orderkey AS memory_id, l_partkey AS entity_id FROM lineitem) l JOIN om ON om.id = l.memory_id"),
    "ent": (("me", "om"), """
        SELECT p_partkey AS entity_id, p_name || '#' || p_partkey AS canonical_name, list_extract(['entity','file','event','person','quantity'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS entity_type,
          coalesce(n, 0) AS mention_count, coalesce(span, 0) AS temporal_span
        FROM part LEFT JOIN (SELECT entity_id, count(*) AS n, ln(1 + count(DISTINCT CAST(created_at AS DATE))) AS span FROM me JOIN om ON om.id = me.memory_id GROUP BY entity_id) s ON s.entity_id = p_partkey"""),
    "facts": ((), """
        SELECT 'order:' || o_orderkey AS subject, 'OWNED_BY' AS predicate, 'customer:' || o_custkey AS object FROM orders
        UNION ALL SELECT 'customer:' || c_custkey, 'PART_OF', 'nation:' || c_nationkey FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'PART_OF', 'nation:' || s_nationkey FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey FROM nation
        UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'DEPENDS_ON', 'supplier:' || l_suppkey FROM lineitem"""),
    "ev": ((), "SELECT event_id, ts, user_id AS session_id, event_type AS tool, json_extract_string(props, '$.k') AS target FROM events"),
    "au": ((), """
        SELECT event_id, ts AS event_time, 'u' || (user_id % 4) AS profile, event_type AS operation, CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens_used,
          list_extract(['embed-small', 'embed-large'], CAST(event_id % 2 + 1 AS INTEGER)) AS embedding_model, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * CAST(0.00002 AS DECIMAL(10,6)) AS DECIMAL(10,6)) AS cost_usd FROM events"""),
}


def sql(names: str, body: str, **values) -> str:
    """WITH the named fixtures and what they need, then body."""
    done: dict[str, str] = {}

    def need(n: str) -> None:
        if n not in done:
            deps, text = CTES[n]
            for d in deps:
                need(d)
            for k, v in values.items():
                text = text.replace("{" + k + "}", str(v))
            done[n] = f"{n} AS ({text.strip()})"

    for n in names.split():
        need(n)
    body = body.strip()
    own = body[5:] if body.startswith("WITH ") else body
    if not done:
        return f"WITH RECURSIVE {own}" if own is not body else body
    return "WITH RECURSIVE " + ",\n".join(done.values()) + (",\n" if own is not body else "\n") + own
