"""Registered queries of re-ranking, routing, metrics, typed edges and ingest, each beside its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixtures as X
from cairn.functions import text as T
from cairn.operators import entities as E
from cairn.operators import ingest as I
from cairn.operators import linking as L
from cairn.operators import maintain as M
from cairn.operators import reports as R
from cairn.operators import rerank as K
from cairn.operators import route as Q
from cairn.operators import search as S
from cairn.operators import triples as G
from cairn.plans.catalog import HYBRID, VOCABULARY, hybrid, mem, nearest, query, r6, tree
from cairn.plans.texts import TX, texts
from cairn.streaming import events as V

def dated():
    """A day for every sixth memory."""
    return F.when(F.col("id") % 6 == 0, F.date_add(F.lit("2024-02-01").cast("date"), (F.col("id") % 28).cast("int")))


def results(s, d, k, *more):
    return nearest(s, d, k).select("query_id", "id", F.col("similarity").alias("relevance"), "rank", *more)


# --- re-ranking


@query("""WITH r AS (SELECT query_id, id, similarity, CASE WHEN id % 10 < 9 THEN CASE WHEN id % 10 = 0 AND rank > 20 THEN id % 200 ELSE id % 4 END END AS day FROM vtop),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM r),
    g AS (SELECT query_id, count(*) AS total, count(day) AS dated, count(day) FILTER (WHERE n <= 20)::DOUBLE / least(count(*), 20) AS share, max(day) FILTER (WHERE n <= 20) - min(day) FILTER (WHERE n <= 20) AS near, max(day) - min(day) AS far FROM a GROUP BY query_id),
    b AS (SELECT a.*, share >= 0.8 AND near <= 0.05::DOUBLE * far AND dated >= 2 AND total > 8 AS gate, row_number() OVER (PARTITION BY a.query_id, day, similarity > 0 ORDER BY n) - 1 AS before FROM a JOIN g USING (query_id)),
    c AS (SELECT query_id, id, n, gate, CASE WHEN NOT gate THEN similarity WHEN day IS NULL THEN similarity * 0.95::DOUBLE ELSE similarity * pow(0.8::DOUBLE, before) END AS new FROM b),
    e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM c WHERE NOT gate OR new > 0)
    SELECT query_id, id, round(new, 9) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY round(new, 9) DESC, id) AS rank FROM e WHERE place <= 8""", "vtop", k=60)
def temporal_diversity_rerank(s, d):
    i = F.col("id")
    offset = F.when(i % 10 < 9, F.when((i % 10 == 0) & (F.col("rank") > 20), i % 200).otherwise(i % 4))
    rows = results(s, d, 60).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int")))
    return K.temporal_diversity_rerank(rows, 8)


@query("""WITH r AS (SELECT query_id, id, similarity, CASE WHEN id % 6 = 0 THEN id % 28 END AS day FROM vtop),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n, count(day) OVER (PARTITION BY query_id) AS dated, row_number() OVER (PARTITION BY query_id ORDER BY day NULLS LAST, id) - 1 AS seq FROM r),
    m AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 14 ELSE max(day) FILTER (WHERE seq = dated // 2) END AS anchor FROM a GROUP BY query_id),
    l AS (SELECT a.query_id, arg_max(id, (day, -n)) FILTER (WHERE day <= anchor) AS last_id, arg_min(id, (day, n)) FILTER (WHERE day >= anchor) AS first_id FROM a JOIN m USING (query_id) GROUP BY a.query_id)
    SELECT query_id, id, similarity AS relevance, rank FROM (SELECT a.*, row_number() OVER (PARTITION BY a.query_id ORDER BY CASE WHEN id = last_id THEN 0 WHEN id = first_id THEN 1 ELSE 2 END, n) AS rank FROM a JOIN l USING (query_id)) WHERE rank <= 10""", "vtop", k=30)
def boundary_inject(s, d):
    anchors = X.queries(s, d).filter("query_id % 2 = 0").select("query_id", F.lit("2024-02-15").cast("date").alias("day"))
    return K.boundary_inject(results(s, d, 30).withColumn("day", dated()), anchors, 10)


@query("""WITH own AS (SELECT * FROM vtop WHERE rank <= 20), a AS (SELECT query_id, id, 0.4::DOUBLE * tanh(similarity) AS extra FROM vtop WHERE rank > 10),
    u AS (SELECT o.query_id, o.id, round(similarity + coalesce(extra, 0), 9) AS relevance, 0 AS later FROM own o LEFT JOIN a ON a.query_id = o.query_id AND a.id = o.id
      UNION ALL SELECT query_id, id, round(extra, 9), 1 FROM (SELECT a.*, row_number() OVER (PARTITION BY query_id ORDER BY extra DESC, id) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = a.query_id AND o.id = a.id)) WHERE n <= 3)
    SELECT query_id, id, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, relevance DESC, id) AS rank FROM u) WHERE rank <= 22""", "vtop", k=40)
def activation_merge(s, d):
    rows = results(s, d, 40)
    activation = rows.filter("rank > 10").select("query_id", "id", F.col("relevance").alias("activation"))
    return K.activation_merge(rows.filter("rank <= 20"), activation, X.queries(s, d).select("query_id", F.lit(0.4).alias("weight")), 22)


@query("""WITH e AS (SELECT query_id, rank, substring(content, 1, 35) AS short, strftime(DATE '2024-02-01' + CAST(v.id % 28 AS INTEGER), '%Y-%m-%d') AS day FROM vtop v JOIN mem USING (id) WHERE v.id % 6 = 0),
    f AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM e),
    g AS (SELECT query_id, day, substring(string_agg(short, ' + ' ORDER BY rank, short), 1, 38) AS summary, string_agg('M' || rank, ',' ORDER BY rank, short) AS refs, date_diff('day', CAST(day AS DATE), DATE '2024-04-15') AS days_ago FROM f WHERE n >= 2 GROUP BY query_id, day)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY day) AS place FROM g) WHERE place <= 20""", "vtop mem", k=60)
def timeline_table(s, d):
    dates = F.when(F.col("id") % 6 == 0, F.array(F.date_format(dated(), "yyyy-MM-dd"))).otherwise(F.array().cast("array<string>"))
    rows = results(s, d, 60).join(mem(s, d).select("id", "content"), "id").withColumn("dates", dates)
    return K.timeline_table(rows, X.as_of())


@query("SELECT query_id, id, rank, CASE WHEN day IS DISTINCT FROM lag(day) OVER (PARTITION BY query_id ORDER BY rank) THEN day END AS header FROM (SELECT v.*, strftime(date_trunc('month', created_at), '%Y-%m-%d') AS day FROM vtop v JOIN mem USING (id))", "vtop mem", k=20)
def session_format(s, d):
    day = mem(s, d).select("id", F.date_format(F.trunc("created_at", "month"), "yyyy-MM-dd").alias("day"))
    return K.session_format(results(s, d, 20).join(day, "id")).select("query_id", "id", "rank", "header")


@query("WITH w AS (SELECT query_id, max(id) AS id FROM gold GROUP BY query_id) SELECT w.query_id, v.rank FROM w LEFT JOIN vtop v ON v.query_id = w.query_id AND v.id = w.id", "vtop gold", k=30)
def exact_token_rank(s, d):
    return K.exact_token_rank(nearest(s, d, 30), X.gold(s, d).groupBy("query_id").agg(F.max("id").alias("id")))


@query()
def mmr_rerank(s, d):
    return K.mmr_rerank(results(s, d, 20).join(mem(s, d).select("id", "content"), "id"), 10)


@query("""SELECT query_id, id, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM (SELECT v.query_id, v.id, round(0.45::DOUBLE * similarity + 0.55::DOUBLE * (length(m.content) % 100) / 100, 9) AS relevance FROM vtop v JOIN mem m USING (id))) WHERE rank <= 10""", "vtop mem", k=20)
def blend_rerank(s, d):
    rows = results(s, d, 20).join(mem(s, d).select("id", "content"), "id").join(X.queries(s, d).select("query_id", F.col("text").alias("query")), "query_id")
    return K.blend_rerank(rows, lambda queries, contents: (contents.str.len() % 100) / 100.0)


# --- search


@query(f"""WITH {HYBRID}, e AS (SELECT source_id AS x, target_id AS y, strength FROM rel WHERE strength >= 0.5 UNION ALL SELECT target_id, source_id, strength FROM rel WHERE strength >= 0.5 AND source_id <> target_id),
    near AS (SELECT x AS start, y AS id, max(strength) AS strength FROM e WHERE y IN (SELECT id FROM active) AND y <> x GROUP BY ALL),
    nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY strength DESC, id) AS place FROM near) WHERE place <= 20),
    u AS (SELECT query_id, id, relevance, 0 AS finder, 0 AS place FROM hs UNION ALL SELECT query_id, nr.id, round(relevance * strength, 9), rank, place FROM hs JOIN nr ON nr.start = hs.id WHERE rank <= 5),
    o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY finder, place) = 1)
    SELECT query_id, id, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM o) WHERE rank <= 10""", "vtop q active boost rel", k=30)
def graph_augmented_search(s, d):
    return S.graph_augmented_search(X.queries(s, d), mem(s, d, True), X.relationships(s, d), X.as_of(), 10).select("query_id", "id", "relevance", "rank")


@query("""WITH su AS (SELECT vec_id AS id, embedding, 'about ' || vec_id AS content, CASE WHEN vec_id % 2 = 0 THEN 'short ' || vec_id END AS short FROM embeddings WHERE vec_id % 3 <> 0),
    f AS (SELECT q.query_id, su.id, round(list_cosine_similarity(q.embedding::DOUBLE[], su.embedding::DOUBLE[]), 6) AS similarity, content, short FROM q CROSS JOIN su),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM f)
    SELECT query_id, id, similarity, rank, coalesce(short, content) AS text, CASE WHEN short IS NULL THEN 'body' ELSE 'short' END AS served FROM t WHERE rank <= 3 AND similarity >= 0.4""", "q")
def topic_search(s, d):
    v = F.col("vec_id")
    summaries = X.read(s, d, "embeddings").select(
        v.alias("id"), F.lit("en").alias("profile"), F.when(v % 3 != 0, "fresh").otherwise("stale").alias("status"), "embedding", F.concat(F.lit("about "), v.cast("string")).alias("content"),
        F.when(v % 2 == 0, F.concat(F.lit("short "), v.cast("string"))).alias("short"), F.lit(None).cast("string").alias("one_line"),
    )
    return S.topic_search(X.queries(s, d), summaries, 3, 0.4, "short")


@query("""WITH k AS (SELECT DISTINCT 'dates' AS key, '["2024-02-' || lpad(CAST(1 + item_id % 28 AS VARCHAR), 2, '0') || '"]' AS value FROM benchmark)
    SELECT key, value, id FROM mem JOIN k ON k.value = '["' || json_extract_string(metadata, '$.dates[0]') || '"]'""", "mem")
def find_by_metadata_key(s, d):
    keys = X.read(s, d, "benchmark").select(F.lit("dates").alias("key"), F.format_string('["2024-02-%02d"]', 1 + F.col("item_id") % 28).alias("value"))
    return S.find_by_metadata_key(mem(s, d), keys)


@query("""WITH o AS (SELECT id, profile, DATE '2024-02-01' + CAST(id % 28 AS INTEGER) AS start, DATE '2024-02-01' + CAST(id % 28 + id % 3 AS INTEGER) AS stop, CASE WHEN id % 10 = 0 THEN id % 7 END AS weekday FROM mem),
    r AS (SELECT item_id AS query_id, 'en' AS profile, DATE '2024-02-01' + CAST(item_id % 20 AS INTEGER) AS f, DATE '2024-02-01' + CAST(item_id % 20 + item_id % 11 AS INTEGER) AS u FROM benchmark WHERE item_id % 11 > 0)
    SELECT query_id, id, 'range' AS how FROM o JOIN r USING (profile) WHERE start < stop AND start < u AND f < stop
    UNION ALL SELECT DISTINCT query_id, id, 'weekday' FROM o JOIN (SELECT query_id, profile, unnest(range(0, date_diff('day', f, u))) AS n, f FROM r) x USING (profile) WHERE weekday = dayofweek(f + CAST(n AS INTEGER))""", "mem")
def occurrence_overlap(s, d):
    i, first = F.col("id"), F.lit("2024-02-01").cast("date")
    m = mem(s, d).select("id", "profile", F.date_add(first, (i % 28).cast("int")).alias("start"), F.date_add(first, (i % 28 + i % 3).cast("int")).alias("stop"), F.when(i % 10 == 0, F.array((i % 7).cast("int"))).alias("recurrence_days"))
    b = F.col("item_id")
    r = X.read(s, d, "benchmark").select(b.alias("query_id"), F.lit("en").alias("profile"), F.date_add(first, (b % 20).cast("int")).alias("start"), F.date_add(first, (b % 20 + b % 11).cast("int")).alias("stop"))
    return S.occurrence_overlap(m, r)


@query()
def keyword_web(s, d):
    """Two of a question's words or its first as a phrase with the second, without the third."""
    w = F.split("text", " ")
    text = F.concat(w[0], F.lit(' or "'), w[0], F.lit(" "), w[1], F.lit('" or '), w[1], F.lit(" -"), w[2])
    return S.keyword_topk(X.queries(s, d).withColumn("text", text), mem(s, d), X.as_of(), 10, "stemmed")


@query("""WITH t AS (SELECT item_id AS id, item_id % 30 + 1 AS n FROM benchmark)
    SELECT id, strftime(DATE '2024-04-15' - CAST(n * 7 + 3 AS INTEGER), '%Y-%m-%d') AS start, strftime(DATE '2024-04-15' - CAST(n * 7 - 4 AS INTEGER), '%Y-%m-%d') AS stop FROM t""")
def resolve_time_range(s, d):
    n = F.col("item_id") % 30 + 1
    rows = X.read(s, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("what was it "), n.cast("string"), F.lit(" weeks ago?")).alias("text"))
    span = T.resolve_time_range(F.col("text"), X.as_of().cast("date"))
    return rows.select("id", *[F.date_format(span[c], "yyyy-MM-dd").alias(c) for c in ("start", "stop")])


def questions(s, d):
    """The queries' texts as questions of every kind."""
    forms = ("what is the order of %s", "how many days between %s and memory", "how many different %s are there", "overview of everything about %s", "what was %s last week", "tell me about %s")
    text = F.element_at(F.array(*[F.concat(F.lit(f.split("%s")[0]), F.col("text"), F.lit(f.split("%s")[1])) for f in forms]), (F.col("query_id") % 6 + 1).cast("int"))
    return X.queries(s, d).withColumn("text", text)


@query()
def bridge_search(s, d):
    return Q.bridge_search(questions(s, d), mem(s, d, True), X.relationships(s, d), X.as_of(), 10).select("query_id", "id", "relevance", "rank")


@query()
def entity_thread(s, d):
    return Q.entity_thread(hybrid(s, d), X.queries(s, d), mem(s, d, True), X.relationships(s, d), X.as_of(), 10)


@query()
def route_search(s, d):
    q = questions(s, d)
    day = lambda x: F.lit(x).cast("timestamp")
    anchors = q.select("query_id", day("2024-02-10").alias("start"), day("2024-02-17").alias("stop"), F.lit("near").alias("direction"))
    activation = results(s, d, 40).filter("rank > 10").select("query_id", "id", F.col("relevance").alias("activation"))
    return Q.route_search(q, mem(s, d, True), X.relationships(s, d), X.as_of(), 5, activation, q.select("query_id", F.lit(0.3).alias("weight")), anchors=anchors)


# --- metrics


@query("""WITH r AS (SELECT query_id, id % 50 AS session, min(rank) AS best FROM vtop GROUP BY ALL), k AS (SELECT query_id, session, row_number() OVER (PARTITION BY query_id ORDER BY best, session) AS rank FROM r),
    w AS (SELECT DISTINCT query_id, id % 50 AS session FROM gold), g AS (SELECT query_id, count(*) AS n FROM w GROUP BY query_id), h AS (SELECT k.query_id, k.rank FROM k JOIN w USING (query_id, session)),
    x AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, min(rank) AS f FROM h GROUP BY query_id)
    SELECT q.query_id, round(CASE WHEN n IS NULL THEN 0 ELSE coalesce(h5, 0)::DOUBLE / n END, 6) AS recall5, round(CASE WHEN n IS NULL THEN 0 ELSE coalesce(h10, 0)::DOUBLE / n END, 6) AS recall10, round(CASE WHEN n IS NULL THEN 0 ELSE coalesce(1.0::DOUBLE / f, 0) END, 6) AS mrr
    FROM q LEFT JOIN g USING (query_id) LEFT JOIN x USING (query_id)""", "vtop gold q", k=30)
def session_retrieval_metrics(s, d):
    sessions = mem(s, d).select("id", (F.col("id") % 50).alias("session"))
    got = R.session_retrieval_metrics(nearest(s, d, 30), sessions, X.gold(s, d), X.queries(s, d).select("query_id", F.lit("fact").alias("category")))
    return got.select("query_id", *[r6(c).alias(c) for c in ("recall5", "recall10", "mrr")])


@query("""WITH a AS (SELECT query_id, lower(text) AS answer, string_split(text, ' ') AS w FROM q), h AS (SELECT v.query_id, min(rank) AS f FROM vtop v JOIN mem m ON m.id = v.id JOIN a ON a.query_id = v.query_id
      WHERE contains(lower(content), answer) OR (length(answer) < 30 AND len(list_filter(w, lambda x: len(x) > 2)) > 0 AND len(list_filter(w, lambda x: len(x) > 2 AND NOT contains(lower(content), x))) = 0) GROUP BY v.query_id)
    SELECT q.query_id, CAST(f IS NOT NULL AS INTEGER) AS hit, round(coalesce(1.0::DOUBLE / f, 0), 6) AS reciprocal_rank FROM q LEFT JOIN h USING (query_id)""", "vtop mem q", k=60)
def answer_hit_metrics(s, d):
    asked = X.queries(s, d).select("query_id", F.col("text").alias("answer"), F.lit("").alias("evidence"))
    return R.answer_hit_metrics(nearest(s, d, 60), mem(s, d), asked).withColumn("reciprocal_rank", r6("reciprocal_rank"))


@query("""WITH x AS (SELECT query_id, 'c' || (query_id % 3) AS category, 'd' || (query_id % 2) AS difficulty, max(similarity) AS best, avg(similarity) AS mean FROM vtop GROUP BY query_id)
    SELECT category, difficulty, count(*) AS n, round(avg(best), 6) AS best, round(avg(mean), 6) AS mean FROM x GROUP BY GROUPING SETS ((category), (difficulty), ())""", "vtop", k=10)
def metrics_summary(s, d):
    by = F.col("query_id")
    rows = nearest(s, d, 10).groupBy("query_id").agg(F.max("similarity").alias("best"), F.avg("similarity").alias("mean"))
    return R.metrics_summary(rows.withColumn("category", F.concat(F.lit("c"), (by % 3).cast("string"))).withColumn("difficulty", F.concat(F.lit("d"), (by % 2).cast("string"))), ["best", "mean"])


# --- typed edges


@query("""WITH r AS (SELECT entity_id AS ref_id, CASE entity_id % 4 WHEN 0 THEN entity_type || ':' || canonical_name WHEN 1 THEN canonical_name WHEN 2 THEN 'a' || entity_id ELSE 'none' END AS ref FROM ent)
    SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN ref_id WHEN 1 THEN ref_id WHEN 2 THEN CASE WHEN ref_id % 3 = 0 THEN ref_id END END AS entity_id, 0 AS ambiguous FROM r""", "ent")
def resolve_entities(s, d):
    e = X.entities(s, d)
    i = F.col("entity_id")
    ref = F.when(i % 4 == 0, F.concat_ws(":", "entity_type", "canonical_name")).when(i % 4 == 1, F.col("canonical_name")).when(i % 4 == 2, F.concat(F.lit("a"), i.cast("string"))).otherwise("none")
    aliases = e.filter(i % 3 == 0).select(F.concat(F.lit("a"), i.cast("string")).alias("alias"), F.lit("p").alias("profile"), "entity_id")
    return G.resolve_entities(e.select(i.alias("ref_id"), ref.alias("ref"), F.lit("p").alias("profile")), e, aliases, ["entity", "file", "event", "person", "quantity"])


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 7 > 0 OR o_orderkey % 100 > 0 AS INTEGER) AS ok FROM orders")
def validate_derived_from(s, d):
    i = F.col("id")
    bare = F.struct(F.when(i % 7 > 0, i).alias("source_edge_id"), F.when(i % 100 > 0, (i % 100).cast("string")).otherwise("").alias("source_memory_id"), F.lit(None).cast("string").alias("reasoning"))
    return G.validate_derived_from(tree(s, d).withColumn("derived_from", F.array(bare))).select("id", "ok")


@query("""WITH v AS (SELECT * FROM (VALUES ('OWNED_BY', 'is owned by', 'OWNS'), ('OWNS', 'owns', NULL), ('PART_OF', 'is part of', NULL)) t(predicate, label, inverse))
    SELECT subject, f.predicate, object, label, 0 AS is_inverse FROM facts f LEFT JOIN v USING (predicate)
    UNION ALL SELECT object, v.inverse, subject, w.label, 1 FROM facts f JOIN v USING (predicate) LEFT JOIN v w ON w.predicate = v.inverse WHERE v.inverse IS NOT NULL""", "facts")
def edge_vocabulary(s, d):
    v = s.createDataFrame([("OWNED_BY", "is owned by", "OWNS"), ("OWNS", "owns", None), ("PART_OF", "is part of", None)], "predicate string, label string, inverse string")
    return G.edge_vocabulary(X.typed_edges(s, d), v)


@query("""SELECT l_orderkey AS line, l_linenumber AS n, CASE WHEN l_linenumber = 4 THEN 'unknown_predicate' WHEN l_partkey % 5 = 0 THEN 'missing_object' WHEN l_partkey = l_suppkey THEN 'self' WHEN l_linenumber = 3 THEN 'already_present' ELSE 'written' END AS fate
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)""")
def apply_graph_bundle(s, d):
    lines = X.read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    part = lines.select("l_partkey").union(lines.select("l_suppkey")).distinct().toDF("k")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    concepts = part.filter("k % 5 > 0").select(name("k").alias("path"), name("k").alias("canonical_name"), F.lit("entity").alias("entity_type"))
    subjects = lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("canonical_name"), F.lit("entity").alias("entity_type"))
    predicate = F.when(F.col("l_linenumber") == 4, "LIKES").when(F.col("l_linenumber") == 3, "DEPENDS_ON").otherwise("PART_OF")
    wanted = lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), predicate.alias("predicate"), name("l_partkey").alias("target_path"))
    have = lines.filter("l_linenumber = 3").select(F.concat(F.lit("entity:"), name("l_suppkey")).alias("subject"), F.lit("DEPENDS_ON").alias("predicate"), F.concat(F.lit("entity:"), name("l_partkey")).alias("object"), F.lit(None).cast("timestamp").alias("valid_to"))
    got = G.apply_graph_bundle(concepts.unionByName(subjects), wanted, X.entities(s, d), have.distinct(), VOCABULARY)
    return got.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("line"), F.split_part("path", F.lit("/"), F.lit(2)).cast("int").alias("n"), "fate")


# --- ingest


@query("""SELECT query_id AS source_id, id AS target_id, 'contradicts' AS relationship, 1.0::DOUBLE AS strength FROM vtop WHERE similarity >= 0.75 AND CASE WHEN query_id % 2 = 0 THEN 1 ELSE -1 END <> CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END""", "vtop", k=30)
def contradiction_edges(s, d):
    new = X.queries(s, d).select(F.col("query_id").alias("id"), F.when(F.col("query_id") % 2 == 0, 1).otherwise(-1).alias("polarity"))
    conflicts = nearest(s, d, 30).select(F.col("query_id"), F.col("id").alias("other_id"), "similarity", F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("other_polarity")).withColumnRenamed("query_id", "id")
    return L.contradiction_edges(new, conflicts)


@query("""SELECT m.id, CAST(epoch(CASE WHEN m.id % 4 = 0 THEN TIMESTAMP '2024-04-15' ELSE created_at END) AS BIGINT) AS updated_at, round(CASE WHEN m.id % 4 = 0 THEN v.embedding[1] ELSE m.embedding[1] END::DOUBLE, 6) AS first
    FROM mem m CROSS JOIN ne JOIN embeddings v ON v.vec_id = (m.id + 1) % ne.e""", "mem ne")
def refresh_embeddings(s, d):
    vectors = X.read(s, d, "embeddings")
    e = vectors.count()
    new = mem(s, d).filter("id % 4 = 0").select("id", ((F.col("id") + 1) % e).alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id")
    return L.refresh_embeddings(mem(s, d, True), new, X.as_of()).select("id", F.unix_seconds("updated_at").alias("updated_at"), r6(F.col("embedding")[0].cast("double")).alias("first"))


@query()
def store_enriched(s, d):
    new = texts(s, d).join(mem(s, d, True).select("id", "profile", "tags", "embedding"), "id").withColumn("id", F.col("id") + 10_000_000)
    rows, contradicts, links, _ = I.store_enriched(new, mem(s, d, True), X.profile_settings(s), X.as_of())
    n = lambda df, c: df.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias(c))
    out = rows.join(n(contradicts, "contradicts"), "id", "left").join(n(links, "links"), "id", "left").na.fill({"contradicts": 0, "links": 0})
    return out.select("id", "profile", F.sha2("content", 256).alias("sha"), F.size("dates").alias("dates"), r6("importance").alias("importance"), "polarity", r6("surprise").alias("surprise"), "contradicts", "links")


@query("""WITH e AS (SELECT session_id AS k, ts FROM ev), w AS (SELECT k, min(ts) AS o FROM e GROUP BY k UNION ALL SELECT w.k, (SELECT min(e.ts) FROM e WHERE e.k = w.k AND e.ts >= w.o + INTERVAL 6 HOUR) FROM w WHERE o IS NOT NULL)
    SELECT k AS memory_id, epoch_us(o) AS opened_at, epoch_us(o) + 21600000000 AS closes_at FROM w WHERE o IS NOT NULL""", "ev")
def editing_window_spans(s, d):
    got = V.editing_windows(X.tool_events(s, d).select(F.col("session_id").alias("memory_id"), "ts"), 360)
    return got.select("memory_id", F.unix_micros("opened_at").alias("opened_at"), F.unix_micros("closes_at").alias("closes_at"))


@query(f"""WITH {TX} SELECT id, sha256(regexp_replace(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '[ \\t\\f]+(\\n|$)', '\\1', 'g'), '^\\n+|\\n+$', '', 'g')) AS fingerprint FROM tx""")
def source_fingerprint(s, d):
    return texts(s, d).select("id", T.source_fingerprint(F.col("content")).alias("fingerprint"))


@query()
def compress(s, d):
    got = M.compress(mem(s, d).withColumn("original_content", F.lit(None).cast("string")), X.as_of())
    return got.select("id", F.sha2("content", 256).alias("sha"), F.length("content").alias("chars"), "compression_level")


@query()
def backfill_entities(s, d):
    m = mem(s, d).drop("content").join(texts(s, d), "id")
    none = s.createDataFrame([], "canonical_name string, entity_type string, mention_count long, evidence_class string")
    links = s.createDataFrame([], "memory_id long, profile string, canonical_name string, entity_type string")
    return E.backfill_entities(m, none, links, X.as_of())[2]
