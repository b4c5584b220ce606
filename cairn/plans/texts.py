"""Registered queries over texts, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import fixtures as X
from cairn.functions import text as T
from cairn.functions.vectors import cosine, l2_normalize
from cairn.operators import ingest as I
from cairn.operators import search as S
from cairn.plans.catalog import mem, query, r6, secs
from cairn.sources import exchange as O
from cairn.streaming import events as V

TEMPLATES = (
    "met on 2024-02-03 and 2024/3/9", "on March 5th, 2024 we met", "[Date: 2024-02-30] odd", "[Date: 2024-02-03] noted", "we decided to use PostgresBackend in src/app/main.py", "got a ValueError today",
    "every Monday and friday we run", "montags geschlossen", "no longer uses that", "with my sister at the wedding", "bought 3 tanks in 2024 years", "api_key=abcdefgh1234 and https://u:secret@h/",
)


def texts(s, d):
    """Each whole document after one of twelve sentences, as the documents hold no English, dates or names."""
    return X.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("doc_id") % 12 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"))


def in_sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


TX = f"tx AS (SELECT doc_id AS id, list_extract([{', '.join(map(in_sql, TEMPLATES))}], CAST(doc_id % 12 + 1 AS INTEGER)) || ' ' || coalesce(text, '') AS content FROM documents)"
words = lambda xs: "(?:" + "|".join(xs) + ")"


IMPORTANCE = f"""0.2::DOUBLE + CASE WHEN regexp_matches(lower(content), '{words(T.DECISION_WORDS)}') THEN 0.3::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(lower(content), '{words(T.ERROR_WORDS)}') OR regexp_matches(content, '\\w*(?:Error|Exception)\\b') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(content), '{words(T.ARCHITECTURE_WORDS)}') THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(content, '(?:[a-zA-Z0-9_@.-]+/)+[a-zA-Z0-9_@.-]+\\.[a-zA-Z0-9_]+') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(content, '`') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(content) > 500 THEN 0.1::DOUBLE ELSE 0 END"""


@query(f"""WITH {TX} SELECT id, round(least(1.0::DOUBLE, {IMPORTANCE}), 6) AS importance,
    CASE WHEN regexp_matches(lower(content), '{words(T.NEGATION_MARKERS)}') THEN -1 ELSE 1 END AS polarity FROM tx""")
def importance_and_polarity(s, d):
    c = F.col("content")
    return texts(s, d).select("id", r6(T.compute_importance(c, F.array().cast("array<string>"))).alias("importance"), T.negation_polarity(c).alias("polarity"))


@query()
def extract_dates(s, d):
    return texts(s, d).select("id", F.array_join(T.extract_dates(F.col("content"), X.as_of().cast("date")), ",").alias("dates"))


@query(f"""WITH {TX}, o AS (SELECT id, nullif(regexp_extract(content, '\\[Date: (\\d{{4}}-\\d{{2}}-\\d{{2}})\\]', 1), '') AS day FROM tx)
    SELECT id, CASE WHEN try_strptime(day, '%Y-%m-%d') IS NOT NULL THEN day END AS start, strftime(try_strptime(day, '%Y-%m-%d') + INTERVAL 1 DAY, '%Y-%m-%d') AS stop FROM o""")
def occurrence_range(s, d):
    day = T.occurrence_day(F.col("content"))
    return texts(s, d).select("id", F.date_format(day, "yyyy-MM-dd").alias("start"), F.date_format(F.date_add(day, 1), "yyyy-MM-dd").alias("stop"))


@query()
def occurrence_and_recurrence(s, d):
    c = F.col("content")
    return texts(s, d).select("id", F.date_format(T.occurrence_day(c), "yyyy-MM-dd").alias("day"), F.array_join(F.transform(T.extract_recurrence(c), lambda x: x.cast("string")), ",").alias("recurrence"))


@query()
def extract_entities(s, d):
    return texts(s, d).select("id", F.array_join(T.extract_entities(F.col("content")), ",").alias("entities"))


def _masked_sql() -> str:
    """The four passes as nested replacements."""
    out = "content"
    for pattern, by in (
        ("(?i)((?:" + "|".join(T.SECRET_NAMES) + r")[=:\s]+\s*['\"]?)[A-Za-z0-9_\-./+=]{8,}['\"]?", r"\1" + T.MASK), ("(?:" + "|".join(T.SECRET_TOKENS) + ")", T.MASK),
        (T.SECRET_URL, f"://{T.MASK}:{T.MASK}@"), (T.SECRET_ENV, r"\1" + T.MASK),
    ):
        out = f"regexp_replace({out}, {in_sql(pattern)}, {in_sql(by)}, 'g')"
    return out


@query(f"WITH {TX} SELECT id, sha256({_masked_sql()}) AS sha, length({_masked_sql()}) AS chars FROM tx")
def mask_secrets(s, d):
    masked = T.mask_secrets(F.col("content"))
    return texts(s, d).select("id", F.sha2(masked, 256).alias("sha"), F.length(masked).cast("long").alias("chars"))


@query("""WITH a AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS prompt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, length(prompt) AS prompt_chars, length(text) AS content_chars FROM a WHERE role = 'assistant' AND before = 'user' AND length(trim(text)) >= 50 AND length(trim(prompt)) > 0""")
def conversation_turn_pairs(s, d):
    return I.conversation_turn_pairs(X.turns(s, d)).select("conv_id", "turn_index", F.length("user_prompt").cast("long").alias("prompt_chars"), F.length("content").cast("long").alias("content_chars"))


@query("SELECT event_id, session_id, tool FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id, tool, target ORDER BY ts, event_id) AS gap FROM ev) WHERE target IS NULL OR target = '' OR gap IS NULL OR gap >= 21600000000", "ev")
def session_dedup(s, d):
    return V.session_dedup(X.tool_events(s, d), 21600).select("event_id", "session_id", "tool")


@query("SELECT profile, operation, CAST(epoch(time_bucket(INTERVAL 1 HOUR, event_time)) AS BIGINT) AS start, count(*) AS n FROM au GROUP BY ALL", "au")
def audit_windows(s, d):
    return V.audit_windows(X.audit(s, d)).select("profile", "operation", secs("start").alias("start"), "n")


@query("""WITH c AS (SELECT profile, operation AS tag, event_time AS ts, epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY profile, operation ORDER BY event_time) AS gap FROM au),
    b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY profile, tag ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM c)
    SELECT profile, tag, max(epoch_us(ts)) + 1800000000 AS fire_at, count(*) AS n FROM b GROUP BY profile, tag, burst""", "au")
def recompute_debounce(s, d):
    changes = X.audit(s, d).select("profile", F.col("operation").alias("tag"), F.col("event_time").alias("ts"))
    return V.recompute_debounce(changes, 1800).withColumn("fire_at", F.unix_micros("fire_at"))


@query("SELECT session_id AS memory_id, count(*) AS searches FROM ev GROUP BY session_id", "ev")
def editing_window_searches(s, d):
    return X.tool_events(s, d).groupBy(F.col("session_id").alias("memory_id")).agg(F.count("*").alias("searches"))


@query()
def editing_windows(s, d):
    return V.editing_windows(X.tool_events(s, d).select(F.col("session_id").alias("memory_id"), "ts"))


@query("SELECT id, profile, sha256('## ' || strftime(created_at, '%Y-%m-%d') || chr(10) || chr(10) || CASE WHEN len(tags) > 0 THEN '**Tags:** ' || array_to_string(tags, ', ') || chr(10) || chr(10) ELSE '' END || '**Source:** ' || source || chr(10) || chr(10) || content || chr(10) || chr(10) || '---') AS sha FROM active", "active")
def export_markdown(s, d):
    from cairn.operators.base import active_memories

    return O.export_markdown(active_memories(mem(s, d), X.as_of())).select("id", "profile", F.sha2("text", 256).alias("sha"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list(lower(entity_type) || '/' || regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g')))), ',') AS paths FROM om JOIN me ON me.memory_id = om.id JOIN ent USING (entity_id) GROUP BY id", "om me ent")
def concept_bundle(s, d):
    out = O.concept_bundle(X.order_memories(s, d), X.memory_entities(s, d), X.entities(s, d))
    return out.select("id", F.array_join("paths", ",").alias("paths")).filter(F.length("paths") > 0)


@query("SELECT query_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings v ON v.vec_id = q.query_id", "q")
def cosine_similarity(s, d):
    v = X.read(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("other"))
    unit = l2_normalize(F.col("embedding"))
    return X.queries(s, d).join(v, "query_id").select("query_id", r6(cosine(unit, F.col("other"))).alias("similarity"))


@query("SELECT event_id, round(CASE embedding_model WHEN 'embed-small' THEN 0.00002::DOUBLE ELSE 0.00013::DOUBLE END * tokens_used / 1000, 8) AS cost FROM au", "au")
def embedding_cost(s, d):
    return X.audit(s, d).select("event_id", T.embedding_cost(F.col("embedding_model"), F.col("tokens_used"), {"embed-small": 0.00002, "embed-large": 0.00013}).alias("cost"))


@query("SELECT id, profile, coalesce(json_extract_string(metadata, '$.dates[0]'), strftime(created_at, '%Y-%m-%d')) AS day FROM mem", "mem")
def memory_date(s, d):
    return mem(s, d).select("id", "profile", T.memory_date(F.col("metadata"), F.col("content"), F.col("created_at")).alias("day"))


@query()
def keyword_cover_density(s, d):
    return S.keyword_topk(X.queries(s, d), mem(s, d), X.as_of(), 10, "cover")


# --- questions: whole benchmark texts in forms of every kind

FORMS = (
    "what is the order of %s", "how many days between %s and the %s?", "how many different %s are there", "overview of everything about '%s'", "what was it last week, %s", "tell me about %s",
    "which came first, the %s or my %s?", "how long since %s did I move", "what happened after %s did I leave my job?", "Before 2024-02-03 %s",
)


def asked(s, d):
    """query_id, text: a question about each benchmark text."""
    body = F.coalesce("text", F.lit(""))
    forms = []
    for form in FORMS:
        parts = form.split("%s")
        forms.append(F.concat(*[x for i, part in enumerate(parts) for x in ([body] if i else []) + [F.lit(part)]]))
    return X.read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(F.array(*forms), (F.col("item_id") % len(FORMS) + 1).cast("int")).alias("text"))


AQ = f"aq AS (SELECT item_id AS query_id, replace(list_extract([{', '.join(map(in_sql, FORMS))}], CAST(item_id % {len(FORMS)} + 1 AS INTEGER)), '%s', coalesce(text, '')) AS text FROM benchmark)"
says = lambda patterns: f"regexp_matches(text, {in_sql('(?i)' + '|'.join(patterns))})"
names = lambda xs: "[" + ", ".join(map(in_sql, xs)) + "]"


@query(f"""WITH {AQ} SELECT query_id, CASE WHEN {says(T.ORDERING)} THEN 'ordering' WHEN {says(T.MULTI_HOP)} THEN 'multi_hop' WHEN {says(T.CROSS_REFERENCE)} THEN 'cross_reference' WHEN {says(T.SUMMARY)} THEN 'summary'
      WHEN len(list_intersect(string_split_regex(lower(text), '[^a-z0-9_]+'), {names(T.TEMPORAL_WORDS)})) > 0 THEN 'temporal' ELSE 'plain' END AS kind FROM aq""")
def classify_query(s, d):
    return asked(s, d).select("query_id", T.classify_query(F.col("text")).alias("kind"))


@query(f"""WITH {AQ}, w AS (SELECT query_id, string_split_regex(lower(text), '[^a-z0-9_]+') AS words FROM aq)
    SELECT query_id, CASE WHEN list_has_any(words, {names(T.AFTER_WORDS)}) THEN 'future' WHEN list_has_any(words, {names(T.BEFORE_WORDS)}) THEN 'past' ELSE 'near' END AS direction FROM w""")
def direction(s, d):
    return asked(s, d).select("query_id", T.direction(F.col("text")).alias("direction"))


def _anchors_sql() -> str:
    pair = lambda p: f"CASE WHEN regexp_matches(text, {in_sql(p)}) THEN [regexp_extract(text, {in_sql(p)}, 1), regexp_extract(text, {in_sql(p)}, 2)] END"
    since = f"CASE WHEN regexp_matches(text, {in_sql(T.SINCE)}) THEN [regexp_extract(text, {in_sql(T.SINCE)}, 1)] END"
    return f"list_filter(list_transform(coalesce({', '.join(map(pair, T.ANCHORS))}, {since}, []::VARCHAR[]), lambda x: trim(regexp_replace(x, '(?i)^(?:the|a|an|my)\\s+', ''))), lambda x: length(x) > 2)"


@query(f"WITH {AQ}, a AS (SELECT query_id, {_anchors_sql()} AS anchors FROM aq) SELECT query_id, len(anchors) AS n, sha256(array_to_string(anchors, chr(10))) AS sha FROM a")
def query_anchors(s, d):
    return asked(s, d).select("query_id", T.query_anchors(F.col("text")).alias("a")).select("query_id", F.size("a").alias("n"), F.sha2(F.array_join("a", "\n"), 256).alias("sha"))


@query(f"""WITH {AQ}, t AS (SELECT query_id, text, list_concat(list_concat(list_transform(regexp_extract_all(text, {in_sql("('[^']+'|" + '"[^"]+")')}, 1), lambda x: x[2:-2]), regexp_extract_all(text, {in_sql(T.ISO_DATE)}, 1)),
      list_filter(regexp_extract_all(text, {in_sql(r"([\p{L}\p{M}\p{N}\p{Pc}](?:[\p{L}\p{M}\p{N}\p{Pc}'-]*[\p{L}\p{M}\p{N}\p{Pc}])?)")}, 1), lambda w: NOT list_contains({names(T.FILLER)}, lower(w)) AND (regexp_matches(w, '^\\p{{Lu}}') OR length(w) >= 4))) AS terms FROM aq),
    l AS (SELECT *, list_transform(terms, lambda x: lower(x)) AS low FROM t)
    SELECT query_id, sha256(CASE WHEN length(text) < 5 OR len(terms) < 2 THEN text ELSE array_to_string(list_filter(terms, lambda x, i: list_position(low, lower(x)) = i), ' ') END) AS sha FROM l""")
def reformulate_query(s, d):
    return asked(s, d).select("query_id", F.sha2(T.reformulate_query(F.col("text")), 256).alias("sha"))


# --- records from dumps and events


@query("""SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 AND text <> '' THEN text WHEN coalesce(text, '') <> '' THEN text || chr(10) || chr(10) || 'end' ELSE 'end' END) AS sha FROM conversations""")
def message_text(s, d):
    flat = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", F.col("text")), block("tool_use", F.lit("ls")), block("text", F.lit("")), block("text", F.lit("end")))
    return X.read(s, d, "conversations").select("conv_id", "turn", F.sha2(T.message_text(flat, blocks), 256).alias("sha"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE trim(coalesce(text, '')) <> '')
    SELECT 'c' || conv_id || ':' || (1700000000 + turn) || '.' || conv_id AS key, sha256(text) AS sha, 1700000000 + turn AS at FROM c WHERE turn % 5 <> 4
    UNION ALL SELECT CAST(conv_id * 1000 + turn AS VARCHAR), sha256(text), 1700000000 + turn FROM c WHERE conv_id % 3 <> 0""")
def map_chat_messages(s, d):
    """Each turn as a Slack message and as one of Telegram's kinds of update, of two chats in three."""
    c, i = X.read(s, d, "conversations").withColumn("conv_id", F.col("conv_id").cast("long")), F.col("turn")
    at = F.lit(1_700_000_000) + i
    slack = c.select(F.concat(F.lit("c"), "conv_id").alias("channel"), F.concat_ws(".", at.cast("string"), "conv_id").alias("ts"), "text", F.when(i % 5 == 4, F.lit("channel_join")).alias("subtype"))
    message = F.struct(at.alias("date"), F.struct((F.col("conv_id") % 3).alias("id")).alias("chat"), F.when(i % 2 == 0, F.col("text")).alias("text"), F.when(i % 2 == 1, F.col("text")).alias("caption"))
    kinds = ("message", "edited_message", "channel_post", "edited_channel_post")
    telegram = c.select((F.col("conv_id") * 1000 + i).alias("update_id"), *[F.when(i % 4 == n, message).alias(k) for n, k in enumerate(kinds)])
    both = I.map_slack(slack).unionByName(I.map_telegram(telegram, [1, 2]))
    return both.select("key", F.sha2("content", 256).alias("sha"), F.unix_seconds("created_at").alias("at"))


@query("""WITH o AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 > 0 THEN source END AS title, CASE WHEN doc_id % 5 > 0 THEN text END AS body, lang FROM documents),
    r AS (SELECT 'github' AS kind, id, trim(concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(body), ''))) AS content, lang || ',bug' AS tags, NULL::VARCHAR AS metadata FROM o WHERE id % 4 > 0
      UNION ALL SELECT 'beads', id, regexp_replace(coalesce(title, '') || chr(10) || chr(10) || coalesce(body, ''), '^\\s+|\\s+$', '', 'g'), lang,
        '{"status":"open","priority":' || (id % 5) || CASE WHEN id % 2 = 0 THEN ',"assignee":"' || lang || '"' ELSE '' END || '}' FROM o)
    SELECT kind, 'issue:' || id AS key, sha256(content) AS sha, tags, metadata FROM r WHERE length(content) > 0""")
def map_issues(s, d):
    """Each document as an issue of two trackers; some without title or body, every fourth of the first one a pull request."""
    i = F.col("doc_id")
    o = X.read(s, d, "documents").select(i.alias("id"), F.when(i % 7 > 0, F.col("source")).alias("title"), F.when(i % 5 > 0, F.col("text")).alias("body"), "lang")
    own = F.when(F.col("id") % 4 == 0, F.lit("pull")).alias("pull_request")
    github = I.map_github(o.select("id", "title", "body", F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("bug").alias("name"))).alias("labels"), own))
    beads = I.map_beads(o.select(
        "id", "title", F.col("body").alias("description"), F.array("lang", F.lit("")).alias("labels"), F.lit("open").alias("status"), (F.col("id") % 5).alias("priority"), F.lit(None).cast("string").alias("issue_type"),
        F.when(F.col("id") % 2 == 0, F.col("lang")).alias("assignee"),
    ))
    both = github.withColumn("kind", F.lit("github")).unionByName(beads.withColumn("kind", F.lit("beads")), allowMissingColumns=True)
    return both.select("kind", "key", F.sha2("content", 256).alias("sha"), F.array_join("tags", ",").alias("tags"), "metadata")


@query(f"""WITH {TX}, m AS (SELECT id, {_masked_sql()} AS content FROM tx WHERE id % 4 > 0)
    SELECT id, sha256(content) AS sha FROM m WHERE id % 9 = 0 OR least(1.0::DOUBLE, {IMPORTANCE} + CASE WHEN id % 9 = 1 THEN 0.1::DOUBLE ELSE 0 END) >= 0.35::DOUBLE""")
def capture_gate(s, d):
    """Each text as a tool's event; every fourth is of a tool that is skipped, one in nine has a high-signal tag, one three others."""
    i = F.col("id")
    tool = F.element_at(F.array(*map(F.lit, ("Read", "Edit", "Bash", "Write"))), (i % 4 + 1).cast("int"))
    tags = F.when(i % 9 == 0, F.array(F.lit("type:fact"))).when(i % 9 == 1, F.array(*map(F.lit, "abc"))).otherwise(F.array().cast("array<string>"))
    return V.capture_gate(texts(s, d).withColumn("tool", tool).withColumn("tags", tags)).select("id", F.sha2("content", 256).alias("sha"))


@query("""SELECT entity_id, CASE WHEN entity_id % 3 > 0 THEN entity_type END AS kind, CASE entity_id % 3 WHEN 0 THEN 'thing:' || canonical_name ELSE canonical_name || ':x' END AS name FROM ent""", "ent")
def split_entity_ref(s, d):
    e, odd = X.entities(s, d), F.col("entity_id") % 3 == 0
    ref = F.when(odd, F.concat(F.lit("thing:"), "canonical_name")).otherwise(F.concat_ws(":", "entity_type", "canonical_name", F.lit("x")))
    return e.select("entity_id", T.split_entity_ref(ref).alias("r")).select("entity_id", "r.kind", "r.name")


@query("SELECT profile, 'part:' || entity_id AS entity FROM me UNION SELECT 'p', subject FROM facts UNION SELECT 'p', object FROM facts", "me facts")
def list_profile_entities(s, d):
    named = X.memory_entities(s, d).select("profile", F.concat(F.lit("part:"), F.col("entity_id").cast("string")).alias("entity"))
    return O.list_profile_entities(named, X.typed_edges(s, d))
