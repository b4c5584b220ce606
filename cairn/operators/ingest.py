"""From dumps and conversations to memory records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.words import ENGLISH, Words
from cairn.operators.base import active, cut, top
from cairn.operators.entities import link_entities
from cairn.operators.linking import links_of

#: Automatic edges of a new memory.
MAX_LINKS = 5
#: Short courtesies that carry nothing.
PLEASANTRIES = ("hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "yes", "no", "sure", "great", "cool", "bye", "good", "nice")


def conversation_turn_pairs(turns: DataFrame, smart_filter: bool = True) -> DataFrame:
    """conv_id, turn_index, user_prompt, content: each assistant turn with the latest human turn before it that isn't used
    yet. Other senders are skipped; empty texts and, with smart_filter, short answers and courtesies are dropped; kept
    pairs are numbered from 0. turns: conv_id, turn, sender, text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = turns.filter(F.col("sender").isin("human", "assistant")).select("conv_id", "turn", "sender", "text", F.lag("sender").over(w).alias("before"), F.lag("text").over(w).alias("prompt"))
    pairs = own.filter((F.col("sender") == "assistant") & (F.col("before") == "human") & (F.length(F.trim("text")) > 0) & (F.length(F.trim("prompt")) > 0))
    if smart_filter:
        plain = F.regexp_replace(F.trim(F.lower("prompt")), r"[.!?]+$", "")
        pairs = pairs.filter((F.length(F.trim("text")) >= 50) & ~((F.length(plain) < 10) & plain.isin(*PLEASANTRIES)))
    return pairs.select("conv_id", (F.row_number().over(w) - 1).alias("turn_index"), F.col("prompt").alias("user_prompt"), F.col("text").alias("content"))


def map_slack(raw: DataFrame) -> DataFrame:
    """key, content, created_at of plain messages: no subtype, some text, a well-formed ts. raw: channel, ts, text, subtype."""
    good = raw.filter(F.col("subtype").isNull() & (F.length(F.trim("text")) > 0) & F.regexp_like("ts", F.lit(r"^[0-9]+\.[0-9]+$")))
    return good.select(F.concat_ws(":", "channel", "ts").alias("key"), F.col("text").alias("content"), F.timestamp_seconds(F.split_part("ts", F.lit("."), F.lit(1)).cast("long")).alias("created_at"))


def map_telegram(raw: DataFrame, allowed_chats: list[int] | None = None) -> DataFrame:
    """The first of the message kinds, its text or caption. raw: update_id and the four kinds as structs of date, chat, text, caption."""
    message = F.coalesce("message", "edited_message", "channel_post", "edited_channel_post")
    rows = raw.select("update_id", message.alias("m")).filter(F.col("m").isNotNull())
    if allowed_chats is not None:
        rows = rows.filter(F.col("m.chat.id").isin(allowed_chats))
    said = rows.select(F.col("update_id").cast("string").alias("key"), F.coalesce("m.text", "m.caption").alias("content"), F.timestamp_seconds("m.date").alias("created_at"))
    return said.filter(F.length(F.trim("content")) > 0)


def map_github(raw: DataFrame) -> DataFrame:
    """Issues without pull requests and empty ones: title and body, labels as tags. raw: id, title, body, labels (array of struct name), pull_request."""
    content = F.trim(F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("body"), F.lit(""))))
    rows = raw.filter(F.col("pull_request").isNull()).select(F.concat(F.lit("issue:"), F.col("id").cast("string")).alias("key"), content.alias("content"), F.transform("labels", lambda x: x["name"]).alias("tags"))
    return rows.filter(F.length("content") > 0)


def map_comments(raw: DataFrame, text_col: str = "body") -> DataFrame:
    """key, content, tags, issue of comments with an id and a text. raw: id, the text, issue."""
    rows = raw.filter(F.col("id").isNotNull() & (F.length(F.col(text_col)) > 0))
    return rows.select(F.concat(F.lit("comment:"), F.col("id").cast("string")).alias("key"), F.col(text_col).alias("content"), F.array().cast("array<string>").alias("tags"), "issue")


def map_beads(raw: DataFrame) -> DataFrame:
    """key, content, tags, metadata of issues with an id and some text: title and description, labels that aren't empty.
    raw: id, title, description, labels (array of strings), status, priority, issue_type, assignee."""
    content = F.trim(F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    tags = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    rows = raw.filter(F.col("id").isNotNull()).select(
        F.concat(F.lit("issue:"), F.col("id").cast("string")).alias("key"), F.regexp_replace(content, r"^\s+|\s+$", "").alias("content"), tags.alias("tags"), F.to_json(F.struct("status", "priority", "issue_type", "assignee")).alias("metadata")
    )
    return rows.filter(F.length("content") > 0)


def map_linear(raw: DataFrame) -> DataFrame:
    """`# title`, description, and `## Comments` by user. raw: identifier, title, description, labels and comments with nodes."""
    comments = F.transform("comments.nodes", lambda c: F.concat(F.lit("**"), c["user"]["name"], F.lit("**: "), c["body"]))
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), F.nullif(F.col("description"), F.lit("")), F.when(F.size(comments) > 0, F.concat(F.lit("## Comments\n\n"), F.array_join(comments, "\n\n"))))
    tags = F.concat(F.transform("labels.nodes", lambda x: F.concat(F.lit("linear:"), x["name"])), F.array(F.lit("type:task")))
    return raw.select(F.col("identifier").alias("key"), content.alias("content"), tags.alias("tags"))


def store_enriched(new: DataFrame, mem: DataFrame, settings: DataFrame, as_of: Column, threshold: float = 0.85, words: Words = ENGLISH) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Memories, contradiction edges, automatic edges and entity links (memory_id, profile, canonical_name, entity_type) for a batch,
    compared with the store as it was; link_entities() takes the memories' tags on to the entities' counts and evidence.

    new: id, profile, content, tags, embedding. Secrets are masked; dates, entities, recurrence, importance, polarity,
    surprise (1 - the largest similarity, 0.5 without neighbours) and expiry are added; conflicts are those of 0.75 or more among the five nearest neighbours.
    """
    from cairn.functions.vectors import similar, topk

    masked = new.withColumn("content", T.mask_secrets(F.col("content")))
    tags = F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), T.extract_entities(F.col("content"), words)))
    rows = masked.withColumn("tags", tags).withColumn("dates", T.extract_dates(F.col("content"), as_of.cast("date"))).withColumn("recurrence_days", T.extract_recurrence(F.col("content"), words))
    rows = rows.withColumn("importance", T.compute_importance(F.col("content"), F.col("tags"))).withColumn("polarity", T.negation_polarity(F.col("content")))
    live = mem.filter(active(as_of))
    asked = new.select(F.col("id").alias("query_id"), "profile", "embedding")
    found = cut(similar(asked, live, max(5, MAX_LINKS + 1), min(0.7499995, threshold)))  # similarities have six digits
    alone = topk(asked.join(found.select("query_id").distinct(), "query_id", "left_anti"), live, 1)  # only how near the nearest is matters
    closest = found.select("query_id", "similarity").unionByName(alone.select("query_id", "similarity")).groupBy(F.col("query_id").alias("id")).agg(F.max("similarity").alias("closest"))
    near = top(found, ["query_id"], [F.desc("similarity"), F.asc("id")], 5).select(F.col("query_id").alias("id"), F.col("id").alias("other_id"), "similarity")
    rows = rows.join(closest, "id", "left").withColumn("surprise", F.coalesce(F.round(1 - F.col("closest"), 3), F.lit(0.5))).drop("closest")
    rows = rows.join(settings.select("profile", "ttl_days"), "profile", "left").withColumn("expires_at", F.timestamp_seconds(F.unix_seconds(as_of) + F.col("ttl_days") * 86400)).drop("ttl_days").withColumn("created_at", as_of)
    rows = cut(rows)  # each text is read and enriched once, whatever is asked of the results
    against = near.filter(F.col("similarity") >= 0.75).join(live.select(F.col("id").alias("other_id"), T.negation_polarity(F.substring("content", 1, 200)).alias("other_polarity")), "other_id").join(rows.select("id", "polarity"), "id")
    contradicts = against.filter(F.col("polarity") != F.col("other_polarity")).select(F.col("id").alias("source_id"), F.col("other_id").alias("target_id"), F.lit("contradicts").alias("relationship"), F.lit(1.0).alias("strength"))
    mentions = link_entities(rows.select(F.col("id").alias("memory_id"), "profile", "tags"), *_no_entities(rows))[1]
    return rows, contradicts, links_of(found, threshold, MAX_LINKS), mentions


def _no_entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty tables of entities and of links, for ids like those of rows."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    return spark.createDataFrame([], "canonical_name string, entity_type string, mention_count long, evidence_class string"), spark.createDataFrame([], f"memory_id {kind}, profile string, canonical_name string, entity_type string")
