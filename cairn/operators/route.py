"""Routed search: each query by the way that suits its kind, with bridges between what it compares and threads of what it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import rerank as K
from cairn.operators.base import cut, top
from cairn.operators.search import augment, hybrid_search

#: Words of four letters or more that name nothing.
NAMELESS = (
    "your", "this", "that", "were", "been", "have", "does", "will", "would", "could", "should", "might", "shall", "then", "with", "from", "what", "when", "where", "which", "each", "every",
    "some", "many", "much", "more", "most", "other", "first", "last", "next", "different", "same", "user", "assistant", "date", "time", "project", "code", "feature", "system",
)


def _untagged(queries: DataFrame) -> DataFrame:
    return queries.withColumn("tags", F.array().cast("array<string>"))


def _best(results: DataFrame, k: int) -> DataFrame:
    return top(results.select("query_id", "id", "relevance"), ["query_id"], [F.desc("relevance"), F.asc("id")], k)


def _anchors(queries: DataFrame, embed: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """key, query_id, profile, text, embedding, place, n: the things that a query compares, each to be searched for."""
    asked = queries.select("query_id", "profile", "embedding", T.query_anchors(F.col("text")).alias("anchors")).filter(F.size("anchors") > 0)
    anchors = asked.select("query_id", "profile", "embedding", F.size("anchors").alias("n"), F.posexplode("anchors").alias("place", "text"))
    anchors = anchors.withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("place").cast("string")))
    if embed:
        anchors = anchors.drop("embedding").join(embed(anchors.select("key", "query_id", "profile", "text")).select("key", "embedding"), "key")
    return anchors


def _searches(queries: DataFrame, key: Column, k: Column, decay: float = 0.0) -> DataFrame:
    """Queries of one kind for a search that many kinds share: __key tells kind and query, k is each one's limit."""
    return queries.select(key.alias("query_id"), "profile", "text", "embedding", "tags", k.cast("int").alias("k"), F.lit(decay).alias("decay"))


def _bridge_queries(queries: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """A query's anchors, each with half of the room where there are two, and the query itself where it has anchors."""
    each = F.when(F.col("n") == 1, 2 * max(limit, 10)).otherwise(max(limit, 10) // 2 * 2)
    standard = queries.join(anchors.select("query_id").distinct(), "query_id", "left_semi")
    return _searches(_untagged(anchors), F.concat(F.lit("anchor "), "key"), each).unionByName(_searches(_untagged(standard), F.concat(F.lit("query "), F.col("query_id").cast("string")), F.lit(2 * limit)))


def _bridged(found: DataFrame, queries: DataFrame, anchors: DataFrame, mem: DataFrame, limit: int) -> DataFrame:
    """The results of _bridge_queries' searches, joined for each query."""
    kind = dict(queries.dtypes)["query_id"]
    keys = anchors.select(F.concat(F.lit("anchor "), "key").alias("query_id"), F.col("query_id").alias("asked"), "place")
    bridged = found.join(keys, "query_id").select(F.col("asked").cast(kind).alias("query_id"), "id", (F.col("relevance") + 0.3 * F.log1p("relevance")).alias("relevance"), F.lit(0).alias("later"), "rank", "place")
    names = queries.select(F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("named"), F.col("query_id").alias("asked"))
    standard = found.withColumnRenamed("query_id", "named").join(names, "named").select(F.col("asked").alias("query_id"), "id", "relevance", F.lit(1).alias("later"), "rank", F.lit(0).alias("place"))
    once = top(bridged.unionByName(standard), ["query_id", "id"], [F.asc("later"), F.asc("rank"), F.asc("place")], 1, "copy")
    timed = once.join(mem.select("id", "created_at"), "id").withColumn("relevance", F.round(F.col("relevance") + F.unix_seconds("created_at") * F.lit(1e-15), 9))
    return _best(timed, limit)


def bridge_search(queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, limit: int = 10, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, id, relevance, rank for queries that compare two things: a search for each (its anchors), taken in turn,
    with relevance r + 0.3 ln(1 + r), before the standard search; equal scores by time.

    Queries without anchors have no rows. queries: query_id, profile, text, embedding. embed gives the anchors' table (key,
    query_id, profile, text) its embeddings; without it an anchor is searched with its query's. All searches share one pass, each
    with its own limit.
    """
    anchors = _anchors(queries, embed)
    found = hybrid_search(_bridge_queries(queries, anchors, limit), mem, edges, as_of, "k")
    return _bridged(found, queries, anchors, mem, limit)


def named_things(query: Column, contents: Column) -> Column:
    """The five most telling names in a question and its first results: capitalised phrases (3), technical terms (2), quoted
    terms (2), then the question's own longer words (3)."""
    everything = F.concat_ws(" ", query, contents)
    found = lambda p: F.regexp_extract_all(everything, F.lit(p), F.lit(1))
    phrases = F.slice(found(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1, 3)
    terms = F.slice(found(r"\b([A-Z][a-zA-Z]+(?:-[a-zA-Z]+)+|[a-z]+[A-Z]\w+|[A-Z]{2,}[a-z]\w*)\b"), 1, 2)
    names = F.concat(phrases, terms, F.slice(found(r'"([^"]+)"'), 1, 2))
    words = F.slice(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"\b(\w{4,})\b"), F.lit(1)), lambda w: ~w.isin(*NAMELESS)), 1, 3)
    more = F.filter(words, lambda w: ~F.array_contains(F.transform(names, F.lower), w))
    return F.slice(F.concat(names, more), 1, 5)


def entity_thread(results: DataFrame, queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """query_id, id, relevance, rank: the results, and in turn with them what a second search finds for the names in the
    question and its first three results (500 characters of each); each memory once. results: query_id, id, relevance, rank."""
    lead = results.filter(F.col("rank") <= 3).join(mem.select("id", F.substring("content", 1, 500).alias("lead")), "id")
    lead = lead.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "lead"))), lambda x: x["lead"]), " ").alias("lead"))
    second = queries.join(lead, "query_id").withColumn("names", named_things(F.col("text"), F.col("lead"))).filter(F.size("names") > 0)
    second = _untagged(second.select("query_id", "profile", F.array_join("names", " ").alias("text"), "embedding"))
    again = hybrid_search(second, mem, edges, as_of, 2 * limit)
    rows = results.select("query_id", "id", "relevance", (2 * F.col("rank")).alias("turn")).unionByName(again.select("query_id", "id", "relevance", (2 * F.col("rank") + 1).alias("turn")))
    once = top(rows, ["query_id", "id"], [F.asc("turn")], 1, "copy").drop("copy")
    return top(once, ["query_id"], [F.asc("turn")], limit).select("query_id", "id", "relevance", "rank")


def route_search(
    queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, limit: int = 10, activation: DataFrame | None = None, weights: DataFrame | None = None, graph_depth: int = 0,
    anchors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """query_id, id, relevance, rank, route: every query by the first route that fits.

    ordering: 10 x limit results strided to 4 x limit, activation merged, by the memories' dates, 2 x limit. multi_hop (with
    anchors): bridge and thread, 2 x limit. cross_reference: 6 x limit, activation merged (0.15), 2 x limit. summary: 10 x
    limit strided to 2 x limit, activation merged (0.4). Else temporal or plain: 3 x limit with a recency decay of 0.01, or
    graph-augmented where graph_depth is over 0, then dates spread to `limit`, and for temporal queries re-ranked around
    `anchors` (query_id, start, stop, direction). Only plain queries are searched by their reformulated text. Here limit is
    what the caller asks for. activation: query_id, id, activation; weights: query_id, weight; without them nothing is merged.
    """
    asked = queries.withColumn("route", T.query_route(F.col("text")))
    asked = cut(asked.withColumn("text", F.when(F.col("route") == "plain", T.reformulate_query(F.col("text"))).otherwise(F.col("text"))))
    wide, dates = 2 * limit, mem.select("id", F.to_date(T.memory_date(F.col("metadata"), F.col("content"), F.col("created_at"))).alias("day"))
    of = lambda *routes: asked.filter(F.col("route").isin(*routes)).drop("route")
    dated = lambda rows: rows.select("query_id", "id", "relevance").join(dates, "id", "left")

    def merged(rows: DataFrame, most: int, fraction: float) -> DataFrame:
        rows = rows.select("query_id", "id", "relevance", "rank")
        return rows.filter(F.col("rank") <= most) if activation is None or weights is None else K.activation_merge(rows, activation, weights, most, fraction)

    # Every route's first search, in one pass; only threads need another, for the names in what has been found.
    name = F.concat(F.lit("route "), F.col("query_id").cast("string"))
    hops = of("multi_hop")
    anchored = _anchors(hops, embed)
    batch = _bridge_queries(hops, anchored, wide)
    for routes, k, decay in ((("ordering", "summary"), 5 * wide, 0.0), (("cross_reference",), 3 * wide, 0.0), (("temporal", "plain"), 3 * limit, 0.0 if graph_depth else 0.01)):
        batch = batch.unionByName(_searches(of(*routes), name, F.lit(k), decay))
    everything = cut(hybrid_search(cut(batch), mem, edges, as_of, "k", recency_decay="decay"))
    keys = asked.select(name.alias("named"), F.col("query_id").alias("asked"), "route")
    searched = everything.withColumnRenamed("query_id", "named").join(keys, "named").withColumnRenamed("asked", "query_id").drop("named")
    got = lambda *routes: searched.filter(F.col("route").isin(*routes)).drop("route")

    ordering = merged(K.strided_select(dated(got("ordering")), 2 * wide), 2 * wide, 0.5)
    by_date = Window.partitionBy("query_id").orderBy(F.coalesce(F.col("day").cast("string"), F.lit("9999")), "place")
    ordering = dated(ordering).join(ordering.select("query_id", "id", F.col("rank").alias("place")), ["query_id", "id"]).withColumn("rank", F.row_number().over(by_date)).filter(F.col("rank") <= wide)
    hops = entity_thread(cut(_bridged(everything, hops, anchored, mem, wide)), hops, mem, edges, as_of, wide)
    crossed = merged(got("cross_reference"), wide, 0.15)
    summary = merged(K.strided_select(dated(got("summary")), wide), wide, 0.4)
    found = augment(got("temporal", "plain"), mem, edges, as_of, 3 * limit, graph_depth) if graph_depth else got("temporal", "plain")
    found = K.temporal_diversity_rerank(dated(found), limit)
    if anchors is not None:
        temporal = of("temporal").select("query_id")
        timed = found.select("query_id", "id", "relevance").join(temporal, "query_id", "left_semi").join(dates.select("id", F.col("day").cast("timestamp").alias("at")), "id", "left")
        timed = K.temporal_rerank(timed, anchors).filter(F.col("rank") <= limit)
        found = found.join(temporal, "query_id", "left_anti").select("query_id", "id", "relevance", "rank").unionByName(timed.select("query_id", "id", "relevance", "rank"))
    out = None
    for part in (ordering, hops, crossed, summary, found):
        part = part.select("query_id", "id", "relevance", "rank")
        out = part if out is None else out.unionByName(part)
    return out.join(asked.select("query_id", "route"), "query_id")
