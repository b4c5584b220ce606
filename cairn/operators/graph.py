"""Walks over the memory graph: bounded loops of equi-joins, deduplicated at every step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.base import active, both_ways, cut, top


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") == 1).drop("__n")


def related_memories(starts: DataFrame, edges: DataFrame, mem: DataFrame, as_of: Column, depth: int = 1, min_strength: float = 0.5, types: list[str] | None = None, k: int = 20) -> DataFrame:
    """start, id, depth, strength: active memories within `depth` steps either way, one row each, at the smallest depth
    over its strongest edge; the k first by depth and strength. starts: start."""
    kept = edges.filter(F.col("strength") >= min_strength)
    if types is not None:
        kept = kept.filter(F.col("relationship").isin(types))
    step = both_ways(kept.select("source_id", "target_id", "strength"))
    live = mem.filter(active(as_of)).select("id")
    front = starts.select("start", F.col("start").alias("id")).distinct()
    seen = front.select("start", "id", F.lit(0).alias("depth"), F.lit(0.0).alias("strength"))
    for d in range(1, depth + 1):
        found = front.join(step, "id").select("start", F.col("other").alias("id"), "strength").groupBy("start", "id").agg(F.max("strength").alias("strength"))
        found = found.join(live, "id", "left_semi").join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(d).alias("depth"), "strength")
        found = cut(found) if depth > 1 else found
        seen, front = seen.unionByName(found), found.select("start", "id")
    return top(seen.filter(F.col("depth") > 0), ["start"], [F.asc("depth"), F.desc("strength"), F.asc("id")], k)


def explore_graph(seeds: DataFrame, edges: DataFrame, mem: DataFrame, as_of: Column, depth: int = 1, min_strength: float = 0.5) -> DataFrame:
    """query_id, id, depth, relevance: seeds, and what they reach, with relevance times the strengths on the way; the best
    path to each memory. One row is kept for a node and depth, which is exact as strengths are at most 1. seeds: query_id, id, relevance."""
    step = both_ways(edges.filter(F.col("strength") >= min_strength).select("source_id", "target_id", "strength"))
    live = mem.filter(active(as_of)).select("id")
    front = cut(seeds.select("query_id", "id", "relevance", F.lit(0).alias("depth")))
    every = front
    for d in range(1, depth + 1):
        front = front.join(step, "id").select("query_id", F.col("other").alias("id"), (F.col("relevance") * F.col("strength")).alias("relevance")).groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"))
        front = front.join(live, "id", "left_semi").select("query_id", "id", "relevance", F.lit(d).alias("depth"))
        front = cut(front) if d < depth else front
        every = every.unionByName(front)
    return _first(every, ["query_id", "id"], [F.desc("relevance"), F.asc("depth")])


def walk_graph(starts: DataFrame, edges: DataFrame, depth: int = 2, direction: str = "both", min_strength: float = 0.0, k: int = 50) -> DataFrame:
    """start, id, depth, connected_from, direction_used: each memory at its smallest depth, over the strongest edge there,
    then the smallest parent; no expiry filter. direction: outgoing, incoming or both."""
    kept = edges.filter(F.col("strength") >= min_strength)
    out = kept.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "strength", F.lit("outgoing").alias("direction_used"))
    back = kept.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "strength", F.lit("incoming").alias("direction_used"))
    step = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    front = starts.select("start", F.col("start").alias("id")).distinct()
    seen = front.select("start", "id", F.lit(0).alias("depth"), F.col("start").alias("connected_from"), F.lit("start").alias("direction_used"), F.lit(1.0).alias("strength"))
    for d in range(1, min(depth, 5) + 1):
        found = front.join(step, "id").select("start", F.col("other").alias("id"), F.col("id").alias("connected_from"), "direction_used", "strength")
        found = _first(found, ["start", "id"], [F.desc("strength"), F.asc("connected_from"), F.desc("direction_used")]).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        found = found.select("start", "id", F.lit(d).alias("depth"), "connected_from", "direction_used", "strength")
        found = cut(found) if depth > 1 else found
        seen, front = seen.unionByName(found), found.select("start", "id")
    return top(seen.filter(F.col("depth") > 0), ["start"], [F.asc("depth"), F.desc("strength"), F.asc("id")], k)


def contradictions(edges: DataFrame, mem: DataFrame, n: int = 10) -> DataFrame:
    """Contradicting pairs with both ends in one profile: the newest n of each, and the total."""
    ends = mem.select("id", "profile")
    rows = (
        edges.filter(F.col("relationship") == "contradicts").select("source_id", "target_id", "strength", "created_at")
        .join(ends.select(F.col("id").alias("source_id"), "profile"), "source_id").join(ends.select(F.col("id").alias("target_id"), F.col("profile").alias("p2")), "target_id")
        .filter(F.col("profile") == F.col("p2")).drop("p2").withColumn("total", F.count("*").over(Window.partitionBy("profile")))
    )
    return top(rows, ["profile"], [F.desc("created_at"), F.asc("source_id"), F.asc("target_id")], n)


def in_result_contradictions(results: DataFrame, edges: DataFrame, mem: DataFrame) -> DataFrame:
    """query_id, stale_id, newer_id: contradicting pairs within a result set, by creation; equal times are dropped."""
    at = mem.select("id", F.unix_micros("created_at").alias("at"))
    own = results.select("query_id", "id").join(at, "id")
    pairs = edges.filter(F.col("relationship") == "contradicts").select("source_id", "target_id").distinct()
    both = pairs.join(own.select("query_id", F.col("id").alias("source_id"), F.col("at").alias("s")), "source_id").join(own.select("query_id", F.col("id").alias("target_id"), F.col("at").alias("t")), ["query_id", "target_id"])
    older = F.col("s") < F.col("t")
    return both.filter(F.col("s") != F.col("t")).select("query_id", F.when(older, F.col("source_id")).otherwise(F.col("target_id")).alias("stale_id"), F.when(older, F.col("target_id")).otherwise(F.col("source_id")).alias("newer_id")).distinct()


def out_of_result_contradictions(results: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, in_id, other_id, strength: contradictions with exactly one end in the result set."""
    ways = both_ways(edges.filter(F.col("relationship") == "contradicts").select("source_id", "target_id", "strength"))
    own = results.select("query_id", "id").distinct()
    found = own.join(ways, "id").select("query_id", F.col("id").alias("in_id"), "other", "strength")
    return found.join(own.withColumnRenamed("id", "other"), ["query_id", "other"], "left_anti").select("query_id", "in_id", F.col("other").alias("other_id"), "strength")


def rarest_first(memory_entities: DataFrame, min_shared: int) -> DataFrame:
    """memory_id, entities (rarest first), entity: a row for each entity but the min_shared - 1 commonest of a memory with min_shared or
    more. Two memories that share min_shared entities share one of these: the rarest that they share has the others after it in both."""
    links = memory_entities.select("memory_id", "entity_id").distinct()
    often = links.groupBy("entity_id").agg(F.count("*").alias("n"))
    ordered = links.join(often, "entity_id").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("n", "entity_id"))).alias("found"))
    sets = ordered.select("memory_id", F.transform("found", lambda e: e["entity_id"]).alias("entities")).filter(F.size("entities") >= min_shared)
    return sets.withColumn("entity", F.explode(F.slice("entities", F.lit(1), F.size("entities") - (min_shared - 1))))


def suggest_connections(memory_entities: DataFrame, edges: DataFrame, mem: DataFrame, as_of: Column | None = None, starts: DataFrame | None = None, min_shared: int = 2, k: int = 10) -> DataFrame:
    """start, id, shared: active memories that share min_shared entities with the start and no edge; the first k by shared
    count, then newest.

    A prefix filter: memories meet on their rarer entities only (rarest_first), so that one which very many memories have makes no
    pairs unless it is among a memory's rarest; a pair is kept at the first entity that it shares, and counted on the full sets.
    """
    links = cut(rarest_first(memory_entities, min_shared))  # cut, so that the join can split an entity of very many memories
    left = links.select(F.col("memory_id").alias("start"), F.col("entities").alias("own"), "entity")
    if starts is not None:
        left = left.join(starts.select("start"), "start", "left_semi")
    met = left.join(links.withColumnRenamed("memory_id", "id"), "entity").filter(F.col("start") != F.col("id")).withColumn("both", F.array_intersect("own", "entities"))
    pairs = met.filter((F.size("both") >= min_shared) & (F.get("both", F.lit(0)) == F.col("entity"))).select("start", "id", F.size("both").cast("long").alias("shared"))
    known = both_ways(edges.select("source_id", "target_id")).select(F.col("id").alias("start"), F.col("other").alias("id"))
    live = mem.filter(active(as_of)) if as_of is not None else mem
    fresh = pairs.join(known, ["start", "id"], "left_anti").join(live.select("id", "created_at"), "id")
    return top(fresh, ["start"], [F.desc("shared"), F.desc("created_at"), F.asc("id")], k)
