"""Entities of memories, and activation that spreads over the memory-entity graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.base import cut, top

#: How strong the evidence of an entity type is.
SYNTACTIC = ("entity", "file", "error", "quantity")
RANKS = {"structured": 3, "syntactic": 2}


def evidence_class(kind: Column) -> Column:
    return F.when(kind.isin(*SYNTACTIC), "syntactic").otherwise("inferred")


def evidence_rank(evidence: Column) -> Column:
    out = F.lit(1)
    for name, rank in RANKS.items():
        out = F.when(evidence == name, rank).otherwise(out)
    return out


def link_entities(mem_tags: DataFrame, entities: DataFrame, memory_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of entities and of memory_entities after each memory's `type:name` tags are linked.

    mem_tags: memory_id, profile, tags. The second colon field is the name, an empty one is skipped, repeats within a
    memory count once. An entity gets one mention for each memory; its evidence is raised, never lowered.
    """
    parts = mem_tags.select("memory_id", "profile", F.explode("tags").alias("tag")).select(
        "memory_id", "profile", F.split_part("tag", F.lit(":"), F.lit(1)).alias("entity_type"), F.split_part("tag", F.lit(":"), F.lit(2)).alias("canonical_name")
    ).filter((F.col("entity_type") != "") & (F.col("canonical_name") != "")).distinct()
    mentions = parts.groupBy("canonical_name", "entity_type").agg(F.count("*").alias("n")).withColumn("seen", evidence_class(F.col("entity_type")))
    both = entities.join(mentions, ["canonical_name", "entity_type"], "full_outer")
    better = F.col("evidence_class").isNull() | (evidence_rank(F.col("seen")) > evidence_rank(F.col("evidence_class")))
    new = both.select(
        "canonical_name", "entity_type", (F.coalesce("mention_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("mention_count"),
        F.when(F.col("seen").isNotNull() & better, F.col("seen")).otherwise(F.col("evidence_class")).alias("evidence_class"),
    )
    links = memory_entities.unionByName(parts.select("memory_id", "profile", "canonical_name", "entity_type")).dropDuplicates(["memory_id", "canonical_name", "entity_type"])
    return new, links


def temporal_span(memory_entities: DataFrame, mem: DataFrame) -> DataFrame:
    """entity_id, session_count (distinct days of its memories), temporal_span = ln(1 + sessions)."""
    days = memory_entities.join(mem.select(F.col("id").alias("memory_id"), F.to_date("created_at").alias("day")), "memory_id")
    return days.groupBy("entity_id").agg(F.countDistinct("day").alias("session_count")).withColumn("temporal_span", F.log1p("session_count"))


def spread_activation(seeds: DataFrame, memory_entities: DataFrame, entities: DataFrame, depth: int = 2, decay: float = 0.65, min_activation: float = 0.1, k: int = 50) -> DataFrame:
    """query_id, id, activation, rank: memories activated from seed entities. seeds: query_id, profile, entity_id (activation 1).

    A hop goes from an entity to its memories and their other entities (not persons), with activation times
    decay * min(span, 3) / ln(1 + max(mentions, 1)); only more than min_activation goes on, and activation is capped at
    1. The largest activation of an entity is kept at each hop, which gives what all paths would, as activation only
    falls with the parent's. That factor belongs to the target alone, so entities that can't pass are left out first.

    From the second hop on, a query's k first memories so far bound what is still looked for: an entity goes on only if the largest
    factor could lift what it reaches to the last of these, and a query of which none goes on has its result.
    """
    factor = decay * F.least("temporal_span", F.lit(3.0)) / F.log(1 + F.greatest("mention_count", F.lit(1)))
    able = cut(entities.filter(F.col("entity_type") != "person").select("entity_id", factor.alias("factor")).filter(F.col("factor") > min_activation))
    member = cut(memory_entities.select("profile", "memory_id", "entity_id"))
    most = able.agg(F.max("factor")).first()[0] or 0.0
    front = seeds.select("query_id", "profile", "entity_id", F.lit(1.0).alias("activation")).distinct()
    every, least, done = front, None, []

    def first(found: DataFrame) -> DataFrame:
        strongest = found.groupBy("query_id", "profile", "entity_id").agg(F.max("activation").alias("activation"))
        memories = strongest.join(member, ["profile", "entity_id"]).groupBy("query_id", F.col("memory_id").alias("id")).agg(F.max("activation").alias("activation"))
        return top(memories.withColumn("activation", F.round("activation", 6)), ["query_id"], [F.desc("activation"), F.asc("id")], k)

    def within(found: DataFrame, growth: float = 1.0) -> DataFrame:
        """found without what stays below the last of its query's k first memories when it grows so much."""
        if least is None:
            return found
        reach = F.round(F.least(F.col("activation") * growth, F.lit(1.0)) + 1e-9, 6)  # a little more than products in any order give
        return found.join(least, "query_id", "left").filter(F.col("least").isNull() | (reach >= F.col("least"))).drop("least")

    for hop in range(depth):
        if hop:
            best = cut(first(every))
            least = cut(best.filter(F.col("rank") == k).select("query_id", F.col("activation").alias("least")))
            front = cut(within(front, most * max(1.0, most) ** (depth - hop - 1)))
            going = cut(front.select("query_id").distinct())
            done.append(best.join(going, "query_id", "left_anti"))
            every = every.join(going, "query_id", "left_semi")
            if going.isEmpty():
                break
        # The best parent of a target in a memory is another entity than the target; a memory's best and second best suffice.
        w = Window.partitionBy("query_id", "profile", "memory_id").orderBy(F.desc("activation"), F.desc("entity_id"))
        two = front.join(member, ["profile", "entity_id"]).withColumn("n", F.row_number().over(w)).filter("n <= 2")
        one, second = F.col("n") == 1, F.col("n") == 2
        reached = two.groupBy("query_id", "profile", "memory_id").agg(F.max(F.when(one, F.col("entity_id"))).alias("best"), F.max(F.when(one, F.col("activation"))).alias("a"), F.max(F.when(second, F.col("activation"))).alias("b"))
        around = reached.join(member.select("memory_id", F.col("entity_id").alias("target")), "memory_id").join(able.withColumnRenamed("entity_id", "target"), "target")
        parent = F.when(F.col("target") != F.col("best"), F.col("a")).otherwise(F.col("b"))
        front = around.select("query_id", "profile", F.col("target").alias("entity_id"), (parent * F.col("factor")).alias("activation")).filter(F.col("activation") > min_activation)
        front = front.groupBy("query_id", "profile", "entity_id").agg(F.least(F.max("activation"), F.lit(1.0)).alias("activation"))
        front = cut(within(front, max(1.0, most) ** (depth - hop - 1)))
        every = within(every).unionByName(front)
    else:
        done.append(first(every))
    return reduce(DataFrame.unionByName, done)


def graph_density(memory_entities: DataFrame) -> DataFrame:
    """profile, n_entities, n_edges, density (edges over entities)."""
    out = memory_entities.groupBy("profile").agg(F.countDistinct("entity_id").alias("n_entities"), F.count("*").alias("n_edges"))
    return out.withColumn("density", F.when(F.col("n_entities") > 0, F.col("n_edges") / F.col("n_entities")).otherwise(2.0))


def activation_weight(density: Column) -> Column:
    """0.30 up to a density of 1.5, 0.05 from 3.5, linear between."""
    return F.when(density <= 1.5, 0.30).when(density >= 3.5, 0.05).otherwise(0.30 - (density - 1.5) / 2 * 0.25)


def backfill_entities(mem: DataFrame, entities: DataFrame, memory_entities: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities and memory_entities after the entities in all active memories' texts are linked, and counts by profile:
    processed, with_entities, edges_added. Links that are there already add nothing."""
    from cairn.functions.text import extract_entities
    from cairn.operators.base import active

    tagged = cut(mem.filter(active(as_of)).select(F.col("id").alias("memory_id"), "profile", extract_entities(F.col("content")).alias("tags")))
    found = tagged.select("memory_id", "profile", F.explode("tags").alias("tag")).select("memory_id", "profile", F.split_part("tag", F.lit(":"), F.lit(1)).alias("entity_type"), F.split_part("tag", F.lit(":"), F.lit(2)).alias("canonical_name"))
    fresh = cut(found.filter("canonical_name <> ''").distinct().join(memory_entities, ["memory_id", "entity_type", "canonical_name"], "left_anti"))
    tags = fresh.groupBy("memory_id", "profile").agg(F.collect_list(F.concat_ws(":", "entity_type", "canonical_name")).alias("tags"))
    new_entities, new_links = link_entities(tags, entities, memory_entities)
    added = fresh.groupBy("profile").agg(F.count("*").alias("edges_added"))
    counts = tagged.groupBy("profile").agg(F.count("*").alias("processed"), F.count_if(F.size("tags") > 0).alias("with_entities")).join(added, "profile", "left").na.fill({"edges_added": 0})
    return new_entities, new_links, counts
