"""Links, near-duplicates and ingest: joins on similarity and on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.vectors import similar
from cairn.operators.base import active, top


def auto_link(new: DataFrame, mem: DataFrame, as_of: Column, threshold: float = 0.85, max_links: int = 5) -> DataFrame:
    """source_id, target_id, relationship, strength, created_by: up to max_links most similar active others of the profile.
    An exact join that prunes by angles (vectors.similar)."""
    return links_of(similar(new.select(F.col("id").alias("query_id"), "profile", "embedding"), mem.filter(active(as_of)), max_links + 1, threshold), threshold, max_links)


def links_of(found: DataFrame, threshold: float, max_links: int) -> DataFrame:
    """The edges of auto_link from each query's max_links + 1 nearest or more. found: query_id, id, similarity."""
    best = top(found.filter((F.col("query_id") != F.col("id")) & (F.col("similarity") > threshold)), ["query_id"], [F.desc("similarity"), F.asc("id")], max_links)
    return _edges(best.select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), F.col("similarity").alias("strength")))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select("source_id", "target_id", F.lit("similar").alias("relationship"), "strength", F.lit("auto").alias("created_by"))


def link_unlinked(mem: DataFrame, edges: DataFrame, as_of: Column, threshold: float = 0.85, max_links: int = 5) -> DataFrame:
    """The same for every active memory with a vector and no outgoing automatic edge."""
    done = edges.filter(F.col("created_by") == "auto").select(F.col("source_id").alias("id"))
    return auto_link(mem.filter(active(as_of)).join(done, "id", "left_anti"), mem, as_of, threshold, max_links)


def keep_known(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Only the new edges whose (source, target, relationship) isn't there."""
    return new.join(edges, ["source_id", "target_id", "relationship"], "left_anti")


def near_duplicates(candidates: DataFrame, mem: DataFrame, as_of: Column, threshold: float = 0.8) -> DataFrame:
    """candidate_id, duplicate: does an active memory of the profile exceed the threshold? Candidates aren't compared with each other."""
    q = candidates.select(F.col("candidate_id").alias("query_id"), "profile", "embedding")
    hit = similar(q, mem.filter(active(as_of)), 1, threshold).select(F.col("query_id").alias("candidate_id"), F.lit(1).alias("duplicate")).distinct()
    return candidates.select("candidate_id").join(hit, "candidate_id", "left").na.fill({"duplicate": 0})


def import_memories(candidates: DataFrame, mem: DataFrame, settings: DataFrame, as_of: Column, threshold: float = 0.8) -> DataFrame:
    """Candidates that aren't near-duplicates as memories, created now, with the profile's time to live; 0 turns the check off."""
    fresh = candidates if threshold <= 0 else candidates.join(near_duplicates(candidates, mem, as_of, threshold).filter("duplicate = 0"), "candidate_id", "left_semi")
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in candidates.columns else F.array().cast("array<string>")
    return fresh.join(settings.select("profile", "ttl_days"), "profile", "left").select(
        F.col("candidate_id").alias("id"), "profile", "content", tags.alias("tags"), as_of.alias("created_at"), F.timestamp_seconds(F.unix_seconds(as_of) + F.col("ttl_days") * 86400).alias("expires_at")
    )


def upsert_memories(mem: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """By id: content, source and tags of what comes in; profile, creation, accesses and confidence of what is there. Rows without a vector are refused."""
    new = incoming.filter(F.col("embedding").isNotNull()).select("id", *[F.col(c).alias(f"new_{c}") for c in ("profile", "content", "source", "tags")], F.lit(1).alias("given"))
    both = mem.join(new, "id", "full_outer")
    pick = lambda c: F.when(F.col("given") == 1, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(
        "id", F.coalesce("profile", "new_profile").alias("profile"), pick("content"), pick("source"), pick("tags"), F.coalesce("created_at", as_of).alias("created_at"),
        F.when(F.col("given") == 1, as_of).otherwise(F.col("updated_at")).alias("updated_at"), F.coalesce("access_count", F.lit(0)).alias("access_count"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )


def ingest_dedup(records: DataFrame, existing: DataFrame) -> DataFrame:
    """records with outcome: ignored (blank), error (no key), duplicate (key stored, or earlier in the run) or stored.
    records: seq, key, content; existing: key."""
    stored = existing.select("key", F.lit(1).alias("known")).distinct()
    blank = F.coalesce(F.trim("content"), F.lit("")) == ""
    usable = ~blank & F.col("key").isNotNull()
    w = Window.partitionBy("key", usable).orderBy("seq")
    rows = records.join(stored, "key", "left").withColumn("n", F.row_number().over(w))
    return rows.withColumn("outcome", F.when(blank, "ignored").when(F.col("key").isNull(), "error").when((F.col("known") == 1) | (F.col("n") > 1), "duplicate").otherwise("stored")).drop("known", "n")


def ingest_counts(outcomes: DataFrame, by: list[str]) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.count("*").alias("scanned"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("stored", "duplicate", "ignored", "error")])


def channel_cursor(existing: DataFrame) -> DataFrame:
    """channel, sec, usec: the greatest well-formed `sec.usec`, compared as numbers. existing: channel, ts."""
    good = existing.filter(F.regexp_like("ts", F.lit(r"^[0-9]+\.[0-9]+$")))
    parts = F.struct(F.split_part("ts", F.lit("."), F.lit(1)).cast("long").alias("sec"), F.split_part("ts", F.lit("."), F.lit(2)).cast("long").alias("usec"))
    return good.groupBy("channel").agg(F.max(parts).alias("m")).select("channel", "m.sec", "m.usec")


def contradiction_edges(new: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Edges `contradicts` of strength 1 where a conflict of 0.75 or more has the opposite polarity. new: id, polarity; conflicts: id, other_id, similarity, other_polarity."""
    return conflicts.filter(F.col("similarity") >= 0.75).join(new.select("id", "polarity"), "id").filter(F.col("polarity") != F.col("other_polarity")).select(
        F.col("id").alias("source_id"), F.col("other_id").alias("target_id"), F.lit("contradicts").alias("relationship"), F.lit(1.0).alias("strength")
    )


def strengthen_edges(result_sets: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id, strength of `related` edges after every result set: a pair met n times grows by 1.01 each
    time, a new one starts at 0.1; at most 1. result_sets: set_id, id."""
    ids = result_sets.select("set_id", "id").distinct()
    pairs = ids.select("set_id", F.col("id").alias("source_id")).join(ids.select("set_id", F.col("id").alias("target_id")), "set_id").filter(F.col("source_id") < F.col("target_id"))
    met = pairs.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    old = edges.filter(F.col("relationship") == "related").select("source_id", "target_id", F.col("strength").alias("old"))
    grown = F.when(F.col("n").isNull(), F.col("old")).when(F.col("old").isNotNull(), F.least(F.lit(1.0), F.col("old") * F.pow(F.lit(1.01), F.col("n")))).otherwise(F.least(F.lit(1.0), 0.1 * F.pow(F.lit(1.01), F.col("n") - 1)))
    return old.join(met, ["source_id", "target_id"], "full_outer").select("source_id", "target_id", grown.alias("strength"))


def refresh_embeddings(mem: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    fresh = new.select("id", F.col("embedding").alias("new_embedding"))
    return mem.join(fresh, "id", "left").withColumn("updated_at", F.when(F.col("new_embedding").isNotNull(), as_of).otherwise(F.col("updated_at"))).withColumn("embedding", F.coalesce("new_embedding", "embedding")).drop("new_embedding")


def embed_corpus(df: DataFrame, cache: DataFrame, fn, dim: int, model: str) -> DataFrame:
    """df with embedding: fn (a Series of texts to a Series of lists) runs once for each distinct text that the cache
    (key, embedding) doesn't have; a vector of another size is an error."""
    import pandas as pd

    key = lambda c: F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(dim)), c), 256)
    keyed = df.withColumn("key", key("content"))
    todo = keyed.select("key", "content").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def run(batches):
        for b in batches:
            vectors = fn(b["content"])
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"embeddings must have {dim} numbers")
            yield pd.DataFrame({"key": b["key"], "embedding": list(vectors)})

    made = todo.mapInPandas(run, "key string, embedding array<float>")
    return keyed.drop("embedding").join(cache.select("key", "embedding").unionByName(made), "key", "left").drop("key")
