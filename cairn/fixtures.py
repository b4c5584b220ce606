"""The given tables as the memory data model: memories, edges, queries and the other inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-04-15 00:00:00"
START = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, embedding: bool = True) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(START) + (d * 7919) % 129600 * 60)
    tags = F.when(d % 8 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("topic:"), (d % 9).cast("string")), F.concat(F.lit("band:"), F.floor(F.col("n_chars") / 1000).cast("string")))
    )
    out = docs.select(
        d.alias("id"), F.col("lang").alias("profile"), "source", F.col("text").alias("content"), created.alias("created_at"), created.alias("updated_at"),
        (d % 13).cast("int").alias("access_count"),
        F.when(d % 5 != 0, F.timestamp_seconds(F.unix_seconds(created) + d % 20 * 86400)).alias("last_accessed_at"),
        (F.lit(0.3) + d % 7 * F.lit(0.1)).alias("confidence"), (F.lit(0.05) + d % 10 * F.lit(0.1)).alias("importance"), (d % 11 / F.lit(10.0)).alias("surprise"),
        F.when(d % 17 == 0, F.timestamp_seconds(F.unix_seconds(created) + 864000)).alias("expires_at"),
        tags.alias("tags"),
        F.when(d % 6 == 0, F.format_string('{"dates":["2024-02-%02d"]}', 1 + d % 28)).otherwise("{}").alias("metadata"),
        F.lit(0).alias("compression_level"),
    )
    if not embedding:
        return out
    vectors = read(spark, sf_dir, "embeddings")
    e = vectors.count()
    return out.withColumn("vec", F.col("id") % e).join(vectors.select(F.col("vec_id").alias("vec"), "embedding"), "vec", "left").drop("vec")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    n = docs.count()
    kinds = F.array(*map(F.lit, ("similar", "related", "contradicts", "supports", "follows", "derived_from")))
    edges = docs.select("source_id", F.explode(F.array(*[F.lit(j).cast("long") for j in (1, 2, 3)])).alias("j"))
    edges = edges.withColumn("target_id", (F.col("source_id") * (2 * F.col("j") + 1) + F.col("j")) % n)
    s, j = F.col("source_id"), F.col("j")
    return edges.filter((s != F.col("target_id")) & (s % 10 != 9) & (F.col("target_id") % 10 != 9)).select(
        "source_id", "target_id", F.element_at(kinds, ((s + j) % 6 + 1).cast("int")).alias("relationship"), (F.lit(0.3) + s * j % 8 * F.lit(0.1)).alias("strength"),
        F.when((j == 1) & (s % 3 != 0), "auto").otherwise("user").alias("created_by"), F.timestamp_seconds(F.lit(START) + (s * 7919) % 129600 * 60).alias("created_at"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir, False)
    i = F.col("id")
    stage = F.element_at(F.array(*map(F.lit, ("fresh", "stable", "editing"))), (i % 3 + 1).cast("int"))
    return m.select(i.alias("memory_id"), "profile", stage.alias("stage"), F.when(i % 3 == 1, F.col("created_at")).otherwise(F.timestamp_seconds(F.unix_seconds(as_of()) - i * 53 % 240 * 60)).alias("stage_entered_at"))


def profile_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("en", 30, 0.1, 0.4), ("fr", 60, 0.1, 0.4), ("de", 90, 0.1, 0.4), ("es", None, 0.1, 0.4)], "profile string, ttl_days int, decay_lambda double, decay_beta double")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    e = vectors.count()
    q = read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("en").alias("profile"),
        F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " "), 1, 3), " ").alias("text"),
        F.array(F.concat(F.lit("topic:"), (F.col("item_id") % 9).cast("string"))).alias("tags"), ((F.col("item_id") * 13 + 5) % e).alias("vec"),
    )
    return q.join(vectors.select(F.col("vec_id").alias("vec"), "embedding", "label"), "vec").drop("vec")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, id: the active memories of the query's profile whose vector has the query vector's label."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label"))
    e = vectors.count()
    m = memories(spark, sf_dir, False).filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of())).select("id", "profile", (F.col("id") % e).alias("vec_id")).join(vectors, "vec_id")
    return queries(spark, sf_dir).select("query_id", "profile", "label").join(m.select("id", "profile", "label"), ["profile", "label"]).select("query_id", "id")


def order_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("profile"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def memory_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id")).distinct()
    return lines.join(order_memories(spark, sf_dir).select(F.col("id").alias("memory_id"), "profile"), "memory_id")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, canonical_name, entity_type, mention_count, temporal_span."""
    part = read(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ("entity", "file", "event", "person", "quantity")))
    stats = memory_entities(spark, sf_dir).join(order_memories(spark, sf_dir).select(F.col("id").alias("memory_id"), "created_at"), "memory_id").groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.log1p(F.countDistinct(F.to_date("created_at"))).alias("temporal_span"))
    named = part.select(F.col("p_partkey").alias("entity_id"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("canonical_name"), F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("entity_type"))
    return named.join(stats, "entity_id", "left").na.fill({"mention_count": 0, "temporal_span": 0.0})


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object (node names), profile: facts of the star schema."""
    t = lambda n: read(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    fact = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit("p").alias("profile"))
    return (
        fact(t("orders"), name("order", "o_orderkey"), "OWNED_BY", name("customer", "o_custkey"))
        .unionByName(fact(t("customer"), name("customer", "c_custkey"), "PART_OF", name("nation", "c_nationkey")))
        .unionByName(fact(t("supplier"), name("supplier", "s_suppkey"), "PART_OF", name("nation", "s_nationkey")))
        .unionByName(fact(t("nation"), name("nation", "n_nationkey"), "PART_OF", name("region", "n_regionkey")))
        .unionByName(fact(t("lineitem").select("l_partkey", "l_suppkey").distinct(), name("part", "l_partkey"), "DEPENDS_ON", name("supplier", "l_suppkey")))
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").withColumn("sender", F.when(F.col("role") == "user", "human").otherwise(F.col("role")))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("target"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("profile"), F.col("event_type").alias("operation"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens_used"), F.element_at(F.array(F.lit("embed-small"), F.lit("embed-large")), (F.col("event_id") % 2 + 1).cast("int")).alias("embedding_model"),
    ).withColumn("cost_usd", (F.col("tokens_used") * F.lit(0.00002).cast("decimal(10,6)")).cast("decimal(10,6)"))
