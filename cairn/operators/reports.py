"""Counts, health and usage of the memory corpus, and measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.base import active, age_days, both_ways, top


def profile_counts(mem: DataFrame, as_of: Column) -> DataFrame:
    return mem.filter(active(as_of)).groupBy("profile").agg(F.count("*").alias("n"))


def top_tags(mem: DataFrame, as_of: Column, k: int = 20) -> DataFrame:
    counts = mem.filter(active(as_of)).select("profile", F.explode("tags").alias("tag")).groupBy("profile", "tag").agg(F.count("*").alias("n"))
    return top(counts, ["profile"], [F.desc("n"), F.asc("tag")], k)


def source_counts(mem: DataFrame, as_of: Column) -> DataFrame:
    return mem.filter(active(as_of)).groupBy("profile", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def memory_stats(mem: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """One row a profile: total, untagged, distinct_tags, orphans (no edge to another active memory of the profile), decay_eligible, at_floor."""
    live = mem.filter(active(as_of))
    idle = F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < as_of - F.expr("interval 7 days"))
    ends = live.select("id", "profile")
    linked = (
        both_ways(edges.filter(F.col("source_id") != F.col("target_id")).select("source_id", "target_id"))
        .join(ends, "id").join(ends.select(F.col("id").alias("other"), F.col("profile").alias("other_profile")), "other")
        .filter(F.col("profile") == F.col("other_profile")).select("id", F.lit(1).alias("linked")).distinct()
    )
    rows = live.select("id", "profile", F.size("tags").alias("n_tags"), (idle & (F.col("importance") > 0.05)).alias("decays"), (F.col("importance") <= 0.05).alias("floor")).join(linked, "id", "left")
    base = rows.groupBy("profile").agg(
        F.count("*").alias("total"), F.count_if(F.col("n_tags") <= 0).alias("untagged"), F.count_if(F.col("linked").isNull()).alias("orphans"),
        F.count_if("decays").alias("decay_eligible"), F.count_if("floor").alias("at_floor"),
    )
    tags = live.select("profile", F.explode("tags").alias("tag")).groupBy("profile").agg(F.countDistinct("tag").alias("distinct_tags"))
    return base.join(tags, "profile", "left").na.fill({"distinct_tags": 0})


def orphans(mem: DataFrame, edges: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    """Active memories older than five minutes without any edge: the newest n of each profile, with the total."""
    old = mem.filter(active(as_of) & (F.col("created_at") < as_of - F.expr("interval 5 minutes"))).select("id", "profile", "created_at")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    alone = old.join(ends, "id", "left_anti").withColumn("total", F.count("*").over(Window.partitionBy("profile")))
    return top(alone, ["profile"], [F.desc("created_at"), F.asc("id")], n)


def stale_lifecycle(lifecycle: DataFrame, mem: DataFrame, as_of: Column, n: int = 10, days: int = 90) -> DataFrame:
    """Active memories that have been stable for more than `days`: the oldest n of each profile, with the total."""
    live = mem.filter(active(as_of)).select(F.col("id").alias("memory_id"))
    old = lifecycle.filter((F.col("stage") == "stable") & (F.col("stage_entered_at") < as_of - F.make_dt_interval(F.lit(days)))).join(live, "memory_id", "left_semi")
    return top(old.withColumn("total", F.count("*").over(Window.partitionBy("profile"))), ["profile"], [F.asc("stage_entered_at"), F.asc("memory_id")], n)


def summary_drift(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """Fresh summaries whose stored hash isn't that of their sources now; without sources, of the empty text."""
    now = sources.select("profile", "topic_key", F.col("source_hash").alias("now_hash"))
    joined = summaries.filter(F.col("status") == "fresh").join(now, ["profile", "topic_key"], "left")
    return joined.filter(F.col("source_hash") != F.coalesce("now_hash", F.sha2(F.lit(""), 256))).select("profile", "topic_key")


def lint_report(checks: dict[str, DataFrame]) -> DataFrame:
    """profile, a count for each named check's rows, total, healthy. One pass over the checks' union."""
    union = None
    for name, df in checks.items():
        part = df.select("profile", F.lit(name).alias("check"))
        union = part if union is None else union.unionByName(part)
    counts = union.groupBy("profile").agg(*[F.count_if(F.col("check") == n).alias(n) for n in checks])
    total = sum((F.col(n) for n in checks), F.lit(0))
    return counts.withColumn("total", total).withColumn("healthy", (F.col("total") == 0).cast("int"))


def gap_signals(results: DataFrame, mem: DataFrame, outside: DataFrame, as_of: Column, old_days: int = 90, low: float = 0.5) -> DataFrame:
    """For each query: newest age in whole days, how many older than old_days, how many of low confidence, the largest
    confidence, contradictions outside, and whether that matters. results: query_id, id; outside: query_id, in_id, other_id."""
    age = F.greatest(F.floor(age_days(F.col("created_at"), as_of)), F.lit(0)).cast("long")
    facts = results.select("query_id", "id").join(mem.select("id", "created_at", "confidence"), "id").groupBy("query_id").agg(
        F.min(age).alias("newest_age"), F.count_if(age > old_days).alias("n_old"), F.count_if(F.col("confidence") < low).alias("n_low"), F.max("confidence").alias("max_confidence")
    )
    against = outside.groupBy("query_id").agg(F.count("*").alias("n_contradictions"))
    out = facts.join(against, "query_id", "left").na.fill({"n_contradictions": 0})
    return out.withColumn("material", ((F.col("n_contradictions") > 0) | (F.col("n_low") > 0) | (F.col("newest_age") > old_days)).cast("int"))


def gap_note(gaps: DataFrame) -> DataFrame:
    """gaps with note: one sentence of the facts that matter; empty where none does."""
    parts = F.concat_ws(
        "; ",
        F.when(F.col("newest_age") > 90, F.concat(F.lit("newest result is "), F.col("newest_age").cast("string"), F.lit(" days old"))),
        F.when(F.col("n_low") > 0, F.concat(F.col("n_low").cast("string"), F.lit(" of low confidence"))),
        F.when(F.col("n_contradictions") > 0, F.concat(F.col("n_contradictions").cast("string"), F.lit(" contradicted by memories not shown"))),
    )
    return gaps.withColumn("note", F.when(F.col("material") == 1, F.concat(F.lit("Gaps: "), parts, F.lit("."))).otherwise(""))


def health_scores(mem: DataFrame, edges: DataFrame, summaries: DataFrame, as_of: Column) -> DataFrame:
    """profile, freshness, size, coverage, shape, mean (0 to 10) and zone."""
    hours = F.lit(24) * age_days(F.max("created_at"), as_of)
    linked = both_ways(edges.filter(F.col("source_id") != F.col("target_id")).select("source_id", "target_id")).select("id", F.lit(1).alias("linked")).distinct()
    base = mem.select("id", "profile", "created_at", F.size("tags").alias("n_tags")).join(linked, "id", "left").groupBy("profile").agg(
        F.count("*").alias("n"), hours.alias("hours"), F.avg("n_tags").alias("avg_tags"), (100 * F.count_if(F.col("linked").isNull()) / F.count("*")).alias("orphan_pct")
    )
    wiki = summaries.groupBy("profile").agg(F.count("*").alias("topics"), F.count_if(F.col("status") == "fresh").alias("fresh"), F.count_if(F.col("status") == "stale").alias("stale"))
    h, n = F.col("hours"), F.col("n")
    freshness = F.when(h <= 24, 10.0).when(h <= 72, 7.99 - (h - 24) * 2.99 / 48).otherwise(F.greatest(F.lit(0.0), 4.99 - F.least(h - 72, F.lit(720)) * 4.99 / 720))
    size = F.when(n >= 100, 10.0).when(n >= 10, 5 + (n - 10) / 89 * 2.99).otherwise(n / 9 * 4.99)
    share = F.col("fresh") / F.col("topics") * 10
    coverage = F.when(F.coalesce("topics", F.lit(0)) == 0, 10.0).when(F.col("stale") > 0, F.least(share, F.lit(7.9))).otherwise(share)
    shape = F.least(F.col("avg_tags") / 2, F.lit(1.0)) * 5 + F.greatest(F.lit(0.0), 1 - F.col("orphan_pct") / 50) * 5
    out = base.join(wiki, "profile", "left").select("profile", freshness.alias("freshness"), size.alias("size"), coverage.alias("coverage"), shape.alias("shape"))
    mean = (F.col("freshness") + F.col("size") + F.col("coverage") + F.col("shape")) / 4
    return out.withColumn("mean", mean).withColumn("zone", F.when(F.col("mean") >= 8, "GREEN").when(F.col("mean") >= 5, "AMBER").otherwise("RED"))


def audit_query(audit: DataFrame, n: int = 50, operation: str | None = None) -> DataFrame:
    rows = audit if operation is None else audit.filter(F.col("operation") == operation)
    return top(rows, ["profile"], [F.desc("event_time"), F.desc("event_id")], n)


def audit_usage(audit: DataFrame) -> DataFrame:
    """Events, tokens and cost by profile, operation, day and model, with totals at each level."""
    rows = audit.withColumn("day", F.date_format("event_time", "yyyy-MM-dd"))
    return rows.rollup("profile", "operation", "day", "embedding_model").agg(
        F.count("*").alias("events"), F.sum("tokens_used").alias("tokens"), F.sum("cost_usd").alias("cost"), F.grouping_id().cast("long").alias("level")
    )


def importance_by_day(mem: DataFrame, days: int = 30) -> DataFrame:
    """Average importance and count for each created day; the last `days` days there are, in each profile."""
    daily = mem.groupBy("profile", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("importance"), 3).alias("avg_importance"), F.count("*").alias("n"))
    return top(daily, ["profile"], [F.desc("day")], days)


def retrieval_metrics(results: DataFrame, gold: DataFrame, questions: DataFrame, cuts: tuple[int, ...] = (5, 10, 20, 30, 50)) -> DataFrame:
    """recall@k, reciprocal rank of the first hit and binary NDCG@10 of each question. results: query_id, id, rank;
    questions: query_id, category. Without gold a question of abstention or summary is perfect, another one 0."""
    wanted = gold.select("query_id", "id").distinct()
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = results.join(wanted, ["query_id", "id"], "left_semi").groupBy("query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in cuts], F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    out = questions.select("query_id", "category").join(size, "query_id", "left").join(hits, "query_id", "left")
    empty, free = F.col("n_gold").isNull(), F.col("category").isin("abstention", "summarization").cast("double")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.coalesce("n_gold", F.lit(1)), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    score = lambda x: F.when(empty, free).otherwise(F.coalesce(x, F.lit(0.0)))
    return out.select("query_id", "category", *[score(F.col(f"hit{k}") / F.col("n_gold")).alias(f"recall{k}") for k in cuts], score(1 / F.col("first")).alias("mrr"), score(F.col("dcg") / ideal).alias("ndcg10"))


def session_retrieval_metrics(results: DataFrame, sessions: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """The same over sessions: results count once, at the rank among sessions of their first. sessions: id, session."""
    first = results.join(sessions, "id").groupBy("query_id", "session").agg(F.min("rank").alias("best"))
    ranked = first.select("query_id", F.col("session").alias("id"), F.row_number().over(Window.partitionBy("query_id").orderBy("best", "session")).alias("rank"))
    wanted = gold.join(sessions, "id").select("query_id", F.col("session").alias("id"))
    return retrieval_metrics(ranked, wanted, questions, (5, 10, 50))


def answer_hit_metrics(results: DataFrame, mem: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, hit, reciprocal_rank: a result hits if it holds the answer, its evidence's first five words, or, for a
    short answer, each of its words of three letters or more. questions: query_id, answer, evidence."""
    text, answer = F.lower("content"), F.lower("answer")
    lead = F.lower(F.array_join(F.slice(F.split("evidence", r"\s+"), 1, 5), " "))
    words = F.filter(F.split(answer, r"\s+"), lambda w: F.length(w) > 2)
    hit = text.contains(answer) | ((F.length(lead) > 0) & text.contains(lead)) | ((F.length("answer") < 30) & (F.size(words) > 0) & F.forall(words, lambda w: F.contains(text, w)))
    found = results.join(mem.select("id", "content"), "id").join(questions, "query_id").filter(hit).groupBy("query_id").agg(F.min("rank").alias("first"))
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def metrics_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Means by category, by difficulty and over all."""
    means = [F.round(F.avg(c), 6).alias(c) for c in columns]
    return metrics.groupingSets([["category"], ["difficulty"], []], "category", "difficulty").agg(F.count("*").alias("n"), *means)
