"""Ageing and upkeep of the memory table: each job gives a new version of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.base import active, age_days, cut, folded


def hebbian_decay(mem: DataFrame, as_of: Column) -> DataFrame:
    """mem with importance decayed and `eligible`: active, above the floor of 0.05, not accessed for seven days."""
    since = F.coalesce("last_accessed_at", "created_at")
    idle = F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < as_of - F.expr("interval 7 days"))
    eligible = active(as_of) & (F.col("importance") > 0.05) & idle
    rate = F.when(F.col("access_count") >= 10, 0.99).otherwise(0.95)
    decayed = F.greatest(F.lit(0.05), F.col("importance") * F.pow(rate, age_days(since, as_of) / 30))
    return mem.withColumn("eligible", eligible.cast("int")).withColumn("importance", F.when(eligible, decayed).otherwise(F.col("importance")))


def advance_lifecycle(lifecycle: DataFrame, mem: DataFrame, as_of: Column) -> DataFrame:
    """Fresh memories of some surprise or importance become stable after an hour, edited ones after 30 minutes."""
    joined = lifecycle.join(mem.select(F.col("id").alias("memory_id"), "surprise", "importance"), "memory_id", "left")
    ready = (F.col("stage") == "fresh") & (F.col("stage_entered_at") <= as_of - F.expr("interval 1 hour")) & ((F.col("surprise") >= 0.3) | (F.col("importance") >= 0.5))
    closed = (F.col("stage") == "editing") & (F.col("stage_entered_at") <= as_of - F.expr("interval 30 minutes"))
    moved = F.coalesce(ready | closed, F.lit(False))
    return joined.select("memory_id", "profile", F.when(moved, "stable").otherwise(F.col("stage")).alias("stage"), F.when(moved, as_of).otherwise(F.col("stage_entered_at")).alias("stage_entered_at"), moved.cast("int").alias("moved"))


def open_editing(lifecycle: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Retrieved stable memories open for editing; a window that is open already isn't restarted."""
    hit = lifecycle.join(ids.select(F.col("id").alias("memory_id"), F.lit(1).alias("hit")).distinct(), "memory_id", "left")
    opens = F.coalesce((F.col("hit") == 1) & (F.col("stage") == "stable"), F.lit(False))
    return hit.select("memory_id", "profile", F.when(opens, "editing").otherwise(F.col("stage")).alias("stage"), F.when(opens, as_of).otherwise(F.col("stage_entered_at")).alias("stage_entered_at"))


def init_lifecycle(lifecycle: DataFrame, mem: DataFrame) -> DataFrame:
    """A row for each memory: missing ones are fresh from their creation; the profile is the memory's."""
    kept = lifecycle.select("memory_id", "stage", "stage_entered_at")
    return mem.select(F.col("id").alias("memory_id"), "profile", "created_at").join(kept, "memory_id", "left").select(
        "memory_id", "profile", F.coalesce("stage", F.lit("fresh")).alias("stage"), F.coalesce("stage_entered_at", "created_at").alias("stage_entered_at")
    )


def lifecycle_counts(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.groupBy("profile").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in ("fresh", "stable", "editing")])


def compression_target(mem: DataFrame, as_of: Column) -> DataFrame:
    """mem with target_level: 1 after 168 hours, 2 after 720, both times the memory's resistance; never below its level."""
    resistance = F.when(F.col("importance") > 0.7, 2.0).otherwise(1.0) * F.when(F.col("confidence") > 0.8, 1.3).otherwise(1.0) * F.when(F.col("access_count") > 10, 1.5).otherwise(1.0)
    hours = (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(3600e6)  # one division: days times 24 miss a limit that is met exactly
    level = F.when(hours >= 720 * resistance, 2).when(hours >= 168 * resistance, 1).otherwise(0)
    return mem.withColumn("target_level", F.greatest("compression_level", level))


def expire(mem: DataFrame, as_of: Column) -> DataFrame:
    return mem.filter(~F.coalesce(F.col("expires_at") < as_of, F.lit(False)))


def count_expired(mem: DataFrame, as_of: Column) -> DataFrame:
    return mem.groupBy("profile").agg(F.count_if(F.col("expires_at") < as_of).alias("expired"))


def apply_ttl(mem: DataFrame, settings: DataFrame) -> DataFrame:
    """expires_at from the profile's time to live; none where the profile has none."""
    return mem.drop("expires_at").join(settings.select("profile", "ttl_days"), "profile", "left").withColumn("expires_at", F.timestamp_seconds(F.unix_seconds("created_at") + F.col("ttl_days") * 86400)).drop("ttl_days")


def record_access(mem: DataFrame, accesses: DataFrame) -> DataFrame:
    """One more access for each call that lists an id, however often it does; accesses: call_id, id, at."""
    counted = accesses.groupBy("id").agg(F.countDistinct("call_id").alias("calls"), F.max("at").alias("last_at"))
    joined = mem.join(counted, "id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("calls", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "last_at")).drop("calls", "last_at")


#: Signals in a row of one chunk.
CHUNK_BITS = 12


def update_confidence(mem: DataFrame, signals: DataFrame) -> DataFrame:
    """Confidence folded over a memory's signals in order of time: Bayes' rule, then 0.95 of it plus 0.025. signals: id, at, seq, signal.

    Each step is a linear fraction of the confidence, so a run of signals is one matrix, the product of its steps' 2 x 2 matrices. Signals
    are dealt by ranges of (id, at, seq), so that those of one memory may go to many tasks; chunks of some thousands become a matrix
    each, and a memory's matrices are multiplied in order. Products are scaled, so that no run is too long. Null signals say nothing;
    where certain signals contradict the confidence or each other (0 to be divided by 0) it stays.
    """
    rows = signals.filter(F.col("signal").isNotNull()).select("id", "at", "seq", F.col("signal").cast("double").alias("s"))
    rows = cut(rows.repartitionByRange("id", "at", "seq").sortWithinPartitions("id", "at", "seq").select("id", "s", F.monotonically_increasing_id().alias("row")))
    s = lambda x: x["s"]
    step = lambda x: (0.95 * s(x) + 0.025 * (2 * s(x) - 1), 0.025 * (1 - s(x)), 2 * s(x) - 1, 1 - s(x))
    made = lambda x: (x["a"], x["b"], x["c"], x["d"])
    chunks = rows.groupBy("id", F.shiftright("row", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("row", "s"))).alias("found"))
    chunks = chunks.select("id", F.struct("chunk", *[_product(F.col("found"), step)[x].alias(x) for x in "abcd"]).alias("matrix"))
    whole = chunks.groupBy("id").agg(F.array_sort(F.collect_list("matrix")).alias("found")).select("id", _product(F.col("found"), made).alias("m"))
    c = F.col("confidence").cast("double")
    now = F.try_divide(F.col("m.a") * c + F.col("m.b"), F.col("m.c") * c + F.col("m.d"))
    return mem.join(whole, "id", "left").withColumn("confidence", F.when(F.col("m").isNotNull() & now.isNotNull(), now).otherwise(F.col("confidence"))).drop("m")


def _product(items: Column, matrix) -> Column:
    """The product of the items' matrices (a b; c d), the first one applied first, scaled to a greatest number of 1."""
    start = F.struct(*[F.lit(x).alias(n) for n, x in zip("abcd", (1.0, 0.0, 0.0, 1.0))])

    def times(m: Column, x: Column) -> Column:
        a, b, c, d = matrix(x)
        new = (a * m["a"] + b * m["c"], a * m["b"] + b * m["d"], c * m["a"] + d * m["c"], c * m["b"] + d * m["d"])
        most = F.greatest(*map(F.abs, new))
        scale = F.when(most > 0, most).otherwise(1.0)
        return F.struct(*[(v / scale).alias(n) for n, v in zip("abcd", new)])

    return F.aggregate(items, start, times)


#: Ids of a topic that are gathered in one row to be hashed; a topic of more is hashed over sorted rows.
MOST_GATHERED = 10_000


def topic_sources(mem: DataFrame, as_of: Column) -> DataFrame:
    """profile, topic_key, source_count, source_cursor, source_hash over each tag's active memories, ids in text order.

    Topics of up to MOST_GATHERED memories are hashed by a native aggregate; larger ones one id after the other, in little memory."""
    key = ["profile", "topic_key"]
    tagged = cut(mem.filter(active(as_of)).select("profile", F.explode(F.array_distinct("tags")).alias("topic_key"), F.col("id").cast("string").alias("id")).distinct())
    sizes = cut(tagged.groupBy(*key).agg(F.count("*").alias("n")))
    large = sizes.filter(F.col("n") > MOST_GATHERED)
    ids = F.array_sort(F.collect_list("id"))
    out = "profile string, topic_key string, source_count long, source_cursor string, source_hash string"

    def native(rows: DataFrame) -> DataFrame:
        gathered = rows.groupBy(*key).agg(F.count("*").alias("source_count"), F.max("id").alias("source_cursor"), ids.alias("ids"))
        return gathered.select(*key, "source_count", "source_cursor", F.sha2(F.array_join("ids", "\n"), 256).alias("source_hash"))

    if large.isEmpty():
        return native(tagged)
    import hashlib

    def step(state, row):
        n, last, digest = state
        digest.update((b"\n" if n else b"") + row["id"].encode())
        return n + 1, row["id"], digest

    same = F.col("profile").eqNullSafe(F.col("__p")) & (F.col("topic_key") == F.col("__t"))
    names = large.select(F.col("profile").alias("__p"), F.col("topic_key").alias("__t"))
    folds = folded(tagged.join(names, same, "left_semi"), key, ["id"], out, lambda row: (0, None, hashlib.sha256()), step, lambda state: (state[0], state[1], state[2].hexdigest()))
    return native(tagged.join(names, same, "left_anti")).unionByName(folds)


def topics_to_recompute(sources: DataFrame, summaries: DataFrame, max_sources: int = 100, force: bool = False) -> DataFrame:
    """profile, topic_key, action: no_sources, skipped_oversize, skipped or recompute."""
    have = summaries.select("profile", "topic_key", F.col("source_hash").alias("stored"), "status")
    n = F.coalesce("source_count", F.lit(0))
    action = F.when(n == 0, "no_sources")
    if not force:
        action = action.when(n > max_sources, "skipped_oversize")
    action = action.when((F.col("status") == "fresh") & (F.col("stored") == F.col("source_hash")), "skipped").otherwise("recompute")
    return sources.join(have, ["profile", "topic_key"], "full_outer").select("profile", "topic_key", action.alias("action"))


def upsert_summaries(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """Insert, or replace on (profile, topic_key) with the next version; a replaced summary is fresh without a reason."""
    incoming = new.select("profile", "topic_key", F.col("content").alias("new_content"), F.col("source_hash").alias("new_hash"))
    given = F.col("new_hash").isNotNull()
    pick = lambda n, old: F.when(given, F.col(n)).otherwise(F.col(old)).alias(old)
    return summaries.join(incoming, ["profile", "topic_key"], "full_outer").select(
        "profile", "topic_key", pick("new_content", "content"), pick("new_hash", "source_hash"),
        F.when(given, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"),
        F.when(given, "fresh").otherwise(F.col("status")).alias("status"), F.when(~given, F.col("stale_reason")).alias("stale_reason"),
    )


def affected_summaries(ids: DataFrame, sources: DataFrame) -> DataFrame:
    """Summaries that cite any of the ids. sources: profile, topic_key, memory_id."""
    return sources.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("profile", "topic_key").distinct()


def sweep_stale(summaries: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    idle = (F.col("status") == "fresh") & (F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days)))
    return summaries.withColumn("stale_reason", F.when(idle, F.lit(f"idle for {days} days")).otherwise(F.col("stale_reason"))).withColumn("status", F.when(idle, "stale").otherwise(F.col("status")))


def list_stale(summaries: DataFrame) -> DataFrame:
    return summaries.filter(F.col("status") == "stale").withColumn("position", F.row_number().over(Window.partitionBy("profile").orderBy("updated_at", "topic_key")))


def hybrid_decay_score(mem: DataFrame, settings: DataFrame, as_of: Column) -> DataFrame:
    """Exponential for three days, then a power law; rates by profile."""
    age = age_days(F.col("created_at"), as_of)
    joined = mem.join(settings.select("profile", "decay_lambda", "decay_beta"), "profile", "left")
    lam, beta = F.coalesce("decay_lambda", F.lit(0.1)), F.coalesce("decay_beta", F.lit(0.4))
    return joined.withColumn("decay", F.when(age < 3, F.exp(-lam * age)).otherwise(F.pow(age / 3, -beta))).drop("decay_lambda", "decay_beta")


def compress(mem: DataFrame, as_of: Column) -> DataFrame:
    """id, content, original_content, compression_level of the memories whose target level is above theirs: level 1 is the
    gist, level 2 the tag line, cut from what the memory holds by now; the first original is kept. mem: also tags,
    compression_level, original_content and what compression_target() reads."""
    from cairn.functions.text import compress_gist, tags_line

    due = mem.join(compression_target(mem, as_of).select("id", "target_level"), "id").filter(F.col("target_level") > F.col("compression_level"))
    short = F.when(F.col("target_level") == 1, compress_gist()("content")).otherwise(tags_line(F.col("content"), F.col("tags")))
    return due.select("id", short.alias("content"), F.coalesce("original_content", "content").alias("original_content"), F.col("target_level").alias("compression_level"))
