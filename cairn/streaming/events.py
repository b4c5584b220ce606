"""Event-at-a-time work as Structured Streaming jobs, each with the batch form it must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T

KEY = ("session_id", "tool", "target")


def session_dedup(events: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Events whose gap to the one before of the same session, tool and target is at least gap_seconds; a dropped event
    restarts the clock. Events without a target are all kept."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    return events.withColumn("gap", gap).filter((F.coalesce(F.length("target"), F.lit(0)) == 0) | F.col("gap").isNull() | (F.col("gap") >= gap_seconds * 1_000_000)).drop("gap")


def session_dedup_stream(events: DataFrame, gap_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """The same as a stream: a session's first event, once the watermark has passed its end. The window is a microsecond
    short of the gap, as an event exactly gap_seconds later starts a new one. Later events than `delay` are dropped."""
    window = F.session_window("ts", f"{gap_seconds - 1}.999999 seconds")
    kept = events.filter(F.length("target") > 0).withWatermark("ts", delay).groupBy(window, *KEY).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return kept.select("first.event_id", "first.ts", *KEY)


# Tools whose events are never kept, tags that always are, and what marks a prompt worth keeping.
SKIPPED_TOOLS = ("Read", "Glob", "Grep", "LS")
HIGH_SIGNAL = ("type:code-change", "type:context", "type:correction", "type:decision", "type:deploy", "type:error", "type:fact", "type:git-signal", "type:preference")
QUESTION_STARTS = ("what ", "how ", "can you", "why ", "where ", "when ", "show me")
MARKERS = (
    "prefer", "favorite", "favourite", "always use", "rather", "like better", "decided", "let's go with", "lets go with", "chose", "going with", "switching to", "actually", "correction", "wrong",
    "instead", "i'm based in", "i am based in", "i work at", "my company", "my team",
)


def capture_gate(events: DataFrame, skipped: tuple[str, ...] = SKIPPED_TOOLS, floor: float = 0.35) -> DataFrame:
    """Events worth a memory, masked: of tools that aren't skipped, with a high-signal tag or enough importance. No state,
    so batch and stream are the same. events: tool, content, tags."""
    masked = events.filter(~F.col("tool").isin(*skipped)).withColumn("content", T.mask_secrets(F.col("content")))
    signal = F.arrays_overlap("tags", F.array(*map(F.lit, HIGH_SIGNAL)))
    return masked.filter(signal | (T.compute_importance(F.col("content"), F.col("tags")) >= floor))


def capture_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts of 30 characters or more that don't start as a question and have a marker, a day name or a date."""
    low = F.lower(F.trim("content"))
    starts = "^" + T.any_of(QUESTION_STARTS)
    return prompts.filter((F.length(F.trim("content")) >= 30) & ~T.like(low, starts) & (T.has_word(F.col("content"), MARKERS) | T.like(F.col("content"), T.ISO_DATE) | T.like(F.col("content"), T.NATURAL_DATE)))


def ingest_stream(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, across restarts; rows later than `delay` are dropped. records: key, ts."""
    return records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


#: Folders of a store by a hash of the key, and 64-bit words of each folder's Bloom filter.
BUCKETS, BLOOM_WORDS = 64, 65_536


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their key's bucket, and the word and three bits of it that the bucket's Bloom filter has."""
    h = F.xxhash64("key")
    bit = lambda i: f"shiftleft(1L, cast(pmod(shiftright(xxhash64(key, 7), {6 * i}), 64) as int))"
    return rows.withColumn("bucket", F.pmod(h, F.lit(BUCKETS)).cast("int")).withColumn("word", F.pmod(F.shiftright(h, 16), F.lit(BLOOM_WORDS)).cast("int")).withColumn("bits", F.expr(f"{bit(0)} | {bit(1)} | {bit(2)}"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table partitioned by bucket; none where there isn't one yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def store_new(batch: DataFrame, store_path: str) -> None:
    """For foreachBatch: appends the keys that the store doesn't have; so a batch that is run again adds nothing. Null keys are one key.

    The store is a Parquet folder dealt to BUCKETS folders by a hash of the key. Beside it (`-bloom`) lies a Bloom filter for each, as
    rows of words that are joined by bit_or: a batch looks its keys up there, and reads the store's keys only in the folders of those
    that may be there. The filter is written before the keys, so that after a break it never lacks one.
    """
    from cairn.operators.base import cut

    spark, bloom_path = batch.sparkSession, store_path.rstrip("/") + "-bloom"
    once = cut(_placed(batch.dropDuplicates(["key"])))
    folders = lambda df: [r["bucket"] for r in df.select("bucket").distinct().collect()]  # noqa: E731  at most BUCKETS numbers
    bloom = _stored(spark, bloom_path, "word int, bits long, bucket int")
    new = once
    if bloom is not None:
        words = bloom.filter(F.col("bucket").isin(folders(once))).withColumnRenamed("bits", "have")
        maybe = once.join(words, ["bucket", "word"]).groupBy("key", "bucket", "bits").agg(F.bit_or("have").alias("have")).filter((F.col("have").bitwiseAND(F.col("bits"))) == F.col("bits"))
        maybe = cut(maybe.select("key", "bucket"))
        store = _stored(spark, store_path, f"key {dict(batch.dtypes)['key']}, bucket int")
        if store is not None:
            there = store.filter(F.col("bucket").isin(folders(maybe))).select("key")
            new = once.join(maybe.join(there, maybe["key"].eqNullSafe(there["key"]), "left_semi").select(F.col("key").alias("__key")), F.col("key").eqNullSafe(F.col("__key")), "left_anti")
    new = cut(new)
    if new.isEmpty():
        return
    new.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits")).select("word", "bits", "bucket").write.mode("append").partitionBy("bucket").parquet(bloom_path)
    new.select(*batch.columns, "bucket").write.mode("append").partitionBy("bucket").parquet(store_path)


def audit_windows(audit: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """profile, operation, start, stop, n in tumbling or sliding windows; in append mode a window comes out after the watermark."""
    w = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    return audit.withWatermark("event_time", delay).groupBy("profile", "operation", w).agg(F.count("*").alias("n")).select("profile", "operation", F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def recompute_debounce(changes: DataFrame, seconds: int = 60) -> DataFrame:
    """profile, tag, fire_at, n: changes of a profile's tag coalesce until none comes for `seconds`; it fires that long after the last. changes: profile, tag, ts."""
    w = Window.partitionBy("profile", "tag").orderBy("ts")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    grouped = changes.withColumn("__gap", gap).withColumn("burst", F.sum((F.coalesce("__gap", F.lit(2**62)) > seconds * 1_000_000).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("profile", "tag", "burst").agg(F.timestamp_micros(F.max(F.unix_micros("ts")) + seconds * 1_000_000).alias("fire_at"), F.count("*").alias("n")).drop("burst")


def recompute_debounce_stream(changes: DataFrame, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """The same as a stream, by session windows whose end is when it fires."""
    w = F.session_window("ts", f"{seconds} seconds")
    return changes.withWatermark("ts", delay).groupBy("profile", "tag", w).agg(F.count("*").alias("n")).select("profile", "tag", F.col("session_window.end").alias("fire_at"), "n")


def _successors(searches: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Distinct searches as memory_id, t (microseconds) that surely open a window, as no search comes in the `length` before; and for each
    search the one that opens the next window if it opens one, as memory_id, t, next, where that isn't sure by itself.

    Time is cut into slots of `length`, so that a slot's last search lies within `length` of its first: what follows a search is looked up
    in the next slot, or is the first of a later one. Windows are over one memory's slot, and over the slots of a memory, of which
    there are no more than its time span has.
    """
    at = searches.filter(F.col("ts").isNotNull() & F.col("memory_id").isNotNull()).select("memory_id", F.unix_micros("ts").alias("t")).distinct()
    at = at.withColumn("slot", F.expr(f"(t - pmod(t, {length}L)) div {length}L"))
    by = Window.partitionBy("memory_id").orderBy("slot")
    slots = at.groupBy("memory_id", "slot").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    slots = slots.withColumn("sure", F.coalesce(F.col("first") - F.lag("last").over(by) >= length, F.lit(True)))
    ahead = lambda n: F.lead(F.struct("slot", "first", "sure"), n).over(by)
    slots = slots.withColumn("one", ahead(1)).withColumn("two", ahead(2))
    # Each search stands in its own slot as one to be found, and in the next slot, `length` later, as one that looks for its successor.
    seen = at.select("memory_id", "slot", F.col("t").alias("place"), F.col("t").alias("found"), F.lit(None).cast("long").alias("t"))
    looking = at.select("memory_id", F.col("slot") + 1, F.col("t") + length, F.lit(None).cast("long"), "t")
    back = Window.partitionBy("memory_id", "slot").orderBy(F.desc("place"), F.col("found").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = seen.union(looking).withColumn("found", F.min("found").over(back)).filter(F.col("t").isNotNull()).select("memory_id", (F.col("slot") - 1).alias("slot"), "t", "found")
    near = F.col("one.slot") == F.col("slot") + 1
    to = F.when(~near, F.col("one")).when(F.col("found").isNull(), F.col("two")).otherwise(F.struct("one.slot", F.col("found").alias("first"), (F.col("one.sure") & (F.col("found") == F.col("one.first"))).alias("sure")))
    nexts = found.join(slots.select("memory_id", "slot", "one", "two"), ["memory_id", "slot"]).select("memory_id", "t", to.alias("to"))
    return slots.filter("sure").select("memory_id", F.col("first").alias("t")), nexts.filter(~F.col("to.sure")).select("memory_id", "t", F.col("to.first").alias("next"))


def editing_windows(searches: DataFrame, minutes: int = 30) -> DataFrame:
    """memory_id, opened_at, closes_at: a search opens a window; searches within it don't restart it. searches: memory_id, ts; rows with a
    null in either are left out, equal ones count once.

    Batch form, by pointer doubling: each search knows the one that would open the next window, and in each round the known openers reach
    those 1, 2, 4, ... windows on. Rounds end when none is reached, after the logarithm of the longest series of windows without a
    pause between them. Joins are on memory and time, so a memory of any size is spread over tasks.
    """
    from cairn.operators.base import cut

    length = minutes * 60_000_000
    openers, jumps = _successors(searches, length)
    openers, jumps, key = cut(openers), cut(jumps), ["memory_id", "t"]
    while True:
        reached = cut(openers.join(jumps, key).select("memory_id", F.col("next").alias("t")))
        if reached.isEmpty():
            break
        openers = openers.unionByName(reached)
        jumps = cut(jumps.join(jumps.select("memory_id", F.col("t").alias("next"), F.col("next").alias("then")), ["memory_id", "next"]).select("memory_id", "t", F.col("then").alias("next")))
    return openers.select("memory_id", F.timestamp_micros("t").alias("opened_at"), F.timestamp_micros(F.col("t") + length).alias("closes_at"))


def editing_window_stream(searches: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """memory_id, opened_at, closes_at, closed as a stream: a row with closed = false when a window opens, and one with true when the watermark
    has passed its end. State for each memory is the last window's start and the windows that haven't closed; it goes with
    the last close. A search before the open window that comes out of order opens none; one later than `delay` is dropped.
    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    length = minutes * 60_000_000

    def windows(key, times, closed):
        return pd.DataFrame({"memory_id": [key[0]] * len(times), "opened_at": pd.to_datetime(times, unit="us"), "closes_at": pd.to_datetime([t + length for t in times], unit="us"), "closed": [closed] * len(times)})

    class Windows(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.start = handle.getValueState("start", "t long")
            self.open = handle.getMapState("open", "at long", "t long")

        def handleInputRows(self, key, rows, timerValues):
            start, opened = self.start.get()[0] if self.start.exists() else None, []
            for t in sorted(int(x.value // 1000) for b in rows for x in b["ts"].astype("datetime64[ns]")):
                if start is None or t >= start + length:
                    start = t
                    opened.append(t)
            for t in opened:
                due = (t + length + 999) // 1000
                self.open.updateValue((due,), (t,))
                self.handle.registerTimer(due)
            if opened:
                self.start.update((start,))
                yield windows(key, opened, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            due = (expiredTimerInfo.getExpiryTimeInMs(),)
            t = self.open.getValue(due)[0]
            self.open.removeKey(due)
            if self.start.exists() and self.start.get()[0] == t:
                self.start.clear()
            yield windows(key, [t], True)

    kind = dict(searches.dtypes)["memory_id"]
    out = f"memory_id {kind}, opened_at timestamp, closes_at timestamp, closed boolean"
    return searches.withWatermark("ts", delay).groupBy("memory_id").transformWithStateInPandas(Windows(), out, "append", "eventTime")
