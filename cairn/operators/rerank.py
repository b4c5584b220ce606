"""Re-ranking of result sets by query: windows, and vectorised groups where the choice is greedy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.base import top


def _order() -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("id"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(_order()))


def temporal_rerank(results: DataFrame, anchors: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Relevance by the days between a result's date and the query's anchor: x1.5 within half a day, else x(1 + 0.5
    exp(-d^2 / 2 sigma^2)), x0.1 on the wrong side by more than half a day; undated rows stay. results: query_id, id,
    relevance, at (timestamp); anchors: query_id, start, stop, direction."""
    middle = (F.unix_micros("start") + F.unix_micros("stop")) / 2
    joined = results.join(anchors, "query_id", "left")
    d = (F.unix_micros("at") - middle) / F.lit(86400e6)
    wrong = ((F.col("direction") == "future") & (d < -0.5)) | ((F.col("direction") == "past") & (d > 0.5))
    factor = F.when(d.isNull(), 1.0).when(wrong, 0.1).when(F.abs(d) < 0.5, 1.5).otherwise(1 + 0.5 * F.exp(-d * d / (2 * sigma * sigma)))
    return _ranked(joined.select("query_id", "id", F.round(F.col("relevance") * factor, 9).alias("relevance")))


def temporal_diversity_rerank(results: DataFrame, limit: int = 10) -> DataFrame:
    """Where the first 20 are mostly dated and crowd into 5 % of the whole span, results of a date that came before count
    0.8 each time and undated ones 0.95; the first `limit` of positive score are taken, then ordered by their new
    relevance. Elsewhere, the first `limit` as they are. results: query_id, id, relevance, day (date)."""
    everything = Window.partitionBy("query_id")
    n = F.row_number().over(_order())
    rows = results.withColumn("n", n)
    head = F.when(F.col("n") <= 20, F.datediff("day", F.lit("1970-01-01")))
    whole = F.datediff("day", F.lit("1970-01-01"))
    rows = rows.withColumn("share", F.count(head).over(everything) / F.least(F.count("*").over(everything), F.lit(20))).withColumn("dated", F.count("day").over(everything))
    rows = rows.withColumn("tight", (F.max(head).over(everything) - F.min(head).over(everything)) <= 0.05 * (F.max(whole).over(everything) - F.min(whole).over(everything))).withColumn("total", F.count("*").over(everything))
    gate = (F.col("share") >= 0.8) & F.col("tight") & (F.col("dated") >= 2) & (F.col("total") > limit)
    before = F.row_number().over(Window.partitionBy("query_id", "day", F.col("relevance") > 0).orderBy("n")) - 1
    new = F.when(F.col("day").isNull(), F.col("relevance") * 0.95).otherwise(F.col("relevance") * F.pow(F.lit(0.8), before))
    rows = rows.withColumn("new", F.when(gate, new).otherwise(F.col("relevance"))).withColumn("gate", gate).filter(~F.col("gate") | (F.col("new") > 0))
    taken = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).filter(F.col("place") <= limit)
    return _ranked(taken.select("query_id", "id", F.round("new", 9).alias("relevance")))


def strided_select(results: DataFrame, limit: int) -> DataFrame:
    """Round robin over the time line: dated rows by date fall into min(limit, dated) buckets, each ordered by relevance;
    undated rows follow. Result sets within the limit stay. results: query_id, id, relevance, day."""
    w = Window.partitionBy("query_id")
    rows = results.withColumn("total", F.count("*").over(w)).withColumn("dated", F.count("day").over(w))
    seq = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("day").asc_nulls_last(), "id")) - 1
    buckets = F.least(F.lit(limit), F.col("dated"))
    size = F.greatest(F.floor(F.col("dated") / buckets), F.lit(1))
    rows = rows.withColumn("bucket", F.when(F.col("day").isNotNull(), F.least(F.floor(seq / size), buckets - 1)))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(F.desc("relevance"), "id")))
    order = [F.col("bucket").isNull(), F.when(F.col("bucket").isNotNull(), F.col("turn")), F.col("bucket"), F.desc("relevance"), F.col("id")]
    small = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    rows = rows.withColumn("strided", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("plain", F.row_number().over(small))
    rank = F.when(F.col("total") > limit, F.col("strided")).otherwise(F.col("plain"))
    return rows.select("query_id", "id", "relevance", rank.alias("rank")).filter(F.col("rank") <= limit)


def mmr_rerank(results: DataFrame, limit: int = 10, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: greedy by weight x relevance / max - (1 - weight) x the largest Jaccard similarity of
    words to those taken. results: query_id, id, relevance, content; a query's results are few (its limit)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True], ignore_index=True)
        words = [set((c or "").lower().split()) for c in pdf["content"]]
        most, left, taken, near = pdf["relevance"].max() or 1.0, list(range(len(pdf))), [], [0.0] * len(pdf)
        while left and len(taken) < limit:
            best = max(left, key=lambda i: (weight * pdf["relevance"][i] / most - (1 - weight) * near[i], -i))
            left.remove(best)
            taken.append(best)
            for i in left:
                union = len(words[i] | words[best])
                near[i] = max(near[i], len(words[i] & words[best]) / union if union else 0.0)
        return pd.DataFrame({"query_id": pdf["query_id"][taken], "id": pdf["id"][taken], "rank": range(1, len(taken) + 1)})

    kinds = dict(results.dtypes)
    return results.select("query_id", "id", "relevance", "content").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int")


def boundary_inject(results: DataFrame, anchors: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The latest result up to the anchor day and the earliest from it on come first, then the rest in order. The anchor is
    the query's, else the middle of the dated results. results: query_id, id, relevance, day; anchors: query_id, day."""
    w = Window.partitionBy("query_id")
    rows = results.withColumn("n", F.row_number().over(_order())).withColumn("dated", F.count("day").over(w)).withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("day").asc_nulls_last(), "id")) - 1)
    middle = F.max(F.when(F.col("seq") == F.floor(F.col("dated") / 2), F.col("day"))).over(w)
    if anchors is not None:
        rows = rows.join(anchors.withColumnRenamed("day", "asked"), "query_id", "left")
        middle = F.coalesce("asked", middle)
    rows = rows.withColumn("anchor", middle)
    last = F.max(F.when(F.col("day") <= F.col("anchor"), F.struct("day", -F.col("n"), "id"))).over(w)["id"]
    first = F.min(F.when(F.col("day") >= F.col("anchor"), F.struct("day", "n", "id"))).over(w)["id"]
    rows = rows.withColumn("last", last).withColumn("first", first)
    place = F.when(F.col("id") == F.col("last"), 0).when(F.col("id") == F.col("first"), 1).otherwise(2)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "n"))).filter(F.col("rank") <= limit).select("query_id", "id", "relevance", "rank")


def activation_merge(results: DataFrame, activation: DataFrame, weights: DataFrame, limit: int = 10, fraction: float = 0.5) -> DataFrame:
    """Relevance + weight x tanh(activation); re-ordered; then at most min(3, limit x fraction) memories that only the
    graph found, with weight x tanh(activation). weights: query_id, weight."""
    a = activation.select("query_id", "id", "activation").join(weights, "query_id").withColumn("extra", F.col("weight") * F.tanh("activation"))
    own = results.select("query_id", "id", "relevance").join(a.select("query_id", "id", "extra"), ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("relevance") + F.coalesce("extra", F.lit(0.0)), 9).alias("relevance"), F.lit(0).alias("later"))
    only = top(a.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti").join(results.select("query_id").distinct(), "query_id", "left_semi"), ["query_id"], [F.desc("extra"), F.asc("id")], min(3, int(limit * fraction)))
    both = own.unionByName(only.select("query_id", "id", F.round("extra", 9).alias("relevance"), F.lit(1).alias("later")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("later", F.desc("relevance"), "id"))).filter(F.col("rank") <= limit).drop("later")


def find_superseded(results: DataFrame, edges: DataFrame, mem: DataFrame) -> DataFrame:
    """query_id, id, superseded_by: results that a newer memory, shown or not, contradicts; the newest one names it."""
    pairs = edges.filter(F.col("relationship") == "contradicts").select("source_id", "target_id")
    ways = pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(pairs.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    at = mem.select(F.col("id"), F.unix_micros("created_at").alias("at"))
    found = results.select("query_id", "id").join(ways, "id").join(at, "id").join(at.select(F.col("id").alias("other"), F.col("at").alias("other_at")), "other").filter(F.col("other_at") > F.col("at"))
    return found.groupBy("query_id", "id").agg(F.max(F.struct("other_at", "other")).alias("m")).select("query_id", "id", F.col("m.other").alias("superseded_by"))


def supersede(results: DataFrame, edges: DataFrame, mem: DataFrame) -> DataFrame:
    """Results with superseded_by; those that have one get relevance -1 and sink."""
    stale = find_superseded(results, edges, mem)
    joined = results.select("query_id", "id", "relevance").join(stale, ["query_id", "id"], "left")
    sunk = joined.withColumn("was", F.col("relevance")).withColumn("relevance", F.when(F.col("superseded_by").isNotNull(), -1.0).otherwise(F.col("relevance")))
    return sunk.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("was"), "id"))).drop("was")


def blend_rerank(results: DataFrame, scorer, alpha: float = 0.55, k: int = 10) -> DataFrame:
    """(1 - alpha) x relevance + alpha x cross score, the first k. scorer: (Series of queries, Series of contents) -> Series. results: query_id, id, relevance, query, content."""
    @F.pandas_udf("double")
    def cross(queries: pd.Series, contents: pd.Series) -> pd.Series:
        return scorer(queries, contents)

    out = results.select("query_id", "id", F.round((1 - alpha) * F.col("relevance") + alpha * cross("query", "content"), 9).alias("relevance"))
    return top(out, ["query_id"], [F.desc("relevance"), F.asc("id")], k)


def timeline_table(results: DataFrame, as_of: Column, most: int = 20) -> DataFrame:
    """query_id, day, summary, refs, days_ago: dated results by day, each cut to 35 characters and joined; days with their
    results' places; the first `most` days. Queries with fewer than two dated events have none. results: query_id, id, rank, content, dates (array)."""
    events = results.select("query_id", "rank", F.substring("content", 1, 35).alias("short"), F.explode("dates").alias("day")).withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).filter(F.col("n") >= 2)
    days = events.groupBy("query_id", "day").agg(F.sort_array(F.collect_list(F.struct("rank", "short"))).alias("e"))
    joined = F.array_join(F.transform("e", lambda x: x["short"]), " + ")
    out = days.select("query_id", "day", F.substring(joined, 1, 38).alias("summary"), F.array_join(F.transform("e", lambda x: F.concat(F.lit("M"), x["rank"].cast("string"))), ",").alias("refs"), F.datediff(as_of.cast("date"), F.col("day").cast("date")).alias("days_ago"))
    return top(out, ["query_id"], [F.asc("day")], most, "place")


def session_format(results: DataFrame) -> DataFrame:
    """results with header: the session's day where it changes down the list, else null. results: query_id, id, rank, day (text)."""
    before = F.lag("day").over(Window.partitionBy("query_id").orderBy("rank"))
    return results.withColumn("header", F.when(~F.col("day").eqNullSafe(before), F.col("day")))


def exact_token_rank(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, rank at which the wanted row came back; null if it didn't. wanted: query_id, id."""
    return wanted.join(results.select("query_id", "id", "rank"), ["query_id", "id"], "left").select("query_id", "rank")
