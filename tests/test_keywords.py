"""Keyword search at size: what leaves a task, and the same results either way."""

import random

from pyspark.sql import functions as F

from cairn.operators import search as S


def some(spark, n=300):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["run", "running", "Runs", "city", "cities", "tea", "teas", "boxes", "box", "é", "walked", "x9", "the"]) for _ in range(rng.randint(0, 30)))
    return spark.createDataFrame([(i, rng.choice(["p", "q", None]), text()) for i in range(n)] + [(900, "p", None)], "id long, profile string, content string").withColumn("expires_at", F.when(F.col("id") % 11 == 0, F.lit("2000-01-01").cast("timestamp")))


def test_index_is_written_where_texts_are_read(spark, monkeypatch):
    """Building an index shuffles no postings, also with texts of more words than are taken at once."""
    plans, cut = [], S.cut

    def seen(df, *args, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString() if args or more else "")
        return cut(df, *args, **more)

    monkeypatch.setattr(S, "cut", seen)
    for words in (1_000_000, 5):
        monkeypatch.setattr(S, "WORDS", words, raising=False)
        index = S.KeywordIndex.build(some(spark), 4)
        assert any(plans) and "Exchange" not in "".join(plans)
        want = some(spark).select("id", "profile", F.posexplode(S.tokens(F.col("content"))).alias("position", "term")).groupBy("profile", "term", "id").agg(F.array_sort(F.collect_list("position")).alias("positions"))
        rows = lambda df: sorted(map(repr, df.select("profile", "term", "id", "positions").collect()))
        assert rows(index.places) == rows(want) and index.postings.filter("tf < 1").isEmpty()


def test_spellings(spark):
    """Every word whose stem is a term is among the term's spellings."""
    rng = random.Random(3)
    starts = ["run", "cit", "box", "bus", "class", "ab", "a", "été", "church", "y", "ly", "sing", "ed", "need", "x9"]
    words = {rng.choice(starts) + "".join(rng.choice(["", "s", "es", "ies", "y", "ing", "ed", "ss", "u"]) for _ in range(3)) for _ in range(4000)}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.stem(F.col("w")).alias("t"))
    assert df.filter(~F.array_contains(S.spellings(F.col("t")), F.col("w"))).isEmpty() and df.filter("w <> t").count() > 300


def test_web_by_either_way(spark, monkeypatch):
    """Web-style queries of few words are ranked where the texts are read, without a shuffle of words; of many, by a join: the same ranks."""
    rng = random.Random(12)
    parts = ["tea", "runs", "city", '"the tea"', '"city running box"', "-walked", '-"tea the"', "or", "box", "x9", "é", "nowhere", "teas-box"]
    asked = [(i, rng.choice("pq"), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(80)] + [(90, "p", None), (91, None, "tea")]
    queries = spark.createDataFrame(asked, "query_id long, profile string, text string")
    for method in ("web", "stemmed"):
        found = S.keyword_topk(queries, some(spark), F.current_timestamp(), 5, method)
        assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "collect_list" not in plan
        got = sorted(map(tuple, found.collect()))
        monkeypatch.setattr(S, "MOST_ASKED", 0)
        monkeypatch.setattr(S, "MOST_SENT", 0)
        assert sorted(map(tuple, S.keyword_topk(queries, some(spark), F.current_timestamp(), 5, method).collect())) == got and len(got) > 100
        monkeypatch.undo()
