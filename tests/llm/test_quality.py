import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import quality
from cairn.llm.queries import op2_quality


def test_held_out_accuracy(spark):
    """Labels whose documents the fit has not seen: half of them are taken out of its table."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("seen", F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) > 0)
    heads = quality.fit(docs, labels.filter("seen").drop("seen"))
    scored = quality.classify(docs.join(labels.filter("NOT seen"), "doc_id"), heads).cache()
    got = quality.combine(scored, quality.posteriors(scored), heads)
    out = (~F.col("keep")).cast("int")
    r = got.agg(
        F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), out)).alias("clean"),
        F.avg(F.when(F.col("quality") == 0, out)).alias("low"),
        F.avg(F.when(F.col("toxic") == 1, out)).alias("toxic"),
    ).first()
    print(r)
    assert r["clean"] < 0.01 and r["low"] > 0.9 and r["toxic"] > 0.85


def test_shrinkage(spark):
    """A sparse path moves less from its host than one with many rows and the same mean; a sparse host less from the corpus."""
    rows = [("a", "x", 0.9)] * 200 + [("a", "y", 0.9)] * 2 + [("a", "z", 0.1)] * 300 + [("b", "x", 0.1)] * 400 + [("c", "x", 0.9)] * 2
    scored = spark.createDataFrame(rows, "host string, path string, p_low double").withColumn("p_toxic", F.lit(0.0))
    got = {(r["host"], r["path"]): r for r in quality.posteriors(scored).collect()}
    overall = sum(p for *_, p in rows) / len(rows)
    assert got["a", "x"]["path_low"] > got["a", "y"]["path_low"] > got["a", "y"]["host_low"]
    assert overall < got["c", "x"]["host_low"] < 0.9


def plain_posteriors(rows):
    """The posterior means in plain Python: moments of the groups give each prior's strength."""
    def strength(groups):  # (n, mean, prior)
        n = sum(g[0] for g in groups)
        within = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
        extra = (sum(g[0] * (g[1] - g[2]) ** 2 for g in groups) - len(groups) * within) / n
        return min(1e4, max(1.0, within / extra)) if len(groups) > 1 and extra > 0 and within > 0 else 1e4

    by = defaultdict(list)
    for host, path, p in rows:
        by[host, path].append(p)
    overall = (sum(p for *_, p in rows) + 0.5) / (len(rows) + 1)
    hosts = {h: [p for (x, _), ps in by.items() if x == h for p in ps] for h, _ in by}
    k = strength([(len(ps), sum(ps) / len(ps), overall) for ps in hosts.values()])
    host = {h: (sum(ps) + k * overall) / (len(ps) + k) for h, ps in hosts.items()}
    k = strength([(len(ps), sum(ps) / len(ps), host[h]) for (h, _), ps in by.items()])
    return {(h, q): (host[h], (sum(ps) + k * host[h]) / (len(ps) + k), overall) for (h, q), ps in by.items()}


def test_posteriors_and_decisions(spark):
    """Posteriors, final odds and decisions against the plain version, with null groups, repeated rows and clashing columns."""
    rng = random.Random(4)
    rows = [(h, q, round(min(1.0, max(0.0, rng.gauss(m, 0.2))), 3)) for h, q, m, n in (("a", "x", 0.2, 40), ("a", None, 0.6, 7), (None, "x", 0.8, 12), ("b", "y", 0.4, 30), ("c", "x", 0.1, 1)) for _ in range(n)]
    rows += rows[:3]
    scored = spark.createDataFrame([(h, q, p, 0.0, "old", 7.0, True) for h, q, p in rows], "host string, path string, p_low double, p_toxic double, host_low string, all_low double, keep boolean")
    want, groups = plain_posteriors(rows), quality.posteriors(scored)
    got = {(r["host"], r["path"]): (r["host_low"], r["path_low"], r["all_low"]) for r in groups.collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for g in want for a, b in zip(got[g], want[g]))
    heads = {"low": quality.Head({}, [], np.zeros(1), 0.6)}
    out = quality.combine(scored, groups, heads).collect()
    assert len(out) == len(rows) and len(set(out[0].asDict())) == len(out[0])
    logit = lambda p: math.log(p / (1 - p))
    for r in out:
        _, path, overall = want[r["host"], r["path"]]
        final = 1 / (1 + math.exp(-(logit(min(1 - 1e-6, max(1e-6, r["p_low"]))) + logit(path) - logit(overall))))
        assert abs(r["final_low"] - final) < 1e-9 and r["keep"] == (final <= 0.6)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "p", 0.5), (2, "", "h", None, 0.5), (2, "word " * 20_000, "h", None, 0.5)], "doc_id long, text string, host string, path string, p_low double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    heads = quality.fit(docs, none)
    assert heads == {}
    scored = quality.classify(docs, heads)
    assert [r["keep"] for r in quality.combine(scored, quality.posteriors(scored), heads).collect()] == [True] * 3
    empty = quality.classify(docs.limit(0), heads)
    assert quality.combine(empty, quality.posteriors(empty), heads).count() == 0
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels)


def test_query(spark, sf_dir):
    got = op2_quality(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
