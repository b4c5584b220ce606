import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import vectors as V


def rows_of(spark, m, profiles, name):
    return spark.createDataFrame([(i, p, [float(x) for x in v]) for i, (v, p) in enumerate(zip(m, profiles))], f"{name} long, profile string, embedding array<float>")


def clustered(rng, n, dim, centres, spread):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clustered", "random", "copies"])
def test_pruned_join_is_exact(spark, monkeypatch, kind):
    """The pruned join gives what all pairs give, with small cells and blocks; clustered vectors meet few others."""
    rng = np.random.default_rng(7)
    n, dim = 1200, 16
    m = clustered(rng, n, dim, 25, 0.05) if kind == "clustered" else rng.normal(size=(n, dim))
    if kind == "copies":
        m[: n // 3] = m[0]  # a third of all rows has one vector
    m[5] = 0
    mem = rows_of(spark, m, rng.choice(["a", "a", "a", "b", None], n), "id")
    mem = mem.unionByName(spark.createDataFrame([(n, "a", None), (n + 1, "c", [1.0] * dim)], mem.schema))
    queries = mem.withColumnRenamed("id", "query_id")
    k, minimum = 4, 0.8
    whole = V.topk(queries.limit(4000), mem, k, minimum)
    for name, value in (("BLOCK", 100), ("ROWS", 150), ("CELL", 20)):
        monkeypatch.setattr(V, name, value)
    made = spark.sparkContext.accumulator(0)
    got = V.similar(queries, mem, k, minimum, made)
    rank = lambda df: {q: [(-s, i) for s, i in sorted((-r["similarity"], r["id"]) for r in rs)][:k] for q, rs in by(df).items()}
    want, have = rank(whole), rank(got)
    assert have == want and len(want) > (500 if kind != "random" else 100)
    pairs = sum(r["count"] ** 2 for r in mem.filter("profile IS NOT NULL").groupBy("profile").count().collect())
    print(kind, made.value, pairs)
    assert made.value < {"clustered": pairs / 4, "random": pairs, "copies": pairs / 1.5}[kind]


def by(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_products_at_scale(spark):
    """On the given memories the join makes far fewer inner products than pairs, as copies of a vector meet as one."""
    from cairn import fixtures as X

    mem = X.memories(spark, "/root/testdata/sf0.1").select("id", "profile", "embedding")
    n = sum(r["count"] ** 2 for r in mem.groupBy("profile").count().collect())
    made = spark.sparkContext.accumulator(0)
    V.similar(mem.select(F.col("id").alias("query_id"), "profile", "embedding"), mem, 6, 0.85, made).count()
    print(made.value, n)
    assert made.value < n / 5


def test_many_cells_take_bounded_room(spark, monkeypatch):
    """Where angles prune nothing, as each query reaches every cell, no copies of queries are stored and a task gives them on in small pieces; the result is exact."""
    from cairn.operators import base as B

    rng = np.random.default_rng(5)
    n = 700
    mem = rows_of(spark, rng.normal(size=(n, 8)), rng.choice(["a", "b"], n), "id")
    queries = mem.withColumnRenamed("id", "query_id")
    want = {q: sorted((-r["similarity"], r["id"]) for r in rs)[:3] for q, rs in by(V.topk(queries, mem, 3, 0.3)).items()}
    for name, value in (("BLOCK", 100), ("ASKS", 60), ("MEMBERS", 50), ("CELL", 9), ("ANGLES", 500), ("GIVEN", 40)):
        monkeypatch.setattr(V, name, value, raising=False)
    stored, cut = [], B.cut

    def seen(df, *args):
        out = cut(df, *args)
        stored.append(out.count())
        return out

    monkeypatch.setattr(B, "cut", seen)
    got = {q: sorted((-r["similarity"], r["id"]) for r in rs)[:3] for q, rs in by(V.similar(queries, mem, 3, 0.3)).items()}
    assert got == want and max(stored) <= n


def test_auto_link_over_many_cells(spark, monkeypatch):
    """Links of memories in many cells and blocks are those of all pairs; a vector's copies link to each other."""
    from cairn.operators import linking as L

    rng = np.random.default_rng(8)
    m = rng.normal(size=(400, 6))
    m[300:] = m[:100]
    mem = rows_of(spark, m, rng.choice(["a", "b"], 400), "id").withColumn("expires_at", F.lit(None).cast("timestamp"))
    want = sorted(map(tuple, L.auto_link(mem, mem, F.current_timestamp(), 0.3, 3).collect()))
    for name, value in (("BLOCK", 50), ("ASKS", 40), ("MEMBERS", 30), ("CELL", 7), ("ANGLES", 300), ("GIVEN", 25)):
        monkeypatch.setattr(V, name, value)
    assert sorted(map(tuple, L.auto_link(mem, mem, F.current_timestamp(), 0.3, 3).collect())) == want and len(want) > 1000
