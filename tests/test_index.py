import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import search as S


def rows(spark, mems):
    return spark.createDataFrame(mems, "id long, profile string, content string").withColumn("expires_at", F.when(F.col("id") % 11 == 0, F.lit("2000-01-01").cast("timestamp")))


@pytest.fixture(scope="module")
def state(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["the", "of", "Tea", "cup", "é", "red", "x9", "moon"]) for _ in range(rng.randint(0, 14)))
    mems = [(i, rng.choice("pq"), text()) for i in range(160)] + [(500, "p", None)]
    more = [(i, rng.choice("pq"), text()) for i in range(150, 190)]  # ids from 150 to 159 are there already
    queries = spark.createDataFrame([(i, rng.choice("pq"), " ".join(rng.sample(["the", "tea", "red", "moon", "é", "nowhere", "TEA"], rng.randint(1, 3)))) for i in range(30)] + [(90, "p", ""), (91, "p", None)], "query_id long, profile string, text string")
    index = S.KeywordIndex.build(rows(spark, mems), 4).insert(rows(spark, more)).delete(spark.createDataFrame([(3,), (151,), (9999,)], "id long"))
    now = {m[0]: m for m in mems} | {m[0]: m for m in more}
    left = rows(spark, [m for i, m in now.items() if i not in (3, 151)])
    return index, left, queries


@pytest.mark.parametrize("method", ["frequency", "cover"])
def test_same_as_without(spark, state, method):
    """What the stored index gives, after changes and compacted, is what reading all contents gives."""
    index, left, queries = state
    as_of = F.current_timestamp()
    want = sorted(map(tuple, S.keyword_topk(queries, left, as_of, 5, method).collect()))
    assert len(want) > 40
    for one in (index, index.compact()):
        got = S.keyword_topk(queries, left, as_of, 5, method, one)
        assert sorted(map(tuple, got.collect())) == want


def test_reads_no_content(spark, state):
    """A search with the index needs no memory's content, and scans the folders of its terms only."""
    index, left, queries = state
    few, as_of = queries.filter("query_id < 9"), F.current_timestamp()
    assert sorted(map(tuple, S.keyword_topk(few, left.drop("content"), as_of, 5, "cover", index).collect())) == sorted(map(tuple, S.keyword_topk(few, left, as_of, 5, "cover").collect()))
    plan = index.postings.filter(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [bucket") == 2  # what was built, and what was inserted
