import random

from pyspark.sql import functions as F

from cairn.llm.queries import op5_substring
from cairn.llm.substring import remove_repeats
from tests.llm import brute


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()}


def test_brute_random(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c"] + [f"w{i}" for i in range(40)]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            i = rng.randrange(0, 60)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[i : i + rng.randrange(25, 60)]
        docs.append((d, " \n\t".join(w)))
    docs += [(100, "x " * 80), (101, "x " * 35), (102, "x " * 34), (103, None), (104, ""), (105, "y " * 36), (106, "z " * 35), (107, "é ab " * 40), (108, " ".join(map(str, range(20_000)))), (109, " ".join(map(str, range(19_000, 19_036))))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert result(remove_repeats(df)) == brute.substring(docs)


def test_reference_data(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in op5_substring(spark, sf_dir).collect()} == brute.substring(docs)


def test_edges(spark):
    rows = [(1, "p " * 20 + "q " * 20, 3), (1, "p " * 20 + "q " * 20, 4), (None, "short", None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, runs int"))
    assert sorted((r["doc_id"] or 0, r["n_removed"], len(r["passages"])) for r in got.collect()) == [(0, 0, 0), (1, 40, 1), (1, 40, 1)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
