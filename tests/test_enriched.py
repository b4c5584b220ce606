"""Enrichment by substrings and bound texts: what the patterns alone give, and each new memory against the store's five nearest."""

import random

from pyspark.sql import functions as F

from cairn import fixtures as X
from cairn.functions import text as T
from cairn.operators import ingest as I


def test_five_nearest_of_any_partition(spark):
    """A memory contradicts the five nearest of the store, however the store's rows fall into tasks."""
    vector = lambda i: [1.0, i / 100, 0.0]
    mem = spark.createDataFrame([(i, "en", "we no longer use that", vector(i)) for i in range(40)] + [(90, "de", "x", [0.0, 0.1, 1.0])], "id long, profile string, content string, embedding array<float>")
    mem = mem.withColumn("expires_at", F.lit(None).cast("timestamp")).repartition(9)
    new = spark.createDataFrame([(100, "en", "we use that", [], vector(20)), (101, "de", "far off", None, [1.0, 0.0, 0.3]), (102, "fr", "alone", [], vector(1))], "id long, profile string, content string, tags array<string>, embedding array<float>")
    rows, contradicts, links, _ = I.store_enriched(new, mem, X.profile_settings(spark), X.as_of())
    assert sorted((r["source_id"], r["target_id"]) for r in contradicts.collect()) == [(100, i) for i in range(18, 23)]
    assert sorted(r["target_id"] for r in links.collect() if r["source_id"] == 100) == list(range(18, 23))
    assert {r["id"]: r["surprise"] for r in rows.collect()} == {100: 0.0, 101: round(1 - 0.3 / (1.01 * 1.09) ** 0.5, 3), 102: 0.5}


def test_guards_miss_nothing(spark):
    """Texts from pieces of secrets, and around them, are masked as the four passes alone would mask them; words are found as by patterns."""
    rng = random.Random(5)
    pieces = [
        "api_key=", "API-KEY: ", "Token ", "bearer ", "passwd='", "sk_live=", "SG.", "AKIA", "dsn=", "Redis_URL = ", "://", ":", "@", "u", "abcdefgh1234", "ABCDEFGHIJKLMNOP", "x" * 24, ".abcdef.", "y" * 27, "12345678:", "z" * 35, "ghp_", "a" * 36,
        "Key=", "TOKEN=", " ", "\n", "é", "'", "xoxb-", "-", "/", "a/b", ".py", "Error", "KeyError", "no longer", "Decided", "CRASH", "`",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    names, c = "(?:" + "|".join(T.SECRET_NAMES) + ")", F.col("t")
    plain = F.regexp_replace(c, "(?i)(" + names + r"[=:\s]+\s*['\"]?)[A-Za-z0-9_\-./+=]{8,}['\"]?", "$1" + T.MASK)
    plain = F.regexp_replace(F.regexp_replace(plain, "(?:" + "|".join(T.SECRET_TOKENS) + ")", T.MASK), T.SECRET_URL, f"://{T.MASK}:{T.MASK}@")
    plain = F.regexp_replace(plain, T.SECRET_ENV, "$1" + T.MASK)
    got = df.select(c, T.mask_secrets(c).alias("got"), plain.alias("want"), T.has_word(c, T.DECISION_WORDS).alias("has"), T.like(F.lower(c), T.any_of(T.DECISION_WORDS)).alias("has_"), T.like(c, T.HAS_PATH).alias("path"), T.like(c, T.FILE_PATH).alias("path_")).collect()
    assert all(r["got"] == r["want"] and r["has"] == r["has_"] and r["path"] == r["path_"] for r in got)
    assert sum(r["got"] != r["t"] for r in got) > 300 and sum(bool(r["path"]) for r in got) > 10

