"""Operators that hot keys must not slow down: against plain versions, with planted hubs and hot memories."""

import random

import pytest
from pyspark.sql import functions as F

import cairn.operators.search as S
from cairn.operators import graph as G
from cairn.operators import maintain as M


@pytest.mark.parametrize("min_shared", [1, 2, 3])
def test_prefix_filter(spark, min_shared):
    """Hubs that all memories have are no meeting place, and every pair that shares enough is found."""
    rng = random.Random(3)
    n = 120
    sets = {i: {0, 1} | {rng.randrange(2, 60) for _ in range(rng.randint(0, 6))} for i in range(n)}
    me = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "memory_id long, entity_id long")
    edges = spark.createDataFrame([(1, 2), (4, 3)], "source_id long, target_id long")
    mem = spark.createDataFrame([(i,) for i in range(n)], "id long").withColumn("created_at", F.timestamp_seconds("id"))
    got = {(r["start"], r["id"]): r["shared"] for r in G.suggest_connections(me, edges, mem, min_shared=min_shared, k=n).collect()}
    linked = {(1, 2), (2, 1), (3, 4), (4, 3)}
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= min_shared and (a, b) not in linked}
    assert got == want
    places = G.rarest_first(me, 3).groupBy("entity").count().collect()
    assert all(r["count"] < n / 2 for r in places if r["entity"] > 1) and not any(r["entity"] in (0, 1) for r in places)


def plain_confidence(c, signals):
    for s in signals:
        c = 0.95 * (c * s / (c * s + (1 - c) * (1 - s))) + 0.025
    return c


def test_confidence_by_matrices(spark, monkeypatch):
    """A hot memory with most signals is cut into many chunks and tasks; the result is the fold's. Long runs neither overflow nor vanish."""
    monkeypatch.setattr(M, "CHUNK_BITS", 4)
    rng = random.Random(1)
    signals = [(7, t // 3, t, rng.choice([0.15, 0.85, 0.5, 0.99])) for t in range(6000)] + [(i, t, t, rng.random()) for i in range(40) for t in range(rng.randint(0, 9)) if i != 7] + [(41, t, t, 0.9) for t in range(5000)]
    signals += [(99, 1, 1, 0.5), (3, 2, 2, None), (50, 1, 1, 0.0), (50, 2, 2, 1.0)]
    mem = spark.createDataFrame([(i, 0.5 + i / 100) for i in range(45)] + [(50, 1.0), (51, None)], "id long, confidence double")
    rows = spark.createDataFrame(signals, "id long, at long, seq long, signal double").repartition(7)
    got = {r["id"]: r["confidence"] for r in M.update_confidence(mem, rows).collect()}
    assert len(got) == 47 and got[51] is None and got[50] == 1.0
    for i in range(45):
        want = plain_confidence(0.5 + i / 100, [s for j, _, _, s in sorted(signals, key=lambda x: x[:3]) if j == i and s is not None])
        assert abs(got[i] - want) < 1e-9, i
    assert M.update_confidence(mem, rows.limit(0)).count() == 47


def test_automaton(spark, monkeypatch):
    """Anchors of many words against texts, also with the words dealt to several automata."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(n))
    mems = [(i, rng.choice("pq"), text(12).upper()) for i in range(150)] + [(900, "p", None), (901, "p", "")]
    anchors = [(i, rng.choice("pq"), text(3)) for i in range(40)] + [(90, "p", "a b"), (91, "p", None), (92, None, "abc")]
    mem = spark.createDataFrame(mems, "id long, profile string, content string").withColumn("created_at", F.timestamp_seconds(F.col("id") * 7 % 50)).withColumn("expires_at", F.lit(None).cast("timestamp"))
    asked = spark.createDataFrame(anchors, "anchor_id long, profile string, anchor string")

    def longest(a):
        best = ""
        for w in (a or "").lower().split():
            best = w if len(w) > 2 and len(w) > len(best) else best
        return best

    want = set()
    for i, p, a in anchors:
        if w := longest(a):
            want |= {(i, m) for _, m in sorted((-(m * 7 % 50), m) for m, q, t in mems if q == p and t and w in t.lower())[:5]}
    for most in (100_000, 9):
        monkeypatch.setattr(S, "MOST_WORDS", most)
        assert {(r["anchor_id"], r["id"]) for r in S.content_contains(mem, asked, F.current_timestamp(), 5).collect()} == want
    assert S.content_contains(mem, asked.limit(0), F.current_timestamp()).count() == 0


def test_topic_hashes(spark, monkeypatch):
    """Large topics are hashed row by row, small ones by an aggregate: the same hashes either way."""
    import hashlib

    mem = spark.createDataFrame([(i, "pq"[i % 2] if i % 9 else None, ["all", f"t{i % 7}", "all"], None) for i in range(200)] + [(999, "p", None, None)], "id long, profile string, tags array<string>, expires_at timestamp")
    want = {}
    for i in range(200):
        for t in ("all", f"t{i % 7}"):
            want.setdefault(("pq"[i % 2] if i % 9 else None, t), []).append(str(i))
    want = {k: (len(v), max(v), hashlib.sha256("\n".join(sorted(v)).encode()).hexdigest()) for k, v in want.items()}
    for most in (10_000, 12, 0):
        monkeypatch.setattr(M, "MOST_GATHERED", most)
        got = {(r[0], r[1]): tuple(r)[2:] for r in M.topic_sources(mem, F.current_timestamp()).collect()}
        assert got == want
