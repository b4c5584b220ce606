import hashlib
import math
from collections import Counter

import numpy as np
import xxhash

from cairn.llm import imatch
from cairn.llm.common import mix64
from cairn.llm.imatch import edited_fingerprints, fingerprints, likeness, with_next
from cairn.llm.queries import op3_imatch


def test_query(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in op3_imatch(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    marks, edited, following = {}, [], []
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(t) // 4
        want = t[: len(t) - cut] + after[:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        assert marks.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        if after != t and len(t) > 400:
            edited.append(r["near_edited"]), following.append(r["near_next"])
    assert sum(edited) / len(edited) > 0.3 and sum(following) / len(following) < 0.1


def plain_fingerprint(text, counts, n):
    """The fingerprint from its definition, term by term: the band, the level, each subset's members, sorted and hashed."""
    hashes = {xxhash.xxh3_64_intdigest(w) for w in set(text.encode().lower().split())}
    if not hashes:
        return "empty"
    known = {h for h in hashes if max(2, math.ceil(n / 1000)) <= counts[h] <= max(2, math.floor(n / 20))}
    terms = sorted(known or hashes)
    level = max(0, round(math.log2(len(terms) / 0.7)))
    seeds = mix64(np.arange(48, dtype=np.uint64), 21)
    parts = [str(level)]
    for rate in (level, level + 1):
        out = ""
        for seed in seeds:
            drawn = mix64(np.array(terms, np.uint64) ^ seed, 22).tolist()
            own = [t for t, x in zip(terms, drawn) if x < 2 ** (64 - rate)]
            out += xxhash.xxh3_64_hexdigest(np.array(own, np.uint64).tobytes())[:5] if own else "-----"
        parts.append(out)
    return ":".join(parts)


def test_fingerprints(spark, sf_dir):
    """Whole fingerprints against the plain version, on the reference data."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = Counter(xxhash.xxh3_64_intdigest(w) for _, t in docs for w in set((t or "").encode().lower().split()))
    got = {r["doc_id"]: r for r in op3_imatch(spark, sf_dir).collect()}
    alone = dict(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())
    for d, t in docs:
        assert got[d]["fingerprint"] == alone[d] == plain_fingerprint(t or "", counts, len(docs))


def test_far_off_ids(spark, monkeypatch):
    """One id far from the others leaves theirs in buckets of about the wanted size; order holds in and between ranges."""
    monkeypatch.setattr(imatch, "RANGES", 5)
    ids = [*range(1000, 1400), 2**62, -(2**61), *range(5000, 5040, 7)]
    got = {r[1]: r[2] for r in with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), per_bucket=10).collect()}
    order = sorted(ids)
    assert got == {str(a): str(b) for a, b in zip(order, order[1:] + order[:1])}


def test_next(spark):
    rows = [(None, "n"), (5, "five"), (2**40, None), (5, "five again"), (-3, "minus")]
    got = {(r[0], r[1]): r[2] for r in with_next(spark.createDataFrame(rows, "doc_id long, text string"), per_bucket=1).collect()}
    assert got == {(None, "n"): "minus", (-3, "minus"): "five", (5, "five"): "five again", (5, "five again"): "", (2**40, ""): "n"}


def test_edges(spark):
    rows = [(1, "one two three", 1), (2, "one two three", 1), (3, "", 2), (4, None, 2), (5, "word " * 20_000, 3)]
    got = {r["doc_id"]: r for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert got[3]["fingerprint"] == got[4]["fingerprint"] == "empty" and got[3]["near_edited"] == 1.0 and got[2]["near_next"] == 0.0
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert edited_fingerprints(spark.createDataFrame(rows[:1], "doc_id long, text string, fingerprint int")).first()["near_next"] == 1.0
