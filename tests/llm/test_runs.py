import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import runs
from cairn.llm.common import mix64
from cairn.llm.queries import op13_runs
from tests.llm.brute import WORD, sha


def plain_runs(w, least=24, times=3):
    """Every stretch that keeps a period, for all periods; those that have a smaller one go."""
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            x = w[s : i + q]
            if len(x) >= max(least, times * q) and not any(all(x[k] == x[k + r] for k in range(len(x) - r)) for r in range(1, q)):
                out.add((s, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(i, w):
    h = zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        return [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
    return w


def texts(n=400):
    rng = random.Random(5)
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            root = [rng.choice("abcdefghijkl"[: rng.choice([1, 2, 4, 12])]) for _ in range(rng.randint(1, 12))]
            w += root * rng.randint(1, 9) + root[: rng.randrange(len(root))]
            w += [f"x{rng.random()}" for _ in range(rng.randint(0, 3))]
        out.append(rng.choice([" ", "\n", "\t ", " \v"]).join(w))
    return out


def test_lyndon_arrays():
    """Both orders against the definition: the next smaller suffix."""
    rng = random.Random(1)
    for _ in range(3000):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 20))]
        for down, v in ((False, w), (True, [-x for x in w])):
            brute = [next((j for j in range(i + 1, len(v)) if v[j:] < v[i:]), len(v)) - i for i in range(len(v))]
            assert runs.lyndon_array(np.array(w, np.int64), down).tolist() == brute


@pytest.mark.parametrize("least,times", [(24, 3), (3, 3), (8, 4), (1, 5)])
def test_runs_and_stretches(least, times):
    """All runs, and all of them within the stretches that repeated shingles cover."""
    for t in texts(250):
        w = t.split()
        ids = np.unique(np.array(w, dtype="U32"), return_inverse=True)[1] if w else np.zeros(0, np.int64)
        want = plain_runs(w, least, times)
        assert runs.runs_of(ids, least, times) == want
        parts = runs.stretches(mix64(ids), np.zeros(len(w), np.int64), runs.seed(least, times), least)
        got = [(s + lo, n, p) for lo, hi in parts for s, n, p in runs.runs_of(ids[lo:hi], least, times)]
        assert sorted(got, key=lambda r: (r[0], r[2])) == want


def check(rows, docs):
    for (i, t), r in zip(docs, rows):
        w = edited(i, WORD.findall(t or ""))
        found = plain_runs(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {j for s, n, p in found for j in range(s + p, s + n)}
        want = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
        assert tuple(r)[1:] == want, i


def test_query(spark, tmp_path):
    docs = list(enumerate(texts() + [None, "", " \n", "a " * 5000, "é ü " * 30]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(op13_runs(spark, str(tmp_path)).collect())
    assert len(rows) == len(docs) and sum(r["n_runs"] > 0 for r in rows) > 100
    check(rows, docs)


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000").collect())
    rows = {r["doc_id"]: r for r in op13_runs(spark, sf).collect()}
    check([rows[i] for i, _ in docs], docs)


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, clashing columns, an empty table, a long run."""
    docs = spark.createDataFrame([(None, "b " * 40, 1, "x"), (7, None, 2, "x"), (7, "a b " * 30, 3, "x"), (7, "a b " * 30, 3, "x")], "doc_id long, text string, runs int, `a.b` string")
    got = sorted(runs.find_runs(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["n_words"]))
    assert [r["text"] for r in got] == ["b", "", "a b", "a b"] and got[0]["a.b"] == "x"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 60, 2)] and got[1]["runs"] == [] and got[1]["best"] is None
    assert runs.find_runs(docs.limit(0)).count() == 0
    long = runs.find_runs(spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('one two three ', 400000)").alias("text"))).first()
    assert long["text"] == "one two three" and long["best"]["length"] == 1_200_000
    with pytest.raises(ValueError):
        runs.find_runs(docs, times=2)
