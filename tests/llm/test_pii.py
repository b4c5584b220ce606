import hashlib

from pyspark.sql import functions as F

from cairn.llm import pii
from cairn.llm.queries import op9_pii
from tests.llm import brute

HARD = [
    "mail a.b+c@x-y.example.com_x@y.org, then 4111 1111 1111 1111 and 4111-1111-1111-1112 or +49 (0)30 123456-7",
    "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.1 10.0.0.1.", "é@é.de a@b a@b.c.d.e.", "+1 2 3 4 5 6 7 8 9 +1 (555) 010-9999 x +1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3",
    "9" * 3_000, "a" * 3_000 + "@", "1." * 3_000, "1 " * 5_000, "x@y.z " * 3000, "", None, "\U0001F600 a@b.de \U0001F600 4111111111111111",
    "-" * 3_000 + "1@", "+1" + " " * 50_000 + "2", "@" * 1000, "00000000000000000000000000000.1.1.1", "a.@b.c%d@e.f",
]


def test_base(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r[0]: [tuple(s) for s in r[1]] for r in pii.propose(df).select("doc_id", "__base").collect()}
    assert got == {i: brute.pii(t) for i, t in enumerate(HARD)}


def test_very_long(spark):
    """Runs of 100,000 characters take linear time and no deep recursion."""
    texts = ["9" * 100_000, "a" * 100_000 + "@", "1." * 20_000, "1 " * 50_000, "-" * 100_000 + "1@", "a@" * 50_000, "1.2.3." * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.select(pii.propose(df), {}).select("doc_id", F.size("__spans")).collect()}
    assert got == {0: 0, 1: 0, 2: 5000, 3: 0, 4: 0, 5: 0, 6: 7500}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op9_pii(spark, sf_dir).collect()}
    for d, t in docs:
        want = brute.pii(t)
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[d]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(got[d]["spans"].split(","))


def test_redacted(spark):
    df = spark.createDataFrame([(1, "mail a@b.de now +49 30 1234567, bye"), (2, "clean"), (3, None)], "doc_id long, text string")
    p = pii.select(pii.propose(df), {})
    got = dict(p.select("doc_id", pii.redacted(F.col("text"), F.col("__spans"))).collect())
    assert got == {1: "mail [EMAIL] now [PHONE], bye", 2: "clean", 3: None}


def test_boosting_adds_loose_forms(spark):
    """Forms that no base pattern finds are added and redacted, from what checks confirm of their likes; look-alikes aren't."""
    n = 60
    alnum = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:40]
    rows = [f"call me at +1 (555) 010-{i:04d} today" for i in range(n)] + [f"order 2024-{i:04d}-77-1 shipped" for i in range(n)]
    rows += [f"{('write to', 'so')[i % 2]} jane{i} (at) example{i} (dot) com please" for i in range(n)] + [f"met at{i} (at) room{i} (dot) door" for i in range(1)]
    rows += [f'token = "{alnum(i)}" set' for i in range(n)] + [f"the part number_of_the_version_{i:02d} fits" for i in range(n)]
    rows += [f"release 1.2.3.{300 + i}.5 is out" for i in range(n)]
    at = len(rows)
    loose = ["ring (555) 010-1234 today", "or joe [at] mail [dot] org now", "mail x (at) y (dot) com", 'key: "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"', "see number_of_the_version_77 there", "release 1.2.3.400.5 and order 2023-0001-77-1"]
    df = spark.createDataFrame([*enumerate([*rows, *loose, "", None, loose[0]])], "doc_id long, text string")
    proposed = pii.propose(df)
    models = pii.fit(proposed)
    got = {r["doc_id"]: r for r in pii.select(proposed, models).withColumn("said", pii.redacted(F.col("text"), F.col("__spans"))).collect()}
    for i in range(n):
        assert "[PHONE]" in got[i]["said"] and "(555)" not in got[i]["said"]
        assert not got[n + i]["__spans"]
        assert got[2 * n + i]["said"] == f"{('write to', 'so')[i % 2]} [EMAIL] please"
        assert got[3 * n + 1 + i]["said"] == 'token = "[SECRET]" set'
        assert not got[4 * n + 1 + i]["__spans"] and not got[5 * n + 1 + i]["__spans"]
    said = [got[at + i]["said"] for i in range(9)]
    assert said == ["ring [PHONE] today", "or [EMAIL] now", "mail [EMAIL]", 'key: "[SECRET]"', loose[4], loose[5], "", None, "ring [PHONE] today"]


def plain_select(base, good):
    """Good candidates (over, start, stop, kind) that no base span and no better overlapping candidate meets; all pairs are looked at."""
    good = [c for c in good if not any(b[0] < c[2] and c[1] < b[2] for b in base)]
    worth = lambda c: (c[0], -c[1], c[2], -c[3])
    kept = [c for c in good if not any(worth(d) > worth(c) and d[1] < c[2] and c[1] < d[2] for d in good)]
    return sorted([*base, *{(c[1], c[3], c[2]) for c in kept}])


def test_overlaps(spark):
    """Random spans of every kind, apart within a kind: what is selected and redacted equals the plain version over all pairs."""
    import random

    rng = random.Random(2)
    rows = []
    for i in range(300):
        def spans(kinds, most):
            out = []
            for k in kinds:
                at = rng.randint(0, 4)
                while at < 60 and rng.random() < most:
                    stop = at + rng.randint(1, 14)
                    out.append((at, k, stop))
                    at = stop + rng.randint(0, 9)
            return out

        base = sorted(spans(range(4), rng.choice([0, 0.3, 0.9])))
        cands = [(a, z, k, rng.randint(0, 3)) for a, k, z in spans(range(5), rng.choice([0, 0.5, 0.95]))]
        rows.append((i, "".join(rng.choice("abcé\n😀") for _ in range(80)), base, cands))
    df = spark.createDataFrame(rows, "doc_id long, text string, __base array<struct<start:int,kind:int,stop:int>>, c array<struct<start:int,stop:int,kind:int,size:int>>")
    full = F.transform("c", lambda c: F.struct(c["start"], c["stop"], c["kind"], *[(c["size"] if f == "size" else F.lit(0)).alias(f) for f in pii.FEATURES], F.lit(0).alias("label")))
    df = df.withColumn("__candidates", full)
    tree = [("size", 1, [("size", 1, -5.0, -5.0), ("size", 2, 1.0, 2.0)]), ("size", 3, [("size", 1, 0.0, 0.0), ("size", 3, 1.5, 1.5)])]
    got = pii.select(df, {k: pii.Boosted(0.0, tree, 0.5) for k in pii.ALL_KINDS}).withColumn("said", pii.redacted(F.col("text"), F.col("__spans"))).collect()
    over = {0: -5.5, 1: 0.5, 2: 1.5, 3: 3.0}
    met = 0
    for r in got:
        _, text, base, cands = rows[r["doc_id"]]
        want = plain_select(base, [(over[n], a, z, k) for a, z, k, n in cands if over[n] >= 0])
        assert [tuple(x) for x in r["__spans"]] == want
        said, at = "", 0
        for a, k, z in want:
            if a >= at:
                said += text[at:a] + f"[{pii.ALL_KINDS[k].upper()}]"
            at = max(at, z)
        assert r["said"] == said + text[at:]
        met += len(want) > len(base)
    assert met > 50


def test_many_matches(spark):
    """Time grows as a text's matches do: four times as many numbers take about four times as long, and their places stay right."""
    import time

    def run(n):
        text = "".join(f"+49 30 {1000000 + i} or 4111 1111 1111 1111; " for i in range(n // 2))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        model = pii.Boosted(1.0, [], 0.0)
        p = pii.select(pii.propose(df), dict.fromkeys(pii.ALL_KINDS, model))
        began = time.time()
        r = p.select("__spans", pii.redacted(F.col("text"), F.col("__spans")).alias("said")).first()
        return time.time() - began, text, r

    run(100)
    few, text, r = run(8_000)
    assert {tuple(x) for x in r["__spans"]} >= {(s, k, e) for s, k, e in brute.pii(text)} and "[PHONE] or [CARD]; " * 3 in r["said"] and "1111" not in r["said"]
    many, _, r = run(32_000)
    print(few, many)
    assert len(r["__spans"]) >= 32_000 and many < 8 * few + 2


def test_odd_columns(spark):
    """Maps and clashing columns are no obstacle."""
    df = spark.sql("SELECT 1L doc_id, 'a@b.de' text, map('k', 1) m, 1 __base, 2 __candidates, 3 __spans UNION ALL SELECT 1L, 'a@b.de', map('k', 2), 1, 2, 3")
    proposed = pii.propose(df)
    got = pii.select(proposed, pii.fit(proposed)).collect()
    assert [[tuple(s) for s in r["__spans"]] for r in got] == [[(0, 0, 6)]] * 2


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "no data"), (None, None)], "doc_id long, text string")
    models = pii.fit(pii.propose(df))
    assert not any(m.trees for m in models.values())
    assert [len(r["__spans"]) for r in pii.select(pii.propose(df), models).collect()] == [0, 0]
    assert all(m.threshold == float("inf") for m in pii.fit(pii.propose(df.limit(0))).values())
