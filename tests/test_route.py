"""Routed search, bridges and threads against plain versions over the same searches; compression, backfill and secrets by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import entities as E
from cairn.operators import maintain as M
from cairn.operators import route as Q
from cairn.operators import search as S
from tests.test_units import now


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, "The wedding of Anna Berg was on the lake", 1), (2, "My long trip to Oslo began in spring", 2), (3, "Notes about the wedding cake and music", 3), (4, "Trip costs and hotel bills", 4),
        (5, "Anna Berg wrote about PostgresBackend", 5), (6, "Nothing of note", 6),
    ]
    mem = spark.createDataFrame(
        [(i, "p", t, [1.0, float(i % 3), 0.5 * i], dt.datetime(2024, 1, d), None, 0, 0.5, 0.5, ["x:y"], None, "{}") for i, t, d in rows],
        "id long, profile string, content string, embedding array<float>, created_at timestamp, expires_at timestamp, access_count int, confidence double, importance double, tags array<string>, last_accessed_at timestamp, metadata string",
    ).cache()
    edges = spark.createDataFrame([(1, 3, "related", 0.9)], "source_id long, target_id long, relationship string, strength double")
    return mem, edges


def asked(spark, *texts):
    return spark.createDataFrame([(i, "p", t, ["x:y"], [1.0, 1.0, 1.0]) for i, t in enumerate(texts)], "query_id long, profile string, text string, tags array<string>, embedding array<float>")


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["relevance"]))
    return out


def test_bridge(spark, corpus):
    mem, edges = corpus
    q = asked(spark, "how many days between the wedding and my trip?", "no anchors here")
    got = listed(Q.bridge_search(q, mem, edges, now(), 2))
    search = lambda text, k: listed(S.hybrid_search(asked(spark, text).withColumn("tags", F.array().cast("array<string>")), mem, edges, now(), k)).get(0, [])
    first, second, standard = search("wedding", 10), search("trip", 10), search("how many days between the wedding and my trip?", 4)
    turn = [x for pair in zip(first, second) for x in pair]
    merged = {}
    for i, r in [(i, r + 0.3 * math.log1p(r)) for i, r in turn] + standard:
        merged.setdefault(i, r)
    at = {r["id"]: r["created_at"].replace(tzinfo=dt.timezone.utc).timestamp() for r in mem.collect()}
    want = sorted(((round(r + at[i] * 1e-15, 9), i) for i, r in merged.items()), key=lambda x: (-x[0], x[1]))[:2]
    assert set(got) == {0} and all(i == j and abs(r - w) < 2e-9 for (i, r), (w, j) in zip(got[0], want, strict=True))


def test_thread(spark, corpus):
    mem, edges = corpus
    q = asked(spark, "what did she write")
    first = S.hybrid_search(q, mem, edges, now(), 3)
    got = [i for i, _ in listed(Q.entity_thread(first, q, mem, edges, now(), 4))[0]]
    one = [i for i, _ in listed(first)[0]]
    lead = " ".join(r["content"] for i in one for r in mem.filter(F.col("id") == i).collect())
    names = q.select(Q.named_things(F.col("text"), F.lit(lead))).first()[0]
    two = [i for i, _ in listed(S.hybrid_search(q.withColumn("text", F.lit(" ".join(names))).withColumn("tags", F.array().cast("array<string>")), mem, edges, now(), 8))[0]]
    want = []
    for i in range(max(len(one), len(two))):
        for x in (one, two):
            if i < len(x) and x[i] not in want:
                want.append(x[i])
    assert got == want[:4]


def test_names(spark):
    row = spark.sql("""SELECT 'what did "blue car" cost, PostgresBackend of Anna Berg should tell' q, 'Oslo City Hall and e-Mail, Red-Line here' c""")
    assert row.select(Q.named_things(F.col("q"), F.col("c"))).first()[0] == ["Anna Berg", "Oslo City Hall", "Red-Line", "blue car", "blue"]


def test_routes(spark, corpus):
    mem, edges = corpus
    q = asked(spark, "what is the order of the trips", "how many days between the wedding and my trip?", "how many different cars are there", "overview of everything", "what was last week", "blue car", "how old was I when", "how old was I when, overview of all")
    got = Q.route_search(q, mem, edges, now(), 2).collect()
    routes = {r["query_id"]: r["route"] for r in got}
    assert [routes[i] for i in range(8)] == ["ordering", "multi_hop", "cross_reference", "summary", "temporal", "plain", "temporal" if routes[6] == "temporal" else "plain", "summary"]
    count = {i: sum(r["query_id"] == i for r in got) for i in routes}
    assert count == {0: 4, 1: 4, 2: 4, 3: 4, 4: 2, 5: 2, 6: 2, 7: 4}
    days = [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert days == sorted(days)  # by date
    a = spark.createDataFrame([(2, 6, 9.0)], "query_id long, id long, activation double")
    with_graph = Q.route_search(q, mem, edges, now(), 2, a, q.select("query_id", F.lit(0.9).alias("weight")))
    assert max(with_graph.filter("query_id = 2").collect(), key=lambda r: r["relevance"])["id"] == 6


def test_compress(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 4, 14)
    text = "First sentence here. Filler one is dull. We decided on src/a/b.py today. Filler two is dull as well. The last one."
    rows = [(1, text, None, old, 0), (2, text, None, new, 0), (3, "A gist. More.", text, old, 1), (4, "x", "y", old, 2), (5, text, None, dt.datetime(2024, 4, 5), 0)]
    mem = spark.createDataFrame([(i, c, o, at, 0.1, 0.1, 0, ["t"], n) for i, c, o, at, n in rows], "id int, content string, original_content string, created_at timestamp, importance double, confidence double, access_count int, tags array<string>, compression_level int")
    got = {r["id"]: (r["content"], r["original_content"], r["compression_level"]) for r in M.compress(mem, now()).collect()}
    assert set(got) == {1, 3, 5}
    assert got[1] == ("First sentence here. [t]", text, 2) and got[3] == ("A gist. [t]", text, 2)
    assert got[5][1:] == (text, 1) and got[5][0].startswith("First sentence here.") and len(got[5][0]) < len(text)


def test_backfill(spark):
    mem = spark.createDataFrame([(1, "p", "PostgresBackend and ValueError", None), (2, "p", "nothing", None), (3, "p", "PostgresBackend", None), (4, "p", "PostgresBackend", dt.datetime(2024, 1, 1))], "id long, profile string, content string, expires_at timestamp")
    none = spark.createDataFrame([("PostgresBackend", "entity", 1, "syntactic")], "canonical_name string, entity_type string, mention_count long, evidence_class string")
    links = spark.createDataFrame([(3, "p", "PostgresBackend", "entity")], "memory_id long, profile string, canonical_name string, entity_type string")
    entities, now_links, counts = E.backfill_entities(mem, none, links, now())
    assert tuple(counts.first()) == ("p", 3, 2, 3)
    assert {(r["entity_type"], r["canonical_name"]): r["mention_count"] for r in entities.collect()} == {("entity", "PostgresBackend"): 2, ("entity", "ValueError"): 1, ("error", "ValueError"): 1}
    assert now_links.count() == 4


def test_secrets_of_each_kind(spark):
    """Every pattern of a name and of a bare token, made from the pattern itself."""
    a, d = "Ab1" * 20, "1234567890"
    bare = [
        "ghp_" + a[:36], "gho_" + a[:36], "github_pat_" + a[:20], "glpat-" + a[:20], "AKIA" + "A1" * 8, "SG." + a[:20], "xoxb-" + a[:10], "sk-ant-" + a[:20], "sk-proj-" + a[:20], "sk-" + a[:40], "npm_" + a[:36],
        "pypi-" + a[:20], "whsec_" + a[:20], d + ":" + a[:35], a[:24] + "." + a[:6] + "." + a[:27],
    ]
    assert len(bare) == len(T.SECRET_TOKENS)
    names = ["api_key", "secret-key", "ACCESS_KEY", "access_token", "authtoken", "password", "passwd", "bearer", "token", "sk_live", "sk-proj", "pk_live", "sk_test", "pk_test", "npg_" + a[:10], "pa-" + a[:20], "sb_secret_", "eyJ" + a[:20], "own_live_"]
    texts = [f"see {t} there" for t in bare] + [f"{n}={a[:12]} there" for n in names] + ["redis://me:pw123@host there", "DSN = 'x y' there", "own_live_" + a[:24] + " there"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("t", T.mask_secrets(F.col("t"), ("own_live_",)).alias("m")).collect():
        assert "***MASKED***" in r["m"] and r["m"].endswith("there") and a[:12] not in r["m"].replace(r["t"].split("=")[0], "") and "pw123" not in r["m"], r
    clean = "a token of thanks, the key is under the mat; sk-12 and npm_abc"
    assert spark.createDataFrame([(clean,)], "t string").select(T.mask_secrets(F.col("t"))).first()[0] == clean
