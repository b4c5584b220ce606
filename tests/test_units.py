"""Single operators on small inputs, with expected values from the blueprint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.operators import graph as G
from cairn.operators import ingest as I
from cairn.operators import linking as L
from cairn.operators import maintain as M
from cairn.operators import rerank as R
from cairn.operators import search as S
from cairn.operators import triples as E
from cairn.sources import exchange as O

NOW = "2024-04-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def test_strengthen(spark):
    sets = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 1), (3, 9), (4, 2), (4, 3)], "set_id int, id int")
    edges = spark.createDataFrame([(1, 2, "related", 0.5)], "source_id int, target_id int, relationship string, strength double")
    got = {(r[0], r[1]): round(r[2], 6) for r in L.strengthen_edges(sets, edges).collect()}
    assert got == {(1, 2): round(0.5 * 1.01**2, 6), (2, 3): 0.1}


def test_lifecycle(spark):
    life = spark.createDataFrame([(1, "p", "fresh", "2024-04-14 22:00:00"), (2, "p", "fresh", "2024-04-14 23:30:00"), (3, "p", "editing", "2024-04-14 23:30:00")], "memory_id int, profile string, stage string, t string").withColumn("stage_entered_at", F.to_timestamp("t"))
    mem = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.5, 0.1), (3, 0.0, 0.0)], "id int, surprise double, importance double")
    assert {r[0]: r[2] for r in M.advance_lifecycle(life, mem, now()).collect()} == {1: "stable", 2: "fresh", 3: "stable"}


def test_supersede(spark):
    results = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (1, 5, 0.05)], "query_id int, id int, relevance double")
    mem = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 1), (5, 1)], "id int, d int").withColumn("created_at", F.timestamp_seconds(F.col("d") * 86400))
    edges = spark.createDataFrame([(1, 2, "contradicts"), (3, 1, "contradicts"), (4, 5, "contradicts")], "source_id int, target_id int, relationship string")
    got = [(r["id"], r["superseded_by"]) for r in R.supersede(results, edges, mem).orderBy("rank").collect()]
    assert got == [(2, None), (5, None), (1, 3)]


def test_query_join(spark):
    edges = spark.createDataFrame([("A", "DEPENDS_ON", "B", "p"), ("B", "OWNS", "C", "p"), ("C", "OWNS", "A", "p")], "subject string, predicate string, object string, profile string")
    starts = spark.createDataFrame([("A", "p"), ("B", "p")], "start string, profile string")
    got = [tuple(r)[2:] for r in E.query_join(starts, ["DEPENDS_ON", "OWNS"], edges).orderBy("hop").collect()]
    assert got == [(1, "A", "DEPENDS_ON", "B"), (2, "B", "OWNS", "C")]


def test_gist():
    text = "First one here. " + " ".join(f"Filler number {i} says little." for i in range(20)) + " We decided to use it. ```code``` The end."
    short = T.gist(text)
    assert short.startswith("First one here.") and "The end." in short and "```code```" in short and "decided" in short and len(short) < len(text)
    assert T.gist("One. Two. Three.") == "One. Two. Three."


def test_message_text(spark):
    df = spark.createDataFrame([("flat", [("text", "a")]), ("", [("text", "a"), ("image", "x"), ("text", "b")]), (None, [])], "text string, blocks array<struct<type:string,text:string>>")
    assert [r[0] for r in df.select(T.message_text(F.col("text"), F.col("blocks"))).collect()] == ["flat", "a\n\nb", ""]


def test_channel_cursor(spark):
    df = spark.createDataFrame([("c", "9.000002"), ("c", "10.000001"), ("c", "bad"), ("d", "1.5")], "channel string, ts string")
    assert {r[0]: (r[1], r[2]) for r in L.channel_cursor(df).collect()} == {"c": (10, 1), "d": (1, 5)}


def test_turn_pairs(spark):
    long = "an answer that is long enough to be kept by the filter of short ones"
    rows = [(1, 0, "human", "first"), (1, 1, "human", "second question?"), (1, 2, "tool", "x"), (1, 3, "assistant", long), (1, 4, "assistant", long), (1, 5, "human", "Thanks!"), (1, 6, "assistant", long)]
    got = I.conversation_turn_pairs(spark.createDataFrame(rows, "conv_id int, turn int, sender string, text string")).collect()
    assert [(r["turn_index"], r["user_prompt"]) for r in got] == [(0, "second question?")]


def test_cover_density():
    assert S.cover_density([[0, 10]]) == pytest.approx(0.2)
    assert S.cover_density([[0, 9], [1, 5]]) == pytest.approx(0.1 / 1 + 0.1 / (1 + 3))


def test_masking(spark):
    cases = {"set api_key=abcdefgh1234 now": "set api_key=***MASKED*** now", "https://u:secret@h/": "https://***MASKED***:***MASKED***@h/", "dsn = x.y": "dsn = ***MASKED***", "AKIA" + "A" * 16 + ".": "***MASKED***.", "clean": "clean"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.mask_secrets(F.col("t"))).collect()} == cases


def test_dates(spark):
    ref = F.lit("2024-04-15").cast("date")  # a Monday
    cases = {"2024/3/9 and 2024-02-03": ["2024-02-03", "2024-3-9"], "March 5th, 2024 or 6 Jan 2023": ["2023-01-06", "2024-03-05"], "3 days ago": ["2024-04-12"], "last monday": ["2024-04-08"], "next friday": ["2024-04-19"], "in 2 weeks": ["2024-04-29"], "nothing": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.extract_dates(F.col("t"), ref)).collect()} == cases


def test_queries(spark):
    q = F.col("t")
    kinds = {"what is the order of things": "ordering", "how many days between a and b": "multi_hop", "how many different cars are there": "cross_reference", "across my sessions": "multi_hop", "overview of everything": "summary", "which one came earlier": "multi_hop", "what was last week": "temporal", "blue car": "plain"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.classify_query(q)).collect()} == kinds
    df = spark.createDataFrame([("between the wedding and my trip?",), ("days since lunch did it rain",), ("none",)], "t string")
    assert [r[0] for r in df.select(T.query_anchors(q)).collect()] == [["wedding", "trip"], ["lunch"], []]
    df = spark.createDataFrame([("What did Anna say about the 'red car' garage?",), ("abc",)], "t string")
    assert [r[0] for r in df.select(T.reformulate_query(q)).collect()] == ["red car Anna garage", "abc"]


@pytest.mark.parametrize("block", [4096, 8])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_topk_equals_brute_force(spark, monkeypatch, block, kind):
    """Queries sent around, or both sides dealt into pairs of blocks; with ties, a minimum and a weight."""
    import numpy as np

    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "ROWS", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x[60:70] = x[50]
    of = (lambda i: i) if kind == "long" else str
    rows = [(of(i), ("p", "q", None)[min(i % 3, 1 + (i == 2))], v.tolist(), 1.0 + i % 4) for i, v in enumerate(x)]
    mem = spark.createDataFrame([*rows, (of(500), "p", None, 1.0)], f"id {kind}, profile string, embedding array<float>, w double")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for weight in (None, "w"):
        found = V.topk(mem.select(F.col("id").alias("query_id"), "profile", "embedding"), mem, 4, 0.2, weight)
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], []).append((-round(r["similarity"] * (r["score"] / r["similarity"] if weight else 1), 6), r["id"]))
        for i in range(120):
            all_ = sorted((-round(s * (rows[j][3] if weight else 1), 6), of(j)) for j in range(120) if rows[i][1] is not None and rows[j][1] == rows[i][1] and (s := round(float(u[i] @ u[j]), 6)) > 0.2)
            assert sorted(got.get(of(i), []))[:4] == all_[:4]


def test_cosine_in_sql(spark):
    V.register(spark)
    got = spark.sql("SELECT cosine_similarity(array(1.0, 0.0), array(1.0, 1.0)) a, cosine_similarity(array(0.0), array(1.0)) b, cosine_similarity(NULL, array(1.0)) c").first()
    assert round(got["a"], 6) == 0.707107 and got["b"] is None and got["c"] is None


def test_walks(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.6), (1, 3, 0.5), (3, 4, 0.4)], "source_id int, target_id int, strength double")
    mem = spark.createDataFrame([(i, None) for i in range(1, 5)], "id int, expires_at timestamp")
    starts = spark.createDataFrame([(1,)], "start int")
    assert [(r["id"], r["depth"]) for r in G.related_memories(starts, edges, mem, now(), 3).orderBy("rank").collect()] == [(2, 1), (3, 1)]
    seeds = spark.createDataFrame([(7, 1, 1.0)], "query_id int, id int, relevance double")
    got = {r["id"]: round(r["relevance"], 3) for r in G.explore_graph(seeds, edges, mem, now(), 2).collect()}
    assert got == {1: 1.0, 2: 0.9, 3: 0.54}


def test_mmr(spark):
    rows = [(1, 1, 1.0, "a b c"), (1, 2, 0.9, "a b c"), (1, 3, 0.5, "x y z")]
    got = R.mmr_rerank(spark.createDataFrame(rows, "query_id int, id int, relevance double, content string"), 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3]


def test_embed_corpus(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "id int, content string")
    cache = spark.createDataFrame([], "key string, embedding array<float>")
    got = L.embed_corpus(df, cache, lambda s: pd.Series([[float(len(x)), 1.0] for x in s]), 2, "m")
    assert {r["id"]: list(r["embedding"]) for r in got.collect()} == {1: [1.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0]}


def test_notes_and_exports(spark, tmp_path):
    (tmp_path / "n" / ".hidden").mkdir(parents=True)
    (tmp_path / "n" / "a.md").write_text("---\ntags: [x, 'y']\n---\n\nBody  \r\nline\n")
    (tmp_path / "n" / "b.md").write_text("---\ntags:\n  - p\n  - q\n---\nOther")
    (tmp_path / "n" / "empty.md").write_text("")
    (tmp_path / "n" / ".hidden" / "c.md").write_text("no")
    got = sorted((r["content"], r["tags"]) for r in O.read_notes(spark, str(tmp_path / "n")).collect())
    assert got == [("Body\nline", ["x", "y"]), ("Other", ["p", "q"])]
    mem = spark.createDataFrame([("1", "p", "text", ["a"], "s", dt.datetime(2024, 1, 2))], "id string, profile string, content string, tags array<string>, source string, created_at timestamp")
    assert O.export_markdown(mem).first()["text"] == "## 2024-01-02\n\n**Tags:** a\n\n**Source:** s\n\ntext\n\n---"
    O.write_memory_export(mem, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "e.json").write_text('{"profile": "p", "count": 1, "memories": [{"id": "1", "content": "c"}]}')
    assert [(r["id"], r["profile"]) for r in O.read_memory_export(spark, str(tmp_path / "e.json")).collect()] == [("1", "p")]
    pages = spark.createDataFrame([("p", "alpha", "see beta and `beta`, not alpha", 2), ("p", "beta", "none", 1)], "profile string, topic_key string, content string, source_count int")
    assert {r["slug"]: r["text"].split("\n\n")[1] for r in O.write_topic_pages(pages).collect()} == {"alpha": "see [[beta]] and `beta`, not alpha", "beta": "none"}


def test_mappers(spark):
    raw = spark.createDataFrame([("c", "1.5", "hi", None), ("c", "x", "hi", None), ("c", "2.5", " ", None), ("c", "3.5", "joined", "join")], "channel string, ts string, text string, subtype string")
    assert [r["key"] for r in I.map_slack(raw).collect()] == ["c:1.5"]
    issues = spark.createDataFrame([(1, "T", "B", [("bug",)], None), (2, "", "", [], None), (3, "P", "", [], "url")], "id int, title string, body string, labels array<struct<name:string>>, pull_request string")
    assert [tuple(r) for r in I.map_github(issues).collect()] == [("issue:1", "T\n\nB", ["bug"])]


def test_web_queries(spark):
    """Words, phrases, exclusions and alternatives against a plain reading of each text."""
    import re

    texts = ["the red car drove", "car red", "red cars and a blue boat", "blue boat", "a red boat", "boats driving red-car", ""]
    queries = ["red car", '"red car"', "red -boat", "red or boat", '-"red car" red', '"blue boat" or car -drove', "-red", "red-car", "none red"]
    mem = spark.createDataFrame([(i, "p", t, None) for i, t in enumerate(texts)], "id int, profile string, content string, expires_at timestamp")
    asked = spark.createDataFrame([(i, "p", t) for i, t in enumerate(queries)], "query_id int, profile string, text string")
    got = {}
    for r in S.keyword_topk(asked, mem, now(), 10, "web").collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["keyword_rank"]
    split = lambda t: re.findall(r"\w+", t.lower())
    for q, text in enumerate(queries):
        want = {}
        for i, t in enumerate(texts):
            words, total = split(t), 0.0
            for side in re.split(r"\s+or\s+", text):
                starts, bad, only = [], False, True
                for part in re.findall(r'-?"[^"]*"|\S+', side):
                    atom = split(part)
                    at = [p for p in range(len(words)) if words[p : p + len(atom)] == atom]
                    if part.startswith("-"):
                        bad |= bool(at)
                    else:
                        only = False
                        starts.append(at)
                if not only and not bad and all(starts):
                    total += S.cover_density(starts)
            if total:
                r = total / len(words)
                want[i] = round(r / (r + 1), 6)
        assert got.get(q, {}) == want, text
    stemmed = {(r["query_id"], r["id"]) for r in S.keyword_topk(asked, mem, now(), 10, "stemmed").collect()}
    assert {(0, 2), (0, 5), (3, 5)} <= stemmed


def test_time_ranges(spark):
    d = lambda *x: dt.date(*x)
    want = {
        "what was between 2024-01-05 and yesterday?": (d(2024, 1, 5), d(2024, 4, 14)), "from 2023-1-2 to 2023-02-03": (d(2023, 1, 2), d(2023, 2, 3)), "two months ago": (d(2024, 2, 0 + 1), d(2024, 3, 31)),
        "a week ago": (d(2024, 4, 5), d(2024, 4, 15)), "3 years ago": (d(2021, 4, 12), d(2021, 4, 19)), "three years ago": (d(2021, 1, 1), d(2021, 12, 31)), "what did I do yesterday": (d(2024, 4, 11), d(2024, 4, 18)), "in June": (d(2023, 6, 1), d(2023, 6, 30)),
        "last February": (d(2023, 2, 1), d(2023, 2, 28)), "in February": (d(2024, 2, 1), d(2024, 2, 29)), "bought 3 in 2024 years": None, "nothing": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r[0]: r[1] and tuple(r[1]) for r in df.select("t", T.resolve_time_range(F.col("t"), F.lit("2024-04-15").cast("date"))).collect()}
    want["two months ago"] = (d(2024, 4, 15) - dt.timedelta(75), d(2024, 4, 15) - dt.timedelta(15))
    assert got == want


def test_memory_files_and_trackers(spark, tmp_path):
    (tmp_path / "home-x-proj").mkdir()
    root = tmp_path / "home-x-proj"
    (root / "a.md").write_text("---\nname: One\ntype: user\noriginSessionId: 'q'\n---\n\nBody line\n\n")
    (root / "b.md").write_text("---\ndescription: d\n---\nOther")
    (root / "MEMORY.md").write_text("---\nname: index\n---\nList")
    (root / "c.md").write_text("no front matter")
    (root / "d.md").write_text("---\nname: x\n---\n\n")
    got = sorted((r["content"], r["tags"]) for r in O.read_memory_files(spark, str(tmp_path)).collect())
    assert got == [("Body line", ["source:agent-memory", "type:user", "project:proj"]), ("Other", ["source:agent-memory", "type:unknown", "project:proj"])]
    assert O.read_memory_files(spark, str(tmp_path), project="p").first()["tags"][-1] == "project:p"
    beads = spark.createDataFrame([("b-1", "T", None, ["x", "", None], "open", 1, "bug", None), (None, "T", "", None, None, None, None, None), ("b-2", "", " ", None, None, None, None, None)], "id string, title string, description string, labels array<string>, status string, priority int, issue_type string, assignee string")
    assert [(r["key"], r["content"], r["tags"]) for r in I.map_beads(beads).collect()] == [("issue:b-1", "T", ["x"])]
    comments = spark.createDataFrame([(1, "hi", 7), (None, "x", 7), (2, "", 7)], "id int, body string, issue int")
    assert [(r["key"], r["content"], r["issue"]) for r in I.map_comments(comments).collect()] == [("comment:1", "hi", 7)]


def test_graph_bundle(spark):
    concepts = spark.createDataFrame([("a", "A", "file", "p", ["x", "y"]), ("b", "B", "file", "p", ["x", ""]), ("c", "C", "file", "p", None)], "path string, canonical_name string, entity_type string, profile string, aliases array<string>")
    wanted = spark.createDataFrame([("a", "PART_OF", "b"), ("a", "PART_OF", "b"), ("a", "LIKES", "b"), ("a", "PART_OF", "zz"), ("a", "PART_OF", "a"), ("b", "PART_OF", "c")], "path string, predicate string, target_path string")
    entities = spark.createDataFrame([("A", "file"), ("B", "error")], "canonical_name string, entity_type string")
    edges = spark.createDataFrame([("file:B", "PART_OF", "file:C", None)], "subject string, predicate string, object string, valid_to timestamp")
    aliases = spark.createDataFrame([("y", "p"), ("x", "q")], "alias string, profile string")
    got = E.graph_bundle_changes(concepts, wanted, entities, edges, aliases, ["PART_OF"])
    assert sorted(map(tuple, got["entities"].collect())) == [("B", "file"), ("C", "file")]
    assert [tuple(r) for r in got["aliases"].collect()] == [("x", "p", "A", "file")]
    assert [tuple(r) for r in got["edges"].collect()] == [("file:A", "PART_OF", "file:B")]
    assert dict(map(tuple, got["counts"].collect())) == {"written": 2, "unknown_predicate": 1, "missing_object": 1, "self": 1, "already_present": 1, "created": 2, "matched": 1, "aliases": 1}
