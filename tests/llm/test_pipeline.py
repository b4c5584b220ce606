import shutil

import pyarrow as pa

import corpus_pipeline
from cairn.llm.common import cut, table
from tests.llm import brute


def test_stages(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, sf_dir))
        at[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == names and docs.schema == before.schema
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    a, b = map(rows, at["line dedup"])
    want = brute.lines(sorted(a.items()))
    assert {d: brute.sha(t) for d, t in b.items()} == {d: w[2] for d, w in want.items()}
    a, b = map(rows, at["MinHash near-dedup"])
    assert set(b) == {d for d, w in brute.near(sorted(a.items())).items() if w[2]}
    a, b = map(rows, at["PII"])
    for d, t in a.items():
        found = brute.pii(t)
        assert bool(found) <= (b[d] != t)
        assert not any(t[i:j] in b[d] for i, k, j in found if k != 2)
    packed = at["best-fit packing"][1]
    assert packed.select("doc_id").distinct().count() == len(b)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, None), (1, "", "en", "s", 0, None), (2, "a text", None, "s", 6, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, host int"
    for n, data in (("odd", rows), ("empty", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{n}").count() == len(data)


def test_near_repeated_and_null_ids(spark, tmp_path):
    """Each row is judged by its own text, and one row of a group stays, whatever ids its rows have."""
    a = " ".join(f"a{i}" for i in range(60))
    edited, b, c = a + " more", " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    rows = [(1, a, 1), (1, a, 1), (5, edited, 2), (5, b, 3), (None, a, 4), (None, c, 5), (None, c, 6), (None, None, 7), (None, "", 8), (9, b, 9)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"))
    got = corpus_pipeline.stage_near(spark, docs, "")
    assert got.schema == docs.schema
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert kept == sorted([(1, a), (5, b), (0, c), (0, ""), (0, "")])


def test_packing_leaves_no_words_behind(spark, tmp_path, monkeypatch):
    """Workers live on for other stages: after packing, none holds the tokenizer and its words."""
    own = shutil.copy(corpus_pipeline.TOKENIZER, tmp_path)
    monkeypatch.setattr(corpus_pipeline, "TOKENIZER", own)
    docs = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 50), i -> sha2(string(id * 50 + i), 256))) as text").repartition(4)

    def held(batches):
        from cairn.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(path == own for path, _ in tokens._ENCODERS)], pa.int64())})

    assert corpus_pipeline.stage_pack(spark, docs, "").count() > 4000
    found = [r["n"] for r in spark.range(4000).repartition(16).mapInArrow(held, "n long").collect()]
    assert len(found) >= 16 and not any(found)
