import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import lines
from cairn.llm.lines import CuckooFilter, LineIndex, dedup_lines
from cairn.llm.queries import op8_lines
from tests.llm import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()}


HARD = [
    (1, "A common line of many words\nown line one"), (2, "  a COMMON line of many words\t\nx\n\n"), (3, "A common line of many words"),
    (9, "A common line of many words\nA common line of many words"), (4, None), (5, ""), (6, "É" * 19 + "\n" + "É" * 20), (7, "É" * 20), (8, "É" * 20 + "\n" + "É" * 19),
    (10, "é" * 20), (11, "line " * 20_000 + "\nA common line of many words"),
]


@pytest.mark.parametrize("sent", [2**25, 0])
def test_brute(spark, monkeypatch, sent):
    """Also with filters that meet their postings in a shuffle, in small groups."""
    monkeypatch.setattr(lines, "MOST_FILTER_BYTES", sent)
    monkeypatch.setattr(lines, "GROUP", 2)
    assert result(dedup_lines(frame(spark, HARD))) == brute.lines(HARD)


def test_reference_data(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in op8_lines(spark, sf_dir).collect()} == brute.lines(docs)


def test_reversible(spark):
    docs, more = frame(spark, HARD[:6]), frame(spark, HARD[6:])
    index = LineIndex.build(docs)
    both = index.insert(more)
    assert result(dedup_lines(docs.unionByName(more), both)) == brute.lines(HARD)
    back = both.delete(more.select("doc_id"))
    assert result(dedup_lines(docs, back)) == brute.lines(HARD[:6])
    held = [CuckooFilter.load(bytes(r[0])).holds(np.array([k[0] for k in both.refs.filter("n_docs >= 3").select("high").collect()])) for r in back.filters.select("filter").collect()]
    was = back.refs.filter("n_docs >= 3").count()
    assert sum(h.sum() for h in held) <= was + 1


def test_changes_write_what_they_touch(spark, monkeypatch):
    """A small change to a large state writes few rows, and any series of changes gives the state of building anew."""
    docs = [(i, f"the common line of all of them\nline number {i // 4} of some\nown line number {i}") for i in range(400)]
    state = LineIndex.build(frame(spark, docs))
    written = []
    cut = lines.cut
    monkeypatch.setattr(lines, "cut", lambda df, name, **more: written.append((name, (out := cut(df, name, **more)).count())) or out)
    state = state.insert(frame(spark, [(400, "line number 3 of some\na new line that is long"), (401, "line number 3 of some")]))
    state = state.delete(spark.createDataFrame([(12,), (401,), (399,), (None,)], "doc_id long"))
    assert sum(n for _, n in written) < 60
    left = [(i, t) for i, t in [*docs, (400, "line number 3 of some\na new line that is long")] if i not in (12, 399)]
    fresh, now = LineIndex.build(frame(spark, left)), state.compact()
    for one in (state, now):
        assert sorted(map(tuple, one.refs.collect())) == sorted(map(tuple, fresh.refs.collect()))
        assert sorted(map(tuple, one.postings.collect())) == sorted(map(tuple, fresh.postings.collect()))
    assert result(dedup_lines(frame(spark, left), state)) == brute.lines(left)


def test_growth(spark, monkeypatch):
    """An index that grows tenfold still answers most lines from its filters, before and after compacting, and equals building anew."""
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 400)
    docs = lambda a, b: [(3 * i + j, f"a line that three documents have {i}\na line of one document only {3 * i + j}") for i in range(a, b) for j in range(3)]
    state = LineIndex.build(frame(spark, docs(0, 200)), parts=4)
    for lo in range(200, 2000, 600):
        state = state.insert(frame(spark, docs(lo, lo + 600)))
    small = state.compact()
    assert state.shards == 1 and small.shards == 6
    for one in (state, small):
        loaded = [CuckooFilter.load(bytes(r["filter"])) for r in one.filters.collect()]
        assert not any(f.full for f in loaded) and len(loaded) == one.shards
        passed = lines.may_repeat(one.postings, one.filters, one.shards).count()
        assert 6000 <= passed < 6000 + 60  # three postings for each of 2,000 lines, of 12,000 in all
    rows = docs(0, 2000)
    fresh = LineIndex.build(frame(spark, rows))
    assert sorted(map(tuple, small.refs.collect())) == sorted(map(tuple, fresh.refs.collect()))
    gone = state.delete(spark.createDataFrame([(0,), (5,)], "doc_id long"))
    left = [r for r in rows if r[0] not in (0, 5)]
    assert result(dedup_lines(frame(spark, left), gone)) == brute.lines(left)


def test_parts_and_repeated_ids(spark):
    """Deleting reads the folders of its ids only; an id that is inserted again counts again, and goes as a whole."""
    first, again = [(i, "a line that all of them have") for i in range(40)], [(7, "a line that all of them have"), (7, "another line of number seven")]
    state = LineIndex.build(frame(spark, first), parts=8).insert(frame(spark, again))
    fresh = LineIndex.build(frame(spark, first + again))
    assert sorted(map(tuple, state.refs.collect())) == sorted(map(tuple, fresh.refs.collect()))
    read = state.postings.filter(F.col("part") == 3)
    assert read._jdf.queryExecution().toString().count("PartitionFilters: [isnotnull(part") == 2  # what was built, and what was inserted
    back = state.delete(spark.createDataFrame([(7,)], "doc_id long"))
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, LineIndex.build(frame(spark, [r for r in first if r[0] != 7])).refs.collect()))


def test_cuckoo():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    f = CuckooFilter.sized(len(keys))
    f.insert(keys)
    assert not f.full and f.holds(keys).all()
    f.delete(keys[:10_000])
    again = CuckooFilter.load(f.dump())
    assert again.holds(keys[10_000:]).all() and again.holds(keys[:10_000]).mean() < 0.01
    small = CuckooFilter(np.zeros((4, 4), np.uint16))
    small.insert(keys[:100])
    assert small.full and small.holds(keys).all()


def test_edges(spark):
    empty = dedup_lines(frame(spark, []))
    assert empty.count() == 0
    rows = [(1, "the same long line in each", 5, "a"), (1, "the same long line in each", 5, "a"), (None, "the same long line in each", 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys int, n_lines string")
    got = sorted((r["doc_id"] or 0, r["n_dropped"], r["text"], r["keys"]) for r in dedup_lines(df).collect())
    assert got == [(0, 1, "", 6), (1, 0, rows[0][1], 5), (1, 0, rows[0][1], 5)]
