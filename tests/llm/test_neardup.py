import random

import numpy as np
import pytest

from cairn.llm import neardup
from cairn.llm.common import cut
from cairn.llm.components import components, rejoined
from cairn.llm.neardup import near_duplicates
from cairn.llm.queries import op4_neardup
from tests.llm import brute


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def corpus(seed, families=6, size=25):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for f in range(families):
        base = [word() for _ in range(rng.randrange(40, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    boiler = " ".join(word() for _ in range(60))
    docs += [f"{boiler} {' '.join(word() for _ in range(60))}" for _ in range(40)]
    rng.shuffle(docs)
    return list(enumerate(docs))


HARD = [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (1005, "a b c d e"), (1006, "a b c d e f"), (1007, "x " * 20_000), (1008, "x " * 19_000), (1009, "É b"), (1010, "é b")]


@pytest.mark.parametrize("block", [2048, 8])
def test_brute(spark, monkeypatch, block):
    """Also with blocks so small that common keys are refined and split."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = corpus(3) + HARD
    assert result(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute.near(docs)


def test_reference_data(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op4_neardup(spark, sf_dir)) == brute.near(docs)


def test_edges(spark):
    rows = [(7, "same words in both of them", 1), (7, "same words in both of them", 2), (None, "same words in both of them", 3), (None, "other words", 3), (8, "other text of some words here", 4)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 7, False), (7, 7, True), (7, 7, True), (8, 8, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 300)]
    assert dict(components(spark.createDataFrame(chain, "x long, y long")).collect()) == {**dict.fromkeys(range(51), 0), 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("order", ["down", "random"])
def test_long_chains(spark, monkeypatch, order):
    """Chains of several hundred settle in few rounds, in orders that let label 0 move one id a round without hooking."""
    n = 400
    ids = [0, *range(n, 0, -1)] if order == "down" else random.Random(5).sample(range(n + 1), n + 1)
    written = []
    monkeypatch.setattr("cairn.llm.components.cut", lambda df, name: written.append(name) or cut(df, name))
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "x long, y long"))
    assert dict(got.collect()) == dict.fromkeys(range(n + 1), 0)
    assert written.count("labels") <= 16


@pytest.mark.parametrize("size", [(2048, 2**25), (3, 2**25), (2048, 200)])
def test_around_one_centre(spark, monkeypatch, size):
    """Classes of one centre are judged by their differences as by their sets, also where they fall into several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", size[0])
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size[1])
    rng = np.random.default_rng(6)
    fresh = lambda n: np.unique(rng.integers(0, 2**64, n, np.uint64))
    rows, sets, label = [], {}, {}
    for centre in (0, 100):
        core = fresh(100)
        for i in range(centre + 1, centre + 25):
            s = core[rng.random(len(core)) > rng.choice([0.05, 0.2, 0.4])]
            base = next((sets[j] for j in range(i - 1, centre, -1) if rng.random() < 0.3), s)
            sets[i] = np.union1d(base[rng.random(len(base)) > 0.05], fresh(int(rng.integers(0, 20))))
            label[i] = centre if rng.random() < 0.4 else i
            rows.append((i, centre, len(sets[i]), np.setxor1d(sets[i], core).tobytes()))
    labels = spark.createDataFrame(list(label.items()), "id long, label long")
    links = neardup.around_centres(spark.createDataFrame(rows, "id long, centre long, n long, difference binary"), labels, 75)
    got = dict(rejoined(labels, links).collect())
    forest = neardup.Forest()
    for i in sets:
        for j in sets:
            if i // 100 == j // 100 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])):
                forest.join(label[i], label[j])
    assert len(set(got.values())) > 2
    assert {i: got[i] for i in sets} == {i: forest.root(label[i]) for i in sets}


def test_large_group(spark, monkeypatch):
    """Hundreds of edited copies, many of them near the threshold: the links are whole, and their number grows as the group."""
    rng, made = random.Random(8), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([2, 8, 9, 10, 11, 12])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "_likely", lambda *a, f=neardup._likely: made.append(a[0].count()) or f(*a))
    assert result(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute.near(docs)
    assert sum(made) <= 300 * 6
