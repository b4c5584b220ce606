import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cairn.llm import lexical
from cairn.llm.queries import op12_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, queries, k=10):
    """Every query against every document, by the formula."""
    words = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    out = []
    for q, text in queries:
        scores = []
        for i, c in rows:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // max(1, total)
            s = sum(weight(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(q, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


def corpus(n=600, seed=3):
    """Texts in three vocabularies with common words, so that clusters and rare terms matter; copies and ties."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        topic = rng.randrange(3)
        words = [rng.choice(["the", "of", "Und", "de"]) if rng.random() < 0.4 else f"{'abc'[topic]}{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randint(1, 60))]
        docs.append((i, rng.choice([" ", ", ", "-\n"]).join(words)))
    docs += [(n + i, docs[5][1]) for i in range(30)] + [(n + 30, None), (n + 31, ""), (n + 32, "é ÉÉ b1é x_y"), (n + 33, "?! .")]
    queries = [(q, " ".join(rng.choice(docs[:n])[1].split()[:12])) for q in range(25)] + [(100, None), (101, "nowhere"), (102, "the the THE of"), (103, docs[5][1]), (104, "É É b1É x y")]
    return docs, queries


@pytest.mark.parametrize("block,few,common,size", [(64, 4, 1 / 16, 4096), (3, 1, 1 / 2, 200), (5, 2, 1 / 50, 97), (2, 1, 2.0, 5000)])
def test_against_plain(monkeypatch, block, few, common, size):
    """Segments and blocks of many sizes, in one process: the same rows as the formula over all pairs."""
    for name, value in (("BLOCK", block), ("FEW", few), ("COMMON", common)):
        monkeypatch.setattr(lexical, name, value)
    docs, queries = corpus()
    words = [Counter(lexical.terms_of(t or "")) for _, t in docs]
    asked = [Counter(lexical.terms_of(t or "")) for _, t in queries]
    vocabulary = sorted({t for c in asked for t in c})
    number = {t: i for i, t in enumerate(vocabulary)}
    n_docs, total = sum(bool(c) for c in words), sum(sum(c.values()) for c in words)
    df = Counter(t for c in words for t in c)
    stats = lexical.Statistics(n_docs, total, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in vocabulary]))
    best = [lexical.Best(10) for _ in queries]
    met = scored = 0
    for lo in range(0, len(docs), size):
        part = [[(number[t], n) for t, n in c.items() if t in number] for c in words[lo : lo + size]]
        flat = np.array([x for p in part for x in p], np.int64).reshape(-1, 2)
        own = lexical.segment(np.array([i for i, _ in docs[lo : lo + size]]), np.array([sum(c.values()) for c in words[lo : lo + size]]), np.array([len(p) for p in part]), flat[:, 0], flat[:, 1], stats)
        for c, b in zip(asked, best):
            terms = np.array(sorted(number[t] for t in c), np.int64)
            dense = np.zeros(len(vocabulary))
            a, z = lexical.search_segment(own, terms, np.array([c[vocabulary[t]] for t in terms]) * stats.weights[terms], b, dense)
            met, scored = met + a, scored + z
            assert not dense.any()
    got = [(q, r + 1, int(i), int(s)) for (q, _), b in zip(queries, best) for r, (i, s) in enumerate(zip(b.ids, b.scores))]
    assert sorted(got, key=str) == plain(docs, queries)
    if block == 3:
        assert scored < met  # summaries do skip blocks


def test_bounds_hold():
    """A summary with the segment's maxima of common terms is never under a document's score."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 12, 300)
    terms = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in sizes])
    stats = lexical.Statistics(300, 9000, rng.integers(100, 9000, 40))
    own = lexical.segment(np.arange(300), sizes * 3, sizes, terms, rng.integers(1, 5, len(terms)), stats)
    again = lexical.unpack(lexical.pack(own))
    assert all((own[p] == again[p]).all() and own[p].dtype == again[p].dtype for p in lexical.PARTS)
    assert sorted(own["block_docs"][own["block_ptr"][own["list_ptr"][0]] : own["block_ptr"][own["list_ptr"][1]]]) == sorted(np.flatnonzero([0 in terms[a:b] for a, b in zip(own["row_ptr"], own["row_ptr"][1:])]))
    for _ in range(20):
        w = rng.integers(0, 3, 40) * stats.weights
        base = (w[own["common_terms"]] * own["common_max"]).sum()
        for b in range(len(own["block_ptr"]) - 1):
            docs = own["block_docs"][own["block_ptr"][b] : own["block_ptr"][b + 1]]
            if len(docs) >= lexical.FEW:
                a, z = own["summary_ptr"][b], own["summary_ptr"][b + 1]
                bound = base + lexical.UNIT * (w[own["summary_terms"][a:z]] * own["summary_max"][a:z].astype(int)).sum()
                assert all((w[terms[x:y]] * own["impacts"][x:y]).sum() <= bound for x, y in zip(own["row_ptr"][docs], own["row_ptr"][docs + 1]))


def test_maxima():
    rng = np.random.default_rng(2)
    for blocks, names in ((3, 5), (2000, 30000)):  # a dense table, and sorting
        b, t, v = rng.integers(0, blocks, 500), rng.integers(0, names, 500), rng.integers(1, 99, 500).astype(np.int32)
        want = {}
        for x, y, z in zip(b.tolist(), t.tolist(), v.tolist()):
            want[x, y] = max(z, want.get((x, y), 0))
        assert [((x, y), z) for x, y, z in zip(*(c.tolist() for c in lexical._maxima(b, t, v, blocks)))] == sorted(want.items())


def test_query_and_blocks_of_queries(spark, tmp_path, monkeypatch):
    """The registered query over odd rows, also with queries in several blocks."""
    docs, queries = corpus()
    docs += [(None, docs[7][1]), (8, docs[8][1])]  # a null id, a repeated row
    queries += [(None, "a1 b2"), (3, queries[4][1])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(q, t, 1) for q, t in queries], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain(docs, queries)
    assert sorted(map(tuple, op12_search(spark, str(tmp_path)).collect()), key=str) == want
    monkeypatch.setattr(lexical, "MOST_PAIRS", 120)
    monkeypatch.setattr(lexical, "SEGMENT", 256)
    assert sorted(map(tuple, op12_search(spark, str(tmp_path)).collect()), key=str) == want


def test_empty_tables(spark):
    docs, queries = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), queries).count() == 0 and lexical.search(docs, queries.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(docs, queries).collect()] == [(1, 1, 1)]
