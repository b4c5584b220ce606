import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairn.llm.queries import op6_segment
from cairn.llm import segment
from cairn.llm.segment import Vocabulary, sample, segmentations

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every(vocabulary, text):
    """All segmentations with their probabilities."""
    def go(i):
        if i == len(text):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(text) + 1):
            if found := vocabulary.pieces.get(text[i:j]):
                out += [((found[0], *ids), found[1] + w) for ids, w in go(j)]
        if text[i] not in vocabulary.pieces:
            raw = [vocabulary.bytes[b] for b in text[i].encode()]
            out += [(tuple(x for x, _ in raw) + ids, sum(w for _, w in raw) + w2) for ids, w2 in go(i + 1)]
        return out
    found = go(0)
    total = math.log(sum(math.exp(w) for _, w in found))
    return {ids: math.exp(w - total) for ids, w in found}


def plain_logp(vocabulary, text, ids):
    """The log-probability of a whole text's segmentation, character by character."""
    after, text = [0.0], " " + text
    for i in range(len(text) - 1, -1, -1):
        ways = [found[1] + after[-n] for n in range(1, min(17, len(text) - i + 1)) if (found := vocabulary.pieces.get(text[i : i + n]))]
        if text[i] not in vocabulary.pieces:
            ways.append(sum(vocabulary.bytes[b][1] for b in text[i].encode()) + after[-1])
        top = max(ways)
        after.append(top + math.log(sum(math.exp(w - top) for w in ways)))
    weight = {i: w for i, w in [*vocabulary.pieces.values(), *vocabulary.bytes.values()]}
    return sum(weight[i] for i in ids) - after[-1]


@pytest.mark.parametrize("short", [48, 0])
def test_probabilities(monkeypatch, short):
    """Edges' probabilities, reckoned as products or by logarithms, against all segmentations and whole texts."""
    monkeypatch.setattr(segment, "SHORT", short)
    v = Vocabulary(MODEL)
    texts = ["in her ▁a", "of", "", "é\u3042\U0001F600 ok", "a" * 200 + " b", "word\nnext, \t \x00", "日本語 text " * 5, "é" * 60, "\U0001F600" * 45]
    for t, (found, _) in zip(texts, sample(v, texts, np.arange(len(texts), dtype=np.uint64), 3)):
        for ids, logp, _ in found:
            assert abs(logp - plain_logp(v, t, ids.tolist())) < 1e-6
        assert v.decode(np.concatenate([x for x, *_ in found]), np.array([len(x) for x, *_ in found])) == [t] * len(found)


def test_sampling_without_replacement():
    lattice = Vocabulary(MODEL, sharpness=0.4)
    text = "in her ▁a"
    p = every(lattice, " " + text)
    assert len(p) > 20
    n, k = 6000, 3
    got = sample(lattice, [text] * n, np.arange(n, dtype=np.uint64) * np.uint64(2**33 + 7), k)
    first, second, total = Counter(), Counter(), Counter()
    for found, after in got:
        ids = [tuple(x.tolist()) for x, _, _ in found]
        assert len(set(ids)) == k and all(i in p for i in ids)
        assert all(abs(math.exp(logp) - p[i]) < 1e-9 for i, (_, logp, _) in zip(ids, found))
        values = [v for *_, v in found] + [after]
        assert values == sorted(values, reverse=True)
        first[ids[0]] += 1
        second[ids[1]] += 1
        for i, (_, logp, _) in zip(ids, found):
            total[i] += 1 / -math.expm1(-math.exp(logp - after))  # unbiased for 1
    for ids, q in p.items():
        want2 = q * sum(r / (1 - r) for other, r in p.items() if other != ids)
        assert abs(first[ids] / n - q) < 5 * math.sqrt(q / n) + 1e-3
        assert abs(second[ids] / n - want2) < 5 * math.sqrt(want2 / n) + 1e-3
    assert abs(sum(total[i] * p[i] for i in p) / n - 1) < 0.05


def test_all_of_few():
    lattice = Vocabulary(MODEL)
    for text in ("", "a", "of"):
        p = every(lattice, " " + text)
        (found, after), = sample(lattice, [text], np.array([5], np.uint64), len(p) + 2)
        assert {tuple(x.tolist()) for x, *_ in found} == set(p) and after == -math.inf


def test_round_trip(spark):
    texts = ["a  b\nc\tÉ x ", "", None, "▁ ▁▁a", "\U0001F600\u0000 ok", " lead", "x" * 3000, "word " * 20_000, "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = segmentations(df, MODEL, k=2).collect()
    for r in got:
        assert r["decoded"] == (texts[r["doc_id"]] or "")
        assert math.isfinite(r["log_inclusion"]) and r["log_inclusion"] <= 0
    ids = {}
    for r in got:
        ids.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
    assert all(len(set(v)) == len(v) for v in ids.values()) and len(ids) == len(texts)
    again = {(r["doc_id"], r["rank"]): r["ids"] for r in segmentations(df.repartition(3), MODEL, k=2).collect()}
    assert again == {(r["doc_id"], r["rank"]): r["ids"] for r in got}
    assert segmentations(df.limit(0), MODEL).count() == 0


def test_query(spark, sf_dir):
    """The query's rows against each text's own probabilities, and its digests."""
    got = op6_segment(spark, sf_dir)
    texts = {d: t or "" for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert len(texts) < len(rows) <= 2 * len(texts) and all(r["exact"] for r in rows)
    assert {r["doc_id"] for r in rows} == set(texts)
    own = {(r["doc_id"], r["rank"]): r for r in segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), MODEL, k=2).collect()}
    v = Vocabulary(MODEL)
    for r in rows:
        ids = own[r["doc_id"], r["rank"]]["ids"]
        assert r["n_pieces"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        if len(texts[r["doc_id"]]) < 3000:
            assert abs(r["log_probability"] - plain_logp(v, texts[r["doc_id"]], ids)) < 1e-6 * (1 + len(ids))


def test_odd_rows(spark):
    """Repeated rows have equal samples; null ids and clashing columns change nothing."""
    rows = [(1, "same text", 1), (1, "same text", 2), (None, "same text", 3), (None, None, 4)]
    got = segmentations(spark.createDataFrame(rows, "doc_id long, text string, rank int"), MODEL).collect()
    assert sorted(Counter(r["doc_id"] for r in got).items(), key=str) == [(1, 4), (None, 3)]
    assert len({(r["rank"], tuple(r["ids"])) for r in got if r["doc_id"] == 1}) == 2
