"""I-Match fingerprints: a document's distinct terms within a band of inverse document frequency, sorted, and hashed
under several randomised subsets of the lexicon (Chowdhury et al. 2002; Kolcz et al. 2004).

A random subset keeps a lexicon term with probability 2**-level. A fixed rate would leave short documents without
terms and give long ones a new hash at every edit, so each document uses the level at which a subset holds about
TERMS of its terms, and the next one, to be comparable with documents of half or twice its size.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import column, mix64, slices, texts_of

SUBSETS = 48
TERMS = 0.7
DIGITS = 5
NONE = "-" * DIGITS


def _terms(text: str) -> list[bytes]:
    return text.encode().lower().split()


def document_frequencies(docs: DataFrame, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """term (a 64-bit hash), n_docs: over all documents. Every task counts first and shuffles only its counts, so a
    term that is in all documents costs a row a task; a task's counts are sent on when they exceed `most` terms."""

    def run(batches):
        import xxhash

        def out(counts):
            return pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts)).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        counts: Counter = Counter()
        for b in slices(batches):
            for text in texts_of(b, "text"):
                counts.update(set(_terms(text)))
                if len(counts) > most:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def lexicon(docs: DataFrame, low: float = 1 / 1000, high: float = 1 / 20, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms that at least `low` (and two documents) and at most `high` of all documents hold.

    There are at most (mean distinct terms of a document) / low of them, however many documents there are: they fit
    in a few MB and are sent to every task.
    """
    n = docs.count()
    band = document_frequencies(docs, text_col).filter(F.col("n_docs").between(max(2, math.ceil(low * n)), max(2, math.floor(high * n))))
    return np.sort(band.select("term").toArrow().column(0).to_numpy().view(np.uint64))


def fingerprint(text: str, words: np.ndarray) -> str:
    """LEVEL:HASHES:HASHES, the hashes of both levels; `empty` for a text without terms.

    A text without terms of the lexicon is fingerprinted by all its terms.
    """
    import xxhash

    all_terms = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set(_terms(text))), np.uint64))
    if not len(all_terms):
        return "empty"
    at = np.searchsorted(words, all_terms)
    known = all_terms[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == all_terms)] if len(words) else all_terms[:0]
    terms = known if len(known) else all_terms
    level = max(0, round(math.log2(len(terms) / TERMS)))
    seeds = mix64(np.arange(SUBSETS, dtype=np.uint64), 21)
    drawn = mix64(terms[:, None] ^ seeds[None, :], 22)
    out = [str(level)]
    for j in (level, level + 1):
        member = drawn >> np.uint64(64 - j) == 0 if j else np.ones(drawn.shape, bool)
        some = member.any(0)
        out.append("".join(xxhash.xxh3_64_hexdigest(terms[member[:, s]].tobytes())[:DIGITS] if some[s] else NONE for s in range(SUBSETS)))
    return ":".join(out)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else, at a level both have, equal subsets over subsets that aren't empty in both; else 0."""
    if a == b:
        return 1.0
    if "empty" in (a, b):
        return 0.0
    (i, *x), (j, *y) = a.split(":"), b.split(":")
    common = max(int(i), int(j))
    if common - min(int(i), int(j)) > 1:
        return 0.0
    x, y = x[common - int(i)], y[common - int(j)]
    pairs = [(x[k : k + DIGITS], y[k : k + DIGITS]) for k in range(0, len(x), DIGITS)]
    seen = [p for p in pairs if p != (NONE, NONE)]
    return sum(p == q for p, q in seen) / len(seen) if seen else 0.0


#: Ranges of ids whose borders are read from the ids' distribution.
RANGES = 4096


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 512) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending id, of the first one after the last.

    Ids are whole numbers. Quantiles of the ids cut them into at most RANGES ranges of about equally many documents, and
    each range is cut into buckets of equal width, for about per_bucket documents; so a far-off id widens no bucket but
    its own range's. Within a bucket, the next row is a window's lead; for its last row it is the first row of the next bucket
    of the range, or of the next range. Null ids come first; rows that repeat an id follow each other by text; a null text
    is empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(RANGES, -(-n // per_bucket)))
    edges = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    cuts = np.unique(np.array(edges, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(1 + np.searchsorted(cuts, ids.to_numpy(), "right"), dtype="int32")

    range_of = F.when(F.col("doc_id").isNull(), 0).otherwise(place(F.coalesce("doc_id", F.lit(0))))
    placed = rows.withColumn("range", range_of)
    spans = {r["range"]: r for r in rows.select("doc_id").withColumn("range", range_of).groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}  # at most RANGES + 1 rows
    if not spans:
        return rows.withColumn("next_text", F.col("text"))
    facts = [(k, r["low"] or 0, max(1, math.ceil(((r["high"] or 0) - (r["low"] or 0) + 1) / r["n"] * per_bucket)), min((x for x in spans if x > k), default=min(spans))) for k, r in spans.items()]
    ranges = docs.sparkSession.createDataFrame(facts, "range int, low long, width long, after_range int")
    placed = placed.join(F.broadcast(ranges), "range").withColumn("bucket", F.coalesce(F.floor((F.col("doc_id") - F.col("low")) / F.col("width")), F.lit(0)).cast("long"))
    ordered = Window.partitionBy("range", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    firsts = placed.groupBy("range", "after_range", "bucket").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "text"))["text"].alias("first"))
    within = firsts.withColumn("following", F.lead("first").over(Window.partitionBy("range").orderBy("bucket")))
    starts = firsts.groupBy(F.col("range").alias("after_range")).agg(F.min(F.struct("bucket", "first"))["first"].alias("of_next"))
    borders = within.join(starts, "after_range").select("range", "bucket", F.coalesce("following", "of_next").alias("first_text"))
    led = placed.select("range", "bucket", "doc_id", "text", F.lead("text").over(ordered).alias("lead"))
    return led.join(borders, ["range", "bucket"]).select("doc_id", "text", F.coalesce("lead", "first_text").alias("next_text"))


def fingerprints(docs: DataFrame, low: float = 1 / 1000, high: float = 1 / 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every text. A null text is empty; equal texts have equal fingerprints."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high, text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("fingerprint", _fingerprint_of(words)("text")).drop("text")


def _fingerprint_of(words):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: fingerprint(t, words.value))

    return run


def edited_fingerprints(docs: DataFrame, low: float = 1 / 1000, high: float = 1 / 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points replaced by as many first ones of the next document. An
    empty table gives an empty table.
    """
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high, text_col))
    out = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        kept: dict[str, str] = {}  # in order of ids, each next text is soon the current one

        def mark(text: str) -> str:
            if text not in kept:
                if len(kept) > 2000:
                    kept.clear()
                kept[text] = fingerprint(text, words.value)
            return kept[text]

        for b in slices(batches):
            rows = []
            for d, text, after in zip(column(b, "doc_id").to_pylist(), texts_of(b, "text"), texts_of(b, "next_text")):
                cut = len(text) // 4
                edited = text[: len(text) - cut] + after[:cut]
                own, other = mark(text), fingerprint(edited, words.value)
                rows.append((d, len(text), edited, own, other, likeness(own, other), likeness(own, mark(after))))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in out.split(", ")])

    return with_next(docs, id_col, text_col).mapInArrow(run, out)
