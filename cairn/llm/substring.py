"""Repeated passages by seed and extend.

Every window of `window` words has an anchor: the word k-gram in it with the smallest hash, the leftmost of equal
ones (winnowing). Windows with equal words have equal anchors at equal places. Windows in a row that share an anchor
form a run, so a text is a list of runs, about two for each `window - seed` words.

Pass one counts anchors over the corpus: how often, and whether all occurrences extend to the same run. Pass two
reads the texts again and keeps only runs whose anchor repeats; where all occurrences extend alike, the whole run is
one unit; where they differ, each of the run's windows is, which extends the match word by word to both sides. Units
that occur twice or more are repeats; the union of a document's repeated windows are its maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bitmap, chunks, column, cut, in_bitmap, mix64, slices, texts_of, WordHashes

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Runs:
    """The runs of many texts' windows, as arrays."""

    def __init__(self, words: list[np.ndarray], window: int = 35, seed: int = 12):
        lengths = np.array([len(w) for w in words], np.int64)
        h = mix64(np.concatenate(words) if words else np.zeros(0, np.uint64), 31)
        n, span = len(h), window - seed + 1
        ends = np.cumsum(lengths)
        # sums[i + m] - sums[i], times a power, is the hash of the m words from i.
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_P_INVERSE, n), dtype=np.uint64)])
        self.scale = _powers(_P, n + 1)
        self.window = window
        at = np.arange(n)
        inside = at + window <= np.repeat(ends, lengths)
        self.begin = np.repeat(ends - lengths, lengths)  # of the text a word is in
        self.owner = np.repeat(np.arange(len(words)), lengths)
        starts = np.flatnonzero(inside)
        if not len(starts):
            self.anchor = self.whole = np.zeros(0, np.uint64)
            self.start = self.count = np.zeros(0, np.int64)
            return
        grams = mix64(self.hash(np.arange(n - seed + 1), seed), 32)
        best = self._leftmost(grams, span)[starts]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(best) != 0) | (np.diff(starts) != 1)]))
        self.start, where = starts[new], best[new]
        self.count = np.diff(np.append(new, len(starts)))
        self.anchor = grams[where]
        long = self.count + window - 1
        self.whole = mix64(mix64(self.hash(self.start, long), 33) ^ (long * 4096 + where - self.start).astype(np.uint64), 34)

    def hash(self, i: np.ndarray, m) -> np.ndarray:
        return (self.sums[i + m] - self.sums[i]) * self.scale[i]

    @staticmethod
    def _leftmost(values: np.ndarray, span: int) -> np.ndarray:
        """For each i, the place of the smallest of values[i:i+span], the leftmost of equals; near the end, of what is left."""
        best, size = np.arange(len(values)), 1
        while size < span:
            step = min(size, span - size)
            other = np.concatenate([best[step:], np.repeat(best[-1:], min(step, len(best)))])[: len(best)]
            best = np.where(values[other] < values[best], other, best)
            size += step
        return best

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, start and hash of each window of the given runs."""
        run = np.repeat(which, self.count[which])
        first = np.cumsum(self.count[which]) - self.count[which]
        start = self.start[run] + np.arange(len(run)) - np.repeat(first, self.count[which])
        return run, start, mix64(self.hash(start, self.window), 35)


def _runs(batches, window: int, seed: int):
    """(batch, the text that each owner number is, runs), for pieces of each batch."""
    hashes = WordHashes()
    for b in slices(batches):
        texts = texts_of(b, "text")
        for i, j in chunks(texts):
            yield b, i, Runs([hashes.of(t.encode().split()) for t in texts[i:j]], window, seed)


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """anchor, n, alike: each anchor that occurs twice or more, and whether all its runs are the same words."""

    def run(batches):
        for _, _, r in _runs(batches, window, seed):
            yield pa.RecordBatch.from_arrays([pa.array(r.anchor.view(np.int64)), pa.array(r.whole.view(np.int64))], ["anchor", "whole"])

    found = docs.select("text").mapInArrow(run, "anchor long, whole long")
    grouped = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    return grouped.filter(F.col("n") >= 2).select("anchor", (F.col("least") == F.col("most")).alias("alike"))


def repeats(docs: DataFrame, window: int = 35, seed: int = 12, bits: int | None = None) -> DataFrame:
    """doc_id, text_hash, runs (array of start, count): windows whose words also start elsewhere. docs: doc_id, text_hash, text.

    A document is a row; rows that repeat one are copies of it. Anchors that repeat pass through two bitmaps of bounded
    size, whose false positives find no partner in the exact count that follows.
    """
    spark = docs.sparkSession
    repeated = cut(anchors(docs, window, seed), "anchors")
    alike, mixed = (spark.sparkContext.broadcast(bitmap(repeated.filter(c), "anchor", bits)) for c in (F.col("alike"), ~F.col("alike")))

    def run(batches):
        for b, i, r in _runs(batches, window, seed):
            whole = np.flatnonzero(in_bitmap(alike.value, r.anchor))
            owner, start, windows = r.windows(np.flatnonzero(in_bitmap(mixed.value, r.anchor)))
            which = np.concatenate([whole, owner])
            begin = np.concatenate([r.start[whole], start])
            count = np.concatenate([r.count[whole], np.ones(len(owner), np.int64)])
            at = pa.array(r.owner[begin] + i if len(begin) else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.anchor[which].view(np.int64)), pa.array(np.concatenate([r.whole[whole], windows]).view(np.int64)), column(b, "doc_id").take(at), column(b, "text_hash").take(at), pa.array((begin - r.begin[begin]).astype(np.int32)), pa.array(count.astype(np.int32))],
                ["anchor", "unit", "doc_id", "text_hash", "start", "count"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    units = cut(docs.mapInArrow(run, f"anchor long, unit long, doc_id {kind}, text_hash long, start int, count int"), "units")
    twice = units.groupBy("anchor", "unit").agg(F.count("*").alias("n")).filter(F.col("n") >= 2).drop("n")
    twice = cut(twice, "twice")  # so that the join can split a unit that very many documents hold
    return units.join(twice, ["anchor", "unit"]).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "count")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, passages (maximal repeats: first word, words).

    Every word covered by a repeated window goes, in each place. A null text has no words; a text shorter than the
    window loses nothing; rows that repeat a document lose all words if they have a window. A document's repeated
    windows, at most as many as its words, are gathered in one row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = repeats(rows, window, seed).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "runs")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "runs")
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in slices(batches):
            runs = column(b, "runs")
            offsets = runs.offsets.to_numpy()
            start, count = (runs.values.field(k).to_numpy() for k in ("start", "count"))
            text, total, removed, passages = [], [], [], []
            for i, t in enumerate(texts_of(b, "text")):
                words = t.encode().split()
                total.append(len(words))
                lo, hi = offsets[i], offsets[i + 1]
                if not runs.is_valid()[i].as_py() or lo == hi:
                    text.append(b" ".join(words).decode()), removed.append(0), passages.append([])
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start[lo:hi], 1)
                np.add.at(edge, start[lo:hi] + count[lo:hi] + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                passages.append([{"first": int(x), "words": int(y - x)} for x, y in turn.reshape(-1, 2)])
                text.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
                removed.append(int(gone.sum()))
            spans = pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(text, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), spans], ["doc_id", "text", "n_words", "n_removed", "passages"])

    return joined.mapInArrow(run, f"doc_id {kind}, text string, n_words long, n_removed long, passages array<struct<first:long,words:long>>")
