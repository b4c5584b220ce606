"""Ranked lexical search over an index of per-term geometric blocks, exact.

The index is dealt into segments of at most SEGMENT documents. In a segment each term's posting list is clustered by the
documents' likeness: some of its documents stand for clusters, and each other one joins the one whose vector (sketched by
random signs, lengths kept) is nearest. A cluster is a block. Its summary is the coordinatewise maximum of its documents' vectors; of terms
that many documents of the segment have, whose maxima hardly differ from block to block, the segment's maximum serves.
A query's inner product with a summary so is an exact bound for all documents of the block: a query takes its terms'
lists from the one that can give most down, skips blocks whose bound is under its k-th best score, scores the documents of
the others whole, and ends where all that the lists left can give is under that score.

Scores are whole numbers: a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document with tf of it and the length
measure m = 25 + (75 n N) div L gives w * ((10^9 tf) div (1000 tf + 8 m)).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import column, cut, mix64, slices, texts_of

#: Documents of a segment, and postings, whichever is reached first.
SEGMENT, SEGMENT_POSTINGS = 4096, 2_000_000
#: Segments of a file: a task of the search reads a file's at once.
FILE_SEGMENTS = 2
#: Documents of a block in the mean; a block of fewer than FEW documents has no summary and is scored whole.
BLOCK, FEW = 64, 8
#: Terms that a larger share of a segment's documents have are bounded by the segment's maximum: most blocks reach it.
COMMON = 1 / 128
#: (query, term) pairs that are searched for at once; more queries go in blocks by hash.
MOST_PAIRS = 400_000
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max  # stands for a null id


def terms_of(text: str) -> list[bytes]:
    """The terms of a text: stretches of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case."""
    return text.encode().translate(_WORDS).split()


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, item_id, term, times: a query's terms with repeats. Rows are told apart by `row`."""
    from collections import Counter

    rows = queries.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in slices(batches):
            counts = [Counter(terms_of(t)) for t in texts_of(b, "text")]
            at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
            yield pa.RecordBatch.from_arrays(
                [column(b, "row").take(at), column(b, "item_id").take(at), pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())],
                ["row", "item_id", "term", "times"],
            )

    return rows.mapInArrow(run, f"row long, item_id {dict(rows.dtypes)['item_id']}, term binary, times long")


def vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary), tf: a row for each document."""
    from collections import Counter

    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches):
        known = sent.value
        for b in slices(batches, 500):
            lengths, sizes, at, tf = [], [], [], []
            for text in texts_of(b, "text"):
                words = terms_of(text)
                lengths.append(len(words))
                had = [(known[t], n) for t, n in Counter(words).items() if t in known]
                sizes.append(len(had))
                at += [i for i, _ in had]
                tf += [n for _, n in had]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


@dataclass
class Statistics:
    """Documents with a term, terms of all, and each vocabulary term's weight."""

    docs: int
    total: int
    weights: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, size: int) -> Statistics:
        """Over all rows of vectors(). A task counts before the shuffle; one number a term comes to the driver."""
        row = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total")).first()

        def count(batches):
            had = np.zeros(size, np.int64)
            for b in batches:
                had += np.bincount(column(b, "terms").flatten().to_numpy(), minlength=size)
            at = np.flatnonzero(had)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(had[at])], ["term", "df"])

        found = rows.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(size, np.int64)
        df[found.column("term").to_numpy()] = found.column("df").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * row["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        return cls(row["docs"], row["total"] or 0, weights)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one after the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _pointers(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _maxima(block: np.ndarray, term: np.ndarray, value: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, term, greatest value) of each pair that is there, by block and term."""
    if not len(term):
        return block, term, value
    seen = np.zeros(int(term.max()) + 1, bool)
    seen[term] = True
    names = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    if blocks * len(names) <= 8 * len(term) + 500_000:  # a dense table of about as much memory
        best = np.zeros(blocks * len(names), np.int32)
        np.maximum.at(best, block * len(names) + place[term], value)
        at = np.flatnonzero(best)
        return at // len(names), names[at % len(names)], best[at]
    key = block * len(names) + place[term]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    key = key[order[first]]
    return key // len(names), names[key % len(names)], np.maximum.reduceat(value[order], first)


#: A summary's maxima are rounded up to multiples of this, which keeps them bounds and halves their room.
UNIT = 256
#: A segment's arrays. Documents: ids; forward vectors by pointer: terms, impacts. Lists by term: its greatest impact, pointer to blocks. Blocks: pointer to
#: places of documents, pointer to the summary's terms and maxima. Common terms and the segment's maxima.
PARTS = ("ids", "row_ptr", "terms", "impacts", "list_terms", "list_max", "list_ptr", "block_ptr", "block_docs", "summary_ptr", "summary_terms", "summary_max", "common_terms", "common_max")


def segment(ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, stats: Statistics) -> dict[str, np.ndarray]:
    """The index of some documents: their vectors, and for each term blocks of like documents with summaries."""
    m = 25 + 75 * n * stats.docs // max(1, stats.total)
    owner = np.repeat(np.arange(len(ids)), sizes)
    impacts = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * m[owner])
    row_ptr = _pointers(sizes)
    # Sketches of the weighed vectors: 32 sums with random signs, which keep distances about as they are.
    names, place = np.unique(terms, return_inverse=True)
    signs = 1.0 - 2.0 * ((mix64(names.astype(np.uint64), 31)[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)).astype(float)
    sketch = np.zeros((len(ids), 32))
    some = sizes > 0
    for lo in range(0, 32, 8):
        if some.any():
            sketch[some, lo : lo + 8] = np.add.reduceat((impacts * stats.weights[terms])[:, None] * signs[place, lo : lo + 8], row_ptr[:-1][some], axis=0)
    half = (sketch**2).sum(1) / 2
    order = np.argsort(place, kind="stable")
    counts = np.bincount(place, minlength=len(names))
    list_at = _pointers(counts)
    blocks_of, block_sizes, block_docs = [], [], []
    for lo, hi in zip(list_at[:-1].tolist(), list_at[1:].tolist()):
        own = owner[order[lo:hi]]
        if len(own) > BLOCK:
            leads = own[np.linspace(0, len(own) - 1, -(-len(own) // BLOCK)).astype(int)]
            near = np.argmax(sketch[own] @ sketch[leads].T - half[leads], axis=1)  # the least distance
            own = own[np.argsort(near, kind="stable")]
            parts = np.bincount(near, minlength=len(leads))
            parts = parts[parts > 0].tolist()
        else:
            parts = [len(own)]
        blocks_of.append(len(parts))
        block_sizes += parts
        block_docs.append(own)
    block_ptr = _pointers(np.array(block_sizes, np.int64))
    block_docs = np.concatenate(block_docs) if block_docs else np.zeros(0, np.int64)
    common = counts > COMMON * len(ids)
    top = np.zeros(len(names), np.int64)
    np.maximum.at(top, place, impacts)
    # Summaries, over the rarer terms, some blocks at a time.
    rare = ~common[place]
    rare_ptr, rare_terms, rare_impacts = _pointers(np.bincount(owner[rare], minlength=len(ids))), place[rare], impacts[rare]
    took = rare_ptr[block_docs + 1] - rare_ptr[block_docs]
    work = _pointers(np.where(np.repeat(np.diff(block_ptr), np.diff(block_ptr)) >= FEW, took, 0))
    parts, lo, last = [], 0, len(block_sizes)
    while lo < last:
        hi = max(lo + 1, int(np.searchsorted(work[block_ptr], work[block_ptr[lo]] + 500_000, "right")) - 1)
        inside = np.arange(block_ptr[lo], block_ptr[hi])
        block = np.repeat(np.arange(hi - lo), np.diff(block_ptr[lo : hi + 1]))
        large = np.diff(block_ptr[lo : hi + 1])[block] >= FEW
        d, block = block_docs[inside[large]], block[large]
        flat = _ranges(rare_ptr[d], rare_ptr[d + 1])
        b, t, v = _maxima(np.repeat(block, rare_ptr[d + 1] - rare_ptr[d]), rare_terms[flat], rare_impacts[flat].astype(np.int32), hi - lo)
        parts.append((np.bincount(b, minlength=hi - lo), names[t], v))
        lo = hi
    joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
    found = (ids, row_ptr, terms, impacts, names, top, _pointers(np.array(blocks_of, np.int64)), block_ptr, block_docs, _pointers(joined[0]), joined[1], -(-joined[2] // UNIT), names[common], top[common])
    return {p: x.astype(np.int64 if p == "ids" else np.uint16 if p == "summary_max" else np.int32) for p, x in zip(PARTS, found)}


def pack(own: dict[str, np.ndarray]) -> bytes:
    """A segment as compressed bytes, in Arrow's stream format: one column for each array, of one row."""
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own[p])], pa.int32()), pa.array(own[p])) for p in PARTS], list(PARTS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {p: batch.column(p).flatten().to_numpy() for p in PARTS}


def build(rows: DataFrame, stats: Statistics) -> DataFrame:
    """The index of vectors(): docs, segment. A row for each segment, packed, so that a task that reads many holds no more than their
    bytes in the JVM. Nothing is shuffled: a segment takes rows of one task."""

    def run(batches):
        held, count = [], [0, 0]

        def done():
            take = lambda k: np.concatenate([h[k] for h in held])
            made = segment(*(take(k) for k in range(5)), stats)
            held.clear()
            count[:] = 0, 0
            return pa.RecordBatch.from_arrays([pa.array([len(made["ids"])], pa.int64()), pa.array([pack(made)], pa.binary())], ["docs", "segment"])

        for b in slices(batches, 256):
            flat = lambda c: column(b, c).flatten().to_numpy().astype(np.int64)
            sizes = column(b, "terms").value_lengths().to_numpy()
            held.append((column(b, "doc_id").fill_null(_LAST).to_numpy(), column(b, "n").to_numpy(), sizes, flat("terms"), flat("tf")))
            count[0] += b.num_rows
            count[1] += int(sizes.sum())
            if count[0] >= SEGMENT or count[1] >= SEGMENT_POSTINGS:
                yield done()
        if held:
            yield done()

    return rows.mapInArrow(run, "docs long, segment binary")


class Best:
    """The k best (score, id) so far, by score and then smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)
        self.least = 0.0  # a score under this can't be among them

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.least)
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = float(self.scores[-1])


def search_segment(own: dict[str, np.ndarray], terms: np.ndarray, weights: np.ndarray, best: Best, dense: np.ndarray) -> tuple[int, int]:
    """One query over one segment: best gets what is better. dense: zeros for every vocabulary term, given back as such. Returns blocks met and scored.

    All numbers are whole and under 2^53, so that sums in double are exact.
    """
    place = np.searchsorted(own["list_terms"], terms)
    there = (place < len(own["list_terms"])) & (own["list_terms"][np.minimum(place, max(0, len(own["list_terms"]) - 1))] == terms) if len(own["list_terms"]) else np.zeros(len(terms), bool)
    place, weights, terms = place[there], weights[there].astype(float), terms[there]
    most = weights * own["list_max"][place]
    order = np.argsort(-most, kind="stable")
    left = np.cumsum(most[order][::-1])[::-1]  # all that this list and those after it can give
    dense[terms] = weights
    base = float((dense[own["common_terms"]] * own["common_max"]).sum())
    seen = np.zeros(len(own["ids"]), bool)
    met = scored = 0
    for i, at in enumerate(order.tolist()):
        if left[i] < best.least or left[i] <= 0:
            break
        lo, hi = int(own["list_ptr"][place[at]]), int(own["list_ptr"][place[at] + 1])
        met += hi - lo
        ptr = own["summary_ptr"][lo : hi + 1]
        a, z = int(ptr[0]), int(ptr[-1])
        total = np.concatenate([[0.0], np.cumsum(dense[own["summary_terms"][a:z]] * own["summary_max"][a:z])])
        bound = base + UNIT * (total[ptr[1:] - a] - total[ptr[:-1] - a])
        bound[np.diff(own["block_ptr"][lo : hi + 1]) < FEW] = np.inf
        turn, step = np.argsort(-bound, kind="stable"), 1
        while len(turn) and bound[turn[0]] >= best.least:
            now, turn = turn[:step], turn[step:]
            now = lo + now[bound[now] >= best.least]
            step *= 2
            scored += len(now)
            d = own["block_docs"][_ranges(own["block_ptr"][now].astype(np.int64), own["block_ptr"][now + 1].astype(np.int64))]
            d = d[~seen[d]]
            if len(d):
                seen[d] = True
                starts, stops = own["row_ptr"][d].astype(np.int64), own["row_ptr"][d + 1].astype(np.int64)
                flat = _ranges(starts, stops)
                best.add(np.add.reduceat(dense[own["terms"][flat]] * own["impacts"][flat], _pointers(stops - starts)[:-1]), own["ids"][d])
    dense[terms] = 0
    return met, scored


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each query's k highest-scoring documents with a score over 0 (fewer, if there aren't so many);
    equal scores by ascending doc_id.

    A null or empty text has no terms: such a document is never found and doesn't count as one, such a query has no rows. Rows
    that repeat an id are documents each, and queries each; a null doc_id comes after all others of its score. doc_id is
    a whole number. Other columns don't matter. The index is for the terms of the queries at hand, at most MOST_PAIRS pairs of
    query and term; more queries are searched in blocks.
    """
    pairs = cut(_query_terms(queries, item_col, query_col), "query-terms")
    blocks = max(1, -(-pairs.count() // MOST_PAIRS))
    out = None
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()  # about MOST_PAIRS rows
        vocabulary = sorted(set(own.column("term").to_pylist()))
        rows = cut(vectors(docs, vocabulary, id_col, text_col), "vectors")
        stats = Statistics.of(rows, len(vocabulary))
        found = _found(cut(build(rows, stats), "segments", file_rows=FILE_SEGMENTS), own, vocabulary, stats, k)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _found(index: DataFrame, own: pa.Table, vocabulary: list[bytes], stats: Statistics, k: int) -> DataFrame:
    """row, item_id, doc_id, score: the k best documents that each task has found for each query."""
    number = {t: i for i, t in enumerate(vocabulary)}
    terms = np.array([number[t] for t in own.column("term").to_pylist()], np.int64)
    weights = own.column("times").to_numpy() * stats.weights[terms] if len(terms) else np.zeros(0, np.int64)
    rows, first, which = np.unique(own.column("row").to_numpy(), return_index=True, return_inverse=True)
    order = np.lexsort((terms, which))
    ptr = _pointers(np.bincount(which, minlength=len(rows)))
    items = own.column("item_id").combine_chunks().take(pa.array(first)) if len(rows) else own.column("item_id").combine_chunks().slice(0, 0)
    sent = index.sparkSession.sparkContext.broadcast((rows, items, ptr, terms[order], weights[order], len(vocabulary)))

    def run(batches):
        rows, items, ptr, terms, weights, size = sent.value
        best, dense = [Best(k) for _ in rows], np.zeros(size)
        for b in batches:
            for i in range(b.num_rows):
                one = unpack(column(b, "segment")[i].as_buffer())
                for q, keep in enumerate(best):
                    search_segment(one, terms[ptr[q] : ptr[q + 1]], weights[ptr[q] : ptr[q + 1]], keep, dense)
        at = pa.array(np.repeat(np.arange(len(rows)), [len(x.ids) for x in best]))
        ids = np.concatenate([x.ids for x in best] or [np.zeros(0, np.int64)])
        scores = np.concatenate([x.scores for x in best] or [np.zeros(0)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows).take(at), items.take(at), pa.array(ids, mask=ids == _LAST), pa.array(scores)], ["row", "item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import from_arrow_type

    return index.mapInArrow(run, f"row long, item_id {from_arrow_type(items.type).simpleString()}, doc_id long, score long")
