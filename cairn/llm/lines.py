"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

State is three tables. `postings` has a row for each document and distinct line key; `refs` counts the documents of
each key and keeps the largest id; `filters` has one cuckoo filter for each shard of the keys that at least
`min_docs` documents hold. A change writes what it touches and no more: inserting documents writes their postings and the
new counts of their keys, deleting them the new counts of theirs (and looks for the largest id only of keys that lost
it), and of the filters only the shards of keys whose count crossed the limit. Older rows are passed over when the tables
are read; compact() writes the state anew. A filter answers most lines ("this key is in fewer documents") without the
exact table; what passes is joined with it, so false positives cost work only. A filter that overflows is built anew from its
shard of the exact table with twice the room, and compact() deals the keys to as many shards as they need by then.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import column, cut, freeing, mix64, slices, texts_of

SLOTS = 4
#: Filters up to this size in all are sent to every task; larger ones meet their shard's postings in a shuffle.
MOST_FILTER_BYTES = 32 * 2**20
KEYS_PER_SHARD = 20_000
#: Postings that are probed in one group of such a shuffle.
GROUP = 200_000


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot. The first word of its bytes is the overflow flag."""

    def __init__(self, cells: np.ndarray, full: bool = False):
        self.cells, self.full = cells, full

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.6))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        words = np.frombuffer(data, np.uint16)
        return cls(words[1:].reshape(-1, SLOTS).copy(), bool(words[0]))

    def dump(self) -> bytes:
        return np.uint16(self.full).tobytes() + self.cells.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each 64-bit key."""
        mask = np.uint64(len(self.cells) - 1)
        h = mix64(np.asarray(keys).astype(np.uint64), 11)
        mark = (h >> np.uint64(48)) | np.uint64(1)
        one = h & mask
        return mark.astype(np.uint16), one.astype(np.int64), ((one ^ mix64(mark, 12)) & mask).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(keys), bool)
        mark, one, two = self.places(keys)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> None:
        mark, one, two = self.places(keys)
        mask = len(self.cells) - 1
        for m, i, j in zip(mark.tolist(), one.tolist(), two.tolist()):
            for turn in range(500):
                row = self.cells[i] if turn else next((self.cells[b] for b in (i, j) if (self.cells[b] == 0).any()), self.cells[i])
                empty = np.flatnonzero(row == 0)
                if len(empty):
                    row[empty[0]] = m
                    break
                at = turn % SLOTS
                row[at], m = m, int(row[at])
                i ^= int(mix64(np.array([m], np.uint64), 12)[0]) & mask
            else:
                self.full = True
                return

    def delete(self, keys: np.ndarray) -> None:
        for m, i, j in zip(*(x.tolist() for x in self.places(keys))):
            for b in (i, j):
                at = np.flatnonzero(self.cells[b] == m)
                if len(at):
                    self.cells[b, at[0]] = 0
                    break


def line_key(line: bytes, min_chars: int = 20) -> bytes | None:
    """The key of a line: ASCII white space off both ends, A-Z in lower case; None if it is too short to count."""
    key = line.strip().lower()
    n = len(key)
    return key if n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars) else None


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def postings(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """high, low (a key's 128-bit hash), doc_id, text_hash: one row for each document and distinct key."""

    def run(batches):
        import xxhash

        for b in slices(batches):
            owner, digests = [], []
            for i, text in enumerate(texts_of(b, "text")):
                got = {xxhash.xxh3_128_digest(k) for line in set(text.encode().split(b"\n")) if (k := line_key(line, min_chars)) is not None}
                owner += [i] * len(got)
                digests += got
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), column(b, "doc_id").take(at), column(b, "text_hash").take(at)], ["high", "low", "doc_id", "text_hash"])

    kind = dict(docs.dtypes)[id_col]
    return _rows(docs, id_col, text_col).mapInArrow(freeing(run), f"high long, low long, doc_id {kind}, text_hash long")


def references(posted: DataFrame) -> DataFrame:
    """The exact table: documents and largest doc_id of each key. Partial counts are made before the shuffle, so a
    line that a third of all documents hold costs one row a task."""
    return posted.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int"))


def change_filters(filters: DataFrame | None, add: DataFrame, remove: DataFrame | None, shards: int, room: int = 1) -> DataFrame:
    """shard, filter: with the keys (high, low) of add inserted and those of remove deleted. A new filter is sized for `room` times its keys."""
    keys = _sharded(add.select("high", F.lit(1).alias("sign")), shards)
    if remove is not None:
        keys = keys.unionByName(_sharded(remove.select("high", F.lit(-1).alias("sign")), shards))
    old = filters if filters is not None else keys.sparkSession.createDataFrame([], "shard int, filter binary")

    def run(key, have: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        new = change.loc[change["sign"] == 1, "high"].to_numpy(np.int64)
        f = CuckooFilter.load(have["filter"].iloc[0]) if len(have) else CuckooFilter.sized(max(room * len(new), KEYS_PER_SHARD // 4))
        f.delete(change.loc[change["sign"] == -1, "high"].to_numpy(np.int64))
        f.insert(new)
        return pd.DataFrame({"shard": pd.Series([key[0]], dtype="int32"), "filter": [f.dump()]})

    return old.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(run, "shard int, filter binary")


def may_repeat(posted: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Those postings whose key the filters hold. A shard's postings are split into groups of about GROUP, however many
    documents hold one of its lines."""
    size = filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    if size <= MOST_FILTER_BYTES:
        have = {r["shard"]: bytes(r["filter"]) for r in filters.collect()}  # at most MOST_FILTER_BYTES

        def run(batches):
            loaded = {k: CuckooFilter.load(v) for k, v in have.items()}
            for b in batches:
                high = column(b, "high").to_numpy()
                shard, keep = np.mod(high, shards), np.zeros(len(high), bool)
                for k, f in loaded.items():
                    at = np.flatnonzero(shard == k)
                    keep[at] = f.holds(high[at])
                yield b.filter(pa.array(keep))

        return posted.mapInArrow(freeing(run), posted.schema)
    dealt = _sharded(posted, shards)
    groups = cut(dealt.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), "groups")
    dealt = dealt.join(groups, "shard").withColumn("group", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("groups")).cast("int")).drop("groups")
    sent = filters.join(groups, "shard").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("shard", "group", "filter")

    names = posted.columns

    def probe(rows: pa.Table, own: pa.Table) -> pa.Table:
        keep = CuckooFilter.load(own.column("filter")[0].as_py()).holds(rows.column("high").to_numpy()) if own.num_rows else np.zeros(rows.num_rows, bool)
        return rows.filter(pa.array(keep)).select(names)

    return dealt.groupBy("shard", "group").cogroup(sent.groupBy("shard", "group")).applyInArrow(probe, posted.schema)


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")


def _kept(posted: DataFrame, parts: int) -> DataFrame:
    """Postings as a table, dealt to `parts` folders by a hash of doc_id unless that is 0."""
    return cut(posted.withColumn("part", _part(parts)), "postings", by="part") if parts else cut(posted, "postings")


def _fresh(refs: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """Filters for the keys of the exact table that count, and the number of their shards."""
    often = refs.filter(F.col("n_docs") >= min_docs)
    shards = 1 + often.count() // KEYS_PER_SHARD
    return cut(change_filters(None, often, None, shards), "filters"), shards


@dataclass
class LineIndex:
    """The state; every change gives a new one. With parts, postings are dealt to that many folders by a hash of doc_id, so that deleting
    documents reads theirs only: for a state that lives on."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 3
    min_chars: int = 20
    parts: int = 0

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, parts: int = 0) -> LineIndex:
        posted = _kept(postings(docs, min_chars), parts)
        refs = cut(references(posted), "refs")
        filters, shards = _fresh(refs, min_docs)
        return cls(posted, refs, filters, shards, min_docs, min_chars, parts)

    def _changed(self, posted: DataFrame, touched: DataFrame) -> LineIndex:
        """touched: high, low, was, n_docs (0 for a key that no document holds any more), last_doc; a small written table."""
        kept = self.refs.join(touched.select("high", "low"), ["high", "low"], "left_anti")
        refs = kept.unionByName(touched.filter(F.col("n_docs") > 0).select("high", "low", "n_docs", "last_doc"))
        now, before = F.col("n_docs") >= self.min_docs, F.col("was") >= self.min_docs
        add, remove = touched.filter(now & ~before), touched.filter(~now & before)
        shards = _sharded(add.select("high").unionByName(remove.select("high")), self.shards).select("shard").distinct()
        own = cut(change_filters(self.filters.join(shards, "shard", "left_semi"), add, remove, self.shards), "filters")
        full = own.filter("substring(filter, 1, 2) <> X'0000'").select("shard")
        if not full.isEmpty():  # the shards' keys again, with room for as many more
            keys = _sharded(refs.filter(now), self.shards).join(F.broadcast(full), "shard", "left_semi")
            own = cut(own.join(full, "shard", "left_anti").unionByName(change_filters(None, keys, None, self.shards, 2)), "filters")
        filters = self.filters.join(own.select("shard"), "shard", "left_anti").unionByName(own)
        return LineIndex(posted, refs, filters, self.shards, self.min_docs, self.min_chars, self.parts)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents. Rows that repeat a text or an id count each, also an id that is in it already: the state is that of
        building from all rows, and deleting the id deletes all of them."""
        new = _kept(postings(docs, self.min_chars), self.parts)
        more = references(new).withColumnsRenamed({"n_docs": "more", "last_doc": "latest"})
        touched = more.join(self.refs, ["high", "low"], "left").select(
            "high", "low", F.coalesce("n_docs", F.lit(0)).alias("was"), (F.coalesce("n_docs", F.lit(0)) + F.col("more")).alias("n_docs"), F.greatest("last_doc", "latest").alias("last_doc")
        )
        return self._changed(self.postings.unionByName(new), cut(touched, "touched"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose doc_id is in doc_ids; a null id deletes nothing."""
        ids = cut(doc_ids.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), "deleted")
        left = self.postings.join(ids, "doc_id", "left_anti").select(*self.postings.columns)
        posted = self.postings
        if self.parts:
            posted = posted.filter(F.col("part").isin([r["part"] for r in ids.select(_part(self.parts)).distinct().collect()]))  # at most `parts` numbers
        less = references(posted.join(ids, "doc_id", "left_semi")).withColumnsRenamed({"n_docs": "less", "last_doc": "latest"})
        met = cut(less.join(self.refs, ["high", "low"]), "met")
        lost = met.filter((F.col("n_docs") > F.col("less")) & (F.col("latest") == F.col("last_doc"))).select("high", "low")
        found = left.join(lost, ["high", "low"], "left_semi").groupBy("high", "low").agg(F.max("doc_id").alias("found"), F.lit(1).alias("again"))
        touched = met.join(found, ["high", "low"], "left").select(
            "high", "low", F.col("n_docs").alias("was"), (F.col("n_docs") - F.col("less")).alias("n_docs"), F.when(F.col("again") == 1, F.col("found")).otherwise(F.col("last_doc")).alias("last_doc")
        )
        return self._changed(left, cut(touched, "touched"))

    def compact(self) -> LineIndex:
        """The same state, written anew after many changes, with as many shards as it needs now."""
        refs = cut(self.refs, "refs")
        filters, shards = _fresh(refs, self.min_docs)
        return LineIndex(_kept(self.postings.drop("part"), self.parts), refs, filters, shards, self.min_docs, self.min_chars, self.parts)

    def drops(self) -> DataFrame:
        """doc_id, text_hash, keys: the hashes of the keys whose lines a document loses. The exact counts are a written table,
        so that the join can split a line that very many documents hold."""
        exact = self.refs.filter(F.col("n_docs") >= self.min_docs)
        return (
            may_repeat(self.postings, self.filters, self.shards)
            .join(exact, ["high", "low"])
            .filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
            .groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("high", "low")).alias("keys"))
        )


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text rewritten, and n_lines, n_dropped added.

    A line goes if its key (at least min_chars code points) is in at least min_docs documents, unless the document
    has the largest id of those that hold it. A row is a document: rows that repeat an id count each, and where the
    repeated id is the largest, each keeps its lines. A null id is smaller than any; a null or empty text is one
    empty line. A document's lines to drop, at most as many as it has, are gathered in one row.
    """
    names = docs.columns
    index = index or LineIndex.build(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_docs, min_chars)
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    drops = index.drops().select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("keys").alias("__keys"))
    joined = rows.join(drops, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__h")), "left").select("__row", F.col("__row")[text_col].alias("__text"), "__keys")
    least = index.min_chars

    def run(batches):
        import xxhash

        for b in slices(batches):
            text, lines, dropped = [], [], []
            for t, keys in zip(texts_of(b, "__text"), column(b, "__keys").to_pylist()):
                parts = t.encode().split(b"\n")
                lines.append(len(parts))
                if keys:
                    gone = {np.array([k["high"], k["low"]], np.int64).tobytes() for k in keys}
                    parts = [p for p in parts if (k := line_key(p, least)) is None or xxhash.xxh3_128_digest(k) not in gone]
                    t = b"\n".join(parts).decode()
                dropped.append(lines[-1] - len(parts))
                text.append(t)
            yield pa.RecordBatch.from_arrays([column(b, "__row"), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["__row", "__text", "__lines", "__dropped"])

    schema = joined.select("__row", "__text", F.lit(0).cast("long").alias("__lines"), F.lit(0).cast("long").alias("__dropped")).schema
    out = joined.mapInArrow(freeing(run), schema)
    kept = [F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in names if c not in ("n_lines", "n_dropped")]
    return out.select(*kept, F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))
