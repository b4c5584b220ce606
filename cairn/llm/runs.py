"""Periodic runs of words by Lyndon roots, and their collapse.

A run is a stretch of words with smallest period q that is at least `least` words and `times` * q long and that no
neighbouring word extends. By the runs theorem each run's root is the longest Lyndon word at its place, under one of two
opposite orders of the words. Phase one of Baier's suffix sorter gives these: suffixes are grouped by their first word; from
the greatest group down, each suffix lengthens the context of the nearest suffix before it that is in a smaller group; when a
group's turn comes, its context is the longest Lyndon prefix of its members. So one grouping for each order yields a Lyndon
array, without a suffix array. Each root is then extended to both sides as far as words equal those a period away.

Grouping is plain Python, so it is kept for where a run can be: in a run of 24 words and three periods each eight words in
a row come again in the document, so stretches that repeated eight-word shingles cover hold all runs whole.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import WordHashes, column, mix64, slices, texts_of

LEAST, TIMES = 24, 3
#: Places of the table of counts that spares sorting most shingles.
_TABLE = 22


def lyndon_array(ids: np.ndarray, down: bool = False) -> np.ndarray:
    """The length of the longest Lyndon word at each place, ids being in their numeric order or, `down`, in the opposite one."""
    n = len(ids)
    values, first = np.unique(-ids.astype(np.int64) if down else ids.astype(np.int64), return_inverse=True)
    group = first.tolist()
    order = np.argsort(first, kind="stable")
    members = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(first[order])) + 1)] if n else []
    size = [1] * len(values)
    lower, upper = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))  # the groups' order; a group above all: len(values)
    before, after = list(range(-1, n)), list(range(1, n + 2))  # places whose group hasn't had its turn
    out = [0] * n
    members.append([])  # the group above all
    size.append(0)
    lower.append(len(values) - 1)
    upper.append(-1)
    now = lower[-1]
    while now >= 0:
        width, given = size[now], {}
        for i in members[now]:
            if group[i] != now:
                continue  # it went to a longer context
            out[i] = width
            p, q = before[i], after[i]
            if p >= 0:
                given[p] = given.get(p, 0) + 1
                after[p] = q
            before[q] = p
        if given:
            moved: dict = {}
            for p, k in given.items():  # in order of place
                moved.setdefault((group[p], k), []).append(p)
            for old, k in sorted(moved, reverse=True):  # more copies of the context are greater; each goes right above its old group, so the greatest first
                new = len(members)
                members.append(moved[old, k])
                size.append(size[old] + k * width)
                above = upper[old]
                lower.append(old)
                upper.append(above)
                upper[old] = new
                lower[above] = new
                for p in members[new]:
                    group[p] = new
        now = lower[now]
    return np.array(out, np.int64)


def _forward(ids: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on, i < j."""
    n, done, step = len(ids) - j, 0, 64
    while done < n:
        wrong = np.flatnonzero(ids[i + done : i + min(n, done + step)] != ids[j + done : j + min(n, done + step)])
        if len(wrong):
            return done + int(wrong[0])
        done, step = done + step, 2 * step
    return n


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n, found = len(ids), set()
    backward = ids[::-1]
    for down in (False, True):
        root = lyndon_array(ids, down)
        at = np.arange(n)
        at = at[at + 2 * root <= n]  # the first root of a run with three periods is followed by a copy
        at = at[(ids[at] == ids[at + root[at]]) & (ids[at + root[at] - 1] == ids[at + 2 * root[at] - 1])]
        last: dict[int, int] = {}  # of each period, the end of the latest run
        for i, p in zip(at.tolist(), root[at].tolist()):
            if i + 2 * p <= last.get(p, -1):
                continue
            start = i - (_forward(backward, n - i - p, n - i) if i else 0)
            end = i + p + _forward(ids, i, i + p)
            last[p] = end
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, owner: np.ndarray, k: int = 8, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [start, stop) of at least `least` words, covered by shingles of k words that the same document has again. ids: the words' 64-bit
    hashes, of all documents in a row; owner: the document of each word."""
    n = len(ids) - k + 1
    if n < 1:
        return []
    h = mix64(owner[:n].astype(np.uint64), 21)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : n + i].astype(np.uint64)
    h = mix64(h, 22)
    inside = owner[:n] == owner[k - 1 :]
    cell = (h >> np.uint64(64 - _TABLE)).astype(np.int64)
    maybe = np.flatnonzero(inside & (np.bincount(cell[inside], minlength=2**_TABLE)[cell] > 1))
    order = maybe[np.argsort(h[maybe], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.diff(np.concatenate([[0], again.view(np.int8), [0]]))
    # A run lies in one series of repeated shingles: all of its own are; series of one document that only meet are apart.
    return [(a, b + k - 1) for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()) if b - a + k - 1 >= least]


def seed(least: int, times: int) -> int:
    """The longest shingle that a run is sure to have again at every place: 2 q + k - 1 <= max(least, times * q) for all q >= 1."""
    k = 8
    while k > 1 and any(2 * q + k - 1 > max(least, times * q) for q in range(1, least + k)):
        k -= 1
    return k


def find_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """docs with text collapsed, and n_words, runs (array of start, length, period by start and then period) and best (the run with most
    periods; of equals the first, then that of smallest period; null without runs) added.

    Collapsed means: the words that no run has after its first period, joined by one blank. Words are parted by ASCII white space. `change` may
    give other words for a row's id and words (bytes). A null or empty text has no words and the empty text; rows that repeat
    an id or text are judged each for itself, alike; ids may be null; columns called n_words, runs or best are replaced.
    times is at least 3. Nothing is shuffled; a text of any length takes memory in proportion to its length.
    """
    if times < 3:
        raise ValueError("runs have three periods at least")
    names = [c for c in docs.columns if c not in ("n_words", "runs", "best")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    k = seed(least, times)

    def run(batches):
        hashes = WordHashes()
        for b in slices(batches, 250):
            words = [t.encode().split() for t in texts_of(b, "__text")]
            if change:
                words = [change(i, w) for i, w in zip(column(b, "__id").to_pylist(), words)]
            counts = np.array([len(w) for w in words], np.int64)
            begins = np.concatenate([[0], np.cumsum(counts)])
            ids = np.concatenate([hashes.of(w) for w in words] or [np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(words)), counts)
            found: dict[int, list] = {}
            for lo, hi in stretches(ids, owner, k, least):
                own = int(owner[lo])
                local = np.unique(ids[lo:hi], return_inverse=True)[1]
                found.setdefault(own, []).extend((s + lo - int(begins[own]), n, p) for s, n, p in runs_of(local, least, times))
            text, runs, best = [], [], []
            for d, w in enumerate(words):
                got = sorted(found.get(d, ()), key=lambda r: (r[0], r[2]))
                if got:
                    gone = np.zeros(len(w) + 1, np.int64)
                    for s, n, p in got:
                        gone[s + p] += 1
                        gone[s + n] -= 1
                    w = [x for x, out in zip(w, np.cumsum(gone).tolist()) if not out]
                named = [dict(zip(("start", "length", "period"), r)) for r in got]
                runs.append(named)
                best.append(min(named, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if named else None)
                text.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([column(b, "__row"), pa.array(text, pa.string()), pa.array(counts), pa.array(runs, pa.list_(run_type)), pa.array(best, run_type)], ["__row", "__text", "__n", "__runs", "__best"])

    kinds = "struct<start:bigint,length:bigint,period:bigint>"
    empty = F.lit(None)
    schema = rows.select("__row", "__text", F.lit(0).cast("long").alias("__n"), empty.cast(f"array<{kinds}>").alias("__runs"), empty.cast(kinds).alias("__best")).schema
    out = rows.mapInArrow(run, schema)
    kept = [F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in names]
    return out.select(*kept, F.col("__n").alias("n_words"), F.col("__runs").alias("runs"), F.col("__best").alias("best"))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repeated tail in one document of ten: with h the CRC-32 of the id in decimal and g = h div 10, where h ends in 0, word i >= a becomes word
    a + (i - a) % p, for a = g % n and p = 1 + (n - a) div (3 + g % 8). Without an id nothing is repeated."""
    import zlib

    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * -(-(n - a) // p))[: n - a]
