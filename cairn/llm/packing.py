"""Best-fit packing of token sequences by linear grouping (Fernandez de la Vega and Lueker 1981).

Lengths are whole numbers up to the capacity, so the whole problem is a histogram of at most `capacity` counts. The
plan is made on that histogram: long lengths fall into groups of equal cardinality and are rounded up to their
group's longest; the few rounded sizes are packed by a linear program over configurations, solved by column
generation; actual documents take the configurations' places; what the rounding down left over and all short
documents then go where they fit best. A plan is a list of intervals (length, first rank, count, first sequence,
offset), whose number depends on the capacity and not on the input. Documents get their rank within their length
by distributed counting and look their place up.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import column, cut, freeing, row_hash, slices
from cairn.llm.tokens import WordEncoder, encoder

#: Words that a tokenizer remembers which lives for one task only.
FEW = 100_000


def tokenize(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", hold: bool = True) -> DataFrame:
    """Pieces of at most max_tokens ids: doc_id, piece, start, length, ids (little-endian 32-bit).

    A document's ids end with end_id; only documents longer than max_tokens are cut, into full pieces and a shorter
    last one. A null text is empty and gives one piece that holds only the end id. Repeated rows give repeated pieces.
    hold: a worker keeps the tokenizer and up to 800,000 words for its next task; else they go when a task ends, and are about FEW at most.
    """

    def pieces(batches):
        code = encoder(tokenizer, end_id) if hold else WordEncoder(tokenizer, end_id, FEW // 2)
        for b in slices(batches):
            owner, piece, start, length, ids = [], [], [], [], []
            for i, got in enumerate(code.encode(column(b, "text"))):
                n = len(got) // 4
                for k in range(0, n, max_tokens):
                    m = min(max_tokens, n - k)
                    owner.append(i), piece.append(k // max_tokens), start.append(k), length.append(m), ids.append(got[4 * k : 4 * (k + m)])
            for lo in range(0, len(owner), 5000):
                s = slice(lo, lo + 5000)
                yield pa.RecordBatch.from_arrays(
                    [column(b, "doc_id").take(pa.array(owner[s], pa.int64())), pa.array(piece[s], pa.int32()), pa.array(start[s], pa.int64()), pa.array(length[s], pa.int64()), pa.array(ids[s], pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces if hold else freeing(pieces), "doc_id long, piece int, start long, length long, ids binary")


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(items of each size, how many sequences): the configuration program's solution, rounded down."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            value = best[c - sizes[fits]] + price[fits]
            at = int(value.argmax())
            if value[at] > best[c - 1] + 1e-12:
                best[c], took[c] = value[at], fits[at]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        pattern, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                pattern[took[c]] += 1
                c -= int(sizes[took[c]])
        move, now = np.linalg.solve(basis, pattern), np.linalg.solve(basis, demand)
        ratio = np.where(move > 1e-9, now / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    now = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), int(np.floor(now[j] + 1e-6))) for j in np.argsort(-now) if now[j] >= 1]


def plan(histogram: dict[int, int], capacity: int = 2048, groups: int = 40) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, count, first sequence, offset) that place every item of the histogram.

    Lengths over an eighth, a quarter or half of the capacity count as long; of the three plans, that of fewest sequences is
    taken, the first of equals. With half, long items are alone, and the whole is best-fit decreasing.
    """
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best, fewest = [], -1
    for small in (capacity // 8, capacity // 4, capacity // 2):
        found = _plan(histogram, capacity, groups, small)
        used = max((first + n for _, _, n, first, _ in found), default=0)
        if fewest < 0 or used < fewest:
            best, fewest = found, used
        if fewest == least:
            break
    return best


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[int, int, int, int, int]]:
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    free: dict[int, list[tuple[int, int]]] = {}  # room -> intervals of sequences (first, count)
    rooms: list[int] = []

    def give(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    # Linear grouping: equal cardinality, rounded up to the longest of the group.
    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    runs: dict[int, list[list[int]]] = {}  # rounded size -> runs [length, count]
    share, room_left, size = -(-total // groups) if total else 0, 0, 0
    for n in large:
        c = left[n]
        while c:
            if room_left == 0:
                size, room_left = n, share
            m = min(c, room_left)
            runs.setdefault(size, []).append([n, m])
            room_left -= m
            c -= m
    if runs:
        sizes = np.array(sorted(runs, reverse=True))
        demand = np.array([sum(m for _, m in runs[s]) for s in sizes.tolist()], float)
        for pattern, n in _configurations(sizes, demand, capacity):
            # Actual documents take the places of n sequences of this pattern.
            segments = [(sequences, n, 0)]
            sequences += n
            for s in np.repeat(sizes, pattern).tolist():
                after = []
                for first, m, used in segments:
                    while m and runs[s]:
                        length, have = runs[s][0]
                        take = min(m, have)
                        put(length, take, first, used)
                        after.append((first, take, used + length))
                        first, m = first + take, m - take
                        runs[s][0][1] -= take
                        if not runs[s][0][1]:
                            runs[s].pop(0)
                    if m:
                        after.append((first, m, used))
                segments = after
            for first, m, used in segments:
                give(capacity - used, first, m)

    # Best fit, longest first.
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left[length] // (capacity // length))
                give(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[at]
            first, n = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
            m = min(n, left[length])
            put(length, m, first, capacity - room)
            give(room - length, first, m)
            give(room, first + m, n - m)
    return out


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = 40, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to every row of pieces, which must be a table (it is read three times).

    Lengths run from 1 to capacity. Rows of one length are numbered in blocks of about 50,000, counted first, so that
    a length that a third of all rows share is spread over many tasks. Equal rows get different places. An empty
    table gives an empty table. Columns called sequence_id or offset are replaced.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(F.col(length_col).cast("long").alias("__length"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), row_hash(pieces).alias("__hash"))
    n = pieces.count()
    rows = rows.withColumn("__block", F.pmod("__hash", F.lit(max(1, -(-n // 50_000)))))
    blocks = rows.groupBy("__length", "__block").agg(F.count("*").alias("__n"))
    histogram = {r[0]: r[1] for r in blocks.groupBy("__length").agg(F.sum("__n")).collect()}  # at most `capacity` rows
    table = sorted(plan(histogram, capacity, groups))
    steps = np.array(table, np.int64).reshape(-1, 5)
    keys = steps[:, 0] * 2**44 + steps[:, 1]
    order = Window.partitionBy("__length").orderBy("__block")
    starts = blocks.withColumn("__from", F.sum("__n").over(order) - F.col("__n")).drop("__n")
    within = Window.partitionBy("__length", "__block").orderBy(F.xxhash64("__hash"))
    ranked = (
        rows.withColumn("__at", F.row_number().over(within) - 1)
        .join(starts, ["__length", "__block"])
        .select("__row", "__length", (F.col("__from") + F.col("__at")).cast("long").alias("__rank"))
    )

    def place(batches):
        for b in batches:
            length, rank = column(b, "__length").to_numpy(), column(b, "__rank").to_numpy()
            at = np.searchsorted(keys, length * 2**44 + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [column(b, "__row"), pa.array(steps[at, 3] + rank - steps[at, 1]), pa.array(steps[at, 4])], ["__row", "__sequence", "__offset"]
            )

    schema = ranked.select("__row", F.col("__rank").alias("__sequence"), F.col("__rank").alias("__offset")).schema
    out = ranked.mapInArrow(place, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in names], F.col("__sequence").alias("sequence_id"), F.col("__offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, hold: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: documents tokenized, cut and packed.

    The ids themselves come from tokenize(); here their checksum is kept, so that the table that is ranked is narrow.
    hold is tokenize()'s.
    """
    pieces = tokenize(docs, tokenizer, capacity, hold=hold).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut(pieces, "pieces"), capacity)
