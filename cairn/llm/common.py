"""What the text operators share: tables, cut lineage, arrow batches, fixed-size filters."""

from __future__ import annotations

import ctypes
import functools
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that a Python function takes up at a time: texts may be long, and a worker holds them several times over.
SLICE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = SLICE):
    """Arrow batches in pieces of at most `rows` rows, without copying."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def freeing(run):
    """run, a generator function over a task's batches; when it ends and what it held is gone, the worker gives free memory back to
    the system. Workers live on from task to task, and without this each keeps the most that any of its tasks took."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets an own one; on
    a cluster that is an error, as executors don't see each other's local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The tables of each open scratch, innermost last; each thread of a driver has its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that cut() writes meanwhile when it ends; those of keep() stay."""
    own: list[str] = []
    outer = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(outer)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str = "cut", level: int = 1, file_rows: int = 0, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor costs nothing. file_rows:
    rows of a file at most, for tables of very large rows, as a task reads many rows of a file at once; 0 sets no bound. by: a column
    whose values get a folder each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    open_now = _OPEN.get()
    if len(open_now) >= level:
        open_now[-level].append(path)
    (df.repartition(by).write.partitionBy(by) if by else df.write).option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """cut() of what outlives the innermost scratch: it belongs to the one around that, or to the caller."""
    return cut(df, name, 2)


def sha(col: Column | str) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8."""
    return F.sha2(F.encode(col, "UTF-8"), 256)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row, of all its columns but those that hold maps, which Spark doesn't hash."""
    return F.xxhash64(F.lit(0), *[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, vectorised; equal on every machine."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word -> 64-bit hash of its UTF-8; emptied when it holds too many words."""

    def __init__(self, cap: int = 400_000):
        super().__init__()
        self.cap = cap

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.cap:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def chunks(texts: list[str], most: int = 1_000_000):
    """Index ranges of about `most` characters, so that word lists stay small."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


# A filter of bounded size: false positives only cost work, as an exact join follows.

#: Bits of the largest bitmap, 8 MB.
MOST_BITS = 26


def bitmap(df: DataFrame, hash_col: str, bits: int | None = None) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes, made by grouped bit_or, of 2**bits bits: by default the least power that is
    over 16 bits a row, so that one in sixteen others passes at most, within 2**16 and 2**MOST_BITS. At most 8 MB reach
    the driver whatever the input's size; a fuller bitmap lets more rows pass, which is slower but still right."""
    if bits is None:
        bits = min(MOST_BITS, max(16, (16 * df.count()).bit_length()))
    at = F.expr(f"({hash_col} & {2**bits - 1})")
    words = (
        df.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({hash_col} & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(2 ** (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.uint64) & np.uint64(bits.size * 64 - 1)
    return (bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
