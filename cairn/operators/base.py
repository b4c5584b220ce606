"""Predicates and helpers that the operators share. Time is always a parameter; a memory that expires just now is neither active nor expired."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame, by: str | None = None, dealt: bool = True) -> DataFrame:
    """df written as a table in the folder all executors share and read again: a loop's lineage ends there. The folder is
    spark.checkpoint.dir; where it is unset, a local session gets an own one, and on a cluster that is an error. by: a column whose
    values get a folder each, so that a filter on it reads those only; unless dealt, each task writes its own files there, without a shuffle."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    ((df.repartition(by) if dealt else df).write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def active(as_of: Column, prefix: str = "") -> Column:
    e = F.col(f"{prefix}expires_at")
    return e.isNull() | (e > as_of)


def age_days(since: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(since)) / F.lit(86400e6)


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; the order must end in an id."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def active_memories(mem: DataFrame, as_of: Column, profiles: list[str] | None = None, tags: list[str] | None = None, source: str | None = None) -> DataFrame:
    """Active memories of the given profiles, with any of the tags, of the source; each filter is off when None."""
    keep = active(as_of)
    if profiles is not None:
        keep = keep & F.col("profile").isin(profiles)
    if tags is not None:
        keep = keep & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if source is not None:
        keep = keep & (F.col("source") == source)
    return mem.filter(keep)


def both_ways(edges: DataFrame) -> DataFrame:
    """An edge from each end; a self-edge once: id, other, and the other columns."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    ends = F.array_distinct(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other"))))
    return edges.select(F.explode(ends).alias("e"), *rest).select("e.id", "e.other", *rest)


def folded(rows: DataFrame, by: list[str], order: list[str], out: str, start, step, end) -> DataFrame:
    """One row for each group: by's columns and what end(state) gives, with a state that start(row) makes and step(state, row)
    changes, over the group's rows in order. Groups are sorted and streamed, so that a group of any size takes the memory of
    its state. rows: dicts of the columns."""

    def run(batches):
        import pyarrow as pa

        names, now, state = [x.split()[0] for x in out.split(", ")], None, None
        for b in batches:
            done = []
            for row in b.to_pylist():
                key = tuple(row[c] for c in by)
                if key != now or state is None:
                    if state is not None:
                        done.append((*now, *end(state)))
                    now, state = key, start(row)
                state = step(state, row)
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], kinds) if done else pa.RecordBatch.from_pylist([], kinds)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, *end(state))))], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(out))
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out)
