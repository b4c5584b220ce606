"""Vector helpers: cosine similarity as an expression, and blocked matrix products for joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a null or zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def matrix(col: pa.Array) -> np.ndarray:
    """Unit rows of an array<float> column without nulls, in double."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


#: Queries and memories in a block. Up to BLOCK queries in all are broadcast; more are dealt to tasks with the memories.
BLOCK, ROWS = 4096, 16384


def topk(queries: DataFrame, mem: DataFrame, k: int | str, minimum: float | None = None, weight: str | None = None) -> DataFrame:
    """query_id, id, similarity (and score, similarity times mem's column `weight`, where that is given): for each query at least
    its k best rows of its group (profile) with similarity over the minimum, before the final ranking. k is a number or the name of a
    column of queries, so that one pass serves queries of many limits.

    Up to BLOCK queries go to every task as a broadcast. More never pass through the driver: both sides of a profile are dealt
    into blocks by hash, and each pair of blocks meets in one task. Either way a task keeps k rows a query, by score and id,
    and only those are shuffled. Null vectors match nothing.
    """
    q = queries.filter(F.col("embedding").isNotNull()).select("query_id", "profile", "embedding", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("k"))
    rows = mem.filter(F.col("embedding").isNotNull()).select("id", "profile", "embedding", (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    out = f"query_id {dict(q.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, similarity double, score double"
    few = q.limit(BLOCK + 1).toArrow()  # at most BLOCK + 1 rows
    if few.num_rows <= BLOCK:
        sent = q.sparkSession.sparkContext.broadcast(few)
        found = rows.mapInArrow(lambda batches: _nearest(sent.value, batches, minimum), out)
    else:
        count = lambda df, name, size: df.groupBy("profile").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        blocks = count(q, "q_blocks", BLOCK).join(count(rows, "m_blocks", ROWS), "profile")
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = q.join(blocks, "profile").withColumn("i", own("query_id", "q_blocks")).withColumn("j", others("m_blocks"))
        right = rows.join(blocks, "profile").withColumn("j", own("id", "m_blocks")).withColumn("i", others("q_blocks"))
        keys = ["profile", "i", "j"]
        left = left.select(*[F.col(c).alias(c) for c in (*keys, "query_id", "embedding", "k")])  # columns of its own, also where both sides are one table
        right = right.select(*keys, "id", "embedding", "weight")

        def meet(own: pa.Table, others: pa.Table) -> pa.Table:
            return pa.Table.from_batches(_nearest(own, others.to_batches(), minimum))

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out)
    return found if weight else found.drop("score")


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k) -> np.ndarray:
    """The places of each query's k best rows, by score and then id. k: one number, or one for each query."""
    order = np.lexsort((ids, -score, query))
    sorted_query = query[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < (k if np.isscalar(k) else k[sorted_query])]


def _nearest(queries: pa.Table, batches, minimum: float | None):
    """One batch: the best rows of `batches` for each query of its profile, as many as its k."""
    limits = queries.column("k").to_numpy()
    q, wanted = matrix(queries.column("embedding").combine_chunks()), np.array(queries.column("profile").to_pylist(), object)
    kind = pa.null()
    kept: list[np.ndarray] | None = None
    for b in batches:
        kind = b.schema.field("id").type
        m, ids, group = matrix(b.column("embedding")), np.array(b.column("id").to_pylist()), np.array(b.column("profile").to_pylist(), object)
        weight = b.column("weight").to_numpy(zero_copy_only=False).astype(float)
        for p in set(wanted.tolist()) & set(group.tolist()) - {None}:
            mine, rows = np.flatnonzero(wanted == p), np.flatnonzero(group == p)
            for lo in range(0, len(rows), 4096):  # a product of bounded size
                part = rows[lo : lo + 4096]
                s = np.round(q[mine] @ m[part].T, 6)
                score = s * weight[part]
                over = np.ones(s.shape, bool) if minimum is None else s > minimum
                k = int(limits[mine].max())
                if 0 < k < len(part):
                    ranked = np.where(over, score, -np.inf)
                    over &= score >= np.partition(ranked, len(part) - k, axis=1)[:, len(part) - k, None]
                at, col = np.nonzero(over)
                new = [mine[at], score[at, col], ids[part[col]], s[at, col]]
                new = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
                best = _best(new[0], new[1], new[2], limits)
                kept = [x[best] for x in new]
    if kept is None:
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)]
    yield pa.RecordBatch.from_arrays(
        [queries.column("query_id").combine_chunks().take(pa.array(kept[0])), pa.array(kept[2]).cast(kind) if kind != pa.null() else pa.array([], pa.int64()), pa.array(kept[3]), pa.array(kept[1])],
        ["query_id", "id", "similarity", "score"],
    )


#: Distinct vectors of a cell in the mean, and centres of all profiles at most: these are sent to every task. Where angles prune little, each
#: query goes to most cells, so that smaller cells would mean more copies.
CELL, MOST_CENTRES = 16384, 4096
#: Queries and vectors of a cell that meet in a task, angles from centres that a task holds at once, and rows it gives on at once.
ASKS, MEMBERS, ANGLES, GIVEN = 32768, 65536, 1_000_000, 16384
#: Vectors that each centre is chosen from.
SAMPLE = 4


def _spread(m: np.ndarray) -> np.ndarray:
    """One in SAMPLE of the rows, each the farthest from those before it."""
    picked, near = [0], m @ m[0]
    for _ in range(-(-len(m) // SAMPLE) - 1):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, m @ m[picked[-1]])
    return m[picked]


def similar(queries: DataFrame, mem: DataFrame, k: int, minimum: float, products=None) -> DataFrame:
    """query_id, id, similarity: what topk() gives for a minimum, by an exact join that prunes in the metric.

    Rows with the same vector meet as one, with the k smallest ids, however many there are. Of a profile with more than CELL distinct
    vectors, a sample (by hash) is drawn, and of it those that are farthest apart are centres; each vector is in its nearest centre's cell, at its angle from it. Two vectors whose angles
    from a centre differ by more than the angle of the minimum can't be that similar: a query goes only to cells whose range of angles it
    can reach, and meets a cell's vectors, sorted by angle, in its own range only. Cells of many rows are split into blocks; a task holds
    a bounded part of a block's products, and no copies of queries for cells are stored. Up to BLOCK queries are broadcast as in topk(). products: an accumulator that counts the inner products of queries and vectors.
    """
    from cairn.operators.base import cut, top

    q = queries.filter(F.col("embedding").isNotNull()).select("query_id", "profile", "embedding")
    rows = mem.filter(F.col("embedding").isNotNull()).select("id", "profile", "embedding")
    if q.limit(BLOCK + 1).count() <= BLOCK:
        return topk(queries, mem, k, minimum)
    same = ["profile", "embedding"]
    rows = cut(top(rows, same, [F.asc("id")], k).groupBy(*same).agg(F.array_sort(F.collect_list("id")).alias("ids")))  # at most k ids each
    members = cut(q.join(q.groupBy(*same).agg(F.min("query_id").alias("class")), same))
    asked = members.filter(F.col("query_id") == F.col("class")).select("class", *same)
    counts = rows.groupBy("profile").count()
    cell = max(CELL, -(-rows.count() // MOST_CENTRES))
    chosen = rows.join(counts.filter(F.col("count") > cell), "profile").withColumn("n", SAMPLE * F.ceil(F.col("count") / cell))
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(F.xxhash64("embedding"), F.element_at("ids", 1)))).filter(F.col("place") <= F.col("n"))
    found = chosen.select("profile", "embedding").toArrow()  # at most 2 * SAMPLE * MOST_CENTRES rows: a profile of more than `cell` vectors has less than twice its share
    owner = np.array(found.column("profile").to_pylist(), object)
    centres = {p: _spread(matrix(found.filter(pa.array(owner == p)).column("embedding").combine_chunks())) for p in set(owner.tolist())}
    sent, reach = q.sparkSession.sparkContext.broadcast(centres), float(np.arccos(np.clip(minimum, -1, 1))) + 1e-6
    kinds = dict(rows.dtypes) | dict(asked.dtypes)

    def places(b: pa.RecordBatch):
        """For each profile of a batch with centres: some of its rows and their angles from each centre. Other rows are in cell -1."""
        group = np.array(b.column("profile").to_pylist(), object)
        for p in set(group.tolist()):
            at = np.flatnonzero(group == p)
            if p not in sent.value:
                yield p, at, None
                continue
            step = max(1, ANGLES // len(sent.value[p]))
            for some in (at[lo : lo + step] for lo in range(0, len(at), step)):
                yield p, some, np.arccos(np.clip(matrix(b.column("embedding").take(pa.array(some))) @ sent.value[p].T, -1, 1))

    def dealt(b: pa.RecordBatch, at, cells, angles) -> pa.RecordBatch:
        part = b.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32()), pa.array(angles, pa.float64())], [*part.schema.names, "cell", "angle"])

    def into_cells(batches):
        for b in batches:
            for _, at, angle in places(b):
                near = np.full(len(at), -1) if angle is None else np.argmin(angle, axis=1)
                yield dealt(b, at, near, np.zeros(len(at)) if angle is None else angle[np.arange(len(at)), near])

    right = cut(rows.select("ids", *same).mapInArrow(into_cells, f"ids {kinds['ids']}, profile string, embedding {kinds['embedding']}, cell int, angle double"))
    spans: dict = {}
    for r in right.filter("cell >= 0").groupBy("profile", "cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most")).collect():  # a row for each centre at most
        spans.setdefault(r["profile"], {})[r["cell"]] = (r["least"], r["most"])

    def reached(b: pa.RecordBatch):
        """For some rows of a batch: profile, the rows, and for each of them and each cell it can reach the row's place, the cell and the angle."""
        for p, at, angle in places(b):
            if angle is None:
                yield p, at, np.arange(len(at)), np.full(len(at), -1), np.zeros(len(at))
                continue
            least, most = (np.array([spans.get(p, {}).get(c, (np.inf, -np.inf))[i] for c in range(angle.shape[1])]) for i in (0, 1))
            i, c = np.nonzero((angle - reach <= most) & (angle + reach >= least))
            yield p, at, i, c, angle[i, c]

    def to_cells(batches):
        for b in batches:
            for _, at, i, c, angle in reached(b):
                for lo in range(0, len(i), GIVEN):
                    part = slice(lo, lo + GIVEN)
                    yield dealt(b, at[i[part]], c[part], angle[part])

    def counted(batches):
        for b in batches:
            for p, _, _, c, _ in reached(b):
                cell, n = np.unique(c, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], ["profile", "cell", "n"])

    left = asked.mapInArrow(to_cells, f"class {kinds['class']}, profile string, embedding {kinds['embedding']}, cell int, angle double")
    cells = ["profile", "cell"]
    size = lambda df, n, name, most: df.groupBy(*cells).agg(F.ceil(n / most).cast("int").alias(name))
    asks = asked.mapInArrow(counted, "profile string, cell int, n long")
    blocks = cut(size(asks, F.sum("n"), "q_blocks", ASKS).join(size(right, F.count("*"), "m_blocks", MEMBERS), cells))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(blocks, cells).withColumn("i", own("class", "q_blocks")).withColumn("j", others("m_blocks")).select(*cells, "i", "j", "class", "embedding", "angle")
    right = right.join(blocks, cells).withColumn("j", own("ids", "m_blocks")).withColumn("i", others("q_blocks")).select(*cells, "i", "j", "ids", "embedding", "angle")

    def meet(asks: pa.Table, rows: pa.Table) -> pa.Table:
        asks, rows = asks.sort_by("angle"), rows.sort_by("angle")
        a, beta = asks.column("angle").to_numpy(), rows.column("angle").to_numpy()
        x, y = matrix(asks.column("embedding").combine_chunks()), matrix(rows.column("embedding").combine_chunks())
        ids = rows.column("ids").combine_chunks()
        first = pa.compute.list_element(ids, 0).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)
        kept = []
        for lo in range(0, len(x), 256):
            hi = min(lo + 256, len(x))
            begin, end = np.searchsorted(beta, a[lo] - reach), np.searchsorted(beta, a[hi - 1] + reach, "right")
            if products is not None:
                products.add(int((hi - lo) * (end - begin)))
            at, row, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(hi - lo, float(minimum))
            for start in range(begin, end, 4096):
                s = x[lo:hi] @ y[start : min(start + 4096, end)].T
                i, col = np.nonzero(s > least[:, None] - 1e-6)
                value = np.round(s[i, col], 6)
                good = (value > minimum) & (value >= least[i])
                at, row, score = np.append(at, i[good]), np.append(row, start + col[good]), np.append(score, value[good])
                best = _best(at, score, first[row], k)
                at, row, score = at[best], row[best], score[best]
                n = np.bincount(at, minlength=hi - lo)
                full = np.flatnonzero(n >= k)
                least[full] = score[np.cumsum(n)[full] - 1]  # of k rows the last
            kept.append((lo + at, row, score))
        who, row, score = (np.concatenate([x[i] for x in kept]) if kept else np.zeros(0) for i in range(3))
        return pa.table([asks.column("class").take(pa.array(who.astype(np.int64))), ids.take(pa.array(row.astype(np.int64))), pa.array(score.astype(float))], ["class", "ids", "similarity"])

    import pyarrow.compute  # noqa: F401

    keys = [*cells, "i", "j"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"class {kinds['class']}, ids {kinds['ids']}, similarity double")
    best = top(met.select("class", "similarity", F.explode("ids").alias("id")), ["class"], [F.desc("similarity"), F.asc("id")], k)
    return members.select("query_id", "class").join(best, "class").select("query_id", "id", "similarity")


def register(spark: SparkSession) -> None:
    """cosine_similarity for SQL users, written with built-in functions; null for a null or zero vector."""
    sums = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (a, b) -> a + b)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN {sums('a', 'b')} / nullif(sqrt({sums('a', 'a')} * {sums('b', 'b')}), 0D)""")
