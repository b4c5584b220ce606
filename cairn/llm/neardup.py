"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

A document has two collections of eight minhashes. A table's key is one minhash of each, so sixteen minhashes make
64 tables; two sets of similarity 0.75 share no key with probability 2 * 0.25**8 = 0.00003. Sixteen more minhashes
refine keys that very many sets share, and all 32 estimate a pair's similarity before it is verified.

Equal sets are one class from the start. Three steps then find the links between classes that share a key:

1. Stars. Within a key each class is paired with one centre only, the class that meets most others over all its keys: of
   a text and its edited copies, the text. Pairs are verified on full sets, and the links join classes to components.
2. Around a centre. A class keeps its exact difference from its main centre, the tested one that meets most classes. The
   symmetric difference of two classes of one centre is that of their differences, so such pairs are judged exactly
   without their sets: in blocks, each class once, and only those not linked with the centre against the others. A block
   gives one link for each two components that it joins.
3. Between centres. Keys that still hold several components of several centres give the plausible pairs of different
   centres and components; these are verified on full sets.

So of n edited copies of a text, those near enough to the text to share it as a centre cost about n rows and not n*n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import WordHashes, bitmap, chunks, column, cut, freeing, in_bitmap, keep, mix64, scratch, slices, texts_of
from cairn.llm.components import components, rejoined

HASHES, SIDE = 32, 8
#: Agreeing minhashes of 32 from which a pair is verified; a pair of similarity 0.75 has fewer with probability 0.000003.
AGREE = 12
#: Sets in a key, or differences around a centre, that are compared in one block.
BLOCK = 2048
#: Bytes of differences in such a block.
BLOCK_BYTES = 32 * 2**20


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; with fewer words, of the whole sequence."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = mix64(h, 41) ^ words[j : n - size + 1 + j]
    return np.unique(mix64(h, 42))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    seeds = mix64(np.arange(HASHES, dtype=np.uint64), 43)
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = (shingles[i : i + 4096, None] ^ seeds[None, :]) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out = np.minimum(out, (x >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def sets(batches, k: int):
    """(batch, index of the first, shingle sets of some texts in a row), through all texts."""
    hashes = WordHashes()
    for b in slices(batches):
        texts = texts_of(b, "text")
        for i, j in chunks(texts):
            yield b, i, [shingle_set(hashes.of(t.encode().lower().split()), k) for t in texts[i:j]]


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the set), marks (32 minhashes of 32 bits). docs: doc_id (long), text."""

    def run(batches):
        import xxhash

        for b, i, found in sets(batches, k):
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").slice(i, len(found)), pa.array([len(s) for s in found], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([minhashes(s).tobytes() for s in found], pa.binary())],
                ["doc_id", "n", "d1", "d2", "marks"],
            )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), "doc_id long, n long, d1 long, d2 long, marks binary")


def _matrix(marks: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(marks.to_pylist()), np.uint32).reshape(-1, HASHES)


def tensored(df: DataFrame, first: int = 0, keep_bits=None) -> DataFrame:
    """df's columns but marks, with a key for each pair of a minhash from first.. and one from first+8.., and its table's
    number; an own key and table column refines. keep_bits: the broadcast bitmap of the only keys that are wanted."""
    names = [c for c in df.columns if c not in ("marks", "key", "table")]
    refine = "key" in df.columns

    def run(batches):
        pairs = np.arange(SIDE * SIDE, dtype=np.uint64)
        for b in slices(batches, 2000):
            m = _matrix(column(b, "marks")).astype(np.uint64)
            one, two = m[:, first : first + SIDE], m[:, first + SIDE : first + 2 * SIDE]
            keys = mix64((one[:, :, None] << np.uint64(32) | two[:, None, :]).reshape(len(m), -1) ^ mix64(pairs, 44)[None, :], 45 + first)
            if refine:
                keys = mix64(keys ^ column(b, "key").to_numpy().view(np.uint64)[:, None], 46)
            own = np.tile(np.arange(SIDE * SIDE), (len(m), 1))
            if refine:
                own = own + SIDE * SIDE * (1 + column(b, "table").to_numpy()[:, None])
            at, keys, own = np.repeat(np.arange(len(m)), SIDE * SIDE), keys.reshape(-1), own.reshape(-1)
            if keep_bits is not None:
                some = np.flatnonzero(in_bitmap(keep_bits.value, keys))
                at, keys, own = at[some], keys[some], own[some]
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own.astype(np.int32)), *(column(b, c).take(at) for c in names)], ["key", "table", *names])

    return df.mapInArrow(freeing(run), df.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("table"), *names).schema)


def _likely(pairs: DataFrame, sharing: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, and other columns) whose sizes and minhashes don't rule them out, with both sets' digests dx and dy."""
    names = [c for c in pairs.columns if c not in ("x", "y")]
    side = lambda c: sharing.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("d1").alias(f"d{c}"), F.col("marks").alias(f"m{c}"))
    near = pairs.join(side("x"), "x").join(side("y"), "y").filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))

    def plausible(batches):
        for b in batches:
            same = (_matrix(column(b, "mx")) == _matrix(column(b, "my"))).sum(1)
            yield b.select(["x", "dx", "y", "dy", *names]).filter(pa.array(same >= AGREE))

    near = near.select("x", "dx", "mx", "y", "dy", "my", *names)
    return near.mapInArrow(freeing(plausible), near.drop("mx", "my").schema)


def verify(likely: DataFrame, docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """x, y, ok (100 * intersection >= percent * union), ny and difference of the pairs (x, dx, y, dy, best): y's size and, of
    `best` pairs, the sorted hashes of the symmetric difference.

    The texts are read again only for documents that a bitmap of each side lets through, and their sets are joined to
    both sides of the pairs.
    """
    spark = likely.sparkSession
    xs, ys = (spark.sparkContext.broadcast(bitmap(likely.select(F.xxhash64(c).alias("h")).distinct(), "h")) for c in ("x", "y"))

    def wanted(batches):
        for b in batches:
            h = column(b, "h").to_numpy()
            yield b.filter(pa.array(in_bitmap(xs.value, h) | in_bitmap(ys.value, h)))

    def run(batches):
        import xxhash

        for b, i, found in sets(wanted(batches), k):
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found), np.int64).reshape(-1, 2)
            h = column(b, "h").slice(i, len(found)).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").slice(i, len(found)), pa.array(digest[:, 0]), pa.array(in_bitmap(xs.value, h)), pa.array(in_bitmap(ys.value, h)), pa.array([s.tobytes() for s in found], pa.binary())],
                ["id", "d", "as_x", "as_y", "shingles"],
            )

    full = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    full = cut(full.mapInArrow(freeing(run), "id long, d long, as_x boolean, as_y boolean, shingles binary"), "sets")
    of = lambda c: full.filter(f"as_{c}").select(F.col("id").alias(c), F.col("d").alias(f"d{c}"), F.col("shingles").alias(f"s{c}"))
    joined = likely.join(of("x"), ["x", "dx"]).join(of("y"), ["y", "dy"]).select("x", "y", "best", "sx", "sy")

    def confirm(batches):
        for whole in batches:
            ok, size, apart = [], [], []
            for a, b, best in zip(column(whole, "sx"), column(whole, "sy"), column(whole, "best").to_pylist()):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                d = np.setxor1d(a, b, assume_unique=True)
                ok.append((100 - percent) * (len(a) + len(b)) >= (100 + percent) * len(d))  # the same as 100 * both >= percent * union
                size.append(len(b))
                apart.append(d.tobytes() if best else None)
            yield pa.RecordBatch.from_arrays([column(whole, "x"), column(whole, "y"), pa.array(ok, pa.bool_()), pa.array(size, pa.int64()), pa.array(apart, pa.binary())], ["x", "y", "ok", "ny", "difference"])

    return joined.mapInArrow(freeing(confirm), "x long, y long, ok boolean, ny long, difference binary")


def _groups(batches, keys: list[str]):
    """Tables of the rows that agree in `keys`, from batches sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        cols = [t.column(c).to_numpy() for c in keys]
        edge = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        starts = np.concatenate([[0], edge])
        for lo, hi in zip(starts[:-1], starts[1:]):
            yield t.slice(lo, hi - lo)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


class Forest:
    """Labels that are joined one by one; `links` are the joins that made two components one."""

    def __init__(self):
        self.up, self.links = {}, []

    def root(self, label: int) -> int:
        while (up := self.up.get(label, label)) != label:
            self.up[label] = self.up.get(up, up)
            label = up
        return label

    def join(self, a: int, b: int) -> None:
        one, two = self.root(a), self.root(b)
        if one != two:
            self.up[max(one, two)] = min(one, two)
            self.links.append((a, b))


def judged_around(n: list[np.ndarray], label: list[np.ndarray], difference: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between labels: every set of the first side against every one of the second, all around one centre.

    A side is (sizes, labels, sorted differences from the centre). Common hashes are counted for all of the second side at
    once, by its inverted list.
    """
    forest, others = Forest(), len(n[1])
    flat = np.concatenate(difference[1]) if others else np.zeros(0, np.uint64)
    size = np.array([len(d) for d in difference[1]], np.int64)
    order = np.argsort(flat, kind="stable")
    owner, flat = np.repeat(np.arange(others), size)[order], flat[order]
    for i, own in enumerate(difference[0]):
        if (label[1] == label[0][i]).all():
            continue
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        count = hi - lo
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(owner[at], minlength=others)
        near = (100 - percent) * (n[0][i] + n[1]) >= (100 + percent) * (len(own) + size - 2 * both)
        for other in np.unique(label[1][near & (label[1] != label[0][i])]).tolist():
            forest.join(int(label[0][i]), other)
    return forest.links


def around_centres(apart: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """x, y: labels that are linked through two classes of one centre. apart: id, centre, n, difference.

    The classes in the centre's own component are linked with each other already. The others, the rest, meet each other and
    these, in blocks that rows are dealt to by hash, so that no task gets more than two of them.
    """
    label = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    slim = apart.select("id", "centre", F.octet_length("difference").alias("bytes"))
    slim = slim.join(label("id"), "id", "left").join(label("centre"), "centre", "left")
    slim = slim.select("id", "centre", "bytes", F.coalesce("id_label", "id").alias("label"), F.coalesce("centre_label", "centre").alias("main"))
    slim = cut(slim.withColumn("rest", F.col("label") != F.col("main")), "slim")
    blocks = lambda c: F.greatest(F.ceil(F.count(F.when(c, 1)) / F.lit(BLOCK)), F.ceil(F.sum(F.when(c, F.col("bytes"))) / F.lit(BLOCK_BYTES)), F.lit(0))
    sizes = slim.groupBy("centre").agg(blocks(F.col("rest")).cast("int").alias("rests"), blocks(~F.col("rest")).cast("int").alias("mains"))
    sizes = cut(sizes.filter("rests > 0"), "sizes")  # cut, so that the join can split a centre of very many classes
    place = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), F.col("rests"))).otherwise(F.col("rests") + F.pmod(F.xxhash64("id"), F.greatest("mains", F.lit(1)))).cast("int")
    dealt = slim.join(sizes, "centre").withColumn("place", place)
    # Blocks are numbered, those of the rest first; a block of the rest meets itself and all later ones.
    with_all = F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1)
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("rest"), with_all).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))))
    dealt = dealt.select("id", "centre", "label", "place", F.least("place", "other").alias("one"), F.greatest("place", "other").alias("two"))
    rows = dealt.join(apart.select("id", "n", "difference"), "id")

    def run(batches):
        for t in _groups(batches, ["centre", "one", "two"]):
            place, label, n = (t.column(c).to_numpy() for c in ("place", "label", "n"))
            apart = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("difference")]
            one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
            sides = [np.flatnonzero(place == p) for p in (one, two)]
            found = judged_around([n[s] for s in sides], [label[s] for s in sides], [[apart[i] for i in s] for s in sides], percent)
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    keys = ["centre", "one", "two"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(freeing(run), "x long, y long").distinct()


ROW = ("key", "table", "id", "n", "label", "centre", "place", "marks")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """x, y: plausible pairs of different components and different centres in each key. rows: ROW; a key has few enough rows.
    place: of two blocks that meet, the row's own, as only pairs across are made there; else -1."""

    def first_shared(x, y):
        """The number of the first table of two collections that two rows share; only there is their pair made."""
        same = x == y
        return same[:, :SIDE].argmax(1) * SIDE + same[:, SIDE:].argmax(1)

    def pairs(key, table, ids, n, label, centre, place, marks):
        out = []
        at, d = np.arange(len(key) - 1), 1
        while len(at):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            a, b = at, at + d
            ok = (label[a] != label[b]) & (centre[a] != centre[b]) & ((place[a] < 0) | (place[a] != place[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            base, deep = table[a] < SIDE * SIDE, table[a] - SIDE * SIDE
            first, second = first_shared(marks[a][:, : 2 * SIDE], marks[b][:, : 2 * SIDE]), first_shared(marks[a][:, 2 * SIDE :], marks[b][:, 2 * SIDE :])
            ok = np.where(base, table[a] == first, (deep // SIDE**2 == first) & (deep % SIDE**2 == second))
            a, b = a[ok], b[ok]
            ok = (marks[a] == marks[b]).sum(1) >= AGREE
            if ok.any():
                out.append(np.stack([a[ok], b[ok]]))
            d += 1
        if not out:
            return np.zeros((0, 2), np.int64)
        a, b = np.concatenate(out, axis=1)
        return np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1), axis=0)

    def run(batches):
        rest = None
        for b in batches:
            now = [column(b, c).to_numpy() for c in ROW[:-1]] + [_matrix(column(b, "marks"))]
            rest = now if rest is None else [np.concatenate(p) for p in zip(rest, now)]
            if not len(rest[0]):
                continue
            end = int(np.searchsorted(rest[0], rest[0][-1]))  # the last key may go on in the next batch
            if end:
                found = pairs(*(c[:end] for c in rest))
                rest = [c[end:] for c in rest]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])
        if rest is not None and len(rest[0]):
            found = pairs(*rest)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(run), "x long, y long").distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """key, size (the number of rows) of the keys that hold several components and several centres."""
    differ = lambda c: F.min(c) < F.max(c)
    keys = rows.groupBy("key").agg(F.count("*").alias("size"), differ("label").alias("labels"), differ("centre").alias("centres"))
    return cut(keys.filter("labels and centres").select("key", "size"), "mixed")  # cut, so that the join can split a key of very many rows


def _between_centres(sharing: DataFrame, labels: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """x, y: the plausible pairs of different components and different centres that share a key."""
    facts = sharing.select("id", "tables").join(labels, "id", "left").join(centres, "id", "left")
    facts = cut(facts.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("centre", "id").alias("centre"), "tables"), "facts")
    rows = facts.select("id", "label", "centre", F.explode("tables").alias("t")).select("t.key", "t.table", "id", "label", "centre")
    # Each class's mixed keys are gathered (at most 64), so that its minhashes are joined once.
    mixed = rows.join(_mixed(rows), "key").groupBy("id", "label", "centre").agg(F.collect_list(F.struct("key", "table", "size")).alias("t"))
    mixed = cut(mixed.join(sharing.select("id", "n", "marks"), "id"), "rows")
    rows = mixed.withColumn("t", F.explode("t")).select("t.key", "t.table", "id", "n", "label", "centre", F.lit(-1).cast("long").alias("place"), "marks", "t.size")
    small, large = rows.filter(F.col("size") <= BLOCK).select(*ROW), rows.filter(F.col("size") > BLOCK)
    if not large.isEmpty():
        # Very common keys are refined by the other sixteen minhashes; what is still too large goes block by block.
        finer = tensored(large.withColumn("copy", F.col("marks")).select(*ROW, "copy"), 2 * SIDE).distinct()
        finer = cut(finer.join(_mixed(finer), "key").withColumnRenamed("copy", "marks"), "finer")
        small = small.unionByName(finer.filter(F.col("size") <= BLOCK).select(*ROW))
        rest = finer.filter(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rest = rest.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).withColumn("place", F.when(F.col("block") != F.col("other"), F.col("block")).otherwise(-1))
        small = small.unionByName(rest.select(*ROW))
    return _across(small, percent)


def sharing_classes(classes: DataFrame) -> DataFrame:
    """id, d1, n, marks, met, tables (at most 64 of key, table, size): the classes that share a key, and how often.

    Keys are counted first; the keys of two classes or more pass a bitmap and are joined with their counts, so that a key
    that very many classes have is split.
    """
    marked = classes.select("id", "marks")
    counts = cut(tensored(marked).groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "counts")
    bits = classes.sparkSession.sparkContext.broadcast(bitmap(counts, "key"))
    shared = tensored(marked, keep_bits=bits).join(counts, "key")
    mine = shared.groupBy("id").agg(F.sum(F.col("size") - 1).alias("met"), F.collect_list(F.struct("key", "table", "size")).alias("tables"))
    return classes.select("id", "d1", "n", "marks").join(mine, "id")


def stars(sharing: DataFrame) -> DataFrame:
    """x, y, met: each class y with the centre x of each of its keys, and how many classes the centre meets."""
    rows = sharing.select("id", "met", F.explode("tables.key").alias("key"))
    most: Column = F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("c")
    centres = cut(rows.groupBy("key").agg(most).select("key", (-F.col("c.minus")).alias("x"), F.col("c.met").alias("met")), "centres")
    return rows.select("key", F.col("id").alias("y")).join(centres, "key").filter(F.col("x") != F.col("y")).select("x", "y", "met").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs, as a table in the shared folder.

    Words are separated by ASCII white space, with A-Z in lower case. Sets are linked if 100 * intersection >=
    percent * union; a text without words is linked with nothing. component_id is the smallest doc_id reachable.
    Rows that repeat an id are judged each by its own text. A null id can't stand for others: its row gets the component of
    its equals, or null, and is kept only if none of them has an id.
    """
    with scratch(docs.sparkSession):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        sketched = cut(sketches(rows, k), "sketches")
        full = sketched.filter(F.col("n") > 0)
        classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("marks").alias("marks"))
        classes = cut(classes, "classes")
        sharing = cut(sharing_classes(classes.filter(F.col("id").isNotNull())), "sharing")
        with scratch(docs.sparkSession):
            likely = _likely(stars(sharing), sharing, percent)
            first = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("met"), "x", "dx", "dy")) == 1  # of at most 64 rows for each set
            likely = cut(likely.withColumn("best", first), "likely")
            verified = keep(verify(likely.select("x", "dx", "y", "dy", "best"), rows, k, percent), "verified")
            tested = keep(likely.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "tested")
        labels = components(verified.filter("ok").select("x", "y"))
        best = verified.filter(F.col("difference").isNotNull()).select(F.col("y").alias("id"), F.col("x").alias("centre"), F.col("ny").alias("n"), "difference")
        labels = rejoined(labels, cut(around_centres(best, labels, percent), "around"))
        pairs = _between_centres(sharing, labels, best.select("id", "centre"), percent).join(tested, ["x", "y"], "left_anti")
        likely = cut(_likely(pairs, sharing, percent).withColumn("best", F.lit(False)), "likely")
        if not likely.isEmpty():
            more = verify(likely, rows, k, percent).filter("ok").select("x", "y")
            named = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
            more = more.join(named("x"), "x", "left").join(named("y"), "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
            labels = rejoined(labels, cut(more.filter("x <> y").distinct(), "links"))

        of = classes.join(labels, "id", "left").select("d1", "d2", F.coalesce("label", "id").alias("component"))
        of = cut(of, "membership")
        linked = full.select("doc_id", "n", "d1", "d2").join(of, ["d1", "d2"]).select("doc_id", "n", "component")
        alone = sketched.filter(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component"))
        out = linked.unionByName(alone)
        return keep(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept")), "near")
