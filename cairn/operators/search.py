"""Search: tables of queries against the memory table, by vector and by keyword, fused by reciprocal rank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.vectors import topk
from cairn.operators.base import active, age_days, both_ways, cut, top
from cairn.operators.graph import related_memories


def explode_profiles(queries: DataFrame) -> DataFrame:
    """A query that names a set of profiles searches those instead of its own."""
    if "profiles" not in queries.columns:
        return queries
    return queries.withColumn("profile", F.explode(F.coalesce("profiles", F.array("profile")))).drop("profiles")


def _top(df: DataFrame, queries: DataFrame, order: list[Column], k: int | str) -> DataFrame:
    """The first k rows of each query; k is a number or the name of a column of queries."""
    if not isinstance(k, str):
        return top(df, ["query_id"], order, k)
    limits = queries.select("query_id", F.col(k).alias("__limit")).distinct()
    return top(df.join(limits, "query_id"), ["query_id"], order, F.col("__limit")).drop("__limit")


def vector_topk(queries: DataFrame, mem: DataFrame, as_of: Column, k: int | str = 10, minimum: float | None = None) -> DataFrame:
    """query_id, id, similarity, rank over active memories of the query's profile(s). k may name a column of queries."""
    found = topk(explode_profiles(queries), mem.filter(active(as_of)), k, minimum)
    return _top(found, queries, [F.desc("similarity"), F.asc("id")], k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 0)


def keyword_topk(queries: DataFrame, mem: DataFrame, as_of: Column, k: int | str = 10, method: str = "frequency", index: KeywordIndex | None = None) -> DataFrame:
    """query_id, id, keyword_rank, rank: active memories that hold all terms of the query, by r / (r + 1).

    r is, for `frequency`, the terms' occurrences over the text's length; for `cover`, the cover density (Clarke,
    Cormack and Tudhope) over the length. Only postings of the queries' terms leave a task; terms are matched before
    positions are looked at, so that common terms cost a count. `web` and `stemmed` take the text as a web query (web_topk).
    With an index (of `frequency` and `cover`) no content is read: a query's rarest term gives its candidates, its other terms are
    looked up for these, and positions for what then holds all terms.
    """
    if method in ("web", "stemmed"):
        return web_topk(queries, mem, as_of, k, method == "stemmed")
    q = explode_profiles(queries).select("query_id", "profile", F.array_distinct(tokens(F.col("text"))).alias("terms")).filter(F.size("terms") > 0)
    wanted = q.select("query_id", "profile", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    if index is not None:
        return _top(index.ranked(wanted, mem.filter(active(as_of)).select("id"), method), queries, [F.desc("keyword_rank"), F.asc("id")], k)
    words = mem.filter(active(as_of)).select("id", "profile", tokens(F.col("content")).alias("words")).withColumn("n_words", F.size("words"))
    postings = words.select("id", "profile", "n_words", F.posexplode("words").alias("position", "term")).join(wanted.select("term").distinct(), "term", "left_semi")
    postings = postings.groupBy("profile", "term", "id", "n_words").agg(F.sort_array(F.collect_list("position")).alias("positions") if method == "cover" else F.count("*").alias("tf"))
    found = wanted.join(postings, ["profile", "term"]).groupBy("query_id", "id", "n_words", "n_terms")
    if method == "frequency":
        scored = found.agg(F.count("*").alias("hit"), F.sum("tf").alias("r")).filter(F.col("hit") == F.col("n_terms")).withColumn("r", F.col("r") / F.col("n_words"))
    else:
        scored = found.agg(F.count("*").alias("hit"), F.collect_list("positions").alias("lists")).filter(F.col("hit") == F.col("n_terms")).withColumn("r", _cover_density()("lists") / F.col("n_words"))
    out = scored.select("query_id", "id", F.round(F.col("r") / (F.col("r") + 1), 6).alias("keyword_rank"))
    return _top(out, queries, [F.desc("keyword_rank"), F.asc("id")], k)


@dataclass(frozen=True)
class KeywordIndex:
    """A stored positional index of memories: postings (bucket, batch, profile, term, id, tf, n_words) and, beside them, places
    (positions of the term in the text), both dealt to folders by a hash of the term. A text's postings are made where it is read and
    written there, so that building shuffles nothing. Every change gives a new index and writes what it
    adds: inserted rows get the next batch, and `gone` (id, upto) says up to which batch an id's rows count no more."""

    postings: DataFrame
    places: DataFrame
    gone: DataFrame
    batch: int = 0
    buckets: int = 32

    @classmethod
    def build(cls, mem: DataFrame, buckets: int = 32) -> KeywordIndex:
        """mem: id, profile, content. Ids are unique."""
        postings, places = cls._written(mem, 0, buckets)
        return cls(postings, places, cut(mem.select("id", F.lit(0).alias("upto")).limit(0)), 0, buckets)

    @staticmethod
    def _written(mem: DataFrame, batch: int, buckets: int) -> tuple[DataFrame, DataFrame]:
        words = mem.select("id", "profile", tokens(F.col("content")).alias("words"))
        rows = words.mapInArrow(_postings, f"id {dict(words.dtypes)['id']}, profile string, term string, n_words int, positions array<int>")
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        whole = cut(rows.select(F.lit(batch).alias("batch"), "profile", "term", "id", F.size("positions").cast("long").alias("tf"), "n_words", "positions", bucket), by="bucket", dealt=False)
        return whole.drop("positions"), whole.select("batch", "profile", "term", "id", "positions", "bucket")

    def _without(self, ids: DataFrame, upto: int) -> DataFrame:
        return cut(self.gone.unionByName(ids.select("id", F.lit(upto).alias("upto"))).groupBy("id").agg(F.max("upto").alias("upto")))

    def insert(self, mem: DataFrame) -> KeywordIndex:
        """With more memories; one whose id is there takes its place."""
        postings, places = self._written(mem, self.batch + 1, self.buckets)
        return KeywordIndex(self.postings.unionByName(postings), self.places.unionByName(places), self._without(mem.select("id").distinct(), self.batch), self.batch + 1, self.buckets)

    def delete(self, ids: DataFrame) -> KeywordIndex:
        return KeywordIndex(self.postings, self.places, self._without(ids.select("id").distinct(), self.batch), self.batch, self.buckets)

    def compact(self) -> KeywordIndex:
        """The same, written anew after many changes."""
        zero = lambda df: cut(self._live(df).withColumn("batch", F.lit(0)), by="bucket")
        return KeywordIndex(zero(self.postings), zero(self.places), self.gone.limit(0), 0, self.buckets)

    def _live(self, df: DataFrame) -> DataFrame:
        return df.join(self.gone, "id", "left").filter(F.col("upto").isNull() | (F.col("batch") > F.col("upto"))).select(*df.columns)

    def ranked(self, wanted: DataFrame, ids: DataFrame, method: str) -> DataFrame:
        """query_id, id, keyword_rank of the given ids that hold all terms. wanted: query_id, profile, n_terms, term, once each."""
        asked = cut(wanted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")))
        own = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most `buckets` numbers
        terms = asked.select("profile", "term").distinct()
        of = lambda df: self._live(df.filter(F.col("bucket").isin(own)).join(terms, ["profile", "term"], "left_semi"))
        postings = cut(of(self.postings).join(ids, "id", "left_semi").select("profile", "term", "id", "tf", "n_words"))
        often = postings.groupBy("profile", "term").agg(F.count("*").alias("df"))
        by_df = Window.partitionBy("query_id", "profile").orderBy("df", "term")
        placed = asked.join(often, ["profile", "term"]).withColumn("place", F.row_number().over(by_df)).withColumn("met", F.count("*").over(Window.partitionBy("query_id", "profile"))).filter(F.col("met") == F.col("n_terms"))
        first = placed.filter("place = 1").join(postings, ["profile", "term"]).select("query_id", "profile", "n_terms", "id", "n_words", "tf")
        rest = placed.filter("place > 1").select("query_id", "profile", "term")
        looked = first.select("query_id", "profile", "id").join(rest, ["query_id", "profile"]).join(postings.select("profile", "term", "id", F.col("tf").alias("more")), ["profile", "term", "id"])
        others = looked.groupBy("query_id", "id").agg(F.count("*").alias("hit"), F.sum("more").alias("more"))
        both = first.join(others, ["query_id", "id"], "left").filter(F.coalesce("hit", F.lit(0)) + 1 == F.col("n_terms"))
        if method == "frequency":
            scored = both.select("query_id", "id", ((F.col("tf") + F.coalesce("more", F.lit(0))) / F.col("n_words")).alias("r"))
        else:
            left = cut(both.select("query_id", "profile", "id", "n_words"))
            found = left.join(asked.select("query_id", "profile", "term"), ["query_id", "profile"]).join(of(self.places).select("profile", "term", "id", "positions"), ["profile", "term", "id"])
            scored = found.groupBy("query_id", "id", "n_words").agg(F.collect_list("positions").alias("lists")).select("query_id", "id", (_cover_density()("lists") / F.col("n_words")).alias("r"))
        return scored.select("query_id", "id", F.round(F.col("r") / (F.col("r") + 1), 6).alias("keyword_rank"))


#: Words of texts whose postings are made at once.
WORDS = 1_000_000


def _postings(batches):
    """For batches of id, profile, words: a row for each term of each text, with its ascending positions."""
    import numpy as np
    import pyarrow as pa

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = part.column("words")
        lengths, row, position = _places(words)
        coded = words.flatten().dictionary_encode()
        key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        at = order[first]
        text = pa.array(row[at])
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(position[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [part.column("id").take(text), part.column("profile").take(text), coded.dictionary.take(coded.indices.take(pa.array(at))), pa.array(lengths[row[at]].astype(np.int32)), positions],
            ["id", "profile", "term", "n_words", "positions"],
        )

    for part in _pieces(batches):
        yield run(part)


def _places(words):
    """Of a list array: the lists' lengths, and each word's list and place there."""
    import numpy as np

    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return lengths, row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _pieces(batches):
    """Batches of about WORDS words, or of one text."""
    import numpy as np

    for b in batches:
        ends, lo = np.cumsum(b.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def cover_density(lists: list[list[int]], weight: float = 0.1) -> float:
    """Sum over minimal covers of weight / (1 + words in the cover that aren't terms)."""
    events = sorted((p, i) for i, one in enumerate(lists) for p in one)
    have, need, start, total = [0] * len(lists), len(lists), 0, 0.0
    for end, (p, i) in enumerate(events):
        need -= have[i] == 0
        have[i] += 1
        while need == 0:
            q, j = events[start]
            if have[j] == 1:  # the smallest window that ends here
                total += weight / (1 + (p - q + 1) - len(lists)) if p - q + 1 >= len(lists) else weight
                have[j] -= 1
                need += 1
            else:
                have[j] -= 1
            start += 1
    return total


def _cover_density():
    @F.pandas_udf("double")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: cover_density([list(one) for one in x]))

    return run


def stem(word: Column) -> Column:
    """A small suffix stripper for English: plurals, -ing and -ed after three letters or more."""
    plural = F.regexp_replace(F.regexp_replace(word, r"(?<=\p{L}{2})ies$", "y"), r"(?<=\p{L}{2}(?:ss|x|ch|sh))es$|(?<=\p{L}{2}[^su])s$", "")
    return F.regexp_replace(plural, r"(?<=\p{L}{3})(?:ing|ed)$", "")


def spellings(term: Column) -> Column:
    """All words whose stem() is the term, and some others."""
    ends = F.array(*[F.concat(term, F.lit(e + s)) for e in ("", "ing", "ed") for s in ("", "s", "es")])
    return F.when(F.endswith(term, F.lit("y")), F.array_append(ends, F.concat(F.substring(term, F.lit(1), F.length(term) - 1), F.lit("ies")))).otherwise(ends)


#: Words of queries that are sent to every task, some 20 MB, more meet the texts' words in a shuffle; and as many as are sent with their queries.
MOST_SENT, MOST_ASKED = 500_000, 50_000


def _sent(words: DataFrame) -> DataFrame:
    return F.broadcast(words) if words.limit(MOST_SENT + 1).count() <= MOST_SENT else words


def web_topk(queries: DataFrame, mem: DataFrame, as_of: Column, k: int | str = 10, stemmed: bool = False) -> DataFrame:
    """query_id, id, keyword_rank, rank for web-style queries: words and "phrases" that must all be there, -words and
    -"phrases" that must not, `or` between alternatives.

    r is the cover density of an alternative's words and phrases, summed over those that match, over the text's length; the
    rank is r / (r + 1). An alternative that only excludes matches nothing. Words that a mark joins are a phrase. Postings of the
    queries' terms only leave a task; a query's terms and their places in one text meet in one row. Stems of the queries' words are
    spelled out, so that no text's words are stemmed. Up to MOST_ASKED words of queries are sent to the texts, which are ranked where they
    are read; only ranks leave a task.
    """
    cut_up = (lambda c: F.transform(tokens(c), stem)) if stemmed else tokens
    parts = explode_profiles(queries).select("query_id", "profile", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))).alias("atom", "part"))
    w = Window.partitionBy("query_id", "profile")
    group = F.sum((F.col("part") == "or").cast("int")).over(w.orderBy("atom").rowsBetween(Window.unboundedPreceding, 0))
    atoms = parts.withColumn("group", group).filter("part <> 'or'").select("query_id", "profile", "group", "atom", F.col("part").startswith("-").alias("no"), cut_up(F.col("part")).alias("words")).filter(F.size("words") > 0)
    need = F.count_if(~F.col("no")).over(Window.partitionBy("query_id", "profile", "group"))
    wanted = cut(atoms.withColumn("need", need).filter("need > 0").select("query_id", "profile", "group", "atom", "no", "need", F.size("words").alias("n"), F.posexplode("words").alias("place", "term")))
    terms = wanted.select("term").distinct()
    spelled = cut(terms.select("term", F.explode(spellings(F.col("term"))).alias("word")).filter(stem(F.col("word")) == F.col("term")) if stemmed else terms.withColumn("word", F.col("term")))
    words = mem.filter(active(as_of)).select("id", "profile", tokens(F.col("content")).alias("words")).withColumn("n_words", F.size("words"))
    if wanted.limit(MOST_ASKED + 1).count() <= MOST_ASKED:
        sent = wanted.sparkSession.sparkContext.broadcast((wanted.orderBy("query_id", "group", "atom", "place").toArrow(), spelled.toArrow()))
        kinds = dict(words.dtypes) | dict(wanted.dtypes)
        scored = words.select("id", "profile", "words").mapInArrow(lambda batches: _web_scores(*sent.value, batches), f"query_id {kinds['query_id']}, id {kinds['id']}, r double")
        out = scored.select("query_id", "id", F.round(F.col("r") / (F.col("r") + 1), 6).alias("keyword_rank"))
        return _top(out, queries, [F.desc("keyword_rank"), F.asc("id")], k)
    postings = words.select("id", "profile", "n_words", F.posexplode("words").alias("position", "word")).join(_sent(spelled), "word")
    postings = postings.groupBy("profile", "term", "id", "n_words").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    met = wanted.join(postings, ["profile", "term"]).groupBy("query_id", "id", "n_words").agg(F.collect_list(F.struct("group", "atom", "no", "need", "n", "place", "positions")).alias("met"))

    @F.pandas_udf("double")
    def ranked(rows: pd.Series) -> pd.Series:
        return rows.map(web_rank)

    scored = met.withColumn("r", ranked("met") / F.col("n_words")).filter("r > 0")
    out = scored.select("query_id", "id", F.round(F.col("r") / (F.col("r") + 1), 6).alias("keyword_rank"))
    return _top(out, queries, [F.desc("keyword_rank"), F.asc("id")], k)


def _web_scores(wanted, spelled, batches):
    """query_id, id, r for batches of id, profile, words: what web_rank() gives over a text's words, for all queries of its profile."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    code = {t: i for i, t in enumerate(dict.fromkeys(wanted.column("term").to_pylist()))}
    words, of = spelled.column("word").combine_chunks(), np.array([code[t] for t in spelled.column("term").to_pylist()], np.int64)
    asked: dict = {}  # by profile and query: its alternatives' need and atoms
    for m in wanted.select(["query_id", "profile", "group", "atom", "no", "need", "term"]).to_pylist():
        groups = asked.setdefault((m["profile"], m["query_id"]), {})
        groups.setdefault(m["group"], (m["need"], {}))[1].setdefault(m["atom"], (m["no"], []))[1].append(code[m["term"]])
    ids, plans, by_term = [], [], {}
    for (profile, query), groups in asked.items():
        for c in {c for _, atoms in groups.values() for no, codes in atoms.values() if not no for c in codes}:
            by_term.setdefault((profile, c), []).append(len(ids))
        ids.append(query)
        plans.append([(need, list(atoms.values())) for need, atoms in groups.values()])
    query_ids = pa.array(ids, wanted.schema.field("query_id").type)

    def rank(plan, there: dict) -> float:
        total = 0.0
        for need, atoms in plan:
            starts, excluded = [], False
            for no, codes in atoms:
                if any(c not in there for c in codes):
                    continue
                at = there[codes[0]]
                if len(codes) > 1:
                    at = sorted(set(at).intersection(*({p - i for p in there[c]} for i, c in enumerate(codes) if i)))
                excluded |= bool(no and at)
                if at and not no:
                    starts.append(at)
            if len(starts) == need and not excluded:
                total += _alone(len(starts[0])) if need == 1 else cover_density(starts)
        return total

    for part in _pieces(batches):
        lengths, row, position = _places(part.column("words"))
        coded = part.column("words").flatten().dictionary_encode()
        place = pa.compute.index_in(coded.dictionary, words).fill_null(-1).to_numpy(zero_copy_only=False)
        terms = np.append(of, -1)[place][coded.indices.to_numpy(zero_copy_only=False)] if len(coded.dictionary) else np.zeros(0, np.int64)
        mine = np.flatnonzero(terms >= 0)
        mine = mine[np.lexsort((terms[mine], row[mine]))]
        bounds = np.flatnonzero(np.diff(row[mine] * (len(code) + 1) + terms[mine], prepend=-1))
        texts: dict = {}
        for lo, hi in zip(bounds, np.append(bounds[1:], len(mine))):
            texts.setdefault(int(row[mine[lo]]), {})[int(terms[mine[lo]])] = position[mine[lo:hi]].tolist()
        found, profiles = ([], [], []), part.column("profile")
        for i, there in texts.items():
            profile = profiles[i].as_py()
            for q in {q for c in there for q in by_term.get((profile, c), ())} if profile is not None else ():
                if (total := rank(plans[q], there)) > 0:
                    for column, x in zip(found, (q, i, total / lengths[i])):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(found[0], pa.int64())), part.column("id").take(pa.array(found[1], pa.int64())), pa.array(found[2], pa.float64())], ["query_id", "id", "r"])


@lru_cache(maxsize=100_000)
def _alone(n: int) -> float:
    """cover_density() of n places of one word, which is a cover each."""
    return cover_density([list(range(n))])


def web_rank(met) -> float:
    """The summed cover density of the alternatives that a text matches. met: a term's places in the query and in the text."""
    groups: dict = {}
    for m in met:
        atom = groups.setdefault(m["group"], (m["need"], {}))[1].setdefault(m["atom"], (m["no"], m["n"], {}))
        atom[2][m["place"]] = m["positions"]
    total = 0.0
    for need, atoms in groups.values():
        starts, excluded = [], False
        for no, n, places in atoms.values():
            if len(places) < n:
                continue
            at = set(places[0])
            for i in range(1, n):
                at &= {p - i for p in places[i]}
            excluded |= bool(no and at)
            if at and not no:
                starts.append(sorted(at))
        if len(starts) == need and not excluded:
            total += cover_density(starts)
    return total


def graph_boost(edges: DataFrame) -> DataFrame:
    """id, graph_boost: the sum of strengths of a memory's edges at either end; a self-edge counts once."""
    return both_ways(edges.select("source_id", "target_id", "strength")).groupBy("id").agg(F.sum("strength").alias("graph_boost"))


def match_memories(queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, threshold: float = 0.7, k: int = 10) -> DataFrame:
    """Similar memories by similarity x softplus(base-level activation) x confidence x graph boost. All over the threshold compete."""
    n = F.col("access_count") + 1
    level = F.log(n) - 0.5 * F.log(F.greatest(age_days(F.coalesce("last_accessed_at", "created_at"), as_of), F.lit(0.01)) / n)
    live = mem.filter(active(as_of)).join(graph_boost(edges), "id", "left")
    live = live.withColumn("weight", F.log1p(F.exp(level)) * F.col("confidence") * (1 + 0.2 * F.coalesce("graph_boost", F.lit(0.0))))
    found = topk(explode_profiles(queries), live, k, threshold, "weight").select("query_id", "id", "similarity", F.round("score", 6).alias("relevance"))
    return top(found, ["query_id"], [F.desc("relevance"), F.asc("id")], k)


def entity_overlap(query_tags: Column, tags: Column) -> Column:
    """0.4 times the share of the query's tags, repeats counted, that the memory has."""
    shared = F.size(F.filter(query_tags, lambda t: F.array_contains(tags, t)))
    return F.when(F.size(query_tags) > 0, shared / F.size(query_tags) * 0.4).otherwise(0.0)


def hybrid_search(
    queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, k: int | str = 10, w_text: float = 0.3, w_semantic: float = 0.7, rrf_k: int = 10, recency_decay: float | str = 0.0, method: str = "frequency"
) -> DataFrame:
    """query_id, id, relevance, rank: both legs' best 3k, fused by reciprocal rank (a missing rank is 3k) and boosted.

    k and recency_decay are numbers or names of columns of queries: searches of different limits then share one pass.
    """
    limit = "__three_k"
    asked = queries.withColumn(limit, 3 * (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int"))
    wide = limit if isinstance(k, str) else 3 * k
    semantic = vector_topk(asked, mem, as_of, wide).select("query_id", "id", "similarity", F.col("rank").alias("rank_s"))
    keyword = keyword_topk(asked, mem, as_of, wide, method).select("query_id", "id", "keyword_rank", F.col("rank").alias("rank_k"))
    fused = semantic.join(keyword, ["query_id", "id"], "full_outer")
    missing = F.lit(wide)
    if isinstance(k, str):
        fused, missing = fused.join(asked.select("query_id", limit), "query_id"), F.col(limit)
    score = w_semantic / (rrf_k + F.coalesce("rank_s", missing)) + w_text / (rrf_k + F.coalesce("rank_k", missing))
    return _boosted(fused.withColumn("score", score).drop(limit), queries, mem, edges, as_of, k, recency_decay, True)


def linear_fusion_search(queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, k: int = 10, w_text: float = 0.3, w_semantic: float = 0.7, method: str = "frequency") -> DataFrame:
    """The older form: a weighted sum of both scores, without importance; the baseline to compare with."""
    limit = 3 * k
    semantic = vector_topk(queries, mem, as_of, limit).select("query_id", "id", "similarity")
    keyword = keyword_topk(queries, mem, as_of, limit, method).select("query_id", "id", "keyword_rank")
    fused = semantic.join(keyword, ["query_id", "id"], "full_outer")
    score = w_semantic * F.coalesce("similarity", F.lit(0.0)) + w_text * F.coalesce("keyword_rank", F.lit(0.0))
    return _boosted(fused.withColumn("score", score), queries, mem, edges, as_of, k, 0.0, False)


def _boosted(fused: DataFrame, queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, k: int | str, recency_decay: float | str, importance: bool) -> DataFrame:
    facts = mem.select("id", "importance", "confidence", "access_count", "tags", "created_at")
    decay = F.col(recency_decay) if isinstance(recency_decay, str) else F.lit(recency_decay)
    joined = fused.join(facts, "id").join(graph_boost(edges), "id", "left").join(queries.select("query_id", F.col("tags").alias("query_tags"), decay.alias("decay")), "query_id")
    relevance = (
        F.col("score") * (F.col("importance") if importance else F.lit(1.0)) * (1 + 0.1 * F.log(F.col("access_count") + 1)) * F.col("confidence")
        * (1 + 0.2 * F.coalesce("graph_boost", F.lit(0.0))) * (1 + entity_overlap(F.col("query_tags"), F.col("tags"))) * F.exp(-F.col("decay") * age_days(F.col("created_at"), as_of))
    )
    out = joined.select("query_id", "id", F.round(relevance, 9).alias("relevance"))
    return _top(out, queries, [F.desc("relevance"), F.asc("id")], k)


def graph_augmented_search(queries: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, k: int = 10, depth: int = 1, **more) -> DataFrame:
    """The search's first k, and what the first five are related to, with relevance times the edge's strength; a memory
    found twice keeps the search row, else the first finder's. query_id, id, relevance, rank."""
    return augment(hybrid_search(queries, mem, edges, as_of, k, **more), mem, edges, as_of, k, depth)


def augment(base: DataFrame, mem: DataFrame, edges: DataFrame, as_of: Column, k: int, depth: int = 1) -> DataFrame:
    """A search's results with what the first five are related to: query_id, id, relevance, rank."""
    five = base.filter(F.col("rank") <= 5)
    near = related_memories(five.select(F.col("id").alias("start")).distinct(), edges, mem, as_of, depth)
    added = five.select("query_id", F.col("id").alias("start"), "relevance", F.col("rank").alias("finder")).join(near.select("start", "id", "strength", F.col("rank").alias("place")), "start")
    rows = base.select("query_id", "id", "relevance", F.lit(0).alias("finder"), F.lit(0).alias("place")).unionByName(
        added.select("query_id", "id", F.round(F.col("relevance") * F.col("strength"), 9).alias("relevance"), "finder", "place")
    )
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("finder", "place"))).filter("n = 1")
    return top(once.select("query_id", "id", "relevance"), ["query_id"], [F.desc("relevance"), F.asc("id")], k)


def topic_search(queries: DataFrame, summaries: DataFrame, k: int = 3, minimum: float = 0.4, level: str = "body") -> DataFrame:
    """query_id, id, similarity, rank, text, served: the k nearest fresh summaries, then only those over the minimum; a
    level that is missing falls back to the body. summaries: id, profile, status, embedding, content, short, one_line."""
    fresh = summaries.filter(F.col("status") == "fresh")
    found = top(topk(queries, fresh, k), ["query_id"], [F.desc("similarity"), F.asc("id")], k).filter(F.col("similarity") >= minimum)
    wanted = {"body": F.col("content"), "short": F.col("short"), "one_line": F.col("one_line")}[level]
    return found.join(fresh.select("id", F.coalesce(wanted, F.col("content")).alias("text"), F.when(wanted.isNull(), "body").otherwise(level).alias("served")), "id").select("query_id", "id", "similarity", "rank", "text", "served")


#: Words that one automaton looks for; more are dealt to several, each of which reads the texts.
MOST_WORDS = 100_000


def content_contains(mem: DataFrame, anchors: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """anchor_id, id, relevance (0.5): active memories that hold the anchor's longest word of over two letters, newest first.

    An automaton of all anchors' words (Aho and Corasick) reads each text once, whatever the number of anchors; what it finds joins the
    anchors by profile and word.
    """
    words = F.filter(F.split(F.lower("anchor"), r"\s+"), lambda w: F.length(w) > 2)
    longest = F.reduce(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    a = cut(anchors.select("anchor_id", "profile", longest.alias("word")).filter(F.length("word") > 0))
    wanted = a.select("word").distinct()
    shards = max(1, -(-wanted.count() // MOST_WORDS))
    texts = mem.filter(active(as_of)).select("id", "profile", "created_at", F.lower("content").alias("text"))
    out = f"id {dict(texts.dtypes)['id']}, profile string, created_at timestamp, word string"
    found = None
    for shard in range(shards):
        own = wanted.filter(F.pmod(F.xxhash64("word"), F.lit(shards)) == shard).toArrow().column("word").to_pylist()  # about MOST_WORDS rows
        held = texts.mapInArrow(_holding(own), out)
        found = held if found is None else found.unionByName(held)
    return top(found.join(a, ["profile", "word"]).select("anchor_id", "id", "created_at", F.lit(0.5).alias("relevance")), ["anchor_id"], [F.desc("created_at"), F.asc("id")], k)


def _holding(words: list[str]):
    """For batches of id, profile, created_at, text: a row for each word that a text holds anywhere."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for b in batches:
            had = [{w for _, w in automaton.iter(t)} if t and words else () for t in b.column("text").to_pylist()]
            at = pa.array([i for i, ws in enumerate(had) for _ in ws], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("id", "profile", "created_at")), pa.array([w for ws in had for w in ws], pa.string())], ["id", "profile", "created_at", "word"])

    return run


def find_by_metadata_key(mem: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value, id: memories whose metadata, a JSON object, has that value at its top level; a join, however many pairs are asked for. keys: key, value."""
    pairs = mem.select("id", F.explode(F.from_json("metadata", "map<string,string>")).alias("key", "value"))
    return pairs.join(keys.select("key", "value").distinct(), ["key", "value"]).select("key", "value", "id")


def occurrence_overlap(mem: DataFrame, ranges: DataFrame) -> DataFrame:
    """query_id, id, how: memories whose days [start, stop) meet the query's (`range`), or that recur on a weekday in it
    (`weekday`; 0 is Sunday). mem: id, profile, start, stop (dates), recurrence_days; ranges: query_id, profile, start, stop.

    Both sides fall into weeks, so that the range join is an equi-join; a pair that meets in several comes out once.
    """
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    weeks = F.explode(F.sequence(F.floor(days(F.col("start")) / 7), F.floor((days(F.col("stop")) - 1) / 7))).alias("week")
    asked = ranges.filter(F.col("start") < F.col("stop"))
    own = mem.filter(F.col("start") < F.col("stop")).select("id", "profile", "start", "stop", weeks)
    theirs = asked.select("query_id", "profile", F.col("start").alias("from"), F.col("stop").alias("until"), weeks)
    met = own.join(theirs, ["profile", "week"]).filter((F.col("start") < F.col("until")) & (F.col("from") < F.col("stop"))).select("query_id", "id", F.lit("range").alias("how"))
    each = F.explode(F.sequence(F.col("start"), F.least(F.date_sub("stop", 1), F.date_add("start", 6)))).alias("day")
    weekdays = asked.select("query_id", "profile", each).select("query_id", "profile", (F.dayofweek("day") - 1).alias("weekday"))
    recurring = mem.select("id", "profile", F.explode("recurrence_days").alias("weekday")).join(weekdays, ["profile", "weekday"]).select("query_id", "id", F.lit("weekday").alias("how"))
    return met.unionByName(recurring).distinct()
