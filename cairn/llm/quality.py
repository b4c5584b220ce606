"""Quality classifier by hierarchical empirical Bayes.

A document classifier gives the odds that a document is of low quality, and that it is toxic, from its words (a
lexicon with log-odds, learned from half of a bounded sample of labelled documents) and from its shape (learned with
the lexicon's evidence by logistic regression on binned features, from the other half). Grouped sums of these
probabilities give each host and each path within a host a Beta posterior: a host is shrunk toward the whole
corpus, a path toward its host, by strengths estimated from how much hosts and paths differ. A document's final
log-odds add its path's shift from the corpus.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import column, cut, freeing, slices, texts_of

HEADS = ("low", "toxic")
SHAPE = ("log_words", "distinct", "top_share", "upper", "symbols", "digits", "mean_length", "marks", "repeat_line", "short_lines")
PREFIXES = (4, 5, 6)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_ODD = b"#$%&*|!<>{}[]=~^\\/_+@"


def _words(text: str) -> Counter:
    return Counter(w.strip(".,!?;:\"'()") for w in text.lower().split())


def _terms(words) -> set:
    """A document's word features: its words, and the first letters of longer ones."""
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in PREFIXES if len(w) > n}


def shape(text: str, words: Counter) -> list[float]:
    raw, total = text.encode(), sum(words.values())
    n = max(1, len(raw))
    lines = text.split("\n")
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    letters = max(1, count(_UPPER) + count(_LOWER))
    return [
        np.log1p(total), len(words) / max(1, total), (max(words.values()) if words else 0) / max(1, total), count(_UPPER) / letters, count(_ODD) / n, count(_DIGIT) / n,
        len(raw) / max(1, total), count(b"|") / n + count(b"!") / n, 1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
    ]


def evidence(words, lexicon: dict) -> list[float]:
    """The largest weight in the text, the sum of its three largest, and how many are over 2."""
    found = sorted((x for t in _terms(words) if (x := lexicon.get(t)) is not None), reverse=True)
    return [found[0] if found else 0.0, sum(x for x in found[:3] if x > 0), float(min(20, sum(x > 2 for x in found)))]


@dataclass
class Head:
    """Logistic regression over one-hot bins of features."""

    lexicon: dict
    edges: list
    weights: np.ndarray
    limit: float = 0.5

    def rows(self, x: np.ndarray) -> np.ndarray:
        parts = [np.eye(len(e) + 1)[np.searchsorted(e, x[:, i], "right")] for i, e in enumerate(self.edges)]
        return np.concatenate([np.ones((len(x), 1)), *parts], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rows(x) @ self.weights, -12, 12)))


def fit_head(lexicon: dict, x: np.ndarray, y: np.ndarray, bins: int = 12, ridge: float = 0.05, steps: int = 25, spare: float = 0.0005) -> Head:
    """Newton steps on two thirds of the rows; on the rest, the limit that at most `spare` of the good rows exceed (0.5 at least)."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    head = Head(lexicon, edges, np.zeros(1 + sum(len(e) + 1 for e in edges)))
    held = np.arange(len(y)) % 3 == 2
    rows, target = head.rows(x[~held]), y[~held]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ head.weights, -30, 30)))
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * len(target) / 100 * np.eye(rows.shape[1])
        head.weights = head.weights + np.linalg.solve(hessian, rows.T @ (target - p) - ridge * len(target) / 100 * head.weights)
    good = head.probability(x[held & (y == 0)])
    head.limit = max(0.5, float(np.quantile(good, 1 - spare))) if len(good) else 0.5
    return head


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, lexicon_size: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Head]:
    """Heads `low` and `toxic`, from at most `sample` labelled documents, those of smallest hashed id.

    A head without labels of both sorts is left out, and then nothing is rejected by it. Null labels say nothing.
    """
    chosen = labels.select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("low"), F.col("toxic")).dropna(subset=["id"]).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows of three numbers
    rows = cut(rows.select("id", "text", "low", "toxic", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)) == 0).alias("first")), "labelled")

    def count(batches):
        counts, seen = [Counter() for _ in range(4)], Counter()
        for b in slices(batches, 250):
            for text, low, toxic in zip(texts_of(b, "text"), column(b, "low").to_pylist(), column(b, "toxic").to_pylist()):
                terms = _terms(_words(text))
                for k, label in enumerate((low, toxic)):
                    if label in (0, 1):
                        counts[2 * k + label].update(terms)
                        seen[2 * k + label] += 1
        keys = list(set().union(*counts))
        cols = [pa.array([c[t] for t in keys] + [seen[i]], pa.int64()) for i, c in enumerate(counts)]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in keys] + [-1], pa.int32()), pa.array([w for _, w in keys] + [""], pa.string()), *cols], ["n", "w", "c0", "c1", "c2", "c3"])

    counted = rows.filter("first").mapInArrow(freeing(count), "n int, w string, c0 long, c1 long, c2 long, c3 long").groupBy("n", "w").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)])
    counted = cut(counted, "terms")
    totals = counted.filter(F.col("n") == -1).first()
    heads: dict[str, Head] = {}
    if totals is None:
        return heads
    lexicons = {}
    for k, name in enumerate(HEADS):
        good, bad = totals[f"c{2 * k}"], totals[f"c{2 * k + 1}"]
        if good and bad:
            g, b = F.col(f"c{2 * k}"), F.col(f"c{2 * k + 1}")
            weight = F.log((b + 0.5) / (bad + 1.0)) - F.log((g + 0.5) / (good + 1.0))
            spread = F.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))
            best = counted.filter((F.col("n") >= 0) & (g + b >= 4)).withColumn("weight", weight).filter(F.abs("weight") > 1).orderBy(F.desc(F.abs(F.col("weight") / spread)), "n", "w").limit(lexicon_size)
            lexicons[name] = {(r["n"], r["w"]): r["weight"] for r in best.select("n", "w", "weight").collect()}  # at most lexicon_size rows

    def describe(batches):
        for b in slices(batches, 250):
            both = [(w := _words(t)) and shape(t, w) + [e for name in HEADS for e in evidence(w, lexicons.get(name, {}))] or [0.0] * (len(SHAPE) + 3 * len(HEADS)) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "low"), column(b, "toxic"), pa.array(both, pa.list_(pa.float64()))], ["id", "low", "toxic", "x"])

    kinds = dict(rows.dtypes)
    fitted = rows.filter(~F.col("first")).mapInArrow(freeing(describe), f"id {kinds['id']}, low {kinds['low']}, toxic {kinds['toxic']}, x array<double>").orderBy("id").toArrow()  # at most `sample` rows
    x = np.array(fitted.column("x").to_pylist(), float).reshape(fitted.num_rows, len(SHAPE) + 3 * len(HEADS))
    for k, name in enumerate(HEADS):
        y = np.array([-1 if v is None else v for v in fitted.column(name).to_pylist()], float)
        use = (y == 0) | (y == 1)
        if name in lexicons and len(np.unique(y[use])) == 2:
            own = np.r_[: len(SHAPE), len(SHAPE) + 3 * k : len(SHAPE) + 3 * k + 3]
            heads[name] = fit_head(lexicons[name], x[use][:, own], y[use])
    return heads


def classify(docs: DataFrame, heads: dict[str, Head], text_col: str = "text") -> DataFrame:
    """docs with p_low and p_toxic: the document classifier's probabilities; 0 for a head that isn't there or a text without words.
    Repeated rows get equal ones; ids don't matter; columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ("p_low", "p_toxic")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))  # the text travels once
    sent = docs.sparkSession.sparkContext.broadcast(heads)  # lexicon_size terms a head

    def run(batches):
        for b in slices(batches, 250):
            words = [(t or "", _words(t or "")) for t in column(b, "__row").field(text_col).to_pylist()]
            shapes, out = [shape(t, w) for t, w in words], []
            for name in HEADS:
                if head := sent.value.get(name):
                    p = head.probability(np.array([s + evidence(w, head.lexicon) for s, (_, w) in zip(shapes, words)]).reshape(len(words), len(SHAPE) + 3))
                    out.append(pa.array(np.where([bool(w) for _, w in words], p, 0.0)))
                else:
                    out.append(pa.array(np.zeros(len(words))))
            yield pa.RecordBatch.from_arrays([column(b, "__row"), *out], ["__row", "p_low", "p_toxic"])

    schema = rows.select("__row", F.lit(0.0).alias("p_low"), F.lit(0.0).alias("p_toxic")).schema
    return rows.mapInArrow(freeing(run), schema).select(*[F.col("__row")[c].alias(c) for c in names], "p_low", "p_toxic")


def _strength(mean: Column, n: Column, prior: Column) -> list[Column]:
    """Sums from which the prior's strength follows by moments: between-group variance against what sampling explains."""
    return [F.sum(n).alias("n"), F.sum(n * (mean - prior) ** 2).alias("between"), F.count("*").alias("groups"), F.sum(n * prior * (1 - prior)).alias("within")]


def _moments(row, most: float = 1e4) -> float:
    """Pseudo-count of a Beta prior: within / between variance; `most` where groups differ no more than chance explains."""
    if not row or not row["n"] or row["groups"] < 2:
        return most
    within = row["within"] / row["n"]
    extra = (row["between"] - row["groups"] * within) / row["n"]
    return float(min(most, max(1.0, within / extra))) if extra > 0 and within > 0 else most


def posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """host, path, and for each head the host's and the path's posterior mean and the corpus's: a grouped table. Other columns of
    scored don't matter; repeated rows count each; an empty table gives an empty one.

    Sums are made before the shuffle, so a host with a third of all rows costs a row a task. Null hosts and paths are
    groups of their own.
    """
    sums = cut(scored.groupBy(host, path).agg(F.count("*").alias("n"), *[F.sum(f"p_{h}").alias(f"s_{h}") for h in HEADS]), "sums")
    hosts = sums.groupBy(host).agg(F.sum("n").alias("hn"), *[F.sum(f"s_{h}").alias(f"hs_{h}") for h in HEADS])
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(h) for h in HEADS]).first()
    out = sums.join(hosts.withColumnRenamed(host, "__host"), F.col(host).eqNullSafe(F.col("__host"))).drop("__host")
    keep = [F.col(host), F.col(path)]
    for h in HEADS:
        overall = ((total[h] or 0.0) + 0.5) / ((total["n"] or 0) + 1)
        prior = F.lit(overall)
        kappa = _moments(hosts.agg(*_strength(F.col(f"hs_{h}") / F.col("hn"), F.col("hn"), prior)).first())
        out = out.withColumn(f"host_{h}", (F.col(f"hs_{h}") + kappa * prior) / (F.col("hn") + kappa))
        inner = _moments(out.agg(*_strength(F.col(f"s_{h}") / F.col("n"), F.col("n"), F.col(f"host_{h}"))).first())
        out = out.withColumn(f"path_{h}", (F.col(f"s_{h}") + inner * F.col(f"host_{h}")) / (F.col("n") + inner))
        keep += [F.col(f"host_{h}"), F.col(f"path_{h}"), prior.alias(f"all_{h}")]
    return out.select(*keep)


#: Groups up to this number are sent to every task; more are joined by their key.
MOST_GROUPS = 50_000


def combine(scored: DataFrame, groups: DataFrame, heads: dict[str, Head], host: str = "host", path: str = "path", weight: float = 1.0) -> DataFrame:
    """scored with host_*, path_*, final_* probabilities and keep: false where a final probability is over its head's limit.

    Null hosts and paths find their own group; rows that repeat an id are judged each for itself. Columns of scored called
    like those that are added are replaced, unless they are the host or the path.
    """
    made = [f"{part}_{h}" for part in ("host", "path", "all", "final") for h in HEADS]
    scored = scored.drop(*[c for c in (*made, "keep") if c not in (host, path)])
    groups = cut(groups.withColumnsRenamed({host: "__h", path: "__p"}), "posteriors")
    side = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups
    out = scored.join(side, F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__p")), "left").drop("__h", "__p")
    logit = lambda p: F.log(p / (1 - p))
    held = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    keep = F.lit(True)
    for h in HEADS:
        odds = logit(held(F.col(f"p_{h}"))) + weight * (logit(held(F.col(f"path_{h}"))) - logit(held(F.col(f"all_{h}"))))
        out = out.withColumn(f"final_{h}", 1 / (1 + F.exp(-odds)))
        if h in heads:
            keep = keep & (F.col(f"final_{h}") <= heads[h].limit)
    return out.withColumn("keep", keep).drop(*[f"all_{h}" for h in HEADS])
