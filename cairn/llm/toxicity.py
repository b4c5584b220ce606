"""Toxicity by noisy-channel deobfuscation: a text is restored, then scored.

The channel writes a letter as itself, as a digit or sign that looks like it, several times, or with a sign, mark or gap after it.
A spelling so is a lattice: each stretch of one character may stand for a few letters, for nothing, or for a gap between
words. Viterbi's algorithm finds the likeliest letters under a character language model of the corpus: the counts of
letters after up to four others, each spelling counted once for each document that has it, each order smoothed by the one
below. Words of plain letters are left as they are unless a letter comes three times or more in a row, or twice where the
model finds that odd; words of one letter each that stand in a row are read as one spelling.

The restored words, and the words as they were, give the evidence: terms (words and the first letters of longer ones) have
log-odds learned from labelled documents. Logistic regression on a text's strongest terms gives its score; it is fitted on
each half of the sample with the terms learned from the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import column, cut, mix64, slices, texts_of

# What a digit or sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
# Signs that may hide one letter.
HIDES, HIDDEN = "*#%&", "aeiou"
ORDER = 5
#: A second letter in a row is odd if its log-probability after the first is under this.
ODD = -5.0
_MARKS = ".,;:!?\"'`()[]{}<>«»„“”‚‘’…-–—_*#%&$|/\\=~^+"
_REPEATED = re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ \t]{1,3}[^\s.,;:?]){2,}(?!\S)")
_RUNS = re.compile(r"(.)\1*", re.S)


@dataclass
class Letters:
    """The character model: counts of stretches of up to ORDER characters, blank for a word's edge."""

    counts: dict[str, int]
    contexts: dict[str, int]
    alphabet: int
    known: dict = field(default_factory=dict)  # probabilities that were asked for

    def __getstate__(self):
        return self.counts, self.contexts, self.alphabet

    def __setstate__(self, state):
        self.counts, self.contexts, self.alphabet = state
        self.known = {}

    @classmethod
    def of(cls, longest: dict[str, int]) -> Letters:
        """From counts of stretches of ORDER characters."""
        counts: Counter = Counter()
        for gram, n in longest.items():
            for k in range(ORDER):
                counts[gram[k:]] += n
        contexts: Counter = Counter()
        for gram, n in counts.items():
            contexts[gram[:-1]] += n
        return cls(dict(counts), dict(contexts), max(2, sum(len(g) == 1 for g in counts) + 1))

    def log(self, before: str, letter: str) -> float:
        """ln P(letter | up to ORDER - 1 characters before it)."""
        key = before + letter
        if (p := self.known.get(key)) is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            prob = 1 / self.alphabet
            for k in range(len(before), -1, -1):
                n = self.contexts.get(before[k:], 0)
                prob = (self.counts.get(before[k:] + letter, 0) + 2 * prob) / (n + 2)
            p = self.known[key] = math.log(prob)
        return p


@lru_cache(4096)
def _arcs(c: str, k: int) -> list[tuple[str, float]]:
    """What k times c may stand for, and the channel's log-probability of each."""
    if c.isspace():
        return [("", -0.3), (" ", -1.5)] if k == 1 else [(" ", -0.3), ("", -2.0)]
    if c.isalpha():
        return [(c, 0.0)] if k == 1 else [(c * 2, 0.0), (c, -7.0)] if k == 2 else [(c, -0.7), (c * 2, -1.5)]
    out = [(h, -1.0) for h in LOOKS.get(c, "")]
    if k > 1:
        out += [(h * 2, -1.5) for h in LOOKS.get(c, "")]
    if c in HIDES and k < 3:
        out += [(h, -2.5) for h in HIDDEN]
    if not c.isdigit():
        out += [("", -0.7 if c in _MARKS else -2.0), (" ", -2.0)]
    return out or [("", -3.0)]


def decode(spelling: str, model: Letters) -> str:
    """The likeliest letters of a spelling in lower case, by Viterbi over the lattice; a state is the last ORDER - 1 letters."""
    log = model.log
    now = {" " * (ORDER - 1): (0.0, None)}
    for m in _RUNS.finditer(spelling):
        after: dict = {}
        arcs = _arcs(m[1], len(m[0]))
        for state, (total, back) in now.items():
            for said, cost in arcs:
                p, s, node = total + cost, state, back
                for c in said:
                    if c == " " and s[-1] == " ":
                        continue  # one edge is enough
                    p += log(s, c)
                    s = s[1:] + c
                    node = (c, node)
                if s not in after or p > after[s][0]:
                    after[s] = (p, node)
        now = after
    _, node = max(((p + (0.0 if s[-1] == " " else log(s, " ")), node) for s, (p, node) in now.items()), key=lambda x: x[0])
    out = []
    while node:
        out.append(node[0])
        node = node[1]
    return "".join(reversed(out)).strip()


class Restorer:
    """Restores texts, each distinct spelling once as long as `most` of them are held."""

    def __init__(self, model: Letters, most: int = 200_000):
        self.model, self.most, self.seen = model, most, {}

    def usual(self, core: str) -> bool:
        """Doubles only where the model expects them."""
        if not _REPEATED.search(core):
            return True
        for m in _REPEATED.finditer(core):
            at = m.end() - 1
            if core[at : at + 2] == core[at] * 2 or self.model.log((" " * (ORDER - 1) + core[:at])[1 - ORDER :], core[at]) < ODD:
                return False
        return True

    def word(self, token: str) -> str:
        """The restored words of a token in lower case: the letters between its marks if there are only letters."""
        if (got := self.seen.get(token)) is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            core = token.strip(_MARKS)
            if core.isalpha() and not (token[0] in LOOKS or token[-1] in "$@") and self.usual(core):
                got = core
            elif not any(c.isalpha() for c in core):
                got = ""
            else:
                got = decode(token, self.model)
            self.seen[token] = got
        return got

    def spellings(self, text: str) -> set[str]:
        """The distinct tokens of a text in lower case, and its rows of single letters."""
        low = text.lower()
        tokens = low.split()
        if b"\1\1\1" in bytes([len(t) == 1 for t in tokens]):
            tokens += [m[0] for m in _SPACED.finditer(low)]
        return set(tokens)

    def text(self, text: str) -> str:
        """The text in lower case with every token, and every row of single letters, restored; one blank between tokens."""
        low = _SPACED.sub(lambda m: m[0] if not (w := self.word(m[0])) else w, text.lower())
        return " ".join(filter(None, map(self.word, low.split())))


def _grams(words: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """gram, n: stretches of ORDER characters of the words, each between blanks, with the sums of the words' counts."""
    text = "".join(" " * (ORDER - 1) + w + " " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # stretches of a word: one ends at each letter, and one at the blank after
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    key = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ORDER):
            key = mix64(key ^ codes[at + i], i) if len(at) else key
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(which, np.repeat(counts, sizes), len(first)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in at[first].tolist()], pa.string()), pa.array(total)], ["gram", "n"])


def letters(docs: DataFrame, text_col: str = "text", grams: int = 300_000) -> Letters:
    """The character model of all documents. A task counts before the shuffle; the `grams` commonest stretches come to the driver."""

    def count(batches):
        words: Counter = Counter()

        def done():
            plain = [(w, n) for s, n in words.items() if (w := s.strip(_MARKS)).isalpha() and len(w) < 100]
            words.clear()
            return _grams([w for w, _ in plain], np.array([n for _, n in plain], np.int64))

        for b in slices(batches):
            for t in texts_of(b, "text"):
                words.update(set(t.lower().split()))
            if len(words) > 300_000:
                yield done()
        yield done()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "gram").limit(grams).toArrow()  # at most `grams` rows
    return Letters.of(dict(zip(best.column("gram").to_pylist(), best.column("n").to_pylist())))


PREFIXES = (4, 5, 6)
#: Evidence: a text's three strongest terms, how many are over 2, and its number of distinct spellings, in logarithms.
EVIDENCE = 5


def terms(restorer: Restorer, spelling: str) -> set[str]:
    """A spelling's terms: its word as it is written and those restored, and the first letters of longer ones, marked by a blank."""
    words = {spelling.strip(_MARKS), *restorer.word(spelling).split(" ")} - {""}
    return words | {w[:n] + " " for w in words for n in PREFIXES if len(w) > n}


class Finder:
    """The evidence of texts; a spelling's terms in the lexicon are looked up once as long as `most` spellings are held."""

    def __init__(self, restorer: Restorer, lexicon: dict[str, float], most: int = 400_000):
        self.restorer, self.lexicon, self.most, self.seen = restorer, lexicon, most, {}

    def hits(self, spelling: str) -> dict[str, float] | tuple:
        """Those of terms() that the lexicon has, with their weights; most spellings have none."""
        known, found = self.lexicon, ()
        plain, restored = spelling.strip(_MARKS), self.restorer.word(spelling)
        for w in (plain,) if restored == plain else (plain, *restored.split(" ")):
            if w in known:
                found = {**dict(found), w: known[w]}
            for n in PREFIXES:
                if len(w) > n and (t := w[:n] + " ") in known:
                    found = {**dict(found), t: known[t]}
        return found

    def evidence(self, text: str) -> list[float]:
        spellings = self.restorer.spellings(text)
        if len(self.seen) > self.most:
            self.seen.clear()
        found: dict[str, float] = {}
        for s in spellings:
            if (hits := self.seen.get(s)) is None:
                hits = self.seen[s] = self.hits(s)
            if hits:
                found.update(hits)
        weights = sorted(found.values(), reverse=True)
        return [*(weights + [0.0, 0.0, 0.0])[:3], float(min(20, sum(x > 2 for x in weights))), math.log1p(len(spellings))]


@dataclass
class Judge:
    """Log-odds of terms, and weights of the evidence and its products; without weights every score is `base`."""

    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    base: float = 0.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.ones((len(z), 1)), z, z[:, :1] ** 2, z[:, :1] * z[:, 3:5]], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.rows(x) @ self.weights, -30, 30)))


def _regression(lexicon: dict, x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30) -> Judge:
    judge = Judge(lexicon, x.mean(0), x.std(0) + 1e-9, None, float((y.sum() + 0.5) / (len(y) + 1)))
    if len(np.unique(y)) < 2:
        return judge
    rows = judge.rows(x)
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, rows.T @ (y - p) - ridge * w)
    judge.weights = w
    return judge


def fit(docs: DataFrame, labels: DataFrame, model: Letters, sample: int = 20_000, size: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> Judge:
    """A judge from at most `sample` labelled documents, those of smallest hashed id. labels: doc_id, toxic (0, 1; others say nothing).

    Without labels of both sorts every score is the share of toxic ones, 0 where there are none.
    """
    chosen = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), "toxic").dropna(subset=["id"]).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows of two numbers
    rows = cut(rows.withColumn("half", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int")), "labelled")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        restorer, counts, seen = Restorer(sent.value), [Counter() for _ in range(4)], [0] * 4
        for b in slices(batches):
            for text, toxic, half in zip(texts_of(b, "text"), column(b, "toxic").to_pylist(), column(b, "half").to_pylist()):
                counts[2 * half + toxic].update(set().union(*(terms(restorer, x) for x in restorer.spellings(text))))
                seen[2 * half + toxic] += 1
        keys = list(set().union(*counts))
        cols = [pa.array([c[t] for t in keys] + [seen[i]], pa.int64()) for i, c in enumerate(counts)]
        yield pa.RecordBatch.from_arrays([pa.array(keys + [""], pa.string()), *cols], ["term", "c0", "c1", "c2", "c3"])

    counted = rows.mapInArrow(count, "term string, c0 long, c1 long, c2 long, c3 long").groupBy("term").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)])
    counted = cut(counted, "terms")
    totals = counted.filter("term = ''").first()
    seen = [totals[f"c{i}"] for i in range(4)] if totals else [0] * 4

    def lexicon(halves) -> dict[str, float]:
        """From one half or both; at most `size` terms, the most certain."""
        good, bad = (sum(seen[2 * h + k] for h in halves) for k in (0, 1))
        g, b = (sum((F.col(f"c{2 * h + k}") for h in halves), F.lit(0)) for k in (0, 1))
        weight = F.log((b + 0.5) / (bad + 1.0)) - F.log((g + 0.5) / (good + 1.0))
        spread = F.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))
        best = counted.filter((F.col("term") != "") & (b >= 2)).select("term", weight.alias("weight"), (weight / spread).alias("sure")).filter("weight > 1").orderBy(F.desc("sure"), "term").limit(size)
        return {r["term"]: r["weight"] for r in best.collect()}  # at most `size` rows

    halves = [lexicon([1]), lexicon([0])]  # for each half the terms of the other

    def describe(batches):
        restorer = Restorer(sent.value)
        finders = [Finder(restorer, lexicon) for lexicon in halves]
        for b in slices(batches):
            x = [finders[h].evidence(t) for t, h in zip(texts_of(b, "text"), column(b, "half").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "toxic"), pa.array(x, pa.list_(pa.float64()))], ["id", "toxic", "x"])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(describe, f"id {kinds['id']}, toxic {kinds['toxic']}, x array<double>").orderBy("id").toArrow()  # at most `sample` rows
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, EVIDENCE)
    y = np.array(found.column("toxic").to_pylist(), float)
    return _regression(lexicon([0, 1]), x, y) if len(y) else Judge({}, np.zeros(EVIDENCE), np.ones(EVIDENCE), None)


def score(docs: DataFrame, model: Letters, judge: Judge, text_col: str = "text", restored: bool = False) -> DataFrame:
    """docs with score (0 to 1) added, and the restored text if asked for.

    A null or empty text is scored like one without any evidence; equal texts get equal scores, whatever their ids; columns of those names are replaced.
    """
    made = ["score", "restored"] if restored else ["score"]
    names = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text_col).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast((model, judge))

    def run(batches):
        model, judge = sent.value
        restorer = Restorer(model)
        finder = Finder(restorer, judge.lexicon)
        for b in slices(batches):
            texts = texts_of(b, "__text")
            x = np.array([finder.evidence(t) for t in texts], float).reshape(len(texts), EVIDENCE)
            cols = [column(b, "__row"), pa.array(judge.scores(x))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([restorer.text(t) for t in texts], pa.string())] if restored else []), ["__row", *made])

    schema = rows.select("__row", F.lit(0.0).alias("score"), *([F.lit("").alias("restored")] if restored else [])).schema
    return rows.mapInArrow(run, schema).select(*[F.col("__row")[c].alias(c) for c in names], *made)
