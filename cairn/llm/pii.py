"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers, each leftmost and non-overlapping, and keep
what passes its check. High-recall generators propose further, overlapping spans of five kinds: addresses with a spelt-out
at or dot, dotted numbers, long and short numbers with loose separators, and long tokens (secrets). Every candidate has a
few small whole-number features of its format and context, and a weak label from a check that these features don't see: a
known top-level domain, four numbers up to 255, Luhn's sum, a plus or a word such as "call" before a number, letters and
digits mixed as at random. Boosted trees, a model for each kind, so learn which formats and contexts the checks confirm;
a threshold for each kind is calibrated on held-out candidates, and what scores over it is selected, whether its own check
passes or not. As the features are small numbers, the corpus is one grouped count (at most FEATURE_ROWS rows, some 30,000), from which
the trees are fitted on the driver; they score as SQL expressions.

A text may have very many matches, so nothing looks at all others for each: places come from running sums, overlaps from one sort and a
running maximum, both made by doubling steps over an array, and texts are cut from chunks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import row_hash

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans; base patterns find the first four.
ALL_KINDS = (*KINDS, "secret")
# Possessive forms of the base patterns: they match the same and take linear time. The look-behinds only skip starts
# within a run whose own start has just failed; \G allows the start right after a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators of candidates: addresses with a spelt-out at or dot, dotted numbers, digits with loose separators, long tokens with a digit.
MAILLIKE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?+(?:@|\(at\)|\[at\])\x20?+[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"
DOTTED = r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+"
CARDLIKE = r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,}+"
PHONELIKE = r"(?<![0-9])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
SECRETLIKE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"
GENERATORS = (MAILLIKE, DOTTED, CARDLIKE, PHONELIKE, SECRETLIKE)
#: Common top-level domains.
DOMAINS = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|uk|eu|ch|at|nl|us|ca|mx|br|ar|jp|cn|in|au"
#: Words before a candidate that speak for each kind.
WORDS = ("mail|contact|write|reach", r"\bip\b|host|server|addr", "card|visa|pay|credit", "phone|tel|call|mobil|fax", "token|key|secret|passw|pwd|auth|credential")
FEATURES = {"digits": 6, "seps": 4, "style": 5, "words": 6, "head": 4, "spelt": 2, "quoted": 3, "letters": 3, "size": 4}
#: What a kind's model looks at; its other features are 0. A phone number's words are what its check looks at.
USED = (("style", "words", "spelt", "quoted", "size"), ("digits", "words", "head", "quoted", "size"), ("digits", "seps", "style", "words", "head"), ("digits", "seps", "style", "head", "quoted"), ("seps", "words", "quoted", "letters", "size"))
FEATURE_ROWS = sum(math.prod(FEATURES[f] for f in used) for used in USED) * 4
SPAN = "array<struct<start:int,stop:int,value:string,before:string>>"


def _let(value: Column, body) -> Column:
    """body of a value that is made once, however often body, or a function within it, takes it up."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, join) -> Column:
    """Running results of `join`, an associative function of two numbers, over an array: element i joins the elements up to it. Steps
    double their reach, so an array of n takes log n passes."""

    def step(so_far: Column, k: Column) -> Column:
        return _let(F.call_function("shiftleft", F.lit(1), k), lambda far: F.transform(so_far, lambda x, i: F.when(i < far, x).otherwise(join(x, F.get(so_far, i - far)))))

    return _let(values, lambda v: F.when(F.size(v) > 1, F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1), v, step)).otherwise(v))


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, in code points, each with the 24 characters at most before it that the
    match before it and the text between them have; where `may` is false there are none."""

    def spans(v: Column) -> Column:
        # The end of match i is the length of the first i+1 pieces between and of the first i+1 matches.
        ends = _scan(F.zip_with(v["found"], F.slice(v["between"], F.lit(1), F.size(v["found"])), lambda m, p: F.length(m) + F.length(p)), lambda x, y: x + y)
        before = lambda i: F.right(F.concat(F.coalesce(F.get(v["found"], i - 1), F.lit("")), F.get(v["between"], i)), F.lit(24))
        return _let(ends, lambda e: F.transform(v["found"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("stop"), m.alias("value"), before(i).alias("before"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    none = F.array().cast(SPAN)
    return F.when(may, _let(both, lambda v: F.when(F.size(v["found"]) > 0, spans(v)).otherwise(none))).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    doubled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _base(text: Column) -> Column:
    """All checked base spans, ordered by start and then kind: array<struct<start, kind (0 to 3), stop>>."""
    has = lambda c: F.contains(text, F.lit(c))
    number = F.regexp_like(text, F.lit("[0-9]"))
    checked = (
        _matches(text, EMAIL, has("@")),
        F.filter(_matches(text, IP, has(".") & number), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))),
        F.filter(_matches(text, CARD, number), lambda s: F.length(_digits(s["value"])).between(12, 19) & _luhn(_digits(s["value"]))),
        F.filter(_matches(text, PHONE, has("+")), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    )
    as_kind = lambda k: lambda s: F.struct(s["start"], F.lit(k).alias("kind"), s["stop"])
    return F.array_sort(F.concat(*[F.transform(spans, as_kind(k)) for k, spans in enumerate(checked)]))


def _proposals(text: Column) -> Column:
    """Candidates with features and the weak label."""
    number = F.regexp_like(text, F.lit("[0-9]"))
    at = F.contains(text, F.lit("@")) | F.regexp_like(text, F.lit(r"[\(\[]at[\)\]]"))
    band = lambda x, *edges: reduce(lambda a, e: a + (x >= e).cast("int"), edges, F.lit(0))
    fits = lambda value, pattern: F.regexp_like(value, F.lit(pattern)).cast("int")

    def label(value: Column, before: Column, kind: int) -> Column:
        digits = F.length(_digits(value))
        if kind == 0:
            return fits(value, rf"(?i)(?:\.|\(dot\)|\[dot\])\x20?(?:{DOMAINS})$")
        if kind == 1:
            part = "(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
            return fits(value, rf"^{part}(?:\.{part}){{3}}$")
        if kind == 2:
            return (digits.between(12, 19) & _luhn(_digits(value))).cast("int")
        if kind == 3:
            return (digits.between(9, 15) & (value.startswith("+") | F.regexp_like(before, F.lit(WORDS[3])))).cast("int")
        turns = F.size(F.regexp_extract_all(value, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), F.lit(0)))
        return ((5 * turns >= F.length(value)) & (20 * digits >= 3 * F.length(value))).cast("int")

    def features(s: Column, kind: int) -> Column:
        value = s["value"]
        seps = F.regexp_replace(value, r"[A-Za-z0-9+]", "")
        before = F.lower(s["before"])
        style = F.when(F.length(seps) == 0, 0).when(F.regexp_like(seps, F.lit("^-+$")), 1).when(F.regexp_like(seps, F.lit("^ +$")), 2).when(F.regexp_like(seps, F.lit(r"^\.+$")), 3).otherwise(4)
        words = reduce(lambda w, k: w.when(F.regexp_like(before, F.lit(WORDS[k])), k + 1), range(4), F.when(F.regexp_like(before, F.lit(WORDS[4])), 5)).otherwise(0)
        parts = {
            "digits": band(F.length(_digits(value)), 7, 9, 12, 16, 20), "seps": band(F.length(seps), 1, 3, 6), "style": style, "words": words,
            "head": band(F.length(F.regexp_extract(value, r"^(?:\+[0-9]{1,3}\x20?)?\(?([0-9]+)", 1)), 1, 3, 5), "spelt": fits(value, r"[\(\[](?:at|dot)[\)\]]"),
            "quoted": F.when(F.regexp_like(before, F.lit(r"[\"'`]$")), 1).when(F.regexp_like(before, F.lit(r"[=:]\s?$")), 2).otherwise(0),
            "letters": F.when(F.regexp_like(value, F.lit("[g-zG-Z]")), 2).when(F.regexp_like(value, F.lit("[a-fA-F]")), 1).otherwise(0), "size": band(F.length(value), 20, 32, 48),
        }
        own = [(parts[f] if f in USED[kind] else F.lit(0)).cast("int").alias(f) for f in FEATURES]
        return F.struct(s["start"], s["stop"], F.lit(kind).alias("kind"), *own, label(value, before, kind).alias("label"))

    may = (at, number & F.contains(text, F.lit(".")), number, number, number)
    described = lambda kind: lambda s: features(s, kind)
    return F.concat(*[F.transform(_matches(text, p, may[kind]), described(kind)) for kind, p in enumerate(GENERATORS)])


def propose(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __base and __candidates added: one projection over each text.

    A null or empty text has none; rows that repeat an id or a text are judged each for itself, alike. Columns of docs called
    __base, __candidates, __good or __spans are replaced.
    """
    docs = docs.drop("__base", "__candidates", "__good", "__spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("__base", _base(text)).withColumn("__candidates", _proposals(text))


@dataclass
class Boosted:
    """Depth-two trees [(feature, cut, [(feature, cut, value below, value from), the same for the other side])], and the threshold."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    threshold: float = math.inf

    def score(self, c: Column) -> Column:
        """Log-odds of a candidate, as an expression."""
        leaf = lambda f, cut, low, high: F.when(c[f] < cut, low).otherwise(high)
        return reduce(lambda a, t: a + F.when(c[t[0]] < t[1], leaf(*t[2][0])).otherwise(leaf(*t[2][1])), self.trees, F.lit(self.start))


def fit(proposed: DataFrame, rounds: int = 30, rate: float = 0.3, precision: float = 0.9) -> dict[str, Boosted]:
    """A model for each kind, over all candidates of `proposed`; every second document, by hash, is held out for the threshold.

    Of a kind without candidates, or whose checks confirm none, nothing is ever added.
    """
    counts = (
        proposed.select((F.pmod(row_hash(proposed), F.lit(2)) == 0).alias("held"), F.explode("__candidates").alias("c"))
        .groupBy("held", "c.kind", *[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.label").alias("label")).count().collect()  # at most FEATURE_ROWS rows
    )
    return {
        name: boost([(r["held"], tuple(r[f] for f in FEATURES), r["label"], r["count"]) for r in counts if r["kind"] == kind], rounds, rate, precision)
        for kind, name in enumerate(ALL_KINDS)
    }


def boost(rows: list[tuple], rounds: int = 30, rate: float = 0.3, precision: float = 0.9, least: int = 5) -> Boosted:
    """rows: (held out, feature values, label, count). The threshold is the lowest score from which on the checks confirm at
    least `precision` of the held-out candidates, and of those at that very score, `least` of them at least."""
    import numpy as np

    names, tops = list(FEATURES), list(FEATURES.values())
    rows = sorted(rows)
    if not rows:
        return Boosted()
    held, x = np.array([r[0] for r in rows], bool), np.array([r[1] for r in rows])
    y, w = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    train = ~held
    positive, total = (w * y)[train].sum(), w[train].sum()
    if not positive:
        return Boosted()
    model = Boosted(math.log((positive + 0.5) / (total - positive + 0.5)))
    score = np.full(len(y), model.start)

    def best(mask, g, h):
        """The split of the masked rows with the largest gain: gain, feature, cut, the two values."""
        found = (-1.0, 0, 1, 0.0, 0.0)
        for f, top in enumerate(tops):
            gs, hs = (np.bincount(x[mask, f], v[mask], top) for v in (g, h))
            for cut in range(1, top):
                a, b, c, d = gs[:cut].sum(), hs[:cut].sum() + 1, gs[cut:].sum(), hs[cut:].sum() + 1
                found = max(found, (a * a / b + c * c / d, f, cut, rate * a / b, rate * c / d))
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        _, f, cut, *_ = best(train, g, h)
        sides = [best(train & m, g, h) for m in (x[:, f] < cut, x[:, f] >= cut)]
        model.trees.append((names[f], cut, [(names[s[1]], s[2], float(s[3]), float(s[4])) for s in sides]))
        for s, m in zip(sides, (x[:, f] < cut, x[:, f] >= cut)):
            score += m * np.where(x[:, s[1]] < s[2], s[3], s[4])
    for x in sorted(set(score[held].tolist()), reverse=True):
        over, own = held & (score >= x), held & (score == x)
        rate_of = lambda m: (w * y)[m].sum() / w[m].sum()
        if rate_of(over) < precision or rate_of(own) < precision:
            break
        if w[over].sum() >= least:
            model.threshold = x - 1e-9
    return model


def select(proposed: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """Adds __spans: the base spans, and the candidates over their kind's threshold that no base span overlaps; of candidates
    that overlap each other, those of the largest score, and of equals the first and longest. Columns __base and __candidates are propose()'s."""
    usable = {kind: models[name] for kind, name in enumerate(ALL_KINDS) if name in models and math.isfinite(models[name].threshold)}

    if not usable:
        return proposed.withColumn("__spans", F.col("__base"))

    def scored(c: Column) -> Column:
        over = reduce(lambda w, k: w.when(c["kind"] == k, usable[k].score(c) - usable[k].threshold), usable, F.when(F.lit(False), 0.0))
        return F.struct(over.alias("over"), (-c["start"]).alias("first"), c["stop"].alias("stop"), (-c["kind"]).alias("rank"))

    good = F.filter(F.transform("__candidates", scored), lambda c: c["over"] >= 0)
    rows = proposed.withColumn("__good", good)
    rows = rows.withColumn("__good", F.when((F.size("__good") > 0) & (F.size("__base") > 0), _apart(F.col("__good"), F.col("__base"))).otherwise(F.col("__good")))
    rows = rows.withColumn("__good", F.array_sort("__good", lambda c, d: F.when(c["first"] > d["first"], -1).when(c["first"] < d["first"], 1).when(c > d, -1).when(c < d, 1).otherwise(0)))
    extra = F.when(F.size("__good") > 1, _unbeaten(F.col("__good"))).otherwise(F.transform("__good", _key))
    spans = F.transform(extra, lambda k: F.struct(F.shiftright(k, 32).cast("int").alias("start"), F.pmod(k, F.lit(8)).cast("int").alias("kind"), (F.shiftright(k, 32) + F.shiftright(F.pmod(k, F.lit(2**32)), 3)).cast("int").alias("stop")))
    return rows.withColumn("__spans", F.when(F.size("__good") > 0, F.array_sort(F.concat("__base", spans))).otherwise(F.col("__base"))).drop("__good")


def _key(c: Column) -> Column:
    """A good candidate's start, length (under 2**29) and kind as one number."""
    return (-c["first"]).cast("long") * 2**32 + (c["stop"] + c["first"]).cast("long") * 8 - c["rank"]


def _apart(good: Column, base: Column) -> Column:
    """The good candidates that no base span overlaps: ordered by candidates' ends and base spans' starts, the greatest end of the base
    spans so far is what reaches into a candidate. At one place candidates come first, as spans that only touch don't overlap."""
    ours = F.transform(good, lambda c: F.struct(c["stop"].alias("at"), F.lit(0).alias("type"), F.lit(-1).alias("reach"), c.alias("c")))
    theirs = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("type"), b["stop"].alias("reach"), F.get(good, F.lit(0)).alias("c")))

    def free(order: Column) -> Column:
        reach = _scan(F.transform(order, lambda e: e["reach"]), lambda x, y: F.greatest(x, y))
        kept = F.filter(F.zip_with(order, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), lambda z: (z["e"]["type"] == 0) & (z["r"] <= -z["e"]["c"]["first"]))
        return F.transform(kept, lambda z: z["e"]["c"])

    return _let(F.array_sort(F.concat(ours, theirs)), free)


def _unbeaten(good: Column) -> Column:
    """Keys of the candidates, ordered by start, that overlap no better one. Spans of one kind are apart, so of each kind only the last
    that starts no later can reach into a candidate: of every such pair the worse is beaten."""

    def beaten(kind: int) -> Column:
        last = _scan(F.transform(good, lambda c, i: F.when(c["rank"] == -kind, i).otherwise(-1)), lambda x, y: F.greatest(x, y))

        def worse(c: Column, d: Column) -> Column:
            meets = (d["rank"] != c["rank"]) & (d["stop"] > -c["first"])  # false or null where there is no d
            return F.when(meets, F.when(c > d, _key(d)).otherwise(_key(c)))

        return F.zip_with(good, last, lambda c, at: worse(c, F.get(good, at)))

    return F.array_except(F.transform(good, _key), F.filter(F.concat(*map(beaten, range(len(ALL_KINDS)))), lambda k: k.isNotNull()))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


#: Characters of a chunk that texts are cut from.
CHUNK = 1024


def redacted(text: Column, spans: Column) -> Column:
    """The text with spans (ordered by start), merged where they overlap, replaced by the first one's kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])

    def part(chunks: Column, start: Column, stop: Column) -> Column:
        """Characters start to stop, without counting from the text's beginning."""
        one, other = (start / CHUNK).cast("int"), (stop / CHUNK).cast("int")
        first, last = F.coalesce(F.get(chunks, one), F.lit("")), F.coalesce(F.get(chunks, other), F.lit(""))
        inside = F.substring(first, start % CHUNK + 1, stop - start)
        across = F.concat(F.substring(first, start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, one + 2, F.greatest(other - one - 1, F.lit(0))), ""), F.substring(last, F.lit(1), stop % CHUNK))
        return F.when(one == other, inside).otherwise(across)

    def said(v: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            return _let(F.coalesce(F.get(v["reach"], i - 1), F.lit(0)), lambda at: F.when(s["start"] >= at, F.concat(part(v["chunks"], at, s["start"]), F.get(names, s["kind"]))).otherwise(""))

        return F.concat(F.array_join(F.transform(v["spans"], piece), ""), part(v["chunks"], F.element_at(v["reach"], -1), v["size"]))

    reach = _scan(F.transform(spans, lambda s: s["stop"]), lambda x, y: F.greatest(x, y))
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    made = F.struct(spans.alias("spans"), reach.alias("reach"), chunks.alias("chunks"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, _let(made, said)).otherwise(text)
