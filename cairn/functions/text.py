"""Enrichment of texts, as column expressions: word lists are patterns or literal arrays, so that all of it stays in the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cairn.functions.words import ENGLISH, Words

# English word lists. Other languages' lists are passed as parameters.
DECISION_WORDS = ("decided", "chose", "choosing", "switched", "migrated", "selected", "picked", "opted", "replaced", "adopted")
ERROR_WORDS = ("error", "exception", "failed", "failure", "bug", "crash", "broken", "traceback", "timeout", "denied")
ARCHITECTURE_WORDS = ("design", "pattern", "refactor", "architecture", "restructure", "modular", "decouple", "abstract", "interface", "migrate")
NEGATION_MARKERS = (
    "no longer", "not anymore", "no more", "used to", "used to be", "formerly", "previously", "deprecated", "replaced by", "replaced with", "switched to", "switched from",
    "changed to", "changed from", "moved to", "moved from", "superseded by", "instead of", "not going to", "canceled", "cancelled", "reverted", "rolled back", "undid", "undone",
)
DAY_NAMES = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
AFTER_WORDS = ("after", "since", "following", "subsequent", "later")
BEFORE_WORDS = ("before", "prior", "previous", "earlier", "preceding")
TEMPORAL_WORDS = ("when", "date", "time", "ago", "last", "before", "after", "during", "since", "until", "yesterday", "tomorrow", "week", "month", "year")
FILLER = (
    "i", "me", "my", "you", "your", "we", "our", "us", "he", "she", "it", "its", "they", "them", "a", "an", "the", "this", "that", "these", "those", "some", "any", "to", "of", "in", "on",
    "at", "by", "for", "with", "from", "into", "about", "up", "is", "was", "are", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "can", "could", "will", "would",
    "should", "what", "when", "where", "who", "why", "how", "which", "whose", "whom", "tell", "show", "give", "please", "mention", "only", "exactly", "just", "also", "really", "actually",
    "remember", "recall", "think", "know", "said", "talked", "discussed", "brought", "items",
)
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "a": 1, "an": 1}
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ENTITY_TYPES = ("entity", "file", "error", "event", "activity", "emotion", "preference", "relationship", "quantity", "location", "person")
# Patterns of secrets, dates and names.
MASK = "***MASKED***"
SECRET_NAMES = (
    r"api[_-]?key", r"secret[_-]?key", r"access[_-]?key", r"access[_-]?token", r"auth[_-]?token", "password", "passwd", "bearer", "token",
    "sk[_-]live", "sk[_-]proj", "pk[_-]live", "sk[_-]test", "pk[_-]test", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "whsec_", "sb_secret_",
    "SG\\.[A-Za-z0-9_-]{20}", "npm_[A-Za-z0-9]{20}", "pypi-[A-Za-z0-9]{20}", "pa-[A-Za-z0-9_-]{20}", "npg_[A-Za-z0-9]{10}", "AKIA[A-Z0-9]{16}", "eyJ[A-Za-z0-9_-]{20,}",
)
SECRET_TOKENS = (
    "ghp_[A-Za-z0-9]{36}", "gho_[A-Za-z0-9]{36}", "github_pat_[A-Za-z0-9_]{20,}", "glpat-[A-Za-z0-9\\-]{20,}", "AKIA[A-Z0-9]{16}", "SG\\.[A-Za-z0-9_\\-]{20,}", "xox[bpars]-[A-Za-z0-9\\-]{10,}",
    "sk-ant-[A-Za-z0-9\\-]{20,}", "sk-proj-[A-Za-z0-9\\-]{20,}", "sk-[A-Za-z0-9]{40,}", "npm_[A-Za-z0-9]{36}", "pypi-[A-Za-z0-9]{20,}", "whsec_[A-Za-z0-9]{20,}",
    "\\d{8,12}:[A-Za-z0-9_-]{35}", "[A-Za-z0-9]{24}\\.[A-Za-z0-9_-]{6}\\.[A-Za-z0-9_-]{27}",
)
# What a text must hold for SECRET_NAMES or SECRET_ENV (in lower case) and for the beginnings and the two forms of SECRET_TOKENS.
NAMES_HOLD = ("key", "token", "passw", "bearer", "sk_", "sk-", "pk_", "pk-", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "whsec_", "sb_secret_", "sg.", "npm_", "pypi-", "pa-", "npg_", "akia", "eyj")
ENV_HOLD = ("_key", "_token", "passw", "bearer", "_url", "connection_string", "dsn", "mongodb_uri", "webhook_secret")
TOKENS_HOLD = ("ghp_", "gho_", "github_pat_", "glpat-", "AKIA", "SG.", "xox", "sk-", "npm_", "pypi-", "whsec_")
TOKEN_FORMS = r"\d:[A-Za-z0-9_-]{35}|\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27}"
SECRET_URL = r"://([^:]+):([^@]{3,})@"
SECRET_ENV = r"(?i)((?:api_key|secret_key|access_key|access_token|auth_token|password|passwd|bearer|private_key|database_url|connection_string|dsn|redis_url|valkey_url|mongodb_uri|encryption_key|signing_key|webhook_secret)\s*[=:]\s*['\"]?)[^\s'\"]+['\"]?"
ISO_DATE = r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
NATURAL_DATE = rf"(?i)\b({MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{4}}|\d{{1,2}}\s+{MONTH}\s+\d{{4}})\b"
CAMEL_CASE = r"\b([A-Z][a-z]+(?:[A-Z][a-zA-Z]*)+)\b"
FILE_PATH = r"((?:\.{0,2}/)?(?:[\w@.-]+/)+[\w@.-]+\.\w+)"
HAS_PATH = r"[\w@.-]/[\w@.-]+\.\w"  # is there where FILE_PATH is, without its runs
ERROR_TYPE = r"\b(\w*(?:Error|Exception))\b"


def any_of(words) -> str:
    """A pattern for any of the words."""
    return "(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")"


def like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def bound(value: Column, body) -> Column:
    """body of a value that is made once, however often body, or a function within it, takes it up."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def holds(text: Column, words) -> Column:
    """Any of the words as a substring: byte by byte, so that a text costs little beside a pattern's alternatives at each place."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words]) if words else like(text, any_of(words))


def has_word(text: Column, words) -> Column:
    """Any of the words as a substring, in either case."""
    return bound(F.lower(text), lambda low: holds(low, words))


def mask_secrets(text: Column, own: tuple[str, ...] = ()) -> Column:
    """Values of keys, bare tokens, credentials in URLs and values of well-known variables, in this order. own: further
    beginnings of keys, as patterns; a token that starts so goes with the 20 characters or more after it."""
    either = lambda *patterns: "(?:" + "|".join(patterns) + ")"
    assigned = r"(?i)(" + either(*SECRET_NAMES, *own) + r"[=:\s]+\s*['\"]?)[A-Za-z0-9_\-./+=]{8,}['\"]?"
    tokens = either(*SECRET_TOKENS, *(o + r"[A-Za-z0-9_\-]{20,}" for o in own))

    def masked(t: Column, low: Column) -> Column:
        # Nothing that a pass matches holds a mask's asterisks or lies across one but a URL's credentials, so what the text holds at first decides for each pass.
        named = holds(low, NAMES_HOLD) | like(t, "(?i)" + either(*own)) if own else holds(low, NAMES_HOLD)
        bare = holds(t, TOKENS_HOLD) | like(t, TOKEN_FORMS) | like(t, either(*own)) if own else holds(t, TOKENS_HOLD) | like(t, TOKEN_FORMS)
        out = t
        for there, pattern, by in (
            (named, assigned, "$1" + MASK), (bare, tokens, MASK), (F.contains(t, F.lit("://")) & F.contains(t, F.lit("@")), SECRET_URL, f"://{MASK}:{MASK}@"), (holds(low, ENV_HOLD), SECRET_ENV, "$1" + MASK),
        ):
            out = bound(out, lambda o: F.when(there, F.regexp_replace(o, pattern, by)).otherwise(o))
        return out

    return bound(text, lambda t: bound(F.lower(t), lambda low: masked(t, low)))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _found_if(there: Column, text: Column, pattern: str) -> Column:
    """The same of a text that `there` says may have some."""
    return F.when(there, _found(text, pattern)).when(text.isNotNull(), F.array().cast("array<string>"))


def extract_dates(text: Column, ref_date: Column) -> Column:
    """Sorted distinct dates: ISO ones as they are but with dashes, English ones in four forms; if there are none, those
    of relative phrases (yesterday, today, tomorrow, N days/weeks/months/years ago, in N ..., last/next weekday), from ref_date."""
    dated = like(text, r"\d{4}")
    iso = F.transform(_found_if(dated, text, ISO_DATE), lambda d: F.replace(d, F.lit("/"), F.lit("-")))
    plain = lambda d: F.trim(F.regexp_replace(F.regexp_replace(F.replace(d, F.lit(","), F.lit(" ")), r"(?i)(?<=\d)(st|nd|rd|th)", ""), r"\s+", " "))

    def parsed(d):
        day = F.regexp_extract(d, r"(?:^|\s)(\d{1,2})(?=\s|$)", 1)
        month = F.substring(F.initcap(F.regexp_extract(d, r"([A-Za-z]+)", 1)), 1, 3)
        year = F.regexp_extract(d, r"(\d{4})", 1)
        return F.date_format(F.try_to_date(F.concat_ws(" ", F.lpad(day, 2, "0"), month, year), "dd MMM yyyy"), "yyyy-MM-dd")

    natural = F.filter(F.transform(_found_if(dated, text, NATURAL_DATE), lambda d: parsed(plain(d))), lambda d: d.isNotNull())
    absolute = F.array_sort(F.array_distinct(F.concat(iso, natural)))

    def phrases(low: Column) -> Column:
        there = holds(low, ("yesterday", "today", "tomorrow", "ago", "last", "next")) | like(low, r"in\s+\d")
        return F.array_sort(F.array_distinct(F.filter(F.transform(_found_if(there, low, RELATIVE), lambda p: F.date_format(relative_date(p, ref_date), "yyyy-MM-dd")), lambda d: d.isNotNull())))

    return bound(absolute, lambda a: F.when(F.size(a) > 0, a).otherwise(bound(F.lower(text), phrases)))


RELATIVE = r"\b(yesterday|today|tomorrow|\d{1,3}\s+(?:day|week|month|year)s?\s+ago|in\s+\d{1,3}\s+(?:day|week|month|year)s?|(?:last|next)\s+(?:sunday|monday|tuesday|wednesday|thursday|friday|saturday|week|month|year))\b"


def relative_date(phrase: Column, ref: Column) -> Column:
    """The day that a lower-case relative phrase names, from ref; null for another phrase."""
    n = F.regexp_extract(phrase, r"(\d+)", 1).cast("int")
    n = F.when(like(phrase, r"ago$"), -n).otherwise(n)
    shift = lambda unit, by: F.when(unit == "day", F.date_add(ref, by)).when(unit == "week", F.date_add(ref, by * 7)).when(unit == "month", F.add_months(ref, by)).when(unit == "year", F.add_months(ref, by * 12))
    sign = F.when(phrase.startswith("last"), -1).otherwise(1)
    unit = F.regexp_extract(phrase, r"(day|week|month|year)s?", 1)
    name = F.regexp_extract(phrase, "(" + "|".join(DAY_NAMES) + ")", 1)
    ahead = F.next_day(ref, "sunday")
    for d in DAY_NAMES[1:]:
        ahead = F.when(name == d, F.next_day(ref, d)).otherwise(ahead)
    back = F.when(F.date_add(ahead, -7) == ref, F.date_add(ahead, -14)).otherwise(F.date_add(ahead, -7))
    return (
        F.when(phrase == "yesterday", F.date_add(ref, -1)).when(phrase == "today", ref).when(phrase == "tomorrow", F.date_add(ref, 1))
        .when(name != "", F.when(sign < 0, back).otherwise(ahead)).when(n.isNotNull(), shift(unit, n)).otherwise(shift(unit, sign))
    )


def occurrence_day(text: Column) -> Column:
    """The day of the first `[Date: YYYY-MM-DD]`; null if there is none or it isn't a day."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"\[Date: (\d{4}-\d{2}-\d{2})\]", 1), F.lit("")), "yyyy-MM-dd")


def extract_recurrence(text: Column, words: Words = ENGLISH) -> Column:
    """Sorted weekdays, 0 for Sunday, of a text with an every word; without one, those of weekday adverbs; else null."""
    def days(low: Column) -> Column:
        named = lambda lists: F.filter(F.array(*[F.when(holds(low, n) & like(low, rf"\b{any_of(n)}\b"), F.lit(i)) if n else F.lit(None).cast("int") for i, n in enumerate(lists)]), lambda d: d.isNotNull())
        adverbs = named(words.day_adverbs)
        return F.when(holds(low, words.every), F.array_sort(F.array_distinct(F.concat(named(words.days), adverbs)))).otherwise(adverbs) if words.every else adverbs

    return bound(bound(F.lower(text), days), lambda d: F.when(F.size(d) > 0, d))


def compute_importance(text: Column, tags: Column, decision=DECISION_WORDS, error=ERROR_WORDS, architecture=ARCHITECTURE_WORDS) -> Column:
    """0.2 and more for words of decision, error and architecture, a path, code, length and tags; at most 1."""
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(0.0)

    def score(t: Column, low: Column) -> Column:
        broken = holds(low, error) | (holds(t, ("Error", "Exception")) & like(t, ERROR_TYPE))
        path = F.contains(t, F.lit("/")) & like(t, HAS_PATH)
        return F.least(
            F.lit(0.2) + add(holds(low, decision), 0.3) + add(broken, 0.2) + add(holds(low, architecture), 0.2) + add(path, 0.1) + add(F.contains(t, F.lit("`")), 0.1) + add(F.length(t) > 500, 0.1)
            + add(F.size(tags) >= 3, 0.1), F.lit(1.0),
        )

    return bound(text, lambda t: bound(F.lower(t), lambda low: score(t, low)))


def negation_polarity(text: Column, markers=NEGATION_MARKERS) -> Column:
    return F.when(has_word(F.coalesce(text, F.lit("")), markers), -1).otherwise(1)


def matched(low: Column, tokens: Column, words, most: int) -> Column:
    """The first `most`, in sorted order, of the words that a text in lower case has: whole tokens; phrases, and words of other scripts,
    anywhere in it. Words of one letter never match."""
    words = sorted({w.lower() for w in words if len(w) > 1})
    inside = [w for w in words if " " in w or not w[0].isascii()]
    whole = [w for w in words if w not in inside]
    none = F.array().cast("array<string>")
    found = F.array_intersect(tokens, F.array(*map(F.lit, whole))) if whole else none
    parts = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in inside]), lambda w: w.isNotNull()) if inside else none
    return F.slice(F.array_sort(F.concat(found, parts)), 1, most)


def related(text: Column, low: Column, tokens: Column, words: Words) -> Column:
    """The first two relationship words in a social context: within three words of a preposition, or of a possessive if the text names an
    event or activity. Words of other scripts count anywhere."""
    any_word = lambda names: F.arrays_overlap(tokens, F.array(*map(F.lit, names))) if names else F.lit(False)
    social = any_word(words.events) | any_word(words.activities)
    marks = "[.,!?:;\"'()]"
    clean = F.transform(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0), lambda w: F.lower(F.regexp_replace(w, marks, "")))
    latin = [w for w in words.relationships if w[0].isascii()]
    others = sorted(w for w in words.relationships if not w[0].isascii() and len(w) > 1)

    def near(v: Column) -> Column:
        def after(w: Column, i: Column) -> Column:
            asked = w.isin(*words.prepositions) | (w.isin(*words.possessives) & v["social"])
            three = F.array(*[F.get(v["clean"], i + k) for k in (1, 2, 3)])
            return F.when(asked, F.get(F.filter(three, lambda x: x.isin(*latin)), F.lit(0)))

        return F.slice(F.filter(F.transform(v["clean"], after), lambda w: w.isNotNull()), 1, 2)

    none = F.array().cast("array<string>")
    found = bound(F.struct(clean.alias("clean"), social.alias("social")), near) if latin else none
    if latin and not set("".join(latin)) & set("σς"):  # sigma's lower case depends on what follows it
        there = bound(F.regexp_replace(low, marks, ""), lambda plain: holds(plain, latin) & like(plain, rf"(?:^|\s){any_of(latin)}(?:\s|$)"))
        found = F.when(there, found).when(text.isNotNull(), none)
    if not others:
        return found
    extra = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in others]), lambda w: w.isNotNull())
    return F.slice(F.concat(found, extra), 1, 2)


def extract_entities(text: Column, words: Words = ENGLISH) -> Column:
    """Sorted `type:name` tags, the first 20: names in camel case, the first five paths, error types; at most two events, activities,
    emotions and preferences in sorted order, two relationships in a social context and three quantities in order of the text, and of the
    cities and countries that are given two cities, and three places in all."""
    none = F.array().cast("array<string>")
    tag = lambda kind, names: F.transform(names, lambda n: F.concat(F.lit(kind + ":"), n))

    def tags(t: Column, low: Column, tokens: Column) -> Column:
        pattern = rf"(?i)\b(?!(?:19|20)\d{{2}}\b)(\d+(?:\.\d+)?\s+{any_of(words.units)})\b"
        amounts = F.transform(F.slice(_found_if(like(t, r"\d\s"), t, pattern), 1, 3), lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")) if words.units else none
        places = lambda names: F.array_distinct(_found_if(holds(t, names), t, rf"\b({any_of(names)})\b")) if names else none
        every = F.concat(
            tag("entity", _found_if(like(t, "[a-z][A-Z]"), t, CAMEL_CASE)), tag("file", F.slice(_found_if(F.contains(t, F.lit("/")) & like(t, HAS_PATH), t, FILE_PATH), 1, 5)),
            tag("error", _found_if(holds(t, ("Error", "Exception")), t, ERROR_TYPE)), tag("event", matched(low, tokens, words.events, 2)), tag("activity", matched(low, tokens, words.activities, 2)),
            tag("emotion", matched(low, tokens, words.emotions, 2)), tag("preference", matched(low, tokens, words.preferences, 2)), tag("relationship", related(t, low, tokens, words)), tag("quantity", amounts),
            tag("location", F.slice(F.concat(F.slice(places(words.cities), 1, 2), places(words.countries)), 1, 3)),
        )
        return F.slice(F.array_sort(F.array_distinct(every)), 1, 20)

    return bound(text, lambda t: bound(F.lower(t), lambda low: bound(F.split(low, r"\s+"), lambda tokens: tags(t, low, tokens))))


def split_entity_ref(ref: Column) -> Column:
    """struct(kind, name): kind is null unless it is one of the known types."""
    kind = F.split_part(ref, F.lit(":"), F.lit(1))
    known = F.contains(ref, F.lit(":")) & kind.isin(*ENTITY_TYPES)
    return F.struct(F.when(known, kind).alias("kind"), F.when(known, F.substring(ref, F.length(kind) + 2, F.length(ref))).otherwise(ref).alias("name"))


def memory_date(metadata: Column, text: Column, created_at: Column) -> Column:
    """The first of: metadata's first date, the text's `[Date: ...]`, the day of creation; as text."""
    return F.coalesce(F.get_json_object(metadata, "$.dates[0]"), F.date_format(occurrence_day(text), "yyyy-MM-dd"), F.date_format(created_at, "yyyy-MM-dd"))


# What marks a question's kind.
ORDERING = (
    "what is the order of", "from earliest to latest", "from latest to earliest", "in (?:chronological|reverse) order", "list the order", "list in order", "walk me through the order",
    "in (?:what|which) order", "the sequence (?:of|in which)",
)
MULTI_HOP = (
    "how many (?:months?|weeks?|days?|years?) (?:between|since|before|after|passed)", "which (?:happened|came|occurred|did I do|event|did I|trip|device|gift|project) .{0,20}first", "what (?:is|was) the order",
    "how long (?:between|since|before|after|had passed|did it take)", "which .{0,30} (?:earlier|later|before|after)", "how (?:old|long) was I when",
    "how many .{0,40}across (?:my |our )?(?:sessions?|requests?|conversations?)", "across (?:all |my |our )?(?:sessions?|conversations?|requests?)",
)
CROSS_REFERENCE = (
    r"how many (?:different |unique |total )\w+", r"how many .{0,50}across (?:my |our |all )?(?:\w+ )?(?:sessions?|conversations?|requests?|messages?|questions?)", "how many .{0,30}(?:in total|total)",
    "how much .{0,30}(?:in total|total|altogether|improve)", "between .{3,50} and .{3,50}, (?:which|what|how)", "considering .{5,80}, how", "given .{5,80}, how",
    "how (?:have|has|did) .{3,40} (?:evolved?|changed?|improved?|progressed?)", "how .{0,20}compare", "what (?:two|three|all) .{3,30}(?:did I|am I|have I)",
)
SUMMARY = (
    "comprehensive summary", "summarize (?:all|everything|my|how)", "summary of (?:all|everything|how|my|what)", "overview of (?:all|everything|how|my)", "how .{0,30} has progressed",
    "how .{0,30} have (?:developed|evolved|changed)", "give me a (?:full|complete|comprehensive|summary)", "progress.{0,20}including", "across (?:all|my) (?:sessions?|conversations?)", "over (?:time|the course)",
)
ANCHORS = (
    r"(?i)between\s+(.+?)\s+and\s+(.+?)(?:\s*[?.!]|$)", r"(?i)(?:first|earlier|later),?\s+(.+?)\s+or\s+(?:the\s+)?(.+?)(?:\s*[?.!]|$)",
    r"(?i)(?:before|after)\s+(.+?)\s+did\s+(?:I\s+)?(.+?)(?:\s*[?.!]|$)", r"(?i)been\s+(.+?)\s+when\s+(?:I\s+)?(.+?)(?:\s*[?.!]|$)",
)
SINCE = r"(?i)(?:since|after|before)\s+(.+?)\s+(?:did|was|had|have|how|when)"


def _asks(query: Column, patterns: tuple[str, ...]) -> Column:
    return like(query, "(?i)" + "|".join(patterns))


def _kind(query: Column, hops: Column) -> Column:
    temporal = like(F.lower(query), r"\b" + any_of(TEMPORAL_WORDS) + r"\b")
    return F.when(_asks(query, ORDERING), "ordering").when(hops, "multi_hop").when(_asks(query, CROSS_REFERENCE), "cross_reference").when(_asks(query, SUMMARY), "summary").when(temporal, "temporal").otherwise("plain")


def classify_query(query: Column) -> Column:
    """ordering, multi_hop, cross_reference, summary, temporal or plain: the first that matches."""
    return _kind(query, _asks(query, MULTI_HOP))


def query_route(query: Column) -> Column:
    """The same, but a question of several hops without anchors is taken as what it is besides."""
    return _kind(query, _asks(query, MULTI_HOP) & (F.size(query_anchors(query)) > 0))


def reformulate_query(query: Column) -> Column:
    """Quoted strings, ISO dates and content words of any script (capitalised, or four letters or more, and no filler), each once in order; the query itself if that leaves fewer than two."""
    quoted = F.transform(_found(query, r"('[^']+'|\"[^\"]+\")"), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    words = F.filter(_found(query, r"(?U)\b([\w'-]+)\b"), lambda w: ~F.lower(w).isin(*FILLER) & (like(w, r"^\p{Lu}") | (F.length(w) >= 4)))
    terms = F.concat(quoted, _found(query, ISO_DATE), words)
    once = F.filter(terms, lambda t, i: F.array_position(F.transform(terms, F.lower), F.lower(t)) == i + 1)
    return F.when((F.length(query) < 5) | (F.size(terms) < 2), query).otherwise(F.array_join(once, " "))


def query_anchors(query: Column) -> Column:
    """The two things a question compares, or the one it counts from; without articles, over two letters."""
    pair = lambda p: F.when(like(query, p), F.array(F.regexp_extract(query, p, 1), F.regexp_extract(query, p, 2)))
    found = F.coalesce(*[pair(p) for p in ANCHORS], F.when(like(query, SINCE), F.array(F.regexp_extract(query, SINCE, 1))), F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda a: F.trim(F.regexp_replace(a, r"(?i)^(?:the|a|an|my)\s+", ""))), lambda a: F.length(a) > 2)


def direction(query: Column) -> Column:
    words = F.split(F.lower(query), r"\W+")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, AFTER_WORDS))), "future").when(F.arrays_overlap(words, F.array(*map(F.lit, BEFORE_WORDS))), "past").otherwise("near")


def _point(phrase: Column, ref: Column) -> Column:
    """The day that an ISO date or a relative phrase at the start of the text names."""
    iso = F.regexp_extract(phrase, r"^(\d{4}-\d{1,2}-\d{1,2})", 1)
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-M-d"), relative_date(F.get(_found(phrase, "^" + RELATIVE), F.lit(0)), ref))


def resolve_time_range(query: Column, ref_date: Column) -> Column:
    """struct(start, stop), days, by the first that fits: `between X and Y` or `from X to Y`, with ISO dates or relative phrases;
    a relative phrase, three days before to four after; weeks, months or years ago in words (a window around it, or that year);
    a month's name (last, next, or the latest such month). Null without one."""
    low = F.lower(query)
    span = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    ends = [(F.regexp_extract(low, p, 1), F.regexp_extract(low, p, 2)) for p in (r"between\s+(.+?)\s+and\s+(.+?)(?:\s*[?.!]|$)", r"from\s+(.+?)\s+to\s+(.+?)(?:\s*[?.!]|$)")]
    given = [F.when(_point(x, ref_date).isNotNull() & _point(y, ref_date).isNotNull(), span(_point(x, ref_date), _point(y, ref_date))) for x, y in ends]
    ago = r"\b(\d{1,3}|" + "|".join(NUMBER_WORDS) + r")\s+(week|month|year)s?\s+ago"
    said = F.regexp_extract(low, ago, 1)
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), said), F.when(like(said, r"^\d+$"), said.cast("int")))
    unit, back = F.regexp_extract(low, ago, 2), lambda days: F.date_sub(ref_date, days)
    year = F.year(ref_date) - n
    window = (
        F.when(unit == "week", span(back(n * 7 + 3), F.when(n > 1, back((n - 1) * 7)).otherwise(ref_date)))
        .when(unit == "month", span(back(n * 30 + 15), F.when(n > 1, back((n - 1) * 30 - 15)).otherwise(ref_date)))
        .when(unit == "year", span(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))))
    )
    day = relative_date(F.get(_found(low, RELATIVE), F.lit(0)), ref_date)
    around = F.when(day.isNotNull(), span(F.date_add(day, -3), F.date_add(day, 4)))
    month = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MONTH_NAMES, 1))):
        month = F.when(F.contains(low, F.lit(name)), i).otherwise(month)
    its_year = F.year(ref_date) + F.when(like(low, "last|previous"), -1).when(F.contains(low, F.lit("next")), 1).when(month > F.month(ref_date), -1).otherwise(0)
    first = F.make_date(its_year, month, F.lit(1))
    return F.coalesce(*given, around, F.when(n.isNotNull(), window), F.when(month.isNotNull(), span(first, F.last_day(first))))


def source_fingerprint(text: Column) -> Column:
    """SHA-256 of a text with line feeds only, lines without white space at their ends, and no blank lines around it."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t\f]+(?=\n|$)", "")
    return F.sha2(F.regexp_replace(lines, r"^\n+|\n+$", ""), 256)


def message_text(text: Column, blocks: Column) -> Column:
    """The flat text if it isn't empty, else the text blocks joined by a blank line. blocks: array of struct(type, text)."""
    parts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), lambda b: b["text"])
    return F.coalesce(F.nullif(text, F.lit("")), F.array_join(parts, "\n\n"))


# Dollars for 1000 tokens, and what models that run locally are called.
PRICES = {"openai:text-embedding-3-small": 0.00002, "voyage:voyage-4-lite": 0.00002}
LOCAL = ("ollama:", "onnx:")


def embedding_cost(model: Column, tokens: Column, prices: dict[str, float] = PRICES) -> Column:
    """Dollars; 0 for a local model, null for one whose price isn't known or without a count of tokens."""
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv]), model)
    return F.when(like(model, "^" + any_of(LOCAL)), 0.0).otherwise(F.round(rate * tokens / 1000, 8))


def gist(text: str) -> str:
    """First, last and the best-scored sentences up to 30 % of a text (50 characters at least), in order, code blocks at the end."""
    blocks = re.findall(r"```.*?```", text, re.S)
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", re.sub(r"```.*?```", " ", text, flags=re.S).strip()) if s]
    if len(sentences) > 3:
        room = max(50, int(len(text) * 0.3)) - len(sentences[0]) - len(sentences[-1])
        score = lambda s: sum(w in s.lower() for w in (*DECISION_WORDS, *ERROR_WORDS)) + bool(re.search(FILE_PATH, s)) + bool(re.search(CAMEL_CASE, s))
        chosen = {0, len(sentences) - 1}
        for i in sorted(range(1, len(sentences) - 1), key=lambda i: (-score(sentences[i]), i)):
            if len(sentences[i]) <= room:
                chosen.add(i)
                room -= len(sentences[i])
        sentences = [sentences[i] for i in sorted(chosen)]
    return "\n".join([" ".join(sentences), *blocks])


def compress_gist():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gist(t))

    return run


def tags_line(text: Column, tags: Column) -> Column:
    """First sentence and first five tags, 200 characters at most."""
    first = F.get(F.split(text, r"(?<=[.!?])\s+"), F.lit(0))
    return F.substring(F.concat_ws(" ", first, F.when(F.size(tags) > 0, F.concat(F.lit("["), F.array_join(F.slice(tags, 1, 5), ", "), F.lit("]")))), 1, 200)


def register(spark: SparkSession) -> None:
    """Names for SQL users."""
    from cairn.functions.vectors import register as vectors

    vectors(spark)
    spark.udf.register("compress_gist", compress_gist())
    bare = "|".join(SECRET_TOKENS).replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mask_bare_secrets(t STRING) RETURNS STRING RETURN regexp_replace(t, '{bare}', '{MASK}')")
