"""Plain single-threaded versions of the contracts, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(docs, min_docs=3, min_chars=20):
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    out = {}
    for d, t in docs:
        have = (t or "").split("\n")
        kept = [x for x in have if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out[d] = (len(have), len(have) - len(kept), sha("\n".join(kept)))
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    n = lambda x: re.sub("[^0-9]", "", x)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(n(x)) <= 19 and luhn(n(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(n(x)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))


def substring(docs, window=35):
    starts = Counter()
    words = {d: WORD.findall(t or "") for d, t in docs}
    for w in words.values():
        starts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    where = defaultdict(set)
    for d in ids:
        for s in sets[d]:
            where[s].add(d)
    for d in ids:
        shared = Counter(e for s in sets[d] for e in where[s] if e > d)
        for e, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
