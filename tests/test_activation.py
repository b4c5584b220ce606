"""Activation that spreads: the pruned walk against a plain one, and what it still looks for."""

import math
import random

import pytest

from cairn.operators import entities as E


def plain(seeds, member, factors, depth, least, k):
    of, inside = {}, {}
    for p, m, e in member:
        of.setdefault((p, e), set()).add(m)
        inside.setdefault(m, set()).add(e)
    out = set()
    for q in {q for q, _, _ in seeds}:
        front = {(p, e): 1.0 for x, p, e in seeds if x == q}
        every = dict(front)
        for _ in range(depth):
            new = {}
            for (p, e), a in front.items():
                for m in of.get((p, e), ()):
                    for t in inside[m] - {e}:
                        if t in factors and a * factors[t] > least:
                            new[p, t] = max(new.get((p, t), 0), min(1.0, a * factors[t]))
            front = new
            for x, a in front.items():
                every[x] = max(every.get(x, 0), a)
        best = {}
        for x, a in every.items():
            for m in of.get(x, ()):
                best[m] = max(best.get(m, 0), round(a, 6))
        out |= {(q, m, a, n + 1) for n, (m, a) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def graph(spark, rng, n, strong):
    ents = [(e, rng.choice(["entity", "person", "file"]), rng.uniform(0.2, 6.0) if strong else rng.uniform(0.5, 3.5), rng.randint(1, 4 if strong else 30)) for e in range(n)]
    factors = {e: f for e, t, s, c in ents if t != "person" and (f := 0.65 * min(s, 3.0) / math.log(1 + max(c, 1))) > 0.1}
    member = sorted({(rng.choice("pq"), m, rng.randrange(n)) for m in range(3 * n) for _ in range(rng.randint(1, 3))})
    seeds = [(q, *rng.choice([(p, e) for p, _, e in member])) for q in range(25) for _ in range(2)]
    frames = (
        spark.createDataFrame(seeds, "query_id long, profile string, entity_id long"), spark.createDataFrame(member, "profile string, memory_id long, entity_id long"),
        spark.createDataFrame(ents, "entity_id long, entity_type string, temporal_span double, mention_count long"),
    )
    return (seeds, member, factors), frames


@pytest.mark.parametrize("strong", [False, True])
@pytest.mark.parametrize("depth,k", [(1, 5), (2, 4), (3, 12), (3, 200)])
def test_same_as_plain(spark, strong, depth, k):
    """Also with factors over 1, by which a later hop can overtake an earlier one."""
    own, frames = graph(spark, random.Random(depth + k), 60, strong)
    got = E.spread_activation(*frames, depth=depth, k=k)
    assert {(r["query_id"], r["id"], r["activation"], r["rank"]) for r in got.collect()} == plain(*own, depth, 0.1, k)


def test_later_hops_write_what_can_matter(spark, monkeypatch):
    """Where the first hop gives a query its k memories, the second one's entities aren't written at all."""
    own, frames = graph(spark, random.Random(4), 60, False)
    written, cut = [], E.cut

    def counted(df, by=None):
        out = cut(df, by)
        written.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(E, "cut", counted)
    got = E.spread_activation(*frames, depth=2, k=3)
    assert {(r["query_id"], r["id"], r["activation"], r["rank"]) for r in got.collect()} == plain(*own, 2, 0.1, 3)
    hops = [n for columns, n in written if columns == ["query_id", "profile", "entity_id", "activation"]]
    assert hops[-1] < hops[0] / 4
