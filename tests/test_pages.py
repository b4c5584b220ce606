from pyspark.sql import functions as F

from cairn.sources import exchange as O

PAGES = [
    ("p", "alpha", "see beta and `beta`, not alpha", "fresh", 2), ("p", "beta", "none", "stale", 1), ("p", "beta plan", "a beta plan, the beta\nplan and [[beta plan]] but beta-plan isn't one", "fresh", 3),
    ("p", "topic:1", "```\nbeta plan\n```\nthen beta plan; topic:1 itself, Alpha in another case", "fresh", 4), ("q", "beta", "alpha is of another profile", "fresh", 5), ("q", "big beta plan", None, "fresh", 0), ("q", "--", "beta -- beta", "fresh", 1),
]


def test_links(spark):
    """Keys of several words, the longest first, also across a line's end; nothing in code or in links, nor the page's own key."""
    pages = spark.createDataFrame(PAGES, "profile string, topic_key string, content string, status string, source_count int")
    got = {(r["profile"], r["slug"]): None if r["text"] is None else r["text"].split("\n\n", 1)[1] for r in O.write_topic_pages(pages).collect()}
    assert got == {
        ("p", "alpha"): "see [[beta]] and `beta`, not alpha", ("p", "beta"): "none", ("p", "beta-plan"): "a [[beta]] plan, the [[beta]]\nplan and [[beta plan]] but beta-plan isn't one",
        ("p", "topic-1"): "```\nbeta plan\n```\nthen [[beta plan]]; topic:1 itself, Alpha in another case", ("q", "beta"): "alpha is of another profile", ("q", "big-beta-plan"): None, ("q", "-"): "[[beta]] -- [[beta]]",
    }
    assert O.write_topic_pages(pages.limit(0)).count() == 0


def test_index(spark):
    pages = spark.createDataFrame(PAGES, "profile string, topic_key string, content string, status string, source_count int")
    rows = O.topic_index(pages, F.lit("2024-04-15 01:02:03").cast("timestamp")).filter("profile = 'p'").orderBy("place").collect()
    assert [r["line"] for r in rows] == [
        "# Topics of p", "Written 2024-04-15 01:02:03, 4 topics.", "## Topics", "- [[alpha|alpha]]: fresh, 2 sources", "- [[beta|beta]]: stale, 1 sources", "- [[beta-plan|beta plan]]: fresh, 3 sources", "- [[topic-1|topic:1]]: fresh, 4 sources",
    ]
    assert [r["place"] for r in rows] == list(range(7))
