"""Entity tags and recurrence by word lists, against cases by hand and a plain version of the social context."""

import random

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.words import ENGLISH, Words

CASES = {
    "Went hiking with my sister after the wedding": {"activity:hiking", "event:wedding", "relationship:sister"},
    "I love the DataFrameReader; see src/app/io.py, KeyError!": {"preference:love", "entity:DataFrameReader", "entity:KeyError", "error:KeyError", "file:src/app/io.py"},
    "my brother called": set(),  # a possessive alone is no social context
    "my brother came to the party": {"event:party", "relationship:brother"},
    "a present for our dear old teacher and for the dentist, with a friend": {"relationship:dentist", "relationship:friend"},  # the teacher is four words after `for`
    "I always get tea, better than coffee, and usually enjoy it": {"preference:always get", "preference:better than"},
    "so frustrated, angry and sad": {"emotion:angry", "emotion:sad"},  # `frustrated,` is no whole token
    "3 books 12 books 2.5  km 7 cups in 2021 pages": {"quantity:3 books", "quantity:12 books", "quantity:2.5 km"},
    "": set(),
}


def test_cases(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id int, content string")
    got = {r["id"]: set(r["e"]) for r in df.select("id", T.extract_entities(F.col("content")).alias("e")).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert spark.range(1).select(T.extract_entities(F.lit(None).cast("string")).alias("e")).first()["e"] is None


def test_other_languages(spark):
    """Lists are parameters: phrases and scripts without blanks match anywhere, places as they are written."""
    words = Words(
        events=("結婚式",), activities=("wandern",), emotions=("heureux",), preferences=("am liebsten",), relationships=("schwester", "友達"), possessives=("meine",), prepositions=("mit",), units=("Bücher",),
        days=(("sonntag", "so"), ("montag",), (), (), (), (), ()), every=("jeden",), cities=("Bern", "São Paulo", "Rome"), countries=("Peru", "Chad"),
    )
    said = ["明日は結婚式です、友達と", "ich wandern mit meine Schwester am liebsten in São Paulo, Rome, Bern, Peru und Chad", "3 Bücher, berne", "jeden Montag und Sonntag"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, content string")
    got = [r["e"] for r in df.orderBy("id").select(T.extract_entities(F.col("content"), words).alias("e")).collect()]
    assert got[0] == ["event:結婚式", "relationship:友達"]
    assert got[1] == ["activity:wandern", "location:Peru", "location:Rome", "location:São Paulo", "preference:am liebsten", "relationship:schwester"]
    assert got[2] == ["quantity:3 bücher"]
    days = [r["d"] for r in df.orderBy("id").select(T.extract_recurrence(F.col("content"), words).alias("d")).collect()]
    assert days == [None, None, None, [0, 1]]


def plain_related(text):
    tokens = set(text.lower().split())
    clean = [w.translate(str.maketrans("", "", ".,!?:;\"'()")).lower() for w in text.split()]
    social, found = bool(tokens & ({*ENGLISH.events} | {*ENGLISH.activities})), []
    for i, w in enumerate(clean):
        if w in ENGLISH.prepositions or w in ENGLISH.possessives and social:
            found += [x for x in clean[i + 1 : i + 4] if x in ENGLISH.relationships][:1]
    return {f"relationship:{w}" for w in found[:2]}


def test_social_context(spark):
    rng = random.Random(6)
    some = ["with", "for", "my", "her", "the", "old", "sister", "boss,", "Friend", "vet.", "party", "hiking", "and", "(coach)"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").select("id", F.filter(T.extract_entities(F.col("content")), lambda e: e.startswith("relationship:")).alias("e")).collect()
    assert all(set(r["e"]) == plain_related(texts[r["id"]]) for r in rows)
