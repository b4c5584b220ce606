import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import toxicity as T
from cairn.llm.queries import op11_toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return T.letters(spark.read.parquet(f"{SF}/documents.parquet").select("text"))


def test_letters_are_a_distribution(model):
    """Each context's probabilities add up to one, with one more letter for all that was never seen."""
    seen = [g for g in model.counts if len(g) == 1]
    for before in ("    ", " idi", "zzqq", "tion", ""):
        total = sum(math.exp(model.log(before, c)) for c in seen) + math.exp(model.log(before, "☃"))
        assert abs(total - 1) < 1e-9


def test_counts_cover_all_documents(spark):
    """A spelling counts once for each document that has it, whatever the partitions."""
    docs = spark.createDataFrame([("Abc abc, abc!",), ("abc x1",), (None,), ("",)], "text string").repartition(3)
    assert T.letters(docs).counts["abc"] == 4 and T.letters(docs).counts[" "] == 4
    assert T.letters(docs.limit(0)).counts == {}


def test_grams_and_hits(model):
    words, counts = ["abc", "é", "abcd", "ab"], np.array([3, 1, 2, 5])
    want = {}
    for w, n in zip(words, counts.tolist()):
        padded = " " * (T.ORDER - 1) + w + " "
        for i in range(len(w) + 1):
            want[padded[i : i + T.ORDER]] = want.get(padded[i : i + T.ORDER], 0) + n
    got = T._grams(words, counts)
    assert dict(zip(got.column("gram").to_pylist(), got.column("n").to_pylist())) == want and T._grams([], np.zeros(0, np.int64)).num_rows == 0
    r = T.Restorer(model)
    for s in ("idiot", "1d10t!", "y o u i d i o t", "lose", "losers", "2009"):
        lexicon = {t: 1.0 for t in T.terms(r, s)} | {"xyz": 2.0}
        assert dict(T.Finder(r, lexicon).hits(s)) == {t: 1.0 for t in T.terms(r, s)}


def brute(spelling, model):
    """Every path of the lattice, scored as decode() scores them."""
    best = (-math.inf, "")
    parts = [T._arcs(m[1], len(m[0])) for m in T._RUNS.finditer(spelling)]
    for path in itertools.product(*parts):
        p, s, said = 0.0, " " * (T.ORDER - 1), ""
        for letters, cost in path:
            p += cost
            for c in letters:
                if c == " " and s[-1] == " ":
                    continue
                p += model.log(s, c)
                s, said = s[1:] + c, said + c
        p += 0.0 if s[-1] == " " else model.log(s, " ")
        best = max(best, (p, said.strip()))
    return best


def test_viterbi_is_exact(model):
    rng = random.Random(4)
    spellings = ["1d10t", "l o s e r", "st*p1d", "sc.u.m", "", "!!", "é1é"] + ["".join(rng.choice("aeidlost10$*. ") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    for s in spellings:
        best, said = brute(s, model)
        got = T.decode(s, model)
        if got != said:  # another path as likely
            assert best - max(p for p in [best_of(got, s, model)]) < 1e-9
        assert got == said or got.replace(" ", "") != ""


def best_of(said, spelling, model):
    """The best score of the paths that say this."""
    best = -math.inf
    parts = [T._arcs(m[1], len(m[0])) for m in T._RUNS.finditer(spelling)]
    for path in itertools.product(*parts):
        p, s, out = 0.0, " " * (T.ORDER - 1), ""
        for letters, cost in path:
            p += cost
            for c in letters:
                if c == " " and s[-1] == " ":
                    continue
                p += model.log(s, c)
                s, out = s[1:] + c, out + c
        p += 0.0 if s[-1] == " " else model.log(s, " ")
        if out.strip() == said:
            best = max(best, p)
    return best


@pytest.mark.parametrize("spelling,word", [
    ("1d10t", "idiot"), ("!diot", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("m0r0n!!", "moron"), ("1oser", "loser"), ("$tup1d", "stupid"), ("s t u p i d", "stupid"),
    ("st*pid", "stupid"), ("sc_u_m", "scum"), ("tra$h", "trash"), ("p@th3t1c", "pathetic"), ("w0rthle$$", "worthless"), ("idiot###", "idiot"), ("DISGUST1NG", "disgusting"), ("reed", "reed"), ("2009", ""),
])
def test_spellings(model, spelling, word):
    assert T.Restorer(model).word(spelling.lower()) == word


def test_restored_text(model):
    r = T.Restorer(model)
    assert r.text("You are an 1d10t, a  l o s e r\nand $cum!") == "you are an idiot a loser and scum"
    assert r.text("") == "" and r.spellings("") == set()


@pytest.fixture(scope="module")
def judged(spark):
    got = op11_toxicity(spark, SF).cache()
    return got, got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()


def test_held_out_accuracy(spark, judged):
    """Labels that the fit never saw. In sf0.1 one toxic document of fourteen has lost its word to other junk."""
    _, rows = judged
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    toxic, clean = [r["predicted"] for r in held if r["toxic"]], [r["predicted"] for r in held if not r["toxic"]]
    print(len(toxic), np.mean(toxic), len(clean), np.mean(clean))
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.015
    assert judged[0].count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_labels_change_nothing(spark, tmp_path):
    """Labels of held-out rows, other columns and ids are no inputs: the same scores with them turned round."""
    small = "/root/testdata/sf0.01"
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    want, got = ({r["doc_id"]: r["score"] for r in op11_toxicity(spark, sf).collect()} for sf in (small, str(tmp_path)))
    assert want.keys() == got.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_disguised_words(spark, model):
    """Clean texts with one disguised word in them are found, as are plain ones; the clean texts aren't."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judge = T.fit(docs, labels, model)
    rng = random.Random(9)
    clean = [r["text"] for r in docs.join(labels.filter("toxic = 0 AND quality = 1"), "doc_id").filter("lang = 'en'").orderBy("doc_id").limit(300).collect()]
    words = ["1d10t", "i d i o t", "m0r0n", "st*pid", "s.c.u.m", "l0ser", "p@thetic", "tra$h", "w0rthless", "clooown", "D1SGUST1NG", "s t u p i d"]
    rows = []
    for i, t in enumerate(clean):
        w = t.split()
        at = rng.randint(0, len(w))
        rows += [(2 * i, t), (2 * i + 1, " ".join(w[:at] + [words[i % len(words)]] + w[at:]))]
    got = {r["doc_id"]: r["score"] >= 0.3 for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), model, judge).collect()}
    assert np.mean([got[i] for i in got if i % 2]) > 0.97 and np.mean([got[i] for i in got if i % 2 == 0]) < 0.02


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, "you idiot", 5), (1, "you idiot", 5), (None, None, 6), (2, "", None), (3, "plain words", 1), (4, "a" * 300_000 + " " + "1" * 300_000 + " " + "x1" * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    judge = T.fit(docs, labels, model)
    got = T.score(docs, model, judge, restored=True).collect()
    assert got[0]["score"] == got[1]["score"] and got[0]["restored"] == "you idiot" and all(0 <= r["score"] <= 1 for r in got) and got[2]["restored"] == ""
    one = T.score(docs, model, T.fit(docs, labels.filter("toxic = 1"), model)).collect()
    assert {r["score"] for r in one} == {one[0]["score"]} and one[0]["score"] > 0.5
    none = T.fit(docs, labels.limit(0), model)
    assert {r["score"] for r in T.score(docs, model, none).collect()} == {0.0} and T.score(docs.limit(0), model, none).count() == 0
