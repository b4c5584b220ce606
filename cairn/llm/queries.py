"""One thin query for each operator: it applies the operator to its whole table and derives digest columns from what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import cut, sha, table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cairn.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    heads = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = cut(quality.classify(docs, heads).drop("text"), "scored")
    return quality.combine(scored, quality.posteriors(scored), heads)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.imatch import edited_fingerprints

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = edited_fingerprints(docs, low=1 / 1000, high=1 / 20)
    return got.select("doc_id", "n_chars", sha("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=75)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.substring import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=35).select("doc_id", "n_words", "n_removed", sha("text").alias("kept_sha256"))


def op6_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cairn.llm.segment import segmentations

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)
    return got.select(
        "doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_probability", "perturbed", "log_inclusion",
        sha("decoded").alias("decoded_sha256"), "exact",
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.chat import format_chats

    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return format_chats(rows).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha("loss_text").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.lines import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=3, min_chars=20).select("doc_id", "n_lines", "n_dropped", sha("text").alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    proposed = cut(pii.propose(docs).select("doc_id", "__base", "__candidates"), "candidates")
    got = pii.select(proposed, pii.fit(proposed))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return got.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        sha(pii.spans_text(F.col("__base"))).alias("base_sha256"), pii.spans_text(F.col("__spans")).alias("spans"),
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.media import featurize, store_payload

    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("utf8"))
    n = F.octet_length("utf8")
    padded = F.greatest(F.lit(64), F.ceil(n / 64) * 64).cast("int")
    stored = store_payload(docs.select("doc_id", n.cast("long").alias("n_bytes"), F.expr("utf8").alias("utf8"), padded.alias("padded")).select("doc_id", "n_bytes", F.expr("rpad(utf8, padded, X'00')").alias("payload")))
    got = featurize(stored.select("doc_id", "n_bytes", "media"))
    return got.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm import toxicity

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.letters(docs)
    judge = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held), model)
    got = toxicity.score(docs, model, judge)
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.lexical import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.runs import find_runs, repeat_tail

    got = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), least=24, times=3, change=repeat_tail)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha("text").alias("collapsed_sha256"),
    )


QUERIES = {"op1_pack": op1_pack, "op2_quality": op2_quality, "op3_imatch": op3_imatch, "op4_neardup": op4_neardup, "op5_substring": op5_substring, "op6_segment": op6_segment, "op7_chat": op7_chat, "op8_lines": op8_lines, "op9_pii": op9_pii, "op10_media": op10_media, "op11_toxicity": op11_toxicity, "op12_search": op12_search, "op13_runs": op13_runs}
ORACLE_SQL: dict[str, str] = {
    "op5_substring": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM t WHERE n > 1),
        x AS (SELECT w.doc_id, word, w2.p, gone.p IS NOT NULL AS out FROM w LEFT JOIN (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) w2 USING (doc_id) LEFT JOIN gone ON gone.doc_id = w2.doc_id AND gone.p = w2.p)
        SELECT doc_id, count(word) AS n_words, count(*) FILTER (WHERE out) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT out), '')) AS kept_sha256 FROM x GROUP BY doc_id""",
    "op12_search": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM t WHERE len(ts) > 0),
        tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(ts) AS term, len(ts) AS n FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
        x AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10""",
    "op8_lines": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        h AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        x AS (SELECT k.*, m IS NOT NULL AND doc_id <> m AS out FROM k LEFT JOIN h USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '')) AS kept_sha256 FROM x GROUP BY doc_id""",
}
