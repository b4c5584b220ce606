"""Reading and writing of memories: exports, notes and topic pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import source_fingerprint

EXPORT = "profile string, exported_at string, count long, memories array<struct<id:string,content:string,metadata:string,source:string,profile:string,tags:array<string>,created_at:string,updated_at:string>>"


def read_memory_export(spark: SparkSession, path: str) -> DataFrame:
    """A row for each memory of JSON export documents; a memory without a profile has the document's."""
    docs = spark.read.schema(EXPORT).json(path, multiLine=True)
    rows = docs.select(F.col("profile").alias("p"), F.explode("memories").alias("m")).select("p", "m.*")
    return rows.withColumn("profile", F.coalesce("profile", "p")).drop("p")


def write_memory_export(mem: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """Memories by profile, ordered by creation and id within a file. Files of at most rows_per_file rows split a large profile."""
    n = mem.count()
    parts = max(1, -(-n // rows_per_file))
    dealt = mem.repartition(parts * 4, "profile", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("profile", "created_at", "id")
    dealt.write.partitionBy("profile").option("maxRecordsPerFile", rows_per_file).mode("overwrite").format(fmt).save(path)


def export_markdown(mem: DataFrame) -> DataFrame:
    """profile, seq key (created_at, id) and a section of Markdown for each memory."""
    section = F.concat_ws(
        "\n\n", F.concat(F.lit("## "), F.date_format("created_at", "yyyy-MM-dd")), F.when(F.size("tags") > 0, F.concat(F.lit("**Tags:** "), F.array_join("tags", ", "))),
        F.when(F.col("source").isNotNull(), F.concat(F.lit("**Source:** "), F.col("source"))), F.col("content"), F.lit("---"),
    )
    return mem.select("profile", "created_at", "id", section.alias("text"))


def read_notes(spark: SparkSession, root: str, most_bytes: int = 1_000_000) -> DataFrame:
    """path, content, tags, fingerprint of a tree of *.md files: no dot-folders, no empty and no very large files; tags of
    the front matter as a list `[a, b]`, a `- a` block or a single word; the body with line feeds only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    kept = files.filter((F.col("length") > 0) & (F.col("length") <= most_bytes) & ~F.regexp_like(F.replace("path", F.lit(root)), F.lit(r"/\.[^/]+/")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    rows = kept.select("path", text.alias("text"))
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    line = F.regexp_extract(front, r"(?m)^tags:[ \t]*(.*)$", 1)
    listed = F.regexp_extract(front, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]*.*(?:\n|\z))+)", 1)
    raw = F.when(listed != "", F.split(F.regexp_replace(listed, r"(?m)^[ \t]*-[ \t]*", ""), "\n")).otherwise(F.split(F.regexp_replace(line, r"[\[\]]", ""), ","))
    tags = F.filter(F.transform(raw, lambda t: F.trim(F.regexp_replace(t, "['\"]", ""))), lambda t: t != "")
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    out = rows.select("path", F.regexp_replace(F.regexp_replace(body, r"[ \t\f]+(?=\n|$)", ""), r"^\n+|\n+$", "").alias("content"), tags.alias("tags"), source_fingerprint(F.col("text")).alias("fingerprint"))
    return out.filter(F.length("content") > 0)


def read_memory_files(spark: SparkSession, root: str, source: str = "agent-memory", project: str | None = None) -> DataFrame:
    """path, content, tags, source, metadata of an agent's memory files: *.md with front matter, but for the index MEMORY.md.
    Tags are source, type (`unknown` without one) and project: the given one, else the last part of the folder's name after a dash.
    Files without front matter or without a body are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = files.filter(F.regexp_extract("path", r"([^/]+)$", 1) != "MEMORY.md").select("path", text.alias("text"), name.alias("name")).filter(F.regexp_like("text", F.lit(r"(?s)\A---\n.*?\n---\n")))
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1), "^['\"]|['\"]$", "")), F.lit(""))
    kind = F.coalesce(field("type"), F.lit("unknown"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    owner = F.lit(project) if project else F.nullif(F.regexp_extract(folder, r"-([^-]+)$", 1), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", ""), r"\A\n+", ""), r"\s+\z", "")
    tags = F.filter(F.array(F.lit(f"source:{source}"), F.concat(F.lit("type:"), kind), F.concat(F.lit("project:"), owner)), lambda t: t.isNotNull())
    metadata = F.to_json(F.struct(F.coalesce(field("name"), F.col("name")).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"), kind.alias("type"), F.col("path").alias("source_file"), field("originSessionId").alias("origin_session_id")))
    return rows.select("path", body.alias("content"), tags.alias("tags"), F.lit(source).alias("source"), metadata.alias("metadata")).filter(F.length("content") > 0)


def read_dump(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """A tracker's or chat's JSON dump, one object a line or one document a file; the mappers of operators.ingest take it on."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def named_topics(summaries: DataFrame) -> DataFrame:
    """profile, topic_key, others: the other topics of the profile that a summary's body names, by a join of the body's word n-grams, as long as
    the keys are, with the keys. Case counts; a key's blanks may be any white space."""
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}:_-]+"), lambda w: F.length(w) > 0)
    keys = summaries.select("profile", F.col("topic_key").alias("other"), words(F.col("topic_key")).alias("w")).select("profile", "other", F.size("w").alias("n"), F.array_join("w", " ").alias("gram")).filter("n > 0")
    sizes = sorted(r["n"] for r in keys.select("n").distinct().collect())  # the lengths of keys, a few
    if not sizes:
        return summaries.select("profile", "topic_key", F.array("topic_key").alias("others")).limit(0)
    body = summaries.select("profile", "topic_key", words(F.col("content")).alias("w"))
    grams = F.flatten(F.array(*[
        F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, F.lit(n)), " ").alias("gram")))).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))  # noqa: B023
        for n in sizes
    ]))
    said = body.select("profile", "topic_key", F.explode(F.array_distinct(grams)).alias("g")).select("profile", "topic_key", "g.n", "g.gram")
    return said.join(keys, ["profile", "n", "gram"]).filter(F.col("other") != F.col("topic_key")).groupBy("profile", "topic_key").agg(F.sort_array(F.collect_set("other")).alias("others"))


def write_topic_pages(summaries: DataFrame) -> DataFrame:
    """profile, slug, text: a page for each summary, with other topic keys of the profile that its body names put in [[ ]] outside code and
    links; where keys overlap the longest first. summaries: profile, topic_key, content, source_count."""
    named = named_topics(summaries)

    @F.pandas_udf("string")
    def linked(bodies: pd.Series, others: pd.Series) -> pd.Series:
        import re

        def one(body, names):
            if body is None or names is None or not len(names):
                return body
            found = "|".join(r"\s+".join(map(re.escape, n.split())) for n in sorted(names, key=len, reverse=True))
            pattern = re.compile(r"(```.*?```|`[^`]*`|\[\[.*?\]\])|(?<![\w:-])(" + found + r")(?![\w:-])", re.S)
            return pattern.sub(lambda m: m[1] or f"[[{m[2]}]]", body)

        return pd.Series([one(b, o) for b, o in zip(bodies, others)])

    joined = summaries.join(named, ["profile", "topic_key"], "left")
    head = F.concat(F.lit("---\ntopic: "), F.col("topic_key"), F.lit("\nsources: "), F.col("source_count").cast("string"), F.lit("\n---\n\n"))
    slug = F.regexp_replace(F.lower("topic_key"), r"[^a-z0-9]+", "-")
    return joined.select("profile", slug.alias("slug"), F.concat(head, linked("content", "others")).alias("text"))


def topic_index(summaries: DataFrame, as_of: Column) -> DataFrame:
    """profile, place, line: each profile's page of contents, a row for each line: a heading, the time and number of topics, then the topics by
    key with a link to each page. summaries: profile, topic_key, status, source_count."""
    slug = F.regexp_replace(F.lower("topic_key"), r"[^a-z0-9]+", "-")
    w = Window.partitionBy("profile").orderBy("topic_key")
    topics = summaries.select("profile", (F.row_number().over(w) + 2).cast("long").alias("place"), F.concat(F.lit("- [["), slug, F.lit("|"), F.col("topic_key"), F.lit("]]: "), "status", F.lit(", "), F.col("source_count").cast("string"), F.lit(" sources")).alias("line"))
    count = summaries.groupBy("profile").agg(F.count("*").alias("n"))
    at = F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")
    head = F.array(F.concat(F.lit("# Topics of "), "profile"), F.concat(F.lit("Written "), at, F.lit(", "), F.col("n").cast("string"), F.lit(" topics.")), F.lit("## Topics"))
    return count.select("profile", F.posexplode(head).alias("place", "line")).select("profile", F.col("place").cast("long").alias("place"), "line").unionByName(topics)


def list_profile_entities(memory_entities: DataFrame, edges: DataFrame) -> DataFrame:
    """profile, entity: entities of the profile's memories and both ends of its edges."""
    return memory_entities.select("profile", "entity").unionByName(edges.select("profile", F.col("subject").alias("entity"))).unionByName(edges.select("profile", F.col("object").alias("entity"))).distinct()


def concept_bundle(mem: DataFrame, memory_entities: DataFrame, names: DataFrame) -> DataFrame:
    """id, paths: each memory with the sorted paths (`type/name`) of its entities. names: entity_id, entity_type, canonical_name."""
    path = F.concat_ws("/", "entity_type", F.regexp_replace(F.lower("canonical_name"), r"[^a-z0-9]+", "-"))
    linked = memory_entities.join(names.select("entity_id", path.alias("path")), "entity_id").groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return mem.select("id", "profile").join(linked, "id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
