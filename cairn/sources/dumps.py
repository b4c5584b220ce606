"""Dumps of trackers and chats by kind, as the rows that the mappers of operators.ingest take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = "struct<nodes: array<struct<name: string>>>"
_MESSAGE = "struct<message_id: long, date: long, text: string, caption: string, chat: struct<id: long, type: string, title: string, username: string>, `from`: struct<id: long, username: string>>"
#: What a row of each kind has, and where a page of the service's answers keeps its rows.
KINDS = {
    "linear": (f"id string, identifier string, title string, description string, priority long, labels {_NAMES}, comments struct<nodes: array<struct<body: string, user: struct<name: string>>>>, state struct<name: string>, assignee struct<name: string>", "data.issues.nodes"),
    "github": ("id long, number long, title string, body string, state string, html_url string, updated_at string, labels array<struct<name: string>>, pull_request string, user struct<login: string>", None),
    "beads": ("id string, title string, description string, labels array<string>, status string, priority long, issue_type string, assignee string, created_at string, updated_at string", None),
    "slack": ("channel string, ts string, text string, subtype string, user string, thread_ts string", "messages"),
    "telegram": (f"update_id long, message {_MESSAGE}, edited_message {_MESSAGE}, channel_post {_MESSAGE}, edited_channel_post {_MESSAGE}", "result"),
}
ISSUES, MESSAGES = ("linear", "github", "beads"), ("slack", "telegram")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    fields, page = KINDS[kind]
    from pyspark.sql.types import ArrayType, StructField, StructType

    row = StructType.fromDDL(fields)
    schema = row
    if page:  # the same columns, or the outermost field that leads to an array of them
        inner = ArrayType(row)
        for name in reversed(page.split(".")[1:]):
            inner = StructType([StructField(name, inner)])
        schema = StructType([*row.fields, StructField(page.split(".")[0], inner)])
    parts = [
        spark.read.schema(schema).option("multiLine", whole).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(path).select("*", F.col("_metadata.file_path").alias("__file"))
        for whole, names in ((True, "*.json"), (False, "*.{jsonl,ndjson}"))
    ]
    read = parts[0].unionByName(parts[1])
    names = row.names
    if not page:
        return read.filter(F.coalesce(*[F.col(c).isNotNull() for c in names[:1]])).select(*names, "__file")
    single = F.array(F.struct(*names))
    rows = read.select("__file", F.explode(F.when(F.col(page).isNotNull(), F.col(page)).otherwise(single)).alias("r"))
    return rows.select("r.*", "__file")


def read_issue_dump(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Issues of a tracker: linear, github or beads. path: a file or a folder of .json files (an object, an array of them, or a page as the
    service answers) and .jsonl or .ndjson files (an object a line), read below each other too. Fields that a file lacks are null."""
    if kind not in ISSUES:
        raise ValueError(f"kind is one of {', '.join(ISSUES)}")
    return _read(spark, path, kind).drop("__file")


def read_message_dump(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Messages of a chat: slack or telegram, from files as in read_issue_dump(). A slack message without a channel has the name of the
    folder that its file is in."""
    if kind not in MESSAGES:
        raise ValueError(f"kind is one of {', '.join(MESSAGES)}")
    rows = _read(spark, path, kind)
    if kind == "slack":
        rows = rows.withColumn("channel", F.coalesce("channel", F.url_decode(F.regexp_extract("__file", r"([^/]+)/[^/]+$", 1))))
    return rows.drop("__file")
