from cairn.streaming import events as V


def test_masked_once(spark):
    """The gate masks a text once to judge it, and what it keeps once more, however many words and patterns it looks for."""
    rows = [(1, "Edit", "decided to keep it, token=abcdefgh1234", []), (2, "Edit", "nothing", ["type:fact"]), (3, "Read", "decided", ["type:fact"]), (4, "Edit", "nothing", ["a"]), (5, "Bash", None, ["type:fact"]), (6, "Bash", None, None)]
    gate = V.capture_gate(spark.createDataFrame(rows, "id long, tool string, content string, tags array<string>"))
    assert {r["id"]: r["content"] for r in gate.select("id", "content").collect()} == {1: "decided to keep it, token=***MASKED***", 2: "nothing", 5: None}
    assert gate._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 8
