import json

import pytest

from cairn.operators import ingest as I
from cairn.sources.dumps import read_issue_dump, read_message_dump


def write(path, name, data, lines=False):
    at = path / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join(map(json.dumps, data)) if lines else json.dumps(data, indent=1))


def test_linear(spark, tmp_path):
    issue = lambda i, **more: {"id": f"u{i}", "identifier": f"E-{i}", "title": f"Title {i}", "description": None, "labels": {"nodes": [{"name": "bug"}]}, "comments": {"nodes": []}} | more
    write(tmp_path, "page.json", {"data": {"issues": {"nodes": [issue(1, description="what"), issue(2, comments={"nodes": [{"body": "yes", "user": {"name": "Ada"}}]})]}}})
    write(tmp_path, "one.json", issue(3))
    write(tmp_path, "more.jsonl", [issue(4), issue(5)], lines=True)
    raw = read_issue_dump(spark, str(tmp_path), "linear")
    got = {r["key"]: r for r in I.map_linear(raw).collect()}
    assert sorted(got) == [f"E-{i}" for i in range(1, 6)] and got["E-1"]["tags"] == ["linear:bug", "type:task"] and "**Ada**: yes" in got["E-2"]["content"] and got["E-1"]["content"].endswith("what")


def test_github_and_beads(spark, tmp_path):
    write(tmp_path / "g", "issues.json", [{"id": 1, "title": "A", "body": "b", "labels": [{"name": "x"}]}, {"id": 2, "title": "PR", "pull_request": {"url": "u"}}, {"id": 3, "title": " ", "body": None, "labels": []}])
    got = I.map_github(read_issue_dump(spark, str(tmp_path / "g"), "github")).collect()
    assert [(r["key"], r["content"], r["tags"]) for r in got] == [("issue:1", "A\n\nb", ["x"])]
    write(tmp_path / "b", "list.json", [{"id": "bd-1", "title": "T", "description": "D", "labels": ["l", ""], "status": "open", "priority": 2}, {"title": "no id"}])
    rows = I.map_beads(read_issue_dump(spark, str(tmp_path / "b"), "beads")).collect()
    assert [(r["content"], r["tags"]) for r in rows] == [("T\n\nD", ["l"])]


def test_messages(spark, tmp_path):
    write(tmp_path / "s" / "general", "2024-01-01.json", [{"ts": "1.5", "text": "hi", "user": "U"}, {"ts": "x", "text": "bad"}, {"ts": "2.0", "text": "left", "subtype": "channel_leave"}])
    write(tmp_path / "s" / "api", "page.json", {"messages": [{"ts": "3.0", "text": "yo", "channel": "C1"}], "ok": True})
    got = I.map_slack(read_message_dump(spark, str(tmp_path / "s"), "slack")).collect()
    assert {(r["key"], r["content"]) for r in got} == {("general:1.5", "hi"), ("C1:3.0", "yo")}
    chat = {"id": 9, "type": "private"}
    write(tmp_path / "t", "updates.json", {"ok": True, "result": [{"update_id": 1, "message": {"date": 5, "chat": chat, "text": "a"}}, {"update_id": 2, "channel_post": {"date": 6, "chat": {"id": 8}, "caption": "c"}}, {"update_id": 3}]})
    raw = read_message_dump(spark, str(tmp_path / "t"), "telegram")
    assert {(r["key"], r["content"]) for r in I.map_telegram(raw).collect()} == {("1", "a"), ("2", "c")}
    assert [r["key"] for r in I.map_telegram(raw, [9]).collect()] == ["1"]


def test_kinds_and_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        read_issue_dump(spark, str(tmp_path), "slack")
    with pytest.raises(ValueError):
        read_message_dump(spark, str(tmp_path), "github")
    assert read_issue_dump(spark, str(tmp_path), "beads").count() == 0 and read_message_dump(spark, str(tmp_path), "telegram").count() == 0
