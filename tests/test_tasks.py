import pytest

from vaultspark.operators import tasks


def found(df):
    return [r.asDict() for r in df.orderBy("file_path", "line_number").collect()]


@pytest.mark.parametrize("line, status, content", [
    ("- [ ] Test task", "incomplete", "Test task"), ("- [X] Completed task", "completed", "Completed task"), ("- [x] Done", "completed", "Done"), ("- [-] Cancelled task", "cancelled", "Cancelled task"),
    ("- [?] Unknown status", "other_?", "Unknown status"), ("  - [ ] Indented task", "incomplete", "Indented task"), ("-[ ]close", "incomplete", "close"), ("- [ ] ", "incomplete", ""),
    ("- [🙂] smile", "other_🙂", "smile"), ("- [ ] Task   with    extra    spaces", "incomplete", "Task with extra spaces"), ("- [ ] 09:30 standup #team", "incomplete", "standup #team"),
])
def test_lines(notes, line, status, content):
    (task,) = found(tasks.extract(notes(line)))
    assert (task["status"], task["content"], task["raw_line"], task["line_number"]) == (status, content, line, 1)


@pytest.mark.parametrize("line", ["This is just text", "- Regular list item", "* [ ] star", "- [ ]", "1. [ ] numbered", ""])
def test_no_tasks(notes, line):
    assert found(tasks.extract(notes(line))) == []


def test_metadata(notes):
    (task,) = found(tasks.extract(notes("- [x] Write tests #testing #a/b due: 2026-01-02 ⏫ 📅 2025-12-10 ➕ 2025-12-01 ✅ 2025-12-09")))
    assert task["content"] == "Write tests #testing #a/b"
    assert task["tags"] == ["testing", "a"]
    assert (task["priority"], task["due_date"], task["created_date"], task["completed_date"], task["summary"]) == ("urgent", "2025-12-10", "2025-12-01", "2025-12-09", None)


@pytest.mark.parametrize("text, priority", [("a 🔼", "high"), ("a 🔽", "low"), ("a ⏬", "lowest"), ("a priority: medium", "medium"), ("a PRIORITY: high", None), ("a", None)])
def test_priority(notes, text, priority):
    assert found(tasks.extract(notes(f"- [ ] {text}")))[0]["priority"] == priority


def test_sub_items(notes):
    rows = found(tasks.extract(notes("- [ ] A\n  - [ ] B\n  * [ ] C\n\t- plain\r\n- [ ] D\n\n  - E\n  - [x] F\n")))
    assert [(r["content"], r["line_number"], r["sub_items"]) for r in rows] == [("A", 1, ["B", "[ ] C", "plain"]), ("D", 5, []), ("F", 8, [])]


def test_filters(notes):
    df = tasks.extract(notes("- [ ] one #a #b 📅 2025-01-02\n- [x] two #a ✅ 2025-02-01\n- [ ] three"))
    names = lambda **kw: [r["content"].split()[0] for r in found(tasks.filtered(df, **kw))]
    assert names(status="completed") == ["two"]
    assert names(tags=["a", "b"]) == ["one"]
    assert names(exclude_tags=["b"]) == ["two", "three"]
    assert names(due_on="2025-01-02") == names(due_before="2025-01-03") == names(due_after="2025-01-01") == ["one"]
    assert names(due_before="2025-01-02") == names(due_after="2025-01-02") == []
    assert names(completed_after="2025-01-31", completed_before="2025-02-02") == ["two"]
    assert [r["content"].split()[0] for r in tasks.search(notes("- [ ] x", "- [ ] y"), limit=1).collect()] == ["x"]
