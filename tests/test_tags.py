from vaultspark.functions import dates
from vaultspark.operators import tags


def front(*names):
    return "---\ntags:\n" + "".join(f"  - {n}\n" for n in names) + "---\nbody"


def test_yaml(notes):
    rows = {r["path"]: r["tags"] for r in tags.extract(notes(front("rust", "programming"), "---\ntags: one\n---\n", "---\ntags: [a, 1, ' ', b]\n---", "no", "---\ntags: [open]\n", "---\ntags: [a\n---\n", "---\nx: 1\n---\n", None)).collect()}
    assert rows == {"n0.md": ["rust", "programming"], "n1.md": ["one"], "n2.md": ["a", "b"], "n3.md": [], "n4.md": [], "n6.md": [], "n7.md": []}


def test_counts(notes):
    df = tags.extract(notes(front("rust", "programming"), front("rust", "cli"), front("dup", "dup")))
    assert [tuple(r) for r in tags.counts(df).collect()] == [("rust", 2), ("cli", 1), ("dup", 1), ("programming", 1)]
    assert [tuple(r) for r in tags.counts(df, min_count=2).collect()] == [("rust", 2)]
    assert [r["tag"] for r in tags.distinct(df).collect()] == ["cli", "dup", "programming", "rust"]


def test_search(notes):
    df = tags.extract(notes(front("Rust", "cli"), front("python"), "untagged"))
    show = lambda *a: [(r["path"], r["matched_tags"], r["all_tags"]) for r in tags.search(df, *a).collect()]
    assert show(["CLI", "rust", "no"]) == [("n0.md", ["cli", "rust"], ["Rust", "cli"])]
    assert show(["rust", "python"], True) == []
    assert show(["rust", "cli"], True) == [("n0.md", ["rust", "cli"], ["Rust", "cli"])]
    assert [x[0] for x in show([], True)] == ["n0.md", "n1.md"]


def test_line_tags(notes):
    rows = notes("---\ntags: [a, \"b\"]\n---", "---\ntags: a, b\n---", "---\ntags: 'one'\n---", front("x"), "none").select(tags.line_tags("content").alias("t")).collect()
    assert [r["t"] for r in rows] == [["a", "b"], ["a", "b"], ["one"], [], []]


def test_dates(spark, notes):
    iso = ["2026-04-24T23:45:37-05:00", "2026-04-25T04:45:37Z", "2026-04-25T06:45:37+02:00", "2026-04-25T04:45:37", "2026-13-25T04:45:37Z", "no", "2026-04-25"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in iso], "s string").select(dates.iso_seconds("s")).collect()]
    assert got == [1777092337] * 4 + [None] * 3
    days = ["2024-02-29", "2023-02-29", "2024-2-9", "2024-00-10", "20240229", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in days], "s string").select(dates.valid_date("s")).collect()] == [True] + [False] * 5
    heads = ["---\ndate: 2020-01-01\ncreated: 2021-01-01\nupdated: 2022-01-01\n---", "---\ndate: 2020-01-01\ncreated: x\n---", "---\nupdated: 2022-01-01T00:00:00\n---", "---\ndate: 2025-02-30\n---", "x"]
    got = [r[0] for r in notes(*heads).select(dates.frontmatter_date("content")).collect()]
    assert got == [1640995200, 1577836800, None, None, None]
    assert [r[0] for r in notes('---\nupdated: "2026-01-01"\n---', "---\n updated: x\n---", "---\nupdated:\nupdated: 'y'\n").select(dates.updated_field("content")).collect()] == ["2026-01-01", None, "y"]
