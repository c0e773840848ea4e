import random
import re

from vaultspark.operators import outline


def model(content):
    """A plain reading of headings outside fences."""
    out, fence = [], ""
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for n, line in enumerate(lines, start=1):
        line = line.removesuffix("\r")
        m = re.match(r"\s*(```|~~~)", line)
        if m:
            fence = "" if fence == m[1] else fence or m[1]
        elif not fence and (h := re.match(r"^(#{1,6})\s+(.+?)(?:\s*\{#[^}]*\})?\s*$", line)):
            out.append((len(h[1]), h[2], n))
    return out


def show(df):
    return [(r["level"], r["title"], r["line_number"]) for r in df.orderBy("path", "seq").collect()]


def test_fences(notes):
    assert [x[1] for x in show(outline.headings(notes("# One\n```\n# Fake\n```\n## Two\n")))] == ["One", "Two"]
    assert [x[1] for x in show(outline.headings(notes("# One\n```\n~~~\n# Fake\n~~~\n```\n## Two {#id}  ")))] == ["One", "Two"]
    assert [x[1] for x in show(outline.headings(notes("# One\n~~~\n# Fake\n", "#no\n #no\n####### no\n# \n")))] == ["One"]


def test_random_notes_agree_with_a_plain_model(notes):
    random.seed(4)
    made = ["".join(random.choice(["# a", "## b c {#x}", "```", "~~~", "### d\r", "text", "", "  ```rust", "# ", "#e", "###### f"]) + "\n" for _ in range(random.randint(0, 14))) for _ in range(120)]
    made = [m[:-1] if i % 3 == 0 else m for i, m in enumerate(made)]
    got = {r["path"]: [] for r in notes(*made).collect()}
    for r in outline.headings(notes(*made)).orderBy("seq").collect():
        got[r["path"]].append((r["level"], r["title"], r["line_number"]))
    for i, m in enumerate(made):
        assert got[f"n{i}.md"] == model(m), m


def test_hierarchy(notes):
    rows = [r.asDict() for r in outline.headings(notes("# Title\n## Section 1\n### Subsection 1.1\n## Section 2\n")).orderBy("seq").collect()]
    assert [r["parent_line"] for r in rows] == [None, 1, 2, 1]
    (root,) = outline.tree(rows)
    assert [c["title"] for c in root["children"]] == ["Section 1", "Section 2"] and root["children"][0]["children"][0]["title"] == "Subsection 1.1"
    (root,) = outline.tree([r.asDict() for r in outline.headings(notes("# Title\n### Deep\n#### Deeper\n")).orderBy("seq").collect()])
    assert root["children"][0]["children"][0]["title"] == "Deeper"


def test_sections(notes):
    text = "pre\n# Title\nintro\n\n## Target Section\nContent here\nMore content\n### Sub\nSub content\n## Next\nend"
    get = lambda **kw: [(r["content"], r["start_line"], r["end_line"]) for r in outline.section(notes(text), "target section", **kw).collect()]
    assert get() == [("Content here\nMore content\n### Sub\nSub content", 5, 9)]
    assert get(include_subsections=False) == [("Content here\nMore content", 5, 7)]
    crlf = outline.sections(notes("# A\r\none\r\ntwo\r\n# B\r\n")).orderBy("seq").collect()
    assert [(r["title"], r["content"]) for r in crlf] == [("A", "one\r\ntwo"), ("B", "")]
    (plain,) = outline.sections(notes("just\ntext\n")).collect()
    assert (plain["level"], plain["title"], plain["content"], plain["start_line"], plain["end_line"]) == (0, "", "just\ntext", 1, 2)


def test_search(notes):
    found = outline.search(notes("# Alpha\n## alphabet\n### Beta", "# none"), "ALPHA", 1, 2)
    assert [(r["title"], r["level"]) for r in found.collect()] == [("Alpha", 1), ("alphabet", 2)]
    assert outline.search(notes("# a"), "a", limit=0).count() == 0


def test_excluded_sections(notes):
    cut = lambda text, *names: outline.without_sections(notes(text), list(names)).collect()[0]["content"]
    text = "## Intro\nIntro text.\n\n## Dataview Query\nQuery stuff.\n\n## Notes\nNotes text.\n"
    assert cut(text, "Query") == "## Intro\nIntro text.\n\n## Notes\nNotes text.\n"
    assert cut("---\na: b\n---\npre\r\n# A\r\n## q\r\nx\r\n### y\r\nz\r\n# B\r\n", "Q") == "---\na: b\n---\npre\r\n# A\r\n# B\r\n"
    assert cut("# q\nall", "q") == "" and cut("no headings q", "q") == "no headings q" and cut(text) == text


def test_spans_are_made_once_for_a_note(notes):
    for found in (outline.without_sections(notes("# a\nb"), ["a"]), outline.headings(notes("# a\nb"))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "exists(aggregate(" not in plan and "exists(transform(" not in plan


def test_headings_and_exclusion_are_line_by_line(notes):
    rng = random.Random(5)
    pieces = ["# Drop a\n", "## Drop\r\n", "# keep {#x} \r\n", "### b  \n", "####### no\n", "#no\n", "# \r\n", "#  \n", " # no\n", "```\n", "  ~~~py\n", "x ``` y\n", "text\n", "\n", "###### drop é\n", "## last"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(60)]

    def brute(text):
        raw, fence, hs = re.findall(r"[^\n]*\n|[^\n]+", text), None, []
        for n, x in enumerate(raw, 1):
            if mark := re.match(r"\s*(```|~~~)", x):
                fence = mark[1] if fence is None else None if fence == mark[1] else fence
            elif fence is None and (m := re.match(r"(#{1,6})\s+([^\n]+?)(?:\s*\{#[^}]*\})?\s*$", re.sub(r"\r?\n$", "", x))):
                hs.append((len(m[1]), m[2], n))
        gone = set()
        for i, (level, title, n) in enumerate(hs):
            if "drop" in title.lower():
                gone |= set(range(n, next((h[2] for h in hs[i + 1 :] if h[0] <= level), len(raw) + 1)))
        above = [next((p[2] for p in reversed(hs[:i]) if p[0] < h[0]), None) for i, h in enumerate(hs)]
        return [(i, *h, a) for i, (h, a) in enumerate(zip(hs, above))], "".join(x for n, x in enumerate(raw, 1) if n not in gone)

    df = notes(*texts)
    got = {}
    for r in outline.headings(df).collect():
        got.setdefault(r["path"], []).append(tuple(r)[1:])
    left = {r["path"]: r["content"] for r in outline.without_sections(df, ["DROP"]).collect()}
    for i, t in enumerate(texts):
        assert (sorted(got.get(f"n{i}.md", [])), left[f"n{i}.md"]) == brute(t), t
