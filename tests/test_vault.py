import datetime
import io
import json
import os
import threading
import urllib.error
import urllib.request
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from vaultspark.__main__ import main
from vaultspark.config import Config, SearchConfig, load, task_limit
from vaultspark.operators import daily, files
from vaultspark.operators.chunker import chunks
from vaultspark.plans import api, index
from vaultspark.plans.search import Mode, search
from vaultspark.server import PATHS, converse, serve
from vaultspark.sources.endpoint import Endpoint, unit
from vaultspark.sources.vault import Vault, excluded, from_files
from vaultspark.streaming import ingest


@pytest.fixture
def vault(spark, tmp_path):
    def write(name, text):
        p = tmp_path / "v" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode() if isinstance(text, str) else text)
        os.utime(p, (1.7e9, 1.7e9))

    write("rust.md", "---\ntags: [lang, fast]\nupdated: 2026-04-25T06:00:00+02:00\n---\n# Rust\nrust programming is about memory safety and speed in systems\n- [ ] learn rust 📅 2025-01-01\n")
    write("sub/_python.md", "---\ntags: [lang]\n---\n# Python\npython programming is slow and easy for many people to learn\n")
    write("graph.md", "# GraphQL\nqueries over graphs are typed and nested in many ways for clients\n")
    write("2025-01-20.md", "day one")
    write("2025-01-22.md", "day two")
    write("bad.md", b"\xff\xfe")
    write("Template/t.md", "- [ ] not this")
    write("image.png", "png")
    write(".vaultspark.toml", 'exclude_paths = ["Template"]\nexclude_headings = ["secret"]\n[search]\nmin_chunk_tokens = 1\nmax_results = 7\n')
    return Vault(spark, tmp_path / "v", load(tmp_path / "v", env={"HOME": str(tmp_path)}))


def test_config(tmp_path):
    home = tmp_path / "x" / "vaultspark"
    home.mkdir(parents=True)
    (home / "config.toml").write_text('exclude_paths = ["a"]\n[search]\nmax_results = 3\n')
    (tmp_path / ".vaultspark.toml").write_text('exclude_paths = ["b"]\ndaily_note_patterns = ["D/YYYY.md"]\n')
    c = load(tmp_path, env={"XDG_CONFIG_HOME": str(tmp_path / "x"), "VAULTSPARK_EXCLUDE_PATHS": "c, d", "VAULTSPARK_RRF_K": "10", "VAULTSPARK_MAX_RESULTS": "many"})
    assert c.exclude_paths == ("a", "b", "c", "d") and c.daily_note_patterns[-1] == "D/YYYY.md" and len(c.daily_note_patterns) == 3
    assert c.search.rrf_k == 10 and c.search.max_results == 3
    (tmp_path / ".vaultspark.toml").write_text("not toml [")
    assert load(tmp_path, env={"HOME": str(tmp_path)}) == Config()
    assert task_limit({"VAULTSPARK_DEFAULT_LIMIT": "7"}) == 7 and task_limit({}) == 50
    assert excluded("/vault/Templates/note.md", Config(exclude_paths=("Template",))) and excluded("/vault/sub/Template/note.md", Config(exclude_paths=("**/Template/**",)))


def test_notes(vault, spark):
    assert sorted(r["path"] for r in vault.notes().collect()) == ["2025-01-20.md", "2025-01-22.md", "graph.md", "rust.md", "sub/_python.md"]
    with pytest.raises(ValueError):
        vault.inside("../x")
    assert from_files(spark, f"file://{vault.path}").count() == 5  # without the name in `_`, with the excluded folder


def test_operations(vault):
    run = lambda name, **kw: json.loads(api.execute(vault, name, kw))
    assert [t["content"] for t in run("tasks", status="incomplete")] == ["learn rust"]
    assert run("tags") == {"tags": ["fast", "lang"]}
    assert run("list-tags", limit=1) == {"tags": [{"tag": "lang", "document_count": 2}], "total_unique_tags": 2, "truncated": True}
    assert run("search-tags", tags=["FAST"])["total_count"] == 1
    listed = run("list-files", include_sizes=True)
    assert (listed["total_files"], listed["total_dirs"]) == (7, 2) and listed["visual_tree"].splitlines()[1:3] == ["  sub/", "    _python.md (" + f"{os.path.getsize(vault.path + '/sub/_python.md')} B)"]
    read = run("read-files", file_paths=["graph.md", "none.md", "../up.md"], continue_on_error=True)
    assert (read["total_requested"], read["success_count"], read["failure_count"]) == (3, 1, 2)
    for paths in ([], ["graph.md", "none.md"]):
        with pytest.raises(ValueError):
            run("read-files", file_paths=paths)
    with pytest.raises(ValueError):
        run("section", file_path="graph.md")
    recent = run("recent-files", limit=2)["files"]
    assert recent[0]["date_source"] == "frontmatter" and recent[0]["updated_at"] == "2026-04-25T06:00:00+02:00" and recent[1]["updated_at"] == "2023-11-14T22:13:20Z"
    assert run("get-daily-note", date="2025-01-20")["content"] == "day one" and not run("get-daily-note", date="2025-01-21")["found"]
    assert [n["date"] for n in run("search-daily-notes", start_date="2025-01-20", end_date="2025-01-22")["notes"]] == ["2025-01-22", "2025-01-20"]
    assert run("outline", file_path="rust.md", hierarchical=True)["total_count"] == 1
    assert run("section", file_path="graph.md", heading="graphql")["sections"][0]["content"].startswith("queries")
    assert run("search-headings", pattern="p")["total_count"] == 2
    assert run("search", query="rust programming", mode="dense")["mode_used"] == "sparse"


def test_files_and_paths_that_are_missing_or_no_notes(vault):
    run = lambda name, **kw: json.loads(api.execute(vault, name, kw))
    assert [t["content"] for t in run("tasks", path="rust.md")] == ["learn rust"] and run("tasks", path="Template/t.md") != []
    assert run("tasks", path="image.png") == [] and run("tasks", path="sub") == []
    for name, kw in (("tasks", {"path": "none"}), ("outline", {"file_path": "none.md"}), ("outline", {"file_path": "image.png"}), ("section", {"file_path": "none.md", "heading": "x"}), ("section", {"file_path": "../up.md", "heading": "x"})):
        with pytest.raises(ValueError):
            run(name, **kw)
    assert {k: v for k, v in run("outline", file_path="sub/_python.md").items() if k != "headings"} == {"file_path": "sub/_python.md", "file_name": "_python.md", "total_count": 1}
    found = run("section", file_path="rust.md", heading="RUST")
    assert (found["file_name"], found["section_count"], found["sections"][0]["start_line"]) == ("rust.md", 1, 5)
    assert run("section", file_path="rust.md", heading="none")["sections"] == []
    assert not run("read-files", file_paths=["Template/t.md", "image.png"], continue_on_error=True)["success_count"]


def test_empty_folders_are_listed(vault):
    os.makedirs(f"{vault.path}/sub/deep/empty")
    os.makedirs(f"{vault.path}/.hidden")
    listed = api.list_files(vault)
    assert (listed["total_files"], listed["total_dirs"]) == (7, 4) and "      empty/" in listed["visual_tree"].splitlines()
    one = api.list_files(vault, max_depth=1)
    assert (one["total_files"], one["total_dirs"]) == (6, 1) and "  sub/" in one["visual_tree"].splitlines() and "deep" not in one["visual_tree"]
    assert api.list_files(vault, "sub/deep/empty") == {"visual_tree": "sub/deep/empty/", "total_files": 0, "total_dirs": 1}


def test_single_files_are_read_alone(vault, monkeypatch):
    monkeypatch.setattr(Vault, "paths", lambda *_: pytest.fail("the vault was walked"))
    assert api.get_outline(vault, "rust.md")["total_count"] == 1
    assert api.get_daily_note(vault, "2025-01-20")["found"] and len(api.search_daily_notes(vault, "2025-01-01", "2025-02-01")["notes"]) == 2
    assert api.read_files(vault, ["graph.md"])["success_count"] == 1


def test_tool_server(vault):
    asked = [{"id": 1, "method": "initialize", "params": {"protocolVersion": "x"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list_tags", "arguments": {"limit": 1}}}, {"id": 4, "method": "tools/call", "params": {"name": "read_files", "arguments": {"file_paths": ["none.md"]}}}, {"id": 5, "method": "tools/call", "params": {"name": "no"}}, {"id": 6, "method": "no"}, {"id": 7, "method": "ping"}]
    out = io.StringIO()
    converse(vault, [*(json.dumps({"jsonrpc": "2.0", **x}) + "\n" for x in asked), "\n", "{no\n"], out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None} and got[1]["result"]["protocolVersion"] == "x"
    listed = {t["name"]: t for t in got[2]["result"]["tools"]}
    assert len(listed) == 11 and listed["get_daily_note"]["inputSchema"]["required"] == ["date"]
    assert json.loads(got[3]["result"]["content"][0]["text"])["tags"][0]["tag"] == "lang" and got[4]["result"]["isError"] and "none.md" in got[4]["result"]["content"][0]["text"]
    assert (got[5]["error"]["code"], got[6]["error"]["code"], got[None]["error"]["code"]) == (-32602, -32601, -32700)


def test_prime_names_every_operation(capsys):
    assert main(["prime"]) == 0
    text = capsys.readouterr().out
    assert all(f"## {name}\n" in text for name in api.OPERATIONS) and "`--exclude-tags` (comma-separated list)" in text


def test_old_versions_of_the_index_go(vault):
    own = api._index(vault)
    for k in range(4):
        with open(f"{vault.path}/more.md", "w") as f:
            f.write(f"a note that has changed {k} times since it was written down for the first time")
        own.build(vault.notes())
    versions = lambda: [x for x in os.listdir(own.base.removeprefix("file://")) if x.startswith("v=")]
    assert len(versions()) == 2 and f"v={own.version()}" in versions()
    assert len([x for x in os.listdir(own.base.removeprefix("file://") + "/current") if x.startswith("part-")]) == 2
    own.build(vault.notes(), reindex=True)
    assert versions() == [f"v={own.version()}"] and own.table("chunks").count() > 0


def test_rows_of_one_path_are_chunked_each(notes):
    two = notes(("a.md", "# A\n" + "one two three " * 20), ("a.md", "# B\n" + "four five six " * 20), ("b.md", None))
    assert sorted((r["source_file"], r["heading"], r["text"][:3]) for r in chunks(two).collect()) == [("a.md", "A", "one"), ("a.md", "B", "fou")]
    nameless = chunks(two.limit(1).withColumn("path", F.lit(None).cast("string"))).collect()
    assert [(r["id"], r["source_file"], r["heading"]) for r in nameless] == [(None, None, "A")]


def test_daily_notes_lack_excluded_sections(vault):
    with open(f"{vault.path}/2025-01-22.md", "w") as f:
        f.write("day two\n# A Secret\nhidden\n## Below\nhidden\n# Open\nshown\n")
    want = "day two\n# Open\nshown\n"
    assert api.read_files(vault, ["2025-01-22.md"])["files"][0]["content"] == want
    assert api.get_daily_note(vault, "2025-01-22")["content"] == want
    assert [n["content"] for n in api.search_daily_notes(vault, "2025-01-20", "2025-01-22", include_content=True)["notes"]] == [want, "day one"]


def test_days():
    assert daily.bounds(None, None, datetime.date(2025, 3, 1)) == ("2025-01-31", "2025-03-01")
    for a, b in (("2025-01-02", "2025-01-01"), ("2024-01-01", "2025-01-01"), ("2024-1-1", "2024-01-02"), ("2025-02-30", None)):
        with pytest.raises(ValueError):
            daily.bounds(a, b)


def test_ambiguous_day(notes):
    both = notes(("2025-01-01.md", "a"), ("0. PeriodicNotes/2025/Daily/01/2025-01-01.md", "b"), ("2025-01-02.md", "c"))
    assert [r["date"] for r in daily.search(both, "2025-01-01", "2025-01-03").collect()] == ["2025-01-02"]


def test_index(vault, spark, tmp_path):
    embed = lambda texts: [[float("rust" in t), float("python" in t), 0.1] for t in texts]
    own = index.Index(spark, f"file://{tmp_path}/idx", index.ChunkConfig(min_chunk_size=1), "m", 3)
    first = own.build(vault.notes(), embed)
    assert (first.status, first.added, first.has_embeddings) == ("FullRebuild", 5, True)
    assert own.build(vault.notes(), embed).status == "UpToDate"
    (tmp_path / "v" / "graph.md").write_text("# GraphQL\nnow about Rust and other things that are new to us here\n")
    os.remove(tmp_path / "v" / "2025-01-22.md")
    next_ = own.build(vault.notes(), embed)
    assert (next_.status, next_.added, next_.modified, next_.removed, next_.chunks) == ("Stale", 0, 1, 1, first.chunks - 1)
    for mode in Mode:
        out = search(own, "rust memory", mode, 3, embed=embed)
        assert out.mode_used is mode and out.results.first()["source_file"] == "rust.md"
    assert search(own, "rust", Mode.HYBRID).mode_used is Mode.SPARSE
    assert search(own, "rust", Mode.SPARSE, recency=0.5, mtimes=vault.notes()).results.count() == 2
    assert search(own, "programming", Mode.SPARSE, tags=["FAST"]).results.count() == 1
    assert index.Index(spark, own.base, index.ChunkConfig(), "other", 3).build(vault.notes(), lambda t: 1 / 0).status == "FullRebuild"
    own.clear()
    assert own.version() is None


@pytest.fixture
def endpoint():
    """An embeddings endpoint; `up` turns it off, `asked` holds what it got."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            server.asked.append((self.path, self.headers["Authorization"], got["model"], got["input"]))
            rows = [{"index": i, "embedding": [3.0 * ("rust" in t.lower()), 4.0, 9.0]} for i, t in enumerate(got["input"])]
            body = json.dumps({"data": rows[::-1]}).encode()
            self.send_response(200 if server.up else 503)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.up, server.asked = True, []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_endpoint(endpoint):
    own = Endpoint(f"http://127.0.0.1:{endpoint.server_port}/v1/", "m", 2, "secret")
    assert own(["rust", "x"]) == [pytest.approx([0.6, 0.8]), [0.0, 1.0]] and own([]) == []
    assert endpoint.asked == [("/v1/embeddings", "Bearer secret", "m", ["rust", "x"])]
    assert unit([0.0, 0.0], 5) == [0.0, 0.0]
    endpoint.up = False
    with pytest.raises(OSError):
        own(["rust"])
    assert Endpoint.of(SearchConfig()) is None


def test_vectors_come_later(spark, vault, endpoint):
    """What was indexed while the endpoint was down gets its vectors in the next build that changes something."""
    base = f"http://127.0.0.1:{endpoint.server_port}"
    vault.config = replace(vault.config, search=replace(vault.config.search, embedding_api_base=base, embedding_dim=2, merge_threshold=0))
    endpoint.up = False
    assert not api.index(vault)["has_embeddings"]
    endpoint.up = True
    assert api.search_notes(vault, "rust", mode="dense")["mode_used"] == "sparse"
    with open(vault.path + "/new.md", "w") as f:
        f.write("# New\n## Below\nwords about something else entirely\n")
    assert api.index(vault)["has_embeddings"]
    found = api.search_notes(vault, "rust", mode="dense", no_reindex=True, limit=1)
    assert found["mode_used"] == "dense" and found["results"][0]["source_file"] == "rust.md"
    sent = [t for *_, texts in endpoint.asked for t in texts]
    assert any(t.startswith("passage: rust\n") for t in sent) and any(t.startswith("passage: New\nwords") for t in sent) and "query: rust" in sent
    os.remove(vault.path + "/new.md")
    endpoint.up = False  # nothing to embed, so nothing to fail
    assert api.index(vault)["has_embeddings"]


def test_command_line_and_server(spark, vault, capsys):
    assert main(["tags", vault.path], spark) == 0 and json.loads(capsys.readouterr().out) == {"tags": ["fast", "lang"]}
    assert main(["section", vault.path, "graph.md", "graphql", "--no-include-subsections"], spark) == 0
    assert json.loads(capsys.readouterr().out)["sections"][0]["content"].startswith("queries")
    assert main(["read-files", vault.path, "--file-paths", "none.md"], spark) == 1 and capsys.readouterr().err
    assert main(["list-files", vault.path, "--max-depth", "1"], spark) == 0 and "  sub/" in capsys.readouterr().out.splitlines()
    server = serve(vault, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda path, body=None: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", body))
    assert ask("/api/tags/list?limit=1")["truncated"] is True
    assert ask("/api/tasks", b'{"status": "incomplete", "limit": null, "path": null}')[0]["content"] == "learn rust"
    assert len(ask("/tools")["tools"]) == 14 and set(PATHS.values()) == set(api.OPERATIONS)
    for path, status in (("/api/outline", 500), ("/none", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path)
        assert e.value.code == status
    server.shutdown()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("- [ ] one #x\n# H\n")
    run = lambda: ingest.drain(ingest.task_stream(ingest.note_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.md").write_text("- [x] two\n")
    run()
    assert sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one #x", "two"]
    counts = ingest.tag_counts(ingest.note_stream(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("tags").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["tag"], r["n"]) for r in spark.table("tags").collect()] == [("x", 1)]


def test_tree(spark):
    rows = files.tree_rows(spark.createDataFrame([("b.md", 1), ("a/z.md", 2000), (".x/y.md", 3), ("a/b/c.md", 4)], "path string, size long"))
    assert files.render(rows, "r", True).splitlines() == ["r/", "  a/", "    b/", "      c.md (4 B)", "    z.md (2.0 KB)", "  b.md (1 B)"]
    assert files.tree_rows(spark.createDataFrame([("a/b/c.md", 4)], "path string, size long"), max_depth=1).count() == 1
