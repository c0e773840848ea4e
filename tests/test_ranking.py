import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vaultspark.functions import text
from vaultspark.operators import bm25, chunker, fusion, vectors


def test_tokens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.bm25_tokens(F.lit("Hello, World! Hello. snake_case a　b"))) == ["hello", "world", "hello", "snake", "case", "a", "b"]
    assert len(one(text.budget_tokens(F.lit("a" * 1000)))) == math.ceil(1000 / 32)
    got = one(text.windows(text.budget_tokens(F.lit("a b c d e f g")), 4, 2))
    assert [(w["start"], w["stop"], w["text"]) for w in got] == [(0, 4, "a b c d"), (2, 6, "c d e f"), (4, 7, "e f g")]
    assert [w["text"] for w in one(text.windows(text.budget_tokens(F.lit(" ")), 4, 2))] == [""]
    assert one(text.preview(F.lit(" é" * 150))) == (" é" * 100).strip()
    sizes = [one(text.format_size(F.lit(n))) for n in (0, 1023, 1024, 1536, 1 << 20, 5 << 30, 3 << 40)]
    assert sizes == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "3.0 TB"]
    assert one(text.low_semantic_value(F.lit("x" * 100))) and not one(text.low_semantic_value(F.lit("a few words"))) and one(text.low_semantic_value(F.lit("")))


def test_sizes_round_ties_to_even(spark):
    sizes = [0, 1279, 1280, 1281, 1792, 3328, 1048524, 1048525, 1048575, 13 << 18, (13 << 18) + 1, 13 << 28, 15 << 28, 1024**4 - 1, 5 << 38, 7 << 38, 2**53 - 1]

    def want(n):
        size, unit = float(n), 0
        while size >= 1024 and unit < 4:
            size, unit = size / 1024, unit + 1
        return f"{size:.1f} {['B', 'KB', 'MB', 'GB', 'TB'][unit]}" if unit else f"{n} B"

    df = spark.createDataFrame([(n,) for n in [*sizes, *range(1024, 9000, 64), None]], "n long")
    got = {r["n"]: r["s"] for r in df.select("n", text.format_size("n").alias("s")).collect()}
    assert got.pop(None) is None
    assert got == {n: want(n) for n in got} and got[3328] == "3.2 KB"


def brute(docs, query):
    split = lambda t: [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if x]
    toks = {k: split(t or "") for k, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for k, t in toks.items():
        tf = Counter(t)
        hits = [w for w in split(query) if tf[w]]
        if hits:
            out[k] = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in hits)
    return out


@pytest.mark.parametrize("query", ["rust memory", "rust rust", "none", "", "Memory, safe!"])
def test_bm25(spark, query):
    docs = [(0, "rust is fast"), (1, "python is slow"), (2, "rust has memory safety, memory!"), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, query)
    for found in (bm25.scores(df, query), bm25.scores_from_index(bm25.postings(df), bm25.corpus_stats(df), query)):
        got = {r["doc_id"]: r["score"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.cosine_top_k(df, [1.0, 0.0, 0.0], 5).collect()] == [(0, 1.0), (1, 0.0)]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(vectors.normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(vectors.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_rrf(spark):
    dense = spark.createDataFrame([(0, 0.9), (1, 0.5)], "k long, score double")
    sparse = spark.createDataFrame([(0, 3.0), (2, 1.0)], "k long, score double")
    got = {r["k"]: r["score"] for r in fusion.rrf([(fusion.ranked(dense, "k"), 1), (fusion.ranked(sparse, "k"), 1)], "k").collect()}
    assert got == pytest.approx({0: 2 / 61, 1: 1 / 62, 2: 1 / 62})


def test_fused_top_is_what_fusing_all_ranks_gives(spark):
    sparse = spark.range(300).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 7.0).alias("score"))
    dense = spark.range(40).select((F.col("id") * 9 % 331).alias("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(20)).cast("double").alias("score"))
    every = fusion.rrf([(fusion.ranked(dense, "k"), 2.0), (fusion.ranked(sparse, "k"), 1.0)], "k")
    want = [(r["k"], round(r["score"], 12)) for r in every.orderBy(F.desc("score"), "k").limit(15).collect()]
    got = [(r["k"], round(r["score"], 12)) for r in fusion.fused_top(dense, sparse, "k", 15, dense_weight=2.0).collect()]
    assert got == want


def test_recency(spark):
    fused = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "k long, score double")
    dates = spark.createDataFrame([(0, 1700000000), (1, 1800000000)], "k long, date long")
    assert {r["k"]: r["score"] for r in fusion.recency_boost(fused, dates, "k", 0.5).collect()} == {0: 1.0, 1: 1.5, 2: 1.0}
    same = spark.createDataFrame([(0, 5), (1, 5)], "k long, date long")
    assert {r["score"] for r in fusion.recency_boost(fused.where("k < 2"), same, "k", 0.5).collect()} == {1.25}


def test_chunks(notes):
    config = chunker.ChunkConfig(min_chunk_size=1, merge_threshold=0)
    rows = chunker.chunks(notes("# Main Title\nm\n## Chapter 1\nc\n### Section 1.1\ns\n## Chapter 2\nd"), config).orderBy("seq").collect()
    assert [(r["heading"], r["heading_path"]) for r in rows] == [("Main Title", []), ("Chapter 1", ["Main Title"]), ("Section 1.1", ["Main Title", "Chapter 1"]), ("Chapter 2", ["Main Title"])]
    assert rows[2]["id"] == "n0.md:5:Chapter 1" and rows[2]["text"] == "s" and (rows[2]["line_start"], rows[2]["line_end"]) == (5, 5)
    rows = chunker.chunks(notes("# Alpha\na\n## Beta\nb\n# Charlie\nc"), config).orderBy("seq").collect()
    assert [r["heading_path"] for r in rows] == [[], ["Alpha"], []]
    (merged,) = chunker.chunks(notes("# A\ntiny\n# B\nalso tiny"), chunker.ChunkConfig(min_chunk_size=1, merge_threshold=5)).collect()
    assert merged["text"] == "tiny\n\nalso tiny" and merged["id"].endswith(":merged")
    assert chunker.chunks(notes("# A\n" + "x" * 5000), chunker.ChunkConfig(min_chunk_size=1)).count() == 0  # data, no prose
    long = chunker.chunks(notes("# A\n" + " ".join(f"w{i}" for i in range(25))), chunker.ChunkConfig(10, 4, 1, 0)).orderBy("seq").collect()
    assert [r["text"].split()[0] for r in long] == ["w0", "w6", "w12", "w18"]
    plain = chunker.chunks(notes("---\ntags: [t]\ndate: 2020-01-01\n---\n" + "word " * 8), chunker.ChunkConfig(5, 0, 1, 0)).orderBy("seq").collect()
    assert all(r["tags"] == ["t"] and r["date"] == 1577836800 and r["heading"] is None for r in plain)


@pytest.mark.parametrize("n", [0, 1, 5, 9000])
def test_ranks_of_all(spark, n):
    """Ranks by bands are those of the whole order; half of the rows share a score."""
    scored = spark.range(n, numPartitions=4).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(50)) / 10.0).alias("score"))
    want = {r["k"]: i for i, r in enumerate(sorted(scored.collect(), key=lambda r: (-r["score"], r["k"])), start=1)}
    ranks = fusion.ranked(scored, "k")
    assert {r["k"]: r["rank"] for r in ranks.collect()} == want and ranks.count() == n


def test_postings_are_counted_in_their_rows(spark):
    df = spark.createDataFrame([(0, "b a b. B"), (1, None), (2, "a"), (3, " ,"), (4, "")], "doc_id long, text string")
    found = bm25.postings(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0, 1, 4), ("a", 2, 1, 1), ("b", 0, 3, 4)]


def test_postings_of_repeated_keys_count_together(spark, tmp_path):
    docs = [(0, "b a b"), (0, "a b a"), (0, "b"), (1, "b"), (None, "c c"), (None, "c d"), (2, None)]
    for case, rows in enumerate((docs, docs[1:2] + docs[3:5], docs[6:], [])):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = Counter((w, k, len(t.split())) for k, t in rows if t for w in t.split())
        bm25.write_index(df, str(tmp_path / str(case)))
        written = spark.read.parquet(str(tmp_path / str(case) / "postings"))
        for found in (bm25.postings(df), written):
            got = [tuple(r) for r in found.select("term", "doc_id", "dl", "tf").collect()]
            assert len(got) == len(want) and {x[:3]: x[3] for x in got} == dict(want)
        stats = spark.read.parquet(str(tmp_path / str(case) / "stats"))
        assert stats.dtypes == bm25.corpus_stats(df).dtypes and stats.collect() == bm25.corpus_stats(df).collect()


def test_written_index_shuffles_texts_and_no_postings(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(i, f"{words} own{i}") for i in range(40)], "doc_id long, text string").repartition(4)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def shuffled():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    bm25.write_index(df, str(tmp_path / "index"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(n for k, n in shuffled().items() if k not in before) < 40 * 10
    rows = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert rows.count() == 40 * 301
    files = {}
    for r in rows.select("term", F.input_file_name().alias("f")).collect():
        files.setdefault(r["f"], []).append(r["term"])
    assert all(x == sorted(x) for x in files.values())


def test_scores_round_as_in_sql(spark):
    from vaultspark.plans.queries import _rounded

    asked = [4.095364499985587, 4.0953645, 2.5, 1e-7, 0.0]
    df = spark.createDataFrame([(x,) for x in asked], "x double")
    got = [r[0] for r in df.select(_rounded(_rounded(F.col("x"), 9), 6)).collect()]
    duckdb = pytest.importorskip("duckdb")
    assert got == [duckdb.execute("SELECT round(round(?::DOUBLE, 9), 6)", [x]).fetchone()[0] for x in asked]


def test_chunker_gives_chunks_out_by_the_megabyte():
    import pyarrow as pa

    words = "some words of a note\nand more " * 10_000
    sections = [{"seq": 0, "level": 1, "title": "t", "content": words, "start_line": 1, "end_line": 10_001}]
    rows = [{"path": f"{i}.md", "content": None if i % 2 else words, "tags": ["x"], "date": None, "sections": sections if i % 2 else None} for i in range(40)]
    made = list(chunker.chunked(iter([pa.RecordBatch.from_pylist(rows)]), chunker.ChunkConfig()))
    assert len(made) >= 10 and max(b.nbytes for b in made) < 2 * chunker.OUT_SIZE
    got = [r for b in made for r in b.to_pylist()]
    assert [r["seq"] for r in got if r["source_file"] == "3.md"] == list(range(sum(r["source_file"] == "3.md" for r in got)))
    one = [r for r in got if r["source_file"] == "2.md"]
    assert " ".join(r["text"] for r in one) == " ".join(words.split())
    assert [(r["line_start"], r["line_end"]) for r in one[:2]] == [(0, 512 // 7), (512 // 7, 1024 // 7)]


def test_chunker_is_sent_a_note_once(spark, notes):
    plain, headed = "just words " * 50, "intro\n# a\nfirst body\n## b\nsecond body\n"
    df = notes(plain, headed)
    found = chunker.chunks(df, chunker.ChunkConfig(min_chunk_size=1, merge_threshold=0))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "THEN content" in plan and "THEN sections" in plan
    assert [(r["source_file"], r["heading"], r["line_start"]) for r in found.orderBy("source_file", "seq").collect()] == [("n0.md", None, 0), ("n1.md", "a", 2), ("n1.md", "b", 4)]
