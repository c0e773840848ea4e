"""The registered queries: each operator over its whole driver table, and the same in DuckDB SQL.

Tables without Markdown get it in the query: the same lines are built on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import bm25, chunker, daily, files, fusion, outline, tags, tasks, vectors
from ..sources.tables import spread
from ..sources.vault import from_documents
from . import index, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# --- ranking --------------------------------------------------------------------------------

ASKED = "tion the ment tion"
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s!-/:-@\[-`{-~]+'), lambda x: x <> '')"
_BM25 = rf"""
d AS (SELECT doc_id, {_TOKENS} AS tok FROM documents),
s AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM d),
q AS (SELECT unnest(['tion', 'the', 'ment', 'tion']) AS term),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p JOIN q USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY doc_id)"""


def _sparse(docs: DataFrame) -> DataFrame:
    """Rounded, so that both engines give equal scores the same order."""
    return bm25.scores(docs, ASKED).select("doc_id", F.round("score", 9).alias("score"))


def _rounded(score: Column, places: int) -> Column:
    """Of the double times a power of ten, as DuckDB rounds; Spark's rounds the decimal digits, so 4.0953645 gives 4.095365 and not 4.095364."""
    return F.round(score * 10.0**places) / 10.0**places


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 10)")
def bm25_topk(spark, sf_dir):
    top = _sparse(_table(spark, sf_dir, "documents")).orderBy(F.desc("score"), "doc_id").limit(10)
    return top.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_all_scores(spark, sf_dir):
    return _sparse(_table(spark, sf_dir, "documents")).select("doc_id", F.round("score", 6).alias("score"))


_WRITTEN: dict[tuple[str, str], str] = {}


def _persisted(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings in order of their terms, and the corpus' sums, of the documents: written once for a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        at = f"{spark.conf.get('spark.sql.warehouse.dir')}/postings-{uuid.uuid4().hex}"
        bm25.write_index(_table(spark, sf_dir, "documents"), at)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _WRITTEN[key] = at
    return tuple(spark.read.parquet(f"{_WRITTEN[key]}/{x}") for x in ("postings", "stats"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_from_postings(spark, sf_dir):
    """From the written index: its scan reads what holds a term of the query in each file."""
    return bm25.scores_from_index(*_persisted(spark, sf_dir), ASKED).select("doc_id", _rounded(_rounded(F.col("score"), 9), 6).alias("score"))


@query(rf"SELECT term, doc_id, count(*) AS tf, dl FROM (SELECT doc_id, CAST(len(tok) AS BIGINT) AS dl, unnest(tok) AS term FROM (SELECT doc_id, {_TOKENS} AS tok FROM documents)) GROUP BY ALL")
def index_postings(spark, sf_dir):
    return bm25.postings(_table(spark, sf_dir, "documents"))


@query(rf"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def term_frequencies(spark, sf_dir):
    return bm25.term_frequencies(bm25.postings(_table(spark, sf_dir, "documents")))


PROBE = 7
_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _dense(spark, sf_dir, k: int) -> DataFrame:
    every = _table(spark, sf_dir, "embeddings")
    probe = every.where(F.col("vec_id") == PROBE).select("embedding").first()["embedding"]
    scored = every.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.lit([float(x) for x in probe])), 9).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def _dense_sql(k: int) -> str:
    return f"c AS (SELECT e.vec_id, round({_DOT}, 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) q ORDER BY score DESC, e.vec_id LIMIT {k})"


@query(f"WITH {_dense_sql(10)} SELECT vec_id, round(score, 6) AS score FROM c")
def cosine_topk(spark, sf_dir):
    every = _table(spark, sf_dir, "embeddings")
    probe = every.where(F.col("vec_id") == PROBE).select("embedding").first()["embedding"]
    return vectors.cosine_top_k(every, probe, 10).select("vec_id", F.round("score", 6).alias("score"))


_HYBRID = f"""{_BM25}, {_dense_sql(40)},
r AS (SELECT vec_id AS doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS score FROM c
      UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM b),
h AS (SELECT doc_id, sum(score) AS score FROM r GROUP BY doc_id)"""


@query(f"WITH {_HYBRID} SELECT doc_id, round(score, 9) AS score FROM (SELECT * FROM h ORDER BY round(score, 12) DESC, doc_id LIMIT 20)")
def rrf_hybrid(spark, sf_dir):
    dense = _dense(spark, sf_dir, 40).withColumnRenamed("vec_id", "doc_id")
    sparse = _sparse(_table(spark, sf_dir, "documents"))
    return fusion.fused_top(dense, sparse, "doc_id", 20).select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 9) AS score FROM b ORDER BY score DESC LIMIT 50")
def rrf_sparse_only(spark, sf_dir):
    sparse = _sparse(_table(spark, sf_dir, "documents"))
    return fusion.rrf([(fusion.ranked(sparse, "doc_id", 50), 1.0)], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_dense_sql(50)} SELECT vec_id, round(2.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)), 9) AS score FROM c")
def rrf_dense_only(spark, sf_dir):
    return fusion.rrf([(fusion.ranked(_dense(spark, sf_dir, 50), "vec_id", 50), 2.0)], "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query(f"""WITH {_BM25}, r AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS score FROM b),
m AS (SELECT min(1600000000 + doc_id % 997 * 86400) AS lo, max(1600000000 + doc_id % 997 * 86400) AS hi FROM r)
SELECT doc_id, round(score * (1 + 0.5 * CASE WHEN hi - lo < 1 THEN 0.5 ELSE (1600000000 + doc_id % 997 * 86400 - lo) / (hi - lo) END), 9) AS score FROM r, m""")
def recency_boost(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    fused = fusion.rrf([(fusion.ranked(_sparse(docs), "doc_id"), 1.0)], "doc_id")
    when = docs.select("doc_id", (F.lit(1600000000) + F.col("doc_id") % 997 * 86400).alias("date"))
    return fusion.recency_boost(fused, when, "doc_id", 0.5).select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_BM25}, t AS (SELECT doc_id FROM b ORDER BY score DESC, doc_id LIMIT 50) SELECT doc_id, lang, source FROM t JOIN documents USING (doc_id) WHERE lower(lang) = 'en' AND lower(source) <> 'src0'")
def search_tag_postfilter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    best = _sparse(docs).orderBy(F.desc("score"), "doc_id").limit(50)
    return docs.select("doc_id", "lang", "source").join(F.broadcast(best.select("doc_id")), "doc_id").where((F.lower("lang") == "en") & (F.lower("source") != "src0"))


@query("""SELECT vec_id, round(list_sum(list_transform(n, lambda x: x * x)), 6) AS length, round(n[1], 6) AS first, CAST(len(n) AS INTEGER) AS dim FROM (
SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS n FROM (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings))""")
def vector_truncate_normalize(spark, sf_dir):
    v = vectors.normalize(vectors.truncate(F.col("embedding"), 32))
    return _table(spark, sf_dir, "embeddings").select("vec_id", v.alias("n")).select("vec_id", F.round(vectors.dot(F.col("n"), F.col("n")), 6).alias("length"), F.round(F.get("n", F.lit(0)), 6).alias("first"), F.size("n").alias("dim"))


# --- texts ----------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(CASE WHEN strlen(text) <= 200 THEN text ELSE substr(text, 1, 200) END, '^\s+|\s+$', '', 'g') AS preview FROM documents")
def preview(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"))


_BUDGET = r"flatten(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), lambda w: regexp_extract_all(w, '.{1,32}')))"


def _windows_sql(most: int, overlap: int) -> str:
    return f"""WITH t AS (SELECT doc_id, {_BUDGET} AS tok FROM documents), w AS (SELECT doc_id, tok, unnest(range(0, greatest(0, len(tok) - {overlap} - 1) + 1, {most - overlap})) AS start FROM t)
SELECT doc_id, CAST(start // {most - overlap} AS INTEGER) AS part, CAST(start AS INTEGER) AS start, CAST(least(start + {most}, len(tok)) AS INTEGER) AS stop, array_to_string(tok[start + 1:start + {most}], ' ') AS text FROM w"""


@query(_windows_sql(128, 0))
def chunk_fixed(spark, sf_dir):
    return chunker.windowed(_table(spark, sf_dir, "documents"), 128)


@query(_windows_sql(128, 32))
def chunk_overlap(spark, sf_dir):
    return chunker.windowed(_table(spark, sf_dir, "documents"), 128, 32)


@query(f"SELECT count(*) AS chunks, max(n) AS max_tokens, max(bytes) AS max_bytes FROM (SELECT stop - start AS n, CAST(strlen(text) AS INTEGER) AS bytes FROM ({_windows_sql(128, 32)}))")
def chunk_stats(spark, sf_dir):
    made = chunker.windowed(_table(spark, sf_dir, "documents"), 128, 32)
    return made.agg(F.count("*").alias("chunks"), F.max(F.col("stop") - F.col("start")).alias("max_tokens"), F.max(F.octet_length("text")).alias("max_bytes"))


@query(r"SELECT page_id, coalesce(len(list_filter(regexp_split_to_array(html, '\s+'), lambda x: x <> '')) / strlen(html) < 0.03, TRUE) AS low_value FROM pages")
def low_semantic_filter(spark, sf_dir):
    return chunker.low_value(_table(spark, sf_dir, "pages"), "page_id", "html")


# A note of a part: frontmatter (lines 1 to 4), a heading with a paragraph (5, 6), a heading with two words (7, 8), one with the
# rest (9, 10), and one too short to be a chunk, as no section follows that it could be merged with (11, 12).
_LONG = "rtrim(repeat(p_name || ' ', 1 + p_size % 23))"
_REST = "rtrim(repeat(p_type || ' ', 1 + p_size % 11))"
_PART_CHUNKS = f"""WITH s AS (SELECT p_partkey, p_name, p_brand, {_LONG} AS a, {_REST} AS b FROM part),
m AS (SELECT *, a || chr(10) || '## tiny' || chr(10) || 'one two' || chr(10) || '## rest' || chr(10) || b || chr(10) || '## end' || chr(10) || 'too short' AS first,
 'one two' || chr(10) || chr(10) || b AS second FROM s),
t AS (SELECT p_partkey, p_name, p_brand, 1 AS k, p_name AS heading, first AS body FROM m UNION ALL SELECT p_partkey, p_name, p_brand, 2, 'tiny', second FROM m),
g AS (SELECT *, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS tok FROM t),
w AS (SELECT *, unnest(CASE WHEN len(tok) > 40 THEN range(0, greatest(0, len(tok) - 8 - 1) + 1, 32) ELSE [0] END) AS start FROM g),
c AS (SELECT *, start // 32 AS j, CASE WHEN len(tok) > 40 THEN array_to_string(tok[start + 1:start + 40], ' ') ELSE body END AS text FROM w)"""


def _part_notes(spark, sf_dir) -> DataFrame:
    body = f"""concat('---\ntags: [', p_brand, ', part]\ncreated: 2001-02-03\n---\n# ', p_name, '\n', {_LONG}, '\n## tiny\none two\n## rest\n', {_REST}, '\n## end\ntoo short\n')"""
    return _table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.expr(body).alias("content"))


def _part_chunks(spark, sf_dir) -> DataFrame:
    return chunker.chunks(_part_notes(spark, sf_dir), chunker.ChunkConfig(max_tokens=40, overlap_tokens=8, min_chunk_size=4, merge_threshold=3))


@query(f"""{_PART_CHUNKS} SELECT p_partkey || '.md:' || (CASE k WHEN 1 THEN 5 ELSE 7 END + j) || ':' || CASE k WHEN 1 THEN 'section' ELSE p_name END AS id, p_partkey || '.md' AS source_file,
CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k, j) - 1 AS INTEGER) AS seq, heading, CASE k WHEN 2 THEN p_name ELSE '' END AS trail, lower(p_brand) || ',part' AS tags, CAST(981158400 AS BIGINT) AS date, text FROM c""")
def chunk_sections(spark, sf_dir):
    """Sections merged, cut in overlapping windows, and left out, with their ids, headings, tags and date."""
    made = _part_chunks(spark, sf_dir)
    return made.select("id", "source_file", "seq", "heading", F.array_join("heading_path", ",").alias("trail"), F.lower(F.array_join("tags", ",")).alias("tags"), "date", "text")


@query(f"SELECT source_file, count(*) AS chunks, CAST(max(n) AS INTEGER) AS most FROM (SELECT p_partkey || '.md' AS source_file, least(len(tok) - start, 40) AS n FROM ({_PART_CHUNKS} SELECT * FROM c)) GROUP BY source_file")
def chunk_counts(spark, sf_dir):
    return _part_chunks(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("chunks"), F.max(F.size(text.words("text"))).alias("most"))


@query(rf"""WITH t AS (SELECT doc_id, {_BUDGET} AS tok FROM documents WHERE text NOT LIKE '%#%'), w AS (SELECT doc_id, tok, unnest(range(0, len(tok), 100)) AS start FROM t)
SELECT doc_id || '.md' AS source_file, count(*) AS chunks FROM w WHERE len(tok) - start >= 30 GROUP BY doc_id""")
def chunk_min_size(spark, sf_dir):
    """Notes without headings: windows that do not overlap, the last of which may be too small to keep."""
    docs = _table(spark, sf_dir, "documents").where(~F.col("text").contains("#"))
    made = chunker.chunks(from_documents(docs), chunker.ChunkConfig(max_tokens=100, min_chunk_size=30))
    return made.groupBy("source_file").agg(F.count("*").alias("chunks"))


@query(f"""{_PART_CHUNKS} SELECT p_partkey || '.md' AS source_file, CAST(k AS INTEGER) AS k, j, 'passage: ' || CASE k WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END || chr(10) || text AS passage,
'tags: ' || p_brand || ' part' || chr(10) || text AS searched, CASE k WHEN 2 THEN p_name ELSE heading END AS shown FROM c""")
def chunk_texts(spark, sf_dir):
    """What is embedded, searched and shown of a chunk: its headings or its file's name before it, its tags, its heading."""
    made = _part_chunks(spark, sf_dir)
    first = F.when(F.size("heading_path") == 0, 1).otherwise(2)
    line = F.regexp_extract("id", r"^[^:]*:(\d+):", 1).cast("long")
    return made.select("source_file", first.alias("k"), (line - F.when(first == 1, 5).otherwise(7)).alias("j"), index.passage().alias("passage"), index.searchable().alias("searched"), search.shown_heading().alias("shown"))


# --- tasks ----------------------------------------------------------------------------------

_LINE_SQL = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'incomplete' ELSE 'cancelled' END AS status,
'Order ' || o_orderkey || ' #seg' || o_custkey % 10 || ' #all' AS content, 'seg' || o_custkey % 10 || ',all' AS tags, strftime(o_orderdate, '%Y-%m-%d') AS due_date,
CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority,
strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') AS created_date, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS completed_date FROM orders"""


def _tasks(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    box = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "O", " ").otherwise("-")
    urgency = F.create_map(*map(F.lit, ["1-URGENT", " ⏫", "2-HIGH", " 🔼", "3-MEDIUM", " priority: medium", "5-LOW", " 🔽"]))
    parts = [F.lit("- ["), box, F.lit("] 09:30 Order "), F.col("o_orderkey").cast("string"), F.lit(" #seg"), (F.col("o_custkey") % 10).cast("string"), F.coalesce(F.try_element_at(urgency, F.col("o_orderpriority")), F.lit("")), F.lit(" 📅 "), day("o_orderdate"), F.lit(" created: "), day(F.col("o_orderdate") - F.expr("INTERVAL 3 DAY")), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" ✅ "), day("o_orderdate"))).otherwise(""), F.lit("   #all")]
    return tasks.parsed(o.select("o_orderkey", F.concat(*parts).alias("raw_line")))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("o_orderkey", "status", "content", F.array_join("tags", ",").alias("tags"), "due_date", "priority", "created_date", "completed_date")


@query(_LINE_SQL)
def task_parse(spark, sf_dir):
    return _shown(_tasks(spark, sf_dir))


@query(f"SELECT * FROM ({_LINE_SQL}) WHERE status = 'completed'")
def task_filter_status(spark, sf_dir):
    return _shown(tasks.filtered(_tasks(spark, sf_dir), status="completed"))


@query(f"SELECT * FROM ({_LINE_SQL}) WHERE due_date < '1996-01-01' AND due_date > '1994-06-30' AND completed_date < '1995-06-01'")
def task_filter_dates(spark, sf_dir):
    return _shown(tasks.filtered(_tasks(spark, sf_dir), due_before="1996-01-01", due_after="1994-06-30", completed_before="1995-06-01"))


@query(f"SELECT * FROM ({_LINE_SQL}) WHERE due_date = '1996-01-02'")
def task_filter_due_on(spark, sf_dir):
    return _shown(tasks.filtered(_tasks(spark, sf_dir), due_on="1996-01-02"))


@query(f"SELECT * FROM ({_LINE_SQL}) WHERE completed_date = '1995-03-10' AND completed_date > '1995-01-01'")
def task_filter_completed_on(spark, sf_dir):
    return _shown(tasks.filtered(_tasks(spark, sf_dir), completed_on="1995-03-10", completed_after="1995-01-01"))


@query(f"SELECT * FROM ({_LINE_SQL}) WHERE tags = 'seg3,all'")
def task_filter_tags(spark, sf_dir):
    return _shown(tasks.filtered(_tasks(spark, sf_dir), tags=["all", "seg3"]))


@query(f"SELECT * FROM ({_LINE_SQL}) WHERE tags NOT IN ('seg3,all', 'seg4,all')")
def task_filter_exclude(spark, sf_dir):
    return _shown(tasks.filtered(_tasks(spark, sf_dir), exclude_tags=["seg3", "seg4"]))


@query(f"SELECT * FROM ({_LINE_SQL}) ORDER BY o_orderkey LIMIT 50")
def task_limit(spark, sf_dir):
    return _shown(_tasks(spark, sf_dir)).orderBy("o_orderkey").limit(50)


@query("""SELECT o_orderkey || '.md' AS file_path, 'Order ' || o_orderkey AS content, 2 AS line_number, CAST(count(l_linenumber) AS INTEGER) AS n_items,
coalesce(string_agg('line ' || l_linenumber || ' part ' || l_partkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS items
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def task_subitems(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("i"))
    row = lambda x: F.concat(F.when(x["l_linenumber"] % 2 == 0, "  - [ ] ").otherwise("    * "), F.lit("line "), x["l_linenumber"].cast("string"), F.lit(" part "), x["l_partkey"].cast("string"), F.lit("\n"))
    body = F.concat(F.lit("# Orders\n- [ ] Order "), F.col("o_orderkey").cast("string"), F.lit("\n"), F.coalesce(F.array_join(F.transform("i", row), ""), F.lit("")), F.lit("\n  - not one of them\n"))
    notes = _table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), body.alias("content"))
    found = tasks.extract(notes.withColumn("file_name", F.col("path")))
    return found.select("file_path", "content", "line_number", F.size("sub_items").alias("n_items"), F.array_join("sub_items", "|").alias("items"))


# --- tags -----------------------------------------------------------------------------------


def _tagged_notes(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    head = F.concat(F.lit("---\ntitle: \"a: b\"\ntags:\n  - "), F.col("lang"), F.lit("\n  - "), F.upper("source"), F.lit("\n  - "), F.col("lang"), F.lit("\n---\n"))
    return from_documents(docs.withColumn("text", F.concat(head, "text")))


def _tagged(spark, sf_dir) -> DataFrame:
    return tags.extract(_tagged_notes(spark, sf_dir))


_COUNTS = "SELECT tag, count(DISTINCT doc_id) AS document_count FROM (SELECT doc_id, unnest([lang, upper(source)]) AS tag FROM documents) GROUP BY tag"


@query("SELECT DISTINCT unnest([lang, upper(source)]) AS tag FROM documents")
def tags_distinct(spark, sf_dir):
    return tags.distinct(_tagged(spark, sf_dir))


@query(_COUNTS)
def tag_counts(spark, sf_dir):
    return tags.counts(_tagged(spark, sf_dir))


@query(f"SELECT * FROM ({_COUNTS}) WHERE document_count >= 60 ORDER BY document_count DESC, tag LIMIT 3")
def tag_counts_top(spark, sf_dir):
    return tags.counts(_tagged(spark, sf_dir), min_count=60, limit=3)


def _tag_sql(op: str) -> str:
    return f"SELECT doc_id || '.md' AS path, array_to_string(list_filter(['src3', 'en'], lambda t: t IN (lower(lang), lower(source))), ',') AS matched, lang || ',' || upper(source) || ',' || lang AS all_tags FROM documents WHERE lower(source) = 'src3' {op} lower(lang) = 'en'"


def _tag_rows(found: DataFrame) -> DataFrame:
    return found.select("path", F.array_join("matched_tags", ",").alias("matched"), F.array_join("all_tags", ",").alias("all_tags"))


@query(_tag_sql("OR"))
def tag_search_or(spark, sf_dir):
    return _tag_rows(tags.search(_tagged(spark, sf_dir), ["Src3", "EN"]))


@query(_tag_sql("AND"))
def tag_search_and(spark, sf_dir):
    return _tag_rows(tags.search(_tagged(spark, sf_dir), ["Src3", "EN"], match_all=True))


@query(f"SELECT * FROM ({_tag_sql('OR')}) ORDER BY path LIMIT 7")
def tag_search_limit(spark, sf_dir):
    return _tag_rows(tags.search(_tagged(spark, sf_dir), ["Src3", "EN"]).limit(7))


@query("SELECT doc_id, lang || '|' || source AS tags, CAST(946684800 + doc_id % 365 * 86400 AS BIGINT) AS date FROM documents")
def frontmatter_lines(spark, sf_dir):
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    head = F.concat(F.lit("---\ntags: ["), F.col("lang"), F.lit(', "'), F.col("source"), F.lit('"]\ndate: 1999-09-09\ncreated: never\nupdated: "'), day, F.lit('"\n---\n'), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", head.alias("c")).select("doc_id", F.array_join(tags.line_tags("c"), "|").alias("tags"), dates.frontmatter_date("c").alias("date"))


# --- outlines -------------------------------------------------------------------------------

_CUSTOMERS = """n AS (SELECT DISTINCT n_nationkey, c_custkey // 1000 AS part, n_name || '-' || c_custkey // 1000 || '.md' AS path, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
x AS (SELECT path, c_custkey, c_name, n_nationkey, row_number() OVER (PARTITION BY path ORDER BY c_custkey) AS k FROM n JOIN customer ON c_nationkey = n_nationkey AND c_custkey // 1000 = part),
h AS (SELECT path, 0 AS seq, 1 AS level, r_name AS title, 1 AS line_number, CAST(NULL AS BIGINT) AS parent_line FROM n
      UNION ALL SELECT path, 1, 2, n_name, 2, 1 FROM n
      UNION ALL SELECT path, k + 1, 3, c_name, 3 * k + 2, 2 FROM x),
t AS (SELECT path, max(line_number) + 2 AS total FROM h GROUP BY path)"""
# Lines of a note: 1 region, 2 nation, 3 and 4 a line of text and an empty one; then, for customer k, heading at 3k + 2, its number, an empty line.


def _region_notes(spark, sf_dir, fenced: bool = False) -> DataFrame:
    """A note for each nation and thousand of customer numbers, so notes keep their size and their number grows."""
    nation = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    own = _table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("c"))
    third = "~~~" if fenced else "number"
    row = lambda x: F.concat(F.lit("### "), x["c_name"], F.lit(" {#c}  \r\n"), F.lit(f"{third} "), x["c_custkey"].cast("string"), F.lit("\n\n"))
    head = F.concat(F.lit("# "), F.col("r_name"), F.lit("\n## "), F.col("n_name"), F.lit("\n```\n# not a heading\n~~~\n## nor this\n```\n" if fenced else "\nsome text\n\n"))
    body = F.concat(head, F.array_join(F.transform(F.col("c"), row), ""))
    return nation.join(own, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat("n_name", F.lit("-"), F.col("part").cast("string"), F.lit(".md")).alias("path"), body.alias("content"))


@query(f"WITH {_CUSTOMERS} SELECT path, CAST(seq AS INTEGER) AS seq, level, title, CAST(line_number AS INTEGER) AS line_number, CAST(parent_line AS INTEGER) AS parent_line FROM h")
def headings(spark, sf_dir):
    return outline.headings(_region_notes(spark, sf_dir))


@query(f"WITH {_CUSTOMERS} SELECT path, CAST(parent_line AS INTEGER) AS parent_line, count(*) AS children FROM h GROUP BY ALL")
def heading_hierarchy(spark, sf_dir):
    return outline.headings(_region_notes(spark, sf_dir)).groupBy("path", "parent_line").agg(F.count("*").alias("children"))


_SECTIONS = """SELECT path, CAST(seq AS INTEGER) AS seq, level, title, CAST(line_number AS INTEGER) AS start_line, CAST(CASE WHEN level = 3 THEN line_number + 2 ELSE total END AS INTEGER) AS end_line,
CAST(CASE WHEN level = 3 THEN length('number ' || (SELECT c_custkey FROM x WHERE x.path = h.path AND x.k = h.seq - 1)) END AS INTEGER) AS chars FROM h JOIN t USING (path)"""


@query(f"WITH {_CUSTOMERS} {_SECTIONS}")
def sections(spark, sf_dir):
    found = outline.sections(_region_notes(spark, sf_dir))
    return found.select("path", "seq", "level", "title", "start_line", "end_line", F.when(F.col("level") == 3, F.length("content")).alias("chars"))


@query(f"WITH {_CUSTOMERS} SELECT path, title, 'number ' || c_custkey AS content, CAST(3 * k + 2 AS INTEGER) AS start_line, CAST(3 * k + 4 AS INTEGER) AS end_line FROM (SELECT *, c_name AS title FROM x) WHERE lower(title) = 'customer#000000007'")
def section_by_title(spark, sf_dir):
    return outline.section(_region_notes(spark, sf_dir), "CUSTOMER#000000007").select("path", "title", "content", "start_line", "end_line")


@query(f"WITH {_CUSTOMERS} SELECT path, 'some text' AS content, CAST(4 AS INTEGER) AS end_line FROM h WHERE level = 2")
def section_alone(spark, sf_dir):
    return outline.sections(_region_notes(spark, sf_dir), include_subsections=False).where("level = 2").select("path", "content", "end_line")


@query(f"WITH {_CUSTOMERS} SELECT path, level, title, CAST(line_number AS INTEGER) AS line_number FROM h WHERE lower(title) LIKE '%#0000001%' AND level BETWEEN 2 AND 3")
def heading_search(spark, sf_dir):
    return outline.search(_region_notes(spark, sf_dir), "#0000001", 2, 3)


@query(f"WITH {_CUSTOMERS} SELECT path, CAST(count(*) FILTER (WHERE level < 3 OR seq % 2 = 0) AS BIGINT) AS n, CAST(max(CASE WHEN level < 3 THEN line_number WHEN seq % 2 = 0 THEN line_number + 3 END) AS INTEGER) AS last FROM h GROUP BY path")
def fence_skip(spark, sf_dir):
    """Every other customer stands in a fence that the one before opens; the last may stay open."""
    return outline.headings(_region_notes(spark, sf_dir, fenced=True)).groupBy("path").agg(F.count("*").alias("n"), F.max("line_number").alias("last"))


@query(f"""WITH {_CUSTOMERS}, k AS (SELECT path, string_agg('### ' || c_name || ' ' || chr(123) || '#c' || chr(125) || '  ' || chr(13) || chr(10) || 'number ' || c_custkey || chr(10) || chr(10), '' ORDER BY k) AS body FROM x WHERE lower(c_name) NOT LIKE '%r#0000003%' AND lower(c_name) NOT LIKE '%r#0000011%' GROUP BY path)
SELECT path, md5('# ' || r_name || chr(10) || '## ' || n_name || chr(10) || 'some text' || chr(10) || chr(10) || coalesce(body, '')) AS digest FROM n JOIN t USING (path) LEFT JOIN k USING (path)""")
def exclude_sections(spark, sf_dir):
    return outline.without_sections(_region_notes(spark, sf_dir), ["R#0000003", "r#0000011"]).select("path", F.md5("content").alias("digest"))


@query(f"WITH {_CUSTOMERS} SELECT path, level, title, CAST(line_number AS INTEGER) AS line_number FROM h WHERE lower(title) LIKE '%cust%' ORDER BY path, line_number LIMIT 30")
def heading_search_limit(spark, sf_dir):
    return outline.search(_region_notes(spark, sf_dir), "CUST", limit=30)


# --- files and days -------------------------------------------------------------------------


@query("""WITH u AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT 'u' || user_id || '.md' AS file_path, 'u' || user_id || '.md' AS file_name,
CASE WHEN user_id % 3 = 0 THEN '2024-01-02T03:04:05+02:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS updated_at, CASE WHEN user_id % 3 = 0 THEN 'frontmatter' ELSE 'mtime' END AS date_source
FROM u ORDER BY CASE WHEN user_id % 3 = 0 THEN 1704157445 ELSE floor(epoch(ts)) END DESC, 'u' || user_id || '.md' LIMIT 20""")
def recent_files(spark, sf_dir):
    last = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.timestamp_seconds(F.max(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))).alias("mtime"))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md"))
    own = F.when(F.col("user_id") % 3 == 0, F.lit('---\ntitle: x\nupdated: "2024-01-02T03:04:05+02:00"\n---\nbody')).otherwise("no frontmatter")
    return files.recent(last.select(path.alias("path"), path.alias("file_name"), own.alias("content"), "mtime"))


@query("""WITH u AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT 'u' || user_id || '.md' AS file_path, 'u' || user_id || '.md' AS file_name, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, 'mtime' AS date_source FROM u WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)""")
def recent_files_since(spark, sf_dir):
    """All files of the last day of the events."""
    last = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    day = last.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md"))
    mtime = F.timestamp_seconds(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return files.recent(last.select(path.alias("path"), path.alias("file_name"), F.lit("text").alias("content"), mtime.alias("mtime")), None, day)


@query("""SELECT user_id, CAST(epoch(strptime('2024-03-' || lpad(CAST(1 + user_id % 28 AS VARCHAR), 2, '0') || ' 10:20:30', '%Y-%m-%d %H:%M:%S')) AS BIGINT) - CASE WHEN user_id % 2 = 0 THEN 0 ELSE -(5 * 3600 + 1800) END AS ts
FROM (SELECT DISTINCT user_id FROM events)""")
def iso_times(spark, sf_dir):
    day = F.lpad((F.lit(1) + F.col("user_id") % 28).cast("string"), 2, "0")
    iso = F.concat(F.lit("2024-03-"), day, F.lit("T10:20:30"), F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 2 == 0, "Z").otherwise("-05:30"))
    return _table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", dates.iso_seconds(iso).alias("ts"))


@query("SELECT o_orderkey, try_cast('1996-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_custkey % 33 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS valid FROM orders")
def validate_dates(spark, sf_dir):
    made = F.concat(F.lit("1996-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_custkey") % 33).cast("string"), 2, "0"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.valid_date(made).alias("valid"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) % 3 <> 0)
SELECT strftime(day, '%Y-%m-%d') AS date, strftime(day, '0. PeriodicNotes/%Y/Daily/%m/%Y-%m-%d.md') AS file_path FROM d WHERE day BETWEEN DATE '1995-01-10' AND DATE '1995-06-20' ORDER BY day DESC LIMIT 100""")
def daily_notes_range(spark, sf_dir):
    """Days whose number ends a third of a week have two notes, so none is found for them."""
    days = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    deep = dates.note_path("0. PeriodicNotes/YYYY/Daily/MM/YYYY-MM-DD.md", F.col("day"))
    both = F.when(F.dayofmonth("day") % 3 == 0, F.array(deep, dates.note_path("YYYY-MM-DD.md", F.col("day")))).otherwise(F.array(deep))
    notes = days.select(F.explode(both).alias("path")).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit("text").alias("content"))
    return daily.search(notes, "1995-01-10", "1995-06-20").select("date", "file_path")


@query("""SELECT n > 0 AS found, '1995-03-10' AS date, CASE WHEN n > 0 THEN '1995-03-10.md' END AS file_path, CASE WHEN n > 0 THEN n || ' orders' END AS content FROM (SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-10')""")
def daily_note(spark, sf_dir):
    """One day's note, among those of all days."""
    days = _table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    path = dates.note_path("YYYY-MM-DD.md", F.col("day"))
    notes = days.select(path.alias("path"), path.alias("file_name"), F.concat(F.col("n").cast("string"), F.lit(" orders")).alias("content"))
    return daily.get(notes, "1995-03-10")


_TREE = r"""p AS (SELECT regexp_replace(regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', ''), '/+$', '') AS path, strlen(html) AS size FROM pages),
s AS (SELECT string_split(path, '/') AS parts, max(size) AS size FROM p GROUP BY path),
e AS (SELECT parts, size, unnest(range(1, len(parts) + 1)) AS depth FROM s WHERE len(list_filter(parts, lambda x: starts_with(x, '.'))) = 0),
g AS (SELECT array_to_string(parts[1:depth], '/') AS path, depth, max(depth < len(parts)) AS is_dir, max(CASE WHEN depth = len(parts) THEN size END) AS size_bytes FROM e GROUP BY ALL)"""


def _tree(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.expr("substring(url, instr(url, '://') + 3)"), "[?#].*$", ""), "/+$", "")
    return files.tree_rows(_table(spark, sf_dir, "pages").select(bare.alias("path"), F.octet_length("html").cast("long").alias("size")))


@query(f"WITH {_TREE} SELECT path, array_to_string(string_split(path, '/')[1:depth - 1], '/') AS parent, string_split(path, '/')[-1] AS name, CAST(depth AS INTEGER) AS depth, is_dir, size_bytes FROM g")
def file_tree(spark, sf_dir):
    return _tree(spark, sf_dir)


@query(f"WITH {_TREE} SELECT CAST(sum(CASE WHEN is_dir THEN 0 ELSE 1 END) AS BIGINT) AS total_files, CAST(sum(CASE WHEN is_dir THEN 1 ELSE 0 END) + 1 AS BIGINT) AS total_dirs FROM g")
def file_tree_totals(spark, sf_dir):
    return files.tree_totals(_tree(spark, sf_dir))


# Folders of orders' years and months, most of them without a file: those of the first days have one.
_FOLDERS = """f AS (SELECT DISTINCT strftime(o_orderdate, '%Y/%m') AS path FROM orders), y AS (SELECT DISTINCT path[1:4] AS path FROM f),
d AS (SELECT path || '/first.md' AS path, count(*) AS size FROM (SELECT strftime(o_orderdate, '%Y/%m') AS path FROM orders WHERE day(o_orderdate) = 1) GROUP BY 1),
e AS (SELECT path, 1 AS depth, TRUE AS is_dir, NULL AS size_bytes FROM y UNION ALL SELECT path, 2, TRUE, NULL FROM f UNION ALL SELECT path, 3, FALSE, size FROM d)"""


def _folders(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy/MM").alias("path"), F.dayofmonth("o_orderdate").alias("day"))
    empty = o.select("path").distinct().select("path", F.lit(None).cast("long").alias("size"), F.lit(True).alias("is_dir"))
    return empty.unionByName(o.where("day = 1").groupBy(F.concat("path", F.lit("/first.md")).alias("path")).agg(F.count("*").alias("size")).withColumn("is_dir", F.lit(False)))


@query(f"WITH {_FOLDERS} SELECT path, CAST(depth AS INTEGER) AS depth, is_dir, CAST(size_bytes AS BIGINT) AS size_bytes FROM e")
def file_tree_folders(spark, sf_dir):
    """Folders that hold nothing have their rows too."""
    return files.tree_rows(_folders(spark, sf_dir)).select("path", "depth", "is_dir", "size_bytes")


@query(f"WITH {_FOLDERS} SELECT CAST(0 AS BIGINT) AS total_files, count(*) FILTER (WHERE depth = 1) + 1 AS total_dirs FROM e WHERE depth <= 2")
def file_tree_depth(spark, sf_dir):
    """Two levels: the folders of the second are shown, and not counted."""
    return files.tree_totals(files.tree_rows(_folders(spark, sf_dir), 2), 2)


@query(f"WITH {_TREE} SELECT path, array_to_string(list_transform(range(1, depth + 1), lambda i: CASE WHEN i < depth OR is_dir THEN '0' ELSE '1' END || string_split(path, '/')[i]), chr(1)) AS place FROM g")
def file_tree_order(spark, sf_dir):
    """What orders a tree: in each folder the folders first, then by name."""
    return _tree(spark, sf_dir).select("path", files.sort_key(F.col("is_dir"), F.col("path")).alias("place"))


@query("""SELECT page_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576) ELSE printf('%.1f GB', s / 1073741824) END AS size
FROM (SELECT page_id, strlen(html) * (1 + page_id % 7) * (CASE WHEN page_id % 5 = 0 THEN 100003 ELSE 1 END) // (CASE WHEN page_id % 11 = 0 THEN 500 ELSE 1 END) AS s FROM pages)""")
def format_size(spark, sf_dir):
    n = F.octet_length("html").cast("long") * (1 + F.col("page_id") % 7) * F.when(F.col("page_id") % 5 == 0, F.lit(100003)).otherwise(1)
    s = F.floor(n / F.when(F.col("page_id") % 11 == 0, F.lit(500)).otherwise(1))
    return _table(spark, sf_dir, "pages").select("page_id", text.format_size(s).alias("size"))


@query("""SELECT i || '.md' AS file_path, d.doc_id IS NOT NULL AS success, d.n_chars AS n_chars FROM (SELECT unnest(range(-3, 40, 3)) AS i) LEFT JOIN documents d ON d.doc_id = i""")
def read_files_status(spark, sf_dir):
    found = files.read(from_documents(_table(spark, sf_dir, "documents")), [f"{i}.md" for i in range(-3, 40, 3)])
    return found.select("file_path", "success", F.length("content").cast("long").alias("n_chars"))


# --- the index ------------------------------------------------------------------------------


@query("""WITH n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src1'), o AS (SELECT doc_id, sha256(CASE WHEN source = 'src2' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'es')
SELECT coalesce(n.doc_id, o.doc_id) || '.md' AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM n FULL JOIN o ON n.doc_id = o.doc_id WHERE n.h IS DISTINCT FROM o.h""")
def staleness_diff(spark, sf_dir):
    """A source has gone, a language has come, another source's texts have changed."""
    docs = _table(spark, sf_dir, "documents")
    now = index.hashes(from_documents(docs.where("source <> 'src1'")))
    text_ = F.when(F.col("source") == "src2", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = index.hashes(from_documents(docs.where("lang <> 'es'").withColumn("text", text_)))
    return index.diff(now, before)


@query("""SELECT sha256(string_agg(h, '' ORDER BY part)) AS content_hash FROM (SELECT sha256(doc_id || '.md')[1:3] AS part, sha256(string_agg(doc_id || '.md:' || sha256(text), chr(10) ORDER BY doc_id || '.md')) AS h FROM documents GROUP BY part)""")
def overall_content_hash(spark, sf_dir):
    return index.overall_hash(index.hashes(from_documents(_table(spark, sf_dir, "documents"))))


@query("""WITH n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src1'), o AS (SELECT doc_id, sha256(CASE WHEN source = 'src2' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'es')
SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM n FULL JOIN o ON n.doc_id = o.doc_id WHERE n.h IS DISTINCT FROM o.h) GROUP BY change""")
def index_change_counts(spark, sf_dir):
    """The counters of an index run."""
    return staleness_diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


_KEPT = rf"""k AS (SELECT doc_id, {_BUDGET} AS tok FROM documents WHERE text NOT LIKE '%#%'), c AS (SELECT doc_id, start // 100 AS seq, array_to_string(tok[start + 1:start + 100], ' ') AS text FROM (SELECT *, unnest(range(0, len(tok), 100)) AS start FROM k) WHERE len(tok) - start >= 30),
d AS (SELECT doc_id, seq, {_TOKENS} AS tok FROM c),
s AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM d),
q AS (SELECT unnest(['tion', 'the', 'ment', 'tion']) AS term),
p AS (SELECT doc_id, seq, dl, term, count(*) AS tf FROM (SELECT doc_id, seq, len(tok) AS dl, unnest(tok) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT doc_id, seq, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN q USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY doc_id, seq)"""


def _built(spark, sf_dir: str) -> index.Index:
    """An index of the documents, built twice: first with other texts in one source, then brought up to date."""
    key = f"{spark.sparkContext.applicationId} index", sf_dir
    at = _WRITTEN.setdefault(key, f"{spark.conf.get('spark.sql.warehouse.dir')}/index-{uuid.uuid4().hex}")
    own = index.Index(spark, at, chunker.ChunkConfig(max_tokens=100, min_chunk_size=30))
    if own.version() is None:
        docs = _table(spark, sf_dir, "documents").where(~F.col("text").contains("#"))
        own.build(from_documents(docs.withColumn("text", F.when(F.col("source") == "src2", F.concat("text", F.lit(" the more"))).otherwise(F.col("text")))))
        own.build(from_documents(docs))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


@query(f"WITH {_KEPT} SELECT doc_id || '.md' AS source_file, CAST(seq AS INTEGER) AS seq, round(score, 6) AS score FROM b")
def index_scores(spark, sf_dir):
    """Every chunk's score from an index that was built and then brought up to date."""
    own = _built(spark, sf_dir)
    return bm25.scores_from_index(own.table("postings"), own.table("stats"), ASKED, "chunk").select("chunk.*", F.round("score", 6).alias("score"))


@query("SELECT 'sparse' AS mode_used, CAST(7 AS BIGINT) AS results")
def search_degrades(spark, sf_dir):
    """A hybrid search of an index without vectors is a sparse one."""
    found = search.search(_built(spark, sf_dir), ASKED, search.Mode.HYBRID, limit=7)
    return found.results.agg(F.count("*").alias("results")).select(F.lit(found.mode_used.value).alias("mode_used"), "results")
