"""BM25 over documents: scores of one query in two narrow passes, or from a persisted inverted index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_BREAK, bm25_tokens, let

# Fixed values.
K1, B = 1.2, 0.75


def query_tokens(query: str) -> list[str]:
    """As documents are split; repeated terms stay and count again."""
    return [t for t in re.split(TOKEN_BREAK, query.lower()) if t]


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _count(tokens: str, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document that has a term of the query.

    Only the query's terms are counted, within each row, so no token is shuffled: the corpus'
    number, average length and term frequencies are one row of sums, broadcast to a second pass.
    """
    terms = query_tokens(query)
    names = sorted(set(terms))
    if not names:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    split = docs.select(key, bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # A generator, since a filter on plain columns would be pushed below them and split every text again for each term.
    counted = split.select(key, F.inline(F.array(F.struct(F.size("_t").cast("long").alias("_dl"), *[_count("_t", w).alias(f"_tf{i}") for i, w in enumerate(names)]))))
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(names))])
    joined = counted.where(" or ".join(f"_tf{i} > 0" for i in range(len(names)))).crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i, w in enumerate(names):
        one = F.when(F.col(f"_tf{i}") > 0, _idf(F.col("_n"), F.col(f"_df{i}")) * _weight(F.col(f"_tf{i}"), F.col("_dl"), F.col("_avgdl"))).otherwise(0.0)
        score = score + terms.count(w) * one
    return joined.select(key, score.alias("score"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl): the inverted index, one row for a term of a document.

    A row's own tokens are sorted and counted within it, so nothing is shuffled. Rows of one key and
    length count together; whether a key is repeated is asked at once, and only then are rows grouped.
    """
    rows = _rows(docs, key, text)
    return (rows if _distinct(docs, key) else _merged(rows, key)).select("term", key, "tf", "dl")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.inline(_counted(F.sort_array(bm25_tokens(F.coalesce(F.col(text), F.lit("")))))))


def _distinct(docs: DataFrame, key: str) -> bool:
    return docs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def _merged(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("term", key, "dl").agg(F.sum("tf").alias("tf"))


def _counted(tokens: Column) -> Column:
    """(term, tf, dl) of each token of a sorted list, by the places where its runs begin; linear in its length."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        begins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        one = lambda at: lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).cast("long").alias("tf"), n.cast("long").alias("dl"))
        return let(begins, lambda at: F.transform(at, one(at)))

    return let(tokens, runs)


#: Bytes of text of a file of the written index: its postings, some 50 bytes a byte of text in memory at most, are sorted by one task.
SEGMENT_BYTES = 16 << 20


def write_index(docs: DataFrame, at: str, key: str = "doc_id", text: str = "text") -> None:
    """`postings`, in order of their terms within each file, and `corpus_stats` of a table as Parquet below `at`.

    Texts are dealt by their keys in parts whose postings one task can sort, which moves a third of the bytes
    that the postings have. Where keys are repeated the postings are dealt by term instead, and count together.
    Texts are split once: the sums follow from the postings.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    files = max(-(-size // SEGMENT_BYTES), min(spark.sparkContext.defaultParallelism, 1 + (size >> 20)))
    rows = _rows(docs.select(key, text).repartition(files, key), key, text) if _distinct(docs, key) else _merged(_rows(docs, key, text).repartition("term"), key)
    rows = rows.select("term", key, "tf", "dl").sortWithinPartitions("term")
    rows.write.parquet(f"{at}/postings")
    tokens = spark.read.schema(rows.schema).parquet(f"{at}/postings").agg(F.sum("tf").alias("_tokens"))
    n = docs.agg(F.count("*").alias("n")).crossJoin(F.broadcast(tokens))  # one row
    n.select("n", F.when(F.col("n") > 0, F.coalesce("_tokens", F.lit(0)) / F.col("n")).alias("avgdl")).write.parquet(f"{at}/stats")


def term_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, avgdl); documents without tokens count."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(bm25_tokens(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def scores_from_index(index: DataFrame, stats: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """(key, score) from `postings` and `corpus_stats`; the query's terms are pushed down to the index's scan."""
    terms = query_tokens(query)
    mine = index.where(F.col("term").isin(*set(terms))) if terms else index.limit(0)
    times = F.lit(0)
    for w in set(terms):
        times = F.when(F.col("term") == w, terms.count(w)).otherwise(times)
    found = mine.join(F.broadcast(term_frequencies(mine)), "term").crossJoin(F.broadcast(stats))  # a row a query term, one row
    return found.groupBy(key).agg(F.sum(times * _idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))
