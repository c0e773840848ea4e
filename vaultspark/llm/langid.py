"""Language identification by prediction by partial matching.

Each language has a byte context tree of order `order` with escape probabilities (method C): after
a context seen T times with D different successors, a successor seen n times has probability
n / (T + D), and the escape to the next shorter context D / (T + D); below order 0 every byte has
1 / 256. The statistics are frozen after training, so the exact code length of a text is a sum of
table entries. The trees are merged into one automaton whose nodes hold the code lengths of all
languages; numpy walks it for a megabyte of text at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, fold, fresh, table, text_bytes, tune

ORDER = 4
#: Bound of the training sample: distinct texts per language, and bytes per language (whole texts
#: are taken in hash order until they reach it). More would only fit the model closer.
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 400_000
UNDETERMINED = "und"


@dataclass
class Model:
    """Merged context trees. Node 0 is dead, node 1 the root; deeper nodes have larger numbers."""

    languages: list[str]
    order: int
    symbol: np.ndarray  # of each byte; 0: never seen in training
    width: int
    step: np.ndarray  # [contexts * width] node after a context and a symbol, or 0
    cost: np.ndarray  # [nodes, languages] bits of the node's last byte after the node's other bytes
    escape: np.ndarray  # [nodes, languages] bits of the escape from the node as a context
    level: np.ndarray  # first node of each depth


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Context trees of each language's texts; no context reaches across two texts."""
    languages = sorted(samples)
    n_lang = len(languages)
    every = b"".join(b"".join(samples[x]) for x in languages)
    seen = np.unique(np.frombuffer(every, np.uint8))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    grams = []  # per depth: code and count by language
    for depth in range(1, order + 2):
        codes, langs = [], []
        for k, lang in enumerate(languages):
            for text in samples[lang]:
                s = symbol[np.frombuffer(text, np.uint8)]
                if len(s) >= depth:
                    code = np.zeros(len(s) - depth + 1, np.int64)
                    for i in range(depth):
                        code = code * width + s[i : len(s) - depth + 1 + i]
                    codes.append(code)
                    langs.append(np.full(len(code), k))
        if not codes:
            break
        codes, langs = np.concatenate(codes), np.concatenate(langs)
        unique, at = np.unique(codes, return_inverse=True)
        count = np.zeros((len(unique), n_lang))
        np.add.at(count, (at, langs), 1)
        grams.append((unique, count))
    level = np.cumsum([0, 1, 1, *(len(u) for u, _ in grams)])  # dead, root, depth 1, ...
    nodes = int(level[-1])
    contexts = int(level[-2]) if len(grams) > 1 else 2
    step = np.zeros(contexts * width, np.int32)
    cost = np.zeros((nodes, n_lang))
    escape = np.zeros((nodes, n_lang))
    above = np.zeros(1, np.int64)  # codes of the contexts of this depth
    first = 1
    for depth, (codes, count) in enumerate(grams, start=1):
        at = level[depth + 1]
        context = np.searchsorted(above, codes // width)
        node = np.arange(at, at + len(codes))
        step[(first + context) * width + codes % width] = node
        total = np.zeros((len(above), n_lang))
        kinds = np.zeros((len(above), n_lang))
        np.add.at(total, context, count)
        np.add.at(kinds, context, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            hit = np.log2((total + kinds)[context] / count)
        if depth == 1:
            shorter = np.full((len(codes), n_lang), 8.0)
            cost[1] = out[0] + 8.0
        else:
            suffix = codes % width ** (depth - 1)
            shorter = cost[level[depth] + np.searchsorted(grams[depth - 2][0], suffix)]
            escape[first : first + len(above)] = out
        cost[node] = np.where(count > 0, hit, out[context] + shorter)
        above, first = codes, int(at)
    return Model(languages, len(grams) - 1 if grams else 0, symbol, width, step, cost.astype(np.float32), escape.astype(np.float32), level)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    for start in range(0, len(data), CHUNK_BYTES):
        stop = min(len(data), start + CHUNK_BYTES)
        back = max(0, start - model.order)  # contexts of the first bytes
        sym = model.symbol[data[back:stop]]
        new = offsets[(offsets >= back) & (offsets < stop)] - back
        best = np.ones(len(sym), np.int32)
        node = np.ones(len(sym), np.int32)
        passed = []
        for depth in range(1, model.order + 2):
            if depth > 1:
                prior = np.empty_like(node)
                prior[0] = 0
                prior[1:] = node[:-1]
                prior[new] = 0
                passed.append(prior)
                node = prior
            node = model.step[node.astype(np.int64) * model.width + sym]
            np.maximum(best, node, out=best)
        bits = model.cost[best]
        for depth, prior in enumerate(passed, start=1):  # contexts longer than the one that matched
            missed = np.flatnonzero((best < model.level[depth + 2]) & (prior > 0))
            bits[missed] += model.escape[prior[missed]]
        sums = np.zeros((stop - start + 1, bits.shape[1]))
        np.cumsum(bits[start - back :], axis=0, dtype=np.float64, out=sums[1:])
        edge = np.clip(offsets, start, stop) - start
        total += sums[edge[1:]] - sums[edge[:-1]]
    return total


def sample(docs: DataFrame, text: str, lang: str, texts: int = SAMPLE_TEXTS, most: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Up to `texts` distinct whole texts of each language, the first in hash order.

    A first scan estimates the distinct texts of each language; the second keeps the share of the
    hash space that holds about four times the sample, so neither a hot text nor a large language is
    gathered in a task. Where that gives too few texts, the share is widened up to the whole space.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    distinct = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    shares = {name: min(1.0, 4 * texts / max(n, 1)) for name, n in distinct.items()}
    hashed = rows.withColumn("whole", F.xxhash64("text")).withColumn("h", F.pmod("whole", F.lit(2**32)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "whole"))
    found: dict[str, list[bytes]] = {}
    while shares:
        share = F.lit(False)
        for name, x in sorted(shares.items()):
            share = share | ((F.col("lang") == name) & (F.col("h") < int(2**32 * x)))
        few = hashed.where(share).dropDuplicates(["lang", "whole"])
        got: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        count = dict.fromkeys(shares, 0)
        for r in few.withColumn("r", rank).where(F.col("r") <= texts).orderBy("lang", "r").toLocalIterator():
            count[r["lang"]] += 1
            if size.get(r["lang"], 0) < most:
                got.setdefault(r["lang"], []).append(r["text"].encode())
                size[r["lang"]] = size.get(r["lang"], 0) + len(r["text"].encode())
        found |= got
        shares = {name: min(1.0, 8 * x) for name, x in shares.items() if count[name] < texts and x < 1}
    return found


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> Model:
    return train(sample(docs, text, lang), order)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` (all its columns) with lang_pred, score and bits_per_byte.

    lang_pred is `und`, score 0, if the text is null or has no letter, or nothing was learned.
    Otherwise score is the posterior of the best language under equal priors; of equal code
    lengths the first language in alphabetical order wins. Columns of those names are replaced, any
    others stay. Texts are read whole, however long; repeated rows are judged alike; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "bits_per_byte")
    judged = kept.withColumn(fresh(kept, "letters"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = judged.columns
    at, letters = names.index(text), len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        labels = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            ok = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            best, score, rate = np.full(len(ok), len(m.languages)), np.zeros(len(ok)), np.full(len(ok), np.nan)
            if ok.any():
                bits = code_lengths(m, data, offsets)
                least = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
                best = np.where(ok, least, best)
                score = np.where(ok, 1 / np.exp2(-gap).sum(axis=1), 0)
                rate = np.where(ok, bits.min(axis=1) / np.maximum(np.diff(offsets), 1), np.nan)
            more = [pa.array(labels[best], pa.string()), pa.array(score), pa.array(rate, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:letters], *more], [*names[:letters], "lang_pred", "score", "bits_per_byte"])

    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)}).schema
    for field in schema:
        field.nullable = True
    return judged.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those whose fold is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    asked = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return predict(asked, model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose text has a language; those judged `und` go.

    `und` is a text without a letter, so the letter test decides and the model's scores do not. It
    also decides where nothing was learned and `predict` calls every document `und`. Each row is
    judged by its own text, whatever its doc_id; columns stay; an empty table stays empty.
    """
    names = docs.columns
    model = fit(docs.where(fold("doc_id", 4) != 2))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return predict(docs, model).where(F.col("lang_pred") != UNDETERMINED).select(names)
