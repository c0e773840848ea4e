"""Katz back-off language model of any order, counted and evaluated over the whole corpus.

The documents are cut into blocks of bounded size, and n-grams into buckets by their 64-bit hash.
Blocks and buckets exchange messages: order by order, a block asks each bucket for the counts of its
distinct n-grams, once each with its own training counts, so a common word or phrase weighs no more
than a rare one; the bucket adds up all blocks' counts and answers. Every seen n-gram is owned by one
block, which adds what its discount frees, and its probability one order below, to the sums of its
context; the buckets add up those too, and answer the blocks that back off there. The tables of
counts and of contexts stay partitioned throughout: no task, nor the driver, holds more than a block
or a bucket, and the number of buckets follows from the number of tokens, so both have a fixed size.

Model, evaluated recursively for every token: P(w|h) = d(c) c(h w) / c(h) if c(h w) > 0, else a(h)
P(w|h') where h' is h without its first word (a is 1 after a history that training never met).
P(w) = d(c) c(w) / N, and the mass left is one event for all unknown words. d is Katz' discount:
(r*/r - A) / (1 - A) for counts r up to K, with the Good-Turing r* = (r+1) n[r+1] / n[r] and A =
(K+1) n[K+1] / n[1], and 1 above; where counts of counts are too sparse for one between 0 and 1, it is
(r - 1/2) / r. A history none of whose continuations is discounted has one count added to c(h), which
is left for the others. a(h) makes the probabilities of all words and the unknown one sum to 1
exactly. A document's first word follows the end token and has that history only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hash_spans, lower_ascii, materialize, mix, release, table, text_bytes, tune, words

ORDER = 3
K = 5  # counts above this are not discounted
#: Bytes of text of one block; a longer document is a block by itself.
BLOCK_BYTES = 6 << 20
#: Tokens for each bucket: a bound of the n-grams of one order that it is asked about.
BUCKET_TOKENS = 2 << 20
END = np.uint64(0x5851F42D4C957F2D)

# --- packing --------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Numbers of one kind as byte planes, compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_values(x: np.ndarray) -> list[bytes]:
    """Numbers few of which are different: these, and the place of each among them."""
    kinds, which = np.unique(x, return_inverse=True)
    return [pack(kinds), pack(which.astype(np.uint32))]


def unpack_values(parts: list[bytes], kind: type) -> np.ndarray:
    return unpack(parts[0], kind)[unpack(parts[1], np.uint32)]


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def cuts(x: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted hashes begins; buckets are equal ranges of hashes."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(x, edges), len(x))


def extend(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of each n-gram from that of all its words but the last, and the last."""
    return mix(mix(history ^ np.uint64(0xA0761D6478BD642F)) + word)


# --- messages -------------------------------------------------------------------------------

SCHEMA = "block long, bucket long, parts array<binary>, stats array<long>"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("parts", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))])
#: From a block to itself, to no bucket; and counts of counts, to no block.
OWN, SUMS = -1, -1
Message = dict


def _sent(messages: Iterator[Message], rows: int = 32, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows and megabytes."""
    held: list[Message] = []
    size = 0
    for m in messages:
        held.append({"stats": None, **m})
        size += sum(map(len, m["parts"]))
        if len(held) == rows or size > most:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def _read(batches: Iterator[pa.RecordBatch], rows: int = 2) -> Iterator[Message]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield from batch.slice(a, rows).to_pylist()


def each(df: DataFrame, work: Callable[[Message], Iterator[Message]]) -> DataFrame:
    return df.mapInArrow(lambda batches: _sent(m for one in _read(batches) for m in work(one)), SCHEMA)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[Message]]:
    held: list[Message] = []
    for m in _read(batches):
        if held and held[0][key] != m[key]:
            yield held
            held = []
        held.append(m)
    if held:
        yield held


def together(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.repartition(n, key).sortWithinPartitions(key, "block", "bucket")


def per_group(df: DataFrame, key: str, n: int, work: Callable[[list[Message]], Iterator[Message]]) -> DataFrame:
    """Messages brought together by `key` (in order of block and bucket), and what `work` makes of each group."""
    return together(df, key, n).mapInArrow(lambda batches: _sent(m for group in _groups(batches, key) for m in work(group)), SCHEMA)


# --- blocks ---------------------------------------------------------------------------------


def block_of(column: pa.Array, learn: np.ndarray) -> list[bytes]:
    """A block's documents as words of its own vocabulary, which stands in order of frequency."""
    data, offsets = text_bytes(column)
    low = lower_ascii(data)
    starts, ends, n = words(low, offsets)
    h = hash_spans(low, starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    token = np.full(len(h) + len(n), END, np.uint64)
    token[np.arange(len(h)) + row] = h
    vocabulary, local, count = np.unique(token, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return [pack(vocabulary[order]), pack(place[local]), pack((n + 1).astype(np.uint32)), pack(learn.astype(np.uint8))]


class Grams:
    """The distinct n-grams of one order in a block: sorted hashes, a place of each, and the n-gram of each token (-1: none)."""

    def __init__(self, hashes: np.ndarray, there: np.ndarray):
        self.hash, first, which = np.unique(hashes[there], return_index=True, return_inverse=True)
        self.place = there[first]
        self.of = np.full(len(hashes), -1, np.int64)
        self.of[there] = which

    def __len__(self) -> int:
        return len(self.hash)


class Block:
    def __init__(self, parts: list[bytes], order: int):
        self.order = order
        self.n = unpack(parts[2], np.uint32).astype(np.int64)
        self.word = unpack(parts[0], np.uint64)[unpack(parts[1], np.uint32)]
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.learn = unpack(parts[3], np.uint8).astype(bool)
        self.trained = self.learn[self.row]
        first = np.cumsum(self.n) - self.n
        self.first = np.zeros(len(self.row), bool)
        self.first[first] = True
        self.place = np.arange(len(self.row)) - first[self.row]

    def hashes(self, n: int) -> np.ndarray:
        """Of the n-gram that ends at each token; those of places below n - 2 mean nothing."""
        h = self.word
        for _ in range(n - 1):
            before = np.empty_like(h)
            before[1:] = h[:-1]
            before[self.first] = END
            h = extend(before, self.word)
        return h

    def grams(self, n: int) -> Grams:
        return Grams(self.hashes(n), np.flatnonzero(self.place >= n - 2))

    def end(self, words_: Grams) -> int:
        return int(np.searchsorted(words_.hash, END))


def requests(block: Message, n: int, order: int, buckets: int) -> Iterator[Message]:
    """To each bucket: the block's n-grams there, with its training counts."""
    b = Block(block["parts"], order)
    g = b.grams(n)
    use = b.trained & (g.of >= 0)
    count = np.bincount(g.of[use], minlength=len(g)).astype(np.uint32)
    at = cuts(g.hash, buckets)
    for k in range(buckets):
        if at[k] < at[k + 1]:
            x = slice(at[k], at[k + 1])
            yield {"block": block["block"], "bucket": k, "parts": [pack_sorted(g.hash[x]), pack(count[x])]}


def answers(asked: list[Message]) -> Iterator[Message]:
    """To each block: the total counts of what it asked for, and which n-grams it owns; and the bucket's counts of counts."""
    keys = [unpack_sorted(m["parts"][0]) for m in asked]
    ends = np.cumsum([0, *map(len, keys)])
    counts = np.concatenate([unpack(m["parts"][1], np.uint32) for m in asked]).astype(np.int64)
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    summed = np.zeros(len(unique), np.int64)
    np.add.at(summed, which, counts)
    with_count = np.flatnonzero(counts)
    _, first = np.unique(which[with_count], return_index=True)
    own = np.zeros(len(which), bool)
    own[with_count[first]] = True
    total = summed[which]
    for i, m in enumerate(asked):
        x = slice(ends[i], ends[i + 1])
        yield {"block": m["block"], "bucket": m["bucket"], "parts": [pack(total[x]), np.packbits(own[x]).tobytes()]}
    yield {"block": SUMS, "bucket": asked[0]["bucket"], "parts": [], "stats": [int(summed.sum()), int((summed > 0).sum()), *(int((summed == r).sum()) for r in range(1, K + 2))]}


def counted(group: list[Message], orders: int) -> Iterator[Message]:
    """A block with the counts and ownership of all its n-grams, order by order, from its buckets' answers."""
    own = next(m for m in group if m["bucket"] == OWN)
    parts = list(own["parts"])
    for n in range(1, orders + 1):
        mine = sorted((m["bucket"] // orders, m) for m in group if m["bucket"] != OWN and m["bucket"] % orders == n - 1)
        totals = [unpack(m["parts"][0], np.int64) for _, m in mine]
        flags = [np.unpackbits(np.frombuffer(m["parts"][1], np.uint8), count=len(t)) for (_, m), t in zip(mine, totals)]
        parts += [pack(np.concatenate([np.zeros(0, np.int64), *totals])), pack(np.concatenate([np.zeros(0, np.uint8), *flags]))]
    yield {"block": own["block"], "bucket": OWN, "parts": parts}


# --- the model ------------------------------------------------------------------------------


def discounts(n: list[int]) -> np.ndarray:
    """d of counts 0 to K + 1, the last for all above. n: n[1] to n[K+1]."""
    a = (K + 1) * n[K] / n[0] if n[0] else 1.0
    out = [1.0]
    for r in range(1, K + 1):
        star = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
        d = (star / r - a) / (1 - a) if a < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array([*out, 1.0])


class Statistics:
    """Of each order: tokens, kinds and counts of counts, of which the discounts follow."""

    def __init__(self, sums: list[list[int]]):
        self.tokens, self.kinds = sums[0][:2]
        self.d = [discounts(s[2:]) for s in sums]
        ones = sums[0][2 : 2 + K]
        freed = sum((1 - self.d[0][r]) * r * x for r, x in enumerate(ones, start=1))
        self.total = self.tokens if freed > 0 else self.tokens + 1  # of the denominator
        self.unknown = (freed or 1.0) / self.total

    def kept(self, n: int, count: np.ndarray) -> np.ndarray:
        """d(c) c for counts of n-grams."""
        return self.d[n - 1][np.minimum(count, K + 1)] * count

    def freed(self, n: int, count: np.ndarray) -> np.ndarray:
        return (1 - self.d[n - 1][np.minimum(count, K + 1)]) * count

    def p1(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.kept(1, count) / self.total, self.unknown)


class Evaluated:
    """A block with all its counts: what it gives to contexts, asks of them, and makes of the answers."""

    def __init__(self, message: Message, s: Statistics, order: int):
        self.s, self.order, parts = s, order, message["parts"]
        b = self.block = Block(parts, order)
        self.grams = [b.grams(n) for n in range(1, order + 1)]
        self.count = [unpack(parts[5 + 2 * k], np.int64) for k in range(order)]
        self.own = [unpack(parts[6 + 2 * k], np.uint8).astype(bool) for k in range(order)]
        self.previous = np.arange(len(b.row)) - 1

    def history(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and count of the history of the n-gram that ends at each of the places."""
        g = self.grams[n - 2]
        which = g.of[self.previous[at]]
        if n == 2:
            which = np.where(self.block.first[at], self.block.end(g), which)
        return g.hash[which], self.count[n - 2][which]

    def at(self, n: int, at: np.ndarray) -> np.ndarray:
        """Count of the n-gram that ends at each of the places, 0 where there is none."""
        which = self.grams[n - 1].of[at]
        return np.where(which >= 0, self.count[n - 1][which], 0) if len(self.count[n - 1]) else np.zeros(len(at), np.int64)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted histories of the owned n-grams, with the counts freed there and the sum of their lower-order probabilities.

        The latter lacks its denominator above order 2: it is the same for the whole history, and the asker knows it.
        """
        keys, freed, covered = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0)]
        for n in range(2, self.order + 1):
            g = self.grams[n - 1]
            mine = np.flatnonzero(self.own[n - 1])
            place = g.place[mine]
            lower = self.at(n - 1, place)
            keys.append(self.history(n, place)[0])
            freed.append(self.s.freed(n, self.count[n - 1][mine]))
            covered.append(self.s.p1(lower) if n == 2 else self.s.kept(n - 1, lower))
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(which, np.concatenate(freed), len(key)), np.bincount(which, np.concatenate(covered), len(key))

    def open(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Histories asked about, sorted; places whose probability needs them; and for each order from 2 the one asked at each (-1: none).

        Asked for are the weights where the n-gram is unseen and its history seen, and whether
        anything is freed where the count is too large to be discounted itself.
        """
        every = np.arange(len(self.block.row))
        undecided = np.ones(len(every), bool)  # no n-gram seen yet, from the highest order down
        below = np.zeros(len(every), bool)
        wanted = []
        for n in range(self.order, 1, -1):
            there = self.grams[n - 1].of >= 0
            c = self.at(n, every)
            history = np.zeros(len(every), np.int64)
            history[there] = self.history(n, every[there])[1]
            wanted.append(there & (history > 0) & ((undecided & ((c == 0) | (c > K))) | below))
            undecided &= c == 0
            below = wanted[-1] & undecided  # the longer history's weight needs this one's denominator
        wanted = wanted[::-1]
        places = np.flatnonzero(np.any(wanted, axis=0)) if wanted else np.zeros(0, np.int64)
        hashes = np.zeros((len(wanted), len(places)), np.uint64)
        for k, w in enumerate(wanted):
            hashes[k, w[places]] = self.history(k + 2, places[w[places]])[0]
        asked = np.unique(hashes[np.array([w[places] for w in wanted])]) if wanted else np.zeros(0, np.uint64)
        index = [np.where(w[places], np.searchsorted(asked, h), -1) for w, h in zip(wanted, hashes)]
        return asked, places, index

    def scores(self, places: np.ndarray, index: list[np.ndarray], freed: np.ndarray, covered: np.ndarray) -> np.ndarray:
        """log10 P of the tokens at the places, from the lowest order up."""
        log = np.log10(self.s.p1(self.at(1, places)))
        lower = np.ones(len(places))  # the denominator one order below: c of the history, with what is added
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(2, self.order + 1):
                there = self.grams[n - 1].of[places] >= 0
                c = self.at(n, places)
                history = np.zeros(len(places), np.int64)
                history[there] = self.history(n, places[there])[1]
                known = index[n - 2] >= 0 if len(index) else np.zeros(len(places), bool)
                free = np.where(known, freed[index[n - 2]] if len(freed) else 0.0, 1.0)  # unasked: something is freed
                total = history + (free <= 0)
                left = np.where(free > 0, free, 1.0) / total
                weight = left / (1 - (covered[index[n - 2]] if len(covered) else 0.0) / lower)
                log = np.where(c > 0, np.log10(self.s.kept(n, c) / total), np.where(there & (history > 0), log + np.log10(weight), log))
                lower = total
        return log


def split_contexts(message: Message, s: Statistics, order: int, buckets: int) -> Iterator[Message]:
    """To each bucket: the block's parts of the sums of its histories, and the histories that it asks about."""
    e = Evaluated(message, s, order)
    key, freed, covered = e.contexts()
    asked, _, _ = e.open()
    x, y = cuts(key, buckets), cuts(asked, buckets)
    for k in range(buckets):
        if x[k] < x[k + 1] or y[k] < y[k + 1]:
            i, j = slice(x[k], x[k + 1]), slice(y[k], y[k + 1])
            yield {"block": message["block"], "bucket": k, "parts": [pack_sorted(key[i]), pack_sorted(asked[j]), *pack_values(freed[i]), *pack_values(covered[i])]}


def weights(messages: list[Message]) -> Iterator[Message]:
    """To each block that asks: the sums of its histories (both 0 for one with no owned n-gram, which has none to free)."""
    h = np.concatenate([unpack_sorted(m["parts"][0]) for m in messages])
    context, which = np.unique(h, return_inverse=True)
    freed = np.bincount(which, np.concatenate([unpack_values(m["parts"][2:4], np.float64) for m in messages]), len(context))
    covered = np.bincount(which, np.concatenate([unpack_values(m["parts"][4:6], np.float64) for m in messages]), len(context))
    for m in messages:
        asked = unpack_sorted(m["parts"][1])
        if len(asked):
            at = np.minimum(np.searchsorted(context, asked), max(len(context) - 1, 0))
            met = context[at] == asked if len(context) else np.zeros(len(asked), bool)
            yield {"block": m["block"], "bucket": m["bucket"], "parts": [pack(np.where(met, freed[at], 0.0) if len(context) else np.zeros(len(asked))), pack(np.where(met, covered[at], 0.0) if len(context) else np.zeros(len(asked)))]}


def finish(message: Message, replies: list[Message], s: Statistics, order: int) -> dict[str, np.ndarray]:
    """The block's documents' results. `replies` stand in order of their buckets."""
    e = Evaluated(message, s, order)
    b = e.block
    _, places, index = e.open()
    freed, covered = (np.concatenate([np.zeros(0), *(unpack(m["parts"][k], np.float64) for m in replies)]) for k in (0, 1))
    every = np.arange(len(b.row))
    none = [np.full(len(every), -1)] * (order - 1)
    log = e.scores(every, none, np.zeros(0), np.zeros(0))
    log[places] = e.scores(places, index, freed, covered)
    c1, docs = e.at(1, every), len(b.n)
    return {
        "n_tokens": b.n,
        "n_known": np.bincount(b.row, c1 > 0, docs).astype(np.int64),
        "base_score": np.bincount(b.row, np.log10((c1 + 0.1) / (s.tokens + 0.1 * (s.kinds + 1))), docs),
        "score": np.bincount(b.row, log, docs),
    }


# --- over tables ----------------------------------------------------------------------------


def _blocks(docs: DataFrame, text: str, learn: str) -> DataFrame:
    """One message a block; its last part holds the documents' ids, its statistics the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            parts = block_of(t.column(2).combine_chunks(), t.column(1).to_numpy(zero_copy_only=False).astype(bool))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", t.schema.field(0).type)])) as out:
                out.write_table(pa.table({"doc_id": t.column(0)}))
            tokens = int(unpack(parts[2], np.uint32).sum())
            yield from _sent(iter([{"block": part << 24 | made, "bucket": OWN, "parts": [*parts, sink.getvalue().to_pybytes()], "stats": [tokens]}]))

        size = 0
        for batch in batches:
            at = 0
            lengths = np.diff(text_bytes(batch.column(2))[1])
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(at, i + 1 - at))
                    yield from done()
                    held, at, size, made = [], i + 1, 0, made + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield from done()

    rows = docs.select("doc_id", F.coalesce(F.col(learn), F.lit(False)).alias("learn"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _sums(rows: DataFrame, n: int) -> list[int]:
    found = rows.agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(n)]).first()
    return [int(x) for x in found]


def score(docs: DataFrame, learn: str, text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows where the boolean `learn` is true (null: false). Tokens are the
    words between ASCII white space, A-Z lower-cased, and one end token a row, so a null or an empty
    text has that one; a text of any length is scored whole. Scores are log10. Repeated rows are
    counted and scored each, a null doc_id is scored like any other. With nothing to learn from, all
    tokens are the unknown one and every score is 0. An empty table gives no rows; other columns of
    `docs` are left out, whatever their names.
    """
    spark = docs.sparkSession
    tune(spark)
    blocks, at_blocks = materialize(_blocks(docs, text, learn), "blocks")
    (tokens,) = _sums(blocks, 1)
    buckets = int(tokens // BUCKET_TOKENS) + 1
    n_blocks = max(1, min(blocks.count(), buckets * 2))
    own = blocks.withColumn("stats", F.lit(None).cast("array<long>"))
    replies, used, sums = [], [at_blocks], []
    for n in range(1, order + 1):
        asked = each(own, lambda m, n=n: requests(m, n, order, buckets))
        found, path = materialize(per_group(asked, "bucket", buckets, answers), f"counts{n}")
        sums.append(_sums(found.where(F.col("block") == SUMS), K + 3))
        replies.append(found.where(F.col("block") != SUMS).withColumn("bucket", F.col("bucket") * order + (n - 1)))
        used.append(path)
    every = own
    for r in replies:
        every = every.unionByName(r)
    whole, _ = materialize(per_group(every, "block", n_blocks, lambda group: counted(group, order)), "counted")
    release(spark, *used)
    held = spark.sparkContext.broadcast(Statistics(sums))
    back, _ = materialize(per_group(each(whole, lambda m: split_contexts(m, held.value, order, buckets)), "bucket", buckets, weights), "contexts")
    names = ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "block"):
            r = finish(group[0], group[1:], held.value, order)
            ids = pa.ipc.open_stream(group[0]["parts"][4]).read_all().column(0).combine_chunks()
            learned = unpack(group[0]["parts"][3], np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays([ids, pa.array(learned), *(pa.array(r[k]) for k in names[2:])], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, learned boolean, n_tokens long, n_known long, base_score double, score double"
    return together(whole.unionByName(back), "block", n_blocks).mapInArrow(run, schema).withColumn("train_tokens", F.lit(sums[0][0]).cast("long"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by trigrams learned from those whose fold is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("learn", fold("doc_id", 10) != 0)
    return score(docs, "learn").select("doc_id", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
