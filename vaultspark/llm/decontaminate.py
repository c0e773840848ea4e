"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are a query set, held by every worker in blocks of bounded size. At each word of an
item the seed is the shortest n-gram that chance alone would hardly put in the corpus: its words'
information, by their frequency in the whole corpus, exceeds that of the corpus' length. A passage
that shares a seed with an item is aligned with it, word by word, so edits, insertions and losses
around the seed count as what they are. An item without such a seed is searched for verbatim.
Documents are never shuffled.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_spans, lower_ascii, ngram_hashes, table, text_bytes, tune, words

_log = logging.getLogger(__name__)

MATCH, MISMATCH, GAP = 2, -1, -1
#: A leak scores at least half of what the whole item would, or as much as this many equal words.
SHARE, ENOUGH = 0.5, 13
#: Lengths of seeds, and the bits by which a seed must be rarer than one place in the corpus.
SEED_WORDS = range(2, 9)
MARGIN_BITS = 3.0
#: Bound of one broadcast block of test items, in words (16 bytes or so each).
BLOCK_WORDS = 1_000_000

_DROP = np.zeros(256, bool)
_DROP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


#: By the first two bytes of a character, whether its script is written without spaces: Thai, Lao,
#: Tibetan; Myanmar; Khmer; radicals; Kana, Bopomofo, Han; compatibility Han; full-width forms; more Han.
_UNSPACED = np.zeros(1 << 16, bool)
for _first, _last in ((0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE2BA, 0xE2BF), (0xE380, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBF), (0xF0A0, 0xF0B3)):
    _UNSPACED[_first : _last + 1] = True


def unspaced_cuts(data: np.ndarray) -> np.ndarray:
    """Places before and after each character of a script without spaces."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return at
    code = data[at].astype(np.int64) << 8 | data[at + 1]
    at = at[_UNSPACED[code] & ~((code == 0xE182) & (data[at + 2] >= 0xA0))]  # Georgian begins there
    return np.unique(np.concatenate([at, at + 3 + (data[at] >= 0xF0)]))


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, lower-cased and without ASCII punctuation, and how many each row has.

    Each character of a script without spaces is a word.
    """
    starts, ends, n = words(data, offsets)
    cuts = unspaced_cuts(data)
    if len(cuts):
        own = np.searchsorted(starts, cuts, "right") - 1
        cuts = cuts[(own >= 0) & (cuts > starts[own]) & (cuts < ends[own])]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        n = np.diff(np.searchsorted(starts, offsets))
    low = lower_ascii(data)
    if len(low) > 1:  # capital letters of Latin-1
        low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    keep = ~_DROP[low]
    before = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    s, e = before[starts], before[ends]
    some = e > s
    row = np.repeat(np.arange(len(n)), n)[some]
    return hash_spans(low[keep], s[some], e[some]), np.bincount(row, minlength=len(n))


@dataclass
class Items:
    """A block of test items: their words, one after another, their seeds, and whole items without one."""

    ids: list
    word: np.ndarray
    offsets: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, their places in `word`, a bitmap
    exact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # the same of items without a seed: the item, or ENOUGH words of it
    seedless: int  # number of those items

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `h` and in `word` where the same seed begins, or an item without one stands in a row of `bounds`."""
        here, there = self._meet(self.seeds, h)
        if self.exact:
            at, place = self._meet(self.exact, h, bounds)
            row, item = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(self.offsets, place, "right") - 1
            whole = np.diff(self.offsets)[item] <= ENOUGH  # all alike, so a row's first is enough
            order = np.lexsort((at, item, row))
            order = order[whole[order]]
            new = np.r_[True, (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])][: len(order)]
            taken = np.concatenate([np.flatnonzero(~whole), order[new]])
            here, there = np.concatenate([here, at[taken]]), np.concatenate([there, place[taken]])
        return here, there

    @staticmethod
    def _meet(seeds: dict, h: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of `seeds` in `h` and in `word`; with `bounds` only those within a row."""
        here, there = [], []
        for n, (seed, place, bitmap) in seeds.items():
            g = ngram_hashes(h, n)
            at = np.flatnonzero(bitmap[(g & np.uint64(len(bitmap) - 1)).astype(np.int64)])
            if bounds is not None:
                at = at[at + n <= bounds[np.searchsorted(bounds, at, "right")]]
            first, last = np.searchsorted(seed, g[at], "left"), np.searchsorted(seed, g[at], "right")
            size = last - first
            if size.sum():
                here.append(np.repeat(at, size))
                run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                there.append(place[np.repeat(first, size) + run])
        if not here:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(here), np.concatenate(there)


def build(ids: list, texts: list[str], counts: dict[int, int], corpus_words: int) -> Items:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    word, n = normal_words(data, offsets)
    bounds = np.concatenate([[0], np.cumsum(n)])
    need = np.log2(max(corpus_words, 2)) + MARGIN_BITS
    bits = np.array([np.log2(max(corpus_words, 2)) - np.log2(counts.get(int(h), 0) + 1) for h in word])
    total = np.concatenate([[0.0], np.cumsum(bits)])
    end = np.repeat(bounds[1:], n)
    at = np.arange(len(word))
    open_, seeds, exact = np.ones(len(word), bool), {}, {}

    def table_of(size: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = ngram_hashes(word, size)[place]
        order = np.argsort(g, kind="stable")
        bitmap = np.zeros(1 << max(16, int(len(place) * 16).bit_length()), bool)
        bitmap[(g & np.uint64(len(bitmap) - 1)).astype(np.int64)] = True
        return g[order], place[order], bitmap

    for size in SEED_WORDS:
        fits = open_ & (at + size <= end)
        fits &= np.where(fits, total[np.minimum(at + size, len(word))] - total[at] >= need, False)
        open_ &= ~fits
        place = np.flatnonzero(fits)
        if len(place):
            seeds[size] = table_of(size, place)
    bare = np.bincount(np.repeat(np.arange(len(n)), n)[~open_], minlength=len(n)) == 0
    bare &= n > 0
    length = np.repeat(np.where(bare, np.minimum(n, ENOUGH), 0), n)
    for size in np.unique(length[length > 0]).tolist():
        exact[size] = table_of(size, np.flatnonzero((length == size) & (at + size <= end)))
    return Items(ids, word, bounds, seeds, exact, int(bare.sum()))


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each item and window, and the place in the window where it ends (exclusive)."""
    rows, cols = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), rows), np.uint64), np.zeros((len(items), cols), np.uint64)
    real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, : len(x)], b[k, : len(y)] = x, y
        real_a[k, : len(x)], real_b[k, : len(y)] = True, True
    h = np.zeros((len(items), cols + 1), np.int32)
    best, where = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    slope = np.arange(cols, dtype=np.int32) * -GAP
    for i in range(rows):
        same = (b == a[:, i, None]) & real_b & real_a[:, i, None]
        t = np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH), h[:, 1:] + GAP)
        t = np.maximum(t, 0).astype(np.int32)
        t = np.maximum.accumulate(t + slope, axis=1) - slope
        h[:, 1:] = t
        top = t.max(axis=1)
        more = top > best
        best[more], where[more] = top[more], t[more].argmax(axis=1) + 1
    return best, where


def align(h: np.ndarray, n: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, score, word in the row where it ends) of every leak among rows of words `h`, `n` to a row."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    here, there = items.hits(h, bounds)
    if not len(here):
        return []
    row = np.searchsorted(bounds, here, "right") - 1
    item = np.searchsorted(items.offsets, there, "right") - 1
    diagonal = here - bounds[row] - (there - items.offsets[item])
    places = np.unique(np.stack([row, item, diagonal >> 3], axis=1), axis=0)
    length = np.diff(items.offsets)[places[:, 1]]
    places = places[np.argsort(length, kind="stable")]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    at = 0
    while at < len(places):
        size = int(items.offsets[places[at, 1] + 1] - items.offsets[places[at, 1]])
        group = places[at : at + max(1, (1 << 17) // (2 * size + 32))]
        at += len(group)
        own, windows, begin = [], [], []
        for r, i, d in group.tolist():
            x = items.word[items.offsets[i] : items.offsets[i + 1]]
            pad = len(x) // 4 + 8
            start = max(bounds[r], bounds[r] + d * 8 - pad)
            own.append(x)
            windows.append(h[start : min(bounds[r + 1], bounds[r] + d * 8 + 8 + len(x) + pad)])
            begin.append(start - bounds[r])
        score, where = smith_waterman(own, windows)
        for (r, i, _), s, w, f, x in zip(group.tolist(), score.tolist(), where.tolist(), begin, own):
            if s >= MATCH * min(SHARE * len(x), ENOUGH) and s > best.get((r, i), (0, 0))[0]:
                best[r, i] = (s, int(f + w))
    return [(r, i, s, w) for (r, i), (s, w) in sorted(best.items())]


def leaks_of(column: pa.Array, items: Items) -> list[tuple[int, int, int, int]]:
    data, offsets = text_bytes(column)
    out = []
    for a, b in chunks(offsets):
        h, n = normal_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out += [(r + a, i, s, w) for r, i, s, w in align(h, n, items)]
    return out


# --- over tables ----------------------------------------------------------------------------


def word_counts(docs: DataFrame, text: str, wanted: np.ndarray) -> tuple[dict[int, int], int]:
    """How often each wanted word stands in all documents, and the number of words in all."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(np.sort(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held.value
        bitmap = np.zeros(1 << max(16, int(len(mine) * 16).bit_length()), bool)
        low = np.uint64(len(bitmap) - 1)
        bitmap[(mine & low).astype(np.int64)] = True
        count, total = np.zeros(len(mine), np.int64), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                h, _ = normal_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total += len(h)
                h = h[bitmap[(h & low).astype(np.int64)]]
                if len(mine) and len(h):
                    at = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
                    count += np.bincount(at[mine[at] == h], minlength=len(mine))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[mine[met].view(np.int64), 0]), pa.array(np.r_[count[met], 0]), pa.array(np.r_[np.zeros(len(met), np.int64), total])], ["word", "n", "total"])

    rows = docs.select(text).mapInArrow(run, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    return {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows if r["n"]}, sum(r["total"] for r in rows)


def blocks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Iterator[Items]:
    """The test items with text, in blocks of about BLOCK_WORDS words."""
    spark = docs.sparkSession
    tune(spark)
    asked = benchmark.where("text is not null").select("item_id", "text").distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(size // (4 * BLOCK_WORDS)) + 1
    for k in range(n):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if not rows:
            continue
        texts = [r["text"] for r in rows]
        wanted = np.unique(normal_words(*text_bytes(pa.array(texts, pa.string())))[0])
        counts, total = word_counts(docs, text, wanted)
        items = build([r["item_id"] for r in rows], texts, counts, total)
        if items.seedless:
            _log.warning("%d of %d test items have no seed rarer than chance; they are searched for verbatim", items.seedless, len(items.ids))
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, share, word_end): each document and test item that it holds a copy of.

    score is the best alignment's (2 a match, -1 a mismatch or gap), share that of the highest
    possible, word_end the word of the text where the copy ends. Null and empty texts and items
    hold and match nothing; repeated rows give one pair. Items too short or too common to have a
    seed are found where they stand verbatim (of longer ones, 13 words in a row), edited copies of
    them are not; their number is logged. A character of a script without spaces counts as a word.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, score int, share double, word_end long"
    found = spark.createDataFrame([], schema)
    for items in blocks(docs, benchmark, text):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = held.value
            length = np.diff(m.offsets)
            for batch in batches:
                leaks = leaks_of(batch.column(1), m)
                if leaks:
                    r, i, s, w = map(list, zip(*leaks))
                    names = pa.array([m.ids[x] for x in i], batch_type)
                    share = np.array(s) / (MATCH * length[i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), names, pa.array(s, pa.int32()), pa.array(share), pa.array(w, pa.int64())], ["doc_id", "item_id", "score", "share", "word_end"])

        from pyspark.sql.pandas.types import to_arrow_type

        batch_type = to_arrow_type(item_type)
        found = found.unionByName(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "share", "word_end")).alias("x")).select("doc_id", "item_id", "x.*")


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a copy of a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no copy of a test item; same columns, whatever their names, no shuffle.

    Each row is judged by its own text, so rows that share a doc_id, or have none, stay or go apart;
    null and empty texts stay; an empty table stays empty.
    """
    spark, clean, at = docs.sparkSession, docs, docs.columns.index(text)
    for items in blocks(docs, benchmark, text):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in leaks_of(batch.column(at), held.value)]] = False
                yield batch.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean
