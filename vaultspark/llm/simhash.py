"""SimHash near-duplicates, linked through Golay-code fuzzy keys.

A 64-bit fingerprint is cut in four segments of 16 bits. Two fingerprints that differ in at most
three bits agree in one segment at least, and of the two halves of the other 48 bits one holds at
most one error. The first 23 bits of each half are decoded in the perfect binary Golay code
[23, 12, 7]: a word and its 23 neighbours decode to about six codewords, and a word with one error
decodes to one of them. So each fingerprint takes, for each of the eight (segment, half) patterns,
its own codeword index and those of its neighbours as keys, together with the exact segment; any
pair to be linked meets in one key, where the Hamming distance is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, release, skew_join, slices, table, text_bytes, tune
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3

# --- fingerprints ---------------------------------------------------------------------------


def fingerprint_words(tokens: list[bytes], n: int = SHINGLE) -> int:
    """The SimHash of one document's words: a bit is set if more than half the shingles set it."""
    k = len(tokens)
    if not k:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if k <= n:
        return digest(joined, SEED)
    begin = list(accumulate(map(len, tokens), lambda a, b: a + b + 1, initial=0))
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(begin, begin[n:])), np.uint64, k - n + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    on = counts * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs`' doc_id with `fp`, the fingerprint's 64 bits as a long. A null text counts as empty (0)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = text_bytes(part.column(1))
                whole = data.tobytes()
                fps = np.array([fingerprint_words(whole[a:b].lower().split(), shingle) for a, b in itertools.pairwise(offsets.tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


# --- the Golay code -------------------------------------------------------------------------

_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which divides x^23 - 1


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= _GENERATOR << (i - 11)
    return x


_SYNDROME_LOW = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
_SYNDROME_HIGH = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
_ERROR = np.zeros(1 << 11, np.int64)
for _w in range(1, 4):
    for _c in itertools.combinations(range(23), _w):
        _e = sum(1 << i for i in _c)
        _ERROR[_remainder(_e)] = _e


def golay_index(x: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word (at most three bits away)."""
    return (x ^ _ERROR[_SYNDROME_LOW[x & 0xFFF] ^ _SYNDROME_HIGH[x >> 12]]) >> 11


def golay_indices(x: np.ndarray) -> np.ndarray:
    """Indices to which each word and its 23 neighbours decode, a row each, repeats as -1 (first column: its own)."""
    near = np.stack([golay_index(x), *(golay_index(x ^ (1 << i)) for i in range(23))], axis=1)
    own = near[:, :1].copy()
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == own] = -1
    return np.concatenate([own, near], axis=1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fingerprints (uint64) and the row that each belongs to."""
    keys, rows = [], []
    for segment in range(4):
        low = fps & np.uint64((1 << 16 * segment) - 1)
        rest = (low | ((fps >> np.uint64(16 * segment + 16)) << np.uint64(16 * segment)) if segment < 3 else low).astype(np.int64)
        exact = (fps >> np.uint64(16 * segment) & np.uint64(0xFFFF)).astype(np.int64)
        for half in range(2):
            near = golay_indices(rest >> (24 * half) & 0x7FFFFF)
            row, col = np.nonzero(near >= 0)
            keys.append(((segment * 2 + half) << 28) | exact[row] << 12 | near[row, col])
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def finer_keys(fps: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the fingerprints, and the fingerprints, for each choice of three groups of `width` bits that are left out.

    Three differing bits stand in three groups at most, so any pair to be linked meets in a key; and
    no more than 2 ** (3 * width) fingerprints share one.
    """
    for k, removed in enumerate(itertools.combinations(range(64 // width), 3)):
        rest = fps
        for g in reversed(removed):
            at = np.uint64(g * width)
            low = rest & np.uint64((1 << g * width) - 1)
            rest = low | (rest >> at >> np.uint64(width) << at)
        yield rest.astype(np.int64) | k << (64 - 3 * width), fps


# --- links within one key -------------------------------------------------------------------

#: Fingerprints of one key that are compared with each other; those of a fuller key are dealt anew by finer
#: keys, which leave out bytes and at last nibbles. Of the latter no key has more than 4096.
RUN = 4096


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among one key's fingerprints: each is visited once."""
    out, rest = [], fps.copy()
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= DISTANCE
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out.append((np.full(len(found), x), found))
                queue.extend(found)
    return out


_NONE = np.zeros(0, np.int64)


def _run_links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links within each run of equal keys, and the fingerprints of runs longer than `most`. Those of a run are distinct."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else _NONE
    size = np.diff(np.r_[first, len(keys)])
    out, full = [], [np.zeros(0, np.uint64)]
    for n in range(2, 9):  # small runs, all of one size at once
        at = first[size == n]
        for i, j in itertools.combinations(range(n), 2) if len(at) else ():
            a, b = fps[at + i], fps[at + j]
            good = np.bitwise_count(a ^ b) <= DISTANCE
            out.append((a[good], b[good]))
    for at, n in zip(first[size > 8], size[size > 8]):
        if n > most:
            full.append(fps[at : at + n])
        else:
            out += _forest(fps[at : at + n])
    return out, np.concatenate(full)


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the keys of rows (key, fp) that come sorted by key; rows (fp, null) for those of full keys.

    Holds `most` rows of a key and a batch at most: the rest of a full key passes through.
    """

    def made(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs, full = _run_links(keys, fps.view(np.uint64), most)
        yield from passed(full.view(np.int64))
        if pairs:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def passed(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fps):
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64())], ["a", "b"])

    keys, fps, full = [_NONE], [_NONE], None
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if full is not None:
            n = int(np.searchsorted(k, full, "right"))
            yield from passed(f[:n])
            k, f, full = k[n:], f[n:], full if n == len(k) else None
        keys.append(k)
        fps.append(f)
        if sum(map(len, keys)) >= 1 << 16:
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(k, k[-1]))
            yield from made(k[:cut], f[:cut])
            keys, fps = [k[cut:]], [f[cut:]]
            if len(keys[0]) > most:
                yield from passed(fps[0])
                keys, fps, full = [_NONE], [_NONE], k[-1]
    yield from made(np.concatenate(keys), np.concatenate(fps))


def _dealt(distinct: DataFrame, keyed, n: int, most: int) -> DataFrame:
    rows = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _linked(batches, most), "a long, b long")


def links(distinct: DataFrame, partitions: int | None = None) -> tuple[DataFrame, list[str]]:
    """(a, b): links among the distinct fingerprints `fp` that join all pairs at three or fewer bits; and its tables.

    Not every such pair is listed where many share a key: a spanning forest of them is, so the
    components are those of all pairs and the rows stay in proportion to the fingerprints.
    """

    def fuzzy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys, rows = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    def finer(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, fps in finer_keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), width):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64))], ["key", "fp"])

        return run

    n = partitions or int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, path = materialize(_dealt(distinct, fuzzy, n, RUN).distinct(), "links")
    out, paths = found.where("b is not null"), [path]
    for width in (8, 4):
        full = found.where("b is null").select(F.col("a").alias("fp"))
        if full.isEmpty():
            break
        found, path = materialize(_dealt(full, finer(width), n, RUN if width > 4 else 1 << 12).distinct(), "links")
        out = out.unionByName(found.where("b is not null"))
        paths.append(path)
    return out, paths


# --- the operator ---------------------------------------------------------------------------


def _rooted(fps: DataFrame) -> DataFrame:
    """(fp, root, least): each fingerprint, one of its component, and the smallest doc_id that has it."""
    spark = fps.sparkSession
    distinct, at_distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found, at_links = links(distinct)
    roots, at_roots = connected_components(found)
    rooted, _ = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    release(spark, at_distinct, at_roots, *at_links)
    return rooted


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of `docs`.

    component_id is the smallest doc_id reachable over links of three or fewer differing bits.
    A null or wordless text has fingerprint zero and links like any other; repeated rows are kept
    and link to each other; a null doc_id is kept and never is the smallest (its component_id is
    null if no document of the component has an id). Other columns of `docs` are left out.
    """
    fps, _ = materialize(fingerprints(docs, text, shingle), "fingerprints")
    rooted = _rooted(fps)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component, _ = materialize(skew_join(rooted, least, "root").select("fp", "component_id"), "components")
    return skew_join(fps, component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component: the row of its smallest doc_id; a row without id is kept.

    Where that id is repeated in the component, one of its rows stays (that of the smallest text
    hash); where it is repeated in another component, each component keeps its own row. Null and
    wordless texts are near-duplicates of each other. Columns stay as they are, whatever their names;
    an empty table stays empty.
    """
    names, of_text = docs.columns, fresh(docs, "text_hash")
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash")))
    fps, path = materialize(fingerprints(docs.select(key.alias("doc_id"), "text")), "fingerprints")
    least = _rooted(fps).groupBy("root").agg(F.min("least").alias("least"))
    keep = least.where("least is not null").select(F.col("least.id").alias("doc_id"), F.col("least.text_hash").alias(of_text))
    release(docs.sparkSession, path)
    kept = docs.withColumn(of_text, F.xxhash64("text")).join(keep, ["doc_id", of_text], "left_semi").dropDuplicates(["doc_id", of_text])
    return kept.select(names).unionByName(docs.where("doc_id is null").select(names))
