"""Byte-level BPE by merge replay over the distinct pieces of a batch of texts.

The distinct pieces of a batch of texts are laid out as one row of symbols. An inverted index leads
from each mergeable token pair, by its rank, to the positions where it stands; the ranks are then
applied in order to all pieces at once, and a merge touches the index for its two neighbours only.
Every text is put together from its pieces' tokens. Texts never meet, so nothing is shuffled, and a
worker keeps a table of pieces it has met. Batches and that table are bounded in bytes; the index
takes some fifty bytes for each byte of the pieces that are laid out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, tune

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of texts that are laid out together; a longer text is by itself.
BATCH_BYTES = 1 << 20
#: Pieces remembered by a worker, and their bytes: twice as much at most. A longer piece is not remembered for long.
REMEMBERED = 250_000
REMEMBERED_BYTES = 4 << 20


def splitter(pattern: str) -> regex.Pattern:
    """The piece pattern with white space as Unicode has it, as the rank files' library reads it."""
    pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(pattern)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.merged: dict[int, int] = {}  # left id << 32 | right id: rank
        self.pair = np.full((256, 256), -1, np.int32)  # rank of two bytes
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.merged[a << 32 | b] = rank
            if len(token) == 2:
                self.pair[token[0], token[1]] = rank

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece: all merges applied in rank order over all pieces together."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(data)
        follows = np.arange(1, n + 1, dtype=np.int32)
        follows[ends - 1] = -1
        precedes = np.arange(-1, n - 1, dtype=np.int32)
        precedes[np.r_[0, ends[:-1]]] = -1
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.pair[data[:-1], data[1:]]
        ranks[ends - 1] = -1
        places = np.flatnonzero(ranks >= 0).astype(np.int32)
        places = places[np.argsort(ranks[places], kind="stable")]
        found, first = np.unique(ranks[places], return_index=True)
        bounds, every = [*first.tolist(), len(places)], array("i", places.tobytes())
        #: The inverted index: of each rank, where its pairs stand.
        index = {r: every[bounds[k] : bounds[k + 1]] for k, r in enumerate(found.tolist())}
        sym, after, before = (array("i", x.tobytes()) for x in (self.byte[data], follows, precedes))
        piece = array("i", np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(np.r_[0, ends])).tobytes())
        del every, follows, precedes, ranks, places
        merged, push = self.merged.get, heapq.heappush
        heap = sorted(index)
        while heap:
            rank = heapq.heappop(heap)
            here = sorted(index.pop(rank))
            waiting = -1  # a piece in which a merge just made a pair that goes first
            for i in here:
                j = after[i]
                if j < 0 or sym[i] < 0 or merged(sym[i] << 32 | sym[j]) != rank:
                    continue
                if piece[i] == waiting:
                    if rank in index:
                        index[rank].append(i)
                    else:
                        index[rank] = array("i", (i,))
                        push(heap, rank)
                    continue
                k, h = after[j], before[i]
                sym[i], sym[j] = rank, -1
                after[i] = k
                if k >= 0:
                    before[k] = i
                    r = merged(rank << 32 | sym[k])
                    if r is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = array("i", (i,))
                            push(heap, r)
                        if r <= rank:
                            waiting = piece[i]
                if h >= 0:
                    r = merged(sym[h] << 32 | rank)
                    if r is not None:
                        if r in index:
                            index[r].append(h)
                        else:
                            index[r] = array("i", (h,))
                            push(heap, r)
                        if r <= rank:
                            waiting = piece[i]
        left = np.frombuffer(sym, np.int32)
        alive = np.flatnonzero(left >= 0)
        cuts = np.searchsorted(alive, ends).tolist()
        ids = left[alive].tolist()
        return [ids[a:b] for a, b in itertools.pairwise([0, *cuts])]


#: Texts of these characters only are split alike by the standard library's faster engine: letters
#: are what is alphanumeric but no digit, and white space is the same.
_UNLIKE = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\x00-\u024f]")


class Encoder:
    """Encodes batches of texts; remembers a bounded number of pieces."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.any = splitter(pattern).findall
        plain = pattern.replace(r"\p{L}+", r"[^\W\d_]+").replace(r"\p{N}+", r"\d+").replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")
        self.plain = re.compile(plain).findall if r"\p" not in plain else self.any
        self.remembered, self.size = remembered, 0
        self.young: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # a piece's ids in decimal; their bytes
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def split(self, text: str) -> list[str]:
        return self.any(text) if _UNLIKE.search(text) else self.plain(text)

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Pieces of each text, all of which are then known."""
        split = [self.split(t) for t in texts]
        if len(self.young[0]) > self.remembered or self.size > REMEMBERED_BYTES:
            self.old, self.young, self.size = self.young, ({}, {}), 0
        decimal, decoded = self.young
        fresh = []
        for w in set(itertools.chain.from_iterable(split)).difference(decimal):
            if (known := self.old[0].get(w)) is not None:
                decimal[w], decoded[w] = known, self.old[1][w]
            else:
                fresh.append(w)
        whole, token = self.vocabulary.ranks, self.vocabulary.token
        coded = [w.encode() for w in fresh]
        rest = [w for w in coded if w not in whole]
        replayed = iter(self.vocabulary.replay(rest))
        for w, c in zip(fresh, coded):
            ids = [whole[c]] if c in whole else next(replayed)
            decimal[w] = ",".join(map(str, ids)).encode()
            decoded[w] = b"".join([token[x] for x in ids])
            self.size += len(c)
        return split

    def ids(self, pieces: list[str]) -> np.ndarray:
        decimal = self.decimal(pieces)
        return np.fromstring(decimal, np.int32, sep=",") if decimal else np.zeros(0, np.int32)

    def decimal(self, pieces: list[str]) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self.young[0].__getitem__, pieces))

    def decoded(self, pieces: list[str]) -> bytes:
        """The bytes of the ids' tokens."""
        return b"".join(map(self.young[1].__getitem__, pieces))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _paths(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", out: str = "token_ids", path: str | None = None, pattern: str | None = None, digest: str | None = None) -> DataFrame:
    """`docs` (all its columns) with `out`, the text's token ids; a null text is an empty one.

    A column of that name is replaced, any others stay. Texts are encoded whole, however long;
    repeated rows are encoded alike; an empty table gives no rows.

    `digest` names a column for the SHA-256 of the bytes that the ids decode to, if it is wanted.
    """
    tune(docs.sparkSession)
    path, pattern = _paths(path, pattern)
    kept = docs.drop(out, *[digest] * bool(digest))
    names = kept.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, pattern)
        for batch in (part for whole in batches for part in slices(whole, at, BATCH_BYTES)):
            split = coder.pieces([t or "" for t in batch.column(at).to_pylist()])
            ids = [coder.ids(p) for p in split]
            more = [pa.array([hashlib.sha256(coder.decoded(p)).hexdigest() for p in split], pa.string())] if digest else []
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *more], [*names, out, *[digest] * bool(digest)])

    schema = kept.withColumns({out: F.array(F.lit(1)), **({digest: F.lit("")} if digest else {})}).schema
    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """`coded` (all its columns) with `out`, the text of the token ids (bytes that are no UTF-8 replaced)."""
    tune(coded.sparkSession)
    path, pattern = _paths(path, None)
    kept = coded.drop(out)
    names = kept.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _encoder(path, pattern).vocabulary.token
        for batch in batches:
            texts = [None if x is None else b"".join([token[i] for i in x]).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    schema = kept.withColumn(out, F.lit("")).schema
    schema[out].nullable = True
    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; a null text is an empty one.

    Texts are encoded whole, however long; repeated rows give equal ones, a null doc_id stays; other
    columns are left out, whatever their names; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    path, pattern = _paths(path, pattern)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, pattern)
        for batch in (part for whole in batches for part in slices(whole, 1, BATCH_BYTES)):
            n, ids, back = [], [], []
            for pieces in coder.pieces([t or "" for t in batch.column(1).to_pylist()]):
                decimal = coder.decimal(pieces)
                n.append(decimal.count(b",") + 1 if decimal else 0)
                ids.append(hashlib.sha256(decimal).hexdigest())
                back.append(hashlib.sha256(coder.decoded(pieces)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, token_ids and decoded_sha256, the digest of the bytes that the ids decode to."""
    return encode(docs, text, "token_ids", digest="decoded_sha256").withColumn("n_tokens", F.size("token_ids").cast("long"))


def op8(spark, sf_dir: str) -> DataFrame:
    """The digests of every document."""
    return digests(table(spark, sf_dir, "documents"))
