"""Personal data: exact patterns, and a linear-chain conditional random field that adds to them.

The field labels tokens (runs of letters, runs of digits, single signs) with O or the begin or
inside of a kind. Its features are word shapes of the token and its neighbours. It is trained on a
small labelled table of lines. Every token of every text is scored, in numpy batches; Viterbi then
decodes the stretches that a bound leaves open, which gives the labels that decoding all would give.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, slices, table, tune

#: Code points of texts whose tokens are scored at once; on the labelled lines that takes some 75 bytes for each.
CHUNK_CHARS = 1 << 18

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

# --- exact patterns -------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each at-sign, so a long run without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15 if kind == "phone" else True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind and start; failing matches are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


# --- the conditional random field -----------------------------------------------------------

_SPACE, _LETTERS, _DIGITS, _SIGN = range(4)
#: Words whose shape is the word itself.
WORDS = ("at", "dot", "com", "org", "net", "tel", "phone", "call", "mail", "card", "version", "v")
#: Codes of shapes: 1 to 17 a run of so many digits, then small letters, a capital and more, capitals, the words, signs.
_SMALL, _CAPITAL, _CAPITALS, _WORD, _OTHER = 18, 19, 20, 21, 64
_LONGEST = max(map(len, WORDS))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its class, whether it is a capital, whether a small letter."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kind = np.full(len(every), _SIGN, np.uint8)
    for pattern, k in ((r"\s+", _SPACE), (r"[^\W\d_]+", _LETTERS), (r"\d+", _DIGITS)):
        for m in re.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    return kind, np.array([c.isupper() for c in every]), np.array([c.islower() for c in every])


@dataclass
class Tokens:
    """Tokens of many texts: places in their text, its number, shape, and whether the token before touches."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    shape: np.ndarray
    glued: np.ndarray


def tokenize(texts: list[str]) -> Tokens:
    kind, capital, small = _tables()
    joined = "\n".join(texts)
    at = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    c = kind[at]
    run = (c == _LETTERS) | (c == _DIGITS)
    change = np.r_[True, c[1:] != c[:-1], True] if len(c) else np.zeros(1, bool)
    start = np.flatnonzero((c == _SIGN) | (run & change[:-1]))
    end = np.flatnonzero((c == _SIGN) | (run & change[1:])) + 1
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    row = np.searchsorted(first, start, "right") - 1
    ups, lows = (np.cumsum(np.r_[0, x[at]]) for x in (capital, small))
    own, length = c[start], end - start
    has_low, has_up = lows[end] > lows[start], ups[end] > ups[start]
    shape = np.where(has_up & ~has_low, _CAPITALS, np.where(capital[at[start]], _CAPITAL, _SMALL)).astype(np.int64)
    shape = np.where(own == _DIGITS, np.minimum(length, 17), np.where(own == _SIGN, _OTHER + at[start].astype(np.int64), shape))
    short = np.flatnonzero((own == _LETTERS) & (length <= _LONGEST))
    if len(short):
        spelled = np.zeros((len(short), _LONGEST), np.uint32)
        for i in range(_LONGEST):
            more = length[short] > i
            spelled[more, i] = at[start[short][more] + i]
        spelled[(spelled >= 65) & (spelled <= 90)] += 32
        key = spelled.astype(np.int64) @ (131 ** np.arange(_LONGEST))
        for k, w in enumerate(WORDS):
            letters = np.array([*map(ord, w), *[0] * (_LONGEST - len(w))])
            maybe = np.flatnonzero(key == letters @ (131 ** np.arange(_LONGEST)))
            shape[short[maybe[(spelled[maybe] == letters).all(axis=1)]]] = _WORD + k
    glued = np.zeros(len(start), bool)
    glued[1:] = (end[:-1] == start[1:]) & (row[:-1] == row[1:])
    return Tokens(start - first[row], end - first[row], row, shape, glued)


def features(t: Tokens, known: np.ndarray) -> np.ndarray:
    """Numbers of the five features of each token: its shape with those around it. `known` are the shapes that count, sorted.

    All others are one shape, the edges of a text are two more.
    """
    n, base = len(t.shape), len(known) + 3
    own = np.minimum(np.searchsorted(known, t.shape), max(len(known) - 1, 0))
    own = np.where(known[own] == t.shape, own, len(known)) if len(known) else np.zeros(n, np.int64)

    def beside(k: int) -> np.ndarray:
        out = np.full(n, base - 2 if k < 0 else base - 1)
        here = np.arange(max(0, -k), min(n, n - k)) if abs(k) < n else np.zeros(0, np.int64)
        same = here[t.row[here] == t.row[here + k]]
        out[same] = own[same + k]
        return out

    before2, before, after, after2 = (beside(k) for k in (-2, -1, 1, 2))
    g = t.glued.astype(np.int64)
    h = np.r_[g[1:], 0][:n]
    left, right = (before * 2 + g) * base + own, (own * 2 + h) * base + after
    return np.stack([own, left, right, before2 * base**3 * 2 + left, right * base + after2], axis=1) * 5 + np.arange(5)


@dataclass
class Field:
    known: np.ndarray  # shapes, sorted
    feature: np.ndarray  # numbers of features, sorted
    emit: np.ndarray  # [features, labels]; the last row is for features never met
    move: np.ndarray  # [labels, labels]; forbidden moves are very low
    begin: np.ndarray

    def scores(self, t: Tokens) -> np.ndarray:
        """[token, label]."""
        out = np.zeros((len(t.shape), len(LABELS)), self.emit.dtype)
        if len(out):
            for f in features(t, self.known).T:
                at = np.minimum(np.searchsorted(self.feature, f), len(self.feature) - 1)
                out += self.emit[np.where(self.feature[at] == f, at, len(self.feature))]
        return out

    def open(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether a token may be anything but O on the best path of its text.

        A stretch of other labels gains at most what its tokens' best other labels gain, and the best
        of the moves into, within and out of it. Where no stretch around a token gains anything, the
        token is O: with O for the whole stretch the path would be better.
        """
        within = max(self.move[1:, 1:].max() - self.move[0, 0], -1e3)
        edge = max(self.move[0, 1:].max() - self.move[0, 0], self.begin[1:].max() - self.begin[0]) + max(self.move[1:, 0].max() - self.move[0, 0], 0.0) - within
        gain = scores[:, 1:].max(axis=1).astype(np.float64) - scores[:, 0] + within
        cut = np.r_[False, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        place = np.arange(len(row)) + np.cumsum(cut)  # a bar of -1e4 stands between texts
        bars = np.full(len(row) + int(cut.sum()), -1e4)
        bars[place] = gain
        total = np.cumsum(bars)
        upto = total - np.minimum.accumulate(np.r_[0, total[:-1]])[: len(total)]
        back = np.cumsum(bars[::-1])
        on = (back - np.minimum.accumulate(np.r_[0, back[:-1]])[: len(back)])[::-1]
        return ((upto + on - bars)[place] + edge > -1e-6) if len(row) else cut

    def labels(self, t: Tokens) -> np.ndarray:
        """The best path of each text, token by token."""
        scores = self.scores(t)
        out = np.zeros(len(scores), np.int64)
        some = np.flatnonzero(self.open(scores, t.row))
        if not len(some):
            return out
        new = np.r_[True, (some[1:] != some[:-1] + 1) | (t.row[some[1:]] != t.row[some[:-1]])]
        first, last = some[new], some[np.r_[new[1:], True]]
        runs = []
        for a, b in zip(first.tolist(), last.tolist()):
            s = scores[a : b + 1].astype(np.float64)
            if a and t.row[a - 1] == t.row[a]:  # O stands before
                s[0] += self.move[0] - self.begin
            if b + 1 < len(out) and t.row[b + 1] == t.row[b]:  # and behind
                s[-1] += self.move[:, 0]
            runs.append(s)
        for a, b, y in zip(first.tolist(), last.tolist(), self.viterbi(runs)):
            out[a : b + 1] = y
        return out

    def viterbi(self, scores: list[np.ndarray], most: int = 256) -> list[np.ndarray]:
        """Best labels of each sequence; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
        order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            n = max(1, min(most, (1 << 16) // len(scores[order[at]])))
            group = order[at : at + n]
            at += n
            length = np.array([len(scores[i]) for i in group])
            best = np.zeros((len(group), length.max(), len(LABELS)))
            for k, i in enumerate(group):
                best[k, : length[k]] = scores[i]
            came = np.zeros(best.shape, np.int8)
            now = best[:, 0] + self.begin
            ends = [now]
            for t in range(1, best.shape[1]):
                step = now[:, :, None] + self.move
                came[:, t] = step.argmax(axis=1)
                now = step.max(axis=1) + best[:, t]
                ends.append(now)
            for k, i in enumerate(group):
                y = np.zeros(length[k], int)
                y[-1] = ends[length[k] - 1][k].argmax()
                for t in range(length[k] - 1, 0, -1):
                    y[t - 1] = came[k, t, y[t]]
                out[i] = y
        return out


def _forbidden() -> np.ndarray:
    no = np.zeros((len(LABELS), len(LABELS)), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            no[:, j] = [x[2:] != to[2:] for x in LABELS]
    return no


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by AdaGrad over forward-backward of all lines at once."""
    t = tokenize([text for text, _ in rows])
    known = np.unique(t.shape)
    codes = features(t, known)
    feature, which = np.unique(codes, return_inverse=True)
    which = which.reshape(codes.shape)
    label = np.zeros(len(t.row), np.int64)
    for r, (_, spans) in enumerate(rows):
        for kind, a, b in spans:
            own = np.flatnonzero((t.row == r) & (t.start >= a) & (t.end <= b))
            label[own] = LABELS.index(f"I-{kind}")
            label[own[:1]] = LABELS.index(f"B-{kind}")
    used, row = np.unique(t.row, return_inverse=True)  # lines with a token
    size = np.bincount(row, minlength=len(used))
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    n, length, k = len(used), int(size.max(initial=1)), len(LABELS)
    ids = np.full((n, length, 5), len(feature))
    mask = np.zeros((n, length), bool)
    truth = np.zeros((n, length), int)
    ids[row, place], mask[row, place], truth[row, place] = which, True, label
    no = _forbidden()
    start_no = np.array([x[0] == "I" for x in LABELS])
    emit, move, begin = np.zeros((len(feature) + 1, k)), np.zeros((k, k)), np.zeros(k)
    past = [np.full(x.shape, 1e-6) for x in (emit, move, begin)]
    onehot = np.eye(k)[truth] * mask[..., None]
    pairs = onehot[:, :-1, :, None] * onehot[:, 1:, None, :] * mask[:, 1:, None, None]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for _ in range(rounds if n else 0):
        m, b = np.where(no, -1e4, move), np.where(start_no, -1e4, begin)
        s = emit[ids].sum(axis=2)
        forth, back = np.zeros((n, length, k)), np.zeros((n, length, k))
        forth[:, 0] = s[:, 0] + b
        for t in range(1, length):
            forth[:, t] = np.where(mask[:, t, None], lse(forth[:, t - 1, :, None] + m, 1) + s[:, t], forth[:, t - 1])
        for t in range(length - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], lse(m + (s[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        z = lse(forth[:, -1], 1)
        p = np.exp(forth + back - z[:, None, None]) * mask[..., None]
        q = np.exp(forth[:, :-1, :, None] + m + (s[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        g = np.zeros_like(emit)
        np.add.at(g, ids.reshape(-1), np.repeat(((onehot - p) / n).reshape(-1, k), 5, axis=0))
        grads = [g - ridge * emit, (pairs - q).sum(axis=(0, 1)) / n - ridge * move, (onehot[:, 0] - p[:, 0]).sum(axis=0) / n - ridge * begin]
        for x, h, d in zip((emit, move, begin), past, grads):
            h += d * d
            x += rate * d / np.sqrt(h)
    emit[-1] = 0
    emit[-1, 0] = 0.5  # what was never met speaks for O
    return Field(known, feature, emit, np.where(no, -1e4, move), np.where(start_no, -1e4, begin))


def _acceptable(kind: str, s: str) -> bool:
    if kind == "email":
        return bool(re.search(r"@|\bat\b", s, re.I) and re.search(r"\.|\bdot\b", s, re.I) and re.search(r"[A-Za-z]{2,}\W*$", s))
    return valid(kind, s) and len(s) <= 40


def find(texts: list[str], field: Field, most: int = CHUNK_CHARS) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by kind and start: the exact ones, and the field's that meet none of them.

    Arrays are of about `most` code points of whole texts at a time; a longer text stands alone.
    """
    offsets = np.cumsum([0, *map(len, texts)])
    return [spans for a, b in chunks(offsets, most) for spans in _find(texts[a:b], field)]


def _find(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    every = [base_spans(t) for t in texts]
    t = tokenize(texts)
    labels = field.labels(t)
    inside = np.array([x[0] == "I" for x in LABELS])
    begins = np.flatnonzero((labels > 0) & ~inside[labels])
    for i in begins.tolist():
        kind, j, row = LABELS[labels[i]][2:], i + 1, int(t.row[i])
        while j < len(labels) and t.row[j] == row and LABELS[labels[j]] == f"I-{kind}":
            j += 1
        start, end = int(t.start[i]), int(t.end[j - 1])
        if _acceptable(kind, texts[row][start:end]) and all(end <= a or start >= b for _, a, b in every[row]):
            every[row].append((kind, start, end))
    return [sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])) for spans in every]


def labelled_lines() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: made-up lines in several layouts, personal data between {k:...} marks."""
    names = ["ana", "li.wei", "sam_k", "j.doe", "marta99", "tom-b"]
    lines = []
    for i, name in enumerate(names * 4):
        a, b, c, d = (i * 37) % 256, (i * 91 + 7) % 256, (i * 53 + 11) % 256, (i * 17 + 1) % 256
        p, q, r = 201 + i * 13 % 700, 100 + i * 29 % 800, 1000 + i * 317 % 8999
        stem = f"{4000 + i * 71 % 900:04d}{i * 1237 % 10000:04d}{i * 7919 % 10000:04d}{i * 271 % 1000:03d}"
        card = stem + str(next(x for x in range(10) if luhn(stem + str(x))))
        fours = [card[x : x + 4] for x in range(0, 16, 4)]
        lines += [
            f"Please write to {{email:{name}@mail{i}.example.com}} about it, the sooner the better.",
            f"or {{email:{name}@example.org}}.",
            f"reach me: {{email:{name} [at] example{i} [dot] com}} any time",
            f"contact {{email:{name}(at)example(dot)org}} for more of this",
            f"write to {{email:{name} [ at ] example{i} [ dot ] com}} for more",
            f"mail {{email:{name} (At) example (Dot) org}} please",
            f"reach {{email:{name} at example dot org}} any time",
            f"or {{email:{name} at mail dot example{i} dot com}}.",
            f"{{email:{name} at example{i} dot org}}",
            "look at the dot on the map, and at each dot of the line",
            "they were at a dot com company and looked at every single dot there",
            f"the host {{ip:{a}.{b}.{c}.{d}}} did not answer",
            f"seen from {{ip:{d}.{c}.{b}.{a}}}, then from {{ip:{c}.{a}.{d}.{b}}} again",
            f"paid with {{card:{card}}} at the door",
            f"card no. {{card:{' '.join(fours)}}} or {{card:{'-'.join(fours)}}}",
            f"charge {{card:{'.'.join(fours)}}} please",
            f"Call {{phone:+1 ({p}) {q}-{r}}} today",
            f"and {{phone:+44 20 {r} {r + 1}}} in the evening",
            f"tel. {{phone:({p}) {q}-{r}}} or {{phone:{p}-{q}-{r}}}",
            f"phone: {{phone:{p}.{q}.{r}}} is out of order",
            f"on 20{i % 30:02d}-0{i % 9 + 1}-1{i % 9} at {i % 24}:{q % 60:02d} the {i} of them met",
            f"version {i}.{i % 7}.{i % 3} of the list costs {p},{q}.{i:02d} in all",
            f"see page {q} of {r}, chapter {i % 20}, and table {i % 9}.{i % 5}",
            f"order {stem[:9]}{r} of {r} pieces, item {stem[:6]}",
            f"a number like {stem[:12]} says nothing and neither does {r}{q}{p}",
            f"Licensed under the Common License, Version {i % 4}.0.",
            f'token = "a{i}b{q}c{r}d{p}e{stem[:7]}f{i}" and hash {i}ab{q}cd{r}',
            "a line of plain words that has nothing in it at all, as most lines",
        ]
    out = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def training_table(spark: SparkSession) -> DataFrame:
    """(text, spans) as a table, to be added to or replaced."""
    return spark.createDataFrame([(t, [(k, a, b) for k, a, b in s]) for t, s in labelled_lines()], "text string, spans array<struct<kind:string,start:int,stop:int>>")


def fit(labelled: DataFrame, most: int = 5000) -> Field:
    """A field from a small labelled table (text, spans); more than `most` rows are refused."""
    rows = labelled.where("text is not null and spans is not null").orderBy("text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    return train([(r["text"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]]) for r in rows])


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """(doc_id, counts and digest of the exact spans, all spans, and the text with all spans masked).

    A null text counts as empty; a text of any length is labelled whole; repeated rows are alike; other
    columns of `docs` are left out, whatever their names; an empty table gives no rows. n_<kind> and base_sha256 are of the exact patterns alone; `spans`
    and `masked` also hold what the field adds, of which n_added is the number.
    """
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(field)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, digest, spans, added, masked = [], [], [], [], []
            for t, found in zip(texts, find(texts, held.value)):
                base = base_spans(t) if found else []
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digest.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(found))
                added.append(len(found) - len(base))
                masked.append(mask(t, found))
            counts = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(masked, pa.string())], names)

    schema = f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, masked string"
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans replaced by its first kind in angle brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """`docs`, same rows (repeated ones too) and columns, with the personal data in `text` masked; a null text stays null, an empty table empty."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(field)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = batch.column(at).to_pylist()
            found = find([t or "" for t in texts], held.value)
            clean = pa.array([t if not s else mask(t, s) for t, s in zip(texts, found)], pa.string())
            columns = list(batch.columns)
            columns[at] = clean
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    field = fit(training_table(spark))
    return detect(table(spark, sf_dir, "documents"), field).drop("masked")


def redact_documents(docs: DataFrame) -> DataFrame:
    """Every document, its personal data masked; n_chars, where there is one, follows the text.

    Rows that share a doc_id are masked each; null texts stay null; an empty table stays empty.
    """
    clean = redact(docs, fit(training_table(docs.sparkSession)))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)
