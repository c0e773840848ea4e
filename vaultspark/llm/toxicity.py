"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are rates and densities of one text: hits of a fixed and of a learned lexicon of
words and word beginnings (which catch compounds and inflections), their nearness to second-person words, capitals, punctuation and obfuscation. Words are read with
punctuation dropped and look-alike digits turned into letters, so `1d.i0t!` counts as `idiot`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, hash_spans, table, text_bytes, tune, word_hash, words

#: Bounds of the labelled sample that is fitted on, the first rows by hash of the id: rows, and bytes of whole texts.
SAMPLE = 8000
SAMPLE_BYTES = 64 << 20
LEXICON = "abuse bastard clown creep crap damn disgusting dumb fool garbage hate idiot jerk kill liar loser moron pathetic pig scum shame shut stupid trash ugly vermin worthless".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros su".split()
NEAR = 6
FEATURES = ["log_words", "fixed_density", "fixed_count", "learned_density", "learned_count", "learned_top", "stem_density", "stem_count", "near_second", "second_density", "capitals", "capital_words", "exclaims", "questions", "punctuation", "obfuscated", "obfuscated_hits", "digits"]
#: Features of which more never speaks for a clean text.
RISING = [FEATURES.index(x) for x in ("fixed_density", "fixed_count", "learned_density", "learned_count", "learned_top", "stem_density", "stem_count", "near_second", "obfuscated_hits")]
#: Lengths in bytes of the word beginnings that are looked up.
STEMS = (4, 5, 6, 7, 8)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOOK = np.zeros(256, np.uint8)  # letters as themselves, lower-cased; look-alikes as letters; the rest is dropped
_LOOK[_LETTER] = np.arange(256, dtype=np.uint8)[_LETTER]
_LOOK[65:91] += 32
for _a, _b in zip("013457@$", "oieastas"):
    _LOOK[ord(_a)] = ord(_b)
_ALIKE = (_LOOK > 0) & ~_LETTER
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _counts(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: hash of its normal form, those of its beginnings (0 where it is no longer), whether
    it is obfuscated, whether in capitals; and the words of each row."""
    starts, ends, n = words(data, offsets)
    look = _LOOK[data]
    kept = _counts(look > 0)
    small = look[look > 0]
    s, e = kept[starts], kept[ends]
    s, e = s.astype(np.int64), e.astype(np.int64)
    h = hash_spans(small, s, e)
    stems = []
    for n_bytes in STEMS:
        longer = np.flatnonzero(e - s > n_bytes)
        stem = np.zeros(len(h), np.uint64)
        stem[longer] = hash_spans(small, s[longer], s[longer] + n_bytes)
        stems.append(stem)
    letters, alike, punct, upper = (_counts(m[data]) for m in (_LETTER, _ALIKE, _PUNCT, _UPPER))
    inner = punct[np.maximum(ends - 1, starts)] - punct[np.minimum(starts + 1, ends)]  # between the word's ends
    n_letters = letters[ends] - letters[starts]
    odd = (n_letters > 0) & ((alike[ends] - alike[starts] > 0) | (inner > 0))
    caps = (n_letters > 1) & (upper[ends] - upper[starts] == n_letters)
    return h, stems, odd, caps, n


@dataclass
class Lexicons:
    fixed: np.ndarray
    second: np.ndarray
    learned: np.ndarray  # sorted hashes
    weight: np.ndarray
    stem: np.ndarray
    stem_weight: np.ndarray


def _in(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return sorted_hashes[at] == h, at


def features(data: np.ndarray, offsets: np.ndarray, lex: Lexicons) -> np.ndarray:
    """One row of FEATURES for each text; zeros for a text without words."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)), np.float32)
    for a, b in chunks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        h, stems, odd, caps, n = tokens(part, own)
        row = np.repeat(np.arange(b - a), n)
        total = np.maximum(n, 1)

        def per(values: np.ndarray) -> np.ndarray:
            return np.bincount(row, values, b - a)

        fixed, _ = _in(lex.fixed, h)
        second, _ = _in(lex.second, h)
        learned, at = _in(lex.learned, h)
        weight = np.where(learned, lex.weight[at] if len(lex.weight) else 0.0, 0.0)
        stemmed = np.zeros(len(h))
        for stem in stems if len(lex.stem) else ():
            found, where = _in(lex.stem, stem)
            stemmed = np.maximum(stemmed, np.where(found, lex.stem_weight[where], 0.0))
        hit = fixed | learned | (stemmed > 0)
        top = np.zeros(b - a)
        np.maximum.at(top, row[learned], weight[learned])
        spot, you = np.flatnonzero(hit), np.flatnonzero(second)
        near = np.zeros(len(h), bool)
        if len(you) and len(spot):
            k = np.searchsorted(you, spot)
            for other in (you[np.minimum(k, len(you) - 1)], you[np.maximum(k - 1, 0)]):
                good = (np.abs(other - spot) <= NEAR) & (row[other] == row[spot])
                near[spot[good]] = True
        byte = {k: np.diff(_counts(m)[own]) for k, m in (("letters", _LETTER[part]), ("upper", _UPPER[part]), ("!", part == 33), ("?", part == 63), ("punct", _PUNCT[part]), ("digit", (part >= 48) & (part < 58)))}
        size = np.maximum(np.diff(own), 1)
        fixed_n, learned_n = per(fixed), per(learned)
        out[a:b] = np.stack([np.log1p(n), fixed_n / total, np.log1p(fixed_n), per(weight) / total, np.log1p(learned_n), top, per(stemmed) / total, np.log1p(per(stemmed > 0)), per(near) / total, per(second) / total, byte["upper"] / np.maximum(byte["letters"], 1), per(caps) / total, byte["!"] / size, byte["?"] / size, byte["punct"] / size, per(odd) / total, np.log1p(per(odd & hit)), byte["digit"] / size], axis=1)
    return out


# --- trees and calibration ------------------------------------------------------------------


@dataclass
class Trees:
    """Complete trees of one depth: split feature and threshold of each node, value of each leaf."""

    depth: int = 3
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 1.0, rising: list[int] | None = None) -> Trees:
    """Newton boosting of logistic loss over quantile bins.

    A split leaves second derivatives of `least` on either side, and none on a `rising` feature
    lowers the score of the larger values.
    """
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, bins))) for c in x.T]
    cuts = [np.unique(np.r_[c.min() / 2 if c.min() > 0 else 0, (c[1:] + c[:-1]) / 2]).astype(np.float32) for c in cuts]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])  # v > cut[k] if and only if bin > k
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        n_inner = 2**depth - 1
        feat, thr = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            chosen = np.zeros(width, np.int64)
            for k, cut in enumerate(cuts):
                m = len(cut) + 1
                key = (node - first) * m + binned[k]
                sums = [np.bincount(key, v, width * m).reshape(width, m) for v in (g, h)]
                left = [s.cumsum(axis=1)[:, :-1] for s in sums]
                whole = [s.sum(axis=1, keepdims=True) for s in sums]
                gain = left[0] ** 2 / (left[1] + ridge) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                right = [w - x for w, x in zip(whole, left)]
                ok = (left[1] >= least) & (right[1] >= least)
                if k in (rising or ()):
                    ok &= left[0] / (left[1] + ridge) >= right[0] / (right[1] + ridge)
                gain = np.where(ok, gain, -np.inf)
                if gain.shape[1]:
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best[better], chosen[better] = value[better], top[better]
                    feat[first : first + width][better] = k
                    thr[first : first + width][better] = cut[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feat[node]] > thr[node])
        leaves = node - n_inner
        value = -rate * np.bincount(leaves, g, n_inner + 1) / (np.bincount(leaves, h, n_inner + 1) + ridge)
        margin += value[leaves]
        model.feature.append(feat)
        model.threshold.append(thr)
        model.leaf.append(value)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots of the non-decreasing fit, for linear interpolation."""
    order = np.argsort(score, kind="stable")
    s, first = np.unique(score[order], return_index=True)
    total, weight = np.add.reduceat(y[order].astype(float), first), np.diff(np.r_[first, len(y)]).astype(float)
    blocks: list[list[float]] = []  # sum, weight, lowest and highest score
    for v, w, x in zip(total, weight, s):
        blocks.append([v, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, w2, _, high = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += w2
            blocks[-1][3] = high
    return np.array([x for b in blocks for x in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicons: Lexicons
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(features(data, offsets, self.lexicons))
        return np.clip(np.interp(margin, *self.knots), 0, 1) if len(self.knots[0]) else 1 / (1 + np.exp(-margin))


def _hashes(names: list[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in names], np.uint64))


def learn_lexicon(texts: list[str], y: np.ndarray, most: int = 300) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words, then of word beginnings, that mark the label, and their log odds."""
    seen: list[dict[int, np.ndarray]] = [{}, {}]
    for text, label in zip(texts, y):
        data = np.frombuffer(text.encode(), np.uint8)
        h, stems, *_ = tokens(data, np.array([0, len(data)]))
        for counts, found in zip(seen, (h, np.concatenate(stems))):
            for x in np.unique(found[found > 0]).tolist():
                counts.setdefault(x, np.zeros(2))[int(label)] += 1
    rows = np.bincount(y.astype(int), minlength=2)
    out = []
    for counts in seen:
        odds = {h: np.log((c[1] + 0.5) / (rows[1] + 1)) - np.log((c[0] + 0.5) / (rows[0] + 1)) for h, c in counts.items() if c[1] >= max(4, 0.02 * rows[1])}
        best = sorted(sorted((h for h in odds if odds[h] > 2.5), key=lambda h: (-odds[h], h))[:most])
        out.append((np.array(best, np.uint64), np.array([odds[h] for h in best])))
    return out


def fit_texts(texts: list[str], y: np.ndarray) -> Model:
    """Lexicon from one part of the rows, trees from a second, calibration from a third."""
    part = np.arange(len(y)) % 5
    first, second, third = part < 2, (part == 2) | (part == 3), part == 4
    pick = lambda m: [t for t, k in zip(texts, m) if k]
    learned, stems = learn_lexicon(pick(first), y[first])
    lex = Lexicons(_hashes(LEXICON), _hashes(SECOND), *learned, *stems)
    x = [features(*text_bytes(pa.array(pick(m), pa.string())), lex) for m in (second, third)]
    if second.sum() < 20 or not 0 < y[second].sum() < second.sum():
        base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(lex, Trees(base=float(np.log(base / (1 - base)))), (np.zeros(0), np.zeros(0)))
    trees = boost(x[0], y[second], rising=RISING)
    return Model(lex, trees, isotonic(trees.margin(x[1]), y[third]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """Fit on up to `sample` labelled documents, the first by hash of their id until their texts have `most` bytes.

    A label is the largest of its id. Rows without id or label teach nothing, nor does an empty table.
    """
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).select("text", "y")
    texts, y, size = [], [], 0
    for r in rows.toLocalIterator():
        size += len(r["text"].encode())
        if size > most and texts:
            break
        texts.append(r["text"])
        y.append(r["y"])
    return fit_texts(texts, np.array(y, float))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` (all its columns) with `score` (0 to 1) and `predicted` (1 if score >= 0.5); a null text is an empty one.

    Columns of those names are replaced, any others stay. Texts are scored whole, however long;
    repeated rows are scored alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    names = kept.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.score(*text_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(run, kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labelled rows whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    asked = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return score(asked, model).select("doc_id", "held_out", "score", "predicted")
