"""Language ID, Katz model, PII, BPE and toxicity: edge rows, and brute force or held-out accuracy."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vaultspark.llm import bpe, katz, langid, pii, toxicity
from vaultspark.llm.common import chunks, hash_spans, text_bytes, word_hash, words

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, letterless, very long, repeated and odd texts; columns with clashing names.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "the of and " * 9000), (6, "the of and"), (6, "the of and"), (None, "the and"), (7, "été 日本 🙂 \x85 x\x00y")]


def odd(spark, *more):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5) for i, t in [*ODD, *more]], DOC + ", score double")


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_words_and_hashes_agree_with_split():
    import pyarrow as pa

    texts = ["a bb  c\x0b", None, "", " x", "y", "z" * 3000 + " é"] * 3
    data, offsets = text_bytes(pa.array(texts)[2:])
    starts, ends, n = words(data, offsets)
    want = [w for t in texts[2:] for w in (t or "").encode().split()]
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == want and n.tolist() == [len((t or "").split()) for t in texts[2:]]
    assert [int(h) for h in hash_spans(data, starts, ends)] == [word_hash(w.decode()) for w in want]
    assert [x for a, b in chunks(offsets, 10) for x in range(a, b)] == list(range(len(texts) - 2))


# --- language ID ----------------------------------------------------------------------------


def brute_bits(samples, text, order):
    seen = defaultdict(Counter)
    for s in samples:
        for k in range(order + 1):
            for i in range(k, len(s)):
                seen[s[i - k : i]][s[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            c = seen.get(text[i - k : i])
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if text[i] in c:
                bits += math.log2(total / c[text[i]])
                break
            bits += math.log2(total / len(c))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_are_exact(order, monkeypatch):
    samples = {"a": [b"hello there the end", b"then"], "b": [b"das ist der hund", b"die"]}
    model = langid.train(samples, order)
    texts = [b"the hund", b"", b"\xff\xfe", b"hello there the end of it all" * 4]
    offsets = np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(langid, "CHUNK_BYTES", 7)  # so that texts cross chunks
    got = langid.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    want = [[brute_bits(samples[x], t, order) for x in model.languages] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_language_accuracy_and_odd_rows(spark):
    p = langid.op2(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    m = p.merge(docs, on="doc_id")
    assert len(p) == len(docs) and (m.lang_pred == m.lang)[m.held_out].mean() > 0.95
    assert (p.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id]).all()
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = langid.predict(odd(spark), model).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4)} == {"und"}
    assert all(r["lang_pred"] == "en" and 0.5 < r["score"] <= 1 for r in rows if r["doc_id"] in (5, 6, None))
    nothing = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(odd(spark), nothing).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0
    kept = langid.keep_identified(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 6, 6, 7]


def test_documents_stay_where_no_language_was_learned(spark):
    unknown = odd(spark).withColumn("lang", langid.F.lit(None).cast("string"))
    for docs in (odd(spark), unknown):
        kept = langid.keep_identified(docs)
        assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 6, 6, 7]


def test_copies_do_not_thin_the_sample(spark, monkeypatch):
    copies = spark.range(20_000).selectExpr("concat('text ', id % 20) as text", "'xx' as lang")
    docs = copies.unionByName(spark.createDataFrame([("one", "yy"), ("two", "yy")], "text string, lang string"))
    want = {"xx": sorted(f"text {i}".encode() for i in range(20)), "yy": [b"one", b"two"]}
    assert {k: sorted(v) for k, v in langid.sample(docs, "text", "lang").items()} == want
    whole = langid.sample(docs, "text", "lang", texts=3)
    assert len(whole["xx"]) == 3
    monkeypatch.setattr(langid.F, "approx_count_distinct", lambda c: langid.F.count(c))  # an estimate far too high
    assert langid.sample(docs, "text", "lang", texts=3) == whole


# --- Katz -----------------------------------------------------------------------------------


def brute_katz(rows, order=katz.ORDER):
    """rows: (learn, text); n_tokens, n_known, base, score of each, and the model's P(word | history)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "<end>"] for _, t in rows]
    c = [Counter() for _ in range(order)]
    past = lambda t, i, n: tuple(["<end>", *t][i + 2 - n : i + 2])  # noqa: E731  the n-gram that ends at token i
    for (learn, _), t in zip(rows, toks):
        for i in range(len(t) if learn else 0):
            for n in range(1, min(order, i + 2) + 1):
                c[n - 1][past(t, i, n)] += 1
    total, v = sum(c[0].values()), len(c[0])

    def discount(counts):
        n = [0, *(list(counts.values()).count(r) for r in range(1, katz.K + 2))]
        out = {}
        for r in range(1, katz.K + 1):
            a = (katz.K + 1) * n[katz.K + 1] / n[1] if n[1] else 1
            d = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if n[r] and a < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    d = [discount(x) for x in c]
    after = [defaultdict(list) for _ in range(order)]
    for n in range(order):
        for g in c[n]:
            after[n][g[:-1]].append(g)

    @functools.cache
    def sums(history):
        """What the history's continuations have in all, how much of it is left, and the weight of the shorter history."""
        n, seen = len(history), after[len(history)].get(history, [])
        counts = [c[n][g] for g in seen]
        whole = sum(counts) + (all(r > katz.K for r in counts))
        left = (whole - sum(d[n].get(r, 1) * r for r in counts)) / whole
        return whole, left, left / (1 - sum(p(history[1:], g[-1]) for g in seen)) if n and seen else left

    def p(history, word):
        n = len(history)
        if history not in after[n] and n:
            return p(history[1:], word)
        whole, left, weight = sums(history)
        if (*history, word) in c[n]:
            r = c[n][*history, word]
            return d[n].get(r, 1) * r / whole
        return weight * p(history[1:], word) if n else left

    each = lambda t, i: p(past(t, i, min(order, i + 2))[:-1], t[i])
    out = [(len(t), sum((w,) in c[0] for w in t), sum(math.log10((c[0][w,] + 0.1) / (total + 0.1 * (v + 1))) for w in t), sum(math.log10(each(t, i)) for i in range(len(t)))) for t in toks]
    return out, p, [*(w for (w,) in c[0]), "<unknown>"]


def test_katz_agrees_with_brute_force_and_sums_to_one(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(zlib.crc32(str(r["doc_id"]).encode()) % 10 != 0, r["text"]) for r in docs.orderBy("doc_id").collect()]
    got = katz.op3(spark, SF).orderBy("doc_id").collect()
    want, p, events = brute_katz(rows)
    for g, w in zip(got, want, strict=True):
        assert (g["n_tokens"], g["n_known"]) == w[:2]
        assert g["base_score"] == pytest.approx(w[2]) and g["score"] == pytest.approx(w[3])
    held = [g for g, (learn, _) in zip(got, rows) if not learn]
    assert all(g["held_out"] for g in held) and sum(g["score"] for g in held) > sum(g["base_score"] for g in held)
    followed = next(t.lower().split() for learn, t in rows if learn and t and len(t.split()) > 9)
    for history in ((), ("<end>",), ("the",), ("never met",), ("<end>", followed[0]), (followed[3], followed[4])):
        assert sum(p(history, w) for w in events) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_katz_of_any_order_in_small_blocks_and_buckets(spark, monkeypatch, order):
    """Counts above K, histories without a discounted word, and n-grams that cross blocks and buckets."""
    monkeypatch.setattr(katz, "BLOCK_BYTES", 500)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 200)
    random.seed(order)
    rows = [(i % 4 > 0, " ".join(random.choices("a b c d e".split(), k=random.randint(0, 40)) if i % 3 else ["x", "y", "z"] * 4 + random.choices("abcxyz", k=i % 5))) for i in range(80)]
    df = spark.createDataFrame([(i, learn, t) for i, (learn, t) in enumerate(rows)], "doc_id long, learn boolean, text string")
    got = katz.score(df, "learn", order=order).orderBy("doc_id").collect()
    want, _, _ = brute_katz(rows, order)
    assert [(g["n_tokens"], g["n_known"]) for g in got] == [w[:2] for w in want]
    assert [g["score"] for g in got] == pytest.approx([w[3] for w in want])
    assert [g["base_score"] for g in got] == pytest.approx([w[2] for w in want])


def test_katz_totals_above_32_bits():
    key = np.array([7, 9], np.uint64)
    asked = [{"block": i, "bucket": 0, "parts": [katz.pack_sorted(key), katz.pack(np.array([4_000_000_000, 1], np.uint32))]} for i in range(2)]
    first, second, sums = katz.answers(asked)
    assert katz.unpack(first["parts"][0], np.int64).tolist() == katz.unpack(second["parts"][0], np.int64).tolist() == [8_000_000_000, 2]
    assert sums["stats"][:2] == [8_000_000_002, 2] and np.unpackbits(np.frombuffer(first["parts"][1], np.uint8), count=2).all()


def test_katz_odd_rows(spark):
    from pyspark.sql import functions as F

    df = odd(spark, (8, "new words only")).withColumn("learn", F.col("doc_id") != 8)
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(df, "learn").collect()))
    rows = [(i is not None and i != 8, t, i) for i, t in [*ODD, (8, "new words only")]]
    want, _, _ = brute_katz([x[:2] for x in rows])
    assert [g[:3] for g in got] == sorted((i or 0, *w[:2]) for (_, _, i), w in zip(rows, want))
    assert sorted(g[4] for g in got) == pytest.approx(sorted(w[3] for w in want), abs=1e-5)
    assert katz.score(empty(spark).withColumn("learn", F.lit(True)), "learn").count() == 0
    none = katz.score(df.withColumn("learn", F.lit(False)), "learn")
    assert {(r["score"], r["base_score"], r["train_tokens"], r["n_known"]) for r in none.collect()} == {(0.0, 0.0, 0, 0)}


def test_katz_packing():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (katz.unpack_sorted(katz.pack_sorted(x)) == x).all() and len(katz.unpack(b"", np.uint32)) == 0
    assert (katz.cuts(x, 7)[1:] >= katz.cuts(x, 7)[:-1]).all() and katz.cuts(x, 7)[-1] == len(x)


# --- PII ------------------------------------------------------------------------------------


def naive_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_exact_patterns_agree_with_naive_ones():
    random.seed(1)
    for _ in range(4000):
        text = "".join(random.choices(random.choice(["a@.-1", "12. -", "+12 ().-", "0123456789 -", "ab1.@é+ "]), k=random.randint(0, 60)))
        assert pii.base_spans(text) == naive_spans(text), text
    assert pii.base_spans("9" * 100_000 + "a" * 100_000 + "@") == []


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_lines())


def test_field_adds_and_keeps(field):
    cases = {"ring (415) 555-0199 today": ["phone"], "mail ann [at] example7 [dot] com please": ["email"], "a 2024-01-02 at 12:30 cost 1,299.00, version 3.2": [], "plain words only": [], "to bob.7@mail1.example.com.": ["email"], "host 10.0.0.7, card 4111 1111 1111 1111": ["ip", "card"]}
    for (text, want), found in zip(cases.items(), pii.find(list(cases), field)):
        assert [k for k, _, _ in found] == want, text
    every = [t for t, _ in pii.labelled_lines()]
    for text, found in zip(every, pii.find(every, field)):
        assert set(pii.base_spans(text)) <= set(found)


def test_labelled_table_fills_each_layout_24_times():
    lines = [t for t, _ in pii.labelled_lines()]
    assert sum(t.startswith("the host ") for t in lines) == sum(t.startswith("Call ") for t in lines) == 24


def test_field_sees_spelled_out_addresses(field):
    cases = {"write to ann [ at ] example [ dot ] com for more": "ann [ at ] example [ dot ] com", "mail ann (At) example (Dot) org please": "ann (At) example (Dot) org", "ann at example dot org": "ann at example dot org", "reach j.doe at mail dot example dot org any time": "j.doe at mail dot example dot org"}
    for (text, want), found in zip(cases.items(), pii.find(list(cases), field)):
        assert [(k, text[a:b]) for k, a, b in found] == [("email", want)], text
    plain = ["Look at the dot on the map and tell them", "they arrive at a dot com company later", "meet at noon, then connect each dot of it"]
    assert pii.find(plain, field) == [[], [], []]


def test_tokens_and_shapes():
    random.seed(2)
    texts = ["".join(random.choices("aAzZ9٣²é_-. \n\x85日Ⅷǅ@v", k=random.randint(0, 30))) for _ in range(300)] + ["At VERSION v dots " + "7" * 30, ""]
    t = pii.tokenize(texts)
    want = [(r, *m.span()) for r, x in enumerate(texts) for m in re.finditer(r"[^\W\d_]+|\d+|[^\w\s]|_", x)]
    assert list(zip(t.row.tolist(), t.start.tolist(), t.end.tolist())) == want
    last = t.shape[t.row == 300].tolist()
    assert last == [pii._WORD + pii.WORDS.index("at"), pii._WORD + pii.WORDS.index("version"), pii._WORD + pii.WORDS.index("v"), pii._SMALL, 17]


def test_decoding_open_stretches_is_decoding_all(spark, field):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    random.seed(4)
    lines = [x for x, _ in pii.labelled_lines()]
    texts += [" ".join(random.choices(lines, k=5)) for _ in range(60)] + ["", "9 " * 500, "@", "tel 415 555 0199"]
    t = pii.tokenize(texts)
    scores = field.scores(t).astype(float)
    whole = np.concatenate([np.zeros(0, int), *field.viterbi([scores[t.row == r] for r in range(len(texts))])])
    assert (field.labels(t) == whole).all() and whole.any()
    plain = t.row < 60
    assert field.open(scores, t.row)[plain].mean() < 0.2  # the bound does its work


def test_gradient_is_that_of_the_likelihood():
    """One step from zero on one line moves every weight by the sign of the difference quotient of the log-likelihood."""
    import itertools

    rows = [("a 12", [("card", 2, 4)])]
    k = len(pii.LABELS)
    gold = (0, pii.LABELS.index("B-card"))
    allowed = [y for y in itertools.product(range(k), repeat=2) if pii.LABELS[y[0]][0] != "I" and (pii.LABELS[y[1]][0] != "I" or pii.LABELS[y[0]][2:] == pii.LABELS[y[1]][2:])]
    one = pii.train(rows, rounds=1, ridge=0.0)
    # at zero weights all allowed paths are alike, so the expected counts are shares of paths
    expected = np.zeros((k, k))
    for y in allowed:
        expected[y] += 1 / len(allowed)
    gradient = -expected
    gradient[gold] += 1
    moved = np.where(one.move <= -1e3, 0, one.move)
    some = np.abs(gradient) > 1e-9
    possible = one.move > -1e3
    assert (np.sign(moved[some & possible]) == np.sign(gradient[some & possible])).all()


def test_added_spans_of_held_out_lines():
    """Fitted on half of the fills, the field finds what the patterns leave in the other half."""
    lines = pii.labelled_lines()
    layouts = len(lines) // 24
    fit, held = lines[: 12 * layouts], lines[12 * layouts :]
    field = pii.train(fit)
    hit = found = there = 0
    for (text, gold), got in zip(held, pii.find([t for t, _ in held], field)):
        base = pii.base_spans(text)
        want = {s for s in gold if all(s[2] <= a or s[1] >= b for _, a, b in base)}
        added = set(got) - set(base)
        hit, found, there = hit + len(want & added), found + len(added), there + len(want)
    assert there > 60 and hit / found > 0.9 and hit / there > 0.9


def test_memory_follows_a_stretch_of_texts_and_not_all(field):
    import tracemalloc

    lines = [t for t, _ in pii.labelled_lines()]
    texts = [" ".join(lines)[:16384]] * 128
    pii.find(texts[:1], field)  # tables of code points
    tracemalloc.start()
    found = pii.find(texts, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 128 and all(spans == found[0] for spans in found) and peak < 75e6


def test_stretches_find_what_all_texts_together_do(field):
    texts = [x for t, _ in pii.labelled_lines() for x in (t, "", "é\ud83d " + t)]
    alone = [pii.find([t], field)[0] for t in texts]
    assert any(alone) and pii.find([], field) == []
    for most in (1, 100, 1 << 30):
        assert pii.find(texts, field, most) == alone


def test_viterbi_is_exact(field):
    rng = np.random.default_rng(1)
    scores = [rng.normal(size=(n, len(pii.LABELS))) * 3 for n in (1, 2, 4, 3)]
    import itertools

    for s, got in zip(scores, field.viterbi(scores)):
        value = lambda y: field.begin[y[0]] + sum(s[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert value(tuple(got)) == pytest.approx(max(map(value, itertools.product(range(len(pii.LABELS)), repeat=len(s)))))


def test_detect_and_redact(spark, field):
    df = odd(spark, (8, "call +1 (415) 555-0199, é€ x@y.zz"), (9, "x@y.zz " * 20_000))
    rows = {r["doc_id"]: r for r in pii.detect(df, field).collect() if r["doc_id"]}
    text = "call +1 (415) 555-0199, é€ x@y.zz"
    assert (rows[8]["n_phone"], rows[8]["n_email"], rows[9]["n_email"], rows[1]["n_card"]) == (1, 1, 20_000, 0)
    assert rows[8]["base_sha256"] == hashlib.sha256(b"email:27:33,phone:5:22").hexdigest() and text[27:33] == "x@y.zz"
    assert rows[8]["masked"] == "call <phone>, é€ <email>" and rows[1]["spans"] == "" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.redact_documents(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[1] is None
    assert pii.detect(empty(spark), field).count() == 0
    with pytest.raises(ValueError):
        pii.fit(pii.training_table(spark), most=3)


# --- BPE ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})


def test_bpe_is_the_library_s(reference):
    import public_tokenizers as P

    coder = bpe.Encoder(P.path(bpe.RANKS), P.PATTERN, remembered=300)  # so that pieces are forgotten
    random.seed(3)
    texts = ["".join(random.choices("abcdeé ñ\n\t  'sreall0123٣½.,!?日本語ßÀ\x1c\x85 　́🙂_-²", k=random.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(random.choices("aab bcthe", k=80)) for _ in range(500)] + ["a" * 5000, "<|endoftext|>", ""]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, pieces in zip(part, coder.pieces(part)):
            assert coder.ids(pieces).tolist() == reference.encode_ordinary(text) and coder.decoded(pieces) == text.encode()


def test_replay_waits_for_pairs_that_go_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"aa": 400, b"aac": 350, b"ab": 390}
    v = bpe.Vocabulary(ranks)

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    random.seed(5)
    pieces = ["".join(random.choices("abc", k=random.randint(1, 12))).encode() for _ in range(500)]
    assert v.replay(pieces) == [plain(p) for p in pieces]


def test_bpe_queries(spark, reference):
    rows = {r["doc_id"]: r for r in bpe.op8(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        ids = reference.encode_ordinary(r["text"])
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd(spark).withColumnRenamed("score", "decoded"))).collect()
    assert len(back) == len(ODD) and all(r["decoded"] == (r["text"] or "") for r in back)
    none = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd(spark)).where("doc_id = 1").collect()] == [(0, none, none)]
    assert bpe.tokenize_documents(empty(spark)).count() == 0


# --- toxicity -------------------------------------------------------------------------------


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    p = toxicity.op10(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(p, on="doc_id")
    held = labels[labels.held_out]
    assert len(p) == 1000 and (held.toxic == held.predicted).mean() > 0.9 and p.score.between(0, 1).all() and (p.predicted == (p.score >= 0.5)).all()
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = toxicity.score(odd(spark, (9, "you are an 1di0t, a stup.id worthless loser, idiot! " * 4)), model).collect()
    assert len(rows) == len(ODD) + 1 and {r["predicted"] for r in rows if r["doc_id"] == 9} == {1} and {r["predicted"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    blank = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(odd(spark), blank).collect()} == {0}
    assert toxicity.score(empty(spark), model).count() == 0


def test_isotonic():
    s, y = np.array([1.0, 2, 2, 3, 4, 5]), np.array([0, 1, 0, 0, 1, 1])
    x, v = toxicity.isotonic(s, y)
    assert (np.diff(v) >= 0).all() and np.interp([1, 2, 3, 4, 5], x, v).tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1, 1])


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((toxicity.boost(x, y).margin(x) > 0) == (y > 0)).mean() > 0.95


def test_a_split_is_the_best_of_all():
    """One tree of one level against every feature and every threshold between values."""
    rng = np.random.default_rng(4)
    for rising in (None, [0]):
        x = rng.integers(0, 6, (60, 3)).astype(np.float32)
        y = (rng.random(60) < 0.15 + 0.12 * x[:, 1]).astype(float)
        model = toxicity.boost(x, y, rounds=1, depth=1, rising=rising)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        g, h = p - y, np.full(60, p * (1 - p))
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: B023, E731
        best = max(gain(left) + gain(~left) - gain(left | True) for k in range(3) for cut in np.unique(x[:, k])[:-1] if min(h[left := x[:, k] <= cut].sum(), h[~left].sum()) >= 1 and not (rising and k == 0 and g[left].sum() / (h[left].sum() + 1) < g[~left].sum() / (h[~left].sum() + 1)))
        left = x[:, model.feature[0][0]] <= model.threshold[0][0]
        assert gain(left) + gain(~left) - gain(left | True) == pytest.approx(best)
        value = [-0.15 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)]
        assert model.leaf[0].tolist() == pytest.approx(value)


def test_isotonic_is_the_max_min_of_means():
    rng = np.random.default_rng(1)
    for _ in range(20):
        s, y = rng.integers(0, 8, 30).astype(float), rng.integers(0, 2, 30).astype(float)
        x, v = toxicity.isotonic(s, y)
        every = np.unique(s)
        mean = lambda a, b: y[(s >= a) & (s <= b)].mean()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in every[every >= z]) for a in every[every <= z]) for z in every]
        assert np.interp(every, x, v).tolist() == pytest.approx(want)


def test_toxicity_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x " * 500, "en", "s", 0) for i in range(60)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen = []
    toxicity.fit_texts, kept = (lambda texts, y: seen.append(len(texts))), toxicity.fit_texts
    try:
        toxicity.fit(docs, labels, most=10_500)
    finally:
        toxicity.fit_texts = kept
    assert seen == [10]


def test_clashing_columns_stay(spark):
    from pyspark.sql import functions as F

    df = odd(spark).withColumns({"letters": F.lit(1), "_letters": F.lit(2), "text_hash": F.lit(3), "lang_pred": F.lit("x")})
    model = langid.train({"en": [b"the of and"], "de": [b"der die das"]})
    got = langid.predict(df, model)
    assert {(r["letters"], r["_letters"], r["text_hash"]) for r in got.collect()} == {(1, 2, 3)} and got.where("lang_pred = 'x'").count() == 0
    back = bpe.encode(df, out="letters")
    assert {r["_letters"] for r in back.collect()} == {2} and back.columns.count("letters") == 1
    assert set(katz.score(df.withColumn("learn", F.lit(True)), "learn").columns) == {"doc_id", "learned", "n_tokens", "n_known", "base_score", "score", "train_tokens"}


def test_a_language_of_few_texts_in_many_copies_is_learned(spark):
    from pyspark.sql import functions as F

    copies = spark.range(100_000).select((F.col("id") % 5).alias("k")).select(F.concat(F.lit("hola que tal "), F.col("k").cast("string")).alias("text"), F.lit("es").alias("lang"))
    rest = spark.range(300).select(F.concat(F.lit("hello there "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    got = langid.sample(copies.unionByName(rest), "text", "lang")
    assert len(got["es"]) == 5 and len(got["en"]) == 300


def test_batches_are_cut_by_bytes():
    import pyarrow as pa
    from vaultspark.llm.common import slices

    texts = ["a" * n for n in (5, 50, 1, 1, 1, 0)] + [None, "b" * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["i", "t"])
    parts = list(slices(batch, 1, 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()) <= 10 or p.num_rows == 1 for p in parts)
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_a_long_piece_takes_little_memory():
    import tracemalloc

    import public_tokenizers as P

    v = bpe.Vocabulary(bpe.load_ranks(P.path(bpe.RANKS)))
    random.seed(1)
    piece = "".join(random.choices("etaoinshrdlu", k=300_000)).encode()
    tracemalloc.start()
    v.replay([piece])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(piece)
