"""Chat, near-duplicates, decontamination, top-k, URL filters and the pipeline: edge rows and brute force."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vaultspark.llm import chat, components, decontaminate, langid, pii, registry, simhash, topk, urlfilter
from vaultspark.llm.common import skew_join, text_bytes

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    rel = c.sql(registry.oracle_sql()[name])
    assert sorted(map(str, got.select(*rel.columns).collect())) == sorted(str(_row(rel.columns, x)) for x in rel.fetchall())


def _row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))


# --- chat -----------------------------------------------------------------------------------


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", None, 9), (1, 2, "bob", None, 9), (1, None, None, "who", 9), (None, 1, "x", "y", 9), (2, 0, "system", "alone", 9)], "conv_id long, turn long, role string, text string, perspective int")
    rows = chat.rotate(turns).orderBy("perspective", "seq").collect()
    assert [(r["perspective"], r["seq"]) for r in rows] == [(p, s) for p in ("ann", "bob") for s in range(1, 6)]
    for p in ("ann", "bob"):
        own = [r for r in rows if r["perspective"] == p]
        whole = "".join(r["content"] for r in own)
        assert all(whole[r["char_start"] : r["char_end"]] == r["content"] for r in own)
        masked = [whole[r["mask_start"] : r["mask_end"]] for r in own if r["mask_start"] is not None]
        assert masked == (["hi<|end|>\n"] if p == "ann" else ["<|end|>\n"] * 2)
    assert [r["content"] for r in rows][:2] == ["<|system|>be kind<|end|>\n", "<|assistant|>hi<|end|>\n"] and rows[4]["name"] == "unknown"
    assert chat.rotate(turns.limit(0)).count() == 0


def test_a_long_dialogue_is_cut_in_ranges(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("role"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text")).withColumnRenamed("id", "turn")
    rows = chat.rotate(turns).where("perspective = 'a'").orderBy("seq").collect()
    assert [r["turn"] for r in rows] == list(range(3000)) and all(a["char_end"] == b["char_start"] for a, b in zip(rows, rows[1:]))


# --- SimHash --------------------------------------------------------------------------------


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code_is_perfect():
    x = np.arange(1 << 23)
    index = simhash.golay_index(x)
    word = index << 11
    word ^= simhash._SYNDROME_LOW[word & 0xFFF] ^ simhash._SYNDROME_HIGH[word >> 12]
    assert (np.bitwise_count(word ^ x) <= 3).all() and len(np.unique(index)) == 1 << 12


def test_any_two_fingerprints_within_three_bits_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    (ka, ra), (kb, rb) = simhash.fuzzy_keys(a), simhash.fuzzy_keys(b)
    both = set(zip(ka.tolist(), ra.tolist())) & set(zip(kb.tolist(), rb.tolist()))
    assert {r for _, r in both} == set(range(len(a)))


def components_of(fps, pairs):
    place = {int(f): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        root[find(place[x])] = find(place[y])
    least = {}
    for i in range(len(fps)):
        least.setdefault(find(i), int(fps[i]))
    return [least[find(i)] for i in range(len(fps))]


def crowd(n, seed=3, spread=40):
    """Distinct fingerprints around a few centres."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 62, 4).astype(np.uint64)
    return np.unique(np.array([centre[i % 4] ^ np.uint64(sum(1 << int(b) for b in rng.choice(spread, rng.integers(0, 5), replace=False))) for i in range(n)], np.uint64))


def test_links_in_a_key_reach_as_far_as_all_pairs():
    fps = crowd(300)
    pairs = [(a, b) for x, y in simhash._forest(fps) for a, b in zip(x.tolist(), y.tolist())]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    assert components_of(fps, pairs) == brute_components(fps.tolist(), fps)


@pytest.mark.parametrize("run", [4096, 60, 9])
def test_full_keys_are_dealt_by_finer_ones(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    fps = crowd(700, spread=64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found, paths = simhash.links(df)
    pairs = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs) and len(paths) > (run < 100)
    assert components_of(fps, pairs) == brute_components(fps.tolist(), fps)


def test_finer_keys_hold_every_pair_and_few_fingerprints():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.array([x ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 3, replace=False))) for x in a], np.uint64)
    for width, most in ((8, 56), (4, 560)):
        met = np.zeros(len(a), bool)
        keys = list(zip(simhash.finer_keys(a, width), simhash.finer_keys(b, width), strict=True))
        for (ka, _), (kb, _) in keys:
            met |= ka == kb
        assert met.all() and len(keys) == most


def test_a_streamed_key_holds_little():
    """Half a million fingerprints of one key pass through batch by batch."""
    n, size = 500_000, 10_000
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array(np.full(size, 7)), pa.array(np.arange(i * size, (i + 1) * size))], ["key", "fp"])
    out = list(simhash._linked((batch(i) for i in range(n // size)), simhash.RUN))
    assert sum(b.num_rows for b in out) == n and max(b.num_rows for b in out) <= 1 << 17 and all(b.column(1).null_count == b.num_rows for b in out)


def test_near_duplicates_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("fp"), F.lit(2).alias("component_id"))
    random.seed(1)
    base = [r["text"] for r in docs.limit(20).collect()]
    more = [(1000 + i, t.replace(" ", "  ") if i % 2 else " ".join(w for k, w in enumerate(t.split()) if k != 9)) for i, t in enumerate(base)]
    more += [(2000, None), (2001, ""), (2002, " \n"), (None, base[0]), (0, base[1]), (0, base[1]), (2003, "one two"), (2004, "ONE  two"), (2005, "w " * 60_000)]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(2)}))
    texts = both.select("doc_id", "text").collect()
    fps = np.array([brute_fingerprint(r["text"]) for r in texts], np.uint64)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, f"{int(f):016x}", c) for r, f, c in zip(texts, fps, brute_components([r["doc_id"] for r in texts], fps)))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(both).collect())
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_repeated_id_keeps_a_row_of_each_component(spark):
    a, b, c = (r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(3).collect())
    near = [t for w in ("x", "y") for t in (b + " " + w, b.upper())]
    docs = docs_of(spark, (1, a), (1, b), (1, b), *((1, t) for t in near), (2, b), (2, c), (3, c), (None, a), (4, None), (4, ""))
    rows = simhash.near_duplicates(docs).collect()
    assert len({r["fingerprint"] for r in rows}) >= 4
    kept = [(r["doc_id"], (r["text"] or "").lower()[:50]) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a.lower()[:50]), (1, b.lower()[:50]), (2, c.lower()[:50]), (None, a.lower()[:50]), (4, "")], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 300), (5, 5), (None, 1)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long"))[0].collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100} | {i: 1000 for i in range(1000, 1050)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


# --- decontamination ------------------------------------------------------------------------


def test_decontamination(spark):
    random.seed(7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = decontaminate.drop_contaminated(docs, items)
    texts = [r["text"] for r in clean.orderBy("doc_id").limit(30).collect()]
    first = [r for r in items.orderBy("item_id").collect() if len(r["text"].split()) >= 12][:20]
    planted = []
    for i, (r, t) in enumerate(zip(first, texts)):
        w = r["text"].split()
        if i % 4 == 1:
            w = [x for k, x in enumerate(w) if k % 6 != 3]  # words lost
        elif i % 4 == 2:
            w = [x if k % 5 != 4 else "changed" for k, x in enumerate(w)]  # words changed
        elif i % 4 == 3:
            w = [y for k, x in enumerate(w) for y in ([x.upper() + "!", "indeed"] if k % 6 == 0 else [x])]  # words added
        planted.append((9000 + i, t + " " + " ".join(w) + " " + t, "en"))
    odd = [(9500, None, "en"), (9501, "", "en"), (9502, " ".join(texts), "en"), (None, first[0]["text"], None), (9600, first[1]["text"], "en"), (9600, first[1]["text"], "en"), (9503, "the the the " * 20_000, "en")]
    more = spark.createDataFrame(planted + odd, "doc_id long, text string, lang string")
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs.unionByName(more), items.unionByName(spark.createDataFrame([(None, "x"), (777, None), (778, "")], items.schema))).collect()}
    assert pairs >= {(9000 + i, r["item_id"]) for i, r in enumerate(first)} | {(None, first[0]["item_id"]), (9600, first[1]["item_id"])}
    assert not {d for d, _ in pairs if d is not None} & {9500, 9501, 9502, 9503}
    found = {d for d, _ in pairs if d is not None and d < 9000}
    assert clean.columns == docs.columns and clean.count() == docs.where(~F.col("doc_id").isin(*found)).count()
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_leaks_are_those_of_aligning_every_pair(spark):
    """Whole texts against whole items, without seeds or windows."""
    random.seed(3)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(25).collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60).collect()]
    base = [t for _, t in docs[:25]]
    for i, ((_, t), host) in enumerate(zip(items, base)):
        w = t.split()
        for k in random.sample(range(len(w)), len(w) // 6):  # edits: a word changed, lost or added
            w[k] = random.choice(["other", "", w[k] + " indeed"])
        docs.append((5000 + i, f"{host} {' '.join(w)} {host}"))
        docs.append((6000 + i, f"{host} {' '.join(w[: len(w) // 3])} {host}"))
    words = lambda t: decontaminate.normal_words(*text_bytes(pa.array([t])))[0]
    wi, wd = [words(t) for _, t in items], [words(t) for _, t in docs]
    want = set()
    for (item, _), x in zip(items, wi):
        score, _ = decontaminate.smith_waterman([x] * len(wd), wd)
        want |= {(docs[d][0], item) for d in np.flatnonzero(score >= decontaminate.MATCH * min(decontaminate.SHARE * len(x), decontaminate.ENOUGH))}
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(want) >= 25 and got <= want and len(got & want) >= 0.9 * len(want)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.contaminated(docs, items).select("doc_id", "item_id", "score").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert sorted(decontaminate.contaminated(docs, items).select("doc_id", "item_id", "score").collect()) == sorted(one)


def test_items_without_a_seed_are_found_verbatim(spark, caplog):
    plain = [(i, "the of the to the of " * 40) for i in range(50)]
    han = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u5427"
    more = [(100, "xylem so The OF, of it"), (101, "before" + "\u6211\u8bf4" + han + "\u3002"), (102, "it of of"), (103, "of the of"), (104, "to"), (105, "the the " * 10), (106, "the " * 9), (None, None)]
    docs = spark.createDataFrame(plain + more, "doc_id long, text string")
    items = spark.createDataFrame([(1, "the of of"), (2, han), (3, "xylem"), (4, "the " * 15), (5, "of to"), (6, None), (7, "..")], "item_id long, text string")
    want = {(100, 1), (101, 2), (100, 3), (105, 4)}
    rows = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and all(r["share"] == 1 for r in rows)
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()} == {i for i, _ in plain + more} - {d for d, _ in want}
    assert "4 of 6 test items" in caplog.text


def test_smith_waterman():
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    b = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]

    def plain(x, y):
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    score, end = decontaminate.smith_waterman(a, b)
    assert score.tolist() == [plain(x, y) for x, y in zip(a, b)]
    assert all(plain(x, y[:e]) == s for x, y, s, e in zip(a, b, score, end))


# --- top-k ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_lists_agree_with_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, d = [(300, 8), (500, 3), (4, 5), (200, 1), (400, 16), (64, 4)][seed]
    v = rng.integers(-3 if seed % 2 else -200, 4 if seed % 2 else 200, (n, d))
    if seed == 4:
        v[100:300] = v[100]  # a common vector
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    q = np.concatenate([v[:20], np.zeros((1, d), np.int64)])
    own = np.concatenate([ids[:20], [-1]])
    rows, found, score, _ = topk.Lists(ids, v).top(q, own[: len(q)], 5)
    for j in range(len(q)):
        s = v @ q[j]
        keep = ids != own[j]
        order = np.lexsort((ids[keep], -s[keep]))[:5]
        assert found[rows == j].tolist() == ids[keep][order].tolist() and score[rows == j].tolist() == s[keep][order].tolist()


def test_lists_stop_early_where_values_are_skewed():
    """A few vectors with large values, as weights of words or clicks have them: most of the lists stay unread."""
    rng = np.random.default_rng(5)
    v = np.floor(rng.pareto(1.2, (2000, 12)) * 10).astype(np.int64)
    q = np.floor(rng.pareto(1.2, (30, 12)) * 10).astype(np.int64)
    rows, found, score, depth = topk.Lists(np.arange(2000), v).top(q, np.full(30, -1), 5)
    for j in range(30):
        s = v @ q[j]
        assert found[rows == j].tolist() == np.lexsort((np.arange(2000), -s))[:5].tolist() and score[rows == j].tolist() == sorted(s, reverse=True)[:5]
    assert depth.mean() < 0.3 and (depth < 1).all()


def test_search_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)  # so that queries come in blocks
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [0.5, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, []), (100, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    v = topk.quantized(e)
    got = [tuple(r)[:4] for r in topk.search(v, v.where("vec_id % 50 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 98304), (0, 2, 1, 98304), (0, 3, 2, 65536), (50, 1, 1, 98304), (50, 2, 1, 98304), (50, 3, 0, 65536), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 1, 0)]
    assert topk.search(v.limit(0), v, 3).count() == 0 and topk.search(v, v.limit(0), 3).count() == 0


# --- URL filters ----------------------------------------------------------------------------


def test_rules(spark):
    urls = {1: "http://A.Example.COM/en/x?q#f", 2: "https://www.example.com/en/", 3: "http://x.net/fr/1", 4: "http://x.net/en/1", 5: "http://badnet/fr/", 6: None, 7: "no scheme", 8: "http://example.com?/en/", 9: "http://sub.www.example.com/en/y", 10: "ftp://net/es/a", 11: "http://q.org", 12: "http://a.com/en/", 13: "x://y://z/p"}
    rows = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumns({"host": F.lit("old"), "listed": F.lit(1), "key": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(rows).collect()}
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("x.net", "/fr/1", "net/fr/", "block"), 4: ("x.net", "/en/1", None, "block"),
        5: ("badnet", "/fr/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("example.com", "", None, "allow"), 9: ("sub.www.example.com", "/en/y", "www.example.com/en/", "allow"),
        10: ("net", "/es/a", "net/es/", "block"), 11: ("q.org", "", None, "allow"), 12: ("a.com", "/en/", "com/", "allow"), 13: ("y:", "//z/p", None, "allow"),
    }
    assert urlfilter.judge(rows.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1 << 19, 200])
def test_cascade_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(urlfilter, "SHARD_KEYS", shard)
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 4)  # so that it has several levels
    rows = spark.range(4000).select(F.concat(F.lit("h"), F.col("id") % 2000).alias("k"), F.when(F.col("id") % 2000 < 2, F.lit(None)).otherwise(F.pmod(F.xxhash64(F.col("id") % 2000), F.lit(5)) == 0).alias("l"))
    universe, _ = urlfilter.key_universe(rows, F.col("k"), F.col("l"))
    if shard > 1000:
        assert len(urlfilter.cascade(universe)) >= 3
    assert urlfilter.listed_rows(rows, "k", universe, "got").where("got <> coalesce(l, false)").count() == 0
    assert urlfilter.cascade(universe.where("not listed")) == []


# --- the pipeline ---------------------------------------------------------------------------


def test_stages(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs_of(spark, (5000, None), (5001, ""), (5002, "12 34"), (5003, "call +1 (415) 555-0199 about the end of that, it was with them"), (5004, docs.first()["text"]), (5005, "some words of the and with " + bench + " and others of it"))
    now = docs.unionByName(more.select(docs.columns))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF).cache()
        kept[name] = {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in now.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    assert {5000, 5001, 5002} <= kept["language"] and 5004 in kept["near-duplicates"] and 5005 in kept["decontamination"] and not kept["personal data"] and not kept["tokens"]
    row = now.where("doc_id = 5003").first()
    assert row["text"].startswith("call <phone> about") and row["n_chars"] == len(row["text"]) and row["n_tokens"] == len(row["token_ids"])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_clashing_columns_of_pages_stay(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").withColumns({"_verdict": F.lit(1), "_listed": F.lit(2), "ruled": F.lit(3), "listed": F.lit(4), "rule": F.lit(5)})
    got = urlfilter.judge(df)
    assert {tuple(r) for r in got.select("_verdict", "_listed", "ruled", "listed").collect()} == {(1, 2, 3, 4)} and got.count() == df.count()
    want = {r["page_id"]: r["verdict"] for r in urlfilter.op9(spark, SF).collect()}
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == want
    long = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 300_000), (1, "http://a.net/es/" + "x" * 300_000)], "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.judge(long).collect()] == ["block", "block"] and urlfilter.judge(long.limit(0)).count() == 0


def test_pipeline_stages_keep_rows_of_a_repeated_id(spark):
    one = "Please write to ann@example.com about the long and winding road that leads to the door"
    docs = docs_of(spark, (1, one), (1, "quite another text of some words that is nobody's copy at all"), (None, one), (2, None), (3, ""))
    more = docs.withColumns({"text_hash": F.lit(7), "letters": F.lit(8)})
    kept = decontaminate.drop_contaminated(more, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert kept.count() == 5 and kept.columns == more.columns
    assert sorted(str(r["text"])[:24] for r in pii.redact_documents(more).collect()) == sorted(["Please write to <email> "] * 2 + ["quite another text of so", "None", ""])
    dropped = simhash.drop_near_duplicates(more)
    assert dropped.columns == more.columns and sorted(str(r["doc_id"]) for r in dropped.collect()) == ["1", "1", "2", "None"]
    assert langid.keep_identified(more).count() == 3
    for stage in (pii.redact_documents, simhash.drop_near_duplicates, langid.keep_identified):
        assert stage(more.limit(0)).count() == 0


def test_a_very_long_turn_and_a_hot_conversation(spark):
    turns = [(1, 0, "a", "x" * 200_000), (1, 1, "b", "y")] + [(2, i, "ab"[i % 2], f"t{i}") for i in range(3000)] + [(2, 7, "a", "t7")] * 3
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.rotate(df).collect()
    assert len(rows) == 2 * len(turns)
    hot = sorted((r for r in rows if r["conv_id"] == 2 and r["perspective"] == "a"), key=lambda r: r["seq"])
    assert [r["seq"] for r in hot] == list(range(1, 3004)) and all(a["char_end"] == b["char_start"] for a, b in zip(hot, hot[1:]))
    assert max(len(r["content"]) for r in rows) > 200_000


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_skew_join_is_a_join(spark, most):
    left = spark.createDataFrame([(i, 7 if i < 500 else i % 40) for i in range(900)] + [(-1, None)], "i long, k long")
    right = spark.createDataFrame([(k, f"r{k}{c}") for k in range(35) for c in "ab"] + [(None, "no")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, skew_join(left, right, "k", how, most).select("i", "k", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("i", "k", "v").collect()))
