"""URL filters: host rules, and a Bloom filter cascade for exact membership without joins.

Level 1 of the cascade encodes the listed keys; level 2 those other keys of the corpus that level 1
takes for listed; level 3 the listed keys that level 2 takes for such errors; and so on until a
level makes no error over the complete key universe. A key is listed if the first level that does
not know it is an even one. Everything is DataFrame and SQL functions: a filter is an array of
64-bit words made by bit_or, and reaches the rows as a scalar subquery. Filters above a bound are
split by shards of the keys, each with a cascade and a pass of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, release, table

BITS_PER_KEY = 12
HASHES = 6
#: Bound of the keys that one shard's first level encodes (12 bits each).
SHARD_KEYS = 1 << 19
SHARD_SEED = 7919
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the host and all its subdomains, where the path begins so.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host and path (any columns of those names replaced); both empty for a url that is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def longest_rule(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as text and as verdict; null if none. Of equal lengths the first listed wins."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ordered]
    text = F.coalesce(*[F.when(c, F.lit(h + p)) for c, (_, h, p) in zip(fits, ordered)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(c, F.lit(v)) for c, (v, _, _) in zip(fits, ordered)], F.lit(None).cast("string"))
    return text, verdict


@dataclass
class Level:
    words: DataFrame  # one row: array<long>
    bits: int
    seed: int

    def knows(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        found = F.lit(True)
        for at in positions(key, self.bits, self.seed):
            word = F.element_at(self.words.scalar(), (F.shiftright(at, 6) + 1).cast("int"))
            found = found & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found


def positions(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def encode(keys: DataFrame, n: int, seed: int) -> Level:
    """A Bloom filter of the n rows' `key`."""
    spark = keys.sparkSession
    words = max(1, -(-n * BITS_PER_KEY // 64))
    bits = words * 64
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, seed))).alias("at"))
    ones = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    every = ones.unionByName(spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    dense = every.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return Level(materialize(dense, "bloom")[0], bits, seed)


def cascade(universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Levels over `universe` (key, listed), one row for each key of the corpus."""
    sides = [universe.where("listed").select("key"), universe.where("not listed").select("key")]
    levels: list[Level] = []
    used: list[str] = []
    n = sides[0].count()
    while n:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade did not end")
        level = encode(sides[0], n, len(levels))
        levels.append(level)
        wrong, path = materialize(sides[1].where(level.knows(F.col("key"))), "wrong")
        used.append(path)
        sides = [wrong, sides[0]]
        n = wrong.count()
    release(universe.sparkSession, *used)
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for every key of the universe that the levels were made over."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(levels[k].knows(key), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def key_universe(rows: DataFrame, key: Column, listed: Column) -> tuple[DataFrame, str]:
    """(key, listed): each key of the rows, and whether any of its rows lists it; and its table."""
    keyed = rows.select(key.alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")).groupBy("key").agg(F.max("listed").alias("listed"))
    return materialize(keyed, "universe")


def listed_rows(rows: DataFrame, key: str, universe: DataFrame, out: str = "listed") -> DataFrame:
    """`rows` with `out`: whether the row's key, which must be in `universe`, is a listed one."""
    shards = int(universe.where("listed").count() // SHARD_KEYS) + 1
    found = None
    for s in range(shards):
        mine, own = universe, rows
        if shards > 1:
            shard = lambda c: F.pmod(F.xxhash64(c, F.lit(SHARD_SEED)), F.lit(shards)) == s  # noqa: B023, E731
            mine, own = universe.where(shard(F.col("key"))), rows.where(shard(F.col(key)))
        part = own.withColumn(out, is_listed(F.col(key), cascade(mine)))
        found = part if found is None else found.unionByName(part)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    Where a rule fits, the longest one gives the verdict. Elsewhere a page is blocked if its host
    is listed, and allowed if not: the hosts on which a rule blocks some page of the corpus are
    listed, by a cascade over all its hosts. A url that is null or has no `://` has an empty host.
    Columns of those four names are replaced, any others stay. Repeated rows are judged alike; urls
    of any length are read whole; an empty table gives no rows.
    """
    text, verdict = longest_rule(rules)
    parsed = with_host_path(pages.drop("rule", "verdict"), url)
    ruled, listed = fresh(parsed, "ruled"), fresh(parsed, "listed")
    judged = parsed.withColumns({"rule": text, ruled: verdict})
    universe, path = key_universe(judged, F.col("host"), F.col(ruled) == "block")
    judged = listed_rows(judged, "host", universe, listed)
    release(pages.sparkSession, path)
    method = F.when(F.col(listed), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(ruled, method)).drop(ruled, listed)


def op9(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), f AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p
), v AS (
  SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM f
), l AS (
  SELECT DISTINCT host FROM v WHERE ruled = 'block'
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM v
"""
