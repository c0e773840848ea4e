"""Reciprocal-rank fusion and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of the sample, by hash of the key, for each of the bands that a whole order is cut into: as many as there are shuffle partitions.
SAMPLE_ROWS = 64


def ranked(scored: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, rank) by score, then key. With a limit the order is a distributed top-k before the ranks are given.

    Without one, a sample of rows cuts the order in bands, also between equal scores; a rank is the
    place in its band after the sizes of the bands before, so no task orders all rows.
    """
    order = [F.desc("score"), F.asc(key)]
    if limit is not None:
        few = scored.orderBy(*order).limit(limit)
        return few.select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))
    bands = max(64, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = scored.select(key, "score").repartition(key)  # narrow rows, so that this exchange serves the three uses below
    own = F.struct((-F.col("score")).alias("down"), F.col(key).alias("at"))
    sample = scored.select(own.alias("x")).orderBy(F.xxhash64("x"), "x").limit(SAMPLE_ROWS * bands).agg(F.sort_array(F.collect_list("x")).alias("_x"))
    size = F.size("_x")
    step = F.greatest(F.lit(1), F.floor(size / bands).cast("int"))
    cuts = sample.select(F.filter("_x", lambda x, i: (i > 0) & (i % step == 0)).alias("_cuts"))  # one row
    banded = scored.select(key, "score").crossJoin(F.broadcast(cuts)).select(key, "score", F.size(F.filter("_cuts", lambda x: x <= own)).alias("_band"))
    sizes = banded.groupBy("_band").agg(F.count("*").alias("_n"))
    before = sizes.select("_band", (F.sum("_n").over(Window.orderBy("_band")) - F.col("_n")).alias("_before"))  # a row a band
    place = F.row_number().over(Window.partitionBy("_band").orderBy(*order))
    return banded.withColumn("rank", place).join(F.broadcast(before), "_band").select(key, (F.col("_before") + F.col("rank")).alias("rank"))


def _literal(value, kind: T.DataType) -> Column:
    """A constant, also of a struct of constants."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def ranks_of(few: DataFrame, scored: DataFrame, key: str, most: int = 500) -> DataFrame:
    """(key, rank) in the whole of `scored` of the few keys that it holds, without ordering the rest.

    The few scores cut the range of scores in bands; one aggregation counts each band's rows, and a
    row's rank is the sum of the bands above. More than `most` are ranked with all the rest instead.
    """
    mine = few.select(key).join(scored, key).orderBy(F.desc("score"), key).limit(most + 1).collect()
    if len(mine) > most:
        return ranked(scored, key).join(few.select(key).distinct(), key, "left_semi")
    spark = scored.sparkSession
    if not mine:
        return scored.select(key, F.lit(1).alias("rank")).limit(0)
    above = [F.sum(((F.col("score") > r["score"]) | ((F.col("score") == r["score"]) & (F.col(key) < _literal(r[key], scored.schema[key].dataType)))).cast("long")).alias(f"r{i}") for i, r in enumerate(mine)]
    counts = scored.agg(*above).first()
    rows = [(r[key], counts[i] + 1) for i, r in enumerate(mine)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(key, scored.schema[key].dataType), T.StructField("rank", T.LongType())]))


def rrf(lists: list[tuple[DataFrame, float]], key: str, k: float = 60.0) -> DataFrame:
    """(key, score): the sum over ranked lists (key, rank), each with a weight, of weight / (k + rank)."""
    parts = [df.select(key, (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("score")) for df, w in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("score").alias("score"))


def fused_top(dense: DataFrame, sparse: DataFrame, key: str, limit: int, k: float = 60.0, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """The `limit` best of dense (a short list) and sparse (any number) scores, as fusing all ranks would give.

    A key of the sparse list alone needs one of its first places to be among the best, and the
    dense list's keys need their own sparse ranks; so no rank is given to the other rows. The sparse
    scores are made once and held while the two short lists, which come to the driver, are drawn up.
    """
    spark = sparse.sparkSession
    kind = sparse.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("rank", T.LongType())])
    held = sparse.select(key, "score").persist()
    try:
        first = {r[key]: i for i, r in enumerate(held.orderBy(F.desc("score"), key).limit(limit).collect(), start=1)}
        short = dense.select(key, "score").orderBy(F.desc("score"), key).collect()
        few = spark.createDataFrame([(r[key], 0) for r in short], schema)
        ranks = first | {r[key]: r["rank"] for r in ranks_of(few, held, key).collect()}
    finally:
        held.unpersist()
    d = spark.createDataFrame([(r[key], i) for i, r in enumerate(short, start=1)], schema)
    s = spark.createDataFrame(list(ranks.items()), schema)
    return rrf([(d, dense_weight), (s, sparse_weight)], key, k).orderBy(F.desc("score"), key).limit(limit)


def recency_boost(fused: DataFrame, dates: DataFrame, key: str, weight: float = 0.5) -> DataFrame:
    """`fused` (key, score) times 1 + weight * place of its date (epoch seconds) between the oldest and the newest.

    The place is 1/2 if they lie less than a second apart; a row without a date is not boosted.
    """
    dated = fused.join(dates.select(key, F.col("date").cast("double").alias("date")), key, "left")
    span = dated.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    f = F.when(F.col("hi") - F.col("lo") < 1, 0.5).otherwise((F.col("date") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    boosted = F.col("score") * F.coalesce(1 + F.lit(float(weight)) * f, F.lit(1.0))
    return dated.crossJoin(F.broadcast(span)).select(key, boosted.alias("score"))  # one row
