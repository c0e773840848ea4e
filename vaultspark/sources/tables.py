"""Tables of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files make fewer partitions than there are cores; else as it is.

    A table of one row group would be worked on by one task. Such a table is small, so dealing it out
    is cheap; a large one has partitions enough and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
