"""Bounded samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_class(df: DataFrame, key: str, label: str, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` rows, twice as many at most, chosen by a hash of ``key``; all rows if there are no more.

    A class, however rare, gives its share or ``rows`` / (4 * classes) of its rows, whichever is more, or all it has;
    column ``rate`` has the share of its class that was chosen. With more than ``rows`` / 4 classes that would be less
    than a row, and all give their share; so the table of rates that is broadcast has ``rows`` / 4 rows at most, and the
    rows themselves are filtered where they lie. Reruns choose the same rows. Only fitting uses this; nothing that is
    predicted, counted or compared does.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("of_class"))
    total, classes = sizes.agg(F.coalesce(F.sum("of_class"), F.lit(0)), F.count("*")).first()
    if total <= rows:
        return df.withColumn("rate", F.lit(1.0))
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    if classes > rows // 4:
        return df.withColumn("rate", F.lit(rows / total)).where(share < F.col("rate")).limit(2 * rows)
    rates = sizes.select(label, F.least(F.lit(1.0), F.greatest(F.lit(rows / total), F.lit(rows / (4 * classes)) / F.col("of_class"))).alias("rate"))
    return df.join(F.broadcast(rates), label).where(share < F.col("rate")).limit(2 * rows)
