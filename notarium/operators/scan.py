"""Running values over an order, safe for one very large key.

A window per song puts a whole song into one task.  Every running value here is
computed in two levels instead.  Rows go to ``(keys, bucket)`` groups, where a bucket
is a fixed stretch of the order axis; each group is scanned on its own.  One row of
totals per group is then scanned over the buckets of a key, and joined back as the
value carried into the group.  Callers make the order unique inside a key (by summing
rows of one instant first, or by ordering on a sequence number), so a group never holds
more rows than its bucket is wide, and the second level holds one row per bucket.

Totals come from the caller's own input through an ordinary aggregate, so they are
combined before the shuffle, and the join back is a broadcast whenever the measured
size of the totals allows it.  Keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from notarium.session import materialise

# Widths of one bucket, as powers of two.
CLOCK_BITS = 24  # microseconds: about 17 seconds
TICK_BITS = 20  # MIDI ticks
SEQ_BITS = 20  # sequence numbers of a control log
BUCKET = "_bucket"


def bucket(order: Column | str, bits: int) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.shiftright(order.cast("bigint"), bits)


def upto(keys: Sequence[str], *order: Column | str, whole: bool = False) -> WindowSpec:
    """Rows of one bucket up to and including the current one.

    ``whole`` leaves the bucket out, for keys that the caller knows to be small: later steps
    on the same keys then need no further shuffle.
    """
    return (
        Window.partitionBy(*keys, *([] if whole else [BUCKET]))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def before(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    """Rows of one bucket strictly before the current one."""
    return (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def earlier_buckets(keys: Sequence[str]) -> WindowSpec:
    """Buckets of one key strictly before the current one (the second level)."""
    return Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def ranged(rows: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows with a bucket by ranges of ``order``, which hold about equally many rows each.

    For orders whose values may lie anywhere, so that no fixed width suits them.  Ranges are
    drawn from a sample, which another run of the same plan may draw differently; the
    rows are therefore written with their bucket once, and every branch reads that.
    """
    parted = rows.repartitionByRange(*order) if parts is None else rows.repartitionByRange(parts, *order)
    return materialise(parted.withColumn(BUCKET, F.spark_partition_id()), "ranges")


def with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the values carried into each bucket to the rows of that bucket."""
    return rows.join(carry, [*keys, BUCKET], "left")
