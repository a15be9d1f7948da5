"""Playback clock under pauses and seeks, and gates replayed along it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.operators import scan
from notarium.operators.playback import AUDIO_OFFSET_US, gates_from_edges, note_edges, trigger_times


def playback_clock(log: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Clock after each row of a control log.

    ``log``: keys, ``seq`` (unique inside a key), ``kind`` (``frame``, ``pause`` or
    ``seek``), ``value_us`` (target of a seek), ``dt_us`` (length of a frame).  Frames add
    their length unless paused, a pause row toggles, a seek sets the clock and starts a new
    segment.  Adds ``paused``, ``segment`` and ``clock_us``.

    Whether a bucket starts paused is unknown until the buckets before it are counted, so
    each bucket is scanned once for both cases (``_run0`` starting live, ``_run1``
    starting paused) and the carried parity picks one.
    """
    keys = list(keys)
    is_pause, is_seek = F.col("kind") == "pause", F.col("kind") == "seek"
    upto = scan.upto(keys, "seq")
    step = F.when(F.col("kind") == "frame", F.col("dt_us")).otherwise(0).cast("bigint")
    rows = log.withColumn(scan.BUCKET, scan.bucket("seq", scan.SEQ_BITS)).withColumns({
        "_flip": F.sum(F.when(is_pause, 1).otherwise(0)).over(upto),
        "_seeks": F.sum(F.when(is_seek, 1).otherwise(0)).over(upto),
    })
    live = F.col("_flip") % 2 == 0
    rows = rows.withColumns({
        "_run0": F.sum(F.when(live, step).otherwise(0)).over(upto),
        "_run1": F.sum(F.when(~live, step).otherwise(0)).over(upto),
    })
    seek = F.when(is_seek, F.struct(
        F.col("seq").alias("seq"), F.col("value_us").cast("bigint").alias("value"), F.col("_run0").alias("run0"),
        F.col("_run1").alias("run1")))
    rows = rows.withColumn("_seek", F.last(seek, ignorenulls=True).over(upto))

    totals = rows.groupBy(*keys, scan.BUCKET).agg(
        F.max("_flip").alias("_flips"), F.max("_seeks").alias("_seek_count"),
        F.max("_run0").alias("_sum0"), F.max("_run1").alias("_sum1"), F.max("_seek").alias("_last_seek"),
    )
    earlier = scan.earlier_buckets(keys)

    def pick(odd: Column, zero: str | Column, one: str | Column) -> Column:
        zero = F.col(zero) if isinstance(zero, str) else zero
        one = F.col(one) if isinstance(one, str) else one
        return F.when(odd, one).otherwise(zero)

    odd = F.col("_odd")
    carry = (
        totals.withColumns({
            "_odd": F.coalesce(F.sum("_flips").over(earlier), F.lit(0)) % 2 == 1,
            "_segments_in": F.coalesce(F.sum("_seek_count").over(earlier), F.lit(0)),
        })
        .withColumn("_sum_in", F.coalesce(F.sum(pick(odd, "_sum0", "_sum1")).over(earlier), F.lit(0)))
        # What a seek adds to the plain sum of frames from there on.
        .withColumn("_shift", F.col("_last_seek.value") - F.col("_sum_in")
                    - pick(odd, "_last_seek.run0", "_last_seek.run1"))
        .withColumn("_shift_in", F.coalesce(F.last("_shift", ignorenulls=True).over(earlier), F.lit(0)))
        .select(*keys, scan.BUCKET, "_odd", "_segments_in", "_sum_in", "_shift_in")
    )
    total = F.col("_sum_in") + pick(odd, "_run0", "_run1")
    shift = F.coalesce(
        F.col("_seek.value") - F.col("_sum_in") - pick(odd, "_seek.run0", "_seek.run1"), F.col("_shift_in")
    )
    return scan.with_carry(rows, carry, keys).select(
        *log.columns,
        (odd != (F.col("_flip") % 2 == 1)).alias("paused"),
        (F.col("_segments_in") + F.col("_seeks")).alias("segment"),
        (total + shift).alias("clock_us"),
    )


def silence_points(clock: DataFrame) -> DataFrame:
    """Rows of a clock at which everything is silenced: seeks and the start of a pause."""
    return clock.filter((F.col("kind") == "seek") | ((F.col("kind") == "pause") & F.col("paused")))


def opening_points(log: DataFrame, keys: Sequence[str] = ("session",), offset_us: int = AUDIO_OFFSET_US) -> DataFrame:
    """Two more points of each session at which everything is silenced: ``start`` of the program, and
    ``load`` of its song.

    They have sequence numbers before the session's first row and the earliest time that a note can
    trigger at, so that they come before every gate.  Columns: keys, ``seq``, ``kind``, ``clock_us``.
    """
    points = F.array(*[F.struct(F.lit(back).alias("back"), F.lit(kind).alias("kind")) for back, kind in ((2, "start"), (1, "load"))])
    first = log.groupBy(*keys).agg(F.min("seq").alias("_first")).withColumn("_point", F.explode(points))
    return first.select(*keys, (F.col("_first") - F.col("_point.back")).alias("seq"), F.col("_point.kind").alias("kind"),
                        F.lit(-offset_us).cast("bigint").alias("clock_us"))


def clock_segments(clock: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """First and last clock value of each stretch between seeks."""
    return clock.groupBy(*keys, "segment").agg(
        F.min(F.when(F.col("kind") == "seek", F.col("clock_us"))).alias("seek_us"),
        F.max("clock_us").alias("seg_end_us"),
    ).select(
        *keys, "segment",
        # The first stretch has no seek: it also fires what triggers before clock 0.
        F.col("seek_us").alias("seg_start_us"), "seg_end_us",
    )


def replay_gates(notes: DataFrame, segments: DataFrame, song_keys: Sequence[str] = ("song_id",),
                 keys: Sequence[str] = ("session",), offset_us: int = AUDIO_OFFSET_US) -> DataFrame:
    """Gate events of each stretch of a replay.

    ``segments``: keys, song keys, ``segment``, ``seg_start_us``, ``seg_end_us``.  A stretch
    fires the notes whose trigger lies inside it; notes already sounding at its start stay
    silent, counters start at zero, and an end past the stretch is never sent (the seek
    silences everything).  A pause stops the clock and keeps the counters, so it changes
    nothing here.

    Notes and stretches meet on ``(song, bucket of time)``, each stretch listed once per
    bucket it touches, so only the two outermost buckets of a stretch yield pairs that the
    range filter then removes.
    """
    cell = "_cell"
    low = F.coalesce("seg_start_us", F.lit(-offset_us).cast("bigint"))
    spread = segments.filter(low <= F.col("seg_end_us")).withColumn("_low", low).withColumn(
        cell, F.explode(F.sequence(scan.bucket("_low", scan.CLOCK_BITS), scan.bucket("seg_end_us", scan.CLOCK_BITS)))
    )
    timed = trigger_times(notes, offset_us).withColumn(cell, scan.bucket("trigger_us", scan.CLOCK_BITS))
    fired = timed.join(spread, [*song_keys, cell]).filter(
        F.col("trigger_us").between(F.col("_low"), F.col("seg_end_us"))
    )
    heard = fired.withColumn("end_us", F.when(F.col("end_us") <= F.col("seg_end_us"), F.col("end_us")))
    lane = [*keys, "segment", *song_keys, "key_index"]
    return gates_from_edges(note_edges(heard, lane), lane)
