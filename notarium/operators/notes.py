"""MIDI events and tempo changes to timed notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.expressions import trunc_div
from notarium.operators import scan
from notarium.operators.keyboard import LOWEST_PITCH

# Fixed values.
DEFAULT_US_PER_QUARTER = 500_000
HIGHEST_KEY = 86  # the key range stops one short of the 88th key
UPPER_HAND_KEY = 39


def pair_notes(events: DataFrame, track_keys: Sequence[str] = ("file", "track"), whole_tracks: bool = False,
               stretches: int | None = None) -> DataFrame:
    """Note-on and note-off rows to notes: the first open note of a pitch takes the next off.

    ``events``: the track keys, ``seq`` (unique and rising inside a track), ``tick``,
    ``kind`` (``on``/``off``), ``channel``, ``pitch``, ``velocity``.  An on with velocity 0
    is an off.  An off with nothing open is ignored; a note never closed is dropped.  Where
    events carry ``ppq``, the ticks per quarter of their file, the notes carry it on; where they
    carry ``us``, their time (see ``event_times``), notes get ``start_us`` and ``dur_us``.

    ``whole_tracks`` says that a track fits into one task, as it does where a decoder has
    just held its whole file; then nothing is carried.  Otherwise all rows are dealt out by
    ranges of (lane, ``seq``) that hold about equally many rows, however sparse the numbers are and
    however large one lane is; what a lane has in one range is a stretch.  ``stretches`` is the
    number of ranges, by default the session's number of shuffle partitions.

    The k-th on of a pitch meets the k-th off that found an open note.  With ``level`` the
    running sum of +1/-1, an off found nothing exactly when it takes ``level`` to a new
    minimum below zero, and the number of such offs so far is minus that minimum; so one
    running sum and one running minimum number both sides.  The pairing is then a plain
    equi-join on a unique ordinal.
    """
    lane = [*track_keys, "channel", "pitch"]
    resolution = ["ppq"] if "ppq" in events.columns else []
    times = ["us"] if "us" in events.columns else []
    is_on = (F.col("kind") == "on") & (F.col("velocity") > 0)
    rows = (
        events.filter(F.col("kind").isin("on", "off"))
        .select(*lane, "seq", "tick", "velocity", F.when(is_on, 1).otherwise(0).alias("on"), *resolution, *times)
    )
    if not whole_tracks:
        rows = scan.ranged(rows, [*lane, "seq"], stretches)
    upto = scan.upto(lane, "seq", whole=whole_tracks)
    stepped = rows.withColumns({
        "ons": F.sum("on").over(upto),
        "level": F.sum(2 * F.col("on") - 1).over(upto),
    }).withColumn("low", F.min("level").over(upto))

    if whole_tracks:
        carried = stepped.withColumns({n: F.lit(0).cast("bigint") for n in ("ons_in", "level_in", "low_in")})
    else:
        per_bucket = stepped.groupBy(*lane, scan.BUCKET).agg(
            F.sum("on").alias("ons_all"),
            F.sum(2 * F.col("on") - 1).alias("level_all"),
            F.min("level").alias("low_all"),
        )
        earlier = scan.earlier_buckets(lane)
        carry = (
            per_bucket.withColumns({
                "ons_in": F.coalesce(F.sum("ons_all").over(earlier), F.lit(0)),
                "level_in": F.coalesce(F.sum("level_all").over(earlier), F.lit(0)),
            })
            .withColumn(
                "low_in", F.coalesce(F.min(F.col("level_in") + F.col("low_all")).over(earlier), F.lit(0)))
            .select(*lane, scan.BUCKET, "ons_in", "level_in", "low_in")
        )
        carried = scan.with_carry(stepped, carry, lane)
    level = F.col("level_in") + F.col("level")
    floor = F.least(F.lit(0), F.col("low_in"), F.col("level_in") + F.col("low"))
    numbered = carried.select(
        *lane, "tick", "velocity", "on", *resolution, *times,
        (F.col("ons_in") + F.col("ons")).alias("ons"),
        level.alias("level"),
        floor.alias("floor"),
    )
    # offs so far = ons - level; those that found nothing = -floor.
    ordinal = F.when(F.col("on") == 1, F.col("ons")).otherwise(F.col("ons") - F.col("level") + F.col("floor"))
    opened = numbered.withColumn("ordinal", ordinal)
    # An ordinal has one on at most.  An ignored off repeats the ordinal of the last valid
    # off (or has 0) and comes after it, so the earliest tick is the valid one.
    per_note = opened.groupBy(*lane, "ordinal").agg(
        F.max(F.when(F.col("on") == 1, F.col("tick"))).alias("start_tick"),
        F.max(F.when(F.col("on") == 1, F.col("velocity"))).alias("velocity"),
        F.min(F.when(F.col("on") == 0, F.col("tick"))).alias("off_tick"),
        *[F.max(c).alias(c) for c in resolution],
        *[F.max(F.when(F.col("on") == 1, F.col(c))).alias("start_us") for c in times],
        *[F.min(F.when(F.col("on") == 0, F.col(c))).alias("end_us") for c in times],
    )
    return per_note.filter(F.col("start_tick").isNotNull() & F.col("off_tick").isNotNull()).select(
        *track_keys, "channel", "pitch", "start_tick",
        (F.col("off_tick") - F.col("start_tick")).alias("len_ticks"), "velocity", *resolution,
        *["start_us" for _ in times], *[(F.col("end_us") - F.col("start_us")).alias("dur_us") for _ in times],
    )


def tempo_segments(tempo: DataFrame, song_keys: Sequence[str] = ("song_id",), default_us: int = DEFAULT_US_PER_QUARTER) -> DataFrame:
    """Tempo changes to segments with the time base at their start.

    ``tempo``: song keys, ``tick``, ``us_per_quarter`` and, where several changes share a
    tick, optionally ``seq`` (the last one counts).  Result: song keys, ``tick``,
    ``us_per_quarter``, ``base_num``; ``base_num`` is microseconds times ticks per quarter,
    kept whole so that nothing is rounded twice.
    """
    keys = list(song_keys)
    last = F.max_by("us_per_quarter", "seq") if "seq" in tempo.columns else F.max("us_per_quarter")
    rows = (
        tempo.groupBy(*keys, "tick")
        .agg(last.cast("bigint").alias("us_per_quarter"))
        .withColumn(scan.BUCKET, scan.bucket("tick", scan.TICK_BITS))
    )
    upto = scan.upto(keys, "tick")
    in_order = Window.partitionBy(*keys, scan.BUCKET).orderBy("tick")
    stretch = (F.col("tick") - F.lag("tick").over(in_order)) * F.lag("us_per_quarter").over(in_order)
    local = rows.withColumn("_step", F.coalesce(stretch, F.lit(0))).withColumn(
        "_sum", F.sum("_step").over(upto)
    )
    per_bucket = local.groupBy(*keys, scan.BUCKET).agg(
        F.min("tick").alias("_first"),
        F.max(F.struct("tick", "us_per_quarter")).alias("_last"),
        F.sum("_step").alias("_inside"),
    )
    over = scan.earlier_buckets(keys)
    previous = F.last("_last").over(over)
    lead_in = F.coalesce(
        (F.col("_first") - previous["tick"]) * previous["us_per_quarter"],
        F.col("_first") * F.lit(default_us),
    )
    carry = (
        per_bucket.withColumn("_lead", lead_in)
        .withColumn("_before", F.coalesce(F.sum(F.col("_lead") + F.col("_inside")).over(over), F.lit(0)))
        .select(*keys, scan.BUCKET, (F.col("_before") + F.col("_lead")).alias("_base"))
    )
    return scan.with_carry(local, carry, keys).select(
        *keys, "tick", "us_per_quarter", (F.col("_base") + F.col("_sum")).alias("base_num")
    )


def _rounded_us(num: Column, ppq: Column | int) -> Column:
    """Microseconds from the whole numerator, halves rounded up."""
    ppq = F.lit(ppq).cast("bigint") if isinstance(ppq, int) else ppq.cast("bigint")
    return trunc_div(num + trunc_div(ppq, 2), ppq)


def _as_of(points: DataFrame, segments: DataFrame, keys: list[str], ppq: int, default_us: int) -> DataFrame:
    """Add ``us``, the time of each point's ``tick``, by the last tempo change at or before it.

    Points and changes meet in one union ordered by tick, so there is one sort and no range join.
    """
    columns = points.columns
    marked = points.select("*", F.lit(1).alias("_is_point"), F.lit(None).cast("struct<tick:bigint,us_per_quarter:bigint,base_num:bigint>").alias("_change"))
    changes = segments.select(*keys, "tick", F.lit(0).alias("_is_point"), F.struct("tick", "us_per_quarter", "base_num").alias("_change"))
    rows = marked.unionByName(changes, allowMissingColumns=True).withColumn(scan.BUCKET, scan.bucket("tick", scan.TICK_BITS))
    local = rows.withColumn("_near", F.last("_change", ignorenulls=True).over(scan.upto(keys, "tick", "_is_point")))
    place = scan.bucket("tick", scan.TICK_BITS).alias(scan.BUCKET)
    fields = ("tick", "us_per_quarter", "base_num")
    buckets = (
        points.select(*keys, place, *[F.lit(None).cast("bigint").alias(f) for f in fields])
        .unionByName(segments.select(*keys, place, *fields))
        .groupBy(*keys, scan.BUCKET)
        .agg(F.max("tick").alias("tick"), *[F.max_by(f, "tick").alias(f) for f in fields[1:]])
    )
    last = F.when(F.col("tick").isNotNull(), F.struct(*fields))
    carry = buckets.select(
        *keys, scan.BUCKET, F.last(last, ignorenulls=True).over(scan.earlier_buckets(keys)).alias("_earlier"),
    )
    found = scan.with_carry(local.filter(F.col("_is_point") == 1), carry, keys).withColumn("_use", F.coalesce("_near", "_earlier"))
    numerator = F.coalesce(
        F.col("_use.base_num") + (F.col("tick") - F.col("_use.tick")) * F.col("_use.us_per_quarter"),
        F.col("tick") * F.lit(default_us),
    )
    return found.select(*columns, _rounded_us(numerator, F.col("ppq") if "ppq" in columns else ppq).alias("us"))


def event_times(rows: DataFrame, song_keys: Sequence[str] = ("file",), order: Sequence[str] = ("track", "seq"), ppq: int = 480,
                default_us: int = DEFAULT_US_PER_QUARTER) -> DataFrame:
    """Add ``us``, the time of each row, for songs that fit into one task, as they do where a decoder has just held their files.

    ``rows``: the song keys, ``tick``, ``us_per_quarter`` on tempo changes and NULL elsewhere, the
    columns of ``order``, of which the last change of one tick is the one that counts, and, where
    it varies, ``ppq``.  Changes and notes are one table here, so a song's rows are dealt out once, by
    the song; later steps on it move nothing.  See ``tempo_segments`` and ``note_times`` for
    songs of any length.
    """
    is_change = F.col("us_per_quarter").isNotNull()
    place = Window.partitionBy(*song_keys).orderBy("tick", F.when(is_change, 0).otherwise(1), *order)
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    in_force = F.coalesce(F.last("us_per_quarter", ignorenulls=True).over(earlier).cast("bigint"), F.lit(default_us).cast("bigint"))
    stepped = rows.withColumn("_step", (F.col("tick") - F.coalesce(F.lag("tick").over(place), F.lit(0))) * in_force)
    summed = F.sum("_step").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn("us", _rounded_us(summed, F.col("ppq") if "ppq" in rows.columns else ppq)).drop("_step")


def tick_times(ticks: DataFrame, segments: DataFrame, song_keys: Sequence[str] = ("song_id",),
               ppq: int = 480, default_us: int = DEFAULT_US_PER_QUARTER) -> DataFrame:
    """Time of each distinct tick (as-of join).  ``ticks`` needs the song keys, ``tick`` and, where it varies, ``ppq``."""
    keys = list(song_keys)
    kept = [*keys, "tick", *(["ppq"] if "ppq" in ticks.columns else [])]
    return _as_of(ticks.select(*kept).distinct(), segments, keys, ppq, default_us)


def ticks_to_us(df: DataFrame, tick_col: str, segments: DataFrame, out: str,
                song_keys: Sequence[str] = ("song_id",), ppq: int = 480) -> DataFrame:
    """Add the time of one tick column."""
    keys = list(song_keys)
    per_row = ["ppq"] if "ppq" in df.columns else []
    points = df.select(*keys, F.col(tick_col).alias("tick"), *per_row)
    times = tick_times(points, segments, keys, ppq)
    on = [*keys, *per_row, tick_col]
    return df.join(times.withColumnsRenamed({"tick": tick_col, "us": out}), on, "left")


def note_times(notes: DataFrame, segments: DataFrame, song_keys: Sequence[str] = ("song_id",), ppq: int = 480,
               default_us: int = DEFAULT_US_PER_QUARTER) -> DataFrame:
    """Add ``start_us`` and ``dur_us``; a tempo change inside a note counts.

    Both ends of a note go into one as-of union together with the note, and meet again by one
    aggregate over it; nothing is joined back.  Equal notes are told apart again by their number.
    """
    keys = list(song_keys)
    per_row = ["ppq"] if "ppq" in notes.columns else []
    own = [c for c in notes.columns if c not in ("start_us", "dur_us")]
    ends = notes.select(
        *keys, *per_row, F.struct(*own).alias("_note"),
        F.posexplode(F.array("start_tick", F.col("start_tick") + F.col("len_ticks"))).alias("_end", "tick"))
    times = _as_of(ends, segments, keys, ppq, default_us)
    at = lambda end: F.max(F.when(F.col("_end") == end, F.col("us")))
    met = times.groupBy("_note").agg(
        at(0).alias("start_us"), (at(1) - at(0)).alias("dur_us"), F.count_if(F.col("_end") == 0).cast("int").alias("_copies"))
    return met.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_note.*", "start_us", "dur_us")


def steady_times(notes: DataFrame, us_per_quarter: int = DEFAULT_US_PER_QUARTER, ppq: int = 480) -> DataFrame:
    """``note_times`` for songs without tempo changes: closed form, no shuffle."""
    per_row = F.col("ppq") if "ppq" in notes.columns else F.lit(ppq)
    start = _rounded_us(F.col("start_tick") * us_per_quarter, per_row)
    end = _rounded_us((F.col("start_tick") + F.col("len_ticks")) * us_per_quarter, per_row)
    return notes.withColumns({"start_us": start, "dur_us": end - start})


def playable(notes: DataFrame, max_key: int = HIGHEST_KEY) -> DataFrame:
    """Keep notes on the keyboard; the default leaves out the top key, 87 admits it."""
    return notes.filter(F.col("pitch").between(LOWEST_PITCH, LOWEST_PITCH + max_key))


def key_index(pitch: Column | str) -> Column:
    pitch = F.col(pitch) if isinstance(pitch, str) else pitch
    return (pitch - LOWEST_PITCH).cast("int")


def key_pitch(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return (key + LOWEST_PITCH).cast("int")


def to_seconds(us: Column | str) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return us.cast("double") / F.lit(1_000_000.0)


def hand(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key >= UPPER_HAND_KEY, "upper").otherwise("lower")


def timed_notes(timed: DataFrame, song_keys: Sequence[str] = ("song_id",), max_key: int = HIGHEST_KEY) -> DataFrame:
    """The note table of a song list: playable notes with key, hand, start and duration."""
    key = key_index("pitch")
    return playable(timed, max_key).select(
        *song_keys, key.alias("key_index"), F.col("velocity").cast("int").alias("velocity"),
        "start_us", "dur_us", hand(key).alias("hand"),
    )


def reset_flags(notes: DataFrame) -> DataFrame:
    """Flags of freshly loaded notes: nothing plays, nothing has played."""
    return notes.withColumns({"is_playing": F.lit(False), "has_played": F.lit(False)})


def song_duration(songs: DataFrame, notes: DataFrame, song_keys: Sequence[str] = ("song_id",)) -> DataFrame:
    """Last note end of each listed song in seconds, 1 for a song without notes."""
    keys = list(song_keys)
    ends = notes.groupBy(*keys).agg(F.max(F.col("start_us") + F.col("dur_us")).alias("duration_us"))
    return (
        songs.select(*keys).distinct().join(ends, keys, "left")
        .withColumn("duration_us", F.coalesce("duration_us", F.lit(1_000_000).cast("bigint")))
        .withColumn("duration", to_seconds("duration_us"))
    )


def unclosed_notes(events: DataFrame, notes: DataFrame, track_keys: Sequence[str] = ("file", "track")) -> DataFrame:
    """Per track, how many note-ons never found their off (the rejects of ``pair_notes``)."""
    keys = list(track_keys)
    ons = events.filter((F.col("kind") == "on") & (F.col("velocity") > 0)).groupBy(*keys).agg(
        F.count("*").alias("ons"))
    paired = notes.groupBy(*keys).agg(F.count("*").alias("paired"))
    return ons.join(paired, keys, "left").select(
        *keys, (F.col("ons") - F.coalesce("paired", F.lit(0))).alias("unclosed")
    ).filter(F.col("unclosed") > 0)
