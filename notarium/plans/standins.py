"""Music tables derived from the relational test tables by exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from notarium.session import scratch_path, spread

# File kinds in turn, chosen by key.
INPUT_SUFFIXES = (".png", ".JPG", ".pdf", ".xml", ".mxl", ".mid", ".midi", ".jpeg", ".XML")
# Two names the vocabulary does not know.
ELEMENT_CLASSES = ("Note", "TrebleClef", "BassClef", "TimeSig", "MeasureNumber", "BarLine", "Rest",
                   "StaffLines", "Slur", "Stem")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tick_notes_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_suppkey").alias("song_id"),
        (F.col("l_partkey") % 128).cast("int").alias("pitch"),
        ((F.col("l_orderkey") * 1009 + F.col("l_linenumber") * 97) % 200000).alias("start_tick"),
        (F.col("l_quantity").cast("bigint") * 48).alias("len_ticks"),
        (1 + F.col("l_orderkey") % 127).cast("int").alias("velocity"),
    )


def tick_notes(spark: SparkSession, folder: str) -> DataFrame:
    return tick_notes_of(table(spark, folder, "lineitem"))


def tempo(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("song_id"),
        ((F.col("o_orderkey") * 7919) % 200000).alias("tick"),
        (300000 + (F.col("o_orderkey") * 31) % 400000).cast("int").alias("us_per_quarter"),
    )


def midi_events(spark: SparkSession, folder: str) -> DataFrame:
    """Note-on and note-off rows; ``seq`` rises with the tick, offs before ons, ons of one tick by velocity."""
    line = table(spark, folder, "lineitem")
    # The velocity is the order key's remainder by 127, so that key is whole in remainder and quotient.
    key = F.col("l_orderkey")
    place = ((key % 127) * F.lit(1 << 37) + F.call_function("div", key, F.lit(127)) * 8 + F.col("l_linenumber")).alias("place")
    notes = line.select("*", place).select(
        F.col("l_suppkey").alias("file"),
        (F.col("l_partkey") % 128).cast("int").alias("pitch"),
        ((F.col("l_orderkey") * 1009 + F.col("l_linenumber") * 97) % 200000).alias("start_tick"),
        (F.col("l_quantity").cast("bigint") * 48).alias("len_ticks"),
        (1 + F.col("l_orderkey") % 127).cast("int").alias("velocity"),
        "place",
    )

    def event(kind: str, tick, velocity):
        order = (tick * 2 + (1 if kind == "on" else 0)) * F.lit(1 << 44) + F.col("place")
        return F.struct(order.alias("seq"), tick.alias("tick"), F.lit(kind).alias("kind"), velocity.alias("velocity"))

    both = F.array(
        event("on", F.col("start_tick"), F.col("velocity")),
        event("off", F.col("start_tick") + F.col("len_ticks"), F.lit(0)),
    )
    return notes.select(
        "file", F.lit(0).alias("track"), F.lit(0).alias("channel"), "pitch", F.explode(both).alias("e")
    ).select("file", "track", "channel", "pitch", "e.*")


def control_log_of(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "seek").when(F.col("event_type") == "view", "pause").otherwise("frame")
    return events.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.round(F.col("value") * 1000000).cast("bigint").alias("value_us"),
        F.round(F.col("value") * 1000).cast("bigint").alias("dt_us"),
    )


def control_log(spark: SparkSession, folder: str) -> DataFrame:
    return control_log_of(table(spark, folder, "events"))


def page_paths(pages: DataFrame) -> DataFrame:
    suffixes = F.array(*[F.lit(s) for s in INPUT_SUFFIXES])
    return pages.select(
        F.concat("url", F.lit("/p"), F.col("page_id"),
                 F.element_at(suffixes, (F.col("page_id") % 9).cast("int") + 1)).alias("path"))


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of two kinds: web addresses and plain file names."""
    suffixes = F.array(*[F.lit(s) for s in INPUT_SUFFIXES])
    pages = page_paths(table(spark, folder, "pages"))
    parts = table(spark, folder, "part").select(
        F.concat(F.lit("/in/"), F.replace("p_name", F.lit(" "), F.lit("_")),
                 F.element_at(suffixes, (F.col("p_partkey") % 9).cast("int") + 1)).alias("path"))
    return pages.unionByName(parts)


def document_id():
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", cents)


def svg_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One small page per order line: outline, nested groups, symbols, curves, odd cases.

    A page in sixteen has an outline without width.
    """
    line = spread(table(spark, folder, "lineitem"))
    names = F.array(*[F.lit(c) for c in ELEMENT_CLASSES])
    q = F.col("l_quantity").cast("bigint")
    a, b = F.col("l_partkey") % 1000, F.col("l_orderkey") % 1500
    cls = F.element_at(names, (F.col("l_partkey") % 10).cast("int") + 1)
    outline = F.when(
        F.col("l_orderkey") % 4 == 0, ""
    ).when(F.col("l_orderkey") % 16 == 3, '<path d="M0,0 L0,2000"/>').otherwise(F.concat(
        F.lit('<path d="M0,0 L'), 1000 + q, F.lit(",0 L"), 1000 + q, F.lit(",2000 L0,2000 Z\"/>")))
    own = F.lit('<path class="Rest" transform="translate(50,50)" d="M0,0 l10,')
    svg = F.concat(
        F.lit('<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg">'), outline,
        F.lit('<g transform="translate('), q, F.lit(","), F.col("l_linenumber"), F.lit(')"><g transform="scale(2)">'),
        F.lit('<g transform="rotate(3) translate('), -q, F.lit(' 7.5)"><use class="'), cls, F.lit('" x="'), a,
        F.lit('" y="'), b, F.lit('"/></g></g><path class="Note" d="M'), a, F.lit(" "), b, F.lit(" C"), a, F.lit(" "),
        b + 40, F.lit(" "), a + 20, F.lit(" "), b + 40, F.lit(" "), a + 20, F.lit(" "), b, F.lit(' Z"/></g>'),
        F.lit('<use class="BarLine" x="'), F.when(F.col("l_linenumber") == 7, F.lit("abc")).otherwise(a.cast("string")),
        F.lit('" y="'), b, F.lit('"/><use class="Rest" y="'), q, F.lit('"/>'),
        own, q, F.lit(' z"/><path class="Note"/><polyline class="StaffLines" points="5,0 5,100"/></svg>'),
    )
    return line.select(F.concat(document_id(), F.lit(".svg")).alias("file"), svg.alias("svg"))


def _hex(number, digits: int):
    return F.lpad(F.hex(number), digits, "0")


def _quantity(number):
    """A MIDI variable-length number in three bytes, as hex digits."""
    n = number.cast("bigint")
    return F.concat(
        _hex(F.shiftright(n, 14).bitwiseAND(127) + 128, 2),
        _hex(F.shiftright(n, 7).bitwiseAND(127) + 128, 2),
        _hex(n.bitwiseAND(127), 2),
    )


MIDI_DIVISIONS = (96, 480, 960)


def midi_files(spark: SparkSession, folder: str) -> DataFrame:
    """One MIDI file per order line: a tempo track with a change, and two overlapping notes of one pitch.

    Files differ in their ticks per quarter; the change may fall before, into or after the notes.
    """
    line = spread(table(spark, folder, "lineitem"))
    pitch, velocity = F.col("l_partkey") % 128, 1 + F.col("l_orderkey") % 127
    length = F.col("l_quantity").cast("bigint") * 48
    division = F.element_at(F.array(*[F.lit(d) for d in MIDI_DIVISIONS]), (F.col("l_partkey") % 3).cast("int") + 1)
    us = 300000 + (F.col("l_orderkey") * 31) % 400000
    tempo_track = F.concat(
        F.lit("00FF5103"), _hex(us, 6), _quantity(F.col("l_orderkey") % 1000), F.lit("FF5103"), _hex(us + 100000, 6),
        F.lit("00FF2F00"))
    note_track = F.concat(
        _quantity(F.col("l_linenumber") * 97), F.lit("90"), _hex(pitch, 2), _hex(velocity, 2),
        F.lit("00FF010141"),  # a text; the status before it goes on
        _quantity(F.lit(24)), _hex(pitch, 2), F.lit("40"),
        _quantity(length - 24), _hex(pitch, 2), F.lit("00"),  # on with velocity 0 is an off
        _quantity(length), F.lit("80"), _hex(pitch, 2), F.lit("40"),
        F.lit("00FF2F00"),
    )

    def chunk(track):
        return F.concat(F.lit("4D54726B"), _hex(F.length(track) / 2, 8), track)

    content = F.unhex(F.concat(
        F.lit("4D5468640000000600010002"), _hex(division, 4), chunk(tempo_track), chunk(note_track)))
    return line.select(document_id().alias("file"), content.alias("content"))


def broken_midi_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same files, one in seven cut short, one in seven without its header."""
    number = F.element_at(F.split("file", "-"), 3)
    content = (
        F.when(number == "7", F.expr("substring(content, 1, length(content) - 5)"))
        .when(number == "3", F.expr("substring(content, 2)")).otherwise(F.col("content")))
    return midi_files(spark, folder).withColumn("content", content)


def score_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One small score per order line: two voices, a chord, a rest, repeats, changing
    divisions, a tempo, a loudness, a tie; some in the time-wise layout."""
    line = spread(table(spark, folder, "lineitem"))
    q, octave = F.col("l_quantity").cast("bigint"), 2 + F.col("l_linenumber") % 5
    divisions = F.element_at(F.array(*[F.lit(d) for d in (1, 2, 4, 8)]), (F.col("l_partkey") % 4).cast("int") + 1)
    steps = F.array(*[F.lit(s) for s in "CDEFGAB"])
    step = F.element_at(steps, (F.col("l_orderkey") % 7).cast("int") + 1)

    def note(pitch, duration, extra=""):
        return F.concat(F.lit(f"<note>{extra}"), pitch, F.lit("<duration>"), duration, F.lit("</duration></note>"))

    def pitched(name, alter, oct_):
        return F.concat(F.lit("<pitch><step>"), name, F.lit(f"</step><alter>{alter}</alter><octave>"), oct_,
                        F.lit("</octave></pitch>"))

    first = F.concat(
        F.lit("<attributes><divisions>"), divisions,
        F.lit('</divisions></attributes><barline><repeat direction="forward"/></barline>'),
        note(pitched(step, 1, octave), q), note(pitched(F.lit("E"), 0, octave), q, "<chord/>"),
        note(F.lit("<rest/>"), F.lit(2)),
        F.lit("<backup><duration>"), q + 2, F.lit("</duration></backup>"),
        note(pitched(F.lit("C"), -1, F.lit(3)), q + 1),
        F.lit("<direction><direction-type><segno/></direction-type></direction>"),
    )
    loud = F.when(F.col("l_linenumber") % 2 == 0, "<f/>").otherwise("<p/>")
    second = F.concat(
        F.lit("<attributes><divisions>2</divisions></attributes><direction><direction-type><dynamics>"), loud,
        F.lit('</dynamics></direction-type><sound tempo="'), 60 + F.col("l_orderkey") % 90, F.lit('"/></direction>'),
        note(pitched(F.lit("B"), 0, F.lit(4)), F.lit(3), '<tie type="start"/>'),
    )
    third = note(pitched(F.lit("B"), 0, F.lit(4)), F.lit(2), '<tie type="stop"/>')
    bars = [(1, first), (2, second), (3, third)]
    by_part = F.concat(
        F.when(F.col("l_linenumber") == 2, '<score-partwise xmlns="urn:score">').otherwise("<score-partwise>"), F.lit('<part id="P1">'),
        *[x for n, bar in bars for x in (F.lit(f'<measure number="{n}">'), bar, F.lit("</measure>"))], F.lit("</part></score-partwise>"))
    by_time = F.concat(
        F.lit("<score-timewise>"),
        *[x for n, bar in bars for x in (F.lit(f'<measure number="{n}"><part id="P1">'), bar, F.lit("</part></measure>"))],
        F.lit("</score-timewise>"))
    xml = F.when(F.col("l_linenumber") == 5, by_time).otherwise(by_part)
    return line.select(document_id().alias("file"), F.encode(xml, "UTF-8").alias("content"))


def in_turn(rows: DataFrame, turn: Column, label: str, arrived: str | None = None) -> DataFrame:
    """A stream that takes the rows one file at a time, in the order of ``turn``.

    Each turn is written as one file; the files' times follow the turns by a second each, which is
    the order that a file stream goes by.  ``arrived`` names a column for the time of a row's file.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, label)
    rows.withColumn("_turn", turn.cast("int")).repartition("_turn").write.partitionBy("_turn").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(path(folder)):
        if entry.isDirectory() and entry.getPath().getName().startswith("_turn="):
            number = int(entry.getPath().getName().removeprefix("_turn="))
            for file in files.listStatus(entry.getPath()):
                files.setTimes(file.getPath(), 1_700_000_000_000 + 1000 * number, -1)
    schema = StructType(rows.schema.fields).add("_turn", "integer")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    if arrived:
        stream = stream.withColumn(arrived, F.col("_metadata.file_modification_time"))
    return stream.drop("_turn")


def numbered_log(spark: SparkSession, folder: str) -> DataFrame:
    """The control log with the rows of each session numbered from 0."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1
    return control_log(spark, folder).withColumn("seq", place.cast("bigint"))


# Arrival of edges: song groups in turn, one stretch of time after the other.
STRETCH_US, STRETCHES, SONG_GROUPS = 16_000_000, 14, 8


def arrival_turn(late_by: int = 2) -> Column:
    """The file that brings an edge: by its stretch of time and its song; one note in sixteen comes ``late_by`` stretches later."""
    stretch = F.greatest(F.lit(0), F.floor(F.col("t_us") / STRETCH_US))
    shifted = stretch + F.when(F.pmod(F.xxhash64("song_id", "key_index", "t_us"), F.lit(16)) == 0, late_by).otherwise(0)
    return F.least(shifted, F.lit(STRETCHES - 1)) * SONG_GROUPS + F.pmod(F.col("song_id"), F.lit(SONG_GROUPS))


def page_books(spark: SparkSession, folder: str) -> DataFrame:
    """One long page per supplier as lines of a named file: an outline and a symbol for each order line."""
    line = table(spark, folder, "lineitem")
    names = F.array(*[F.lit(c) for c in ELEMENT_CLASSES])
    symbol = F.concat(
        F.lit('<use class="'), F.element_at(names, (F.col("l_partkey") % 10).cast("int") + 1), F.lit('" x="'), F.col("l_partkey") % 1000,
        F.lit('" y="'), 100 + F.col("l_orderkey") % 1500, F.lit('"/>'))
    name = F.concat(F.lit("book.svg_"), F.col("l_suppkey"), F.lit(".svg"))
    body = line.select(name.alias("name"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), symbol.alias("line"))
    ends = line.select(name.alias("name")).distinct().select("name", F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("ord"),
                 F.lit('<svg xmlns="http://www.w3.org/2000/svg"><path d="M0,0 L1000,0 L1000,2000 L0,2000 Z"/>').alias("line")),
        F.struct(F.lit((1 << 62)).alias("ord"), F.lit("</svg>").alias("line")))).alias("e")).select("name", "e.*")
    return body.unionByName(ends)


def part_files(spark: SparkSession, folder: str) -> DataFrame:
    """One short named file per part, of each input kind in turn."""
    part = table(spark, folder, "part")
    suffixes = F.array(*[F.lit(s) for s in INPUT_SUFFIXES])
    name = F.concat(F.lit("part_"), F.col("p_partkey"), F.element_at(suffixes, (F.col("p_partkey") % 9).cast("int") + 1))
    return part.select(name.alias("name"), F.lit(0).cast("bigint").alias("ord"), F.col("p_name").alias("line"))
