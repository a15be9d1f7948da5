import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from notarium.operators import notes, scan
from notarium.plans import registry
from notarium.sources import midi


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


TICKS = "song_id bigint, pitch int, start_tick bigint, len_ticks bigint, velocity int"


def test_timed_notes(spark):
    table = spark.createDataFrame(
        [(1, 60, 480, 960, 64), (1, 59, 0, 480, 64), (1, 21, 960, 480, 64), (1, 107, 0, 480, 64),
         (1, 108, 0, 480, 64), (1, 20, 0, 480, 64)], TICKS)
    tempo = spark.createDataFrame([(1, 960, 1_000_000)], "song_id bigint, tick bigint, us_per_quarter int")
    timed = notes.timed_notes(notes.note_times(table, notes.tempo_segments(tempo)))
    assert rows(timed, "key_index", "hand", "start_us", "dur_us") == [
        (0, "lower", 1_000_000, 1_000_000), (38, "lower", 0, 500_000), (39, "upper", 500_000, 1_500_000),
        (86, "upper", 0, 500_000)]
    songs = spark.createDataFrame([(1,), (2,)], "song_id bigint")
    assert rows(notes.song_duration(songs, timed), "song_id", "duration") == [(1, 2.0), (2, 1.0)]
    assert notes.timed_notes(notes.steady_times(table), max_key=87).filter("key_index = 87").count() == 1


@pytest.mark.parametrize("narrow", [False, True])
def test_tempo_map_against_walk(spark, request, narrow):
    if narrow:
        request.getfixturevalue("small_buckets")
    rng = random.Random(7)
    changes = {(s, rng.randrange(200)): rng.randrange(300_000, 700_000) for s in range(3) for _ in range(15)}
    points = [(s, rng.randrange(260)) for s in range(4) for _ in range(60)]
    tempo = spark.createDataFrame([(s, t, u) for (s, t), u in changes.items()], "song_id bigint, tick bigint, us_per_quarter int")
    ticks = spark.createDataFrame(points, "song_id bigint, tick bigint")

    def walk(song, tick):
        num, at, speed = 0, 0, 500_000
        for t, u in sorted((t, u) for (s, t), u in changes.items() if s == song and t <= tick):
            num, at, speed = num + (t - at) * speed, t, u
        return (num + (tick - at) * speed + 240) // 480

    got = rows(notes.tick_times(ticks, notes.tempo_segments(tempo)), "song_id", "tick", "us")
    assert got == sorted((s, t, walk(s, t)) for s, t in set(points))


EVENTS = "file string, track int, seq bigint, tick bigint, kind string, channel int, pitch int, velocity int"


def queue_pairs(events):
    open_notes, out = defaultdict(list), []
    for file, track, seq, tick, kind, channel, pitch, velocity in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        lane = (file, track, channel, pitch)
        if kind == "on" and velocity > 0:
            open_notes[lane].append((tick, velocity))
        elif open_notes[lane]:
            start, v = open_notes[lane].pop(0)
            out.append((file, track, pitch, start, tick - start, v))
    return sorted(out)


@pytest.mark.parametrize("narrow", [False, True])
def test_pairing_against_queue(spark, request, narrow):
    """Stray offs, unclosed notes and zero-velocity ons, against a plain first-in-first-out queue."""
    if narrow:
        request.getfixturevalue("small_buckets")
    rng = random.Random(3)
    events = []
    for file in "ab":
        for track in range(2):
            tick = 0
            for seq in range(150):
                tick += rng.randrange(4)
                events.append((file, track, seq, tick, rng.choice(["on", "off"]), 0, rng.choice([60, 61, 62]),
                               rng.choice([0, 10, 20, 30])))
    for stretches in (None, 1, 40):
        paired = notes.pair_notes(spark.createDataFrame(events, EVENTS), stretches=stretches)
        assert rows(paired, "file", "track", "pitch", "start_tick", "len_ticks", "velocity") == queue_pairs(events)


def test_sparse_lane_in_even_stretches(spark):
    """One lane of numbers far apart, most of them in a small part of their range."""
    rng = random.Random(8)
    numbers = sorted({rng.randrange(1 << 20) if rng.random() < 0.9 else rng.randrange(1 << 61) for _ in range(3000)})
    events = [("a", 0, s, i, rng.choice(["on", "off"]), 0, 60, 1 + i % 90) for i, s in enumerate(numbers)]
    df = spark.createDataFrame(events, EVENTS)
    paired = notes.pair_notes(df, stretches=16)
    assert rows(paired, "file", "track", "pitch", "start_tick", "len_ticks", "velocity") == queue_pairs(events)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be put together
    try:
        sizes = [r.n for r in scan.ranged(df, ["file", "seq"], 16).groupBy(scan.BUCKET).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 16 and max(sizes) <= 2 * len(events) / 16


def test_midi_bytes(spark):
    one = bytes.fromhex("4D5468640000000600000001 01E0 4D54726B00000014 00FF510307A120 00903C40 8360803C00 00FF2F00".replace(" ", ""))
    never_closed = bytes.fromhex("4D546864000000060000000101E0 4D54726B00000008 00903C40 00FF2F00".replace(" ", ""))
    files = spark.createDataFrame([("one", one), ("open", never_closed), ("bad", b"RIFF")], "file string, content binary")
    events = midi.decode_midi(files).cache()
    assert rows(events.filter("kind = 'tempo'"), "file", "tick", "us_per_quarter", "ppq") == [("one", 0, 500_000, 480)]
    assert [r.file for r in events.filter("kind = 'error'").collect()] == ["bad"]
    paired = notes.pair_notes(events)
    assert rows(paired, "file", "pitch", "start_tick", "len_ticks", "velocity") == [("one", 60, 0, 480, 64)]
    assert rows(notes.unclosed_notes(events, paired), "file", "unclosed") == [("open", 1)]
    segments = notes.tempo_segments(midi.tempo_changes(events), ["file"])
    timed = notes.note_times(paired, segments, ["file"])
    assert rows(timed, "start_us", "dur_us") == [(0, 500_000)]


def test_read_midi_folder(spark, tmp_path):
    data = bytes.fromhex("4D546864000000060000000101E04D54726B0000000F00903C408360903C0000FF2F00")
    (tmp_path / "a.mid").write_bytes(data)
    (tmp_path / "b.midi").write_bytes(data)
    (tmp_path / "c.txt").write_bytes(data)
    paired = notes.pair_notes(midi.read_midi(spark, str(tmp_path)))
    assert sorted(r.file.rsplit("/", 1)[1] for r in paired.collect()) == ["a.mid", "b.midi"]


def test_two_tempos_at_one_tick(spark):
    tempo = spark.createDataFrame(
        [(1, 0, 400_000, 2), (1, 0, 600_000, 1)], "song_id bigint, tick bigint, us_per_quarter int, seq int")
    assert rows(notes.tempo_segments(tempo), "us_per_quarter", "base_num") == [(400_000, 0)]


def test_note_times_plan_has_no_nested_loop(spark):
    table = spark.createDataFrame([(1, 60, 480, 960, 64)], TICKS)
    tempo = spark.createDataFrame([(1, 960, 1_000_000)], "song_id bigint, tick bigint, us_per_quarter int")
    plan = notes.note_times(table, notes.tempo_segments(tempo))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_key_pitch_inverse(spark):
    df = spark.range(21, 108).select(F.col("id").cast("int").alias("pitch"))
    assert df.filter(notes.key_pitch(notes.key_index("pitch")) != F.col("pitch")).count() == 0


def _midi(track, division=480):
    return bytes.fromhex("4D546864000000060000" + f"0001{division:04X}" + "4D54726B" + f"{len(track) // 2:08X}" + track)


def test_resolution_of_each_file_counts(spark):
    """One quarter at the default tempo, in files of three resolutions."""
    quarter = {96: "60", 480: "8360", 960: "8740"}
    files = [(str(d), _midi(f"00903C40{q}803C0000FF2F00", d)) for d, q in quarter.items()]
    events = midi.decode_midi(spark.createDataFrame(files, "file string, content binary"))
    for whole in (False, True):
        paired = notes.pair_notes(events, whole_tracks=whole)
        timed = notes.note_times(paired, notes.tempo_segments(midi.tempo_changes(events), ["file"]), ["file"])
        assert rows(timed, "file", "ppq", "dur_us") == [("480", 480, 500_000), ("96", 96, 500_000), ("960", 960, 500_000)]


def test_running_status_goes_on_after_a_text(spark):
    data = _midi("00903C40" + "00FF010141" + "18" + "3C00" + "00FF2F00")
    paired = notes.pair_notes(midi.decode_midi(spark.createDataFrame([("a", data)], "file string, content binary")))
    assert rows(paired, "start_tick", "len_ticks") == [(0, 24)]


def test_bad_midi_files_are_rows(spark):
    good = _midi("00903C4018803C0000FF2F00")
    files = [("good", good), ("long tempo", _midi("00FF51050102030405" + "00FF2F00")), ("no status", _midi("003C40")),
             ("cut", good[:-5]), ("header", good[1:]), ("division", _midi("00FF2F00", 0)), ("number", _midi("FFFFFFFFFF00")), ("null", None)]
    got = midi.decode_midi(spark.createDataFrame(files, "file string, content binary"))
    assert sorted(r.file for r in got.filter("kind = 'error'").collect()) == sorted(f for f, _ in files if f != "good")


def test_building_queries_starts_no_job(spark):
    """Plans of batch operators are built without running anything."""
    from notarium.plans import registry

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "plans only")
    try:
        for name in ("pressed_frames", "drawn_frames", "paired_notes", "svg_labels", "path_boxes", "gate_events", "playable_by_hand"):
            registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        # Reading a table's schema is all that may run.
        spans = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("build")]
        assert all(len(tracker.getStageInfo(s).name) and tracker.getStageInfo(s).numTasks == 1 for j in spans for s in j.stageIds)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ons_of_one_tick_are_struck_by_velocity(spark, tmp_path):
    """Order 200000 starts at the tick of order 0 and later in the log, but its velocity is the lower one: 1 + 101 < 1 + 126."""
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"
    lines = [(126, 60, 1, 1, 3.0), (200_126, 60, 1, 1, 5.0)]
    assert 1 + 200_126 % 127 < 1 + 126 % 127
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.paired_notes(spark, str(tmp_path)).collect()
    assert sorted((r.len_ticks, r.velocity) for r in got) == [(144, 1 + 200_126 % 127), (240, 127)]
