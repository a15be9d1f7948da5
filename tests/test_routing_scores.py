import io
import zipfile

import pytest

from notarium.operators import routing, score
from notarium.plans import registry
from notarium.sources import scores, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("path, ext, route, final", [
    ("/in/a.PDF", ".pdf", "recognise", "/in/a.mid"), ("/in/b.mxl", ".mxl", "convert", "/in/b.mid"),
    ("/in/c.midi", ".midi", "as_is", "/in/c.midi"), ("/in/d.jpeg", ".jpeg", "fallthrough", "/in/d.mid"),
    ("e.v2.xml", ".xml", "convert", "e.v2.mid"), ("/f.png", ".png", "recognise", "/f.mid"),
    ("C:\\x\\g.mid", ".mid", "as_is", "C:\\x\\g.mid"), ("/in//h", "", "fallthrough", "/in/h.mid"),
])
def test_routes(spark, path, ext, route, final):
    r = routing.routed(spark.createDataFrame([(path,)], "path string")).first()
    assert (r.ext, r.route, r.midi_path) == (ext, route, final)
    assert r.accepted_by_dialog == (route != "fallthrough")


def test_manifest(spark):
    files = spark.createDataFrame([(n,) for n in ("x.v2.xml", "y.xml", "y.mxl", "z.XML")], "file string")
    manifest = routing.render_manifest(files)
    assert rows(manifest, "file", "target", "is_collision") == [
        ("x.v2.xml", "x.v2.svg", False), ("y.mxl", "y.svg", True), ("y.xml", "y.svg", True)]
    results = spark.createDataFrame([("y.xml", 1, 1), ("y.xml", 2, 0), ("y.mxl", 1, 3)], "file string, attempt int, exit_code int")
    assert rows(routing.manifest_status(manifest, results), "file", "status") == [
        ("x.v2.xml", "PENDING"), ("y.mxl", "FAILED"), ("y.xml", "SUCCESS")]


def test_label_target(spark):
    files = spark.createDataFrame([("p.svg",), ("p.svg.svg",)], "file string")
    assert rows(routing.label_target(files), "label_file") == [("p.txt",), ("p.txt.txt",)]


SCORE = (
    '<score-partwise><part id="P1"><measure number="1"><attributes><divisions>2</divisions></attributes>'
    '<barline><repeat direction="forward"/></barline>'
    "<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration></note>"
    "<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration></note>"
    "<note><rest/><duration>2</duration></note><backup><duration>4</duration></backup>"
    "<note><pitch><step>C</step><octave>3</octave></pitch><duration>4</duration></note></measure></part></score-partwise>"
)


@pytest.mark.parametrize("narrow", [False, True])
def test_score(spark, tmp_path, request, narrow):
    if narrow:
        request.getfixturevalue("small_buckets")
    (tmp_path / "a.xml").write_text(SCORE)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as box:
        box.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="s.xml"/></rootfiles></container>')
        box.writestr("s.xml", SCORE)
    (tmp_path / "b.mxl").write_bytes(packed.getvalue())
    (tmp_path / "c.xml").write_text("<broken")
    (tmp_path / "d.XML").write_text(SCORE)
    assert rows(scores.list_scores(spark, str(tmp_path)), "file") == [("a.xml",), ("b.mxl",), ("c.xml",)]
    elements = scores.read_scores(spark, str(tmp_path)).cache()
    assert elements.filter("kind = 'error'").count() == 1
    clean = score.drop_repeats(elements.filter("kind != 'error'"))
    assert elements.filter("kind = 'repeat'").count() == 2 and clean.filter("kind = 'repeat'").count() == 0
    got = rows(score.score_notes(clean), "pitch", "start_tick", "len_ticks")
    assert got == sorted([(60, 0, 480), (64, 0, 480), (48, 0, 960)] * 2)


def test_divisions_carry_over_buckets(spark, small_buckets):
    data = [("f", "p", i, "1", i // 7, "note", "C", 0, 4, 3, 2 if i == 0 else (6 if i == 9 else None), i % 7 % 4 == 3, False, False, False, None) for i in range(20)]
    df = spark.createDataFrame([(*r, None) for r in data], scores.SCORE_SCHEMA)
    cursor, expected, div, last = 0, [], 1, 0  # one voice: measures follow on without a gap
    for i in range(20):
        div = 2 if i == 0 else 6 if i == 9 else div
        length = 3 * 480 // div
        if i % 7 % 4 == 3:
            expected.append((i, cursor - last, length))
        else:
            expected.append((i, cursor, length))
            cursor, last = cursor + length, length
    assert rows(score.score_notes(df), "ord", "start_tick", "len_ticks") == expected


def test_short_second_voice(spark, tmp_path):
    """The next measure waits for the longer voice."""
    note = "<note><pitch><step>{}</step><octave>4</octave></pitch><duration>{}</duration></note>"
    xml = (
        '<score-partwise><part id="P"><measure number="1"><attributes><divisions>1</divisions></attributes>'
        + note.format("C", 4) + "<backup><duration>4</duration></backup>" + note.format("E", 1)
        + '</measure><measure number="X"/><measure number="1">' + note.format("G", 2) + "</measure></part></score-partwise>")
    (tmp_path / "a.xml").write_text(xml)
    got = rows(score.score_notes(scores.read_scores(spark, str(tmp_path))), "pitch", "start_tick", "len_ticks")
    assert got == [(60, 0, 1920), (64, 0, 480), (67, 1920, 960)]


def test_note_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(s, 5, 60, 10 * s, 5) for s in range(30)], "song_id bigint, key_index int, velocity int, start_us bigint, dur_us bigint")
    tables.write_note_events(df, str(tmp_path / "n"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "n"))
    assert back.count() == 30 and back.select("song_bucket").distinct().count() <= 4


def _score(body, root="score-partwise", extra=""):
    return (f'<{root}{extra}><part id="P1"><measure number="1"><attributes><divisions>2</divisions></attributes>{body}'
            f"</measure></part></{root}>").encode()


def _note(step, duration, tie=""):
    ties = "".join(f'<tie type="{t}"/>' for t in tie.split())
    return f"<note><pitch><step>{step}</step><octave>4</octave></pitch><duration>{duration}</duration>{ties}</note>"


def test_bad_scores_are_rows(spark):
    """Broken containers, numbers out of range and other layouts; a namespace is no fault."""
    import io
    import zipfile

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", _score(_note("C", 2) * 50))
    broken = bytearray(box.getvalue())
    broken[40:60] = b"\xff" * 20
    files = [("zip", bytes(broken)), ("inf", _score(_note("C", "1e999"))), ("big", _score(_note("C", 9999999999))),
             ("time", _score(_note("C", 2), "score-timewise")), ("space", _score(_note("C", 2), extra=' xmlns="urn:x"')), ("null", None)]
    got = {r.file: r.kind for r in scores.decode_scores(spark.createDataFrame(files, "file string, content binary")).collect()}
    assert got == {"zip": "error", "inf": "error", "big": "error", "time": "error", "space": "note", "null": "error"}


def test_ties_and_tempo(spark):
    body = ('<direction><sound tempo="120"/></direction>' + _note("C", 2, "start") + _note("C", 2, "stop start") + _note("C", 1, "stop")
            + _note("C", 2) + _note("D", 2, "start") + '<direction><sound tempo="60"/></direction>' + _note("E", 2, "stop"))
    score_rows = scores.decode_scores(spark.createDataFrame([("f", _score(body))], "file string, content binary"))
    merged = score.merge_ties(score.score_notes(score_rows, whole_parts=True))
    assert rows(merged, "pitch", "start_tick", "len_ticks") == [(60, 0, 1200), (60, 1200, 480), (62, 1680, 480), (64, 2160, 480)]
    assert rows(score.score_tempo(score_rows), "tick", "us_per_quarter") == [(0, 500_000), (2160, 1_000_000)]


def test_a_table_of_several_files_as_a_stream(spark, tmp_path):
    """The driver's larger pages are a folder of files."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", "") for i in range(9)], "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert registry.stream_route(spark, str(tmp_path)).count() == 9
