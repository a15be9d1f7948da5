import cmath
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from notarium.functions.expressions import once, six_decimals
from notarium.functions.svgpath import path_bbox
from notarium.operators import labels
from notarium.sources import svg, tables

PAGE = """<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg">
<path d="M0,0 L1000,0 L1000,2000 L0,2000 Z"/>
<g transform="translate(10,20)"><use class="TrebleClef" x="100" y="200"/></g>
<use class="BarLine" x="500" y="300"/>
<g transform="translate(100,0)"><g transform="translate(5 5)"><path class="Note" d="M10,10 L30,10 L30,50 Z"/></g></g>
<use class="Slur" x="1" y="1"/><path class="Rest"/><use class="Rest" x="0" y="10"/>
<path class="Rest" d="M0,0 L10,10" transform="translate(50,50)"/>
<use class="Note" x="1200" y="100"/><polyline class="StaffLines" points="5,0 5,100"/><use class="Note" x="abc"/></svg>"""

EXPECTED = [
    "1 0.117500 0.102500 0.015000 0.015000", "5 0.507500 0.180000 0.015000 0.060000",
    "0 0.125000 0.017500 0.020000 0.020000", "6 0.005000 0.002500 0.010000 0.005000",
    "0 1.207500 0.042500 0.015000 0.015000",
]


def parsed(spark, *pages, tags=("use", "path")):
    df = spark.createDataFrame([(f"p{i}.svg", p) for i, p in enumerate(pages)], "file string, svg string")
    return svg.parse_pages(df, tags)


def lines(df):
    return [r.line for r in labels.format_label(df).orderBy("file", "ord").collect()]


def test_page(spark):
    docs = parsed(spark, PAGE)
    assert lines(labels.labels(docs)) == EXPECTED
    reasons = {(r.cls, r.reason) for r in labels.label_rejects(docs).collect()}
    assert reasons == {("Rest", "no usable geometry"), ("Note", "bad symbol position")}
    assert [r.n_labels for r in labels.label_summary(labels.labels(docs)).collect()] == [5]


def test_six_decimals(spark):
    """Exact binary rounding, halves to even, as printf does it."""
    rng = random.Random(5)
    values = [0.0, 5e-7, 1.5e-6, 2.5e-6, 3.5e-6, 0.0123455, 0.0078125, 0.0234375, 1.0, 0.9999995, 12.3456785, 0.1, 1 / 3]
    values += [rng.randrange(10**7) / 10**7 for _ in range(3000)] + [rng.random() * 2 for _ in range(3000)]
    values += [rng.randrange(4096) / 128 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", six_decimals(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.6f}" for r in got]


def test_early_class_choice(spark):
    df = spark.createDataFrame([("p0.svg", PAGE)], "file string, svg string")
    early = svg.parse_pages(df, classes=labels.CLASS_IDS)
    assert lines(labels.labels(early)) == EXPECTED
    assert early.selectExpr("transform(elements, e -> e.ord) AS o").first().o == [1, 2, 3, 5, 6, 7, 8, 9]


def test_options(spark):
    docs = parsed(spark, PAGE, tags=("use", "path", "polyline"))
    assert "7 0.005000 0.025000 0.010000 0.050000" in lines(labels.labels(docs, include_polyline=True))
    assert lines(labels.labels(docs)) == EXPECTED
    assert "6 0.055000 0.027500 0.010000 0.005000" in lines(labels.labels(docs, own_transform=True))


@pytest.mark.parametrize("outline", ["", "<path/>", '<path d="M1"/><path d="M0,0 L10,10"/>'])
def test_page_size_fallback(spark, outline):
    docs = parsed(spark, f'<svg>{outline}<use class="Note" x="0" y="30"/></svg>')
    row = labels.labels(docs).first()
    assert row.norm_w == 15 / 3319.9 and row.norm_h == 30 / 4555.4
    size = labels.page_size(labels.page_elements(docs)).first()
    assert (size.page_w, size.page_h) == (3319.9, 4555.4)


def test_unreadable(spark):
    docs = parsed(spark, "<svg><use></svg>", '<svg><g transform="translate(1.2.3,4)"><use class="Note" y="40"/></g></svg>')
    reasons = sorted(r.reason.split(":")[0] for r in labels.label_rejects(docs).collect())
    assert reasons == ["bad ancestor translate", "unreadable page"]
    assert labels.labels(docs).count() == 0


@pytest.mark.parametrize("text, move", [
    ("translate(1,2)", (1, 2)), ("rotate(3) translate(-.5 \t4)", (-0.5, 4)), ("translate(5)", (0, 0)),
    ("translate(1e3,2)", (0, 0)), ("matrix(1 0 0 1 3 4)", (0, 0)), ("translate(1,2) translate(9,9)", (1, 2)),
])
def test_translate(spark, text, move):
    t = spark.createDataFrame([(text,)], "t string").select(labels.parse_translate(F.col("t")).alias("m")).first().m
    assert (t.dx, t.dy) == move


@pytest.mark.parametrize("points, box", [
    ("5,0 5,100", (0, 10, 0, 100)), (" 1,2  4,8 7 1,2,3", (1, 4, 2, 8)), ("7 8", None), ("a,b 1,2", None),
])
def test_polyline(spark, points, box):
    df = spark.createDataFrame([(points,)], "p string").select(labels.polyline_bbox(F.col("p")).alias("b"))
    got = df.first().b
    assert (got and tuple(got)) == box


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.svg").write_text(PAGE, encoding="utf-8")
    (tmp_path / "in" / "b.SVG").write_text(PAGE, encoding="utf-8")
    (tmp_path / "in" / "empty.svg").write_text("<svg/>", encoding="utf-8")
    docs = svg.parse_pages(svg.read_svg_corpus(spark, str(tmp_path / "in")))
    out = str(tmp_path / "out")
    tables.write_labels(labels.labels(docs), out)
    assert [n for n in os.listdir(out) if n.startswith("file=")] == ["file=a.svg"]
    part = next(n for n in os.listdir(f"{out}/file=a.svg") if n.endswith(".txt"))
    assert open(f"{out}/file=a.svg/{part}").read().splitlines() == EXPECTED
    back = tables.read_labels(spark, out)
    assert back.count() == 5 and dict(back.dtypes)["norm_x"] == "double"


@pytest.mark.skipif("LABEL_FOLDER" not in os.environ, reason="no folder of existing label files named")
def test_existing_label_files(spark):
    """Rows per class of three known pages, given by a folder."""
    got = tables.read_labels(spark, os.environ["LABEL_FOLDER"]).groupBy("file").pivot("class_id").count().collect()
    counts = sorted(tuple(r[c] or 0 for c in r.__fields__ if c != "file") for r in got)
    assert sum(map(sum, counts)) == 853


def sampled(d):
    """Box of absolute path data by dense sampling; a second way to the same numbers."""
    xs, ys, pen, start = [], [], 0j, 0j

    def add(points):
        xs.extend(p.real for p in points)
        ys.extend(p.imag for p in points)

    for cmd, text in re.findall(r"([MLCQAZ])([^MLCQAZ]*)", d):
        n = [float(v) for v in text.split()]
        p = [complex(a, b) for a, b in zip(n[::2], n[1::2])] if cmd != "A" else []
        ts = [i / 4000 for i in range(4001)]
        if cmd == "M":
            pen = start = p[0]
            continue
        if cmd == "Z":
            add([pen, start])
            pen = start
        elif cmd == "L":
            add([pen, p[0]])
            pen = p[0]
        elif cmd == "Q":
            add([(1 - t) ** 2 * pen + 2 * t * (1 - t) * p[0] + t * t * p[1] for t in ts])
            pen = p[1]
        elif cmd == "C":
            add([(1 - t) ** 3 * pen + 3 * t * (1 - t) ** 2 * p[0] + 3 * t * t * (1 - t) * p[1] + t ** 3 * p[2] for t in ts])
            pen = p[2]
        elif cmd == "A":
            rx, ry, phi, large, sweep, x, y = n
            end, turn = complex(x, y), cmath.exp(1j * math.radians(phi))
            z = (pen - end) / 2 / turn
            grow = max(1.0, math.hypot(z.real / rx, z.imag / ry))
            rx, ry = rx * grow, ry * grow
            a, b = complex(z.real / rx, z.imag / ry), complex(-z.real / rx, -z.imag / ry)
            reach = abs(a) ** 2
            c = (1 if large != sweep else -1) * math.sqrt(max(0.0, 1 / reach - 1)) * complex(a.imag, -a.real)
            th1, th2 = cmath.phase(a - c), cmath.phase(b - c)
            span = (th2 - th1) % (2 * math.pi) if sweep else -((th1 - th2) % (2 * math.pi))
            mid = (pen + end) / 2 + turn * complex(rx * c.real, ry * c.imag)
            add([mid + turn * complex(rx * math.cos(th1 + span * t), ry * math.sin(th1 + span * t)) for t in ts])
            pen = end
    return min(xs), max(xs), min(ys), max(ys)


def test_paths_against_sampling(spark):
    rng = random.Random(1)
    num = lambda: str(rng.randrange(-50, 50))
    paths = []
    for _ in range(120):
        d = f"M {num()} {num()}"
        for _ in range(rng.randrange(1, 5)):
            cmd = rng.choice("LCQAZ")
            count = {"L": 2, "C": 6, "Q": 4, "Z": 0, "A": 0}[cmd]
            if cmd == "A":
                d += f" A {rng.randrange(1, 40)} {rng.randrange(1, 40)} {rng.randrange(0, 180)} {rng.randrange(2)} {rng.randrange(2)} {num()}.5 {num()}.25"
            else:
                d += f" {cmd} " + " ".join(num() for _ in range(count))
        paths.append(d + " L 0 0")
    df = spark.createDataFrame([(i, d) for i, d in enumerate(paths)], "i int, d string")
    got = {r.i: tuple(r.b) for r in once(df, "b", path_bbox("d")).select("i", "b").collect()}
    for i, d in enumerate(paths):
        assert got[i] == pytest.approx(sampled(d), abs=2e-3), d


@pytest.mark.parametrize("d, box", [
    ("m1 1 l2 2 h3 v-8 z", (1, 6, -5, 3)), ("M0 0 Q5 10 10 0 T20 0", (0, 20, -5, 5)),
    ("M0 0 C0 10 10 10 10 0 S 20 -10 20 0", (0, 20, -7.5, 7.5)), ("L10,10", (0, 10, 0, 10)), ("M0 0 1 1 2 5", (0, 2, 0, 5)),
    ("M0-1L.5.5", (0, 0.5, -1, 0.5)), ("M5 5", None), ("", None), ("L10,10Z", None), ("M1", None), ("3 M0 0 L1 1", None),
    ("M0 0 L1 1 Z 5", None), ("M0,0 A0 5 45 1 1 3 3", None), ("M0 0 L", None), ("M0 0 L1 1 Z L 3 3", (0, 3, 0, 3)),
])
def test_path_forms(spark, d, box):
    got = spark.createDataFrame([(d,)], "d string").select(path_bbox("d").alias("b")).first().b
    assert (got and tuple(got)) == box


def test_labels_need_no_shuffle(spark):
    pages = spark.range(0, 100, 1, 16).selectExpr("CAST(id AS STRING) AS file", "CAST(id AS STRING) AS svg")
    plan = labels.labels(svg.parse_pages(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_classes_join_without_shuffle(spark):
    elements = spark.range(0, 100, 1, 16).selectExpr("CAST(id AS STRING) AS cls")
    plan = labels.assign_class(elements, labels.vocabulary(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_markup_tags(spark):
    df = spark.createDataFrame([(1, '<div class="ad x"><P>hi</P><br/><a href="x" class="">y</a></div>')], "id int, html string")
    got = [(r.ord, r.tag, r.cls) for r in labels.markup_tags(df, "html").orderBy("ord").collect()]
    assert got == [(0, "div", "ad x"), (1, "P", None), (2, "br", None), (3, "a", "")]


def test_cubic_whose_leading_term_vanishes_up_to_rounding(spark):
    """The coefficient of t^2 in the derivative is 1e-13 here; the extremum must still be found."""
    from notarium.functions.svgpath import path_bbox

    df = spark.createDataFrame([("M989.88,0 C44.73,10 63.94,20 1047.51,30",)], "d string")
    ts = [i / 100_000 for i in range(100_001)]
    low = min((1 - t) ** 3 * 989.88 + 3 * (1 - t) ** 2 * t * 44.73 + 3 * (1 - t) * t * t * 63.94 + t ** 3 * 1047.51 for t in ts)
    assert abs(df.select(path_bbox("d").alias("b")).first().b.xmin - low) < 1e-4


def test_page_of_size_zero_is_rejected(spark):
    svg = '<svg><path d="M0,0 L0,100"/><use class="Note" x="1" y="50"/></svg>'
    from notarium.operators import labels
    from notarium.sources import svg as pages

    docs = pages.parse_pages(spark.createDataFrame([("a.svg", svg)], "file string, svg string"))
    assert labels.labels(docs).count() == 0
    assert [r.reason for r in labels.label_rejects(docs).collect()] == ["page of size zero"]


def test_only_wanted_members_are_handed_on(spark):
    df = spark.createDataFrame([("p0.svg", PAGE), ("p1.svg", "<svg"), ("p2.svg", PAGE)], "file string, svg string")
    whole = svg.parse_pages(df)
    for fields in (("tag", "cls"), labels.BOX_FIELDS):
        some = svg.parse_pages(df, fields=fields)
        assert some.schema["elements"].dataType.elementType.names == ["ord", *fields]
        assert some.select("file", "page_d", "error").collect() == whole.select("file", "page_d", "error").collect()
        chosen = labels.page_elements(whole).select("file", "ord", *fields)
        assert labels.page_elements(some).collect() == chosen.collect()
    assert lines(labels.labels(some.filter("file = 'p2.svg'"))) == EXPECTED
