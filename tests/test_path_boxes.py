"""Path boxes worked out a batch at a time equal the boxes that Spark works out row by row."""

import random

import numpy as np
from pyspark.sql import functions as F

from notarium.functions import pathbox
from notarium.functions.svgpath import path_bbox_sql
from notarium.operators import labels

ODD = [
    "M.5.5L-3-4", "M1e1 2E-1 l+3,4", "M1. 2 L3 4", "M1 2 L3 4 5", "M 1e 2 L 3 4", "M1,2 - 3 L 4 5", "M0 0 L1 1 m2 2 z z s1 2 3 4", "M0 0 C1 9 2 9 3 0 Z S4 -9 6 0",
    "M0 0 Q5 9 9 0 T 20 0 30 0 t5 5", "M0 0 H5 6 -7 v3 -8", "M0 0 A5 3 30 1 0 9 4 5 3 30 0 1 -9 4", "Z", "M1 1 Z", "12", "x M1 1 L2 2", "M0 0 L1e400 0",
    "M0.1234567890123456789 12345678901234567890 L1e-30 1e25", "M1 1 é L 2 2", "", "M0 0 c0 10 10 10 10 0 s10 -10 10 0", None, "M1 2 1e5.5 7",
]


def random_paths(count):
    rng = random.Random(3)
    number = lambda: rng.choice(["%d", "%.2f", "%.1e", "-%.3f"]) % (rng.random() * 90)
    sizes = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "Z": 0}
    paths = []
    for _ in range(count):
        d = f"M{number()} {number()}"
        for _ in range(rng.randrange(1, 9)):
            letter = rng.choice([*sizes, "A"])
            groups = 1 if letter == "Z" else rng.choice([1, 1, 1, 2])
            one = lambda: f"{number()} {number()} {number()} {rng.randrange(2)} {rng.randrange(2)} {number()} {number()}" if letter == "A" else ",".join(
                number() for _ in range(sizes[letter]))
            d += rng.choice([letter, letter.lower()]) + " ".join(one() for _ in range(groups))
        paths.append(d)
    return paths


def test_as_row_by_row(spark, monkeypatch):
    paths = [*ODD, *random_paths(400)]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, d string").coalesce(1)
    want = {r.i: r.b for r in df.select("i", F.expr(path_bbox_sql("d")).alias("b")).collect()}
    for chunk in (pathbox.CHUNK, 40):
        monkeypatch.setattr(pathbox, "CHUNK", chunk)
        boxes, there = pathbox.path_boxes(paths)
        for i, d in enumerate(paths):
            assert there[i] == (want[i] is not None), d
            if there[i]:
                np.testing.assert_allclose(boxes[:, i], list(want[i]), rtol=1e-12, atol=1e-9, err_msg=d)


def test_straight_and_curved_boxes_are_equal_to_the_last_bit(spark):
    paths = [d for d in random_paths(300) if "a" not in d.lower()]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, d string")
    for r in df.select("i", F.expr(path_bbox_sql("d")).alias("b"), pathbox.path_bbox("d").alias("c")).collect():
        assert r.b == r.c, paths[r.i]


def test_no_interpreted_walk(spark):
    """A path box, and all of a label, is no ``aggregate`` or ``transform`` of Spark's, which interprets them node by node."""
    element = "ord int, tag string, cls string, d string, x string, y string, ancestor_transforms array<string>"
    docs = spark.createDataFrame([], f"file string, elements array<struct<{element}>>, page_d string, error string")
    for result in (labels.labels(docs), labels.label_rejects(docs), labels.page_size(labels.page_elements(docs))):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan.lower().replace("aggregate [", "") and "lambda" not in plan


def test_numbers_and_moves_as_expressions_read_them(spark):
    texts = ["1", "-2.5", "+3", ".5", "5.", "1e3", " 7 ", "\t8", "abc", "", "1d", "2f", "0x1p3", "inf", "-Infinity", "nan", "1_0", "--1", "٣", None]
    moves = [[], None, ["translate(1,2)"], ["translate(1.2.3,4)", "scale(2)"], ["rotate(3) translate(-.5 \t4)", None, "translate(9,--1)"], ["translate(1,2"]]
    rows = [(i, "use", "BarLine" if i % 2 else "Note", None, x, y, m) for i, (x, y, m) in enumerate((x, y, m) for x in texts for y in ("4", "b") for m in moves)]
    df = spark.createDataFrame(rows, "i int, tag string, cls string, d string, x string, y string, ancestor_transforms array<string>")
    raw = df.withColumn("raw", labels.use_bbox(F.col("x"), F.col("y"), F.col("cls")))
    want = raw.select("i", F.when(F.col("raw").isNotNull(), labels.shift_by_ancestors(F.col("raw"), F.col("ancestor_transforms"))).alias("b")).collect()
    got = {r.i: r for r in labels.element_boxes(df).collect()}
    for r in want:
        box, reject = got[r.i].box, got[r.i].reject
        assert str(box) == str(r.b), rows[r.i]
        broken = r.b is not None and None in tuple(r.b)
        assert reject == ("bad symbol position" if r.b is None else "bad ancestor translate" if broken else None), rows[r.i]
