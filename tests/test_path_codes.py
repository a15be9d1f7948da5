"""Commands of path data are told apart by the code of their letter."""

from notarium.functions.svgpath import path_bbox, path_bbox_sql

PATHS = {
    "M1 2 L4 6": (1.0, 4.0, 2.0, 6.0), "m1 2 l3 4": (1.0, 4.0, 2.0, 6.0), "m1 2 3 4": (1.0, 4.0, 2.0, 6.0), "M1 2 4 6 z": (1.0, 4.0, 2.0, 6.0),
    "M0 0 H5 V7": (0.0, 5.0, 0.0, 7.0), "m0 0 h5 v7": (0.0, 5.0, 0.0, 7.0), "m0 0 l5": None, "M0 0 Z Z": None, "B1 2": None, "": None,
}


def test_letters_in_both_cases(spark):
    got = spark.createDataFrame([(d,) for d in PATHS], "d string").select("d", path_bbox("d").alias("b")).collect()
    assert {r.d: r.b and (r.b.xmin, r.b.xmax, r.b.ymin, r.b.ymax) for r in got} == PATHS


def test_no_text_is_raised():
    """``upper`` goes over every byte by the rules of its locale; it took a tenth of the sampled time of svg_labels."""
    assert "upper(" not in path_bbox_sql("d")
