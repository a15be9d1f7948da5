"""Very many files: written to folders of bounded size, listed by tasks, streamed by lists."""

import os
import re
from collections import Counter

import pytest

from notarium.functions import paths
from notarium.operators import labels
from notarium.sources import listing, named_text, scores, svg, tables
from notarium.streaming import live

KIND = "name string, ord int, line string"


def found(folder):
    return {n: os.path.join(d, n) for d, _, names in os.walk(folder) for n in names}


def test_folders_hold_a_bounded_number_of_files(spark, tmp_path):
    for turn in range(2):  # a second write adds to the first
        rows = [(f"{turn}-{n}.txt", k, f"{n} {k}") for n in range(200) for k in range(2)]
        named_text.write_named(spark.createDataFrame(rows, KIND), str(tmp_path / "out"), per_folder=7)
    files = found(tmp_path / "out")
    assert {n: open(p).read() for n, p in files.items()} == {f"{t}-{n}.txt": f"{n} 0\n{n} 1" for t in range(2) for n in range(200)}
    assert max(Counter(os.path.dirname(p) for p in files.values()).values()) == 7
    listed = listing.list_files(spark, str(tmp_path / "out")).collect()
    assert sorted((r.path, r.length) for r in listed) == sorted((p, os.path.getsize(p)) for p in files.values())
    assert all(abs(r.modificationTime.timestamp() - os.path.getmtime(r.path)) < 1 for r in listed)


def test_a_failed_write_leaves_no_folder(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.txt" if i != 7 else "a/b", 0, str(i)) for i in range(30)], KIND)
    with pytest.raises(Exception, match="no file name"):
        named_text.write_named(rows, str(tmp_path / "out"), per_folder=5)
    assert found(tmp_path / "out") == {}


def test_scores_below_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("top.xml", "a/one.mxl", "a/b/two.xml", "a/three.XML", "_hidden.xml", "a/.four.xml", "a/five.pdf"):
        (tmp_path / name).write_text("x")
    assert sorted(r.file for r in scores.list_scores(spark, str(tmp_path)).collect()) == ["one.mxl", "top.xml", "two.xml"]


def test_a_stream_keeps_account_of_lists_not_of_files(spark, tmp_path):
    """Two routes over one listing, which was taken twice: each file once, and a source's log names lists only."""
    rows = spark.createDataFrame([(f"{i}.xml", 0, str(i)) for i in range(300)], KIND)
    named_text.write_named(rows, str(tmp_path / "in"), per_folder=50)
    for _ in range(2):
        listing.write_listing(spark, str(tmp_path / "in"), str(tmp_path / "lists"))
    routes = [listing.stream_listing(spark, str(tmp_path / "lists"), n) for n in (3, 4)]
    got = live.run_available(live.first_arrivals(routes[0].unionByName(routes[1])), "listed")
    assert sorted(r.path for r in got.collect()) == sorted(found(tmp_path / "in").values())
    assert listing.list_count(spark, str(tmp_path / "lists")) < 100


def test_label_files_in_folders(spark, tmp_path):
    """Pages and their label files in folders of a bounded number of files, under their own names."""
    page = '<svg xmlns="http://www.w3.org/2000/svg"><path d="M0,0 L1000,0 L1000,2000 Z"/><use class="Note" x="{}" y="100"/></svg>'
    pages = spark.createDataFrame([(f"p{n}.svg", 0, page.format(n)) for n in range(60)], KIND)
    named_text.write_named(pages, str(tmp_path / "in"), per_folder=4)
    out = labels.labels(svg.parse_pages(svg.read_svg_corpus(spark, str(tmp_path / "in"))))
    tables.write_label_files(out, str(tmp_path / "out"), per_folder=5)
    assert sorted(found(tmp_path / "out")) == sorted(f"p{n}.txt" for n in range(60))
    back = tables.read_labels(spark, str(tmp_path / "out")).withColumn("file", paths.base_name("file")).collect()
    assert sorted((r.file, r.norm_x) for r in back) == sorted((f"p{n}.txt", round((n + 7.5) / 1000, 6)) for n in range(60))


def test_base_names(spark):
    names = ["", "/", "a", "/a", "a/", "a/b.c", "a\\b", "a/b\\c", "a\\b/c d", "file:///x/y/z.txt", "\\\\s\\t", None]
    got = spark.createDataFrame([(n,) for n in names], "path string").select("path", paths.base_name("path").alias("b")).collect()
    assert {r.path: r.b for r in got} == {n: None if n is None else re.split(r"[/\\]", n)[-1] for n in names}
