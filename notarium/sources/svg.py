"""SVG pages: directory scan and element parser."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Members of an element, in order, behind its place ``ord``.
ELEMENT_FIELDS = ("tag", "cls", "d", "x", "y", "points", "transform", "ancestor_transforms")


def _element(fields: frozenset[str]) -> T.StructType:
    lists = {"ancestor_transforms": T.ArrayType(T.StringType())}
    return T.StructType(
        [T.StructField("ord", T.IntegerType())]
        + [T.StructField(name, lists.get(name, T.StringType())) for name in ELEMENT_FIELDS if name in fields])


def read_svg_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``file, svg`` for every name ending in ``.svg`` in a folder and below it, each page one row."""
    return (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.svg", recursiveFileLookup=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("svg"))
    )


def _walker(wanted: frozenset[str], classes: frozenset[str] | None, fields: frozenset[str]) -> tuple[list[tuple], Callable[[str], tuple]]:
    """A list of wanted elements, and a function that adds those of one document to it.

    The function returns the outline of the page and, for one that can't be read, why.  Elements
    under the same groups share one list of transforms.
    """
    from xml.parsers import expat

    rows: list[tuple] = []
    brief = fields <= {"tag", "cls"}
    seen, outline_seen, outline = 0, False, None
    above: list[str] = []
    open_groups: list[list[str]] = []

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal seen, outline_seen, outline, above
        if name in wanted:
            get = attrs.get
            cls = get("class")
            if cls is None and name == "path" and not outline_seen:
                outline_seen, outline = True, get("d")
            if classes is None or cls in classes:
                rows.append((seen, name, cls) if brief else (
                    seen, name, cls, get("d"), get("x"), get("y"), get("points"), get("transform"), above))
            seen += 1
        elif name == "g" and not brief:
            open_groups.append(above)
            transform = attrs.get("transform")
            if transform:
                above = [transform, *above]

    def end(name: str) -> None:
        nonlocal above
        if name == "g":
            above = open_groups.pop()

    def walk(text: str) -> tuple[str | None, str | None]:
        nonlocal seen, outline_seen, outline, above
        seen, outline_seen, outline, above = 0, False, None, []
        open_groups.clear()
        before = len(rows)
        parser = expat.ParserCreate()
        parser.StartElementHandler = start
        if not brief:
            parser.EndElementHandler = end
        try:
            parser.Parse(text, True)
        except expat.ExpatError as problem:
            del rows[before:]
            return None, str(problem)
        return outline, None

    return rows, walk


def parse_pages(pages: DataFrame, tags: tuple[str, ...] = ("use", "path"), text: str = "svg",
                classes: Iterable[str] | None = None, fields: Iterable[str] = ELEMENT_FIELDS) -> DataFrame:
    """Parse each page once: wanted elements in document order with the ``transform`` of
    every ancestor ``g``, innermost first.

    Adds ``elements`` (array), ``page_d`` (data of the first path without a class) and
    ``error`` in place of the text column.  With ``classes`` other elements are left out
    here already instead of being handed on and dropped; ``ord`` counts them all the same.
    ``fields`` names the members of an element that are wanted, besides ``ord``: the optimizer can't
    leave out of a Python step what nobody asks for.
    Arrow batches in and out; one document is one
    row, so no task holds more than a batch of documents.
    """
    kept = [f for f in pages.schema.fields if f.name != text]
    members = frozenset(fields)
    element = _element(members)
    schema = T.StructType([
        *kept,
        T.StructField("elements", T.ArrayType(element)),
        T.StructField("page_d", T.StringType()),
        T.StructField("error", T.StringType()),
    ])
    names = [f.name for f in kept]
    wanted = frozenset(tags)
    chosen = None if classes is None else frozenset(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, outlines, errors = [0], [], []
            rows, walk = _walker(wanted, chosen, members)
            for value in batch.column(text).to_pylist():
                outline, error = walk(value or "")
                offsets.append(len(rows))
                outlines.append(outline)
                errors.append(error)
            held = ("ord", *(ELEMENT_FIELDS[:2] if members <= set(ELEMENT_FIELDS[:2]) else ELEMENT_FIELDS))
            columns = dict(zip(held, zip(*rows) if rows else [()] * len(held)))
            types = {"ord": pa.int32(), "ancestor_transforms": pa.list_(pa.string())}
            parts = [pa.array(columns[n], types.get(n, pa.string())) for n in element.names]
            structs = pa.StructArray.from_arrays(parts, element.names)
            elements = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), elements, pa.array(outlines, pa.string()),
                 pa.array(errors, pa.string())],
                [*names, "elements", "page_d", "error"],
            )

    return pages.mapInArrow(run, schema)
