"""Page elements to detector labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notarium.functions.expressions import bind, once, parse_double, six_decimals
from notarium.functions.pathbox import BOX, CORNERS, box_array, path_bbox, path_boxes

# Class vocabulary, fallback page size, symbol box sizes, translate pattern.
CLASS_IDS = {
    "Note": 0,
    "TrebleClef": 1,
    "BassClef": 2,
    "TimeSig": 3,
    "MeasureNumber": 4,
    "BarLine": 5,
    "Rest": 6,
    "StaffLines": 7,
}
DEFAULT_PAGE = (3319.9, 4555.4)
SYMBOL_WIDTH, SYMBOL_HEIGHT, BAR_LINE_HEIGHT = 15, 30, 120
MIN_LINE_WIDTH, LINE_PADDING = 1, 5

_TRANSLATE = r"translate\(([-\d.]+)[,\s]+([-\d.]+)\)"

# The same texts inside tasks: a number of a few digits, any plain number, its names, blanks around them.
_SHORT = r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$"
_TRANSLATION = re.compile(_TRANSLATE, re.ASCII)
_BLANKS = "".join(map(chr, range(33)))
_PLAIN = re.compile(r"[\x00-\x20]*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?[\x00-\x20]*")
_NAMED = {sign + name: float(sign + name) for sign in ("", "+", "-") for name in ("inf", "infinity", "nan") if name != "nan" or not sign}

BROADCAST_NAMES = 10_000
# What boxes are made from, without polylines and an element's own transform.
BOX_FIELDS = ("tag", "cls", "d", "x", "y", "ancestor_transforms")
_GEOMETRY, _LINE = ("d", "x", "y", "points", "transform", "ancestor_transforms"), "_line"


def vocabulary(spark: SparkSession, class_ids: dict[str, int] | None = None) -> DataFrame:
    """The class names as a table, to be broadcast while their number, known here, is small.

    One class may hold most elements, so a join that shuffles on the class is the last resort.
    """
    rows = list((class_ids or CLASS_IDS).items())
    names = spark.createDataFrame(rows, "cls string, class_id int")
    return F.broadcast(names) if len(rows) <= BROADCAST_NAMES else names


def page_elements(documents: DataFrame, with_errors: bool = False) -> DataFrame:
    """One row per element of parsed documents (see ``sources.svg.parse_pages``).

    ``with_errors`` keeps the ``error`` column, and a row for documents without elements.
    """
    dropped = ("elements", "page_d") if with_errors else ("elements", "page_d", "error")
    kept = [c for c in documents.columns if c not in dropped]
    listing = F.explode_outer if with_errors else F.explode
    return documents.select(*kept, listing("elements").alias("e")).select(*kept, "e.*")


def page_size(elements: DataFrame) -> DataFrame:
    """Page width and height per file, from the first path without a class.

    For element tables whose documents are gone.  ``label_boxes`` does not need it: there
    the parser hands the page outline along with the document.
    """
    outline = F.when((F.col("tag") == "path") & F.col("cls").isNull(), F.col("ord"))
    pages = elements.groupBy("file").agg(F.min_by(F.struct("d"), outline).alias("first"))
    return _sized(pages, "first.d").select("file", "page_w", "page_h")


def _sized(pages: DataFrame, d: str) -> DataFrame:
    """Add ``page_w`` and ``page_h`` by the outline ``d``."""
    w, h = DEFAULT_PAGE
    return pages.withColumn("_outline", path_bbox(d)).withColumns({
        "page_w": F.coalesce(F.col("_outline.xmax") - F.col("_outline.xmin"), F.lit(w)),
        "page_h": F.coalesce(F.col("_outline.ymax") - F.col("_outline.ymin"), F.lit(h)),
    }).drop("_outline")


def assign_class(elements: DataFrame, vocab: DataFrame) -> DataFrame:
    """Class ids by exact name; elements without a known class go."""
    return elements.filter(F.col("cls") != "").join(vocab, "cls")


def class_id(cls: Column) -> Column:
    """The built-in vocabulary as an expression: no join at all."""
    chain = None
    for name, number in CLASS_IDS.items():
        chain = F.when(cls == name, number) if chain is None else chain.when(cls == name, number)
    return chain


def use_bbox(x: Column, y: Column, cls: Column) -> Column:
    """Box of a placed symbol; NULL members where x or y is no number."""

    def box(at: Column) -> Column:
        tall = cls == "BarLine"
        return F.struct(
            at.x.alias("xmin"), (at.x + SYMBOL_WIDTH).alias("xmax"),
            F.when(tall, at.y).otherwise(at.y - SYMBOL_HEIGHT).alias("ymin"),
            F.when(tall, at.y + BAR_LINE_HEIGHT).otherwise(at.y).alias("ymax"),
        )

    zero = F.lit("0")
    at = F.struct(parse_double(F.coalesce(x, zero)).alias("x"), parse_double(F.coalesce(y, zero)).alias("y"))
    return bind(at, lambda p: F.when(p.x.isNotNull() & p.y.isNotNull(), box(p)))


def polyline_bbox(points: Column) -> Column:
    """Box of a ``x,y x,y`` list, widened where it is thinner than one unit; NULL if unreadable."""
    pairs = F.filter(
        F.transform(F.split(F.trim(points), r"\s+"), lambda p: F.split(p, ",", -1)), lambda p: F.size(p) == 2
    )
    numbers = F.transform(pairs, lambda p: F.struct(
        parse_double(p[0]).alias("x"), parse_double(p[1]).alias("y")))

    def box(ps: Column) -> Column:
        xs, ys = F.transform(ps, lambda p: p.x), F.transform(ps, lambda p: p.y)
        readable = (F.size(ps) > 0) & F.forall(ps, lambda p: p.x.isNotNull() & p.y.isNotNull())
        ends = F.struct(
            F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"),
            F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))
        return F.when(readable, bind(ends, widened))

    def widened(b: Column) -> Column:
        pad = F.when(b.xmax - b.xmin < MIN_LINE_WIDTH, float(LINE_PADDING)).otherwise(0.0)
        return F.struct(
            (b.xmin - pad).alias("xmin"), (b.xmax + pad).alias("xmax"), b.ymin.alias("ymin"), b.ymax.alias("ymax"))

    return bind(numbers, box)


def parse_translate(transform: Column) -> Column:
    """``struct<dx, dy, bad>`` of the first two-argument translate; zeros where there is none."""
    dx_text = F.regexp_extract(transform, _TRANSLATE, 1)
    dy_text = F.regexp_extract(transform, _TRANSLATE, 2)

    def move(texts: Column) -> Column:
        found = texts.x != ""
        return F.struct(
            F.when(found, parse_double(texts.x)).otherwise(0.0).alias("dx"),
            F.when(found, parse_double(texts.y)).otherwise(0.0).alias("dy"),
        )

    return bind(F.struct(dx_text.alias("x"), dy_text.alias("y")), move)


def shift_by_ancestors(box: Column, transforms: Column) -> Column:
    """Move a box by every ancestor translate, innermost first; NULL if one is unreadable."""

    def move(acc: Column, text: Column) -> Column:
        return bind(parse_translate(text), lambda t: F.struct(
            (acc.xmin + t.dx).alias("xmin"), (acc.xmax + t.dx).alias("xmax"),
            (acc.ymin + t.dy).alias("ymin"), (acc.ymax + t.dy).alias("ymax")))

    plain = F.struct(
        box.xmin.alias("xmin"), box.xmax.alias("xmax"), box.ymin.alias("ymin"), box.ymax.alias("ymax"))
    return F.when(F.size(transforms) > 0, F.aggregate(transforms, plain, move)).otherwise(plain)


def _doubles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts, and which could not be read; the rules of ``parse_double``."""
    short = pc.match_substring_regex(texts, _SHORT).to_numpy(zero_copy_only=False)
    values, bad = np.zeros(len(texts)), np.zeros(len(texts), bool)
    values[short] = texts.filter(pa.array(short)).cast(pa.float64()).to_numpy()
    for i in np.flatnonzero(~short).tolist():
        t = texts[i].as_py()
        read = float(t) if _PLAIN.fullmatch(t) else _NAMED.get(t.strip(_BLANKS).lower())
        values[i], bad[i] = (0.0, True) if read is None else (read, False)
    return values, bad


def _moved(boxes: np.ndarray, missing: np.ndarray, rows: np.ndarray, texts: pa.Array) -> None:
    """Move the boxes of ``rows`` by one translate each, in place; see ``parse_translate``."""
    coded = pc.fill_null(texts, "").dictionary_encode()
    which = coded.indices.to_numpy()
    found = [_TRANSLATION.search(t) for t in coded.dictionary.to_pylist()]
    for corners, group in ((slice(0, 2), 1), (slice(2, 4), 2)):
        by, bad = _doubles(pa.array([m[group] if m else "0" for m in found], pa.string()))
        boxes[corners, rows] += by[which]
        if bad.any():
            missing[corners, rows] |= bad[which]


def _element_box(batch: pa.RecordBatch, own_transform: bool) -> tuple[pa.Array, pa.Array]:
    """``box`` and ``reject`` of a batch of elements (see ``element_boxes``)."""
    n = batch.num_rows
    boxes, there, missing = np.full((4, n), np.nan), np.zeros(n, bool), np.zeros((4, n), bool)

    def flags(values: pa.Array) -> np.ndarray:
        return pc.fill_null(values, False).to_numpy(zero_copy_only=False)

    tag, cls = batch.column("tag"), batch.column("cls")
    paths = np.flatnonzero(flags(pc.and_(pc.equal(tag, "path"), pc.not_equal(batch.column("d"), ""))))
    boxes[:, paths], there[paths] = path_boxes(batch.column("d").take(pa.array(paths)).to_pylist())
    is_use = flags(pc.equal(tag, "use"))
    uses = np.flatnonzero(is_use)
    (x, bad_x), (y, bad_y) = (_doubles(pc.fill_null(batch.column(c).take(pa.array(uses)), "0")) for c in ("x", "y"))
    tall = flags(pc.equal(cls, "BarLine"))[uses]
    boxes[:, uses] = x, x + SYMBOL_WIDTH, np.where(tall, y, y - SYMBOL_HEIGHT), np.where(tall, y + BAR_LINE_HEIGHT, y)
    there[uses] = ~(bad_x | bad_y)
    if _LINE in batch.schema.names:
        line = batch.column(_LINE)
        lines = np.flatnonzero(flags(pc.and_(pc.equal(tag, "polyline"), pc.is_valid(line))))
        boxes[:, lines] = [pc.struct_field(line, c).take(pa.array(lines)).to_numpy(zero_copy_only=False) for c in CORNERS]
        there[lines] = True

    if own_transform:
        own = batch.column("transform")
        rows = np.flatnonzero(there & flags(pc.not_equal(own, "")))
        _moved(boxes, missing, rows, own.take(pa.array(rows)))
    above = batch.column("ancestor_transforms")
    deep = pc.fill_null(pc.list_value_length(above), 0).to_numpy(zero_copy_only=False)
    rows, level = np.flatnonzero(there & (deep > 0)), 0
    while len(rows):
        _moved(boxes, missing, rows, pc.list_element(above.take(pa.array(rows)), level))
        level += 1
        rows = rows[deep[rows] > level]
    lost = there & missing.any(axis=0)
    reject = pa.array(["bad symbol position", "bad ancestor translate"]).take(pa.array(lost.astype(np.int32), mask=~(lost | (is_use & ~there))))
    return box_array(boxes, there, missing), reject


def element_boxes(elements: DataFrame, include_polyline: bool = False, own_transform: bool = False) -> DataFrame:
    """Add ``box`` (NULL without usable geometry) and ``reject`` (why a row stops a page).

    Paths without readable data are dropped silently later on; an unreadable number on a
    symbol or in an ancestor transform is a reject.  ``own_transform`` also applies the
    element's own translate, which the default leaves out.  The members that boxes are made from
    are left out of the result.
    """
    if include_polyline:
        line = F.when((F.col("tag") == "polyline") & (F.col("points") != ""), polyline_bbox(F.col("points")))
        elements = once(elements, _LINE, line)
    kept = [f for f in elements.schema.fields if f.name not in (*_GEOMETRY, _LINE)]
    names = [f.name for f in kept]
    schema = T.StructType(kept).add("box", BOX).add("reject", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *_element_box(batch, own_transform)], [*names, "box", "reject"])

    return elements.mapInArrow(run, schema)


def normalise(boxes: DataFrame) -> DataFrame:
    """Centre and size of ``box`` in shares of the page (``page_w``, ``page_h``)."""
    w, h = F.col("box.xmax") - F.col("box.xmin"), F.col("box.ymax") - F.col("box.ymin")
    return boxes.withColumns({
        "norm_x": F.try_divide(F.col("box.xmin") + w / 2.0, F.col("page_w")),
        "norm_y": F.try_divide(F.col("box.ymin") + h / 2.0, F.col("page_h")),
        "norm_w": F.try_divide(w, F.col("page_w")),
        "norm_h": F.try_divide(h, F.col("page_h")),
    })


def valid_label() -> Column:
    """Positive size and no negative centre; NaN fails, and there is no upper bound."""
    sane = ~(F.isnan("norm_x") | F.isnan("norm_y") | F.isnan("norm_w") | F.isnan("norm_h"))
    return (
        sane & (F.col("norm_w") > 0) & (F.col("norm_h") > 0) & (F.col("norm_x") >= 0) & (F.col("norm_y") >= 0)
    )


def label_boxes(documents: DataFrame, include_polyline: bool = False, own_transform: bool = False,
                with_errors: bool = False) -> DataFrame:
    """Boxes of all elements of known class, with rejects marked and page size attached.

    Everything is row-local: the page size is worked out once per document before its
    elements are listed, so the whole way from document to label needs no shuffle.
    """
    tags = ("use", "path", "polyline") if include_polyline else ("use", "path")
    sized = _sized(documents, "page_d").drop("page_d")
    listed = page_elements(sized, with_errors).withColumn("class_id", class_id(F.col("cls")))
    wanted = F.col("tag").isin(*tags) & F.col("class_id").isNotNull()
    if with_errors:
        wanted = wanted | F.col("error").isNotNull()
    return element_boxes(listed.filter(wanted), include_polyline, own_transform)


def labels(documents: DataFrame, include_polyline: bool = False, own_transform: bool = False) -> DataFrame:
    """``file, ord, class_id, norm_x, norm_y, norm_w, norm_h`` of every valid element."""
    boxes = label_boxes(documents, include_polyline, own_transform)
    usable = boxes.filter(F.col("box").isNotNull() & F.col("reject").isNull())
    return normalise(usable).filter(valid_label()).select(
        "file", "ord", "class_id", "norm_x", "norm_y", "norm_w", "norm_h"
    )


def label_rejects(documents: DataFrame) -> DataFrame:
    """Rows that would stop a page, elements dropped for want of geometry, unreadable pages,
    and elements of a page without width or height, which have no place in it."""
    flat = (F.col("page_w") == 0) | (F.col("page_h") == 0)
    reason = F.coalesce(
        F.concat(F.lit("unreadable page: "), "error"), "reject", F.when(F.col("box").isNull(), "no usable geometry"),
        F.when(flat, "page of size zero"))
    return label_boxes(documents, with_errors=True).select(
        "file", "ord", "tag", "cls", reason.alias("reason")).filter(F.col("reason").isNotNull())


def format_label(labels_df: DataFrame) -> DataFrame:
    """The text line of each label: class id, then four numbers with six decimals."""
    numbers = [six_decimals(F.col(c)) for c in ("norm_x", "norm_y", "norm_w", "norm_h")]
    return labels_df.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *numbers))


def label_summary(labels_df: DataFrame) -> DataFrame:
    """Label rows per page, only for pages that have some."""
    return labels_df.groupBy("file").agg(F.count("*").alias("n_labels"))


def markup_tags(df: DataFrame, col: str) -> DataFrame:
    """Tag name and class of every start tag in a markup column, in order."""
    starts = F.regexp_extract_all(F.col(col), F.lit(r"<[A-Za-z][A-Za-z0-9]*(?:\s[^>]*)?/?>"), F.lit(0))
    has_class = F.col("start").rlike(r'\sclass="')
    return (
        df.select(*[c for c in df.columns if c != col], F.posexplode(starts).alias("ord", "start"))
        .withColumn("tag", F.regexp_extract("start", r"^<([A-Za-z][A-Za-z0-9]*)", 1))
        .withColumn("cls", F.when(has_class, F.regexp_extract("start", r'\sclass="([^"]*)"', 1)))
        .drop("start")
    )
