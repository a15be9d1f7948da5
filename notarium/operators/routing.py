"""Input routing and manifests over file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.functions import paths

# Extensions by route, and those the file dialog offers.
RECOGNISE = (".png", ".jpg", ".pdf")
CONVERT = (".xml", ".mxl")
AS_IS = (".mid", ".midi")


def path_parts(df: DataFrame, col: str = "path") -> DataFrame:
    return df.withColumns({
        "parent": paths.parent_folder(col), "stem": paths.stem(col), "ext": paths.extension(col),
    })


def route_inputs(df: DataFrame) -> DataFrame:
    """Which chain of conversions a file takes.  Unknown kinds are shown as ``fallthrough``."""
    ext = F.col("ext")
    return df.withColumn(
        "route",
        F.when(ext.isin(*RECOGNISE), "recognise")
        .when(ext.isin(*CONVERT), "convert")
        .when(ext.isin(*AS_IS), "as_is")
        .otherwise("fallthrough"),
    )


def planned_paths(df: DataFrame, col: str = "path") -> DataFrame:
    """Where the score and the MIDI file of an input lie; a MIDI input is its own result."""
    beside = lambda suffix: paths.sibling(F.col("parent"), F.concat(F.col("stem"), F.lit(suffix)))
    return df.withColumns({
        "score_path": beside(".mxl"),
        "midi_path": F.when(F.col("route") == "as_is", F.col(col)).otherwise(beside(".mid")),
    })


def dialog_filter(df: DataFrame) -> DataFrame:
    """Flag what the file dialog would offer; dropped files are never filtered."""
    return df.withColumn("accepted_by_dialog", F.col("ext").isin(*RECOGNISE, *CONVERT, *AS_IS))


def routed(df: DataFrame, col: str = "path") -> DataFrame:
    """All routing columns of a list of paths; a projection, so it also runs on streams."""
    return dialog_filter(planned_paths(route_inputs(path_parts(df, col)), col))


def score_files(df: DataFrame, col: str = "file") -> DataFrame:
    """Keep names ending in ``.xml`` or ``.mxl``, in this spelling only."""
    return df.filter(F.col(col).endswith(".xml") | F.col(col).endswith(".mxl"))


def render_manifest(df: DataFrame, col: str = "file") -> DataFrame:
    """Score files with their page target, flagging targets several scores write to.

    The counts are aggregated map-side and joined back, so that a target shared by very
    many scores is not gathered into one window.
    """
    listed = score_files(df, col).withColumn(
        "target", F.concat(F.regexp_replace(F.col(col), r"\.[^.]*$", ""), F.lit(".svg"))
    )
    sources = listed.groupBy("target").agg(F.count("*").alias("n_sources"))
    return listed.join(sources, "target").withColumn("is_collision", F.col("n_sources") > 1)


def manifest_status(manifest: DataFrame, results: DataFrame, col: str = "file") -> DataFrame:
    """SUCCESS or FAILED per manifest row by exit status.

    ``results``: file, ``attempt``, ``exit_code``; the latest attempt counts.  Files
    without a result are PENDING: one failure does not stop the others.
    """
    latest = results.groupBy(col).agg(F.max_by("exit_code", "attempt").alias("exit_code"))
    return manifest.join(latest, col, "left").withColumn(
        "status",
        F.when(F.col("exit_code").isNull(), "PENDING").when(F.col("exit_code") == 0, "SUCCESS").otherwise("FAILED"),
    )


def label_target(df: DataFrame, col: str = "file") -> DataFrame:
    """Name of the label file of a page: every ``.svg`` in the name becomes ``.txt``."""
    return df.withColumn("label_file", F.replace(F.col(col), F.lit(".svg"), F.lit(".txt")))
