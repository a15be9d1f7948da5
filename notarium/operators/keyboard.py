"""The 88-key keyboard as a table (K1-K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notarium.functions.expressions import trunc_div

# Keyboard layout and screen geometry, in pixels.
KEY_COUNT = 88
WHITE_COUNT = 52
LOWEST_PITCH = 21
BLACK_STEPS = (1, 3, 6, 8, 10)
NOTE_NAMES = ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
SCREEN_WIDTH = 1280
HIT_LINE = 570
WHITE_HEIGHT = 150
BLACK_HEIGHT = 90
BLACK_WIDTH = 14


def is_black(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12)).isin(*BLACK_STEPS)


def key_label(pitch: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.element_at(names, F.pmod(pitch, F.lit(12)).cast("int") + 1)


def key_base(spark: SparkSession) -> DataFrame:
    """88 rows: ``key_index``, ``pitch``, ``is_black``, ``label``."""
    pitch = (F.col("id") + LOWEST_PITCH).cast("int")
    return spark.range(0, KEY_COUNT, 1, 1).select(
        F.col("id").cast("int").alias("key_index"),
        pitch.alias("pitch"),
        is_black(pitch).alias("is_black"),
        key_label(pitch).alias("label"),
    )


def keyboard(spark: SparkSession, screen_width: int = SCREEN_WIDTH, hit_line: int = HIT_LINE) -> DataFrame:
    """All keys with their rectangles; white keys sort before black ones in ``z_order``.

    The only table in the package with a fixed size (88 rows), so its two windows over
    the whole of it are harmless.
    """
    in_order = Window.partitionBy(F.lit(0)).orderBy("key_index")
    whites = F.sum(F.when(~F.col("is_black"), 1).otherwise(0)).over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    edge = trunc_div(F.col("whites").cast("bigint") * screen_width, WHITE_COUNT).cast("int")
    left = trunc_div((F.col("whites").cast("bigint") - 1) * screen_width, WHITE_COUNT).cast("int")
    black = F.col("is_black")
    placed = key_base(spark).withColumn("whites", whites).select(
        "key_index",
        "is_black",
        F.when(black, edge - BLACK_WIDTH // 2).otherwise(left).alias("x"),
        F.lit(hit_line).alias("y"),
        F.when(black, BLACK_WIDTH).otherwise(edge - left).alias("width"),
        F.when(black, BLACK_HEIGHT).otherwise(WHITE_HEIGHT).alias("height"),
        "label",
    )
    draw_order = Window.partitionBy(F.lit(0)).orderBy("is_black", "key_index")
    return placed.withColumn("z_order", F.row_number().over(draw_order) - 1)


def key_style(keys: DataFrame, pressed: str = "is_pressed") -> DataFrame:
    """Fill colour and label position of each key by colour and pressed flag."""
    black, down = F.col("is_black"), F.col(pressed)
    return keys.withColumns({
        "fill": F.when(~black & down, "darkblue")
        .when(~black, "rgb(230,230,230)")
        .when(down, "gray")
        .otherwise("black"),
        "label_x": F.col("x") + F.when(black, 2).otherwise(5),
        "label_y": F.col("y") + F.col("height") - F.when(black, 15).otherwise(20),
    })
