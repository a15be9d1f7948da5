"""What each filter of a chain removes in every order of the chain, and its share over all orders.

Documents are counted once by part and by the set of filters that they fail.  From these counts
comes a game: a coalition of filters removes every document that fails at least one of them.

* **Steps** are differences of two coalitions: what a filter removes after others is what the
  others remove with it, less what they remove without it.
* **Shapley numbers** come from the potential of Hart and Mas-Colell.  The potential of no filter
  is 0, that of a coalition is what it removes plus the potentials of the coalitions with one
  filter less, divided by its size; a filter's share is the potential of all filters less that of
  all the others.  Potentials are kept times the number of orders, so all of them are whole.

At scale: one pass over the texts leaves a narrow row per document in the shared folder.  Whether
a text has an earlier copy is found by joining on text and id together, so that a text which a
third of all documents share meets in no task.  A part is one row of at most 32 counts from there
on, however many documents it has; the orders are made row by row.

Null texts are empty ones, a null source is the part ''.  A document without id has no earlier
copy and is none; rows that repeat an id and text are counted each and are no copies of each
other.  Of several labels of a document any counts.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.session import materialise

FILTERS = "ABCDE"
# Fixed values of the five filters.
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of words
MOST_CAPITALS = 5  # percent of code points
SIGNS = "[#$%&*|]"
_BLANKS = " \t\n\x0b\x0c\r"


def bit(letter: str, filters: str = FILTERS) -> int:
    return 1 << filters.index(letter)


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D."""
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def text_failures(text: Column, words: Column) -> Column:
    """Filters A to D that a text fails, as bits."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }
    return sum((F.when(hit, bit(letter)).otherwise(0) for letter, hit in fails.items()), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by ``part``, ``mask`` of failed filters, ``good`` and ``toxic``: at most 128 rows a part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", text.alias("text")).withColumn(
        "words", word_list(F.col("text")))
    seen = materialise(read.select(
        "part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures(F.col("text"), F.col("words")).alias("mask")), "failures")
    rows = seen.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    firsts = seen.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # The same kind of join at every size: narrow rows move once, never the texts.
    known = rows.join(firsts.hint("merge"), ["digest", "doc_id"], "left").join(marks.hint("merge"), "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(copy, bit("E")).otherwise(0)
    return known.groupBy(
        "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    ).agg(F.sum("n").alias("n"))


def games(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part: what every coalition removes (all, good, toxic) and its potential times the number of orders.

    Arrays are indexed by the coalition's bits.
    """
    size = 1 << len(filters)
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    by_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    parts = by_mask.groupBy("part").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("by_mask"))
    coalitions = F.sequence(F.lit(0), F.lit(size - 1))
    zero = F.lit(0).cast("bigint")

    def summed(name: str, take) -> Column:
        return F.transform(coalitions, lambda s: F.aggregate(
            "by_mask", zero, lambda sum_, m: sum_ + F.when(take(m["mask"], s), m[name]).otherwise(0)))

    def removed(name: str) -> Column:
        return summed(name, lambda mask, s: mask.bitwiseAND(s) != 0)

    out = parts.select(
        "part", "total", removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic"),
        summed("n", lambda mask, s: mask == s).alias("exactly"))
    orders = math.factorial(len(filters))
    bits = F.array(*[F.lit(1 << i) for i in range(len(filters))])

    def potential(known: Column, s: Column) -> Column:
        without = F.aggregate(F.filter(bits, lambda b: s.bitwiseAND(b) != 0), zero,
                              lambda sum_, b: sum_ + F.element_at(known, s - b + 1))
        return F.call_function("div", F.lit(orders) * F.element_at("removed", s + 1) + without, F.bit_count(s).cast("bigint"))

    return out.withColumn("potential", F.aggregate(
        F.sequence(F.lit(1), F.lit(size - 1)), F.array(zero), lambda known, s: F.array_append(known, potential(known, s))))


def steps(game: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, every step of it, for every part."""
    every = (1 << len(filters)) - 1
    orders = F.split(F.lit(" ".join("".join(o) for o in itertools.permutations(filters))), " ")
    dealt = game.withColumn("filter_order", F.explode(orders))
    at = dealt.select("*", F.posexplode(F.split("filter_order", "")).alias("_place", "_letter"))
    earlier = F.substring("filter_order", F.lit(1), F.col("_place"))
    before = sum((F.when(F.contains(earlier, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    own = sum((F.when(F.col("_letter") == f, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    step = at.withColumns({"_before": before, "_own": own})

    def of(name: str, coalition: Column) -> Column:
        return F.element_at(name, coalition + 1)

    def gain(name: str) -> Column:
        return of(name, F.col("_before") + F.col("_own")) - of(name, F.col("_before"))

    return step.select(
        "part", "filter_order", (F.col("_place") + 1).cast("int").alias("step"),
        (F.col("total") - of("removed", F.col("_before") + F.col("_own"))).alias("kept"),
        gain("removed").alias("removed"),
        (of("removed", F.col("_own")) - gain("removed")).alias("redundant"),
        of("exactly", F.col("_own")).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (of("potential", F.lit(every)) - of("potential", F.lit(every) - F.col("_own"))).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters over documents and their labels."""
    return steps(games(failures(docs, labels)))
