"""Quality rules: base counts of each text, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words fall into ``BUCKETS`` hash buckets.  Two multinomials
over the buckets are counted: one over all documents, one over trusted documents.  A text's
ratio is the sum of log(trusted / all) over its n-grams, divided by their number.  A text is
rejected below the ``LOW`` quantile of the ratios that trusted documents have when those of
their own ``FOLDS``th part aren't counted as trusted, so the verdict doesn't depend on how many are trusted.
(With their own counted, few trusted documents have far higher ratios than good ones unseen.)
The quantile is averaged with the ratio of a text that has nothing in common with trusted ones, which weighs
as much as ``FIRM`` documents; so none reject nothing and few are followed, by one rule for any number.

Everything is built-in expressions.  The corpus counts are one aggregate of at most
``BUCKETS`` rows; the weights travel as one row of ``BUCKETS`` numbers.  All documents with a
good label are trusted; their n-grams are written once.  What is needed more than once inside a row is bound by a higher-order function, and words, repeats and ratio
never leave their row, however long the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.functions.expressions import bind
from notarium.session import materialise

BUCKETS = 1 << 14
PRIOR = 16 * BUCKETS
LOW = 0.005
FIRM = 1
FOLDS = 10
STEPS = 10_000  # bins of a unit of the ratio
NEAR = 1e-9  # ratios this little below the bound are at it
LEAST_WORDS = 50
PLACE_BITS = 20
MOST_RANGES = 1 << 14  # bitmaps of 4 KB that are broadcast at most

_BLANKS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Runs of characters other than blanks; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANKS), "")


def _buckets(words: Column) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    size = F.lit(BUCKETS)

    def both(h: Column) -> Column:
        single = F.transform(h, lambda x: F.pmod(x, size).cast("int"))
        pairs = F.when(F.size(h) > 1, F.transform(
            F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), size).cast("int")))
        return F.concat(single, F.coalesce(pairs, F.array().cast("array<int>")))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), both)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur at least twice in the text.

    Window hashes are sorted with their places in one number each; neighbours with equal
    hashes are compared by their words.  Places of repeated windows, in order, then cover up
    to three words each.  Texts of more than 2^20 words sort pairs of hash and place.
    """
    def window(w: Column, i: Column) -> Column:
        return F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.coalesce(F.least(F.lit(3), (F.get(at, j + 1) - p).cast("int")), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    def repeats(w: Column, hashes: Column, place, same) -> Column:
        """Places of windows that equal a neighbour in hash order."""
        def twin(s: Column, i: Column, j: Column) -> Column:
            x, y = F.get(s, i), F.get(s, j)
            return F.coalesce(same(x, y) & (window(w, place(x)) == window(w, place(y))), F.lit(False))

        def places(s: Column) -> Column:
            flagged = F.filter(F.transform(s, lambda x, j: F.when(
                ((j > 0) & twin(s, j, j - 1)) | twin(s, j, j + 1), place(x))), lambda p: p.isNotNull())
            return F.array_sort(flagged)

        return bind(F.sort_array(hashes), places)

    def packed(w: Column) -> Column:
        mask = F.lit((1 << PLACE_BITS) - 1)
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
        return repeats(w, hashes, lambda x: x.bitwiseAND(mask).cast("int"),
                       lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS))

    def paired(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return repeats(w, hashes, lambda x: x["i"], lambda x, y: x["h"] == y["h"])

    zero = F.lit(0).cast("long")
    return (F.when(F.size(words) < 3, zero).when(F.size(words) <= 1 << PLACE_BITS, bind(packed(words), covered))
            .otherwise(bind(paired(words), covered)))


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """Base counts by name; ``words`` are those of ``text``."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(_WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all labelled documents of good quality that aren't toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()


def id_bitmaps(ids: DataFrame) -> DataFrame:
    """(range, bits): ids as one bitmap of 4 KB for each range of 32 768 that holds any."""
    return ids.groupBy(F.bitmap_bucket_number("doc_id").alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))


def has_bit(bits: Column, place: Column) -> Column:
    """Whether a bitmap holds a place, counted from 0."""
    octet = F.conv(F.hex(F.substring(bits, F.call_function("div", place, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", octet, (place % 8).cast("int")) == 1


def trusted_grams(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(grams, fold): buckets of each document with a trusted id, and its part.

    Trusted ids come as bitmaps, which are broadcast where they are counted to be at most
    ``MOST_RANGES`` (64 MB: ids up to some 500 million if they lie close); no text moves then.
    Beyond that texts and ids meet by a shuffle, with the same result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bitmaps = materialise(id_bitmaps(trusted), "bitmaps")
    if bitmaps.count() <= MOST_RANGES:
        near = F.col("range") == F.bitmap_bucket_number("doc_id")
        chosen = texts.join(F.broadcast(bitmaps), near).filter(has_bit(F.col("bits"), F.bitmap_bit_position("doc_id")))
    else:
        chosen = texts.join(trusted.hint("merge"), "doc_id", "left_semi")
    return chosen.select(_buckets(words_of(F.col("text"))).alias("grams"), fold_of(F.col("text")).alias("fold"))


def mean_weight(grams: Column, w: Column) -> Column:
    """Mean of the weights ``w`` over ``grams``; 0 without n-grams."""
    return F.when(F.size(grams) > 0, F.aggregate(grams, F.lit(0.0), lambda total, b: total + F.get(w, b)) / F.size(grams)).otherwise(0.0)


def fold_of(text: Column) -> Column:
    """The part of the trusted documents that a document belongs to; copies share it."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def fold_weights(counts: DataFrame) -> DataFrame:
    """(fold, w): the weights without the trusted documents of each fold; ``FOLDS`` rows."""
    def weight(x: Column, n: Column, fold: Column) -> Column:
        share = (x["everywhere"] + 1) / (n["e"] + BUCKETS)
        return F.log(x["trusted"] - F.get(x["parts"], fold) + PRIOR * share) - F.log(n["t"] - F.get(n["parts"], fold) + PRIOR) - F.log(share)

    rows = counts.select("c", "n", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))
    return rows.select("fold", F.transform("c", lambda x: weight(x, F.col("n"), F.col("fold"))).alias("w"))


def derived_threshold(good: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: the lower edge of the bin with the ``LOW`` quantile of the ratios without the own fold,
    averaged with the least ratio there can be by the number of ratios and ``FIRM``.

    All trusted documents of ``LEAST_WORDS`` words count, in bins of a fixed width, so the
    last step sees a table of bounded size and the result is the same on every run.
    """
    long = good.filter(F.size("grams") >= 2 * LEAST_WORDS - 1)
    ratio = mean_weight(F.col("grams"), F.col("w"))
    folds = materialise(fold_weights(counts), "folds")
    bins = long.join(F.broadcast(folds), "fold").select(F.floor(ratio * STEPS).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    row = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))

    def step(s: Column, x: Column) -> Column:
        seen = s["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.coalesce(s["bin"], F.when(seen > LOW * total, x["bin"])).alias("bin"))

    at = F.aggregate("b", start, step, lambda s: s["bin"])
    low = F.coalesce(at / STEPS, F.lit(0.0))  # without ratios its share is 0
    least = F.log(F.lit(float(PRIOR))) - F.log(F.col("t") + PRIOR)
    return row.join(F.broadcast(counts.select(F.col("n.t").alias("t")))).select(
        ((total * low + FIRM * least) / (total + FIRM) - NEAR).alias("threshold"))


def corpus_counts(docs: DataFrame, good: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: ``c``, the counts of every bucket, and their sums ``n``; ``good`` are the trusted n-grams."""
    every = docs.select(F.explode(_buckets(words_of(F.col(text_col)))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("everywhere"))
    parts = good.select("fold", F.explode("grams").alias("bucket")).groupBy("bucket", "fold").agg(F.count("*").alias("n"))
    trusted = parts.groupBy("bucket").agg(
        F.sum("n").alias("trusted"), *(F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"part{k}") for k in range(FOLDS)))
    counts = every.join(F.broadcast(trusted), "bucket", "left")
    spark = docs.sparkSession
    all_buckets = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = all_buckets.join(F.broadcast(counts), "bucket", "left").fillna(0)
    row = filled.agg(F.sort_array(F.collect_list(F.struct(
        "bucket", "everywhere", "trusted", F.array(*(f"part{k}" for k in range(FOLDS))).alias("parts")))).alias("c"))

    def total(of) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda t, x: t + of(x))

    parts = F.array(*(total(lambda x, k=k: F.get(x["parts"], F.lit(k))) for k in range(FOLDS)))
    return row.select("c", F.struct(
        total(lambda x: x["trusted"]).alias("t"), total(lambda x: x["everywhere"]).alias("e"), parts.alias("parts")).alias("n"))


def weights(docs: DataFrame, good: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: the weight log(trusted / all) of every bucket; ``good`` are the trusted n-grams."""
    return weights_of(corpus_counts(docs, good, text_col))


def weights_of(counts: DataFrame) -> DataFrame:
    """The weights by ``corpus_counts``.

    All documents count.  The trusted multinomial starts from ``PRIOR`` n-grams spread as in
    all documents, so few trusted ones give weights near 0, and none give 0.
    """
    def weight(x: Column, n: Column) -> Column:
        share = (x["everywhere"] + 1) / (n["e"] + BUCKETS)
        return F.log((x["trusted"] + PRIOR * share) / (n["t"] + PRIOR)) - F.log(share)

    return counts.select(bind(F.struct("c", "n"), lambda s: F.transform(s["c"], lambda x: weight(x, s["n"]))).alias("weights"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept[, carried]).

    ``base_failed``: fewer than ``LEAST_WORDS`` words, or more than half of them in repeated
    windows.  ``kept``: not failed, and ``ratio`` not below ``threshold``; by default
    that is derived from the trusted documents.

    A null or blank text has no words, fails the base rules and has ratio 0.  Repeated rows
    and null ids each give a row; a null id is never trusted.  No rows give no rows.
    ``carry`` names columns to be handed through in the struct ``carried``.
    """
    good = materialise(trusted_grams(docs, trusted_ids(labels), id_col, text_col), "trusted")
    counts = materialise(corpus_counts(docs, good, text_col), "counts")
    least = derived_threshold(good, counts) if threshold is None else docs.sparkSession.range(1).select(F.lit(threshold).alias("threshold"))
    row = materialise(weights_of(counts).join(F.broadcast(least)), "weights").withColumn("one", F.lit(1))
    chosen = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(1).alias("one")]
    if carry:
        chosen.append(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"))
    joined = docs.select(*chosen).join(F.broadcast(row), "one")
    w = F.col("weights")

    def facts(words: Column) -> Column:
        grams = bind(_buckets(words), lambda g: mean_weight(g, w))
        columns = [c.alias(n) for n, c in base_counts(F.col("text"), words).items()]
        return F.struct(*columns, grams.alias("ratio"))

    kept = ["doc_id", "threshold", *(["carried"] if carry else [])]
    rows = joined.select(*kept, F.explode(F.array(bind(words_of(F.col("text")), facts))).alias("f"))
    failed = (F.col("f.n_words") < LEAST_WORDS) | (100 * F.col("f.n_repeat_words") > 50 * F.col("f.n_words"))
    verdict = ~failed & (F.col("f.ratio") >= F.col("threshold"))
    return rows.select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
                      failed.alias("base_failed"), "f.ratio", *kept[2:], verdict.alias("kept"))
