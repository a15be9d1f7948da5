"""Language of whole texts by the nearest of several centroids per language.

A text is the vector of its byte trigrams, hashed to ``FEATURES`` numbers, each the square
root of its count times its inverse document frequency, scaled to length 1.  Trigrams run over
letters; every other byte counts as a blank.  Each language has ``CENTROIDS`` directions, found
by clustering its training vectors; a text gets the language of the direction with the largest
cosine.  A text farther from all directions than nearly all labelled texts of its length are is
rejected: of every ``SPARE`` training texts one is left out of the clustering, and the bound is
the ``LOW`` quantile of the cosines of its beginnings, for each language and each length of
``LEVELS``.  That quantile is averaged with the one of all languages, which weighs as much as ``FIRM``
beginnings, and that with the bound of the length before, the first with ``SLACK`` of the least
training cosine; so few beginnings move a bound little, by one rule for any number.  Between two lengths the bound is interpolated, below the least it falls to 0.

The classifier is fitted on at most ``SAMPLE`` labelled texts, spread evenly over at most
``LANGUAGES`` languages (the most frequent); everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from notarium.llm.memory import give_back, hold_little, lean
from notarium.llm.shards import cut_batch
from notarium.llm.words import Texts, ragged, texts_of

FEATURES = 4096
CENTROIDS = 3
SAMPLE = 4000
LANGUAGES = 256
ROUNDS = 10
SPARE = 3
LOW = 0.01
LEVELS = 16 << np.arange(10)  # bytes of a beginning
FIRM = 100  # beginnings that a wider quantile weighs as much as
SLACK = 0.25  # share of the low training cosine that bounds where there are no spare beginnings
UNKNOWN = "und"

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass
class Model:
    """Unit directions with their languages, feature weights, and the least cosine that counts, by direction and level."""

    languages: list[str]
    directions: np.ndarray
    weights: np.ndarray
    least: np.ndarray


def trigram_counts(texts: Texts) -> np.ndarray:
    """(documents, FEATURES) counts of hashed trigrams, a blank before and after each text."""
    n = len(texts)
    data = np.insert(_LETTER[texts.data], texts.offsets, 0)
    code = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    edges = texts.offsets + np.arange(n + 1)  # places of the blanks
    doc = np.repeat(np.arange(n), np.diff(edges))[:len(code)]
    whole = code > 0
    whole[np.minimum(edges[1:-1] - 1, len(code) - 1)] = False  # runs over two documents
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
    return np.bincount(doc[whole] * FEATURES + slot[whole].astype(np.int64), minlength=n * FEATURES).reshape(n, FEATURES)


def _unit(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts, dtype=np.float32) * weights
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _groups(texts: Texts, most: int = 512) -> Iterator[tuple[int, int]]:
    for begin in range(0, len(texts), most):
        yield begin, min(begin + most, len(texts))


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by k-means on directions, started from texts far from each other."""
    mean = v.mean(axis=0)
    centres = [v[int(np.argmax(v @ mean))]]
    while len(centres) < min(k, len(v)):
        centres.append(v[int(np.argmin(np.max(v @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        c = np.array([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _beginning(texts: Texts, size: int) -> Texts:
    """The first ``size`` bytes of those texts that have as many."""
    starts = texts.offsets[:-1][np.diff(texts.offsets) >= size]
    return Texts(texts.data[ragged(starts, np.full(len(starts), size))], np.arange(len(starts) + 1) * size)


def _drawn(cosines: np.ndarray, toward: float) -> float:
    """The low quantile, averaged with ``toward`` as if ``FIRM`` cosines stood there."""
    low = np.quantile(cosines, LOW, method="lower") if len(cosines) else 0.0
    return (len(cosines) * low + FIRM * toward) / (len(cosines) + FIRM)


def _bounds(cosines: dict[str, list[np.ndarray]], names: list[str], first: np.ndarray) -> np.ndarray:
    """(directions, levels): the low quantile of a language's spare cosines, drawn towards that of all languages."""
    least = np.empty((len(names), len(LEVELS)))
    for k in range(len(LEVELS)):
        every = np.concatenate([c[k] for c in cosines.values()])
        for i, lang in enumerate(names):
            # Longer texts have higher cosines: the level before is a lower bound.
            shorter = least[i, k - 1] if k else first[i]
            least[i, k] = _drawn(cosines[lang][k], _drawn(every, shorter))
    return least


def _least(model: Model, best: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bound of each text of ``n`` trigrams whose nearest direction is ``best``."""
    at = np.clip(np.log2(np.maximum(n, 1) / LEVELS[0]), 0, len(LEVELS) - 1)
    low = np.minimum(at.astype(np.int64), len(LEVELS) - 2)
    share = at - low
    bound = (1 - share) * model.least[best, low] + share * model.least[best, low + 1]
    return bound * np.minimum(1.0, n / LEVELS[0])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on at most ``sample`` rows of ``labelled`` with a language, a text and an id.

    Rows are chosen by a hash of the id, so the choice is the same on every run.  No such rows
    give a model without languages, for which every text is ``und``.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "lang IS NOT NULL AND id IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model([], np.zeros((0, FEATURES), np.float32), np.ones(FEATURES, np.float32), np.zeros((0, len(LEVELS))))
    each = max(1, sample // len(counts))
    # Twice the wanted share by hash, then the exact number: the window sees a bounded table.
    shares = spark.createDataFrame([(r.lang, min(1.0, 2.0 * each / r.n + 20.0 / r.n)) for r in counts], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).filter(
        F.col("draw") < F.col("share") * float(1 << 40))
    placed = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch["text"])
            spare = batch["place"].to_numpy() % SPARE == 0
            for b, e in _groups(texts):
                whole = texts.part(b, e)
                # Level -1 is a whole text; only spare texts are cut.
                for level, size in enumerate([0, *LEVELS.tolist()], -1):
                    long = np.diff(whole.offsets) >= size
                    use = long & (spare[b:e] if level >= 0 else ~spare[b:e])
                    v = trigram_counts(_beginning(whole, size) if level >= 0 else whole)[use[long]]
                    v, use = np.minimum(v, 65535).astype("<u2"), np.flatnonzero(use)
                    yield pa.RecordBatch.from_arrays(
                        [batch["lang"].slice(b, e - b).take(pa.array(use)), pa.array(np.full(len(use), level, np.int32)),
                         pa.array([zstandard.compress(x.tobytes(), 1) for x in v], pa.binary())], ["lang", "level", "v"])

    got = placed.filter(F.col("place") <= each).select("lang", "text", "place").mapInArrow(lean(vectors), "lang string, level int, v binary").collect()
    hold_little()
    got.sort(key=lambda r: (r.level, r.lang, bytes(r.v)))
    raw, langs = _unpacked([r for r in got if r.level < 0])
    weights = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    v = _unit(raw, weights)
    names, directions, first = [], [], []
    for lang in sorted(set(langs)):
        own = v[langs == lang]
        c = _clusters(own, centroids)
        names += [lang] * len(c)
        directions.append(c)
        first += [SLACK * float(np.quantile(np.max(own @ c.T, axis=1), 0.001))] * len(c)
    if not names:
        return Model([], np.zeros((0, FEATURES), np.float32), weights, np.zeros((0, len(LEVELS))))
    toward = np.concatenate(directions).astype(np.float32)
    cosines = {lang: [] for lang in sorted(set(names))}
    for level, size in enumerate(LEVELS.tolist()):
        raw, langs = _unpacked([r for r in got if r.level == level])
        # A beginning of digits and signs is as short as its trigrams are few.
        lettered = raw.sum(axis=1) >= size / 2
        best = np.max(_unit(raw, weights) @ toward.T, axis=1)
        for lang, found in cosines.items():
            found.append(best[lettered & (langs == lang)])
    del got, raw, v
    give_back()  # the driver's own, too
    return Model(names, toward, weights, _bounds(cosines, names, np.array(first)))


def _unpacked(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts and languages of the rows that have a trigram."""
    raw = np.array([np.frombuffer(zstandard.decompress(r.v), "<u2") for r in rows], np.float32).reshape(len(rows), FEATURES)
    filled = raw.any(axis=1)
    return raw[filled], np.array([r.lang for r in rows], object)[filled]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected[, carried, text]) for every row, from the text alone.

    ``score`` is the cosine with the nearest direction, from 0 to 1.  A null text, and one
    without a letter, gives ``und``, 0 and is rejected.  ``rejected`` also marks texts farther
    from every direction than nearly all labelled texts of that length are.  Rows stay where they are; repeated rows and
    null ids are kept.  ``carry`` names columns to be handed through in the struct ``carried``, beside ``text``.
    """
    chosen = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if carry:
        chosen.append(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"))
    rows = docs.select(*chosen)
    out = T.StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]
    if carry:
        kind = rows.schema["carried"].dataType
        out = out.add("carried", kind).add("text", "string")
        fields += [("carried", to_arrow_type(kind)), ("text", pa.string())]
    schema = pa.schema(fields)
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_batch(whole):
                texts = texts_of(batch["text"])
                best, score, rejected = [], [], []
                for b, e in _groups(texts):
                    part = texts.part(b, e)
                    at, cosine, bad = _nearest(part, model)
                    best.append(at)
                    score.append(cosine)
                    rejected.append(bad)
                columns = [batch["doc_id"], pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score)),
                           pa.array(np.concatenate(rejected))]
                if carry:
                    columns += [batch["carried"], batch["text"]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(lean(run), out)


def _nearest(texts: Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Direction, cosine and rejection of each text; the direction after the last means unknown."""
    n = len(texts)
    letters = np.r_[0, np.cumsum((_LETTER[texts.data] > 0) & (texts.data < 128))][texts.offsets]
    some = np.diff(letters) > 0
    for i in np.flatnonzero(~some & (np.diff(texts.offsets) > 0)).tolist():
        some[i] = any(map(str.isalpha, texts.data[texts.offsets[i]:texts.offsets[i + 1]].tobytes().decode()))
    unknown = np.full(n, len(model.languages))
    if not model.languages:
        return unknown, np.zeros(n), np.ones(n, bool)
    counts = trigram_counts(texts)
    cosines = _unit(counts, model.weights) @ model.directions.T
    best = np.argmax(cosines, axis=1)
    score = np.clip(cosines[np.arange(n), best].astype(np.float64), 0.0, 1.0)
    far = score < _least(model, best, counts.sum(axis=1))
    return np.where(some, best, unknown), np.where(some, score, 0.0), far | ~some
