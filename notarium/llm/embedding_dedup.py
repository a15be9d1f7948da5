"""Embedding near-dedup by sorted projection passes.

Each pass gives every vector the signs of its products with random directions, one after the
other, as one number, and sorts by it within a label.  Near vectors agree in most signs and
often in the leading ones, so they come to stand close together; a vector is compared with
at least ``WINDOW`` successors of each pass.  Links found in the passes are joined.

The larger a label, the more leading signs a pair must share to stand close together: a pass puts
a pair with cosine c into one block of n vectors with a chance of about a^log2(n / ``BLOCK``), where
a = 1 - arccos(c) / pi is the chance of one sign.  The number of passes follows from that and from the
counted size of the largest label, so that ``RECALL`` of the pairs at the bound are found at every size.

Equal vectors are one class from the start, however many there are.  Where a window is full
of links up to its end, more near vectors follow than it holds; such stretches are compared
further on, over distances that double until no window ends full.  So a dense group larger
than a window loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm.components import components
from notarium.session import materialise

COSINE = 0.93
PASSES = 8  # at least
RECALL = 0.99  # of pairs at the bound
BITS = 60
BLOCK = 512
WINDOW = 256
SEED = 11

_LINK, _FULL = 0, 1
_OUT = "kind int, a long, b long"
_OUT_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def passes_for(largest: int, cosine: float = COSINE, block: int = BLOCK, recall: float = RECALL) -> int:
    """Passes that find ``recall`` of the pairs at ``cosine`` in a label of ``largest`` vectors."""
    sign = 1 - math.acos(cosine) / math.pi
    hit = sign ** max(0.0, math.log2(max(largest, 1) / block))
    return PASSES if hit >= 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-hit)))


def directions(dim: int, passes: int, bits: int = BITS) -> np.ndarray:
    """Random directions of all passes; the same for every task."""
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, passes * bits))


def projection_keys(vectors: np.ndarray, passes: int) -> np.ndarray:
    """(vectors, passes) numbers of ``BITS`` signs each."""
    signs = (vectors @ directions(vectors.shape[1], passes)) > 0
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return signs.reshape(len(vectors), passes, BITS) @ weights


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of vectors of one length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        starts = column.offsets.to_numpy()[at]
        yield at, flat[starts[:, None] + np.arange(dim)]


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, passes: int | None = None, block: int = BLOCK, window: int = WINDOW,
                 recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of the same label and length are linked where their cosine in double precision is
    at least ``cosine``; only pairs that some pass puts within a window are looked at, and none
    below is linked.  ``passes`` is by default what ``recall`` needs for the largest label.  A null label, and a vector that is null, empty, zero or holds a null or
    non-finite number, links with nothing.  Repeated rows are vectors of their own, linked with
    each other.  A null id counts in ``n_links`` of others, is never a ``component_id`` of others
    and isn't ``kept``.  No rows give no rows.  Other columns aren't read.
    """
    if not 0 < window <= block:
        raise ValueError("the window must lie within a block")
    vector = F.col(vector_col)
    sane = (F.col(label_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector, lambda x: x != 0))
    base = materialise(rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(sane, F.xxhash64(F.col(label_col), vector)).alias("node"),
        F.col(label_col).alias("label"), vector.alias("vector")), "vectors")
    classes = base.filter("node IS NOT NULL").groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.count("*").alias("size"))
    classes = materialise(classes, "classes")
    if passes is None:
        # One number, however many labels there are.
        largest = classes.groupBy("label", F.size("vector")).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
        passes = passes_for(largest or 0, cosine, block, recall)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _by_length(batch["vector"]):
                node = batch["node"].take(pa.array(at))
                label = batch["label"].take(pa.array(at))
                found = projection_keys(matrix, passes)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), label, pa.array(np.full(len(at), matrix.shape[1], np.int32)),
                         pa.array(found[:, p]), node], ["pass", "label", "dim", "key", "node"])

    kind = classes.schema["label"].dataType.simpleString()
    order = ["pass", "label", "dim", "key", "node"]
    sorted_rows = classes.select("node", "label", "vector").mapInArrow(
        keys, f"pass int, label {kind}, dim int, key long, node long").repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(n, n + size)), batch["pass"], batch["node"]],
                ["part", "place", "pass", "node"])
            n += size

    numbered = materialise(sorted_rows.select("pass", "node").mapInArrow(number, "part int, place long, pass int, node long"), "ranks")
    # One row for each partition of the sort, however many vectors there are.
    starts, total = [], 0
    for part, n in sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "part int, first long")
    ranks = numbered.join(F.broadcast(offsets), "part").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("pass", (F.col("first") + F.col("place")).alias("rank")))).alias("r"))
    placed = materialise(classes.join(ranks, "node").select(
        "node", F.xxhash64("label").alias("label"), "vector", F.col("r.rank").alias("ranks")), "placed")
    homes = placed.select("node", "label", "vector", "ranks", F.posexplode("ranks").alias("pass", "rank")).withColumn(
        "block", F.expr(f"rank div {block}"))

    def compare(left: pa.Table, right: pa.Table, pass_no: int, same: bool, guests: bool) -> pa.Table:
        a, b = [], []
        full = False
        left_n, right_n = left["node"].to_numpy(), right["node"].to_numpy()
        left_l, right_l = left["label"].to_numpy(), right["label"].to_numpy()
        left_r, right_r = (np.array(t["ranks"].to_pylist(), np.int64).reshape(t.num_rows, passes) for t in (left, right))
        right_groups = {m.shape[1]: (at, m) for at, m in _by_length(right["vector"].combine_chunks())}
        for at, m in _by_length(left["vector"].combine_chunks()):
            if m.shape[1] not in right_groups:
                continue
            bt, n = right_groups[m.shape[1]]
            near = (m @ n.T) >= cosine * np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(n, axis=1))
            near &= left_l[at][:, None] == right_l[bt][None, :]
            far = right_r[bt, pass_no]
            if not same:
                tail = far >= np.quantile(far, 0.75)
                full = full or bool((near[:, tail].all(axis=1)).any())
            i, j = np.nonzero(near)
            i, j = at[i], bt[j]
            if same:
                use = left_r[i, pass_no] < right_r[j, pass_no]
                i, j = i[use], j[use]
            a.append(np.stack([i, j]))
        if a:
            i, j = np.concatenate(a, axis=1)
            known = np.zeros(len(i), bool)
            for p in range(pass_no if guests else passes):
                x, y = left_r[i, p], right_r[j, p]
                low, high = np.minimum(x, y), np.maximum(x, y)
                known |= (low // block == high // block) | ((low // block + 1 == high // block) & (high % block < window))
            i, j = i[~known], j[~known]
            a, b = left_n[i], right_n[j]
        kinds, firsts, seconds = np.zeros(len(a), np.int32), np.asarray(a, np.int64), np.asarray(b, np.int64)
        if full:
            kinds, firsts, seconds = np.r_[kinds, np.int32(_FULL)], np.r_[firsts, 0], np.r_[seconds, 0]
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array(firsts, pa.int64()), "b": pa.array(seconds, pa.int64())})

    def near(table: pa.Table) -> pa.Table:
        """A block with the first of the next."""
        number, pass_no = table["block"][0].as_py(), table["pass"][0].as_py()
        role = table["guest"].to_numpy(zero_copy_only=False)
        home, guest = table.filter(pa.array(~role)), table.filter(pa.array(role))
        out = [compare(home, home, pass_no, True, True)] if home.num_rows else []
        if home.num_rows and guest.num_rows:
            out.append(compare(home, guest, pass_no, False, True))
        return _named(out, number, pass_no)

    def farther(table: pa.Table) -> pa.Table:
        """Two blocks of one pass at a distance."""
        number, pass_no = table["block"][0].as_py(), table["pass"][0].as_py()
        role = table["guest"].to_numpy(zero_copy_only=False)
        home, guest = table.filter(pa.array(~role)), table.filter(pa.array(role))
        out = [compare(home, guest, pass_no, False, False)] if home.num_rows and guest.num_rows else []
        return _named(out, number, pass_no)

    copies = F.array(
        F.struct(F.col("block"), F.lit(False).alias("guest")),
        F.struct((F.col("block") - 1).alias("block"), F.lit(True).alias("guest")))
    first = homes.withColumn("c", F.explode(copies)).filter(f"NOT c.guest OR (c.block >= 0 AND rank % {block} < {window})").select(
        "node", "label", "vector", "ranks", "pass", "c.block", "c.guest")
    # A block may hold the end of one pass and the start of the next: they are told apart.
    found = materialise(first.groupBy("block", "pass").applyInArrow(near, _OUT), "links")
    rounds, distance = [found], 1
    while True:
        full = rounds[-1].filter(f"kind = {_FULL}").select(F.col("a").alias("block"), F.col("b").alias("pass")).distinct()
        if full.isEmpty():
            break
        pairs = full.select("block", "pass", F.explode(F.sequence(F.lit(distance), F.lit(2 * distance - 1))).alias("step"))
        keep = ["node", "label", "vector", "ranks", "pass", "block", "step", "guest"]
        one = homes.join(pairs, ["block", "pass"]).withColumn("guest", F.lit(False)).select(*keep)
        two = homes.withColumnRenamed("block", "at").join(
            pairs.withColumn("at", F.col("block") + F.col("step")), ["at", "pass"]).withColumn("guest", F.lit(True)).select(*keep)
        rounds.append(materialise(one.unionByName(two).groupBy("block", "pass", "step").applyInArrow(farther, _OUT), "links"))
        distance *= 2
    links = rounds[0]
    for r in rounds[1:]:
        links = links.unionByName(r)
    links = materialise(links.filter(f"kind = {_LINK}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    both = links.union(links.select("b", "a")).toDF("node", "other")
    partners = both.join(classes.select(F.col("node").alias("other"), "size"), "other").groupBy("node").agg(F.sum("size").alias("n"))
    joined = components(links)
    summary = classes.select("node", "size").join(partners, "node", "left").join(joined, "node", "left").select(
        "node", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    members = base.select("vec_id", "node").join(summary, "node", "left")
    least = members.filter("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    return members.join(least, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _named(parts: list[pa.Table], block: int, pass_no: int) -> pa.Table:
    """Full windows get the block and pass that they lie in."""
    table = pa.concat_tables(parts) if parts else _OUT_SCHEMA.empty_table()
    full = table["kind"].to_numpy() == _FULL
    a, b = table["a"].to_numpy().copy(), table["b"].to_numpy().copy()
    a[full], b[full] = block, pass_no
    return pa.table({"kind": table["kind"], "a": pa.array(a), "b": pa.array(b)}, _OUT_SCHEMA)
