"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_texts, stored
from .components import components

THRESHOLD = 0.98
#: Vectors of a tile's side, rows compared at a time, and pairs verified at a time.
TILE, ROWS, PAIRS = 2_048, 256, 65_536
#: Leading dimensions after which the bound is looked at.
STEPS = (8, 16, 32, 64, 128, 256, 512)
SLACK = 1e-9
FOUND = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, which keeps squares finite."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def rotations(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, principal axes of all unit vectors, the widest first.

    Tasks add up their own products; a sum has as many rows as a vector has components,
    and only the sums come to the driver.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            d = b.column(0).to_numpy()
            for n in np.unique(d).tolist():
                x = unit(matrix(b.column(1).filter(pa.array(d == n))))
                sums[n] = sums.get(n, 0) + x.T @ x
        for n, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], ["d", "i", "x"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.array(rows.column("x").to_pylist()).sum(0)
        return pa.table({"d": rows.column("d")[:1], "i": rows.column("i")[:1], "x": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "d int, i int, x array<double>"
    summed = map_texts(distinct.select("d", "v"), partial, schema).groupBy("d", "i").applyInArrow(add, schema)
    parts: dict[int, dict[int, list]] = {}
    for r in summed.collect():
        parts.setdefault(r.d, {})[r.i] = r.x
    out = {}
    for d, rows in parts.items():
        _, axes = np.linalg.eigh(np.array([rows[i] for i in range(d)]))
        out[d] = axes[:, ::-1].copy()
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float,
                same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold between rows of a and b (r < c if they are the same).

    ra, rb: unit rows on the principal axes. Products of leading axes are summed up; what the
    others can add is at most the product of the suffix norms. Pairs that cannot reach the
    threshold are dropped; those left are decided by the cosine of the vectors as given.
    """
    d = ra.shape[1]
    stops = [s for s in STEPS if s < d] + [d]
    tail_a, tail_b = (
        {s: np.sqrt(np.maximum((x[:, s:]**2).sum(1), 0)) for s in stops} for x in (ra, rb)
    )
    na, nb = (np.sqrt((x**2).sum(1)) for x in (a, b))
    for top in range(0, len(ra), ROWS):
        rows = ra[top:top + ROWS]
        s = stops[0]
        products = rows[:, :s] @ rb[:, :s].T
        possible = products + tail_a[s][top:top + ROWS, None] * tail_b[s][None, :] >= threshold - SLACK
        if same:
            possible &= np.arange(top, top + len(rows))[:, None] < np.arange(len(rb))[None, :]
        r, c = np.nonzero(possible)
        for k in range(0, len(r), PAIRS):
            i, j = r[k:k + PAIRS] + top, c[k:k + PAIRS]
            have = products[i - top, j]
            for begin, end in zip(stops, stops[1:]):
                have = have + np.einsum("ij,ij->i", ra[i, begin:end], rb[j, begin:end])
                fit = have + tail_a[end][i] * tail_b[end][j] >= threshold - SLACK
                i, j, have = i[fit], j[fit], have[fit]
            exact = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j]) >= threshold
            if exact.any():
                yield i[exact], j[exact]


def tile_links(nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, left: np.ndarray, axes: np.ndarray,
               threshold: float, same: bool) -> tuple[list, list, list]:
    """Rows (node, other, links) of a tile: links counted per node, and edges that connect them."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    turned = unit(vectors) @ axes
    rows = np.flatnonzero(left)
    cols = rows if same else np.flatnonzero(~left)
    counts = np.zeros(len(nodes), np.int64)
    label = np.arange(len(nodes))
    for i, j in close_pairs(scaled[rows], scaled[cols], turned[rows], turned[cols], threshold, same):
        i, j = rows[i], cols[j]
        np.add.at(counts, i, weights[j])
        np.add.at(counts, j, weights[i])
        while True:
            li, lj = label[i], label[j]
            if (li == lj).all():
                break
            low = np.minimum(li, lj)
            np.minimum.at(label, li, low)
            np.minimum.at(label, lj, low)
            while (label[label] != label).any():
                label = label[label]
    linked, moved = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(label)))
    return (
        [*nodes[linked].tolist(), *nodes[moved].tolist()],
        [*[None] * len(linked), *nodes[label[moved]].tolist()],
        [*counts[linked].tolist(), *[0] * len(moved)],
    )


def tiles(distinct: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Every vector once for each tile it belongs to.

    Unit vectors that reach the threshold differ by at most `reach` along the first axis, so they
    lie in the same cell of that width or in neighbouring ones. A cell is dealt into slices of
    about TILE vectors; a tile is a pair of slices of one cell, or of a cell and the next.
    """
    reach = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    schema = pa.schema([("label", pa.int64()), ("d", pa.int32()), ("node", pa.int64()), ("w", pa.int64()),
                        ("v", pa.list_(pa.float64())), ("cell", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            d = b.column(1).to_numpy()
            for n in np.unique(d).tolist():
                x = unit(matrix(b.column(4).filter(pa.array(d == n))))
                cell[d == n] = np.floor((x @ axes[n][:, 0] + 1) / reach).astype(np.int64)
            yield batch(schema, *b.columns, cell)

    placed = stored(
        map_texts(distinct.select("label", "d", "node", "w", "v"), place, "label long, d int, node long, w long, v array<double>, cell int"),
        "embedding-cells",
    )
    key = ["label", "d", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / TILE).alias("k"))
    below = sizes.select("label", "d", (F.col("cell") + 1).cast("int").alias("cell"), F.col("k").alias("k_below"))
    above = sizes.select("label", "d", (F.col("cell") - 1).cast("int").alias("cell"), F.col("k").alias("k_above"))
    sizes = sizes.join(below, key, "left").join(above, key, "left").na.fill(0, ["k_below", "k_above"])
    rows = placed.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node"), "k"))

    def count(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    def tile(cross: int, cell, i, j, left):
        return F.struct(F.lit(cross).alias("cross"), cell.alias("at"), i.alias("i"), j.alias("j"), left.alias("left"))

    own, cell = F.col("own"), F.col("cell")
    meets = F.concat(
        F.transform(count("k"), lambda o: tile(0, cell, F.least(own, o), F.greatest(own, o), own <= o)),
        F.transform(count("k_above"), lambda o: tile(1, cell, own, o, F.lit(True))),
        F.transform(count("k_below"), lambda o: tile(1, (cell - 1).cast("int"), o, own, F.lit(False))),
    )
    return rows.select("label", "d", F.explode(meets).alias("t"), "node", "w", "v").select("label", "d", "t.*", "node", "w", "v")


def links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, other, links: counted links (other is null) and edges of the same components."""
    axes = rotations(distinct)

    def compare(rows: pa.Table) -> pa.Table:
        same = rows.column("cross")[0].as_py() == 0 and rows.column("i")[0] == rows.column("j")[0]
        out = tile_links(
            rows.column("node").to_numpy(), rows.column("w").to_numpy(), matrix(rows.column("v")),
            rows.column("left").to_numpy(), axes[rows.column("d")[0].as_py()], threshold, same,
        )
        return pa.table([pa.array(c, f.type) for c, f in zip(out, FOUND)], schema=FOUND)

    spread = tiles(distinct, axes, threshold).groupBy("label", "d", "cross", "at", "i", "j")
    return stored(spread.applyInArrow(compare, "node long, other long, links long"), "embedding-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label and length are linked from cosine `threshold` on, in double precision.
    Equal vectors of a label are compared as one, with a number of its own, that counts for all. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without label or id, are linked with nothing
    and stand alone (component_id is their own id). Repeated ids are vectors of their own. No rows give
    no rows. Other columns are not looked at.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"),
    )
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = stored(rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v"))), "embeddings")
    distinct = stored(
        rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
        .withColumns({"node": F.monotonically_increasing_id(), "d": F.size("v")}), "embedding-distinct",
    )
    found = links(distinct, threshold)
    counted = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    heads = classes.join(distinct.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("head"))
    classes = classes.join(heads, "component").select("node", "head")
    judged = distinct.join(counted, "node", "left").join(classes, "node", "left").select(
        "label", "v", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("head", "least").alias("c"),
    )
    return rows.join(judged, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("c", "vec_id")).alias("kept"),
    )
