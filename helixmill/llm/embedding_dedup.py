"""Embedding near-dedup: epsilon grid order join.

Vectors of unit length with cosine >= c lie within epsilon = sqrt(2 - 2c). They are sorted by their grid cells of side
epsilon on the leading principal dimensions, cut into sequence intervals, and the intervals are joined recursively: a
pair is skipped with all below it if the boxes of its leading coordinates are further apart than epsilon. Intervals that
remain are compared by the cosine in double precision of all components.

Exact copies are one point with a count, so a vector that fills the table costs no more than a rare one; pairs are never
expanded: an interval pair gives each point's number of links and a spanning forest. The principal axes come from a
bounded sample (AXES_ROWS rows); they steer the pruning and never the result.

Defined cases: only equal, non-null labels are compared, and vectors of equal length; vectors that are null, empty, zero
or hold null or non-finite components, and rows without id, link with nothing (n_links 0, their own component); rows
that repeat an id are separate vectors of one name, equal or not, and link like any others. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import digest_sample, durable, join_hot, small_batches, usable
from ._links import close_pairs, compare_pairs, components, cut_blocks, local_roots, number_blocks

AXES = 8
AXES_ROWS = 4096
BLOCK_BYTES = 64 * 1024
MARGIN = 1e-9  # closer to the threshold than this, the cosine is recomputed from the original components


def principal_axes(points: DataFrame, vector: str) -> np.ndarray:
    """Leading principal axes (as rows) of the unit vectors, from the AXES_ROWS rows of smallest digest."""
    rows = digest_sample(points.select(vector), F.xxhash64(vector), AXES_ROWS, vector).collect()
    if not rows:
        return np.zeros((1, 1))
    width = max(len(r[0]) for r in rows)
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x[k, : len(r[0])] = r[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x -= x.mean(0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES].T.copy()


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def links(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    epsilon = math.sqrt(2 - 2 * least)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    part = F.coalesce(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    points = rows.where(part).groupBy("label", "v").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    points = points.withColumn("grp", F.xxhash64("label", F.size("v"))).withColumn("point", F.monotonically_increasing_id())
    points = durable(points, "points")  # a number for each distinct (label, vector), whatever its rows' ids
    axes = principal_axes(points, "v")
    n_axes, double = len(axes), points.schema["v"].dataType.simpleString() == "array<double>"
    real = "<f8" if double else "<f4"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column("v"), batch.num_rows
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            owner, place = np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            unit = flat / np.sqrt(np.bincount(owner, flat * flat, n))[owner]
            at = place < axes.shape[1]
            c = [np.bincount(owner[at], unit[at] * a[place[at]], n) for a in axes]
            raw = column.flatten().to_numpy(zero_copy_only=False).astype(real)
            cut = np.cumsum(size)[:-1]
            packed = [x.tobytes() for x in np.split(raw, cut)]
            cells = [np.floor(x / epsilon).astype(np.int32) for x in c]
            columns = [batch.column("grp"), batch.column("point"), batch.column("copies"), pa.array(packed, pa.binary())]
            names = ["grp", "point", "copies", "raw"]
            for k in range(n_axes):
                columns += [pa.array(c[k]), pa.array(cells[k])]
                names += [f"c{k}", f"g{k}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    box = [f"c{k}" for k in range(n_axes)]
    schema = "grp long, point long, copies long, raw binary" + "".join(f", c{k} double, g{k} int" for k in range(n_axes))
    order = ["grp", *[f"g{k}" for k in range(n_axes)], "point"]
    cells = points.select("grp", "point", "copies", "v").mapInArrow(project, schema)
    sequence = cells.repartitionByRange(*order).sortWithinPartitions(*order)
    width = axes.shape[1] * (8 if double else 4)
    block_rows = max(16, min(1024, BLOCK_BYTES // max(1, width)))

    def pack(frame: pd.DataFrame) -> dict:
        out = {f"{end}_{c}": float(getattr(frame[c], f)()) for c in box for end, f in (("lo", "min"), ("hi", "max"))}
        return out | {"ids": frame["point"].to_numpy().astype("<i8").tobytes(), "copies": frame["copies"].to_numpy().astype("<i8").tobytes(), "raw": b"".join(frame["raw"])}

    fields = "grp long, pid int, seq long, n int" + "".join(f", lo_{c} double, hi_{c} double" for c in box) + ", ids binary, copies binary, raw binary"
    blocks = durable(number_blocks(durable(sequence.mapInPandas(lambda it: cut_blocks(it, block_rows, pack), fields), "intervals")), "intervals")

    def near(x, y) -> Column:
        gap = lambda c: F.greatest(F.lit(0.0), x(f"lo_{c}") - y(f"hi_{c}"), y(f"lo_{c}") - x(f"hi_{c}"))
        return sum((gap(c) * gap(c) for c in box), F.lit(0.0)) <= (epsilon + 1e-6) ** 2

    def compare(row) -> pd.DataFrame | None:
        def read(ids, copies, raw):
            ids = np.frombuffer(ids, "<i8")
            x = np.frombuffer(raw, real).reshape(len(ids), -1).astype(np.float64)
            return ids, np.frombuffer(copies, "<i8"), x, x / np.linalg.norm(x, axis=1, keepdims=True)

        a, na, xa, ua = read(row.x_ids, row.x_copies, row.x_raw)
        b, nb, xb, ub = (a, na, xa, ua) if row.same else read(row.y_ids, row.y_copies, row.y_raw)
        cosine = ua @ ub.T
        hit = cosine >= least
        for i, j in zip(*np.nonzero(np.abs(cosine - least) < MARGIN)):
            hit[i, j] = exact_cosine(xa[i], xb[j]) >= least
        if row.same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return None
        i, j = np.nonzero(hit)
        if row.same:
            ids, count = a, hit @ na
        else:
            ids, count, j = np.concatenate([a, b]), np.concatenate([hit @ nb, na @ hit]), j + len(a)
        some = np.flatnonzero(count)
        return pd.DataFrame({"u": ids[some], "v": ids[local_roots(i, j, len(ids))[some]], "n": count[some]})

    found = compare_pairs(close_pairs(blocks, box, near), blocks, ["ids", "copies", "raw"], compare, "u long, v long, n long")
    found = durable(found, "links")
    groups = durable(components(found.select("u", "v")), "groups")
    named = groups.join(points.select("point", "first_id"), F.col("node") == F.col("point"))
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count("*").alias("members"))
    least = durable(least.withColumnRenamed("root", "of"), "least")
    groups = join_hot(groups, least, "root", "of", "members", groups.count()).select("node", "least_id")
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    known = points.join(counts, F.col("point") == F.col("u"), "left").join(groups, F.col("point") == F.col("node"), "left")
    key = F.struct(F.col("label").alias("l"), F.col("v").alias("v"))
    known = known.select(key.alias("of"), "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least_id", "first_id").cast("long").alias("component_id"))
    keyed = rows.where(part).select("id", key.alias("key"))
    used = join_hot(keyed, durable(known, "known"), "key", "of", "copies", keyed.count())
    own = rows.where(~part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    out = used.select("id", "n_links", "component_id").union(own)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE rows AS (SELECT vec_id, label, embedding, ROW_NUMBER() OVER () AS k FROM embeddings),
ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, k FROM rows
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.k AS u, b.k AS w, b.vec_id AS id FROM ok a JOIN ok b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98),
r(u, w, id) AS (SELECT u, w, id FROM p UNION SELECT r.u, p.w, p.id FROM r JOIN p ON r.w = p.u),
c AS (SELECT u, MIN(id) AS least FROM r GROUP BY u),
n AS (SELECT u, COUNT(*) AS n FROM p GROUP BY u)
SELECT e.vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, CAST(LEAST(e.vec_id, COALESCE(c.least, e.vec_id)) AS BIGINT) AS component_id,
       e.vec_id = LEAST(e.vec_id, COALESCE(c.least, e.vec_id)) AS kept
FROM rows e LEFT JOIN n ON e.k = n.u LEFT JOIN c ON e.k = c.u
"""
