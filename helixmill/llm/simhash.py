"""SimHash near-dedup: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints of distinct value are sorted by their population counts (of the whole, then of its parts) and cut into
tiles. Two tiles are compared only if the population counts of no pair of parts prove them further apart than the
radius: |pop(x) - pop(y)| summed over disjoint parts never exceeds the number of differing bits.

Defined cases: null or blank text has no word and fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle; rows that repeat an id are separate rows of one document; a null id is ignored when the smallest
id of a group is sought, and a group of null ids alone has a null component. Extra columns are ignored, or kept by
keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable, join_hot, sized, small_batches
from ._links import close_pairs, compare_pairs, components, cut_blocks, local_roots, number_blocks

SEED = 42
TILE = 2048
ROWS = 128  # rows of a tile compared at once: a working set of 2 MB


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    h64 = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([h64(joined, SEED)], dtype="<u8")
    else:
        hashes = np.fromiter((h64(joined[a : b - 1], SEED) for a, b in zip(at, at[width:])), "<u8", len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 60_000):  # 16-bit sums can't overflow
        part = hashes[k : k + 60_000]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")
    return out.withColumnRenamed("id", id_col)


def _links(fps: DataFrame, radius: int) -> DataFrame:
    """Spanning edges (u, v) of the links between distinct fingerprints."""
    small_batches(fps.sparkSession)
    byte = [F.bit_count(F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))) for k in range(8)]
    half = [byte[2 * k] + byte[2 * k + 1] for k in range(4)]
    total = half[0] + half[1] + half[2] + half[3]
    parts = {"t": total, "q0": half[0], "r0": total - half[0], "q1": half[1], "q2": half[2], "q3": half[3]}
    parts |= {f"p{k}": byte[k] for k in range(8)}
    rows = fps.select(F.lit(0).cast("long").alias("grp"), "fp", *[c.cast("int").alias(k) for k, c in parts.items()])
    order = ["t", "q0", "q1", "q2", "p0", "p2", "p4", "fp"]

    names = list(parts)

    def pack(frame: pd.DataFrame) -> dict:
        box = {f"{end}_{c}": int(getattr(frame[c], f)()) for c in names for end, f in (("lo", "min"), ("hi", "max"))}
        return box | {"fps": frame["fp"].to_numpy().astype("<i8").tobytes()}

    schema = "grp long, pid int, seq long, n int, " + ", ".join(f"lo_{c} int, hi_{c} int" for c in parts) + ", fps binary"
    sequence = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = durable(number_blocks(durable(sequence.mapInPandas(lambda it: cut_blocks(it, TILE, pack), schema), "tiles")), "tiles")

    def near(x, y) -> Column:
        gap = lambda c: F.greatest(F.lit(0), x(f"lo_{c}") - y(f"hi_{c}"), y(f"lo_{c}") - x(f"hi_{c}"))
        splits = (["t"], ["q0", "r0"], ["q0", "q1", "q2", "q3"], [f"p{k}" for k in range(8)])
        tests = [sum((gap(c) for c in cols[1:]), gap(cols[0])) <= radius for cols in splits]
        return tests[0] & tests[1] & tests[2] & tests[3]

    def compare(row) -> pd.DataFrame | None:
        x, y = np.frombuffer(row.x_fps, "<u8"), np.frombuffer(row.y_fps, "<u8")
        found = []
        for k in range(0, len(x), ROWS):
            hit = np.bitwise_count(x[k : k + ROWS, None] ^ y[None, :]) <= radius
            if hit.any():
                a, b = np.nonzero(hit)
                found.append(np.stack([a + k, b]))
        if not found:
            return None
        i, j = np.concatenate(found, axis=1)
        ids = np.concatenate([x, y])
        if row.same:
            up = i < j
            i, j, ids = i[up], j[up], x
        else:
            j = j + len(x)
        root = local_roots(i, j, len(ids))
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[leaf].view("<i8"), "v": ids[root[leaf]].view("<i8")})

    pairs = close_pairs(blocks, list(parts), near)
    return compare_pairs(pairs, blocks, ["fps"], compare, "u long, v long")


def _grouped(marked: DataFrame, first: Column, radius: int) -> DataFrame:
    """(fp, n, first, least) of marked rows with fp: the number of rows and the smallest `first` of each fingerprint, and of
    its group."""
    fps = durable(marked.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    groups = durable(components(_links(fps, radius)), "groups")
    named = groups.join(fps, F.col("node") == F.col("fp")).select("root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("members"))
    least = durable(least.withColumnRenamed("root", "of"), "least")
    known = join_hot(groups, least, "root", "of", "members", groups.count()).select("node", "least")
    out = fps.join(known, F.col("fp") == F.col("node"), "left")
    return durable(out.select("fp", "n", "first", F.coalesce("least", "first").alias("least")), "groups-of-fingerprints")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    marked = durable(fingerprints(docs, id_col, text_col, width), "fingerprints")
    of = _grouped(marked, F.col(id_col), radius).select(F.col("fp").alias("of"), "n", F.col("least").alias("component_id"))
    rows = join_hot(marked, of, "fp", "of", "n", marked.count())
    return rows.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """docs with one row of each group: that of the smallest id (null last), among rows of that id the smallest digest of
    the whole row. Rows equal in every column leave one. A row goes only if its own fingerprint's group keeps another."""
    columns = docs.columns
    row = F.xxhash64(*[F.col(c) for c in columns])
    marked = fingerprints(docs.select(F.struct(F.col(id_col).alias("id"), row.alias("row")).alias("name"), F.col(text_col).alias("text")), "name", "text", width)
    marked = durable(marked.select("name.id", "name.row", "fp"), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    of = _grouped(marked, rank, radius).select(F.col("fp").alias("of"), F.col("n").alias("m"), "least")
    named = join_hot(marked, of, "fp", "of", "m", marked.count())
    own = named.select("id", "row", (F.col("row") == F.col("least.row")) & F.col("id").eqNullSafe(F.col("least.id")))
    names = durable(own.toDF("id", "row", "stays").groupBy("id", "row").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "names")
    on = (F.col(id_col).eqNullSafe(F.col("__hm_id"))) & (F.col("__hm_key") == F.col("__hm_row"))
    slim = lambda some: names.where(some).select(F.col("id").alias("__hm_id"), F.col("row").alias("__hm_row"))
    keyed = docs.withColumn("__hm_key", row)
    out = keyed.join(sized(slim("not stays")), on, "left_anti")
    again = slim("stays and n > 1")
    if again.limit(1).count():
        one = keyed.join(sized(again), on, "left_semi").dropDuplicates([id_col, "__hm_key"])
        out = out.join(sized(again), on, "left_anti").unionByName(one)
    return out.select(*columns)
