"""CIGAR strings as columns: query bounds on the forward strand, reference length, aligned blocks and gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = r"(\d+)([A-Z=])"


def operations(cigar: Column) -> Column:
    """Array of struct(n, op)."""
    n, op = (F.regexp_extract_all(cigar, F.lit(OPS), F.lit(k)) for k in (1, 2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("op")))


def _total(ops: Column, *kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("long"), lambda s, x: s + x["n"])


def query_bounds(cigar: Column, strand: Column) -> Column:
    """struct(q_start, q_end, ref_len): clips before the first operation that consumes the query shift its start."""
    ops = operations(cigar)
    ops = F.when(strand == "-", F.reverse(ops)).otherwise(ops)
    consumes = F.transform(ops, lambda x: x["op"].isin("M", "I", "=", "X"))
    first = F.array_position(consumes, True)
    lead = F.when(first > 0, F.slice(ops, F.lit(1), (first - 1).cast("int"))).otherwise(ops)
    q_start, q_len = _total(lead, "S", "H"), _total(ops, "M", "I", "=", "X")
    return F.struct(q_start.alias("q_start"), (q_start + q_len).alias("q_end"), _total(ops, "M", "D", "N", "=", "X").alias("ref_len"))


def blocks(cigar: Column, start: Column) -> Column:
    """Aligned reference blocks, half-open: array of struct(s, e)."""
    init = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(F.lit(0))
        block = F.array(F.struct(state["at"].alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(x["op"].isin("M", "=", "X"), F.concat(state["out"], block)).otherwise(state["out"]).alias("out"))

    return F.aggregate(operations(cigar), init, step, lambda s: s["out"])


def large_gaps(cigar: Column, start: Column, least: int = 600) -> Column:
    """Gaps of more than `least` bases between consecutive blocks: array of struct(next_start, curr_end)."""
    b = blocks(cigar, start)
    pairs = F.zip_with(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), lambda x, y: F.struct(y["s"].alias("next_start"), x["e"].alias("curr_end")))
    return F.filter(pairs, lambda p: p["next_start"] - p["curr_end"] > least)


def to_plain_matches(cigar: Column) -> Column:
    """Runs of = and X fused into M."""
    init = F.array().cast("array<struct<n:bigint,op:string>>")

    def step(out: Column, x: Column) -> Column:
        op = F.when(x["op"].isin("=", "X", "M"), F.lit("M")).otherwise(x["op"])
        last = F.element_at(out, -1)
        fuse = (F.size(out) > 0) & (op == "M") & (F.when(F.size(out) > 0, last["op"]) == "M")
        more = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct((last["n"] + x["n"]).alias("n"), op.alias("op"))))
        return F.when(fuse, more).otherwise(F.concat(out, F.array(F.struct(x["n"].alias("n"), op.alias("op")))))

    return F.array_join(F.transform(F.aggregate(operations(cigar), init, step), lambda x: F.concat(x["n"].cast("string"), x["op"])), "")
