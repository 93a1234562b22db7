"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by a digest of the id), served as often as the cap allows.
Documents travel in packets of at most PACKET words. A packet's virtual finish time is its source's cumulative words up to
its end, divided by the source's target. All packets are range-sorted by finish time, and the sequence is truncated where
its words reach the total budget. The packets in service there are cut again to single words, which are sorted and
truncated alike, so sources end within a word or two of their targets. A document gives its words before the cut.

Targets: sources in code-point order (null last) get the weights in turn; the budget is shared by weight, no target
exceeds `cap` times its source's size, and the excess is reshared among the others until none is above.

The sorts are by range, with ties broken down to the row, so neither a source nor a repeated id meets in one task; what is
summed per task has a row for each task and source. The cut is one word, and each document's share of it follows in place.

Defined cases: null text has size 0 and gives nothing; rows that repeat an id are separate rows, in the order of size and
text; an empty table gives an empty mix; extra columns are ignored, or kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, durable, forget, join_hot, sized

PACKET = 256


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(idx, source, source_size, target) of (source, source_size). Only sums over all sources reach the driver."""
    ordered = durable(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    pid = F.shiftright("at", 33)
    per = ordered.groupBy(pid.alias("pid")).agg(F.count("*").alias("k"))  # a row per partition
    first = per.select("pid", (F.sum("k").over(Window.orderBy("pid")) - F.col("k")).alias("first"))
    place = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.withColumn("pid", pid).join(F.broadcast(first), "pid").select("source", "source_size", place.alias("idx"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = durable(ranked.withColumn("weight", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    most, rate, state = cap * F.col("source_size"), 0.0, None
    while True:  # the rate only rises, so a source that is capped stays so
        above = F.col("weight") * rate > most
        now = tuple(ranked.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first())
        if now == state or not now[1]:
            break
        state, rate = now, (share * total - (now[0] or 0.0)) / now[1]
    return ranked.select("idx", "source", "source_size", F.least(F.col("weight") * F.lit(rate), most).alias("target"))


def _numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows range-sorted by order, as a durable table with pid: the place of the row's task in the order."""
    return durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()), name)


def _queue(base: DataFrame, goals: DataFrame) -> DataFrame:
    """base (id, source, key, size) with idx, source_size, target and before: words of its source in front of the row."""
    n_sources = base.groupBy("source").agg(F.count("*").alias("n_rows"))
    named = durable(goals.join(n_sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("idx", F.struct("source").alias("of"), "source_size", "target", "n_rows"), "sources")
    rows = join_hot(base.withColumn("name", F.struct("source")), named, "name", "of", "n_rows", base.count()).drop("name", "of", "n_rows")
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    order = ["idx", "digest", "size", "key", "rid"]
    rows = _numbered(rows.withColumn("digest", digest), order, "queues")
    sums = rows.groupBy("idx", "pid").agg(F.sum("size").alias("words"))  # a row for each task and source
    first = sums.select("idx", "pid", (F.sum("words").over(Window.partitionBy("idx").orderBy("pid")) - F.col("words")).alias("first"))
    inside = Window.partitionBy("idx", "pid").orderBy("digest", "size", "key", "rid").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("own", F.sum("size").over(inside) - F.col("size"))
    queue = own.join(sized(durable(first, "offsets")), ["idx", "pid"]).withColumn("before", F.col("first") + F.col("own"))
    queue = durable(queue.select("id", "source", "key", "size", "idx", "source_size", "target", "before", "digest"), "queue")
    forget(rows, named)
    return queue


def _rounds(cap: float) -> range:
    return range(max(1, -int(-cap // 1)))


def _packets(served: int) -> Column:
    """The packets of a row in one round, as an array of struct(finish, words): size and before as in _queue()."""
    n = F.ceil(F.col("size") / F.lit(PACKET)).cast("int")
    before = F.col("before") + served * F.col("source_size")

    def packet(k: Column) -> Column:
        end = F.least(F.col("size"), (k + 1) * PACKET)
        return F.struct(((before + end) / F.col("target")).alias("finish"), (end - k * PACKET).alias("words"))

    return F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), packet)


def _reached(time: float | Column, target: str = "target") -> Column:
    """Words of a source that are served by the virtual time: the largest n with n / target <= time."""
    t, time = F.col(target), F.lit(time) if isinstance(time, float) else time
    n = F.floor(time * t).cast("long")
    return F.when((n + 1) / t <= time, n + 1).when(n / t > time, n - 1).otherwise(n)


def _cut(queue: DataFrame, goals: DataFrame, budget: int, cap: float) -> tuple[float, int] | None:
    """(finish, idx) of the word at which the global order reaches the budget; None if there are fewer words.

    No two words have both the finish time and the source in common, so these give the order.
    """
    live = queue.where((F.col("size") > 0) & (F.col("target") > 0))
    # a source needs another round only if its target is beyond what the rounds before it give
    each = [live.where(F.col("target") > r * F.col("source_size")).select("idx", F.inline(_packets(r))) for r in _rounds(cap)]
    packets = each[0]
    for more in each[1:]:
        packets = packets.union(more)
    packets = _numbered(packets, ["finish", "idx"], "packets")
    sums = packets.groupBy("pid").agg(F.sum("words").alias("words"))  # a row for each task
    run = F.sum("words").over(Window.orderBy("pid"))
    last = sums.withColumn("run", run).where(F.col("run") >= budget).orderBy("pid").limit(1).collect()
    if not last or budget < 1:
        forget(packets)
        return None if not last else (float("-inf"), 0)
    room = budget - (last[0]["run"] - last[0]["words"])
    before = F.sum("words").over(Window.orderBy("finish", "idx")) - F.col("words")
    at = packets.where(F.col("pid") == last[0]["pid"]).withColumn("before", before).where(F.col("before") < room)
    high = float(at.agg(F.max("finish")).first()[0])
    forget(packets)
    # words served by a time, from the sources alone; the cut lies between the last time tried that is too early, and high
    few = goals.where((F.col("source_size") > 0) & (F.col("target") > 0))
    top = lambda time: F.least(_reached(time), len(_rounds(cap)) * F.col("source_size"))
    step = PACKET * few.count() / budget
    times = [max(0.0, high - step * 8.0**k) for k in range(12)] + [0.0]
    served = few.agg(*[F.sum(top(t)) for t in times]).first()
    low, done = next((t, n) for t, n in zip(times, served) if n < budget)
    words = few.where(top(high) > top(low)).select("idx", "target", F.explode(F.sequence(top(low) + 1, top(high))).alias("c"))
    words = words.select((F.col("c") / F.col("target")).alias("finish"), "idx")
    found = words.orderBy("finish", "idx").limit(budget - done).agg(F.max(F.struct("finish", "idx")).alias("m")).first().m
    return found.finish, found.idx


def _given(served: int, cut: tuple[float, int] | None) -> Column:
    """Words that a row gives in one round: those in front of the cut, and the one at it."""
    left = F.least("size", F.greatest(F.lit(0), _share(cut) - F.col("before") - served * F.col("source_size")))
    some = (F.col("size") > 0) & (F.col("target") > served * F.col("source_size"))
    return F.when(some, left).otherwise(F.lit(0)).cast("long")


def _share(cut: tuple[float, int] | None) -> Column:
    """Words of the row's source in front of the cut."""
    if cut is None:
        return F.ceil("target")
    n = _reached(cut[0])
    return F.when((n / F.col("target") == F.lit(cut[0])) & (F.col("idx") > cut[1]), n - 1).otherwise(n)


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: id, source, key (digest of the text), size, idx, source_size, target, before, digest, and
    given: the words it gives in each round."""
    key = F.xxhash64(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), n_words(text_col).alias("size"))
    base = durable(base.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    goals = durable(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    queue = _queue(base, goals)
    total = queue.agg(F.sum("size")).first()[0] or 0
    cut = _cut(queue, goals, int(share * total), cap) if total else None
    return queue.withColumn("given", F.array(*[_given(r, cut) for r in _rounds(cap)]))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, taken, finish.

    taken: words the mix takes, repeats counted. finish: virtual time at which its first round ends, null if nothing is taken.
    """
    rows = plan(docs, id_col, **options)
    taken = F.aggregate("given", F.lit(0).cast("long"), lambda s, x: s + x)
    finish = F.when(F.col("given")[0] > 0, (F.col("before") + F.col("given")[0]) / F.col("target"))
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), finish.alias("finish"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them, with the columns of docs.

    Whole documents only: one of which the cut leaves less than half is not taken; a blank one is taken once, if it stands in
    front of a document that is. In a queue these are the rows in front of some place, one place a round; so the plan comes back as one row for each source (its last row
    taken in every round) and not as a row for each document. Rows equal in id, source and text are taken alike. The order
    is that of the expected virtual time: the round, and the place of the digest in the queue.
    """
    rows = plan(docs, **options)
    place = F.struct("digest", "size", "key")
    takes = lambda r: (F.col("size") > 0) & (2 * F.col("given")[r] >= F.col("size"))
    rounds = len(_rounds(options.get("cap", 2.0)))
    ends = [F.max(F.when(takes(r), place)).alias(f"end{r}") for r in range(rounds)]
    last = rows.groupBy("source", "source_size", "target").agg(*ends, F.count("*").alias("__n"))
    last = durable(last.select(F.struct("source").alias("__of"), *[f"end{r}" for r in range(rounds)], F.try_divide("source_size", "target").alias("__pace"), "__n"), "mix-plan")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = docs.withColumn("__source", F.struct("source")).withColumn("__place", F.struct(digest.alias("digest"), n_words("text").alias("size"), F.xxhash64("text").alias("key")))
    total = last.agg(F.sum("__n")).first()[0] or 0
    both = join_hot(own, last, "__source", "__of", "__n", total)
    served = F.array(*[F.when((F.col("__place.size") > 0) | F.lit(r == 0), F.col("__place") <= F.col(f"end{r}")) for r in range(rounds)])
    both = both.withColumn("__served", served)
    some = F.filter(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.coalesce(F.get(F.col("__served"), r), F.lit(False)))
    at = F.conv(F.substring("__place.digest", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    both = both.withColumn("__at", at * F.coalesce("__pace", F.lit(1.0))).withColumn("__round", F.explode(some))
    return both.orderBy(F.col("__round") * F.coalesce("__pace", F.lit(1.0)) + F.col("__at"), "doc_id").select(*docs.columns)


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (
  SELECT source, source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS idx, SUM(source_size) OVER () AS total FROM g),
x AS (SELECT *, (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[CAST(idx % 3 + 1 AS INT)] AS w FROM r),
k AS (
  SELECT *, 2.0 * source_size / w AS ratio,
         COALESCE(SUM(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
         SUM(w) OVER (ORDER BY 2.0 * source_size / w DESC, source DESC NULLS FIRST) AS rest
  FROM x),
rate AS (SELECT COALESCE(arg_min((CAST(1.5 AS DOUBLE) * total - capped) / rest, capped), 0.0) AS rate FROM k WHERE (CAST(1.5 AS DOUBLE) * total - capped) / rest <= ratio),
t AS (SELECT source, idx, total, source_size, LEAST(w * rate, CAST(2.0 * source_size AS DOUBLE)) AS target FROM k, rate),
o AS (
  SELECT s.doc_id, s.size, t.idx, t.source_size, t.target, t.total, ROW_NUMBER() OVER () AS k,
         CAST(SUM(size) OVER (PARTITION BY t.idx ORDER BY md5(CAST(doc_id AS VARCHAR)), size, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS b
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT k, idx, target, total, UNNEST(range(b + r * source_size + 1, b + r * source_size + size + 1)) AS c
  FROM o, (SELECT UNNEST([0, 1]) AS r) WHERE size > 0 AND target > r * source_size),
f AS (SELECT k, total, ROW_NUMBER() OVER (ORDER BY CAST(c AS DOUBLE) / target, idx) AS place FROM e),
n AS (SELECT k, COUNT(*) AS taken FROM f WHERE place <= FLOOR(CAST(1.5 AS DOUBLE) * total) GROUP BY k)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(COALESCE(n.taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN n ON o.k = n.k
"""
