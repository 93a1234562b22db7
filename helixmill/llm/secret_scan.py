"""Secret scans: an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its text. The ledger is a Parquet folder with a row for each blob and
run: the rules with their versions that were scanned then, and the spans found, none or more. A run scans only pairs of
blob and rule version that the ledger lacks, each blob once however many paths and versions share it, appends them, and
joins the ledger's findings of the current rule versions back to all paths. Spans are code points, end exclusive.

Rules: a pattern, its leftmost non-overlapping matches, and the least length of a group; matches below it are dropped.
The first three are the base rules. Positions are running sums over the pieces between matches, taken in runs of RUN
matches, so the work grows with the number of matches and no Python is needed.

Defined cases: null text is the empty blob, without findings; null and repeated ids keep their rows (versions of a path);
a run that wrote a pair twice changes nothing; empty tables give empty results; extra columns are ignored, or kept by
redact().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, durable, exists, join_hot, n_bytes, shared_dir, sized


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, base=True),  # a maximal run either way
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
)
SPAN = "array<struct<s:bigint,ord:int,e:bigint,kind:string>>"
LEDGER = "blob binary, rules array<string>, spans array<struct<s:bigint,e:bigint,rule:string>>"
RUN = 256


def blob_id(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def _folded(items: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """struct(at, out) after folding items into at: bigint (from 0) and out: an array of kind, which step() lengthens.

    Items are taken in runs of RUN, whose results are flattened at the end, so no long array is copied for every item.
    """
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def run(state: Column, xs: Column) -> Column:
        one = F.aggregate(xs, F.struct(state["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        # transform() binds the run's result once
        return F.transform(F.array(one), lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))[0]

    return F.aggregate(runs, start, run, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))


def spans_of(text: Column, rule: Rule) -> Column:
    """array of struct(s, e, rule): the spans of one rule in a text, in order."""
    kind = "array<struct<s:bigint,e:bigint,rule:string>>"
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), part.alias("p"))
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["b"]).cast("long").alias("b"), F.length(x["w"]).cast("long").alias("w"), (F.length(x["p"]) >= rule.least).alias("good")))

    def step(state: Column, x: Column) -> Column:
        s = state["at"] + x["b"]
        span = F.struct(s.alias("s"), (s + x["w"]).alias("e"), F.lit(rule.name).alias("rule"))
        return F.struct((s + x["w"]).alias("at"), F.when(x["good"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    found = F.transform(F.array(sizes), lambda x: _folded(x, step, kind)["out"])[0]
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(kind))


def _pending(names: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, id, rules) of the blobs of names (id, blob) that the ledger lacks a rule version for: one of their ids, and
    what is missing."""
    every = F.array(*[F.lit(r.name) for r in rules])
    blobs = names.groupBy("blob").agg(F.min(F.struct("id")).alias("first"))
    spark = names.sparkSession
    if not exists(spark, ledger):
        return blobs.select("blob", "first.id", every.alias("rules"))
    seen = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules]))
    seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "first.id", missing.alias("rules")).where(F.size("rules") > 0)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with the texts of versions (id, text). Returns (id, blob) of all rows of versions."""
    spark = versions.sparkSession
    names = durable(versions.select("id", blob_id("text").alias("blob")), "blobs")
    pending = durable(_pending(names, ledger, rules), "pending")
    if not pending.limit(1).count():
        return names
    texts = versions.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_id("text"))
    if exists(spark, ledger):
        todo = sized(pending.withColumnsRenamed({"blob": "of", "id": "first"}))
        new = texts.join(todo, (F.col("blob") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")))
    else:  # all blobs are new: leave out further copies instead of asking for every text
        own = pending.select(F.col("blob").alias("of"), F.col("id").alias("first"))
        spare = names.join(own, (F.col("blob") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")), "left_anti").distinct()
        spare = durable(spare.withColumnsRenamed({"blob": "of", "id": "first"}), "copies")
        new = texts.join(sized(spare), (F.col("blob") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")), "left_anti")
        new = new.withColumn("rules", F.array(*[F.lit(r.name) for r in rules]))
    extra = F.rlike("text", F.lit("|".join(f"(?:{r.pattern})" for r in rules if not r.base) or "(?!)"))
    none = F.array().cast("array<struct<s:bigint,e:bigint,rule:string>>")
    found = [F.when(F.array_contains("rules", r.name) & (F.lit(True) if r.base else extra), spans_of(F.col("text"), r)).otherwise(none) for r in rules]
    rows = new.select("blob", "rules", F.concat(*found).alias("spans"))
    rows.write.option("compression", "zstd").mode("append").parquet(ledger)
    return names


def findings(names: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, n, spans): the ledger's findings of the current rule versions in the blobs of names, n: rows of names. Only
    blobs with findings; spans as SPAN, by start and then in the order of the rules."""
    known = names.sparkSession.read.schema(LEDGER).parquet(ledger)
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    some = known.where(F.size("spans") > 0).select("blob", "spans", F.explode(F.array_intersect("rules", F.array(*[F.lit(r.name) for r in rules]))).alias("rule"))
    at = order[F.col("rule")]
    own = F.transform(F.filter("spans", lambda x: x["rule"] == F.col("rule")), lambda x: F.struct(x["s"].alias("s"), at.alias("ord"), x["e"].alias("e"), F.element_at(kinds, at + 1).alias("kind")))
    # a pair that was written twice counts once
    each = some.select("blob", "rule", own.cast(SPAN).alias("spans")).where(F.size("spans") > 0).groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
    some = each.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    n = names.groupBy("blob").agg(F.count("*").alias("n"))
    return durable(some.join(n, "blob").select(F.col("blob").alias("of"), "n", "spans"), "findings")


def of_all(rows: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """rows (with blob) with the spans of their blob, empty where it has none."""
    none = F.array().cast(SPAN)
    if n_bytes(found) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), F.col("blob") == F.col("of"), "left").drop("of", "n").withColumn("spans", F.coalesce("spans", none))
    every = names.groupBy("blob").agg(F.count("*").alias("m")).join(found, F.col("blob") == F.col("of"), "left")
    every = durable(every.select(F.col("blob").alias("of"), F.col("m").alias("n"), F.coalesce("spans", none).alias("spans")), "findings")
    return join_hot(rows, every, "blob", "of", "n", names.count()).drop("of", "n")


def new_ledger(docs: DataFrame) -> str:
    return f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex[:12]}"


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, base_sha256, spans. ledger: the folder of an earlier run's
    ledger or of a new one; without it one is begun in the shared folder."""
    ledger = ledger or new_ledger(docs)
    names = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ledger, rules)
    rows = of_all(names, findings(names, ledger, rules), names) if exists(docs.sparkSession, ledger) else names.withColumn("spans", F.array().cast(SPAN))
    base = [k for k, r in enumerate(rules) if r.base]
    many = lambda k: F.size(F.filter("spans", lambda x: x["ord"] == k)).cast("long")
    counts = [many(k).alias(f"n_{rules[k].kind}") for k in base]
    digest = F.sha2(listed(F.filter("spans", lambda x: x["ord"].isin(base))), 256).alias("base_sha256")
    return rows.select(F.col("id").alias(id_col), *counts, digest, listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """docs with every span in text replaced by the mark, overlapping spans by one; n_chars follows where there is one."""
    ledger = ledger or new_ledger(docs)
    names = scan(docs.select(F.col("doc_id").alias("id"), "text"), ledger, rules)
    if not exists(docs.sparkSession, ledger):
        return docs
    columns = [F.col(c).alias(f"__{c}") for c in docs.columns]
    rows = of_all(docs.select(*columns, blob_id("text").alias("blob")), findings(names, ledger, rules), names)
    text, kind = F.col("__text"), "array<struct<s:bigint,e:bigint>>"

    def keep(state: Column, x: Column) -> Column:  # spans come by start: the text between the furthest end so far and a start stays
        gap = F.struct(state["at"].alias("s"), x["s"].alias("e"))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.when(x["s"] >= state["at"], F.concat(state["out"], F.array(gap))).otherwise(state["out"]).alias("out"))

    rows = rows.withColumn("kept", F.when(F.size("spans") > 0, _folded(F.col("spans"), keep, kind)))
    cut = lambda t, at, g: F.substring(t, (g["s"] - at + 1).cast("int"), (g["e"] - g["s"]).cast("int"))

    def pieces_of(gaps: Column) -> Column:  # of one stretch of the text, so that finding a place doesn't start at its beginning
        at, to = gaps[0]["s"], F.element_at(gaps, -1)["e"]
        stretch = F.array(F.substring(text, (at + 1).cast("int"), (to - at).cast("int")))
        return F.transform(stretch, lambda t: F.transform(gaps, lambda g: cut(t, at, g)))[0]

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("kept.out") - 1) / RUN).cast("int")), lambda k: F.slice("kept.out", k * RUN + 1, F.lit(RUN)))
    pieces = F.flatten(F.transform(runs, pieces_of))
    tail = F.substring(text, (F.col("kept.at") + 1).cast("int"), F.length(text))
    rows = rows.withColumn("clean", F.when(F.col("kept").isNull(), text).otherwise(F.array_join(F.concat(pieces, F.array(tail)), mark)))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("kept").isNull(), F.col("__n_chars")).otherwise(F.length("clean")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"__{c}").alias(c))
    return rows.select(*out)


#: As above for the base rules and the rules added to them, in the oracle's dialect.
def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_key, {k} AS ord, '{r.kind}' AS kind, w, p,
         CAST(SUM(length(b) + length(w)) OVER (PARTITION BY doc_key ORDER BY n) AS BIGINT) AS e
  FROM (SELECT doc_key, UNNEST(string_split_regex(t, '{p}')) AS b, UNNEST(list_append(regexp_extract_all(t, '{p}', 0), NULL)) AS w,
               UNNEST(list_append(regexp_extract_all(t, '{p}', {r.group}), NULL)) AS p, generate_subscripts(string_split_regex(t, '{p}'), 1) AS n
        FROM d WHERE regexp_matches(t, '{p}'))""")
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    base = [k for k, r in enumerate(rules) if r.base]
    counts = ", ".join(f"COUNT(kind) FILTER (WHERE ord = {k}) AS n_{rules[k].kind}" for k in base)
    one = "kind || ':' || CAST(e - length(w) AS VARCHAR) || ':' || CAST(e AS VARCHAR)"
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, ROW_NUMBER() OVER () AS doc_key FROM documents),
f AS ({" UNION ALL ".join(parts)}),
h AS (SELECT * FROM f WHERE w IS NOT NULL AND length(p) >= CASE ord {least} END)
SELECT d.doc_id, {counts},
       sha256(COALESCE(string_agg({one}, ',' ORDER BY e - length(w), ord) FILTER (WHERE ord <= {max(base)}), '')) AS base_sha256,
       COALESCE(string_agg({one}, ',' ORDER BY e - length(w), ord), '') AS spans
FROM d LEFT JOIN h ON d.doc_key = h.doc_key GROUP BY d.doc_key, d.doc_id
"""
