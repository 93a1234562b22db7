"""URL filters: host and path rules, and for the rest a character language-model ratio, in DataFrame functions only.

Two smoothed variable-order Markov models (Witten-Bell interpolation over contexts of up to ORDER - 1 characters) are
fitted on all distinct URLs that rules accept and reject but a fifth, which is held out. A URL's score is the difference
of its log-likelihoods divided by its length; the threshold is the one of best balanced accuracy on all held-out URLs, in
the middle between two scores.

A string is scored through its substrings: one join gives for each (position, length) the log-probability of the
substring as a gram and the log back-off weight as a context. The probability at a position is that of its longest known
gram times the back-off weights of the longer known contexts. The table of grams
grows with the URLs, as far as their characters allow. Distinct strings are numbered, and only numbers and substrings
travel; work grows with the length of a string.

Defined cases: a null url, and one without `://`, have an empty host and path; the models judge what follows `://`, or
the whole url without it; an empty or null url that no rule fits is blocked; if either class has no URL to learn from,
what no rule decides is allowed. Rows are judged one by one, whatever their ids; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, join_hot, sized

ORDER = 4
STRETCH = 512
SCORES = 50_000  # distinct held-out scores a task of the threshold's running counts
ALPHABET = 256  # characters the lowest order shares its last mass among


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rest_of(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)"))


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict), or null."""
    host, path = F.col("host"), F.col("path")
    tests = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*tests, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, k, s): substrings s of length k up to ORDER that end at character `at` of column rest.

    A string is cut into stretches of STRETCH characters, each with the ORDER - 1 before it, so the work grows with its
    length and no row holds more than a stretch's substrings.
    """
    chars, back = F.split("rest", ""), ORDER - 1
    cut = lambda j: F.struct((j * STRETCH).alias("first"), F.slice("chars", F.greatest(F.lit(1), j * STRETCH + 1 - back), F.least(j * STRETCH, F.lit(back)) + STRETCH).alias("c"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("chars") - 1) / STRETCH).cast("int")), cut)
    part = rows.where("rest <> ''").select(*keep, chars.alias("chars")).select(*keep, F.explode(runs).alias("run")).select(*keep, "run.first", "run.c")
    lead = F.least("first", F.lit(back))  # characters of the stretch before

    def ending(i: Column) -> Column:  # the substrings that end at the i-th character of the run, from 1
        k = F.sequence(F.lit(1), F.least(F.lit(ORDER), i))
        return F.transform(k, lambda k: F.struct((F.col("first") - lead + i).alias("at"), k.alias("k"), F.concat(*[F.when(k > n, F.get("c", i - 1 - n)).otherwise("") for n in range(ORDER - 1, 0, -1)], F.get("c", i - 1)).alias("s")))

    each = F.flatten(F.transform(F.sequence(lead + 1, F.size("c")), ending))
    return part.select(*keep, F.inline(each))


def fit(rows: DataFrame) -> DataFrame:
    """(s, p0, p1, w0, w1) from (rest, y): log-probability of s as a gram and log back-off weight of s as a context, by class."""
    counts = durable(_grams(rows, "y").groupBy("y", "k", "s").agg(F.count("*").alias("n")), "grams")
    context = counts.groupBy("y", F.expr("substring(s, 1, k - 1)").alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    context = durable(context, "contexts")
    all_of = counts.join(context, (counts.y == context.y) & (F.expr("substring(s, 1, k - 1)") == context.h)).select(counts.y, "k", "s", "n", "total", "kinds")
    lower, levels = None, []
    for k in range(1, ORDER + 1):
        some = all_of.where(F.col("k") == k)
        if lower is None:
            some = some.withColumn("below", F.lit(1.0 / ALPHABET))
        else:
            some = some.join(lower.select(F.col("y").alias("y2"), F.col("s").alias("s2"), F.col("p").alias("below")), (F.col("y") == F.col("y2")) & (F.expr("substring(s, 2)") == F.col("s2")))
        lower = durable(some.select("y", "s", ((F.col("n") + F.col("kinds") * F.col("below")) / (F.col("total") + F.col("kinds"))).alias("p")), "gram-probabilities")
        levels.append(lower)
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.union(level)
    weight = context.select("y", F.col("h").alias("s"), F.log(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("w"))
    both = grams.select("y", "s", F.log("p").alias("p"), F.lit(None).cast("double").alias("w")).union(weight.select("y", "s", F.lit(None).cast("double"), "w"))
    of = lambda c, y: F.max(F.when(F.col("y") == y, F.col(c))).alias(f"{c}{y}")
    return durable(both.groupBy("s").agg(of("p", 0), of("p", 1), of("w", 0), of("w", 1)), "language-models")


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(sid, score) of strings (sid, rest), sid their number: mean over characters of log P(class 1) - log P(class 0)."""
    root = model.where("s = ''").select("w0", "w1").first()
    size = F.length("rest").alias("size")
    dealt = rows.where("rest <> ''").select("sid", "rest", size).repartition("sid")  # what follows groups within a string
    found = _grams(dealt, "sid", "size").join(sized(model), "s", "left")
    # as a gram the substring counts where it ends, as a context at the next character
    use = F.explode(F.array(F.struct(F.col("at").alias("pos"), F.lit(True).alias("gram")), F.struct((F.col("at") + 1).alias("pos"), F.lit(False).alias("gram"))))
    values = [f"{c}{y}" for c in "pw" for y in (0, 1)]
    each = found.select("sid", "size", "k", *values, use.alias("u")).where((F.col("u.gram") & (F.col("p0").isNotNull() | F.col("p1").isNotNull())) | (~F.col("u.gram") & (F.col("k") < ORDER) & (F.col("w0").isNotNull() | F.col("w1").isNotNull())) | (F.col("u.gram") & (F.col("k") == 1)))
    pick = [F.max(F.when((F.col("k") == k) & (F.col("u.gram") == (c == "p")), F.col(f"{c}{y}"))).alias(f"{c}{y}_{k}") for c in "pw" for y in (0, 1) for k in range(1, ORDER + (c == "p"))]
    at = each.groupBy("sid", F.col("u.pos").alias("pos")).agg(F.max("size").alias("size"), *pick).where("pos <= size")
    logs = []
    for y in (0, 1):
        zero, none = F.lit(0.0), F.lit(float(root[y]) if root and root[y] is not None else 0.0) - F.log(F.lit(float(ALPHABET)))
        cases, above = [], zero
        for k in range(ORDER, 0, -1):  # the longest known gram; above: weights of known contexts of length k and more
            cases.append(F.when(F.col(f"p{y}_{k}").isNotNull(), F.col(f"p{y}_{k}") + above))
            if k > 1:
                above = above + F.coalesce(F.col(f"w{y}_{k - 1}"), zero)
        logs.append(F.coalesce(*cases, none + above))
    mean = F.sum(F.round("d", 9).cast("decimal(30,9)")).cast("double") / F.max("size")
    return at.select("sid", "size", (logs[1] - logs[0]).alias("d")).groupBy("sid").agg(mean.alias("score"))


def threshold(known: DataFrame) -> float:
    """The score of best balanced accuracy over all of (score, y), in the middle between two scores; 0 without both classes.

    Running counts go over slices of the scores first and over the slices' sums after, so no task has all scores.
    """
    of = lambda y: F.sum((F.col("y") == y).cast("long")).alias(f"n{y}")
    at = durable(known.groupBy("score").agg(of(0), of(1)), "held-out")
    total = at.agg(F.count("*").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total.n0 or not total.n1:
        return 0.0
    slices = 1 + total.n // SCORES
    cuts = at.approxQuantile("score", [k / slices for k in range(1, slices)], 0.1 / slices) if slices > 1 else []
    own = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("score")))
    at = durable(at.withColumn("slice", own), "held-out-slices")
    w = Window.orderBy("slice")
    before = [F.coalesce(F.sum(f"n{y}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before{y}") for y in (0, 1)]
    sums = at.groupBy("slice").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("score").alias("low"))
    sums = durable(sums.select("slice", *before, F.lead("low").over(w).alias("beyond")), "slices")  # a row for each slice
    w = Window.partitionBy("slice").orderBy("score")
    below = [F.sum(f"n{y}").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"before{y}") for y in (0, 1)]
    middle = (F.col("score") + F.coalesce(F.lead("score").over(w), "beyond", "score")) / 2
    ends = at.join(sized(sums), "slice").select(middle.alias("score"), below[0].alias("b0"), below[1].alias("b1"))
    good = F.col("b0") / F.lit(total.n0) + 1 - F.col("b1") / F.lit(total.n1)
    return float(ends.select(F.max_by("score", F.struct(good, -F.abs("score"))).alias("t")).first().t)


def judge(pages: DataFrame, rules: tuple[UrlRule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, score (null where a rule decides)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", F.coalesce(rest_of("url"), "url", F.lit("")).alias("rest"), host_of("url").alias("host"), path_of("url").alias("path"))
    rows = durable(rows.withColumn("m", matching_rule(rules)).select("id", "rest", "host", "path", "m.rule", "m.verdict"), "urls")
    strings = rows.where("rest <> ''").groupBy("rest", F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "allow").cast("int")).alias("y")).agg(F.count("*").alias("n"))
    strings = durable(strings.withColumn("sid", F.monotonically_increasing_id()), "strings")  # a number for each distinct string
    known, open_ones = strings.where("y is not null"), strings.where("y is null")
    held = F.pmod(F.xxhash64(F.lit("held out"), "rest"), F.lit(5)) == 0
    of = known.groupBy("y").agg(F.count("*"), F.sum((~held).cast("int"))).collect()
    if len(of) == 2 and all(r[2] for r in of):
        model = fit(known.where(~held))
        limit = threshold(score(known.where(held), model).join(known.select("sid", "y"), "sid"))
        judged = open_ones.join(score(open_ones, model), "sid").withColumn("own", F.when(F.col("score") > limit, "allow").otherwise("block"))
    else:
        judged = open_ones.select("rest", "n", F.lit(None).cast("double").alias("score"), F.lit("allow").alias("own"))
    judged = durable(judged.select(F.col("rest").alias("of"), "n", "score", "own"), "judged")
    undecided = F.col("verdict").isNull() & (F.col("rest") != "")
    total = open_ones.agg(F.sum("n")).first()[0] or 0
    scored = join_hot(rows.where(undecided), judged, "rest", "of", "n", total)
    out = scored.select("id", "host", "path", "rule", F.col("own").alias("verdict"), "score")
    rest = rows.where(~undecided).select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("block")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)
