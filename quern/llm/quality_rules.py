"""Quality rules: base statistics of every text, and robust multivariate outliers by language and source.

Only DataFrame and SQL functions run here.  Each text's statistics are made in one pass (array functions
over its words and lines; windows of five words are compared by 64-bit hashes, and only texts that hold
a repeated window sort them).  Four transformed statistics (smoothed mean word length, and the roots of
the smoothed rates of symbols, repeated lines and repeated words) form a vector.

For each language and source a minimum-covariance-determinant estimate is found.  Three starts stand on medians and
median deviations: uncorrelated, with the correlations of squashed scores, and with those of spatial signs.  A
concentration step takes the share ``COVERED`` of rows nearest by Mahalanobis distance and gives their mean and
covariance.  After ``TRIAL`` steps of every start the one with the least determinant goes on until its determinant stands
still.  To each variance the group's mean counting noise is added (what a rate over so many words varies by
itself), which keeps it regular where nothing varies.  The result is shrunk towards the pooled one with the weight of
``SHRINK`` rows, so groups of any size are judged alike, and a row is rejected if its squared distance is one that
fewer than ``LEVEL`` rows of a clean group of this size would reach, by the chi-square distribution.  All estimates are
grouped aggregates, so a hot source is combined before it moves; a group's estimate is one row, joined as a table of
known size.

Defined cases: null text counts as empty: all statistics 0, base_failed true.  Null language or source is
a group of its own; in a group without a row that passes the base rules the pooled estimate holds.
Repeated rows are judged alike; ties at the edge of a concentration step are all in; extra columns are ignored,
whatever their names; a text of any length is read whole, in one task's memory; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Share of rows in a concentration step; steps of every start; most steps of the best one; change of a log determinant that is none.
COVERED, TRIAL, MOST_STEPS, STILL = 0.75, 2, 20, 1e-3
#: Rows' worth of the pooled estimate in each group's; clean rows of a group that may be rejected.
SHRINK, LEVEL = 60, 1e-6
#: COVERED over the chi-square (6 degrees) mass below the COVERED quantile for 4 degrees.
CONSISTENCY = 1.485
#: Ranks of sketched quantiles are off by at most one in so many.
ACCURACY = 10_000
VECTOR = ("x0", "x1", "x2", "x3")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame's columns and the five statistics of ``text_col`` (a column of a statistic's name gives way)."""
    others = [c for c in docs.columns if c != text_col and c not in STATISTICS]
    # The frame's columns travel as one, so that none of them meets a name used here.
    docs = docs.select(F.struct(*[F.col(c) for c in others], F.lit(0).alias("_none")).alias("_row"), F.col(text_col))
    kept = [F.col("_row")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    step = docs.select(*kept, text.alias("text"))
    step = step.select(*kept, F.filter(F.split("text", _SPACE), lambda w: w != "").alias("words"), lines.alias("lines"), F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    # Each of these is read more than once above itself, so the optimizer keeps it as a column.
    step = step.select(
        *kept, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("h") - 5), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)]))
    step = step.select(*kept, *STATISTICS[:4], F.when(F.size("h") >= 5, window).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    step = step.select(*kept, *STATISTICS[:4], F.when(some, placed).alias("placed"))
    twice = lambda j: (F.get("placed", j - 1)["v"] == F.get("placed", j)["v"]) | (F.get("placed", j + 1)["v"] == F.get("placed", j)["v"])
    found = F.transform(F.filter(F.sequence(F.lit(0), F.size("placed") - 1), lambda j: F.coalesce(twice(j), F.lit(False))), lambda j: F.get("placed", j)["i"])
    step = step.select(*kept, *STATISTICS[:4], F.when(F.col("placed").isNotNull(), F.sort_array(found)).alias("at"))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate("at", start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(5), p - a["last"])).alias("total")), lambda a: a["total"])
    return step.select(*[F.col("_row")[c].alias(c) for c in others], *STATISTICS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> list[Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        ((chars + F.lit(100.0)) / (words + F.lit(20.0))).alias("x0"),
        F.sqrt(F.col("n_symbols") / (chars + F.lit(50.0))).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_dup_lines") + F.lit(5.0) + words / F.lit(10.0))).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / (words + F.lit(20.0))).alias("x3"),
    ]


def noise() -> list[Column]:
    """What each statistic of a text varies by counting alone: the variance of a mean or of a rate's root over so many words."""
    words, chars = F.col("n_words"), F.col("word_chars")
    length = (chars + F.lit(100.0)) / (words + F.lit(20.0))
    return [
        (length * length / (words + F.lit(20.0))).alias("v0"),
        (F.lit(0.25) / (chars + F.lit(50.0))).alias("v1"),
        (F.lit(0.25) / (F.col("n_dup_lines") + F.lit(5.0) + words / F.lit(10.0))).alias("v2"),
        # Repeated words come by windows of five.
        (F.lit(1.25) / (words + F.lit(20.0))).alias("v3"),
    ]


P = len(VECTOR)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MEANS, _COVARIANCES, _FLOORS = [f"m{i}" for i in range(P)], [f"c{i}{j}" for i, j in _PAIRS], [f"f{i}" for i in range(P)]
_FACTORS = [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def _joined(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with their group's estimates, a table whose size is known: broadcast if it is small, without moving the rows."""
    known = common.shared_table(estimates.withColumnRenamed("group", "of"), "estimates")
    return rows.join(known, rows.group == known.of).drop("of")


def _cholesky(estimates: DataFrame) -> DataFrame:
    """Adds the lower factor l<i><j> of each covariance c<i><j>, and the log determinant."""
    out = estimates
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"c{j}{i}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # Rounding alone can bring a pivot to 0: no variance is below its floor's thousandth.
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.col(f"f{i}") / 1000)) if i == j else value / F.col(f"l{j}{j}"))
    total = F.log(F.col("l00"))
    for i in range(1, P):
        total = total + F.log(F.col(f"l{i}{i}"))
    return out.withColumn("logdet", 2 * total)


def _distance() -> Column:
    """The squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(VECTOR):
        value = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * z[j]
        z.append(value / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _concentrate(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """One concentration step of every (group, start) in ``factors``."""
    keys = ["group", "start"]
    near = _joined(rows, factors.select(*keys, *_MEANS, *_FACTORS, *_FLOORS, "n")).withColumn("d", _distance())
    limits = near.groupBy(*keys).agg(F.percentile_approx("d", COVERED, ACCURACY).alias("limit"))
    edges = common.shared_table(factors.join(limits, keys).select(F.col("group").alias("of"), "start", "limit", *_MEANS, *_FACTORS, *_FLOORS, "n"), "edges")
    inner = rows.join(edges, rows.group == edges.of).drop("of").withColumn("d", _distance()).where("d <= limit")
    scaled = [(F.covar_pop(VECTOR[i], VECTOR[j]) * CONSISTENCY + (F.first(f"f{i}") if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i, j in _PAIRS]
    made = inner.groupBy(*keys).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(VECTOR)], *scaled, *[F.first(f).alias(f) for f in _FLOORS], F.first("n").alias("n"))
    return common.shared_table(_cholesky(made), "factors")


def _starts(rows: DataFrame) -> DataFrame:
    """Every group's three starts: (group, start, means, covariances, floors, n) with their factors."""
    half = lambda c: F.percentile_approx(c, 0.5, ACCURACY)
    middles = rows.groupBy("group").agg(*[half(x).alias(f"m{i}") for i, x in enumerate(VECTOR)])
    spread = _joined(rows, middles).groupBy("group").agg(
        *[F.first(m).alias(m) for m in _MEANS], *[(half(F.abs(F.col(x) - F.col(f"m{i}"))) * 1.4826).alias(f"s{i}") for i, x in enumerate(VECTOR)],
        *[F.avg(f"v{i}").alias(f"f{i}") for i in range(P)], F.count(F.lit(1)).alias("n"),
    )
    spread = spread.withColumns({f"s{i}": F.sqrt(F.col(f"s{i}") ** 2 + F.col(f"f{i}")) for i in range(P)})
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(VECTOR)]
    length = F.greatest(z[0] * z[0] + z[1] * z[1] + z[2] * z[2] + z[3] * z[3], F.lit(1e-18))
    scored = _joined(rows, spread).select("group", *[F.tanh(v).alias(f"t{i}") for i, v in enumerate(z)], *[(v / F.sqrt(length)).alias(f"u{i}") for i, v in enumerate(z)])
    squashed = [F.covar_pop(f"t{i}", f"t{j}").alias(f"q{i}{j}") for i, j in _PAIRS]
    signs = [F.avg(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"g{i}{j}") for i, j in _PAIRS]
    both = spread.join(scored.groupBy("group").agg(*squashed, *signs), "group")

    def start(number: int, letter: str | None) -> DataFrame:
        def covariance(i: int, j: int) -> Column:
            if i == j:
                return F.col(f"s{i}") ** 2
            if letter is None:
                return F.lit(0.0)
            # Correlations a tenth nearer to none, so that every start is regular.
            of = F.sqrt(F.col(f"{letter}{i}{i}") * F.col(f"{letter}{j}{j}"))
            return F.when(of > 1e-12, 0.9 * F.col(f"{letter}{i}{j}") / of).otherwise(0.0) * F.col(f"s{i}") * F.col(f"s{j}")

        return both.select("group", F.lit(number).alias("start"), *_MEANS, *[covariance(i, j).alias(f"c{i}{j}") for i, j in _PAIRS], *_FLOORS, "n")

    return common.shared_table(_cholesky(start(0, None).union(start(1, "q")).union(start(2, "g"))), "starts")


def estimates_of(rows: DataFrame) -> DataFrame:
    """Per ``group``: n, mean and covariance of the minimum-covariance-determinant estimate of ``VECTOR``, with the floors."""
    rows = rows.select("group", *VECTOR, *[f"v{i}" for i in range(P)])
    factors = _starts(rows)
    for _ in range(TRIAL):
        factors = _concentrate(rows, factors)
    best = factors.groupBy("group").agg(F.min(F.struct("logdet", "start")).alias("best")).select("group", F.col("best.start").alias("start"))
    factors = factors.join(best, ["group", "start"])
    for _ in range(MOST_STEPS):
        before = factors.select(F.col("group").alias("of"), F.col("logdet").alias("was"))
        factors = _concentrate(rows, factors)
        moved = factors.join(before, F.col("group") == F.col("of")).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if moved is None or moved < STILL:
            break
    return factors.select("group", "n", *_MEANS, *_COVARIANCES, *_FLOORS)


def _shrunk(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """Every group's estimate, drawn towards the pooled one (within and between groups) by ``SHRINK`` rows' weight."""
    n = F.col("n").cast("double")
    total = F.sum(n)
    pooled = estimates.agg(
        *[(F.sum(n * F.col(m)) / total).alias(m) for m in _MEANS], *[(F.sum(n * F.col(f)) / total).alias(f) for f in _FLOORS],
        *[(F.sum(n * (F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}"))) / total).alias(f"c{i}{j}") for i, j in _PAIRS],
    ).first()
    # Without a row that passes the base rules nothing is judged.
    value = lambda c: F.lit(pooled[c]).cast("double")
    own = estimates.withColumnRenamed("group", "of")
    every = groups.join(own, groups.group == own.of, "left").drop("of").withColumn("n", F.coalesce("n", F.lit(0)))
    mixed = lambda c, whole: (F.coalesce(F.col(c), F.lit(0.0)) * F.col("n") + whole * F.lit(SHRINK)) / (F.col("n") + F.lit(SHRINK))
    between = {f"c{i}{j}": mixed(f"c{i}{j}", value(f"c{i}{j}") - value(f"m{i}") * value(f"m{j}")) for i, j in _PAIRS}
    return _cholesky(every.withColumns(between | {m: mixed(m, value(m)) for m in _MEANS} | {f: mixed(f, value(f)) for f in _FLOORS}))


def cutoff(n: Column) -> Column:
    """The chi-square value (4 degrees) that ``LEVEL`` of ``n`` clean rows reach: exp(-x / 2) (1 + x / 2) = LEVEL / n, solved by iteration."""
    least = F.log(F.greatest(n, F.lit(1)) / F.lit(LEVEL))
    half = least
    for _ in range(12):
        half = least + F.log1p(half)
    return 2 * half


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the five statistics, base_failed, kept and the squared distance of every whole text."""
    common.prepare(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    group = F.xxhash64(F.coalesce("lang", F.lit("")), F.isnull("lang"), F.coalesce("source", F.lit("")), F.isnull("source"))
    made = statistics(read).select("doc_id", group.alias("group"), *STATISTICS, failed.alias("base_failed"), *vector(), *noise()).checkpoint()
    estimates = estimates_of(made.where("NOT base_failed"))
    judged = _shrunk(made.select("group").distinct(), estimates).select("group", F.col("n").alias("rows"), *_MEANS, *_FACTORS)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff(F.col("rows")))
    return _joined(made, judged).withColumn("distance", _distance()).select("doc_id", *STATISTICS, "base_failed", kept.alias("kept"), "distance")
