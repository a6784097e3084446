"""Cleaning, profiling and reconstruction of tables."""

from __future__ import annotations

from itertools import chain as flat

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Rows of a slice of a globally ordered table.
SLICE_ROWS = 500_000


def lookup(mapping: dict, key: str | Column) -> Column:
    """A literal map's value; a miss is NULL."""
    return F.create_map(*[F.lit(x) for x in flat.from_iterable(mapping.items())])[F.col(key) if isinstance(key, str) else key]


def modes(df: DataFrame, columns: list[str], unknown: str = UNKNOWN) -> dict[str, object]:
    """Each column's most frequent known value, ties to the smallest, in one pass over the data."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    counts = df.select(pairs).select("p.*").where(F.col("value").isNotNull() & (F.col("value") != unknown)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    rows = counts.withColumn("r", F.row_number().over(order)).where("r = 1").collect()
    return {r["column"]: r["value"] for r in rows}


def impute_modes(df: DataFrame, columns: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """Known modes in place of ``unknown``; all modes are taken before any column changes."""
    found = modes(df, columns, unknown)
    return df.withColumns({c: F.when(F.col(c) == unknown, F.lit(found[c])).otherwise(F.col(c)) for c in columns if c in found})


def sentinel_to_null(df: DataFrame, column: str, sentinel, flag: str) -> DataFrame:
    """The sentinel becomes NULL, and ``flag`` says (1) where a real value stood."""
    return df.withColumns({flag: F.when(F.col(column) != sentinel, 1).otherwise(0), column: F.when(F.col(column) == sentinel, None).otherwise(F.col(column))})


def deduplicate(df: DataFrame, keys: list[str], keep_by: list[Column]) -> DataFrame:
    """One row a key, the first by ``keep_by`` (a total order makes the survivor the same in every run)."""
    order = Window.partitionBy(*keys).orderBy(*keep_by)
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def by_duplicate_policy(df: DataFrame, keys: list[str], keep_by: list[Column], policy: str = "drop") -> DataFrame:
    """Repeated keys under a declared policy: ``drop`` all but the first, ``keep`` every row, or ``raise``."""
    if policy == "keep":
        return df
    if policy == "drop":
        return deduplicate(df, keys, keep_by)
    if policy != "raise":
        raise ValueError(f"{policy!r} is no policy for duplicates")
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} repeat")
    return df


def percentiles(df: DataFrame, columns: list[str], points: list[float], by: str | None = None, between: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles: ``by`` (if given) and for each column an array of its values at ``points`` (NULLs do not count).

    ``between`` interpolates linearly between neighbours; otherwise the smallest value is taken that at least
    the share of rows does not exceed.  A sketch brackets each point within 1 / ``accuracy`` of the ranks; rows in the brackets
    are counted by value, the others by the bracket before them, so no task holds a group's values and
    nothing comes to the driver.
    """
    reach = 2.0 / accuracy
    keys = [F.col(by)] if by else [F.lit(0).alias("_all")]
    key = by or "_all"

    def of(c: str, shift: float) -> Column:
        """The sketch's values at the points moved by ``shift``; beyond the ends there is no bound."""
        found = F.percentile_approx(F.col(c).cast("double"), [min(max(p + shift, 0.0), 1.0) for p in points], accuracy)
        ends = [-float("inf") if p + shift <= 0 else float("inf") if p + shift >= 1 else None for p in points]
        return F.array(*[F.get(found, k) if e is None else F.lit(e) for k, e in enumerate(ends)])

    made = df.groupBy(*keys).agg(*[x for c in columns for x in (F.count(c).alias(f"_n_{c}"), of(c, -reach).alias(f"_lo_{c}"), of(c, reach).alias(f"_hi_{c}"))])
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_n_{c}").alias("n"), F.col(f"_lo_{c}").alias("lo"), F.col(f"_hi_{c}").alias("hi")) for k, c in enumerate(columns)])).alias("b")
    brackets = made.select(F.col(key).alias("_g"), parts).select("_g", "b.*")
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)])).alias("v")
    rows = df.select(keys[0].alias("_of"), values).select("_of", "v.*").where(F.col("x").isNotNull())
    inside = F.exists(F.arrays_zip("lo", "hi"), lambda p: (F.col("x") >= p["lo"]) & (F.col("x") <= p["hi"]))
    below = F.array_max(F.filter("hi", lambda h: h < F.col("x")))
    near = rows.join(brackets, F.col("_of").eqNullSafe(F.col("_g")) & (F.col("_k") == F.col("k")))
    # Rows between brackets stand together after the bracket below them; the neighbours of a bracket are the ends of such a stretch.
    near = near.select("_g", "k", "n", "x", (~inside).alias("between"), F.when(inside, F.col("x")).otherwise(F.coalesce(below, F.lit(float("-inf")))).alias("place"))
    counted = near.groupBy("_g", "k", "n", "place", "between").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
    # A row a value inside the brackets: some 1 / 2,500 of a group's rows and point at most.
    upto = F.sum("c").over(Window.partitionBy("_g", "k").orderBy("place", "between"))
    placed = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))

    def at(rank: Column) -> Column:
        return F.max(F.when(rank == F.col("before"), F.col("least")).when((rank > F.col("before")) & (rank < F.col("upto")), F.col("most")))

    found = []
    for p in points:
        if between:
            place = F.lit(float(p)) * (F.col("n") - 1)
            low, share = F.floor(place), place - F.floor(place)
            found += [at(low), at(F.least(low + 1, F.col("n") - 1)), F.max(share)]
        else:
            found.append(at(F.greatest(F.ceil(F.lit(float(p)) * F.col("n")) - 1, F.lit(0))))
    picked = placed.groupBy("_g", "k").agg(*[f.alias(f"f{i}") for i, f in enumerate(found)])
    mixed = [(1 - F.col(f"f{i + 2}")) * F.col(f"f{i}") + F.col(f"f{i + 2}") * F.col(f"f{i + 1}") for i in range(0, len(found), 3)] if between else [F.col(f"f{i}") for i in range(len(found))]
    wide = picked.select("_g", "k", F.array(*mixed).alias("p")).groupBy("_g").pivot("k", list(range(len(columns)))).agg(F.first("p", ignorenulls=True))
    return wide.select(*([F.col("_g").alias(by)] if by else []), *[F.col(str(k)).alias(c) for k, c in enumerate(columns)])


def fences(df: DataFrame, column: str, reach: float = 1.5) -> tuple[float, float]:
    """Lower and upper interquartile fences; of no values, none (NaN)."""
    row = percentiles(df, [column], [0.25, 0.75], between=False).first()
    q1, q3 = row[0] if row is not None else (float("nan"), float("nan"))
    return q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)


def cap_at_fence(df: DataFrame, column: str, into: str) -> DataFrame:
    return df.withColumn(into, F.least(F.col(column), F.lit(fences(df, column)[1])))


def outliers(df: DataFrame, column: str) -> DataFrame:
    """One row: rows outside the interquartile fences, and beyond three deviations of the mean."""
    low, high = fences(df, column)
    moments = df.agg(F.avg(column).alias("m"), F.stddev(column).alias("s"))
    x = F.col(column)
    return df.join(moments).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((x < low) | (x > high)).alias("outside_fences"), F.count_if(F.abs(x - F.col("m")) > 3 * F.col("s")).alias("beyond_three_sigma"))


def null_profile(df: DataFrame) -> DataFrame:
    """One row a column with its nulls, from one pass."""
    names = df.columns
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in names])).alias("p")).select("p.*")


def distinct_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column with its number of distinct values."""
    counted = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in columns])).alias("p")).select("p.*")


def cast_failures(df: DataFrame, column: str, kind: str) -> DataFrame:
    """One row: values that the cast would lose."""
    x = F.col(column)
    return df.agg(F.count_if(x.isNotNull()).alias("given"), F.count_if(x.isNotNull() & x.try_cast(kind).isNull()).alias("lost"))


def normalise_text(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bins`` equal-width bins over the column's range, the last closed: bin (0-based) and rows; empty bins too."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))), F.lit(bins - 1))
    counted = df.where(F.col(column).isNotNull()).join(span).select(at.cast("bigint").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def sliced(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_slice``: ranges of ``order`` of some ``SLICE_ROWS`` rows each, in order, cut at its quantiles.

    The cuts are looked up by binary search; a million slices (5e11 rows) are 8 MB of cuts.
    """
    rows = df.count()
    n = max(1, -(-rows // SLICE_ROWS))
    cuts = sorted(set(df.approxQuantile(order, [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if not cuts:
        return df.withColumn("_slice", F.lit(0.0))
    splits = [-float("inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=order, outputCol="_slice").transform(df)


def _before() -> Window:
    """All slices before one: a window over the table of slices, a row each."""
    return Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def running_count(df: DataFrame, order: str, event: Column, into: str) -> DataFrame:
    """The number of ``event`` rows up to each row in the global order of ``order``, without one window over all rows.

    A slice's own running count and the total of the slices before it add up.
    """
    cut = sliced(df, order).withColumn("_event", F.when(event, 1).otherwise(0))
    before = cut.groupBy("_slice").agg(F.sum("_event").alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_before"))
    own = F.sum("_event").over(Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(F.broadcast(before), "_slice").withColumn(into, F.col("_own") + F.col("_before")).drop("_slice", "_event", "_own", "_before")


def previous(df: DataFrame, order: str, column: str, into: str) -> DataFrame:
    """The column's value in the row before, in the global order of ``order``, by slices as in ``running_count``."""
    cut = sliced(df, order)
    before = cut.groupBy("_slice").agg(F.max_by(column, order).alias("_last")).select("_slice", F.last("_last").over(_before()).alias("_carry"))
    slice_order = Window.partitionBy("_slice").orderBy(order)
    made = cut.withColumns({"_lag": F.lag(column).over(slice_order), "_first": F.row_number().over(slice_order) == 1}).join(F.broadcast(before), "_slice")
    return made.withColumn(into, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop("_slice", "_lag", "_first", "_carry")


def following(df: DataFrame, by: str, order: str, column: str, into: str) -> DataFrame:
    """The column's value in the next row of the same ``by`` in the order of ``order``, without one window over a whole group.

    A slice's last row of a group takes the group's first value of the next slice that has one.
    """
    cut = sliced(df, order)
    after = Window.partitionBy(by).orderBy("_slice")
    heads = cut.groupBy(by, "_slice").agg(F.min_by(column, order).alias("_head")).select(F.col(by).alias("_by"), F.col("_slice").alias("_at"), F.lead("_head").over(after).alias("_carry"))
    own = Window.partitionBy(by, "_slice").orderBy(order)
    made = cut.withColumns({"_next": F.lead(column).over(own), "_end": F.row_number().over(own) == F.count(F.lit(1)).over(Window.partitionBy(by, "_slice"))})
    # Groups times slices, a row each: left to Spark's own choice by size.
    joined = made.join(heads, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_at")), "left")
    return joined.withColumn(into, F.when(F.col("_end"), F.col("_carry")).otherwise(F.col("_next"))).drop("_slice", "_next", "_end", "_by", "_at", "_carry")


def mint_ids(df: DataFrame, order: str, into: str = "row_id") -> DataFrame:
    """Stable 1-based numbers in the order of a unique column."""
    return running_count(df, order, F.lit(True), into)


def rollovers(df: DataFrame, order: str, column: str, into: str) -> DataFrame:
    """How often ``column`` has gone backwards up to each row, in the order of ``order``."""
    lagged = previous(df, order, column, "_previous")
    return running_count(lagged, order, F.col(column) < F.col("_previous"), into).drop("_previous")


def join_small(df: DataFrame, small: DataFrame, on: str, most_rows: int = 100_000) -> DataFrame:
    """A left join that may not change the row count: the small side is checked for size and unique keys, then broadcast.

    A null key matches nothing, so rows of the small side without a key do not count.  ``unmatched`` counts what found no partner.
    """
    keyed = small.where(F.col(on).isNotNull())
    n, keys = keyed.agg(F.count(F.lit(1)), F.countDistinct(on)).first()
    if n != keys:
        raise ValueError(f"{on} is not unique: the join would change the row count")
    return df.join(F.broadcast(keyed) if n <= most_rows else keyed, on, "left")


def unmatched(df: DataFrame, small: DataFrame, on: str) -> int:
    """Rows of ``df`` whose key (a null one too) the small side does not have."""
    return df.join(small.where(F.col(on).isNotNull()).select(on).distinct(), on, "left_anti").count()


def rename(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """The mapped columns only, in its order: business name to source column or expression."""
    return df.select(*[(F.col(source) if isinstance(source, str) else source).alias(name) for name, source in mapping.items()])


def checked_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Flags as smallint, NULL kept; a fractional or other value than 0 and 1 raises."""
    bad = df.where(" OR ".join(f"{c} NOT IN (0, 1)" for c in columns)).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"one of {columns} holds a value that is no flag")
    return df.withColumns({c: F.col(c).cast("smallint") for c in columns})


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spark's summary (all statistics as strings) of the columns."""
    return df.select(*columns).summary()


def bucketize(df: DataFrame, column: str, splits: list[float], into: str) -> DataFrame:
    """The declared half-open interval of each value (the last closed)."""
    return Bucketizer(splits=splits, inputCol=column, outputCol=into).transform(df)
