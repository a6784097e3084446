"""Tables as key-value items: one partition key a run and path, a sort key a grain, a header for constants."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = "#model"
#: The decimal exponents that the store keeps.
EXPONENTS = (-130, 125)


def sort_key(*fields: str) -> Column:
    """Alternating field#value parts."""
    parts = [p for f in fields for p in (F.lit(f), F.col(f).cast("string"))]
    return F.concat_ws("#", *parts)


def constants(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The value of each column that has one value only, NULL included."""
    row = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(c) for c in columns], *[F.any_value(c).alias(f"_v_{c}") for c in columns]).first()
    return {c: row[f"_v_{c}"] for c in columns if row[c] == 1}


#: An attribute's store type (S text, N exact decimal number, BOOL) and its text.
ATTRIBUTE = "struct<type:string,value:string>"


def attribute(column: str, kind: T.DataType) -> Column:
    """A column's typed attribute; NULL stays NULL.  Numbers are written as the shortest decimal that reads back as they are."""
    x = F.col(column)
    if isinstance(kind, T.BooleanType):
        name, text = "BOOL", x.cast("string")
    elif isinstance(kind, (T.NumericType,)):
        # Plain integers lose a fraction of zero, as exact decimals do.
        name, text = "N", F.regexp_replace(x.cast("string"), r"\.0$", "")
    elif isinstance(kind, T.StringType):
        name, text = "S", x
    else:
        raise TypeError(f"{column}: {kind.simpleString()} has no stored form")
    return F.when(x.isNotNull(), F.struct(F.lit(name).alias("type"), text.alias("value")).cast(ATTRIBUTE))


def refused(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """By floating column, its values that the store cannot hold: not finite, or beyond its exponents."""
    floating = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return {}
    low, high = 10.0 ** EXPONENTS[0], 10.0 ** (EXPONENTS[1] + 1)
    bad = lambda c: F.isnan(c) | (F.abs(c) >= high) | ((F.abs(c) < low) & (F.col(c) != 0))
    row = df.agg(*[F.count_if(bad(c)).alias(c) for c in floating]).first()
    return {c: row[c] for c in floating if row[c]}


def items(df: DataFrame, pk: str, grain: list[str], lift: bool = True, artifact: str = "rows") -> DataFrame:
    """(pk, sk, attrs): one item a row, and a header with the lifted constants and the number of rows.

    Grain values must be non-empty and hold no #; keys must be unique; numbers must be such as the store holds;
    NULL attributes are left out.  Attributes carry their store type.
    """
    bad = F.lit(False)
    for g in grain:
        value = F.col(g).cast("string")
        bad = bad | value.isNull() | (value == "") | value.contains("#")
    checks = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if checks["bad"]:
        raise ValueError(f"{checks['bad']} rows have a grain value that is empty or holds #")
    if found := refused(df, df.columns):
        raise ValueError(f"values that cannot be stored: {found}")
    keyed = df.withColumn("sk", sort_key(*grain))
    if not keyed.groupBy("sk").count().where("count > 1").isEmpty():
        raise ValueError(f"{grain} do not identify a row")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rest = [c for c in df.columns if c not in grain]
    lifted = constants(df, rest) if lift and checks["n"] > 1 else {}
    own = [*grain, *[c for c in rest if c not in lifted]]

    def attributes(columns: list[str], values: list[Column]) -> Column:
        made = F.map_from_arrays(F.array(*map(F.lit, columns)).cast("array<string>"), F.array(*values).cast(f"array<{ATTRIBUTE}>"))
        return F.map_filter(made, lambda k, v: v.isNotNull()).alias("attrs")

    rows = keyed.select(F.lit(pk).alias("pk"), "sk", attributes(own, [attribute(c, kinds[c]) for c in own]))
    # The header's constants are read off any row, so they are typed as in the rows.
    number = F.struct(F.lit("N").alias("type"), F.lit(str(checks["n"])).alias("value"))
    name = F.struct(F.lit("S").alias("type"), F.lit(artifact).alias("value"))
    held = df.limit(1).select(*lifted) if lifted else df.sparkSession.range(1)
    header = held.select(F.lit(pk).alias("pk"), F.lit(HEADER).alias("sk"), attributes([*lifted, "artifact", "artifact_rows"], [*[attribute(c, kinds[c]) for c in lifted], name, number]))
    return rows.unionByName(header) if lifted or checks["n"] else rows.unionByName(df.sparkSession.range(1).select(F.lit(pk).alias("pk"), F.lit(HEADER).alias("sk"), attributes(["artifact", "artifact_rows"], [name, number])))


def as_item(row) -> dict:
    """A row of ``items`` as the store's Python values: text, exact decimals, booleans."""
    read = {"S": lambda v: v, "N": Decimal, "BOOL": lambda v: v == "true"}
    return {"pk": row["pk"], "sk": row["sk"], **{k: to_store(read[a["type"]](a["value"])) for k, a in row["attrs"].items()}}


def to_store(value):
    """A Python value at the store's type boundary: booleans before integers, exact decimals for floats, no NaN."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return Decimal(value)
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            raise ValueError(f"{value} cannot be stored")
        value = Decimal(str(value))
    if isinstance(value, Decimal):
        if value and not EXPONENTS[0] <= value.adjusted() <= EXPONENTS[1]:
            raise ValueError(f"{value} is out of range")
        return value
    raise TypeError(f"{type(value).__name__} has no stored form")


def orphans(held: DataFrame, written: DataFrame, keys: list[str] = ("pk", "sk")) -> DataFrame:
    """Items of the partitions written that the rerun no longer has."""
    parts = written.select("pk").distinct()
    return held.join(parts, "pk", "left_semi").join(written.select(*keys), list(keys), "left_anti")


def publish(rows: DataFrame, put: Callable[[Iterable[dict]], None]) -> None:
    """Hands each partition's items, as ``as_item`` makes them, to ``put`` (a batch writer made on the executor)."""
    rows.foreachPartition(lambda part: put(map(as_item, part)))


def sweep(held: DataFrame, written: DataFrame, delete: Callable[[Iterable[tuple]], None]) -> int:
    """Hands the keys of orphans to ``delete`` by partition; returns how many there are.  Written items are never among them."""
    gone = orphans(held, written).select("pk", "sk").distinct()
    n = gone.count()
    if n:
        gone.foreachPartition(lambda part: delete((r["pk"], r["sk"]) for r in part))
    return n
