"""Incremental loading under an external watermark, and merges over Parquet tables.

The watermark is a string compared as text, as its store keeps it.  The data object is written before the
watermark moves.  Plain Parquet has no MERGE: a merge is the target without the source's keys, plus the
source, written beside the old table and swapped in.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_RUN_ID = re.compile(r"[A-Za-z0-9._-]{1,32}\Z")


def identifier(name: str) -> str:
    if not _IDENTIFIER.match(name):
        raise ValueError(f"{name!r} is no plain identifier")
    return name


def run_name(value: str) -> str:
    if not _RUN_ID.match(value):
        raise ValueError(f"{value!r} is no run id")
    return value


def extract_query(table: str, load_column: str | None, last: str | None, full_load: bool) -> str:
    """The SELECT of an extract: everything (a full load, or no watermark yet), or the rows after the watermark, newest first."""
    query = f"SELECT * FROM {identifier(table)}"
    if full_load:
        return query
    if load_column is None:
        raise ValueError("an incremental extract needs a load column")
    column = identifier(load_column)
    if last is None:
        return query
    escaped = last.replace("'", "''")
    return f"{query} WHERE {column} > '{escaped}' ORDER BY {column} DESC"


def extract(df: DataFrame, load_column: str | None, last: str | None, full_load: bool = False) -> DataFrame:
    """The same over a frame: rows whose load column, as text, is after the watermark."""
    if full_load:
        return df
    if load_column is None:
        raise ValueError("an incremental extract needs a load column")
    return df if last is None else df.where(F.col(load_column).cast("string") > F.lit(last))


def next_watermark(extracted: DataFrame, load_column: str, last: str | None) -> str | None:
    """The largest value as text; unchanged when nothing was extracted; never less than before."""
    found = extracted.agg(F.max(F.col(load_column).cast("string"))).first()[0]
    if found is None:
        return last
    if last is not None and found < last:
        raise ValueError(f"the watermark would go back from {last!r} to {found!r}")
    return found


def advance(first_value: str | None, values: list[str], last: str | None) -> str | None:
    """The guard of a newest-first extract: its first row must hold the largest text, or nothing moves."""
    if not values:
        return last
    if first_value != max(values):
        raise ValueError(f"the first row has {first_value!r}, but {max(values)!r} is the largest as text")
    return first_value


def guarded_watermark(extracted: DataFrame, load_column: str, last: str | None) -> str | None:
    """``next_watermark`` under ``advance``'s guard: the first row by the column's own order must hold the largest text.

    A number column whose values differ in length (9 and 10) fails here, before anything is written.
    """
    largest = next_watermark(extracted, load_column, last)
    first = extracted.where(F.col(load_column).isNotNull()).orderBy(F.desc(load_column)).select(F.col(load_column).cast("string")).first()
    return last if first is None else advance(first[0], [largest], last)


@dataclass
class StateStore:
    """Load states as a JSON list of table_name, load_column, last_extracted_value; rewritten as a whole."""

    path: str

    def read(self) -> list[dict]:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def get(self, table: str) -> dict:
        for row in self.read():
            if row["table_name"] == table:
                return row
        raise KeyError(f"no load state for {table}")

    def set(self, table: str, value: str | None) -> None:
        rows = self.read()
        if not any(r["table_name"] == table for r in rows):
            raise KeyError(f"no load state for {table}")
        for r in rows:
            if r["table_name"] == table:
                r["last_extracted_value"] = value
        folder = os.path.dirname(os.path.abspath(self.path))
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
            json.dump(rows, f, indent=2)
        os.replace(f.name, self.path)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"the source repeats a key of {keys}")


def merge(target: DataFrame, source: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Upsert: matched keys take the source's row, others stay, new ones come.  A repeated source key raises."""
    if check:
        assert_unique(source, keys)
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def replace_run(target: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """The run's rows and no others under its id (delete, then insert)."""
    return target.where(F.col("run_id") != run_name(run_id)).unionByName(rows.select(*target.columns))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; if a swap was cut off between its two renames, the table it had moved aside, put back first."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs = at.getFileSystem(hadoop)
    if not fs.exists(at) and fs.exists(old) and not fs.rename(old, at):
        raise OSError(f"{old} could not be moved back to {path}")
    return spark.read.parquet(path)


def swap_in(df: DataFrame, path: str) -> None:
    """Writes beside the table at ``path`` and renames twice.

    Nothing is lost at any point: until the new table is in place the old one stands at ``path`` or, between the
    renames, at ``path``.old, from where ``current`` puts it back.  A reader that does not go through ``current`` may meet the gap
    between the renames.
    """
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new", f"{path}.old"
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(hadoop)
    for p in (new, old):
        fs.delete(to(p), True)
    df.write.parquet(new)
    if fs.exists(to(path)) and not fs.rename(to(path), to(old)):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(to(new), to(path)):
        fs.rename(to(old), to(path))
        raise OSError(f"{new} could not be moved to {path}")
    fs.delete(to(old), True)


def merge_into(spark: SparkSession, path: str, source: DataFrame, keys: list[str]) -> None:
    """Merge into a Parquet table: checked first, then swapped in whole (for tables without partitions, such as dimensions)."""
    assert_unique(source, keys)
    swap_in(merge(current(spark, path), source, keys, check=False), path)


def merge_partitions(spark: SparkSession, path: str, source: DataFrame, keys: list[str], partition: str) -> None:
    """Merge into a Parquet table partitioned by one of ``keys``: only the partitions that the source touches are read and replaced.

    The touched values are few (a source is one extract's waves), so they become literals that prune the scan.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must be a key: else a row could leave its partition")
    assert_unique(source, keys)
    touched = [r[0] for r in source.select(partition).distinct().collect()]
    if not touched:
        return
    names = [*[c for c in source.columns if c != partition], partition]
    rows = source.select(*names)
    if exists(spark, path):
        rows = merge(spark.read.parquet(path).where(F.col(partition).isin(touched)).select(*names), rows, keys, check=False)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(hadoop).exists(at))


def upsert_through_stage(df: DataFrame, path: str, keys: list[str]) -> int:
    """Rows by key into the table at ``path`` through a ``tmp_`` table beside it; returns the rows staged.

    The stage is written and counted before the table is touched, and dropped at the end, whatever happens: a
    fault before the swap leaves the table as it was.
    """
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, _, name = path.rstrip("/").rpartition("/")
    stage = f"{folder}/tmp_{name}"
    at = jvm.org.apache.hadoop.fs.Path(stage)
    wanted = df.count()
    try:
        df.write.mode("overwrite").parquet(stage)
        staged = spark.read.parquet(stage)
        if staged.count() != wanted:
            raise ValueError(f"{stage} has {staged.count()} rows, not {wanted}: nothing was merged")
        if exists(spark, path):
            merge_into(spark, path, staged, keys)
        else:
            assert_unique(staged, keys)
            staged.write.parquet(path)
    finally:
        at.getFileSystem(hadoop).delete(at, True)
    return wanted


def seed(rows: DataFrame, path: str, expected: int, check: dict[str, int] | None = None) -> None:
    """Writes declared rows once; checks on every call that the table has ``expected`` rows and, in ``check``, so many by each expression."""
    spark = rows.sparkSession
    if not exists(spark, path):
        rows.write.parquet(path)
    found = spark.read.parquet(path)
    row = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(e)).alias(f"c{k}") for k, e in enumerate(check or {})]).first()
    wanted = (expected, *(check or {}).values())
    if tuple(row) != wanted:
        raise ValueError(f"{path} holds {tuple(row)} rows by check, not {wanted}: it was seeded in part")


def offenders(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The ``n`` keys that repeat most, with their rows: what a refused merge reports."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(n)


def replace_run_into(rows: DataFrame, path: str) -> None:
    """Rows with a run_id column into a table partitioned by it; only the runs among them are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def newest_window(spine: DataFrame, loaded: DataFrame, column: str) -> DataFrame:
    """Spine rows from the newest loaded value on: the newest is merged again, which its key makes harmless.

    The one value is read first and stands as a literal, so the spine's scan is filtered and pruned by it.
    """
    newest = loaded.agg(F.max(column)).first()[0]
    return spine if newest is None else spine.where(F.col(column) >= F.lit(newest))


def stage_waves(df: DataFrame, wave: str, folder: str) -> dict[int, int]:
    """The table by wave below ``folder`` (``wave=1`` and so on), as the source's loads come; the rows of each."""
    df.write.mode("overwrite").partitionBy(wave).parquet(folder)
    return {r[wave]: r["count"] for r in df.sparkSession.read.parquet(folder).groupBy(wave).count().collect()}


def type_disagreements(frames: dict[str, DataFrame]) -> list[tuple[str, dict[str, str]]]:
    """Columns that several frames have under different types."""
    seen: dict[str, dict[str, str]] = {}
    for name, df in frames.items():
        for column, kind in df.dtypes:
            seen.setdefault(column, {})[name] = kind
    return sorted((c, kinds) for c, kinds in seen.items() if len(set(kinds.values())) > 1)


def missing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of each side, with their multiplicity, that the other lacks; equal tables have none."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(left.exceptAll(right), "only_left").join(count(right.exceptAll(left), "only_right"))


def at_scale(df: DataFrame, scales: dict[str, int], precision: int = 38) -> DataFrame:
    """Result columns as decimals of their table's declared scales, so that every store rounds them alike."""
    return df.withColumns({c: F.col(c).cast(f"decimal({precision},{scale})") for c, scale in scales.items()})


def split_columns(df: DataFrame, parts: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A lossless split of a table by columns: every column is in some part, or the split raises."""
    lost = set(df.columns) - {c for names in parts.values() for c in names}
    if lost:
        raise ValueError(f"the split would lose {sorted(lost)}")
    return {name: df.select(*names) for name, names in parts.items()}


def ddl(table: str, columns: dict[str, str], key: list[str]) -> str:
    """A CREATE TABLE statement from declared columns."""
    lines = [f"    {identifier(c)} {kind}" for c, kind in columns.items()] + [f"    PRIMARY KEY ({', '.join(map(identifier, key))})"]
    return f"CREATE TABLE IF NOT EXISTS {identifier(table)} (\n" + ",\n".join(lines) + "\n)"
