"""Readers and writers: declared schemas, checked headers and shapes, exact text conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.bars import MONEY

TICKS = T.StructType(
    [
        T.StructField("trade_id", T.LongType()), T.StructField("price", MONEY), T.StructField("qty", MONEY), T.StructField("quote_qty", MONEY),
        T.StructField("event_time_us", T.LongType()), T.StructField("is_buyer_maker", T.BooleanType()), T.StructField("is_best_match", T.BooleanType()),
    ]
)


def read_ticks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Headerless positional tick files (plain or gzip, globs), one path a symbol, unioned by name."""
    out = None
    for symbol, path in paths.items():
        one = spark.read.schema(TICKS).option("header", False).option("mode", "FAILFAST").csv(path).withColumn("symbol", F.lit(symbol))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no symbol was given")
    return out


def read_contacts(spark: SparkSession, path: str, schema: T.StructType, order: str = "row_id") -> DataFrame:
    """A semicolon file with a header, under a declared schema, with the rows' order kept in ``order``."""
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path).withColumn(order, F.monotonically_increasing_id())


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, null: str = "\\N", sha256: str | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """Tab-separated values, plain or gzip; a digest and a shape (rows, columns), if given, are checked first.

    A digest is that of one file: a path of several files is refused.
    """
    if sha256 is not None:
        found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).limit(2).collect()]
        if found != [sha256]:
            raise ValueError(f"{path} has the digests {found}, not the one of {sha256}")
    out = spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", null).option("mode", "FAILFAST").csv(path)
    if shape is not None:
        header = spark.read.option("sep", "\t").option("header", True).csv(path)
        if (out.count(), len(header.columns)) != tuple(shape):
            raise ValueError(f"{path} has {out.count()} rows and {len(header.columns)} columns, not {shape}")
    return out


def read_copy(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A bulk load's conventions: a header line, and empty fields, quoted or not, are NULL."""
    read = spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "FAILFAST").option("nullValue", "").csv(path)
    text = {f.name: F.when(F.col(f.name) != "", F.col(f.name)) for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return read.withColumns(text) if text else read


def check_header(spark: SparkSession, path: str, expected: list[str], sep: str = ";") -> None:
    """Order matters: the columns are bound by place."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    found = [c.strip().strip('"') for c in first[0][0].split(sep)]
    if found != expected:
        raise ValueError(f"{path} has the columns {found}")


def present(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Whether each path is there and holds bytes; faults other than absence are raised."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(hadoop)
        out[p] = bool(fs.exists(path)) and fs.getContentSummary(path).getLength() > 0
    return out


def all_present(spark: SparkSession, paths: list[str]) -> bool:
    """All or nothing: whether every path is there and holds bytes; the branch of a job that needs them all."""
    return all(present(spark, paths).values())


def read_parquet(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return df


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str], partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query's rows over JDBC (its driver must be on the class path), in parallel if a column's range is given."""
    reader = spark.read.format("jdbc").option("url", url).options(**properties)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def time_columns(df: DataFrame) -> list[str]:
    """Columns of a time type, read off the schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, null: str = "") -> int:
    """CSV with header and \\n line ends (a header alone if empty); returns the rows, counted before the write."""
    rows = df.count()
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).option("nullValue", null).option("lineSep", "\n").csv(path)
    return rows


def write_rates(df: DataFrame, path: str, rates: list[str], null: str = "\\N") -> int:
    """As ``write_csv``, rates with two decimals and NULL as a token."""
    return write_csv(df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).cast("double"))) for c in rates}), path, null=null)


def write_waves(df: DataFrame, folder: str, wave: str, rates: list[str], null: str = "\\N") -> dict[int, int]:
    """One export a wave (a few declared ones), named after it; the rows of each."""
    waves = sorted(r[0] for r in df.select(wave).distinct().collect() if r[0] is not None)
    return {w: write_rates(df.where(F.col(wave) == w), f"{folder.rstrip('/')}/{wave}_{w}", rates, null) for w in waves}


def read_kpis(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A KPI directory read back under its declared schema, in its columns' order."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*schema.fieldNames())


def place_file(spark: SparkSession, folder: str, target: str) -> None:
    """The single part file of ``folder`` under a fixed name, over what stood there; the folder goes."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(folder).getFileSystem(hadoop)
    parts = [s.getPath() for s in fs.listStatus(of(folder)) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} holds {len(parts)} part files, not one")
    fs.delete(of(target), False)
    if not fs.rename(parts[0], of(target)):
        raise OSError(f"{parts[0].toString()} could not be moved to {target}")
    fs.delete(of(folder), True)


def archive(spark: SparkSession, source: str, into: str) -> str:
    """Moves a processed file into a folder; returns its new place."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    folder = jvm.org.apache.hadoop.fs.Path(into)
    fs = at.getFileSystem(hadoop)
    fs.mkdirs(folder)
    to = jvm.org.apache.hadoop.fs.Path(folder, at.getName())
    if not fs.rename(at, to):
        raise OSError(f"{source} could not be moved to {into}")
    return to.toString()
