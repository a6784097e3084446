"""The three batch pipelines end to end, as plain functions, and a small command line.

    python -m quern.pipelines bars --ticks SYMBOL=PATH ... --start-us N --end-us N --interval-us N --output PATH
    python -m quern.pipelines path --kind continuous|categorical|online --bars PATH --output PATH
    python -m quern.pipelines contacts --input PATH --curated-output PATH --kpi-output PATH [--warehouse PATH --archive PATH]
    python -m quern.pipelines star --offers PATH --clients PATH --state PATH --warehouse PATH [--run-id ID] [--seed N]
    python -m quern.pipelines items --refined PATH --run-id ID [--output PATH] [--dry-run]
    python -m quern.pipelines --self-check
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import bandit, bars, cleaning, features, incremental, kpis, kv, models
from quern.session import build_session
from quern.sources import tables
from quern.verdicts import firewall_fires, verdict

#: The contact table's columns, in order.
STRINGS = ["job", "marital", "education", "default", "housing", "loan", "contact", "month", "day_of_week"]
COUNTS = ["duration", "campaign", "pdays", "previous"]
RATES = ["emp_var_rate", "cons_price_idx", "cons_conf_idx", "euribor3m", "nr_employed"]
CONTACTS = T.StructType(
    [
        T.StructField("age", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in STRINGS], *[T.StructField(c, T.IntegerType()) for c in COUNTS],
        T.StructField("poutcome", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in RATES], T.StructField("y", T.StringType()),
    ]
)
#: Fixed values of the contact table: its months, school years and sectors.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
SCHOOL_YEARS = {"illiterate": 0, "basic.4y": 4, "basic.6y": 6, "basic.9y": 9, "high.school": 12, "professional.course": 13, "university.degree": 16}
SECTORS = {
    "admin.": "White collar", "blue-collar": "Manual", "entrepreneur": "Business owner", "housemaid": "Service", "management": "White collar", "retired": "Not working",
    "self-employed": "Business owner", "services": "Service", "student": "Not working", "technician": "Technical", "unemployed": "Not working",
}
FIRST_YEAR, NO_CONTACT = 2008, 999
#: The columns that are imputed, encoded, scaled, and kept as flags, and those of the KPI tables, in order.
IMPUTED = ["job", "marital", "education", "housing", "loan"]
ENCODED = ["job", "marital", "education", "contact", "poutcome", "age_group"]
NUMERIC = ["age", "campaign_capped", "previous", "contacts_total", *RATES, "edu_years", "months_elapsed"]
FLAGS = ["was_contacted_before", "contacted_by_cell", "known_customer", "is_university", "is_q4", "prev_success_rate"]
SEGMENT_KEYS = ["contact_date", "sector", "education"]
SEGMENT_KPIS = "contact_date date, sector string, education string, contacts long, subscribed long, subscribe_rate double, avg_age double, avg_campaign double"
MONTHLY_KPIS = "contact_date date, contacts long, unique_jobs long, subscribed long, subscribe_rate double, avg_euribor3m double, top_sector string, pct_cellular double"


def run_bars(spark: SparkSession, paths: dict[str, str], calendar: bars.Calendar, output: str) -> DataFrame:
    """Ticks to the dense bar table, written and returned; breaches raise before anything is written."""
    ticks = tables.read_ticks(spark, paths)
    bars.assert_contiguous(ticks)
    dense = bars.densify(bars.aggregate(ticks, calendar.interval_us), calendar, sorted(paths)).persist()
    try:
        bars.assert_sound(dense, ticks)
        tables.write_parquet(dense.select(*bars.BAR_COLUMNS), output)
    finally:
        dense.unpersist()
    return spark.read.parquet(output)


def clean_contacts(raw: DataFrame) -> DataFrame:
    """Target as 0/1, known modes for unknowns, sentinel as NULL, one row of equals (the first in file order), the leak dropped, the cap."""
    flag = lambda test: F.when(test, 1).otherwise(0)
    df = cleaning.impute_modes(raw.withColumn("y", flag(F.col("y") == "yes")), IMPUTED)
    df = cleaning.sentinel_to_null(df, "pdays", NO_CONTACT, "was_contacted_before")
    df = cleaning.deduplicate(df, CONTACTS.fieldNames(), [F.col("row_id")]).drop("duration")
    return cleaning.cap_at_fence(df, "campaign", "campaign_capped")


def engineer_contacts(df: DataFrame) -> DataFrame:
    """Groups and flags, the years rebuilt from month rollovers in file order, calendar parts, sectors."""
    flag = lambda test: F.when(test, 1).otherwise(0)
    df = df.withColumns(
        {
            "age_group": F.when(F.col("age") < 30, "young").when(F.col("age") < 60, "middle").otherwise("senior"),
            "contacted_by_cell": flag(F.col("contact") == "cellular"),
            "contacts_total": F.col("campaign") + F.col("previous"),
            "prev_success_rate": flag((F.col("previous") > 0) & (F.col("poutcome") == "success")),
            "known_customer": flag(F.col("previous") > 0),
            "is_university": flag(F.col("education").contains("university")),
            "edu_years": cleaning.lookup(SCHOOL_YEARS, "education").cast("double"),
            "month_num": cleaning.lookup(MONTHS, "month"),
        }
    )
    df = cleaning.rollovers(df, "row_id", "month_num", "years_on")
    df = df.withColumn("contact_date", F.make_date((F.col("years_on") + FIRST_YEAR).cast("int"), "month_num", F.lit(1)))
    df = df.withColumns({"quarter": F.quarter("contact_date"), "is_q4": flag(F.quarter("contact_date") == 4), "months_elapsed": F.months_between("contact_date", F.lit(f"{FIRST_YEAR}-05-01").cast("date")).cast("int")})
    sectors = df.sparkSession.createDataFrame(list(SECTORS.items()), "job string, sector string")
    df = cleaning.join_small(df.drop("years_on"), sectors, "job")
    if not df.where(F.col("contact_date").isNull()).isEmpty():
        raise ValueError("some rows have no contact date: the file order was lost")
    return df


def run_contacts(spark: SparkSession, path: str, curated: str, kpi: str) -> dict[str, int]:
    """The contact table to the curated model matrix and the two KPI tables; the rows written of each."""
    header = [f.replace("_", ".") if f in ("emp_var_rate", "cons_price_idx", "cons_conf_idx", "nr_employed") else f for f in CONTACTS.fieldNames()]
    tables.check_header(spark, path, header)
    enriched = models.encode(engineer_contacts(clean_contacts(tables.read_contacts(spark, path, CONTACTS))), ENCODED).persist()
    try:
        matrix = models.model_matrix(enriched, NUMERIC, [*FLAGS, *[f"{c}_vec" for c in ENCODED]], "y")
        tables.write_parquet(matrix, curated)
        segment = kpis.segment_kpis(enriched, SEGMENT_KEYS, "y", {"avg_age": "age", "avg_campaign": "campaign_capped"})
        monthly = kpis.monthly_kpis(enriched, "contact_date", "y", "job", "sector", {"avg_euribor3m": "euribor3m", "pct_cellular": "contacted_by_cell"}).withColumnRenamed("unique_values", "unique_jobs")
        order = ["contact_date", "contacts", "unique_jobs", "subscribed", "subscribe_rate", "avg_euribor3m", "top_sector", "pct_cellular"]
        return {
            "curated": spark.read.parquet(curated).count(),
            "segment_level_kpis": tables.write_csv(segment.orderBy(*SEGMENT_KEYS), f"{kpi.rstrip('/')}/segment_level_kpis", single_file=True),
            "monthly_kpis": tables.write_csv(monthly.select(*order).orderBy("contact_date"), f"{kpi.rstrip('/')}/monthly_kpis", single_file=True),
        }
    finally:
        enriched.unpersist()


def contacts_flow(spark: SparkSession, incoming: str, done: str, curated: str, kpi: str, warehouse: str) -> dict:
    """Validate, branch, run, load both KPI tables, archive.  Without the file nothing runs; a fault leaves it where it is."""
    if not tables.all_present(spark, [incoming]):
        return {"branch": "nothing to do", "missing": [p for p, there in tables.present(spark, [incoming]).items() if not there]}
    written = run_contacts(spark, incoming, curated, kpi)
    base, folder = warehouse.rstrip("/"), kpi.rstrip("/")
    loaded = {
        name: incremental.upsert_through_stage(tables.read_copy(spark, f"{folder}/{name}", T.StructType.fromDDL(schema)), f"{base}/{name}", keys)
        for name, schema, keys in (("segment_level_kpis", SEGMENT_KPIS, SEGMENT_KEYS), ("monthly_kpis", MONTHLY_KPIS, ["contact_date"]))
    }
    return {"branch": "loaded", "written": written, "loaded": loaded, "archived": tables.archive(spark, incoming, done)}


#: The ledgers of each path that become key-value items, with the columns that tell their rows apart.
ITEM_GRAINS = {
    "continuous": {"coefficients": ["feature"], "topology": ["column_a", "column_b"]},
    "categorical": {"coefficients": ["feature", "class_name"], "topology": ["grouping", "column_a", "column_b"], "scaling_search": ["scaling"]},
    "online": {"arms": ["symbol"]},
}


def load_items(spark: SparkSession, refined: str, run_id: str, put: Callable[[Iterable[dict]], None] | None = None, dry_run: bool = False) -> dict[str, int]:
    """All paths' ledgers as items under ``run_id``; the items of each.  A dry run builds and checks them and puts none."""
    incremental.run_name(run_id)
    counts, base = {}, refined.rstrip("/")
    for path, ledgers in ITEM_GRAINS.items():
        for name, grain in ledgers.items():
            rows = kv.items(spark.read.parquet(f"{base}/{path}/{name}"), f"{run_id}#{path}#{name}", grain, artifact=name).persist()
            counts[f"{path}/{name}"] = rows.count()
            if put is not None and not dry_run:
                kv.publish(rows, put)
            rows.unpersist()
    return counts


def ticks_flow(spark: SparkSession, ticks: dict[str, str], calendar: bars.Calendar, output: str, run_id: str, put: Callable[[Iterable[dict]], None] | None = None, replicates: int = 200, seed: int = 20250101) -> dict:
    """Ingest, the three paths side by side, then the items; a fault in one path stops the load."""
    from quern import paths

    base = output.rstrip("/")
    made = run_bars(spark, ticks, calendar, f"{base}/bars")
    jobs = {"continuous": {}, "categorical": {}, "online": {"replicates": replicates, "seed": seed}}
    with ThreadPool(len(jobs)) as pool:
        pool.map(lambda job: getattr(paths, job[0])(spark, f"{base}/bars", f"{base}/{job[0]}", **job[1]), jobs.items())
    return {"bars": made.count(), "items": load_items(spark, base, run_id, put)}


def self_check() -> dict[str, bool]:
    """The decisions whose failure would be silent, without a session."""
    grid = bandit.ArmGrid({"A": (1.0, 2.0)})
    import numpy as np

    alpha, beta, pulls = bandit.replay(np.full((50, 2), np.nan), 1)
    return {
        "firewall is strict": [firewall_fires(x) for x in (0, 0.0499, 0.05, 0.050001, 0.5)] == [False, False, False, True, True],
        "arms are numbered on": [r[0] for r in grid.rows()] == [1, 2, 3],
        "unobserved plays only decay": bool((alpha <= 1).all() and (beta <= 1).all() and pulls.sum() == 50),
        "watermarks compare as text": incremental.advance("9", ["9", "10"], None) == "9",
        "cuts of folds rise": features.fold_cut(0.5, 0, 100) < features.fold_cut(0.8, 0, 100),
        "booleans stay booleans": kv.to_store(True) is True,
    }


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--self-check", action="store_true")
    parser.add_argument("--local", type=int, default=None, help="run in this process with so many cores")
    sub = parser.add_subparsers(dest="job")
    one = sub.add_parser("bars")
    one.add_argument("--ticks", nargs="+", required=True, help="SYMBOL=PATH")
    for name in ("--start-us", "--end-us", "--interval-us"):
        one.add_argument(name, type=int, required=True)
    one.add_argument("--output", required=True)
    path = sub.add_parser("path")
    path.add_argument("--kind", choices=("continuous", "categorical", "online"), required=True)
    for name in ("--bars", "--output"):
        path.add_argument(name, required=True)
    path.add_argument("--seed", type=int, default=20250101, help="of the online path's replays")
    two = sub.add_parser("contacts")
    for name in ("--input", "--curated-output", "--kpi-output"):
        two.add_argument(name, required=True)
    for name in ("--warehouse", "--archive"):
        two.add_argument(name, help="with both: load the KPI tables and archive the file")
    three = sub.add_parser("star")
    for name in ("--offers", "--clients", "--state", "--warehouse"):
        three.add_argument(name, required=True)
    three.add_argument("--run-id", default=None)
    three.add_argument("--seed", type=int, default=20031001)
    four = sub.add_parser("items")
    for name in ("--refined", "--run-id"):
        four.add_argument(name, required=True)
    four.add_argument("--output", help="a folder for the items, as Parquet")
    four.add_argument("--dry-run", action="store_true", help="build and check the items, write none")
    args = parser.parse_args(argv)
    if args.self_check:
        found = self_check()
        print(json.dumps(found))
        return int(not all(found.values()))
    if args.job == "bars":
        calendar = bars.Calendar(args.start_us, args.end_us, args.interval_us)
        paths = dict(x.split("=", 1) for x in args.ticks)
        made = run_bars(build_session(local_cores=args.local), paths, calendar, args.output)
        print(json.dumps({"bars": made.count(), "slots": calendar.slots}))
    elif args.job == "path":
        from quern import paths

        extra = {"seed": args.seed} if args.kind == "online" else {}
        made = getattr(paths, args.kind)(build_session(local_cores=args.local), args.bars, args.output, **extra)
        print(json.dumps({name: df.count() for name, df in made.items()}))
    elif args.job == "contacts":
        spark = build_session(local_cores=args.local)
        if args.warehouse and args.archive:
            print(json.dumps(contacts_flow(spark, args.input, args.archive, args.curated_output, args.kpi_output, args.warehouse)))
        else:
            print(json.dumps(run_contacts(spark, args.input, args.curated_output, args.kpi_output)))
    elif args.job == "star":
        from quern import paths

        spark = build_session(local_cores=args.local)
        offers, clients = spark.read.parquet(args.offers), spark.read.parquet(args.clients)
        print(json.dumps(paths.star(spark, args.warehouse, offers, clients, paths.MAIL_GRID, incremental.StateStore(args.state), args.seed, run_id=args.run_id)))
    elif args.job == "items":
        spark = build_session(local_cores=args.local)
        counts = load_items(spark, args.refined, args.run_id, dry_run=args.dry_run)
        if args.output and not args.dry_run:
            for name in counts:
                path, ledger = name.split("/")
                rows = kv.items(spark.read.parquet(f"{args.refined.rstrip('/')}/{name}"), f"{args.run_id}#{path}#{ledger}", ITEM_GRAINS[path][ledger], artifact=ledger)
                rows.write.mode("overwrite").parquet(f"{args.output.rstrip('/')}/{name}")
        print(json.dumps(counts))
    else:
        parser.print_help()
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
