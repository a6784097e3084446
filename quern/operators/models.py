"""Fitted models: encoders, selectors, elastic nets under time-ordered folds, scaling search, association rules."""

from __future__ import annotations

import math
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, Imputer, MinMaxScaler, OneHotEncoder, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import cleaning, features

#: Grids of regularisation strength and share of the absolute penalty.
CONTINUOUS_GRID = ((1e-8, 1e-6, 1e-4), (0.25, 0.5, 1.0))
CLASS_GRID = ((0.01, 0.1), (0.5, 1.0))
#: Expanding folds: train below the first share of the span, test up to the second; the rest is held out.
EXPANDING = ((0.5, 0.6), (0.6, 0.7), (0.7, 0.8))
HOLDOUT = 0.8
#: Seeds of the random folds, fits run at once, rows of a partition when fitting.
SHUFFLES, PARALLEL_FITS, FIT_ROWS = (11, 22, 33), 4, 100_000

#: Tokens whose bits one long holds.
BITS = 62


def sized(df: DataFrame) -> DataFrame:
    """As many partitions as the rows ask for, so that small frames are not scheduled as large ones."""
    return df.repartition(max(1, -(-df.count() // FIT_ROWS)))


def assemble(df: DataFrame, columns: list[str], into: str = "features", invalid: str = "error") -> DataFrame:
    cast = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=into, handleInvalid=invalid).transform(cast)


def encode(df: DataFrame, columns: list[str], drop_last: bool = True, order: str = "frequencyDesc") -> DataFrame:
    """Index and one-hot vector of each column in one pipeline, so the plan holds one fitted model."""
    stages = [StringIndexer(inputCols=columns, outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep", stringOrderType=order), OneHotEncoder(inputCols=[f"{c}_idx" for c in columns], outputCols=[f"{c}_vec" for c in columns], dropLast=drop_last)]
    return Pipeline(stages=stages).fit(df).transform(df)


def model_matrix(df: DataFrame, numeric: list[str], others: list[str], target: str) -> DataFrame:
    """Numeric, other and vector columns, with the numeric ones assembled and scaled to mean 0 and deviation 1."""
    made = assemble(df, numeric, "features", "skip")
    scaled = StandardScaler(inputCol="features", outputCol="features_std", withMean=True, withStd=True).fit(made).transform(made)
    return scaled.select(*numeric, *others, "features", "features_std", target)


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    cast = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return Imputer(strategy="median", inputCols=columns, outputCols=columns).fit(cast).transform(cast)


def select_varying(df: DataFrame, columns: list[str], threshold: float = 0.0) -> list[str]:
    """The columns whose sample variance is over the threshold."""
    model = VarianceThresholdSelector(varianceThreshold=threshold, featuresCol="features", outputCol="selected").fit(assemble(df, columns))
    return [columns[i] for i in model.selectedFeatures]


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    made = assemble(df, columns)
    return MinMaxScaler(inputCol="features", outputCol="scaled").fit(made).transform(made).withColumn("scaled", vector_to_array("scaled"))


def discretise(df: DataFrame, column: str, buckets: int, into: str) -> DataFrame:
    """Quantile buckets, cut at exact quantiles; fewer where quantiles coincide.  Without a value there is one bucket."""
    row = cleaning.percentiles(df, [column], [k / buckets for k in range(buckets + 1)], between=False).first()
    cuts = sorted(set(row[0][1:-1])) if row is not None else []
    return Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol=column, outputCol=into).transform(df)


def moments(df: DataFrame, columns: list[str], fold: str) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """By fold, the sums of products of (1, ``columns`` to a common scale), with the centres and scales; two passes over the data.

    Each partition makes one matrix product a fold and batch; the driver sees folds x columns squared numbers.
    """
    row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    centre = np.array([row[k] or 0.0 for k in range(len(columns))])
    spread = np.array([row[len(columns) + k] or 0.0 for k in range(len(columns))])
    scale = np.where(spread > 0, spread, 1.0)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = (batch[columns].to_numpy(dtype=float) - centre) / scale
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            where = batch[fold].to_numpy()
            for f in np.unique(where):
                some = z[where == f]
                sums[int(f)] = sums.get(int(f), 0.0) + some.T @ some
        for f, m in sums.items():
            yield pd.DataFrame({"fold": f, "at": np.arange(m.size), "v": m.reshape(-1)})

    rows = df.select(fold, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(over, "fold int, at int, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).collect()
    size = len(columns) + 1
    found: dict[int, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["fold"], np.zeros(size * size))[r["at"]] = r["v"]
    return {f: m.reshape(size, size) for f, m in sorted(found.items())}, centre, scale


def descend(sums: np.ndarray, reg: float, net: float, unit: float) -> np.ndarray:
    """(intercept, coefficients) of the elastic net on summed products whose last column is the target, by coordinate descent.

    The penalties are those of Spark's linear regression: on coefficients of standardised columns, the target
    standardised too; ``unit`` is the size of the target's scale in its own unit.
    """
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = np.flatnonzero(spread[:-1] > 1e-12)
    beta = np.zeros(len(spread) - 1)
    if spread[-1] > 1e-12 and len(live):
        a = cov[np.ix_(live, live)] / np.outer(spread[live], spread[live])
        r = cov[live, -1] / (spread[live] * spread[-1])
        strength = reg / (spread[-1] * unit)
        l1, l2 = strength * net, strength * (1.0 - net)
        w = np.zeros(len(live))
        for _ in range(20_000):
            moved = 0.0
            for j in range(len(live)):
                rest = r[j] - a[j] @ w + a[j, j] * w[j]
                new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (a[j, j] + l2)
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < 1e-9:
                break
        beta[live] = w * spread[-1] / spread[live]
    return np.concatenate([[mean[-1] - beta @ mean[:-1]], beta])


#: The columns of the coefficient ledger, in order.
COEFFICIENTS = "feature string, coefficient double, survived_step9 boolean, mu double, sigma double, bp_per_sd double, reg_param double, elastic_net_param double, intercept double, cv_rmse double, target_sd double, n_rows double"


def elastic_net(df: DataFrame, columns: list[str], target: str, fold: str = "fold") -> tuple[DataFrame, float]:
    """The coefficient ledger (with the basis points a deviation moves) of the best elastic net by RMSE over given time folds.

    All fits of the grid and folds work on the folds' sums of products, so the data are read twice in all.
    """
    known = df.where(F.col(target).isNotNull())
    sums, centre, scale = moments(known, [*columns, target], fold)
    total = sum(sums.values())
    unit = float(scale[-1])

    def error(held: int, reg: float, net: float) -> float:
        b = descend(total - sums[held], reg, net, unit)
        v = np.concatenate([-b, [1.0]])
        return float(np.sqrt(max(v @ sums[held] @ v, 0.0) / sums[held][0, 0])) * unit

    usable = [f for f in sums if total[0, 0] - sums[f][0, 0] > 0]
    scores = {(reg, net): float(np.mean([error(f, reg, net) for f in usable])) for reg in CONTINUOUS_GRID[0] for net in CONTINUOUS_GRID[1]}
    (reg, net), rmse = min(scores.items(), key=lambda p: p[1])
    b = descend(total, reg, net, unit)
    n = total[0, 0]
    sample = np.sqrt(n / max(n - 1, 1))
    beta = b[1:] * unit / scale[:-1]
    intercept = float(centre[-1] + b[0] * unit - beta @ centre[:-1])
    live = np.sqrt(np.maximum(np.diag(total)[1:] / n - (total[0, 1:] / n) ** 2, 0.0)) > 1e-12
    rows = []
    for k, c in enumerate(columns):
        kept = bool(beta[k] != 0.0)
        sigma = float(scale[k] * sample) if live[k] else 0.0
        rows.append((c, float(beta[k]), kept, float(centre[k]) if kept else None, sigma if kept else None, float(10000.0 * beta[k] * sigma) if kept else None, reg, net, intercept, rmse, unit * float(sample), float(n)))
    return df.sparkSession.createDataFrame(rows, COEFFICIENTS), rmse


def label(column: str = "y_class"):
    out = F.when(F.col(column) == features.CLASSES[0], 0.0)
    for k, name in enumerate(features.CLASSES[1:], 1):
        out = out.when(F.col(column) == name, float(k))
    return out


def accuracy(model, test: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(test))


def majority_accuracy(dev: DataFrame, test: DataFrame) -> float:
    """The held-out accuracy of always saying the development rows' most frequent class."""
    modal = dev.groupBy("label").count().orderBy(F.desc("count"), "label").first()[0]
    return test.agg(F.avg((F.col("label") == modal).cast("double"))).first()[0]


def multinomial(df: DataFrame, columns: list[str], time: str = "bar_us") -> DataFrame:
    """One row a grid point: accuracy over expanding folds, over random folds, and on the held-out end.

    The fits of a grid point are independent and run side by side; their frame is dealt by its size, as
    each of many iterations schedules a task a partition.
    """
    made = sized(assemble(df.withColumn("label", label()).where(F.col("label").isNotNull()), columns, invalid="skip").select("features", "label", time)).persist()
    try:
        lo, hi = made.agg(F.min(time), F.max(time)).first()
        cut = lambda share: features.fold_cut(share, lo, hi)
        dev, test = made.where(F.col(time) < cut(HOLDOUT)), made.where(F.col(time) >= cut(HOLDOUT))
        base, rows = majority_accuracy(dev, test), []
        for reg in CLASS_GRID[0]:
            for net in CLASS_GRID[1]:
                fit = LogisticRegression(family="multinomial", regParam=reg, elasticNetParam=net, maxIter=50).fit
                folds = [(made.where(F.col(time) < cut(a)), made.where((F.col(time) >= cut(a)) & (F.col(time) < cut(b)))) for a, b in EXPANDING]
                folds += [tuple(dev.randomSplit([0.8, 0.2], seed)) for seed in SHUFFLES] + [(dev, test)]
                with ThreadPool(PARALLEL_FITS) as pool:
                    found = pool.map(lambda pair, fit=fit: accuracy(fit(pair[0]), pair[1]), folds)
                ordered, shuffled = found[: len(EXPANDING)], found[len(EXPANDING) : -1]
                rows.append((reg, net, sum(ordered) / len(ordered), sum(shuffled) / len(shuffled), found[-1], base))
    finally:
        made.unpersist()
    return df.sparkSession.createDataFrame(rows, "reg_param double, elastic_net double, cv_time_ordered double, cv_random double, holdout double, majority double")


def multinomial_coefficients(df: DataFrame, columns: list[str], reg: float, net: float, baseline: float, time: str = "bar_us") -> DataFrame:
    """One row a feature and class of the classifier at one grid point, fitted on the development rows."""
    made = sized(assemble(df.withColumn("label", label()).where(F.col("label").isNotNull()), columns, invalid="skip").select("features", "label", time))
    lo, hi = made.agg(F.min(time), F.max(time)).first()
    dev = made.where(F.col(time) < features.fold_cut(HOLDOUT, lo, hi))
    matrix = LogisticRegression(family="multinomial", regParam=reg, elasticNetParam=net, maxIter=50).fit(dev).coefficientMatrix.toArray()
    largest = np.abs(matrix).max(axis=0)
    rows = [(c, features.CLASSES[k], float(matrix[k, j]), float(largest[j]), bool(largest[j] > 0), reg, net, baseline) for j, c in enumerate(columns) for k in range(len(matrix))]
    return df.sparkSession.createDataFrame(rows, "feature string, class_name string, coefficient double, max_abs_across_classes double, survived_step9 boolean, reg_param double, elastic_net_param double, baseline_accuracy double")


def scaling_search(df: DataFrame, columns: list[str], time: str = "bar_us", reg: float = 0.01, net: float = 0.5) -> DataFrame:
    """One row a scaling (standard, signed log, rank): held-out accuracy of the same classifier; scalers see development rows only."""
    known = df.withColumn("label", label()).where(F.col("label").isNotNull()).na.drop(subset=columns).select(time, "label", *[F.col(c).cast("double").alias(c) for c in columns])
    lo, hi = known.agg(F.min(time), F.max(time)).first()
    cut = features.fold_cut(HOLDOUT, lo, hi)
    ranked, points = known, features.rank_cuts(known.where(F.col(time) < cut), columns, 200)
    for c in columns:
        ranked = features.rank_by_cuts(ranked, c, c, points[c])
    ways = {"standard": known, "signed_log1p": known.withColumns({c: features.signed_log1p(F.col(c)) for c in columns}), "percent_rank": ranked}
    rows = []
    for name, frame in ways.items():
        made = sized(assemble(frame, columns, "raw")).persist()
        dev, test = made.where(F.col(time) < cut), made.where(F.col(time) >= cut)
        if name == "standard":
            scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(dev)
            dev, test = scaler.transform(dev), scaler.transform(test)
        else:
            dev, test = dev.withColumnRenamed("raw", "features"), test.withColumnRenamed("raw", "features")
        model = LogisticRegression(family="multinomial", regParam=reg, elasticNetParam=net, maxIter=50).fit(dev)
        rows.append((name, accuracy(model, test), majority_accuracy(dev, test), len(columns)))
        made.unpersist()
    best = max(r[1] for r in rows)
    return df.sparkSession.createDataFrame([(*r, r[1] == best) for r in rows], "scaling string, holdout double, majority double, n_features int, best boolean")


def association_rules(baskets: DataFrame, min_support: float = 0.003, min_confidence: float = 0.5, items: str = "items", ordered: bool = True) -> DataFrame:
    """Rules by FP-growth with their antecedents in the tokens' order; if ``ordered``, strongest lift first, then rarest.

    Baskets are mined once, in as many parts as the session shuffles to.  A frequent set is known by its bits (some longs):
    each set meets its supersets by one token under its own bits, so no set of strings is shuffled or compared.
    """
    held = baskets.where(F.col(items).isNotNull()).select(F.col(items).alias("items"))
    total = held.count()
    least = math.ceil(min_support * total)
    token = held.schema["items"].dataType.elementType
    # At most as many as the baskets' tokens over ``least``, in order.
    counts = held.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy("token").collect()
    names = F.array(*[F.lit(r["token"]) for r in counts]).cast(T.ArrayType(token))
    coded = held.select(F.filter(F.transform("items", lambda x: F.array_position(names, x).cast("int") - 1), lambda x: x >= 0).alias("items"))
    parts = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=max(parts, 1)).fit(coded).freqItemsets
    sets = often.select(F.array_sort("items").alias("ids"), "freq")
    bits = [f"bits{lo}" for lo in range(0, max(len(counts), 1), BITS)]
    bit = lambda x, lo: f"if({x} >= {lo} AND {x} < {lo + BITS}, shiftleft(1L, {x} - {lo}), 0L)"
    sets = sets.withColumns({c: F.expr(f"aggregate(ids, 0L, (held, x) -> held | {bit('x', k * BITS)})") for k, c in enumerate(bits)})
    # The set itself (token -1) and the set without each of its tokens, but for the empty one.
    split = sets.select("*", F.explode(F.when(F.size("ids") > 1, F.concat(F.array(F.lit(-1)), F.col("ids"))).otherwise(F.array(F.lit(-1)))).alias("token"))
    split = split.select("freq", "token", F.when(F.col("token") < 0, F.col("ids")).alias("ids"), *[F.expr(f"{c} ^ {bit('token', k * BITS)}").alias(c) for k, c in enumerate(bits)])
    # Groups of one set and at most a row a token.
    same = Window.partitionBy(*bits)
    met = split.withColumns({"below": F.max(F.when(F.col("token") < 0, F.col("freq"))).over(same), "antecedent": F.max("ids").over(same)})
    confidence = F.col("freq") / F.col("below")
    at = lambda values, x: F.element_at(values, x + 1)
    singles = F.array(*[F.lit(r["n"]) for r in counts]).cast("array<bigint>")
    rules = met.where((F.col("token") >= 0) & (confidence >= min_confidence)).select(
        F.transform("antecedent", lambda x: at(names, x)).alias("antecedent"), F.array(at(names, F.col("token"))).alias("consequent"), confidence.alias("confidence"),
        (confidence / (at(singles, F.col("token")) / F.lit(float(total)))).alias("lift"), (F.col("freq") / F.lit(float(total))).alias("support"),
    )
    return rules.orderBy(F.desc("lift"), F.asc("support")) if ordered else rules


def strongest(pairs: DataFrame, column: str = "r", n: int = 1) -> DataFrame:
    """The ``n`` rows largest by absolute value (NULLs out), ties by the other columns: a top-k, not a sort."""
    return pairs.where(F.col(column).isNotNull()).orderBy(F.desc(F.abs(F.col(column))), *[c for c in pairs.columns if c != column]).limit(n)


def token_path(baskets: DataFrame, target: DataFrame, on: str, tokens: list[str], strengths: tuple[float, ...]) -> DataFrame:
    """How many one-hot tokens keep a weight as the absolute penalty grows (no standardisation)."""
    wide = baskets.join(target, on).select("label", *[F.array_contains("items", t).cast("double").alias(f"t{k}") for k, t in enumerate(tokens)])
    made = assemble(wide, [f"t{k}" for k in range(len(tokens))]).persist()
    rows = []
    for reg in strengths:
        model = LinearRegression(regParam=reg, elasticNetParam=1.0, standardization=False, maxIter=100).fit(made)
        rows.append((reg, int(sum(1 for w in model.coefficients if w != 0.0))))
    made.unpersist()
    return baskets.sparkSession.createDataFrame(rows, "reg_param double, kept int")
