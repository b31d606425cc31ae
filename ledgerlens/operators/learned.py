"""Learned scores with Spark ML: trees and linear models fitted on all rows, scoring of all rows, importances and contributions."""

from __future__ import annotations

from math import inf, isqrt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import written

#: Rows that stacking, calibration and networks are fitted on at most, taken by a hash of the key; documented bound of the sample.
MOST_ROWS = 100_000
#: Bins of a feature of the trees, of about as many rows each; fewer values have a bin each.
BINS = 32


def sample(rows: DataFrame, key: str = "row_index", most: int = MOST_ROWS) -> DataFrame:
    """At most about ``most`` rows, by a hash of the key: the same rows whatever the order."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight: negatives over positives for a positive row, 1 for others and where there is no positive."""
    n, p = rows.agg(F.count("*"), F.sum(label)).first()
    return rows.withColumn("weight", F.when(F.col(label) == 1, float((n - p) / p) if p else 1.0).otherwise(1.0))


def _numbers(train: DataFrame, features: list[str], label: str) -> DataFrame:
    return weighted(train, label).select(label, "weight", *(F.col(c).cast("double").alias(c) for c in features))


def _coarse(x: Column) -> Column:
    """x rounded to 9 binary digits, in the order of x; values too large for that stay."""
    far = x * float((1 << 44) + 1)
    return F.when(F.abs(x) < 1e290, far - (far - x)).otherwise(x)


def bin_starts(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """For each column the least value of each bin but the first, exact over all rows: the values where the rows below pass a further ``1/bins``, or all values if there are not more.

    Values are counted in coarse steps first, and by themselves only in the steps where that can matter.
    """
    long = rows.select(F.posexplode(F.array(*(F.col(c) + 0.0 for c in columns))).alias("c", "x"))  # -0.0 as 0.0
    by = W.partitionBy("c")
    place = lambda n: F.floor(n * F.lit(bins) / F.sum("n").over(by))
    upto = lambda df, x: df.withColumn("_to", F.sum("n").over(by.orderBy(x).rowsBetween(W.unboundedPreceding, 0)))
    steps = written(long.groupBy("c", _coarse(F.col("x")).alias("v")).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("x").alias("_most")), "steps")
    passed = (place(F.col("_to")) > place(F.col("_to") - F.col("n"))) | (F.count("*").over(by) <= bins)
    steps = upto(steps, "v").withColumn("_fine", passed & (F.col("x") < F.col("_most")))
    fine = F.broadcast(steps.where("_fine").select("c", "v"))  # about 32 a column at most
    values = long.withColumn("v", _coarse(F.col("x"))).join(fine, ["c", "v"], "left_semi").groupBy("c", "x").agg(F.count("*").alias("n"))
    at = upto(steps.where("NOT _fine").select("c", "x", "n").unionByName(values), "x").withColumn("_at", place(F.col("_to") - F.col("n")))
    before = F.lag("_at").over(by.orderBy("x"))
    starts = at.withColumns({"_before": before, "_values": F.count("*").over(by)}).where(F.col("_before").isNotNull() & ((F.col("_values") <= bins) | (F.col("_at") > F.col("_before"))))
    out = [[] for _ in columns]
    for r in starts.select("c", "x").collect():  # 31 a column at most
        out[r["c"]].append(r["x"])
    return [sorted(x) for x in out]


def fit_trees(train: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 5) -> PipelineModel:
    """Boosted trees on all rows. Spark draws thresholds from a sample of max(maxBins^2, 10,000) rows, so values become bins first and maxBins is such that the sample is all rows; no feature has more than BINS bins all the same."""
    rows = _numbers(train, features, label)
    filled, binned = [f"{c}_f" for c in features], [f"{c}_b" for c in features]
    filler = Imputer(inputCols=features, outputCols=filled).fit(rows)
    rows = filler.transform(rows)
    cuts = [[-inf, *(x or [0.0]), inf] for x in bin_starts(rows, filled)]
    binner = Bucketizer(splitsArray=cuts, inputCols=filled, outputCols=binned)
    kept = written(binner.transform(rows).select(label, "weight", *(F.col(c).cast("byte").alias(c) for c in binned)), "bins")
    packer = VectorAssembler(inputCols=binned, outputCol="_features")
    model = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=max(BINS, isqrt(kept.count()) + 1), stepSize=0.1, seed=42)
    return PipelineModel([filler, binner, packer, model.fit(packer.transform(kept))])


def fit_linear(train: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """A logistic model on all rows."""
    filled = [f"{c}_f" for c in features]
    model = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="weight", maxIter=50, regParam=0.01)
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_features"), model]).fit(_numbers(train, features, label))


def scored(model: PipelineModel, rows: DataFrame, features: list[str], out: str = "model_score") -> DataFrame:
    """rows with the model's probability of the positive class."""
    cast = rows.withColumns({c: F.col(c).cast("double") for c in features})
    done = model.transform(cast).withColumn(out, vector_to_array("probability")[1])
    return done.drop("_features", "rawPrediction", "probability", "prediction", *(f"{c}{end}" for c in features for end in ("_f", "_b")))


def stacked(train: DataFrame, features: list[str], label: str = "label", key: str = "row_index", folds: int = 3, configs: tuple[tuple[int, int], ...] = ((10, 3), (15, 4), (20, 5))):
    """(tree models, meta model): each configuration scores each fold with a model of the other folds; a logistic model joins them. Folds are a hash of the key."""
    rows = sample(train, key)
    fold = F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(folds))
    out = None
    for f in range(folds):
        held = rows.where(fold == f)
        for i, (trees, depth) in enumerate(configs):
            held = scored(fit_trees(rows.where(fold != f), features, label, trees, depth), held, features, f"m{i}")
        out = held if out is None else out.unionByName(held)
    names = [f"m{i}" for i in range(len(configs))]
    return [fit_trees(rows, features, label, t, d) for t, d in configs], fit_linear(out.select(key, label, *names), names, label)


def load_or_fit(path: str, fit) -> PipelineModel:
    """The model kept at a path, or ``fit()`` saved there first. A model that is there and cannot be read is an error and stays as it is."""
    try:
        return PipelineModel.load(path)
    except Exception as e:  # noqa: BLE001 - which class says that a path is missing depends on the file system
        if not any(x in str(e) for x in ("does not exist", "PATH_NOT_FOUND", "FileNotFound")):
            raise
    model = fit()
    model.write().save(path)
    return model


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features with the model's gain, highest first."""
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def share_of(table: list[tuple[str, float]], prefix: str) -> float:
    """The part of all importance that features with a prefix have."""
    whole = sum(v for _, v in table)
    return sum(v for n, v in table if n.startswith(prefix)) / whole if whole else 0.0


def contributions(model: PipelineModel, rows: DataFrame, features: list[str], key: str = "row_index", best: int = 5) -> DataFrame:
    """(key, feature, contribution, place): of a linear model the coefficient times the distance from the mean, the largest by size, of these the positive ones."""
    means = rows.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in features)).first()
    parts = F.array(*(
        F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)) - (means[c] or 0.0)).alias("d"), F.lit(float(w)).alias("w"))
        for c, w in zip(features, model.stages[-1].coefficients.toArray())
    ))
    sized = F.transform(parts, lambda x: F.struct((-F.abs(x["d"] * x["w"])).alias("size"), x["feature"].alias("feature"), (x["d"] * x["w"]).alias("v")))
    return rows.select(key, F.posexplode(F.slice(F.array_sort(sized), 1, best)).alias("place", "x")).where("x.v > 0").select(key, "x.feature", F.col("x.v").alias("contribution"), "place")


def calibrated(train: DataFrame, rows: DataFrame, score: str, label: str = "label", out: str = "calibrated", most: int = MOST_ROWS) -> DataFrame:
    """rows with the isotonic (pool adjacent violators) calibration of the score, linear between steps, clipped outside."""
    fitted = sample(train, most=most).where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    model = IsotonicRegression(featuresCol="x", labelCol="y").fit(fitted)
    return model.setFeaturesCol(score).setPredictionCol(out).transform(rows.where(F.col(score).isNotNull()))
