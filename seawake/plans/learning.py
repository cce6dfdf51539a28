"""Sampling, splitting and metrics around models, and the models: destination, time to arrival, anomaly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seawake.operators import quantiles

FEATURES = ["speed", "course", "latitude", "longitude", "delta_distance_km", "speed_estimated_kn", "course_change_deg", "hour_of_day"]


def ranked(df: DataFrame, order: list[str], parts: int = 64) -> tuple[DataFrame, int]:
    """Rows with their 0-based position in a total order, and their number.

    Rows are dealt by fixed ranges of the first column, so their sizes are the same whenever they are counted, and no task
    sees more than its share of the rows.
    """
    kind = df.schema[order[0]].dataType
    cuts = df.agg(F.percentile_approx(order[0], [k / parts for k in range(1, parts)], 10_000).alias("cuts")).first().cuts or []
    part = F.lit(0)
    for c in sorted({*cuts}):
        part = part + F.coalesce(F.col(order[0]) > F.lit(c).cast(kind), F.lit(False)).cast("int")
    placed = df.withColumn("_p", part)
    start, at = [], 0
    for r in placed.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # at most `parts` rows
        start += [F.lit(r._p), F.lit(at)]
        at += r.n
    if not start:
        return df.withColumn("position", F.lit(0).cast("long")), 0
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("position", (F.element_at(F.create_map(*start), F.col("_p")) + inner).cast("long")).drop("_p"), at


def evenly(df: DataFrame, order: list[str], m: int) -> DataFrame:
    """At most m rows, evenly spaced in the order, first and last included."""
    rows, n = ranked(df, order)
    if n <= m:
        return rows
    i = F.col("position")
    back = F.ceil(i * (m - 1) / (n - 1))  # the first of the m steps at or past this row
    taken = F.floor(back * (n - 1) / (m - 1)) == i
    return rows.filter(taken)


def time_split(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """`is_train`: the first share of the rows in time."""
    rows, n = ranked(df, order)
    return rows.withColumn("is_train", F.col("position") < int(share * n))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and weights inverse to them."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(total).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))  # with one row


def frequent_classes(df: DataFrame, label: str, least: tuple[int, ...] = (200, 100, 50, 20, 5, 1), want: int = 2, most: int = 80) -> DataFrame:
    """Rows of the classes above the first threshold that leaves `want` classes, the most frequent `most` of them."""
    counts = df.groupBy(label).count()
    tops = counts.agg(*(F.count_if(F.col("count") >= t).alias(f"n{t}") for t in least)).first()
    bar = next((t for t in least if tops[f"n{t}"] >= want), least[-1])
    keep = counts.filter(F.col("count") >= bar).orderBy(F.desc("count"), label).limit(most)
    return df.join(keep.select(label), label, "left_semi")


def thresholds(features: DataFrame) -> DataFrame:
    """The 0.99 quantile of absolute acceleration and the 0.95 of course change."""
    q = lambda c, p, n: quantiles.quantile(features, c, [p]).select(F.get("quantiles", 0).alias(n))
    return q(F.abs("acceleration_kn_per_h"), 0.99, "acceleration_p99").crossJoin(q(F.col("course_change_deg"), 0.95, "course_change_p95"))  # one row with one row


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 per class."""
    hit = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    t = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("support"), F.sum(hit).alias("hits"))
    p = df.groupBy(F.col(prediction).alias("class")).agg(F.count("*").alias("predicted"))
    out = t.join(p, "class", "full_outer").na.fill(0, ["support", "hits", "predicted"])
    out = out.withColumn("precision", F.coalesce(F.col("hits") / F.nullif("predicted", F.lit(0)), F.lit(0.0))).withColumn("recall", F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), F.lit(0.0)))
    both = F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / both, F.lit(0.0)))


def regression_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    means = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return means.crossJoin(quantiles.quantile(df, F.abs(e), [0.5]).select(F.get("quantiles", 0).alias("median_ae")))  # one row with one row


def train_destination(rows: DataFrame, label: str = "destination_norm", trees: int = 20, seed: int = 7) -> PipelineModel:
    """A forest over imputed track features, classes weighted inversely to their size."""
    weighted = rows.join(class_weights(rows, label).select(label, "weight"), label)
    stages = [StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"), Imputer(inputCols=FEATURES, outputCols=FEATURES, strategy="median"), VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"), RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, weightCol="weight")]
    return Pipeline(stages=stages).fit(weighted)


def train_eta(rows: DataFrame, label: str = "eta_minutes_label", rounds: int = 20, seed: int = 7) -> PipelineModel:
    """Boosted trees for the minutes to arrival."""
    stages = [Imputer(inputCols=FEATURES, outputCols=FEATURES, strategy="median"), VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=label, maxIter=rounds, seed=seed)]
    return Pipeline(stages=stages).fit(rows.filter(F.col(label).isNotNull()))


def top_classes(scored: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """The k most probable classes of each row."""
    from pyspark.ml.functions import vector_to_array

    p = F.arrays_zip(vector_to_array("probability").alias("p"), F.array(*map(F.lit, names)).alias("name"))
    return scored.withColumn("top", F.slice(F.reverse(F.array_sort(p)), 1, k))


def filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps filled with the column's median, in rows that have any of the columns."""
    medians = rows.agg(*(F.percentile_approx(c, 0.5, 10_000).alias(c) for c in columns)).first()
    some = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
    return rows.withColumns({c: F.coalesce(F.col(c), F.when(some, F.lit(medians[c]))) for c in columns})


def fit_isolation(rows: DataFrame, columns: list[str], sample: int = 4096, trees: int = 64, depth: int = 10, seed: int = 7) -> list[list]:
    """Random isolation trees on a bounded sample (smallest hashes) of the rows that have any of the columns, gaps filled with
    medians; each node is (column, cut, left, right) or a path length."""
    data = filled(rows, columns).select(*columns).dropna(how="all").orderBy(F.xxhash64(*columns)).limit(sample).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)

    def usual(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(x: np.ndarray, d: int) -> object:
        span = np.ptp(x, axis=0) if len(x) else np.zeros(len(columns))
        live = np.flatnonzero(span > 0)
        if d == depth or len(x) < 2 or not len(live):
            return float(d + usual(len(x)))
        c = int(rng.choice(live))
        cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
        return [c, cut, grow(x[x[:, c] < cut], d + 1), grow(x[x[:, c] >= cut], d + 1)]

    size = min(256, len(data))
    return [[grow(data[rng.choice(len(data), size, replace=False)] if size else data, 0), usual(size)] for _ in range(trees)]


def isolation_score(rows: DataFrame, columns: list[str], forest: list[list]) -> DataFrame:
    """`anomaly_score` from 0 to 1; larger is stranger; gaps count as medians; null where every feature is null."""

    def paths(node: object, x: np.ndarray) -> np.ndarray:
        if not isinstance(node, list):
            return np.full(len(x), node)
        left = x[:, node[0]] < node[1]
        out = np.empty(len(x))
        out[left], out[~left] = paths(node[2], x[left]), paths(node[3], x[~left])
        return out

    @F.pandas_udf("double")
    def score(*cs: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cs])
        mean = np.mean([paths(t, x) / max(u, 1e-9) for t, u in forest], axis=0)
        return pd.Series(np.where(np.isnan(x).any(1), np.nan, 2.0**-mean)).astype(object).where(~np.isnan(x).any(1), None)

    gaps = filled(rows.withColumns({f"_{c}": F.col(c) for c in columns}), [f"_{c}" for c in columns])
    return gaps.withColumn("anomaly_score", score(*(f"_{c}" for c in columns))).drop(*(f"_{c}" for c in columns))


def accuracy(scored: DataFrame, label: str, top: str, k: int = 5) -> DataFrame:
    """Share of rows whose label is the first, and among the first k, of the class names in `top`."""
    first, some = F.get(F.col(top), 0) == F.col(label), F.array_contains(F.slice(top, 1, k), F.col(label))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return scored.agg(F.count("*").alias("rows"), share(first).alias("top_1"), share(some).alias(f"top_{k}"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
