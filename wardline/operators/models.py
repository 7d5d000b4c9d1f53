"""Spark ML models for the outcome flag and the length of stay."""

from __future__ import annotations

import math
import random
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scores import threshold_label
from wardline.operators.admissions import SEED
from wardline.operators.summaries import class_balance
from wardline.session import new_path, stage

# The search ranges, the number of sampled settings and of folds, the early-stopping patience.
SEARCH_RANGES = {
    "maxDepth": (2, 8),
    "stepSize": (0.001, 1.0),
    "subsamplingRate": (0.5, 1.0),
    "featureSubsetStrategy": (0.5, 1.0),
    "minInfoGain": (0.0, 10.0),
    "weight": (0.5, 1.5),
}
SETTINGS = 10
FOLDS = 10
PATIENCE = 5

ROWS_PER_PARTITION = 200_000


def hash_share(*columns: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only: the same on every run."""
    parts = [F.lit(seed), *[F.col(c) for c in columns]]
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_000)) / F.lit(1_000_000.0)


def add_class_weight(df: DataFrame, label: str, factor: float = 1.0, name: str = "weight") -> DataFrame:
    """Positives weigh negatives / positives times ``factor``; negatives weigh 1."""
    weight = class_balance(df, label).first()["pos_weight"] * factor
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def assemble(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def fit_outcome_trees(
    train: DataFrame, features: list[str], label: str = "hospital_expire_flag", weight: str | None = "weight",
    validation: str | None = None, **params,
) -> PipelineModel:
    """Boosted-tree classifier; ``validation`` names a boolean column of rows kept for early stopping."""
    trees = GBTClassifier(labelCol=label, seed=SEED, **params)
    if weight:
        trees = trees.setWeightCol(weight)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assemble(features), trees]).fit(train)


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows that have a label: orphans of a right join, for one, have none and cannot be learned from or judged."""
    return df.where(F.col(label).isNotNull())


def best_round(losses: list[float], patience: int = PATIENCE) -> int:
    """How many rounds to keep: up to the best before ``patience`` rounds in a row brought no gain."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_outcome_trees_early(
    train: DataFrame, features: list[str], label: str = "hospital_expire_flag", weight: str | None = "weight",
    validation: str = "is_validation", rounds: int = 30, patience: int = PATIENCE, **params,
) -> tuple[PipelineModel, list[float]]:
    """Boosted trees cut back to the best round on the ``validation`` rows, and the loss there after each round.

    The rounds kept are fitted again with the same seed, which gives the same trees.
    """
    learning = train.where(~F.col(validation))
    fitted = fit_outcome_trees(learning, features, label, weight, maxIter=rounds, **params)
    losses = fitted.stages[-1].evaluateEachIteration(fitted.stages[0].transform(train.where(validation)))
    kept = best_round(losses, patience)
    if kept < rounds:
        fitted = fit_outcome_trees(learning, features, label, weight, maxIter=kept, **params)
    return fitted, losses


def fit_stay_trees_early(
    train: DataFrame, features: list[str], label: str = "LoS", validation: str = "is_validation", rounds: int = 30,
    patience: int = PATIENCE, **params,
) -> tuple[PipelineModel, list[float]]:
    """The same for the length of stay, by squared error."""
    known = labelled(train, label)
    learning = known.where(~F.col(validation))
    fitted = fit_stay_trees(learning, features, label, maxIter=rounds, **params)
    losses = fitted.stages[-1].evaluateEachIteration(fitted.stages[0].transform(known.where(validation)), "squared")
    kept = best_round(losses, patience)
    if kept < rounds:
        fitted = fit_stay_trees(learning, features, label, maxIter=kept, **params)
    return fitted, losses


def fit_stay_trees(
    train: DataFrame, features: list[str], label: str = "LoS", validation: str | None = None, **params
) -> PipelineModel:
    trees = GBTRegressor(labelCol=label, seed=SEED, **params)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assemble(features), trees]).fit(train)


def validation_slice(df: DataFrame, key: str = "subject_id", share: float = 0.2) -> DataFrame:
    """Adds ``is_validation`` for a hash-chosen share of subjects: whole subjects, from training rows only."""
    return df.withColumn("is_validation", hash_share(key, seed=SEED + 1) < share)


def fit_sequence_baseline(
    train: DataFrame, features: list[str], outcome: str = "hospital_expire_flag", stay: str = "LoS",
    weight: str = "weight", iterations: int = 25,
) -> tuple[PipelineModel, PipelineModel]:
    """Class-weighted outcome classifier and stay regressor over history features."""
    vector = assemble(features)
    classifier = LogisticRegression(labelCol=outcome, weightCol=weight, maxIter=iterations, regParam=0.01)
    regressor = LinearRegression(labelCol=stay, maxIter=iterations, regParam=0.01)
    return Pipeline(stages=[vector, classifier]).fit(train), Pipeline(stages=[vector, regressor]).fit(train)


def fit_text_classifier(
    train: DataFrame, text: str = "text", label: str = "label", buckets: int = 1 << 16, iterations: int = 20
) -> PipelineModel:
    """Two-class model on text: hashed terms weighted by rarity, then logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"\s+|\|"),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=buckets),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(labelCol=label, maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(train)


def score_batch(model: Model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All columns of ``df`` with ``score`` and ``pred`` (classifier) or ``pred`` (regressor)."""
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
        out = out.withColumns({"score": score, "pred": threshold_label(score, threshold)})
    else:
        out = out.withColumn("pred", F.col("prediction"))
    extra = {"features", "rawPrediction", "probability", "prediction", "tokens", "counts"}
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c in df.columns or c not in extra])


def sample_settings(
    estimator, n: int = SETTINGS, ranges: dict[str, tuple[float, float]] | None = None, seed: int = SEED
) -> list[dict]:
    """``n`` seeded settings over the ranges the estimator has; the step size is drawn on a log scale."""
    ranges, draw = ranges or SEARCH_RANGES, random.Random(seed)
    settings = []
    for _ in range(n):
        picked = {}
        for name, (low, high) in ranges.items():
            if not estimator.hasParam(name):
                continue
            value = low * (high / low) ** draw.random() if name == "stepSize" else draw.uniform(low, high)
            if name == "maxDepth":
                value = draw.randint(int(low), int(high))
            picked[estimator.getParam(name)] = f"{value:.3f}" if name == "featureSubsetStrategy" else value
        settings.append(picked)
    return settings


def search_hyperparameters(
    train: DataFrame, features: list[str], label: str, classification: bool = True, settings: int = SETTINGS,
    folds: int = FOLDS, parallelism: int = 8, ranges: dict[str, tuple[float, float]] | None = None,
    **params,
) -> tuple[CrossValidatorModel, list[dict]]:
    """Cross-validated choice among sampled settings, by ROC AUC or squared error.

    Every fit reads all labelled rows of its folds, and the chosen setting is fitted on all of them. Folds
    follow the subject, so no subject is on both sides. For a classifier the class weight is
    part of the setting: one weight column per sampled factor. The range of the minimum gain is that of
    a sum over rows; the trees here use gains per row, so it is divided by the number of rows. The trees have no
    L1 or L2 penalty, so those two ranges of the reference search have nothing to set.
    """
    # every fit runs a job per tree level and many fits run at once: few rows belong in one partition
    known = labelled(train, label)
    parts = max(1, math.ceil(known.count() / ROWS_PER_PARTITION))
    train = stage(known.coalesce(parts), "search")
    ranges = dict(SEARCH_RANGES if ranges is None else ranges)
    weights = ranges.pop("weight", (1.0, 1.0))
    rows = max(train.count(), 1)
    ranges["minInfoGain"] = tuple(v / rows for v in ranges.get("minInfoGain", (0.0, 0.0)))
    if classification:
        trees = GBTClassifier(labelCol=label, seed=SEED, **params)
        evaluator = BinaryClassificationEvaluator(labelCol=label, numBins=0)
    else:
        trees = GBTRegressor(labelCol=label, seed=SEED, **params)
        evaluator = RegressionEvaluator(labelCol=label, metricName="mse")
    grid = sample_settings(trees, settings, ranges)
    if classification:
        ratio = class_balance(train, label).first()["pos_weight"]
        draw = random.Random(SEED + 1)
        for i, chosen in enumerate(grid):
            name, factor = f"weight_{i}", draw.uniform(*weights)
            positive = F.col(label) == 1
            train = train.withColumn(name, F.when(positive, F.lit(ratio * factor)).otherwise(F.lit(1.0)))
            chosen[trees.weightCol] = name
    folded = train.withColumn("fold", F.floor(hash_share("subject_id", seed=SEED + 2) * folds).cast("int"))
    search = CrossValidator(
        estimator=Pipeline(stages=[assemble(features), trees]), estimatorParamMaps=grid, evaluator=evaluator,
        numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED,
    )
    return cross_validate(search, folded), [{p.name: v for p, v in g.items()} for g in grid]


def cross_validate(search: CrossValidator, folded: DataFrame) -> CrossValidatorModel:
    """What ``search.fit(folded)`` gives for an assembler followed by trees, with the fits of all folds in one pool.

    A fit is a chain of small jobs, one per tree level, and leaves most cores idle; ``CrossValidator`` waits for the slowest
    setting of a fold before it begins the next. Here the deepest settings of all folds go first, so that none is left alone
    at the end. The vectors are assembled once and kept.
    """
    (vector, trees), grid, evaluator = search.getEstimator().getStages(), search.getEstimatorParamMaps(), search.getEvaluator()
    fold, folds = search.getFoldCol(), search.getNumFolds()
    rows = vector.transform(folded).cache()
    held = {r[fold]: r["count"] for r in rows.groupBy(fold).count().collect()}
    empty = next((i for i in range(folds) if held.get(i, 0) in (0, sum(held.values()))), None)
    if empty is not None:
        raise ValueError(f"The training or validation data at fold {empty} is empty.")

    def judged(task: tuple[int, int]) -> tuple[tuple[int, int], float]:
        i, at = task
        model = trees.fit(rows.where(F.col(fold) != i), grid[at])
        return task, evaluator.evaluate(model.transform(rows.where(F.col(fold) == i)))

    depth = lambda at: grid[at].get(trees.maxDepth, trees.getMaxDepth())
    tasks = sorted(((i, at) for i in range(folds) for at in range(len(grid))), key=lambda t: -depth(t[1]))
    pool = ThreadPool(min(search.getParallelism(), len(tasks)))
    try:
        found = dict(pool.imap_unordered(inheritable_thread_target(folded.sparkSession)(judged), tasks))
    finally:
        pool.close()
        rows.unpersist()
    scores = np.array([[found[i, at] for at in range(len(grid))] for i in range(folds)])
    means = scores.mean(axis=0)
    best = grid[int(means.argmax() if evaluator.isLargerBetter() else means.argmin())]
    return search._copyValues(CrossValidatorModel(search.getEstimator().fit(folded, best), list(means), None, list(scores.std(axis=0))))


def search_table(df: DataFrame, model: CrossValidatorModel, settings: list[dict]) -> DataFrame:
    """One row per setting with its mean score: a driver-sized report."""
    rows = [
        (i, str(dict(sorted((k, str(v)) for k, v in s.items()))), float(m))
        for i, (s, m) in enumerate(zip(settings, model.avgMetrics))
    ]
    return df.sparkSession.createDataFrame(rows, "setting int, parameters string, score double")


def pca_project(df: DataFrame, column: str = "features", k: int = 2) -> tuple[DataFrame, PipelineModel]:
    """Scores on the first ``k`` components of the scaled vectors; constant positions scale to zero."""
    stages = [
        StandardScaler(inputCol=column, outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=k, inputCol="_scaled", outputCol="_scores"),
    ]
    model = Pipeline(stages=stages).fit(df)
    out = model.transform(df).withColumn("_array", vector_to_array("_scores"))
    scores = {f"PC{i + 1}": F.col("_array")[i] for i in range(k)}
    return out.withColumns(scores).drop("_scaled", "_scores", "_array"), model


def cluster(df: DataFrame, column: str = "features", k: int = 4, scale: bool = False) -> DataFrame:
    """``k`` clusters of the rows by repeated bisection, unscaled unless asked for."""
    stages, used = [], column
    if scale:
        used = "_scaled"
        stages.append(StandardScaler(inputCol=column, outputCol=used, withMean=True, withStd=True))
    stages.append(BisectingKMeans(k=k, featuresCol=used, predictionCol="cluster", seed=SEED))
    return Pipeline(stages=stages).fit(df).transform(df).drop("_scaled")


def as_vector(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(column).cast("array<double>")))


def split_counts(df: DataFrame, model: PipelineModel) -> DataFrame:
    """How many splits use each feature over all trees, from the nodes of the saved model.

    The model is written to the shared folder and its node table read back, so trees of any number and
    depth are counted as rows.
    """
    spark = df.sparkSession
    features = model.stages[0].getInputCols()
    path = new_path(spark, "trees")
    model.stages[-1].write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    index = F.col("nodeData.split.featureIndex")
    names = F.array(*[F.lit(f) for f in features])
    return (
        nodes.where(index >= 0)
        .groupBy(F.element_at(names, index + 1).alias("feature"))
        .agg(F.count(F.lit(1)).alias("importance"))
    )


def top_importance(importance: DataFrame, k: int = 20, value: str = "importance") -> DataFrame:
    return importance.orderBy(F.desc_nulls_last(value), "feature").limit(k)


def save_model(model: PipelineModel, path: str) -> None:
    """Fitted stages and the feature order, which lives in the assembler stage."""
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
