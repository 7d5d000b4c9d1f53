"""Preparation steps as pipeline stages, so that a saved pipeline scores raw rows, nulls and unseen values included.

What a stage has learned is kept in its params and saved with it: missing-value flags, exact training medians, target means
of categories, scale. Stages add columns and leave the given ones as they are.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scores import threshold_label
from wardline.operators import scaling
from wardline.operators.admissions import SEED
from wardline.operators.columns import quoted
from wardline.operators.models import labelled, vector_to_array

_MOST_LEVELS = 10_000


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class _Columns(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Shared params: the columns a stage reads, and the ending of the names it writes."""

    columns = _param("columns", "columns read", TypeConverters.toListString)
    ending = _param("ending", "ending of the names of the columns written", TypeConverters.toString)

    def __init__(self, **values):
        super().__init__()
        self._set(**values)

    def values(self, *names: str) -> list:
        return [self.getOrDefault(self.getParam(n)) for n in names]


class MissingFlags(_Columns, Transformer):
    """0/1 per column: is the value null."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, ending = self.values("columns", "ending")
        return dataset.withColumns({c + ending: F.col(quoted(c)).isNull().cast("double") for c in columns})


class MedianImputer(_Columns, Estimator):
    """Learns the exact median of each column; ``defaults`` names a number for columns without any value."""

    default = _param("default", "value of a column that is null in all training rows", TypeConverters.toFloat)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        columns, ending, default = self.values("columns", "ending", "default")
        found = scaling.learn_medians(dataset.select(*[quoted(c) for c in columns]), columns)
        empty = [c for c in columns if found.get(c) is None]
        return MedianImputerModel(columns=columns, ending=ending, medians=[default if c in empty else float(found[c]) for c in columns], empty=empty)


class MedianImputerModel(_Columns, Model):
    """``empty`` lists the columns that had no training value."""

    medians = _param("medians", "value in place of null, by column", TypeConverters.toListFloat)
    empty = _param("empty", "columns without a training value", TypeConverters.toListString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, ending, medians = self.values("columns", "ending", "medians")
        return dataset.withColumns({c + ending: F.coalesce(F.col(quoted(c)).cast("double"), F.lit(m)) for c, m in zip(columns, medians)})


class Standardizer(_Columns, Estimator):
    """Learns mean and population deviation; nulls are skipped."""

    def _fit(self, dataset: DataFrame) -> StandardizerModel:
        columns, ending = self.values("columns", "ending")
        scale = scaling.learn_scale(dataset, columns)
        return StandardizerModel(columns=columns, ending=ending, means=[float(scale[c][0] or 0.0) for c in columns], deviations=[float(scale[c][1]) for c in columns])


class StandardizerModel(_Columns, Model):
    means = _param("means", "mean by column", TypeConverters.toListFloat)
    deviations = _param("deviations", "deviation by column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, ending, means, deviations = self.values("columns", "ending", "means", "deviations")
        return dataset.withColumns({c + ending: (F.col(quoted(c)) - F.lit(m)) / F.lit(d) for c, m, d in zip(columns, means, deviations)})


class TargetMeans(_Columns, Estimator):
    """Learns the weighted target mean of each value of one column (see ``scaling.target_means``); null is a value."""

    label = _param("label", "target column", TypeConverters.toString)

    def _fit(self, dataset: DataFrame) -> TargetMeansModel:
        (column,), ending, label = self.values("columns", "ending", "label")
        means, overall = scaling.target_means(dataset, column, label)
        rows = means.limit(_MOST_LEVELS + 1).collect()
        if len(rows) > _MOST_LEVELS:
            raise ValueError(f"{column} has more than {_MOST_LEVELS} values, too many to be saved with a model; use scaling.target_encode")
        known = {r[0]: float(r[1]) for r in rows}
        prior = float(overall or 0.0)
        levels = sorted(str(v) for v in known if v is not None)
        return TargetMeansModel(
            columns=[column], ending=ending, levels=levels, encoded=[{str(k): v for k, v in known.items()}[v] for v in levels],
            prior=prior, of_null=known.get(None, prior),
        )


class TargetMeansModel(_Columns, Model):
    """Values that training did not have take the overall mean."""

    levels = _param("levels", "values of the column", TypeConverters.toListString)
    encoded = _param("encoded", "their target means", TypeConverters.toListFloat)
    prior = _param("prior", "overall mean", TypeConverters.toFloat)
    of_null = _param("of_null", "target mean of null", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        (column,), ending, levels, encoded, prior, of_null = self.values("columns", "ending", "levels", "encoded", "prior", "of_null")
        side = dataset.sparkSession.createDataFrame(list(zip(levels, encoded)), "_level string, _encoded double")
        value = F.col(quoted(column)).cast("string")
        joined = dataset.join(F.broadcast(side), value == F.col("_level"), "left")  # at most _MOST_LEVELS rows
        result = F.when(value.isNull(), F.lit(of_null)).otherwise(F.coalesce(F.col("_encoded"), F.lit(prior)))
        return joined.withColumn(column + ending, result).drop("_level", "_encoded")


def prepared_trees(
    numbers: list[str], categories: list[str], label: str, is_class: bool, optional: list[str] | None = None, weight: str | None = None, **params
) -> Pipeline:
    """Boosted trees on raw columns: flags for ``optional`` numbers, medians, target means of ``categories``, scale, trees."""
    flags = [f"{c}_missing" for c in optional or []]
    filled, means = [f"{c}_filled" for c in numbers], [f"{c}_mean" for c in categories]
    inputs = [f"{c}_scaled" for c in [*filled, *means]] + flags
    trees = (GBTClassifier if is_class else GBTRegressor)(labelCol=label, featuresCol="_features", seed=SEED, **params)
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[
        *([MissingFlags(columns=list(optional), ending="_missing")] if optional else []),
        MedianImputer(columns=numbers, ending="_filled", default=0.0),
        *[TargetMeans(columns=[c], ending="_mean", label=label) for c in categories],
        Standardizer(columns=[*filled, *means], ending="_scaled"),
        VectorAssembler(inputCols=inputs, outputCol="_features"),
        trees,
    ])


def fit_prepared(train: DataFrame, numbers: list[str], categories: list[str], label: str, is_class: bool, **given) -> PipelineModel:
    return prepared_trees(numbers, categories, label, is_class, **given).fit(labelled(train, label))


def score_raw(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All columns of raw rows with ``score`` and ``pred`` (classifier) or ``pred`` (regressor); nulls are no obstacle."""
    out = model.transform(df)
    kept = [quoted(c) for c in df.columns]
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
        return out.select(*kept, score.alias("score"), threshold_label(score, threshold).alias("pred"))
    return out.select(*kept, F.col("prediction").alias("pred"))
