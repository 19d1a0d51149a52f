"""Random-forest models of booking completion with Spark ML.

``fit`` is eager, as any training is; it collects one imputation value per
feature and the category lists. Everything else stays on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.functions.numbers import exact_sum, round_half_up
from ridelens.operators import learning_data as L

MISSING_CATEGORY = "nan"
MISSING_NUMBER = -1.0  # below every feature's range, so a tree can split it off


@dataclass(frozen=True)
class ForestSpec:
    """What to train. The defaults of the three named specs are the published ones."""

    features: tuple[str, ...]
    trees: int
    depth: int
    min_leaf: int = 1
    balanced: bool = True
    impute: bool = True
    payment_policy: str = "impute"
    risk_column: str = "Prebooking_Risk_Score"
    seed: int = 42

    def used_features(self) -> list[str]:
        """``payment_policy="drop"`` leaves the payment method out: it is missing for
        exactly the bookings that failed, so imputing it leaks the outcome."""
        if self.payment_policy not in ("impute", "drop"):
            raise ValueError(f"unknown payment policy: {self.payment_policy}")
        dropped = {"Payment Method"} if self.payment_policy == "drop" else set()
        return [c for c in self.features if c not in dropped]


PREBOOKING = ForestSpec(tuple(L.PREBOOKING_FEATURES), trees=200, depth=16, min_leaf=2)
WIDE = ForestSpec(
    tuple(L.WIDE_FEATURES), trees=200, depth=18, min_leaf=2,
    risk_column="Cancellation_Risk_Score",
)
# Unlimited depth in the original; 30 is the deepest Spark grows.
NOTEBOOK = ForestSpec(
    tuple(L.PREBOOKING_FEATURES), trees=300, depth=30, balanced=False, impute=False
)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def imputation_stage(train: DataFrame, spec: ForestSpec) -> SQLTransformer:
    """Gaps filled from training rows: medians for numbers, modes for categories.

    Without imputation a missing category is a category of its own, and a missing
    number takes a value below the range of the others. The values become constants of an SQL stage, so they are saved with the model.
    """
    names = [c for c in spec.used_features() if c in train.columns]
    numbers, texts = L.numeric(names), L.categorical(names)
    filled: dict[str, str] = {}
    if spec.impute:
        medians = L.impute_median(train, numbers).collect()
        modes = L.impute_mode(train, texts).collect()
        filled |= {r["Column"]: f"CAST({r['Value']!r} AS DOUBLE)" for r in medians}
        filled |= {r["Column"]: _quoted(r["Value"]) for r in modes}
    else:
        filled |= {c: _quoted(MISSING_CATEGORY) for c in texts}
        filled |= {c: str(MISSING_NUMBER) for c in numbers}
    parts = []
    for c in numbers:
        parts.append(f"COALESCE(CAST(`{c}` AS DOUBLE), {filled.get(c, 'NULL')}) AS `numeric__{c}`")
    for c in texts:
        parts.append(f"COALESCE(`{c}`, {filled.get(c, 'NULL')}) AS `categorical__{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def feature_stages(columns: Sequence[str]) -> list:
    """Sorted one-hot categories, all zeros for an unknown one, after the numbers."""
    numbers, texts = L.numeric(columns), L.categorical(columns)
    cats = [f"categorical__{c}" for c in texts]
    index = StringIndexer(
        inputCols=cats,
        outputCols=[f"{c}__index" for c in cats],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    encode = OneHotEncoder(
        inputCols=index.getOutputCols(), outputCols=[f"{c}__vector" for c in cats], dropLast=True
    )
    assemble = VectorAssembler(
        inputCols=[f"numeric__{c}" for c in numbers] + encode.getOutputCols(),
        outputCol="features",
        handleInvalid="keep",
    )
    return [index, encode, assemble]


def fit_features(train: DataFrame, spec: ForestSpec) -> PipelineModel:
    """The fitted column transformation alone."""
    columns = [c for c in spec.used_features() if c in train.columns]
    stages = [imputation_stage(train, spec), *feature_stages(columns)]
    return Pipeline(stages=stages).fit(train)


def train_forest(train: DataFrame, spec: ForestSpec) -> PipelineModel:
    """Fit features and forest on the training rows (with ``Target_Completed``).

    The rows are read many times (imputation, categories, each level of the
    trees), so they are kept on the executors for the duration of the fit.
    """
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _train_forest(train, spec)
    finally:
        train.unpersist()


def _train_forest(train: DataFrame, spec: ForestSpec) -> PipelineModel:
    prepared = fit_features(train, spec)
    # Every level of the trees is a pass over the rows: all cores should have a part.
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prepared.transform(train).select(L.TARGET, "features").repartition(parts)
    forest = RandomForestClassifier(
        labelCol=L.TARGET,
        featuresCol="features",
        numTrees=spec.trees,
        maxDepth=spec.depth,
        minInstancesPerNode=spec.min_leaf,
        featureSubsetStrategy="sqrt",
        seed=spec.seed,
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )
    if spec.balanced:
        # One row per class.
        weights = L.class_weights(train).select(L.TARGET, "Weight")
        rows = rows.join(F.broadcast(weights), L.TARGET)
        forest = forest.setWeightCol("Weight")
    model = forest.fit(rows)
    return PipelineModel([*prepared.stages, model])


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the vector slots: ``numeric__X``, then ``categorical__X_value``."""
    index = next(s for s in model.stages if hasattr(s, "labelsArray"))
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = [c for c in assembler.getInputCols() if not c.endswith("__vector")]
    for column, labels in zip(index.getInputCols(), index.labelsArray):
        names += [f"{column}_{label}" for label in labels]
    return names


def feature_importance(model: PipelineModel) -> DataFrame:
    """(Feature, Importance), largest first, rounded to six decimals."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(feature_names(model), values)]
    df = SparkSession.active().createDataFrame(rows, "Feature string, Importance double")
    return df.orderBy(F.desc("Importance"), "Feature").withColumn(
        "Importance", F.round("Importance", 6)
    )


def encoded_columns(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(Slot, Feature, Total): each transformed column's sum over the rows."""
    names = feature_names(model)
    rows = df.sparkSession.createDataFrame(list(enumerate(names)), "Slot int, Feature string")
    held = model.transform(df).select(F.posexplode(vector_to_array("features")))
    sums = held.groupBy(F.col("pos").alias("Slot")).agg(exact_sum(F.col("col")).alias("Total"))
    return rows.join(sums, "Slot", "left").orderBy("Slot")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds the predicted class and the probability of completion."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("Predicted_Completed"),
        vector_to_array("probability")[1].alias("Completion_Probability"),
    )


def prediction_report(scored: DataFrame, spec: ForestSpec, keys: Sequence[str]) -> DataFrame:
    """Scored rows with actual class, label text and risk, riskiest first."""
    p = F.col("Completion_Probability")
    return (
        scored.withColumnRenamed(L.TARGET, "Actual_Completed")
        .withColumns(
            {
                "Prediction": F.when(F.col("Predicted_Completed") == 1, "Completed").otherwise(
                    "Not Completed"
                ),
                spec.risk_column: round_half_up((1 - p) * 100, 2),
                "Completion_Probability": round_half_up(p, 4),
            }
        )
        .orderBy(F.desc(spec.risk_column), *keys)
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
