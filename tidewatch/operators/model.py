"""The scoring pipeline: encoding, gradient-boosted trees, scores, persistence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.performance import class_weight
from tidewatch.schema import DROP_COLUMNS, TAG_COLUMNS, TARGET, column_roles, require_columns
from tidewatch.session import ensure_checkpoint_dir, stored

# Indexer, one-hot, means, assembler; the trees follow.
ENCODER_STAGES = 4
# Training rows of one task, about.
TASK_ROWS = 100_000


@dataclass(frozen=True)
class TrainConfig:
    trees: int = 200
    depth: int = 4
    learning_rate: float = 0.05
    row_fraction: float = 0.9
    column_fraction: float = 0.9
    test_size: float = 0.25
    seed: int = 42


def feature_frame(df: DataFrame) -> DataFrame:
    """Model inputs only: identifiers, simulated score, label and source tags removed."""
    require_columns(df, [*DROP_COLUMNS, TARGET])
    return df.drop(*DROP_COLUMNS, TARGET, *TAG_COLUMNS)


def feature_label(df: DataFrame) -> DataFrame:
    require_columns(df, [*DROP_COLUMNS, TARGET])
    return df.drop(*DROP_COLUMNS, *TAG_COLUMNS).withColumn(TARGET, F.col(TARGET).cast("double"))


def encoder_stages(categorical: list[str], numeric: list[str]) -> list:
    """One-hot block, then numbers. The dropped one-hot slot is the one of unseen values,
    so every known value keeps its column and an unseen or missing value gives zeros.
    Missing numbers take the training mean, as these trees cannot route them."""
    return [
        StringIndexer(
            inputCols=categorical,
            outputCols=[f"{c}_index" for c in categorical],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in categorical],
            outputCols=[f"{c}_slots" for c in categorical],
            dropLast=True,
        ),
        Imputer(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric]),
        VectorAssembler(
            inputCols=[f"{c}_slots" for c in categorical] + [f"{c}_filled" for c in numeric],
            outputCol="features",
        ),
    ]


def fit_encoder(df: DataFrame) -> PipelineModel:
    """The encoder alone, fitted on all rows of ``df``."""
    return Pipeline(stages=encoder_stages(*column_roles(feature_frame(df)))).fit(df)


def encoder_names(model: PipelineModel) -> list[str]:
    """Slot names: ``<column>_<value>`` for categories, the column name for numbers."""
    indexer, _, imputer = model.stages[:3]
    slots = [
        f"{c}_{value}"
        for c, values in zip(indexer.getInputCols(), indexer.labelsArray)
        for value in values
    ]
    return slots + list(imputer.getInputCols())


def train(df: DataFrame, config: TrainConfig = TrainConfig()) -> PipelineModel:
    """Fit encoder and trees on labelled rows, positives weighted by the class ratio."""
    ensure_checkpoint_dir(df.sparkSession)  # boosting cuts its lineage there
    categorical, numeric = column_roles(feature_frame(df))
    # The class ratio, the labels, the means and the trees each pass over the rows.
    data = stored(feature_label(df), "training")
    ratio = class_weight(data).select("scale_pos_weight").scalar()
    weighted = data.withColumn(
        "_weight", F.when(F.col(TARGET) == 1, F.coalesce(ratio, F.lit(1.0))).otherwise(F.lit(1.0))
    )
    trees = GBTClassifier(
        labelCol=TARGET,
        featuresCol="features",
        weightCol="_weight",
        maxIter=config.trees,
        maxDepth=config.depth,
        stepSize=config.learning_rate,
        subsamplingRate=config.row_fraction,
        featureSubsetStrategy=str(config.column_fraction),
        seed=config.seed,
    )
    encoder = Pipeline(stages=encoder_stages(categorical, numeric)).fit(weighted)
    encoded = encoder.transform(weighted).select(TARGET, "_weight", "features")
    return PipelineModel([*encoder.stages, trees.fit(_dealt(encoded, data.count()))])


def _dealt(encoded: DataFrame, rows: int) -> DataFrame:
    """Many rows in tasks of about ``TASK_ROWS``: the trees keep every encoded row, several times as wide
    as the stored one whose size sets the tasks of a scan."""
    if rows <= TASK_ROWS * encoded.sparkSession.sparkContext.defaultParallelism:
        return encoded
    return encoded.repartition(-(-rows // TASK_ROWS))


def score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 as a new column; the input columns are kept as they are."""
    return model.transform(df).select(
        *df.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(name)
    )


def transform_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The encoded row as a dense array, without running the trees."""
    encoded = PipelineModel(model.stages[:ENCODER_STAGES]).transform(df)
    return encoded.select(*df.columns, vector_to_array("features").alias("features"))


def feature_sums(model: PipelineModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and encoded feature: the sum of its cells and how many of them are not 0.

    Vectors are added up as they are, inside the tasks first; rows are never taken apart by feature.
    """
    encoded = PipelineModel(model.stages[:ENCODER_STAGES]).transform(df).groupBy(*keys)
    sums = encoded.agg(Summarizer.metrics("sum", "numNonZeros").summary(F.col("features")).alias("s"))
    names = F.array(*[F.lit(c) for c in encoder_names(model)])
    cells = F.arrays_zip(
        names.alias("feature"),
        vector_to_array("s.sum").alias("total"),
        F.transform(vector_to_array("s.numNonZeros"), lambda x: x.cast("long")).alias("nonzero"),
    )
    return sums.select(*keys, F.inline(cells))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
