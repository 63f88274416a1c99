"""A text classifier on hashed word n-grams: train, predict, save, load."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import class_name

# The classifier's parameters.
EPOCHS = 25
NGRAMS = 2
BUCKETS = 2**21


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``rows / (classes * rows of the class)``, one row per class present."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("count"))
    totals = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    n, k = totals.select("n").scalar(), totals.select("k").scalar()
    return counts.withColumn("weight", n / (k * F.col("count")))


def weight_ratio(weights: DataFrame, label: str = "label") -> DataFrame:
    """How much more a row of class 1 weighs than one of class 0."""
    one = F.max(F.when(F.col(label) == 1, F.col("weight")))
    zero = F.max(F.when(F.col(label) == 0, F.col("weight")))
    return weights.agg((one / zero).alias("ratio"))


def attach_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` for the classes 0 and 1: one counting pass, and no join with the documents."""
    zero, one = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    classes = (zero > 0).cast("int") + (one > 0).cast("int")

    def balanced(count):
        return F.when(count > 0, (zero + one) / (classes * count))

    weights = df.agg(F.struct(balanced(zero).alias("zero"), balanced(one).alias("one")).alias("w")).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, weights["one"]).otherwise(weights["zero"]))


def train_text_classifier(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    weights: bool = True,
    max_iter: int = EPOCHS,
    reg: float = 1e-4,
) -> PipelineModel:
    """Fit hashed word 1..n-grams with logistic regression. Runs jobs.

    The learner reads its input twice before it iterates on its own blocks, so the
    hashed features are kept until it is done; what is lost is computed again.
    """
    stages = [RegexTokenizer(inputCol=text, outputCol="_w1", pattern=r"\s+", toLowercase=False)]
    stages += [NGram(n=n, inputCol="_w1", outputCol=f"_w{n}") for n in range(2, ngrams + 1)]
    grams = ", ".join(f"_w{n}" for n in range(1, ngrams + 1))
    stages.append(SQLTransformer(statement=f"SELECT *, concat({grams}) AS _grams FROM __THIS__"))
    stages.append(HashingTF(numFeatures=buckets, inputCol="_grams", outputCol="_features"))
    learner = LogisticRegression(
        featuresCol="_features",
        labelCol="_label",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_class",
        maxIter=max_iter,
        regParam=reg,
    )
    data = df.where(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("double"))
    if weights:
        data = attach_weights(data, label)
        learner = learner.setWeightCol("weight")
    features = PipelineModel(stages)
    inputs = ["_features", "_label", *(["weight"] if weights else [])]
    hashed = features.transform(data).select(*inputs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = learner.fit(hashed)
    finally:
        hashed.unpersist()
    return PipelineModel([*stages, fitted])


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the probability of both classes, the class at the threshold and its name."""
    scored = model.transform(df).withColumn("_p", vector_to_array("_probability"))
    p = F.get("_p", F.lit(1))
    hit = (p >= threshold).cast("int")
    return scored.select(
        *df.columns,
        F.get("_p", F.lit(0)).alias("nonai_probability"),
        p.alias("ai_probability"),
        hit.alias("predicted_label"),
        class_name(hit).alias("predicted_class"),
    )


def save_model(model: PipelineModel, threshold: DataFrame, path: str) -> str:
    """Write the model and, next to it, the one-row table of its operating threshold."""
    model.write().save(f"{path}/model")
    threshold.coalesce(1).write.json(f"{path}/optimal_threshold")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    schema = "threshold double, recall double, precision double, f1 double"
    return PipelineModel.load(f"{path}/model"), spark.read.schema(schema).json(f"{path}/optimal_threshold")
