"""A trained link predictor: one message-passing step over node vectors, then a logistic model of node pairs."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vocabulary as V
from skein.operators import graph as G
from skein.session import cut


def node_features(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(name, x): a node's vector and type, and the mean of its neighbours' vectors. ``nodes``: name, type, vec."""
    typed = nodes.select("name", F.concat("vec", G.one_hot(F.col("type"), V.ENTITY_TYPES)).alias("vec"))
    sent = G.message_features(typed, adj)
    zero = F.transform("own", lambda v: F.lit(0.0))
    return sent.select("name", F.concat("own", F.coalesce("mean", zero)).alias("x"))


def pair_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs with the element-wise product of their ends' features; symmetric in the ends."""
    side = lambda s: features.select(F.col("name").alias(s), F.col("x").alias(f"x_{s}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.withColumn("features", array_to_vector(F.zip_with("x_u", "x_v", lambda a, b: a * b))).drop("x_u", "x_v")


def train(pos: DataFrame, neg: DataFrame, features: DataFrame, reg: float = 0.01) -> LogisticRegressionModel:
    """A model from linked and unlinked pairs (u, v)."""
    rows = pos.select("u", "v", F.lit(1.0).alias("label")).unionByName(neg.select("u", "v", F.lit(0.0).alias("label")))
    return LogisticRegression(regParam=reg, maxIter=50).fit(cut(pair_features(rows, features).select("label", "features")))


def score(model: LogisticRegressionModel, pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs with the probability of a link."""
    found = model.transform(pair_features(pairs, features))
    return found.withColumn("score", vector_to_array("probability")[1]).withColumn("method", F.lit("sage_logistic")).drop("features", "rawPrediction", "probability", "prediction")


def save(model: LogisticRegressionModel, path: str, embedder: str, metrics: dict[str, float]) -> None:
    """The model, and beside it what it was trained with."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(embedder, metrics)], "embedder string, metrics map<string,double>").coalesce(1).write.mode("overwrite").json(f"{path}.about")


def load(path: str, embedder: str) -> LogisticRegressionModel | None:
    """A saved model if there is one for this embedder; without one predictions fall back to shared neighbours."""
    spark = SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.about")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    about = spark.read.schema("embedder string").json(f"{path}.about").first()
    return LogisticRegressionModel.load(path) if about and about["embedder"] == embedder else None
