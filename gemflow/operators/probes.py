"""Linear readers of vectors, trained by folds of families: what a class looks like, and where a piece lies in a picture."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemflow.functions.text import hash_fold
from gemflow.session import materialise


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: every class counts as much as any other."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    shares = n.crossJoin(F.broadcast(total)).select(F.col(label).alias("_l"), (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row; one row per class
    return rows.join(F.broadcast(shares), F.col(label) == F.col("_l")).drop("_l")


def _learner(steps: int, penalty: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=steps, regParam=penalty, family="multinomial")


def train_probe(rows: DataFrame, vec: str, label: str, steps: int = 50, penalty: float = 1e-3):
    """A fitted linear softmax reader over (vec, numeric label). Rows without either take no part."""
    known = rows.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return _learner(steps, penalty).fit(weighted(known, "label"))


def read_with(model, rows: DataFrame, vec: str) -> DataFrame:
    """Add ``p``, the probabilities of all classes by number, and ``read``, the likeliest; null where there is no vector."""
    known = model.transform(rows.where(F.col(vec).isNotNull()).withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))))
    read = known.select(*rows.columns, vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("read"))
    none = rows.where(F.col(vec).isNull()).withColumn("p", F.lit(None).cast("array<double>")).withColumn("read", F.lit(None).cast("int"))
    return read.unionByName(none)


def train_by_folds(rows: DataFrame, key: str, vec: str, label: str, family: str, folds: int = 5, steps: int = 50) -> DataFrame:
    """(key, fold, label, read, p): every row read by the reader of the folds without its family.

    Families go whole into a fold, by a stable hash, so no copy of a piece is both learnt and tested. Rows without vector,
    label or family take no part.
    """
    kept = rows.where(F.col(vec).isNotNull() & F.col(label).isNotNull() & F.col(family).isNotNull())
    placed = materialise(kept.select(key, vec, F.col(label).cast("int").alias("label"), hash_fold(F.col(family).cast("string"), folds).cast("int").alias("fold")), "folds")
    out = None
    for fold in range(folds):
        model = train_probe(placed.where(F.col("fold") != fold), vec, "label", steps)
        part = read_with(model, placed.where(F.col("fold") == fold), vec).select(key, "fold", "label", "read", F.array_max("p").alias("p"))
        out = part if out is None else out.unionByName(part)
    return out
