"""Training data of names and models over their features: deficits, augmentation, fit, report, prediction."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.features import features

#: Classes by number, and what augmentation puts before or after a transliterated name.
CLASSES = ("PureASCII", "PureVietnamese", "MixedVietnamese", "TransliteratedViet", "Abbreviation", "Unknown")
PREFIXES, SUFFIXES = ("get", "set"), ("Info", "Data")
#: An augmented example's share of its source's confidence.
FADE = 0.85


def class_number(name: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, CLASSES)), name) - 1).cast("int")


def deficits(corpus: DataFrame, target: int) -> DataFrame:
    """(label, n, deficit): examples of each class, and how many it lacks."""
    counts = corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("deficit", F.greatest(F.lit(target) - F.col("n"), F.lit(0)).cast("long"))


def _drawn(digits: int, *parts) -> Column:
    """A number from a hash, so that reruns and lost tasks draw alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def augment(corpus: DataFrame, target: int = 5000) -> DataFrame:
    """corpus (id, label, confidence) and varied copies, until each class that has examples has ``target``.

    Copies are dealt evenly, in order of the ids' hashes. Of PureASCII one small letter is made
    a capital, TransliteratedViet gains a prefix or a suffix, other classes are repeated.
    Only classes with fewer than ``target`` rows are numbered, so no window is larger than that.
    """
    lack = F.broadcast(deficits(corpus, target).where("deficit > 0"))
    order = Window.partitionBy("label").orderBy(F.md5("id"), "id", "confidence")
    pool = corpus.join(lack, "label").withColumn("_rank", F.row_number().over(order) - 1)
    copies = F.floor(F.col("deficit") / F.col("n")) + F.when(F.col("_rank") < F.col("deficit") % F.col("n"), 1).otherwise(0)
    made = pool.withColumn("_k", F.explode(F.sequence(F.lit(0), copies.cast("int")))).where("_k > 0")
    at = F.pmod(_drawn(8, "id", F.col("_k").cast("string")), F.greatest(F.length("id"), F.lit(1))).cast("int")
    raised = F.concat(F.substring(F.col("id"), F.lit(1), at), F.translate(F.substring(F.col("id"), at + 1, F.lit(1)), T.LOWER, T.UPPER), F.substring(F.col("id"), at + 2, F.length("id")))
    side = F.pmod(_drawn(8, "id", F.col("_k").cast("string")), F.lit(4)).cast("int")
    named = F.when(side < 2, F.concat(F.get(F.array(*map(F.lit, PREFIXES)), side), "id")).otherwise(F.concat("id", F.get(F.array(*map(F.lit, SUFFIXES)), side - 2)))
    varied = F.when(F.col("label") == 0, raised).when(F.col("label") == 3, named).otherwise(F.col("id"))
    new = made.select(varied.alias("id"), "label", (F.col("confidence") * FADE).alias("confidence"))
    return corpus.select("id", "label", "confidence").unionByName(new)


def report(predicted: DataFrame) -> DataFrame:
    """(label, support, guesses, hits, precision, recall) of (label, predicted); the ratios are null over nothing."""
    side = predicted.select(F.col("label").alias("c"), F.lit(1).alias("s"), F.lit(0).alias("g"), (F.col("label") == F.col("predicted")).cast("int").alias("h"))
    side = side.unionByName(predicted.select(F.col("predicted").alias("c"), F.lit(0).alias("s"), F.lit(1).alias("g"), F.lit(0).alias("h")))
    sums = side.groupBy(F.col("c").alias("label")).agg(F.sum("s").alias("support"), F.sum("g").alias("guesses"), F.sum("h").alias("hits"))
    ratio = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n))
    return sums.select("*", ratio("guesses").alias("precision"), ratio("support").alias("recall"))


def scores(reported: DataFrame) -> DataFrame:
    """One row of a report: accuracy, and precision, recall and F1 averaged over classes that have examples or guesses (0 where a ratio is null)."""
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return reported.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1"))


def fold_of(name: Column, folds: int) -> Column:
    """The fold, 0 to folds-1, of an example by its id, so that reruns agree."""
    return F.pmod(_drawn(8, name), F.lit(folds)).cast("int")


def split(corpus: DataFrame, test_share: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(training, test) by ids."""
    tested = fold_of(F.col("id"), 1000) < int(1000 * test_share)
    return corpus.where(~tested), corpus.where(tested)


def cross_validate(corpus: DataFrame, folds: int = 5, **options) -> tuple[float, float]:
    """(mean, standard deviation) of macro F1 over folds, a model fitted on the other folds each time."""
    got = []
    for k in range(folds):
        held = fold_of(F.col("id"), folds) == k
        told = predict(corpus.where(held & F.col("label").between(0, 4)), fit(corpus.where(~held), **options))
        got.append(scores(report(told)).first()["f1"] or 0.0)
    mean = sum(got) / folds
    return mean, (sum((x - mean) ** 2 for x in got) / folds) ** 0.5


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("_features", array_to_vector(features(F.col("id")).cast("array<double>")))


def fit(corpus: DataFrame, trees: int = 300, depth: int = 4, rate: float = 0.08, share: float = 0.8, least_confidence: float = 0.7, seed: int = 42) -> PipelineModel:
    """Boosted trees, one against the rest, over scaled features of (id, label, confidence); rows weigh their confidence."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import StandardScaler

    rows = _vectors(corpus.where((F.col("confidence") >= least_confidence) & F.col("label").between(0, 4)).withColumn("label", F.col("label").cast("double")))
    tree = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed)
    rest = OneVsRest(classifier=tree, featuresCol="_scaled", labelCol="label", weightCol="confidence", predictionCol="_prediction")
    return Pipeline(stages=[StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True), rest]).fit(rows)


def probabilities(rows: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """rows (id, ...) with ``predicted`` and ``probabilities``, an array by class number that adds up to 1.

    Of a model: what each of its machines says of its own class, over the sum of all; all of it in the JVM. Without one: the class by the rules of names with its
    confidence, and the rest shared by the others. Ties go to the smaller number.
    """
    from pyspark.ml.functions import vector_to_array

    if model is None:
        cls = T.identifier_class(F.col("id"))
        own = T.class_confidence(cls)
        every = F.array(*[F.when(class_number(cls) == i, own).otherwise((1 - own) / 4) for i in range(5)])
        return rows.withColumn("predicted", class_number(cls)).withColumn("probabilities", every)
    scaler, rest = model.stages
    told = scaler.transform(_vectors(rows))
    for i, machine in enumerate(rest.models):
        told = machine.copy().setFeaturesCol("_scaled").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}").transform(told)
    each = F.array(*[vector_to_array(F.col(f"_p{i}"))[1] for i in range(len(rest.models))])
    total = F.aggregate("_each", F.lit(0.0), lambda x, y: x + y)
    told = told.withColumn("_each", each).withColumn("probabilities", F.transform("_each", lambda p: F.when(total > 0, p / total).otherwise(1.0 / len(rest.models))))
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return told.select(*rows.columns, best.cast("int").alias("predicted"), "probabilities")


def predict(rows: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """rows (id, ...) with ``predicted``, by the model, or by the rules of names where there is none."""
    return probabilities(rows, model).drop("probabilities")


def save(model: PipelineModel, path: str) -> None:
    """Write a model, and beside it what it is: classes, names of features, machines and their trees."""
    from .. import api

    rest = model.stages[1]
    told = {"classes": list(CLASSES[: len(rest.models)]), "features": api.FEATURE_NAMES, "machines": len(rest.models), "trees": [m.getNumTrees for m in rest.models]}
    model.write().overwrite().save(path)
    SparkSession.getActiveSession().createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.info")


def info(spark: SparkSession, path: str) -> dict:
    """What a model saved by save is."""
    return json.loads(spark.read.text(f"{path}.info").first()["value"])


def load(path: str) -> PipelineModel | None:
    """A model saved by ``model.save(path)``, wherever Spark can read it; None where there is nothing at the path."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        return PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "does not exist", "InvalidInputException", "FileNotFound")):
            return None
        raise


def export_features(corpus: DataFrame, path: str) -> None:
    """CSV with a header: 64 features, label, confidence."""
    f = corpus.select(features(F.col("id")).alias("f"), "label", "confidence")
    f.select(*[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(64)], "label", "confidence").write.option("header", True).csv(path)


def export_unlabelled(names: DataFrame, path: str) -> None:
    """JSON lines of id with label -1."""
    names.select("id", F.lit(-1).alias("label")).write.json(path)
