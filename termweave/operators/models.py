"""Models on phrase features and embeddings."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.vectors import dot
from termweave.operators import tfidf
from termweave.operators.compare import class_weights
from termweave.operators.skew import salted_join
from termweave.session import durable, release


@dataclass(frozen=True)
class TextClassifier:
    """A logistic regression on TF-IDF: `idf(phrase_id, idf)`, `coefficients(phrase_id, weight)`, intercept and the idf of phrases not met in the fit."""

    idf: DataFrame
    coefficients: DataFrame
    intercept: float
    unseen_idf: float

    def features(self, docs: DataFrame, key: str, text: str, vocab) -> DataFrame:
        """`(key, phrase_id, tf, idf, tfidf)` with the idf of the fit."""
        counts = tfidf.term_counts(docs, key, text, vocab)
        known = tfidf.by_phrase(counts, self.idf, vocab, "left")
        return tfidf.scaled(known.withColumn("idf", F.coalesce("idf", F.lit(self.unseen_idf))), key)


#: Rows of one phrase that meet in a task while gradients are taken; more frequent phrases are cut by document.
ROWS_PER_PIECE = 1_000_000


def fit_text_classifier(docs: DataFrame, key: str, text: str, label: str, vocab, reg_param: float = 0.01, steps: int = 30) -> TextClassifier:
    """Logistic regression on length-normalised TF-IDF of the vocabulary phrases; `key` must be unique.

    Takes a fixed number of accelerated gradient steps from zero on the mean loss plus
    `reg_param / 2` times the squared coefficients. Where the vocabulary was measured to be
    small, a step sends the coefficients to every task, which adds its documents' slopes.
    Otherwise coefficients are rows by phrase from start to end: a step joins them with the
    documents' values and adds the slopes on the map side, and only the intercept and the
    number of documents reach the driver. Rows without a label are left out; without any
    row all coefficients are zero.
    """
    docs = docs.where(F.col(label).isNotNull())
    counts = durable(tfidf.term_counts(docs, key, text, vocab))
    if vocab.size().fits():
        return _fit_sent(docs, key, label, counts, reg_param, steps)
    frequency = durable(tfidf.document_frequency(counts, docs).select("phrase_id", "idf", F.ceil(F.col("df") / ROWS_PER_PIECE).cast("int").alias("pieces")))
    targets = durable(docs.select(key, F.col(label).cast("double").alias("_label")))
    n = targets.count()
    scaled = tfidf.scaled(salted_join(counts, frequency, "phrase_id"), key).select(key, "phrase_id", "tfidf")
    piece = F.pmod(F.xxhash64(key), F.col("pieces")).cast("int")
    values = durable(salted_join(scaled, frequency.select("phrase_id", "pieces"), "phrase_id").select(key, "phrase_id", piece.alias("piece"), "tfidf"))
    # The intercept is the row without a phrase.
    rows = frequency.select("phrase_id", "pieces").unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("phrase_id"), F.lit(0).alias("pieces")))
    state = durable(rows.select("phrase_id", "pieces", F.lit(0.0).alias("weight"), F.lit(0.0).alias("ahead")))
    for _ in range(steps):
        following = durable(_gradient_step(values, targets, state, key, max(n, 1), reg_param))
        release(state)
        state = following
    intercept = state.where("phrase_id IS NULL").first()["weight"]
    release(counts, values, targets)
    coefficients = state.where("phrase_id IS NOT NULL").select("phrase_id", "weight")
    return TextClassifier(frequency.select("phrase_id", "idf"), coefficients, float(intercept), math.log(1.0 + n) + 1)


def _fit_sent(docs: DataFrame, key: str, label: str, counts: DataFrame, reg_param: float, steps: int) -> TextClassifier:
    """The fit over a vocabulary whose size was checked; one row per key, with its number of labels, their sum and its phrases."""
    spark = docs.sparkSession
    frequency = durable(tfidf.document_frequency(counts, docs).select("phrase_id", "idf"))
    scaled = tfidf.scaled(counts.join(F.broadcast(frequency), "phrase_id"), key)
    vectors = scaled.groupBy(key).agg(F.collect_list(F.struct("phrase_id", "tfidf")).alias("_x"))
    targets = docs.groupBy(key).agg(F.count(F.lit(1)).alias("labels"), F.sum(F.col(label).cast("double")).alias("total"))
    values = durable(targets.join(vectors, key, "left").select("labels", "total", F.col("_x.phrase_id").alias("ids"), F.col("_x.tfidf").alias("x")))
    n = values.agg(F.coalesce(F.sum("labels"), F.lit(0)).alias("n")).first()["n"]
    ids = np.sort(frequency.select("phrase_id").toArrow()["phrase_id"].to_numpy())
    steepest = 0.5 + reg_param
    flat = math.sqrt(reg_param / steepest)
    # The intercept stands behind the phrases and is not held back.
    penalty = np.append(np.full(len(ids), reg_param), 0.0)
    weight, ahead = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((ids, ahead))
        found = values.mapInArrow(_slopes(shared), "place long, slope double").groupBy("place").agg(F.sum("slope").alias("slope")).toArrow()
        slope = np.zeros(len(ids) + 1)
        slope[found["place"].to_numpy()] = found["slope"].to_numpy()
        moved = ahead - (slope / max(n, 1) + penalty * ahead) / steepest
        weight, ahead = moved, moved + (1 - flat) / (1 + flat) * (moved - weight)
        shared.unpersist()
    release(counts, values)
    coefficients = spark.createDataFrame(pa.table({"phrase_id": pa.array(ids, pa.int64()), "weight": weight[:-1]}))
    return TextClassifier(frequency, coefficients, float(weight[-1]), math.log(1.0 + n) + 1)


def _slopes(shared):
    """Per partition one row for each place with a slope of the summed loss."""

    def run(batches):
        ids, ahead = shared.value
        slope = np.zeros(len(ids) + 1)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.searchsorted(ids, batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            margin = np.bincount(row, x * ahead[place], batch.num_rows) + ahead[-1]
            error = batch.column("labels").to_numpy() / (1 + np.exp(-margin)) - batch.column("total").to_numpy()
            slope[:-1] += np.bincount(place, x * error[row], len(ids))
            slope[-1] += error.sum()
        own = np.flatnonzero(slope)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(slope[own])], names=["place", "slope"])

    return run


def _gradient_step(values: DataFrame, targets: DataFrame, state: DataFrame, key: str, n: int, reg_param: float) -> DataFrame:
    """The next `(phrase_id, pieces, weight, ahead)`; slopes are taken at `ahead`, where the momentum has carried the weights.

    Documents have length one, so the slope of the mean loss with its intercept changes
    by at most half the way, and a step of one over that and the penalty cannot diverge.
    """
    steepest = 0.5 + reg_param
    flat = math.sqrt(reg_param / steepest)
    momentum = (1 - flat) / (1 + flat)
    copies = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    spread = state.where("phrase_id IS NOT NULL").select("phrase_id", "ahead", copies)
    margins = values.join(spread, ["phrase_id", "piece"]).groupBy(key).agg(F.sum(F.col("tfidf") * F.col("ahead")).alias("_margin"))
    intercept = state.where("phrase_id IS NULL").select("ahead").scalar()
    chance = 1 / (1 + F.exp(-(F.coalesce("_margin", F.lit(0.0)) + intercept)))
    errors = targets.join(margins, key, "left").select(key, (chance - F.col("_label")).alias("_error"))
    slopes = values.join(errors, key).groupBy("phrase_id").agg(F.sum(F.col("tfidf") * F.col("_error")).alias("_slope"))
    slopes = slopes.unionByName(errors.agg(F.sum("_error").alias("_slope")).withColumn("phrase_id", F.lit(None).cast("long")))
    met = state.join(slopes.withColumnRenamed("phrase_id", "_phrase"), F.col("phrase_id").eqNullSafe(F.col("_phrase")), "left")
    penalty = F.when(F.col("phrase_id").isNull(), 0.0).otherwise(F.col("ahead") * reg_param)
    moved = F.col("ahead") - (F.coalesce("_slope", F.lit(0.0)) / n + penalty) / steepest
    stepped = met.select("phrase_id", "pieces", F.col("weight").alias("_before"), moved.alias("weight"))
    return stepped.select("phrase_id", "pieces", "weight", (F.col("weight") + momentum * (F.col("weight") - F.col("_before"))).alias("ahead"))


def linear_scores(features: DataFrame, key: str, coefficients: DataFrame, intercept: float, vocab=None) -> DataFrame:
    """`(key, probability)` of the positive class from `features(key, phrase_id, tfidf)`.

    Products are summed on the map side; frequent phrases are cut into pieces, unless `vocab`
    is given and small: then the coefficients of its phrases are sent to every task.
    """
    values = features.select(key, "phrase_id", "tfidf")
    products = tfidf.by_phrase(values, coefficients, vocab, "left") if vocab else salted_join(values, coefficients, "phrase_id", "left")
    margin = F.coalesce(F.sum(F.col("tfidf") * F.col("weight")), F.lit(0.0)) + intercept
    return products.groupBy(key).agg((1 / (1 + F.exp(-margin))).alias("probability"))


def score_texts(model: TextClassifier, docs: DataFrame, key: str, text: str, vocab) -> DataFrame:
    """`(key, prediction, probability)` of the positive class; without a known phrase the intercept decides."""
    scored = linear_scores(model.features(docs, key, text, vocab), key, model.coefficients, model.intercept, vocab)
    nothing = 1 / (1 + math.exp(-model.intercept))
    probability = F.coalesce("probability", F.lit(nothing))
    joined = docs.select(key).join(scored, key, "left").select(key, probability.alias("probability"))
    return joined.select(key, (F.col("probability") > 0.5).cast("int").alias("prediction"), "probability")


def fit_source_classifier(
    df: DataFrame,
    key: str,
    embedding: str,
    label: str,
    grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0),
    folds: int = 5,
    balanced: bool = False,
    iterations: int = 20,
) -> tuple[OneVsRestModel, DataFrame]:
    """Linear one-versus-rest classifier on embeddings with a cross-validated grid.

    Returns the best model and, for the held-out fifth, `(key, label, predicted)` with
    the names of the classes. The fifth and the folds follow from a hash of `key`, so
    they do not depend on partitions. `iterations` bounds the solver, not the data.
    """
    place = F.pmod(F.xxhash64(key), F.lit(5 * folds))
    df = df.withColumn("_held", place % 5 == 0).withColumn("_fold", F.floor(place / 5).cast("int"))
    data = df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    if balanced:
        data = data.join(class_weights(data, label).select(label, "weight"), label)
    names = StringIndexer(inputCol=label, outputCol="class", stringOrderType="alphabetAsc").fit(data)
    indexed = names.transform(data)
    train, test = durable(indexed.where(~F.col("_held"))), indexed.where("_held")
    svc = LinearSVC(maxIter=iterations)
    ovr = OneVsRest(classifier=svc, labelCol="class", featuresCol="features", parallelism=3)
    if balanced:
        ovr = ovr.setWeightCol("weight")
    params = ParamGridBuilder().addGrid(svc.regParam, list(grid)).build()
    # OneVsRest keeps its classifier's parameters, so the grid varies whole classifiers.
    params = [{ovr.classifier: svc.copy(p)} for p in params]
    judge = MulticlassClassificationEvaluator(labelCol="class", metricName="accuracy")
    search = CrossValidator(estimator=ovr, estimatorParamMaps=params, evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=4)
    best = search.fit(train).bestModel
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels).transform(best.transform(test))
    return best, named.select(key, label, "predicted")


def covariance(df: DataFrame, embedding: str) -> DataFrame:
    """`(i, j, covariance)` of the components of a vector column, places from 1, both halves.

    Every task adds its vectors' products in one matrix per batch, so that a partition
    sends one row per pair of components, whatever the number of vectors. Null vectors,
    those with null or non-finite components and those of another length than the first
    non-null one are left out. Under two vectors there are no rows.
    """
    vectors = df.select(F.col(embedding).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    first = vectors.select(F.size("v").alias("n")).first()
    size = first["n"] if first else 1
    sums = vectors.where((F.size("v") == size) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    # The first vector as origin: products of values far from zero would lose digits.
    origin = sums.first()
    if origin is None:
        return df.sparkSession.createDataFrame([], "i int, j int, covariance double")
    added = sums.mapInArrow(_products(origin["v"]), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    # Place 0 stands for the number one: (0, 0) counts the vectors, (i, 0) adds the components.
    n = added.where("i = 0 AND j = 0").select("total").scalar()
    means = added.where("j = 0 AND i > 0").select("i", F.col("total").alias("sum"))
    both = added.where("i > 0 AND j > 0").join(means, "i").join(means.select(F.col("i").alias("j"), F.col("sum").alias("sum_j")), "j")
    counted = both.withColumn("n", n).where("n > 1")
    return counted.select("i", "j", ((F.col("total") - F.col("sum") * F.col("sum_j") / F.col("n")) / (F.col("n") - 1)).alias("covariance"))


def _products(origin: list[float]):
    def run(batches):
        size = len(origin)
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - np.array(origin)
            one = np.hstack([np.ones((len(flat), 1)), flat])
            total += one.T @ one
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "total"])

    return run


def principal_components(df: DataFrame, key: str, embedding: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """`(key, pc1 … pck)`, coordinates on the first principal components, and the share of the variance each explains.

    The matrix of covariances, whose size is that of one vector squared, is decomposed on the
    driver. A component's largest entry is positive, so that signs do not depend on the
    solver. Vectors that `covariance` leaves out have null coordinates.
    """
    rows = covariance(df, embedding).collect()
    if not rows:
        return df.select(key, *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(k)]), [0.0] * k
    size = max(r["i"] for r in rows)
    matrix = np.zeros((size, size))
    for r in rows:
        matrix[r["i"] - 1, r["j"] - 1] = r["covariance"]
    values, vectors = np.linalg.eigh(matrix)
    top = vectors[:, ::-1][:, :k].T
    top *= np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
    vector = F.col(embedding).cast("array<double>")
    valid = (F.size(vector) == size) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    placed = df.select(key, *[F.when(valid, dot(vector, F.array(*[F.lit(float(x)) for x in axis]))).alias(f"pc{i + 1}") for i, axis in enumerate(top)])
    means = placed.agg(F.array(*[F.avg(f"pc{i + 1}") for i in range(len(top))]).alias("m")).scalar()
    centred = placed.withColumn("_m", means).select(key, *[(F.col(f"pc{i + 1}") - F.col("_m")[i]).alias(f"pc{i + 1}") for i in range(len(top))])
    variance = float(values.sum())
    return centred, [float(x) / variance if variance > 0 else 0.0 for x in values[::-1][:k]]
