"""Learned typing and tagging with MLlib (TXN9, TXN11, TXN12, TAG10)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.operators.layout import token_shapes

TEXT_TERMS = 50
#: A word of two letters, digits or underscores or more, in any script.
TERM = r"[\p{L}\p{N}_]{2,}"
LAYERS = [64, 32]


def _terms(samples: DataFrame) -> DataFrame:
    """``terms`` of a description: its words of two letters or more without stop words, then its pairs of such words."""
    found = F.regexp_extract_all(F.lower(F.coalesce("description", F.lit(""))), F.lit(TERM), F.lit(0))
    words = samples.withColumn("_words", F.filter(found, lambda w: ~w.isin(lx.STOP_WORDS)))
    following = F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 1, F.lit(0)))
    pairs = F.filter(F.zip_with("_words", following, lambda one, two: F.concat(one, F.lit(" "), two)), lambda pair: pair.isNotNull())
    return words.withColumn("terms", F.concat("_words", pairs)).drop("_words")


def fit_text_terms(samples: DataFrame, size: int = TEXT_TERMS) -> list[tuple[str, float]]:
    """The ``size`` most frequent words and word pairs, ties by code point, each with its weight: inverse document frequency + 1.

    Counts are over all samples and combined before the shuffle; only the vocabulary, ``size`` rows, comes to the driver.
    """
    counted = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), (
        F.size("terms") - F.size(F.array_remove("terms", t))).alias("tf")))
    terms = _terms(samples).select(F.inline(counted)).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("texts"))
    weight = F.log((F.lit(samples.count()) + 1) / (F.col("texts") + 1)) + 1
    return [(r.term, r.weight) for r in terms.orderBy(F.desc("n"), "term").limit(size).select("term", weight.alias("weight")).collect()]


def type_features(samples: DataFrame, terms: list[tuple[str, float]]) -> DataFrame:
    """Feature vector per transaction (TXN11): sign, size, page, ten word flags, text terms.

    Text weights are counts times the weights of ``fit_text_terms``, with unit length; a description without any of the
    terms, or null, has zeros.
    """
    counts = [(F.size("terms") - F.size(F.array_remove("terms", term))) * F.lit(weight) for term, weight in terms]
    weighted = _terms(samples).withColumn("_raw", F.array(*counts).cast("array<double>"))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, v: s + v * v))
    text = F.when(F.col("_norm") > 0, F.transform("_raw", lambda v: v / F.col("_norm"))).otherwise(F.col("_raw"))
    lower = F.lower(F.coalesce("description", F.lit("")))
    amount = F.col("amount").cast("double")
    flags = [lower.contains(w).cast("double") for w in lx.MODEL_DEBIT_WORDS + lx.MODEL_CREDIT_WORDS]
    row = F.array((amount < 0).cast("double"), F.log1p(F.abs(amount)), F.coalesce("page", F.lit(0)) / 20.0, *flags)
    return weighted.withColumn("_norm", norm).select(*samples.columns, array_to_vector(F.concat(row, text)).alias("features"))


def fit_typing(featured: DataFrame, network: bool = False) -> PipelineModel:
    """Credit/debit classifier on ``features, type`` (TXN12).

    Debits are weighted by credits/debits; ``network=True`` fits the two-layer network instead,
    which has no class weights.
    """
    labelled = featured.withColumn("label", (F.col("type") == "debit").cast("double"))
    if network:
        size = featured.select(F.size(vector_to_array("features"))).first()[0]
        stage = MultilayerPerceptronClassifier(layers=[size, *LAYERS, 2], seed=42, maxIter=30)
        return Pipeline(stages=[stage]).fit(labelled)
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("credit"), F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("debit"),
        F.lit(1).alias("_one"))
    weight = F.when(F.col("label") == 1, F.coalesce("credit", F.lit(0)) / F.greatest(F.coalesce("debit", F.lit(0)), F.lit(1))).otherwise(1.0)
    weighted = labelled.withColumn("_one", F.lit(1)).join(F.broadcast(counts), "_one").withColumn("weight", weight)
    return Pipeline(stages=[LogisticRegression(weightCol="weight", maxIter=20)]).fit(weighted)


def predict_types(featured: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``model_type`` and its probability ``model_prob`` (TXN9)."""
    debit = F.get(vector_to_array("probability"), F.lit(1))
    return (model.transform(featured)
            .withColumn("model_type", F.when(debit > 0.5, "debit").otherwise("credit"))
            .withColumn("model_prob", F.bround(F.when(debit > 0.5, debit).otherwise(1 - debit), 4))
            .drop("rawPrediction", "probability", "prediction", "features"))


def token_features(tokens: DataFrame) -> DataFrame:
    """Shape and position features per token."""
    shaped = token_shapes(tokens)
    size = F.length("text")
    flags: dict[str, Column] = {
        "_date": F.col("is_date"), "_month": F.col("is_month"), "_amount": F.col("is_amount"),
        "_digits": F.col("text").rlike(r"^\d+$"), "_upper": F.col("text") == F.upper("text"), "_alpha": F.col("text").rlike(r"^[A-Za-z]+$"),
        "_left": F.col("x0") < 100, "_desc": (F.col("x0") >= 100) & (F.col("x0") < 650), "_right": F.col("x0") >= 800}
    staged = shaped.select(*tokens.columns, *[F.coalesce(c, F.lit(False)).cast("double").alias(n) for n, c in flags.items()],
                           (F.col("x0") / 1000).alias("_x"), (F.col("top") / 1000).alias("_y"), (size / 20).alias("_len"))
    names = [*flags, "_x", "_y", "_len"]
    return VectorAssembler(inputCols=names, outputCol="features").transform(staged).drop(*names)


def with_weights(featured: DataFrame, weights: DataFrame) -> DataFrame:
    """The ``weight`` of each token's ``true_tag``.

    The nine weights are broadcast: dealt by tag, tokens would lie in nine partitions, one of them with most of them.
    """
    return featured.join(F.broadcast(weights.withColumnRenamed("tag", "true_tag")), "true_tag")


def fit_tagger(featured: DataFrame, weights: DataFrame) -> PipelineModel:
    """Token tagger on ``features, true_tag`` with class ``weights`` per tag (TAG10)."""
    weighted = with_weights(featured, weights)
    return Pipeline(stages=[
        StringIndexer(inputCol="true_tag", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        LogisticRegression(family="multinomial", weightCol="weight", maxIter=15)]).fit(weighted)


def predict_tags(featured: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``tag`` and ``conf`` per token (TAG10)."""
    names = F.array(*[F.lit(n) for n in model.stages[0].labels])
    probability = vector_to_array("probability")
    scored = model.stages[1].transform(featured)
    return (scored.withColumn("tag", F.coalesce(F.get(names, F.col("prediction").cast("int")), F.lit("O")))
            .withColumn("conf", F.array_max(probability)).drop("rawPrediction", "probability", "prediction", "features"))
