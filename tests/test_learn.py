"""Text features of the typing model against a plain count."""

import math
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions import lexicon as lx
from ledgerloom.operators import learn as ml
from ledgerloom.operators import scale, tagging
from ledgerloom.sources import derive as dv

SMALL = "/root/testdata/sf0.001"

SCHEMA = "k long, amount decimal(18,2), page int, description string"


def plain_terms(text):
    words = [w for w in re.findall(r"\w\w+", (text or "").lower()) if w not in lx.STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("size", [3, 8, 100])
def test_text_features_equal_a_plain_count(spark, size):
    texts = ["ACH Deposit deposit payroll", "the fee of a wire", None, "", "zz yy", "yy zz", "fee fee fee x", "a I the",
             "Deposit " * 300, "café deposit-fee 12.50"]
    samples = spark.createDataFrame([(k, None if k == 4 else Decimal(k - 3), None if k % 2 else k, text) for k, text in enumerate(texts)], SCHEMA)
    total, held = Counter(), Counter()
    for text in texts:
        total.update(plain_terms(text))
        held.update(set(plain_terms(text)))
    chosen = sorted(total, key=lambda t: (-total[t], t))[:size]
    vocabulary = ml.fit_text_terms(samples, size)
    assert [t for t, _ in vocabulary] == chosen
    assert [w for _, w in vocabulary] == pytest.approx([math.log((len(texts) + 1) / (held[t] + 1)) + 1 for t in chosen])
    weight = dict(vocabulary)
    got = {r.k: list(r.features) for r in ml.type_features(samples.filter("amount is not null"), vocabulary).select("k", ml.vector_to_array("features").alias("features")).collect()}
    for k, text in enumerate(texts):
        if k != 4:
            counts = Counter(plain_terms(text))
            raw = [counts[t] * weight[t] for t in chosen]
            norm = math.sqrt(sum(v * v for v in raw))
            assert got[k][13:] == pytest.approx([v / norm if norm else 0.0 for v in raw])
            assert got[k][:3] == pytest.approx([float(k < 3), math.log1p(abs(k - 3)), 0.0 if k % 2 else k / 20])


def test_no_samples_have_no_terms(spark):
    samples = spark.createDataFrame([], SCHEMA)
    assert ml.fit_text_terms(samples) == [] and ml.type_features(samples, []).count() == 0


def test_tokens_are_not_dealt_by_tag(spark):
    tokens = spark.range(50_000).select("id", F.when(F.col("id") % 10 < 8, "O").otherwise("B-DATE").alias("true_tag"))
    histogram = tokens.groupBy(F.col("true_tag").alias("tag")).agg((F.count(F.lit(1)) / 50_000).alias("weight"))
    plan = ml.with_weights(tokens, histogram)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tagger_facts_count_every_token(spark):
    rows = entry.queries()["tag10_model_facts"](spark, SMALL).collect()
    assert sum(r.n for r in rows) == dv.statement_tokens(spark, SMALL).count()


def test_tasks_hold_a_bounded_number_of_rows(spark, tmp_path):
    """Whole statements, about as many orders in a task however many there are; adaptive execution would join them up."""
    for rows, parts in ((3_000, 1), (90_000, 4), (700_000, 6)):
        folder = tmp_path / str(rows)
        spark.read.parquet(f"{SMALL}/orders.parquet").limit(1).drop("o_orderkey").crossJoin(
            spark.range(rows).withColumnRenamed("id", "o_orderkey")).write.parquet(str(folder / "orders.parquet"))
        tasks = dv.statement_txns(spark, str(folder)).groupBy("stem", F.spark_partition_id().alias("task")).count().groupBy("task").agg(
            F.sum("count").alias("n"), F.max("count").alias("largest")).collect()
        assert len(tasks) == parts and sum(t.n for t in tasks) == rows and max(t.n for t in tasks) < 1.5 * scale.ROWS_PER_TASK
        assert min(t.largest for t in tasks) == 100


def test_token_tasks_are_smaller_and_sorted_less(spark, tmp_path):
    """Tokens are dealt by half as many orders as transactions; rule tags and the decoder need no sort of their own for page windows."""
    spark.read.parquet(f"{SMALL}/orders.parquet").limit(1).drop("o_orderkey").crossJoin(
        spark.range(650_000).withColumnRenamed("id", "o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    tokens = dv.statement_tokens(spark, str(tmp_path))
    assert re.findall(r"hashpartitioning\(stem#\d+, (\d+)\), REPARTITION_BY_NUM", plan(tokens)) == ["11"]
    own = plan(tokens).count("Sort [")
    assert plan(tagging.rule_tags(tokens)).count("Sort [") == own + 2
    predicted = tokens.withColumn("tag", F.col("pred_tag")).repartition(3, "stem")
    assert plan(tagging.decode(predicted)).count("Sort [") == own + 2
