"""Entity and transaction metrics (EVL1-EVL4, JOI7, TXN13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_amount
from ledgerloom.operators.layout import PAGE

AMOUNT_TOLERANCE = 0.01
TARGETS = {"entity_f1": 0.90, "txn_precision": 0.95, "txn_recall": 0.90}


def _with_starts(tokens: DataFrame, tag: str, name: str) -> DataFrame:
    """``<name>_kind`` of a token (null outside entities) and ``<name>_new`` where an entity starts.

    An entity starts at a B, at an I after O, or where the type changes.
    """
    by_pos = Window.partitionBy(*PAGE).orderBy("pos")
    kind = F.col(f"{name}_kind")
    return (tokens.withColumn(f"{name}_kind", F.when(F.col(tag) != "O", F.substring(tag, 3, 20)))
            .withColumn(f"{name}_new", kind.isNotNull() & (
                F.col(tag).startswith("B-") | ~kind.eqNullSafe(F.lag(f"{name}_kind").over(by_pos)))))


def entity_spans(tokens: DataFrame, tag: str) -> DataFrame:
    """Entities of a tag column as ``type, start, end`` positions (EVL1)."""
    running = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (_with_starts(tokens, tag, "e").withColumn("_span", F.sum(F.col("e_new").cast("int")).over(running))
            .filter(F.col("e_kind").isNotNull()).groupBy(*PAGE, "_span")
            .agg(F.first("e_kind").alias("type"), F.min("pos").alias("start"), F.max("pos").alias("end")).drop("_span"))


def _scores(tp: Column, pred: Column, true: Column) -> dict[str, Column]:
    precision = F.when(pred > 0, tp / pred).otherwise(0.0)
    recall = F.when(true > 0, tp / true).otherwise(0.0)
    f1 = F.when(tp > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": f1}


def entity_report(tokens: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per entity type, and micro/macro/weighted averages (EVL2).

    Both tag columns are read in one pass: two entities are equal when they start at the same
    token with the same type and stop before the same token. Only counts per type are shuffled.
    """
    marked = _with_starts(_with_starts(tokens, true, "t"), pred, "p")
    later = Window.partitionBy(*PAGE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    stops = marked.withColumns({f"{n}_stop": F.min(F.when(F.col(f"{n}_new") | F.col(f"{n}_kind").isNull(), F.col("pos"))).over(later)
                                for n in "tp"})
    same = (F.col("t_new") & F.col("p_new") & (F.col("t_kind") == F.col("p_kind"))
            & F.col("t_stop").eqNullSafe(F.col("p_stop")))
    count = lambda n, hit: F.when(F.col(f"{n}_new"), F.struct(
        F.col(f"{n}_kind").alias("type"), hit.cast("long").alias("tp"), F.lit(int(n == "p")).cast("long").alias("pred"),
        F.lit(int(n == "t")).cast("long").alias("support")))
    entities = stops.filter("t_new or p_new").select(F.inline(F.array_compact(F.array(count("t", same), count("p", F.lit(False))))))
    by_type = entities.groupBy("type").agg(*[F.sum(c).alias(c) for c in ("tp", "pred", "support")])
    scored = by_type.select("type", "tp", "pred", "support", *[c.alias(n) for n, c in _scores(
        F.col("tp"), F.col("pred"), F.col("support")).items()])
    # All averages come from one aggregate over the few type rows.
    metrics = ("precision", "recall", "f1")
    totals = scored.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "pred", "support")], *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in metrics],
                        *[F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{m}") for m in metrics])
    micro = _scores(F.col("tp"), F.col("pred"), F.col("support"))
    row = lambda name, parts: F.struct(F.lit(name).alias("type"), *[p.alias(m) for p, m in zip(parts, metrics)], F.col("support").alias("support"))
    averages = totals.select(F.inline(F.array(
        row("micro avg", [micro[m] for m in metrics]), row("macro avg", [F.col(f"macro_{m}") for m in metrics]),
        row("weighted avg", [F.col(f"weighted_{m}") for m in metrics]))))
    return scored.select("type", *metrics, "support").union(averages)


def match_counts(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Greedy one-to-one matching per page that has truth: ``tp, fp, fn`` (JOI7).

    ``predicted``: ``stem, page, seq, date_text, amount_text``; ``truth``: ``stem, page, seq, date, amount``. Each
    truth takes the first free prediction whose date contains or is contained in its date and
    whose absolute amount is within a cent. The greedy state is a fold over one page's rows.
    """
    page = ["stem", "page"]
    preds = predicted.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.lower(F.coalesce("date_text", F.lit(""))).alias("date"),
        F.abs(parse_amount(F.coalesce("amount_text", F.lit("0")))).alias("amount")))).alias("preds"))
    truths = truth.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.lower(F.coalesce("date", F.lit(""))).alias("date"),
        F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0))).alias("amount")))).alias("truths"))
    empty = F.array().cast("array<int>")

    def take(used: Column, t: Column) -> Column:
        def free(p: Column) -> Column:
            dates = p["date"].contains(t["date"]) | t["date"].contains(p["date"])
            return ~F.array_contains(used, p["i"]) & dates & (F.abs(p["amount"] - t["amount"]) <= AMOUNT_TOLERANCE)

        hit = F.filter(F.col("_p"), free)
        return F.when(F.size(hit) > 0, F.concat(used, F.array(F.get(hit, F.lit(0))["i"]))).otherwise(used)

    indexed = F.transform("preds", lambda p, i: F.struct(i.alias("i"), p["date"].alias("date"), p["amount"].alias("amount")))
    joined = truths.join(preds, page, "left").withColumn("_p", F.coalesce(indexed, F.array().cast(
        "array<struct<i:int,date:string,amount:double>>")))
    tp = F.size(F.aggregate("truths", empty, take))
    return joined.withColumn("tp", tp).select(
        *page, "tp", (F.size("_p") - F.col("tp")).alias("fp"), (F.size("truths") - F.col("tp")).alias("fn"))


def transaction_scores(matches: DataFrame) -> DataFrame:
    """Totals and precision, recall and F1 over all pages (EVL3)."""
    sums = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    scores = _scores(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", *[F.bround(c, 4).alias(n) for n, c in scores.items()])


def target_report(entity: DataFrame, txn: DataFrame) -> DataFrame:
    """Measured value against target, PASS or BELOW TARGET (EVL4)."""
    rows = (entity.filter(F.col("type") == "micro avg").select(F.lit("entity_f1").alias("metric"), F.col("f1").alias("value"))
            .union(txn.select(F.lit("txn_precision"), "precision")).union(txn.select(F.lit("txn_recall"), "recall")))
    target = F.element_at(F.create_map(*[F.lit(v) for pair in TARGETS.items() for v in pair]), F.col("metric"))
    return rows.select("metric", "value", target.alias("target"),
                       F.when(F.col("value") > target, "PASS").otherwise("BELOW TARGET").alias("status"))


def type_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy per true type and overall (null type) (TXN13)."""
    return scored.rollup("true_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("true_type") == F.col("pred_type")).alias("correct")).withColumn(
        "accuracy", F.col("correct") / F.col("n"))
