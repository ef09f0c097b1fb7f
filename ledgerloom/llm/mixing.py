"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources in code point order (null last) weigh 3, 1, 2, 3, ... and share ``SHARE`` times all words. A source's target
stops at ``CAP`` times its size; what it cannot take is shared again by weight among the others. This ends at one
level ``t`` with target ``min(CAP * size, t * weight)``, found by ordering sources by size per weight.

The mix is cut into ``BLOCKS`` blocks of equal words (of at least one word each). Seat ``j`` of a source has the
quotient ``target / (2 j - 1)``; the highest quotients win, and since a larger house only adds seats, consecutive
stretches of the ranking are output shards, each with integer quotas per source. Every source's words lie in a seeded
order of its documents; shard after shard takes the source's next blocks of them, going round at the end without a
gap. So the mix is decided by sums, and a document's share by where its words lie.

A source with a third of all rows is spread over hash bins of the seeded order; only bin sums meet per source.

Defined cases: a null text has no words and is taken zero times; null ids are ordered by the text ``null``; rows that
repeat an id or are equal are rows of their own, next to each other in the order (ties: smaller size first); an empty
table or one without a word takes nothing. Callers hand over the columns they want to keep; clashing names aren't
touched, as the frame is packed first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, materialise, running_sum, word_count
from ledgerloom.operators.scale import exact_rank

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BLOCKS, SHARDS, SEED = 1_000_000, 64, "mix-1"
RANK_BIN = 4096


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, place, source_size, target`` from ``sizes(source, source_size)``, one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
              .withColumn("ratio", cap * F.col("source_size") / F.col("weight")))
    everything = Window.partitionBy()
    upto = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = ((share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    found = (ranked.withColumn("level", level)
             .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level")))
                         .over(everything)["level"]))
    target = F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return found.select("source", "place", "source_size", target.alias("target"))


def quotas(goals: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS) -> tuple[DataFrame, int]:
    """``source, place, shard, seats`` and the words of a block, from the rows of ``targets``."""
    total, sources = goals.agg(F.sum("target"), F.count(F.lit(1))).first()
    words = max(1, -(-int(total or 0) // blocks))
    house = round((total or 0) / words)
    most = F.when(F.col("target") > 0, F.ceil(F.col("target") * ((house + sources) / max(total or 0, 1))) + 1)
    seats = goals.filter("target > 0").select("source", "place", "target", F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("j"))
    seats = seats.withColumn("quotient", F.col("target") / (2 * F.col("j") - 1))
    seats = seats.withColumn("bin", F.floor(F.lit(float(total or 0)) / (2 * F.col("quotient")) / RANK_BIN))
    ranked = exact_rank(seats, [], ["bin"], [F.col("quotient").desc(), F.col("place")], "rank")
    shard = F.floor((F.col("rank") - 1) * shards / max(house, 1)).cast("int")
    return (ranked.filter(F.col("rank") <= house).groupBy("source", "place", shard.alias("shard"))
            .agg(F.count(F.lit(1)).alias("seats"))), words


def mix(rows: DataFrame, source: str = "source", doc_id: str = "doc_id", size: str = "size",
        seed: str = SEED, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """``row`` (the given row), ``source_size, target, taken``, whole ``passes`` and the words ``[0, part)`` of one more.

    ``rows`` has a source, an id and a number of words; it is read three times and should be narrow or written.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    packed = rows.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"),
                         F.col(doc_id).alias("doc"), order.alias("order"), F.substring(order, 1, 3).alias("bin"))
    sizes = packed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialise(targets(sizes), "targets")
    seats, words = quotas(goals, blocks, shards)
    seated = seats.groupBy("place").agg(F.sum("seats").alias("seats"))
    plan = goals.join(seated, "place", "left").select(
        F.col("source").alias("_source"), "source_size", "target", (F.coalesce("seats", F.lit(0)) * words).alias("wanted"))
    some = F.col("source_size") > 0
    whole = F.when(some, F.least(F.floor(F.col("wanted") / F.col("source_size")), F.lit(CAP))).otherwise(0)
    cut = F.when(some & (F.col("passes") < CAP), F.col("wanted") - F.col("passes") * F.col("source_size")).otherwise(0)
    plan = plan.withColumn("passes", whole).withColumn("cut", cut).drop("wanted")
    placed = running_sum(packed, ["source"], ["bin"], [F.col("order"), F.col("doc").asc_nulls_last(), F.col("size")],
                         "size", "start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("start")))
    return (placed.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("part", part)
            .select("row", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"),
                    F.col("passes").cast("int").alias("passes"), F.col("part").cast("long").alias("part")))


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(rows).select("row.doc_id", "row.size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix as rows of ``docs``: a document once per whole pass, and cut after its last taken word in a last one."""
    sized = docs.select(F.struct("*").alias("_given"), F.col(source).alias("_source"), F.col(doc_id).alias("_doc"),
                        word_count(F.col(text)).alias("_size"))
    plan = mix(sized, "_source", "_doc", "_size")
    copies = F.array_repeat(F.col("row._size"), F.col("passes"))
    takes = F.when(F.col("part") > 0, F.concat(copies, F.array("part"))).otherwise(copies)
    taken = plan.select(F.col("row._given").alias("_row"), F.col("row._size").alias("_size"), F.explode(takes).alias("_take"))
    words = F.regexp_extract_all(F.col(f"_row.`{text}`"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("_take").cast("int")), "")
    cut = F.when(F.col("_take") < F.col("_size"), head).otherwise(F.col(f"_row.`{text}`"))
    return taken.withColumn("_cut", cut).select(*[
        (F.col("_cut") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
