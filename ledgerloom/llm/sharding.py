"""Sharding by balanced label propagation.

Documents with equal texts are linked through a hub per text; a hub of more documents than a shard holds is cut into
parts that fit. All linked documents are laid out hub by hub and the line is cut into shards of equal counts, so a hub
starts in one shard or lies across a cut. Then labels propagate: in each round every hub in several shards picks the
one where most of its documents could meet, counted with the room of that shard, and the hub's documents in its other
shards move there, shard by shard, while they fit the quota. What leaves a shard is room in the next round. Every move
joins two pieces of a hub for good, so rounds end when nothing moves, without a limit on their number. Quotas are the
exact row counts with some slack; at the end a shard keeps its largest hubs up to its exact count, and the documents
beyond it fill, with the unlinked ones, what is free. Law ``rows``: the counts of any two shards differ by one at most.

Rounds work on counts per hub and shard, not on documents, and the driver holds one number per shard. Documents meet
their hub's row in joins that spread hubs with many of them (``counted_join``); ranks go through bins of a row's hash.

Defined cases: null texts equal each other and differ from empty ones, with 8 bytes and CRC-32 zero; rows that repeat
an id or are equal are rows of their own; null ids come last in a shard's slots, and rows without an id are told apart
by where they were read; an empty table gives an empty result. Extra columns are never looked at.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import counted_join, hash_bin, id_order, materialise, running_sum
from ledgerloom.operators.scale import exact_rank

SHARDS, SLACK = 24, 1.2
HUB_BITS = 10


def capacities(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def number_of(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (shard + 1).cast("int"))


def counts(placed: DataFrame, shards: int) -> list[int]:
    """Documents per shard of ``placed(shard, n)``."""
    found = dict(placed.groupBy("shard").agg(F.sum("n")).collect())
    return [found.get(s, 0) for s in range(shards)]


def propagate(pieces: DataFrame, limits: list[int]) -> DataFrame:
    """Move the pieces ``(hub, start, shard, n)`` of hubs in several shards together, within ``limits`` documents a shard."""
    one_hub = Window.partitionBy("hub")
    while True:
        room = number_of([max(0, limit - n) for limit, n in zip(limits, counts(pieces, len(limits)))], F.col("shard"))
        votes = pieces.groupBy("hub", "shard").agg(F.sum("n").alias("n"))
        cut = votes.withColumn("all", F.sum("n").over(one_hub)).filter("n < all")
        meet = F.struct(F.least("all", F.col("n") + room).alias("meet"), "n", F.xxhash64("hub", "shard").alias("tie"),
                        F.col("shard").alias("to"), room.alias("room"))
        movers = (cut.withColumn("best", F.max(meet).over(one_hub)).select("hub", "shard", "n", "best.to", "best.room")
                  .filter("shard != to and n <= room").withColumn("bin", hash_bin(F.xxhash64("hub"), HUB_BITS)))
        queued = running_sum(movers, ["to"], ["bin"], [F.col("hub"), F.col("shard")], "n", "ahead")
        let_in = materialise(queued.filter("ahead + n <= room").select("hub", "shard", "to"), "moves")
        if let_in.isEmpty():
            return pieces
        moved = pieces.join(let_in, ["hub", "shard"], "left")
        pieces = materialise(moved.select("hub", "start", F.coalesce("to", "shard").alias("shard"), "n"), "pieces")


def assign(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    mark = F.xxhash64(F.xxhash64(text), F.xxhash64(text, F.lit("salt")), size, F.col(text).isNull())
    row = F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())
    rows = materialise(docs.select(
        F.col(doc_id).alias("doc_id"), size.cast("long").alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("text_crc32"),
        mark.alias("mark"), F.xxhash64(mark, F.col(doc_id), row).alias("spot")), "rows")
    total = rows.count()
    exact = capacities(total, shards)
    most = max(1, total // shards)

    classes = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).withColumn("hub_bin", hash_bin(F.xxhash64("mark"), HUB_BITS))
    classes = materialise(classes.withColumn("linked", F.when(F.col("n") > 1, F.col("n")).otherwise(0)), "classes")
    line = materialise(running_sum(classes, [], ["hub_bin"], [F.col("mark")], "linked", "ahead"), "line")
    linked = max(1, classes.agg(F.sum("linked")).first()[0] or 0)
    along = hash_bin(F.col("spot"), 32) / F.lit(float(2**32))
    part = F.floor(along * F.ceil(F.col("n") / most))
    start = F.least(F.lit(shards - 1), F.floor((F.col("ahead") + along * F.col("n")) * shards / linked))
    named = counted_join(rows, line, ["mark"], "n").withColumn("spot_bin", hash_bin(F.col("spot"), HUB_BITS))
    named = materialise(named.select("doc_id", "size", "text_crc32", "spot", "spot_bin", F.when(F.col("n") > 1, F.xxhash64("mark", part)).alias("hub"),
                                     F.when(F.col("n") > 1, start.cast("int")).alias("start")), "named")

    pieces = named.filter("hub is not null").groupBy("hub", "start").agg(F.count(F.lit(1)).alias("n"))
    pieces = materialise(pieces.select("hub", "start", F.col("start").alias("shard"), "n"), "pieces")
    pieces = propagate(pieces, [int(slack * c) + 1 for c in exact])
    # a shard's hubs in order of their size, so that those beyond its exact count are the smallest
    settled = pieces.groupBy("hub", "shard").agg(F.sum("n").alias("all")).withColumn(
        "order", F.lit(-(1 << HUB_BITS)) * F.floor(F.log2("all")) + hash_bin(F.xxhash64("hub"), HUB_BITS))
    settled = running_sum(settled, ["shard"], ["order"], [F.col("hub")], "all", "ahead")
    keeps = F.greatest(F.lit(0), number_of(exact, F.col("shard")) - F.col("ahead"))
    final = materialise(pieces.join(settled.select("hub", "shard", "all", keeps.alias("keeps")), ["hub", "shard"]), "final")
    placed = materialise(counted_join(named, final, ["hub", "start"], "n").select(*named.columns, "shard", "all", "keeps"), "placed")

    columns = ["doc_id", "size", "text_crc32", "spot", "spot_bin"]
    # at most one hub of a shard is cut to the exact count
    trimmed = materialise(exact_rank(placed.filter("keeps > 0 and keeps < all"), ["shard"], ["spot_bin"], [F.col("spot")], "rank"), "trimmed")
    kept = placed.filter("keeps >= all").select(*columns, "shard").unionByName(trimmed.filter("rank <= keeps").select(*columns, "shard"))
    ends = list(accumulate(max(0, c - n) for c, n in zip(exact, counts(final, shards))))
    leaving = placed.filter("keeps = 0").select(*columns, "hub").unionByName(trimmed.filter("rank > keeps").select(*columns, "hub"))
    pool = (leaving.withColumn("late", F.lit(0)).withColumn("hub_bin", hash_bin(F.xxhash64("hub"), HUB_BITS))
            .unionByName(named.filter("hub is null").select(*columns, F.col("spot").alias("hub"), F.lit(1).alias("late"), F.col("spot_bin").alias("hub_bin"))))
    filled = exact_rank(pool, [], ["late", "hub_bin"], [F.col("hub"), F.col("spot")], "rank")
    place = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("rank")))
    placed = kept.unionByName(filled.select(*columns, place.cast("int").alias("shard")))
    slotted = exact_rank(placed, ["shard"], ["spot_bin"], [F.col("spot"), id_order(F.col("doc_id"))], "rank")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                          (F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
