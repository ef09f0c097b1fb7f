"""Stratified, diverse and grouped sampling (WIN2-WIN5, WIN7).

Random draws are orders by a seeded MD5, so they repeat on any cluster and need no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.operators.scale import exact_rank, take_per_key


def seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def quota_sample(files: DataFrame, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Up to a quota of files per bank (WIN2).

    The largest quota bounds the per-bank top-k, so a bank with most of the files is cut down
    before the shuffle.
    """
    names = list(quotas)
    quota = F.element_at(F.create_map(*[F.lit(v) for n in names for v in (n, quotas[n])]), F.col("bank"))
    known = files.filter(F.col("bank").isin(*names))
    ranked = take_per_key(known, ["bank"], [seeded(F.col("stem"), seed), F.col("stem")], max(quotas.values()), "rank")
    return ranked.filter(F.col("rank") <= quota)


def default_quotas() -> dict[str, int]:
    return {bank: quota for bank, _, quota in lx.SAMPLED_BANKS}


def fill_to_target(unknown: DataFrame, picked: DataFrame, target: int, seed: int = 42, digits: int = 4) -> DataFrame:
    """Unknown-bank files in random order while the page total is below the target (WIN3).

    The random order is cut into ``16 ** digits`` bins by its leading digits. Page sums of the bins tell the one bin in
    which the target is reached: files of earlier bins are in, files of later ones are out, and only that bin's files,
    one in ``16 ** digits``, are summed one by one. The bins are all that is ever broadcast or ordered as a whole.
    Files without pages or without a page count are never picked.
    """
    order = [F.col("_draw"), F.col("stem")]
    drawn = unknown.filter(F.col("pages") > 0).withColumn("_draw", F.coalesce(seeded(F.col("stem"), seed), F.lit("")))
    drawn = drawn.withColumn("_bin", F.substring("_draw", 1, digits))
    base = picked.agg((F.lit(target) - F.coalesce(F.sum("pages"), F.lit(0))).alias("_left"), F.lit(1).alias("_one"))
    earlier = Window.partitionBy("_one").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn.groupBy("_bin").agg(F.sum("pages").alias("_sum")).withColumn("_one", F.lit(1))
    bins = (sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(F.broadcast(base), "_one")
            .select("_bin", "_sum", (F.col("_left") - F.col("_before")).alias("_left")).filter("_left > 0"))
    rows = drawn.join(F.broadcast(bins), "_bin")
    inside = Window.partitionBy("_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edge = (rows.filter("_sum > _left").withColumn("_before", F.coalesce(F.sum("pages").over(inside), F.lit(0)))
            .filter("_before < _left"))
    return rows.filter("_sum <= _left").select(*unknown.columns).unionByName(edge.select(*unknown.columns))


def diverse_sample(files: DataFrame, per_bank: int = 3, known: list[str] | None = None) -> DataFrame:
    """Files evenly spread over page counts per bank, one for banks already known (WIN4, WIN5).

    Files of a bank are ordered by page count, then MD5. Ranks come from bin counts (page count
    and two hex digits), so even one huge bank is ranked in many tasks. Files without a page count
    come first in their bank; a file without a bank counts as unknown.
    """
    known = lx.KNOWN_BANKS if known is None else known
    unknown = F.coalesce("bank", F.lit("Unknown")) == "Unknown"
    named = files.filter(~unknown).withColumn("_h", F.md5("stem")).withColumn("_bin", F.substring("_h", 1, 2))
    named = named.withColumn("_pages", F.coalesce("pages", F.lit(-1)))  # bins have no nulls
    ranked = exact_rank(named, ["bank"], ["_pages", "_bin"], [F.col("_h"), F.col("stem")], "_rank", "_total")
    limit = F.when(F.lower("bank").isin(*known), 1).otherwise(per_bank)
    at = F.transform(F.sequence(F.lit(0), limit - 1), lambda i: F.floor(i * (F.col("_total") / limit)).cast("long"))
    keep = (F.col("_total") <= limit) | F.array_contains(at, F.col("_rank") - 1)
    spread = ranked.filter(keep).drop("_h", "_bin", "_pages", "_rank", "_total")
    return spread.unionByName(closest_pages(files.filter(unknown), per_bank))


def closest_pages(unknown: DataFrame, k: int, pages: int = 4) -> DataFrame:
    """The ``k`` files closest to four pages (WIN5); those without a page count come last."""
    return unknown.orderBy(F.abs(F.col("pages") - pages).asc_nulls_last(), F.md5("stem"), "stem").limit(k)


def group_split(rows: DataFrame, test_percent: int = 15, seed: int = 42) -> DataFrame:
    """Add ``split``: whole statements go to train or test by a hash of their stem (WIN7)."""
    bucket = F.conv(F.substring(seeded(F.col("stem"), seed), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(bucket < test_percent, "test").otherwise("train"))
