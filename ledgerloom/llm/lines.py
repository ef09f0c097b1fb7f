"""Line deduplication by winnowing over line hashes.

A line is deleted if it lies in a run of whole lines with ``MIN_WORDS`` words or more that occurs earlier. Two windows
find all such runs. One starts at a line and takes as many lines as it needs to reach ``MIN_WORDS`` words, the other
ends at a line and reaches back as far. Of a maximal equal run, windows that start in it and end in it cover all but
the last lines, and the window that ends with the run's last line covers those, so no match needs to be followed line
by line. The smallest line hash of a window is its fingerprint; windows whose fingerprint lies at one place only are
dropped. The rest are grouped by 128 hash bits over all their lines, each group's earliest place is joined back, and
every window at a later place is a repeat. "Earlier" goes by document id, then by line, also within a document, so the
first occurrence of each run stays. A run counts against any earlier occurrence, not only against the earliest one.

All rows that meet in a shuffle are hashes of lines. A line or run that a third of the documents share is counted
before it is shuffled and joined by an equi-join that can be split; nothing is paired with its own group.

Defined cases: lines are cut at line feeds and compared exactly; lines without a word take no part and stay; texts with
fewer words than ``MIN_WORDS`` lose nothing; null texts stay null; null ids come last; rows equal in id and text are
one document and lose the same lines; rows with one id and different texts are ordered by their hashes; an empty
table gives an empty table. Extra columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, id_order, materialise

MIN_WORDS = 50
SALT = "second"


def keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """Two longs that name a document: its id (null last) and its text's hash."""
    return [id_order(F.col(doc_id)).alias("doc"), F.xxhash64(text).alias("mark")]


def windows(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: doc, mark, first and last line, fingerprint, anchor (its line), and two content hashes.

    A window that ends at a line is left out where it is also the one that starts at its first line.
    """
    lines = docs.filter(F.col(text).isNotNull()).select(
        *keyed(docs, doc_id, text), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "mark", "pos", F.regexp_count("line", F.lit(WORD)).alias("words"),
                         F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(SALT)).alias("g"))
    lines = lines.filter("words > 0").groupBy("doc", "mark", "pos").agg(
        *[F.min(c).alias(c) for c in ("words", "h", "g")])  # rows repeated whole
    document = Window.partitionBy("doc", "mark")
    before = F.sum("words").over(document.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    ahead = document.orderBy("before").rangeBetween(0, min_words - 1)  # exactly the lines that the window needs
    behind = document.orderBy("through").rangeBetween(1 - min_words, 0)

    def window(frame: WindowSpec, full: Callable[[Column], Column]) -> Column:
        size = F.sum("words").over(frame)
        return F.when(full(size), F.struct(
            F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"),
            F.min(F.struct("h", "pos")).over(frame).alias("least"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("c1"), F.xxhash64(F.collect_list("g").over(frame)).alias("c2")))

    starting = window(ahead, lambda size: size >= min_words)
    ending = window(behind, lambda size: size - F.col("words") >= min_words)
    both = (lines.withColumn("before", before).withColumn("through", F.col("before") + F.col("words"))
            .select("doc", "mark", starting.alias("starting"), ending.alias("ending")))
    return (both.select("doc", "mark", F.explode(F.array("starting", "ending")).alias("w")).filter("w is not null")
            .select("doc", "mark", "w.first", "w.last", F.col("w.least.h").alias("fingerprint"),
                    F.col("w.least.pos").alias("anchor"), "w.c1", "w.c2"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of lines to delete: ``doc, mark, runs`` with ``runs`` an array of ``(first, last)``, apart and in order."""
    seen = materialise(windows(docs, min_words, doc_id, text), "windows")
    spot = F.struct("doc", "mark", "anchor")
    shared = (seen.groupBy("fingerprint").agg(F.min(spot).alias("one"), F.max(spot).alias("other"))
              .filter("one != other").select("fingerprint"))
    matched = materialise(seen.join(shared, "fingerprint", "left_semi"), "matches")
    place = F.struct("doc", "mark", "first")
    firsts = (matched.groupBy("c1", "c2").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("c1", "c2", "earliest"))
    later = (matched.join(firsts, ["c1", "c2"]).filter(place > F.col("earliest"))
             .select("doc", "mark", "first", "last"))
    document = Window.partitionBy("doc", "mark")
    reach = F.max("last").over(document.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach >= F.col("first") - 1, 0).otherwise(1)
    run = F.sum("starts").over(document.orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    runs = (later.withColumn("starts", starts).withColumn("run", run).groupBy("doc", "mark", "run")
            .agg(F.min("first").alias("first"), F.max("last").alias("last")))
    return runs.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Struct ``row`` (the row of ``docs``), ``kept`` (its text without repeated runs), ``runs``, ``n_lines``, ``n_removed``."""
    runs = repeated_runs(docs, min_words, doc_id, text)
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), *keyed(docs, doc_id, text))
    lines = F.split("text", "\n", -1)
    gone = lambda pos: F.exists("runs", lambda r: (r["first"] <= pos) & (pos <= r["last"]))
    kept = F.array_join(F.filter(lines, lambda line, pos: ~(gone(pos) & line.rlike(WORD))), "\n")
    n_kept = F.size(F.filter(lines, lambda line, pos: ~(gone(pos) & line.rlike(WORD))))
    found = F.col("runs").isNotNull()
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return packed.join(runs, ["doc", "mark"], "left").select(
        "row", F.when(found, kept).otherwise(F.col("text")).alias("kept"),
        F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")).alias("runs"),
        n_lines.cast("long").alias("n_lines"),
        F.when(found, F.size(lines) - n_kept).otherwise(0).cast("long").alias("n_removed"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text`` (what stays), ``runs, n_lines, n_removed`` of every document."""
    return dedup_lines(docs, min_words).select(
        F.col("row.doc_id").alias("doc_id"), F.col("kept").alias("text"), "runs", "n_lines", "n_removed")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with what stays of their texts; documents of which no word stays are left out."""
    found = dedup_lines(docs, min_words, doc_id, text)
    emptied = (F.col("n_removed") > 0) & ~F.col("kept").rlike(WORD)
    return found.filter(~emptied).select(*[
        (F.col("kept") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
