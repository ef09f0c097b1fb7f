"""Rule tagger, tag statistics, chunking and decoding (TAG1-TAG9, AGG16, EVL5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.operators.layout import (
    ACROSS, PAGE, ROW, is_header_row, is_section_marker, row_numbers, token_shapes, with_columns_x)

CHUNK_OVERLAP = 20
CHUNK_MARGIN = 10
MIN_CHUNK = 50
#: Room for the transactions of a page in a sequence number.
PAGE_STRIDE = 1 << 32
FIELDS = ("date", "desc", "amount", "balance")
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def rule_tags(tokens: DataFrame, tolerance: float = lx.ROW_TOLERANCE) -> DataFrame:
    """BIO tags from layout rules (TAG1) with multi-line descriptions (TAG2).

    Adds ``tag`` to the token table. Everything is windows over a page or one of its rows. A window copies every token,
    so functions that need nothing of each other share one, and a row's flags are found once, at its first token.
    """
    row = Window.partitionBy(*ROW)
    along = row.orderBy(*ACROSS)
    page = Window.partitionBy(*PAGE).orderBy("row_index", *ACROSS).rowsBetween(Window.unboundedPreceding, 0)
    p, lead_token = F.col("row_pos"), F.col("row_pos") == 0
    rowed = row_numbers(tokens, tolerance).withColumns({
        "row_pos": F.row_number().over(along) - 1, "_follow": F.lead("text", 1).over(along), "_year": F.lead("text", 2).over(along),
        "_words": F.collect_list(F.lower("text")).over(along.rowsBetween(*_ALL))})
    named = F.col("is_month") & F.coalesce(F.col("_follow").rlike(r"^\d{1,2},?$"), F.lit(False))
    day_end = F.when(~F.col("is_month"), p).when(F.coalesce(F.col("_year").rlike(r"^\d{2,4}$"), F.lit(False)), p + 2).otherwise(p + 1)
    flagged = (token_shapes(rowed)
               .withColumn("_dated", F.col("is_date") | named)
               .withColumn("_date_end", F.when(F.col("_dated"), day_end))
               .withColumn("_marks", F.when(lead_token, is_section_marker(F.col("_words"))))
               .withColumn("_heads", F.when(lead_token, is_header_row(F.col("_words")))).drop("_words", "_follow", "_year")
               .withColumns({
                   "is_marker": F.bool_or("_marks").over(row), "is_header": F.bool_or("_heads").over(row),
                   "_date_pos": F.min(F.when(F.col("_dated"), p)).over(row),
                   "_date_end": F.min_by("_date_end", F.when(F.col("_dated"), p)).over(row),
                   "_amount_first": F.min(F.when(F.col("is_amount"), p)).over(row),
                   "_amount_last": F.max(F.when(F.col("is_amount"), p)).over(row),
                   "_amounts": F.count_if("is_amount").over(row)}))
    staged = flagged.withColumn("_skip", F.col("is_marker") | F.col("is_header"))
    is_txn = ~F.col("_skip") & F.col("_date_pos").isNotNull() & (F.col("_amounts") > 0)
    in_desc = (p > F.col("_date_end")) & (p < F.col("_amount_first"))
    tag = (F.when(~F.col("_txn"), "O")
           .when(F.col("is_amount") & (F.col("_amounts") >= 2) & (p == F.col("_amount_last")), "B-BALANCE")
           .when(F.col("is_amount"), "B-AMOUNT")
           .when(p == F.col("_date_pos"), "B-DATE")
           .when((p > F.col("_date_pos")) & (p <= F.col("_date_end")), "I-DATE")
           .when(in_desc, F.when(p == F.col("_date_end") + 1, "B-DESC").otherwise("I-DESC"))
           .otherwise("O"))
    tagged = with_columns_x(staged.withColumn("_txn", is_txn).withColumn("tag", tag).withColumn(
        "_desc_at", F.when(F.col("tag") == "B-DESC", F.col("x0"))))
    # Continuation rows: unbroken since the last transaction row (or the top of the page).
    desc_x = F.coalesce(F.last("_desc_at", ignorenulls=True).over(page), F.col("description_x"))
    fits = (~F.col("_skip") & F.col("_date_pos").isNull() & (F.col("_amounts") == 0)
            & (F.abs(F.col("x0") - F.col("_desc_x")) < lx.CONTINUATION_X)
            & (F.col("x0") > F.col("date_x") + lx.CONTINUATION_MIN_X))
    breaks = lead_token & ~F.col("_txn") & ~F.col("_fits")
    chained = (tagged.withColumn("_desc_x", desc_x).withColumn("_fits", fits).withColumn("_breaks", breaks)
               .withColumns({"_last_break": F.max(F.when(F.col("_breaks"), F.col("row_index"))).over(page),
                             "_last_txn": F.max(F.when(lead_token & F.col("_txn"), F.col("row_index"))).over(page)}))
    unbroken = F.col("_last_break").isNull() | F.coalesce(F.col("_last_break") < F.col("_last_txn"), F.lit(False))
    final = F.when(~F.col("_txn") & unbroken, "I-DESC").otherwise(F.col("tag"))
    return chained.select(*tokens.columns, "row_index", "row_pos", final.alias("tag"))


def _tags(column: str, tag: str) -> Column:
    return F.count_if(F.col(column) == tag)


def rule_quality(tagged: DataFrame) -> DataFrame:
    """Share of complete transactions per page, scaled to 75 (TAG3)."""
    counts = tagged.groupBy(*PAGE).agg(
        _tags("tag", "B-DATE").alias("n_dates"), _tags("tag", "B-AMOUNT").alias("n_amounts"), _tags("tag", "B-DESC").alias("n_descs"))
    complete = F.least("n_dates", "n_amounts", "n_descs")
    rate = (F.when(F.col("n_dates") == 0, 0.0).when(F.col("n_dates") == complete, 75.0)
            .otherwise(F.bround(complete / F.col("n_dates") * 75.0, 1)))
    return counts.select(*PAGE, "n_dates", complete.alias("n_complete"), rate.alias("alignment_rate"))


def tag_histogram(tagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tag counts, per ``keys`` or over the corpus (TAG4)."""
    return tagged.groupBy(*(keys or []), "tag").agg(F.count(F.lit(1)).alias("n"))


def tag_maps(tagged: DataFrame) -> DataFrame:
    """Tag counts per page as a map (at most nine entries per page)."""
    counts = tag_histogram(tagged, PAGE)
    return counts.groupBy(*PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tag_counts"))


def class_weights(spark: SparkSession, histogram: DataFrame, cap: float = 10.0) -> DataFrame:
    """Inverse-frequency weights of the nine tags, absent tags 1.0 (AGG16)."""
    tags = spark.createDataFrame([(t,) for t in lx.BIO_TAGS], "tag string")
    joined = F.broadcast(tags).join(histogram, "tag", "left")
    total = F.sum("n").over(Window.partitionBy())  # nine rows
    return joined.select("tag", F.coalesce(F.least(total / (F.lit(len(lx.BIO_TAGS)) * F.col("n")), F.lit(cap)), F.lit(1.0)).alias("weight"))


def alignment_rate(tagged: DataFrame, txn_counts: DataFrame) -> DataFrame:
    """Aligned transactions per page in percent, 100 where there are none (EVL5)."""
    pages = tagged.groupBy(*PAGE).agg(F.least(_tags("tag", "B-DATE"), _tags("tag", "B-AMOUNT")).alias("aligned"))
    n = F.coalesce("n_txns", F.lit(0))
    return (pages.join(txn_counts, PAGE, "left")
            .select(*PAGE, "aligned", n.alias("total"),
                    F.when(n > 0, F.bround(F.col("aligned") / n * 100, 1)).otherwise(100.0).alias("alignment_rate")))


def mean_conf(test: Column, conf: str = "conf") -> Column:
    """Mean confidence that does not depend on the order rows are added in."""
    return F.avg(F.when(test, F.col(conf).cast("decimal(18,9)"))).cast("decimal(20,13)")


def page_confidence(predictions: DataFrame, *more: Column) -> DataFrame:
    """Mean confidence of tagged tokens per page and the low flag (TAG9); ``more`` are aggregates of the same pages."""
    mean = F.coalesce(mean_conf(F.col("tag") != "O"), F.lit(1).cast("decimal(20,13)"))
    return (predictions.groupBy(*PAGE).agg(mean.cast("double").alias("page_conf"), *more)
            .withColumn("is_low", F.col("page_conf") < lx.LOW_PAGE_CONFIDENCE))


def split_chunks(tokens: DataFrame, fit: int) -> DataFrame:
    """Cut pages with more than ``fit`` tokens into overlapping chunks (TAG7).

    Chunk 0 is the first ``fit`` tokens; later chunks repeat the last 20 tokens of the one
    before, as many as the page needs. Tokens count from the first one given, so trimmed pages
    lose nothing; ``pos`` stays what it was. Each token computes the chunks it belongs to, so no
    range join is needed.
    """
    size = max(fit - 1 - CHUNK_MARGIN, MIN_CHUNK)
    step, origin = size - CHUNK_OVERLAP, max(fit - CHUNK_OVERLAP, 0)
    page = Window.partitionBy(*PAGE)
    n, place = F.count(F.lit(1)).over(page), F.row_number().over(page.orderBy("pos")) - 1
    pos = F.col("_place")
    chunks = F.greatest(F.ceil((F.col("_n") - size - origin) / step), F.lit(0)) + 1
    low = F.greatest(F.ceil((pos - origin - size + 1) / step), F.lit(0))
    high = F.least(F.floor((pos - origin) / step), chunks - 1)
    later = F.when((F.col("_n") > fit) & (pos >= origin) & (low <= high),
                   F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda j: j + 1))
    none = F.array().cast("array<int>")
    head = F.when(pos < fit, F.array(F.lit(0))).otherwise(none)
    return (tokens.withColumn("_n", n).withColumn("_place", place)
            .withColumn("chunk", F.explode(F.concat(head, F.coalesce(later, none)))).drop("_n", "_place"))


def merge_chunks(predictions: DataFrame) -> DataFrame:
    """One tag per token: the most confident chunk, ties to the earlier one (TAG8)."""
    best = F.max_by(F.struct("tag", "conf", "chunk"), F.struct("conf", -F.col("chunk")))
    merged = predictions.groupBy(*PAGE, "pos").agg(best.alias("_b"))
    unseen = (F.col("_b.conf") <= 0) & (F.col("_b.chunk") > 0)
    return merged.select(*PAGE, "pos", F.when(unseen, "O").otherwise(F.col("_b.tag")).alias("tag"), F.col("_b.conf").alias("conf"))


def _field_text(field: str) -> Column:
    items = F.sort_array(F.collect_list(F.when(F.col("_take") & (F.col("_field") == field), F.struct("pos", "text"))))

    def join(acc: Column, item: Column) -> Column:
        word = item["text"]
        if field in ("amount", "balance"):
            return F.concat(acc, word)
        glue = F.lit(" ")
        if field == "date":
            tight = acc.endswith("/") | acc.endswith("-") | word.isin("/", "-", ",")
            glue = F.when(tight, "").otherwise(" ")
        return F.when(acc == "", word).otherwise(F.concat(acc, glue, word))

    # A field of one word, as most amounts are, is that word.
    return F.when(F.size(items) == 1, F.get(items, F.lit(0))["text"]).when(F.size(items) > 1, F.aggregate(items, F.lit(""), join))


def decode(tagged: DataFrame) -> DataFrame:
    """BIO tags to field texts, one row per transaction (TAG5).

    Reads ``text, tag, conf``. A transaction starts at each B-DATE once a date is held; the last
    B of a field wins, an I without its B starts the field if anything is held. Columns:
    ``stem, page, seq, date_text, desc_text, amount_text, balance_text, mean_conf``.
    """
    page = Window.partitionBy(*PAGE)
    is_b = F.col("tag").startswith("B-")
    is_date = F.col("tag") == "B-DATE"
    between = (F.col("tag") == "I-DATE") & (F.col("pos") > F.col("_fb")) & (
        F.col("_fbd").isNull() | (F.col("pos") < F.col("_fbd")))
    by_pos = page.orderBy("pos")
    whole = by_pos.rowsBetween(*_ALL)  # in the order of the running count, so one sort and one window serve both
    n = F.col("_n")
    # Tokens outside all fields start nothing and count for nothing.
    segments = (tagged.filter(F.col("tag") != "O").withColumn("_b", F.when(is_b, F.col("pos"))).withColumns({
                    "_n": F.sum(is_date.cast("int")).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)),
                    "_fb": F.min("_b").over(whole), "_fbd": F.min(F.when(is_date, F.col("pos"))).over(whole)})
                .withColumn("_promoted", F.coalesce(F.bool_or(between).over(page), F.lit(False)))
                .withColumn("_seg", F.when(F.col("_promoted"), n).otherwise(F.greatest(n, F.lit(1))))
                .withColumn("_field", F.lower(F.substring("tag", 3, 20))))
    field = Window.partitionBy(*PAGE, "_seg", "_field")
    held = F.col("pos") >= F.col("_fb")
    start = F.coalesce(F.max("_b").over(field), F.min(F.when(held, F.col("pos"))).over(field))
    taken = segments.withColumn("_start", start).withColumn(
        "_take", F.coalesce(held & (F.col("pos") >= F.col("_start")), F.lit(False)))
    return _collect_fields(taken, _field_text, mean_conf(F.lit(True)))


def decode_strict(tagged: DataFrame) -> DataFrame:
    """Decoder used by evaluation: an I without its B is dropped, words are always space-joined (TAG6)."""
    page = Window.partitionBy(*PAGE)
    running = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_b = F.col("tag").startswith("B-")
    n = F.sum((F.col("tag") == "B-DATE").cast("int")).over(running)
    segments = (tagged.withColumn("_seg", F.greatest(n, F.lit(1))).filter(F.col("tag") != "O")
                .withColumn("_field", F.lower(F.substring("tag", 3, 20))))
    start = F.max(F.when(is_b, F.col("pos"))).over(Window.partitionBy(*PAGE, "_seg", "_field"))
    taken = segments.withColumn("_take", F.coalesce(F.col("pos") >= start, F.lit(False)))

    def spaced(name: str) -> Column:
        items = F.sort_array(F.collect_list(F.when(F.col("_take") & (F.col("_field") == name), F.struct("pos", "text"))))
        return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: x["text"]), " "))

    return _collect_fields(taken, spaced, F.lit(None).cast("decimal(20,13)")).drop("mean_conf")


def _collect_fields(taken: DataFrame, text, conf: Column) -> DataFrame:
    rows = taken.groupBy(*PAGE, "_seg").agg(*[text(f).alias(f"{f}_text") for f in FIELDS], conf.alias("mean_conf"))
    return rows.filter(F.col("date_text").isNotNull()).select(
        "stem", F.col("page_index").alias("page"), (F.col("page_index") * PAGE_STRIDE + F.col("_seg")).alias("seq"),
        *[f"{f}_text" for f in FIELDS], "mean_conf")
