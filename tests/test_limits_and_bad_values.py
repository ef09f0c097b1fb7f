"""No caps on pages, queues or texts, and no job ends on one bad value."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.operators import align, banks, evaluate, feedback, filters, ingest, labelling, layout, responses, summary, tagging
from ledgerloom.operators import transactions as tx
from ledgerloom.session import shared_dir

TOKENS = "stem string, page_index int, pos int, text string"


@pytest.mark.parametrize("first, n, fit", [(0, 12_000, 512), (600, 500, 512), (600, 700, 512), (0, 2_000, 64)])
def test_chunks_keep_every_token(spark, first, n, fit):
    rows = spark.range(n).select(F.lit("s").alias("stem"), F.lit(0).alias("page_index"), (F.col("id") + first).cast("int").alias("pos"))
    chunks = tagging.split_chunks(rows, fit)
    assert chunks.select("pos").distinct().count() == n
    size = chunks.groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert size <= fit


def test_queue_holds_every_open_statement(spark):
    stems = spark.range(1500).select(F.format_string("s%05d", "id").alias("stem"))
    named = stems.select("stem", F.when(F.col("stem") >= "s01400", "Rare").otherwise("Common").alias("bank"))
    queue = labelling.labelling_queue(stems, named, stems.limit(0)).collect()
    assert len(queue) == 1500 and [r.bank for r in queue[:100]] == ["Rare"] * 100 and queue[0].bank_count == 100
    totals = {r.bank: r.open_statements for r in labelling.queue_totals(stems, named, stems.limit(0)).collect()}
    assert totals == {"Rare": 100, "Common": 1400, None: 1500}


def test_whole_texts_count(spark):
    text = spark.createDataFrame([("x " * 4000 + "Chase Bank statement",), ("x " * 4000 + "other",)], "text string")
    a, b = (r[0] for r in text.select(ingest.fingerprint(F.col("text"))).collect())
    assert a != b and len(a) == 64
    words = spark.createDataFrame([("s", 0, k, "word" if k < 300 else "chase") for k in range(301)], TOKENS)
    assert banks.detect_bank_format(words).first().bank != "unknown"
    assert banks.detect_bank_format(words, head_words=100).first().bank == "unknown"
    long = "m" * 40
    rows = spark.createDataFrame([(f"{long}{k}\t", "debit", 1.0, "2025-01", None, "f", 0, k) for k in range(2)],
                                 "description string, type string, amount double, month_key string, parsed_date date, source_file string, page int, seq int")
    assert sorted(r.merchant for r in summary.top_merchants(rows).collect()) == [f"{long}0", f"{long}1"]


def test_oversized_numbers_are_visible(spark):
    fields = spark.createDataFrame([("s", 1, "01/02", "ok", "12.50", None, 0.9), ("s", 2, "01/02", "huge", "9" * 25, "8" * 25, 0.9)],
                                   "stem string, seq int, date_text string, desc_text string, amount_text string, balance_text string, mean_conf double")
    built = tx.build_transactions(fields)
    rows = {r.description: r for r in tx.drop_empty(built).collect()}
    assert float(rows["ok"].amount) == 12.5 and rows["huge"].amount is None and rows["huge"].balance_after is None
    assert [tuple(r) for r in tx.rejected_amounts(built).collect()] == [("s", 2, 1)]
    embedded = built.withColumn("amount", F.lit(0).cast("decimal(18,2)")).withColumn("description", F.lit("fee $" + "9" * 25))
    assert tx.rescue_embedded_amounts(embedded).first().amount is None


def test_null_amount_labels_are_skipped(spark):
    tokens = spark.createDataFrame([("s", 0, k, t, 10 * k, 0, 10 * k + 5, 8, 1.0, 9.0) for k, t in enumerate(["01/02", "coffee", "12.50"])],
                                   TOKENS + ", x0 int, y0 int, x1 int, y1 int, top double, bottom double")
    label = "stem string, page_index int, seq int, date string, amount decimal(18,2), balance_after decimal(18,2)"
    none = spark.createDataFrame([("s", 0, 0, "01/02", None, None)], label)
    assert {r.tag for r in align.align_tokens(tokens, none).collect()} == {"O"}


def test_report_without_true_entities(spark):
    tags = spark.createDataFrame([("s", 0, 0, "O", "B-DATE"), ("s", 0, 1, "O", "O")], "stem string, page_index int, pos int, t string, p string")
    rows = {r.type: r for r in evaluate.entity_report(tags, "t", "p").collect()}
    assert rows["weighted avg"].f1 == 0 and rows["macro avg"].precision == 0 and rows["micro avg"].support == 0
    nothing = {r.type: r for r in evaluate.entity_report(tags.withColumn("p", F.lit("O")), "t", "p").collect()}
    assert set(nothing) == {"micro avg", "macro avg", "weighted avg"} and all(r.f1 == 0 for r in nothing.values())


def test_empty_review_table(spark):
    pages = spark.createDataFrame([], "alignment_rate double, reviewed boolean, review_status string")
    row = labelling.review_stats(pages).first()
    assert (row.total, row.avg_alignment, row.reviewed_pct) == (0, 0, 0)


def test_quoted_amounts_are_read(spark):
    txns = [{"date": "d", "description": "a", "amount": "$1,012.50", "type": "debit"}, {"date": "d", "description": "b", "amount": 3, "type": "credit"},
            {"date": "d", "description": "c", "amount": "n/a", "type": "credit"}]
    frame = spark.createDataFrame([("s", 0, json.dumps({"transactions": txns})), ("s", 1, "{broken " + "x" * 600)], "stem string, page_index int, text string")
    pages = responses.parse_labels(frame)
    got = {r.description: r.amount for r in responses.label_samples(pages).collect()}
    assert got == {"a": 1012.5, "b": 3.0, "c": None}
    assert pages.filter("parse_error").first().notes.endswith("x" * 600)


def test_flagged_rows_are_all_kept(spark):
    txns = spark.createDataFrame([("s", k, 0, "d" * 80, 0.5) for k in range(50)], "stem string, seq int, page int, description string, confidence double")
    assert feedback.flagged_details(txns).filter(F.length("description") == 80).count() == 50
    pages = spark.createDataFrame([("s", 3, 0), ("t", 1, 1), ("u", 1, 0)], "stem string, page_count long, n_low_pages long")
    named = spark.createDataFrame([("s", "Chase")], "stem string, bank string")
    assert {r.stem: r.flagged_transactions for r in feedback.feedback_records(txns, pages, named).collect()} == {"s": 50, "t": 0}


class NoSharedFolder:
    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://somewhere"

        @staticmethod
        def getConf():  # noqa: N802
            return NoSharedFolder.conf


def test_unset_shared_folder_raises():
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(NoSharedFolder)


def test_thresholds_are_arguments_and_what_they_remove_is_counted(spark):
    long = "statement of your account " * 10
    rows = [("a.pdf", 20_000, long), ("b.pdf", 9_999, long), ("c.pdf", None, long), ("d.pdf", 20_000, "short"), ("e.pdf", 20_000, None),
            (None, 20_000, long), ("f.pdf", 20_000, long)]
    files = spark.createDataFrame(rows, "name string, size long, text string")
    known = files.filter("name = 'f.pdf'")
    fates = lambda **kw: {r.fate: r.n for r in filters.candidate_counts(files, known, **kw).collect()}
    assert fates() == {"kept": 1, "small": 2, "short_text": 2, "name": 1, "known": 1}
    assert fates(min_bytes=1, min_chars=1) == {"kept": 3, "small": 1, "short_text": 1, "name": 1, "known": 1}
    for kw in ({}, {"min_bytes": 1, "min_chars": 1}):
        assert filters.candidate_files(files, known, **kw).count() == fates(**kw)["kept"]
    assert tuple(filters.scoring_counts(files).first())[:3] == (1, 1, 5)
    assert tuple(filters.scoring_counts(files, min_chars=0).first())[:3] == (1, 0, 6)
    words = spark.createDataFrame([("s", p, k, f"w{k}") for p, n in ((0, 5), (1, 25)) for k in range(n)], "stem string, page_index int, pos int, text string")
    more = spark.createDataFrame([("s", p, k, f"w{k}") for p, n in ((0, 9), (1, 30)) for k in range(n)], words.schema)
    assert tuple(ingest.word_choices(words, more).first()) == (2, 1, 5, 30)
    assert tuple(ingest.word_choices(words, more, min_native=100).first()) == (2, 2, 30, 0)
    for least in (20, 100):
        kept = ingest.choose_words(words, more, least)
        left_out = ingest.word_choices(words, more, least).first()
        assert kept.filter("not used_ocr").count() == 30 - left_out.native_left_out
        assert kept.filter("used_ocr").count() == 39 - left_out.ocr_left_out
    empty = words.limit(0)
    assert tuple(ingest.word_choices(empty, empty).first()) == (0, 0, 0, 0)


def test_a_short_preamble_stays_unless_asked_otherwise(spark):
    header = lx.TXN_START_HEADERS[0].split()
    page = [*["x"] * 10, *header, "paid", "rent"]
    tokens = spark.createDataFrame([("s", 0, k, t) for k, t in enumerate(page)], "stem string, page_index int, pos int, text string")
    assert tuple(layout.trimmed_counts(tokens).first()) == (0, len(page), 0)
    assert tuple(layout.trimmed_counts(tokens, min_preamble=10).first()) == (10, len(page) - 10, 0)
    assert layout.trim_sections(tokens).count() == len(page) and layout.trim_sections(tokens, 10).count() == len(page) - 10
