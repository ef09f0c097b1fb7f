"""Hand-made rows with the result each rule implies."""

import datetime
import hashlib
import math

from pyspark.sql import functions as F

from ledgerloom.functions import dates as dt
from ledgerloom.functions import fuzzy
from ledgerloom.functions import money as mn
from ledgerloom.functions.text import path_name, required_literal, safe_name, strip_fence
from ledgerloom.operators import enrich, evaluate, feedback, filters, ingest, layout, responses, sampling, summary, tagging
from ledgerloom.operators import transactions as tx


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, rows, schema, column):
    return [r[0] for r in values(spark, rows, schema, column)]


def test_parse_amount(spark):
    texts = ["$1,234.56", "(12.00)", "−5.00", "12.00-", "", "12d", None, " 7 ", "1_000", "1e2", "5s.00", ".5", "--1"]
    expected = [1234.56, 12.0, -5.0, 0.0, 0.0, 0.0, 0.0, 7.0, 1000.0, 100.0, 5.0, 0.5, 0.0]
    assert one(spark, [(t,) for t in texts], "t string", mn.parse_amount(F.col("t"))) == expected


def test_embedded_amounts(spark):
    rows = [(0, "UBER -$17.75 trip $2.00"), (0, "UBER -$17.75"), (5, "x $3"), (0, "a $, b"), (0, "$5 $50"), (0, None)]
    df = spark.createDataFrame(rows, "n int, description string").select(
        F.col("n").cast(mn.MONEY).alias("amount"), "description", F.lit("unknown").alias("type"))
    got = [(float(r.amount), r.description, r.type) for r in tx.rescue_embedded_amounts(df).collect()]
    assert got == [(2.0, "UBER trip", "unknown"), (17.75, "UBER", "debit"), (5.0, "x $3", "unknown"), (0.0, "a $, b", "unknown"),
                   (50.0, "0", "unknown"), (0.0, None, "unknown")]


def test_summary_rows(spark):
    rows = [("Total deposits and other credits", 1), ("AB", 0), ("AB", 5), ("  ", 0), ("Coffee", 0)]
    df = spark.createDataFrame(rows, "description string, n int").withColumn("amount", F.col("n").cast(mn.MONEY))
    assert [r.description for r in tx.drop_summary_rows(df).collect()] == ["AB", "Coffee"]


def test_types(spark):
    df = spark.createDataFrame([("s", 0, 100, 10), ("s", 1, None, 5), ("s", 2, 70, 30)], "stem string, seq long, b int, a int").select(
        "stem", "seq", F.col("b").cast(mn.MONEY).alias("balance_after"), F.col("a").cast(mn.MONEY).alias("amount"), F.lit("unknown").alias("type"))
    assert [r.type for r in tx.infer_by_balance(df).orderBy("seq").collect()] == ["unknown", "unknown", "debit"]
    words = [("ACH CREDIT payroll",), ("service charge",), ("xyz",)]
    assert one(spark, words, "d string", tx.type_by_words(F.col("d"))) == ["credit", "debit", "debit"]


def tagged(spark, items):
    rows = [("s", 0, i, word, tag, 0.5) for i, (tag, word) in enumerate(items)]
    return spark.createDataFrame(rows, "stem string, page_index long, pos long, text string, tag string, conf double")


def fields(df):
    return [(r.date_text, r.desc_text, r.amount_text) for r in df.orderBy("seq").collect()]


def test_decode(spark):
    first = [("B-DATE", "01/02"), ("B-DESC", "A"), ("I-DESC", "B"), ("B-AMOUNT", "1"), ("I-AMOUNT", ".5"), ("B-DATE", "01/03"), ("B-AMOUNT", "2")]
    assert fields(tagging.decode(tagged(spark, first))) == [("01/02", "A B", "1.5"), ("01/03", None, "2")]
    promoted = [("I-DESC", "x"), ("B-DESC", "y"), ("I-DATE", "01/02"), ("B-DATE", "01/03")]
    assert fields(tagging.decode(tagged(spark, promoted))) == [("01/02", "y", None), ("01/03", None, None)]
    spaced = [("B-DATE", "Jan"), ("I-DATE", "15"), ("I-DATE", ","), ("I-DATE", "2025")]
    assert fields(tagging.decode(tagged(spark, spaced))) == [("Jan 15, 2025", None, None)]


def test_visual_rows(spark):
    rows = [("s", 0, i, float(t), 10 * i, "w") for i, t in enumerate([1, 7, 12, 30])]
    df = spark.createDataFrame(rows, "stem string, page_index int, pos int, top double, x0 int, text string")
    assert [r.row_index for r in layout.visual_rows(df).orderBy("pos").collect()] == [0, 0, 1, 2]


def test_token_shapes(spark):
    texts = [("1,234.56",), ("$5.00",), ("5.00-",), ("1234.56",), ("-$5.00",)]
    assert one(spark, texts, "t string", layout.is_amount_token(F.col("t"))) == [True, True, True, False, False]


def test_rule_quality(spark):
    tags = ["B-DATE"] * 4 + ["B-AMOUNT"] * 4 + ["B-DESC"] * 3
    df = tagged(spark, [(t, "x") for t in tags])
    assert tagging.rule_quality(df).collect()[0].alignment_rate == 56.2


def test_categories(spark):
    rows = [("Payroll ACME",), ("current rent",), ("ZELLE TO BOB",), ("zzz",), ("FPL DIRECT",)]
    assert one(spark, rows, "d string", enrich.category_of(F.col("d"))) == [
        "Payroll/Income", "Rent/Mortgage", "Transfers", "Other", "Utilities"]


def test_dates(spark):
    day = datetime.date(2025, 1, 5)
    rows = [("1/5/2025",), ("01-05-25",), ("Jan 5, 2025",), ("2/30",), ("foo",), (" january  5. ",), ("JAN 5",), ("1/5-2025",), ("Feb 29",), ("Foo 5, 2025",)]
    got = one(spark, rows, "d string", dt.parse_date(F.col("d"), F.lit(2025)))
    assert got == [day, day, day, None, None, day, day, None, None, None]
    late = one(spark, [("12/20",), ("01/03",), ("2/29",), ("12/20/2024",)], "d string", dt.parse_date(F.col("d"), F.lit(2026), F.lit(1)))
    assert late == [datetime.date(2025, 12, 20), datetime.date(2026, 1, 3), None, datetime.date(2024, 12, 20)]
    leap = one(spark, [("2/29",)], "d string", dt.parse_date(F.col("d"), F.lit(2024), F.lit(1)))
    assert leap == [None]


def test_statement_period(spark):
    rows = [("12/20/2025 - 01/22/2026", None), ("x", "June 1, 2024 to July 2, 2024"), ("ending June 2023 and 1/1/2022", "Jan 2022"),
            ("2021-x Jan 2021", "Feb 2022"), ("nothing", "")]
    got = one(spark, rows, "a string, b string", dt.infer_period(F.col("a"), F.col("b")))
    assert [None if r is None else (r.year, r.end_month) for r in got] == [(2026, 1), (2024, 7), (2023, None), (2021, None), None]


def test_variants(spark):
    got = one(spark, [("1/5/2025",), ("01/15",), ("June 13",), ("Jun. 3",), ("",)], "d string", dt.date_variants(F.col("d")))
    assert got[0] == sorted(["1/5/2025", "1/5", "1-5"])
    assert got[1] == sorted(["01/15", "Jan 15"])
    assert got[2] == sorted(["June 13", "Jun 13"])
    assert got[3] == sorted(["Jun. 3", "Jun.", "06/03", "06-03"])
    assert got[4] == []
    amounts = one(spark, [("-1234.5",)], "a string", mn.amount_variants(F.col("a").cast(mn.MONEY)))[0]
    assert amounts == ["1,234.50", "1234.50", "$1,234.50", "$1234.50", "1,234", "-1,234.50", "(1,234.50)", "-$1,234.50"]


def test_fuzzy(spark):
    pairs = [("01/15", "01/16"), ("", ""), ("abc", ""), ("june 13", "jun 13")]
    native = one(spark, pairs, "a string, b string", fuzzy.ratio(F.col("a"), F.col("b")))
    plain = [fuzzy.Pattern(a).ratio(b) for a, b in pairs]
    assert native[0] == 80.0 and all(math.isclose(x, y) for x, y in zip(native, plain))


def test_monthly(spark):
    df = spark.createDataFrame([("2025-01", "credit", 100), ("2025-01", "debit", 30), ("2025-01", "unknown", 5), ("unknown", "debit", 9)],
                               "month_key string, type string, n int").withColumn("amount", F.col("n").cast(mn.MONEY))
    rows = summary.monthly_cashflow(df).collect()
    assert [(r.month_key, float(r.income), float(r.expenses), r.n) for r in rows] == [("2025-01", 100.0, 35.0, 3)]


def test_zero_mean_balance(spark):
    df = spark.createDataFrame([("s", 10), ("s", -10)], "stem string, b int").select(
        "stem", F.col("b").cast(mn.MONEY).alias("balance_after"), F.lit(1).cast(mn.MONEY).alias("amount"), F.lit("debit").alias("type"),
        F.lit("x").alias("description"))
    assert summary.statement_metrics(df).collect()[0].average_daily_balance is None


def test_greedy_match(spark):
    pred = spark.createDataFrame([("s", 0, 1, "01/02", "5.00"), ("s", 0, 2, "01/02", "5.00")], "stem string, page long, seq long, date_text string, amount_text string")
    truth = spark.createDataFrame([("s", 0, 1, "01/02/2025", -5.0), ("t", 0, 1, "x", 1.0)], "stem string, page long, seq long, date string, amount double")
    got = {r.stem: (r.tp, r.fp, r.fn) for r in evaluate.match_counts(pred, truth).collect()}
    assert got == {"s": (1, 1, 0), "t": (0, 0, 1)}


def test_entity_report(spark):
    df = spark.createDataFrame([("s", 0, 0, "B-DATE", "B-DATE"), ("s", 0, 1, "O", "O"), ("s", 0, 2, "B-AMOUNT", "O")],
                               "stem string, page_index long, pos long, t string, p string")
    row = evaluate.entity_report(df, "t", "p").filter(F.col("type") == "micro avg").collect()[0]
    assert (row.precision, row.recall, round(row.f1, 3)) == (1.0, 0.5, 0.667)


def test_fill_to_target(spark):
    # MD5 order is replaced by names whose order is known only to the sampler, so sizes are compared.
    unknown = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate([3, 0, 2, 4])], "stem string, pages long")
    picked = spark.createDataFrame([(6,)], "pages long")
    got = sampling.fill_to_target(unknown, picked, 10).collect()
    pages = [r.pages for r in got]
    assert 0 not in pages and 6 + sum(pages) >= 10 and 6 + sum(pages) - min(pages) < 10 + max(pages)


def test_fill_to_a_million_pages(spark):
    files = spark.range(400_000).select(F.concat(F.lit("f"), "id").alias("stem"), (F.col("id") % 8).alias("pages"))
    picked = spark.createDataFrame([(1234,)], "pages long")
    held, expected = 1234, set()
    for draw, stem in sorted((hashlib.md5(f"42|f{k}".encode()).hexdigest(), f"f{k}") for k in range(400_000) if k % 8):
        if held >= 1_000_000:
            break
        expected.add(stem)
        held += int(stem[1:]) % 8
    for digits in (1, 4):
        got = sampling.fill_to_target(files.select("stem", "pages"), picked, 1_000_000, digits=digits)
        assert {r.stem for r in got.collect()} == expected
    whole = sampling.fill_to_target(files.select("stem", "pages"), picked, 10_000_000)
    assert whole.count() == 350_000 and sampling.fill_to_target(files.select("stem", "pages"), picked, 1234).count() == 0


def test_evenly_spaced_keeps_files_without_pages_or_bank(spark):
    rows = [("Chase", "a", None), ("Chase", "b", 5), ("Big", "c", 1), ("Big", "d", None), ("Big", "e", 9), (None, "f", 4), ("Unknown", "g", None),
            ("Unknown", "h", 3)]
    files = spark.createDataFrame(rows, "bank string, stem string, pages int")
    got = sampling.diverse_sample(files, 3, known=["chase"]).collect()
    assert {r.stem for r in got} == {"a", "c", "d", "e", "f", "g", "h"}


def test_evenly_spaced(spark):
    files = spark.createDataFrame([("Big", f"s{i}", i) for i in range(10)] + [("Chase", f"c{i}", i) for i in range(4)], "bank string, stem string, pages long")
    got = sampling.diverse_sample(files, 3).collect()
    assert sorted(r.pages for r in got if r.bank == "Big") == [0, 3, 6]
    assert [r.pages for r in got if r.bank == "Chase"] == [0]


def test_responses(spark):
    rows = [('{"transactions":[{"amount":1},{"amount":2},{"amount":', "max_tokens"), ('{"transactions":[{"amount":1}]}\nDone', "end_turn"),
            ("```json\n{\"transactions\":[{\"amount\":3}]}\n```", "end_turn")]
    got = responses.response_transactions(spark.createDataFrame(rows, "text string, stop_reason string")).collect()
    assert [(r.amount, r.confidence) for r in got] == [(1.0, 0.8), (2.0, 0.8), (3.0, 1.0)]
    both = [("```\na\n```\nb",)]
    assert values(spark, both, "t string", strip_fence(F.col("t"), False), strip_fence(F.col("t"), True)) == [("a\nb", "a")]


def test_fallback_rule(spark):
    rows = [([0, 1], 4), ([0, 1, 2], 4)]
    assert one(spark, rows, "low array<int>, n int", feedback.needs_fallback(F.col("low"), F.col("n"))) == [False, True]


def test_names(spark):
    urls = [("https://a.b/x/My%20Stmt.pdf?z=1",), ("https://a.b/drivers-license.pdf",), ("https://a.b/ab.pdf",), ("https://a.b/stmt.PDF#p",), ("/in/jan.txt",)]
    assert one(spark, urls, "u string", path_name(F.col("u"))) == ["My%20Stmt.pdf", "drivers-license.pdf", "ab.pdf", "stmt.PDF", "jan.txt"]
    assert one(spark, urls, "u string", filters.is_statement_name(F.col("u"))) == [True, False, False, True, False]
    assert one(spark, [("a b/é-1.pdf",)], "n string", safe_name(F.col("n"))) == ["a_b_é-1.pdf"]


def test_boxes_and_magic(spark):
    rows = [(-5.0, 612.0), (306.0, 612.0), (700.0, 612.0), (611.9, 612.0)]
    assert one(spark, rows, "x double, w double", ingest.scale_coordinate(F.col("x"), F.col("w"))) == [0, 500, 1000, 999]
    files = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"PK"),)], "content binary")
    assert ingest.pdf_files(files).count() == 1


def test_required_literal():
    assert required_literal(r"u\.?s\.?\s*bank") == "bank"
    assert required_literal(r"\bpnc\s*(bank|financial)?") == "pnc"
    assert required_literal(r"chase\b.*bank") == "chase"
    assert required_literal(r"a|b") == ""


def test_first_writes(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "held")], "pdf_hash string, ts long, v string")
    held = spark.createDataFrame([("b",)], "pdf_hash string")
    assert [(r.pdf_hash, r.v) for r in ingest.first_writes(rows, "pdf_hash", ["ts"], held).collect()] == [("a", "early")]
