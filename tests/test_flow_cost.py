"""What whole flows shuffle and pass over: plans that must not grow again, and results that must stay."""

from pyspark.sql import functions as F

from ledgerloom.operators import align as al
from ledgerloom.operators import layout as ly
from ledgerloom.operators import tagging as tg
from ledgerloom.operators import transactions as tx
from ledgerloom.plans import spending
from ledgerloom.sources import derive as dv


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def pages(spark):
    """Pages of three statements with an area, a heading, dated rows and an end; a null statement among them."""
    rows = []
    for stem in ("a", "b", None):
        for page in range(2):
            words = "Acme Bank Deposits Date Description Amount Balance".split()
            for n in range(4):
                words += ["01/0%d" % (n + 1), "shop", "%d.00" % (n + 1), "%d.00" % (90 - n)]
            for pos, word in enumerate(words):
                line, x = (0, pos) if pos < 3 else (1, pos - 3) if pos < 7 else (2 + (pos - 7) // 4, (pos - 7) % 4)
                rows.append((stem, page, pos, word, [0, 150, 700, 850][x % 4], 20.0 * line, "O" if pos % 5 else "B-DATE", 0.5 if page else 0.9))
    return spark.createDataFrame(rows, "stem string, page_index int, pos int, text string, x0 int, top double, tag string, conf double")


def test_sections_meet_their_transactions_without_dealing_words_again(spark):
    tokens = pages(spark).repartition(3, "stem")
    txns = tx.build_transactions(tg.decode(tg.rule_tags(tokens.drop("tag", "conf")).withColumn("conf", F.lit(1.0))))
    located = ly.section_of(txns, ly.page_sections(tokens))
    assert "ENSURE_REQUIREMENTS" not in plan_of(located)
    found = located.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count("section_type").alias("typed")).collect()
    assert sorted((str(r.stem), r.n, r.typed) for r in found) == [("None", 8, 0), ("a", 8, 8), ("b", 8, 8)]  # a null statement has no page


def test_rule_tags_and_decoder_share_windows(spark):
    decoded = tg.decode(tg.rule_tags(ly.trim_sections(pages(spark).drop("tag", "conf"))).withColumn("conf", F.lit(1.0)))
    assert plan_of(decoded).count("- Window ") <= 13


def test_words_are_counted_in_the_pass_that_finds_low_pages(spark):
    tokens = pages(spark)
    txns = spending.parse_statements(tokens.drop("tag", "conf"))
    apart = spending.parse_results(txns, tokens.drop("tag", "conf"), tokens, "v").filter("stem is not null").collect()
    at_once = spending.parse_results(txns, tokens, None, "v").filter("stem is not null").collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, apart))
    assert sorted((str(r.stem), r.page_count, r.word_count, r.n_low_pages) for r in at_once) == [("a", 2, 46, 1), ("b", 2, 46, 1)]


def test_labels_meet_their_pages_without_dealing_words_again(spark):
    tokens = pages(spark).drop("tag", "conf")
    labels = spark.createDataFrame(
        [(stem, page, n, "01/0%d" % (n + 1), n + 1.0, 90.0 - n) for stem in ("a", None, "gone") for page in (0, 1) for n in range(4)],
        "stem string, page_index int, seq int, date string, amount double, balance_after double").withColumns(
        {c: F.col(c).cast("decimal(18,2)") for c in ("amount", "balance_after")})
    tagged = al.align_tokens(tokens.repartition(3, "stem"), labels.repartition(3, "stem"))
    assert "ENSURE_REQUIREMENTS" not in plan_of(tagged)
    found = tagged.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tag") == "B-DATE").alias("dates"),
                                       F.count_if(F.col("tag") == "B-BALANCE").alias("balances")).collect()
    # Labels of no page and labels without a statement tag nothing; pages without labels keep all their words.
    assert sorted((str(r.stem), r.n, r.dates, r.balances) for r in found) == [("None", 46, 0, 0), ("a", 46, 8, 8), ("b", 46, 0, 0)]


def test_printed_lines_are_made_outside_the_generator(spark):
    """A generator interprets its expressions row by row; the lines are a column that it only takes apart."""
    assert "Generate inline(_lines" in plan_of(dv.statement_tokens(spark, "/root/testdata/sf0.001"))
