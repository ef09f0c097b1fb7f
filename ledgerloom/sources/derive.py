"""Statement-shaped tables derived from the general-purpose test tables.

The given tables hold no bank statements, so statements, page tokens, file listings, label
files and feedback logs are computed from them row by row, with integers, decimals and text
only. Statement keys are blocks of order keys, so nothing here needs a window over an
unbounded key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lexicon import MONTHS
from ledgerloom.functions.money import MONEY
from ledgerloom.operators.scale import ROWS_PER_TASK, spread
from ledgerloom.sources.tables import table

PER_STATEMENT = 100
PER_PAGE = 20
#: Orders of a task that makes tokens: about seven wide rows each, which the chains behind sort several times.
TOKEN_ORDERS = 60_000

PHRASES = [
    "Direct Deposit ACME Payroll", "Apartment Rent May", "City Water Utility", "WALMART Store 1123",
    "STARBUCKS Coffee 88", "Netflix.com monthly", "Zelle to Bob", "ONDECK Lending pmt", "Overdraft item fee",
    "Check #1042", "Refund AMZN order", "Interest paid", "UBER -$17.75 trip $2.00", "Hotel stay −$120.50",
    "Beginning Balance", "Total deposits and other credits", "AB", "Wire in from client", "Service charge",
    "NSF returned item", "Mobile phone Verizon", "current account sweep", "Chipotle 0422", "Spotify",
    "Cash App transfer out", "SBA loan payment", "Kroger #552", "ATM withdrawal 5th Ave",
    "purchase HARDWARE DEPOT", "xyz", "Property Mgmt LLC", "Comcast cable", "Trader Joe 101", "DoorDash order",
    "openai chatgpt", "Venmo cashout", "Bluevine draw", "Monthly fee", "bill payment electric", "Salary March",
    "Deposit branch 12", "POS $45.00 refund $5", "Ending Balance", "ach credit vendor", "ach debit insurer",
    "Misc adjustment", "Café Central", "Panda Express 7"]
NO_AMOUNT = (12, 13, 41)
BANK_LINES = [
    "Wells Fargo Bank", "JPMorgan Chase Bank", "Bank of America", "Citi Cards", "PNC Bank", "TD Bank",
    "Truist Financial", "Regions Bank", "Oak Valley Bank", "Zions Bancorp", "Navy Federal", "US Bank", "Plain Ledger"]
PREAMBLE = ("Thank you for banking with us please review the items below and call the number on your card "
            "with any question soon")
SECTIONS = ["Transaction Detail", "Deposits and Additions", "Account Activity", "Electronic Withdrawals"]
COLUMN_HEADS = ["Date", "Description", "Amount", "Balance"]
PERIOD_LINES = [
    "Statement Period 12/20/2025 - 01/22/2026", "December 25, 2024 through January 28, 2025",
    "Account summary ending June 30, 2023", "01/05/2024 02/10/2024 03/01/2025", "",
    "closing date 2022 and 2023 Jan 2023", "3-1-24 thru 3-31-24", "Mar. 2021 Dec 15, 2030"]
CLOSING_LINES = ["", "Period 11/30/2023 to 12/31/2023", "March 3 2022", "thru 2026"]
FILE_NAMES = [
    "Chase_Statement_{}.pdf", "wells fargo {}.PDF", "BofA-{}.pdf", "invoice_{}.pdf", "TD_bank_{}.pdf", "scan{}.pdf",
    "PNC {}.pdf", "drivers-license-{}.pdf", "statement%20{}.pdf", "USAA_{}_2024.pdf", "Zions {}.pdf", "eStmt_{}.txt",
    "Mar{}.pdf", "Oak Valley {}.pdf"]
FILE_HEADS = [
    "JPMorgan Chase Bank N.A.", "Wells Fargo Online", "Bank of America account statement", "Huntington National Bank",
    "U.S. Bank checking", "Citi Cards", "TD  Bank", "PNC Financial", "capital one", "TRUIST", "Regions Bank",
    "Fifth Third", "Key Bank", "M&T Bank", "Citizens Financial", "BMO Harris", "Ally Bank", "Discover bank", "USAA",
    "Navy Federal Credit Union", "Oak Valley Bank\nMember FDIC", "Mercury", "First National", "Zions Bancorp",
    "Comerica", "First Horizon", "Webster bank", "Federal Credit Union", "Savings Bank of Elm\nFDIC insured",
    "Statement period January to March, account 12: deposits, checks, fees $1.00 $2.00 $3.00", "note", ""]
UPLOAD_NAMES = ["jan statement", "drivers_license", "Stmt-2023", "voided-check", "acct_0925", "ab", "W9 form",
                "march%20bank", "Scan 5"]


def pick(values: list[str], index: Column) -> Column:
    """Element of a constant list by a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(number: Column) -> Column:
    return number.cast("string")


def statement_txns(spark: SparkSession, folder: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Decoded transactions of the orders table, in tasks of a bounded number of rows."""
    orders = table(spark, folder, "orders")
    return txns_of_orders(orders, orders.count(), per_task)


def txns_of_orders(orders: DataFrame, rows: int | None = None, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Decoded transactions: a statement is a block of 100 order keys, a page is 20 of them.

    Where the number of ``rows`` is given, statements are dealt over tasks by it.
    """
    k = F.col("o_orderkey")
    year = 2020 + F.year("o_orderdate") % 10
    month, day = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    name = pick(MONTHS, month - 1)
    two = lambda c: F.lpad(_text(c), 2, "0")
    date = (F.when(k % 8 == 0, F.concat(two(month), F.lit("/"), two(day), F.lit("/"), _text(year)))
            .when(k % 8 == 1, F.concat(_text(month), F.lit("/"), _text(day), F.lit("/"), two(year % 100)))
            .when(k % 8 == 2, F.concat(two(month), F.lit("/"), two(day)))
            .when(k % 8 == 3, F.concat(two(month), F.lit("-"), two(day), F.lit("-"), _text(year)))
            .when(k % 8 == 4, F.concat(F.substring(name, 1, 3), F.lit(" "), _text(day), F.lit(", "), _text(year)))
            .when(k % 8 == 5, F.concat(name, F.lit(" "), _text(day)))
            .when(k % 8 == 6, F.concat(two(month), F.lit("-"), two(day)))
            .when(k % 24 == 7, F.lit("foo"))
            .when(k % 24 == 15, F.lit("2/30"))
            .otherwise(F.concat(F.substring(name, 1, 3), F.lit(" "), _text(day), F.lit(" "), _text(year))))
    cents = (F.when((k % 48).isin(*NO_AMOUNT) | (k % 96 == 16), F.lit(0))
             .otherwise(F.round(F.col("o_totalprice") * 100))).cast("long")
    d = F.floor(k / PER_STATEMENT)
    base = orders.select(
        k.alias("k"), F.col("o_custkey").alias("account"), d.alias("d"),
        F.concat(F.lit("stmt_"), _text(d)).alias("stem"),
        (k % PER_STATEMENT).alias("seq"), F.floor((k % PER_STATEMENT) / PER_PAGE).alias("page"),
        date.alias("date"), pick(PHRASES, k % len(PHRASES)).alias("description"), cents.alias("cents"),
        F.when(k % 5 == 0, "debit").otherwise("unknown").alias("type"),
        F.when(k % 3 == 0, "credit").otherwise("debit").alias("true_type"),
        ((k * 37 % 100) / 100.0).alias("confidence"),
        F.concat(F.lit("stmt_"), _text(d),
                 F.when(d % 3 == 0, "_2023").when(d % 3 == 1, "").otherwise("_1999"),
                 F.lit(".pdf")).alias("source_file"))
    if rows is not None:
        base = spread(base, ["stem"], rows, per_task)
    # 100 rows per statement by construction, so this window is bounded.
    running = Window.partitionBy("stem").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("true_type") == "credit", F.col("cents")).otherwise(-F.col("cents"))
    balance = F.when(k_col() % 3 != 1, 10_000_000 + F.sum(signed).over(running))
    money = lambda c: (c.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)
    return (base.withColumn("balance_cents", balance)
            .withColumn("amount", money(F.col("cents")))
            .withColumn("balance_after", money(F.col("balance_cents"))))


def k_col() -> Column:
    return F.col("k")


def _grouped(cents: Column) -> Column:
    """Cents as grouped text with two decimals."""
    positive = F.abs(cents)
    return F.concat(F.format_number(F.floor(positive / 100), 0), F.lit("."), F.lpad(_text(positive % 100), 2, "0"))


def raw_amount_text(k: Column, cents: Column) -> Column:
    """The ways a statement prints an amount."""
    plain = _grouped(cents)
    return (F.when(k % 6 == 0, F.concat(F.lit("$"), plain)).when(k % 6 == 2, F.concat(F.lit("-"), plain))
            .when(k % 6 == 3, F.concat(F.lit("("), plain, F.lit(")"))).when(k % 6 == 4, F.concat(plain, F.lit("-")))
            .otherwise(plain))


def statement_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical token table: every transaction printed as a row, plus headings and totals.

    ``true_tag`` is the tag the token was printed for; ``pred_tag``/``conf`` imitate a tagger
    that sometimes errs. One exchange (by page) numbers the tokens.
    """
    txns = statement_txns(spark, folder, TOKEN_ORDERS)
    k, d, page, seq = F.col("k"), F.col("d"), F.col("page"), F.col("seq")
    base = 60 + 24 * (seq % PER_PAGE)
    shape = "array<struct<part:int,i:int,text:string>>"

    def line(part: int, *texts: str | Column, when: Column | None = None) -> Column:
        items = F.array(*[F.struct(F.lit(part), F.lit(n), t if isinstance(t, Column) else F.lit(t)) for n, t in enumerate(texts)]).cast(shape)
        return items if when is None else F.when(when, items).otherwise(F.array().cast(shape))

    def one_of(part: int, texts: list[str], index: Column, when: Column | None = None) -> Column:
        items = F.element_at(F.array(*[line(part, *t.split(" ")) for t in texts]), (index + 1).cast("int"))
        return items if when is None else F.when(when, items).otherwise(F.array().cast(shape))

    first = seq % PER_PAGE == 0
    balance = F.concat(F.when(F.col("balance_cents") < 0, "-").otherwise(""), _grouped(F.col("balance_cents")))
    dated = F.transform(F.split("date", " "), lambda t, i: F.struct(F.lit(0).alias("part"), i.alias("i"), t.alias("text"))).cast(shape)
    # Printed texts are constants but for date, amount, balance and reference; their lines are made ready in the plan.
    lines = F.concat(
        dated,
        one_of(1, PHRASES, k % len(PHRASES)),
        line(2, raw_amount_text(k, F.col("cents")), when=F.col("cents") != 0),
        line(3, balance, when=F.col("balance_cents").isNotNull()),
        line(5, "REF", _text(k), when=k % 7 == 3),
        one_of(6, ["Checks Paid", "Other Credits"], F.when(d % 2 == 1, 1).otherwise(0), seq % PER_PAGE == 9),
        one_of(7, BANK_LINES, d % len(BANK_LINES), first & (page == 0)),
        line(8, *PREAMBLE.split(" "), when=first & (page == 0) & (d % 2 == 0)),
        one_of(9, SECTIONS, (d + page) % len(SECTIONS), first),
        line(10, *COLUMN_HEADS, when=first & ((d + page) % 5 != 4)),
        line(11, "Daily", "Ending", "Balance", when=first & (page % 2 == 1)),
        line(12, "01/31", "1,000.00", when=first & (page % 2 == 1)),
        line(13, "Ending", "Balance", "123.45", when=first))
    part, i = F.col("part"), F.col("i")
    line_top = F.when(part < 4, base).when(part.isin(5, 6), base + 12)
    for number, height in ((7, 4), (8, 16), (9, 28), (10, 40), (11, 560), (12, 575), (13, 590)):
        line_top = line_top.when(part == number, height)
    x0 = (F.when(part == 0, 50 + 30 * i).when(part == 2, F.lit(700)).when(part == 3, F.lit(850))
          .when(part == 10, F.element_at(F.array(*[F.lit(x) for x in (50, 150, 700, 850)]), i + 1))
          .when(part.isin(1, 5), 150 + 40 * i).otherwise(60 + 40 * i))
    top = (F.col("line_top") + F.when(part == 1, i % 3 * 3).when(part == 2, F.lit(5)).otherwise(F.lit(0))).cast("double")
    true_tag = (F.when(part == 0, F.when(i == 0, "B-DATE").otherwise("I-DATE"))
                .when(part == 1, F.when(i == 0, "B-DESC").otherwise("I-DESC"))
                .when(part == 2, "B-AMOUNT").when(part == 3, "B-BALANCE").when(part == 5, "I-DESC").otherwise("O"))
    noise = (k * 31 + i * 17 + part * 7) % 100
    pred = (F.when(noise < 6, "O")
            .when((noise < 12) & true_tag.startswith("B-"), F.concat(F.lit("I-"), F.substring(true_tag, 3, 10)))
            .otherwise(true_tag))
    by_page = Window.partitionBy("stem", "page_index").orderBy("line_top", "part", "i")
    # The lines are a column of their own: within the generator their expressions would be interpreted row by row.
    return (txns.select("k", "d", "stem", "seq", F.col("page").alias("page_index"), lines.alias("_lines"))
            .select("k", "d", "stem", "seq", "page_index", F.inline("_lines"))
            .withColumn("line_top", line_top.cast("int"))
            .select("k", "d", "stem", "page_index", "line_top", "part", "i", "text",
                    x0.cast("int").alias("x0"), F.col("line_top").alias("y0"), (x0 + 30).cast("int").alias("x1"),
                    (F.col("line_top") + 10).alias("y1"), top.alias("top"), (top + 10).alias("bottom"),
                    true_tag.alias("true_tag"), pred.alias("pred_tag"), (noise / 100.0).alias("conf"))
            .withColumn("pos", F.row_number().over(by_page) - 1)
            .drop("line_top", "part", "i"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """First and last page text of every document: both halves of the text with period lines."""
    doc = F.col("doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    start = F.concat(pick(PERIOD_LINES, doc % len(PERIOD_LINES)), F.lit("\n"),
                     F.substr("text", F.lit(1), half))
    end = F.when(doc % 5 < 4, F.concat(F.substr("text", half + 1), F.lit("\n"),
                                       pick(CLOSING_LINES + [""], doc % 5)))
    return table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), _text(doc)).alias("stem"), doc.alias("doc_id"),
        start.alias("first_page"), end.alias("last_page"))


def statement_files(spark: SparkSession, folder: str) -> DataFrame:
    """File listing with names, sizes, page counts and first-page text."""
    doc = F.col("doc_id")
    name = F.replace(pick(FILE_NAMES, doc % len(FILE_NAMES)), F.lit("{}"), _text(doc))
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), name).alias("path"), name.alias("name"),
        F.concat(F.lit("f_"), F.lpad(_text(doc), 9, "0")).alias("stem"),
        (F.col("n_chars") * 40).alias("size"), (doc % 9).alias("pages"),
        F.concat(pick(FILE_HEADS, (doc * 7) % len(FILE_HEADS)), F.lit("\n"), F.col("text")).alias("text"))


def training_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page inventory with label, review and alignment state (five documents make a statement)."""
    doc = F.col("doc_id")
    group = F.floor(doc / 5)
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return (table(spark, folder, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").select(
        "doc_id", F.concat(F.when(group % 4 == 0, "auto_").otherwise("doc_"), _text(group)).alias("stem"),
        (doc % 5).alias("page_index"), F.col("quality").isNotNull().alias("labelled"),
        ((doc * 13) % 101).cast("double").alias("alignment_rate"),
        (F.col("quality").isNotNull() & (doc % 3 != 0)).alias("reviewed"),
        F.when(F.col("quality").isNotNull() & (doc % 3 != 0),
               F.when(F.col("quality") == 1, "accepted").otherwise("rejected")).alias("review_status"),
        pick(["manual", "auto", "rules", ""], doc % 4).alias("raw_source"),
        (doc % 7 != 0).alias("has_image"), F.col("n_chars").alias("word_count"),
        (doc % 11 == 0).alias("parse_error"), (doc % 6).alias("n_txns")))


def feedback_log(spark: SparkSession, folder: str) -> DataFrame:
    """Service log: one row per parsed statement."""
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        e.alias("event_id"), F.col("user_id").alias("deal_id"), F.col("event_type").alias("method"),
        (e % 50).alias("transaction_count"), F.col("value").cast("decimal(18,2)").alias("total_deposits"),
        (e % 900).cast("decimal(18,2)").alias("total_withdrawals"), (1 + e % 6).alias("page_count"),
        F.when(e % 7 == 0, F.array().cast("array<bigint>"))
        .otherwise(F.sequence(F.lit(0).cast("long"), e % 7 - 1)).alias("low_confidence_pages"),
        (e * 17 % 5000).alias("processing_time_ms"), F.concat(F.lit("v"), _text(e % 5)).alias("model_version"),
        F.when(e % 3 != 0, "fallback").alias("shadow_method"),
        F.when(e % 3 != 0, e % 47).alias("shadow_transaction_count"),
        F.when(e % 3 != 0, F.col("value") + (e % 4)).cast("decimal(18,2)").alias("shadow_total_deposits"),
        (e % 11 == 0).alias("corrected"), F.col("ts").alias("created_at"))


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Form submissions: answers keyed by field, an answer being a JSON list or plain text."""
    p = F.col("page_id")
    root = F.regexp_replace("url", "[?#].*$", "")
    name = pick(UPLOAD_NAMES, p % len(UPLOAD_NAMES))
    one = F.concat(root, F.lit("/"), name, F.lit("_"), _text(p % 40), F.lit(".pdf"))
    two = F.concat(root, F.lit("/copy.PDF"))
    link = F.concat(F.lit("http://forms.example.com/u/"), _text(p % 40), F.lit("/stmt.pdf"))
    field = lambda kind, answer, pretty: F.struct(
        F.lit(kind).alias("type"), answer.alias("answer"), pretty.alias("pretty_format"))
    none = F.lit(None).cast("string")
    return table(spark, folder, "pages").select(
        p.alias("id"), (p % 4).alias("form"),
        F.create_map(
            F.lit("1"), field("control_fileupload", F.when(p % 3 == 0, one).otherwise(
                F.concat(F.lit('["'), one, F.lit('","'), two, F.lit('","'), root, F.lit('"]'))), none),
            F.lit("2"), field("control_widget", F.when(p % 2 == 0, F.lit("n/a")).otherwise(two),
                              F.concat(F.lit('<a href="'), link, F.lit('">x</a> <a href='), one, F.lit('>'))),
            F.lit("3"), field("control_textbox", F.when(p % 5 == 0, F.concat(link, F.lit("?v=1"))).otherwise(
                F.substring("html", 1, 100000000)), none)).alias("answers"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model responses: clean, fenced, truncated and non-JSON texts."""
    n = F.col("conv_id") + F.col("turn")
    size = _text(F.length("text"))
    first = F.concat(F.lit('{"date":"01/02","description":"ITEM '), size, F.lit('","amount":12.5,"type":"credit"}'))
    second = F.concat(F.lit('{"date":"01/03","description":"FEE, NSF","amount":-'), size,
                      F.lit('.25,"type":"debit","balance_after":10.0}'))
    whole = F.concat(F.lit('{"transactions":['), first, F.lit(","), second, F.lit("]}"))
    cut = F.concat(F.lit('{"transactions":['), first, F.lit(","), second, F.lit(',{"date":"01/0'))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.when(n % 5 == 0, whole)
        .when(n % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(n % 5 == 2, F.concat(F.lit("```json\n"), whole, F.lit("\n```\nDone\n```")))
        .when(n % 5 == 3, cut).otherwise(F.col("text")).alias("text"),
        F.when((n % 5 == 3) & (F.col("conv_id") % 2 == 0), "max_tokens").otherwise("end_turn").alias("stop_reason"))


def deal_documents(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = pick(["application/pdf", "image/png", "Application/PDF; v=1", "text/plain"], k % 4)
    name = F.concat(F.lower("o_orderpriority"), F.lit(" "), _text(k),
                    pick([".pdf", ".PDF", ".png", ".txt", ".é"], k % 5))
    return table(spark, folder, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("deal_id"), name.alias("file_name"),
        F.concat(F.lit("deals/"), _text(k)).alias("storage_path"), F.lit("secure-pdfs").alias("bucket"),
        kind.alias("content_type"))


def applications(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    upload = lambda i: F.struct(
        F.concat(F.lit("st "), _text(c), F.lit("_"), _text(i), pick([".pdf", ".PDF", ".jpg"], (c + i) % 3))
        .alias("filename"),
        F.when((c + i) % 5 != 0, F.concat(F.lit("apps/"), _text(c))).alias("storage_path"))
    return table(spark, folder, "customer").select(
        c.alias("id"), F.struct(F.when(c % 4 != 0, F.transform(
            F.sequence(F.lit(0).cast("long"), c % 4 - 1), upload)).alias("uploaded_statements")).alias("payload"))


def evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Model versions with scores: one per part brand and size."""
    return (table(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
            .select(F.concat("p_brand", F.lit("-"), F.lpad(_text(F.col("p_size")), 3, "0")).alias("model_version"),
                    F.col("p_brand").alias("family"),
                    ((F.col("n") * 37 + F.col("p_size") * 13) % 1000 / 1000.0).alias("f1"),
                    ((F.col("n") * 11 + F.col("p_size") * 7) % 1000 / 1000.0).alias("txn_f1")))
