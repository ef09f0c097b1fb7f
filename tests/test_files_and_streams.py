"""JSON page folders, listings, sinks, and streams that equal their batch results."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.sources import derive as dv
from ledgerloom.sources import files as fs
from ledgerloom.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def page(folder, stem, index, kind, payload):
    target = folder / stem
    target.mkdir(parents=True, exist_ok=True)
    (target / f"page_{index}_{kind}.json").write_text(json.dumps(payload, indent=2))


def test_page_folders(spark, tmp_path):
    word = {"text": "Hi", "bbox": [1, 2, 3, 4], "top": 5.5, "bottom": 6.5}
    page(tmp_path, "stmt one", 0, "words", {"pdf": "a.pdf", "page_index": 0, "total_pages": 1, "used_ocr": False, "word_count": 1, "words": [word, word]})
    page(tmp_path, "stmt one", 12, "labels", {"transactions": [{"date": "01/02", "amount": 3.5, "type": "credit"}], "has_transactions": True})
    page(tmp_path, "b", 3, "bio", {"pdf_stem": "b", "page_index": 3, "words": ["x"], "tags": ["O"], "tag_counts": {"O": 1}, "alignment_rate": 75.0})
    words = fs.token_table(fs.read_pages(spark, str(tmp_path))).collect()
    assert [(w.stem, w.page_index, w.pos, w.text, w.x0, w.y1, w.top) for w in words] == [("stmt one", 0, 0, "Hi", 1, 4, 5.5), ("stmt one", 0, 1, "Hi", 1, 4, 5.5)]
    label = fs.read_pages(spark, str(tmp_path), "labels").collect()[0]
    assert (label.stem, label.page_index, label.transactions[0].amount) == ("stmt one", 12, 3.5)
    bio = fs.read_pages(spark, str(tmp_path), "bio").collect()[0]
    assert bio.tags == ["O"] and bio.tag_counts == {"O": 1}


def test_pages_are_written_where_they_are_read(spark, tmp_path):
    """One file per page, named by the task that wrote it, below a folder per statement; odd stems included."""
    stems = ["a b", "x/y", "50%", None, ""]
    tokens = spark.createDataFrame([(s, p, i, f"w{i}", 1, 2, 3, 4, 5.0, 6.0) for s in stems for p in (0, 11) for i in range(2)],
                                   "stem string, page_index int, pos int, text string, x0 int, y0 int, x1 int, y1 int, top double, bottom double")
    fs.write_page_files(fs.word_pages(tokens).withColumn("pdf", F.col("stem")), str(tmp_path / "out"))
    names = sorted(str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*.json"))
    assert len(names) == 10 and "a b/page_11_words.json" in names
    read = fs.read_pages(spark, str(tmp_path / "out")).collect()
    assert sorted((str(r.pdf), r.page_index, [w.text for w in r.words]) for r in read) == sorted(
        (str(s), p, ["w0", "w1"]) for s in stems for p in (0, 11))


def test_feedback_files(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"pdf_hash": "h", "bank_format": "Chase", "flagged_details": [{"page": 1, "description": "x", "confidence": 0.5}]}, indent=1))
    row = fs.read_feedback(spark, str(tmp_path)).collect()[0]
    assert (row.pdf_hash, row.flagged_details[0].confidence) == ("h", 0.5)


def test_statement_listing(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", "d/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    listed = fs.list_statements(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed) == ["a.pdf", "b.PDF", "e.pdf"]


def test_page_write_replaces_only_its_buckets(spark, tmp_path):
    target = str(tmp_path / "bio")
    rows = spark.createDataFrame([(f"s{i}", 0, 1) for i in range(20)], "stem string, page_index int, v int")
    fs.write_pages(rows, target, buckets=4)
    fs.write_pages(rows.filter("stem in ('s0')").withColumn("v", F.lit(2)).unionByName(
        rows.join(rows.filter("stem = 's0'").select(F.pmod(F.xxhash64("stem"), F.lit(4)).alias("b")), F.pmod(F.xxhash64("stem"), F.lit(4)) == F.col("b")).drop("b").filter("stem <> 's0'")), target, buckets=4)
    back = {r.stem: r.v for r in spark.read.parquet(target).collect()}
    assert len(back) == 20 and back.pop("s0") == 2 and set(back.values()) == {1}


def split_orders(spark, tmp_path):
    """The orders table as three files that arrive one after the other."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    folder = tmp_path / "in"
    top = orders.agg(F.max("o_orderkey")).first()[0] + 1
    for i in range(3):
        low, high = (top * i // 3, top * (i + 1) // 3)
        orders.filter((F.col("o_orderkey") >= low) & (F.col("o_orderkey") < high)).coalesce(1).write.mode("append").parquet(str(folder))
    return orders, spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def files_of(spark, folder, schema, batches):
    """A stream that reads one given list of rows per batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


BALANCES = "stem string, seq long, amount decimal(18,2), balance_after decimal(18,2)"


@pytest.mark.parametrize("block", [4096, 8])
def test_balances_of_shuffled_rows_equal_batch(spark, tmp_path, block):
    draw = random.Random(block)
    rows = [(stem, seq, Decimal(draw.randrange(-500, 500)) / 100, None if draw.random() < 0.6 else Decimal(draw.randrange(10**6)) / 100)
            for stem, size in (("a", 60), ("b", 25), (None, 12), ("empty", 3)) for seq in range(size)]
    rows = [(stem, seq, amount, None if stem == "empty" else balance) for stem, seq, amount, balance in rows]
    expected, last = {}, {}
    for stem, seq, amount, balance in rows:  # in order
        expected[stem, seq] = (amount, balance, last.get(stem))
        last[stem] = last.get(stem) if balance is None else balance
    draw.shuffle(rows)
    got = jobs.run_balances(spark, files_of(spark, tmp_path / "in", BALANCES, [rows[i::4] for i in range(4)]), block).collect()
    assert len(got) == len(rows)
    assert {(r.stem, r.seq): (r.amount, r.balance_after, r.prev_balance) for r in got} == expected


def test_late_and_repeated_balances_correct_later_rows(spark, tmp_path):
    batches = [[("s", 5, None, None), ("s", 9, None, Decimal("9.00")), ("s", None, Decimal("1.50"), Decimal("2.50"))],
               [("s", 2, None, Decimal("2.00"))], [("s", 2, None, Decimal("7.25")), ("s", 2, None, None), ("s", 12, None, None)]]
    got = jobs.run_balances(spark, files_of(spark, tmp_path / "in", BALANCES, batches), 4).collect()
    seen = {r.seq: (r.balance_after, r.prev_balance) for r in got}
    assert len(got) == 5 and seen == {2: (Decimal("7.25"), None), 5: (None, Decimal("7.25")), 9: (Decimal("9.00"), Decimal("7.25")),
                                      12: (None, Decimal("9.00")), None: (Decimal("2.50"), None)}


def test_a_batch_writes_only_changed_positions(spark, tmp_path):
    """Ten rows of one block, then one balance in their middle: the log gains it and the rows up to the next balance."""
    first = [("s", seq, None, Decimal(seq) if seq in (0, 7) else None) for seq in range(10) if seq != 4]
    log = []
    latest = jobs.latest_balances
    try:
        jobs.latest_balances = lambda rows: log.append(rows) or latest(rows)
        jobs.run_balances(spark, files_of(spark, tmp_path / "in", BALANCES, [first, [("s", 4, None, Decimal(4))]]))
    finally:
        jobs.latest_balances = latest
    assert sorted(r.seq for r in log[0].filter("batch_id = 1").collect()) == [4, 5, 6, 7]


def test_retrain_signal_once_per_crossing(spark, tmp_path):
    sizes = [{"a": 30, "b": 9, None: 3}, {"a": 75, None: 8}, {"b": 1, "a": 5}, {"c": 4}]
    batches = [[(key,) for key, n in batch.items() for _ in range(n)] for batch in sizes]
    stream = files_of(spark, tmp_path / "in", "bank string", batches)
    rows = jobs.run_retrain_signals(spark, stream, "bank", 10).collect()
    assert sorted((str(r.key), r.signal, r.pages) for r in rows) == sorted(
        [("a", k, 10 * k) for k in range(1, 12)] + [("b", 1, 10), ("None", 1, 10)])


def test_new_statements_across_batches(spark, tmp_path):
    stream = files_of(spark, tmp_path / "in", "k string", [[("a",), ("b",), ("a",)], [("b",), (None,), ("old",)], [("c",), (None,), ("a",)]])
    known = spark.createDataFrame([("old",)], "k string")
    assert sorted(str(r.k) for r in jobs.run_new_statements(spark, stream, "k", known).collect()) == ["None", "a", "b", "c"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_monthly_stream_equals_batch(spark, tmp_path):
    orders, stream = split_orders(spark, tmp_path)

    def deltas(batch):
        rows = batch.select(F.date_format("o_orderdate", "yyyy-MM").alias("month_key"), F.when(F.col("o_orderkey") % 3 == 0, "credit").otherwise("debit").alias("type"),
                            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
        return jobs.monthly_deltas(rows)

    key = lambda df: {r.month_key: (r.income, r.expenses, r.n) for r in df.collect()}
    streamed = jobs.run_batches(spark, stream, "months", deltas)
    assert streamed.select("batch_id").distinct().count() == 3
    assert key(jobs.merge_months(streamed)) == key(jobs.merge_months(deltas(orders)))


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_streamed_table_of_several_files(spark, tmp_path, parts):
    """A table is a folder of files where it is large; the trigger counts the pages of all of them, or of none."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    (docs.repartition(parts) if parts else docs.limit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(7).write.parquet(str(tmp_path / "other.parquet"))
    row = entry.queries()["str4_retrain_trigger"](spark, str(tmp_path)).collect()
    due = docs.filter(F.floor(F.col("doc_id") / 5) % 4 == 0).count() if parts else 0
    assert [tuple(r) for r in row] == [(due, due >= 50)]


def test_each_fingerprint_once(spark, tmp_path):
    _, stream = split_orders(spark, tmp_path)
    events = stream.select((F.col("o_custkey") % 7).alias("pdf_hash"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = jobs.run_to_table(spark, jobs.new_statements(events, "pdf_hash", "ts", delay="9000 days"), "once").collect()
    assert sorted(r.pdf_hash for r in rows) == list(range(7))
