"""Operators against plain sequential versions on random small inputs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.fuzzy import Pattern
from ledgerloom.functions.text import required_literal
from ledgerloom.operators import align, ingest, layout, sampling, scale, tagging

TAGS = lx.BIO_TAGS


def sequential_decode(tokens):
    """One pass over a page, holding the fields of the open transaction."""
    done, held, confs = [], {}, []
    for word, tag, conf in tokens:
        if tag == "O":
            continue
        kind, field = tag[0], tag[2:].lower()
        if kind == "B":
            if field == "date" and "date" in held:
                done.append((held, confs))
                held, confs = {}, []
            held[field] = word
        elif field in held:
            tight = field in ("amount", "balance") or (
                field == "date" and (held[field][-1] in "/-" or word in ("/", "-", ",")))
            held[field] += word if tight else " " + word
        elif held:
            held[field] = word
        confs.append(conf)
    if "date" in held:
        done.append((held, confs))
    return [(h.get("date"), h.get("desc"), h.get("amount"), h.get("balance"), round(sum(c) / len(c), 6)) for h, c in done]


def sequential_strict(tokens):
    done, held = [], {}
    for word, tag, _ in tokens:
        if tag.startswith("B-"):
            field = tag[2:].lower()
            if field == "date" and "date" in held:
                done.append(held)
                held = {}
            held[field] = word
        elif tag.startswith("I-") and tag[2:].lower() in held:
            held[tag[2:].lower()] += " " + word
    if "date" in held:
        done.append(held)
    return [(h.get("date"), h.get("desc"), h.get("amount"), h.get("balance")) for h in done]


def test_decoders_match_sequential_fold(spark):
    rng = random.Random(7)
    pages, rows = {}, []
    for page in range(400):
        tokens = [(rng.choice(["a", "b", "/", "-", "x/", "7"]), rng.choice(TAGS), rng.randint(0, 99) / 100) for _ in range(rng.randint(1, 14))]
        pages[page] = tokens
        rows += [("s", page, i, w, t, c) for i, (w, t, c) in enumerate(tokens)]
    df = spark.createDataFrame(rows, "stem string, page_index long, pos long, text string, tag string, conf double")
    got, strict = {}, {}
    for r in tagging.decode(df).orderBy("seq").collect():
        got.setdefault(r.page, []).append((r.date_text, r.desc_text, r.amount_text, r.balance_text, round(float(r.mean_conf), 6)))
    for r in tagging.decode_strict(df).orderBy("seq").collect():
        strict.setdefault(r.page, []).append((r.date_text, r.desc_text, r.amount_text, r.balance_text))
    for page, tokens in pages.items():
        assert got.get(page, []) == sequential_decode(tokens), tokens
        assert strict.get(page, []) == sequential_strict(tokens), tokens


def test_visual_rows_match_sequential_scan(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for page in range(60):
        words = [(i, float(rng.randint(0, 60)), rng.randint(0, 50)) for i in range(rng.randint(1, 25))]
        index, anchor = -1, None
        for pos, top, _ in sorted(words, key=lambda w: (w[1], w[2])):
            if anchor is None or top - anchor > 8:
                index, anchor = index + 1, top
            expected[(page, pos)] = index
        rows += [("s", page, pos, top, x, "w") for pos, top, x in words]
    df = spark.createDataFrame(rows, "stem string, page_index int, pos int, top double, x0 int, text string")
    assert {(r.page_index, r.pos): r.row_index for r in layout.visual_rows(df).collect()} == expected


def sequential_tags(words):
    """Row by row over a page, keeping the last transaction row and description column."""
    order = sorted(words, key=lambda w: (w["top"], w["x0"], w["pos"]))
    rows, anchor = [], None
    for w in order:
        if anchor is None or w["top"] - anchor > 8:
            rows.append([])
            anchor = w["top"]
        rows[-1].append(w)
    rows = [sorted(r, key=lambda w: w["x0"]) for r in rows]
    import re
    is_date = lambda t: re.match(lx.DATE_TOKEN, t)
    is_amount = lambda t: re.match(lx.AMOUNT_TOKEN, t)
    is_month = lambda t: t.lower().rstrip(".") in lx.MONTH_WORDS

    def header(row):
        texts = {w["text"].lower() for w in row}
        return sum(bool(texts & set(names)) for _, names in lx.HEADER_WORDS) >= 2

    def marker(row):
        text = " ".join(w["text"] for w in row).lower()
        return any(p in text for p in lx.ROW_MARKER_PHRASES) or (
            len(row) <= 3 and row[0]["text"].lower().strip("*") in lx.ROW_MARKER_WORDS)

    xs = dict(lx.DEFAULT_COLUMNS)
    for row in rows:
        if header(row):
            for w in row:
                kind = next((k for k, names in lx.HEADER_WORDS if w["text"].lower() in names), None)
                if kind:
                    xs[kind] = w["x0"]
            break
    tags = {w["pos"]: "O" for w in words}
    last, desc_x = -1, xs["description"]
    for i, row in enumerate(rows):
        if marker(row) or header(row):
            continue
        texts = [w["text"] for w in row]
        date = next((p for p, t in enumerate(texts) if is_date(t) or (
            is_month(t) and p + 1 < len(row) and re.match(r"^\d{1,2},?$", texts[p + 1]))), None)
        amounts = [p for p, t in enumerate(texts) if is_amount(t)]
        if date is not None and amounts:
            tags[row[date]["pos"]] = "B-DATE"
            end = date
            if is_month(texts[date]):
                end = date + 1
                tags[row[end]["pos"]] = "I-DATE"
                if end + 1 < len(row) and re.match(r"^\d{2,4}$", texts[end + 1]):
                    end += 1
                    tags[row[end]["pos"]] = "I-DATE"
            for n, p in enumerate(amounts):
                tags[row[p]["pos"]] = "B-BALANCE" if len(amounts) > 1 and n == len(amounts) - 1 else "B-AMOUNT"
            for n, p in enumerate(range(end + 1, amounts[0])):
                tags[row[p]["pos"]] = "I-DESC" if n else "B-DESC"
                desc_x = desc_x if n else row[p]["x0"]
            last = i
        elif last == i - 1 and date is None and not amounts:
            if abs(row[0]["x0"] - desc_x) < 80 and row[0]["x0"] > xs["date"] + 30:
                for w in row:
                    tags[w["pos"]] = "I-DESC"
                last = i
    return tags


def test_rule_tags_match_sequential_scan(spark):
    rng = random.Random(11)
    vocabulary = ["01/02", "Jan", "5", "5,", "2025", "1,234.56", "$9.00", "SHOP", "ACME", "Balance", "Date", "Amount", "Description", "total", "*checks", "x"]
    rows, expected = [], {}
    for page in range(300):
        words = [{"pos": i, "text": rng.choice(vocabulary), "top": float(rng.choice([0, 3, 10, 20, 21, 32, 44])), "x0": rng.choice([0, 40, 60, 110, 130, 170, 300, 700, 850])}
                 for i in range(rng.randint(1, 16))]
        # Equal positions within a row would leave the order open.
        seen, kept = set(), []
        for w in words:
            if (w["top"] // 9, w["x0"]) not in seen:
                seen.add((w["top"] // 9, w["x0"]))
                kept.append(w)
        for p, t in sequential_tags(kept).items():
            expected[(page, p)] = t
        rows += [("s", page, w["pos"], w["text"], w["x0"], w["top"]) for w in kept]
    df = spark.createDataFrame(rows, "stem string, page_index int, pos int, text string, x0 int, top double")
    got = {(r.page_index, r.pos): r.tag for r in tagging.rule_tags(df).collect()}
    assert got == expected


def test_blocked_previous_value_equals_plain_window(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randint(0, 3)}", i, rng.randint(0, 9) if rng.random() < 0.3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "stem string, seq long, v int")
    plain = Window.partitionBy("stem").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    expected = {r.seq: r.p for r in df.withColumn("p", F.last("v", ignorenulls=True).over(plain)).collect()}
    for block in (1, 7, 10_000):
        got = scale.previous_value(df, ["stem"], "seq", "v", "p", block).collect()
        assert {r.seq: r.p for r in got} == expected and len(got) == len(rows)


def test_exact_rank_equals_row_number(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.randint(0, 4), f"k{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "bank string, pages int, stem string")
    plain = Window.partitionBy("bank").orderBy("pages", "stem")
    expected = {r.stem: r.n for r in df.withColumn("n", F.row_number().over(plain)).collect()}
    got = scale.exact_rank(df, ["bank"], ["pages"], [F.col("stem")], "n", "total").collect()
    assert {r.stem: r.n for r in got} == expected
    assert {(r.bank, r.total) for r in got} == {(b, sum(x[0] == b for x in rows)) for b in ("hot", "cold")}


def test_quota_and_split(spark):
    files = spark.createDataFrame([("Chase" if i % 3 else "USAA", f"f{i}", i % 5) for i in range(200)], "bank string, stem string, pages long")
    quotas = {"Chase": 6, "USAA": 2}
    picked = sampling.quota_sample(files, quotas).groupBy("bank").count().collect()
    assert {r["bank"]: r["count"] for r in picked} == quotas
    pages = spark.createDataFrame([(f"s{i // 4}", i % 4) for i in range(400)], "stem string, page_index int")
    leaks = sampling.group_split(pages).groupBy("stem").agg(F.countDistinct("split").alias("n")).filter("n > 1")
    assert leaks.count() == 0


def test_not_done_is_idempotent(spark):
    todo = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "stem string, page_index int")
    done = todo.filter("stem = 'a' and page_index = 1")
    left = ingest.not_done(todo, done, ["stem", "page_index"])
    assert left.count() == 2 and ingest.not_done(todo, done.union(left), ["stem", "page_index"]).count() == 0
    assert ingest.not_done(todo, done, ["stem", "page_index"], force=True).count() == 3


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        before = list(row)
        for j, other in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if ch == other else max(before[j], row[j - 1])
    return row[-1]


def test_pattern_ratio_equals_table():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("01/ja ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        total = len(a) + len(b)
        expected = 200.0 * plain_lcs(a, b) / total if total else 100.0
        assert abs(Pattern(a).ratio(b) - expected) < 1e-9 and Pattern(a).limit(b) >= expected - 1e-9


def test_literals_occur_in_every_match():
    import re
    texts = ["jpmorgan chase bank", "us bank", "u.s. bank", "td  bank", "pnc", "m & t bank", "regions financial", "wf ", "credit union",
             "national bank of arizona", "key bank", "harris bank", "citi", "ally financial", "zions bancorp", "federal credit", "savings bank"]
    patterns = [p for _, a, b in lx.SURVEYED_BANKS for p in (*a, *b)] + [p for _, ps, _ in lx.SAMPLED_BANKS for p in ps] + [p for p, _ in lx.HEADER_BANKS]
    for pattern in patterns:
        for text in texts:
            hit = re.search(pattern.lower(), text)
            assert not hit or required_literal(pattern.lower()) in hit.group()


def test_chunks_cover_pages_and_overlap(spark):
    rows = [("s", p, i, "w") for p, n in enumerate([10, 64, 65, 200, 400]) for i in range(n)]
    df = spark.createDataFrame(rows, "stem string, page_index int, pos int, text string")
    chunks = tagging.split_chunks(df, 64).groupBy("page_index", "chunk").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    for page, n in enumerate([10, 64, 65, 200, 400]):
        spans = sorted((r.chunk, r.a, r.b) for r in chunks if r.page_index == page)
        assert spans[0][1] == 0 and spans[-1][2] == n - 1
        assert all(later[1] <= earlier[2] - 18 for earlier, later in zip(spans, spans[1:]))


def brute_align(words, txns):
    """Every variant against every token and token pair, best first."""
    tags, used = ["O"] * len(words), set()
    row = [w["row"] for w in words]
    for t in txns:
        best, date = 0, -1
        for v in t["dates"]:
            for i, w in enumerate(words):
                options = [w["text"]]
                if i + 1 < len(words) and row[i] == row[i + 1]:
                    options.append(w["text"] + " " + words[i + 1]["text"])
                for option in options:
                    total = len(option) + len(v)
                    score = 200.0 * plain_lcs(v, option) / total
                    if score > best and score >= 70 and row[i] not in used:
                        best, date = score, i
        if date < 0:
            continue

        def pick(variants, skip):
            top, found = 0, -1
            for v in variants:
                for i, w in enumerate(words):
                    if not row[date] <= row[i] < row[date] + 3 or i in skip:
                        continue
                    total = len(v) + len(w["clean"])
                    score = 200.0 * plain_lcs(v, w["clean"]) / total if total else 100.0
                    if score > top and score >= 80:
                        top, found = score, i
            return found

        amount = pick(t["amounts"], set())
        if amount < 0:
            continue
        used.add(row[date])
        tags[date] = "B-DATE"
        tail = [k for k in (date + 1, date + 2) if k < len(words) and row[k] == row[date]]
        more = 0
        while more < len(tail) and (words[tail[more]]["text"] in ",/-" or (
                words[tail[more]]["text"].isdigit() and len(words[tail[more]]["text"]) in ((1, 2), (2, 3, 4))[more])):
            tags[tail[more]] = "I-DATE"
            more += 1
        tags[amount] = "B-AMOUNT"
        if row[amount] == row[date]:  # what stands between the date and the amount, as it is read
            between = [k for k in range(date + 1, amount)]
            while between and tags[between[0]] == "I-DATE":
                between.pop(0)
            free = [k for k in between if tags[k] == "O"]
            for k in free:
                tags[k] = "B-DESC" if k == free[0] else "I-DESC"
        if t["balances"] is not None:
            balance = pick(t["balances"], {i for i in range(len(words)) if i == amount or tags[i] != "O"})
            if balance >= 0:
                tags[balance] = "B-BALANCE"
    return tags


def test_alignment_equals_brute_force():
    rng, kinds = random.Random(2), set()
    for _ in range(400):
        words = []
        for r in range(rng.randint(1, 4)):
            for at in range(rng.randint(1, 5)):
                text = rng.choice(["01/15", "01/16", "12.50", "13.50", "112.50", "9.99", "xx", "yy", "01", "2025", ","])
                words.append({"pos": len(words), "text": text, "clean": text, "row": r, "at": at})
        txns = [{"seq": i, "dates": [rng.choice(["01/15", "01/17"])], "amounts": [rng.choice(["12.50", "9.99"])],
                 "balances": rng.choice([None, ["13.50"]])} for i in range(3)]
        got = align._tag_page(words, txns)
        expected = brute_align(words, txns)
        assert got == expected, (words, txns)
        kinds |= set(got)
    assert {"B-DATE", "I-DATE", "B-DESC", "I-DESC", "B-AMOUNT", "B-BALANCE"} <= kinds
