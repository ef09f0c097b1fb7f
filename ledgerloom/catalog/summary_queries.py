"""Enrichment and summary queries."""

from pyspark.sql import functions as F

from ledgerloom.catalog import frames as fr
from ledgerloom.catalog import sqlfn as sf
from ledgerloom.catalog.registry import query
from ledgerloom.functions import dates as dt
from ledgerloom.functions import lexicon as lx
from ledgerloom.functions import money as mn
from ledgerloom.operators import enrich as en
from ledgerloom.operators import summary as sm
from ledgerloom.operators import transactions as tx
from ledgerloom.plans import spending
from ledgerloom.sources import derive as dv

YEAR = 2025


def enriched(spark, folder):
    return en.enrich(dv.statement_txns(spark, folder).withColumn("type", F.col("true_type")), YEAR)


def doubles(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def esql(body):
    return fr.sql(fr.TXN, sf.ENRICHED + body)


@query("enr1_category", esql("select k, description, category from enriched"))
def category(spark, folder):
    return dv.statement_txns(spark, folder).select("k", "description", en.category_of(F.col("description")).alias("category"))


@query("enr2_parse_date", esql("select k, date, parsed_date from enriched"))
def parse_date(spark, folder):
    return enriched(spark, folder).select("k", "date", "parsed_date")


@query("enr3_cross_year", fr.sql(fr.TXN, "select k, date, " + sf.parse_date("date", "2024", "cast(k % 13 as int)")
                                 + " parsed_date from txn"))
def cross_year(spark, folder):
    return dv.statement_txns(spark, folder).select(
        "k", "date", dt.parse_date(F.col("date"), F.lit(2024), (F.col("k") % 13).cast("int")).alias("parsed_date"))


@query("enr4_year_in_name", fr.sql(fr.TXN, f"select distinct source_file, {sf.year_in_name('source_file')} as y from txn"))
def year_in_name(spark, folder):
    return (dv.statement_txns(spark, folder).select("source_file", dt.year_in_name(F.col("source_file")).alias("y"))
            .distinct())


def _re(pattern):
    return fr.lit(pattern)


def _period_sql():
    def range_end(t):
        n, m = _re(dt.NUMERIC_RANGE), _re(dt.NAMED_RANGE)
        y = f"regexp_extract({t}, {n}, 3)"
        return (f"case when regexp_matches({t}, {n}) then struct_pack(y := case when length({y}) = 2 then "
                f"2000 + try_cast({y} as int) else try_cast({y} as int) end, m := try_cast(regexp_extract({t}, {n}, 2) as int)) "
                f"when regexp_matches({t}, {m}) then struct_pack(y := try_cast(regexp_extract({t}, {m}, 2) as int), m := "
                f"cast({sf.month_no(f'substr(regexp_extract({t}, {m}, 1), 1, 3)')} as int)) end")

    def votes(t):
        c = f"regexp_extract({t}, {_re(dt.CLOSING_YEAR)}, 1)"
        return (f"(case when {c} <> '' then [{c}, {c}, {c}, {c}, {c}] else [] end || regexp_extract_all({t}, "
                f"{_re(dt.DATED_YEAR)}, 1) || regexp_extract_all({t}, {_re(dt.NAMED_YEAR)}, 1))")

    return (f", t as (select doc_id, first_page a, coalesce(last_page, '') b from page_texts), "
            f"r as (select doc_id, coalesce({range_end('a')}, {range_end('b')}) r, {votes('a')} || {votes('b')} v from t), "
            "u as (select doc_id, unnest(v) y, unnest(range(len(v))) i from r), "
            "w as (select doc_id, arg_max(y, (n * 1000000) - i) y from (select doc_id, y, count(*) n, min(i) i from u "
            "group by 1, 2) group by 1) "
            "select r.doc_id, coalesce(r.r.y, cast(w.y as int)) as yr, r.r.m end_month from r left join w using (doc_id)")


@query("enr5_statement_period", fr.sql(fr.PAGE_TEXTS, _period_sql()))
def statement_period(spark, folder):
    period = dt.infer_period(F.col("first_page"), F.col("last_page"))
    return (dv.page_texts(spark, folder).select("doc_id", period.alias("p"))
            .select("doc_id", F.col("p.year").alias("yr"), F.col("p.end_month").alias("end_month")))


def _periods_sql():
    head, tail = _period_sql().split("select r.doc_id", 1)
    return (f"{head}, per as (select r.doc_id{tail}), named as (select txn.*, {sf.year_in_name('source_file')} nm, per.yr, per.end_month from txn left join per on per.doc_id = txn.d), "
            f"hinted as (select *, coalesce(nm, yr, {YEAR}) yh, case when nm is null then end_month end em from named), "
            f"pdated as (select *, {sf.parse_date('date', 'yh', 'em')} pd from hinted) "
            "select strftime(pd, '%Y-%m') month_key, cast(sum(case when true_type = 'credit' then cents else 0 end) as bigint) / 100.0 income, "
            "cast(sum(case when true_type <> 'credit' then cents else 0 end) as bigint) / 100.0 expenses, count(*) n, "
            "cast(sum(case when true_type = 'credit' then cents else -cents end) as bigint) / 100.0 net from pdated where pd is not null group by 1")


@query("flow_monthly_with_periods", fr.sql(fr.TXN + ", " + fr.PAGE_TEXTS, _periods_sql()))
def monthly_with_periods(spark, folder):
    """Monthly cash flow where the page text tells the year that a file name doesn't."""
    pages = dv.page_texts(spark, folder).withColumn("stem", F.concat(F.lit("stmt_"), F.col("doc_id").cast("string")))
    txns = dv.statement_txns(spark, folder).withColumn("type", F.col("true_type"))
    return doubles(spending.spending_tables(txns, YEAR, pages)["monthly"], "income", "expenses", "net")


@query("enr6_month_key", esql("select k, month_key, strftime(parsed_date, '%b %Y') month_label from enriched"))
def month_key(spark, folder):
    return enriched(spark, folder).select("k", "month_key", F.date_format("parsed_date", "MMM yyyy").alias("month_label"))


def _variants(signed):
    g, p = fr.grouped(signed), f"(abs({signed}) // 100) || '.' || lpad(cast(abs({signed}) % 100 as varchar), 2, '0')"
    whole = f"format('{{:,}}', {sf.half_even(f'abs({signed})', '100')})"
    return (f"array_to_string([{g}, {p}, '$' || {g}, '$' || {p}, {whole}] || case when {signed} < 0 then "
            f"['-' || {g}, '(' || {g} || ')', '-$' || {g}] else [] end, '|')")


@query("enr7_amount_variants", fr.sql(fr.TXN, "select k, " + _variants("(case when true_type = 'credit' then cents else -cents end)")
                                      + " variants from txn"))
def amount_variants(spark, folder):
    signed = F.when(F.col("true_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    return dv.statement_txns(spark, folder).select("k", F.array_join(mn.amount_variants(signed), "|").alias("variants"))


def _date_variants_sql():
    parts = "string_split_regex(trim(date), '[/\\-\\s]+')"
    abbr = "case p[1] " + " ".join(f"when '{i:02d}' then '{m[:3]}'" for i, m in enumerate(lx.MONTHS, 1)) + " end"
    num = "case cap " + " ".join(f"when '{m[:3]}' then '{i:02d}'" for i, m in enumerate(lx.MONTHS, 1)) + " end"
    full = "base"
    steps = ""
    for i, m in enumerate(lx.MONTHS):
        steps += (f", s{i + 1} as (select k, date, case when contains(lower(date), '{m.lower()}') then v || list_transform(v, "
                  f"lambda x: replace(replace(x, '{m}', '{m[:3]}'), '{m.lower()}', '{m[:3].lower()}')) else v end v from s{i})")
    return (f", a as (select k, date, {parts} p from txn), "
            f"b as (select *, {abbr} abbr, rtrim(upper(substr(p[1], 1, 1)) || lower(substr(p[1], 2)), '.') cap, "
            "case when length(p[2]) < 2 then lpad(p[2], 2, '0') else p[2] end dd from a), "
            f"c as (select *, {num} num from b), "
            "s0 as (select k, date, [date] || case when len(p) = 3 then [p[1] || '/' || p[2], p[1] || '-' || p[2], "
            "p[1] || '/' || p[2] || '/' || p[3]] else [] end || case when len(p) >= 2 and abbr is not null then "
            "[abbr || ' ' || p[2], abbr || ' ' || cast(try_cast(p[2] as int) as varchar)] else [] end || "
            "case when len(p) >= 2 and num is not null then [p[1], num || '/' || dd, num || '-' || dd] else [] end v from c)"
            f"{steps} select k, date, array_to_string(list_sort(list_distinct(v)), '|') variants from s12")


@query("enr8_date_variants", fr.sql(fr.TXN, _date_variants_sql()))
def date_variants(spark, folder):
    return dv.statement_txns(spark, folder).select("k", "date", F.array_join(dt.date_variants(F.col("date")), "|").alias("variants"))


@query("enr10_money_text", fr.sql(fr.TXN, "select k, case when balance_cents < 0 then '-' else '' end || '$' || "
                                  + fr.grouped("balance_cents") + " as txt from txn"))
def money_text(spark, folder):
    return dv.statement_txns(spark, folder).select("k", mn.format_money(F.col("balance_after")).alias("txt"))


@query("enr11_nsf_flag", fr.sql(fr.TXN, f"select k, {fr.any_of('upper(description)', lx.NSF_WORDS)} nsf, "
                                f"{fr.any_of('upper(description)', lx.NSF_WORDS_FALLBACK)} nsf_fallback from txn"))
def nsf_flag(spark, folder):
    return dv.statement_txns(spark, folder).select(
        "k", tx.is_nsf(F.col("description")).alias("nsf"), tx.is_nsf(F.col("description"), True).alias("nsf_fallback"))


@query("enr12_source_order", esql("select k, parsed_date, source_file, page, seq from enriched "
                                  "order by parsed_date nulls first, source_file, page, seq"))
def source_order(spark, folder):
    return en.source_order(enriched(spark, folder)).select("k", "parsed_date", "source_file", "page", "seq")


_MONTHLY = ("select month_key, cast(coalesce(sum(cents) filter (type = 'credit'), 0) as bigint) / 100.0 income, "
            "cast(coalesce(sum(cents) filter (type <> 'credit'), 0) as bigint) / 100.0 expenses, count(*) n, "
            "cast(sum(case when type = 'credit' then cents else -cents end) as bigint) / 100.0 net "
            "from enriched where month_key <> 'unknown' group by month_key")


@query("agg1_monthly_cashflow", esql(_MONTHLY))
def monthly_cashflow(spark, folder):
    return doubles(sm.monthly_cashflow(enriched(spark, folder)), "income", "expenses", "net")


@query("agg2_category_totals", esql(
    ", c as (select category, cast(sum(cents) as bigint) / 100.0 total from enriched where month_key <> 'unknown' "
    "and type <> 'credit' group by 1), g as (select cast(sum(cents) as bigint) / 100.0 g from enriched where "
    "month_key <> 'unknown' and type <> 'credit') select category, total, total / g * 100 as share from c, g"))
def category_totals(spark, folder):
    return doubles(sm.category_totals(enriched(spark, folder)), "total")


@query("agg3_daily_balances", esql(
    "select parsed_date, balance_cents / 100.0 balance, count(*) over () >= 5 chart from (select *, row_number() over (partition by parsed_date "
    "order by source_file desc, page desc, seq desc) rn from enriched where balance_cents is not null and parsed_date "
    "is not null) where rn = 1"))
def daily_balances(spark, folder):
    return doubles(sm.balance_chart(enriched(spark, folder)), "balance")


@query("agg4_top_merchants", esql(
    ", m as (select *, trim(description) merchant from enriched where month_key <> 'unknown' and "
    "type = 'debit'), r as (select merchant, count(*) n, sum(cents) c from m where merchant <> '' group by 1) "
    "select merchant, n, cast(c as bigint) / 100.0 total from r order by c desc limit 15"))
def top_merchants(spark, folder):
    return doubles(sm.top_merchants(enriched(spark, folder)), "total")


@query("agg5_portfolio", esql(
    ", e as (select * from enriched where month_key <> 'unknown'), x as (select "
    "cast(coalesce(sum(cents) filter (type = 'credit'), 0) as bigint) inc, "
    "cast(coalesce(sum(cents) filter (type <> 'credit'), 0) as bigint) exp, "
    "greatest(count(distinct month_key), 1) months_analyzed, count(*) total_transactions, "
    "count(*) filter (confidence < 0.75) flagged_transactions from e) select inc / 100.0 total_income, exp / 100.0 "
    "total_expenses, months_analyzed, total_transactions, flagged_transactions, (inc - exp) / 100.0 net_cashflow, "
    f"({sf.half_even('exp', 'months_analyzed')}) / 100.0 avg_monthly_spend from x"))
def portfolio(spark, folder):
    return doubles(sm.portfolio(enriched(spark, folder)), "total_income", "total_expenses", "net_cashflow", "avg_monthly_spend")


@query("set5_months_seen", esql("select distinct month_key from enriched where month_key <> 'unknown'"))
def months_seen(spark, folder):
    return sm.months_seen(enriched(spark, folder))


_ADB = f"case when sum(balance_cents) <> 0 then ({sf.half_even('cast(sum(balance_cents) as bigint)', 'count(balance_cents)')}) / 100.0 end"


@query("agg6_statement_metrics", fr.sql(fr.TXN, (
    "select stem, cast(coalesce(sum(cents) filter (true_type = 'credit'), 0) as bigint) / 100.0 total_deposits, "
    "cast(coalesce(sum(cents) filter (true_type = 'debit'), 0) as bigint) / 100.0 total_withdrawals, "
    f"{_ADB} average_daily_balance, count(*) filter ({fr.any_of('upper(description)', lx.NSF_WORDS)}) nsf_count, "
    "count(*) transactions from txn group by stem")))
def statement_metrics(spark, folder):
    txns = dv.statement_txns(spark, folder).withColumn("type", F.col("true_type"))
    return doubles(sm.statement_metrics(txns), "total_deposits", "total_withdrawals", "average_daily_balance")


@query("agg7_fallback_metrics", fr.sql(fr.TXN, (
    ", s as (select *, case when k % 4 = 1 then -cents else cents end c from txn) select stem, "
    "cast(coalesce(sum(abs(c)) filter (true_type = 'credit' or c > 0), 0) as bigint) / 100.0 total_deposits, "
    "cast(coalesce(sum(abs(c)) filter (true_type = 'debit' or c < 0), 0) as bigint) / 100.0 total_withdrawals, "
    f"case when count(balance_cents) > 0 then ({sf.half_even('cast(sum(balance_cents) as bigint)', 'count(balance_cents)')}) / 100.0 end "
    f"average_daily_balance, count(*) filter ({fr.any_of('upper(description)', lx.NSF_WORDS_FALLBACK)}) nsf_count "
    "from s group by stem")))
def fallback_metrics(spark, folder):
    txns = (dv.statement_txns(spark, folder).withColumn("type", F.col("true_type"))
            .withColumn("amount", F.when(F.col("k") % 4 == 1, -F.col("amount")).otherwise(F.col("amount"))))
    return doubles(sm.fallback_metrics(txns), "total_deposits", "total_withdrawals", "average_daily_balance")
