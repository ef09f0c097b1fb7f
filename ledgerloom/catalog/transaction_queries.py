"""Transaction building, cleaning and typing queries."""

from pyspark.sql import functions as F

from ledgerloom.catalog import frames as fr
from ledgerloom.catalog.frames import any_of
from ledgerloom.catalog.registry import query
from ledgerloom.functions import lexicon as lx
from ledgerloom.functions import money as mn
from ledgerloom.operators import transactions as tx
from ledgerloom.sources import derive as dv

_CLEAN = "replace(replace(translate({t}, ',$()\\s', ''), '−', '-'), '–', '-')"
_NUM = (r"^[ \t\r\n\f]*[-+]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][-+]?\d+)?[ \t\r\n\f]*$")


def parse_sql(text):
    c = _CLEAN.format(t=text)
    return (f"coalesce(case when regexp_matches({c}, '{_NUM}') then try_cast(trim(replace({c}, '_', '')) as double) end, "
            "0.0::double)")


def money(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("amount", "balance_after") if c in df.columns})


@query("txn1_parse_amount", fr.sql(fr.TOKENS, f"select stem, page_index, pos, text, {parse_sql('text')} as val from tokens"))
def parse_amount(spark, folder):
    return dv.statement_tokens(spark, folder).select(
        "stem", "page_index", "pos", "text", mn.parse_amount(F.col("text")).alias("val"))


_RAW = f"case when k % 17 = 0 then ' ' when k % 19 <> 0 then {fr.raw_amount('k', 'cents')} end"


@query("txn2_build_transaction", fr.sql(fr.TXN, (
    f", r as (select *, {_RAW} raw from txn), p as (select *, {parse_sql('raw')} v from r where coalesce(trim(raw), '0') <> '') "
    "select k, date, description, round(abs(v), 2) amount, case when v < 0 then 'debit' else 'unknown' end as type, "
    "balance_cents / 100.0 balance_after, confidence from p")))
def build_transaction(spark, folder):
    k = F.col("k")
    raw = F.when(k % 17 == 0, " ").when(k % 19 != 0, dv.raw_amount_text(k, F.col("cents")))
    fields = dv.statement_txns(spark, folder).select(
        "k", F.col("date").alias("date_text"), F.col("description").alias("desc_text"), raw.alias("amount_text"),
        F.col("balance_after").cast("string").alias("balance_text"), F.col("confidence").alias("mean_conf"))
    return money(tx.build_transactions(fields))


_EMBED = (
    f", e as (select *, regexp_extract_all(description, '{mn.EMBEDDED}') m from txn), "
    "f as (select *, case when cents = 0 and len(m) > 0 then try_cast(replace(replace(replace(replace(m[len(m)], '$', ''), "
    "',', ''), '−', '-'), '–', '-') as double) end v from e), rescued as (select k, stem, seq, page, date, true_type, "
    "balance_cents, confidence, case when v is null then description else trim(regexp_replace(list_reduce(m, "
    "lambda acc, x: replace(acc, x, ''), description), '\\s+', ' ', 'g')) end description, "
    "case when v is null then cents else cast(round(abs(v) * 100) as bigint) end cents, "
    "case when v < 0 then 'debit' else type end as type from f) ")


@query("txn3_embedded_amounts", fr.sql(fr.TXN, _EMBED + "select k, description, cents / 100.0 amount, type from rescued"))
def embedded_amounts(spark, folder):
    return money(tx.rescue_embedded_amounts(dv.statement_txns(spark, folder)).select("k", "description", "amount", "type"))


@query("txn4_drop_empty", fr.sql(fr.TXN, "select k, cents / 100.0 amount, balance_cents / 100.0 balance_after from txn "
                                 "where cents <> 0 or balance_cents is not null"))
def drop_empty(spark, folder):
    return money(tx.drop_empty(dv.statement_txns(spark, folder)).select("k", "amount", "balance_after"))


_SUMMARY = f"{any_of('trim(lower(description))', lx.SUMMARY_WORDS)} or (length(trim(description)) < 3 and cents = 0)"


@query("txn5_drop_summary_rows", fr.sql(fr.TXN, f"select k, description from txn where not ({_SUMMARY})"))
def drop_summary_rows(spark, folder):
    return tx.drop_summary_rows(dv.statement_txns(spark, folder)).select("k", "description")


_PREV = (", prev as (select *, last_value(balance_cents ignore nulls) over (partition by stem order by seq rows between "
         "unbounded preceding and 1 preceding) p from {src}) ")
_BYBAL = ("case when abs(balance_cents - p + cents) < 100 then 'debit' when abs(balance_cents - p - cents) < 100 "
          "then 'credit' end")


@query("win1_previous_balance", fr.sql(fr.TXN, _PREV.format(src="txn") + "select k, p / 100.0 prev_balance from prev"))
def previous_balance(spark, folder):
    return tx.previous_balance(dv.statement_txns(spark, folder)).select("k", F.col("prev_balance").cast("double").alias("prev_balance"))


@query("txn6_type_by_balance", fr.sql(fr.TXN, _PREV.format(src="txn") + "select k, case when type <> 'unknown' then type "
                                      f"else coalesce({_BYBAL}, 'unknown') end as type from prev"))
def type_by_balance(spark, folder):
    return tx.infer_by_balance(dv.statement_txns(spark, folder)).select("k", "type")


_WORDS = (f"case when {any_of('lower(description)', lx.CREDIT_WORDS)} then 'credit' else 'debit' end")


@query("txn8_type_by_words", fr.sql(fr.TXN, f"select k, description, {_WORDS} as type from txn"))
def type_by_words(spark, folder):
    return dv.statement_txns(spark, folder).select("k", "description", tx.type_by_words(F.col("description")).alias("type"))
