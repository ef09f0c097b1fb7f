"""Feedback, labelling, sampling, join, response, model and streaming queries."""

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import frames as fr
from ledgerloom.catalog import sqlfn as sf
from ledgerloom.catalog.frames import any_of, lit
from ledgerloom.catalog.ingest_queries import _BNK2, _URLS
from ledgerloom.catalog.layout_queries import CHUNKS, FIT, ROWED, SECTIONS, TAGGED, _DEC, _TRIM, rsql, section_sql
from ledgerloom.catalog.registry import ORACLES, query
from ledgerloom.catalog.transaction_queries import _BYBAL, _PREV, _SUMMARY, _WORDS, parse_sql
from ledgerloom.catalog.summary_queries import _MONTHLY, YEAR, _date_variants_sql, _variants, doubles, enriched, esql
from ledgerloom.functions import lexicon as lx
from ledgerloom.functions import money as mn
from ledgerloom.functions.fuzzy import ratio
from ledgerloom.operators import align as al
from ledgerloom.operators import banks as bk
from ledgerloom.operators import enrich as en
from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import feedback as fb
from ledgerloom.operators import ingest as ig
from ledgerloom.operators import labelling as lb
from ledgerloom.operators import learn as ml
from ledgerloom.operators import responses as rs
from ledgerloom.operators import sampling as sp
from ledgerloom.operators import summary as sm
from ledgerloom.operators import tagging as tg
from ledgerloom.operators import transactions as tx
from ledgerloom.operators.scale import spread
from ledgerloom.plans import labels as label_plan
from ledgerloom.plans import spending as plan
from ledgerloom.session import materialise, shared_dir
from ledgerloom.sources import derive as dv
from ledgerloom.sources import files as fs
from ledgerloom.sources.tables import table
from ledgerloom.streaming import jobs

# --- feedback -----------------------------------------------------------------------------

_LOWP = (", lp as (select stem, page_index, cast(sum(round(conf * 100)) filter (pred_tag <> 'O') as bigint) s, count(*) filter (pred_tag <> 'O') n from tokens group by 1, 2), "
         "pg as (select stem, count(*) page_count, list_sort(coalesce(list(page_index) filter (n > 0 and s < 70 * n), [])) low from lp group by 1) ")
_FLAG = (", tt as (select stem, count(*) total, count(*) filter (confidence < 0.75) flagged, cast(sum(round(confidence * 100)) as bigint) cs from txn group by 1), "
         "hd as (select stem, string_agg(lower(text), ' ' order by pos) t from tokens where page_index = 0 group by 1), "
         "bf as (select stem, case " + " ".join(f"when contains(t, {lit(p)}) then {lit(b)}" for p, b in lx.BANK_SUBSTRINGS) + " else 'unknown' end bank from hd), "
         f"rec as (select pg.stem, coalesce(bank, 'unknown') bank_format, page_count, total total_transactions, flagged flagged_transactions, len(low) n_low_pages, "
         f"({sf.half_even('cs * 100', 'total')}) / 10000.0 avg_confidence, ({sf.half_even('cs * 100', 'total')}) ac from pg left join tt using (stem) left join bf using (stem) "
         "where flagged > 0 or len(low) > 0) ")


def _records(spark, folder):
    words = dv.statement_tokens(spark, folder)
    return plan.flag_statements(dv.statement_txns(spark, folder), words, words.withColumn("tag", F.col("pred_tag")))


@query("agg8_feedback_records", fr.sql(fr.TOKENS, _LOWP + _FLAG + "select stem, bank_format, page_count, total_transactions, flagged_transactions, n_low_pages, avg_confidence from rec"))
def feedback_records(spark, folder):
    return _records(spark, folder)


@query("agg8_flagged_details", fr.sql(fr.TXN, "select stem, seq, page, description, confidence from txn where confidence < 0.75"))
def flagged_details(spark, folder):
    return fb.flagged_details(dv.statement_txns(spark, folder))


_BANKREC = (f", br as (select bank_format, count(*) n, ({sf.half_even('cast(sum(ac) as bigint)', 'count(*)')}) / 10000.0 bank_confidence from rec group by 1) ")


@query("agg9_flagged_by_bank", fr.sql(fr.TOKENS, _LOWP + _FLAG + _BANKREC + "select * from br"))
def flagged_by_bank(spark, folder):
    return fb.flagged_by_bank(_records(spark, folder))


@query("agg9_flagged_members", fr.sql(fr.TOKENS, _LOWP + _FLAG + _BANKREC + (
    "select bank_format, n, bank_confidence, stem, flagged_transactions, total_transactions, avg_confidence from rec join br using (bank_format)")))
def flagged_members(spark, folder):
    return fb.flagged_members(materialise(_records(spark, folder), "flagged"))  # read twice


@query("agg10_retrain_readiness", fr.sql(fr.TRAINING, (
    ", lab as (select * from training where labelled), bio as (select * from training where labelled and doc_id % 2 = 0) select "
    "(select count(distinct stem) from lab where starts_with(stem, 'auto_')) auto_labeled_pdfs, (select count(*) from lab where starts_with(stem, 'auto_')) auto_labeled_pages, "
    "(select count(*) from bio where starts_with(stem, 'auto_')) auto_aligned_pages, (select count(*) from bio) total_training_pages, "
    "(select count(*) from training where parse_error) flagged_pdfs, (select count(*) from lab where starts_with(stem, 'auto_')) >= 50 ready_for_retrain")))
def retrain_readiness(spark, folder):
    pages = dv.training_pages(spark, folder)
    labels = pages.filter("labelled")
    return fb.retrain_readiness(labels, labels.filter(F.col("doc_id") % 2 == 0), pages.filter("parse_error"))


@query("win9_newest_logs", fr.sql(fr.LOG, "select event_id, deal_id, method, cast(total_deposits as double) total_deposits from log where method = 'click' order by created_at desc, event_id desc limit 50"))
def newest_logs(spark, folder):
    return doubles(fb.log_query(dv.feedback_log(spark, folder), method="click").select("event_id", "deal_id", "method", "total_deposits"), "total_deposits")


@query("win9_corrected_logs", fr.sql(fr.LOG, "select event_id, deal_id from log where corrected"))
def corrected_logs(spark, folder):
    return fb.corrected_rows(dv.feedback_log(spark, folder)).select("event_id", "deal_id")


@query("joi9_shadow_comparison", fr.sql(fr.LOG, (
    "select event_id, deal_id, method, transaction_count ml_transactions, shadow_transaction_count other_transactions, transaction_count - shadow_transaction_count txn_diff, "
    "cast(total_deposits as double) ml_deposits, cast(shadow_total_deposits as double) other_deposits, cast(total_deposits - shadow_total_deposits as double) deposit_diff, "
    "processing_time_ms from log where shadow_method is not null order by created_at desc, event_id desc limit 50")))
def shadow_comparison(spark, folder):
    return doubles(fb.shadow_comparison(dv.feedback_log(spark, folder)), "ml_deposits", "other_deposits", "deposit_diff")


@query("win11_traffic_split", fr.sql(fr.LOG, "select event_id, cast('0x' || substr(md5(cast(event_id as varchar)), 1, 8) as bigint) % 100 < 30 to_model from log"))
def traffic_split(spark, folder):
    return dv.feedback_log(spark, folder).select("event_id", fb.route(F.col("event_id"), 30).alias("to_model"))


@query("win12_fallback_rule", fr.sql(fr.LOG, "select event_id, len(low_confidence_pages) > page_count * 0.5 fallback from log"))
def fallback_rule(spark, folder):
    return dv.feedback_log(spark, folder).select("event_id", fb.needs_fallback(F.col("low_confidence_pages"), F.col("page_count")).alias("fallback"))


_SIDES = (", a as (select stem, count(*) n, cast(sum(case when true_type = 'credit' then cents else 0 end) as bigint) i, cast(sum(case when true_type <> 'credit' then cents else 0 end) as bigint) e, "
          "cast(sum(k % 90) as bigint) t from txn where d % 10 <> 7 group by 1), b as (select stem, count(*) n, cast(sum(case when true_type = 'credit' then cents else 0 end) as bigint) i, "
          "cast(sum(case when true_type <> 'credit' then cents else 0 end) as bigint) e, cast(sum(k % 900) as bigint) t from txn where d % 10 <> 4 and (d % 2 = 0 or k % 10 <> 3) group by 1), "
          "cp as (select coalesce(a.stem, b.stem) stem, coalesce(a.n, 0) n_a, coalesce(b.n, 0) n_b, coalesce(a.i, 0) ia, coalesce(b.i, 0) ib, coalesce(a.e, 0) ea, coalesce(b.e, 0) eb, coalesce(a.t, 0) ta, "
          "coalesce(b.t, 0) tb from a full join b on a.stem = b.stem) ")


def _sides(spark, folder):
    txns = dv.statement_txns(spark, folder)
    credit = F.col("true_type") == "credit"

    def side(rows, every):
        return rows.groupBy("stem").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(credit, F.col("amount")).otherwise(0)).alias("income"),
            F.sum(F.when(~credit, F.col("amount")).otherwise(0)).alias("expenses"), F.sum(F.col("k") % every).alias("time_ms"))

    left = side(txns.filter(F.col("d") % 10 != 7), 90)
    right = side(txns.filter((F.col("d") % 10 != 4) & ((F.col("d") % 2 == 0) | (F.col("k") % 10 != 3))), 900)
    return fb.compare_parsers(left, right)


@query("joi8_compare_parsers", fr.sql(fr.TXN, _SIDES + (
    "select stem, n_a, n_b, abs(n_a - n_b) n_diff, n_a = n_b n_match, ia / 100.0 income_a, ib / 100.0 income_b, abs(ia - ib) / 100.0 income_diff, abs(ia - ib) < 100 income_match, "
    "abs(ea - eb) / 100.0 expenses_diff, abs(ea - eb) < 100 expenses_match, case when ia = 0 and ib = 0 then '0%' when ib = 0 then 'N/A' else "
    f"(case when ({sf.half_even('(ia - ib) * 1000', 'ib')}) < 0 then '-' else '' end || (abs({sf.half_even('(ia - ib) * 1000', 'ib')}) // 10) || '.' || (abs({sf.half_even('(ia - ib) * 1000', 'ib')}) % 10) || '%') end income_pct from cp")))
def compare_parsers(spark, folder):
    cols = ["stem", "n_a", "n_b", "n_diff", "n_match", "income_a", "income_b", "income_diff", "income_match", "expenses_diff", "expenses_match", "income_pct"]
    return doubles(_sides(spark, folder).select(*cols), "income_a", "income_b", "income_diff", "expenses_diff")


_IN_A, _IN_B = "(k // 100) % 10 <> 7", "(k // 100) % 10 <> 4 and ((k // 100) % 2 = 0 or k % 10 <> 3)"


def _both(spark, folder):
    rows = enriched(spark, folder)
    d = F.floor(F.col("k") / 100)
    return rows.filter(d % 10 != 7), rows.filter((d % 10 != 4) & ((d % 2 == 0) | (F.col("k") % 10 != 3)))


def _compare_sql(key, where, measures):
    """Sums of cents or counts per key for either side, joined."""
    sums = ", ".join(f"cast(coalesce(sum({c}) filter ({side}), 0) as bigint) {m}{t}" for m, c in measures for t, side in (("a", _IN_A), ("b", _IN_B)))
    return f", g as (select {key}, {sums} from enriched where {where} and (({_IN_A}) or ({_IN_B})) group by 1) "


@query("joi8_compare_months", esql(_compare_sql("month_key", "month_key <> 'unknown'", [
    ("i", "case when type = 'credit' then cents else 0 end"), ("e", "case when type <> 'credit' then cents else 0 end"), ("n", "1")]) + (
    "select month_key, ia / 100.0 income_a, ib / 100.0 income_b, (ia - ib) / 100.0 income_diff, ea / 100.0 expenses_a, eb / 100.0 expenses_b, (ea - eb) / 100.0 expenses_diff, "
    "na n_a, nb n_b, na - nb n_diff from g")))
def compare_months(spark, folder):
    left, right = (sm.monthly_cashflow(side) for side in _both(spark, folder))
    money = [f"{m}_{t}" for m in ("income", "expenses") for t in ("a", "b", "diff")]
    return doubles(fb.compare_summaries(left, right, ["month_key"], ["income", "expenses", "n"]), *money)


@query("joi8_compare_categories", esql(_compare_sql("category", "month_key <> 'unknown' and type <> 'credit'", [("t", "cents")]) + (
    "select category, ta / 100.0 total_a, tb / 100.0 total_b, (ta - tb) / 100.0 total_diff from g")))
def compare_categories(spark, folder):
    left, right = (sm.category_totals(side) for side in _both(spark, folder))
    return doubles(fb.compare_summaries(left, right, ["category"], ["total"]), "total_a", "total_b", "total_diff")


@query("joi8_compare_merchants", esql(_compare_sql("trim(description) merchant", "month_key <> 'unknown' and type = 'debit' and trim(description) <> ''", [("t", "cents"), ("n", "1")]) + (
    "select merchant, ta / 100.0 total_a, tb / 100.0 total_b, (ta - tb) / 100.0 total_diff, na n_a, nb n_b, na - nb n_diff from g")))
def compare_merchants(spark, folder):
    left, right = (sm.merchants(side) for side in _both(spark, folder))
    return doubles(fb.compare_summaries(left, right, ["merchant"], ["total", "n"]), "total_a", "total_b", "total_diff")


@query("joi8_comparison_totals", fr.sql(fr.TXN, _SIDES + (
    ", tt as (select cast(sum(n_a) as bigint) n_a, cast(sum(n_b) as bigint) n_b, cast(sum(ia) as bigint) ia, cast(sum(ib) as bigint) ib, cast(sum(ea) as bigint) ea, cast(sum(eb) as bigint) eb, "
    "cast(sum(ta) as bigint) time_ms_a, cast(sum(tb) as bigint) time_ms_b from cp) select n_a, n_b, ia / 100.0 income_a, ib / 100.0 income_b, ea / 100.0 expenses_a, eb / 100.0 expenses_b, time_ms_a, time_ms_b, "
    f"({sf.half_even('time_ms_b * 10', 'greatest(time_ms_a, 1)')}) / 10.0 speed_ratio from tt")))
def comparison_totals(spark, folder):
    return doubles(fb.comparison_totals(_sides(spark, folder)), "income_a", "income_b", "expenses_a", "expenses_b")


@query("joi10_version_deltas", fr.sql(fr.EVALS, (
    "select family, model_version, f1, f1 - lag(f1) over w f1_delta, txn_f1 - lag(txn_f1) over w txn_f1_delta, coalesce(f1 >= lag(f1) over w, true) promote from evals "
    "window w as (partition by family order by model_version)")))
def version_deltas(spark, folder):
    return fb.version_deltas(dv.evaluations(spark, folder))


# --- labelling ------------------------------------------------------------------------------

@query("agg11_labelling_progress", fr.sql(fr.TRAINING, (
    "select count(distinct stem) filter (labelled) labeled_pdfs, count(*) filter (labelled) labeled_pages, count(distinct stem) total_pdfs, count(*) total_pages from training")))
def labelling_progress(spark, folder):
    pages = dv.training_pages(spark, folder)
    return lb.labelling_progress(pages, pages.filter("labelled"))


@query("agg12_review_stats", fr.sql(fr.TRAINING, (
    "select count(*) total, count(*) filter (reviewed) reviewed, count(*) filter (reviewed and review_status = 'accepted') accepted, count(*) filter (reviewed and review_status = 'rejected') rejected, "
    "count(*) filter (not reviewed) unreviewed, round(sum(alignment_rate) / count(*), 3) avg_alignment, count(*) filter (alignment_rate < 90) below_90, count(*) filter (reviewed) / count(*) * 100 reviewed_pct from training")))
def review_stats(spark, folder):
    return lb.review_stats(dv.training_pages(spark, folder)).withColumn("avg_alignment", F.round("avg_alignment", 3))


_AL = "select stem, n_txns - (case when n_txns > 0 and doc_id % 4 = 0 then 1 else 0 end) aligned, n_txns total, alignment_rate from training where labelled"


@query("agg13_alignment_stats", fr.sql(fr.TRAINING, (
    f", p as ({_AL}), g as (select stem, count(*) pages, cast(sum(aligned) as bigint) aligned, cast(sum(total) as bigint) n_txns, cast(sum(alignment_rate) as bigint) sr from p group by rollup(stem)), "
    f"r as (select stem, pages, aligned, n_txns, ({sf.half_even('sr * 10', 'pages')}) / 10.0 page_rate, case when n_txns > 0 then ({sf.half_even('aligned * 1000', 'n_txns')}) / 10.0 else 0.0 end rate from g) "
    "select *, rate < 90 warning from r")))
def alignment_stats(spark, folder):
    pages = dv.training_pages(spark, folder).filter("labelled").select(
        "stem", (F.col("n_txns") - F.when((F.col("n_txns") > 0) & (F.col("doc_id") % 4 == 0), 1).otherwise(0)).alias("aligned"),
        F.col("n_txns").alias("total"), "alignment_rate")
    return lb.alignment_stats(pages)


@query("agg14_labelling_run", fr.sql(fr.TRAINING, (
    "select count(*) pages, count(*) filter (not labelled) to_label, round(count(*) filter (not labelled) * 0.003::double, 6) est_cost, count(*) filter (labelled and parse_error) errors, "
    "cast(coalesce(sum(n_txns) filter (labelled), 0) as bigint) transactions from training")))
def labelling_run(spark, folder):
    return lb.labelling_run(dv.training_pages(spark, folder)).withColumn("est_cost", F.round("est_cost", 6))


def _banked(spark, folder):
    return dv.statement_files(spark, folder).select("doc_id", "stem", "name", "path", "pages", bk.bank_of_text(F.col("text")).alias("bank"))


_BANKED = f", banked as (select doc_id, stem, name, path, pages, {_BNK2} bank from files) "
_QUOTA = "case bank " + " ".join(f"when {lit(b)} then {q}" for b, _, q in lx.SAMPLED_BANKS) + " end"
_PICKED = _BANKED + (f", rk as (select *, row_number() over (partition by bank order by md5('42|' || stem), stem) rn from banked), picked as (select * from rk where rn <= {_QUOTA}) ")


@query("win2_quota_sample", fr.sql(fr.FILES, _PICKED + "select bank, stem, pages from picked"))
def quota_sample(spark, folder):
    return sp.quota_sample(_banked(spark, folder), sp.default_quotas()).select("bank", "stem", "pages")


@query("agg15_sample_coverage", fr.sql(fr.FILES, _PICKED + "select bank, count(*) pdfs, cast(sum(pages) as bigint) pages, count(distinct bank) banks from picked group by rollup(bank)"))
def sample_coverage(spark, folder):
    return lb.sample_coverage(quota_sample(spark, folder))


_FILL = _PICKED + (", un as (select *, coalesce(sum(pages) over (order by md5('42|' || stem), stem rows between unbounded preceding and 1 preceding), 0) bf from banked where bank = 'Unknown' and pages > 0), "
                   "filled as (select bank, stem, pages from un where bf + (select sum(pages) from picked) < 400) ")


@query("win3_fill_to_target", fr.sql(fr.FILES, _FILL + "select * from filled"))
def fill_to_target(spark, folder):
    banked = materialise(_banked(spark, folder), "banked")  # two passes follow, texts are read once
    picked = sp.quota_sample(banked, sp.default_quotas())
    return sp.fill_to_target(banked.filter(F.col("bank") == "Unknown"), picked, 400).select("bank", "stem", "pages")


@query("win4_evenly_spaced", fr.sql(fr.FILES, _BANKED + (
    ", r as (select *, row_number() over (partition by bank order by pages, md5(stem), stem) - 1 rn, count(*) over (partition by bank) n from banked where bank <> 'Unknown'), "
    f"l as (select *, case when lower(bank) in ({', '.join(lit(b) for b in lx.KNOWN_BANKS)}) then 1 else 3 end lim from r) "
    "select bank, stem, pages from l where n <= lim or list_contains(list_transform(range(lim), lambda i: cast(floor(i * (n / lim)) as bigint)), rn) union all "
    "(select bank, stem, pages from banked where bank = 'Unknown' order by abs(pages - 4), md5(stem), stem limit 3)")))
def evenly_spaced(spark, folder):
    banked = materialise(_banked(spark, folder).select("bank", "stem", "pages"), "banked")
    return sp.diverse_sample(banked)


@query("win5_closest_pages", fr.sql(fr.FILES, _BANKED + "select stem, pages from banked where bank = 'Unknown' order by abs(pages - 4), md5(stem), stem limit 3"))
def closest_pages(spark, folder):
    return sp.closest_pages(_banked(spark, folder).filter(F.col("bank") == "Unknown"), 3).select("stem", "pages")


@query("win6_labelling_queue", fr.sql(fr.FILES, _BANKED + (
    ", q as (select b.* from banked b where stem not in (select 'f_' || lpad(cast(doc_id as varchar), 9, '0') from labels) ), "
    "c as (select *, count(*) over (partition by bank) bank_count from q) select stem, bank, bank_count from c")))
def labelling_queue(spark, folder):
    banked = _banked(spark, folder)
    done = table(spark, folder, "labels").select(F.concat(F.lit("f_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("stem"))
    return lb.labelling_queue(banked.select("stem"), banked.select("stem", "bank"), done).select("stem", "bank", "bank_count")


@query("win6_queue_totals", fr.sql(fr.FILES, _BANKED + (
    "select bank, count(*) open_statements from banked where stem not in (select 'f_' || lpad(cast(doc_id as varchar), 9, '0') from labels) group by rollup(bank)")))
def queue_totals(spark, folder):
    banked = _banked(spark, folder)
    done = table(spark, folder, "labels").select(F.concat(F.lit("f_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("stem"))
    return lb.queue_totals(banked.select("stem"), banked.select("stem", "bank"), done)


@query("win7_group_split", fr.sql(fr.TRAINING, "select stem, page_index, case when cast('0x' || substr(md5('42|' || stem), 1, 8) as bigint) % 100 < 15 then 'test' else 'train' end split from training"))
def group_split(spark, folder):
    return sp.group_split(dv.training_pages(spark, folder)).select("stem", "page_index", "split")


@query("win10_next_unlabelled", fr.sql(fr.TRAINING, (
    "select a.stem, a.page_index, min(b.page_index) next_page from training a left join training b on a.stem = b.stem and b.page_index > a.page_index and not b.labelled group by 1, 2")))
def next_unlabelled(spark, folder):
    pages = dv.training_pages(spark, folder)
    return lb.next_unlabelled(pages, pages.filter("labelled"))


@query("agg17_class_balance", fr.sql(fr.TXN, "select count(*) filter (true_type = 'credit') credit, count(*) filter (true_type = 'debit') debit, count(*) filter (true_type = 'credit') / count(*) filter (true_type = 'debit') pos_weight from txn"))
def class_balance(spark, folder):
    return lb.class_balance(dv.statement_txns(spark, folder).withColumn("type", F.col("true_type")))


@query("jsn5_label_source", fr.sql(fr.TRAINING, "select doc_id, coalesce(nullif(raw_source, ''), 'claude') src from training"))
def label_source(spark, folder):
    return dv.training_pages(spark, folder).select("doc_id", lb.label_source(F.col("raw_source")).alias("src"))


# --- set operations and joins -----------------------------------------------------------------

@query("joi1_words_with_labels", fr.sql(fr.TRAINING, "select stem, page_index, word_count, quality from training t join labels l on t.doc_id = l.doc_id"))
def words_with_labels(spark, folder):
    pages = dv.training_pages(spark, folder).select("stem", "page_index", "doc_id", "word_count")
    labels = pages.join(table(spark, folder, "labels"), "doc_id").select("stem", "page_index", "quality")
    return lb.words_with_labels(pages.drop("doc_id"), labels)


@query("joi2_labelled_pages", fr.sql(fr.TRAINING, "select stem, page_index from training where labelled"))
def labelled_pages(spark, folder):
    pages = dv.training_pages(spark, folder)
    return pages.select("stem", "page_index").join(pages.filter("labelled").select("stem", "page_index"), ["stem", "page_index"], "left_semi")


@query("joi3_new_file_names", fr.sql(fr.FILES, "select name from files where doc_id not in (select doc_id from labels)"))
def new_file_names(spark, folder):
    files = dv.statement_files(spark, folder)
    held = files.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return ig.not_done(files.select("name"), held, ["name"])


@query("set2_distinct_urls", fr.sql(fr.SUBMISSIONS, _URLS + "select distinct url from urls"))
def distinct_urls(spark, folder):
    return ig.submission_urls(dv.submissions(spark, folder)).select("url").distinct()


@query("set4_unlabelled_stems", fr.sql(fr.TRAINING, "select distinct stem from training except select distinct stem from training where labelled"))
def unlabelled_stems(spark, folder):
    pages = dv.training_pages(spark, folder)
    return ig.not_done(pages.select("stem").distinct(), pages.filter("labelled"), ["stem"])


_SHOW = (", lt as (select doc_id, stem, page_index, labelled, n_txns from training) select stem, page_index, case when labelled then n_txns when doc_id % 3 <> 0 then 2 else 0 end n, case when labelled then "
         "'existing_label' when doc_id % 3 <> 0 then 'model' else 'empty' end as source from lt")


@query("joi11_page_for_labelling", fr.sql(fr.TRAINING, _SHOW))
def page_for_labelling(spark, folder):
    pages = dv.training_pages(spark, folder)
    item = F.struct(F.lit("01/02").alias("date"), F.col("stem").alias("description"))
    labels = pages.filter("labelled").select("stem", "page_index", F.array_repeat(item, F.col("n_txns").cast("int")).alias("transactions"))
    predictions = pages.filter(F.col("doc_id") % 3 != 0).select("stem", "page_index", F.array_repeat(item, 2).alias("transactions"))
    return lb.page_for_labelling(pages, labels, predictions).select("stem", "page_index", F.size("transactions").alias("n"), "source")


# Longest common subsequence in SQL: one table row per character of the left text.
_LCS = (", c as (select p_partkey k, lower(p_name) a, lower(p_type) b from part), d as (select k, a, b, list_reduce(list_prepend(list_transform(range(length(b) + 1), lambda i: 0), "
        "list_transform(range(1, length(a) + 1), lambda i: [i])), lambda prev, x: list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda row, j: row || [case when "
        "substr(b, j[1], 1) = substr(a, x[1], 1) then prev[j[1]] + 1 else greatest(prev[j[1] + 1], row[-1]) end])) t from c) ")


@query("enr9_fuzzy_ratio", "with x as (select 1)" + _LCS + "select k, a, b, t[-1] * 200.0::double / (length(a) + length(b)) score from d")
def fuzzy_ratio(spark, folder):
    a, b = F.lower("p_name"), F.lower("p_type")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k"), a.alias("a"), b.alias("b"), ratio(a, b).alias("score"))


# Greedy alignment: page by page, a recursion over the labels in order that carries tags and used rows.
_CLEAN = "lower(trim(trim(trim(replace(replace({}, ',', ''), '$', ''), '-'), '('), ')'))"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _ratio_sql(a, b):
    """Similarity of two texts by the table of common subsequences, one list per character."""
    row = (f"list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda row, j: row || [case when "
           f"substr({b}, j[1], 1) = substr({a}, x[1], 1) then prev[j[1]] + 1 else greatest(prev[j[1] + 1], row[-1]) end])")
    rows = f"list_reduce(list_prepend(list_transform(range(length({b}) + 1), lambda i: 0), list_transform(range(1, length({a}) + 1), lambda i: [i])), lambda prev, x: {row})"
    return f"({rows})[-1] * 200.0::double / (length({a}) + length({b}))"


def _choice_sql(candidates, variants, threshold):
    """Place of the candidate most similar to a variant; an equal one before all others."""
    equal = f"list_filter({variants}, lambda v: len(list_filter({candidates}, lambda c: c.t = v)) > 0)[1]"
    able = f"list_filter({candidates}, lambda c: least(length(c.t), length({variants}[v])) * 200.0 >= {threshold} * (length(c.t) + length({variants}[v])))"
    score = _ratio_sql(f"{variants}[v]", "c.t")
    scored = f"flatten(list_transform(range(1, len({variants}) + 1), lambda v: list_transform({able}, lambda c: {{'s': {score}, 'v': -v, 'i': -c.i}})))"
    best = f"list_filter({scored}, lambda c: c.s >= {threshold})"
    return (f"case when {equal} is not null then list_min(list_transform(list_filter({candidates}, lambda c: c.t = {equal}), lambda c: c.i)) "
            f"else -(list_sort({best}, 'DESC')[1].i) end")


def _aligned_sql():
    dates = _date_variants_sql()
    head, tail = dates.rsplit(" select ", 1)
    tail = tail.replace("array_to_string(list_sort(list_distinct(v)), '|') variants", "list_transform(list_sort(list_distinct(v)), lambda x: lower(x)) variants")
    amounts = lambda cents: f"list_transform(string_split({_variants(cents)}, '|'), lambda x: {_CLEAN.format('x')})"
    labels = (", labels0 as (select t.stem, t.page page_index, row_number() over (partition by t.stem, t.page order by t.seq) k, d.variants dv, "
              f"{amounts('t.cents')} av, case when t.balance_cents is not null then {amounts('t.balance_cents')} end bv "
              f"from txn t join (select {tail}) d on d.k = t.k), labels as (select stem, page_index, k, {_ONCE.format('dv')} dv, {_ONCE.format('av')} av, "
              f"{_ONCE.format('bv')} bv from labels0)")
    pages = (f", seen as (select stem, page_index, row_number() over (partition by stem, page_index order by pos) i, lower(text) t, {_CLEAN.format('text')} c, row_index r, row_pos a, "
             "lead(lower(text)) over (partition by stem, page_index order by pos) t2, lead(row_index) over (partition by stem, page_index order by pos) r2 from rowed), "
             "words as (select stem, page_index, list({'i': i, 't': t, 'c': c, 'r': r, 'a': a} order by i) w, flatten(list(case when r = r2 then "
             "[{'i': i, 't': t, 'r': r}, {'i': i, 't': t || ' ' || t2, 'r': r}] else [{'i': i, 't': t, 'r': r}] end order by i)) d from seen group by 1, 2)")
    near = "list_transform(list_filter(w, lambda x: x.r >= w[date].r and x.r < w[date].r + 3), lambda x: {'i': x.i, 't': x.c, 'r': x.r, 'a': x.a})"
    follows = lambda k, n: (f"coalesce(w[date + {k}].r = w[date].r and (regexp_full_match(w[date + {k}].t, '[0-9]{{{n}}}') "  # noqa: E731
                            f"or w[date + {k}].t in (',', '/', '-')), false)")
    between = ("list_filter(near, lambda x: x.r = w[date].r and w[amount].r = w[date].r and x.a > w[date].a and x.a < w[amount].a and named[x.i] = 'O')")
    stages = [f"select f.stem, f.page_index, l.k, f.w, f.d, f.tags, f.used, l.dv, l.av, l.bv, list_filter(f.d, lambda c: not list_contains(f.used, c.r)) free "
              "from fold f join labels l on l.stem = f.stem and l.page_index = f.page_index and l.k = f.k + 1",
              f"select *, {_choice_sql('free', 'dv', lx.DATE_MATCH)} date from ({{}})",
              f"select *, case when date is not null then {near} else [] end near from ({{}})",
              f"select *, {_choice_sql('near', 'av', lx.AMOUNT_MATCH)} amount from ({{}})",
              f"select *, {follows(1, '1,2')} has_day, {follows(1, '1,2')} and {follows(2, '2,4')} has_year from ({{}})",
              "select *, list_transform(tags, lambda t, i: case when i = amount then 'B-AMOUNT' when i = date then 'B-DATE' when i = date + 1 and has_day then 'I-DATE' "
              "when i = date + 2 and has_year then 'I-DATE' else t end) named from ({})",
              f"select *, list_transform(list_sort(list_transform({between}, lambda x: {{'a': x.a, 'i': x.i}})), lambda x: x.i) line from ({{}})",
              "select *, list_transform(named, lambda t, i: case when i = line[1] then 'B-DESC' when list_contains(line, i) then 'I-DESC' else t end) told from ({})",
              "select *, case when bv is not null then list_filter(near, lambda x: told[x.i] = 'O' and x.i <> amount) else [] end rest from ({})",
              f"select *, case when len(rest) > 0 then {_choice_sql('rest', 'bv', lx.AMOUNT_MATCH)} end balance from ({{}})",
              "select stem, page_index, k, w, d, case when amount is null then tags when balance is null then told else list_transform(told, lambda t, i: "
              "case when i = balance then 'B-BALANCE' else t end) end, case when amount is null then used else used || [w[date].r] end from ({})"]
    body = stages[0]
    for stage in stages[1:]:
        body = stage.replace("({})", f"({body})")
    fold = (", fold as (select stem, page_index, 0::bigint k, w, d, list_transform(w, lambda x: 'O') tags, []::bigint[] used from words union all " + body + ")")
    last = (", done as (select stem, page_index, arg_max(tags, k) tags from fold group by 1, 2), aligned as (select s.stem, s.page_index, s.i, d.tags[s.i] tag "
            "from seen s join done d using (stem, page_index)) ")
    return head + labels + pages + fold + last


ALIGNED = _aligned_sql()


def _words_of(spark, folder):
    """The columns that alignment reads; labels are dealt over as many tasks as the tokens, so both meet in place."""
    return dv.statement_tokens(spark, folder).select("stem", "page_index", "pos", "text", "x0", "top")


@query("joi6_align_labels", rsql(ALIGNED + (
    "select r.stem, r.page_index, r.pos, r.text, a.tag from (select *, row_number() over (partition by stem, page_index order by pos) i from rowed) r "
    "join aligned a using (stem, page_index, i)")))
def align_labels(spark, folder):
    txns = dv.statement_txns(spark, folder, dv.TOKEN_ORDERS).select("stem", F.col("page").alias("page_index"), "seq", "date", "amount", "balance_after")
    return al.align_tokens(_words_of(spark, folder), txns).select("stem", "page_index", "pos", "text", "tag")


@query("joi6_alignment_by_statement", rsql(ALIGNED + (
    ", counts as (select stem, page page_index, count(*) n from txn group by 1, 2), "
    "hits as (select stem, page_index, least(count(*) filter (tag = 'B-DATE'), count(*) filter (tag = 'B-AMOUNT')) aligned from aligned group by 1, 2), "
    f"rated as (select stem, aligned, coalesce(n, 0) n, case when n > 0 then {sf.half_even('aligned * 1000', 'n')} else 1000 end tenths from hits left join counts using (stem, page_index)), "
    "sums as (select stem, count(*) pages, cast(sum(aligned) as bigint) aligned, cast(sum(n) as bigint) n_txns, cast(sum(tenths) as bigint) tenths from rated group by rollup(stem)), "
    f"rates as (select *, case when n_txns > 0 then ({sf.half_even('aligned * 1000', 'n_txns')}) / 10.0 else 0.0 end rate from sums) "
    f"select stem, pages, aligned, n_txns, ({sf.half_even('tenths', 'pages')}) / 10.0 page_rate, rate, rate < 90 as warning from rates")))
def alignment_by_statement(spark, folder):
    txns = dv.statement_txns(spark, folder, dv.TOKEN_ORDERS).select("stem", "page", "seq", "date", "amount", "balance_after")
    return label_plan.alignment_summary(label_plan.aligned_pages(_words_of(spark, folder), txns)[1])


# --- responses ----------------------------------------------------------------------------------

_BODY = ("case when not starts_with(trim(text, ' ' || chr(10)), '```') then trim(text, ' ' || chr(10)) else array_to_string({keep}, chr(10)) end")
_LINES = "(string_split(trim(text, ' ' || chr(10)), chr(10)))[2:]"
_OPEN = _BODY.format(keep=f"list_filter({_LINES}, lambda s: not starts_with(s, '```'))")
_CLOSE = _BODY.format(keep=f"(case when len(list_filter({_LINES}, lambda s: starts_with(s, '```'))) > 0 then ({_LINES})[1:list_position(list_transform({_LINES}, lambda s: starts_with(s, '```')), true) - 1] else {_LINES} end)")


@query("jsn1_strip_fence", fr.sql(fr.RESPONSES, f"select conv_id, turn, {_OPEN} body_all, {_CLOSE} body_first from responses"))
def strip_fence(spark, folder):
    return dv.responses(spark, folder).select(
        "conv_id", "turn", rs.response_body(F.col("text")).alias("body_all"), rs.response_body(F.col("text"), True).alias("body_first"))


_JSON = f", b as (select conv_id, turn, stop_reason, {_OPEN} body, {_CLOSE} body1 from responses), v as (select *, json_valid(body) ok, json_valid(body1) ok1 from b) "


@query("jsn2_parse_labels", fr.sql(fr.RESPONSES, _JSON + (
    "select conv_id, turn, case when ok1 then json_array_length(body1, '$.transactions') else 0 end n, not ok1 parse_error, case when not ok1 then 'JSON parse error. Raw: ' || body1 end notes from v")))
def parse_labels(spark, folder):
    return rs.parse_labels(dv.responses(spark, folder)).select("conv_id", "turn", F.size("transactions").alias("n"), "parse_error", "notes")


_TXNS = _JSON + (", x as (select *, case when ok then body when stop_reason = 'max_tokens' then regexp_extract(body, '(?s)^(.*\\}),', 1) || ']}' end fixed from v), "
                 "y as (select * from x where json_valid(fixed)), rt as (select conv_id, turn, case when ok then 1.0 else 0.8 end::double confidence, "
                 "unnest(range(cast(json_array_length(fixed, '$.transactions') as bigint))) idx, fixed from y), "
                 "rtx as (select conv_id, turn, confidence, idx, json_extract_string(fixed, '$.transactions[' || idx || '].date') date, json_extract_string(fixed, '$.transactions[' || idx || '].description') description, "
                 "cast(json_extract(fixed, '$.transactions[' || idx || '].amount') as double) amount, json_extract_string(fixed, '$.transactions[' || idx || '].type') as type, "
                 "cast(json_extract(fixed, '$.transactions[' || idx || '].balance_after') as double) balance_after from rt) ")


@query("jsn3_salvaged_transactions", fr.sql(fr.RESPONSES, _TXNS + "select * from rtx"))
def salvaged_transactions(spark, folder):
    return rs.response_transactions(dv.responses(spark, folder))


_LABELS = _JSON + (", ly as (select conv_id, turn, body1, unnest(range(cast(json_array_length(body1, '$.transactions') as bigint))) idx from v where ok1), "
                   "lt as (select conv_id, turn, idx, cast(json_extract(body1, '$.transactions[' || idx || '].amount') as double) amount, json_extract_string(body1, '$.transactions[' || idx || '].description') "
                   "description, json_extract_string(body1, '$.transactions[' || idx || '].type') as type from ly) ")


@query("jsn4_label_samples", fr.sql(fr.RESPONSES, _LABELS + "select 'c_' || conv_id stem, turn page_index, abs(amount) amount, description, type from lt"))
def label_samples(spark, folder):
    pages = rs.parse_labels(dv.responses(spark, folder)).select(
        F.concat(F.lit("c_"), F.col("conv_id").cast("string")).alias("stem"), F.col("turn").alias("page_index"), "transactions")
    return rs.label_samples(pages)


@query("snk4_auto_labels", fr.sql(fr.RESPONSES, _TXNS + (
    ", n as (select conv_id, turn, count(*) c from rtx group by 1, 2) select 'auto_' || substr(md5(cast(r.conv_id as varchar)), 1, 12) stem, r.turn page_index, coalesce(c, 0) n, coalesce(c, 0) > 0 has_transactions, "
    "'page_' || r.turn || '.png' source_image from responses r left join n on n.conv_id = r.conv_id and n.turn = r.turn where r.conv_id % 4 <> 0")))
def auto_labels(spark, folder):
    responses = dv.responses(spark, folder)
    key = F.substring(F.md5(F.col("conv_id").cast("string")), 1, 12)
    rows = rs.response_transactions(responses).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("idx", "date", "amount")).alias("transactions"))
    empty = F.array().cast("array<struct<idx:int,date:string,amount:double>>")
    pages = (responses.select("conv_id", "turn").join(rows, ["conv_id", "turn"], "left")
             .select(key.alias("pdf_hash"), F.col("turn").alias("page_index"), F.coalesce("transactions", empty).alias("transactions")))
    saved = responses.filter(F.col("conv_id") % 4 == 0).select(F.concat(F.lit("auto_"), key).alias("stem")).distinct()
    return ig.auto_labels(pages, saved).select("stem", "page_index", F.size("transactions").alias("n"), "has_transactions", "source_image")


# --- files ---------------------------------------------------------------------------------------

def _written(spark, folder=None, name="table"):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src1_page_word_files", fr.sql(fr.TOKENS, "select stem, page_index, pos, text, x0, y0, x1, y1, top, bottom from tokens"))
def page_word_files(spark, folder):
    """Word pages written as JSON lines and scanned back."""
    target = _written(spark, folder, "words")
    pages = fs.word_pages(dv.statement_tokens(spark, folder)).withColumn("pdf", F.concat("stem", F.lit(".pdf")))
    pages.select("pdf", "page_index", "word_count", "words").write.json(target)
    read = fs.token_table(fs.read_page_lines(spark, target))
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_index", "pos")})


@query("src2_label_files", fr.sql(fr.RESPONSES, _LABELS + "select conv_id, turn, count(*) n from lt group by 1, 2"))
def label_files(spark, folder):
    """Label rows written as JSON lines and read with the fixed schema."""
    target = _written(spark, folder, "labels")
    rs.parse_labels(dv.responses(spark, folder)).filter(~F.col("parse_error")).write.json(target)
    rows = spark.read.schema("conv_id long, turn long, " + fs.sc.LABELS_PAGE).json(target)
    return rows.filter(F.size("transactions") > 0).select("conv_id", "turn", F.size("transactions").alias("n"))


@query("src1_page_files", fr.sql(fr.TOKENS, "select stem, page_index, count(*) n from tokens group by 1, 2"))
def page_files(spark, folder):
    """Word pages in one file per page below a folder per statement, found and read again."""
    target = _written(spark, folder, "pages")
    pages = fs.word_pages(dv.statement_tokens(spark, folder)).withColumn("pdf", F.concat("stem", F.lit(".pdf")))
    fs.write_page_files(pages, target)
    return fs.read_pages(spark, target).select(
        F.regexp_replace("pdf", r"\.pdf$", "").alias("stem"), F.col("page_index").cast("long").alias("page_index"),
        F.size("words").cast("long").alias("n"))


@query("src3_listed_files", (
    "select 'd' || doc_id || case when doc_id % 2 = 0 then '.pdf' else '.PDF' end as name, sha256(case when doc_id % 3 = 0 then '%PDF-1.7' else 'PK' end || coalesce(text, '')) pdf_hash, "
    "doc_id % 3 = 0 as is_pdf from documents where doc_id % 5 <> 0"))
def listed_files(spark, folder):
    """Files written to a real folder, listed by suffix, fingerprinted and checked by their first bytes."""
    doc, target = F.col("doc_id"), _written(spark, folder, "files")
    suffix = F.when(doc % 5 == 0, ".txt").when(doc % 2 == 0, ".pdf").otherwise(".PDF")
    blobs = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), doc.cast("string"), suffix).alias("name"),
        F.concat(F.when(doc % 3 == 0, "%PDF-1.7").otherwise("PK"), F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    fs.write_files(blobs, target)
    # Files are read once: what fingerprint and marker need of them is kept, and joined without their contents.
    listed = materialise(fs.list_statements(spark, target, content=True).select(
        "path", ig.fingerprint(F.col("content")).alias("pdf_hash"), F.substring("content", 1, 8).alias("content")), "listed")
    magic = ig.pdf_files(listed).select("path", F.lit(True).alias("is_pdf"))
    return listed.join(magic, "path", "left").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "pdf_hash", F.coalesce("is_pdf", F.lit(False)).alias("is_pdf"))


@query("src3_statement_listing", fr.sql(fr.FILES, "select distinct regexp_replace(path, '^.*/', '') as name from files where ends_with(lower(name), '.pdf')"))
def statement_listing(spark, folder):
    """Distinct PDF paths of the file listing (the listing of a real folder is tested on files)."""
    files = dv.statement_files(spark, folder)
    return files.filter(F.lower("path").endswith(".pdf")).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).distinct()


@query("snk1_json_export", esql("select stem, seq, month_key, category, cents / 100.0 amount from enriched"))
def json_export(spark, folder):
    target = _written(spark, folder, "export")
    rows = materialise(enriched(spark, folder), "enriched")  # one pass writes the rows, five sum them up
    fs.export_summary(rows, plan.summary_tables(rows), target)
    read = spark.read.schema("stem string, seq long, month_key string, category string, amount double").json(f"{target}/transactions")
    return read


#: Key column and measures of each exported table, and the query whose statement gives the same rows.
_EXPORTED = {
    "monthly": ("month_key", ["income", "expenses", "n", "net"], "agg1_monthly_cashflow"),
    "categories": ("category", ["total", "share"], "agg2_category_totals"),
    "balances": ("parsed_date", ["balance"], "agg3_daily_balances"),
    "merchants": ("merchant", ["n", "total"], "agg4_top_merchants"),
    "portfolio": ("'all'", ["total_income", "total_expenses", "months_analyzed", "total_transactions", "flagged_transactions",
                            "net_cashflow", "avg_monthly_spend"], "agg5_portfolio")}


def _exported_sql():
    parts = []
    for name, (key, measures, twin) in _EXPORTED.items():
        names, values = ", ".join(lit(m) for m in measures), ", ".join(f"cast({m} as double)" for m in measures)
        parts.append(f"select {lit(name)} as tbl, cast({key} as varchar) as item, unnest([{names}]) as measure, unnest([{values}]) as val "
                     f"from ({ORACLES[twin]}) as x")
    return " union all ".join(parts)


@query("snk1_summary_export", _exported_sql())
def summary_export(spark, folder):
    """All summary tables as they are read back from the export, a row per measure."""
    target = _written(spark, folder, "export")
    rows = materialise(enriched(spark, folder), "enriched")
    tables = plan.summary_tables(rows)
    fs.export_summary(rows, tables, target)
    read = fs.read_summary(spark, target, {name: table.schema for name, table in tables.items()})
    parts = [read[name].select(F.lit(name).alias("tbl"), F.expr(key).cast("string").alias("item"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("val")) for m in measures])))
        for name, (key, measures, _) in _EXPORTED.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("snk2_page_write", fr.sql(fr.TOKENS, "select stem, page_index, count(*) word_count, string_agg(true_tag, ' ' order by pos) tags from tokens group by 1, 2"))
def page_write(spark, folder):
    target = _written(spark, folder, "bio")
    tagged = dv.statement_tokens(spark, folder).withColumn("tag", F.col("true_tag"))
    fs.write_pages(fs.bio_pages(tagged, F.lit("rules")), target, buckets=8)
    return spark.read.parquet(target).select("stem", "page_index", "word_count", F.array_join("tags", " ").alias("tags"))


# --- models ---------------------------------------------------------------------------------------

def _samples(spark, folder):
    return dv.statement_txns(spark, folder).select("k", "stem", "seq", "page", "amount", "description", "true_type",
                                                   F.col("true_type").alias("type"))


_STOP = "[" + ", ".join(lit(w) for w in lx.STOP_WORDS) + "]"
_FLAGS11 = ", ".join(f"case when contains(lower(coalesce(description, '')), {lit(w)}) then 1.0 else 0.0 end"
                     for w in lx.MODEL_DEBIT_WORDS + lx.MODEL_CREDIT_WORDS)


@query("txn11_type_features", fr.sql(fr.TXN, (
    f", ws as (select *, [x for x in regexp_extract_all(lower(coalesce(description, '')), '{ml.TERM}') if not list_contains({_STOP}, x)] w from txn), "
    "tm as (select k, w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] t from ws), "
    "ct as (select k, term, count(*) tf from (select k, unnest(t) term from tm) group by 1, 2), "
    "vo as (select term, sum(tf) n, ln(cast((select count(*) from txn) + 1 as double) / (count(*) + 1)) + 1 wt from ct group by 1 order by n desc, term limit 50), "
    "rk as (select term, wt, row_number() over (order by n desc, term) r from vo), "
    "wv as (select k, r, tf * wt v from ct join rk using (term)), "
    "dn as (select k, list(coalesce(v, 0.0) order by r) v, sqrt(coalesce(sum(v * v), 0)) norm from (select k from txn) cross join rk left join wv using (k, r) group by 1) "
    "select k, [round(cast(x as double), 6) for x in [case when cents < 0 then 1.0 else 0.0 end, ln(1 + abs(cents / 100.0)), coalesce(page, 0) / 20.0, "
    f"{_FLAGS11}] || [case when norm > 0 then y / norm else y end for y in v]] features from txn join dn using (k)")))
def type_features(spark, folder):
    samples = _samples(spark, folder)
    featured = ml.type_features(samples, ml.fit_text_terms(samples))
    return featured.select("k", F.transform(ml.vector_to_array("features"), lambda v: F.round(v, 6)).alias("features"))


def _typed(spark, folder):
    split = sp.group_split(_samples(spark, folder))
    train = split.filter(F.col("split") == "train")
    terms = ml.fit_text_terms(train)
    model = ml.fit_typing(ml.type_features(train, terms))
    return ml.predict_types(ml.type_features(split.filter(F.col("split") == "test"), terms), model)


@query("txn12_typing_model")
def typing_model(spark, folder):
    return _typed(spark, folder).select("k", "true_type", "model_type", "model_prob")


# Weights of a model are no SQL matter; what must hold for any fit is: which rows are scored, no statement on both
# sides of the split, probabilities, and more right answers than the most frequent class gives.
_SPLIT = "cast('0x' || substr(md5('42|' || stem), 1, 8) as bigint) % 100 < 15"


def _facts(scored, truth, guess, probability, low):
    """Rows per true class with two facts about the whole: probabilities in range, accuracy above the largest class."""
    by_class = scored.groupBy(F.col(truth).alias("truth")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("right"),
        F.bool_and(F.col(probability).between(low, 1)).alias("ok"))
    whole = by_class.agg(F.bool_and("ok").alias("in_range"), (F.sum("right") > F.max("n")).alias("above_majority"), F.lit(1).alias("one"))
    return by_class.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select("truth", "n", "in_range", "above_majority")


@query("txn12_model_facts", fr.sql(fr.TXN, f"select true_type truth, count(*) n, true in_range, true above_majority from txn where {_SPLIT} group by 1"))
def typing_model_facts(spark, folder):
    return _facts(_typed(spark, folder), "true_type", "model_type", "model_prob", 0.5)


@query("txn9_split_facts", fr.sql(fr.TXN, f"select case when {_SPLIT} then 'test' else 'train' end split, count(*) n, count(distinct stem) stems, 0::bigint leaked from txn group by 1"))
def typing_split_facts(spark, folder):
    """Rows and statements on either side of the split that learned typing uses, and statements on both."""
    split = sp.group_split(_samples(spark, folder))
    sides = split.groupBy("stem", "split").agg(F.count(F.lit(1)).alias("n"))
    both = sides.groupBy("stem").agg(F.count(F.lit(1)).alias("sides"))
    return sides.join(both, "stem").groupBy("split").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("stems"), F.count_if(F.col("sides") > 1).alias("leaked"))


@query("txn13_type_accuracy", fr.sql(fr.TXN, (
    f", w as (select true_type, case when {any_of('lower(description)', lx.CREDIT_WORDS)} then 'credit' else 'debit' end p from txn) select true_type, count(*) n, "
    "count(*) filter (true_type = p) correct, count(*) filter (true_type = p) / count(*) accuracy from w group by rollup(true_type)")))
def type_accuracy(spark, folder):
    txns = dv.statement_txns(spark, folder).withColumn("pred_type", tx.type_by_words(F.col("description")))
    return ev.type_accuracy(txns)


@query("txn9_learned_types")
def learned_types(spark, folder):
    train = sp.group_split(_samples(spark, folder)).filter(F.col("split") == "train")
    terms = ml.fit_text_terms(train)
    model = ml.fit_typing(ml.type_features(train, terms))
    held_out = sp.group_split(dv.statement_txns(spark, folder)).filter(F.col("split") == "test").drop("split")
    return tx.infer_types(ml.predict_types(ml.type_features(held_out, terms), model)).select("k", "type")


@query("tag10_learned_tags")
def learned_tags(spark, folder):
    words = materialise(dv.statement_tokens(spark, folder).select(  # weights, labels, fit and scores read it
        "stem", "page_index", "pos", "text", "x0", "top", "true_tag"), "words")
    weights = tg.class_weights(spark, tg.tag_histogram(words.withColumn("tag", F.col("true_tag"))))
    # The written words are packed into few large tasks; the fit holds its rows in memory, so they are dealt again.
    train = spread(sp.group_split(words).filter(F.col("split") == "train"), ["stem", "page_index"], words.count(), 400_000)
    model = ml.fit_tagger(ml.token_features(train), weights)
    return ml.predict_tags(ml.token_features(words), model).select("stem", "page_index", "pos", "true_tag", "tag", F.round("conf", 4).alias("conf"))


@query("tag10_model_facts", fr.sql(fr.TOKENS, "select true_tag truth, count(*) n, true in_range, true above_majority from tokens group by 1"))
def tagging_model_facts(spark, folder):
    """Facts about the tags of all tokens, of the statements that the tagger was fitted on too."""
    return _facts(learned_tags(spark, folder), "true_tag", "tag", "conf", 0)


# --- whole flows -----------------------------------------------------------------------------------

# The same chain in SQL: the token table is renamed, so that the tagger reads the trimmed pages.
_RULES = TAGGED + ", src as (select stem, page_index, pos, text, tag, 1.0 conf from tagged)"
_FLOW = (fr.TOKENS.replace("tokens as (", "alltokens as (") + _TRIM.replace("from tokens", "from alltokens") + ", tokens as (select * from trimmed)"
         + ROWED + _RULES + _DEC
         + f", built as (select stem, page, seq, date_text date, coalesce(desc_text, '') description, {parse_sql('coalesce(amount_text, chr(48))')} v, "
           f"case when balance_text <> '' then {parse_sql('balance_text')} end bal from decoded where coalesce(trim(amount_text), '0') <> ''), "
           "cents0 as (select *, cast(round(abs(v) * 100) as bigint) c0, case when v < 0 then 'debit' else 'unknown' end t0, cast(round(bal * 100) as bigint) balance_cents, "
           f"regexp_extract_all(description, '{mn.EMBEDDED}') m from built), "
           "cents1 as (select *, case when c0 = 0 and len(m) > 0 then try_cast(replace(replace(replace(replace(m[len(m)], '$', ''), ',', ''), '−', '-'), '–', '-') as double) end e from cents0), "
           "cents2 as (select stem, page, seq, date, balance_cents, case when e is null then description else trim(regexp_replace(list_reduce(m, lambda acc, x: replace(acc, x, ''), description), "
           "'\\s+', ' ', 'g')) end description, case when e is null then c0 else cast(round(abs(e) * 100) as bigint) end cents, case when e < 0 then 'debit' else t0 end as type from cents1), "
           f"clean as (select * from cents2 where (cents <> 0 or balance_cents is not null) and not ({_SUMMARY}))"
         + SECTIONS.replace("from tokens", "from alltokens") + section_sql("clean") + _PREV.format(src="sectioned")
         + f", flow as (select stem, page, seq, date, description, cents, case when type <> 'unknown' then type else coalesce({_BYBAL}, section_type, {_WORDS}) end as type, balance_cents from prev) ")


@query("flow_parsed_transactions", "with recursive " + _FLOW + (
    "select stem, page, seq, date, description, cents / 100.0 amount, type, balance_cents / 100.0 balance_after, 1.0::double confidence from flow"))
def parsed_transactions(spark, folder):
    return doubles(plan.parse_statements(dv.statement_tokens(spark, folder), write=True).select(
        "stem", "page", "seq", "date", "description", "amount", "type", "balance_after", "confidence"), "amount", "balance_after")


_SERVED = CHUNKS + (
    ", pr as (select stem, page_index, pos, text, chunk, case when chunk % 2 = 0 then pred_tag else true_tag end tag, ((pos * 7 + chunk * 13) % 10) / 10.0 conf from ck), "
    "bs as (select *, row_number() over (partition by stem, page_index, pos order by conf desc, chunk) rn from pr), "
    "src as (select stem, page_index, pos, text, case when conf <= 0 and chunk > 0 then 'O' else tag end tag, conf from bs where rn = 1)")


@query("flow_tagged_transactions", "with recursive " + _FLOW.replace(_RULES, _SERVED) + (
    "select stem, page, seq, date, description, cents / 100.0 amount, type, balance_cents / 100.0 balance_after from flow"))
def tagged_transactions(spark, folder):
    """The serving chain with given predictions: trim, chunk, score, merge, decode, clean, type."""
    def score(chunks):
        return (chunks.withColumn("tag", F.when(F.col("chunk") % 2 == 0, F.col("pred_tag")).otherwise(F.col("true_tag")))
                .withColumn("conf", (F.col("pos") * 7 + F.col("chunk") * 13) % 10 / 10.0))

    txns = plan.parse_predictions(dv.statement_tokens(spark, folder), FIT, score, write=True)
    return doubles(txns.select("stem", "page", "seq", "date", "description", "amount", "type", "balance_after"), "amount", "balance_after")


@query("flow_monthly_from_tokens", "with recursive " + _FLOW + (
    f", dated as (select *, strftime({sf.parse_date('date', str(YEAR))}, '%Y-%m') month_key from flow) select month_key, cast(sum(case when type = 'credit' then cents else 0 end) as bigint) / 100.0 income, "
    "cast(sum(case when type <> 'credit' then cents else 0 end) as bigint) / 100.0 expenses, count(*) n, cast(sum(case when type = 'credit' then cents else -cents end) as bigint) / 100.0 net "
    "from dated where month_key is not null group by 1"))
def monthly_from_tokens(spark, folder):
    txns = plan.parse_statements(dv.statement_tokens(spark, folder), write=True).withColumn("source_file", F.concat("stem", F.lit(".pdf")))
    return doubles(plan.spending_tables(txns, YEAR)["monthly"], "income", "expenses", "net")


@query("flow_statement_results", "with recursive " + _FLOW + _LOWP.replace("from tokens", "from alltokens") + (
    ", wc as (select stem, count(*) word_count from alltokens group by 1), ft as (select stem, cast(sum(case when type = 'credit' then cents else 0 end) as bigint) dep, "
    "cast(sum(case when type = 'debit' then cents else 0 end) as bigint) wd, cast(sum(balance_cents) as bigint) bs, count(balance_cents) bn, "
    f"count(*) filter ({any_of('upper(description)', lx.NSF_WORDS)}) nsf_count, count(*) transactions from flow group by 1) "
    "select stem, page_count, word_count, coalesce(dep, 0) / 100.0 total_deposits, coalesce(wd, 0) / 100.0 total_withdrawals, coalesce(nsf_count, 0) nsf_count, "
    f"coalesce(transactions, 0) transactions, case when bs <> 0 then ({sf.half_even('bs', 'bn')}) / 100.0 end average_daily_balance, 'rules-1' model_version, "
    "len(low) n_low_pages from pg left join wc using (stem) left join ft using (stem)"))
def statement_results(spark, folder):
    words = dv.statement_tokens(spark, folder)
    results = plan.parse_results(plan.parse_statements(words, write=True), words.withColumn("tag", F.col("pred_tag")), None, "rules-1")
    return doubles(results, "total_deposits", "total_withdrawals", "average_daily_balance")


# --- streams ------------------------------------------------------------------------------------------

def _staged(spark, name, table_rows, bucket, key, buckets=4, files=2):
    """A table as a stream of several files: bucket after bucket is written, so that batches come in that order."""
    target = _written(spark, folder=None, name=name)
    rows = table_rows.withColumn("_bucket", bucket)
    for number in range(buckets):
        rows.filter(F.col("_bucket") == number).drop("_bucket").repartition(files, key).write.mode("append").parquet(target)
    return spark.readStream.schema(table_rows.schema).option("maxFilesPerTrigger", 1).parquet(target)


@query("str1_new_statements", "select distinct sha256(cast(user_id as varchar)) pdf_hash from events")
def new_statements(spark, folder):
    events = _staged(spark, "str1", table(spark, folder, "events"), F.col("event_id") % 4, "event_id").select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("pdf_hash"))
    return jobs.run_new_statements(spark, events, "pdf_hash").select("pdf_hash")


@query("str2_feedback_rates", (
    "select date_trunc('hour', ts) as start, event_type as method, count(*) n, cast(sum(cast(value as decimal(18,2))) as double) deposits, cast(sum(cast(value as decimal(18,2))) as double) / count(*) mean_deposits from events group by 1, 2 "
    "having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 2 hour from events)"))
def feedback_rates(spark, folder):
    events = jobs.read_stream(spark, folder, "events").select(
        F.col("event_type").alias("method"), F.col("value").cast("decimal(18,2)").alias("total_deposits"), F.col("ts").cast("timestamp").alias("created_at"))
    rates = jobs.run_to_table(spark, jobs.feedback_rates(events), "str2")
    return doubles(rates.withColumn("start", F.col("start").cast("timestamp_ntz")), "deposits")


@query("str3_running_months", esql(_MONTHLY.replace(", cast(sum(case when type = 'credit' then cents else -cents end) as bigint) / 100.0 net", "")))
def running_months(spark, folder):
    def summarise(batch):
        txns = dv.txns_of_orders(batch).withColumn("type", F.col("true_type"))
        return jobs.monthly_deltas(en.enrich(txns, YEAR).filter(F.col("month_key") != "unknown"))

    deltas = jobs.run_batches(spark, jobs.read_stream(spark, folder, "orders"), "str3", summarise)
    return doubles(jobs.merge_months(deltas), "income", "expenses")


@query("str4_retrain_trigger", "select count(*) auto_pages, count(*) >= 50 ready_for_retrain from documents where (doc_id // 5) % 4 = 0")
def retrain_trigger(spark, folder):
    docs = jobs.read_stream(spark, folder, "documents")
    group = F.floor(F.col("doc_id") / 5)
    pages = docs.select(F.concat(F.when(group % 4 == 0, "auto_").otherwise("doc_"), group.cast("string")).alias("stem"))
    return jobs.retrain_due(jobs.run_batches(spark, pages, "str4", jobs.retrain_counter), lx.MIN_PAGES_FOR_RETRAIN)


@query("str4_retrain_signals", (
    "select source, rn // 50 as signal, rn pages from (select coalesce(source, '') source, row_number() over (partition by source order by doc_id) rn "
    "from documents where (doc_id // 5) % 4 = 0) where rn % 50 = 0"))
def retrain_signals(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    stream = _staged(spark, "str4", docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)), "doc_id").filter(F.floor(F.col("doc_id") / 5) % 4 == 0)
    signals = jobs.run_retrain_signals(spark, stream, "source", lx.MIN_PAGES_FOR_RETRAIN)
    return signals.select(F.coalesce("key", F.lit("")).alias("source"), "signal", "pages")


@query("str5_running_balances", fr.sql(fr.TXN, (
    "select stem, seq, last_value(balance_cents ignore nulls) over (partition by stem order by seq rows between unbounded preceding and 1 preceding) / 100.0 prev_balance from txn")))
def running_balances(spark, folder):
    txns = dv.statement_txns(spark, folder).select("stem", "seq", "amount", "balance_after")
    shuffled = F.pmod(F.xxhash64("stem", "seq"), F.lit(4))  # eight files, every statement in all of them and out of order
    stream = _staged(spark, "str5", txns, shuffled, "seq")
    rows = jobs.run_balances(spark, stream)
    return doubles(rows.select("stem", "seq", "prev_balance"), "prev_balance")
