"""Ingestion, filter and bank queries."""

from pyspark.sql import functions as F

from ledgerloom.catalog import frames as fr
from ledgerloom.catalog.frames import any_of, lit
from ledgerloom.catalog.registry import query
from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.text import path_name, safe_name
from ledgerloom.operators import banks as bk
from ledgerloom.operators import filters as fl
from ledgerloom.operators import ingest as ig
from ledgerloom.sources import derive as dv
from ledgerloom.sources.tables import table


@query("src4_fingerprint", "select doc_id, sha256(text) pdf_hash from documents")
def fingerprint(spark, folder):
    return table(spark, folder, "documents").select("doc_id", ig.fingerprint(F.col("text")).alias("pdf_hash"))


def _scaled(v, size):
    return f"cast(trunc(greatest(0.0, least(1000.0, {v} / {size} * 1000))) as bigint)"


@query("src5_normalise_boxes", (
    f"select l_orderkey, l_linenumber, {_scaled('(l_extendedprice / 90 - 50)', '612.0::double')} x0, "
    f"{_scaled('l_quantity * 20', '792.0::double')} y0, {_scaled('(l_extendedprice / 90 - 20)', '612.0::double')} x1, "
    f"{_scaled('(l_quantity * 20 + 10)', '792.0::double')} y1 from lineitem"))
def normalise_boxes(spark, folder):
    x, y = F.col("l_extendedprice") / 90, F.col("l_quantity") * 20
    raw = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (x - 50).alias("x0"), y.alias("y0"), (x - 20).alias("x1"), (y + 10).alias("y1"),
        F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return ig.normalise_boxes(raw).drop("width", "height")


def _padded():
    k = F.col("k")
    return (F.when(k % 9 == 0, F.concat(F.lit(" "), "text", F.lit("\t"))).when(k % 11 == 0, "  ")
            .when(k % 13 == 0, F.lit(None)).otherwise(F.col("text")))


@query("src6_clean_ocr_tokens", fr.sql(fr.TOKENS, (
    "select stem, page_index, pos, text from tokens where not (k % 9 <> 0 and (k % 11 = 0 or k % 13 = 0)) "
    "and conf >= 0.30")))
def clean_ocr_tokens(spark, folder):
    raw = dv.statement_tokens(spark, folder).withColumn("text", _padded()).withColumn(
        "ocr_conf", F.round(F.col("conf") * 100))
    return ig.clean_tokens(raw, ocr=True).select("stem", "page_index", "pos", "text")


_CHOSEN = (", nat as (select *, false used_ocr from tokens where (k // 20) % 4 = 0 or pos < 12), ocr as (select *, true used_ocr "
           "from tokens where conf >= 0.8), cnt as (select stem, page_index, count(*) filter (not used_ocr) n, "
           "count(*) filter (used_ocr) m from (select * from nat union all select * from ocr) group by 1, 2), "
           "chosen as (select a.stem, a.page_index, pos, text, used_ocr from (select * from nat union all select * from ocr) a "
           "join cnt using (stem, page_index) where used_ocr = (n < 20 and m > n)) ")


def _word_sources(spark, folder):
    tokens = dv.statement_tokens(spark, folder)
    return tokens.filter((F.floor(F.col("k") / 20) % 4 == 0) | (F.col("pos") < 12)), tokens.filter(F.col("conf") >= 0.8)


def _chosen(spark, folder):
    return ig.choose_words(*_word_sources(spark, folder)).select("stem", "page_index", "pos", "text", "used_ocr")


@query("src7_word_source", fr.sql(fr.TOKENS, _CHOSEN + "select * from chosen"))
def word_source(spark, folder):
    return _chosen(spark, folder)


@query("src7_word_choices", fr.sql(fr.TOKENS, _CHOSEN + (
    "select count(*) pages, count(*) filter (n < 20 and m > n) ocr_pages, cast(coalesce(sum(n) filter (n < 20 and m > n), 0) as bigint) native_left_out, "
    "cast(coalesce(sum(m) filter (not (n < 20 and m > n)), 0) as bigint) ocr_left_out from cnt")))
def word_choices(spark, folder):
    return ig.word_choices(*_word_sources(spark, folder))


@query("src8_extraction_stats", fr.sql(fr.TOKENS, _CHOSEN + (
    ", pg as (select stem, page_index, count(*) wc, bool_or(used_ocr) o from chosen group by 1, 2) select stem, count(*) pages, "
    "cast(sum(wc) as bigint) words_total, count(*) filter (o) ocr_pages from pg group by rollup(stem)")))
def extraction_stats(spark, folder):
    pages = _chosen(spark, folder).groupBy("stem", "page_index").agg(
        F.count(F.lit(1)).alias("word_count"), F.bool_or("used_ocr").alias("used_ocr"))
    return ig.extraction_stats(pages)


@query("src9_not_done", fr.sql(fr.TRAINING, "select stem, page_index from training where not labelled"))
def not_done(spark, folder):
    pages = dv.training_pages(spark, folder)
    return ig.not_done(pages, pages.filter("labelled"), ["stem", "page_index"]).select("stem", "page_index")


_URLS = (", u0 as (select id, form, unnest(list_filter(list, lambda x: ends_with(lower(x), '.pdf'))) url from answers where kind <> "
         "'control_textbox' union all select id, form, unnest(regexp_extract_all(pretty, 'href=[\"'']?(https?://[^\"''>\\s]+\\.pdf)', "
         "1, 'i')) from answers where contains(lower(pretty), '.pdf') union all select id, form, txt from answers where "
         "starts_with(txt, 'http') and contains(lower(txt), '.pdf')), urls as (select distinct id, form, url from u0) ")


@query("src10_submission_urls", fr.sql(fr.SUBMISSIONS, _URLS + "select id, form, url from urls"))
def submission_urls(spark, folder):
    return ig.submission_urls(dv.submissions(spark, folder))


def _app_manifest(spark, folder):
    return table(spark, folder, "customer").filter(F.col("c_custkey") % 3 == 0).select(
        F.concat(F.lit("app_"), "c_custkey", F.lit("_1")).alias("manifest_key"))


@query("src11_application_uploads", fr.sql(fr.APPS, (
    "select id, idx, u.filename filename, u.storage_path storage_path, 'app_' || id || '_' || idx manifest_key, "
    "regexp_replace('app_' || id || '_' || u.filename, '[^\\p{L}\\p{N}.\\-_]', '_', 'g') safe_name from apps "
    "where u.storage_path is not null and ends_with(lower(u.filename), '.pdf') and not (id % 3 = 0 and idx = 1)")))
def application_uploads(spark, folder):
    return ig.application_uploads(dv.applications(spark, folder), _app_manifest(spark, folder))


_DEALS = (", wanted as (select *, regexp_replace('deal_' || deal_id || '_' || file_name, '[^\\p{L}\\p{N}.\\-_]', '_', 'g') safe_name, "
          "'deal_' || id manifest_key from deals where (contains(lower(content_type), 'pdf') or ends_with(lower(file_name), '.pdf')) "
          "and not id % 7 = 0) ")


def _deal_uploads(spark, folder):
    docs = dv.deal_documents(spark, folder)
    manifest = docs.filter(F.col("id") % 7 == 0).select(F.concat(F.lit("deal_"), "id").alias("manifest_key"))
    return ig.deal_uploads(docs, manifest)


@query("src12_deal_uploads", fr.sql(fr.DEALS, _DEALS + "select id, deal_id, file_name, storage_path, bucket, content_type, "
                                    "manifest_key, safe_name from wanted"))
def deal_uploads(spark, folder):
    return _deal_uploads(spark, folder)


_LAST = "regexp_extract(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '?', 1), '#', 1), '([^/]*)/*$', 1)"


@query("src13_safe_names", fr.sql(fr.SUBMISSIONS, _URLS + (
    f"select id, url, 'jf_' || id || '_' || regexp_replace({_LAST}, '[^\\p{{L}}\\p{{N}}.\\-_]', '_', 'g') jf_name, "
    f"regexp_replace('M&T Bank / ' || form, '[^\\p{{L}}\\p{{N}}_]', '_', 'g') || '_' || {_LAST} bank_name from urls")))
def safe_names(spark, folder):
    return ig.submission_urls(dv.submissions(spark, folder)).select(
        "id", "url", ig.submission_name(F.col("url"), F.col("id")).alias("jf_name"),
        ig.bank_prefixed_name(F.concat(F.lit("M&T Bank / "), "form"), path_name(F.col("url"))).alias("bank_name"))


_ALL_FILES = ("select safe_name filename, 'deal_documents' as source from wanted union all select regexp_replace('app_' || id || '_' || "
              "u.filename, '[^\\p{L}\\p{N}.\\-_]', '_', 'g'), 'applications' from apps where u.storage_path is not null and "
              "ends_with(lower(u.filename), '.pdf') and not (id % 3 = 0 and idx = 1) union all select 'local_' || regexp_replace(name, "
              "'[^\\p{L}\\p{N}.\\-_]', '_', 'g'), 'local' from files where ends_with(lower(name), '.pdf')")


def _all_files(spark, folder):
    deals = _deal_uploads(spark, folder).select(F.col("safe_name").alias("filename"), F.lit("deal_documents").alias("source"), "deal_id")
    apps = application_uploads(spark, folder).select(
        F.col("safe_name").alias("filename"), F.lit("applications").alias("source"), F.col("id").alias("application_id"))
    local = dv.statement_files(spark, folder).filter(F.lower("name").endswith(".pdf")).select(
        safe_name(F.concat(F.lit("local_"), "name")).alias("filename"), F.lit("local").alias("source"))
    return deals.unionByName(apps, allowMissingColumns=True).unionByName(local, allowMissingColumns=True)


_THREE = fr.sql(fr.DEALS, _DEALS + ", " + fr.APPS + ", " + fr.FILES)


@query("set1_union_of_sources", _THREE + ", m as (" + _ALL_FILES + ") select filename, source from m")
def union_of_sources(spark, folder):
    return _all_files(spark, folder).select("filename", "source")


@query("src14_manifest_stats", _THREE + ", m as (" + _ALL_FILES + ") select source, count(*) files from m group by rollup(source)")
def manifest_stats(spark, folder):
    return ig.manifest_stats(_all_files(spark, folder))


_SKIP = [w.replace("_", "") for w in lx.NON_STATEMENT_NAMES]
_ISSTMT = (f"(not {any_of(f'regexp_replace(lower({_LAST}), $$%20|[-_ ]$$, $$$$, $$g$$)', _SKIP)} and ends_with(lower({_LAST}), '.pdf') "
           f"and length(replace(lower({_LAST}), '.pdf', '')) >= 3)")


@query("flt1_statement_names", fr.sql(fr.SUBMISSIONS, _URLS + f"select id, url, {_ISSTMT} is_statement from urls"))
def statement_names(spark, folder):
    return ig.submission_urls(dv.submissions(spark, folder)).select("id", "url", fl.is_statement_name(F.col("url")).alias("is_statement"))


@query("src15_acquisition_funnel", fr.sql(fr.SUBMISSIONS, _URLS + (
    f", n as (select *, {_ISSTMT} s, 'jf_' || id || '_' || regexp_replace({_LAST}, '[^\\p{{L}}\\p{{N}}.\\-_]', '_', 'g') fnm from urls), "
    "g as (select *, id % 6 = 0 held, id % 4 <> 1 ok from n), h as (select *, row_number() over (partition by fnm, s order by url) rn from g) "
    "select form, count(*) found, count(*) filter (not s) filtered, count(*) filter (s and (held or (ok and rn > 1))) already_had, "
    "count(*) filter (s and not held and ok and rn = 1) downloaded, count(*) filter (s and not held and not ok) failed "
    "from h group by rollup(form)")))
def acquisition_funnel(spark, folder):
    urls = ig.submission_urls(dv.submissions(spark, folder)).withColumn("ord", F.col("url"))
    names = urls.select("id", ig.submission_name(F.col("url"), F.col("id")).alias("filename")).distinct()
    existing = names.filter(F.col("id") % 6 == 0).select("filename")
    outcomes = names.select("filename", (F.col("id") % 4 != 1).alias("ok"))
    return ig.acquisition_funnel(urls, existing, outcomes)


@query("src16_pdf_magic", "select doc_id from documents where doc_id % 3 = 0")
def pdf_magic(spark, folder):
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7").otherwise("PK"), "text").cast("binary")
    return ig.pdf_files(table(spark, folder, "documents").select("doc_id", content.alias("content"))).select("doc_id")


@query("snk3_first_writes", fr.sql(fr.LOG, (
    "select pdf_hash, event_id, method, cast(total_deposits as double) total_deposits from (select *, substr(md5(cast(deal_id as "
    "varchar)), 1, 12) pdf_hash, row_number() over (partition by deal_id order by created_at, event_id) rn from log where deal_id % 10 <> 3) "
    "where rn = 1")))
def first_writes(spark, folder):
    log = dv.feedback_log(spark, folder)
    key = F.substring(F.md5(F.col("deal_id").cast("string")), 1, 12).alias("pdf_hash")
    rows = log.select(key, "event_id", "method", F.col("total_deposits").cast("double").alias("total_deposits"), "created_at")
    held = log.filter(F.col("deal_id") % 10 == 3).select(key).distinct()
    return ig.first_writes(rows, "pdf_hash", ["created_at", "event_id"], held).drop("created_at")


def _score_sql(t):
    low = f"lower({t})"
    hits = " + ".join(f"contains({low}, {lit(w)})::int" for w in lx.CONTENT_TXN)
    return (f"case when length(regexp_replace({low}, '^\\s+|\\s+$', '', 'g')) >= 100 then {any_of(low, lx.CONTENT_BANK)}::int + "
            f"{any_of(low, lx.CONTENT_ACCOUNT)}::int + {any_of(low, lx.CONTENT_PERIOD)}::int + (({hits}) >= 3)::int + "
            f"(len(regexp_extract_all({t}, '{lx.DOLLARS}')) >= 3)::int end")


@query("flt2_statement_content", fr.sql(fr.FILES, f"select doc_id, {_score_sql('text')} score, coalesce({_score_sql('text')} >= 2, false) keep from files"))
def statement_content(spark, folder):
    return dv.statement_files(spark, folder).select(
        "doc_id", fl.statement_score(F.col("text")).alias("score"), fl.is_statement_text(F.col("text")).alias("keep"))


@query("flt2_scoring_counts", fr.sql(fr.FILES, (
    f", sc as (select text, {_score_sql('text')} score from files) select count(*) filter (text is null) no_text, "
    "count(*) filter (text is not null and score is null) too_short, count(score) scored, count(*) filter (score >= 2) kept from sc")))
def scoring_counts(spark, folder):
    return fl.scoring_counts(dv.statement_files(spark, folder))


@query("flt3_candidate_counts", fr.sql(fr.FILES, (
    f"select case when size is null or size < 10000 then 'small' when {any_of('lower(name)', lx.NON_CANDIDATE_NAMES)} then 'name' "
    "when text is null or length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 then 'short_text' "
    "when doc_id % 10 = 4 then 'known' else 'kept' end fate, count(*) n from files group by 1")))
def candidate_counts(spark, folder):
    files = dv.statement_files(spark, folder)
    return fl.candidate_counts(files, files.filter(F.col("doc_id") % 10 == 4))


@query("flt3_candidate_files", fr.sql(fr.FILES, (
    f"select doc_id, name from files where size >= 10000 and not {any_of('lower(name)', lx.NON_CANDIDATE_NAMES)} and "
    "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50 and doc_id % 10 <> 4")))
def candidate_files(spark, folder):
    files = dv.statement_files(spark, folder)
    return fl.candidate_files(files, files.filter(F.col("doc_id") % 10 == 4)).select("doc_id", "name")


@query("flt4_training_pages", fr.sql(fr.TRAINING, (
    "select doc_id from training where labelled and alignment_rate >= 50 and reviewed and review_status <> 'rejected' and has_image "
    "and word_count > 0")))
def training_pages(spark, folder):
    pages = dv.training_pages(spark, folder)
    return fl.training_filter(pages, pages.filter("labelled"), only_reviewed=True).select("doc_id")


@query("flt4_skipped_pages", fr.sql(fr.TRAINING, "select count(*) skipped from training where not labelled"))
def skipped_pages(spark, folder):
    pages = dv.training_pages(spark, folder)
    return fl.skipped_pages(pages, pages.filter("labelled"))


@query("flt5_review_queue", fr.sql(fr.TRAINING, "select stem, page_index from training where not reviewed and alignment_rate < 60"))
def review_queue(spark, folder):
    return fl.review_queue(dv.training_pages(spark, folder), below=60.0).select("stem", "page_index")


_HEAD = ("case " + " ".join(f"when contains(t, {lit(p)}) then {lit(b)}" for p, b in lx.BANK_SUBSTRINGS) + " else 'unknown' end")


@query("bnk1_bank_of_head", fr.sql(fr.TOKENS, (
    ", h as (select stem, string_agg(lower(text), ' ' order by pos) t from tokens where page_index = 0 group by 1) "
    f"select stem, {_HEAD} bank from h")))
def bank_of_head(spark, folder):
    return bk.detect_bank_format(dv.statement_tokens(spark, folder))


_BNK2 = fr.ordered_case("text", [("|".join(f"(?:{p})" for p in ps), b) for b, ps, _ in lx.SAMPLED_BANKS], "'Unknown'", "(?i)")


@query("bnk2_bank_of_text", fr.sql(fr.FILES, f"select doc_id, {_BNK2} bank from files"))
def bank_of_text(spark, folder):
    return dv.statement_files(spark, folder).select("doc_id", bk.bank_of_text(F.col("text")).alias("bank"))


def _multi(expr, rules):
    hits = ", ".join(f"case when regexp_matches({expr}, {lit('(?i)' + '|'.join(f'(?:{p})' for p in ps))}) then {lit(b)} end"
                     for b, ps in rules if ps)
    return f"list_filter([{hits}], lambda x: x is not null)"


_BY_NAME = _multi("name", [(b, n) for b, n, _ in lx.SURVEYED_BANKS])
_BY_TEXT = _multi("text", [(b, t) for b, _, t in lx.SURVEYED_BANKS])


@query("bnk3_banks_in_name", fr.sql(fr.FILES, f"select doc_id, unnest({_BY_NAME}) bank from files"))
def banks_in_name(spark, folder):
    return dv.statement_files(spark, folder).select("doc_id", F.explode(bk.banks_in_name(F.col("name"))).alias("bank"))


@query("bnk3_banks_in_text", fr.sql(fr.FILES, f"select doc_id, unnest({_BY_TEXT}) bank from files"))
def banks_in_text(spark, folder):
    return dv.statement_files(spark, folder).select("doc_id", F.explode(bk.banks_in_text(F.col("text"))).alias("bank"))


@query("joi4_pattern_match_counts", fr.sql(fr.FILES, f", m as (select unnest({_BY_TEXT}) bank from files) select bank, count(*) files from m group by 1"))
def pattern_match_counts(spark, folder):
    return bk.bank_members(banks_in_text(spark, folder))


_BNK4 = fr.ordered_case("lower(text)", lx.HEADER_BANKS, (
    "coalesce(case when contains(lower(text), 'fdic') then (list_filter(list_transform(string_split(text, chr(10)), "
    "lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: length(s) > 3 and contains(lower(s), 'bank')))[1] end, 'Unknown')"))


@query("bnk4_bank_of_header", fr.sql(fr.FILES, f"select doc_id, {_BNK4} bank from files"))
def bank_of_header(spark, folder):
    return dv.statement_files(spark, folder).select("doc_id", bk.bank_of_header(F.col("text")).alias("bank"))


_SAMPLE = (", pdfs as (select * from files where ends_with(lower(name), '.pdf')), sampled as (select * from pdfs order by "
           "md5('42|' || name), name limit 200) ")


@query("bnk5_bank_coverage", fr.sql(fr.FILES, _SAMPLE.replace(" limit 200", "") + (
    f", a as (select bank, count(*) fn from (select unnest({_BY_NAME}) bank from pdfs) group by 1), "
    f"b as (select bank, count(*) txt from (select unnest({_BY_TEXT}) bank from sampled) group by 1), "
    "s as (select (select count(*) from pdfs) total, (select count(*) from sampled) n) "
    "select coalesce(a.bank, b.bank) bank, coalesce(fn, 0) filename_count, coalesce(txt, 0) text_count, coalesce(txt, 0) / n * 100 text_pct, "
    "greatest(coalesce(fn, 0), cast(floor(coalesce(txt, 0) / n * total) as bigint)) estimate from a full join b on a.bank = b.bank, s")))
def bank_coverage(spark, folder):
    pdfs = dv.statement_files(spark, folder).filter(F.lower("name").endswith(".pdf"))
    return bk.bank_coverage(pdfs)


@query("bnk6_unmatched_files", fr.sql(fr.FILES, _SAMPLE + (
    f"select name, replace(text, chr(10), ' | ') snippet, len({_BY_NAME}) > 0 in_name from pdfs where len({_BY_TEXT}) = 0")))
def unmatched_files(spark, folder):
    pdfs = dv.statement_files(spark, folder).filter(F.lower("name").endswith(".pdf"))
    return bk.unmatched_files(pdfs)


@query("win8_uniform_sample", fr.sql(fr.FILES, _SAMPLE + "select name from sampled"))
def uniform_sample(spark, folder):
    pdfs = dv.statement_files(spark, folder).filter(F.lower("name").endswith(".pdf"))
    return bk.survey_sample(pdfs).select("name")
