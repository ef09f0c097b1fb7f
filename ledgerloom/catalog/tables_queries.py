"""The derived tables themselves, as queries."""

from pyspark.sql import functions as F

from ledgerloom.catalog import frames as fr
from ledgerloom.catalog.registry import query
from ledgerloom.sources import derive as dv


@query("base_statement_txns", fr.sql(fr.TXN, "select k, account, stem, seq, page, date, description, cents, type, "
                                     "true_type, balance_cents, confidence, source_file from txn"))
def statement_txns(spark, folder):
    return dv.statement_txns(spark, folder).select(
        "k", "account", "stem", "seq", "page", "date", "description", "cents", "type", "true_type", "balance_cents",
        "confidence", "source_file")


@query("base_statement_tokens", fr.sql(fr.TOKENS, "select stem, page_index, pos, text, x0, y0, x1, y1, top, bottom, "
                                       "true_tag, pred_tag, conf from tokens"))
def statement_tokens(spark, folder):
    return dv.statement_tokens(spark, folder).select(
        "stem", "page_index", "pos", "text", "x0", "y0", "x1", "y1", "top", "bottom", "true_tag", "pred_tag", "conf")


@query("base_statement_files", fr.sql(fr.FILES, "select doc_id, path, name, stem, size, pages, md5(text) as text from files"))
def statement_files(spark, folder):
    return dv.statement_files(spark, folder).withColumn("text", F.md5("text"))


@query("base_page_texts", fr.sql(fr.PAGE_TEXTS, "select stem, doc_id, md5(first_page) first_page, md5(last_page) "
                                 "last_page from page_texts"))
def page_texts(spark, folder):
    return (dv.page_texts(spark, folder).withColumn("first_page", F.md5("first_page"))
            .withColumn("last_page", F.md5("last_page")))


@query("base_training_pages", fr.sql(fr.TRAINING, "select * from training"))
def training_pages(spark, folder):
    return dv.training_pages(spark, folder)


@query("base_responses", fr.sql(fr.RESPONSES, "select * from responses"))
def responses(spark, folder):
    return dv.responses(spark, folder)
