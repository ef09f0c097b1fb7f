"""Page tokens, uploads, manifests and first-write-wins sinks (SRC4-SRC16, SNK3, SNK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.text import path_name, safe_name
from ledgerloom.operators.filters import is_statement_name

UPLOAD_FIELDS = ("control_fileupload", "control_widget")
_HREF = r"""(?i)href=["']?(https?://[^"'>\s]+\.pdf)"""


def fingerprint(content: Column) -> Column:
    """Statement identity: the SHA-256 of the whole content (SRC4)."""
    return F.sha2(content.cast("binary"), 256)


def short_fingerprint(identity: Column) -> Column:
    """Twelve digits of an identity for display; never a key."""
    return F.substring(identity, 1, 12)


def scale_coordinate(value: Column, size: Column) -> Column:
    """Page coordinate on the 0-1000 scale, truncated (SRC5)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), value / size * 1000)).cast("int")


def normalise_boxes(tokens: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``x0, y0, x1, y1`` in page units to 0-1000 integers (SRC5)."""
    return tokens.withColumns({c: scale_coordinate(F.col(c), F.col(size))
                               for c, size in (("x0", width), ("y0", height), ("x1", width), ("y1", height))})


def clean_tokens(tokens: DataFrame, ocr: bool) -> DataFrame:
    """Trim, drop blanks and, for OCR tokens, anything below the confidence floor (SRC6)."""
    kept = tokens.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    kept = kept.filter(F.col("text") != "")
    return kept.filter(F.col("ocr_conf").cast("int") >= lx.MIN_OCR_CONFIDENCE) if ocr else kept


def choose_words(native: DataFrame, ocr: DataFrame, min_native: int = lx.MIN_NATIVE_WORDS) -> DataFrame:
    """Per page the native tokens, or OCR tokens when there are under ``min_native`` and OCR has more (SRC7)."""
    both = native.withColumn("used_ocr", F.lit(False)).unionByName(
        ocr.withColumn("used_ocr", F.lit(True)), allowMissingColumns=True)
    page = Window.partitionBy("stem", "page_index")
    n_native = F.count_if(~F.col("used_ocr")).over(page)
    n_ocr = F.count_if(F.col("used_ocr")).over(page)
    wants_ocr = (n_native < min_native) & (n_ocr > n_native)
    return both.withColumn("_ocr", wants_ocr).filter(F.col("used_ocr") == F.col("_ocr")).drop("_ocr")


def word_choices(native: DataFrame, ocr: DataFrame, min_native: int = lx.MIN_NATIVE_WORDS) -> DataFrame:
    """Pages, those read by OCR, and the tokens of either source that ``choose_words`` leaves out (SRC7)."""
    page = ["stem", "page_index"]
    both = native.select(*page, F.lit(1).alias("n"), F.lit(0).alias("o")).unionByName(ocr.select(*page, F.lit(0).alias("n"), F.lit(1).alias("o")))
    sizes = both.groupBy(*page).agg(F.sum("n").alias("n"), F.sum("o").alias("o"))
    by_ocr = (F.col("n") < min_native) & (F.col("o") > F.col("n"))
    total = lambda test, value: F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0))
    return sizes.agg(F.count(F.lit(1)).alias("pages"), F.count_if(by_ocr).alias("ocr_pages"),
                     total(by_ocr, "n").alias("native_left_out"), total(~by_ocr, "o").alias("ocr_left_out"))


def extraction_stats(pages: DataFrame) -> DataFrame:
    """Pages, words and OCR pages per statement plus a grand total with a null stem (SRC8)."""
    return pages.rollup("stem").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("word_count").alias("words_total"),
        F.count_if("used_ocr").alias("ocr_pages"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work that has no result yet; ``force`` redoes everything (SRC9, SET4, JOI3)."""
    return todo if force else todo.join(done.select(*keys), keys, "left_anti")


def submission_urls(submissions: DataFrame) -> DataFrame:
    """PDF URLs of form answers, each once per submission (SRC10)."""
    is_pdf = lambda u: F.lower(u).endswith(".pdf")

    def field_urls(entry: Column) -> Column:
        value = entry["value"]
        answer = F.coalesce(value["answer"], F.lit(""))
        pretty = F.coalesce(value["pretty_format"], F.lit(""))
        is_list = answer.startswith("[")
        listed = F.coalesce(F.from_json(F.when(is_list, answer), "array<string>"), F.array().cast("array<string>"))
        upload = F.when(value["type"].isin(*UPLOAD_FIELDS),
                        F.filter(F.when(is_list, listed).otherwise(F.array(answer)), is_pdf))
        links = F.when(F.lower(pretty).contains(".pdf"), F.regexp_extract_all(pretty, F.lit(_HREF), 1))
        plain = F.when(~is_list & answer.startswith("http") & F.lower(answer).contains(".pdf"), F.array(answer))
        none = F.array().cast("array<string>")
        return F.concat(F.coalesce(upload, none), F.coalesce(links, none), F.coalesce(plain, none))

    urls = F.array_distinct(F.flatten(F.transform(F.map_entries("answers"), field_urls)))
    keep = [c for c in submissions.columns if c != "answers"]
    return submissions.select(*keep, F.explode(urls).alias("url"))


def application_uploads(applications: DataFrame, manifest: DataFrame) -> DataFrame:
    """Uploaded statements of application payloads that are not in the manifest (SRC11)."""
    rows = applications.select("id", F.posexplode("payload.uploaded_statements").alias("idx", "u"))
    rows = rows.select("id", "idx", F.col("u.filename").alias("filename"), F.col("u.storage_path").alias("storage_path"))
    wanted = (F.coalesce("storage_path", F.lit("")) != "") & F.lower(F.coalesce("filename", F.lit(""))).endswith(".pdf")
    rows = rows.filter(wanted).withColumn("manifest_key", F.concat_ws("_", F.lit("app"), "id", "idx"))
    rows = rows.withColumn("safe_name", safe_name(F.concat_ws("_", F.lit("app"), F.col("id"), F.col("filename"))))
    return not_done(rows, manifest, ["manifest_key"])


def deal_uploads(documents: DataFrame, manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """PDF deal documents that are not in the manifest, by id (SRC12)."""
    pdf = (F.lower(F.coalesce("content_type", F.lit(""))).contains("pdf")
           | F.lower(F.coalesce("file_name", F.lit(""))).endswith(".pdf"))
    rows = documents.filter(pdf).withColumn("manifest_key", F.concat_ws("_", F.lit("deal"), "id"))
    rows = rows.withColumn("safe_name", safe_name(F.concat_ws("_", F.lit("deal"), F.col("deal_id"), F.col("file_name"))))
    rows = not_done(rows, manifest, ["manifest_key"])
    return rows.orderBy("id").limit(limit) if limit else rows


def submission_name(url: Column, submission: Column) -> Column:
    return F.concat(F.lit("jf_"), submission.cast("string"), F.lit("_"), safe_name(path_name(url)))


def bank_prefixed_name(bank: Column, name: Column) -> Column:
    """File name for a second file of the same name (SRC13)."""
    return F.concat(F.regexp_replace(bank, r"[^\p{L}\p{N}_]", "_"), F.lit("_"), name)


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Files per source and in total (null source) (SRC14)."""
    return manifest.rollup("source").agg(F.count(F.lit(1)).alias("files"))


def acquisition_funnel(urls: DataFrame, existing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Found, filtered, already held, downloaded and failed URLs per form and in total (SRC15).

    ``urls``: ``form, id, url, ord``; ``existing``: ``filename``; ``outcomes``: ``filename, ok``. Only the
    first good copy of a name is a download, later ones were already held by then.
    """
    named = urls.withColumn("is_statement", is_statement_name(F.col("url"))).withColumn(
        "filename", submission_name(F.col("url"), F.col("id")))
    per_file = named.groupBy("form", "filename", "is_statement").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    joined = (per_file.join(existing.select("filename", F.lit(True).alias("held")), "filename", "left")
              .join(outcomes.select("filename", "ok"), "filename", "left"))
    # One row per form and file name here, so a name's window holds at most one row per form.
    first = F.min("first").over(Window.partitionBy("filename", "is_statement"))
    state = joined.withColumn("_new", F.col("is_statement") & F.col("held").isNull()).withColumn(
        "_good", F.col("_new") & F.coalesce("ok", F.lit(False))).withColumn("_lead", F.col("first") == first)
    n, zero = F.col("n"), F.lit(0)
    got = F.when(F.col("_good") & F.col("_lead"), 1).otherwise(zero)
    counted = state.select(
        "form", n.alias("found"), F.when(~F.col("is_statement"), n).otherwise(zero).alias("filtered"),
        F.when(F.col("is_statement") & F.col("held").isNotNull(), n)
        .when(F.col("_good"), n - got).otherwise(zero).alias("already_had"),
        got.alias("downloaded"), F.when(F.col("_new") & ~F.col("_good"), n).otherwise(zero).alias("failed"))
    return counted.rollup("form").agg(*[F.sum(c).alias(c) for c in
                                        ("found", "filtered", "already_had", "downloaded", "failed")])


def pdf_files(files: DataFrame) -> DataFrame:
    """Files whose content starts with the PDF marker (SRC16)."""
    return files.filter(F.substring("content", 1, 4) == F.to_binary(F.lit("%PDF"), F.lit("utf-8")))


def first_writes(rows: DataFrame, key: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Earliest row per key that the target does not hold yet (SNK3).

    A min_by aggregate keeps one row per key and task before the shuffle, so a key repeated
    any number of times stays cheap.
    """
    fresh = rows if existing is None else not_done(rows, existing, [key])
    rest = [c for c in rows.columns if c != key]
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def auto_labels(pages: DataFrame, existing: DataFrame, shadow: bool = False) -> DataFrame:
    """Fallback results as label pages of new ``auto_`` statements (SNK4).

    ``pages``: ``pdf_hash, page_index, transactions``; statements already saved are left alone.
    """
    prefix = "auto_shadow_" if shadow else "auto_"
    rows = pages.withColumn("stem", F.concat(F.lit(prefix), "pdf_hash")).withColumn(
        "has_transactions", F.size("transactions") > 0).withColumn(
        "source_image", F.concat(F.lit("page_"), "page_index", F.lit(".png")))
    return not_done(rows, existing, ["stem"])
