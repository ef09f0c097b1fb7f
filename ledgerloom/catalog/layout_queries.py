"""Layout, tagging, decoding and evaluation queries."""

from pyspark.sql import functions as F

from ledgerloom.catalog import frames as fr
from ledgerloom.catalog import sqlfn as sf
from ledgerloom.catalog.frames import any_of, arr, lit
from ledgerloom.catalog.registry import query
from ledgerloom.catalog.transaction_queries import _BYBAL, _PREV, _WORDS, parse_sql
from ledgerloom.functions import lexicon as lx
from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import layout as ly
from ledgerloom.operators import tagging as tg
from ledgerloom.operators import transactions as tx
from ledgerloom.sources import derive as dv

FIT = 64


def tokens(spark, folder):
    return dv.statement_tokens(spark, folder)


ROWED = """, tops as (select distinct stem, page_index, top from tokens),
anchors as (select stem, page_index, min(top) a from tops group by 1, 2
  union all select r.stem, r.page_index, min(t.top) from anchors r join tops t on t.stem = r.stem
    and t.page_index = r.page_index and t.top > r.a + 8 group by 1, 2),
ranked as (select *, row_number() over (partition by stem, page_index order by a) - 1 row_index,
  coalesce(lead(a) over (partition by stem, page_index order by a), 1e9) nxt from anchors),
rowed as (select t.*, r.row_index, row_number() over (partition by t.stem, t.page_index, r.row_index order by x0, top, pos) - 1 row_pos
  from tokens t join ranked r on t.stem = r.stem and t.page_index = r.page_index and t.top >= r.a and t.top < r.nxt) """


def rsql(body, frame=None):
    return "with recursive " + (frame or fr.TOKENS) + ROWED + body


@query("lay1_visual_rows", rsql("select stem, page_index, pos, row_index, row_pos from rowed"))
def visual_rows(spark, folder):
    return ly.visual_rows(tokens(spark, folder)).select("stem", "page_index", "pos", "row_index", "row_pos")


def _overlap(names):
    return f"(len(list_intersect(words, {arr(names)})) > 0)::int"


ROW_FLAGS = (", rw as (select stem, page_index, row_index, list(lower(text) order by row_pos) words from rowed group by 1, 2, 3), "
             f"flags as (select *, {any_of(chr(39) + chr(39) + ' || array_to_string(words, chr(32))', lx.ROW_MARKER_PHRASES)} or (len(words) <= 3 "
             f"and trim(words[1], '*') in ({', '.join(lit(w) for w in lx.ROW_MARKER_WORDS)})) is_marker, "
             + " + ".join(_overlap(n) for _, n in lx.HEADER_WORDS) + " >= 2 is_header from rw) ")


@query("lay2_section_markers", rsql(ROW_FLAGS + "select stem, page_index, row_index, array_to_string(words, ' ') row_text, is_marker from flags"))
def section_markers(spark, folder):
    return ly.row_table(ly.visual_rows(tokens(spark, folder))).select("stem", "page_index", "row_index", "row_text", "is_marker")


@query("lay3_header_rows", rsql(ROW_FLAGS + "select stem, page_index, row_index, is_header from flags where is_header"))
def header_rows(spark, folder):
    return ly.row_table(ly.visual_rows(tokens(spark, folder))).filter("is_header").select("stem", "page_index", "row_index", "is_header")


@query("set3_header_intersection", rsql(ROW_FLAGS + (
    f"select stem, page_index, row_index, array_to_string(list_sort(list_intersect(words, {arr(sorted({w for _, n in lx.HEADER_WORDS for w in n}))})), ' ') "
    "shared from flags where is_header")))
def header_intersection(spark, folder):
    names = F.array(*[F.lit(w) for w in sorted({w for _, n in lx.HEADER_WORDS for w in n})])
    rows = ly.row_table(ly.visual_rows(tokens(spark, folder))).filter("is_header")
    return rows.select("stem", "page_index", "row_index", F.array_join(F.array_sort(F.array_intersect(
        F.split("row_text", " "), names)), " ").alias("shared"))


_KIND = "case " + " ".join(f"when lower(text) in ({', '.join(lit(w) for w in names)}) then '{k}'" for k, names in lx.HEADER_WORDS) + " end"
COLUMNS = (", hdr as (select stem, page_index, min(row_index) row_index from flags where is_header group by 1, 2), "
           f"hw as (select stem, page_index, {_KIND} kind, x0, row_pos from rowed join hdr using (stem, page_index, row_index)), "
           "hx as (select stem, page_index, kind, arg_max(x0, row_pos) x from hw where kind is not null group by 1, 2, 3), "
           "cols as (select stem, page_index, " + ", ".join(
               f"coalesce(max(x) filter (kind = '{k}'), {d}) {k}_x" for k, d in lx.DEFAULT_COLUMNS.items())
           + " from (select distinct stem, page_index from rowed) left join hx using (stem, page_index) group by 1, 2) ")


@query("lay4_page_columns", rsql(ROW_FLAGS + COLUMNS + "select * from cols"))
def page_columns(spark, folder):
    return ly.page_columns(ly.with_row_flags(ly.visual_rows(tokens(spark, folder))))


_ISMON = f"rtrim(lower(text), '.') in ({', '.join(lit(w) for w in lx.MONTH_WORDS)})"


@query("lay5_token_shapes", fr.sql(fr.TOKENS, (
    f"select stem, page_index, pos, text, regexp_matches(text, '{lx.DATE_TOKEN}') is_date, {_ISMON} is_month, "
    f"regexp_matches(text, '{lx.AMOUNT_TOKEN}') is_amount from tokens")))
def token_shapes(spark, folder):
    return ly.token_shapes(tokens(spark, folder)).select("stem", "page_index", "pos", "text", "is_date", "is_month", "is_amount")


def _gram(n):
    return " || ' ' || ".join(["lower(text)"] + [f"lead(lower(text), {i}) over w" for i in range(1, n)])


_TRIM = (f", grams as (select *, {_gram(2)} g2, {_gram(3)} g3, {_gram(4)} g4 from tokens window w as (partition by stem, page_index order by pos)), "
         "tst0 as (select stem, page_index, " + ", ".join(
             f"coalesce(min(pos) filter (g{len(h.split())} = {lit(h)}), 0) s{i}" for i, h in enumerate(lx.TXN_START_HEADERS))
         + " from grams group by 1, 2), tst as (select stem, page_index, case when greatest(" + ", ".join(
             f"s{i}" for i in range(len(lx.TXN_START_HEADERS))) + ") < 20 then 0 else greatest(" + ", ".join(
             f"s{i}" for i in range(len(lx.TXN_START_HEADERS))) + ") end s from tst0), "
         "en as (select stem, page_index, min(pos) e from grams join tst using (stem, page_index) where pos >= s and ("
         + " or ".join(f"g{n} in ({', '.join(lit(h) for h in lx.TXN_END_HEADERS if len(h.split()) == n)})" for n in (2, 3, 4))
         + ") group by 1, 2), trimmed as (select t.* from tokens t join tst using (stem, page_index) left join en using (stem, page_index) "
         "where pos >= s and (e is null or pos < e)) ")


@query("lay6_trim_sections", fr.sql(fr.TOKENS, _TRIM + "select stem, page_index, pos, text from trimmed"))
def trim_sections(spark, folder):
    return ly.trim_sections(tokens(spark, folder)).select("stem", "page_index", "pos", "text")


@query("lay6_trimmed_counts", fr.sql(fr.TOKENS, _TRIM + (
    "select count(*) filter (pos < s) preamble, count(*) filter (pos >= s and (e is null or pos < e)) kept, "
    "count(*) filter (pos >= s and pos >= e) closing from tokens join tst using (stem, page_index) left join en using (stem, page_index)")))
def trimmed_counts(spark, folder):
    return ly.trimmed_counts(tokens(spark, folder))


def _phrase(p, kind):
    before = f"substr(txt, 1, instr(txt, {lit(p)}) - 1)"
    return (f"case when contains(txt, {lit(p)}) then [{{'pos': length({before}) - length(replace({before}, ' ', '')), 'type': '{kind}'}}] "
            "else [] end")


_HEADW = ", ".join(lit(w) for w in lx.DEBIT_HEADINGS + lx.CREDIT_HEADINGS)
SECTIONS = (", pw as (select stem, page_index, list(lower(text) order by pos) words from tokens group by 1, 2), "
            "pt as (select *, array_to_string(words, ' ') txt from pw), ph as (select *, "
            + " || ".join([_phrase(p, "debit") for p in lx.DEBIT_PHRASES] + [_phrase(p, "credit") for p in lx.CREDIT_PHRASES])
            + f" phrases, list_transform(list_filter(list_transform(words, lambda t, i: {{'pos': i - 1, 'type': case when t in ({', '.join(lit(w) for w in lx.DEBIT_HEADINGS)}) "
              f"then 'debit' when t in ({_HEADW}) then 'credit' end}}), lambda s: s.type is not null), lambda s: [s]) singles from pt), "
              "acc as (select *, case when len(singles) = 0 then phrases else list_reduce(singles, lambda a, x: case when len(list_filter(a, "
              "lambda s: abs(s.pos - x[1].pos) < 5)) > 0 then a else a || x end, phrases) end found from ph), "
              "sections as (select stem, page_index, words, list_transform(list_sort(list_transform(found, lambda s, i: {'pos': s.pos, 'i': i, "
              "'type': s.type})), lambda s: {'pos': s.pos, 'type': s.type}) sections from acc) ")


@query("lay7_page_sections", fr.sql(fr.TOKENS, SECTIONS + ", s as (select stem, page_index, unnest(sections) s from sections) select stem, page_index, s.pos pos, s.type as type from s"))
def page_sections(spark, folder):
    return (ly.page_sections(tokens(spark, folder)).select("stem", "page_index", F.explode("sections").alias("s"))
            .select("stem", "page_index", "s.pos", "s.type"))


def section_sql(src):
    fw = "string_split_regex(ltrim(lower(description)), '\\s+')[1]"
    return (f", sx as (select x.*, s.words, s.sections, list_distinct(list_transform(s.sections, lambda q: q.type)) kinds, coalesce("
            f"list_position(words, lower(date)), case when {fw} <> '' then list_position(words, {fw}) end) - 1 loc from {src} x "
            "left join sections s on s.stem = x.stem and s.page_index = x.page), sectioned as (select * exclude (words, sections, kinds, loc), case when len(kinds) = 1 then kinds[1] "
            "else (list_filter(sections, lambda q: q.pos < loc))[-1].type end section_type from sx) ")


@query("lay8_section_of_txn", fr.sql(fr.TOKENS, SECTIONS + section_sql("txn") + "select k, section_type from sectioned"))
def section_of_txn(spark, folder):
    txns = dv.statement_txns(spark, folder)
    return ly.section_of(txns, ly.page_sections(tokens(spark, folder))).select("k", "section_type")


@query("joi5_asof_heading", fr.sql(fr.TOKENS, SECTIONS + (
    ", h as (select stem, page_index, unnest(sections) s from sections) select x.k, max(s.pos) heading_pos, arg_max(s.type, s.pos) heading from "
    "(select k, stem, page_index, min(pos) loc from tokens where true_tag = 'B-DATE' group by 1, 2, 3) x join h on h.stem = x.stem and "
    "h.page_index = x.page_index and s.pos < loc group by 1")))
def asof_heading(spark, folder):
    words = tokens(spark, folder)
    dates = words.filter(F.col("true_tag") == "B-DATE").groupBy("k", "stem", "page_index").agg(F.min("pos").alias("at"))
    before = F.filter("sections", lambda s: s["pos"] < F.col("at"))
    joined = dates.join(ly.page_sections(words), ["stem", "page_index"]).withColumn("_last", F.get(F.reverse(before), F.lit(0)))
    return joined.filter(F.col("_last").isNotNull()).select("k", F.col("_last.pos").alias("heading_pos"), F.col("_last.type").alias("heading"))


@query("txn7_type_by_section", fr.sql(fr.TOKENS, SECTIONS + section_sql("txn") + (
    "select k, case when type <> 'unknown' then type else coalesce(section_type, 'unknown') end as type from sectioned")))
def type_by_section(spark, folder):
    located = ly.section_of(dv.statement_txns(spark, folder), ly.page_sections(tokens(spark, folder)))
    return located.select("k", F.coalesce(F.nullif(F.col("type"), F.lit("unknown")), "section_type", F.lit("unknown")).alias("type"))


@query("txn10_hybrid_typing", fr.sql(fr.TOKENS, SECTIONS + section_sql("txn") + _PREV.format(src="sectioned") + (
    f"select k, case when type <> 'unknown' then type else coalesce({_BYBAL}, section_type, {_WORDS}) end as type from prev")))
def hybrid_typing(spark, folder):
    txns = dv.statement_txns(spark, folder)
    sections = ly.section_of(txns, ly.page_sections(tokens(spark, folder)))
    return tx.infer_types(sections).select("k", "type")


_ISDAY = "regexp_matches({0}, '^\\d{{1,2}},?$')"
TAGGED = ROW_FLAGS + COLUMNS + f""", sh as (select r.*, f.is_marker or f.is_header skip, regexp_matches(text, '{lx.DATE_TOKEN}') isd, {_ISMON} ism,
   regexp_matches(text, '{lx.AMOUNT_TOKEN}') isa, lead(text, 1) over rr nx, lead(text, 2) over rr nn from rowed r join flags f using (stem, page_index, row_index)
   window rr as (partition by r.stem, r.page_index, r.row_index order by row_pos)),
dt as (select *, isd or (ism and coalesce({_ISDAY.format('nx')}, false)) dated from sh),
rs as (select stem, page_index, row_index, bool_or(skip) skip, min(row_pos) filter (dated) dpos,
   arg_min(case when not ism then row_pos when coalesce(regexp_matches(nn, '^\\d{{2,4}}$'), false) then row_pos + 2 else row_pos + 1 end, row_pos) filter (dated) dend,
   min(row_pos) filter (isa) a0, max(row_pos) filter (isa) a1, count(*) filter (isa) na, arg_min(x0, row_pos) x_first from dt group by 1, 2, 3),
rt as (select *, not skip and dpos is not null and na > 0 txn from rs),
tg0 as (select d.*, rt.txn, case when not rt.txn then 'O' when isa and na >= 2 and row_pos = a1 then 'B-BALANCE' when isa then 'B-AMOUNT'
   when row_pos = dpos then 'B-DATE' when row_pos > dpos and row_pos <= dend then 'I-DATE'
   when row_pos = dend + 1 and row_pos < a0 then 'B-DESC' when row_pos > dend and row_pos < a0 then 'I-DESC' else 'O' end tag0
   from dt d join rt using (stem, page_index, row_index)),
dx as (select stem, page_index, row_index, max(x0) filter (tag0 = 'B-DESC') dx from tg0 group by 1, 2, 3),
ro as (select rt.*, coalesce(last_value(dx ignore nulls) over (partition by stem, page_index order by row_index rows between unbounded preceding and 1 preceding),
   description_x) lastx, date_x, count(*) filter (txn) over (partition by stem, page_index order by row_index) own
   from rt join dx using (stem, page_index, row_index) join cols using (stem, page_index)),
rf as (select *, count(*) filter (not txn and not (not skip and dpos is null and na = 0 and abs(x_first - lastx) < 80 and x_first > date_x + 30))
   over (partition by stem, page_index, own order by row_index) brk from ro),
tagged as (select t.stem, t.page_index, t.pos, t.text, t.k, t.true_tag, t.pred_tag, t.conf,
   case when not t.txn and brk = 0 then 'I-DESC' else tag0 end tag from tg0 t join rf using (stem, page_index, row_index)) """


def tagged(spark, folder):
    return tg.rule_tags(tokens(spark, folder))


@query("tag1_rule_tags", rsql(TAGGED + "select stem, page_index, pos, tag from tagged"))
def rule_tags(spark, folder):
    return tagged(spark, folder).select("stem", "page_index", "pos", "tag")


@query("tag2_continuation_tokens", rsql(TAGGED + ", w as (select *, sum((tag = 'B-DATE')::int) over (partition by stem, page_index order by pos) n from tagged) "
                                        "select stem, page_index, n, count(*) desc_tokens from w where tag = 'I-DESC' group by 1, 2, 3"))
def continuation_tokens(spark, folder):
    from pyspark.sql import Window
    n = F.sum((F.col("tag") == "B-DATE").cast("int")).over(Window.partitionBy("stem", "page_index").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0))
    return (tagged(spark, folder).withColumn("n", n).filter(F.col("tag") == "I-DESC").groupBy("stem", "page_index", "n")
            .agg(F.count(F.lit(1)).alias("desc_tokens")))


@query("tag3_rule_quality", rsql(TAGGED + (
    ", c as (select stem, page_index, count(*) filter (tag = 'B-DATE') d, count(*) filter (tag = 'B-AMOUNT') a, count(*) filter (tag = 'B-DESC') s "
    "from tagged group by 1, 2), q as (select *, least(d, a, s) m from c) select stem, page_index, d n_dates, m n_complete, case when d = 0 then 0.0::double "
    f"when d = m then 75.0 else ({sf.half_even('m * 750', 'd')}) / 10.0 end alignment_rate from q")))
def rule_quality(spark, folder):
    return tg.rule_quality(tagged(spark, folder))


@query("tag4_tag_histogram", fr.sql(fr.TOKENS, "select true_tag tag, count(*) n from tokens group by 1"))
def tag_histogram(spark, folder):
    return tg.tag_histogram(tokens(spark, folder).withColumn("tag", F.col("true_tag")))


@query("tag4_page_tag_counts", fr.sql(fr.TOKENS, (
    "select stem, page_index, string_agg(t || '=' || n, ',' order by t) counts from (select stem, page_index, true_tag t, count(*) n from tokens group by 1, 2, 3) group by 1, 2")))
def page_tag_counts(spark, folder):
    maps = tg.tag_maps(tokens(spark, folder).withColumn("tag", F.col("true_tag")))
    entry = F.transform(F.map_entries("tag_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("stem", "page_index", F.array_join(entry, ",").alias("counts"))


_DEC = """, seg0 as (select *, min(pos) filter (starts_with(tag, 'B-')) over p fb, min(pos) filter (tag = 'B-DATE') over p fbd,
   sum((tag = 'B-DATE')::int) over (partition by stem, page_index order by pos) n from src window p as (partition by stem, page_index)),
seg1 as (select *, bool_or(tag = 'I-DATE' and pos > fb and (fbd is null or pos < fbd)) over (partition by stem, page_index) promo from seg0),
seg as (select *, case when coalesce(promo, false) then n else greatest(n, 1) end sg, lower(substr(tag, 3)) f from seg1 where tag <> 'O'),
st as (select *, coalesce(max(pos) filter (starts_with(tag, 'B-')) over q, min(pos) filter (pos >= fb) over q) s0 from seg window q as (partition by stem, page_index, sg, f)),
tk as (select *, lag(text) over (partition by stem, page_index, sg, f order by pos) pv from st where pos >= fb and pos >= s0),
cf as (select stem, page_index, sg, sum(round(conf * 100)::bigint) cs, count(*) cn from seg group by 1, 2, 3),
tx as (select stem, page_index, sg,
   string_agg(case when pv is null then '' when right(pv, 1) in ('/', '-') or text in ('/', '-', ',') then '' else ' ' end || text, '' order by pos) filter (f = 'date') date_text,
   string_agg(text, ' ' order by pos) filter (f = 'desc') desc_text, string_agg(text, '' order by pos) filter (f = 'amount') amount_text,
   string_agg(text, '' order by pos) filter (f = 'balance') balance_text from tk group by 1, 2, 3),
decoded as (select *, page_index as page, page_index * 4294967296 + sg seq from tx join cf using (stem, page_index, sg) where date_text is not null) """
_CONF = f"({sf.half_even('cast(cs * 100 as bigint)', 'cn')}) / 10000.0"
DECODED = ", src as (select *, pred_tag tag from tokens)" + _DEC


def predicted(spark, folder):
    return tokens(spark, folder).withColumn("tag", F.col("pred_tag"))


@query("tag5_decode", fr.sql(fr.TOKENS, DECODED + f"select stem, page, seq, date_text, desc_text, amount_text, balance_text, {_CONF} conf from decoded"))
def decode(spark, folder):
    return tg.decode(predicted(spark, folder)).withColumn("conf", F.bround("mean_conf", 4).cast("double")).drop("mean_conf")


STRICT = """, sg0 as (select *, pred_tag tag, greatest(sum((pred_tag = 'B-DATE')::int) over (partition by stem, page_index order by pos), 1) sg from tokens),
sg1 as (select *, lower(substr(tag, 3)) f from sg0 where tag <> 'O'),
sg2 as (select *, max(pos) filter (starts_with(tag, 'B-')) over (partition by stem, page_index, sg, f) s0 from sg1),
strict as (select stem, page_index as page, page_index * 4294967296 + sg seq, """ + ", ".join(
    f"string_agg(text, ' ' order by pos) filter (f = '{f}') {f}_text" for f in tg.FIELDS) + """ from sg2 where pos >= s0 group by 1, 2, 3
  having date_text is not null) """


@query("tag6_decode_strict", fr.sql(fr.TOKENS, STRICT + "select * from strict"))
def decode_strict(spark, folder):
    return tg.decode_strict(predicted(spark, folder))


_SIZE = max(FIT - 1 - 10, 50)
_STEP, _ORIG = _SIZE - 20, FIT - 20
_CHUNKS = ("; sz as (select *, count(*) over (partition by stem, page_index) n, row_number() over (partition by stem, page_index order by pos) - 1 pl from {src}), "
           f"ck as (select *, 0 chunk from sz where pl < {FIT} union all select * exclude (j), j + 1 from (select *, unnest(range(n)) j from sz where n > {FIT}) where "
           f"pl >= {_ORIG} + j * {_STEP} and pl < {_ORIG} + j * {_STEP} + {_SIZE} and (j = 0 or {_ORIG} + (j - 1) * {_STEP} + {_SIZE} < n)) ").replace(";", ",", 1)
CHUNKS = _CHUNKS.replace("{src}", "tokens")


@query("tag7_split_chunks", fr.sql(fr.TOKENS, CHUNKS + "select stem, page_index, pos, chunk from ck"))
def split_chunks(spark, folder):
    return tg.split_chunks(tokens(spark, folder), FIT).select("stem", "page_index", "pos", "chunk")


@query("tag8_merge_chunks", fr.sql(fr.TOKENS, CHUNKS + (
    ", pr as (select stem, page_index, pos, chunk, case when chunk % 2 = 0 then pred_tag else true_tag end tag, ((pos * 7 + chunk * 13) % 10) / 10.0 conf from ck), "
    "b as (select *, row_number() over (partition by stem, page_index, pos order by conf desc, chunk) rn from pr) "
    "select stem, page_index, pos, case when conf <= 0 and chunk > 0 then 'O' else tag end tag, conf from b where rn = 1")))
def merge_chunks(spark, folder):
    chunks = tg.split_chunks(tokens(spark, folder), FIT)
    predictions = chunks.select("stem", "page_index", "pos", "chunk",
                                F.when(F.col("chunk") % 2 == 0, F.col("pred_tag")).otherwise(F.col("true_tag")).alias("tag"),
                                ((F.col("pos") * 7 + F.col("chunk") * 13) % 10 / 10.0).alias("conf"))
    return tg.merge_chunks(predictions)


@query("flow_trimmed_chunks", fr.sql(fr.TOKENS, _TRIM + _CHUNKS.replace("{src}", "trimmed") + (
    ", pr as (select stem, page_index, pos, chunk, case when chunk % 2 = 0 then pred_tag else true_tag end tag, ((pos * 7 + chunk * 13) % 10) / 10.0 conf from ck), "
    "b as (select *, row_number() over (partition by stem, page_index, pos order by conf desc, chunk) rn from pr) "
    "select stem, page_index, pos, case when conf <= 0 and chunk > 0 then 'O' else tag end tag, conf from b where rn = 1")))
def trimmed_chunks(spark, folder):
    """Trim pages, cut them into chunks, merge the chunks' predictions: every trimmed token keeps one tag."""
    chunks = tg.split_chunks(ly.trim_sections(tokens(spark, folder)), FIT)
    return tg.merge_chunks(chunks.select(
        "stem", "page_index", "pos", "chunk", F.when(F.col("chunk") % 2 == 0, F.col("pred_tag")).otherwise(F.col("true_tag")).alias("tag"),
        ((F.col("pos") * 7 + F.col("chunk") * 13) % 10 / 10.0).alias("conf")))


@query("tag9_page_confidence", fr.sql(fr.TOKENS, (
    ", c as (select stem, page_index, sum(round(conf * 100)::bigint) filter (pred_tag <> 'O') s, count(*) filter (pred_tag <> 'O') n from tokens group by 1, 2) "
    "select stem, page_index, round(case when n = 0 then 1.0 else s / n / 100.0 end, 9) page_conf, case when n = 0 then false else s < 70 * n end is_low from c")))
def page_confidence(spark, folder):
    return tg.page_confidence(predicted(spark, folder)).withColumn("page_conf", F.round("page_conf", 9))


@query("agg16_class_weights", fr.sql(fr.TOKENS, (
    f", h as (select pred_tag tag, count(*) n from tokens group by 1), d as (select unnest({arr(lx.BIO_TAGS)}) tag), t as (select cast(sum(n) as bigint) t from h) "
    "select d.tag, coalesce(least(t / (9 * n), 10.0), 1.0) weight from d left join h using (tag), t")))
def class_weights(spark, folder):
    return tg.class_weights(spark, tg.tag_histogram(predicted(spark, folder)))


@query("evl5_alignment_rate", rsql(TAGGED + (
    ", p as (select stem, page_index, least(count(*) filter (tag = 'B-DATE'), count(*) filter (tag = 'B-AMOUNT')) aligned from tagged group by 1, 2), "
    "c as (select stem, page page_index, count(*) n from txn group by 1, 2) select stem, page_index, aligned, coalesce(n, 0) total, case when n > 0 then "
    f"({sf.half_even('aligned * 1000', 'n')}) / 10.0 else 100.0 end alignment_rate from p left join c using (stem, page_index)")))
def alignment_rate(spark, folder):
    counts = dv.statement_txns(spark, folder).groupBy("stem", F.col("page").alias("page_index")).agg(F.count(F.lit(1)).alias("n_txns"))
    return tg.alignment_rate(tagged(spark, folder), counts)


def _spans(tag, name):
    return (f", {name}0 as (select stem, page_index, pos, case when {tag} <> 'O' then substr({tag}, 3) end kd, starts_with({tag}, 'B-') b from tokens), "
            f"{name}1 as (select *, sum((kd is not null and (b or kd is distinct from pk))::int) over (partition by stem, page_index order by pos) sp from "
            f"(select *, lag(kd) over (partition by stem, page_index order by pos) pk from {name}0)), "
            f"{name} as (select stem, page_index, kd as type, min(pos) as start, max(pos) as \"end\" from {name}1 where kd is not null group by stem, page_index, sp, kd) ")


@query("evl1_entity_spans", fr.sql(fr.TOKENS, _spans("pred_tag", "sp") + "select * from sp"))
def entity_spans(spark, folder):
    return ev.entity_spans(tokens(spark, folder), "pred_tag")


_REPORT = (_spans("true_tag", "ts") + _spans("pred_tag", "ps") + (
    ", j as (select coalesce(t.type, p.type) as type, (t.type is not null)::int t, (p.type is not null)::int p from ts t full join ps p on t.stem = p.stem and "
    "t.page_index = p.page_index and t.type = p.type and t.start = p.start and t.\"end\" = p.\"end\"), "
    "g as (select type, cast(sum(t * p) as bigint) tp, cast(sum(p) as bigint) pred, cast(sum(t) as bigint) support from j group by 1), "
    "u as (select * from g union all select 'micro avg', cast(sum(tp) as bigint), cast(sum(pred) as bigint), cast(sum(support) as bigint) from g), "
    "m as (select *, case when pred > 0 then tp / pred else 0.0 end \"precision\", case when support > 0 then tp / support else 0.0 end recall from u), "
    "f as (select *, case when tp > 0 then 2 * \"precision\" * recall / (\"precision\" + recall) else 0.0 end f1 from m), "
    "report as (select type, \"precision\", recall, f1, support from f union all select 'macro avg', avg(\"precision\"), avg(recall), avg(f1), cast(sum(support) as bigint) from f where type <> 'micro avg' "
    "union all select 'weighted avg', sum(\"precision\" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) as bigint) "
    "from f where type <> 'micro avg') "))


def _report(spark, folder):
    return ev.entity_report(tokens(spark, folder), "true_tag", "pred_tag")


@query("evl2_entity_report", fr.sql(fr.TOKENS, _REPORT + "select type, round(\"precision\", 9) \"precision\", round(recall, 9) recall, round(f1, 9) f1, support from report"))
def entity_report(spark, folder):
    return _report(spark, folder).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_MATCH = STRICT + (
    f", pr as (select stem, page, row_number() over (partition by stem, page order by seq) i, lower(date_text) d, abs({parse_sql('coalesce(amount_text, chr(48))')}) a from strict), "
    "tr as (select stem, page, seq, lower(date) d, cents / 100.0 a from txn), "
    "cd as (select tr.stem, tr.page, tr.seq, list(pr.i order by pr.i) filter (pr.i is not null and (contains(pr.d, tr.d) or contains(tr.d, pr.d)) and abs(pr.a - tr.a) <= 0.01) c "
    "from tr left join pr on pr.stem = tr.stem and pr.page = tr.page group by 1, 2, 3), "
    "gr as (select stem, page, count(*) t, list_reduce(list(coalesce(c, []) order by seq), lambda used, x: used || (list_filter(x, lambda i: not list_contains(used, i)))[1:1], []::bigint[]) used "
    "from cd group by 1, 2), matches as (select g.stem, g.page, len(used) tp, coalesce(n, 0) - len(used) fp, t - len(used) fn from gr g left join (select stem, page, count(*) n from pr "
    "group by 1, 2) using (stem, page)) ")


def _matches(spark, folder):
    return ev.match_counts(tg.decode_strict(predicted(spark, folder)), dv.statement_txns(spark, folder))


@query("joi7_match_counts", fr.sql(fr.TOKENS, _MATCH + "select stem, page, tp, fp, fn from matches"))
def match_counts(spark, folder):
    return _matches(spark, folder)


_SCORES = (", sm as (select cast(sum(tp) as bigint) tp, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn from matches), "
           "sc as (select *, tp / (tp + fp) p, tp / (tp + fn) r from sm), scores as (select tp, fp, fn, round(p, 4) \"precision\", round(r, 4) recall, round(2 * p * r / (p + r), 4) f1 from sc) ")


@query("evl3_transaction_scores", fr.sql(fr.TOKENS, _MATCH + _SCORES + "select * from scores"))
def transaction_scores(spark, folder):
    return ev.transaction_scores(_matches(spark, folder))


@query("evl4_target_report", fr.sql(fr.TOKENS, _REPORT + _MATCH + _SCORES + (
    ", v as (select 'entity_f1' metric, f1 as val, 0.9 target from report where type = 'micro avg' union all select 'txn_precision', \"precision\", 0.95 from scores "
    "union all select 'txn_recall', recall, 0.9 from scores) select metric, round(val, 9) as val, cast(target as double) target, case when val > target then 'PASS' else 'BELOW TARGET' end status from v")))
def target_report(spark, folder):
    report = ev.target_report(_report(spark, folder), transaction_scores(spark, folder))
    return report.select("metric", F.round("value", 9).alias("val"), "target", "status")
