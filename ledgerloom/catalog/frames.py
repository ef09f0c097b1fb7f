"""DuckDB statements of the derived tables, written independently of the Spark code."""

from __future__ import annotations

from ledgerloom.functions import lexicon as lx
from ledgerloom.sources import derive as dv


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


def at(values, index: str) -> str:
    return f"({arr(values)})[cast({index} as int) + 1]"


def any_of(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def ordered_case(expr: str, rules, default: str, flags: str = "") -> str:
    whens = " ".join(f"when regexp_matches({expr}, {lit(flags + p)}) then {lit(label)}" for p, label in rules)
    return f"case {whens} else {default} end"


_NAME = f"({arr(lx.MONTHS)})[month(o_orderdate)]"
_Y = "cast(2020 + year(o_orderdate) % 10 as varchar)"
_M, _D = "cast(month(o_orderdate) as varchar)", "cast(day(o_orderdate) as varchar)"
_MM, _DD = f"lpad({_M}, 2, '0')", f"lpad({_D}, 2, '0')"


def grouped(cents: str) -> str:
    return f"format('{{:,}}', abs({cents}) // 100) || '.' || lpad(cast(abs({cents}) % 100 as varchar), 2, '0')"


def raw_amount(k: str, cents: str) -> str:
    g = grouped(cents)
    return (f"case {k} % 6 when 0 then '$' || {g} when 2 then '-' || {g} when 3 then '(' || {g} || ')' "
            f"when 4 then {g} || '-' else {g} end")


TXN = f"""txn0 as (
  select o_orderkey k, o_custkey account, o_orderkey // {dv.PER_STATEMENT} d,
    'stmt_' || (o_orderkey // {dv.PER_STATEMENT}) stem, o_orderkey % {dv.PER_STATEMENT} seq,
    (o_orderkey % {dv.PER_STATEMENT}) // {dv.PER_PAGE} page,
    case when o_orderkey % 8 = 0 then {_MM} || '/' || {_DD} || '/' || {_Y}
      when o_orderkey % 8 = 1 then {_M} || '/' || {_D} || '/' || substr({_Y}, 3, 2)
      when o_orderkey % 8 = 2 then {_MM} || '/' || {_DD}
      when o_orderkey % 8 = 3 then {_MM} || '-' || {_DD} || '-' || {_Y}
      when o_orderkey % 8 = 4 then substr({_NAME}, 1, 3) || ' ' || {_D} || ', ' || {_Y}
      when o_orderkey % 8 = 5 then {_NAME} || ' ' || {_D}
      when o_orderkey % 8 = 6 then {_MM} || '-' || {_DD}
      when o_orderkey % 24 = 7 then 'foo' when o_orderkey % 24 = 15 then '2/30'
      else substr({_NAME}, 1, 3) || ' ' || {_D} || ' ' || {_Y} end date,
    {at(dv.PHRASES, f"o_orderkey % {len(dv.PHRASES)}")} description,
    case when o_orderkey % 48 in (12, 13, 41) or o_orderkey % 96 = 16 then 0
      else cast(round(o_totalprice * 100) as bigint) end cents,
    case when o_orderkey % 5 = 0 then 'debit' else 'unknown' end type,
    case when o_orderkey % 3 = 0 then 'credit' else 'debit' end true_type,
    (o_orderkey * 37 % 100) / 100.0 confidence,
    'stmt_' || (o_orderkey // {dv.PER_STATEMENT}) || case (o_orderkey // {dv.PER_STATEMENT}) % 3
      when 0 then '_2023' when 1 then '' else '_1999' end || '.pdf' source_file
  from orders),
txn as (select *, case when k % 3 <> 1 then 10000000 + cast(sum(case when true_type = 'credit' then cents else -cents end)
    over (partition by stem order by seq rows unbounded preceding) as bigint) end balance_cents from txn0)"""

_HEADS = {10: [50, 150, 700, 850]}


def _line(part: int, texts: str, top: str, where: str = "true") -> str:
    return (f"select k, d, stem, page, {top} line_top, {part} part, unnest(range(len({texts}))) i, "
            f"unnest({texts}) as text from txn where {where}")


_BASE = f"60 + 24 * (seq % {dv.PER_PAGE})"
_FIRST = f"seq % {dv.PER_PAGE} = 0"
_BAL = f"case when balance_cents < 0 then '-' else '' end || {grouped('balance_cents')}"


def _words(expr: str) -> str:
    return f"string_split({expr}, ' ')"


TOKENS = TXN + ", tok0 as (" + " union all ".join([
    _line(0, _words("date"), _BASE),
    _line(1, _words("description"), _BASE),
    _line(2, f"[{raw_amount('k', 'cents')}]", _BASE, "cents <> 0"),
    _line(3, f"[{_BAL}]", _BASE, "balance_cents is not null"),
    _line(5, "['REF', cast(k as varchar)]", f"{_BASE} + 12", "k % 7 = 3"),
    _line(6, _words("case when d % 2 = 1 then 'Other Credits' else 'Checks Paid' end"), f"{_BASE} + 12",
          f"seq % {dv.PER_PAGE} = 9"),
    _line(7, _words(at(dv.BANK_LINES, f"d % {len(dv.BANK_LINES)}")), "4", f"{_FIRST} and page = 0"),
    _line(8, _words(lit(dv.PREAMBLE)), "16", f"{_FIRST} and page = 0 and d % 2 = 0"),
    _line(9, _words(at(dv.SECTIONS, f"(d + page) % {len(dv.SECTIONS)}")), "28", _FIRST),
    _line(10, arr(dv.COLUMN_HEADS), "40", f"{_FIRST} and (d + page) % 5 <> 4"),
    _line(11, "['Daily', 'Ending', 'Balance']", "560", f"{_FIRST} and page % 2 = 1"),
    _line(12, "['01/31', '1,000.00']", "575", f"{_FIRST} and page % 2 = 1"),
    _line(13, "['Ending', 'Balance', '123.45']", "590", _FIRST),
]) + f"""),
tok1 as (select *, (k * 31 + i * 17 + part * 7) % 100 noise,
   case when part = 0 then 50 + 30 * i when part = 2 then 700 when part = 3 then 850
     when part = 10 then ([50, 150, 700, 850])[i + 1] when part in (1, 5) then 150 + 40 * i else 60 + 40 * i end x0,
   cast(line_top + case when part = 1 then (i % 3) * 3 when part = 2 then 5 else 0 end as double) top,
   case when part = 0 and i = 0 then 'B-DATE' when part = 0 then 'I-DATE' when part = 1 and i = 0 then 'B-DESC'
     when part in (1, 5) then 'I-DESC' when part = 2 then 'B-AMOUNT' when part = 3 then 'B-BALANCE' else 'O' end true_tag,
   row_number() over (partition by stem, page order by line_top, part, i) - 1 pos from tok0),
tokens as (select k, d, stem, page page_index, pos, text, cast(x0 as bigint) x0, cast(line_top as bigint) y0,
   cast(x0 + 30 as bigint) x1, cast(line_top + 10 as bigint) y1, top, top + 10 bottom, true_tag,
   case when noise < 6 then 'O' when noise < 12 and starts_with(true_tag, 'B-') then 'I-' || substr(true_tag, 3)
     else true_tag end pred_tag, noise / 100.0 conf from tok1)"""

PAGE_TEXTS = f"""page_texts as (
  select 'doc_' || doc_id stem, doc_id,
    {at(dv.PERIOD_LINES, f"doc_id % {len(dv.PERIOD_LINES)}")} || chr(10) || substr(text, 1, length(text) // 2) first_page,
    case when doc_id % 5 < 4 then substr(text, length(text) // 2 + 1) || chr(10) ||
      {at(dv.CLOSING_LINES + [''], 'doc_id % 5')} end last_page from documents)"""

FILES = f"""files as (
  select doc_id, '/in/' || source || '/' || replace({at(dv.FILE_NAMES, f"doc_id % {len(dv.FILE_NAMES)}")}, '{{}}',
     cast(doc_id as varchar)) path,
   replace({at(dv.FILE_NAMES, f"doc_id % {len(dv.FILE_NAMES)}")}, '{{}}', cast(doc_id as varchar)) as name,
   'f_' || lpad(cast(doc_id as varchar), 9, '0') stem, n_chars * 40 size, doc_id % 9 pages,
   {"(" + arr(dv.FILE_HEADS) + f")[cast((doc_id * 7) % {len(dv.FILE_HEADS)} as int) + 1]"} || chr(10) || text as text
  from documents)"""

TRAINING = """training as (
  select d.doc_id, case when (d.doc_id // 5) % 4 = 0 then 'auto_' else 'doc_' end || (d.doc_id // 5) stem,
    d.doc_id % 5 page_index, l.quality is not null labelled, cast((d.doc_id * 13) % 101 as double) alignment_rate,
    l.quality is not null and d.doc_id % 3 <> 0 reviewed,
    case when l.quality is not null and d.doc_id % 3 <> 0 then
      case when l.quality = 1 then 'accepted' else 'rejected' end end review_status,
    (['manual', 'auto', 'rules', ''])[cast(d.doc_id % 4 as int) + 1] raw_source, d.doc_id % 7 <> 0 has_image,
    d.n_chars word_count, d.doc_id % 11 = 0 parse_error, d.doc_id % 6 n_txns
  from documents d left join labels l using (doc_id))"""

LOG = """log as (
  select event_id, user_id deal_id, event_type as method, event_id % 50 transaction_count,
    cast(value as decimal(18,2)) total_deposits, event_id % 900 total_withdrawals, 1 + event_id % 6 page_count,
    range(event_id % 7) low_confidence_pages, event_id * 17 % 5000 processing_time_ms,
    'v' || (event_id % 5) model_version, case when event_id % 3 <> 0 then 'fallback' end shadow_method,
    case when event_id % 3 <> 0 then event_id % 47 end shadow_transaction_count,
    case when event_id % 3 <> 0 then cast(value + (event_id % 4) as decimal(18,2)) end shadow_total_deposits,
    event_id % 11 = 0 corrected, ts created_at from events)"""

SUBMISSIONS = f"""sub0 as (
  select page_id id, page_id % 4 form, page_id p, html, regexp_replace(url, '[?#].*$', '') root,
    {at(dv.UPLOAD_NAMES, f"page_id % {len(dv.UPLOAD_NAMES)}")} nm from pages),
sub1 as (select *, root || '/' || nm || '_' || (p % 40) || '.pdf' u1, root || '/copy.PDF' u2,
    'http://forms.example.com/u/' || (p % 40) || '/stmt.pdf' link from sub0),
answers as (
  select id, form, 'control_fileupload' as kind, case when p % 3 = 0 then [u1] else [u1, u2, root] end list,
    case when p % 3 = 0 then u1 end txt, cast(null as varchar) pretty from sub1
  union all select id, form, 'control_widget', [case when p % 2 = 0 then 'n/a' else u2 end],
    case when p % 2 = 0 then 'n/a' else u2 end, '<a href="' || link || '">x</a> <a href=' || u1 || '>' from sub1
  union all select id, form, 'control_textbox', [], case when p % 5 = 0 then link || '?v=1' else html end, null
    from sub1)"""

RESPONSES = """resp0 as (select conv_id, turn, conv_id + turn n, text,
    '{"date":"01/02","description":"ITEM ' || length(text) || '","amount":12.5,"type":"credit"}' a,
    '{"date":"01/03","description":"FEE, NSF","amount":-' || length(text)
      || '.25,"type":"debit","balance_after":10.0}' b from conversations),
responses as (select conv_id, turn,
    case n % 5 when 0 then '{"transactions":[' || a || ',' || b || ']}'
      when 1 then '```json' || chr(10) || '{"transactions":[' || a || ',' || b || ']}' || chr(10) || '```'
      when 2 then '```json' || chr(10) || '{"transactions":[' || a || ',' || b || ']}' || chr(10) || '```' || chr(10)
        || 'Done' || chr(10) || '```'
      when 3 then '{"transactions":[' || a || ',' || b || ',{"date":"01/0' else text end as text,
    case when n % 5 = 3 and conv_id % 2 = 0 then 'max_tokens' else 'end_turn' end stop_reason from resp0)"""

DEALS = """deals as (
  select o_orderkey id, o_custkey deal_id, lower(o_orderpriority) || ' ' || o_orderkey ||
     (['.pdf', '.PDF', '.png', '.txt', '.é'])[cast(o_orderkey % 5 as int) + 1] file_name,
    'deals/' || o_orderkey storage_path, 'secure-pdfs' bucket,
    (['application/pdf', 'image/png', 'Application/PDF; v=1', 'text/plain'])[cast(o_orderkey % 4 as int) + 1] content_type
  from orders)"""

APPS = """apps as (
  select c_custkey id, unnest(range(c_custkey % 4)) idx,
    unnest(list_transform(range(c_custkey % 4), lambda i: {
      'filename': 'st ' || c_custkey || '_' || i || (['.pdf', '.PDF', '.jpg'])[cast((c_custkey + i) % 3 as int) + 1],
      'storage_path': case when (c_custkey + i) % 5 <> 0 then 'apps/' || c_custkey end})) u
  from customer)"""

EVALS = """evals as (
  select p_brand || '-' || lpad(cast(p_size as varchar), 3, '0') model_version, p_brand family,
    (count(*) * 37 + p_size * 13) % 1000 / 1000.0 f1, (count(*) * 11 + p_size * 7) % 1000 / 1000.0 txn_f1
  from part group by p_brand, p_size)"""


def sql(frame: str, body: str) -> str:
    """``WITH <frame> <body>``; the body may add further CTEs after a leading comma."""
    return f"with {frame} {body}"
