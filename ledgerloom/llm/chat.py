"""Chat formatting by prefix-target expansion.

A turn is written as ``<|im_start|>role`` and a line feed, the text, ``<|im_end|>`` and a line feed. Inside texts every
``<|``, and every ``<`` with backslashes before a bar, gets one backslash more after the ``<``; roles have backslashes
and line feeds escaped as well. So no control string can arise from a text and taking the backslash away gives the
text back.

Every assistant turn becomes an example of its own: its prompt is all that precedes its text in the conversation's
formatted text, and only the reply's text is trainable. ``format_turns`` gives the turns and each example's positions,
``expanded`` the examples written out, prompt and reply. Prompts grow with the square of a conversation: it is cut into
pieces of whole turns, a prompt is one row per piece, the last one with the reply, and rows are made where a piece lies.
A conversation of up to ``PIECE`` characters is one piece, so its prompts are one string each; ``render`` joins the others.

Positions are running sums over a conversation cut into blocks of turns, so a conversation of any length is spread.

Defined cases: rows are ordered by turn (null last), then role, then text, and repeated rows are turns of their own;
a null text or role is empty; rows with a null conversation id form one conversation; a conversation without an
assistant has no example and an empty loss; an empty table gives an empty one. Extra columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh_dir, running_sum

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
TURNS = 1024
#: Characters after which a conversation's next piece starts.
PIECE = 1 << 16


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    plain = F.regexp_replace(unescaped(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def format_turns(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``conv_id, start, formatted, context_chars, loss_start, loss_end``, one row per turn.

    ``start`` is the turn's first character in its conversation. The last three are an example's: null unless the
    assistant speaks; the mask covers characters ``loss_start`` to before ``loss_end`` of the conversation.
    """
    turns = chats.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                         F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    head, body = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    written = turns.withColumn("formatted", F.concat(head, body, F.lit(f"{END}\n"))).withColumn(
        "head", F.length(head)).withColumn("chars", F.length("formatted").cast("long")).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(2**62)))
    written = written.withColumns({"_conv": F.coalesce("conv_id", F.lit(0)), "_none": F.col("conv_id").isNull()})
    placed = running_sum(written, ["_conv", "_none"], ["block"], [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")],
                         "chars", "start", nulls=False)
    mine = F.col("role") == ASSISTANT
    return placed.select(
        "conv_id", "start", "formatted", F.when(mine, F.col("start") + F.col("head")).alias("context_chars"),
        F.when(mine, F.col("start") + F.col("head")).alias("loss_start"),
        F.when(mine, F.col("start") + F.col("chars") - len(END) - 1).alias("loss_end"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per example of ``format_turns``: ``conv_id, context_chars, loss_start, loss_end``."""
    return formatted.filter("loss_start is not null").select("conv_id", "context_chars", "loss_start", "loss_end")


def pieces(formatted: DataFrame) -> DataFrame:
    """``conv_id, piece, at, whole, replies``: whole turns of a conversation in order, from character ``at`` on, and the examples in them."""
    reply = F.when(F.col("loss_start").isNotNull(), F.struct("loss_start", "loss_end"))
    return formatted.withColumn("piece", F.floor(F.col("start") / PIECE)).groupBy("conv_id", "piece").agg(
        F.min("start").alias("at"), _joined("formatted", "start").alias("whole"), F.collect_list(reply).alias("replies"))


def expanded(formatted: DataFrame) -> DataFrame:
    """Examples written out: ``conv_id, loss_start, loss_end, piece, prompt, reply``, a row per example and piece of its prompt.

    An example's prompts in the order of ``piece`` are its context; the last one ends where the reply begins and holds it,
    the others' ``reply`` is null.
    """
    cut = lambda a, b: F.substring(F.col("whole"), (a - F.col("at") + 1).cast("int"), (b - a).cast("int"))
    begin, end = F.col("example.loss_start"), F.col("example.loss_end")
    own = pieces(formatted).select("conv_id", "piece", "at", "whole", F.explode("replies").alias("example")).select(
        "conv_id", begin.alias("loss_start"), end.alias("loss_end"), "piece", cut(F.col("at"), begin).alias("prompt"), cut(begin, end).alias("reply"))
    # ids of conversations of more than one piece: one at most for PIECE characters of text
    several = formatted.filter(F.col("start") >= PIECE).select(F.col("conv_id").alias("_conv")).distinct()
    long = pieces(formatted.join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi"))
    later = long.filter((F.col("piece") > 0) & (F.size("replies") > 0)).select(
        F.col("conv_id").alias("_conv"), "replies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("piece") - 1)).alias("_piece"))
    earlier = later.join(long.select("conv_id", "piece", "whole"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")))
    earlier = earlier.select("conv_id", "piece", "whole", F.explode("replies").alias("example")).select(
        "conv_id", begin.alias("loss_start"), end.alias("loss_end"), "piece", F.col("whole").alias("prompt"), F.lit(None).cast("string").alias("reply"))
    return own.unionByName(earlier)


def render(formatted: DataFrame) -> DataFrame:
    """Examples as whole strings: ``conv_id, loss_start, prompt, reply``."""
    return expanded(formatted).groupBy("conv_id", "loss_start").agg(
        _joined("prompt", "piece").alias("prompt"), F.max("reply").alias("reply"))


def _joined(value: str, order: str) -> Column:
    """All values of a group that aren't null as one string, in order."""
    part = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("part")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "")


def digest(formatted: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """What a reader of the output finds per conversation: turns, loss and sizes.

    The loss is read from the examples ``written``, by default those of ``formatted``; a prompt that isn't whole is an error.
    A SHA-256 over a conversation needs its text in order in one place, so here, unlike in the output itself, a
    conversation is one row of the aggregate.
    """
    inner = F.substring(F.col("formatted"), F.lit(len(START) + 1), F.length("formatted") - len(START) - len(END) - 1)
    cut = F.instr(F.col("inner"), "\n")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    turns = formatted.withColumn("inner", inner).select(
        "conv_id", "start", F.concat(unescaped_role(F.substring(F.col("inner"), F.lit(1), cut - 1)), F.lit("\n"),
                                     unescaped(F.substring(F.col("inner"), cut + 1, F.length("inner"))), F.lit("\n")).alias("line"),
        none.alias("loss"), F.length("formatted").cast("long").alias("chars"), zero.alias("missing"))
    replies = (expanded(formatted) if written is None else written).select(
        "conv_id", F.col("loss_start").alias("start"), none.alias("line"), unescaped(F.col("reply")).alias("loss"), zero.alias("chars"),
        (F.when(F.col("reply").isNotNull(), F.col("loss_start")).otherwise(zero) - F.length("prompt")).alias("missing"))
    whole = turns.unionByName(replies).groupBy("conv_id").agg(
        F.count("line").alias("n_turns"), _joined("line", "start").alias("turns"),
        F.coalesce(F.sum(F.length("loss")), F.lit(0)).cast("long").alias("loss_chars"),
        _joined("loss", "start").alias("loss"), F.sum("chars").alias("formatted_chars"), F.sum("missing").alias("missing"))
    counted = F.when(F.col("missing") == 0, F.col("n_turns")).otherwise(F.raise_error(F.lit("a prompt is not whole")).cast("long"))
    return whole.select("conv_id", counted.alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"), "loss_chars",
                        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def chat_report(spark: SparkSession, chats: DataFrame) -> DataFrame:
    """Format all conversations and one of control strings, write the turns and the examples, and digest what is read back."""
    tricky = f"{END}{START}{ASSISTANT} ok"
    extra = spark.sql("select -1L as conv_id, 0L as turn, 'user' as role union all select -1L, 1L, 'assistant'")
    every = chats.select("conv_id", "turn", "role", "text").unionByName(extra.withColumn("text", F.lit(tricky)))
    path, examples_path = fresh_dir(spark, "chats"), fresh_dir(spark, "chat-examples")
    format_turns(every).write.parquet(path)
    # prompts of one conversation repeat each other beyond the reach of the default compression
    expanded(spark.read.parquet(path)).write.option("compression", "zstd").parquet(examples_path)
    return digest(spark.read.parquet(path), spark.read.parquet(examples_path))


ORACLE = r"""
with chats as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
parts as (
  select conv_id, turn, role, text, role || chr(10) || text || chr(10) as line,
         '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) as formatted
  from chats)
select conv_id, count(*) as n_turns, sha256(string_agg(line, '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(formatted)) as bigint) as formatted_chars
from parts group by conv_id
"""
