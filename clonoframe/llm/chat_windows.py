"""Chat formatting in budgeted windows.

A conversation is rendered turn by turn. Prefix sums of the turns' token costs choose spans that
begin and end with a turn: a window takes turns until its budget is used up. Later windows first
repeat the system turn and a limited stretch of history, and only the span's own assistant texts
are under the loss mask, so every assistant text is learnt once.

Template: ``<|turn|>role`` line end ``text<|end|>`` line end. Control strings inside roles and
texts (``CONTROL``) get a backslash after their first character, one more than they already
have, so no raw control string is left and unescaping is exact.

Everything is built-in functions over one shuffle by conversation; a conversation is one row
between, as its digest needs all its turns in order.

Defined cases: null text and null role are empty; turns of equal number are ordered by role,
then text, a null number first; repeated rows are repeated turns; a turn above the budget makes
a window of its own, whole, marked ``over_budget``; a conversation without assistant turns has
an empty mask; a null conv_id is one conversation; other columns are ignored; an empty table
gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024  # tokens in a window
HISTORY = 256  # tokens of it that repeated turns may take
HISTORY_TURNS = 4
OVERHEAD = 4  # tokens of the template around a turn

TURN, END, LINE = "<|turn|>", "<|end|>\n", "<|nl|>"
#: What may follow "<" or "[" and some backslashes to make a control string.
TAILS = r"\||/?s>|/?INST\]|/?SYS>>"
CONTROL = rf"(<|\[)(\\*)(?={TAILS})"
ESCAPED = rf"(<|\[)(\\*)\\(?={TAILS})"
#: A token, for the budget: a run of letters and digits, or one other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D ]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def _role(raw: Column) -> Column:
    return F.replace(escape(raw), F.lit("\n"), F.lit(LINE))


def _raw_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def _prefixed(turns: DataFrame) -> DataFrame:
    """Turns with their token cost and the running sum of costs in their conversation."""
    raw = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    cost = F.regexp_count(escape(F.col("text")), F.lit(TOKEN)).cast("long") + OVERHEAD
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = raw.withColumn("cost", cost).withColumn(
        "upto", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return rows.withColumns({"role": _role(F.col("role")), "text": escape(F.col("text"))})


def windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """(conv_id, window, n_context, formatted, spans, n_tokens, over_budget).

    The first ``n_context`` turns of ``formatted`` are repeated ones. ``spans`` are the start and
    length, in code points of ``formatted``, of the assistant texts under the loss mask.
    """
    whole = (
        _prefixed(turns)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("upto", "role", "text", "cost"))).alias("turns"))
        .withColumn("system", F.expr("if(turns[0].role = 'system', 1, 0)"))
    )
    fresh = f"if(s.first = 0, {budget}, {budget - history} - system * turns[0].cost)"
    starts = F.expr(
        "aggregate(turns, named_struct('starts', array(0), 'base', 0L, 'first', 0, 'i', 0),"
        f" (s, t) -> if(s.i > s.first and t.upto - s.base > {fresh},"
        "  named_struct('starts', concat(s.starts, array(s.i)), 'base', t.upto - t.cost,"
        "   'first', s.i, 'i', s.i + 1),"
        "  named_struct('starts', s.starts, 'base', s.base, 'first', s.first, 'i', s.i + 1)),"
        " s -> s.starts)"
    )
    split = whole.withColumn("starts", starts)
    # repeated turns: the last few before the span, but for the system turn, within the allowance
    recent = f"slice(turns, 1 + greatest(a - {history_turns}, system), a - greatest(a - {history_turns}, system))"
    kept = f"filter({recent}, t -> turns[a - 1].upto - t.upto + t.cost <= {history})"
    context = f"if(a = 0, slice(turns, 1, 0), concat(slice(turns, 1, system), {kept}))"
    parts = split.select(
        "conv_id",
        F.posexplode(
            F.expr(
                f"transform(starts, (a, k) -> named_struct('context', {context}, 'span',"
                " slice(turns, a + 1, coalesce(get(starts, k + 1), size(turns)) - a)))"
            )
        ).alias("window", "part"),
    )
    rendered = f"x -> concat('{TURN}', x.role, '\\n', x.text, '{END[:-1]}', '\\n')"
    texts = parts.select(
        "conv_id", "window",
        F.size("part.context").alias("n_context"),
        F.expr(f"array_join(transform(part.context, {rendered}), '')").alias("before"),
        F.expr(f"transform(part.span, {rendered})").alias("own"),
        F.expr("part.span").alias("span"),
        F.expr("aggregate(concat(part.context, part.span), 0L, (n, x) -> n + x.cost)").alias("n_tokens"),
    )
    spans = F.expr(
        "aggregate(arrays_zip(span, own), named_struct('at', length(before), 'spans',"
        " cast(array() as array<struct<start:int,length:int>>)),"
        " (s, x) -> named_struct('at', s.at + length(x.own), 'spans',"
        "  if(x.span.role = 'assistant', concat(s.spans, array(named_struct("
        f"   'start', s.at + {len(TURN)} + length(x.span.role) + 1, 'length', length(x.span.text)))),"
        "  s.spans)), s -> s.spans)"
    )
    return texts.select(
        "conv_id", "window", "n_context",
        F.concat("before", F.array_join("own", "")).alias("formatted"),
        spans.alias("spans"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
    )


def parsed(formatted: Column, n_context: Column) -> Column:
    """Turns (role, text) of a window without its repeated ones, read from its formatted text."""
    pieces = F.split(formatted, TURN.replace("|", r"\|"))
    own = F.slice(pieces, n_context + 2, F.greatest(F.size(pieces) - n_context - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        start = F.length(role) + 2
        text = F.substring(piece, start, F.length(piece) - start + 1 - len(END))
        return F.struct(_raw_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(own, turn)


def learnt(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    texts = F.transform(
        spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))
    )
    return F.array_join(texts, "")
