"""Preference formatting of conversation pairs, in DataFrame functions.

The turns that the chosen and the rejected conversation share from the start are rendered once, as the prompt; what
follows is rendered for each side, with a mask of the characters that count for the loss: the texts of the assistant's
turns and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role SEPARATOR text CLOSE.  Where a text holds the start of a mark, a backslash goes into it.
OPEN, SEPARATOR, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def by_neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs the conversations 2k (chosen) and 2k + 1 (rejected); adds pair_id and side."""
    kept = conversations.where("conv_id is not null")
    return kept.select(F.expr("conv_id - pmod(conv_id, 2)").alias("even"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text").select(F.expr("even div 2").alias("pair_id"), "side", "turn", "role", "text")


def by_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Turns of the pairs (pair_id, chosen_id, rejected_id), with pair_id and side.  A conversation can be in many pairs."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s")).select("pair_id", "s.side", "s.conv_id")
    return sides.join(conversations.select("conv_id", "turn", "role", "text"), "conv_id").select("pair_id", "side", "turn", "role", "text")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SEPARATOR), turn["text"], F.lit(CLOSE))


def _mask(turns: Column) -> Column:
    """start:end (code points of the rendered turns) of what counts for the loss, comma-joined."""

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(_rendered(turn))
        begin = state["at"] + F.length(F.concat(F.lit(OPEN), turn["role"], F.lit(SEPARATOR)))
        span = F.concat_ws(":", begin.cast("string"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == TRAINED_ROLE, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(turns, start, step, lambda s: F.array_join(s["out"], ","))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair.

    turns needs pair_id, side (``chosen`` or ``rejected``), turn, role and text; other columns are ignored, rows without
    a pair_id go.  Turns stand in the order of (turn, role, text), a missing turn number last; a null role or text counts
    as empty; repeated turns are repeated.  A side without any turn has an empty completion and complete = false.  Equal
    conversations have two empty completions.  Returns pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask,
    prompt_turns, chosen_turns, rejected_turns, complete.
    """
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("<\\|"))
    role = F.replace(F.coalesce("role", F.lit("")), F.lit(OPEN), F.lit("<\\|"))
    item = F.struct(F.col("turn").isNull().alias("last"), "turn", role.alias("role"), text.alias("text"))
    of_side = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, item)))
    pairs = turns.where("pair_id is not null").groupBy("pair_id").agg(of_side("chosen").alias("a"), of_side("rejected").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(same, F.lit(False)).cast("int")
    pairs = pairs.withColumn("shared", F.when(first_other > 0, first_other - 1).otherwise(F.size("a")))
    rest = lambda side: F.slice(side, F.col("shared") + 1, F.size(side))
    pairs = pairs.select("pair_id", "shared", F.slice("a", F.lit(1), F.col("shared")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    shown = lambda side: F.array_join(F.transform(side, _rendered), "")
    return pairs.select(
        "pair_id", shown("p").alias("prompt"), shown("a").alias("chosen"), shown("b").alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"),
        F.col("shared").cast("long").alias("prompt_turns"), F.size("a").cast("long").alias("chosen_turns"), F.size("b").cast("long").alias("rejected_turns"),
        ((F.col("shared") + F.size("a") > 0) & (F.col("shared") + F.size("b") > 0)).alias("complete"),
    )


ORACLE_SQL = """
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side,
         row_number() over (partition by conv_id order by turn nulls last, replace(coalesce(role, ''), '<|', '<\\|'), replace(coalesce(text, ''), '<|', '<\\|')) as i,
         replace(coalesce(role, ''), '<|', '<\\|') as role, replace(coalesce(text, ''), '<|', '<\\|') as text
  from conversations where conv_id is not null),
r as (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown, '<|' || role || '|>' || chr(10) as head from t),
n as (select pair_id, coalesce(max(i) filter (where side = 0), 0) as na, coalesce(max(i) filter (where side = 1), 0) as nb from r group by pair_id),
eq as (select a.pair_id, a.i from r a join r b on a.pair_id = b.pair_id and a.i = b.i and a.side = 0 and b.side = 1 and a.role = b.role and a.text = b.text),
run as (select pair_id, i, row_number() over (partition by pair_id order by i) as k from eq),
shared as (select n.pair_id, n.na, n.nb, coalesce(max(run.k) filter (where run.k = run.i), 0) as s from n left join run on n.pair_id = run.pair_id group by all),
w as (select r.*, s.s, sum(length(shown)) over (partition by r.pair_id, side, (i > s.s) order by i) as upto from r join shared s on r.pair_id = s.pair_id)
select sh.pair_id,
  coalesce(string_agg(shown, '' order by i) filter (where side = 0 and i <= w.s), '') as prompt,
  coalesce(string_agg(shown, '' order by i) filter (where side = 0 and i > w.s), '') as chosen,
  coalesce(string_agg(shown, '' order by i) filter (where side = 1 and i > w.s), '') as rejected,
  coalesce(string_agg((upto - length(shown) + length(head))::bigint::varchar || ':' || (upto - 1)::bigint::varchar, ',' order by i) filter (where side = 0 and i > w.s and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg((upto - length(shown) + length(head))::bigint::varchar || ':' || (upto - 1)::bigint::varchar, ',' order by i) filter (where side = 1 and i > w.s and role = 'assistant'), '') as rejected_mask,
  sh.s::bigint as prompt_turns, (sh.na - sh.s)::bigint as chosen_turns, (sh.nb - sh.s)::bigint as rejected_turns, (sh.na > 0 and sh.nb > 0) as complete
from shared sh join w on sh.pair_id = w.pair_id group by sh.pair_id, sh.s, sh.na, sh.nb
"""
