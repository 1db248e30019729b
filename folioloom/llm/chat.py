"""Operator 6: chat formatting of preference pairs.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns (same role and text) is rendered once, as the prompt; what follows on each
side is the completion.  Only the text and the end mark of assistant turns in a
completion carry loss, not the header that names the role.

``preference_turns`` gives one row per rendered turn: pair, part (``prompt``, ``chosen``,
``rejected``), turn, role, text in the template, loss (1 or 0), the characters of the
rendered text that carry it (loss_from to before loss_to) and the conversation it came from.
``paired`` joins them to one record a pair: prompt, both completions and the masks of these
as character ranges.  A pair of more than ``CHUNK_TURNS`` turns has a record for each
stretch of so many turn numbers, in order, so a conversation of any length stays distributed.

Text cannot forge a mark: a ``<`` before bars gets one bar more, which is undone by
removing one.  In a role all but letters, digits, ``_``, ``-`` and space become ``_``.

Turns are compared at their turn number.  Repeated rows count once; different rows
with one turn number are one turn, in order of role and text.  A turn that one side
lacks ends the prefix.  Null text is empty, null role is ``unknown``, a null turn
counts as number -1.  A conversation without partner is rendered whole, as completion.
Rows without pair belong to none: ``preference_turns`` renders them the same way, ``paired`` leaves them out.
Texts of any length stay whole.  An empty table gives no row.

``with_swapped_answers`` makes pairs of a table of conversations: the chosen side is a
conversation as it stands, the rejected one the same with its last assistant turn
answered as the next conversation (by id, within ``SWAP`` ids on end, the last one
followed by the first) is.  One without assistant turn is its own rejected side.
Rows without conversation id make no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_TURNS, SWAP = 512, 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", "<|$1")


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(role: Column, text: Column) -> Column:
    return F.concat(header(role), escaped(text), F.lit("\n<|end|>\n"))


def _cleaned(turns: DataFrame, *others: str) -> DataFrame:
    role = F.regexp_replace(F.coalesce(F.col("role").cast("string"), F.lit("unknown")), "[^A-Za-z0-9_ -]", "_")
    return turns.select(
        *others, "conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"),
        role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()


def preference_turns(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, chosen (boolean), conv_id, turn, role, text.  Returns the rendered rows."""
    flat = _cleaned(turns, "pair_id", "chosen")
    # What stands at a turn of one side, as a digest that doesn't depend on order: the sum of the rows' hashes in 128 bits
    told = F.sha2(F.concat_ws("\x1f", "role", "text"), 256)
    part = [F.sum(F.conv(F.substring(told, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{k}") for k in range(2)]
    sides = flat.where("pair_id is not null").groupBy("pair_id", "turn", "chosen").agg(*part, F.count("*").alias("n"))
    at_turn = sides.groupBy("pair_id", "turn").agg(F.count("*").alias("sides"), *[F.min(c).alias(f"{c}_low") for c in ("d0", "d1", "n")], *[F.max(c).alias(f"{c}_high") for c in ("d0", "d1", "n")])
    differs = (F.col("sides") < 2) | (F.col("d0_low") != F.col("d0_high")) | (F.col("d1_low") != F.col("d1_high")) | (F.col("n_low") != F.col("n_high"))
    ends = at_turn.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("first_other"))
    ends = ends.select(F.col("pair_id").alias("__p"), F.coalesce("first_other", F.lit((1 << 63) - 1)).alias("first_other"))
    joined = flat.join(ends, flat["pair_id"] == ends["__p"], "left")
    common = F.coalesce(F.col("turn") < F.col("first_other"), F.lit(False))
    part_name = F.when(common, F.lit("prompt")).when(F.col("chosen"), F.lit("chosen")).otherwise(F.lit("rejected"))
    rendered, loss = render(F.col("role"), F.col("text")), ~common & (F.col("role") == "assistant")
    return joined.where(~common | F.col("chosen")).select(
        "pair_id", part_name.alias("part"), "turn", "role", rendered.alias("rendered"), F.when(loss, 1).otherwise(0).alias("loss"),
        F.when(loss, F.length(header(F.col("role")))).alias("loss_from"), F.when(loss, F.length(rendered)).alias("loss_to"), "conv_id",
    )


def paired(rows: DataFrame) -> DataFrame:
    """``rows``: as of ``preference_turns``.  pair_id, chunk (from 0), prompt, chosen, rejected, chosen_loss, rejected_loss (ranges as ``from-to``, by comma), n_prompt_turns."""
    chunk = F.floor(F.greatest("turn", F.lit(0)) / CHUNK_TURNS)
    order = Window.partitionBy("pair_id", "chunk", "part").orderBy("turn", "role", "rendered")
    laid = rows.where("pair_id is not null").withColumn("chunk", chunk).withColumn("at", F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("rendered"))
    laid = laid.withColumn("span", F.when(F.col("loss") == 1, F.concat(F.col("at") + F.col("loss_from"), F.lit("-"), F.col("at") + F.col("loss_to"))))

    def joined(part: str, column: str, between: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when((F.col("part") == part) & F.col(column).isNotNull(), F.struct("at", F.col(column).alias("x")))))
        return F.array_join(F.transform(listed, lambda r: r["x"]), between)

    return laid.groupBy("pair_id", "chunk").agg(
        joined("prompt", "rendered", "").alias("prompt"), joined("chosen", "rendered", "").alias("chosen"), joined("rejected", "rendered", "").alias("rejected"),
        joined("chosen", "span", ",").alias("chosen_loss"), joined("rejected", "span", ",").alias("rejected_loss"), F.count_if(F.col("part") == "prompt").alias("n_prompt_turns"),
    )


def with_swapped_answers(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, text.  Both sides of a pair for each conversation, as ``preference_turns`` takes them."""
    flat = _cleaned(turns).where("conv_id is not null")
    last = flat.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    near = Window.partitionBy(F.floor(F.col("conv_id") / SWAP)).orderBy("conv_id")  # at most SWAP rows
    follows = F.coalesce(F.lead("last.text").over(near), F.first("last.text").over(near))
    last = last.select(F.col("conv_id").alias("c"), F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"), follows.alias("other"))
    joined = flat.join(last, flat["conv_id"] == last["c"], "left")
    here = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn")) & (F.col("text") == F.col("last_text"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("chosen"), F.col("text").alias("said")), F.struct(F.lit(False).alias("chosen"), F.when(here, F.col("other")).otherwise(F.col("text")).alias("said"))))
    return joined.select(F.col("conv_id").alias("pair_id"), "conv_id", "turn", "role", sides.alias("s")).select("pair_id", "s.chosen", "conv_id", "turn", "role", F.col("s.said").alias("text"))


def op6_preference(spark, sf_dir: str) -> DataFrame:
    """A pair for each conversation: as it stands, and with its last answer swapped."""
    return paired(preference_turns(with_swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP6_SQL = r"""
with t as (
  select distinct conv_id, coalesce(cast(turn as bigint), -1) as turn, regexp_replace(coalesce(role, 'unknown'), '[^A-Za-z0-9_ -]', '_', 'g') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
l as (select conv_id, turn as last_turn, text as last_text from t where role = 'assistant' qualify row_number() over (partition by conv_id order by turn desc, text desc) = 1),
d as (select *, coalesce(lead(last_text) over w, first_value(last_text) over w) as other from l window w as (partition by floor(conv_id / 64) order by conv_id)),
s as (
  select conv_id as pair_id, true as chosen, turn, role, text from t
  union all
  select conv_id, false, turn, role, case when role = 'assistant' and turn = last_turn and text = last_text then other else text end from t left join d using (conv_id)),
f as (select distinct * from s),
g as (select pair_id, turn, chosen, string_agg(role || chr(31) || text, chr(30) order by role, text) as told from f group by all),
a as (select pair_id, turn, count(*) < 2 or min(told) <> max(told) as differs from g group by all),
e as (select pair_id, coalesce(min(case when differs then turn end), 9223372036854775807) as first_other from a group by all),
r as (
  select pair_id, case when turn < first_other then 'prompt' when chosen then 'chosen' else 'rejected' end as part, turn, greatest(turn, 0) // 512 as chunk, role,
         '<|' || role || '|>' || chr(10) || regexp_replace(text, '<(\|+)', '<|\1', 'g') || chr(10) || '<|end|>' || chr(10) as rendered
  from f join e using (pair_id) where turn >= first_other or chosen),
o as (select *, sum(length(rendered)) over (partition by pair_id, chunk, part order by turn, role, rendered rows unbounded preceding) - length(rendered) as begun from r),
p as (select *, case when role = 'assistant' then (begun + length(role) + 5)::bigint || '-' || (begun + length(rendered))::bigint end as span from o)
select pair_id, chunk,
       coalesce(string_agg(rendered, '' order by begun) filter (where part = 'prompt'), '') as prompt,
       coalesce(string_agg(rendered, '' order by begun) filter (where part = 'chosen'), '') as chosen,
       coalesce(string_agg(rendered, '' order by begun) filter (where part = 'rejected'), '') as rejected,
       coalesce(string_agg(span, ',' order by begun) filter (where part = 'chosen'), '') as chosen_loss,
       coalesce(string_agg(span, ',' order by begun) filter (where part = 'rejected'), '') as rejected_loss,
       count(*) filter (where part = 'prompt') as n_prompt_turns
from p group by pair_id, chunk
"""
