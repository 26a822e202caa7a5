"""Order models over the roles of conversations and the events of users."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import base, query, table, with_base
from plumbline.functions.model import choice, compile_model, elem, seq
from plumbline.operators import sequence as Q

TALK = seq(elem("system", 0, 1), seq(elem("user"), elem("assistant"), lo=1, hi=None))


def talk(spark, sf, damaged=True) -> Q.Groups:
    df = base(spark, sf, "talk") if damaged else table(spark, sf, "conversations")
    return Q.Groups(df, ["conv_id"], "turn", "role", compile_model(TALK))


SHAPES = with_base("talk") + """, shapes as (select conv_id, string_agg(case when role in ('system', 'user', 'assistant') then left(role, 1) else 'x' end, '' order by turn) as s from talk group by conv_id)
"""
PREFIXES = with_base("talk") + """, p as (select conv_id, turn, role, string_agg(case when role in ('system', 'user', 'assistant') then left(role, 1) else 'x' end, '') over (partition by conv_id order by turn) as s from talk)
"""


@query("Q1_sequence_valid", SHAPES + "select conv_id, regexp_full_match(s, 's?(ua)+') as valid from shapes")
def valid(spark, sf):
    return Q.sequence_valid(talk(spark, sf))


@query("Q1b_sequence_valid_events", """
select user_id, not contains(string_agg(case event_type when 'purchase' then 'p' when 'signup' then 's' else '.' end, '' order by ts), 'sp') as valid
from events group by user_id""")
def valid_events(spark, sf):
    """Whole event histories in which no signup is followed directly by a purchase."""
    plain = [elem("view"), elem("click"), elem("error")]
    model = seq(choice(*plain, elem("purchase"), seq(elem("signup", 1, None), choice(*plain)), lo=0, hi=None), elem("signup", 0, None))
    return Q.sequence_valid(Q.Groups(table(spark, sf, "events"), ["user_id"], "ts", "event_type", compile_model(model)))


@query("Q2_sequence_trace", PREFIXES + """
select conv_id, turn, role, cast(case when s = 's' then 1 when regexp_full_match(s, 's?(ua)*u') then 2 when regexp_full_match(s, 's?(ua)+') then 3 else 4 end as integer) as state from p""")
def trace(spark, sf):
    return Q.sequence_trace(talk(spark, sf))


@query("Q3_first_invalid", PREFIXES + """
select conv_id, min(turn) filter (not regexp_full_match(s, 's?(ua)*u?')) as first_invalid from p group by conv_id""")
def first_invalid(spark, sf):
    return Q.first_invalid(talk(spark, sf))


@query("Q4_missing_to_complete", SHAPES + """
select conv_id, case when regexp_full_match(s, 's?(ua)+') then '' when regexp_full_match(s, 's?(ua)*u') then 'assistant' when s = 's' then 'user,assistant' end as missing from shapes""")
def missing(spark, sf):
    return Q.missing_to_complete(talk(spark, sf)).select("conv_id", F.array_join("missing", ",").alias("missing"))


@query("Q5_allowed_next", SHAPES + """
select conv_id, case when s = 's' then 'user' when regexp_full_match(s, 's?(ua)*u') then 'assistant' when regexp_full_match(s, 's?(ua)+') then 'user' else '' end as allowed from shapes""")
def allowed(spark, sf):
    return Q.allowed_next(talk(spark, sf)).select("conv_id", F.array_join("allowed", ",").alias("allowed"))


@query("Q6_allowed_at_gaps", PREFIXES + """
, full_shape as (select conv_id, arg_max(s, turn) as s, max(turn) + 1 as n from p group by conv_id),
gaps as (select conv_id, s, unnest(generate_series(0, length(s))) as gap from full_shape),
tries as (select conv_id, s, gap, r.role, left(s, cast(gap as integer)) || left(r.role, 1) || substr(s, cast(gap as integer) + 1) as t from gaps, (values ('system', 1), ('user', 2), ('assistant', 3)) r(role, i))
select conv_id, cast(g.gap as bigint) as gap, coalesce((select string_agg(role, ',' order by case role when 'system' then 1 when 'user' then 2 else 3 end)
  from tries t where t.conv_id = g.conv_id and t.gap = g.gap and regexp_full_match(t.t, 's?(ua)*u?')), '') as allowed from gaps g""")
def gaps(spark, sf):
    return Q.allowed_at_gaps(talk(spark, sf)).select("conv_id", "gap", F.array_join("allowed", ",").alias("allowed"))


@query("Q7_insertion_plan", """
with shapes as (select conv_id, string_agg(left(role, 1), '' order by turn) as s from conversations group by conv_id),
x as (select conv_id, s, starts_with(s, 's') as sys, right(s, 1) = 'u' as half, contains(s, 'a') as has_a from shapes),
-- after a system turn or a finished exchange the next legal symbol is user, in the middle of one assistant; what follows must still fit
rows as (
  select conv_id, 'system' as name, 0 as gap, case when half then 'suggested' else 'suggested' end as label from x where not sys
  union all select conv_id, 'user', length(s), 'repeat' from x where not half
  union all select conv_id, 'assistant', length(s), 'required-missing' from x where half)
select conv_id, name, cast(gap as bigint) as gap, label from rows""")
def plan(spark, sf):
    return Q.insertion_plan(talk(spark, sf, False)).select("conv_id", "name", "gap", "label")


@query("Q9_repair_cost", """
with shapes as (select conv_id, string_agg(left(role, 1), '' order by turn) as s from conversations group by conv_id)
select conv_id, cast(case when regexp_full_match(s, 's?(ua)+') then 0 else 1 end as integer) as cost from shapes""")
def cost(spark, sf):
    return Q.repair_cost(talk(spark, sf, False))


def swapped(spark, sf) -> Q.Groups:
    """Complete conversations with their turns 0 and 1 exchanged."""
    df = table(spark, sf, "conversations").withColumn("turn", F.when(F.col("turn") < 2, 1 - F.col("turn")).otherwise(F.col("turn")))
    return Q.Groups(df, ["conv_id"], "turn", "role", compile_model(TALK))


@query("Q10_repair_plan", """
with t as (select conv_id, case when turn < 2 then 1 - turn else turn end as turn, role from conversations),
shapes as (select conv_id, string_agg(left(role, 1), '' order by turn) as s from t group by conv_id),
full_pairs as (select * from shapes where not regexp_full_match(s, 's?(ua)+'))
select conv_id, cast(case when regexp_full_match(s, 'au(ua)*') then 1 when regexp_full_match(s, 'au(ua)*u') then 2 when s in ('u', 'us') then 1
  when regexp_full_match(s, 'us(au)*a') then 1 when regexp_full_match(s, 'us(au)*') and length(s) > 2 then 2 end as integer) as cost
from full_pairs""")
def repairs(spark, sf):
    return Q.repair_plan(swapped(spark, sf)).select("conv_id", "cost")


@query("Q11_apply_repair", """
with t as (select conv_id, case when turn < 2 then 1 - turn else turn end as turn, role from conversations),
shapes as (select conv_id, string_agg(left(role, 1), '' order by turn) as s from t group by conv_id)
select conv_id, true as valid from shapes where not regexp_full_match(s, 's?(ua)+')""")
def applied(spark, sf):
    """Every repaired conversation, checked against the model again."""
    g = swapped(spark, sf)
    arrays = g.chunks.select("conv_id", F.col("_syms").alias("symbols"))
    fixed = Q.repair_plan(g).where("cost is not null").join(arrays, "conv_id")
    again = fixed.select("conv_id", F.posexplode(Q.apply_repair(F.col("symbols"), F.col("edits"))).alias("turn", "role"))
    return Q.sequence_valid(Q.Groups(again, ["conv_id"], "turn", "role", g.model))


@query("Q13_sequence_findings", """
with shapes as (select conv_id, string_agg(left(role, 1), '' order by turn) as s, count(*) as n from conversations group by conv_id)
select cast(conv_id as varchar) as doc_key, n as ordinal, 'cvc-complex-type.2.4.b' as code, 'Missing here: assistant' as message, 'childGap' as anchor from shapes where not regexp_full_match(s, 's?(ua)+')""")
def findings(spark, sf):
    return Q.sequence_findings(talk(spark, sf, False)).select("doc_key", "ordinal", "code", "message", "anchor")


@query("Q14_placement_options", SHAPES + """
, e as (select conv_id, cast(case when regexp_full_match(s || 'uau', 's?(ua)+') or regexp_full_match(s || 'aua', 's?(ua)+') then 0
  when s = 's' or regexp_full_match(s, 's?(ua)+') then 2 when regexp_full_match(s, 's?(ua)*u') then 1 else 3 end as integer) as errors from shapes)
select conv_id, errors, row_number() over (partition by conv_id % 5 order by errors, conv_id) as rank from e""")
def placement(spark, sf):
    options = Q.placement_options(talk(spark, sf), ["assistant", "user", "assistant"]).withColumn("scope", F.col("conv_id") % 5)
    return Q.rank_placements(options, ["scope"], "conv_id").select("conv_id", "errors", F.col("rank"))


# Events of a user sorted by type, so that their order is right and only the counts matter.
TYPES = ("click", "error", "purchase", "signup", "view")


def by_type(spark, sf, group="user_id") -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type"))
    return table(spark, sf, "events").select(F.expr(group).alias("g"), (place * (1 << 40) + F.col("event_id")).alias("at"), "event_type")


COUNTS = f"""with c as (select {{group}} as g, {', '.join(f"count(*) filter (event_type = '{t}') as {t}" for t in TYPES)} from events group by all)
"""


@query("Q1c_sequence_valid_counts", COUNTS.format(group="user_id % 8") + f"select g, {' and '.join(f'{t} between 20 and 260' for t in TYPES[:-1])} and view between 25 and 9000 as valid from c")
def valid_counts(spark, sf):
    """Large bounds are kept exactly: a model of about ten thousand states in a few runs."""
    model = seq(*[elem(t, 20, 260) for t in TYPES[:-1]], elem("view", 25, 9000))
    return Q.sequence_valid(Q.Groups(by_type(spark, sf, "user_id % 8"), ["g"], "at", "event_type", compile_model(model)))


UP_TO_14 = [elem(t, 0, 14) for t in TYPES[:-1]]


@query("Q4b_missing_counts", COUNTS.format(group="user_id") + f"""
select g, case when {' or '.join(f'{t} > 14' for t in TYPES[:-1])} or view > 9000 then null when view >= 20 then '' else array_to_string(list_transform(range(20 - view), lambda i: 'view'), ',') end as missing from c""")
def missing_counts(spark, sf):
    g = Q.Groups(by_type(spark, sf), ["g"], "at", "event_type", compile_model(seq(*UP_TO_14, elem("view", 20, 9000))))
    return Q.missing_to_complete(g).select("g", F.array_join("missing", ",").alias("missing"))


@query("Q9b_repair_cost_counts", COUNTS.format(group="user_id") + f"""
, x as (select g, {' + '.join(f'greatest({t} - 14, 0)' for t in TYPES[:-1])} + greatest(view - 9000, 0) as n from c)
select g, cast(case when n <= 4 then n end as integer) as cost from x""")
def repair_cost_counts(spark, sf):
    """Least edits under a model of nine thousand states: every row too many is one."""
    return Q.repair_cost(Q.Groups(by_type(spark, sf), ["g"], "at", "event_type", compile_model(seq(*UP_TO_14, elem("view", 0, 9000)))))
