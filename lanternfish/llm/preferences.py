"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as the prompt. The
remaining turns of either are its completion; its mask lists the spans (begin and end in code points of the
completion) of assistant turns' texts with their end marks, which alone count for training.

A conversation becomes one row, so a row is as large as its conversation; groups never hold more than the turns
of one conversation, and partners are found within rings of conversations, dealt by a hash, of about ``TURNS_PER_RING`` turns.

Defined results: null role counts as user and null text as empty; a turn without a conversation's id is a conversation of
its own; repeated turns stay, and turns that tie are ordered by role and text; equal conversations give empty
completions (status same); a prompt may be empty (status apart); a null array has no turns; turns of any length are kept
whole; an empty table gives no rows; ids may be of any type that casts to text; other columns pass through ``format_pairs``,
except that output names win over equal names, and are ignored elsewhere. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import number_from_md5, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_RING = 4096


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the turns of each conversation in order, as an array of (role, text)."""
    name = F.col(f"`{key}`")
    row = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(name.alias("_key"), row.alias("_turn"))
    said = rows.where("_key is not null").groupBy("_key").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    said = said.unionByName(rows.where("_key is null").select("_key", F.array("_turn").alias("_turns")))
    return said.select(F.col("_key").alias(key), F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE + "\n"))), "")


def mask(turns: Column) -> Column:
    """Spans of assistant texts in the rendered turns, as begin-end joined by commas."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + 1).cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


_TURNS = "array<struct<role:string,text:string>>"


def format_pairs(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """Replace two arrays of (role, text) turns by the prompt, both completions, their masks and a status."""
    made = ["n_prefix_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", "status"]
    kept = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected, *made)]
    none = F.array().cast(_TURNS)
    rows = pairs.select(F.struct(*kept).alias("_kept") if kept else F.lit(None).alias("_kept"), *[F.coalesce(F.col(f"`{c}`"), none).alias(n) for c, n in ((chosen, "_a"), (rejected, "_b"))])
    a, b = F.col("_a"), F.col("_b")
    same = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x["a"].eqNullSafe(x["b"]), 1).otherwise(0)).alias("n"), (s["on"] & x["a"].eqNullSafe(x["b"])).alias("on")), lambda s: s["n"])
    rest = rows.withColumn("_n", same)
    n = F.col("_n")
    tail = {name: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0))) for name, c in (("chosen", a), ("rejected", b))}
    status = F.when((F.size(a) == n) & (F.size(b) == n), "same").when(n == 0, "apart").otherwise("pair")
    values = [n.cast("bigint"), render(F.slice(a, 1, n)), render(tail["chosen"]), render(tail["rejected"]), mask(tail["chosen"]), mask(tail["rejected"]), status]
    own = [F.col(f"_kept.`{c}`").alias(c) for c in pairs.columns if c not in (chosen, rejected, *made)]
    return rest.select(*own, *[v.alias(name) for name, v in zip(made, values)])


def with_borrowed_reply(said: DataFrame, key: str = "conv_id", rings: int = 1) -> DataFrame:
    """Pair each conversation with itself, its last assistant turn answered by its neighbour's last one.

    Conversations are dealt to rings by a hash of id, or of the turns where there is none; the neighbour is the next id in
    the ring, after the last the first. A conversation without an assistant turn, or whose neighbour has none, is
    paired with itself as it is.
    """
    name = F.col(f"`{key}`")
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i).otherwise(F.lit(-1))))
    rows = said.select(name.alias("_key"), "turns", at.alias("at"), F.pmod(number_from_md5(F.coalesce(name.cast("string"), F.to_json("turns"))), F.lit(rings)).alias("ring"))
    rows = rows.withColumn("reply", F.when(F.col("at") >= 0, F.get("turns", F.col("at"))["text"]))
    ring = Window.partitionBy("ring").orderBy("_key", "turns")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("borrowed", F.when(F.lead(F.lit(1)).over(ring).isNotNull(), F.lead("reply").over(ring)).otherwise(F.first("reply").over(whole)))
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when((i == F.col("at")) & F.col("borrowed").isNotNull(), F.col("borrowed")).otherwise(t["text"]).alias("text")))
    return rows.select(F.col("_key").alias(key), F.col("turns").alias("chosen_turns"), swapped.alias("rejected_turns"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_pairs(with_borrowed_reply(conversations(turns), rings=max(1, turns.count() // TURNS_PER_RING)))


#: For tables in which every turn has its conversation's id.
OP3_SQL = f"""
with t as (select conv_id, coalesce(role, 'user') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn, role, text) as i from conversations),
l as (select conv_id, max(case when role = 'assistant' then i end) as at_, count(*) as n, ('0x' || substr(md5(conv_id::varchar), 1, 15))::bigint % greatest(1, (select count(*) from conversations) // {TURNS_PER_RING}) as ring from t group by conv_id),
r as (select l.conv_id, l.n, l.at_, l.ring, t.text as reply from l left join t on t.conv_id = l.conv_id and t.i = l.at_),
b as (select *, case when lead(1) over w is not null then lead(reply) over w
    else first_value(reply) over (partition by ring order by conv_id rows between unbounded preceding and unbounded following) end as borrowed
  from r window w as (partition by ring order by conv_id)),
p as (select b.conv_id, b.n, b.at_, b.reply, b.borrowed,
    case when b.at_ is null or b.borrowed is null or b.borrowed = b.reply then b.n else b.at_ - 1 end as k from b),
x as (select t.conv_id, t.i, t.role, t.text as own, case when t.i = p.at_ and p.borrowed is not null then p.borrowed else t.text end as other, p.k from t join p using (conv_id)),
y as (select *, '<|im_start|>' || role || chr(10) as head,
    '<|im_start|>' || role || chr(10) || own || '<|im_end|>' || chr(10) as a,
    '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) as b from x),
z as (select *, coalesce(sum(case when i > k then length(a) end) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) + length(head) as sa,
    coalesce(sum(case when i > k then length(b) end) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) + length(head) as sb from y)
select conv_id, max(k)::bigint as n_prefix_turns,
  coalesce(string_agg(a, '' order by i) filter (i <= k), '') as prompt,
  coalesce(string_agg(a, '' order by i) filter (i > k), '') as chosen,
  coalesce(string_agg(b, '' order by i) filter (i > k), '') as rejected,
  coalesce(string_agg(sa::varchar || '-' || (sa + length(own) + 10)::varchar, ',' order by i) filter (i > k and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(sb::varchar || '-' || (sb + length(other) + 10)::varchar, ',' order by i) filter (i > k and role = 'assistant'), '') as rejected_mask,
  case when max(k) = count(*) then 'same' when max(k) = 0 then 'apart' else 'pair' end as status
from z group by conv_id
"""
