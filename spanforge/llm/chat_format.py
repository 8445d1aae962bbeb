"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, each time one turn longer. Every conversation gets a rolling
hash of each of its turn prefixes; a conversation whose whole hash is a proper prefix of another one is
anti-joined away, equal conversations keep the smallest conv_id, and what remains is rendered.

The hash of a prefix is the running exclusive-or of two 64-bit hashes of (position, role, text), so it
depends on order, needs no collected arrays, and a window gives it for all prefixes in one sort.
Prefix hashes are made distinct before the anti-join: a first turn shared by a third of all
conversations is one row there. Turns are shuffled once, by conversation; finding the maximal conversations and
rendering them read the same exchange.

Edge cases: turns are ordered by turn, ties by role then text; positions count from 0, so gaps in turn
don't matter; a null role renders as "user", a null text as empty, and for the comparison null differs
from both; rows with a null conv_id belong to one conversation of that id; exactly repeated rows
count as repeated turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The tokens of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def by_conversation(turns: DataFrame) -> DataFrame:
    """The turns dealt by conversation; k holds conv_id, so that a null one is a key like any other."""
    return turns.select(F.struct("conv_id").alias("k"), "turn", "role", "text").repartition("k")


def prefixes(dealt: DataFrame) -> DataFrame:
    """Each turn's position, the two hashes of the prefix that ends with it, and the position of its conversation's end."""
    whole = Window.partitionBy("k")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    here = dealt.withColumn("pos", F.row_number().over(order) - 1)
    term = lambda seed: F.xxhash64(F.lit(seed), "pos", F.coalesce(F.xxhash64(F.lit(seed + 1), "role"), F.lit(0)), F.col("role").isNull(), F.col("text").isNull(), "text")
    here = here.withColumn("t1", term(11)).withColumn("t2", term(23))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = here.withColumn("h1", F.bit_xor("t1").over(so_far)).withColumn("h2", F.bit_xor("t2").over(so_far))
    return here.select("k", "pos", "h1", "h2", F.max("pos").over(whole).alias("end"))


def maximal(turns: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations."""
    p = prefixes(by_conversation(turns) if dealt is None else dealt)
    proper = p.where("pos < end").select("h1", "h2").distinct()
    n_turns = (F.col("pos") + 1).cast("bigint")
    finals = p.where("pos = end").groupBy("h1", "h2").agg(F.min("k.conv_id").alias("conv_id"), F.max(n_turns).alias("n_turns"), F.count("*").alias("n_copies"))
    return finals.join(proper, ["h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, keep: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """One row for each conversation in keep, with its turns rendered in order."""
    dealt = by_conversation(turns) if dealt is None else dealt
    wanted = keep.select(F.struct("conv_id").alias("k"), F.struct("n_turns", "n_copies").alias("about"))
    one = F.struct(
        F.col("turn"), F.col("role"), F.col("text"),
        F.concat(F.lit(START), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END), F.lit("\n")).alias("r"),
    )
    rows = dealt.join(wanted, "k").groupBy("k").agg(F.first("about").alias("about"), F.array_sort(F.collect_list(one)).alias("x"))
    return rows.select("k.conv_id", "about.n_turns", "about.n_copies", F.concat_ws("", "x.r").alias("text"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    dealt = by_conversation(turns)
    return render(turns, maximal(turns, dealt), dealt)


ORACLE_SQL = """
with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as pos from conversations),
p as (select conv_id, pos, md5(string_agg(pos || '|' || case when role is null then 'n' else 'r' || md5(role) end || '|' || case when text is null then 'n' else 't' || md5(text) end, ';')
        over (partition by conv_id order by pos rows between unbounded preceding and current row)) as h from t),
w as (select conv_id, max(pos) as "end" from p group by conv_id),
f as (select p.conv_id, p.h, w."end" + 1 as n_turns from p join w on p.conv_id is not distinct from w.conv_id and p.pos = w."end"),
k as (select h, min(conv_id) as conv_id, max(n_turns) as n_turns, count(*) as n_copies from f group by h),
m as (select * from k where h not in (select p.h from p join w on p.conv_id is not distinct from w.conv_id where p.pos < w."end")),
r as (select conv_id, string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by pos) as text from t group by conv_id)
select m.conv_id, cast(m.n_turns as bigint) as n_turns, cast(m.n_copies as bigint) as n_copies, r.text
from m join r on m.conv_id is not distinct from r.conv_id
"""
