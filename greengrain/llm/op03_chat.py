"""Chat formatting after collapsing cumulative snapshots of one conversation.

A log that writes a conversation after every turn holds each shorter state as a prefix of a longer one. Every
conversation gets a chain of prefix hashes, one per turn, each rolled forward from the one before. A conversation
whose last hash is an inner hash of another one is a snapshot; an anti-join against the distinct inner hashes keeps
the maximal ones, and only those are rendered. Equal conversations keep the smallest conv_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.staging import stage

# The markup of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def clean_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with defaults for missing values."""
    role = F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))))
    text = F.trim(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"),
                                                     F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, a, b): two 64-bit hashes of the first k turns, rolled forward by one turn each.

    A turn is hashed with its place, and the running xor of these is the prefix. A window holds one conversation,
    which becomes one rendered row anyway.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("k", F.row_number().over(order)).withColumns(
        {"x": F.xxhash64("k", "role", "text"), "y": F.xxhash64("text", "role", "k")})
    return placed.select("conv_id", "k", F.bit_xor("x").over(so_far).alias("a"), F.bit_xor("y").over(so_far).alias("b"))


def collapsed(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, state) for every conversation of (conv_id, turn, role, text).

    state is `maximal`, `snapshot` (a longer conversation starts with it) or `copy` (an equal one has a smaller
    conv_id). Turns follow the order of (turn, role, text), NULL first. Roles are compared in lower case, texts
    without outer blanks; a NULL role is `unknown`, a NULL text empty. Repeated rows are turns of their own. Rows
    without conv_id belong to no conversation and are left out. An empty table gives no rows; further columns are
    not read.
    """
    chain = stage(prefix_hashes(clean_turns(turns)), "prefixes")
    ends = chain.groupBy("conv_id").agg(F.max(F.struct("k", "a", "b")).alias("end"))
    ends = ends.select("conv_id", "end.*")
    inner = chain.join(ends.select("conv_id", F.col("k").alias("n")), "conv_id").where("k < n").select("k", "a", "b").distinct()
    first = ends.groupBy("k", "a", "b").agg(F.min("conv_id").alias("first"))
    maximal = first.join(inner, ["k", "a", "b"], "left_anti")
    state = F.when(F.col("first").isNull(), "snapshot").when(F.col("conv_id") == F.col("first"), "maximal").otherwise("copy")
    return ends.join(maximal, ["k", "a", "b"], "left").select("conv_id", F.col("k").cast("long").alias("n_turns"), state.alias("state"))


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, state, chat): chat is the marked-up conversation, NULL unless it is maximal."""
    states = stage(collapsed(turns), "states")
    wanted = clean_turns(turns).join(states.where("state = 'maximal'").select("conv_id"), "conv_id", "left_semi")
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    chats = wanted.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), one), "").alias("chat"))
    return states.join(chats, "conv_id", "left").select("conv_id", "n_turns", "state", "chat")


SQL = """
with t as (select conv_id, turn, lower(trim(coalesce(role, 'unknown'), ' ')) as role, trim(coalesce(text, ''), ' ') as text
  from conversations where conv_id is not null),
m as (select *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as piece,
  row_number() over (partition by conv_id order by turn nulls first, role, text) as k from t),
p as (select conv_id, k, md5(string_agg(piece, '') over (partition by conv_id order by k)) as prefix,
  count(*) over (partition by conv_id) as n from m),
e as (select conv_id, n, prefix from p where k = n),
s as (select e.conv_id, e.n as n_turns, case when e.prefix in (select prefix from p where k < n) then 'snapshot'
  when e.conv_id = min(e.conv_id) over (partition by e.prefix) then 'maximal' else 'copy' end as state from e),
c as (select conv_id, string_agg(piece, '' order by k) as chat from m group by conv_id)
select s.conv_id, n_turns, state, case when state = 'maximal' then md5(chat) end as chat_md5
from s join c using (conv_id)"""
