"""Cumulative-snapshot collapse of logged conversations, and their rendering, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is rendered. Fixed values of the chat markup.
TURN_OPEN, TURN_MIDDLE, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Salts of the two hashes that stand for a turn: 128 bits in all.
_SALTS = ("turn", "again")


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns as (conv, turn, role, text): null role or text counts as empty; rows without a conversation id are left out;
    rows that repeat all four count once."""
    cols = [F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    return df.select(*cols).where("conv is not null")


def prefix_hashes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, nr, n, p, q): for each turn, numbered from 1 in its conversation of n, the rolling hashes of all
    turns up to it.

    A turn's hash covers its number, role and text, so the exclusive-or of a prefix's hashes tells the prefix. Turns go
    by turn number (nulls first), then role and text hash. Only hashes are shuffled, and a window runs over them.
    """
    text = [F.xxhash64(F.lit(s), "role", "text") for s in _SALTS]
    own = _turns(df, conv_col, turn_col, role_col, text_col).select("conv", "turn", text[0].alias("a"), text[1].alias("b")).distinct()
    order = Window.partitionBy("conv").orderBy("turn", "a", "b")
    numbered = own.withColumn("nr", F.row_number().over(order))
    hashed = numbered.select("conv", "turn", "a", "b", "nr", F.xxhash64("nr", "a").alias("x"), F.xxhash64("b", "nr").alias("y"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.withColumns({"p": F.bit_xor("x").over(upto), "q": F.bit_xor("y").over(upto)})
    return rolled.withColumn("n", F.count("*").over(Window.partitionBy("conv"))).select("conv", "turn", "a", "b", "nr", "n", "p", "q")


def maximal(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, n_turns, n_copies): conversations that are no proper prefix of another; of equal ones the least id.

    Prefix hashes are made distinct before the anti-join, so copies of a conversation or of a first turn meet once.
    """
    steps = prefix_hashes(df, conv_col, turn_col, role_col, text_col)
    whole = steps.where("nr = n").groupBy("n", "p", "q").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = steps.where("nr < n").select(F.col("nr").cast("long").alias("k"), F.col("p").alias("kp"), F.col("q").alias("kq")).distinct()
    kept = whole.join(inner, (F.col("n") == F.col("k")) & (F.col("p") == F.col("kp")) & (F.col("q") == F.col("kq")), "left_anti")
    return kept.select("conv", F.col("n").alias("n_turns"), "n_copies")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), role, F.lit(TURN_MIDDLE), text, F.lit(TURN_CLOSE))


def render(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_col, n_turns, n_copies, chat): every maximal conversation in chat markup.

    n_copies counts the logged conversations equal to it, itself included. Null role or text renders as empty; a null
    turn comes first; turns under one number go by the hash of role and text; repeated rows count once; rows with a null
    conversation id are left out, other columns ignored. An empty table gives none. One row holds one conversation, as
    the chat string does; the texts of collapsed conversations are never shuffled twice.
    """
    kept = maximal(df, conv_col, turn_col, role_col, text_col)
    turns = _turns(df, conv_col, turn_col, role_col, text_col)
    text = [F.xxhash64(F.lit(s), "role", "text") for s in _SALTS]
    parts = turns.select("conv", F.struct("turn", text[0].alias("a"), text[1].alias("b"), _rendered(F.col("role"), F.col("text")).alias("s")).alias("t"))
    chats = parts.join(kept, "conv").groupBy("conv", "n_turns", "n_copies").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    chat = F.array_join(F.transform("ts", lambda t: t["s"]), "")
    return chats.select(F.col("conv").alias(conv_col), "n_turns", "n_copies", chat.alias("chat"))


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for ``render``: prefixes compared as whole lists."""
    return f"""
        WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table} WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS ts FROM turns GROUP BY conv_id),
        kinds AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM convs GROUP BY ts),
        inner_ AS (SELECT DISTINCT ts[1:k] AS ts FROM kinds, unnest(range(1, len(ts))) AS r(k))
        SELECT conv_id, len(ts)::BIGINT AS n_turns, n_copies, list_aggregate(ts, 'string_agg', '') AS chat
        FROM kinds WHERE ts NOT IN (SELECT ts FROM inner_)
    """
