"""Chat formatting by DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; an array
aggregation merges neighbours of one role into one block, whose parts stay
apart by a control string. A block is

    <|im role|>text<|and|>text<|end|>

each on a line of its own. Inside texts and roles every `<|`, also with
backslashes between both characters, gets one more backslash there, so control
strings never occur in a text and the way back takes one away; in roles `|>` is
escaped alike.

`format_chats` returns conv_id, formatted and mask, an array of
`(begin, length)` in code points (from 0) of the parts that count for the loss:
the texts of `loss_role`. `read_chats` reads turns and masked texts back from
these two columns alone.

Edge cases: null texts and roles count as empty; turns with one number are
ordered by role, then text, as they are before escaping; rows that repeat are
turns of their own; null conversation ids form one conversation; an empty table
gives none. Extra columns are ignored. Work grows in proportion to a
conversation's length, whatever its number of turns; the conversation has to fit
into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OPEN, _NAMED, _AND, _END = "<|im ", "|>", "<|and|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _named(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def _unnamed(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def _blocks(turns: Column, begins: Column) -> Column:
    """Arrays of (role, parts): neighbours of one role merge. Both arguments are
    columns; an expression would be computed for each element of a lambda."""
    return F.transform(begins, lambda i, n: F.struct(turns[i]["role"].alias("role"), F.transform(F.slice(turns, i + 1, F.coalesce(F.get(begins, n + 1), F.size(turns)) - i), lambda t: t["text"]).alias("parts")))


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    whole = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), whole(role_col).alias("role"), whole(text_col).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    safe = chats.select("conv_id", F.transform("turns", lambda t: F.struct(_named(t["role"]).alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    turns = F.col("turns")
    begins = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
    merged = safe.select("conv_id", "turns", begins.alias("begins")).select("conv_id", _blocks(turns, F.col("begins")).alias("blocks"))
    # pieces in order, each with whether it counts for the loss
    piece = lambda text, loss: F.struct(text.alias("s"), loss.alias("loss"))
    mine = _named(F.lit(loss_role))

    def pieces(b: Column) -> Column:
        head = F.array(piece(F.concat(F.lit(_OPEN), b["role"], F.lit(_NAMED)), F.lit(False)))
        parts = F.flatten(F.transform(b["parts"], lambda p, i: F.filter(F.array(piece(F.when(i > 0, F.lit(_AND)).otherwise(F.lit("")), F.lit(False)), piece(p, b["role"] == mine)), lambda x: x["loss"] | (F.length(x["s"]) > 0))))
        return F.concat(head, parts, F.array(piece(F.lit(_END), F.lit(False))))

    # where each piece begins is a running sum over the pieces of its conversation,
    # which lie together already; an array can't hold one without copying it a piece
    flat = merged.select("conv_id", F.posexplode(F.flatten(F.transform("blocks", pieces))).alias("i", "p")).select("conv_id", "i", "p.s", "p.loss", F.length("p.s").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    back = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "s", "loss", "begin", "n"))).alias("p"))
    return back.select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["begin"].alias("begin"), x["n"].alias("length"))).alias("mask"))


#: Code points of the cuts in which masked parts are looked up; a part found from
#: the start of the text each time would make long conversations quadratic.
_CUT = 256


def read_chats(df: DataFrame) -> DataFrame:
    """Turns `(role, text)` and masked texts, read back from formatted and mask."""
    split = F.split(F.col("formatted"), r"<\|end\|>\n")
    cut = df.select("conv_id", "formatted", "mask", split.alias("b"), F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0)).alias("cuts"))
    blocks = F.slice("b", 1, F.size("b") - 1)

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substring(b, len(_OPEN) + 1, 2**31 - 1), _NAMED, 1)
        body = F.length(role) + len(_OPEN) + len(_NAMED) + 1
        return F.transform(F.split(F.substr(b, body), r"<\|and\|>"), lambda t: F.struct(_unnamed(role).alias("role"), unescaped(t).alias("text")))

    def part(m: Column) -> Column:
        first, last = F.floor(m["begin"] / _CUT).cast("int"), F.floor((m["begin"] + m["length"]) / _CUT).cast("int")
        # a column that is named twice is not computed inside the lambda
        near = F.array_join(F.slice(F.col("cuts"), first + 1, F.least(last + 1, F.size("cuts")) - first), "")
        return unescaped(F.substr(near, m["begin"] % _CUT + 1, m["length"]))

    return cut.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.transform("mask", part).alias("loss_texts"))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    back = read_chats(format_chats(chats.unionByName(more)))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
