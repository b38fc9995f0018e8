"""Chat formatting with Spark expressions alone, and reading it back.

Turns are collected as structs in chunks of a conversation, sorted, and
adjacent turns of one role become one block; the chunks of a conversation are
then joined the same way, so a long conversation is never one group of rows.

    <s>[INST]first user turn[NEXT]second in a row[/INST]answer[INST]more ... </s>

``[INST]`` opens a block of the user, ``[/INST]`` of the assistant, ``[SYS]`` of
the system, ``[ROLE]name[/ROLE]`` of anyone else; ``[NEXT]`` parts the turns of a
block.  A control string inside a text gets a backslash after its first
character, and so does one that has backslashes there already, which is undone
by taking one away: texts come back as they were.  Only turns of the assistant
are under the loss mask, their control strings are not.

Cases: a null text is empty and a null role is the empty role; a text of any
length is one turn; turns are sorted
by turn, role and text, nulls first, so ties have one order; repeated rows are
repeated turns; a null conversation id is a conversation; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns that are collected at once.
CHUNK_TURNS = 64
#: The control strings of the template.
OPENERS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
BEGIN, END, NEXT, ROLE, ROLE_END = "<s>", "</s>", "[NEXT]", "[ROLE]", "[/ROLE]"
TRAINED = "assistant"
#: A control string between its first character and the rest of it.
_TAIL = r"(/?s>|/?INST\]|SYS\]|NEXT\]|/?ROLE\])"
#: What opens a block.
OPENING = r"\[/?INST\]|\[SYS\]|(?s:\[ROLE\].*?\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAIL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_TAIL}", r"$1$2$3")


def _opener(role: Column) -> Column:
    out = F.concat(F.lit(ROLE), escape(role), F.lit(ROLE_END))
    for name, control in OPENERS.items():
        out = F.when(role == name, F.lit(control)).otherwise(out)
    return out


def _body(blocks: Column) -> Column:
    """Sorted blocks as one text that lacks the opener of the first; those of one role beside each other are merged.

    A block has ``first`` and ``last``, its outer roles, and such a ``body``.
    """

    def place(block: Column, i: Column) -> Column:
        before = F.get(blocks, i - 1)["last"]
        opener = F.when(i == 0, F.lit("")).when(before == block["first"], F.lit(NEXT)).otherwise(_opener(block["first"]))
        return F.concat(opener, block["body"])

    return F.array_join(F.transform(blocks, place), "")


def format_conversations(turns: DataFrame, *, chunk: int = CHUNK_TURNS) -> DataFrame:
    """``conv_id`` and ``formatted`` of all conversations of (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / chunk).alias("chunk"), turn.alias("turn"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    one = F.transform("turns", lambda t: F.struct(t["role"].alias("first"), t["role"].alias("last"), escape(t["text"]).alias("body")))
    chunks = chunks.select("conv_id", "chunk", one.alias("b"))
    block = F.struct("chunk", F.get("b", F.lit(0))["first"].alias("first"), F.element_at("b", -1)["last"].alias("last"), _body(F.col("b")).alias("body"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return whole.select("conv_id", F.concat(F.lit(BEGIN), _opener(F.get("b", F.lit(0))["first"]), _body(F.col("b")), F.lit(END)).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with its ``turns`` and its ``loss_mask``.

    The mask has an entry for each turn: the characters of control strings
    before its text, those of the text as it stands, and whether that is
    trained on.
    """
    inside = F.substr("formatted", F.lit(len(BEGIN) + 1), F.char_length("formatted") - len(BEGIN + END))
    split = formatted.withColumn("__in", inside)
    split = split.withColumns({"__open": F.regexp_extract_all("__in", F.lit(f"({OPENING})"), F.lit(1)), "__body": F.split("__in", OPENING, -1)})
    role = lambda o: unescape(F.substr(o, F.lit(len(ROLE) + 1), F.char_length(o) - len(ROLE + ROLE_END)))

    def named(opener: Column) -> Column:
        out = role(opener)
        for name, control in OPENERS.items():
            out = F.when(opener == control, F.lit(name)).otherwise(out)
        return out

    blocks = F.zip_with("__open", F.slice("__body", 2, F.size("__body")), lambda o, p: F.struct(o.alias("opener"), named(o).alias("role"), F.split(p, r"\[NEXT\]", -1).alias("texts")))
    split = split.withColumn("__blocks", blocks)
    turns = F.flatten(F.transform("__blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    mask = F.flatten(
        F.transform(
            "__blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.char_length(b["opener"])).otherwise(len(NEXT)).alias("control_chars"), F.char_length(t).alias("chars"), (b["role"] == TRAINED).alias("trained")
                ),
            ),
        )
    )
    return split.select(*formatted.columns, turns.alias("turns"), mask.alias("loss_mask"))


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the formatting contract, all read back from ``formatted``."""
    read = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.filter(F.arrays_zip("turns", "loss_mask"), lambda z: z["loss_mask"]["trained"])
    loss = F.array_join(F.transform(under, lambda z: z["turns"]["text"]), "")
    read = read.select("conv_id", "formatted", "turns", said.alias("said"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
