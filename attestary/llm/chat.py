"""Chat formatting as a relational job: Spark expressions only.

A formatted conversation is a sequence of blocks, one for each run of turns of one role:

    ### <role>:\\n<text></turn><text></turn>\\n

Texts and roles are escaped so that control strings never occur inside them, and so that unescaping gives back every
text: a backslash becomes \\e, `### ` \\h and `</turn>` \\c; in roles also a line break \\n and a colon \\d. Each backslash of
an escaped text then starts a code of two characters, so replacing the codes one kind at a time is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
_CODES = (("\\", "\\e"), (HEAD, "\\h"), (END, "\\c"))
_ROLE_CODES = (*_CODES, ("\n", "\\n"), (":", "\\d"))


def escape(text: Column, codes=_CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=_CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role, _ROLE_CODES), F.lit(":\n"))


def _run(chars: Column, loss: bool) -> Column:
    return F.struct(chars.cast("long").alias("chars"), F.lit(loss).alias("loss"))


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, mask array<struct<chars, loss>>).

    mask: run lengths over formatted in code points; loss is true on the escaped texts of the role `trained` alone, not
    on the marks between them. Turns sort by turn (null first), then role and text, so ties have one order; null texts
    and roles count as empty; repeated rows are turns of their own; null conv_ids are one conversation; an empty table
    gives an empty result."""
    rows = turns.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # places where a run of one role starts; the runs are slices between them
    starts = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("t", s)["role"].alias("role"),
            F.transform(
                F.slice("t", s + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - s), lambda x: escape(x["text"])
            ).alias("texts"),
        ),
    )
    talks = talks.withColumn("starts", starts).select("conv_id", blocks.alias("blocks"))
    body = lambda b: _joined(F.transform(b["texts"], lambda x: F.concat(x, F.lit(END))))
    formatted = _joined(F.transform("blocks", lambda b: F.concat(_head(b["role"]), body(b), F.lit("\n"))))
    mask = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.when(
                b["role"] == trained,
                F.concat(
                    F.array(_run(F.length(_head(b["role"])), False)),
                    F.flatten(F.transform(b["texts"], lambda x: F.array(_run(F.length(x), True), _run(F.lit(len(END)), False)))),
                    F.array(_run(F.lit(1), False)),
                ),
            ).otherwise(F.array(_run(F.length(_head(b["role"])) + F.length(body(b)) + 1, False))),
        )
    )
    return talks.select("conv_id", formatted.alias("formatted"), mask.alias("mask"))


def read_conversations(formatted: DataFrame, trained: str = "assistant") -> DataFrame:
    """What format_conversations gives -> (conv_id, turns array<struct<role, text>>, loss_text, formatted), parsed back
    from the formatted text alone; loss_text is what lies under the mask, unescaped. A mask whose runs are not just the
    trained role's texts is an error."""
    blocks = F.filter(F.split("formatted", HEAD), lambda b, i: i > 0)
    parsed = F.flatten(
        F.transform(
            F.transform(
                blocks,
                lambda b: F.struct(
                    F.substring_index(b, ":\n", 1).alias("role"),
                    # the piece behind the last mark is the block's closing line break
                    F.split(b, END).alias("pieces"),
                ),
            ),
            lambda b: F.transform(
                F.slice(b["pieces"], 1, F.size(b["pieces"]) - 1),
                lambda x, i: F.struct(
                    b["role"].alias("role"),
                    F.when(i == 0, x.substr(F.length(b["role"]) + 3, F.length(x))).otherwise(x).alias("text"),
                ),
            ),
        )
    )
    out = formatted.withColumn("parsed", parsed)
    own = F.filter("parsed", lambda x: unescape(x["role"], _ROLE_CODES) == trained)
    runs = F.transform(F.filter("mask", lambda m: m["loss"]), lambda m: m["chars"])
    out = out.withColumn("own", F.transform(own, lambda x: x["text"]))
    agrees = F.transform("own", lambda x: F.length(x).cast("long")) == runs
    loss = F.when(agrees, _joined(F.transform("own", lambda x: unescape(x)))).otherwise(F.raise_error(F.lit("the mask is not over the trained texts")).cast("string"))
    turns = F.transform("parsed", lambda x: F.struct(unescape(x["role"], _ROLE_CODES).alias("role"), unescape(x["text"]).alias("text")))
    return out.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")
