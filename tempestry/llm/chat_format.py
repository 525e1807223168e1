"""Chat formatting with Spark expressions only.

Turns are collected per conversation, sorted, merged where neighbours have the same role, and concatenated:

    <|im_start|>role\\ntext<|im_sep|>next text of the same role<|im_end|>\\n

Control strings inside texts are escaped reversibly: every `<` followed by any number of backslashes and `|`
gets one more backslash, so `<|` never occurs within a text. Line ends in roles become `%0A` and `%` becomes
`%25`. The loss mask has one entry (start, length) in code points for each turn, counted from the turn's own
marker (`<|im_start|>` or `<|im_sep|>`); its length is 0 where the turn is not trained on. `read_turns` and
`read_loss` get turns and trained texts back from the formatted string and the mask.

Null texts and roles count as empty. Turns with the same number are ordered by role, then text; a null number
comes first; repeated rows are repeated turns. Rows with a null conv_id form one conversation of their own.
Other columns of the input are not used. A conversation is one string, so it must fit one row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def merged_runs(turns: Column) -> Column:
    """array<struct<role, texts>>: sorted turns, with adjacent ones of the same role in one element."""
    # Where runs begin, then what lies between one beginning and the next: linear in the number of turns.
    at = F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    return F.transform(
        at,
        lambda i, k: F.struct(
            F.element_at(turns, i)["role"].alias("role"),
            F.transform(
                F.slice(turns, i, F.coalesce(F.get(at, k + 1), F.size(turns) + 1) - i), lambda t: t["text"]
            ).alias("texts"),
        ),
    )


def format_chats(conversations: DataFrame, trained=("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation."""
    turn = F.struct(
        F.col("turn"),
        escape_role(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    runs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    runs = runs.select("conv_id", merged_runs(F.col("turns")).alias("runs"))
    formatted = F.array_join(
        F.transform(
            "runs",
            lambda run: F.concat(F.lit(START), run["role"], F.lit("\n"), F.array_join(run["texts"], SEP), F.lit(END + "\n")),
        ),
        "",
    )
    marked = [escape_role(F.lit(role)) for role in trained]
    loss = F.flatten(
        F.transform(
            "runs",
            lambda run: F.transform(
                run["texts"],
                lambda text, k: F.struct(
                    F.when(k == 0, F.length(run["role"]) + F.lit(len(START) + 1)).otherwise(F.lit(len(SEP))).alias("start"),
                    F.when(run["role"].isin(*marked), F.length(text)).otherwise(F.lit(0)).alias("length"),
                ),
            ),
        )
    )
    return runs.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, unescaped."""
    runs = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.length(formatted) + 1)

    def turns(run):
        cut = F.instr(run, "\n")
        role = unescape_role(F.substring(run, F.lit(1), cut - 1))
        body = F.substring(run, cut + 1, F.length(run) - cut - len(END + "\n"))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """array<string>: the texts under the loss mask, unescaped, in order."""
    parts = F.slice(F.split(formatted, r"(?=<\|im_start\|>|<\|im_sep\|>)"), 1, F.size(loss))
    kept = F.filter(F.arrays_zip(parts.alias("part"), loss.alias("mask")), lambda x: x["mask"]["length"] > 0)
    return F.transform(kept, lambda x: unescape(F.substring(x["part"], x["mask"]["start"] + 1, x["mask"]["length"])))
