"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the template of all turns
before it as context, then that reply, which alone is trainable.  Turns after
the last reply go into one more example without a trainable part, so that no
turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Breaks every ``<|`` by one more backslash than stands there; reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Inverse of escape."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    """Roles stand before the first line break of a turn, so breaks are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    broken = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(broken, F.lit("\\\\"), F.lit("\\"))


def expand(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), of, text, loss_start, loss_end.

    ``of`` is how many examples the conversation has, ``text`` the formatted
    turns up to the example's own, ``loss_start`` and ``loss_end`` the code points
    of text that are trainable, which is the escaped reply; both equal the length
    where nothing is.  The last example holds every turn.

    Turns sort by turn, then role and text; null turns come first.  A null role
    or text counts as empty.  Rows with a null conv_id are one conversation, as
    in a GROUP BY.  Repeated rows are repeated turns; other columns are ignored;
    an empty table gives an empty result.  A row is as long as its conversation
    up to that turn, so all rows together grow with the square of the turns:
    that is what the expansion is.
    """
    kept = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(F.lit(OPEN), _escape_role(t.role), F.lit("\n"), escape(t.text), F.lit(CLOSE + "\n")))
    # code points of the reply of an assistant's turn, null of others
    reply = F.transform("turns", lambda t: F.when(t.role == "assistant", F.length(escape(t.text))))
    staged = whole.select("conv_id", piece.alias("pieces"), reply.alias("replies"))
    n = F.size("replies")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("replies", i).isNotNull() | (i == n - 1))
    each = staged.select("conv_id", "pieces", "replies", F.size(targets).alias("of"), F.posexplode(targets).alias("example", "at"))
    made = each.select("conv_id", "example", "of", F.array_join(F.slice("pieces", F.lit(1), F.col("at") + 1), "").alias("text"), F.get("replies", F.col("at")).alias("reply"))
    end = F.length("text") - F.when(F.col("reply").isNotNull(), len(CLOSE) + 1).otherwise(0)
    return made.select("conv_id", "example", "of", "text", (end - F.coalesce("reply", F.lit(0))).cast("bigint").alias("loss_start"), end.cast("bigint").alias("loss_end"))


def parse(text: Column) -> Column:
    """Turns (role, text) read back from a formatted example."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>"), lambda p: p != "")
    head = lambda p: F.instr(p, "\n")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring(p, F.lit(1), head(p) - 1)).alias("role"),
            unescape(F.substring(p, head(p) + 1, F.length(p) - head(p) - (len(CLOSE) + 1))).alias("text"),
        ),
    )
