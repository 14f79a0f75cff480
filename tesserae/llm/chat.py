"""Chat formatting with prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it as context, and only that reply
trainable. A turn is written `<|im_start|>role`, a line feed, the text and `<|im_end|>` with a line feed. A `<|` inside a role or text
is escaped: `<`, any number of backslashes and `|` get one backslash more, so no text can hold a control string and
reading takes the backslash off again. Line feeds and percent signs in roles are written %0A and %25.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows: conv_id, example (number from 0), formatted, loss_start and loss_end (characters of formatted; the reply's escaped text).

    Turns go by number (null: first), then role and text, so ties have a fixed order; repeated rows are turns each. A null text is empty, a null
    role is empty. Where a conversation does not end with a reply, a last example with an empty loss span (both ends null) holds
    all its turns, so nothing is lost. Other columns are not read; an empty table gives no rows.
    """
    head = F.concat(F.lit(START), _escape_role(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"))
    own = turns.select(F.col(conv_id).alias("c"), F.struct(F.col(turn).alias("n"), head.alias("h"), escape(F.coalesce(F.col(text), F.lit(""))).alias("b")).alias("t"))
    gathered = own.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Each turn written out once; an example is the turns up to a reply.
    gathered = gathered.withColumn("parts", F.transform("ts", lambda t: F.concat(t["h"], t["b"], F.lit(END)))).withColumn("size", F.size("ts"))
    trained = START + TRAINED_ROLE + "\n"
    last = F.sequence(F.lit(0), F.col("size") - 1)
    ends = F.filter(last, lambda i: (F.get("ts", i)["h"] == trained) | (i == F.col("size") - 1))
    rows = gathered.select("c", "ts", "parts", F.posexplode(ends).alias("example", "i"))
    body = F.get("ts", F.col("i"))
    rows = rows.select("c", "example", F.concat_ws("", F.slice("parts", F.lit(1), F.col("i") + 1)).alias("formatted"), (body["h"] == trained).alias("reply"), F.char_length(body["b"]).cast("long").alias("n"))
    stop = F.char_length("formatted").cast("long") - len(END)
    return rows.select(F.col("c").alias(conv_id), "example", "formatted", F.when(F.col("reply"), stop - F.col("n")).alias("loss_start"), F.when(F.col("reply"), stop).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            _unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """The trainable text, unescaped; empty where there is none."""
    return F.coalesce(unescape(F.substr(formatted, (loss_start + 1).cast("int"), (loss_end - loss_start).cast("int"))), F.lit(""))
