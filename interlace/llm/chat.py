"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts (kind, text, ref, tokens). Text parts are escaped; image,
audio and document parts become numbered placeholders, each with a record of the attachment and
of the tokens that it expands to. Conversations are one string each, which reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,tokens:long>"


def escape(text: Column) -> Column:
    """No '<' is left, so no marker can stand in a text; '&' first, so that it reads back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_parts(turns: DataFrame) -> DataFrame:
    """Rows of plain text as turns with one text part; null text is empty."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array(part).alias("parts"))


def visit(parts: Column) -> Column:
    """The content of a turn: texts escaped, other parts as placeholders numbered within the turn."""

    def one(part: Column, i: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), i.cast("string"), F.lit("|>"))
        return F.when(part["kind"].isin(*KINDS), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    return F.array_join(F.transform(parts, one), "")


def flatten(turns: DataFrame) -> DataFrame:
    """Each turn with its content, attachments (place, kind, ref, tokens) and their token count."""
    others = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"))), lambda p: p["kind"].isin(*KINDS))
    total = F.aggregate(others, F.lit(0).cast("long"), lambda n, p: n + p["tokens"])
    return turns.select("conv_id", "turn", "role", visit(F.col("parts")).alias("content"), others.alias("attachments"), total.alias("attachment_tokens"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant contents in it, in code points), attachments, attachment_tokens.

    ``turns`` has conv_id, turn, role and parts. Turns are ordered by number; ties go by role and
    content, repeated rows stay. Null roles, texts and parts are empty. A null conv_id is a
    conversation of its own. Other columns are ignored.
    """
    flat = flatten(turns)
    head = F.concat(F.lit(OPEN), F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    flat = flat.withColumn("row", F.concat(head, F.coalesce("content", F.lit("")), F.lit(CLOSE))).withColumn("head", F.length(head))
    row = F.struct("turn", "role", "row", "head", "attachments", "attachment_tokens")
    chats = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # spans: a running total of lengths over the turns
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def add(state: Column, r: Column) -> Column:
        size = F.length(r["row"]).cast("long")
        span = F.struct((state["at"] + r["head"]).cast("long").alias("start"), (size - r["head"] - len(CLOSE)).cast("long").alias("length"))
        spans = F.when(r["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    return chats.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["row"]), "").alias("formatted"),
        F.aggregate("rows", zero, add)["spans"].alias("loss"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["turn"].alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["attachment_tokens"]).alias("attachment_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id and turns (role, content), parsed from ``formatted`` alone."""
    rows = F.split("formatted", r"<\|end\|>\n", -1)

    def turn(r: Column) -> Column:
        role = F.substring_index(F.substring(r, len(OPEN) + 1, 2**31 - 1), "\n", 1)
        content = F.substring(r, (F.length(role) + len(OPEN) + 2).cast("int"), F.length(r).cast("int"))
        return F.struct(unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(content).alias("content"))

    return chats.withColumn("turns", F.transform(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), turn))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings hold: turns, and the text under the loss mask."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return read_back(chats).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
