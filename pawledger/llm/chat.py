"""Conversations from event logs, and their rendering for training.

An event has conv_id, seq, kind, message, role and text. `message` starts a message, `delta` adds to
it, `edit` puts another text in place of what it has, `regenerate` starts it anew and drops the later
messages (of a greater number) that were there by then. Events of one seq are taken in the order of
(kind, message, role, text); kinds not named here have no effect.

A turn is rendered as `<role>text</turn>` and a newline. Inside roles and texts ~, < and > are
written ~0, ~1 and ~2, so no text can hold a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

END = "</turn>\n"
ESCAPES = (("~", "~0"), ("<", "~1"), (">", "~2"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def folded(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final messages of each conversation.

    A null text counts as an empty one, a null role as the last one the message had, or an empty
    one. Events without a message number form one message before the others. Events without a
    conv_id form one conversation. Repeated events count each. Other columns are ignored; no events
    give no rows.
    """
    columns = ["conv_id", "seq", "kind", "message", "role", "text"]
    number = Window.partitionBy("conv_id").orderBy("seq", "kind", "message", "role", "text")
    rows = events.select(*columns).where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    rows = rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("order", F.row_number().over(number))
    by_message = Window.partitionBy("conv_id").orderBy(F.col("message").cast("long"))
    cut = F.max(F.when(F.col("kind") == "regenerate", F.col("order"))).over(by_message.rangeBetween(Window.unboundedPreceding, -1))
    own = Window.partitionBy("conv_id", "message")
    start = F.max(F.when(F.col("kind") != "delta", F.col("order"))).over(own)
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("start", F.coalesce(start, F.lit(0)))
    live = rows.where("order >= start and order > cut")
    texts = F.sort_array(F.collect_list(F.struct("order", "text")))
    return live.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("order"))), F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda one: one["text"]), "").alias("text"),
    )


def rendered(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, turn_starts, loss_spans: one row for each conversation.

    turn_starts are the places (characters from 0) where turns begin; loss_spans the turn, start and
    end (exclusive) of the texts of the roles trained on.
    """
    mark = F.concat(F.lit("<"), escaped(F.col("role")), F.lit(">"))
    body = escaped(F.col("text"))
    rows = messages.select("conv_id", "message", "role", mark.alias("mark"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("mark", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("message")
    rows = rows.withColumn("turn", F.row_number().over(order) - 1)
    before = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)))
    start = F.col("at") + F.length("mark")
    loss = F.when(F.col("role").isin(*trained), F.struct("turn", start.alias("start"), (start + F.length("body")).alias("end")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "at", "piece")))
    grouped = rows.withColumn("loss", loss).groupBy("conv_id").agg(turns.alias("turns"), F.sort_array(F.collect_list("loss")).alias("loss_spans"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["at"]).alias("turn_starts"),
        "loss_spans",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each), loss_texts (of each span), from the rendered form."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, 2, 1 << 30), ">", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(piece.substr(F.length(role) + 3, F.length(piece))).alias("text"))

    rows = formatted.withColumn("pieces", F.split("formatted", END))
    rows = rows.withColumn("pieces", F.slice("pieces", 1, F.size("pieces") - 1))
    span = lambda s: unescaped(
        F.get("pieces", s["turn"]).substr((s["start"] - F.get("turn_starts", s["turn"]) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    )
    return rows.select(
        "conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.transform("loss_spans", span).alias("loss_texts")
    )


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what is read back."""
    rows = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as events: every row is a message of its own, in order of
    (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", F.col("message").alias("seq"), F.lit("message").alias("kind"), "message", "role", "text")
