"""Chat sessions as an append-only table (session, turn, role, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import squeezed


def summaries(turns: DataFrame) -> DataFrame:
    """Messages, turns of the user and last turn of each session."""
    return turns.groupBy("session").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"))


def history(turns: DataFrame, most: int = 6) -> DataFrame:
    """The last messages of user and assistant of each session, in order."""
    w = Window.partitionBy("session").orderBy(F.desc("turn"))
    return turns.where(F.col("role").isin("user", "assistant")).withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)


def titles(turns: DataFrame, most: int = 60) -> DataFrame:
    """A title from the first user message: cut at a word within `most` characters."""
    first = turns.where(F.col("role") == "user").groupBy("session").agg(F.min_by("content", "turn").alias("content"))
    flat = squeezed(F.col("content"))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    return first.select("session", F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("..."))).alias("title"))


def nested(turns: DataFrame) -> DataFrame:
    """One row for each session with its messages in order, as a document."""
    return turns.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))


def latest(turns: DataFrame) -> DataFrame:
    """The last message of each session."""
    return turns.groupBy("session").agg(F.max_by(F.struct("turn", "role", "content"), "turn").alias("m")).select("session", "m.*")


def slug(title: F.Column) -> F.Column:
    """A file name from a title."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(title), r"[^\p{L}\p{N}_-]+", "_"), r"^_+|_+$", ""), 1, 40)


DEFAULT_TITLE = "Cuộc trò chuyện"


def created(session: F.Column, time: F.Column, title: str = f"{DEFAULT_TITLE} mới") -> list[F.Column]:
    """Columns of the log's row that opens a session."""
    return [session.alias("session"), F.lit("created").alias("event"), time.alias("time"), F.lit(None).cast("string").alias("role"), F.lit(title).alias("content")]


def said(session: F.Column, time: F.Column, role: F.Column, content: F.Column) -> list[F.Column]:
    """Columns of the log's row of a message."""
    return [session.alias("session"), F.lit("message").alias("event"), time.alias("time"), role.alias("role"), content.alias("content")]


def renamed(session: F.Column, time: F.Column, title: F.Column) -> list[F.Column]:
    """Columns of the log's row that renames a session; a title has 80 characters at most."""
    named = F.substring(F.trim(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))), 1, 80)
    return [session.alias("session"), F.lit("renamed").alias("event"), time.alias("time"), F.lit(None).cast("string").alias("role"), named.alias("content")]


def deleted(session: F.Column, time: F.Column) -> list[F.Column]:
    """Columns of the log's row that deletes a session."""
    none = F.lit(None).cast("string")
    return [session.alias("session"), F.lit("deleted").alias("event"), time.alias("time"), none.alias("role"), none.alias("content")]


def state(log: DataFrame) -> DataFrame:
    """The sessions that aren't deleted: session, title, created, updated, n_messages. log: (session, event, time, role, content).

    A session is what its rows say, so nothing is rewritten. A session that nobody named goes by its first user message.
    """
    is_ = lambda e: F.col("event") == e
    first = F.min(F.when(is_("message") & (F.col("role") == "user"), F.struct("time", "content")))["content"]
    name = F.max(F.when(is_("renamed") | (is_("created") & ~F.coalesce(F.col("content"), F.lit("")).startswith(DEFAULT_TITLE)), F.struct("time", "content")))["content"]
    opened = F.min(F.when(is_("created"), F.struct("time", "content")))["content"]
    flat = squeezed(F.col("first"))
    cut = F.when(F.length(flat) <= 60, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, 60), r"\s+\S*$", ""), F.lit("...")))
    told = log.groupBy("session").agg(
        first.alias("first"), name.alias("name"), opened.alias("opened"), F.min("time").alias("created"), F.max("time").alias("updated"),
        F.count_if(is_("message")).alias("n_messages"), F.count_if(is_("deleted")).alias("gone"),
    )
    title = F.coalesce("name", F.when(F.col("first").isNotNull(), cut), "opened", F.lit("Untitled"))
    return told.where("gone = 0").select("session", title.alias("title"), "created", "updated", "n_messages")


def listed(states: DataFrame, by: str = "updated", most: int = 15) -> DataFrame:
    """The first sessions: those updated or created last, or by title; ties by session."""
    return states.orderBy(F.col("title") if by == "title" else F.desc(by), "session").limit(most)
