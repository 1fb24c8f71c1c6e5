"""Event-sourced chats: logs folded into final messages, rendered to training text, and read back.

All steps are DataFrame functions. An event log has a row (conv_id, seq, kind, msg, role, text) for each event:
``start`` opens message ``msg`` with its role and a first piece of text, ``delta`` appends to it, ``edit`` replaces
the text so far, ``regenerate`` empties it so that later deltas start anew. Ties in seq are broken by kind and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Escapes, in the order in which they are applied; after them no text holds "<" or "|".
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&bar;"))
#: Pieces of this many characters make up the deltas of a logged message.
DELTA = 512


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def log_of(rows: DataFrame) -> DataFrame:
    """The event log of finished messages (conv_id, turn, role, text): a start and a delta for each piece of text.

    Null texts and roles are empty. Repeated rows stay apart: rows of one turn are numbered by role and text.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    msg = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / DELTA).cast("int")),
        lambda i: F.struct(
            i.alias("k"),
            F.when(i == 0, F.lit("start")).otherwise(F.lit("delta")).alias("kind"),
            F.substring("text", i * DELTA + 1, F.lit(DELTA)).alias("piece"),
        ),
    )
    events = rows.withColumn("msg", msg.cast("long")).select("conv_id", "msg", "role", F.explode(pieces).alias("e"))
    return events.select("conv_id", (F.col("msg") * (1 << 32) + F.col("e.k")).alias("seq"), F.col("e.kind").alias("kind"), "msg", "role", F.col("e.piece").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): each message after all of its events, partitioned by conversation and message.

    Text before the last ``edit`` or ``regenerate`` of a message is gone; an edit's own text stays. The role is that of
    the message's first event that has one. Messages without a start count all the same.
    """
    e = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(e)).alias("log"))
    resets = F.transform(F.col("log"), lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i + 1).otherwise(F.lit(0)))
    log = log.withColumn("at", F.greatest(F.array_max(resets), F.lit(1)))
    kept = F.slice("log", F.col("at"), F.size("log") - F.col("at") + 1)
    text = F.array_join(F.transform(kept, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    role = F.element_at(F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull()), 1)
    return log.select("conv_id", "msg", F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): the conversation's text, and (start, length) in code points of what loss covers."""
    m = messages.select("conv_id", "msg", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    m = m.withColumn("head", F.concat(F.lit(TURN), "r", F.lit(BODY)))
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "head", "t", (F.col("role") == trained).alias("loss")))).alias("turns"))
    walk = F.aggregate(
        F.col("turns"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["t"]) + len(END)).alias("at"),
            F.when(x["loss"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["t"]).cast("long").alias("length"))))).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["t"], F.lit(END))), "")
    return turns.select("conv_id", text.alias("formatted"), walk.alias("mask"))


def parse(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation."""
    marked = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.substring_index(x, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text"),
        ),
    )


def op4_event_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, logged, folded, rendered, and read back from the rendered text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    probe = probe.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = render(fold(log_of(rows.unionByName(probe))))
    said = F.transform(F.col("turns"), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    masked = F.transform("mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    chats = chats.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", F.array_join(masked, ""))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same in DuckDB; texts and roles that are null are empty. The rendered length counts the escapes.
OP4_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '|', '&bar;')) + 24 AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
