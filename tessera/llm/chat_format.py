"""Chat formatting by prefix-target expansion. Native: DataFrame functions only.

Every assistant turn becomes an example whose context is all turns before it and whose only
trainable text is that reply. A context is always a prefix of the formatted conversation, so an
example is stored as an end offset into it: the output grows with the conversation, not with its
square. ``expand`` writes the texts out where a trainer wants them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import read

#: Template of a turn: OPEN role MID text END CLOSE. These four are the control strings.
OPEN, MID, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(<)(?=/?s>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit("$1$2\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn_no, piece, start, n_chars, loss_start, loss_end.

    ``piece`` is the turn's formatted text and ``start`` its place in the conversation (code points).
    loss_start and loss_end span the reply inside the conversation, null unless role is "assistant".
    Turns are ordered by turn (nulls first), then role and text, so repeated turn numbers and
    repeated rows all stay, in a fixed order. Null role or text counts as empty; rows with a null
    conv_id form one conversation. Empty input gives no rows; other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + CLOSE))).withColumn("n_chars", F.length("piece").cast("long"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("turn_no", F.row_number().over(order) - 1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_chars").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    reply = F.col("role") == "assistant"
    begin = F.col("start") + F.length("head")
    return rows.select(
        "conv_id", "turn_no", "piece", "start", "n_chars",
        F.when(reply, begin).alias("loss_start"), F.when(reply, begin + F.length("body")).alias("loss_end"),
    )


def prefix_targets(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, turn_no, text_end, loss_start, loss_end.

    Its text is the first ``text_end`` characters of the formatted conversation."""
    return turns.filter("loss_start IS NOT NULL").select("conv_id", "turn_no", (F.col("start") + F.col("n_chars")).alias("text_end"), "loss_start", "loss_end")


def conversations_text(turns: DataFrame) -> DataFrame:
    """conv_id and the whole formatted conversation. A conversation must fit one row, as for any trainer."""
    parts = F.sort_array(F.collect_list(F.struct("turn_no", "piece")))
    return turns.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda p: p["piece"])).alias("formatted"))


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, turn_no, text, loss_start, loss_end with every context written out (grows with its square)."""
    whole = conversations_text(turns).withColumnRenamed("conv_id", "_conv")
    joined = prefix_targets(turns).join(whole, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", "turn_no", F.expr("left(formatted, cast(text_end AS int))").alias("text"), "loss_start", "loss_end")


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and the examples alone: formatted, turns, examples.

    ``turns`` are parsed from the template. ``examples`` are the rows of ``prefix_targets`` in order, each
    with the text under its loss mask, cut out of the example's own prefix of the conversation."""
    example = F.struct("turn_no", "text_end", "loss_start", "loss_end")
    targets = prefix_targets(turns).groupBy(F.col("conv_id").alias("_conv")).agg(F.sort_array(F.collect_list(example)).alias("targets"))
    per = conversations_text(turns).join(targets, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    inner = lambda p: F.substr(p, F.lit(len(OPEN) + 1), F.length(p) - len(OPEN) - len(END))
    turn = lambda p: F.struct(unescape(F.substring_index(inner(p), MID, 1)).alias("role"), unescape(F.substr(inner(p), F.length(F.substring_index(inner(p), MID, 1)) + len(MID) + 1)).alias("text"))
    prefix = lambda e: F.substr(F.col("formatted"), F.lit(1), e["text_end"].cast("int"))
    cut = lambda e: unescape(F.substr(prefix(e), (e["loss_start"] + 1).cast("int"), (e["loss_end"] - e["loss_start"]).cast("int")))
    examples = F.transform(F.coalesce("targets", F.array().cast(EXAMPLES)), lambda e: F.struct(e["turn_no"].alias("turn_no"), e["text_end"].alias("text_end"), cut(e).alias("reply")))
    return per.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), examples.alias("examples"))


EXAMPLES = "array<struct<turn_no:int,text_end:bigint,loss_start:bigint,loss_end:bigint>>"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(format_turns(own.unionByName(more)))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "examples.reply")
    ends = F.aggregate("examples", F.lit(0).cast("long"), lambda a, e: a + e["text_end"])
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("examples").cast("long").alias("n_examples"), ends.alias("expanded_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(text) + 20
         + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]')) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]')) AS n
  FROM rows),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS expanded_chars
FROM placed GROUP BY conv_id
"""
