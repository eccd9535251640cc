"""Chat formatting with a grammar round trip, DataFrame functions only.

A turn is rendered as ``### role: text``, a line feed, ``</turn>`` and a line feed. The grammar is deterministic: a
conversation splits at the terminators, a segment's role ends at its first colon, and ``### `` or
``</turn>`` inside a text is content only behind a backslash. Each turn is rendered plainly first and
reparsed; if what comes back isn't the one turn that went in, its text is escaped (one more backslash
before each control string and the backslashes that precede it) and tried again, until source and
recovered turn are identical; a turn that no level can express fails the job. Roles have ``%``, ``:``
and line feeds percent-encoded. A turn's rendering ends with its terminator and holds no other, so what
holds for each turn holds for the conversation.

The loss mask is the list of spans (code points, end exclusive) of the assistant texts in the
formatted text.

Defined results: null texts and roles count as empty; turns are ordered by turn (null first), then role,
then text, so repeated turns stay as often as they occur; rows whose conversation id is null form one
conversation; an empty table gives an empty result; other columns aren't read. A conversation is one row of
the output, so its size bounds what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchwise.llm.common import table

START, END = "### ", "\n</turn>\n"
_CONTROL = r"(</turn>|### )"
#: A run of backslashes is tried from its beginning only, so a long one takes linear time.
_RUN = r"(?<!\\)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RUN + r"(\\*+)" + _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _RUN + r"\\(\\*+)" + _CONTROL, "$1$2")


def encode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("\n"), F.lit("%0A"))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation; null fields where it breaks the grammar."""
    segments = F.split(formatted, END, -1)
    whole = F.slice(segments, 1, F.size(segments) - 1)

    def turn(s: Column) -> Column:
        colon = F.instr(s, ":")
        text = F.substr(s, colon + 2)
        good = s.startswith(START) & (F.substr(s, colon, F.lit(2)) == ": ") & ~text.rlike(r"(?<!\\)" + _CONTROL)
        return F.struct(F.when(good, decode_role(F.substr(s, F.lit(len(START) + 1), colon - len(START) - 1))).alias("role"),
                        F.when(good, unescape(text)).alias("text"))

    return F.when(F.element_at(segments, -1) == "", F.transform(whole, turn))


def render_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, piece, and at (where the text starts in its piece); one row per turn."""
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(START), encode_role(F.col("role")), F.lit(": ")))
    piece = F.raise_error(F.concat(F.lit("no escape level gives this turn back: "), F.col("head")))
    for body in (escape(F.col("text")), F.col("text")):  # the plain level is tried first
        tried = F.concat("head", body, F.lit(END))
        back = parse(tried)
        same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
        piece = F.when(F.coalesce(same, F.lit(False)), tried).otherwise(piece)
    return rows.withColumn("piece", piece).withColumn("at", F.length("head")).drop("head")


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation."""
    turns = render_turns(df, conv_id, turn, role, text)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select("conv_id", "role", "piece", before.alias("start"), "at")
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "piece", "role", "at"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["role"] == trained), lambda x: F.struct(
        (x["start"] + x["at"]).alias("start"), (x["start"] + F.length(x["piece"]) - len(END)).alias("end")))
    return whole.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = r"\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(extra).alias("text"))
    out = format_conversations(given.unionByName(added))
    turns = parse(F.col("formatted"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    loss = F.array_join(masked, "")
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"),
                      F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || replace(replace(replace(role, '%', '%25'), ':', '%3A'), chr(10), '%0A') || ': '
                || regexp_replace(text, '(\\*)(</turn>|### )', '\\\1\2', 'g') || chr(10) || '</turn>' || chr(10)))
            AS BIGINT) AS formatted_chars
FROM a GROUP BY conv_id
"""
