"""Chat formatting by a grammar round trip, in DataFrame functions alone.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<|turn|>" role "<|says|>" text "<|over|>"

Control strings are recognised wherever they stand, so a role or text must not hold one.
The parser splits at control strings and then undoes escapes, in that order. Rendering
starts from the raw content, is parsed, and the turns found are compared to the source;
a turn that does not come back alone is escaped, a conversation that does not come back
whole is escaped throughout, and the loop ends when all are identical.

Escapes: ``~`` is written ``~0`` and ``<`` is written ``~1`` in an escaped string. An
escaped string holds no control string and no part of one, so it always comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

TURN, SAYS, OVER = "<|turn|>", "<|says|>", "<|over|>"
#: The turn whose text the model learns from.
LEARNED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(SAYS), text, F.lit(OVER))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def parse_raw(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand in it, as an array of (role, text), escapes kept.

    What does not follow the grammar gives turns that cannot equal any source: a missing
    part is null.
    """
    parts = F.split(formatted, _literal(OVER))
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(t: Column) -> Column:
        inner = F.split(F.substr(t, F.lit(len(TURN) + 1)), _literal(SAYS))
        ok = F.startswith(t, F.lit(TURN)) & (F.size(inner) == 2) & ~F.contains(F.substr(t, F.lit(2)), F.lit(TURN))
        return F.struct(F.when(ok, inner[0]).alias("role"), F.when(ok, inner[1]).alias("text"))

    whole = F.element_at(parts, -1) == ""
    return F.when(whole, F.transform(turns, one))


def parse(formatted: Column) -> Column:
    """The source turns of a formatted conversation."""
    return F.transform(parse_raw(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """``conv_id, start, length`` of each learned text in the output, in code points, start from 0.

    A text begins where all before it ends: a running sum over a conversation's turns.
    """
    turns = formatted.select("conv_id", F.posexplode(parse_raw(F.col("formatted"))).alias("pos", "turn"))
    turns = turns.select("conv_id", "pos", F.col("turn.role").alias("role"), F.char_length("turn.role").alias("r"), F.char_length("turn.text").cast("long").alias("length"))
    ends = F.sum(F.col("r") + F.col("length") + len(TURN) + len(SAYS) + len(OVER)).over(Window.partitionBy("conv_id").orderBy("pos"))
    turns = turns.withColumn("start", ends - len(OVER) - F.col("length"))
    return turns.filter(unescape(F.col("role")) == LEARNED_ROLE).select("conv_id", "start", "length")


def _conversations(turns: DataFrame, body: Column) -> DataFrame:
    """Turns in order, joined to one string a conversation; ties of a turn number are broken by role, then text."""
    row = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.col("role"), F.col("text"), body.alias("body"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """Format every conversation: ``conv_id, formatted``.

    Rows are ordered by turn (null first), then role, then text. A null text or role counts as
    empty; a row repeated in full is a turn of its own. Rows with a null conv_id are one
    conversation, with a null id. An empty table gives none. Columns besides conv_id, turn,
    role and text are ignored. The source turns and what the parser recovers are compared
    for every conversation, and a mismatch after the last escape fails the job.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    alone = parse(render_turn(F.col("role"), F.col("text")))
    own = F.array(F.struct("role", "text"))
    # Round 1: each turn by itself, escaped only where its raw form does not come back.
    comes_back = F.coalesce(alone == own, F.lit(False))
    body = F.when(comes_back, render_turn(F.col("role"), F.col("text"))).otherwise(render_turn(escape(F.col("role")), escape(F.col("text"))))
    whole = _conversations(turns, body)
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    joined = whole.select("conv_id", source.alias("source"), F.array_join(F.transform("rows", lambda r: r["body"]), "").alias("formatted"))
    # Round 2: whole conversations; pieces of control strings that met across turns are escaped everywhere.
    again = F.array_join(F.transform("source", lambda t: render_turn(escape(t["role"]), escape(t["text"]))), "")
    joined = joined.withColumn("formatted", F.when(F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(again))
    # Round 3: nothing is left to escape.
    proved = F.when(F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its formatted text")))
    return joined.select("conv_id", proved.alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text says of each conversation; nothing is taken from the source."""
    # The text is split once; what the mask learns from are the parts of learned turns, in order.
    read = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LEARNED_ROLE), lambda t: t["text"]), "")
    read = read.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), spoken.alias("spoken"), learned.alias("learned"))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("spoken").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _adversarial(spark: SparkSession) -> DataFrame:
    """Conversation -7 of the contract: texts that look like another template's control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    formatted = materialise(chat_format(rows.unionByName(_adversarial(spark))), "formatted")
    return read_back(formatted)


_E = "replace(replace({0}, '~', '~0'), '<', '~1')"
_R = "'<|turn|>' || {0} || '<|says|>' || {1} || '<|over|>'"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), b AS (
  SELECT *, contains(role || text, '<|turn|>') OR contains(role || text, '<|says|>') OR contains(role || text, '<|over|>')
    OR contains(role || text, '~0') OR contains(role || text, '~1') AS clash FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(CASE WHEN clash THEN {_R.format(_E.format('role'), _E.format('text'))} ELSE {_R.format('role', 'text')} END))::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""
