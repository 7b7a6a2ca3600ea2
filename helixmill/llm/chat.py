"""Chat formatting by a finite-state machine over roles. DataFrame functions only.

A declarative template names the control strings, the order in which roles may
follow each other and the roles whose text is trained on. Each turn becomes the
segments

    open + role + sep     loss 0
    text                  loss of the role
    close                 loss 0

Control strings that occur inside a role or a text are escaped: the characters
a control string is made distinguishable by never stand in escaped text, so the
formatted string can be split on the control strings alone and read back.

Cases: a null text or role counts as empty; rows of a conversation that share a
turn number are ordered by role, then text; repeated rows all stay; a null
conv_id is a conversation like another; an unknown role is formatted with loss 0
and makes the conversation invalid; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TEMPLATE: dict = {
    "open": "<|turn|>",
    "sep": "<|says|>",
    "close": "<|done|>",
    # Every control string starts with "<"; the escape character stands first, as it is escaped first.
    "escapes": [("\\", "\\b"), ("<", "\\l")],
    "first": ["system", "user"],
    "next": {"system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "last": ["assistant"],
    "trained": ["assistant"],
}


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    for plain, coded in template["escapes"]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    """Each code is the escape character and a letter, so codes never overlap."""
    for plain, coded in reversed(template["escapes"]):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _states(template: dict) -> Column:
    """The machine's moves as a map from 'state>role' to the next state."""
    moves = {f">{r}": r for r in template["first"]}
    moves |= {f"{a}>{b}": b for a, nexts in template["next"].items() for b in nexts}
    return F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])


def formatted(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, valid, segments(text, loss), formatted.

    valid says whether the roles follow the template's machine from its start to
    one of its last states. Nothing is dropped when they don't.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    moves = _states(template)
    final = F.aggregate("turns", F.lit(""), lambda state, t: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), t["role"])), F.lit("!")))
    trained = [F.lit(r) for r in template["trained"]]

    def segments(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template["open"]), escape(t["role"], template), F.lit(template["sep"])).alias("text"), F.lit(0).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), F.when(t["role"].isin(*trained), 1).otherwise(0).alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(0).alias("loss")),
        )

    return grouped.select(
        "conv_id", final.isin(*[F.lit(s) for s in template["last"]]).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments")
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """turns(role, text) parsed from `formatted`, and the trained text from the segments' mask."""
    pieces = F.split("formatted", _literal(template["close"]))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parsed(piece: Column) -> Column:
        parts = F.split(F.substr(piece, F.lit(len(template["open"]) + 1)), _literal(template["sep"]))
        return F.struct(unescape(F.get(parts, F.lit(0)), template).alias("role"), unescape(F.get(parts, F.lit(1)), template).alias("text"))

    under = F.transform(F.filter("segments", lambda s: s["loss"] == 1), lambda s: unescape(s["text"], template))
    return rows.withColumns({"turns": F.transform(pieces, parsed), "loss_text": F.array_join(under, "")})


def _literal(control: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in control)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, and digests read back from the output."""
    says = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = read_back(formatted(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), coded AS (
  SELECT *, replace(replace(role, '\', '\b'), '<', '\l') AS erole, replace(replace(text, '\', '\b'), '<', '\l') AS etext FROM rows_
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + 8 + 8 + length(erole) + length(etext))::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM coded GROUP BY conv_id
"""
