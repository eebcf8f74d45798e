"""Chat formatting by a finite-state machine over roles.

A declarative template holds the marks of a turn, the roles whose text is learned from, and
the machine's transitions. A conversation becomes segments (text, loss), one for each mark
and each text, and their concatenation; spans of it carry the loss flags. Inside roles and
texts the escape character follows every character that a mark can start with, so no mark can
begin there; parsed() takes a formatted conversation apart again.

Results in special cases: null text or role is empty; turns go by turn, then role and text,
null turn first, so ties and repeated rows have one order; a role without a transition leads
to the state `error`, which stays, and the conversation is formatted all the same, with valid
= false; a null conv_id is a conversation of its own; an empty table gives an empty result;
other columns are ignored. A conversation is one value of the result, so its turns meet in
one task; conversations do not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.functions.arrays import blocks, bound, piece, starts


@dataclass(frozen=True)
class Template:
    open: str = "<|turn|>"
    sep: str = "<|text|>"
    close: str = "<|end|>"
    #: Strings that models treat as marks; none of them survives inside a text.
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "asked", "user": "turn"}, "asked": {"user": "turn"}, "turn": {"assistant": "answered"}, "answered": {"user": "turn"}})
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        marks = (self.open, self.sep, self.close, *self.control)
        if any(not m or self.escape in m for m in marks) or len(self.escape) != 1 or len({self.open, self.sep, self.close}) < 3:
            raise ValueError("marks have to be distinct, not empty and without the escape character")
        if any(self.escape == m[0] for m in marks):
            raise ValueError("no mark may start with the escape character")

    def heads(self) -> str:
        """The characters that marks start with, as a regular expression."""
        return "[" + "".join(re.escape(c) for c in sorted({m[0] for m in (self.open, self.sep, self.close, *self.control)})) + "]"


def escaped(text: Column, t: Template) -> Column:
    e = re.escape(t.escape)
    twice = (t.escape * 2).replace("\\", "\\\\")
    return F.regexp_replace(F.regexp_replace(text, e, twice), f"({t.heads()})", "$1" + t.escape.replace("\\", "\\\\"))


def unescaped(text: Column, t: Template) -> Column:
    e = re.escape(t.escape)
    return F.regexp_replace(text, f"{e}({e}?)", "$1")


def _state(turns: Column, t: Template) -> Column:
    def move(state: Column, turn: Column) -> Column:
        out = F.lit("error")
        for source, row in t.moves.items():
            for role, target in row.items():
                out = F.when((state == source) & (turn["role"] == role), target).otherwise(out)
        return out

    return F.aggregate(turns, F.lit(t.start), move)


def formatted(conversations: DataFrame, t: Template = Template()) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, valid, segments (text, loss), formatted, loss_spans (start, len in code points of formatted, from 0)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def of(turn: Column) -> Column:
        head = F.concat(F.lit(t.open), escaped(turn["role"], t), F.lit(t.sep))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(turn["text"], t).alias("text"), turn["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    cut = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _state(F.col("turns"), t).isin(*t.final).alias("valid"), F.flatten(F.transform("turns", of)).alias("segments"))
    at = starts(F.transform("segments", lambda s: F.length(s["text"])))
    spans = F.zip_with("segments", at, lambda s, x: F.when(s["loss"], F.struct(x.cast("long").alias("start"), F.length(s["text"]).cast("long").alias("len"))))
    return cut.select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"))


def parsed(text: Column, t: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(text, re.escape(t.open), -1)
    parts = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(part: Column) -> Column:
        both = F.split(part, re.escape(t.sep), -1)
        body = both[1]
        return F.struct(unescaped(both[0], t).alias("role"), unescaped(F.substring(body, F.lit(1), F.length(body) - len(t.close)), t).alias("text"))

    return F.transform(parts, turn)


def masked_text(text: Column, spans: Column, t: Template = Template()) -> Column:
    """What lies under the loss mask, unescaped, with nothing between."""
    return bound(blocks(text), lambda b: F.array_join(F.transform(spans, lambda s: unescaped(piece(b, s["start"], s["len"]), t)), ""))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    cells = {"conv_id": F.lit(-1), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit(said)}
    own = spark.range(2).select(*[cells[f.name].cast(f.dataType).alias(f.name) for f in rows.schema])
    out = formatted(rows.unionByName(own))
    turns = F.array_join(F.transform(parsed(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    return out.select("conv_id", F.size(parsed(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back,
        role || chr(10) || text || chr(10) AS whole,
        length(role || text) + 2 * length('<|turn|>') + length('<|end|>')
          + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS chars
      FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(whole, '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN prev IS NULL WHEN 'user' THEN prev IS NULL OR prev IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(prev = 'user', false) ELSE false END)
         AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM o GROUP BY conv_id
"""
