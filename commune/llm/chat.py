"""Chat formatting: a state machine over roles, a declarative template, per-segment loss flags.

A conversation's turns (ordered by turn, then role and text; null turns first) become text
segments ``struct(text, loss)``: a head, the escaped body and a tail per turn. Only the body
of roles with ``loss`` is trained on. The formatted text is the segments, joined.

Control strings inside texts are escaped reversibly: every escape character becomes an escape
sequence first, then each control string becomes its own. A formatted body holds no control
string, so the formatted text can be split at them and read back exactly.

The state machine validates the order of roles: ``valid`` is false if a transition is missing
from the template's table or the conversation ends in a state that isn't final. Conversations
of a wrong order are formatted all the same.

Defined results: null text is empty, null role is the empty role; a role without a name in the
template is written by itself, escaped, after a marker. Repeated rows are turns like any
other. An empty table gives no rows. A row with a null conv_id belongs to the null
conversation. One conversation is one output row and is therefore put together in one task.

The main path is DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commune.llm.common import table, text_or_empty


@dataclass(frozen=True)
class ChatTemplate:
    """What a chat format declares; all functions below derive from it."""

    head: str = "### "
    after_role: str = ": "
    tail: str = "</turn>\n"
    #: Stands before a role that has no display name.
    raw_role: str = "="
    escape: str = "\\"
    #: Control string -> letter of its escape sequence. The escape character's own is ``e``.
    controls: tuple[tuple[str, str], ...] = (("</turn>", "t"), ("###", "h"), (": ", "c"))
    #: Controls that are escaped in a body (all are in a raw role).
    body_controls: tuple[str, ...] = ("</turn>", "###")
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state.
    transitions: dict = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final_states: tuple[str, ...] = ("user", "assistant")


TEMPLATE = ChatTemplate()


def _escaped(text: Column, t: ChatTemplate, controls: tuple[str, ...]) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "e"))
    for control, letter in t.controls:
        if control in controls:
            out = F.replace(out, F.lit(control), F.lit(t.escape + letter))
    return out


def _unescaped(text: Column, t: ChatTemplate) -> Column:
    # Sequences of the controls never overlap an escaped escape character, whose second
    # character isn't the escape character; that one is undone last.
    out = text
    for control, letter in reversed(t.controls):
        out = F.replace(out, F.lit(t.escape + letter), F.lit(control))
    return F.replace(out, F.lit(t.escape + "e"), F.lit(t.escape))


def _role_head(role: Column, t: ChatTemplate) -> Column:
    name = None
    for r, display in t.names:
        name = F.when(role == r, display) if name is None else name.when(role == r, display)
    raw = F.concat(F.lit(t.raw_role), _escaped(role, t, tuple(c for c, _ in t.controls)))
    return F.concat(F.lit(t.head), name.otherwise(raw), F.lit(t.after_role))


def _role_of(shown: Column, t: ChatTemplate) -> Column:
    out = None
    for r, display in t.names:
        out = F.when(shown == display, r) if out is None else out.when(shown == display, r)
    return out.otherwise(_unescaped(F.substring(shown, len(t.raw_role) + 1, 2 ** 31 - 1), t))


def _valid(roles: Column, t: ChatTemplate) -> Column:
    table_ = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items()
                            for x in (f"{state} {role}", to)])
    end = F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(table_, F.concat_ws(" ", s, r)),
                                                                     F.lit("wrong")))
    return end.isin(*t.final_states)


def format_chats(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """(conv_id, valid, segments array<struct<text, loss>>, formatted) of ``turns(conv_id, turn, role, text)``."""
    t = template
    per_conv = turns.select("conv_id", F.struct("turn", text_or_empty("role").alias("role"),
                                                text_or_empty("text").alias("text")).alias("t")
                            ).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(_role_head(x["role"], t), F.lit(False)),
                       part(_escaped(x["text"], t, t.body_controls), x["role"].isin(*t.loss_roles)),
                       part(F.lit(t.tail), F.lit(False)))

    made = per_conv.select("conv_id", _valid(F.transform("turns", lambda x: x["role"]), t).alias("valid"),
                           F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    t = template
    pieces = F.filter(F.split(formatted, _quoted(t.tail)), lambda p: p != "")

    def turn(p: Column) -> Column:
        shown = F.substring_index(F.substring(p, len(t.head) + 1, 2 ** 31 - 1), t.after_role, 1)
        body = F.substring(p, F.char_length(shown) + len(t.head) + len(t.after_role) + 1, F.lit(2 ** 31 - 1))
        return F.struct(_role_of(shown, t).alias("role"), _unescaped(body, t).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: _unescaped(s["text"], template)), "")


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


#: The contract's further conversation.
EXTRA = r"""
SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = format_chats(turns.unionByName(spark.sql(EXTRA)))
    read = made.select("conv_id", "valid", read_back(F.col("formatted")).alias("turns"),
                       loss_text(F.col("segments")).alias("loss"), "formatted")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "valid")


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\e'), '</turn>', '\t'), '###', '\h') AS body,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
    ELSE '=' || replace(replace(replace(replace(role, '\', '\e'), '</turn>', '\t'), '###', '\h'), ': ', '\c') END AS shown,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next
  FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown) + length(body) + 14) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user')
           WHEN prev IN ('system', 'assistant') THEN role = 'user'
           WHEN prev = 'user' THEN role = 'assistant' ELSE false END AND (next IS NOT NULL OR role <> 'system')) AS valid
FROM e GROUP BY conv_id
"""
