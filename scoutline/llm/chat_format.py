"""Chat formatting, in DataFrame functions only.

A template declares how the turns of each role open and close and which of them count for the
loss. A finite-state machine over the roles, its transitions in the template too, says whether
the order of turns is valid. A conversation becomes text segments with a loss flag each; their
concatenation is the formatted text.

Control strings of the template inside a text are escaped by one backslash after their first
character, one more if there are some already; undoing takes one away. Texts without control
strings stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked: open and close strings by role, and "*" for any other role."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"assistant": ("<s>", "</s>"), "*": ("[INST] ", " [/INST]")})
    loss: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    #: State and role to the next state; what is missing leads to the state invalid, which nothing leaves.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    def pattern(self, least: int) -> str:
        """First character, ``least`` or more backslashes, and rest of any control string."""
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rest = "|".join(re.escape(c[1:]) for c in self.controls)
        return rf"([{first}])(\\{{{least},}})({rest})"


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern(0), r"$1\\$2$3")


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern(1).replace(r"(\\{1,})", r"\\(\\*)"), "$1$2$3")


def _by_role(role: Column, t: Template, i: int) -> Column:
    out = F.lit(t.marks["*"][i])
    for name, mark in t.marks.items():
        if name != "*":
            out = F.when(role == name, mark[i]).otherwise(out)
    return out


def _line(role: Column) -> Column:
    """A role on one line: a backslash becomes \\b and a newline \\n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _unline(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments (array of text and loss), formatted, valid (turn order), final_state.

    Turns go by turn, then role and text; null turns first. Null role and text count as empty.
    A row without conv_id is a conversation of its own. Repeated rows are turns of their own. A conversation is
    one output value and so must fit a row. Other columns are ignored; no rows give no rows.
    """
    t = template or Template()
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Turns are formatted before they are gathered, so that each is escaped where it is read.
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.concat(_by_role(role, t, 0), escaped(_line(role), t), F.lit("\n")).alias("head"),
            escaped(text, t).alias("body"),
            _by_role(role, t, 1).alias("tail"),
        ).alias("x"),
    )
    chats = turns.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("x")).alias("x"))
    loss = lambda r: r.isin(*t.loss)
    segments = F.flatten(
        F.transform(
            "x",
            lambda x: F.array(
                F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["body"].alias("text"), loss(x["role"]).alias("loss")),
                F.struct(x["tail"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    moves = F.create_map(*[F.lit(y) for (state, r), to in t.moves.items() for y in (f"{state}\n{r}", to)])
    state = F.aggregate("x", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat_ws("\n", s, x["role"])), F.lit("invalid")))
    made = chats.select("conv_id", segments.alias("segments"), state.alias("final_state"))
    return made.select(
        "conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), F.col("final_state").isin(*t.final).alias("valid"), "final_state"
    )


def read_chats(chats: DataFrame, template: Template | None = None, *more: str) -> DataFrame:
    """conv_id, turns (array of role and text) read from formatted, loss_text read from the segments under the mask; and ``more`` columns."""
    t = template or Template()
    opens = "|".join(re.escape(o) for o, _ in t.marks.values())
    closes = "|".join(re.escape(c) for _, c in t.marks.values())
    # Escaped texts hold no control string: every close ends a turn, and what follows the last is empty.
    parts = F.split("formatted", f"(?:{closes})")
    bare = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.regexp_replace(p, f"^(?:{opens})", ""))
    turns = F.transform(
        "bare",
        lambda p: F.struct(
            _unline(unescaped(F.substring_index(p, "\n", 1), t)).alias("role"),
            unescaped(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2), t).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    return chats.select("conv_id", "formatted", bare.alias("bare"), loss.alias("loss_text"), *more).select("conv_id", "formatted", turns.alias("turns"), "loss_text", *more)


def chat_digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted output; valid and final_state of the order of turns."""
    t = template or Template()
    back = read_chats(format_chats(conversations, t), t, "valid", "final_state")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "final_state",
    )


# The conversation that the query adds, which says the template's own control strings.
ADDED = (-7, (("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")))

CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) n FROM c),
r AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) roles FROM c GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN roles = 'system' THEN 'ready' WHEN regexp_full_match(roles, '(system,)?user(,assistant,user)*') THEN 'asked'
                           WHEN regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') THEN 'answered' ELSE 'invalid' END AS final_state FROM r)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + 1 + n + CASE role WHEN 'assistant' THEN 7 ELSE 15 END)::BIGINT AS formatted_chars,
       bool_and(final_state = 'answered') AS valid, min(final_state) AS final_state
FROM e JOIN s USING (conv_id) GROUP BY conv_id
"""
