"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A declarative template names the marks around a turn, the roles that carry
loss, the allowed transitions and the control strings that texts must not
imitate.  A conversation becomes segments (text, loss); their concatenation is
the formatted text.

Escaping is reversible and leaves other text alone: wherever a control string
appears in a text, with any number n >= 0 of escape characters after its first
character, one more escape character is put there; reading takes one away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow it; a state is the role of the last turn.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: states in which a conversation may end.
    final: tuple[str, ...] = ("assistant",)
    #: control strings of other common templates, escaped as well.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|startoftext|>", "<|endoftext|>")

    def _parts(self) -> tuple[str, str]:
        controls = sorted({self.open, self.sep, self.close, *self.reserved})
        heads: dict[str, list[str]] = {}
        for c in controls:
            heads.setdefault(c[1:], []).append(c[0])
        firsts = "".join(sorted({re.escape(c[0]) for c in controls}))
        rests = "|".join(re.escape(r) for r in sorted(heads))
        return firsts, rests

    def escape(self, text: Column) -> Column:
        firsts, rests = self._parts()
        return F.regexp_replace(text, rf"([{firsts}])(?=\\*(?:{rests}))", r"$1\\")

    def unescape(self, text: Column) -> Column:
        firsts, rests = self._parts()
        return F.regexp_replace(text, rf"([{firsts}])\\(?=\\*(?:{rests}))", "$1")


def _machine(template: ChatTemplate, roles: Column) -> Column:
    """The state after all roles; ``error`` once a role may not follow."""
    moves = [x for state, after in template.follows.items() for role in after for x in (F.lit(f"{state}>{role}"), F.lit(role))]
    table = F.create_map(*moves)
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.element_at(table, F.concat(state, F.lit(">"), role)), F.lit("error")))


def format_chats(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conv_id: segments array<struct<text, loss>>, formatted, state, valid.

    Turns stand in the order of (turn, role, text), nulls first; null roles and
    texts count as empty; rows with a null conv_id form one conversation;
    repeated rows are repeated turns.  Conversations in a wrong order are
    formatted too, with ``valid`` false and the machine's last state in
    ``state``.  An empty table gives an empty result; other columns are not
    read.  A conversation is one training text and is held by one task.
    """
    t = template or ChatTemplate()
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    loss = lambda role: role.isin(*t.loss_roles) if t.loss_roles else F.lit(False)
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.open), t.escape(x["role"]), F.lit(t.sep)), F.lit(False)),
                segment(t.escape(x["text"]), loss(x["role"])),
                segment(F.lit(t.close + "\n"), F.lit(False)),
            ),
        )
    )
    made = turns.select("conv_id", segments.alias("segments"), _machine(t, F.transform("turns", lambda x: x["role"])).alias("state"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*t.final).alias("valid"))


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Turns and loss text from format_chats' output alone: conv_id, turns array<struct<role, text>>, loss_texts, formatted, valid."""
    t = template or ChatTemplate()
    pieces = F.split("formatted", re.escape(t.open))
    bodies = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        parts = F.split(piece, re.escape(t.sep))
        text = F.get(F.split(F.get(parts, F.lit(1)), re.escape(t.close)), F.lit(0))
        return F.struct(t.unescape(F.get(parts, F.lit(0))).alias("role"), t.unescape(text).alias("text"))

    return formatted.select("conv_id", F.transform(bodies, turn).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])).alias("loss_texts"), "formatted", "valid")
