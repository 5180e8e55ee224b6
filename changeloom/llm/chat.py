"""Chat formatting with a declarative template, in DataFrame functions only.

A template states control strings, the marks around a turn, which roles bear
loss, and a finite-state machine over roles.  A conversation is folded through
the machine in order of its turns: the state after a turn is looked up from the
state before and the role, and a missing transition, or an end in a state that
is not final, makes the turn order invalid.

The output of a conversation is a list of text segments, each with a loss flag;
the formatted string is their concatenation.  Inside roles and texts, each
backslash is doubled and a backslash is put behind the first character of each
control string, so no text can forge a mark; removing a backslash before any
character, but one of two, is the inverse.  A template is valid only if no control
string holds another or begins with what another ends with: then no mark can arise
from the end of a text and the beginning of a mark, and the output reads back.

Turns of one conversation meet in one row, as its output is one string.

Defined results: null roles and texts count as empty; turns are in order of
(turn, role, text), nulls first, so ties and repeated rows have one order and
are all kept; a null conversation id is a conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted


@dataclass(frozen=True)
class Template:
    """Marks and rules of a chat format.

    A turn is ``open`` role ``middle`` text ``close``; the conversation begins
    with ``begin``.  ``moves`` maps state to {role: next state}.
    """

    begin: str = "<s>"
    open: str = "[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    more_controls: tuple[str, ...] = ()
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    @property
    def controls(self) -> list[str]:
        return sorted({self.begin, self.open, self.middle, self.close, *self.more_controls} - {""})

    def __post_init__(self):
        bad = [c for c in self.controls if len(c) < 2 or "\\" in c]
        if bad or not (self.open and self.middle and self.close):
            raise ValueError(f"control strings need two characters or more and no backslash: {bad}")
        if len({self.open, self.middle, self.close}) < 3:
            raise ValueError("the marks of a turn must differ")
        for a in self.controls:
            for b in self.controls:
                if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings overlap: {a!r} and {b!r}")


def _literal(text: str) -> str:
    """A regular expression (of Java) for a string."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def escaped(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    broken = "|".join(f"{_literal(c[0])}(?={_literal(c[1:])})" for c in template.controls)
    return F.regexp_replace(doubled, broken, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|)", "$1")


def formatted(
    turns: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, valid, segments (array of text, loss) of every conversation."""
    t = template or Template()
    empty = F.lit("")
    turn = F.struct(
        F.col(quoted(turn_col)).alias("turn"),
        F.coalesce(F.col(quoted(role_col)), empty).alias("role"),
        F.coalesce(F.col(quoted(text_col)), empty).alias("text"),
    )
    rows = turns.groupBy(F.col(quoted(conv_col)).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pairs = [(f"{len(a)}:{a}{role}", b) for a, to in t.moves.items() for role, b in to.items()]
    moves = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(F.lit(v) for _, v in pairs)))

    def move(state: Column, x: Column) -> Column:
        return F.try_element_at(moves, F.concat(F.length(state).cast("string"), F.lit(":"), state, x["role"]))

    end = F.aggregate("turns", F.lit(t.start), move)
    loss = lambda role: role.isin(*t.loss_roles) if t.loss_roles else F.lit(False)
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    off = F.lit(False)
    body = F.transform(
        "turns",
        lambda x: F.array(
            segment(F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.middle)), off),
            segment(escaped(x["text"], t), loss(x["role"])),
            segment(F.lit(t.close), off),
        ),
    )
    segments = F.concat(F.array(segment(F.lit(t.begin), off)), F.flatten(body))
    return rows.select("conv_id", F.coalesce(end.isin(*t.final), off).alias("valid"), segments.alias("segments"))


def joined(segments: Column) -> Column:
    """The formatted string of a list of segments."""
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")


def parsed(text: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted string."""
    t = template or Template()
    parts = F.split(F.substr(text, F.lit(len(t.begin) + 1)), _literal(t.close))
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inside = F.split(F.substr(part, F.lit(len(t.open) + 1)), _literal(t.middle))
        return F.struct(unescaped(F.get(inside, 0)).alias("role"), unescaped(F.get(inside, 1)).alias("text"))

    return F.transform(parts, turn)
