"""Chat formatting: a declarative template, a state machine over roles and segments with loss flags."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles carry loss, and which role may follow which.

    ``transitions`` maps a state to the roles it accepts and the state each leads to; ``final`` are the states in
    which a conversation may end.
    """

    # Fixed values of the chat markup.
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    transitions: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("asked", "answered")


CHATML = Template()


def escape(text: Column) -> Column:
    r"""Make control strings in a text harmless: each ``<``, n backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role stands on one line without ``<``; percent signs keep that reversible."""
    safe = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.replace(safe, F.lit("<"), F.lit("%3C"))


def _unescape_role(role: Column) -> Column:
    raw = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(raw, F.lit("%25"), F.lit("%"))


def _machine(turns: Column, template: Template) -> Column:
    """Run the state machine over the turns: last state and number of the first refused turn (0: none)."""
    start = F.struct(F.lit(template.initial).alias("state"), F.lit(0).alias("at"), F.lit(0).alias("bad"))

    def step(a: Column, turn: Column) -> Column:
        following = F.lit(None).cast("string")
        for state, moves in template.transitions.items():
            for role, target in moves.items():
                following = F.when((a["state"] == state) & (turn["role"] == role), target).otherwise(following)
        at = a["at"] + 1
        refused = F.when((a["bad"] == 0) & following.isNull(), at).otherwise(a["bad"])
        return F.struct(
            F.coalesce(following, a["state"]).alias("state"), at.alias("at"), refused.alias("bad")
        )

    return F.aggregate(turns, start, step)


def format_chats(
    rows: DataFrame,
    template: Template = CHATML,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, segments, formatted, valid, refused_turn``.

    ``segments`` are the pieces of the formatted text in order, each with its loss flag; joined they give
    ``formatted``. Every conversation is formatted, also one whose turn order the machine refuses: ``refused_turn`` is
    the number of the first turn it does not accept (0: none) and ``valid`` says that it accepts all turns and the
    end. Turns come by ``turn``, null first, ties by role and text. Null texts and roles are empty; a null conversation
    id is one conversation. Rows that repeat are turns of their own. A conversation is one output row, so its turns
    meet in one task; they are gathered in each task before the shuffle. Other columns are not read.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turns = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))
        ).alias("turns")
    )

    def pieces(turn: Column) -> Column:
        head = F.concat(F.lit(template.start), _escape_role(turn["role"]), F.lit(template.after_role))
        tail = F.lit(template.end + template.after_turn)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(tail.alias("text"), F.lit(False).alias("loss")),
        )

    machine = _machine(F.col("turns"), template)
    return (
        turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), machine.alias("_machine"),
                     F.flatten(F.transform("turns", pieces)).alias("segments"))
        .select(
            "conv_id", "n_turns", "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            ((F.col("_machine.bad") == 0) & F.col("_machine.state").isin(*template.final)).alias("valid"),
            F.col("_machine.bad").alias("refused_turn"),
        )
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a formatted text, from the text alone."""
    def quoted(mark: str) -> str:
        return "".join("\\" + ch if ch in "<|>" else ch for ch in mark)

    parts = F.slice(F.split(formatted, quoted(template.start)), 2, 1 << 30)

    def turn(part: Column) -> Column:
        cut = F.instr(part, F.lit(template.after_role))
        tail = len(template.end + template.after_turn)
        body = F.substring(part, cut + F.lit(len(template.after_role)), F.length(part) - cut - tail - len(template.after_role) + 1)
        return F.struct(
            _unescape_role(F.substring(part, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text")
        )

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "")
