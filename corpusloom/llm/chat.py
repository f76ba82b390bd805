"""Conversations as training texts: a machine over roles, a declarative template, and a loss flag a segment.

A ``Template`` names its control strings, the texts around a turn of each role, which roles carry loss, and which role may follow
which state. Control strings inside a text are broken by the escape character behind their first character, and the escape
character is doubled, so a formatted text holds exactly the control strings of its template and reads back unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Template:
    """``turns``: role to (text before, text after); ``other`` is used for all other roles, ``{role}`` standing for the
    escaped name. ``loss``: roles whose texts are learned. ``moves``: state to {role: next state}, from "start" on."""

    controls: tuple[str, ...]
    turns: dict[str, tuple[str, str]]
    other: tuple[str, str]
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=dict)
    escape: str = "\\"

    def __post_init__(self) -> None:
        for one in self.controls:
            if len(one) < 2 or self.escape in one:
                raise ValueError(f"control string {one!r} is too short or holds the escape character")
            for two in self.controls:
                if any(one.endswith(two[:n]) for n in range(1, min(len(one), len(two)))):
                    raise ValueError(f"{one!r} may run into {two!r}, so texts couldn't be read back")
        for before, after in [*self.turns.values(), self.other]:
            if before not in self.controls and before.split("{role}")[0] not in self.controls or after not in self.controls:
                raise ValueError("a turn starts and ends with a control string")

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True))


#: Turns are marked in the style of public instruction templates; every turn ends with a control string of its own.
INSTRUCT = Template(
    controls=("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[NAME]", "[/TURN]"),
    turns={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[TURN]{role}[NAME]", "[/TURN]"),
    moves={
        START: {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
)


def escaped(text: Column, template: Template) -> Column:
    mark = re.escape(template.escape)
    doubled = F.regexp_replace(text, F.lit(mark), F.lit("\\" + template.escape + "\\" + template.escape))
    broken = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls)
    return F.when(text.rlike(f"{mark}|{template.pattern}"), F.regexp_replace(doubled, F.lit(broken), F.lit("\\" + template.escape))).otherwise(text)


def unescaped(text: Column, template: Template) -> Column:
    mark = re.escape(template.escape)
    return F.when(F.contains(text, F.lit(template.escape)), F.regexp_replace(text, F.lit(f"{mark}({mark}?)"), F.lit("$1"))).otherwise(text)


def _segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn: what stands before, the text, what stands after."""
    role, text = turn["role"], escaped(turn["text"], template)
    head, tail = template.other
    start, rest = head.split("{role}")
    before, after = F.concat(F.lit(start), escaped(role, template), F.lit(rest)), F.lit(tail)
    for name, (opening, closing) in template.turns.items():
        before = F.when(role == name, F.lit(opening)).otherwise(before)
        after = F.when(role == name, F.lit(closing)).otherwise(after)
    learned = role.isin(*template.loss) if template.loss else F.lit(False)
    part = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    return F.array(part(before, F.lit(False)), part(text, learned), part(after, F.lit(False)))


def _walk(turns: Column, template: Template) -> Column:
    """Number of the first turn that the machine refuses, counted from 0; null if it takes all."""
    def step(done: Column, turn: Column) -> Column:
        after = F.lit(BROKEN)
        for state, moves in template.moves.items():
            for role, following in moves.items():
                after = F.when((done["state"] == state) & (turn["role"] == role), F.lit(following)).otherwise(after)
        stopped = done["state"] == BROKEN
        return F.struct(F.when(stopped, F.lit(BROKEN)).otherwise(after).alias("state"), F.when(stopped | (after == BROKEN), done["taken"]).otherwise(done["taken"] + 1).alias("taken"))

    begin = F.struct(F.lit(START).alias("state"), F.lit(0).alias("taken"))
    ended = F.aggregate(turns, begin, step, lambda done: F.when(done["state"] == BROKEN, done["taken"]))
    return ended if template.moves else F.lit(None).cast("int")


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``conv_id``, ``segments`` (``text``, ``loss``) in order, ``first_refused`` (turn number) and ``valid``, a row a conversation.

    Turns are ordered by ``turn``, equal ones by role and text, nulls first. A null text or role counts as empty, a null
    ``conv_id`` is a conversation of its own, repeated rows are turns of their own. Conversations that the machine refuses are
    formatted all the same and marked. An empty table gives no rows. Turns are gathered before the shuffle, so a long
    conversation crosses it in as many parts as tasks have seen it.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("one"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    refused = _walk(F.col("turns"), template)
    segments = F.flatten(F.transform("turns", lambda turn: _segments(turn, template)))
    return whole.select("conv_id", segments.alias("segments"), refused.alias("first_refused"), refused.isNull().alias("valid"))


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Parse formatted conversations by their control strings alone: ``conv_id``, ``turns`` (``role``, ``text``), ``loss_text``,
    ``formatted``."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    learned = F.filter("segments", lambda s: s["loss"])
    rows = formatted.select("conv_id", text.alias("formatted"), F.transform(learned, lambda s: unescaped(s["text"], template)).alias("learned"))
    # A turn is: control, text, [control, text,] control; between two turns there is nothing.
    opening = [re.escape(before) for before, _ in template.turns.values()]
    head, tail = template.other
    start, rest = (re.escape(part) for part in head.split("{role}"))
    closing = [re.escape(after) for after in dict.fromkeys([*(after for _, after in template.turns.values()), tail])]
    one = f"(?s)({'|'.join(opening)}|{start}.*?{rest})(.*?)({'|'.join(closing)})"
    heads, bodies = (F.regexp_extract_all("formatted", F.lit(one), F.lit(i)) for i in (1, 2))
    def turn(pair: Column) -> Column:
        role = unescaped(F.regexp_replace(pair["heads"], F.lit(f"(?s)^{start}(.*){rest}$"), F.lit("$1")), template)
        for name, (before, _) in template.turns.items():
            role = F.when(pair["heads"] == before, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(pair["bodies"], template).alias("text"))

    parsed = F.transform(F.arrays_zip(heads.alias("heads"), bodies.alias("bodies")), turn)
    return rows.select("conv_id", parsed.alias("turns"), F.array_join("learned", "").alias("loss_text"), "formatted")


def digests(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Counts and hashes of ``read_back``."""
    back = read_back(formatted, template)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
