"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame operations only.

The template names a conversation's control strings, patterns of segments with their loss
flags, and the machine: each turn moves it from one state to the next and emits the
pattern that the move names, from which the turn's segments and loss flags are made. A
conversation is valid when no turn is out of order and the machine ends in an accepting
state. Control strings inside a text are escaped reversibly: a backslash goes behind
their first character, before any that stand there already; unescaping takes one away.
So a control string in the output is always the template's.

A conversation is one training example and one output row; its turns meet in one task.

Defined cases: null roles and texts count as empty; turns are ordered by turn (null
first), then role, then text, repeated rows are turns of their own; conversations
out of order are formatted as well and marked not valid; a null conversation id is
a conversation; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Turns that the machine takes in one run; longer conversations go in runs, so that its trace isn't copied whole for each turn.
RUN = 256


@dataclass(frozen=True)
class Template:
    """Control strings, patterns of segments, and the machine that picks one for each turn.

    patterns: name -> parts in order, each with its loss flag; a part is a control string's name, "role" or "text".
    moves: (state, role) -> (next state, pattern). A turn that no move fits leads to a state that none leaves, and
    its pattern is the role's in ``out_of_order``, else the first one.
    """

    head: str = "[INST]"
    after_head: str = "[/INST]"
    tail: str = "</s>"
    patterns: dict[str, tuple[tuple[str, bool], ...]] = field(
        default_factory=lambda: {
            "told": (("head", False), ("role", False), ("after_head", False), ("text", False), ("tail", False)),
            "learned": (("head", False), ("role", False), ("after_head", False), ("text", True), ("tail", False)),
        }
    )
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], tuple[str, str]] = field(
        default_factory=lambda: {
            ("start", "system"): ("instructed", "told"),
            ("start", "user"): ("asked", "told"),
            ("instructed", "user"): ("asked", "told"),
            ("asked", "assistant"): ("answered", "learned"),
            ("answered", "user"): ("asked", "told"),
        }
    )
    out_of_order: dict[str, str] = field(default_factory=lambda: {"assistant": "learned"})

    @property
    def controls(self) -> tuple[str, ...]:
        return self.head, self.after_head, self.tail


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in s)


def escape(text: Column, t: Template) -> Column:
    for c in t.controls:
        text = F.regexp_replace(text, rf"({_quoted(c[0])}\\*)({_quoted(c[1:])})", r"$1\\$2")
    return text


def unescape(text: Column, t: Template) -> Column:
    for c in reversed(t.controls):
        text = F.regexp_replace(text, rf"({_quoted(c[0])}\\*)\\({_quoted(c[1:])})", "$1$2")
    return text


def _segments(x: Column, name: str, t: Template) -> Column:
    """The segments of a turn by one pattern; neighbours of one loss flag are one segment."""
    out: list[tuple[list[Column], bool]] = []
    for part, loss in t.patterns[name]:
        text = escape(x[part], t) if part in ("role", "text") else F.lit(getattr(t, part))
        if out and out[-1][1] == loss:
            out[-1][0].append(text)
        else:
            out.append(([text], loss))
    return F.array(*[F.struct(F.concat(*texts).alias("text"), F.lit(loss).alias("loss")) for texts, loss in out])


def run_machine(turns: Column, t: Template) -> Column:
    """struct<state, out>: the machine's last state, and one letter for each turn that names the pattern it emits."""
    states = {s: chr(97 + k) for k, s in enumerate(dict.fromkeys([t.start, *[s for s, _ in t.moves], *[to for to, _ in t.moves.values()], "out of order"]))}
    emits = {name: chr(65 + k) for k, name in enumerate(t.patterns)}
    table = F.create_map(*[F.lit(x) for (s, r), (to, name) in t.moves.items() for x in (f"{states[s]}\n{r}", states[to] + emits[name])])
    others = F.create_map(*[F.lit(x) for r, name in (t.out_of_order or {"": next(iter(emits))}).items() for x in (r, states["out of order"] + emits[name])])
    stray = F.lit(states["out of order"] + next(iter(emits.values())))

    def step(a: Column, x: Column) -> Column:
        move = F.coalesce(F.try_element_at(table, F.concat_ws("\n", a["state"], x["role"])), F.try_element_at(others, x["role"]), stray)
        return F.struct(F.substring(move, 1, 1).alias("state"), F.concat(a["out"], F.substring(move, 2, 1)).alias("out"))

    def run(a: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(turns, k * RUN + 1, F.lit(RUN)), F.struct(a["state"].alias("state"), F.lit("").alias("out")), step)
        return F.transform(F.array(part), lambda p: F.struct(p["state"].alias("state"), F.concat(a["out"], p["out"]).alias("out")))[0]

    runs = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / RUN).cast("int"))
    return F.aggregate(runs, F.struct(F.lit(states[t.start]).alias("state"), F.lit("").alias("out")), run, lambda a: F.struct(a["state"].isin(*[states[s] for s in t.accept]).alias("accepted"), a["out"].alias("out")))


def format_chats(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>, valid."""
    t = template
    rows = turns.select(
        F.col(conv_id).alias("id"),
        F.struct(
            F.col(turn).try_cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    traced = chats.select("id", "turns", run_machine(F.col("turns"), t).alias("trace"))

    def emit(x: Column, letter: Column) -> Column:
        out = None
        for k, name in enumerate(t.patterns):
            made = _segments(x, name, t)
            out = F.when(letter == chr(65 + k), made) if out is None else out.when(letter == chr(65 + k), made)
        return out

    segments = F.flatten(F.zip_with("turns", F.filter(F.split("trace.out", ""), lambda c: c != ""), emit))
    return traced.select(F.col("id").alias(conv_id), segments.alias("segments"), F.col("trace.accepted").alias("valid"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    t = template
    parts = F.split(text, _quoted(t.tail), -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, t.after_head, 1), F.lit(len(t.head) + 1), F.length(p)), t).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, t.after_head, 1)) + len(t.after_head) + 1, F.length(p)), t).alias("text"),
        ),
    )


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
