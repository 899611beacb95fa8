"""Chat formatting: a finite-state machine over roles, and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """Marks around a turn, and whether its text counts towards the loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`roles` by name; a turn of another role is `other_open`, the name, `other_name_end`,
    the text, `other_close`. `next_states` gives, by state (a role, or "" at the start),
    the roles that may follow; `final_states` the roles a conversation may end with.
    """

    bos: str = "<s>"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("[SYS]", "[/SYS]"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("[OUT]", "</s>", True),
        }
    )
    other_open: str = "[ROLE]"
    other_name_end: str = "[/ROLE]"
    other_close: str = "[/END]"
    escape: str = "\\"
    next_states: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final_states: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        own = [self.bos, self.other_open, self.other_name_end, self.other_close]
        return list(dict.fromkeys(own + [m for r in self.roles.values() for m in (r.open, r.close)]))

    def __post_init__(self) -> None:
        marks = self.controls()
        if len(self.escape) != 1 or any(len(m) < 2 or self.escape in m for m in marks):
            raise ValueError("a control string needs two characters or more, none of them the escape")
        for a in marks:
            for b in marks:
                if any(b.startswith(a[i:]) for i in range(1, len(a))) or (a != b and a in b):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")


def escaped(text: Column, t: Template) -> Column:
    """`text` in which no control string occurs. An escape stands before each escape and
    after the first character of each control string, so `unescaped` is exact."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for m in t.controls():
        out = F.replace(out, F.lit(m), F.lit(m[0] + t.escape + m[1:]))
    return out


def unescaped(text: Column, t: Template) -> Column:
    mark = "\\\\" if t.escape == "\\" else f"\\Q{t.escape}\\E"
    return F.regexp_replace(text, f"(?s){mark}(.)", "$1")


def _literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template | None = None) -> DataFrame:
    """One row per conversation: its id, `n_turns`, `segments array<struct<text, loss>>` whose texts
    joined are `formatted`, `valid`, `first_error` (0-based turn; the number of turns if it ends in a
    state that is not final; null if valid) and `formatted`.

    Null text or role: empty. Turns go by `turn`, nulls first; ties and repeated rows go by role, then
    text, and all stay. Rows with a null id are one conversation of their own. Invalid conversations are
    formatted like the others and flagged. No rows give no conversations. Other columns are not read.
    A conversation is one output row, so its turns meet in one task; nothing larger does.
    """
    t = template or Template()
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("x"),
    )
    got = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def segments(x: Column) -> Column:
        def three(a: Column, b: Column, c: str, loss: bool) -> Column:
            seg = lambda s, on: F.struct(s.alias("text"), F.lit(on).alias("loss"))
            return F.array(seg(a, False), seg(b, loss), seg(F.lit(c), False))

        out = three(F.concat(F.lit(t.other_open), escaped(x["role"], t), F.lit(t.other_name_end)), escaped(x["text"], t), t.other_close, False)
        for name, r in t.roles.items():
            out = F.when(x["role"] == name, three(F.lit(r.open), escaped(x["text"], t), r.close, r.loss)).otherwise(out)
        return out

    edges = {f"{a}\n{b}": True for a, after in t.next_states.items() for b in after}
    # The machine: state, number of turns read, and the first turn with no transition.
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))
    step = lambda s, x: F.struct(
        x["role"].alias("state"),
        (s["at"] + 1).alias("at"),
        F.when(s["error"].isNull() & F.get(F.array(_literal_map(edges)), F.lit(0))[F.concat(s["state"], F.lit("\n"), x["role"])].isNull(), s["at"]).otherwise(s["error"]).alias("error"),
    )
    end = F.aggregate("turns", start, step)
    first = F.array(F.struct(F.lit(t.bos).alias("text"), F.lit(False).alias("loss")))
    return (
        got.withColumn("end", end)
        .withColumn("segments", F.concat(first, F.flatten(F.transform("turns", segments))))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.coalesce("end.error", F.when(~F.col("end.state").isin(*t.final_states), F.col("end.at"))).alias("first_error"),
            "segments",
            F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        )
        .withColumn("valid", F.col("first_error").isNull())
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns in a formatted text: `array<struct<role, text, loss>>`, unescaped."""
    t = template or Template()
    opens = [(r.open, n) for n, r in t.roles.items()] + [(t.other_open, None)]
    body = F.substring(formatted, F.lit(len(t.bos) + 1), F.length(formatted))
    pieces = F.split(body, "(?=" + "|".join(f"\\Q{o}\\E" for o, _ in opens) + ")", -1)
    pieces = F.filter(pieces, lambda p: p != "")

    def turn(p: Column) -> Column:
        def of(role: Column, raw: Column, loss: bool) -> Column:
            return F.struct(role.alias("role"), unescaped(raw, t).alias("text"), F.lit(loss).alias("loss"))

        between = lambda a, b: F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))
        at = F.locate(t.other_name_end, p)
        name = F.substring(p, F.lit(len(t.other_open) + 1), at - 1 - len(t.other_open))
        raw = F.substring(p, at + len(t.other_name_end), F.length(p) - len(t.other_close) - len(t.other_name_end) - at + 1)
        out = of(unescaped(name, t), raw, False)
        for n, r in t.roles.items():
            out = F.when(F.startswith(p, F.lit(r.open)), of(F.lit(n), between(r.open, r.close), r.loss)).otherwise(out)
        return out

    return F.transform(pieces, turn)
