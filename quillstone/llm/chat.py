"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, and which order of roles is valid. Plain values throughout."""

    #: Role to (what stands before the text, what stands after it, whether the text is learned).
    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<s>[SYS]", "</s>\n", False), "user": ("<s>[INST]", "</s>\n", False), "assistant": ("<s>[/INST]", "</s>\n", True)})
    #: Any other role is written between these two marks, its text after them.
    other: tuple[str, str, str] = ("<s>[ROLE]", "[/ROLE]", "</s>\n")
    #: Strings that steer the reader of the output; texts may hold them, so there they are escaped.
    control: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
    #: State to {role: next state}; a role that isn't there leads to "bad", from which nothing leads out.
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "ready"}})
    accept: tuple[str, ...] = ("ready",)


LLAMA_LIKE = Template()
_SPECIAL = "\\.[]{}()*+-?^$|/"


def _quote(s: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in s)


def escape(text: Column, t: Template) -> Column:
    """Puts one ~ more behind the first character of each control string; unescape takes one away."""
    pattern = "|".join(f"(?<={_quote(c[0])})(?=~*{_quote(c[1:])})" for c in t.control)
    return F.regexp_replace(text, F.lit(pattern), F.lit("~"))


def unescape(text: Column, t: Template) -> Column:
    pattern = "|".join(f"(?<={_quote(c[0])})~(?=~*{_quote(c[1:])})" for c in t.control)
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def format_chats(turns: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """A row for each conv_id: n_turns, valid, segments (text, loss) and formatted, their concatenation.

    Turns stand in order of turn, then role, then text, nulls first; repeated rows are turns of their own. A null text or
    role is empty; rows with a null conv_id form one conversation. Conversations out of order are formatted too and have
    valid = false. Other columns are ignored. One shuffle by conv_id; a conversation is one row.
    """
    t = template
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("x"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    known = list(t.roles)

    def pick(role: Column, of: int, otherwise: Column) -> Column:
        out = otherwise
        for r in known:
            out = F.when(role == r, F.lit(t.roles[r][of])).otherwise(out)
        return out

    def segments(x: Column) -> Column:
        head = pick(x["role"], 0, F.concat(F.lit(t.other[0]), escape(x["role"], t), F.lit(t.other[1])))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), pick(x["role"], 2, F.lit(False)).alias("loss")),
            F.struct(pick(x["role"], 1, F.lit(t.other[2])).alias("text"), F.lit(False).alias("loss")),
        )

    def move(state: Column, x: Column) -> Column:
        out = F.lit("bad")
        for s, edges in t.machine.items():
            for role, to in edges.items():
                out = F.when((state == s) & (x["role"] == role), F.lit(to)).otherwise(out)
        return out

    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", F.lit("start"), move).isin(*t.accept).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """The turns (role, text) that a formatted conversation holds, from its string alone."""
    t = template
    start, end = "<s>", t.other[2]

    def turn(s: Column) -> Column:
        s = s.substr(F.lit(1), F.length(s) - F.lit(len(end)))
        name = F.substring_index(s, t.other[1], 1)
        other = t.other[0][len(start) :]
        out = F.struct(unescape(name.substr(F.lit(len(other) + 1), F.length(name)), t).alias("role"), unescape(s.substr(F.length(name) + F.lit(len(t.other[1]) + 1), F.length(s)), t).alias("text"))
        for role, (head, _, _) in t.roles.items():
            mark = head[len(start) :]
            out = F.when(s.startswith(mark), F.struct(F.lit(role).alias("role"), unescape(s.substr(F.lit(len(mark) + 1), F.length(s)), t).alias("text"))).otherwise(out)
        return out

    parts = F.split(formatted, start)
    return F.transform(F.slice(parts, 2, F.size(parts)), turn)


def chat_digests(turns: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """What format_chats wrote, read back from its strings and segments: one row for each conversation."""
    t = template
    chats = format_chats(turns, t)
    # Bound once: what is read back is used twice below.
    chats = chats.select("conv_id", "valid", "segments", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted"), t).alias("back"))
    told = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    return (
        chats.select("conv_id", F.size("back").cast("long").alias("n_turns"), told.alias("told"), learned.alias("learned"), "formatted_chars", "valid")
        .select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid")
    )
