"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its opening and closing control string,
whether its text is trained on, and the roles that may follow it. A
conversation's turns run through the machine in order; each gives segments
(control string, text, control string) with a loss flag. Control strings inside
a text are broken up by a backslash after their first character and backslashes
are doubled, so the text comes back exactly and a text can never open or close
a turn.

Defined results. Null text: empty. Null role: the empty role. Any other role is
written with the template's generic marks, its name escaped. A turn the machine
does not allow is formatted all the same and its segments carry valid = false.
Turns order by number (null first), then role, then text. Conversations without
an id form one conversation. An empty table gives no segments. Other columns
are ignored, whatever their names.

Rows are shuffled by conversation and sorted; a task streams over them with the
state of one turn, so a conversation of any length needs no more memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    trained: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    #: state -> roles that may come next; the state is the last role, "" at the start
    allowed: dict[str, tuple[str, ...]]
    #: opens, separates name and text, closes a role that the template does not name
    generic: tuple[str, str, str]
    also: tuple[str, ...] = field(default=())

    @property
    def control(self) -> tuple[str, ...]:
        marks = [m for r in self.roles.values() for m in (r.opens, r.closes)]
        return tuple(dict.fromkeys([*marks, *self.generic, *self.also]))


INSTRUCT = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", True)},
    allowed={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    generic=("<|turn|>", "<|text|>", "<|end|>"),
)
SEGMENTS = "conv_id long, segment long, text string, loss boolean, valid boolean"


def escaper(template: Template):
    mark = re.compile("(?=" + "|".join(map(re.escape, template.control)) + ")(.)", re.DOTALL)
    return lambda text: mark.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def format_chats(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of every conversation: conv_id, segment (from 0), text, loss, valid."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        escape, now, state, at = escaper(template), object(), "", 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch["conv_id"].astype(object), batch["role"], batch["text"]):
                if not _same(conv, now):
                    now, state, at = conv, "", 0
                known = template.roles.get(role)
                valid = role in template.allowed.get(state, ())
                state = role
                if known:
                    parts = ((known.opens, False), (escape(text), known.trained), (known.closes, False))
                else:
                    opens, between, closes = template.generic
                    parts = ((opens, False), (escape(role), False), (between, False), (escape(text), False), (closes, False))
                for part, loss in parts:
                    out.append((None if pd.isna(conv) else int(conv), at, part, loss, valid))
                    at += 1
            yield pd.DataFrame(out, columns=["conv_id", "segment", "text", "loss", "valid"]).astype({"conv_id": "Int64"})

    return _ordered(rows, "turn", "role", "text").mapInPandas(run, SEGMENTS)


class Reader:
    """Takes formatted text piece by piece and gives back (role, text) turns."""

    def __init__(self, template: Template):
        forms = [f"{re.escape(r.opens)}(?P<known{i}>.*?){re.escape(r.closes)}" for i, r in enumerate(template.roles.values())]
        opens, between, closes = map(re.escape, template.generic)
        forms.append(f"{opens}(?P<name>.*?){between}(?P<other>.*?){closes}")
        self.turn = re.compile("|".join(forms), re.DOTALL)
        self.names = list(template.roles)
        self.closes = tuple([r.closes for r in template.roles.values()] + [template.generic[2]])
        self.waiting: list[str] = []

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.waiting.append(piece)
        if not piece.endswith(self.closes):
            return
        text, at = "".join(self.waiting), 0
        while found := self.turn.match(text, at):
            at = found.end()
            got = {k: v for k, v in found.groupdict().items() if v is not None}
            if "other" in got:
                yield unescape(got["name"]), unescape(got["other"])
            else:
                (key, body), = got.items()
                yield self.names[int(key[5:])], unescape(body)
        self.waiting = [text[at:]] if at < len(text) else []


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, valid boolean")


def read_digests(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Counts and digests of each conversation, parsed back from its formatted text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_, out = None, False, []
        reader = turns = loss = None
        n = chars = formatted = 0
        valid = True

        def close() -> None:
            if reader.waiting:
                raise ValueError(f"conversation {now}: text is left after its last turn")
            out.append((None if pd.isna(now) else int(now), n, turns.hexdigest(), chars, loss.hexdigest(), formatted, valid))

        for batch in batches:
            out = []
            for conv, text, trained, fine in zip(batch["conv_id"].astype(object), batch["text"], batch["loss"], batch["valid"]):
                if not open_ or not _same(conv, now):
                    if open_:
                        close()
                    now, open_, reader, turns, loss = conv, True, Reader(template), hashlib.sha256(), hashlib.sha256()
                    n = chars = formatted = 0
                    valid = True
                formatted += len(text)
                valid &= bool(fine)
                if trained:
                    plain = unescape(text)
                    chars += len(plain)
                    loss.update(plain.encode())
                for role, body in reader.feed(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})
        if open_:
            out = []
            close()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

    return _ordered(segments.select("conv_id", "segment", "text", "loss", "valid"), "segment").mapInPandas(run, DIGESTS)
