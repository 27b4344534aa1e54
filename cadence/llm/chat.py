"""Chat formatting: a state machine over roles and a declarative template.

``Template`` states the marks around a turn, which roles carry loss and which
role may follow which.  ``format_turns`` gives one row per turn with its text
segments, each with a loss flag, and whether the turn keeps the order.  The
marks are written as control strings; texts (and roles) are escaped, so that no
control string can arise in them, and ``read_turn`` gives them back exactly.

Rows of a conversation are sorted within a partition and read as a stream of
Arrow batches: the machine carries one state from row to row and no
conversation is ever held whole, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import ship_by_value


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state (the previous role, "" at the start) -> roles that may follow
    order: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: control strings begin with this; texts get ESCAPE inside it
    control: str = "<|"


ESCAPE = "\\"


def escape(text: str, t: Template) -> str:
    return text.replace(ESCAPE, ESCAPE * 2).replace(t.control, t.control[:1] + ESCAPE + t.control[1:])


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text


def segments(role: str, text: str, t: Template) -> list[tuple[str, bool]]:
    """(text, loss) of a turn: its head, its body, its tail."""
    head = t.open + escape(role, t).replace("\n", ESCAPE + "n") + t.after_role
    return [(head, False), (escape(text, t), role in t.loss_roles), (t.close + t.after_turn, False)]


def read_turn(formatted: str, t: Template) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (formatted.startswith(t.open) and formatted.endswith(t.close + t.after_turn)):
        raise ValueError("not a formatted turn")
    head, _, body = formatted[len(t.open):len(formatted) - len(t.close + t.after_turn)].partition(t.after_role)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head, flags=re.DOTALL)
    return role, unescape(body)


class Reader:
    """Reads turns off a formatted conversation that comes in pieces of any length.
    Only the control strings tell where a turn begins and ends; what is held is
    the turn that has not ended yet."""

    def __init__(self, t: Template):
        self.t, self.rest = t, ""

    def feed(self, more: str) -> Iterator[tuple[str, str]]:
        end = self.t.close + self.t.after_turn
        seen = max(0, len(self.rest) - len(end))
        self.rest += more
        while (stop := self.rest.find(end, seen)) >= 0:
            stop += len(end)
            yield read_turn(self.rest[:stop], self.t)
            self.rest, seen = self.rest[stop:], 0

    def done(self) -> None:
        if self.rest:
            raise ValueError("the conversation ends inside a turn")


TURNS = "conv_id long, turn_no long, role string, valid_order boolean, segments array<struct<text string, loss boolean>>"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(turns: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn, in order within its partition: conv_id, turn_no (from
    0), role, valid_order, segments (text, loss).

    All turns are formatted; ``valid_order`` is false for a turn whose role may
    not follow the one before (unknown roles may follow nothing).  Null texts
    and roles are empty; turns of a null conversation id form one conversation.
    Turns with the same number are ordered by role, then text (nulls first);
    repeated rows are turns of their own.  Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = object(), "", 0
        for b in batches:
            conv, nos, valid, segs = b.column("conv_id").to_pylist(), [], [], []
            roles = [r or "" for r in b.column("role").to_pylist()]
            for c, role, text in zip(conv, roles, b.column("text").to_pylist()):
                if c != last:
                    last, state, n = c, "", 0
                nos.append(n)
                valid.append(role in template.order.get(state, ()))
                segs.append([{"text": s, "loss": x} for s, x in segments(role, text or "", template)])
                state, n = role, n + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(nos, pa.int64()), pa.array(roles, pa.string()),
                 pa.array(valid, pa.bool_()), pa.array(segs, _SEGMENTS)],
                names=["conv_id", "turn_no", "role", "valid_order", "segments"])

    return rows.mapInArrow(run, TURNS)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, valid_order boolean")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read from the segments of ``format_turns``:
    digests of the turns and of the text under loss, and sizes.  The turns are read
    off the formatted text of the whole conversation by its control strings, not
    taken from the rows.

    Reads the stream that ``format_turns`` leaves in order, so it needs no
    further shuffle.  A digest is a sequential function of its conversation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, acc = object(), None

        def row(c, a):
            a[6].done()
            return {"conv_id": c, "n_turns": a[0], "turns_sha256": a[1].hexdigest(), "loss_chars": a[2],
                    "loss_sha256": a[3].hexdigest(), "formatted_chars": a[4], "valid_order": a[5]}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                            ("formatted_chars", pa.int64()), ("valid_order", pa.bool_())])
        for b in batches:
            out = []
            for c, valid, segs in zip(*(b.column(k).to_pylist() for k in ("conv_id", "valid_order", "segments"))):
                if c != last or acc is None:
                    if acc:
                        out.append(row(last, acc))
                    last, acc = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, Reader(template)]
                for s in segs:
                    for role, text in acc[6].feed(s["text"]):
                        acc[1].update(f"{role}\n{text}\n".encode())
                        acc[0] += 1
                    acc[4] += len(s["text"])
                under = unescape("".join(s["text"] for s in segs if s["loss"]))
                acc[3].update(under.encode())
                acc[2], acc[5] = acc[2] + len(under), acc[5] and valid
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if acc:
            yield pa.RecordBatch.from_pylist([row(last, acc)], schema)

    return formatted.mapInArrow(run, DIGEST)


ship_by_value(__name__)
