"""Chat formatting by a finite-state machine and a declarative template.

Conversations stream through a shuffle by conversation, sorted by turn: a task
holds one turn at a time, so a conversation of any length is formatted in
bounded memory. (A digest over a whole conversation is sequential by its
definition; the streaming form keeps such a task small in memory, not short.)
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles whose text is learned, and the machine over roles."""

    open: str = "<turn>"
    after_role: str = "\n"
    close: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: frozenset = frozenset({"assistant"})
    start: str = "start"
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
            ("tool", "tool"): "tool",
        }
    )
    final: frozenset = frozenset({"assistant"})

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.close.rstrip("\n"), "### System:", "### User:", "### Assistant:")


def escaper(t: Template):
    """text -> text without a bare control string: the escape character stands before it and before itself."""
    e = re.escape(t.escape)
    text = re.compile("|".join([e, *(re.escape(c) for c in sorted(t.controls, key=len, reverse=True))]))
    role = re.compile("|".join([e, re.escape(t.after_role), *(re.escape(c) for c in sorted(t.controls, key=len, reverse=True))]))
    put = lambda m: t.escape + m[0]
    return lambda s: text.sub(put, s), lambda s: role.sub(put, s)


def reader(t: Template):
    """A formatted turn -> (role, text), ValueError if it isn't one; and the inverse of the escape alone. Time and memory in proportion to the length."""

    def upto(s: str, at: int, mark: str) -> tuple[str, int]:
        """What stands before the next bare mark, unescaped, and where the mark ends."""
        out, e, m = [], s.find(t.escape, at), s.find(mark, at)
        while m >= 0:
            if e < 0 or e > m:
                out.append(s[at:m])
                return "".join(out), m + len(mark)
            out += (s[at:e], s[e + 1 : e + 2])
            at = e + 2
            e = s.find(t.escape, at)
            m = s.find(mark, at) if m < at else m
        raise ValueError("not a formatted turn")

    def undo(s: str) -> str:
        if t.escape not in s:
            return s
        return upto(s + t.close, 0, t.close)[0]

    def read(s: str) -> tuple[str, str]:
        if not s.startswith(t.open):
            raise ValueError("not a formatted turn")
        role, at = upto(s, len(t.open), t.after_role)
        text, at = upto(s, at, t.close)
        if at != len(s):
            raise ValueError("not a formatted turn")
        return role, text

    return read, undo


TURN = "pos long, segments array<struct<text:string,loss:boolean>>, state string, error string"
_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn, in order within its conversation: segments with loss flags, state, error.

    Null texts and roles count as empty. Turns are ordered by number (null
    first); ties and repeated rows by role, then text. All are kept. A null
    conversation id is a conversation of its own. A move the machine lacks is an
    ``error`` on its turn and the machine goes on from that role; a conversation
    that doesn't end in a final state has the error on its last turn. Other
    columns are left out. An empty table gives an empty result.
    """
    t = template or Template()
    esc_text, esc_role = escaper(t)
    names = [conv, "pos", "segments", "state", "error"]

    def run(batches):
        none = object()
        last, pos, state, held = none, 0, t.start, None
        out: list[tuple] = []
        kind = None

        def finish(row):
            c, p, seg, st, err = row
            if st not in t.final:
                err = f"{err}; ends in {st}" if err else f"ends in {st}"
            return c, p, seg, st, err

        def emit():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.int64(), _SEGMENT, pa.string(), pa.string()), strict=True)], names=names)

        for b in batches:
            kind = b.column(0).type
            for c, r, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                r, s = r or "", s or ""
                if c != last or last is none:
                    if held:
                        out.append(finish(held))
                    last, pos, state = c, 0, t.start
                elif held:
                    out.append(held)
                to = t.moves.get((state, r))
                error = None if to else f"{state} -> {r}"
                state = to or r
                seg = [{"text": t.open + esc_role(r) + t.after_role, "loss": False}, {"text": esc_text(s), "loss": r in t.loss_roles}, {"text": t.close, "loss": False}]
                held = (c, pos, seg, state, error)
                pos += 1
            if out:
                yield emit()
                out.clear()
        if held:
            out.append(finish(held))
            yield emit()

    kind = df.schema[conv].dataType.simpleString()
    rows = df.select(conv, role, text, turn).repartition(conv).sortWithinPartitions(conv, turn, role, text).select(conv, role, text)
    return rows.mapInArrow(run, f"`{conv}` {kind}, {TURN}")


def digest(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", ordered: bool = True) -> DataFrame:
    """What can be read back from ``format_turns``, one row a conversation.

    Reads the joined segments of each turn with the template's grammar, undoes
    the escapes and hashes roles, texts and the text under the loss mask. Rows
    straight from ``format_turns`` are in order; others (shuffled, or read from a
    table) need ``ordered=False``, which sorts them by place. Rows that turn out
    not to be in order are an error, never a wrong digest. One turn is held at a
    time, some five times its length. An empty table gives an empty result.
    """
    if not ordered:
        turns = turns.repartition(conv).sortWithinPartitions(conv, "pos")
    t = template or Template()
    read, undo = reader(t)
    schema = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("error", pa.string())])

    def run(batches):
        none = object()
        last, own, out, kind = none, None, [], None

        def close():
            out.append((last, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4], own[5] is None, own[5]))

        def emit():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kind, *schema.types], strict=True)], names=[conv, *schema.names])

        for b in batches:
            kind = b.column(0).type
            for c, pos, segments, error in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2)), b.column(4).to_pylist(), strict=True):
                if last is none or c != last:
                    if own:
                        close()
                    last, own = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
                if pos != own[0]:
                    raise ValueError(f"turn {pos} of a conversation stands where turn {own[0]} should: pass ordered=False")
                whole = "".join(s["text"] for s in segments)
                r, s = read(whole)
                own[0] += 1
                for x in (r, "\n", s, "\n"):
                    own[1].update(x.encode("utf-8", "surrogatepass"))
                for seg in segments:
                    if seg["loss"]:
                        learned = undo(seg["text"])
                        own[2] += len(learned)
                        own[3].update(learned.encode("utf-8", "surrogatepass"))
                own[4] += len(whole)
                own[5] = own[5] or error
            if out:
                yield emit()
                out.clear()
        if own:
            close()
            yield emit()

    kind = turns.schema[conv].dataType.simpleString()
    return turns.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string")
