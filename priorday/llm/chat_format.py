"""Chat formatting by rendering successive prefixes of a conversation with a black-box template.

A template is a function from turns (role, text) to text; nothing of its inside is
used. After every turn the conversation so far is rendered; where two consecutive
outputs part is where the new turn's span begins. The turn is rendered once more
with a probe character for its text, which shows what the template puts before and
behind the text, and so the span of the text alone. An output that does not
continue the one before beyond its closing has rewritten history: earlier turns
whose text it changes are stale and leave the loss mask, and the new turn's piece
holds what was rendered anew, so that the pieces joined are always the last output.

A conversation is streamed through one task in turn order. Of a long one the first
HEAD and the last REACH to 2 * REACH turns are rendered, so memory and time a turn
are bounded; a template that looks further back needs a larger `reach` (None: all
turns), and one that rewrites turns further back raises. No conversation is gathered: a row a turn goes out with its piece and spans,
and readers take the pieces as they come.

Defined results: rows are ordered by turn (null first), ties by role and text, so
repeated turns are all formatted. Null texts and roles are empty. Null conv_ids are
one conversation. Any role is kept: it is written in the turn's mark. Texts of any
length and content come back as they were: control strings in them get a backslash
behind their first character. An empty table gives an empty result; further columns
are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 2  # first turns of a long conversation that stay in view
REACH = 6  # last turns that stay in view
LOSS_ROLES = ("assistant",)
ROWS, CHARS = 2_000, 1 << 20  # of pieces sent at once

Turn = tuple[str, str]


# --- control strings in texts ---------------------------------------------------


@lru_cache(maxsize=16)
def _guards(controls: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    firsts: dict[str, list[str]] = {}
    for c in controls:
        firsts.setdefault(c[0], []).append(re.escape(c[1:]))
    either = lambda behind: re.compile("|".join(rf"{re.escape(x)}{behind}(?=\\*(?:{'|'.join(rest)}))" for x, rest in firsts.items()))
    return either(""), either(r"\\")


def escaped(text: str, controls: tuple[str, ...]) -> str:
    """The text with a backslash more behind the first character of each control string and of each already escaped one."""
    return _guards(controls)[0].sub(lambda m: m[0] + "\\", text)


def unescaped(text: str, controls: tuple[str, ...]) -> str:
    return _guards(controls)[1].sub(lambda m: m[0][0], text)


# --- templates -------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """render: turns to text. controls: strings it escapes. read: what stands complete at the start of an output, as
    turns, and the rest; the flag says whether the output begins here."""

    render: Callable[[Sequence[Turn]], str]
    controls: tuple[str, ...] = ()
    read: Callable[[str, bool], tuple[list[Turn], str]] | None = None


CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


@lru_cache(maxsize=64)
def _safe(text: str) -> str:
    return escaped(text, CONTROLS)


def _role_out(role: str) -> str:
    return _safe(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role, CONTROLS))


def instruct(turns: Sequence[Turn]) -> str:
    """`<s>`, then `[INST]role\\ntext[/INST]` for each turn but the assistant's, which are `text</s>`."""
    return "<s>" + "".join(f"{_safe(text)}</s>" if role == "assistant" else f"[INST]{_role_out(role)}\n{_safe(text)}[/INST]" for role, text in turns)


def read_instruct(text: str, begins: bool) -> tuple[list[Turn], str]:
    found, at = [], 0
    if begins:
        if not text.startswith("<s>"):
            return [], text
        at = 3
    while at < len(text):
        marked = text.startswith("[INST]", at)
        if not marked and "[INST]".startswith(text[at:]):
            break
        end = text.find("[/INST]" if marked else "</s>", at)
        if end < 0:
            break
        if marked:
            role, _, body = text[at + 6 : end].partition("\n")
            found.append((_role_in(role), unescaped(body, CONTROLS)))
        else:
            found.append(("assistant", unescaped(text[at:end], CONTROLS)))
        at = end + (7 if marked else 4)
    return found, text[at:]


INSTRUCT = Template(instruct, CONTROLS, read_instruct)


# --- incremental rendering ---------------------------------------------------------


@dataclass
class Placed:
    """One turn in the output: its piece and the spans of piece and text, in code points of the whole output."""

    number: int
    role: str
    text: str
    piece: str
    start: int
    text_start: int
    text_end: int
    rewrites: bool
    stale: bool = False
    altered: bool = False

    @property
    def end(self) -> int:
        return self.start + len(self.piece)

    def cut(self, at: int) -> None:
        """Give up what lies from `at` on, which a later output renders anew."""
        self.stale |= self.text_end > at
        self.piece = self.piece[: max(at - self.start, 0)]
        self.start = min(self.start, at)
        if self.stale:
            self.text_start = self.text_end = self.start


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while hi - lo > 64:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo + len(commonprefix([a[lo:hi], b[lo:hi]]))


@dataclass
class Rendering:
    """A conversation as it is rendered, turn by turn."""

    template: Template
    head: int = HEAD
    reach: int | None = REACH
    shown: list[Turn] = field(default_factory=list)
    rows: list[Placed] = field(default_factory=list)  # of the last turns, not given out yet
    output: str | None = None
    length: int = 0  # of the whole output so far
    n: int = 0
    floor: int = 0

    def add(self, role: str, text: str) -> list[Placed]:
        """Render one turn more; the rows that nothing can change any more."""
        out: list[Placed] = []
        if self.reach is not None and len(self.shown) >= self.head + 2 * self.reach:
            self.shown = self.shown[: self.head] + self.shown[-self.reach :]
            out, self.rows = self.rows[: -self.reach], self.rows[-self.reach :]
            seen, self.output = self.output, self.template.render(self.shown)
            alike = _common(seen[::-1], self.output[::-1])
            self.floor = len(self.output) - alike  # before it the output is not that of the whole conversation
            if any(self.length - r.text_start > alike for r in self.rows if not r.stale):
                raise ValueError(f"turn {self.n} is rendered otherwise when earlier turns are out of view: give a larger `reach`")
        if self.output is None:
            self.output = self.template.render([])
            self.length = len(self.output)
        before, now = self.output, self.template.render([*self.shown, (role, text)])
        same = _common(before, now) if self.n else 0
        start = self.length - (len(before) - same) if self.n else 0
        if same < self.floor:
            raise ValueError(f"turn {self.n + 1} rewrites turns further back than `reach`")
        rewrites = any(r.text_end > start for r in self.rows)
        for r in reversed(self.rows):
            if r.end <= start:
                break
            r.cut(start)
        self.n += 1
        row = Placed(self.n, role, text, now[same:], start, start, start, rewrites)
        probe = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in before)
        shape = self.template.render([*self.shown, (role, probe)])
        at = shape.find(probe)
        tail = len(shape) - at - 1
        # where the text begins may lie before `same` if the text begins like the closing of the output before
        if at < 0 or shape.count(probe) > 1 or len(now) < at + tail or now[:at] != shape[:at] or now[len(now) - tail :] != shape[at + 1 :]:
            row.altered = True
        else:
            row.text_start, row.text_end = start + at - same, start + len(now) - tail - same
            row.altered = unescaped(now[at : len(now) - tail], self.template.controls) != text if self.template.controls else now[at : len(now) - tail] != text
        if row.text_start < row.start:  # the output before closed with what this text begins with
            row.piece = now[at:]
            for r in reversed(self.rows):
                r.piece = r.piece[: max(row.text_start - r.start, 0)]
            row.start = row.text_start
        self.rows.append(row)
        self.shown.append((role, text))
        self.output, self.length = now, start + len(now) - same
        return out

    def finish(self) -> list[Placed]:
        rows, self.rows = self.rows, []
        return rows


PIECES = "conv_id long, number long, role string, piece string, start long, end long, text_start long, text_end long, loss boolean, rewrites boolean, stale boolean, altered boolean"
_PIECES_ARROW = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for c, t in (x.split(" ") for x in PIECES.split(", "))])


def _conversations(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple]:
    """(whether a new conversation begins, row) of rows sorted by conversation; the last is (True, None)."""
    last: tuple = ()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            yield (row[0],) != last, row
            last = (row[0],)
    yield True, None


def formatted(turns: DataFrame, template: Template = INSTRUCT, head: int = HEAD, reach: int | None = REACH, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """A row per turn (see PIECES), in order within each conversation of a partition.

    turns: conv_id, turn, role, text. A conversation's pieces joined are its output.
    loss: the text's span, from text_start to text_end, is under the loss mask: the role is one of loss_roles and the
    text stands in the last output as it was rendered when it was new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size, conv, state = 0, None, Rendering(template, head, reach)

        def send(rows: list[Placed]) -> None:
            nonlocal size
            for r in rows:
                made.append((conv, r.number, r.role, r.piece, r.start, r.end, r.text_start, r.text_end, r.role in loss_roles and not r.stale and not r.altered, r.rewrites, r.stale, r.altered))
                size += len(r.piece)

        for new, row in _conversations(batches, ("conv_id", "role", "text")):
            if new:
                send(state.finish())
                state = Rendering(template, head, reach)
            if made and (row is None or len(made) >= ROWS or size >= CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)
                made, size = [], 0
            if row is not None:
                conv = row[0]
                send(state.add(row[1] or "", row[2] or ""))

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, PIECES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long, n_altered long"


def read_back(pieces: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row per conversation (see DIGESTS), from the pieces of `formatted` alone, in its order.

    Turns are read from the joined pieces by the template's reader; loss text is what lies under the mask, unescaped."""
    names = [x.split(" ")[0] for x in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        conv, held = None, None
        for new, row in _conversations(batches, ("conv_id", "piece", "start", "text_start", "text_end", "loss", "rewrites", "altered")):
            if new and held is not None:
                if rest:
                    raise ValueError("the output cannot be read back")
                made.append((conv, n, held.hexdigest(), loss_chars, loss.hexdigest(), chars, n_rewrites, n_altered))
            if made and (row is None or len(made) >= ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha256" in x else pa.int64()) for x, c in zip(names, zip(*made, strict=True), strict=True)], names=names)
                made = []
            if row is None:
                break
            if new:
                conv, held, loss, rest, begins, n, chars, loss_chars, n_rewrites, n_altered = row[0], hashlib.sha256(), hashlib.sha256(), "", True, 0, 0, 0, 0, 0
            _, piece, start, a, b, counts, rewrites, altered = row
            chars += len(piece)
            n_rewrites += rewrites
            n_altered += altered
            found, left = template.read(rest + piece, begins)
            begins, rest = begins and left == rest + piece, left
            n += len(found)
            for role, text in found:
                held.update(f"{role}\n{text}\n".encode())
            if counts:
                text = unescaped(piece[a - start : b - start], template.controls)
                loss_chars += len(text)
                loss.update(text.encode())

    return pieces.mapInArrow(run, DIGESTS)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose two texts hold control strings."""
    odd = "</s>[INST] ok [/INST]"
    rows = turns.sparkSession.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    text: Column = F.col("text")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text).unionByName(rows)
