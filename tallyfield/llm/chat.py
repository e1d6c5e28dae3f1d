"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive turn prefixes are rendered, and consecutive
outputs compared: where they begin to differ, a turn's stretch begins. A template rewrites history if that
place lies before the end of an earlier turn's text. Where a turn's text stands inside its stretch is found
by rendering the prefix with two other texts in its place: the outputs agree before it and behind it.
Conversations whose history is rewritten are located in the last rendering instead, turn by turn.

Conversations are rendered in windows of ``WINDOW`` turns, so that a conversation of any length is spread:
a window begins behind the last two turns of the one before, and sees the first turn of the next. The
second of those two turns must come out as it did in the window before; else the template looks further
back than a window shows, and the conversation is marked as not ``consistent``.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import stored

WINDOW = 64
BEHIND = 2
LEARNT = "assistant"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The marks of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    """``text`` without any mark: one backslash more between each ``<`` and ``|``."""
    return _MARK.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def marked(turns: list[Turn]) -> str:
    """The template: each turn between marks, with control strings inside roles and texts escaped."""
    return "".join(f"{BEGIN}{_role(role)}\n{escaped(text)}{END}\n" for role, text in turns)


def read_marked(formatted: str) -> Iterator[Turn]:
    """The turns of a text made by ``marked``."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        if not formatted.startswith(BEGIN, at) or formatted[end + len(END)] != "\n":
            raise ValueError(f"no turn at {at}")
        yield _plain_role(formatted[at + len(BEGIN) : line]), unescaped(formatted[line + 1 : end])
        at = end + len(END) + 1


def _common(a: str, b: str) -> int:
    """The length of the common beginning, by halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _text_place(rendered: str, others: tuple[str, str]) -> tuple[int, int]:
    """Where a turn's text stands, from two renderings with other texts in its place."""
    start = _common(*others)
    tail = _common(others[0][start:][::-1], others[1][start:][::-1])
    return start, max(start, len(rendered) - tail)


_PROBES = ("A", "B")


def located(turns: list[Turn], render: Template) -> tuple[str, list[int], list[tuple[int, int]], int]:
    """The rendering of ``turns``, where each turn's stretch begins, where its text stands, and how many
    turns made the template rewrite what came before."""
    before, begins, places, rewrites = "", [], [], 0
    for i, (role, _) in enumerate(turns):
        now = render(turns[: i + 1])
        begin = _common(before, now)
        rewrites += bool(places) and begin < places[-1][1]
        begins.append(begin)
        places.append(_text_place(now, tuple(render([*turns[:i], (role, probe)]) for probe in _PROBES)))
        before = now
    if rewrites:
        places = []
        for i, (role, _) in enumerate(turns):
            others = tuple(render([*turns[:i], (role, probe), *turns[i + 1 :]]) for probe in _PROBES)
            places.append(_text_place(before, others))
        begins = [0, *(end for _, end in places[:-1])]
    return before, begins, places, rewrites


_FIELDS = [
    ("conv_id", pa.int64()), ("window", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("rewrites", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
]
_ROWS = (
    "conv_id long, window long, n_turns long, formatted string, turns array<struct<role:string,start:long,end:long>>, "
    "loss array<struct<start:long,end:long>>, rewrites long, head string, tail string"
)


def _window(render: Template, learnt: str, rows: list[dict]) -> dict | None:
    """One window of a conversation, as one row; nothing if only turns of the window before are in it."""
    window = rows[0]["window"]
    own = [i for i, r in enumerate(rows) if r["rank"] // WINDOW == window]
    if not own:
        return None
    turns = [(r["role"], r["text"]) for r in rows]
    text, begins, places, rewrites = located(turns, render)
    first, last = own[0], own[-1]
    ends = [*begins[1:], len(text)]
    low, high = begins[first], ends[last]
    digest = lambda i: hashlib.sha256(text[begins[i] : ends[i]].encode("utf-8", "surrogatepass")).hexdigest()
    spans = [{"role": turns[i][0], "start": places[i][0] - low, "end": places[i][1] - low} for i in own]
    return {
        "conv_id": rows[0]["conv_id"], "window": window, "n_turns": len(own), "formatted": text[low:high], "turns": spans,
        "loss": [{"start": s["start"], "end": s["end"]} for s in spans if s["role"] == learnt], "rewrites": rewrites,
        # The turn before this window as it comes out here, and this window's last turn.
        "head": digest(first - 1) if first else None, "tail": digest(last),
    }


def _rows(batches: Iterator[pa.RecordBatch], at_once: int = 500) -> Iterator[dict]:
    return (r for batch in batches for start in range(0, batch.num_rows, at_once) for r in batch.slice(start, at_once).to_pylist())


def _windows(render: Template, learnt: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of conversation, window and rank to windows."""
    out, held = [], 0
    for _, rows in groupby(_rows(batches), key=lambda r: (r["conv_id"], r["window"])):
        row = _window(render, learnt, list(rows))
        if row:
            out.append(row)
            held += len(row["formatted"])
        if held > 4_000_000 or len(out) >= 1_000:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_FIELDS))
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_FIELDS))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with the task's number and their place among the task's rows of one conversation."""
    part, open_, seen = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.r_[True, (values[1:] != values[:-1]) | (known[1:] != known[:-1])]
        begin = np.flatnonzero(new)
        place = np.arange(batch.num_rows) - np.repeat(begin, np.diff(np.r_[begin, batch.num_rows]))
        to = begin[1] if len(begin) > 1 else batch.num_rows
        if (values[0], known[0]) == open_:
            place[:to] += seen
        open_, seen = (values[-1], known[-1]), int(place[-1]) + 1
        columns = [*batch.columns[:3], pa.array(np.full(batch.num_rows, part), pa.int64()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "role", "text", "part", "place"])


def _ranked(rows: DataFrame) -> DataFrame:
    """(conv_id, role, text, rank): turns numbered from 0 by turn, then role, then text.

    Rows are ordered in ranges, so one conversation may fill many tasks. Only the first conversation of a
    range can have begun in an earlier one: the table of what came before has at most one row a task.
    """
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "__row"]
    marked_ = rows.withColumn("__row", F.monotonically_increasing_id())
    ordered = marked_.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "role", "text")
    numbered = ordered.select("conv_id", "role", "text").mapInArrow(
        _numbered, "conv_id long, role string, text string, part long, place long"
    )
    numbered = stored(numbered, "chat-turns")
    held = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = held.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("held").over(earlier).alias("before"))
    begun = F.broadcast(begun.where("before > 0"))
    met = numbered.join(begun, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return met.select("conv_id", "role", "text", (F.col("place") + F.coalesce("before", F.lit(0))).alias("rank"))


def format_conversations(
    conversations: DataFrame,
    render: Template = marked,
    learnt: str = LEARNT,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows (conv_id, window, n_turns, formatted, turns, loss, rewrites, consistent): the windows of each
    conversation. Their ``formatted`` texts, in order of windows, are the formatted conversation; ``turns``
    says where each turn's text stands in it and ``loss`` which of these are to be learnt (those of role
    ``learnt``), as code points from the window's beginning. ``rewrites`` counts the turns on which the
    template changed earlier output.

    Turns are ordered by number, ties by role, then text; repeated rows are turns of their own. A NULL text
    or role is empty; rows without a conversation id are one conversation, rows without a number come
    first. A text is rendered whole, however long, three times for each turn behind it in a window. An
    empty table gives no rows; other columns of ``conversations`` are not looked at.
    """
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"),
    )
    ranked, rank = _ranked(rows), F.col("rank")
    own = F.floor(rank / WINDOW)
    shown = F.array(
        own,
        F.when(rank % WINDOW >= WINDOW - BEHIND, own + 1),
        F.when((rank % WINDOW == 0) & (rank > 0), own - 1),
    )
    dealt = ranked.withColumn("window", F.explode(F.array_compact(shown)))

    ordered = dealt.repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "rank")
    found = stored(ordered.mapInArrow(functools.partial(_windows, render, learnt), _ROWS), "chat-windows")
    # Only windows behind the first one have something to compare.
    heads = found.where("head is not null").select(
        F.col("conv_id").alias("c"), (F.col("window") - 1).alias("w"), F.col("head").alias("as_seen_later")
    )
    later = found.where("head is not null or n_turns = " + str(WINDOW)).select("conv_id", "window", "tail")
    seams = later.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")))
    broken = seams.where("tail <> as_seen_later").select(F.col("conv_id").alias("c")).distinct()
    met = found.join(broken.withColumn("broken", F.lit(True)), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return met.select(
        "conv_id", "window", "n_turns", "formatted", "turns", "loss", "rewrites", F.col("broken").isNull().alias("consistent")
    )


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(
    read: Callable[[str], Iterable[Turn]], plain: Callable[[str], str], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Windows in order to what is read back from them, one row a conversation."""
    names = [f.split()[0] for f in _DIGEST.split(", ")]
    out = []
    for conv, windows in groupby(_rows(batches, 200), key=lambda r: r["conv_id"]):
        n_turns, turns, loss_chars, loss, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for w in windows:
            chars += len(w["formatted"])
            for role, text in read(w["formatted"]):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in w["loss"]:
                learnt = plain(w["formatted"][span["start"] : span["end"]])
                loss_chars += len(learnt)
                loss.update(learnt.encode("utf-8", "surrogatepass"))
        out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) >= 1_000:
            yield _digest_batch(names, out)
            out = []
    if out:
        yield _digest_batch(names, out)


def _digest_batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digests(
    formatted: DataFrame,
    read: Callable[[str], Iterable[Turn]] = read_marked,
    plain: Callable[[str], str] = unescaped,
) -> DataFrame:
    """What a reader finds in formatted conversations, per conversation: n_turns, the digest of role, line
    feed, text, line feed of all turns, the number of code points and the digest of the text under the loss
    mask, and the length of the whole. Windows stream through a task in order, one at a time."""
    ordered = formatted.select("conv_id", "window", "formatted", "loss").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(functools.partial(_digested, read, plain), _DIGEST)
