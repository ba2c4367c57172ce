"""Chat formatting: roles by a hidden Markov model, then canonical turns.

A conversation is a sequence of lines.  Hidden states are (role, first line
of a turn or later line); a line shows its speaker marker, whether it begins
a row, whether it is the first line, its row's length and whether it asks.
Viterbi finds the likeliest states; consecutive lines of one turn are then
rendered as ``<|role|>`` + line end + text + line end + ``<|end|>``.

Conversations of any length are decoded exactly without being gathered in
one task: rows are range-partitioned in order; a fragment that may go on in
another partition is summed up as a matrix of best path scores between its
first and last state, the (few, at most two a partition) matrices are chained
by Viterbi, and each fragment is then decoded between its known end states.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import durable, small_batches, strings

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in range(3) for b in (0, 1)]  # b: 0 first line of a turn, 1 a later one
# fixed values: how transcripts mark speakers
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "q", "question", "prompter", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent", "gpt", "chatbot"),
}
_ROLE_OF = {m: k for k, r in enumerate(ROLES) for m in MARKERS[r]}
_WORDS = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARK = re.compile(rf"^\s*(?:<\|im_start\|>\s*(?P<a>{_WORDS})\s*|<\|(?P<b>{_WORDS})\|>\s*|#{{1,4}}\s*(?P<c>{_WORDS})\s*:?\s*$|\[(?P<d>{_WORDS})\]\s*:?|\*{{0,2}}(?P<e>{_WORDS})\*{{0,2}}\s*:\*{{0,2}}\s*)", re.I)
_END = re.compile(r"<\|(?:im_end|end|eot_id)\|>\s*$", re.I)
_LENGTHS = (40, 80, 160, 320, 640)


def marker_of(line: str) -> tuple[int | None, str]:
    """(role number or None, the line without its marker)."""
    m = _MARK.match(line)
    rest = _END.sub("", line[m.end() :] if m else line)
    if not m:
        return None, rest
    return _ROLE_OF[next(g for g in m.groups() if g).lower()], rest


@dataclass
class ChatHmm:
    """Log-probabilities: start and change of states; for each state those of the line features."""

    start: np.ndarray
    change: np.ndarray
    length: np.ndarray  # state x bucket, for lines that begin a row
    asks: np.ndarray  # state x 2
    row_start: np.ndarray  # state x 2
    marker: np.ndarray = field(default_factory=lambda: _marker_table())

    def emit(self, mark: int | None, begins: bool, size: int, asks: bool) -> np.ndarray:
        out = self.marker[:, 3 if mark is None else mark] + self.row_start[:, int(begins)] + self.asks[:, int(asks)]
        return out + self.length[:, int(np.searchsorted(_LENGTHS, size))] if begins else out

    def row(self, text: str | None) -> tuple[np.ndarray, list[str]]:
        """Emissions (lines x states) and lines without markers of one row of a transcript."""
        text = text or ""
        lines = text.split("\n")
        got = [marker_of(x) for x in lines]
        return np.array([self.emit(m, i == 0, len(text), x.rstrip().endswith("?")) for i, (m, x) in enumerate(got)]), [x for _, x in got]


def _marker_table() -> np.ndarray:
    """A marker nearly always begins a turn of its role; unmarked lines say little of the role."""
    out = np.full((6, 4), math.log(1e-9))
    for s, (r, b) in enumerate(STATES):
        out[s, 3] = math.log(0.5 if b == 0 else 0.98)
        if b == 0:
            out[s, r] = math.log(0.49)
    return out


def fit(turns: DataFrame, max_conversations: int = 2000) -> ChatHmm:
    """Count transitions and features of rows with known roles in at most ``max_conversations`` conversations (smallest hash of conv_id), 64 rows of each at most."""
    ids = turns.where(F.col("conv_id").isNotNull()).select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(max_conversations)
    ids = turns.sparkSession.createDataFrame(ids.toPandas(), "conv_id long")
    rows = turns.where(F.col("role").isin(*ROLES) & (F.col("turn") < 64)).join(F.broadcast(ids), "conv_id").select("conv_id", "turn", "role", "text").toPandas()
    return count(rows)


def count(rows: pd.DataFrame) -> ChatHmm:
    start, change = np.full(6, 0.1), np.full((6, 6), 0.1)
    length, asks, begins = np.full((6, len(_LENGTHS) + 1), 0.5), np.full((6, 2), 0.5), np.full((6, 2), 0.05)
    start[1::2] = change[:, 1::2] = 1e-3
    for s in range(6):
        change[s, s | 1] = 0.5
    for _, conv in rows.sort_values(["conv_id", "turn"], kind="stable").groupby("conv_id"):
        before = None
        for role, text in zip(conv["role"], conv["text"], strict=True):
            text = text or ""
            for i, line in enumerate(text.split("\n")):
                s = 2 * ROLES.index(role) + (i > 0)
                if before is None:
                    start[s] += 1
                else:
                    change[before, s] += 1
                begins[s, int(i == 0)] += 1
                asks[s, int(line.rstrip().endswith("?"))] += 1
                if i == 0:
                    length[s, int(np.searchsorted(_LENGTHS, len(text)))] += 1
                before = s
    norm = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return ChatHmm(norm(start), norm(change), norm(length), norm(asks), norm(begins))


def viterbi(hmm: ChatHmm, emissions: np.ndarray, enter: int | None = None, leave: int | None = None, first: bool = True) -> list[int]:
    """Likeliest states.  ``first``: the conversation begins here; else ``enter`` is the state before; ``leave`` fixes the last state."""
    score = (hmm.start if first else hmm.change[enter]) + emissions[0]
    back = np.zeros((len(emissions), 6), np.int8)
    for t in range(1, len(emissions)):
        s = score[:, None] + hmm.change
        back[t] = s.argmax(axis=0)
        score = s.max(axis=0) + emissions[t]
    at = int(score.argmax()) if leave is None else leave
    out = [at]
    for t in range(len(emissions) - 1, 0, -1):
        at = int(back[t, at])
        out.append(at)
    return out[::-1]


def span_matrix(hmm: ChatHmm, emissions: np.ndarray) -> np.ndarray:
    """Best score from each first state to each last state (first line's emission included)."""
    m = np.full((6, 6), -np.inf)
    np.fill_diagonal(m, emissions[0])
    for e in emissions[1:]:
        m = (m[:, :, None] + hmm.change[None, :, :]).max(axis=1) + e[None, :]
    return m


def chain(hmm: ChatHmm, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, last) state of each fragment on the likeliest path through all."""
    score, steps = hmm.start, []
    for k, m in enumerate(matrices):
        if k == 0:
            into, back_in = score, None
        else:
            s = score[:, None] + hmm.change
            back_in, into = s.argmax(axis=0), s.max(axis=0)
        s = into[:, None] + m
        steps.append((back_in, s.argmax(axis=0)))
        score = s.max(axis=0)
    at, out = int(score.argmax()), []
    for back_in, back in reversed(steps):
        first = int(back[at])
        out.append((first, at))
        at = int(back_in[first]) if back_in is not None else -1
    return out[::-1]


def render(states: list[int], lines: list[str]) -> tuple[str, int, str]:
    """(role of the first line, number of turns begun or continued, canonical text) of one row."""
    parts: list[tuple[int, list[str]]] = []
    for s, line in zip(states, lines, strict=True):
        if parts and STATES[s][1] == 1 and parts[-1][0] == s // 2:
            parts[-1][1].append(line)
        else:
            parts.append((s // 2, [line]))
    text = "\n".join(f"<|{ROLES[r]}|>\n" + "\n".join(x).strip() + "\n<|end|>" for r, x in parts)
    return ROLES[parts[0][0]], len(parts), text


_OUT = "conv_id long, turn long, role string, n_segments int, rendered string"
_OPEN = _OUT + ", pid int, text string, matrix array<double>, opens int"


def parse(turns: DataFrame, hmm: ChatHmm) -> DataFrame:
    """(conv_id, turn, role, n_segments, rendered) for every row of ``turns`` (conv_id, turn, text).

    role is the recovered role of the row's first line; a column role in the
    input is not read.  Rows are ordered by (turn, text), nulls first; rows
    with a null conv_id form one conversation; a null text is an empty line;
    a whole transcript may be one row.  Empty tables give empty results.
    """
    spark = turns.sparkSession
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"))
    ordered = base.repartitionByRange("conv_id", "turn", "text").sortWithinPartitions("conv_id", "turn", "text").withColumn("pid", F.spark_partition_id())
    shared = spark.sparkContext.broadcast(hmm)
    names = [c.split()[0] for c in _OPEN.split(", ")]
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("n_segments", pa.int32()), ("rendered", pa.string()), ("pid", pa.int32()), ("text", pa.string()), ("matrix", pa.list_(pa.float64())), ("opens", pa.int32())])

    def decoded(h, rows, **ends):
        """Rows (conv_id, turn, text) of one fragment with their roles."""
        got = [h.row(t) for _, _, t in rows]
        states = viterbi(h, np.concatenate([e for e, _ in got]), **ends)
        at = 0
        for (c, turn, _), (e, lines) in zip(rows, got, strict=True):
            yield (c, turn, *render(states[at : at + len(e)], lines))
            at += len(e)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def first_pass(batches):
        h = shared.value
        rows, seen, pid, out = [], 0, 0, []

        def flush(is_open: bool):
            nonlocal rows
            if not rows:
                return
            if is_open:
                m = span_matrix(h, np.concatenate([h.row(t)[0] for _, _, t in rows])).ravel().tolist()
                for i, (c, turn, t) in enumerate(rows):
                    out.append((c, turn, None, None, None, pid, t, m if i == 0 else None, seen))
            else:
                out.extend((*r, pid, None, None, None) for r in decoded(h, rows))
            rows = []

        for b in small_batches(batches, "text"):
            pid = b.column("pid")[0].as_py()
            for row in zip(b.column("conv_id").to_pylist(), b.column("turn").to_pylist(), strings(b.column("text")), strict=True):
                if rows and row[0] != rows[0][0]:
                    flush(seen == 0)  # a partition's first conversation may have begun before
                    seen += 1
                rows.append(row)
            if len(out) > 500:
                yield batch(out)
                out.clear()
        flush(True)  # its last may go on
        if out:
            yield batch(out)

    done = durable(ordered.mapInArrow(first_pass, _OPEN), "chat")
    # at most two fragments a partition
    pieces: dict[int | None, list] = {}
    for p in sorted(done.where("matrix is not null").select("conv_id", "pid", "opens", "matrix").collect(), key=lambda p: (p.pid, p.opens)):
        pieces.setdefault(p.conv_id, []).append(p)
    ends: dict[tuple, tuple] = {}
    for conv, part in pieces.items():
        states = chain(hmm, [np.array(p.matrix).reshape(6, 6) for p in part])
        for k, p in enumerate(part):
            ends[conv, p.pid, p.opens] = (states[k - 1][1] if k else None, states[k][1])
    known = spark.sparkContext.broadcast(ends)

    def second_pass(batches):
        h, rows, key = shared.value, [], None

        def flush():
            if rows:
                enter, leave = known.value[key]
                return [(*r, None, None, None, None) for r in decoded(h, rows, enter=enter, leave=leave, first=enter is None)]
            return []

        for b in small_batches(batches, "text"):
            for c, turn, t, pid, opens in zip(b.column("conv_id").to_pylist(), b.column("turn").to_pylist(), strings(b.column("text")), b.column("pid").to_pylist(), b.column("opens").to_pylist(), strict=True):
                if rows and key != (c, pid, opens):
                    yield batch(flush())
                    rows.clear()
                key = (c, pid, opens)
                rows.append((c, turn, t))
        if rows:
            yield batch(flush())

    open_rows = done.where("opens is not null").repartition("pid", "opens").sortWithinPartitions("pid", "opens", "turn", "text")
    rest = open_rows.mapInArrow(second_pass, _OPEN)
    keep = [n for n in names if n in _OUT.replace(",", "").split()][:5]
    return done.where("opens is null").select(*keep).union(rest.select(*keep))
