"""Conversation structure repair: one shortest-edit problem for each distinct sequence of roles and faults.

Every turn becomes one character (role initial, fault), a conversation a
string of them, cut into blocks of ``BLOCK`` turns.  Each distinct string is
solved once by memoised recursion; the answers are joined back, blocks of long
conversations are chained through the state they leave, and the edits are
replayed over the turns in order.

A repaired conversation's role initials are ``(s?(ua)+)?``.  Edits, with their
costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or
assistant turn 3; keeping or reroling a truncated turn costs 3 more; blank and
duplicate turns must be deleted.  Of cheapest edits the ASCII-least audit wins.

Memory: solving takes one block, replaying one row and the conversation's
audit (which is a column value).  A conversation is sorted, and spilled, by
the one task that replays it: its digest is a sequential function of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import drop_durable, durable, tidy, utf8

BLOCK = 128
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3  # more, for a truncated turn that stays
SPACES = " \t\n\x0b\x0c\r"
# states: 0 nothing yet, 1 after a system turn, 2 after user, 3 after assistant; 0 and 3 may end
NEXT = (2, 2, 3, 2)  # a user or assistant turn that fits
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, 2, 1, 0)  # turns to insert at the end
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def solve(signature: str, whole: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of the cheapest edits of one block for each pair of states that edits can join.

    ``whole``: the block is a conversation; only entry 0 and the exit -1,
    with what must be inserted at the end.  Inserts belong to the block of the
    turn they precede, so audits of one entry are never prefixes of each other.
    """

    @cache
    def best(i: int, state: int) -> dict[int, tuple[int, str]]:
        if i == len(signature):
            return {-1: (COSTS["I"] * ENDS[state], "I" * ENDS[state])} if whole else {state: (0, "")}
        out: dict[int, tuple[int, str]] = {}
        code, at = signature[i], state
        for inserted in range(3):
            steps = [("D", COSTS["D"], at)]
            if code != "-":
                more = TRUNCATED if code.isupper() else 0
                steps.append(("R", COSTS["R"] + more, NEXT[at]))
                if (code.lower(), at) in KEPT:
                    steps.append(("K", COSTS["K"] + more, KEPT[code.lower(), at]))
            for letter, cost, after in steps:
                for leave, (rest, audit) in best(i + 1, after).items():
                    found = (COSTS["I"] * inserted + cost + rest, "I" * inserted + letter + audit)
                    if leave not in out or found < out[leave]:
                        out[leave] = found
            at = NEXT[at]
        return out

    return [(entry, leave, *found) for entry in ((0,) if whole else range(4)) for leave, found in best(0, entry).items()]


def chain(blocks: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its blocks' paths, in order.

    For each state the cheapest way so far is kept as linked pieces with its
    place among the four by ASCII order, so no audit is copied or compared
    twice.
    """
    ways: dict[int, tuple[int, int, tuple | None]] = {0: (0, 0, None)}  # state: cost, place, pieces
    for paths in blocks:
        best: dict[int, tuple[int, int, str, tuple | None]] = {}
        for entry, leave, cost, audit in paths:
            if entry in ways:
                so_far, place, pieces = ways[entry]
                found = (so_far + cost, place, audit, pieces)
                if leave not in best or found[:3] < best[leave][:3]:
                    best[leave] = found
        order = {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        ways = {s: (c, order[s], (audit, pieces)) for s, (c, _, audit, pieces) in best.items()}
    least = min(c + COSTS["I"] * ENDS[s] for s, (c, _, _) in ways.items())
    done = []
    for s, (c, _, pieces) in ways.items():
        if c + COSTS["I"] * ENDS[s] == least:
            parts = ["I" * ENDS[s]]
            while pieces:
                parts.append(pieces[0])
                pieces = pieces[1]
            done.append("".join(reversed(parts)))
    return least, min(done)


def _rows(turns: DataFrame, dropped: str | None) -> DataFrame:
    gone = F.coalesce(F.col(dropped).cast("boolean"), F.lit(False)) if dropped else F.lit(False)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (~gone).alias("there"))


def _tie(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, signature, alone, counts, turns): texts stay behind, only their digests are shuffled."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", "b").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    d = rows.select("conv_id", "turn", "role", _tie(F.col("text")).alias("digest"), fault.alias("fault"), "there").repartition("conv_id")
    same = Window.partitionBy("conv_id", "there", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    own = Window.partitionBy("conv_id", "there").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    d = d.withColumn("fault", F.when((F.col("fault") != "b") & (F.row_number().over(same) > 1), "d").otherwise(F.col("fault")))
    initial = F.substring("role", 1, 1)
    d = d.withColumns({"pos": F.row_number().over(own) - 1, "pair": F.concat(F.lag(initial).over(own), initial), "before": F.lag("turn").over(own)})
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("b", "d"), "-").when(F.col("fault") == "t", F.upper(code)).otherwise(code)
    n = lambda cond: F.sum(F.when(F.col("there") & cond, 1).otherwise(0)).cast("long")
    fresh = F.col("turn").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("turn")))
    seen = F.when(F.col("there"), F.col("turn"))
    d = d.groupBy("conv_id", F.when(F.col("there"), F.floor(F.col("pos") / BLOCK)).otherwise(-1).cast("long").alias("block")).agg(
        _joined(code),
        *[n(F.col("fault") == k[0]).alias(k) for k in COUNTS[:3]],
        n((F.col("pos") > 0) & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        n(fresh).alias("turns"),
        F.min(seen).alias("low"),
        F.max(seen).alias("high"),
    )
    return d.withColumn("alone", F.max("block").over(Window.partitionBy("conv_id")) < 1)


def _joined(code: Column) -> Column:
    """The block's characters in order, null where no turn is left (at most BLOCK are gathered)."""
    listed = F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("pos", code.alias("c")))))
    return F.array_join(F.transform(listed, lambda x: x["c"]), "").alias("signature")


PATHS = "array<struct<entry:int, leave:int, cost:bigint, audit:string>>"


def _solved(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with their paths, table of solutions)."""

    def run(batches):
        for b in batches:
            paths = [[dict(zip(("entry", "leave", "cost", "audit"), p, strict=True)) for p in solve(s, w)] for s, w in zip(b["signature"], b["alone"], strict=True)]
            yield b.assign(paths=paths)

    live = blocks.where("block >= 0")
    once = durable(live.groupBy("signature", "alone").agg(F.count(F.lit(1)).alias("n")).mapInPandas(run, f"signature string, alone boolean, n long, paths {PATHS}"), "repair-solutions")
    total = once.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # signatures that hold a thousandth of the blocks, so a thousand at most, are broadcast; of the rest none is hot
    often = F.col("n") * 1000 >= total
    key = ["signature", "alone"]
    marked = live.join(F.broadcast(once.where(often).select(*key, "paths")), key, "left")
    hot = marked.where("paths is not null")
    cold = marked.where("paths is null").drop("paths").join(once.where(~often).select(*key, "paths"), key)
    return hot.unionByName(cold), once


def audit(turns: DataFrame, dropped: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation.

    ``turns`` has conv_id, turn, role and text; where ``dropped`` names a
    boolean column, rows that it marks do not count, but their conversations
    are listed, with zeros and an empty audit if no row is left.  Turns stand by
    number, nulls first, rows of one number by role and the SHA-256 of the text.
    Null roles and texts are one space; a null conv_id is a conversation like
    any other; rows that repeat role and text of an earlier one are duplicates;
    an empty table gives an empty one; other columns are ignored.
    """
    blocks = durable(_blocks(_rows(turns, dropped)), "repair-blocks")
    solved, once = _solved(blocks)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def chained(batches):
        at, held, first = None, [], True
        for b in batches:
            ids = b.column("conv_id").to_pylist()
            for i, paths in zip(ids, b.column("paths").to_pylist(), strict=True):
                if not first and i != at:
                    yield _answer(b.schema.field("conv_id").type, at, held)
                    held = []
                at, first = i, False
                held.append([tuple(p.values()) for p in paths])
        if held:
            yield _answer(b.schema.field("conv_id").type, at, held)

    one = solved.where("alone").select("conv_id", F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit"))
    many = solved.where("not alone").select("conv_id", "block", "paths").repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "paths")
    many = many.mapInArrow(tidy(chained), f"conv_id {kind}, cost long, audit string")
    parts = one.unionByName(many).unionByName(blocks.select("conv_id", *COUNTS, "turns", "low", "high"), allowMissingColumns=True)
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = parts.groupBy("conv_id").agg(zero(gaps).alias("gaps"), *[zero(F.sum(c)).alias(c) for c in COUNTS], zero(F.max("cost")).alias("cost"), F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    out = durable(out, "repair-audits")
    drop_durable(blocks, once)
    return out


def _answer(kind: pa.DataType, at, held: list) -> pa.RecordBatch:
    cost, text = chain(held)
    return pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([cost], pa.int64()), pa.array([text], pa.string())], ["conv_id", "cost", "audit"])


def _stream(turns: DataFrame, audits: DataFrame, dropped: str | None) -> DataFrame:
    """Each conversation's audit followed by its turns in order, conversation after conversation."""
    rows = _rows(turns, dropped).where("there").select("conv_id", "turn", "role", "text", _tie(F.col("text")).alias("tie"))
    both = audits.withColumn("is_turn", F.lit(False)).unionByName(rows.withColumn("is_turn", F.lit(True)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", F.asc_nulls_first("turn"), "role", "tie").drop("tie")


def _edits(batches) -> Iterator[tuple]:
    """(batch, row, letter, role, text): letter None for an audit's own row; roles and texts are bytes."""
    names = (b"user", b"assistant")
    todo, at, state, head = "", 0, 0, None
    for b in batches:
        audits, is_turn = b.column("audit").to_pylist(), b.column("is_turn").to_pylist()
        roles, texts = utf8(b.column("role")), utf8(b.column("text"))
        for i, turn in enumerate(is_turn):
            if not turn:
                while at < len(todo):  # the rest can only be inserts
                    yield *head, "I", names[NEXT[state] == 3], b""
                    state, at = NEXT[state], at + 1
                todo, at, state, head = audits[i], 0, 0, (b, i)
                yield b, i, None, None, None
                continue
            while todo[at] == "I":
                yield *head, "I", names[NEXT[state] == 3], b""
                state, at = NEXT[state], at + 1
            letter, at = todo[at], at + 1
            role = roles[i]
            if letter == "R":
                role, state = names[NEXT[state] == 3], NEXT[state]
            elif letter == "K":
                state = KEPT[role[:1].decode(), state]
            yield b, i, letter, role, texts[i]
    while at < len(todo):
        yield *head, "I", names[NEXT[state] == 3], b""
        state, at = NEXT[state], at + 1


def replay(turns: DataFrame, audits: DataFrame, dropped: str | None = None) -> DataFrame:
    """(conv_id, place, edit, turn, role, text) of the repaired conversations, deleted turns left out.

    ``place`` counts from 0; inserted turns have no number.  Cases as in :func:`audit`.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        held: list[tuple] = []
        size, place, own, id_type = 0, 0, None, None

        def pack():
            cols = list(zip(*held, strict=True))
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) if k != pa.binary() else pa.array(c, k).cast(pa.string(), safe=False) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "place", "edit", "turn", "role", "text"])

        for b, i, letter, role, text in _edits(batches):
            if letter is None:
                own, place, id_type = b.column("conv_id")[i].as_py(), 0, b.schema.field("conv_id").type
            elif letter != "D":
                held.append((own, place, letter, None if letter == "I" else b.column("turn")[i].as_py(), role.decode("utf-8", "replace").encode(), text.decode("utf-8", "replace").encode()))
                place, size = place + 1, size + len(text)
                if len(held) >= 1000 or size > 4 << 20:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    return _stream(turns, audits, dropped).mapInArrow(tidy(run), f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def repair(turns: DataFrame, dropped: str | None = None) -> DataFrame:
    """:func:`audit` with repaired_sha256: the digest of the repaired ``role:text`` lines, joined by newlines.

    Cases as in :func:`audit`; a conversation of which nothing is left has the
    digest of the empty string.
    """
    audits = audit(turns, dropped)
    names = ["conv_id", "gaps", *COUNTS, "cost", "audit"]
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        batch, rows, digests, sha, lines = None, [], [], None, 0

        def pack():
            at = pa.array(rows, pa.int32())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(digests, pa.string())], [*names, "repaired_sha256"])

        for b, i, letter, role, text in _edits(batches):
            if letter is None:
                if sha is not None:
                    digests.append(sha.hexdigest())
                if b is not batch:
                    if rows:
                        yield pack()
                    batch, rows, digests = b, [], []
                rows.append(i)
                sha, lines = hashlib.sha256(), 0
            elif letter != "D":
                if lines:
                    sha.update(b"\n")
                sha.update(role + b":")
                sha.update(text)
                lines += 1
        if sha is not None:
            digests.append(sha.hexdigest())
            yield pack()

    return _stream(turns, audits, dropped).mapInArrow(tidy(run), f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Planted faults by crc32(``conv_id:turn``) % 20: 0 marks the row ``dropped``, 1 empties the text, 2 removes its sentence marks, 3 repeats it, 4 makes it the user's; nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    d = turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), (k == 0).alias("dropped"), F.when(k == 3, 2).otherwise(1).alias("_copies"))
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")
