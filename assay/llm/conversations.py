"""Repair of conversations: faults of their turns, and the cheapest edits to alternating roles.

Faults are found by grouping and numbering narrow rows without texts. A conversation's letters are then cut
into blocks of rows, each searched in a task of its own (turn_edits). Last, blocks and texts of a conversation
meet in order in one pass that holds a block or a text at a time: it joins the blocks' best paths and feeds the
digest of the repaired text, which can only be taken from front to back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assay.functions.ordered import row_index
from assay.llm import turn_edits as T
from assay.llm.text import bound_batches
from assay.session import staged

#: Rows of a conversation that are searched together.
BLOCK = 1024
#: Remainders of crc32 modulo DAMAGES: row dropped, text emptied, ends of sentences removed, row repeated, role set to user.
DAMAGES = 20
DROP, EMPTY, UNENDED, REPEAT, USURP = range(5)

_WHITE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_NUMBERS = "n_blank long, n_duplicate long, n_truncated long, illegal long, low long, high long, n_turns long, first_turn long, last_turn long"
_BLOCK = f"first string, last string, letters string, {_NUMBERS}, paths array<struct<start:int,end:int,cost:long,edits:string>>"
BLOCKS = f"none boolean, id string, block long, {_BLOCK}"
FOUND = "none boolean, id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(none, id, turn, role, text): rows after damage, as the checksum of conversation and turn chooses it."""
    kind = F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn)).cast("binary")) % DAMAGES
    some = rows.select(F.col(conv).isNull().alias("none"), F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("id"), F.col(turn).cast("long").alias("turn"),
                       _text(role).alias("role"), _text(text).alias("text"), kind.alias("kind")).where(F.col("kind") != DROP)
    copies = F.explode(F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    left = F.when(F.col("kind") == EMPTY, F.lit("")).when(F.col("kind") == UNENDED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return some.select("none", "id", "turn", F.when(F.col("kind") == USURP, F.lit("user")).otherwise(F.col("role")).alias("role"), left.alias("text"), copies.alias("copy")).drop("copy")


def lettered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (none, id, place, turn, initial, letter) in order, and the rows with texts and that order.

    Rows go by turn, nulls first, then role, text digest and place in the input.
    """
    end = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    base = rows.select("none", "id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), same.alias("same"), F.monotonically_increasing_id().alias("row"))
    base = staged(base, "turns").withColumn("at", F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "same", "row"))
    narrow = base.drop("role", "text")
    first = narrow.groupBy("none", "id", "same").agg(F.min("at").alias("_first")).select(F.col("_first.row").alias("row"), F.lit(True).alias("earliest"))
    narrow = narrow.join(first, "row", "left")
    own = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    fault = F.when(F.col("blank"), "blank").when(F.col("earliest").isNull(), "duplicate").when(F.col("cut"), "truncated")
    narrow = narrow.select("none", "id", "at", "turn", own.alias("initial"), fault.alias("fault"))
    placed = row_index(narrow, ["none", "id"], "at", "place").drop("at")
    return placed, base.select("none", "id", "at", "role", "text")


def _searched(letters: str, first: bool, last: bool) -> list[dict]:
    """Cheapest paths over a block, from every state it may begin in to every state it may end in."""
    out = []
    for start in (T.NOTHING,) if first else range(4):
        if last:
            found = T.search(letters, start, {T.NOTHING: 0, T.ASSISTANT: 0}, True)
            out += [{"start": start, "end": found[2], "cost": found[0], "edits": found[1]}] if found else []
            continue
        for end in range(4):
            found = T.search(letters, start, {end: 0}, False)
            out += [{"start": start, "end": end, "cost": found[0], "edits": found[1]}] if found else []
    return out


def _block(rows: list[dict], number: int, size: int) -> dict:
    """What the conversation needs to know of a block."""
    letters = "".join(T.MUST_GO if r["fault"] in ("blank", "duplicate") else r["initial"].upper() if r["fault"] else r["initial"] for r in rows)
    initials = [r["initial"] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    count = lambda kind: sum(r["fault"] == kind for r in rows)
    # a block with room is the last of its conversation; of a full one the ends are left open
    return {
        "first": initials[0], "last": initials[-1], "letters": letters, "n_blank": count("blank"), "n_duplicate": count("duplicate"), "n_truncated": count("truncated"),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "low": min(turns, default=None), "high": max(turns, default=None), "n_turns": len(set(turns)),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "paths": _searched(letters, number == 0, len(rows) < size),
    }


def blocks(placed: DataFrame, size: int) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))
    rows = placed.groupBy("none", "id", F.floor(F.col("place") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "turn", "initial", "fault"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"none": r["none"], "id": r["id"], "block": r["block"], **_block(r["rows"], r["block"], size)} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, BLOCKS)


class _Conversation:
    """One conversation while its blocks, then its texts, go by."""

    def __init__(self, key):
        self.key = key
        self.best = {T.NOTHING: (0, 0, None)}  # state: cost, rank by letters, the path as (earlier path, edits)
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.low = self.high = self.last = self.last_turn = None
        self.edits = None
        self.letters: list[str] = []
        self.digest, self.begun, self.at, self.row, self.state = hashlib.sha256(), False, 0, 0, T.NOTHING

    def block(self, b: dict) -> None:
        n = self.n
        for kind in ("blank", "duplicate", "truncated"):
            n[kind] += b[f"n_{kind}"]
        n["illegal"] += b["illegal"] + (self.last is not None and self.last + b["first"] not in _LEGAL)
        n["turns"] += b["n_turns"] - (self.last_turn is not None and self.last_turn == b["first_turn"])
        self.last = b["last"]
        if b["last_turn"] is not None:
            self.last_turn, self.high = b["last_turn"], b["high"]
            self.low = b["low"] if self.low is None else self.low
        self.letters.append(b["letters"])
        offers: dict[int, list] = {}
        for p in b["paths"]:
            if p["start"] in self.best:
                cost, rank, path = self.best[p["start"]]
                offers.setdefault(p["end"], []).append((cost + p["cost"], rank, p["edits"], path))
        chosen = {end: min(o, key=lambda e: e[:3]) for end, o in offers.items()}
        order = sorted((e[1:3], end) for end, e in chosen.items())
        ranks = {end: i for i, (_, end) in enumerate(order)}
        self.best = {end: (cost, ranks[end], (path, edits)) for end, (cost, _, edits, path) in chosen.items()}

    def decide(self) -> None:
        """Choose the path. A full last block leaves its ends open, so inserts may have to follow it."""
        ends = []
        for state, (cost, rank, path) in self.best.items():
            more, tail = T.TAILS[state]
            ends.append((cost + more, rank, tail, path))
        self.cost, _, tail, path = min(ends, key=lambda e: e[:3])
        parts = [tail]
        while path is not None:
            path, edits = path
            parts.append(edits)
        self.edits, self.known = "".join(reversed(parts)), "".join(self.letters)

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun = True

    def _inserted(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = T.turned(self.state)
            self._line(T.role_of(self.state), "")

    def text(self, role: str, text: str) -> None:
        if self.edits is None:
            self.decide()
        self._inserted()
        edit, letter = self.edits[self.at], self.known[self.row]
        self.at, self.row = self.at + 1, self.row + 1
        if edit == "K":
            self.state = T.kept_state(self.state, letter.lower())
            self._line(role, text)
        elif edit == "R":
            self.state = T.turned(self.state)
            self._line(T.role_of(self.state), text)

    def result(self) -> dict:
        if self.edits is None:
            self.decide()
        self._inserted()
        n = self.n
        gaps = 0 if self.low is None else self.high - self.low + 1 - n["turns"]
        return {"none": self.key[0], "id": self.key[1], "gaps": gaps, **{k: n[k] for k in ("blank", "duplicate", "truncated", "illegal")},
                "cost": self.cost, "audit": self.edits, "repaired_sha256": self.digest.hexdigest()}


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks, then texts, of each conversation in order, to one row per conversation."""
    open_, done = None, []
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["none"], r["id"])
            if open_ is None or open_.key != key:
                if open_ is not None:
                    done.append(open_.result())
                open_ = _Conversation(key)
            if r["own"] is not None:
                open_.block(r["own"])
            else:
                open_.text(r["role"], r["text"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if open_ is not None:
        yield pa.RecordBatch.from_pylist([open_.result()], schema)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per conversation: its faults after damage, and the cheapest edits to alternating turns.

    A null conversation is one of its own, null turns come first, a null role or text is one space. Rows of equal
    turn go by role and text digest, repeated rows are one after the other (and duplicates). A conversation that
    lost all rows has zeros, no edits and the digest of the empty text; an empty table gives no rows. Turns are
    whole numbers. Conversations, and texts, may be of any length: only letters are held, a byte a row.
    """
    bound_batches(rows.sparkSession)
    placed, texts = lettered(damaged(rows, conv, turn, role, text))
    own = blocks(placed, size)
    own = own.select("none", "id", "block", F.struct(*own.columns[3:]).alias("own"))
    both = own.unionByName(texts, allowMissingColumns=True)
    in_order = both.repartition("none", "id").sortWithinPartitions("none", "id", F.col("own").isNull(), "block", "at").select("none", "id", "own", "role", "text")
    schema = to_arrow_schema(StructType.fromDDL(FOUND))
    found = in_order.mapInArrow(lambda batches: _joined(batches, schema), FOUND)
    names = rows.select(F.col(conv).alias("conv_id")).distinct().select("conv_id", F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"))
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return names.join(found, ["none", "id"], "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
