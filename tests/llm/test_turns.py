"""Conversation repair against dynamic programming over whole conversations."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from assay.llm import conversations, turn_edits

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(letters):
    """(cost, edits) by trying everything from the end, with at most two inserts in a row."""
    @lru_cache(None)
    def best(i, last, inserted):
        out = []
        if i == len(letters) and last in ("", "a"):
            out.append((0, ""))
        def offer(edit, cost, rest):
            if rest is not None:
                out.append((cost + rest[0], edit + rest[1]))
        if inserted < 2:
            offer("I", 5, best(i, NEXT[last], inserted + 1))
        if i < len(letters):
            row = letters[i]
            offer("D", 2, best(i + 1, last, 0))
            if row != "x":
                cut = 5 if row.isupper() else 0
                if row.lower() == NEXT[last] or (row.lower() == "s" and last == ""):
                    offer("K", cut, best(i + 1, row.lower(), 0))
                offer("R", cut + 1, best(i + 1, NEXT[last], 0))
        return min(out, default=None)
    return best(0, "", 0)


def brute(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in convs.items():
        same = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], same(r)))
        seen, letters, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits = cheapest(letters)
        lines, i, last = [], 0, ""
        for e in edits:
            if e != "D":
                role = {"u": "user", "a": "assistant"}[NEXT[last]] if e != "K" else own[i][1]
                lines.append(role + ":" + ("" if e == "I" else own[i][2]))
                last = role[:1]
            i += e != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, digest))
    return sorted(out, key=repr)


def test_search_finds_the_least_of_the_cheapest():
    rng = random.Random(5)
    for _ in range(600):
        letters = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(1, 9)))
        cost, edits, state = turn_edits.search(letters, turn_edits.NOTHING, {turn_edits.NOTHING: 0, turn_edits.ASSISTANT: 0}, True)
        assert (cost, edits) == cheapest(letters), letters


def test_search_from_state_to_state():
    assert turn_edits.search("xx", turn_edits.USER, {turn_edits.NOTHING: 0}, False) is None
    assert turn_edits.search("u", turn_edits.NOTHING, {turn_edits.SYSTEM: 0}, False) is None
    assert turn_edits.search("s", turn_edits.NOTHING, {turn_edits.SYSTEM: 0}, False) == (0, "K", turn_edits.SYSTEM)
    assert turn_edits.search("x", turn_edits.USER, {turn_edits.ASSISTANT: 0}, False) == (7, "ID", turn_edits.ASSISTANT)


def test_estimates_are_lower_bounds():
    rng = random.Random(6)
    for _ in range(200):
        letters = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 8)))
        assert turn_edits.estimates(letters, {turn_edits.NOTHING: 0, turn_edits.ASSISTANT: 0})[0][0] <= cheapest(letters)[0]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [1024, 3])
def test_all_conversations(spark, sf, size):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert rows_of(conversations.repaired(table.repartition(4), size=size)) == brute(rows)


@pytest.mark.parametrize("size", [2, 4, 1024])
def test_odd_rows(spark, size):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "User"], ["Yes.", "No", "", None, " \n", "Why?\n", "a.b", "Ja!", "Oui. "]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in (1, 2, 3, 4, 5, None) for t in [None, None, *range(11)]]
    rows += [(9, None, None, None), (8, 3, "user", "w " * 200_000 + "end."), (8, 5, "user", "Hm.")] + [(7, 1, "user", "Same.")] * 6
    rows += [(n, 1, "system", "S.") for n in range(100, 140)]
    df = spark.createDataFrame([(*r, "x", 1, True, "y") for r in rows], "conv_id long, turn long, role string, text string, id string, block int, none boolean, place string").repartition(3)
    assert rows_of(conversations.repaired(df, size=size)) == brute(rows)


def test_empty_table(spark):
    assert conversations.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
