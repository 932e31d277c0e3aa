"""Cheapest edits that turn a conversation into alternating turns, by iterative-deepening A*.

A conversation's rows are read left to right; what matters of the rows left so far is one of four states. The
search goes depth first, trying edits in the order of their letters, under a cost bound that grows to the least
estimate beyond it; places that failed are remembered with the budget they failed with. The first path to the
goal is the cheapest, and of the cheapest the least by letters. The estimate is the cost of a simpler problem:
a system turn and a finished pair are not told apart and any end is accepted.

Conversations are cut into blocks of rows which are searched apart, from every state to every state; since a
block's letters hold as many rows on every path, the best path to each state can be carried from block to block.
"""

from __future__ import annotations

#: States: nothing left so far, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Letters of rows: s, u, a, o for any other role; upper case where the row is truncated; x where it must be deleted.
DELETE, RELABEL, INSERT, TRUNCATED = 2, 1, 5, 5
#: Edits that end a conversation in each state.
TAILS = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
MUST_GO = "x"
_FAR = 1 << 60


def turned(state: int) -> int:
    """State after a turn that continues the alternation."""
    return ASSISTANT if state == USER else USER


def role_of(state: int) -> str:
    """Role of the turn that led to a state, where it was inserted or given a new role."""
    return "user" if state == USER else "assistant"


def kept_state(state: int, letter: str) -> int | None:
    """State after a row is kept as it is; None where it does not fit."""
    if letter == "s":
        return SYSTEM if state == NOTHING else None
    if letter == ("a" if state == USER else "u"):
        return turned(state)
    return None


def estimates(rows: str, goals: dict[int, int]) -> list[list[int]]:
    """Lower bounds of the cost from each row and state, by one backward pass over the simpler problem.

    goals: cost that follows each end state. Every end counts as the cheapest goal.
    """
    end = min(goals.values())
    after = [end] * 4
    out = [after]
    for row in reversed(rows):
        letter, cut = row.lower(), TRUNCATED if row.isupper() else 0
        gone = [DELETE + h for h in after]
        if row == MUST_GO:
            now = gone
        else:
            now = list(gone)
            for state in (NOTHING, SYSTEM, USER, ASSISTANT):
                kept = kept_state(state, letter)
                cost = RELABEL + after[turned(state)]
                now[state] = min(now[state], cut + (cost if kept is None else min(cost, after[kept])))
        # an inserted turn leads to the state after it, a second one from there to the next
        for _ in range(2):
            now = [min(now[s], now[turned(s)] + INSERT) for s in range(4)]
        now[SYSTEM] = now[ASSISTANT] = min(now[SYSTEM], now[ASSISTANT])
        out.append(now)
        after = now
    out.reverse()
    return out


def search(rows: str, start: int, goals: dict[int, int], tails: bool) -> tuple[int, str, int] | None:
    """(cost, letters, end state) of the cheapest path from start over all rows, the least by letters of equals.

    goals: cost that follows each accepted end state, in which the path must be when the last row is done. With
    tails, inserts after the last row lead on to an accepted end; otherwise the path ends with the last row.
    """
    if not _possible(rows, start, goals):
        return None
    guess, n = estimates(rows, goals), len(rows)
    bound = guess[0][start]
    while bound < _FAR:
        found, bound = _deepen(rows, start, goals, tails, guess, n, bound)
        if found is not None:
            return found
    return None


def _possible(rows: str, start: int, goals: dict[int, int]) -> bool:
    """Whether some path exists. Turns can always be inserted before a row, but nothing leads back to the first two states."""
    if not rows:
        return False
    if USER in goals or ASSISTANT in goals:
        return True
    if NOTHING in goals and start == NOTHING:
        return True
    return SYSTEM in goals and (start == SYSTEM or (start == NOTHING and ("s" in rows or "S" in rows)))


def _moves(rows: str, place: int, state: int, n: int, goals: dict[int, int], tails: bool):
    """Edits at a place in the order of their letters: (letter, cost, next place, next state)."""
    if place == n:
        if tails:
            yield "I", INSERT, place, turned(state)
        return
    row = rows[place]
    yield "D", DELETE, place + 1, state
    yield "I", INSERT, place, turned(state)
    if row != MUST_GO:
        cut = TRUNCATED if row.isupper() else 0
        kept = kept_state(state, row.lower())
        if kept is not None:
            yield "K", cut, place + 1, kept
        yield "R", cut + RELABEL, place + 1, turned(state)


def _deepen(rows, start, goals, tails, guess, n, bound):
    """The first path within the bound; or None and the least estimate beyond it."""
    failed: dict[tuple[int, int], int] = {}
    beyond = _FAR
    path: list[str] = []
    stack = [(0, start, bound, _moves(rows, 0, start, n, goals, tails))]
    while stack:
        place, state, left, moves = stack[-1]
        if place == n and goals.get(state, _FAR) <= left:
            return (bound - left + goals[state], "".join(path), state), bound
        for letter, cost, then, into in moves:
            rest = left - cost
            least = guess[then][into] if then < n else goals.get(into, min(goals.values()) if tails else _FAR)
            if least > rest:
                beyond = min(beyond, bound + least - rest)
                continue
            if failed.get((then, into), -1) >= rest:
                continue
            path.append(letter)
            stack.append((then, into, rest, _moves(rows, then, into, n, goals, tails)))
            break
        else:
            if place == n and goals.get(state, _FAR) < _FAR and goals[state] > left:
                beyond = min(beyond, bound + goals[state] - left)
            failed[place, state] = max(failed.get((place, state), -1), left)
            stack.pop()
            if path:
                path.pop()
    return None, beyond
