"""Cheapest edits that make a string of turns follow ``(s?(ua)+)?``, by Wagner-Fischer tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# A turn is one letter: the initial of its role (o: any other), upper case if it is cut off,
# or a digit, the place of that initial in INITIALS, if it must go.
INITIALS = "suao"
FAR = 1 << 28
BLOCK = 32

# Where a conversation stands: at its beginning, behind a system turn, where a user turn
# comes next (or the end), and where an assistant turn comes next.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
# Cost and edits that end the string there.
AT_END = {BEGIN: (0, ""), SYSTEM: (4, "II"), USER: (0, ""), ASSISTANT: (2, "I")}


def initial(code: str) -> str:
    return INITIALS[int(code)] if code.isdigit() else code.lower()


def _ends(start: int, length: int) -> int:
    """Where one stands after ``length`` symbols u, a, u, … (a, u, … from ASSISTANT)."""
    if not length:
        return start
    return ASSISTANT if (length + (start == ASSISTANT)) % 2 else USER


def _incumbent(codes: str, symbol: str) -> tuple[int, int]:
    """Edits of a quick alignment, and its length: a turn of the other side gets an
    inserted turn before it, any other its role changed.
    """
    edits, length = 0, 0
    for code in codes:
        if code.isdigit():
            continue
        if code.lower() != symbol:
            edits += 1
            if code.lower() in "ua":
                length += 1
                symbol = code.lower()
        length += 1
        symbol = "a" if symbol == "u" else "u"
    return edits, length


def _aligned(codes: str, start: int, lead: bool, tails: dict[int, int]) -> tuple[int, str, int]:
    """(cost with the tail, edits, end) of the turns against every feasible length of the
    grammar from ``start``; ``lead``: behind a kept system turn of these turns.

    One table a length, all filled side by side from the last turn on: cell (i, j) has the
    cost of turns i.. against symbols j... Insertions behind the last turn are left to what
    follows. A length is feasible, and a cell inside its band, unless the turns it has to
    lose or to insert alone cost more than a quick alignment. The edits are traced through
    the tables of all cheapest lengths at once: an edit leads each of them to the same
    cell, so the least initial at each cell gives the least audit of all.
    """
    n, first = len(codes), "a" if start == ASSISTANT else "u"
    must = np.array([c.isdigit() for c in codes])
    cut = np.array([c.isupper() for c in codes], dtype=np.int64)
    kind = np.array([initial(c) for c in codes])
    free = np.concatenate([[0], np.cumsum(~must)])
    base = 3 * int(must.sum()) + int(cut.sum())

    if lead:
        # symbol 0 is the system turn: the quick alignment keeps the first one, all before goes
        kept = next((i for i, c in enumerate(codes) if c in "sS"), None)
        if kept is None:
            return FAR, "", start
        edits, quick = _incumbent(codes[kept + 1:], "u")
        lost = sum(3 - int(c.isupper()) for c in codes[:kept] if not c.isdigit())
        known = base + lost + 2 * edits + tails[_ends(SYSTEM, quick)]
    else:
        edits, quick = _incumbent(codes, first)
        known = base + 2 * edits + tails[_ends(start, quick)]

    after = SYSTEM if lead else start
    reach = max(0, known - base - min(tails.values())) // 2
    middle = int(free[n])
    lengths = [m for m in range(max(int(lead), middle - reach), middle + reach + 1)
               if base + 2 * abs(middle - m) + tails[_ends(after, m - lead)] <= known]
    if not lengths:
        return FAR, "", start
    width = max(lengths)
    other = {"u": "a", "a": "u"}
    symbols = [first if (j - lead) % 2 == 0 else other[first] for j in range(width)]
    if lead:
        symbols[0] = "s"
    target = np.array(symbols, dtype="<U1") if symbols else np.empty(0, "<U1")
    changeable = target != "s"

    cells = np.full((n + 1, len(lengths), width + 1), FAR, dtype=np.int64)
    for k, m in enumerate(lengths):
        cells[n, k, m] = tails[_ends(after, m - lead)]
    slope = 2 * np.arange(width + 1)
    for i in range(n - 1, -1, -1):
        low, high = max(0, int(free[i]) - reach), min(width, int(free[i]) + reach)
        if low > high:
            continue
        row, below = cells[i, :, low:high + 1], cells[i + 1]
        np.minimum(3 + below[:, low:high + 1], FAR, out=row)
        if not must[i]:
            to = min(high + 1, width)
            use = np.where(target[low:to] == kind[i], 0, np.where(changeable[low:to], 2, FAR)) + cut[i]
            row[:, :to - low] = np.minimum(row[:, :to - low], np.minimum(use + below[:, low + 1:to + 1], FAR))
        behind = int(lead and low == 0)  # no system turn is inserted
        sloped = row[:, behind:] + slope[low + behind:high + 1]
        if sloped.shape[1]:
            row[:, behind:] = np.minimum(np.minimum.accumulate(sloped[:, ::-1], axis=1)[:, ::-1] - slope[low + behind:high + 1], FAR)

    totals = cells[0, :, 0]
    best = int(totals.min())
    if best >= FAR:
        return FAR, "", start
    alive = np.flatnonzero(totals == best)
    audit, i, j = [], 0, 0
    while i < n:
        here = cells[i, alive, j]
        ways = [("D", 3, i + 1, j)]
        if j < width and not (lead and j == 0):
            ways.append(("I", 2, i, j + 1))
        if j < width and not must[i]:
            if target[j] == kind[i]:
                ways.append(("K", int(cut[i]), i + 1, j + 1))
            elif target[j] != "s":
                ways.append(("R", 2 + int(cut[i]), i + 1, j + 1))
        for letter, cost, to_i, to_j in ways:
            same = alive[here == cost + cells[to_i, alive, to_j]]
            if len(same):
                audit.append(letter)
                alive, i, j = same, to_i, to_j
                break
    return best, "".join(audit), _ends(after, j - lead)


@lru_cache(100_000)
def _block(codes: str, start: int, *tails: int) -> tuple[int, str, int]:
    """The cheaper of the alignments without and with a leading system turn; of equal ones
    that of the least edits.
    """
    costs = dict(enumerate(tails))
    found = _aligned(codes, start, False, costs)
    if start == BEGIN:
        found = min(found, _aligned(codes, start, True, costs))
    return found


def align(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation; of equally cheap ones the
    audit least in ASCII order.

    Keep (0), Rerole to u or a (2), Delete (3), Insert a u or a (2); a digit can only go; an
    upper-case letter that stays costs 1 more. Long conversations are aligned a block at a
    time, the last first, from each place the grammar can stand at before it; blocks end
    where a turn does, so memory and time a turn don't grow with the conversation.
    """
    starts = range(0, len(codes), block)
    costs = {s: AT_END[s][0] for s in AT_END}
    chosen: list[dict[int, tuple[str, int]]] = []
    for at in reversed(starts):
        part, least = codes[at:at + block], min(costs.values())
        found = {s: _block(part, s, *(costs[k] - least for k in range(4))) for s in ([BEGIN] if at == 0 else range(4))}
        chosen.append({s: (edits, end) for s, (_, edits, end) in found.items()})
        costs = {s: cost + least for s, (cost, _, _) in found.items()}
    state, audit = BEGIN, []
    for choice in reversed(chosen):
        edits, state = choice[state]
        audit.append(edits)
    return (costs[BEGIN], "".join(audit) + AT_END[state][1])
