"""Shortest edit paths over the lattice of one conversation, by the auction algorithm, and their lexicographic trace.

A node is a row boundary and what has been said so far (nothing, the system turn, a user turn last, an assistant turn last). Arcs are
edits with small integer costs. The auction keeps a price for every node such that no arc is dearer to leave than to take,
``price(i) <= cost(i, j) + price(j)``, and one path from the origin: its last node is extended along the arc that offers the least, or,
where every offer is above the node's price, the price rises to the best offer and the path contracts by that node. Prices only
rise and stay feasible, so the origin's price is its distance once the path arrives.
"""

from __future__ import annotations

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS, FAULTS = "sua", ("fine", "blank", "duplicate", "truncated")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER = len(INITIALS)
KEEP, REROLE, DELETE, INSERT, LATE = 0, 2, 3, 2, 1
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The turn that an insertion or a new role gives, and the cost of insertions that end a conversation, by what was said last.
TURN = ("u", "u", "a", "u")
CLOSING = (0, 2 * INSERT, INSERT, 0)
BLOCK = 32


def letter(initial: int, fault: int) -> str:
    """One character for a row: which initial its role has, and its first fault."""
    return chr(65 + 4 * initial + fault)


def _arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """For each state the edits (letter, cost, state after, rows used) of a row with this code, in order of their letters."""
    initial, fault = divmod(code, 4)
    late = LATE if fault == TRUNCATED else 0
    out = []
    for state in range(4):
        target = FOLLOWS[state][TURN[state]]
        edits = [("D", DELETE, state, 1), ("I", INSERT, target, 0)]
        if fault not in (BLANK, DUPLICATE):
            if initial < OTHER and INITIALS[initial] in FOLLOWS[state]:
                edits.append(("K", KEEP + late, FOLLOWS[state][INITIALS[initial]], 1))
            edits.append(("R", REROLE + late, target, 1))
        out.append(edits)
    return out


ARCS = [_arcs(code) for code in range(4 * (OTHER + 1))]


class Lattice:
    """Prices of the nodes of some consecutive rows; ``ahead`` are the distances to the end from the states behind the last row."""

    def __init__(self, codes: str, ahead: list[int]):
        self.rows = [ARCS[ord(c) - 65] for c in codes]
        self.shift = min(ahead)
        self.ahead = [x - self.shift for x in ahead]
        self.prices = [0] * (4 * len(codes) + 5)  # the last is the end

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        at, state = divmod(node, 4)
        if at == len(self.rows):
            return [("", self.ahead[state], 4 * at + 4)]
        return [(name, cost, 4 * (at + used) + after) for name, cost, after, used in self.rows[at][state]]

    def settle(self, origin: int) -> int:
        """Distance from ``origin`` to the end of all rows."""
        prices, path, end = self.prices, [origin], len(self.prices) - 1
        while path[-1] != end:
            node = path[-1]
            offer, following = min((cost + prices[j], j) for _, cost, j in self.arcs(node))
            if prices[node] < offer:
                prices[node] = offer
                if len(path) > 1:
                    path.pop()
            else:
                path.append(following)
        return prices[origin] + self.shift

    def trace(self, state: int) -> tuple[str, int]:
        """The least letters of a shortest path from the first row on, and the state behind the last row.

        An arc is tight if its offer equals the price; it lies on a shortest path if it stays tight once its end is settled too.
        """
        self.settle(state)
        node, out = state, []
        while node < 4 * len(self.rows):
            for name, cost, j in self.arcs(node):
                if self.prices[node] == cost + self.prices[j]:
                    self.settle(j)
                    if self.prices[node] == cost + self.prices[j]:
                        break
            out.append(name)
            node = j
        return "".join(out), node % 4


def repair(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and the edits' letters of rows given by ``letter``; among equal costs the letters that come first in ASCII.

    Rows are taken in blocks from the last to the first, each with the settled distances of the next one, so the auction's path never
    spans more than a block; then the blocks are traced from the first to the last.
    """
    first = [codes[a : a + block] for a in range(0, len(codes), block)]
    ahead = [list(CLOSING)]
    for rows in reversed(first):
        lattice = Lattice(rows, ahead[-1])
        ahead.append([lattice.settle(s) for s in range(4)])
    letters, state = [], START
    for rows, further in zip(first, reversed(ahead[:-1])):
        found, state = Lattice(rows, further).trace(state)
        letters.append(found)
    return ahead[-1][START], "".join(letters) + "I" * (CLOSING[state] // INSERT)

