"""Deep-shallow sorting of byte strings: multikey sorting to a shallow depth, blind tries for what stays equal beyond it."""

from __future__ import annotations

import numpy as np

SHALLOW = 64


def common(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the longest common prefix, known to be at least ``low``."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Trie that keeps only branching depths and one byte per branch; a string is compared once, with the leaf it is led to."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth = strings, depth
        self.root: list | int | None = None  # an inner node is [depth, {byte or -1 at an end: child}]; a leaf is an index
        self.same: dict[int, list[int]] = {}

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root, self.same[i] = i, [i]
            return
        node = self.root
        while isinstance(node, list):
            byte = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(byte)
            if node is None:
                break
        if node is None:
            node = self._any(s)
        other = self.strings[node]
        lcp = common(s, other, self.depth)
        if lcp == len(s) == len(other):
            self.same[node].append(i)
            return
        self.same[i] = [i]
        mine, theirs = (s[lcp] if lcp < len(s) else -1), (other[lcp] if lcp < len(other) else -1)
        above, at = None, self.root
        while isinstance(at, list) and at[0] < lcp:
            above, at = at, at[1][s[at[0]] if at[0] < len(s) else -1]
        if isinstance(at, list) and at[0] == lcp:
            at[1][mine] = i
            return
        fresh = [lcp, {mine: i, theirs: at}]
        if above is None:
            self.root = fresh
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = fresh

    def _any(self, s: bytes) -> int:
        """A leaf below the last node that the string can be led to; all of them agree with each other as far as it matters."""
        node = self.root
        while isinstance(node, list):
            byte = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(byte) if byte in node[1] else next(iter(node[1].values()))
        return node

    def sorted(self) -> tuple[list[int], list[int]]:
        """Indices in order, and the common prefix of each with the one before it (0 for the first)."""
        order, lcps, todo, depth = [], [], [(self.root, 0)], 0
        while todo:
            node, depth = todo.pop()
            if isinstance(node, list):
                kids = sorted(node[1].items())
                todo.extend((child, node[0]) for _, child in reversed(kids[1:]))
                todo.append((kids[0][1], depth))
            else:
                for n, i in enumerate(self.same[node]):
                    lcps.append(len(self.strings[i]) if n else depth)
                    order.append(i)
        return order, lcps


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of each group (equal numbers, ascending): order over all, and the common prefix with the one before.

    The first string of a group has prefix -1. Multikey sorting takes eight bytes as one symbol and treats the sets of all groups
    together: a set that is equal so far is split by its next symbol. Sets still equal at SHALLOW bytes go to a blind trie each.
    A string that ends is filled up with zeros while sorting; sets of strings that may end early are left to the trie.
    """
    n = len(strings)
    order, lcps = np.arange(n), np.full(n, -1, np.int64)
    if not n:
        return order, lcps
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    bucket = groups.astype(np.int64)  # of the string at each place of the order
    live = np.arange(n)
    for step in range(SHALLOW // 8):
        at = np.flatnonzero((bucket[live][1:] == bucket[live][:-1])) if len(live) else live
        tied = np.zeros(len(live), bool)
        tied[at] = tied[at + 1] = True
        live = live[tied]
        if not len(live):
            break
        key = head[order[live], step]
        by = np.lexsort((key, bucket[live]))
        order[live], key = order[live][by], key[by]
        same = bucket[live][1:] == bucket[live][:-1]
        split = same & (key[1:] != key[:-1])
        differ = key[1:][split] ^ key[:-1][split]
        lead = np.array([64 - int(x).bit_length() for x in differ], np.int64) // 8
        place = live[1:][split]
        lcps[place] = np.minimum(8 * step + lead, np.minimum(lengths[order[place]], lengths[order[place - 1]]))
        start = np.concatenate([[True], ~same | split])
        bucket[live] = live[start][np.cumsum(start) - 1] + n * (step + 1)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            members = order[a:b].tolist()
            trie = BlindTrie([strings[i] for i in members], 0)
            for i in range(b - a):
                trie.add(i)
            inner, prefix = trie.sorted()
            order[a:b] = [members[i] for i in inner]
            lcps[a + 1 : b] = prefix[1:]
            for edge_at in (a, b):  # strings that end early may have changed places with their neighbours across the edge
                if edge_at < n and lcps[edge_at] >= 0:
                    lcps[edge_at] = common(strings[order[edge_at - 1]], strings[order[edge_at]])
    return order, lcps
