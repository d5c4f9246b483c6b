"""The same results in plain Python, and rows that hold the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "éa", "stone", "river", "x"]) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    base, long = prose(1, 120), prose(2, 9000)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "  \n\t ", "one", "one two three", "One TWO three", base, base, " ".join(near), long, long + " tail", "\n".join([prose(3, 12)] * 6),
             prose(4, 60) + "\n" + base + "\n" + prose(5, 60), "### *** $$$ %%% &&& ### *** $$$ %%% &&& ###", "ü" * 500, "a" * 1000, prose(6, 40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None), (None, None, None, None, None), (40, prose(7, 80), "de", None, 1), (41, prose(7, 80), "de", "", 1)]
    return rows


def repeated_windows(texts: list[str | None], k: int) -> list[tuple]:
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in lists for i in range(len(w) - k + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def repeated_bytes(texts: list[str | None], k: int) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + k] for r in raws for i in range(len(r) - k + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - k + 1):
            if seen[r[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        spans = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, sha(bytes(x for x, g in zip(r, gone) if not g))))
    return out


def shingles(text: str | None) -> set:
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(sets: list[set], percent: int) -> list[int]:
    """Index of the first row of each row's group."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]
