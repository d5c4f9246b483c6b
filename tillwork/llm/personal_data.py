"""Personal data: patterns with checks, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained on a bounded sample of windows (``sample`` of them, chosen by hash over the whole table) with the spans that have the
shape of a kind, and on altered copies of these windows whose spans the patterns miss: two kinds one behind the other, which the patterns
read as one number, other separators and groupings, bracketed signs, a missing plus; and on numbers that are nothing of the kind, such
as dates, prices and versions. Windows in which the patterns' own reading is doubtful are left out of the training.
Every text is then read in windows of WINDOW characters that overlap by half. Windows with neither an at sign nor four digits cannot hold
any of the kinds and are not decoded. Spans of all windows of a text are reconciled together: a span that touches an inner edge of
its window is left to the window that holds it whole, and of the rest the set of disjoint spans with the highest total score stays.
Pattern spans always stay; a decoded span is added where it meets none of them and holds what its kind must hold (``fits``): a Luhn number,
four octets, so many digits, or an address once bracketed and spaced signs are written plainly.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import lstm_crf, tables

KINDS = ["email", "ip", "card", "phone"]
WINDOW = 96
SPANS = "array<struct<kind:string,start:long,end:long,source:string>>"
# Fixed patterns of the kinds.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
BRACKETED_AT = re.compile(r"\s*[\[({<]\s*(?:at|AT|@)\s*[\])}>]\s*")
HINT = re.compile(r"[0-9@]|[\[({<]\s*(?:at|AT)\s*[\])}>]")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}")

Span = tuple[int, int, int]  # kind, start, past


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, without those that fail their check, by start and kind.

    An email is found from its at sign: the leftmost match begins where the run of local characters before the sign begins (or
    where the last match ended). An ip is looked for at the first digit of a run only. Both give the leftmost matches in linear time.
    """
    out: list[Span] = []
    last = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def shapes(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans with the shape of a kind, whatever their checks say, and the stretches where the patterns' reading is doubtful.

    Doubtful are numbers with too many digits, which may be two, and spans that overlap.
    """
    spans = [x for x in pattern_spans(text) if x[0] == 0]
    doubt = []
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(part) <= 3 for part in m[0].split("."))]
    for kind, pattern, least, most in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = len(NOT_DIGIT.sub("", m[0]))
            if least <= digits <= most:
                spans.append((kind, m.start(), m.end()))
            elif digits > most:
                doubt.append((m.start(), m.end()))
    spans.sort(key=lambda x: (x[1], x[0]))
    for (_, a, b), (_, c, d) in zip(spans, spans[1:]):
        if c < b:
            doubt.append((a, max(b, d)))
    return spans, doubt


def plainly(address: str) -> str:
    """An address with bracketed and spaced signs written as signs; a dot must have a space on both sides or on none."""
    address = re.sub(r"\s*@\s*", "@", BRACKETED_AT.sub("@", address))
    return re.sub(r"\s*[\[({<]\s*(?:dot|DOT|\.)\s*[\])}>]\s*|\s\.\s", ".", address)


def fits(kind: int, found: str, before: str, after: str) -> bool:
    """Whether a decoded span holds what its kind must hold and is not part of a longer word."""
    if before.isalnum() or after.isalnum() or not found.strip() or found != found.strip():
        return False
    digits = NOT_DIGIT.sub("", found)
    if kind == 0:
        return ADDRESS.fullmatch(plainly(found)) is not None
    if not found.isascii() or any(c.isalpha() for c in found) or DATE.search(found) or ":" in found:
        return False
    if kind == 1:
        parts = re.split(r"[^0-9]+", found)
        marks = set(re.findall(r"[^0-9]+", found))
        return len(parts) == 4 and len(marks) == 1 and "." in marks.pop() and all(0 < len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and len(found) <= 2 * len(digits) and "+" not in found
    return 10 <= len(digits) <= 15 and found[0] in "+(0" and len(found) <= 2 * len(digits)


def windows(text: str) -> list[tuple[int, np.ndarray]]:
    """(start, character classes filled up with padding) of the windows that can hold a span."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = lstm_crf.classes(codes)
    hints = np.zeros(len(codes) + 1, np.int64)
    marks = (kinds == 3) + 4 * (codes == 64)
    for m in BRACKETED_AT.finditer(text):
        marks[m.start()] += 4
    np.cumsum(marks, out=hints[1:])
    out = []
    for start in range(0, max(len(codes) - WINDOW // 2, 1), WINDOW // 2):
        past = min(start + WINDOW, len(codes))
        if hints[past] - hints[start] >= 4:
            out.append((start, np.pad(kinds[start:past], (0, WINDOW - past + start))))
    return out


def tagged(spans: list[Span], start: int) -> np.ndarray:
    """Tags of a window: 0, 1 + 2 * kind at a beginning, 2 + 2 * kind inside; the first of overlapping spans, and only whole ones."""
    out = np.zeros(WINDOW, np.int8)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if a >= 0 and b <= WINDOW and not out[a:b].any():
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def decoded(tags: np.ndarray, odds: np.ndarray, start: int, length: int) -> list[tuple[int, int, int, float]]:
    """(kind, start, past, score) of the spans in a window's tags, without those that touch an inner edge of the window."""
    out, k = [], 0
    while k < WINDOW:
        if tags[k] % 2 == 1:
            past = k + 1
            while past < WINDOW and tags[past] == tags[k] + 1:
                past += 1
            whole = (k > 0 or start == 0) and (past < WINDOW or start + past >= length)
            if whole and start + past <= length:
                out.append((int(tags[k]) // 2, start + k, start + past, float(odds[k:past].sum())))
            k = past
        else:
            k += 1
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Disjoint spans of the highest total score; the score of a span decoded twice is its best one."""
    best: dict[Span, float] = {}
    for kind, a, b, score in found:
        if score > 0:
            best[(kind, a, b)] = max(score, best.get((kind, a, b), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends, total, chosen = [s[2] for s in spans], [0.0], []
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, i)
        take = total[before] + best[s]
        chosen.append((take > total[i], before))
        total.append(max(take, total[i]))
    out, i = [], len(spans)
    while i:
        taken, before = chosen[i - 1]
        if taken:
            out.append(spans[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def sample_windows(docs: DataFrame, sample: int) -> list[tuple[str, list[Span]]]:
    """(text, spans of a shape that lie inside) of at most ``sample`` windows without a doubtful stretch, the least by hash of all windows of the table."""
    def emit(batches):
        for batch in batches:
            rows: list[tuple[str, list[int]]] = []
            for text in batch.column(0).to_pylist():
                if text and HINT.search(text):
                    spans, doubt = shapes(text)
                    for start, _ in windows(text):
                        past = min(start + WINDOW, len(text))
                        if not any(a < past and b > start for a, b in doubt):
                            rows.append((text[start:past], [v for k, a, b in spans if a >= start and b <= past for v in (k, a - start, b - start)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["window", "spans"])

    made = docs.select("text").mapInArrow(emit, "window string, spans array<int>").distinct()
    made = made.orderBy(F.xxhash64("window"), "window", "spans").limit(sample)
    return [(r[0], [tuple(r[1][i : i + 3]) for i in range(0, len(r[1]), 3)]) for r in made.collect()]


def _altered(kind: int, found: str, rng: random.Random) -> str:
    """A form of a span that the patterns miss or read otherwise."""
    digits = NOT_DIGIT.sub("", found)
    if kind == 0:
        local, domain = found.split("@")
        left, right = rng.choice(["[]", "()", "{}", "<>"])
        at, dot = rng.choice([(f"{left}at{right}", f"{left}dot{right}"), (f" {left}at{right} ", f" {left}dot{right} "), (" @ ", "."), ("@", " . "), (f" {left}@{right} ", ".")])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return found.replace(".", rng.choice([" . ", "[.]", "(.)", ". "]))
    if kind == 2:
        sizes, out = rng.choice([[4], [6, 5, 4], [2], [3], [8]]), []
        while digits:
            n = sizes[min(len(out), len(sizes) - 1)]
            out.append(digits[:n])
            digits = digits[n:]
        return rng.choice([".", "/", "  ", " - ", "_"]).join(out)
    mark = rng.choice([" ", "-", ".", "/"])
    parts = [digits[:3], digits[3:6], digits[6:]]
    return rng.choice(["00" + mark.join([digits[:2], digits[2:5], digits[5:]]), f"(0{parts[0]}) {parts[1]}{mark}{parts[2]}", "0" + mark.join(parts), "+" + mark.join([digits[:2], digits[2:6], digits[6:]])])


def _nothing(rng: random.Random) -> str:
    """A number that is none of the kinds."""
    r = rng.randrange
    return rng.choice([f"{r(1990, 2030)}-{r(1, 13):02d}-{r(1, 29):02d}", f"{r(1, 29)}.{r(1, 13)}.{r(1990, 2030)}", f"{r(1, 999)},{r(1000):03d}.{r(100):02d}", f"v{r(9)}.{r(20)}.{r(99)}",
                       f"{r(24):02d}:{r(60):02d}:{r(60):02d}", f"{r(10**6, 10**9)}", f"{r(1990, 2030)}-{r(1990, 2030)}", f"{r(100)}.{r(10**6)}", "".join(rng.choice("0123456789abcdef") for _ in range(24))])


def examples(drawn: list[tuple[str, list[Span]]], seed: int = 5) -> list[tuple[str, list[Span]]]:
    """The windows, and for each altered copies: a span in another form, two spans of different kinds side by side, a number of no kind."""
    rng = random.Random(seed)
    pool = [[text[a:b] for text, spans in drawn for k, a, b in spans if k == kind] for kind in range(len(KINDS))]
    known = [k for k in range(len(KINDS)) if pool[k]]
    out = list(drawn)

    def put(text: str, spans: list[Span], a: int, b: int, pieces: list[tuple[int | None, str]]) -> None:
        """The window with text[a:b] replaced by pieces of given kinds, moved so that they fit in."""
        made, fresh = text[:a], [s for s in spans if s[2] <= a]
        for kind, piece in pieces:
            if kind is not None:
                fresh.append((kind, len(made), len(made) + len(piece)))
            made += piece
        fresh += [(k, s - b + len(made), e - b + len(made)) for k, s, e in spans if s >= b]
        made += text[b:]
        start = max(0, min(a - 20, len(made) - WINDOW))
        out.append((made[start : start + WINDOW], [(k, s - start, e - start) for k, s, e in fresh if s >= start and e <= start + WINDOW]))

    for text, spans in drawn:
        for kind, a, b in spans[:1]:
            put(text, spans, a, b, [(kind, _altered(kind, text[a:b], rng))])
            pair = rng.sample(known, 2) if len(known) > 1 else [kind, kind]
            put(text, spans, a, b, [(pair[0], rng.choice(pool[pair[0]])), (None, rng.choice([" ", " ", ", ", "-"])), (pair[1], rng.choice(pool[pair[1]]))])
        if not spans:
            a = rng.randrange(len(text) + 1)
            put(text, spans, a, a, [(None, f" {_nothing(rng)} ")])
    return out


def learned(rows: list[tuple[str, list[Span]]], epochs: int):
    """Weights of the network for windows with their spans, or None if there is no span."""
    if not any(spans for _, spans in rows):
        return None
    coded = [np.pad(k := lstm_crf.classes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)), (0, WINDOW - len(k))) for t, _ in rows]
    return lstm_crf.train(np.stack(coded), np.stack([tagged(spans, 0) for _, spans in rows]).astype(np.int64), len(KINDS), hidden=24, epochs=epochs)


def found_in(weights, texts: list[str]) -> list[list[Span]]:
    """Spans that the network reads in each text, before any is checked against the patterns."""
    found: list[list] = [[] for _ in texts]
    todo = [(i, start, x) for i, t in enumerate(texts) if t and HINT.search(t) for start, x in windows(t)]
    for a in range(0, len(todo), 512):
        some = todo[a : a + 512]
        tags, odds = lstm_crf.decode(weights, np.stack([x for _, _, x in some]))
        for (i, start, _), t, o in zip(some, tags, odds):
            found[i] += decoded(t, o, start, len(texts[i]))
    return [[s for s in reconcile(f) if fits(s[0], t[s[1] : s[2]], t[s[1] - 1 : s[1]] if s[1] else "", t[s[2] : s[2] + 1])] for t, f in zip(texts, found)]


def personal_data(docs: DataFrame, sample: int = 1500, epochs: int = 12, learn: bool = True) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end in code points, end exclusive, source ``pattern`` or ``model``) of every row of ``docs``.

    A null or empty text has no spans; a null doc_id does not matter; repeated rows get equal spans. Spans are ordered by start, then kind as
    in KINDS. Without any pattern span in the sample (an empty table, say) there is nothing to learn from and no span is added.
    """
    rows = tables.as_documents(docs)
    weights = learned(examples(sample_windows(rows, sample)), epochs) if learn else None
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def emit(batches):
        weights = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [pattern_spans(t) if t and HINT.search(t) else [] for t in texts]
            more = found_in(weights, texts) if weights is not None else [[] for _ in texts]
            out = []
            for text, spans, found in zip(texts, base, more):
                taken = np.zeros(len(text) + 1, bool) if found else None
                for _, a, b in spans if found else ():
                    taken[a:b] = True
                added = [s for s in found if not taken[s[1] : s[2]].any()]
                both = sorted([(*s, "pattern") for s in spans] + [(*s, "model") for s in added], key=lambda s: (s[1], s[0]))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "source": source} for k, a, b, source in both])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("source", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(emit, f"doc_id long, spans {SPANS}")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["source"] == "pattern")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
