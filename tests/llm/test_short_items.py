"""Operator 8 on benchmark items that are shorter than its window."""

from itertools import combinations

from tillwork.llm import decontamination as dc


def test_short_items_with_every_allowed_difference(spark, frame):
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 14)], "item_id long, text string")
    rows, want = [], {}
    for n in range(1, 14):
        allowed = 2 * n // 13
        for differ in (allowed, allowed + 1):
            for places in combinations(range(n), differ):
                words = [f"other{i}" if i in places else f"w{n}x{i}" for i in range(n)]
                want[len(rows)] = [n] if differ == allowed else []
                rows.append((len(rows), " ".join(["before", *words, "behind"]), "en", "s", 0))
        # Cut off at either end of the text, where the missing word is the difference.
        for text in (f"behind w{n}x0", " ".join(f"w{n}x{i}" for i in range(1, n)), " ".join(f"w{n}x{i}" for i in range(n - 1))):
            whole = n == 1 and "w1x0" in text
            want[len(rows)] = [n] if whole or allowed and text.count(" ") == n - 2 and n > 2 else []
            rows.append((len(rows), text, "en", "s", 0))
    got = {r.doc_id: list(r["items"]) for r in dc.verdicts(frame(rows), items).collect()}
    assert got == want
