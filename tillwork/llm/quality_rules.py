"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides.

The latent class of a document is good or poor. Each rule has, for each class, its own chances of voting good, voting poor and
abstaining (its accuracies); they are estimated from the counts of vote patterns, of which there are at most 3 ** rules whatever
the number of documents. A rule that seldom speaks against good documents thus counts for more than a majority of lenient ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import tables, words as wd

# Characters that count as symbols, and the windows of repeated words.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_plain_ends", "n_chars"]
_KIND = "struct<" + ",".join(f"{name}:long" for name in FEATURES) + ">"
_IS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "letter", "mark", "digit")}
_IS["symbol"][[ord(c) for c in SYMBOLS]] = True
_IS["upper"][65:91] = True
_IS["letter"][65:91] = _IS["letter"][97:123] = True
_IS["mark"][[ord(c) for c in "!?"]] = True
_IS["digit"][48:58] = True
_IS["plain"] = _IS["letter"] | _IS["digit"] | (np.arange(256) >= 128)
_IS["plain"][[ord(c) for c in ".,;:'\")-"]] = True
_IS["head"] = (np.arange(256) & 0xC0) != 0x80


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the units whose (text, hash) occurs before or after as well, and mask of those that are not the first of their kind."""
    order = np.lexsort((hashes, text))
    same = (text[order][1:] == text[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    again, any_ = np.zeros(len(text), bool), np.zeros(len(text), bool)
    again[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return any_, again


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The features of each text."""
    part = wd.words(texts)
    raw, offsets, n = part.raw, part.offsets, len(texts)
    out = {"n_words": np.diff(part.first)}
    solid = ~wd.SPACE[raw]
    out["word_chars"] = _per_text(solid & ((raw & 0xC0) != 0x80), offsets)
    for name, kind in (("n_symbols", "symbol"), ("n_upper", "upper"), ("n_letters", "letter"), ("n_marks", "mark"), ("n_digits", "digit"), ("n_chars", "head")):
        out[name] = _per_text(_IS[kind][raw], offsets)
    out["n_plain_ends"] = _per_text(_IS["plain"][raw[part.ends - 1]] & _IS["plain"][raw[part.starts]], part.first)
    windows = wd.rolling(part.hashes, WINDOW)
    starts = np.flatnonzero(wd.within(part.first, WINDOW))
    twice, _ = _repeats(part.text[starts], windows[starts])
    covered = wd.covered(starts[twice], WINDOW, len(part.starts))
    out["n_repeat_words"] = _per_text(covered, part.first)
    breaks = np.flatnonzero(raw == 10)  # lines of all texts: each text's start and what follows each break inside it
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([offsets[1:], breaks]))
    line_text = np.searchsorted(np.sort(np.concatenate([breaks, offsets[1:]])), begin, "left")
    line_text = np.repeat(np.arange(n), 1 + _per_text(raw == 10, offsets)) if n else line_text
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    worded = filled[end] > filled[begin]
    line_text, begin, end = line_text[worded], begin[worded], end[worded]
    _, again = _repeats(line_text, wd.spans_hash(raw, begin, end))
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n)
    return out


def _features(texts: pa.Array) -> pa.Array:
    found = [measure(texts.slice(a, b - a)) for a, b in wd.pieces(texts)]
    columns = [pa.array(np.concatenate([f[name] for f in found]) if found else np.zeros(0), pa.int64()) for name in FEATURES]
    return pa.StructArray.from_arrays(columns, FEATURES)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``quality_features``; a null text is empty."""
    def column(texts: pa.Array) -> pa.Array:
        return _features(texts)

    column.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn("quality_features", F.arrow_udf(column, _KIND)(F.col("text").cast("string")))


def _share(part: str, whole: str) -> Column:
    f = F.col("quality_features")
    return F.when(f[whole] > 0, f[part] / f[whole])


def _between(x: Column, good: Column, poor: Column) -> Column:
    """1 for good, 0 for poor, null (abstains) otherwise or where x is null."""
    return F.when(x.isNull(), F.lit(None)).when(poor, 0).when(good, 1)


def default_rules() -> dict[str, Column]:
    """Votes of the rules: 1 good, 0 poor, null abstains. Bounds are shares of words, letters or lines."""
    n, mean = F.col("quality_features")["n_words"], _share("word_chars", "n_words")
    low = lambda x, good, poor: _between(x, x <= good, x > poor)
    return {
        "enough_words": _between(n, n >= 30, n < 10),
        "word_length": _between(mean, mean.between(3, 10), (mean < 2) | (mean > 15)),
        "few_symbols": low(_share("n_symbols", "n_words"), 0.02, 0.1),
        "few_repeated_lines": low(_share("n_dup_lines", "n_lines"), 0.05, 0.3),
        "few_repeated_words": low(_share("n_repeat_words", "n_words"), 0.05, 0.2),
        "lower_case": low(_share("n_upper", "n_letters"), 0.15, 0.3),
        "few_marks": low(_share("n_marks", "n_words"), 0.05, 0.2),
        "plain_words": _between(_share("n_plain_ends", "n_words"), _share("n_plain_ends", "n_words") >= 0.95, _share("n_plain_ends", "n_words") < 0.85),
        "mostly_letters": _between(_share("n_symbols", "word_chars"), _share("n_symbols", "word_chars") <= 0.01, _share("n_symbols", "word_chars") > 0.05),
        "few_digits": low(_share("n_digits", "word_chars"), 0.1, 0.3),
    }


@dataclass
class LabelModel:
    """Share of good documents, and for each rule the log ratio (good to poor) of each of its votes."""

    prior: float
    chances: Mapping[str, np.ndarray]  # [class poor, good][vote poor, good, abstains]

    def posterior(self, rules: Mapping[str, Column]) -> Column:
        total = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for name, vote in rules.items():
            poor, good, silent = (float(x) for x in np.log(self.chances[name][1] / self.chances[name][0]))
            total = total + F.when(vote.isNull(), silent).when(vote == 1, good).otherwise(poor)
        return 1 / (1 + F.exp(-total))


def fit(voted: DataFrame, rules: Mapping[str, Column], rounds: int = 200, alarm: float = 0.001) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns of all rows (at most 3 ** rules rows reach the driver).

    Starts from "poor if any rule says so". The likelihood has several peaks; to stay at the one in which poor means junk, no rule may
    come out with a share of false alarms (poor votes on good documents) above ``alarm``. A thousandth of a pseudo-count for each vote keeps
    every chance above zero, also without any document.
    """
    names = list(rules)
    marks = F.concat(*(F.coalesce(rules[r].cast("string"), F.lit("2")) for r in names))
    found = voted.select(marks.alias("votes")).groupBy("votes").count().collect()
    found.sort(key=lambda r: r["votes"])
    votes = np.array([[int(c) for c in r["votes"]] for r in found], np.int64).reshape(len(found), len(names))
    counts = np.array([r["count"] for r in found], float)
    good = np.where((votes == 0).any(axis=1), 0.001, 0.999)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight[1].sum() + 1e-3) / (weight.sum() + 2e-3)
        chances = np.stack([[(weight[:, votes[:, j] == v].sum(axis=1) + 1e-3) for v in range(3)] for j in range(len(names))]).transpose(0, 2, 1)
        chances = chances / chances.sum(axis=2, keepdims=True)
        excess = np.maximum(chances[:, 1, 0] - alarm, 0)
        chances[:, 1, 0] -= excess
        chances[:, 1, 1] += excess
        logs = np.log([1 - prior, prior]) + sum((np.log(chances[j][:, votes[:, j]]).T for j in range(len(names))), np.zeros((len(found), 2)))
        fresh = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        done = np.abs(fresh - good).max(initial=0) < 1e-9
        good = fresh
        if done:
            break
    return LabelModel(float(prior), dict(zip(names, chances)))


def judged(measured: DataFrame, rules: Mapping[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (posterior probability of good) and kept to a table with ``quality_features``."""
    rules = rules or default_rules()
    f = F.col("quality_features")
    base = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])
    model = fit(measured, rules)
    return (measured.withColumn("base_failed", base).withColumn("quality", model.posterior(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are kept.

    A null or empty text has no words and fails; repeated rows get equal verdicts; a null doc_id does not matter; an empty table stays
    empty. Columns named like this module's own are set aside while it works.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    return judged(features(packed), threshold=threshold).where("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``."""
    docs = tables.as_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    measured = tables.stage(features(docs).drop("text"), "quality")
    return judged(measured).select("doc_id", *(F.col(f"quality_features.{c}").alias(c) for c in FEATURES[:5]), "base_failed", "kept", "quality")
