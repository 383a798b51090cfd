"""Quality rules: statistics of every text, and a decision list learned from labels by sequential covering.

A rule is a conjunction of thresholds on the statistics. Rules are grown one threshold at a time by information gain on
two thirds of the labelled texts, pruned on the other third, and kept while they are precise enough there; the texts
that a rule covers are taken out and the next rule is learned. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onefold.llm import common
from onefold.llm.words import span_hashes, window_hashes, words

SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 8
#: Labelled texts that the rules are learned from at most: those with the least hash of their doc_id.
SAMPLE = 20_000

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What thresholds are set on: names and SQL over the statistics.
FEATURES = {
    "words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def _repeated(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys their text has twice or more, and which of them come after an equal one."""
    order = np.lexsort((key, text))
    same = (text[order][1:] == text[order][:-1]) & (key[order][1:] == key[order][:-1])
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATISTICS of an array of texts without nulls."""
    w = words(texts)
    data, at, n = w.data, w.text_starts, w.n_texts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] += 1
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    starts = (data & 0xC0) != 0x80

    cuts = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], cuts + 1]))
    line_start = line_start[line_start < len(data)]
    line_text = np.searchsorted(at, line_start, side="right") - 1
    next_cut = np.append(cuts, len(data))[np.searchsorted(cuts, line_start)]
    line_end = np.minimum(next_cut, at[line_text + 1])
    filled = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    has = filled[line_end] > filled[line_start]
    line_text, line_start, line_end = line_text[has], line_start[has], line_end[has]
    _, later = _repeated(line_text, span_hashes(data, line_start, line_end))

    first = w.windows(REPEAT_WIDTH)
    twice, _ = _repeated(w.doc[first], window_hashes(w.hashes(), first, REPEAT_WIDTH))
    edge = np.zeros(len(w.doc) + 1, np.int64)
    edge[first[twice]] += 1
    edge[first[twice] + REPEAT_WIDTH] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return {
        "n_words": w.counts(), "word_chars": _per_text(inside & starts, at), "n_symbols": _per_text(_SYMBOL[data], at), "n_dup_lines": np.bincount(line_text[later], minlength=n),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n), "n_lines": np.bincount(line_text, minlength=n),
    }


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with STATISTICS, named with `prefix`, after its own columns. A null text is empty."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + name, T.LongType()) for name in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in common.steps(batches, text):
            found = statistics(step.column(text).fill_null(""))
            yield pa.RecordBatch.from_arrays([*step.columns, *[pa.array(found[name].astype(np.int64)) for name in STATISTICS]], names=schema.names)

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Threshold:
    feature: str
    least: bool
    value: float

    def covers(self, features: pd.DataFrame) -> np.ndarray:
        x = features[self.feature].to_numpy()
        return x >= self.value if self.least else x <= self.value

    def sql(self, prefix: str = "") -> str:
        of = FEATURES[self.feature]
        for name in sorted(STATISTICS, key=len, reverse=True) if prefix else ():
            of = of.replace(name, prefix + name)
        return f"{of} {'>=' if self.least else '<='} {self.value!r}D"


Rule = tuple[Threshold, ...]


def _covers(rule: Rule, features: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(features), bool)
    for threshold in rule:
        out &= threshold.covers(features)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, bool, float]:
    """The gain of the best threshold between two neighbouring values of `x`, whether it is a least one, and its value."""
    order = np.argsort(x, kind="stable")
    x, right = x[order], np.cumsum(bad[order])
    at = np.flatnonzero(x[1:] > x[:-1])
    if not len(at):
        return 0.0, True, 0.0
    before = np.log2(right[-1] / len(x))
    gains = []
    for q, n in ((right[-1] - right[at], len(x) - at - 1), (right[at], at + 1)):
        gains.append(q * (np.log2(np.maximum(q, 1) / n) - before))
    least = gains[0].max() >= gains[1].max()
    i = at[int(gains[0 if least else 1].argmax())]
    low, high = float(x[i]), float(x[i + 1])
    middle = low + (high - low) / 2
    return float(gains[0 if least else 1].max()), bool(least), middle if low < middle < high else high if least else low


def _grow(features: pd.DataFrame, bad: np.ndarray, most: int) -> Rule:
    """Thresholds are tried between all neighbouring values of the rows that the rule still covers."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (p := int(bad[inside].sum())) and p < inside.sum():
        best, gain = None, 1e-9
        for feature in FEATURES:
            found, least, value = _best(features[feature].to_numpy()[inside], bad[inside])
            if found > gain:
                best, gain = Threshold(feature, least, value), found
        if best is None:
            break
        rule = (*(x for x in rule if (x.feature, x.least) != (best.feature, best.least)), best)  # the new one is the narrower
        inside &= best.covers(features)
    return rule


def learn(features: pd.DataFrame, bad: np.ndarray, precision: float = 0.95, sure: float = 0.93, rules: int = 12, conditions: int = 4) -> list[Rule]:
    """An ordered list of rules for bad texts. Rows are split by their place: every third prunes. No rows, or one kind only: no rules.

    A rule must be right in `precision` of what it covers, also among what pruned it, and cover enough for its estimate
    after Laplace, (right + 1) / (covered + 2), to reach `sure`: clean texts are not to pay for chance.
    """
    found: list[Rule] = []
    bad = np.asarray(bad, bool)
    left = np.ones(len(bad), bool)
    prunes = np.arange(len(bad)) % 3 == 2
    while len(found) < rules and bad[left & ~prunes].any():
        grow, prune = left & ~prunes, left & prunes
        rule = _grow(features[grow], bad[grow], conditions)

        def worth(r: Rule) -> float:
            inside = _covers(r, features[prune])  # noqa: B023
            p = int(bad[prune][inside].sum())  # noqa: B023
            return (2 * p - inside.sum()) / max(1, inside.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        inside = _covers(rule, features)
        own = [bad[part & inside] for part in (left, prune)]
        if not rule or not len(own[1]) or (own[0].sum() + 1) / (len(own[0]) + 2) < sure or any(x.mean() < precision for x in own):
            break
        found.append(rule)
        left &= ~inside
    return found


def expression(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that a text meets, from 1, or 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        condition = F.expr(" AND ".join(x.sql(prefix) for x in rule))
        out = F.when(condition, i) if out is None else out.when(condition, i)
    return (F.lit(0) if out is None else out.otherwise(0)).cast("int")


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **parameters) -> list[Rule]:
    """The rules for `docs` (doc_id, text) whose `labels` (doc_id, quality) say 0 or 1.

    At most `sample` labels are taken, those with the least hash of their doc_id: that bounds what is broadcast to find
    their texts, and the statistics that come to the driver. Labels that are null, or neither 0 nor 1, teach nothing, nor
    do texts that fail the base, which no rule needs to reject.
    """
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    taken = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(sample)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).join(F.broadcast(taken), "doc_id")
    rows = with_statistics(texts).where(f"NOT ({BASE_FAILED})").select("turn", "doc_id", "quality", *[F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()]).toPandas()
    rows = rows.sort_values(["turn", "doc_id", *FEATURES], ignore_index=True)
    return learn(rows, rows["quality"].to_numpy() == 0, **parameters)


def judge(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the rule that rejected the text (0: none), for every row of `docs`.

    Null texts have no words and fail; a null doc_id stays null; repeated rows are judged each by itself; other columns are
    ignored, whatever their names. Without labels only the base decides. An empty table gives no rows.
    """
    rules = learn_from(docs, labels, **parameters)
    found = with_statistics(docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))).drop("text")
    found = found.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", expression(rules))
    return found.select("doc_id", *STATISTICS[:5], "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule", "n_lines")


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they were."""
    mine = "__quality_"
    rules = learn_from(docs, labels, **parameters)
    failed = BASE_FAILED.replace("n_words", mine + "n_words").replace("n_repeat_words", mine + "n_repeat_words")
    return with_statistics(docs, prefix=mine).where(~F.expr(failed) & (expression(rules, mine) == 0)).select(docs.columns)
