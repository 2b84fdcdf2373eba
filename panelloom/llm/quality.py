"""Quality rules with risk-controlled cutoffs.

Every rule compares one measure of a text with a cutoff from a fixed ladder, lenient to strict. Labelled documents are
split by a hash of their id. The tuning third builds a chain for each stratum: at each link one rule takes one more step up
its ladder, the rule that costs fewest good documents first, as long as what it adds is worth it. The holdout must then
certify the chain link by link: the good documents that the rules reject together give an exact (Clopper-Pearson) upper
bound of the stratum's false rejection rate, and the first bound above `risk` ends the climb. Links of a chain are tested in
a fixed order, which needs no correction among them. The strata share the error rate by Holm's rule: it is divided by the
number of chains not certified to their end, so that a finished chain leaves its part to the others. So with probability
1 - delta no stratum loses more than `risk` of its good documents to all of its rules together. A stratum with too few
labels to certify anything has no cutoffs and loses nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import ship, slices, utf8
from panelloom.sources.storage import materialize

WINDOW = 8
#: Share of a stratum's good documents that all its rules together may reject.
RISK = 0.02
DELTA = 0.05
#: A step is worth its place if it adds this many times the share of bad documents that it adds of good ones.
WORTH = 20
#: Measure, sign (1: reject above the cutoff, -1: below) and the ladder of cutoffs, lenient first.
RULES: dict[str, tuple[int, list[float]]] = {
    "symbols_per_word": (1, [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1]),
    "chars_per_word": (1, [12.0, 10.0, 9.0, 8.0, 7.5, 7.0]),
    "few_chars_per_word": (-1, [2.0, 2.5, 3.0, 3.5, 4.0]),
    "duplicate_lines": (1, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeated_words": (1, [0.28, 0.25, 0.2, 0.15, 0.1]),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of 8 words that occur more than once; windows are compared whole, by doubling their ranks."""
    n = len(words)
    if n <= window:
        return 0
    first: dict[bytes, int] = {}
    ranks = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    span = 1
    while span < window:
        ranks = ranks[:-span] * n + ranks[span:]
        _, ranks = np.unique(ranks, return_inverse=True)
        span *= 2
    twice = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k: k + len(twice)] |= twice
    return int(covered.sum())


def measures(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = text.split()  # on bytes: \x20 and \x09-\x0D
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (len(words), len(b"".join(words).decode()), len(text) - len(text.translate(None, b"#*$%&|<>")), len(lines),
            len(lines) - len(set(lines)), repeated_words(words))


def document_counts(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, the stratum and the COUNTS of every whole text, a few MB at a time; null and empty texts count 0."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(2)):
                part = batch.slice(first, last - first)
                raw, at = utf8(part.column(2))
                text = memoryview(raw)
                found = np.array([measures(bytes(text[a:b])) for a, b in itertools.pairwise(at.tolist())], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, found.reshape(-1, len(COUNTS)).T.copy())],
                                                 ["doc_id", "stratum", *COUNTS])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("stratum", T.StringType())]
                          + [T.StructField(c, T.LongType()) for c in COUNTS])
    rows = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / words, "chars_per_word": F.col("word_chars") / words,
            "few_chars_per_word": F.col("word_chars") / words,
            "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeated_words": F.col("n_repeat_words") / words}


def upper_bound(failures: int, trials: int, delta: float) -> float:
    """Clopper-Pearson: the least rate at which `failures` or fewer of `trials` have probability at most delta."""
    if failures >= trials:
        return 1.0
    ways = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in range(failures + 1)]
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = [w + k * math.log(p) + (trials - k) * math.log1p(-p) for k, w in enumerate(ways)]
        top = max(logs)
        if top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(delta):
            high = p
        else:
            low = p
    return high


#: Labelled documents of one kind: how many there are for each combination of ladder steps, in the order of RULES.
Crossed = dict[tuple[int, ...], int]


def rejected(documents: Crossed, state: tuple[int, ...]) -> int:
    """Documents that at least one rule rejects, each rule at its step of `state` (0: not in use)."""
    return sum(n for steps, n in documents.items() if any(0 < s <= x for s, x in zip(state, steps, strict=True)))


def chain(good: Crossed, bad: Crossed) -> list[tuple[int, ...]]:
    """States of growing strictness: each moves one rule to its next step that is worth it, least good documents lost first."""
    n_good, n_bad = sum(good.values()), sum(bad.values())
    out: list[tuple[int, ...]] = []
    state = (0,) * len(RULES)
    while n_good and n_bad:
        lost, caught = rejected(good, state), rejected(bad, state)
        moves = []
        for i, (_, ladder) in enumerate(RULES.values()):
            for step in range(state[i] + 1, len(ladder) + 1):
                new = (*state[:i], step, *state[i + 1:])
                more_lost, more = rejected(good, new) - lost, rejected(bad, new) - caught
                if more / n_bad > WORTH * more_lost / n_good:
                    moves.append((more_lost, -more, i, new))
                    break
        if not moves:
            break
        state = min(moves)[-1]
        out.append(state)
    return out


def choose(counts: dict[tuple[str, bool, bool], Crossed], risk: float, delta: float) -> dict[str, tuple[int, ...]]:
    """The strictest certified state of each stratum that has one, from `counts[stratum, holdout, good]`."""
    chains = {s: chain(counts.get((s, False, True), {}), counts.get((s, False, False), {})) for s in sorted({s for s, *_ in counts})}
    waiting = {s for s, links in chains.items() if links}
    certified = dict.fromkeys(waiting, 0)
    while waiting:
        level = delta / len(waiting)
        for s in waiting:
            good = counts.get((s, True, True), {})
            trials = sum(good.values())
            while certified[s] < len(chains[s]):
                lost = rejected(good, chains[s][certified[s]])
                if lost >= risk * trials or upper_bound(lost, trials, level) > risk:
                    break
                certified[s] += 1
        ended = {s for s in waiting if certified[s] == len(chains[s])}
        if not ended:
            break
        waiting -= ended
    return {s: chains[s][n - 1] for s, n in certified.items() if n}


def ladder_step(rule: str, measure: Column) -> Column:
    """How many cutoffs of its ladder a document crosses."""
    sign, ladder = RULES[rule]
    return sum((F.when(measure > c if sign > 0 else measure < c, 1).otherwise(0) for c in ladder), F.lit(0))


def fit_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Certified cutoffs by stratum and rule, from all labelled documents that pass the base rules.

    `labels` has doc_id and quality (1 good, 0 bad); documents with none, or with both, are left out. The driver gets
    one line for each stratum, half, label and combination of steps that occurs: the ladders allow 18,144 of them.
    """
    label = (labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most"))
    own = counted.filter(~base_failed()).join(label.select("doc_id", "quality"), "doc_id")
    steps = F.array(*[ladder_step(r, m) for r, m in rule_measures().items()])
    rows = (own.select("stratum", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("holdout"), (F.col("quality") == 1).alias("good"),
                       steps.alias("steps")).groupBy("stratum", "holdout", "good", "steps").count().collect())
    counts: dict[tuple[str, bool, bool], Crossed] = {}
    for r in rows:
        counts.setdefault((r["stratum"], r["holdout"], r["good"]), {})[tuple(r["steps"])] = r["count"]
    return {s: {r: ladder[step - 1] for (r, (_, ladder)), step in zip(RULES.items(), state, strict=True) if step}
            for s, state in choose(counts, risk, delta).items()}


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK,
                  delta: float = DELTA) -> DataFrame:
    """Per row of `docs` (doc_id, text, `stratum`): doc_id, stratum, COUNTS, base_failed, failed_rules, kept.

    Null and empty texts have no words and fail the base rules. Null strata are one stratum, named ''. Repeated rows
    stay; a null doc_id matches no label; other columns are ignored; an empty table gives no rows, and without labels
    only the base rules hold.
    """
    counted = materialize(document_counts(docs, stratum), "quality-counts")
    # one line for each stratum with a certified cutoff; Spark decides by its size how it meets the documents
    lines = fit_cutoffs(counted, labels, risk, delta)
    table = docs.sparkSession.createDataFrame([(s, *[float(x[r]) if r in x else None for r in RULES]) for s, x in lines.items()],
                                              T.StructType([T.StructField("stratum", T.StringType())]
                                                           + [T.StructField(f"_{r}", T.DoubleType()) for r in RULES]))
    failed = [F.when((m > F.col(f"_{r}")) if RULES[r][0] > 0 else (m < F.col(f"_{r}")), F.lit(r)) for r, m in rule_measures().items()]
    ruled = counted.join(table, "stratum", "left").withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return ruled.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), "failed_rules",
                        (~base_failed() & (F.size("failed_rules") == 0)).alias("kept"))
