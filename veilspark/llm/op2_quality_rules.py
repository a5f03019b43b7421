"""Quality rules by weak supervision.

Each rule votes *bad*, *good* or abstains on the statistics of a text. The votes of all documents are counted by pattern
(at most 3 ** rules rows, whatever the input), and expectation-maximisation on that histogram estimates the share of
good documents and, for each rule and true class, how often it votes each way; no label is read. A document's verdict is
its posterior probability of being good, so one doubtful vote does not reject what the others speak for.

Statistics are exact over whole texts. Words are maximal runs of anything but ASCII white space.

Defined results: null text counts as the empty text: it has no words and fails the base test; repeated rows get equal
verdicts; null ids and other columns pass through; an empty table gives no rows, and a model of the start values.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import WORD, content, materialize, table

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\v\f\r "
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_shouted", "n_short", "n_bangs"]
_words = re.compile(WORD).findall


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    count, total, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + size - max(i, covered)
            covered = i + size
    return total


def text_stats(text: str) -> tuple[int, ...]:
    words = _words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        sum(map(str.isupper, words)),
        sum(1 for w in words if len(w) <= 3),
        text.count("!"),
    )


def stats_column(text: Column) -> Column:
    """A struct of STATS for each whole text."""

    @arrow_udf("struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = list(zip(*(text_stats(x.as_py()) for x in batch))) or list(repeat((), len(STATS)))
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=STATS)

    return run(text)


def rules(s: str = "stats") -> dict[str, Column]:
    """Each rule's vote: -1 bad, 1 good, 0 abstains. The bounds are parameters of the rules, not fitted."""
    c = lambda name: F.col(f"{s}.{name}").cast("double")
    words, lines, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))

    def vote(bad: Column, good: Column | None = None) -> Column:
        return F.when(bad, -1).when(good if good is not None else F.lit(False), 1).otherwise(0)

    return {
        "symbols": vote(c("n_symbols") / chars > 0.04),
        "repeats": vote(c("n_repeat_words") / words > 0.25),
        "shouting": vote((c("n_shouted") / words > 0.35) & (c("n_words") >= 5)),
        "bangs": vote(c("n_bangs") / words > 0.15),
        "vocabulary": vote((c("n_distinct_words") / words < 0.25) & (c("n_words") < 1000) | (c("n_distinct_words") / words < 0.05), (c("n_distinct_words") / words > 0.6) & (c("n_words") >= 30)),
        "same_lines": vote((c("n_dup_lines") / lines > 0.4) & (c("n_dup_lines") >= 3)),
        "word_length": vote((chars / words > 12) | (chars / words < 2.2), (chars / words >= 3.5) & (chars / words <= 9)),
        "short_words": vote((c("n_short") / words < 0.06) & (c("n_words") >= 30), (c("n_short") / words >= 0.1) & (c("n_short") / words <= 0.6)),
    }


@dataclass
class LabelModel:
    """Share of good documents and P(vote | class) of each rule, votes in the order -1, 0, 1."""

    names: list[str]
    good: float = 0.85
    table: dict[str, tuple[list[float], list[float]]] = field(default_factory=dict)

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.good / (1 - self.good))
        for name, v in zip(self.names, votes):
            bad, good = self.table[name]
            odds += math.log(good[v + 1] / bad[v + 1])
        return 1 / (1 + math.exp(-max(-700, min(700, odds))))


#: Where the estimation starts, and what each rule counts for as if seen on so many documents of each class.
START_BAD, START_GOOD, WEIGHT = (0.35, 0.45, 0.2), (0.01, 0.34, 0.65), 5.0


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents)."""
    model = LabelModel(names, table={n: (list(START_BAD), list(START_GOOD)) for n in names})
    for _ in range(rounds):
        share, total = 17.0, 20.0
        sums = {n: ([WEIGHT * x for x in START_BAD], [WEIGHT * x for x in START_GOOD]) for n in names}
        for votes, n in patterns:
            p = model.posterior(votes)
            share, total = share + n * p, total + n
            for name, v in zip(names, votes):
                sums[name][0][v + 1] += n * (1 - p)
                sums[name][1][v + 1] += n * p
        before = model.good
        model.good = share / total
        model.table = {n: tuple([x / sum(side) for x in side] for side in both) for n, both in sums.items()}
        if abs(model.good - before) < 1e-9:
            break
    return model


def vote_patterns(frame: DataFrame, stats: str = "stats") -> tuple[list[tuple[tuple[int, ...], int]], list[str]]:
    """The histogram of vote patterns over all rows; its size depends on the number of rules only."""
    votes = rules(stats)
    return pattern_counts(frame.select(F.array(*votes.values()).alias("votes"))), list(votes)


def pattern_counts(voted: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    return sorted((tuple(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())


def base_failed(s: str = "stats") -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{s}.n_words"))


def posterior(model: LabelModel, stats: str = "stats") -> Column:
    """The model's probability that a document is good, as a column expression over its statistics."""
    return posterior_of(model, list(rules(stats).values()))


def posterior_of(model: LabelModel, votes: list[Column]) -> Column:
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for name, v in zip(model.names, votes):
        bad, good = model.table[name]
        odds = odds + F.element_at(F.array(*[F.lit(math.log(g / b)) for b, g in zip(bad, good)]), v + 2)
    return 1 / (1 + F.exp(-odds))


def judge(frame: DataFrame, threshold: float = 0.5, stats: str = "stats") -> DataFrame:
    """Adds base_failed, posterior and kept to rows with their statistics; the model is fitted on all the rows."""
    model = fit(*vote_patterns(frame, stats))
    out = frame.withColumn("base_failed", base_failed(stats)).withColumn("posterior", posterior(model, stats))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their own columns. The texts are read once: rows that pass the base test are written beside the
    votes of all."""
    rows = docs.select(F.struct("*").alias("row"), stats_column(content(text_col)).alias("stats")).withColumn("failed", base_failed())
    names = list(rules())
    voted = materialize(rows.select(F.when(~F.col("failed"), F.col("row")).alias("row"), "failed", F.array(*rules().values()).alias("votes")), "voted")
    model = fit(pattern_counts(voted), names)
    return voted.where(~F.col("failed") & (posterior_of(model, [F.col("votes")[i] for i in range(len(names))]) >= threshold)).select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", stats_column(content()).alias("stats"))
    out = judge(materialize(docs, "quality"))
    return out.select("doc_id", *[F.col(f"stats.{s}") for s in STATS[:5]], "base_failed", "kept", "posterior")
