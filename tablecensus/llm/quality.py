"""Quality rules that vote, and the probability of good quality that their votes give."""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATISTICS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_symbol_words", "n_marks", "n_capitals", "n_distinct",
]

# Each rule: a number, the range in which it votes for good, and the range outside
# of which it votes for bad; in between it abstains. A text without words has no shares:
# all rules vote for bad. Most faults show in several rules, whose agreement tells a
# fault from an error of one rule.
RULES = {
    "length": ("n_words", (80, None), (50, None)),
    "word_length": ("word_chars / n_words", (4, 7), (3, 9)),
    "symbols": ("n_symbols / n_words", (None, 0.03), (None, 0.1)),
    "symbol_words": ("n_symbol_words / n_words", (None, 0.05), (None, 0.1)),
    "marks": ("n_marks / word_chars", (None, 0.08), (None, 0.15)),
    "capitals": ("n_capitals / word_chars", (None, 0.1), (None, 0.3)),
    "dup_lines": ("n_dup_lines / n_lines", (None, 0.1), (None, 0.3)),
    "repetition": ("n_repeat_words / n_words", (None, 0.1), (None, 0.3)),
    "variety": ("n_distinct / sqrt(n_words)", (4, None), (2, None)),
}


# What is taken for granted before votes are seen, weighing as much as PRIOR_WEIGHT of all
# texts: the share of good texts, how often a rule that votes on a good text is right, and
# on a bad one, where most rules see nothing of a fault that is not their own.
PRIOR_GOOD, PRIOR_RIGHT, PRIOR_WEIGHT = 0.85, {1: 0.97, -1: 0.2}, 0.02


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


@dataclass(frozen=True)
class Votes:
    """What expectation-maximisation found: the share of good texts, and how often each
    rule, where it votes, is right on good texts (1) and on bad ones (-1)."""

    good: float
    right: tuple[dict[int, float], ...]

    def weight(self, rule: int, vote: int) -> float:
        """What a vote adds to the log-odds of good quality; abstentions add nothing."""
        right = self.right[rule]
        if vote == 1:
            return math.log(right[1] / (1 - right[-1]))
        return math.log((1 - right[1]) / right[-1]) if vote == -1 else 0.0

    def posterior(self, pattern: Sequence[int]) -> float:
        """The probability of good quality, given the votes."""
        return _logistic(_logit(self.good) + sum(self.weight(j, vote) for j, vote in enumerate(pattern)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``STATISTICS`` over every whole text.

    A word is a run of anything but ASCII white space, case kept. ``n_repeat_words``
    counts the words that lie in a window of three words found twice or more in
    the text, the first time included: the windows are hashed (64 bits) and
    sorted with their places, equal neighbours give the places, and the words
    they cover are added up without counting one twice. All of it happens inside
    the row, so nothing is shuffled. ``n_symbol_words`` counts the words with one of
    ``SYMBOLS``, ``n_marks`` ASCII punctuation, ``n_capitals`` A-Z, ``n_distinct``
    different words (by a hash of 64 bits). Null and empty texts have 0 everywhere.
    """
    text = F.coalesce("row.text", F.lit(""))
    steps = docs.select(F.struct(*docs.columns).alias("row")).select("row", text.alias("t"))
    steps = steps.select(
        "row",
        F.array_remove(F.split(F.translate("t", SPACES[1:], " " * (len(SPACES) - 1)), " "), "").alias("words"),
        F.length(F.translate("t", SPACES, "")).cast("bigint").alias("word_chars"),
        *[
            (F.length("t") - F.length(F.translate("t", signs, ""))).cast("bigint").alias(name)
            for signs, name in ((SYMBOLS, "n_symbols"), (MARKS, "n_marks"), (CAPITALS, "n_capitals"))
        ],
        F.filter(F.split("t", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("lines"),
    )
    steps = steps.select(
        "row", "word_chars", "n_symbols", "n_marks", "n_capitals",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.rlike(f"[{SYMBOLS}]"))).cast("bigint").alias("n_symbol_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("w"),
    )
    steps = steps.withColumn("n_distinct", F.size(F.array_distinct("w")).cast("bigint"))
    window = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    steps = steps.withColumn("w", F.slice(window, 1, F.greatest(F.size("w") - 2, F.lit(0))))
    # most texts repeat no window, which hashing alone tells
    repeats = F.size(F.array_distinct("w")) < F.size("w")
    placed = F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    steps = steps.withColumn("p", F.when(repeats, placed))

    def twice(one, i):
        return (one["x"] == F.get("p", i + 1)["x"]) | ((i > 0) & (one["x"] == F.get("p", i - 1)["x"]))

    found = F.filter("p", lambda one, i: F.coalesce(twice(one, i), F.lit(False)))
    steps = steps.withColumn("p", F.sort_array(F.transform(found, lambda one: one["i"])))
    covered = F.transform("p", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - i, F.lit(3))))
    repeated = F.aggregate(covered, F.lit(0).cast("bigint"), lambda total, n: total + n)
    steps = steps.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("bigint")))
    statistics = [F.col(c) for c in STATISTICS]
    return steps.select(*statistics, "row").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in STATISTICS], *statistics
    )


def _vote(number: str, good: tuple, bad: tuple):
    """1 inside ``good``, -1 outside ``bad`` and where the number is undefined, else 0."""
    over, _, under = number.partition(" / ")
    value = F.try_divide(F.expr(over).cast("double"), F.expr(under or "1"))

    def inside(low, high):
        return (value >= (low if low is not None else -math.inf)) & (value <= (high if high is not None else math.inf))

    return F.when(value.isNull() | ~inside(*bad), -1).when(inside(*good), 1).otherwise(0)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 1000) -> Votes:
    """Expectation-maximisation over the patterns of votes and how often each occurs.

    Texts are of two kinds, good and bad, and a rule that votes on a text is right as often as its
    accuracy for that kind says, whatever others vote. The expected kind of each pattern
    follows from the accuracies, and these from the expected kinds, until nothing moves. A
    vote for bad that others often contradict thus comes to weigh little, and one that comes
    along with others' much. Begun at, and held to by a small weight, ``PRIOR_GOOD`` and
    ``PRIOR_RIGHT``, which also says which kind is the good one. The result depends on the shares of the
    patterns only; without texts it is the prior.
    """
    rules = max((len(p) for p in patterns), default=0)
    total = sum(patterns.values())
    model = Votes(PRIOR_GOOD, tuple(dict(PRIOR_RIGHT) for _ in range(rules)))
    for _ in range(rounds if total else 0):
        good = {p: model.posterior(p) for p in patterns}
        share = sum(n * good[p] for p, n in patterns.items()) / total
        share = (share + PRIOR_WEIGHT * PRIOR_GOOD) / (1 + PRIOR_WEIGHT)
        right = []
        for j in range(rules):
            each = {}
            for kind, prior in PRIOR_RIGHT.items():
                belongs = {p: n / total * (good[p] if kind == 1 else 1 - good[p]) for p, n in patterns.items() if p[j]}
                hits = sum(n for p, n in belongs.items() if p[j] == kind)
                each[kind] = (hits + PRIOR_WEIGHT * prior) / (sum(belongs.values()) + PRIOR_WEIGHT)
            right.append(each)
        model = Votes(share, tuple(right))
        if max(abs(model.posterior(p) - good[p]) for p in patterns) < 1e-10:
            break
    return model


def judged(docs: DataFrame, keep: float = 0.5, carry: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``carry``, with statistics, ``base_failed``, ``p_good`` and ``kept``.

    Each of ``RULES`` votes for good or bad or abstains. The patterns of votes, at
    most three to the number of rules, are counted over all rows; that table
    alone comes to the driver, where expectation-maximisation estimates how the
    rules vote on good and bad texts. A row's ``p_good`` follows from its pattern,
    and it is kept from ``keep`` on unless the base test fails (under 50 words, or
    over half of them in repeated windows). Statistics are written once, as they
    are read to count patterns and to judge. Columns of ``docs`` with the names of
    new ones are replaced; an empty table stays empty.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c not in STATISTICS]
    counted = stored(with_statistics(docs).select(*names, *STATISTICS), "quality")
    votes = [_vote(*rule) for rule in RULES.values()]
    rows = counted.select(F.array(*votes).alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    model = estimate({tuple(r.votes): r.n for r in rows})
    odds = F.lit(_logit(model.good))
    for j, vote in enumerate(votes if rows else []):
        odds = odds + F.when(vote == 1, model.weight(j, 1)).when(vote == -1, model.weight(j, -1)).otherwise(0.0)
    p_good = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.withColumn("p_good", p_good)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))
    )
