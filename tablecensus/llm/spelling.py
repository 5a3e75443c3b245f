"""Spelling variants: words one edit apart, found by two chunks of one and the grams of the other."""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import stored

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
# One in so many runs of a document loses a code point.
DAMAGED = 199
# Distinct words a task adds up before it passes their counts on.
COUNTED_WORDS = 200_000


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, damaged: int | None = DAMAGED) -> DataFrame:
    """``word, n``: how often each word of at least ``least_length`` code points occurs in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With
    ``damaged``, a run whose checksum with its ``doc_id`` (null: nothing) this number divides has lost the
    code point that the checksum points at; it is counted as what is left. Null
    texts have no words, repeated rows count each, other columns are not looked at.
    Tasks add counts up before they are shuffled, in pieces of bounded size.
    """
    # a shorter run has no word to count, damaged or not
    find = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}").findall

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # of bytes only A-Z are lower-cased
                lowered = (text.as_py() or "").encode().lower().decode()
                before = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                for run, n in Counter(find(lowered)).items():
                    if damaged:
                        check = zlib.crc32(run.encode(), before)
                        if check % damaged == 0:
                            at = check % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                    counts[run] = counts.get(run, 0) + n
                if len(counts) > COUNTED_WORDS:
                    yield summed()
                    counts.clear()
        yield summed()

    parts = docs.select("doc_id", "text").mapInArrow(rows, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _signatures(word: Column, size: Column, length: Column) -> list[Column]:
    """What ``word`` shares with any word of ``size`` code points that it is, or has one more than.

    A word of that size has two disjoint chunks, its first and its last half. One
    edit preserves one of them, and where it stands follows from whether the edit
    lies behind it (no shift) or before it (a shift by the difference in length).
    The edit then lies in the rest, which has two disjoint chunks again. So each
    signature is a chunk and a chunk of the rest, known by a fingerprint with its place.
    """
    half = F.floor(size / 2).cast("int")
    quarter = F.floor((size - half) / 2).cast("int")
    part = lambda at, count: F.substring(word, at, count)
    head, tail = part(F.lit(1), half), part(length - half + 1, half)
    return [
        F.xxhash64(F.lit(place), size, chunk, of_rest)
        for place, (chunk, of_rest) in enumerate([
            (head, part(half + 1, quarter)),
            (head, part(length - quarter + 1, quarter)),
            (tail, part(F.lit(1), quarter)),
            (tail, part(length - half - quarter + 1, quarter)),
        ])
    ]


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for all words (unique ones of ``word, n``) exactly one edit apart, both ways round.

    An edit inserts, deletes or replaces a code point. The shorter of two words, or
    either of two equally long ones, gives its chunks, the longer its grams at the same
    place or shifted by one; what meets is verified. Words that share most of
    their letters without being near meet in vain, but no pair is left out, and
    Spark splits a signature that very many words share.
    """
    length = F.length("word")
    sized = words.select("word", "n", length.alias("size"))
    same = _signatures(F.col("word"), F.col("size"), F.col("size"))
    chunks = sized.select(F.col("word").alias("one"), F.col("n").alias("one_n"), "size", F.explode(F.array(*same)).alias("key"))
    longer = _signatures(F.col("word"), F.col("size") - 1, F.col("size"))
    grams = sized.select(
        F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("size").alias("other_size"),
        F.explode(F.array(*same, *longer)).alias("key"),
    )
    once = (F.col("other_size") > F.col("size")) | (F.col("one") < F.col("other"))
    within = F.col("other_size").between(F.col("size"), F.col("size") + 1)
    pairs = (
        chunks.join(grams, "key")
        .where(within & once & (F.levenshtein("one", "other", 1) == 1))
        .select("one", "one_n", "other", "other_n")
        .distinct()
    )
    ways = [
        F.struct(*[F.col(c).alias(name) for c, name in zip(way, ("word", "n", "near", "near_n"))])
        for way in (("one", "one_n", "other", "other_n"), ("other", "other_n", "one", "one_n"))
    ]
    return pairs.select(F.inline(F.array(*ways)))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` without cycles: the last form that is reached.

    Each round looks up the form of what was reached, so steps double.
    """
    reached = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = reached.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        led = stored(led, "forms")
        moved, reached = led.where("moved").limit(1).count(), led.drop("moved")
        if not moved:
            return reached


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for words and their counts (``word, n``).

    The ``form`` of a word is its near word with the largest count, of equal ones the
    first in code point order, if that is at least ``ratio`` times the word's own;
    else it is null. ``root`` follows forms to the last, and is the word itself without a form.
    ``ratio`` is over 1, so counts grow along forms and there are no cycles. Words
    that are null are left out; of repeated ones counts are added up.
    """
    words = stored(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = -F.col("best.less")
    enough = found >= ratio * F.col("n")
    near = near.select(
        "word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, found).alias("form_n")
    )
    near = stored(near, "near-words")
    roots = roots_of(near.where(F.col("form").isNotNull()))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n",
        )
    )
