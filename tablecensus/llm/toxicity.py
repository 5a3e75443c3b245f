"""Toxicity by compression: which of two zstandard dictionaries shortens a text's windows more."""

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.llm.frames import lean

# Bytes each byte is written as before compression. A match costs zstandard three
# or four bytes, as much as a short word; written wide, a word costs more.
WIDTH = 6
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 64 << 10
# Windows remembered by a task; those not met again while half as many were new are forgotten.
REMEMBERED = 250_000
# Texts of an Arrow batch that are Python strings at a time.
AT_ONCE = 256


@dataclass(frozen=True)
class Dictionaries:
    """What learning gives: two dictionaries, the threshold, and how sharply it parts."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    slope: float
    window_words: int = 1


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: a checksum of the id divisible by 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@cache
def _codes() -> list[bytes]:
    draw = random.Random(WIDTH)
    return [bytes(draw.randrange(256) for _ in range(WIDTH)) for _ in range(256)]


def _wide(window: bytes) -> bytes:
    """The window between two spaces, so that whole words match longer than parts of words."""
    return b"".join(map(_codes().__getitem__, b" " + window + b" "))


def windows(text: str, words: int = 1) -> set[bytes]:
    """Runs of ``words`` words of the whole text, lower-cased; the last may be shorter."""
    parts = text.encode().lower().split()
    if words == 1:
        return set(parts)
    return {b" ".join(parts[i : i + words]) for i in range(0, len(parts), words)}


def _dictionary(found: list[bytes], most: int) -> bytes:
    """All byte values seen and then the windows, the most frequent last, where they are nearest."""
    chosen, size = [], 0
    for window in found:
        wide = _wide(window)
        if size + len(wide) > most:
            break
        chosen.append(wide)
        size += len(wide)
    return b"".join(reversed(chosen))


class Distance:
    """How much shorter the toxic dictionary makes a text's most telling window."""

    def __init__(self, model: Dictionaries):
        import zstandard

        settings = zstandard.ZstdCompressionParameters(
            window_log=20, hash_log=18, chain_log=18, search_log=9, min_match=6, target_length=64,
            strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.model = model
        self.sides = []
        for content in (model.ordinary, model.toxic):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=settings)
            self.sides.append(zstandard.ZstdCompressor(dict_data=data, compression_params=settings))
        self.frame = len(self.sides[0].compress(b""))  # what any window costs
        self.known: dict[bytes, float] = {}
        self.earlier: dict[bytes, float] = {}

    def of_window(self, window: bytes) -> float:
        wide = _wide(window)
        ordinary, toxic = (len(side.compress(wide)) for side in self.sides)
        return (ordinary - toxic) / (ordinary - self.frame)

    def of_text(self, text: str) -> float:
        """The largest over all windows; a text without words is as far as can be, -1."""
        if 2 * len(self.known) > REMEMBERED:
            self.known, self.earlier = {}, self.known
        known, earlier, largest = self.known, self.earlier, -1.0
        for window in windows(text, self.model.window_words):
            distance = known.get(window)
            if distance is None:
                distance = earlier.get(window)
                known[window] = distance = self.of_window(window) if distance is None else distance
            if distance > largest:
                largest = distance
        return largest

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(min(50.0, self.model.slope * (self.model.threshold - self.of_text(text)))))


def _calibrated(found: list[tuple[float, int]]) -> tuple[float, float, int]:
    """The threshold with fewest errors (halfway between two distances), a slope, the errors."""
    values = sorted({d for d, _ in found})
    cuts = [values[0] - 1, *[(a + b) / 2 for a, b in zip(values, values[1:])], values[-1] + 1]
    errors = {c: sum((d >= c) != bool(y) for d, y in found) for c in cuts}
    cut = min(cuts, key=lambda c: (errors[c], c))

    def loss(slope):
        return sum(math.log1p(math.exp(min(50.0, (-slope if y else slope) * (d - cut)))) for d, y in found)

    return cut, min((5.0, 10.0, 20.0, 40.0, 80.0), key=loss), errors[cut]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3_000,
    longest: int = 50_000,
    window_words: int = 1,
    shares: tuple[float, ...] = (0.01, 0.02, 0.04),
) -> Dictionaries | None:
    """Two dictionaries from a bounded sample of labelled texts; null without both labels.

    At most ``per_class`` texts of each label, drawn by a hash of their ids from the
    rows not :func:`held_out`, and of at most ``longest`` bytes: that bounds what
    comes to the driver. Two thirds train. The ordinary dictionary has the most
    frequent windows of ordinary texts; the toxic one those that toxic texts have
    and ordinary ones lack, if at least a certain share of the toxic texts has
    them. On the last third the share, the threshold and the slope are calibrated.
    Labels other than 0 and 1 and ids without a text are left out.
    """
    drawn = [
        labels.where((F.col("toxic") == value) & ~held_out())
        .select("doc_id", "toxic")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(per_class)
        for value in (0, 1)
    ]
    sample = drawn[0].unionByName(drawn[1])
    texts = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text") <= longest)
        .join(F.broadcast(sample), "doc_id")  # at most twice per_class ids
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"), F.min(F.xxhash64("doc_id")).alias("draw"))
        .orderBy("draw", "text")
        .limit(2 * per_class)
        .collect()
    )
    sides = {y: [r.text for r in texts if r.toxic == y] for y in (0, 1)}
    if not sides[0] or not sides[1]:
        return None
    fit = {y: side[: max(1, 2 * len(side) // 3)] for y, side in sides.items()}
    rest = [(t, y) for y, side in sides.items() for t in side[2 * len(side) // 3 :]] or [
        (t, y) for y, side in sides.items() for t in side
    ]
    counts = {y: Counter(w for t in side for w in windows(t, window_words)) for y, side in fit.items()}
    by_count = {y: sorted(c, key=lambda w, c=c: (-c[w], w)) for y, c in counts.items()}
    alphabet = _wide(bytes(sorted({b for w in counts[0] for b in w})))
    ordinary = alphabet + _dictionary(by_count[0], ORDINARY_BYTES)
    best = None
    for share in shares:
        least = max(min(2, len(fit[1])), share * len(fit[1]))
        telling = [w for w in by_count[1] if counts[1][w] >= least and w not in counts[0]]
        toxic = alphabet + _dictionary(telling, TOXIC_BYTES)
        distance = Distance(Dictionaries(ordinary, toxic, 0.0, 1.0, window_words))
        cut, slope, errors = _calibrated([(distance.of_text(t), y) for t, y in rest])
        if best is None or errors < best[0]:
            best = errors, Dictionaries(ordinary, toxic, cut, slope, window_words)
    return best[1]


def toxicity_score(docs: DataFrame, model: Dictionaries | None) -> Column:
    """A column with the score of ``text``, from 0 to 1; 0 for all without a model.

    Every window of the whole text is compressed with both dictionaries. Null and
    empty texts have no windows and score next to 0.
    """
    if model is None:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two bounded dictionaries

    def scores(batches: Iterator) -> Iterator:
        distance = Distance(sent.value)  # of this task, so what it remembers goes with it
        for texts in batches:
            found: list[float] = []
            for low in range(0, len(texts), AT_ONCE):
                found += [distance.score(t or "") for t in texts.slice(low, AT_ONCE).to_pylist()]
            yield pa.array(found, pa.float64())
            del texts
            pa.default_memory_pool().release_unused()

    def typed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(scores)(texts)

    return F.arrow_udf(typed, "double")(F.col("text"))


def score_toxicity(docs: DataFrame, model: Dictionaries | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, 1 from a score of 0.5 on.

    Rows come out as often as they went in; columns of these names are replaced.
    """
    scored = docs.withColumn("score", toxicity_score(docs, model))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
