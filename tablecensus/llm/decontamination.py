"""Benchmark windows in documents: a join on each window's rarest shingle, then checked word for word."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecensus.llm.frames import small, stored, utf8

WINDOW = 10
# Words in a shingle.
SHINGLE = 3
# Everything but 0-9, A-Z, a-z and what is not ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased; of null none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def shingles(found: Column, size: int) -> Column:
    """``size`` neighbouring words with a space between them, from every word on; null where too few follow."""

    def shingle(word: Column, i: Column) -> Column:
        parts = [word]
        for k in range(1, size):
            parts += [F.lit(" "), F.get(found, i + k)]
        return F.concat(*parts)

    return F.transform(found, shingle)


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``number, words, size, shingles, items``: the distinct windows of all items, stored.

    A window is ``window`` neighbouring words, or a shorter item as a whole;
    ``size`` is the words in each of its shingles, ``items`` the ids of the items that have it, as
    texts. Items are told apart by ``item_id`` (null: an empty text); those without words have no window.
    """
    found = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    count = F.size("w")
    cut = found.where(count > 0).select(
        "item", "w", F.explode(F.sequence(F.lit(0), F.greatest(count - window, F.lit(0)))).alias("at")
    )
    cut = cut.select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("w"))
    merged = cut.groupBy("w").agg(F.collect_set("item").alias("items"))
    count = F.size("w")
    size = F.least(count, F.lit(shingle))
    by_size = F.lit(None)
    for k in range(1, shingle + 1):
        by_size = F.when(size == k, F.filter(shingles(F.col("w"), k), lambda s: s.isNotNull())).otherwise(by_size)
    numbered = merged.select(
        F.monotonically_increasing_id().alias("number"), count.alias("words"), size.alias("size"),
        by_size.alias("shingles"), "items",
    )
    return stored(numbered, "windows")  # from here on numbers stay


def _row_key() -> list[Column]:
    return [F.col("doc_id"), F.md5(utf8()).alias("digest")]


def _placed(size: int) -> Callable[[Column, Column], Column]:
    return lambda s, i: F.struct(F.lit(size).alias("size"), i.alias("at"), s.alias("shingle"))


def shingle_places(docs: DataFrame, vocabulary: DataFrame, sizes: list[int]) -> DataFrame:
    """Where the shingles of ``vocabulary`` (``shingle``) begin in each text, stored; texts are read once.

    Rows are known by ``doc_id, digest``. Besides one row per place (``size, at, shingle``) every
    row of ``docs`` has one with size 0, an empty shingle and its number of words as ``at``.
    """
    found = F.col("w")
    none = F.struct(F.lit(0).alias("size"), F.size(found).alias("at"), F.lit("").alias("shingle"))
    every = [F.array(none)]
    for size in sizes:
        every.append(F.transform(shingles(found, size), _placed(size)))
    known = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([("",)], "shingle string"))
    known = small(stored(known, "vocabulary"), F.octet_length("shingle"))
    rows = docs.select(*_row_key(), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "digest", F.inline(F.concat(*every)))
    return stored(rows.join(known, "shingle"), "shingle-places")


def window_prefixes(windows: DataFrame, places: DataFrame) -> DataFrame:
    """Each window's rarest shingle and its place there (``shingle, offset``), stored.

    A window lies only where all of its shingles do, so for containment a prefix of one,
    in the order of rarity over all texts, is all that must meet. Windows with a
    shingle that no text has are left out.
    """
    often = places.where("size > 0").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    each = windows.select("number", F.posexplode("shingles").alias("offset", "shingle"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    chosen = each.join(often, "shingle", "left").groupBy("number").agg(rarest).where(F.col("rarest.n") > 0)
    chosen = chosen.select("number", "rarest.shingle", "rarest.offset")
    return stored(chosen.join(windows.drop("items"), "number"), "prefixes")


def occurrences(places: DataFrame, prefixes: DataFrame, shingle: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """``doc_id, digest, start, words, number``: where whole windows begin, exactly.

    At each place the shingles around it, as many as a window has, are looked at with
    it. A window whose rarest shingle is there must begin in the text and have its
    shingles, one after another, from its begin on.
    """
    reach = max(window - shingle, 0)
    here = Window.partitionBy("doc_id", "digest", "size").orderBy("at").rowsBetween(-reach, reach)
    around = F.collect_list(F.struct("at", "shingle")).over(here)
    near = places.where("size > 0").distinct().withColumn("around", around)
    size = prefixes.select(
        F.col("size").alias("window_size"), "shingle", "offset", "number", "words", F.col("shingles").alias("wanted")
    )
    met = near.join(small(size, F.octet_length(F.array_join("wanted", " "))), "shingle")
    start = F.col("at") - F.col("offset")
    met = met.where((F.col("size") == F.col("window_size")) & (start >= 0)).withColumn("start", start)
    inside = F.filter(
        "around", lambda x: (x["at"] >= F.col("start")) & (x["at"] < F.col("start") + F.size("wanted"))
    )
    same = F.transform(inside, lambda x: x["shingle"]) == F.col("wanted")
    return met.where(same).select("doc_id", "digest", "start", "words", "number")


def _covered(spans: Column) -> Column:
    """How many words lie in at least one of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(total: Column, span: Column) -> Column:
        end = F.greatest(total["end"], span["start"] + span["words"])
        more = end - F.greatest(total["end"], span["start"])
        return F.struct(end.alias("end"), (total["n"] + F.greatest(more, F.lit(0))).cast("bigint").alias("n"))

    return F.aggregate(spans, zero, add, lambda total: total["n"])


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window of any item of
    ``items`` (``item_id, text``), ``items`` are the ids of the items with such a window, as
    sorted texts. Whole texts are looked at. Null and empty texts have no words; null
    ids are joined like others; rows come out as often as they went in, and other
    columns are not looked at. Without items or documents nothing is hit.

    All steps are joins and aggregates of Spark. What travels are the places of
    shingles that some item has, not texts. Broadcasts are of measured size; beyond
    it the same joins are shuffled, and Spark splits shingles that very many texts have.
    """
    windows = item_windows(items, window, shingle)
    sizes = sorted(r.size for r in windows.select(F.col("size")).distinct().collect())  # at most ``shingle`` numbers
    vocabulary = windows.select(F.explode("shingles").alias("shingle")).distinct()
    places = shingle_places(docs, vocabulary, sizes)
    met = occurrences(places, window_prefixes(windows, places), shingle, window)
    found = met.groupBy("doc_id", "digest").agg(
        _covered(F.sort_array(F.collect_set(F.struct("start", "words")))).alias("n_hit"),
        F.collect_set("number").alias("numbers"),
    )
    found = stored(found, "contaminated")
    owners = small(windows.select("number", "items"), F.octet_length(F.array_join("items", ",")))
    named = (
        found.select("doc_id", "digest", "n_hit", F.explode("numbers").alias("number"))
        .join(owners, "number")
        .groupBy("doc_id", "digest", "n_hit")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("doc_id").alias("id"), F.col("digest").alias("text_digest"), "n_hit", "items")
    )
    rows = places.where("size = 0").select("doc_id", "digest", F.col("at").cast("bigint").alias("n_words"))
    joined = rows.join(
        named, rows["doc_id"].eqNullSafe(F.col("id")) & (rows["digest"] == F.col("text_digest")), "left"
    )
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        items_found.alias("items"),
        (hit > 0).alias("contaminated"),
    )
