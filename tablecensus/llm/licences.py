"""Licences of files: TF-IDF cosine of lines, headers and whole files to licence texts, and inheritance along paths."""

import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecensus.llm import licence_texts
from tablecensus.llm.frames import stored

# Notices of one sentence; longer texts are in ``licence_texts``.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0",
    "BSD-3-Clause": "Released under the BSD 3-Clause License",
    "BSD-2-Clause": "Released under the BSD 2-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
}
LICENCE_FILE = r"(?i)^(un)?(licen[sc]e|copying|copyright|notice)([.-].*)?$"
# Lines that are a comment or blank, comments that end with a mark (and with which of them), and what may stand before.
COMMENT_LINE = r"(?i)^\s*(?:$|#|//|/\*|\*|--|;|%|<!--|\"\"\"|'|!|\(\*|\{-|<\?|dnl\s|rem\s)"
COMMENT_BLOCKS = ((r"/\*", "*/", 1), ("<!--", "-->", 1), (r'"""', '"""', 2), ("'''", "'''", 2), (r"\(\*", "*)", 1), (r"\{-", "-}", 1))
BEFORE_COMMENT = r"^\s*(?:<\?[^\n]*\n\s*|#![^\n]*\n\s*)?"
GAP = "\uffff"  # stands for lines between runs
LETTERS_OF_NO_WORD = "\t\n\x0b\x0c\r.,;:!?()[]{}<>\"'`/\\|-_*#=+~"


def words(text: Column) -> Column:
    """Lower-cased words; punctuation parts them."""
    plain = F.translate(F.lower(text), LETTERS_OF_NO_WORD, " " * len(LETTERS_OF_NO_WORD))
    return F.array_remove(F.split(plain, " "), "")


def _words(text: str) -> list[str]:
    """What :func:`words` does, for texts on the driver."""
    return [w for w in text.lower().translate(str.maketrans(dict.fromkeys(LETTERS_OF_NO_WORD, " "))).split(" ") if w]


def _forms(templates: Mapping[str, str], texts: Mapping[str, Sequence[str]], tags: Mapping[str, Sequence[str]]) -> list[tuple]:
    """Licence, words with their number and words that must be met of each text to compare with."""
    whole = [(name, text, "") for name, text in templates.items()]
    whole += [(name, text, "") for name, several in texts.items() for text in several]
    whole += [(name, f"SPDX-License-Identifier: {tag}", tag) for name, several in tags.items() for tag in several]
    return [(name, Counter(_words(text)), set(_words(tag))) for name, text, tag in whole]


def _weights(forms: list[tuple], idf: Mapping[str, float], least: float) -> tuple[list[tuple], list[str]]:
    """Rows of normalised weights, and anchors: words one of which whatever reaches ``least`` has.

    By Cauchy and Schwarz a cosine is at most the length of the part of the form that
    is shared. So of each form its rarest words are anchors, as many as
    are needed for the others to stay below ``least``.
    """
    rows, anchors = [], set()
    for form, (licence, counts, must) in enumerate(forms):
        weights = {w: n * idf[w] for w, n in counts.items()}
        norm = math.sqrt(math.fsum(x * x for x in weights.values()))
        if not norm:
            continue
        rest = 1.0
        for w, x in sorted(weights.items(), key=lambda p: (-idf[p[0]], p[0])):
            rows.append((form, licence, w, x / norm, int(w in must), len(must)))
            if x and rest >= max(least - 1e-6, 0) ** 2 - 1e-9:
                anchors.add(w)
                rest -= (x / norm) ** 2
    return rows, sorted(anchors)


def _array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _units(text: Column, anchors: Column) -> Column:
    """What of a text is compared, as an array of ``kind, said``; units of one kind do not overlap.

    Lines and sentences, paragraphs, runs of neighbouring lines with an anchor, runs of
    comment lines, the block comment at the top, and the whole.
    """
    unit = lambda kind: lambda said: F.struct(F.lit(kind).alias("kind"), said.alias("said"))
    several = lambda said: said.rlike(r"\n|[.!?]\s")  # a line alone is a unit already
    physical = F.split(text, r"\n")
    paragraphs = F.split(text, r"\n[\s.,;:!?()\[\]{}<>\"'`/\\|\-_*#=+~]*\n")
    kept = lambda holds: F.array_join(F.transform(physical, lambda line: F.when(holds(line), line).otherwise(F.lit(GAP))), "\n")
    parted = lambda holds: F.split(kept(holds), rf"(?:^|\n){GAP}(?=\n|$)")
    runs = parted(lambda line: F.arrays_overlap(words(line), anchors))
    comments = parted(lambda line: line.rlike(COMMENT_LINE))
    block = F.lit("")
    for opening, closing, nth in COMMENT_BLOCKS:
        block = F.when(text.rlike(BEFORE_COMMENT + opening), F.substring_index(text, closing, nth)).otherwise(block)
    return F.concat(
        F.transform(F.split(text, r"\n|(?<=[.!?])\s+"), unit(0)),
        F.transform(F.filter(paragraphs, several), unit(1)),
        F.transform(F.filter(runs, several), unit(2)),
        F.transform(F.filter(comments, several), unit(3)),
        F.transform(F.filter(F.array(block), several), unit(4)),
        F.transform(F.filter(F.array(text), several), unit(5)),
    )


def scan_licences(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    least: float = 0.75,
    mostly: float = 0.5,
    carry: Sequence[str] | None = None,
    texts: Mapping[str, Sequence[str]] | None = None,
    tags: Mapping[str, Sequence[str]] = licence_texts.SPDX,
) -> DataFrame:
    """``files``, or its columns in ``carry``, with ``licence``, ``licence_score``, ``licence_origin`` and ``licence_from``.

    Every unit of the whole text (:func:`_units`: lines, paragraphs, comments,
    the whole file) is a sparse vector of its words, weighted by their frequency in it and
    the logarithm of their rarity among all files (words of no form count as rarest). So is
    each form: the notices in ``templates``, the headers, titles and whole licence files in ``texts`` (by default
    those of ``licence_texts``), and an SPDX line for each of ``tags``, which must be met with all words of its tag.
    They meet in a join on words. Units without any of the words that a cosine of ``least`` takes are left
    out before. A file's own licence (origin ``own``) is that of the form with the largest
    cosine to any unit, from ``least`` on, ties by name.

    A licence file is one whose name says so or whose words are at least by the share
    ``mostly`` in units of one kind that match. Other files without a licence of their own inherit (``inherited``) that
    of the nearest directory above them that has a licence file with a licence, by a join
    of each directory's ancestors with those directories; of several there the best score, then
    name, then path. What is left has origin ``none``.

    Null and empty texts have no lines, a null path is in no directory and
    inherits nothing. Repeated rows are judged alike and all kept. Columns with the names
    of new ones are replaced. Without files there are no rows. ``files`` is read twice.
    """
    spark = files.sparkSession
    names = [c for c in (files.columns if carry is None else carry) if c not in ("licence", "licence_score", "licence_origin", "licence_from")]
    forms = _forms(templates, licence_texts.texts() if texts is None else texts, tags)
    vocabulary = sorted({w for _, counts, _ in forms for w in counts})
    rows = files.select(
        F.struct(*names).alias("file"),
        F.col(path).cast("string").alias("at"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    ).select("*", words(F.col("t")).alias("w"))
    # files in which each word of the forms occurs; as no word is empty, that stands for all files
    hits = F.concat(F.array_intersect("w", _array(vocabulary)), F.array(F.lit("")))
    counts = dict(
        rows.select(F.explode(hits).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files")).collect()
    )
    total = counts.get("", 0)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    weights, anchors = _weights(forms, idf, least)
    anchors = _array(anchors)
    rarest = F.lit(math.log(total + 1))
    # the texts of files that may match; of others only what their rows carry
    rows = stored(
        rows.select(
            "file", "at", F.size("w").alias("n_words"),
            F.when(F.arrays_overlap("w", anchors), F.col("t")).alias("t"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "licence-words",
    )
    idf = stored(spark.createDataFrame(list(idf.items()), "word string, idf double"), "idf")  # one row per word of the forms
    weights = stored(
        spark.createDataFrame(weights, "form int, licence string, word string, weight double, must int, musts int"), "licence-weights"
    )

    # units against forms
    units = rows.where(F.col("t").isNotNull()).select("row", F.posexplode(_units(F.col("t"), anchors)).alias("unit", "what"))
    units = units.select("row", "unit", "what.kind", words(F.col("what.said")).alias("w")).where(F.arrays_overlap("w", anchors))
    place = ["row", "unit", "kind", "size"]
    terms = (
        units.select("row", "unit", "kind", F.size("w").alias("size"), F.explode("w").alias("word"))
        .groupBy(*place, "word")
        .agg(F.count(F.lit(1)).alias("tf"))
        .join(F.broadcast(idf), "word", "left")
        .select(*place, "word", (F.col("tf") * F.coalesce("idf", rarest)).alias("weight"), F.col("idf").isNotNull().alias("known"))
    )
    terms = stored(terms, "licence-terms")
    square = F.col("weight") * F.col("weight")
    lengths = terms.groupBy(*place).agg(
        F.sqrt(F.sum(square)).alias("length"), F.sqrt(F.sum(F.when(F.col("known"), square).otherwise(0.0))).alias("known")
    )
    # no cosine is above the share of a unit that lies in words of the forms
    lengths = stored(
        lengths.where((F.col("length") > 0) & (F.col("known") >= (least - 1e-6) * F.col("length"))).drop("known"), "licence-units"
    )
    dots = (
        terms.where("known").select("row", "unit", "word", F.col("weight").alias("unit_weight"))
        .join(lengths.select("row", "unit"), ["row", "unit"], "left_semi")
        .join(F.broadcast(weights), "word")
        .groupBy("row", "unit", "form", "licence", "musts")
        .agg(F.sum(F.col("unit_weight") * F.col("weight")).alias("dot"), F.sum("must").alias("met"))
        .where(F.col("met") == F.col("musts"))
    )
    scores = dots.join(lengths, ["row", "unit"]).select(
        "row", "unit", "kind", "size", "licence", F.round(F.col("dot") / F.col("length"), 9).alias("score")
    )
    matches = scores.where(F.col("score") >= least)
    sizes = matches.groupBy("row", "kind", "unit").agg(F.max("size").alias("size")).groupBy("row", "kind").agg(F.sum("size").alias("size"))
    sizes = sizes.groupBy("row").agg(F.max("size").alias("matched"))
    best = matches.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    own = stored(
        best.join(sizes, "row").select("row", "best.licence", (-F.col("best.minus")).alias("score"), "matched"), "licences"
    )

    # directories and what their licence files say
    parts = F.split("at", "/")
    name, directory = F.element_at(parts, -1), F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1))
    rows = rows.select("file", "row", "at", "n_words", name.alias("name"), F.when(F.col("at").isNotNull(), directory).alias("directory"))
    judged = rows.join(own, "row", "left")
    is_licence_file = F.col("name").rlike(LICENCE_FILE) | (F.col("matched") >= mostly * F.col("n_words"))
    speaking = judged.where(F.col("licence").isNotNull() & F.col("directory").isNotNull() & is_licence_file)
    speaking = speaking.groupBy("directory").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "licence", "at")).alias("says")
    ).select(F.col("directory").alias("above"), "says")
    speaking = stored(speaking, "licence-directories")
    steps = F.sequence(F.lit(0), F.size(F.split("directory", "/")))
    ancestors = (
        rows.select("directory").where(F.col("directory").isNotNull()).distinct()
        .select("directory", F.explode(steps).alias("depth"))
        .select("directory", "depth", F.concat_ws("/", F.slice(F.split("directory", "/"), 1, F.col("depth"))).alias("above"))
    )
    heirs = (
        ancestors.join(speaking, "above")
        .groupBy("directory")
        .agg(F.max_by("says", "depth").alias("says"))
    )
    heirs = stored(heirs, "heirs")
    found = judged.join(heirs, "directory", "left")
    has, gets = F.col("licence").isNotNull(), F.col("says").isNotNull()
    return found.select(
        *[F.col(f"file.`{c}`").alias(c) for c in names],
        F.coalesce("licence", "says.licence").alias("licence"),
        F.when(has, F.col("score")).otherwise(-F.col("says.minus")).alias("licence_score"),
        F.when(has, "own").when(gets, "inherited").otherwise("none").alias("licence_origin"),
        F.when(~has & gets, F.col("says.at")).alias("licence_from"),
    )
