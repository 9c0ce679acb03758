"""Spelling variants of words: near words by forward and reversed dictionaries.

Two words are near if one inserted, deleted or replaced character makes one of the other.  Of the characters that such an
edit could touch, it leaves the first half or the second half intact.  So near words lie in one shared-prefix block of the
dictionary sorted forwards, or in one shared-suffix block of the dictionary sorted backwards:

1. every word enters the blocks of its own length, and of one less (as the longer word of a pair), in either dictionary;
2. a block of more than ``LARGEST`` words is subdivided: what its words share stays fixed, and of the characters in
   between again one half is intact, so its words go on to a longer shared prefix or a longer shared suffix.  At one
   character in between there is nothing to halve, and as many words as there are characters for that place;
3. blocks are shuffled by what they share and sorted, and each is scanned once: pairs are verified within the join, so
   only near words leave it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.runtime import Scratch

#: Letters of a word, as a regular expression.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block beyond which it is subdivided.
LARGEST = 48
#: A form has at least so many times the occurrences of its variant.
RATIO = 5
_BLOCK = ["path", "short", "head", "tail"]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, rarest: int = 5, spoil: int | None = None) -> DataFrame:
    """word, n: maximal runs of letters in whole texts, A-Z lower-cased, of at least ``shortest`` characters and ``rarest``
    occurrences.  Null and empty texts have none; a null id counts as empty; rows that repeat count each.

    With ``spoil``, a planted misspelling: where that number divides the CRC-32 h of "<id>:<word>", the word loses
    its character h modulo its length.  Counts are combined before the shuffle.
    """
    # a run that is too short can't become a word; the expression is greedy, so what it finds are whole runs
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if spoil:
        found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.select(F.when(F.col("h") % spoil == 0, less).otherwise(F.col("word")).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= rarest) & (F.length("word") >= shortest))


def _first_blocks(words: DataFrame) -> DataFrame:
    """The blocks of every word: path, short (length of a pair's shorter word), head, tail, longer."""
    m = F.length("word")
    roles = F.array(F.struct(m.alias("short"), F.lit(False).alias("longer")), F.struct((m - 1).alias("short"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.short", "r.longer", F.lit("").alias("path"), F.lit("").alias("head"), F.lit("").alias("tail"))
    return _halved(rows)


def _between() -> Column:
    return F.col("short") - F.length("head") - F.length("tail")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of blocks as rows of their two halves: what is shared grows by half of what lies between, at either end."""
    half = F.floor(_between() / 2).cast("int")
    forward = F.struct(F.concat("path", F.lit("f")).alias("path"), F.substring("word", F.lit(1), F.length("head") + half).alias("head"), F.col("tail").alias("tail"))
    size = F.length("tail") + half
    backward = F.struct(F.concat("path", F.lit("b")).alias("path"), F.col("head").alias("head"), F.substring("word", F.length("word") - size + 1, size).alias("tail"))
    return rows.select("word", "n", "short", "longer", F.explode(F.array(forward, backward)).alias("b")).select("b.path", "short", "b.head", "b.tail", "word", "n", "longer")


def near_words(words: DataFrame, scratch: Scratch, largest: int = LARGEST) -> DataFrame:
    """word, n, other, other_n: every pair of near words of ``words`` (distinct words and their n), both ways round."""
    rows, levels = _first_blocks(words), []
    while True:
        sizes = rows.groupBy(*_BLOCK).agg(F.count_if(~F.col("longer")).alias("s"), F.count(F.lit(1)).alias("all")).where("s > 0 and all > 1")
        sizes = sizes.select(*_BLOCK, ((F.col("all") > largest) & (_between() > 1)).alias("large"))
        level = scratch.keep(rows.join(sizes, _BLOCK), f"level-{len(levels)}")
        levels.append(level.where("not large").drop("large"))
        large = level.where("large").drop("large")
        if large.isEmpty():
            break
        rows = _halved(large)
    blocks = levels[0]
    for level in levels[1:]:
        blocks = blocks.unionByName(level)
    a, b = blocks.where("not longer").drop("longer"), blocks.select(*_BLOCK, F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("longer"))
    same = F.lit(True)
    for c in _BLOCK:
        same = same & (a[c] == b[c])
    near = same & (b["longer"] | (a["word"] < b["other"])) & (F.levenshtein(a["word"], b["other"], 1) == 1)
    pairs = a.join(b, near).select("word", "n", "other", "other_n").distinct()
    pairs = scratch.keep(pairs, "pairs")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def spelling_groups(words: DataFrame, scratch: Scratch | None = None, ratio: int = RATIO, largest: int = LARGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n; distinct).

    A word's form is its near word of the largest n (of several the first in code-point order), if that is at least
    ``ratio`` times its own; else null.  The root follows forms to the last.  Counts grow along forms, so there are no
    cycles and few steps.  A word without near words has n_near 0 and is its own root.
    """
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, scratch, largest).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best"))
    near = near.select("word", "n_near", F.col("best.other").alias("best"), (-F.col("best.col1")).alias("best_n"))
    enough = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    found = scratch.keep(found, "forms")
    steps = scratch.keep(found.where("form is not null").select("word", F.col("form").alias("root")), "steps-0")
    top, low = found.agg(F.max("n"), F.min("n")).first()
    most = math.floor(math.log((top or 1) / (low or 1), ratio) + 1e-9) if ratio > 1 else 0  # forms that can follow each other
    for k in range(max(0, most - 1).bit_length()):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = scratch.keep(steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"steps-{k + 1}")
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
