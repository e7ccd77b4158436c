"""Greedy packing of sentences into chunks, as a fold over the sentence array inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import SENTENCES_AND_CLAUSES, sentences, words

_STATE = "struct<done:array<string>,now:string,n:int>"


def _flush(s: Column) -> Column:
    return F.when(s["n"] > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])


def chunks(text: Column, most: int, hard_split: bool = False, pattern: str = SENTENCES_AND_CLAUSES) -> Column:
    """array<string> of chunks of at most `most` words.

    A longer sentence is a chunk of its own; with hard_split it ends the open chunk and is cut into slices of `most`
    words, the last of which takes no further sentence.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(s: Column, sentence: Column) -> Column:
        parts = words(sentence)
        n = F.size(parts)
        fits = (s["n"] > 0) & (s["n"] + n <= most)
        longer = F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(" "), sentence).alias("now"), (s["n"] + n).alias("n"))
        fresh = F.struct(_flush(s).alias("done"), sentence.alias("now"), n.alias("n"))
        out = F.when(fits, longer)
        if hard_split:
            slices = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int")), lambda k: F.array_join(F.slice(parts, k * most + 1, most), " "))
            out = F.when(n > most, F.struct(F.concat(_flush(s), slices).alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))).when(fits, longer)
        return out.otherwise(fresh)

    return F.aggregate(sentences(text, pattern), start.cast(_STATE), lambda s, x: step(s, x).cast(_STATE), _flush)
