"""The published Snowball rules for Russian, as an Arrow-batched UDF with a small memo of words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "аеиоуыэюя"
# The endings of the published algorithm.
GERUND_1, GERUND_2 = ("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE_1, PARTICIPLE_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
VERB_2 = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
SUPERLATIVE, DERIVATIONAL = ("ейше", "ейш"), ("ость", "ост")


def _longest(word: str, start: int, free: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """The word without its longest ending that lies in word[start:]; endings of `after_a` need а or я before them."""
    best = ""
    for ending in (*free, *after_a):
        if len(ending) > len(best) and len(word) - len(ending) >= start and word.endswith(ending):
            if ending in free or word[: -len(ending)][-1:] in ("а", "я") and len(word) - len(ending) > start:
                best = ending
    return word[: -len(best)] if best else None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    word = word.lower().replace("ё", "е")
    first = re.search(f"[{VOWELS}]", word)
    if not first:
        return word
    rv = first.end()
    r1 = re.search(f"[{VOWELS}][^{VOWELS}]", word)
    r2 = r1 and re.search(f"[{VOWELS}][^{VOWELS}]", word[r1.end() :])
    r2_start = r1.end() + r2.end() if r2 else len(word)
    done = _longest(word, rv, GERUND_2, GERUND_1)
    if done is None:
        word = _longest(word, rv, REFLEXIVE) or word
        adjective = _longest(word, rv, ADJECTIVE)
        if adjective is not None:
            done = _longest(adjective, rv, PARTICIPLE_2, PARTICIPLE_1) or adjective
        else:
            done = _longest(word, rv, VERB_2, VERB_1)
            if done is None:
                done = _longest(word, rv, NOUN)
    word = word if done is None else done
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    word = _longest(word, r2_start, DERIVATIONAL) or word
    if len(word) > rv and word.endswith("нн"):
        return word[:-1]
    cut = _longest(word, rv, SUPERLATIVE)
    if cut is not None:
        return cut[:-1] if cut.endswith("нн") else cut
    return word[:-1] if len(word) > rv and word.endswith("ь") else word


def stems(words: Column) -> Column:
    """Stems of an array of words, aligned with it."""

    @F.pandas_udf("array<string>")
    def of(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else [stem(w) for w in x])

    return of(words)
