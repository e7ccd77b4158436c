"""Vectors of one word in its sentences, from the hidden states of a pluggable token encoder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import dot

#: Texts to (offsets of n tokens, n x size hidden states); made once in a task.
TokenEncoder = Callable[[], Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]]


def hash_token_encoder(size: int = 32) -> TokenEncoder:
    """A deterministic stand-in: hashed words mixed with half of each neighbour's vector. It is no language model."""

    def make():
        import zlib

        def states(words: list[str]) -> np.ndarray:
            own = np.array([np.random.default_rng(zlib.crc32(w.lower().encode())).standard_normal(size) for w in words]).reshape(len(words), size)
            mixed = own.copy()
            mixed[1:] += own[:-1] / 2
            mixed[:-1] += own[1:] / 2
            return mixed

        def encode(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
            found = [list(re.finditer(r"\w+", t)) for t in texts]
            return [(np.array([m.span() for m in f], int).reshape(len(f), 2), states([m.group() for m in f])) for f in found]

        return encode

    return make


def word_in_context(rows: DataFrame, word: str, encoder: TokenEncoder, key: str, text: str = "text", batch: int = 16) -> DataFrame:
    """(key, vector): the unit mean of the hidden states of the tokens that overlap the first word beginning with `word`.

    A text without the word, or one whose word meets no token, is an error.
    """
    kind = rows.schema[key].dataType.simpleString()
    pattern = rf"{re.escape(word)}\w*"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for f in frames:
            vectors = []
            for s in range(0, len(f), batch):
                texts = f[text].iloc[s : s + batch].fillna("").tolist()
                for one, (spans, hidden) in zip(texts, encode(texts)):
                    at = re.search(pattern, one, re.IGNORECASE)
                    if at is None:
                        raise ValueError(f"a context lacks the word {word}")
                    own = (spans[:, 1] > at.start()) & (spans[:, 0] < at.end())
                    if not own.any():
                        raise ValueError(f"no token overlaps the word {word}")
                    v = np.asarray(hidden, float)[own].mean(0)
                    vectors.append((v / (np.linalg.norm(v) or 1.0)).tolist())
            yield pd.DataFrame({key: f[key], "vector": vectors})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")


def cosine_matrix(vectors: DataFrame, key: str, most: int = 100) -> DataFrame:
    """(key, cosines): each row's inner products with all rows' unit vectors in order of the key. For a few rows; more than `most` are an error."""
    if (n := vectors.count()) > most:
        raise ValueError(f"a matrix of {n} rows is too large, {most} are allowed")
    every = vectors.agg(F.array_sort(F.collect_list(F.struct(key, "vector"))).alias("every"))  # `most` rows at most
    rows = every.select("every", F.explode("every").alias("own"))
    return rows.select(F.col("own")[key].alias(key), F.transform("every", lambda o: F.round(dot(F.col("own.vector"), o["vector"]), 6)).alias("cosines"))
