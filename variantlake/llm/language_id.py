"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1 (drawn from its code point).  A letter
trigram is the product of its letters' vectors, each rotated by its place; a text is the
sum of its trigrams' vectors, and a language's prototype is the sum of its texts'.  A
document gets the language whose prototype has the highest cosine with its vector.

Learning is one pass: each task sums integer vectors per language and Spark adds these
up, so prototypes do not depend on partitioning or order.  Only the prototypes (languages
x ``dim`` numbers) reach the driver.  Predicting is a narrow pass without a shuffle.

Defined results: letters are lower-cased ``str.isalpha`` characters, everything else is a
word boundary, and runs of boundaries count once.  A text that is null or has no letter
is ``und`` with score 0, as is everything when nothing was learned; equal cosines go to
the alphabetically first language; a negative cosine scores 0.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake.llm.common import map_batches, python_ready, tidied

DIM = 2048
CHUNK_DOCS, CHUNK_CHARS, CHUNK_GRAMS = 512, 1_500_000, 2048
_NUMBERS = 1 << 22  # of a chunk's trigram vectors; twice that for letters' vectors
_DENSE = 1 << 22  # trigram codes that fit a lookup table; beyond it they are sorted

_LETTERS: dict[tuple[int, int], np.ndarray] = {}


def letter_vector(code: int, dim: int) -> np.ndarray:
    """The random +1/-1 vector of a code point (0: word boundary)."""
    vec = _LETTERS.get((code, dim))
    if vec is None:
        if len(_LETTERS) >= 2 * _NUMBERS // dim:
            _LETTERS.clear()
        bits = np.random.default_rng(77_003 + code).integers(0, 2, dim)
        vec = _LETTERS[code, dim] = (2 * bits - 1).astype(np.float32)
    return vec


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram number) of every trigram, and the trigrams' code points."""
    joined = "".join(f" {t.lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 2 for t in texts])
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.array([0, *(c for c in np.flatnonzero(seen) if chr(c).isalpha())])
    # a code is below base ** 3, and base 1,290 fits 32 bits
    number = np.zeros(0x110000, np.int32 if len(alphabet) <= 1290 else np.int64)
    number[alphabet[1:]] = np.arange(1, len(alphabet))
    letter = number[codes]
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] != 0) | (letter[:-1] != 0) | (doc[1:] != doc[:-1])
    letter, doc = letter[keep], doc[keep]
    inside = doc[2:] == doc[:-2]
    base = len(alphabet)
    code = ((letter[:-2] * base + letter[1:-1]) * base + letter[2:])[inside]
    doc = doc[:-2][inside]
    if base**3 <= _DENSE:
        there = np.zeros(base**3, bool)
        there[code] = True
        grams = np.flatnonzero(there)
        number = np.zeros(base**3, np.int32)
        number[grams] = np.arange(len(grams))
        code = number[code]
    else:
        grams, code = np.unique(code, return_inverse=True)
    return doc, code, np.stack([alphabet[grams // base // base], alphabet[grams // base % base], alphabet[grams % base]], axis=1)


def _gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """One row per trigram: rotate each letter's vector by its place, then multiply."""
    codes, at = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(c), dim) for c in codes])
    at = at.reshape(grams.shape)
    out = np.roll(table, 2, axis=1)[at[:, 0]]
    out *= np.roll(table, 1, axis=1)[at[:, 1]]
    out *= table[at[:, 2]]
    return out


def bundle(texts: list[str], owner: np.ndarray, n_owners: int, dim: int) -> np.ndarray:
    """Sum of the trigram vectors of the texts of each owner (``owner[i]`` of text i)."""
    out = np.zeros((n_owners, dim), np.float32)
    if not texts:
        return out
    doc, code, grams = _trigrams(texts)
    own = owner[doc]
    step = max(1, min(CHUNK_GRAMS, _NUMBERS // dim))
    for at in range(0, len(grams), step):
        part = grams[at : at + step]
        here = (code >= at) & (code < at + len(part)) if len(grams) > step else slice(None)
        counts = np.bincount(own[here] * len(part) + code[here] - at, minlength=n_owners * len(part))
        out += counts.reshape(n_owners, len(part)).astype(np.float32) @ _gram_vectors(part, dim)
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of bounded number and characters (a longer text alone)."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= CHUNK_DOCS or chars + len(t) > CHUNK_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if texts:
        yield start, len(texts)


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype of every language among the labelled texts of ``docs`` (all rows count)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            langs, owner = np.unique(pdf["lang"].to_numpy(str), return_inverse=True)
            for s, e in _chunks(texts):
                part = bundle(texts[s:e], owner[s:e], len(langs), dim)
                for lang, vec in zip(langs, part):
                    total[lang] = total.get(lang, 0) + vec.astype(np.int64)
        for lang, vec in total.items():
            yield pd.DataFrame({"lang": [lang], "vec": [vec]})

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    parts = map_batches(rows, sums, "lang string, vec array<long>")
    added = parts.select("lang", F.posexplode("vec").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, i, x in added.collect():  # languages x dim numbers
        found.setdefault(lang, np.zeros(dim))[i] = x
    return {lang: found[lang] for lang in sorted(found) if found[lang].any()}


def _best(texts: list[str], names: list[str], unit: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Language and cosine of each text; ``und`` and 0 without a letter."""
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    for s, e in _chunks(texts) if names else ():
        vec = bundle(texts[s:e], np.arange(e - s), e - s, dim)
        length = np.sqrt(np.einsum("ij,ij->i", vec, vec, dtype=np.float64))
        cos = (vec @ unit) / np.maximum(length, 1e-9)[:, None]
        best = cos.argmax(axis=1)
        known = length > 0
        lang[s:e][known] = np.array(names, object)[best[known]]
        score[s:e] = np.where(known, np.clip(cos[np.arange(e - s), best], 0, 1), 0)
    return lang, score


def predict(text: Column, prototypes: dict[str, np.ndarray], *, dim: int = DIM, limit: Column | None = None,
            longer: dict[str, np.ndarray] | None = None, longer_dim: int = DIM) -> Column:
    """Struct (lang, score) of a text column.

    With ``limit``, a cosine that is to be reached, texts that are not six deviations
    (of chance at ``dim``) above it are decided by the prototypes ``longer`` instead.
    """
    units = [(list(p), np.stack([v / np.linalg.norm(v) for v in p.values()]).astype(np.float32).T if p else None, d)
             for p, d in ((prototypes, dim), (longer or {}, longer_dim))]
    clear = 6 / dim**0.5

    def classify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, limits in batches:
            texts = [t if isinstance(t, str) else "" for t in texts]
            lang, score = _best(texts, *units[0])
            close = np.flatnonzero((lang != "und") & (score < limits.to_numpy(float) + clear))  # NaN: no limit
            if len(close):
                lang[close], score[close] = _best([texts[i] for i in close], *units[1])
            yield pd.DataFrame({"lang": lang, "score": score})

    limit = F.lit(None) if limit is None else limit
    return F.pandas_udf(tidied(classify), "lang string, score double")(text, limit.cast("double"))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score", **how) -> DataFrame:
    """``docs`` with the predicted language and its cosine (``how``: see ``predict``); columns of
    these names are replaced."""
    python_ready(docs.sparkSession)
    hit = predict(F.col(text_col), prototypes, **how)
    return docs.drop(lang_out, score_out).withColumn("_language_hit", hit).select(
        *[c for c in docs.columns if c not in (lang_out, score_out)], F.col("_language_hit.lang").alias(lang_out), F.col("_language_hit.score").alias(score_out))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
