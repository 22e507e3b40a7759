"""Language of a text by its nearest centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows, bounded_sample, let_go, staged

DIMENSIONS = 4096
LENGTH_CLASSES = DIMENSIONS.bit_length() + 1
GRAMS = (1, 2, 3, 4)
#: Documents of each language that a fit reads at most, the first by a hash of the id.
FIT_ROWS = 1500
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected below this quantile (less a margin) of the similarities of fitted texts of its length.
QUANTILE = 0.005
MARGIN = 0.95
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte n-grams of the whole lower-cased text.

    All between two runs of letters counts as one blank, so marks and digits say nothing.
    """
    letters = f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "
    b = np.frombuffer(letters.encode("utf-8"), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    code = np.zeros(len(b), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        if n in GRAMS and len(code):
            mixed = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
    return out


def length_class(counts: np.ndarray) -> int:
    """How much a text says: the binary logarithm of its number of different n-grams."""
    return int(np.count_nonzero(counts)).bit_length()


def excerpts(text: str) -> list[str]:
    """The first and the last 1, 2, 4, ... words of a text that have letters, and the text itself."""
    words, out, n = text.split(), [text], 1
    while n < len(words):
        out += [" ".join(words[:n]), " ".join(words[-n:])]
        n *= 2
    return [x for x in out if any(map(str.isalpha, x))]


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """One unit vector for each text: logarithmic counts times ``idf``."""
    return measured(texts, idf)[0]


def measured(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vector and length class of each text."""
    out = np.empty((len(texts), DIMENSIONS), dtype=np.float32)
    classes = np.zeros(len(texts), dtype=int)
    for i, text in enumerate(texts):
        counts = gram_counts(text)
        out[i], classes[i] = np.log1p(counts) * idf, length_class(counts)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1), classes


def bounds(texts: list[str], idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The least similarity of each length class, from the excerpts of a language's texts.

    A class that no excerpt has takes the bound of the next shorter one.
    """
    pieces = [x for text in texts for x in excerpts(text)]
    near, classes = np.zeros(len(pieces)), np.zeros(len(pieces), dtype=int)
    for start in range(0, len(pieces), 256):
        x, classes[start : start + 256] = measured(pieces[start : start + 256], idf)
        near[start : start + 256] = (x @ centres.T).max(axis=1)
    out = np.zeros(LENGTH_CLASSES)
    for c in range(1, LENGTH_CLASSES):
        out[c] = MARGIN * np.quantile(near[classes == c], QUANTILE) if (classes == c).any() else out[c - 1]
    return out


@dataclass(frozen=True)
class Model:
    """``centroids[i]`` belongs to ``langs[i]``; nearer than ``least[i]`` of the text's length class
    counts as that language."""

    langs: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit vectors, by cosine; the starts are spread by farthest-first choice."""
    starts, near = [0], x @ x[0]
    while len(starts) < min(k, len(x)):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    centres = x[starts]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(learn: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """Fit on ``learn`` (``doc_id, text, lang``): at most ``fit_rows`` documents of each language.

    Document frequencies and clusters
    are found by one task per language, over that bounded sample. A document that is less similar to its
    language than nearly all fitted ones is later rejected. Since short texts are less similar to any centroid,
    there is a bound for each length class, taken from the fitted documents and excerpts of them (``bounds``).
    It is a small quantile, so a few odd labelled rows do not lower it.
    """
    sample = staged(bounded_sample(learn.filter("trim(text) <> ''"), "lang", fit_rows))

    def frequencies(part: pd.DataFrame) -> pd.DataFrame:
        let_go()
        seen = np.zeros(DIMENSIONS)
        for text in part["text"]:
            seen += gram_counts(text) > 0
        return pd.DataFrame({"n": [len(part)], "seen": [seen.tolist()]})

    found = sample.select("lang", "text").groupBy("lang").applyInPandas(frequencies, "n long, seen array<double>").collect()
    n = sum(r["n"] for r in found)
    seen = np.sum([r["seen"] for r in found], axis=0) if found else np.zeros(DIMENSIONS)
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)

    def clusters(part: pd.DataFrame) -> pd.DataFrame:
        let_go()
        part = part.sort_values("doc_id")
        texts = part["text"].tolist()
        centres = clustered(vectors(texts, idf), centroids)
        least = bounds(texts, idf, centres).tolist()
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": centres.tolist(), "least": [least] * len(centres)})

    rows = sorted(
        map(tuple, sample.groupBy("lang").applyInPandas(clusters, "lang string, centre array<float>, least array<double>").collect())
    )
    return Model(
        tuple(r[0] for r in rows),
        idf,
        np.array([r[1] for r in rows], dtype=np.float32).reshape(len(rows), DIMENSIONS),
        np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), LENGTH_CLASSES),
    )


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of each text."""
    texts = [t or "" for t in texts]
    lang, score, far = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    usable = [i for i, t in enumerate(texts) if model.langs and any(map(str.isalpha, t))]
    for start in range(0, len(usable), 256):
        block = usable[start : start + 256]
        x, classes = measured([texts[i] for i in block], model.idf)
        near = x @ model.centroids.T
        for i, best, s, c in zip(block, near.argmax(axis=1).tolist(), near.max(axis=1).tolist(), classes.tolist()):
            lang[i], score[i], far[i] = model.langs[best], min(1.0, max(0.0, s)), bool(s < model.least[best][c])
    return lang, score, far


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with all their columns and without a shuffle."""

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        let_go()
        return ~pd.Series(classify(texts.tolist(), model)[2], dtype=bool)

    return df.filter(known(F.col(text_col)))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every whole text; only the text decides.

    ``score`` is the cosine to the nearest centroid (0 to 1); among equally near ones the
    first language by name wins. ``rejected`` means that the text is farther from the centroid
    than the fit allows. A null text, or one without a letter, is ``und``, score 0 and
    rejected; so is every text where nothing could be learned. Ids may be null or repeat; further
    columns are ignored; an empty table gives an empty result.
    """

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        lang, score, far = classify(batch.column(1).to_pylist(), model)
        return {"doc_id": batch.column(0), "lang_pred": lang, "score": score, "rejected": far}

    return arrow_rows(
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        rows,
        "doc_id long, lang_pred string, score double, rejected boolean",
    )


def learnable(df: DataFrame) -> DataFrame:
    return df.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")


def language_id(df: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the documents that are not held out, then predict all: ``doc_id, held_out, ...``.

    Held out are the documents whose id, as text, has a CRC-32 that leaves 2 when divided by
    4; documents with a null id are neither learned from nor held out.
    """
    return predict(df, fit(learnable(df), fit_rows)).withColumn("held_out", held_out(F.col("doc_id")))
