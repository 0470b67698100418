"""Term counts, TF-IDF and pluggable sentence encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.scalars import tokenize
from shelfwise.session import materialize, measured


def term_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, term, tf) for every distinct term of every text."""
    tokens = df.select(key, F.explode(tokenize(text)).alias("term"))
    return tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df, total) from (key, term, tf)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def document_frequency_filter(
    counts: DataFrame,
    n_docs,
    min_df: float = 0.005,
    max_df: float = 0.99,
    max_features: int | None = None,
) -> DataFrame:
    """Terms with min_df * n <= df <= max_df * n, optionally only the
    ``max_features`` most frequent ones. ``n_docs`` is a number or a column."""
    n = F.lit(n_docs) if not hasattr(n_docs, "alias") else n_docs
    vocab = document_frequency(counts).filter(
        (F.col("df") >= n * F.lit(min_df)) & (F.col("df") <= n * F.lit(max_df))
    )
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("total"), "term").limit(max_features)
    return vocab


def tfidf_terms(
    df: DataFrame,
    text: str,
    key: str,
    min_df: float = 0.005,
    max_df: float = 0.99,
    max_features: int | None = None,
) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), rows of unit
    length. The vocabulary is written first, so a join that is measured to be
    small broadcasts it and postings of a frequent term never meet."""
    n = df.agg(F.count("*")).scalar()
    counts = materialize(term_counts(df, text, key), "postings")  # read twice, tokenised once
    vocab = document_frequency_filter(counts, n, min_df, max_df, max_features)
    idf = measured(vocab.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")
    raw = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    # a window over one document's distinct terms, which came from one row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


class TfidfModel:
    """Vocabulary fitted on one table, applied to any other."""

    def __init__(self, terms: Sequence[str], dfs: Sequence[int], n_docs: int):
        self.terms, self.dfs, self.n_docs = list(terms), list(dfs), n_docs

    @classmethod
    def fit(cls, df: DataFrame, text: str, key: str, min_df=0.005, max_df=0.99, max_features: int | None = None):
        """The driver holds the vocabulary. ``min_df`` bounds it: at most (mean
        distinct terms per text) / ``min_df`` terms can be that frequent."""
        n = df.count()
        vocab = document_frequency_filter(term_counts(df, text, key), n, min_df, max_df, max_features)
        rows = vocab.orderBy("term").collect()
        return cls([r["term"] for r in rows], [r["df"] for r in rows], n)

    def idf(self) -> list[float]:
        return [float(np.log((1 + self.n_docs) / (1 + d)) + 1) for d in self.dfs]

    def transform(self, df: DataFrame, text: str, out: str = "text_features") -> DataFrame:
        """Add an ML vector of normalised weights through CountVectorizer form."""
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        staged = df.withColumn("__tokens", tokenize(text))
        cv = CountVectorizerModel.from_vocabulary(self.terms, "__tokens", "__tf")
        scale = ElementwiseProduct(scalingVec=Vectors.dense(self.idf()), inputCol="__tf", outputCol="__w")
        unit = Normalizer(p=2.0, inputCol="__w", outputCol=out)
        return unit.transform(scale.transform(cv.transform(staged))).drop("__tokens", "__tf", "__w")

    def feature_names(self, prefix: str = "description") -> list[str]:
        return [f"{prefix}_{i}" for i in range(len(self.terms))]


Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(width: int = 64) -> Callable[[], Encoder]:
    """A model-free encoder: signed feature hashing of words, unit length."""
    import re
    import zlib

    def load() -> Encoder:
        word = re.compile(r"\w\w+")

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width), dtype=np.float32)
            for i, t in enumerate(texts):
                words = word.findall((t or "").lower())
                h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
                out[i] = np.bincount((h >> 1) % width, weights=2.0 * (h & 1) - 1.0, minlength=width)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1.0, norms)

        return encode

    return load


def embed(df: DataFrame, text: str, load: Callable[[], Encoder] | None = None, batch: int = 32, out: str = "embedding") -> DataFrame:
    """Add a vector per text. ``load`` builds the encoder once per task; texts
    reach it in batches, whole and in arrival order."""
    load = load or hashing_encoder()
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in frames:
            texts = pdf[text].tolist()
            parts = [encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            yield pdf.assign(**{out: list(vectors)})

    return df.mapInPandas(run, schema)
