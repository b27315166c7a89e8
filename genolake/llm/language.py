"""Operator 1: languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from genolake.llm.common import bucket, free_name, small_batches, table, with_result
from genolake.llm.fitting import bounded_sample, fitted

BINS = 1 << 16
ORDERS = (2, 4)
DOCS_PER_LANGUAGE = 1500
#: EM ends when no share moves by more than this.
STILL = 1e-4
#: Log-likelihood that one more language must win: this times the log of the number of n-grams.
PENALTY = 4.0
LETTERS = re.compile(r"[^\W\d_]")
KEPT = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Bins of the byte n-grams (2 and 4) of the lower-cased letters; other ASCII signs separate words."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(KEPT).split()) + b" "
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, h = [], x * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in ORDERS:
            out.append((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def fit(rows: list[dict]) -> bytes:
    """log P(bin | language) with 0.5 added to each count."""
    languages = sorted({r["lang"] for r in rows})
    counts = np.full((len(languages), BINS), 0.5)
    for r in rows:
        counts[languages.index(r["lang"])] += np.bincount(grams(r["text"] or ""), minlength=BINS)
    table = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).T.copy()
    return pickle.dumps((languages, table))


def mixture(logp: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of n-grams (rows) under languages (columns)."""
    top = logp.max(1, keepdims=True)
    p = np.exp(logp - top)
    share, before = np.full(logp.shape[1], 1 / logp.shape[1]), np.zeros(logp.shape[1])
    while np.abs(share - before).max() > STILL:  # EM raises the likelihood each round, and shares converge
        weighted = p * share
        weighted /= weighted.sum(1, keepdims=True)
        share, before = weighted.mean(0), share
    return share, float(np.log(p @ share).sum() + top.sum())


def has_letter(text: str) -> bool:
    """Whether any character is of a Unicode letter category; the pattern also finds signs like ² that are none."""
    return any(m.group().isalpha() for m in LETTERS.finditer(text))


def certainty(x: np.ndarray) -> float:
    """0.5 to 1: how far the likeliest single language is ahead of the next, in units of the penalty."""
    if x.shape[1] < 2:
        return 1.0
    second, first = np.sort(x.sum(0, dtype=np.float64))[-2:]
    return float(1 / (1 + np.exp(-(first - second) / (PENALTY * math.log(len(x) + 1) * len(ORDERS)))))


def likelihoods(text: str | None, languages: list[str], logp: np.ndarray) -> np.ndarray | None:
    """Log-likelihoods of a text's n-grams (rows) under the languages; None without a letter or an n-gram."""
    if not text or not languages or not has_letter(text):
        return None
    x = logp[grams(text)]
    return x if len(x) else None


def proportions(text: str | None, languages: list[str], logp: np.ndarray) -> dict[str, float]:
    x = likelihoods(text, languages, logp)
    return {} if x is None else shares(x, languages)


def shares(x: np.ndarray, languages: list[str]) -> dict[str, float]:
    """Language shares of one text, over the set of languages with the best penalised likelihood; empty without letters.

    The set starts with the likeliest single language and takes in the next likeliest while that wins more than the
    penalty (a language whose slope at share 0 is too small for that is not tried). n-grams overlap, so their log-likelihood is scaled down by the number of orders.
    """
    penalty = PENALTY * math.log(len(x) + 1) * len(ORDERS)
    single = x.sum(0, dtype=np.float64)
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    while len(chosen) < len(languages):
        now = x[:, chosen[0]] if len(chosen) == 1 else np.log(np.exp(x[:, chosen]) @ share.astype(np.float32))
        with np.errstate(over="ignore"):
            slope = np.exp(x - now[:, None]).sum(0, dtype=np.float64) - len(x)
        slope[chosen] = -np.inf
        new = int(slope.argmax())
        if slope[new] <= penalty:  # the likelihood is concave in the shares: no share of any other language wins more
            break
        trial, value = mixture(x[:, [*chosen, new]].astype(np.float64))
        if value - best <= penalty:
            break
        chosen, share, best = [*chosen, new], trial, value
    return {languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def learn(docs: DataFrame, training: F.Column, most: int = DOCS_PER_LANGUAGE) -> bytes:
    """Fits on at most about `most` rows of each language among rows with `training` and a language."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fitted(bounded_sample(rows.select("doc_id", "text", "lang"), most, ["lang"]), fit)


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) of every row; `und` and score 0 if the text is null or has no letter.

    lang_pred has the largest share. The score is that share times the certainty that no other single language fits the
    text better; equal shares go to the last name in order. A null doc_id stays, a repeated row stays as often. Very long
    texts are read whole. With a model fitted on no row every text is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logp = pickle.loads(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            found, sure = [], []
            for t in texts:
                x = likelihoods(t, languages, logp)
                found.append({} if x is None else shares(x, languages))
                sure.append(0.0 if x is None else certainty(x))
            best = [max(f, key=lambda k: (f[k], k)) if f else "und" for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(best, pa.string()),
                    pa.array([f.get(k, 0.0) * c for f, k, c in zip(found, best, sure, strict=True)], pa.float64()),
                    pa.array([list(f) for f in found], pa.list_(pa.string())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    small_batches(docs.sparkSession)
    schema = "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: bytes, least_share: float = 0.4) -> DataFrame:
    """The rows of docs whose main language has a share of at least least_share; texts without a letter go.

    A null lang is filled with the language found; all other columns stay as they are. Repeated rows stay.
    """
    name = free_name(docs, "language_found")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        languages, logp = pickle.loads(shared.value)

        def main(text: str | None) -> str | None:
            found = proportions(text, languages, logp)
            best = max(found, key=lambda k: (found[k], k), default=None)
            return best if best is not None and found[best] >= least_share else None

        return lambda texts: pa.array(list(map(main, texts)), pa.string())

    kept = with_result(docs, name, StringType(), make).where(F.col(name).isNotNull())
    return kept.withColumn("lang", F.coalesce("lang", name)).drop(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares) of every row of documents, learnt from those whose
    crc32(doc_id as text) mod 3 is not 1. A row with a null doc_id is neither learnt from nor held out. The defined results for nulls, empties, ties, repeats are those of identify()."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, bucket("doc_id", 3) != 1)
    return identify(docs, model).select(
        "doc_id", F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score",
        F.array_join("languages", ",").alias("languages"), F.array_join(F.transform("shares", lambda x: F.round(x, 6).cast("string")), ",").alias("shares"),
    )
