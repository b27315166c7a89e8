"""Operator 8: toxic spans by a linear-chain conditional random field, aggregated to document scores."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm.common import bucket, small_batches, table, text_chunks
from genolake.llm.fitting import bounded_sample, fitted

BINS = 1 << 18
BLOCK = 64
DOCS_PER_LABEL = 2400
STEPS = (30, 15)
RIDGE = 3e-5
THRESHOLD = 0.3
SPAN_AT = 0.5
CACHED_WORDS = 300_000
CHUNK_LETTERS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Bins of a lower-case word: itself, its beginnings of 4 and 5 letters, its length."""
    named = [f"l{min(len(word), 12)}", *parts(word)]
    return [zlib.crc32(f.encode("utf-8", "replace")) % BINS for f in named]


def chain(odds: np.ndarray, starts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probability of tag 1 for each token of several chains, by the forward-backward algorithm.

    odds: exp(score) of tag 1 against tag 0, for the tokens of all chains; starts: first token of each chain, then the
    end; step[i, j]: potential of going from tag i to j. Every chain begins after a clean token. Chains are cut into
    blocks of 64 tokens. Transfer matrices of all blocks are multiplied side by side, messages then pass from block to
    block, and last through all blocks side by side; this gives the same as one pass from end to end. Also returns the
    expected number of each transition.
    """
    sizes = np.diff(starts)
    blocks = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    chain_of = np.repeat(np.arange(len(sizes)), blocks)
    begin = starts[:-1][chain_of] + BLOCK * (np.arange(len(chain_of)) - first[chain_of])
    at = begin[:, None] + np.arange(BLOCK)
    real = at < starts[1:][chain_of][:, None]
    w = np.where(real, odds[np.minimum(at, len(odds) - 1)], 1.0)
    n = len(begin)
    whole = np.tile(np.eye(2), (n, 1, 1))
    for k in range(BLOCK):
        new = whole @ step
        new[:, :, 1] *= w[:, k, None]
        new /= new.sum((1, 2), keepdims=True)
        whole = np.where(real[:, k, None, None], new, whole)
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    order = np.argsort(-blocks, kind="stable")
    counts = np.searchsorted(-blocks[order], -np.arange(1, blocks.max(initial=0) + 1), side="right")
    v = np.tile([1.0, 0.0], (len(sizes), 1))
    for k, m in enumerate(counts):
        b = first[order[:m]] + k
        ahead[b] = v[order[:m]]
        v[order[:m]] = (v[order[:m], None, :] @ whole[b])[:, 0]
        v[order[:m]] /= v[order[:m]].sum(1, keepdims=True)
    u = np.ones((len(sizes), 2))
    for k in range(len(counts) - 1, -1, -1):
        own = order[: counts[k]]
        b = first[own] + k
        back[b] = u[own]
        u[own] = (whole[b] @ u[own][:, :, None])[:, :, 0]
        u[own] /= u[own].sum(1, keepdims=True)
    alphas = np.empty((n, BLOCK + 1, 2))
    alphas[:, 0] = ahead
    for k in range(BLOCK):
        a = alphas[:, k] @ step
        a[:, 1] *= w[:, k]
        a /= a.sum(1, keepdims=True)
        alphas[:, k + 1] = np.where(real[:, k, None], a, alphas[:, k])
    p, moves, beta = np.zeros((n, BLOCK)), np.zeros((2, 2)), back
    for k in range(BLOCK - 1, -1, -1):
        both = alphas[:, k + 1] * beta
        p[:, k] = both[:, 1] / both.sum(1)
        after = beta.copy()
        after[:, 1] *= w[:, k]
        pair = alphas[:, k, :, None] * step * after[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        moves += pair[real[:, k]].sum(0)
        new = after @ step.T
        new /= new.sum(1, keepdims=True)
        beta = np.where(real[:, k, None], new, beta)
    return p[real], moves


def parts(word: str) -> list[str]:
    return [f"w{word}", *(f"p{word[:k]}" for k in (4, 5) if len(word) >= k)]


def telling_words(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Word parts that mark toxic documents: whole words and beginnings of 4 or 5 letters, at least 30 times likelier
    there than in other documents (half a document added to each count). A part counts no more toxic documents than
    there are different words before it, or after it, in them, so that copies of one text don't make its rare words telling."""
    follows: dict[str, set[str]] = {}
    leads: dict[str, set[str]] = {}
    there: Counter = Counter()
    elsewhere: Counter = Counter()
    for words, t in zip(texts, toxic, strict=True):
        if t:
            for before, word in zip(["", *words], words, strict=False):
                for p in parts(word):
                    follows.setdefault(p, set()).add(before)
            for word, after in zip(words, [*words[1:], ""], strict=True):
                for p in parts(word):
                    leads.setdefault(p, set()).add(after)
        (there if t else elsewhere).update({p for w in set(words) for p in parts(w)})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    seen = {p: min(there[p], len(f), len(leads[p])) for p, f in follows.items()}
    return {p for p, c in seen.items() if c >= 4 and (c + 0.5) / n1 >= 30 * (elsewhere[p] + 0.5) / n0}


def aggregates(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document: log of 1 + expected toxic tokens, and the largest marginal."""
    sizes, total = np.diff(starts), np.concatenate(([0.0], np.cumsum(p)))
    most = np.zeros(len(sizes))
    if len(p):
        most[sizes > 0] = np.maximum.reduceat(p, starts[:-1][sizes > 0])
    return np.stack([np.log1p(np.maximum(0, total[starts[1:]] - total[starts[:-1]])), most], 1)


def fit(rows: list[dict]) -> bytes:
    """Token labels, then the field's weights, then the map from marginals to a document's score.

    Labels are given for documents only. A token is labelled toxic if its document is and a telling word part is in it.
    The field's weights maximise the conditional likelihood of these labels (gradient from the marginals, Adam), on the
    blocks that hold a toxic token and three times as many others, then also on the clean ones that look worst. The last step is a logistic regression of documents' labels on
    their aggregated marginals.
    """
    toxic = np.array([bool(r["toxic"]) for r in rows], bool)
    words = [[m.lower() for m in WORD.findall(r["text"] or "")] for r in rows]
    if toxic.all() or not toxic.any():
        return pickle.dumps((np.full(BINS, -1e-3, np.float32), np.ones((2, 2)), np.array([0.0, 0.0, 8.0 if toxic.any() else -8.0])))
    marks = telling_words(words, toxic)
    names: dict[str, int] = {}
    bad: list[bool] = []
    made: list[list[int]] = []
    for own in words:
        for w in own:
            if w not in names:
                names[w] = len(names)
                made.append(features(w))
                bad.append(not marks.isdisjoint(parts(w)))
    sizes = np.array([len(f) for f in made], int)
    of, flat = np.repeat(np.arange(len(made)), sizes), np.concatenate([np.array(f, int) for f in made]) if made else np.zeros(0, int)
    ids = [np.array([names[w] for w in own], int) for own in words]
    is_bad = np.array(bad, bool)
    pieces = [(x[k : k + BLOCK], t) for x, t in zip(ids, toxic, strict=True) for k in range(0, len(x), BLOCK)]
    with_bad = [(x, is_bad[x]) for x, t in pieces if t and is_bad[x].any()]
    clean = [(x, np.zeros(len(x), bool)) for x, t in pieces if not t]
    w, t = np.zeros(BINS), np.zeros((2, 2))
    used = [*with_bad, *clean[:: max(1, len(clean) // (3 * len(with_bad) + 200))]]
    for steps in STEPS:
        token, y = np.concatenate([x for x, _ in used]), np.concatenate([z for _, z in used])
        starts = np.concatenate(([0], np.cumsum([len(x) for x, _ in used])))
        before = np.concatenate(([False], y[:-1]))
        before[starts[:-1]] = False
        seen_moves = np.array([[np.sum((before == i) & (y == j)) for j in (False, True)] for i in (False, True)], float)
        moments = [(np.zeros_like(q), np.zeros_like(q)) for q in (w, t)]
        for step in range(1, steps + 1):
            score = np.bincount(of, w[flat], len(made))
            p, moves = chain(np.exp(np.clip(score[token], -30, 30)), starts, np.exp(t))
            per_word = np.bincount(token, y - p, len(made))
            grads = [np.bincount(flat, per_word[of], BINS) / len(y) * 50 - RIDGE * w, (seen_moves - moves) / len(y) * 50]
            for q, g, (m, v) in zip((w, t), grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                q += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        if clean:  # next, the clean blocks that look worst take part as well
            score = np.exp(np.clip(np.bincount(of, w[flat], len(made)), -30, 30))
            starts = np.concatenate(([0], np.cumsum([len(x) for x, _ in clean])))
            worst = aggregates(chain(score[np.concatenate([x for x, _ in clean])], starts, np.exp(t))[0], starts)[:, 1]
            used += [c for c, p in zip(clean, worst, strict=True) if p > 0.02]
    score = np.bincount(of, w[flat], len(made))
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    p, _ = chain(np.exp(np.clip(score[np.concatenate(ids)], -30, 30)), starts, np.exp(t))
    x = np.hstack([aggregates(p, starts), np.ones((len(rows), 1))])
    c = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (toxic - q) - 0.5 * c)
    return pickle.dumps((w.astype(np.float32), np.exp(t), c))


class Tagger:
    def __init__(self, model: bytes):
        self.w, self.step, self.c = pickle.loads(model)
        self.odds: dict[str, float] = {}

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals of all tokens, start of each text's tokens, scores)."""
        if len(self.odds) > CACHED_WORDS:
            self.odds = {}
        found = [WORD.findall(t.lower()) for t in texts]
        new = [w for w in {w for own in found for w in own} if w not in self.odds]
        if new:
            made = [features(w) for w in new]
            score = np.add.reduceat(self.w[np.concatenate([np.array(f, int) for f in made])], np.cumsum([0, *(len(f) for f in made[:-1])]))
            self.odds.update(zip(new, np.exp(np.clip(score, -30, 30)).tolist(), strict=True))
        starts = np.concatenate(([0], np.cumsum([len(own) for own in found]))).astype(int)
        odds = np.fromiter((self.odds[w] for own in found for w in own), float, starts[-1])
        p, _ = chain(odds, starts, self.step) if len(odds) else (np.zeros(0), None)
        x = np.hstack([aggregates(p, starts), np.ones((len(texts), 1))])
        return p, starts, 1 / (1 + np.exp(-np.clip(x @ self.c, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, most: int = DOCS_PER_LABEL) -> bytes:
    """Fits on at most about `most` documents of each label; labels: (doc_id, toxic), null labels left out. A document with
    both labels counts as toxic."""
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fitted(bounded_sample(docs.select("doc_id", "text").join(marked, "doc_id"), most, ["toxic"]), fit)


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal of at least 0.5, as character ranges [begin, end) of the text as it is."""
    out: list[dict] = []
    joined, low = False, text.lower()
    place = list(range(len(low) + 1)) if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
    for m, bad in zip(WORD.finditer(low), (p >= SPAN_AT).tolist(), strict=True):
        end = place[m.end() - 1] + 1
        if bad and joined:
            out[-1]["end"] = end
        elif bad:
            out.append({"begin": place[m.start()], "end": end})
        joined = bad
    return out


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score, spans) of every row: the probability of being toxic, and the text's offending character ranges.

    Null and empty texts have no token and get the score of documents without any toxic sign. Equal texts get equal
    scores, repeated rows and null ids stay. Texts are tagged whole, about a million letters of them at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            whole = [t or "" for t in b.column(1).to_pylist()]
            for begin, end in text_chunks(whole, CHUNK_LETTERS):
                texts = whole[begin:end]
                p, starts, s = tagger.tag(texts)
                worst = aggregates(p, starts)[:, 1]
                found = [spans(t, p[i:j]) if m >= SPAN_AT else [] for t, i, j, m in zip(texts, starts[:-1], starts[1:], worst, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), pa.array(s, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "spans"])

    small_batches(docs.sparkSession)
    schema = "doc_id long, score double, spans array<struct<begin:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of documents; rows whose crc32(doc_id as text) mod 4 is 2 are
    held out; one with a null doc_id is neither learnt from nor held out. The defined results for nulls, empties, repeats and long texts are those of score()."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs.where(bucket("doc_id", 4) != 2), labels)
    return score(docs, model).select(
        "doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
