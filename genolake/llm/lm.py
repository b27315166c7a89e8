"""Operator 2: text probabilities by online logistic context mixing over hashed-context bit predictors.

What the corpus teaches lies in three places. Counts of all words: a table that grows with the corpus and is joined to the
words of the texts. Runs: what follows an anchor, a place told by the bytes before it; a growing table again, grouped and
joined by the anchors' hashes, so a passage that occurs elsewhere is told word by word. Counters of bits in contexts: tables
whose size follows the corpus up to a bound, so that they may travel to every task. mixing.py holds the model itself.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm import mixing
from genolake.llm.common import Scratch, bucket, small_batches, table
from genolake.llm.mixing import Coder, Model, Tokens

#: At most so many of the most frequent words have paths of their own. All other words share an escape: behind it a word is
#: told by its count, if it was seen elsewhere, or spelled.
HEAD_WORDS = 1 << 18
TABLE_BITS = (12, 21)
BATCH_ROWS, BATCH_BYTES = 1500, "4m"
#: Word counts of so many entries are put together before they leave a task.
MERGED = 1_500_000
PART = 1 << 16
#: Runs seen more than once that a task counts before it sends them on.
HELD_RUNS = 4_000

_made: dict[str, object] = {}


def once(key: str, make: Callable):
    """One object for each key `run-part` and Python worker; those of another run go first, so a worker never holds two models."""
    if key not in _made:
        for other in [k for k in _made if k.rpartition("-")[0] != key.rpartition("-")[0]]:
            del _made[other]
        _made[key] = make()
    return _made[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows' tokens without the end token; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _made.clear()  # of a run before
        parts, size = [], 0
        for b in batches:
            t = Tokens(b.column(0))
            n = np.bincount(t.codes, minlength=len(t.names))
            used = np.flatnonzero(n)
            parts.append(pa.table({"word": t.keys().take(pa.array(used)), "n": pa.array(n[used], pa.int64())}))
            size += len(used)
            if size > MERGED:
                parts = [summed(parts)]
                if (size := len(parts[0])) > MERGED // 2:
                    yield from parts[0].to_batches()
                    parts, size = [], 0
        if parts:
            yield from summed(parts).to_batches()

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD_WORDS) -> list:
    """The words with the highest counts, `most` of them at the most and none that was seen once, most frequent first.

    Where to cut is read off a histogram of the counts' logarithms (a few thousand numbers), so nothing is sorted.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    bins = counts.where("n > 1").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a few thousand at any size
    least, size = None, 0
    for r in bins:
        if size + r["count"] > most:
            break
        least, size = r["level"], size + r["count"]
    if least is None:
        return []
    return sorted(counts.where((F.col("n") > 1) & (level >= least)).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def bit_counts(docs: DataFrame, coder: Callable[[], Coder], table_bits: int, scratch: Scratch) -> np.ndarray:
    """How often each bit was seen at each counter, over all rows.

    Each task fills tables of a bounded size; their parts are then added up by part number, as a stream, so no task ever
    holds more than the parts it adds.
    """
    size = mixing.counters(table_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sums = coder(), np.zeros(size, np.int32)
        for b in batches:
            mixing.count_into(sums, c, Tokens(b.column(0)))
        for k in range(0, size, PART):
            if (part := sums[k : k + PART]).any():  # bytes of one weight side by side, which compress well
                data = np.ascontiguousarray(part.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k // PART], pa.int32()), pa.array([zlib.compress(data, 1)], pa.binary())], ["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], ["part", "data"])

    counted = docs.select("text").mapInArrow(count, "part int, data binary")
    added = scratch.save(counted.repartition(32, "part").mapInArrow(add, "part int, data binary"), "bits")
    out = np.zeros(size, np.float32)  # exact to 2^24, and to 7 digits beyond
    for r in added.toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(r["data"])), "<i8")
        out[r["part"] * PART : r["part"] * PART + len(part)] = part
    return out


def runs_of(docs: DataFrame) -> DataFrame:
    """(key, run, n, total): for each anchor's hash the most frequent run after it (of equally frequent ones the last in
    order), how often it and how often any run was seen. One shuffle by key; what a batch has more than once is counted over
    the whole task before it, so an anchor of every document sends a row or so a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, bytes]] = Counter()
        for b in batches:
            t = Tokens(b.column(0))
            _, key, begin, end = t.anchors()
            seen = Counter(zip(key.tolist(), mixing.slices(t.data, begin, end).to_pylist(), strict=True))
            held.update({k: n for k, n in seen.items() if n > 1 or k in held})
            yield batch({k: n for k, n in seen.items() if k not in held})
            if len(held) > HELD_RUNS:
                yield batch(held)
                held = Counter()
        yield batch(held)

    def batch(seen: dict[tuple[int, bytes], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.int64()), pa.array([r for _, r in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["key", "run", "n"]
        )

    found = docs.select("text").mapInArrow(run, "key long, run binary, n long").repartition("key")
    found = found.groupBy("key", "run").agg(F.sum("n").alias("n"))
    best = found.groupBy("key").agg(F.max(F.struct("n", "run")).alias("best"), F.sum("n").alias("total"))
    return best.select("key", "best.run", "best.n", "total")


def told_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(row, runs): for each text the runs after its anchors that any other text shows. Most anchors occur once, so few rows
    come of the join; a very frequent anchor has one row in runs, and adaptive execution splits its other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Tokens(b.column(0))
            w, key, _, _ = t.anchors()
            lane = t.lane[w]
            counted = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            both, first, n = np.unique(np.stack([lane, key]), axis=1, return_index=True, return_counts=True) if len(w) else (None, np.zeros(0, int), np.zeros(0, int))
            at = lane[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first], pa.int64()), b.column(1).take(pa.array(at)), pa.array(np.where(counted[at], n, 0).astype(np.int64))], ["key", "row", "own"]
            )

    wanted = rows.select("text", "row", "training").mapInArrow(run, "key long, row long, own long")
    found = wanted.join(runs, "key").where("total > own").select("row", F.struct("key", "run", "n", "total").alias("told"))
    return found.groupBy("row").agg(F.collect_set("told").alias("runs"))


def run_arrays(column: pa.Array) -> dict[str, np.ndarray]:
    """The runs of a batch, each anchor's once, in the order of their hashes."""
    flat = column.flatten()
    key, n, total = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2, 3))
    key, first = np.unique(key, return_index=True)
    run = flat.field(1).take(pa.array(first))
    if not len(key):
        none = np.zeros(0, np.int64)
        return {"key": none, "begin": none, "end": none, "n": none, "total": none, "data": np.zeros(0, np.uint8)}
    run = pa.concat_arrays([run])
    edges = np.frombuffer(run.buffers()[1], np.int32)[run.offset : run.offset + len(run) + 1].astype(np.int64)
    return {"key": key, "begin": edges[:-1], "end": edges[1:], "n": n[first], "total": total[first], "data": np.frombuffer(run.buffers()[2] or b"", np.uint8)}


def scored(rows: DataFrame, coder: Callable[[], Coder], model: Callable[[], Model], log_of: Callable, n_docs: int) -> DataFrame:
    """For each row its counts, its score without what rare words leave open, and its rare words: how often each occurs, how
    often no run told it, and its log-probability when spelled (the mean of those times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        base_of, end_score = log_of(m.coder.weights[: m.coder.end].astype(float)), float(log_of(n_docs))
        for b in batches:
            tokens, own = Tokens(b.column(1)), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            found = m.score(tokens, own, run_arrays(b.column(3)))
            ids, _ = m.coder.symbols(tokens)
            head, n = ids != m.coder.escape, len(own)
            base = np.bincount(tokens.lane[head], base_of[ids[head]], n) + end_score
            pair, at, times = np.unique(found["lane"] * np.int64(len(tokens.names) + 1) + found["code"], return_inverse=True, return_counts=True)
            missed = np.bincount(at, ~found["spared"], len(pair))
            cost = np.bincount(at, found["spelled"] * ~found["spared"], len(pair)) / np.maximum(missed, 1)
            lane, code = np.divmod(pair, len(tokens.names) + 1)
            edges = pa.array(np.searchsorted(lane, np.arange(n + 1)).astype(np.int32))
            lists = [tokens.keys().take(pa.array(code)), pa.array(times.astype(np.int32)), pa.array(missed.astype(np.int32)), pa.array(cost.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), pa.array(tokens.sizes + 1), pa.array(np.bincount(tokens.lane[head], minlength=n) + (n_docs > 0)), pa.array(base),
                    pa.array(found["total"] / math.log(10)), b.column(4), *(pa.ListArray.from_arrays(edges, x) for x in lists),
                ],
                ["doc_id", "training", "n_tokens", "known", "base", "score", "n_bytes", "words", "times", "missed", "cost"],
            )

    schema = "doc_id long, training boolean, n_tokens long, known long, base double, score double, n_bytes long, words array<binary>, times array<int>, missed array<int>, cost array<float>"
    return rows.select("doc_id", "text", "training", "runs", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, schema)


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Learns from all rows with `training`. Rows that were learnt from are scored without their own share in the counts, so both
    kinds of rows compare: each event's own count, its own runs and its rare words' own occurrences are taken out.
    A null text counts as empty: its end alone is scored. Repeated rows and null ids stay, each with its score; equal texts
    of one kind get equal scores. Very long texts are scored whole. Without any training row all words are unknown, and the
    base score is 0 by its formula.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    scratch, name = Scratch(spark, "lm"), uuid.uuid4().hex
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))  # the same in every scan; rows that share it have equal texts
    learned = rows.where("training")
    counts = scratch.save(word_counts(learned), "words")
    n_docs = learned.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("n") == 1, 1)), F.lit(0))).first()
    n, v = sums[0] + n_docs, sums[1] + (n_docs > 0)
    head = head_words(counts)
    words, of_word = [bytes(r["word"]) for r in head], np.array([r["n"] for r in head], np.int64)
    tail = int(sums[0] - of_word.sum())
    seen = tail - sums[2]  # tokens of rare words that were seen at least twice
    table_bits = min(TABLE_BITS[1], max(TABLE_BITS[0], n.bit_length() - 2))
    shared = spark.sparkContext.broadcast((words, of_word))

    def coder() -> Coder:
        return once(f"{name}-coder", lambda: Coder(*shared.value, n_docs, tail, table_bits))

    tables = spark.sparkContext.broadcast(bit_counts(learned, coder, table_bits, scratch))

    def model() -> Model:
        return once(f"{name}-model", lambda: Model(coder(), tables.value))

    def log_of(c):
        return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    told = told_runs(rows, runs_of(learned))
    done = scored(rows.join(told, "row", "left"), coder, model, log_of, n_docs)
    done = scratch.save(done.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = done.select("row", "training", F.explode(F.arrays_zip("words", "times", "missed", "cost")).alias("x"))
    rare = rare.select("row", "training", F.col("x.words").alias("word"), "x.times", "x.missed", "x.cost").join(counts, "word", "left")
    count = F.coalesce("n", F.lit(0))
    others = F.greatest(count - F.when(F.col("training"), F.col("times")).otherwise(0), F.lit(0))
    share = (seen / tail) * others / max(1, seen) if tail else F.lit(0.0)
    spelled = F.lit(1 - seen / tail if tail else 1.0) * F.exp("cost")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((count + 0.1) / (n + 0.1 * (v + 1)))).alias("rare_base"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("missed") * F.log10(F.greatest(share + spelled, F.lit(1e-300)))).alias("rare_score"),
    )
    joined = done.drop("words", "times", "missed", "cost").join(rare, "row", "left")
    whole = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return joined.select(
        "doc_id", "training", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), whole.alias("score"),
        (-whole * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of documents, learnt
    from those whose crc32(doc_id as text) mod 10 is not 0. A row with a null doc_id is neither learnt from nor held out. Nulls,
    empties, repeats and long texts: see score()."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, bucket("doc_id", 10) != 0)
    held = F.coalesce(bucket("doc_id", 10) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
