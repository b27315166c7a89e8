"""Operator 11: spelling variants, by dynamic programming over sorted word lists."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm.common import Scratch, small_batches, table

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form must occur so many times as often as the word.
TIMES = 5
#: One run in so many, by checksum, loses a letter.
DAMAGED = 199
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 200_000
#: Words of a block beyond which it is split at the middle of its open part.
BLOCK = 20_000
#: In Latin-1, letters of runs: a to z and U+00C0 to U+00FF. Others separate; what Latin-1 lacks is read as "?".
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(doc_id: int | None, text: str | None) -> list[bytes]:
    """The runs of letters of a text that have at least LEAST_LETTERS, in Latin-1, A-Z in lower case; a run whose checksum
    with the id is a multiple of DAMAGED loses one letter (and is left out if it is too short then)."""
    found = (text or "").encode("latin-1", "replace").lower().translate(LETTERS).split()
    found = [w for w in found if len(w) >= LEAST_LETTERS]
    lead = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc = zlib.crc32
    sums = np.array([crc(w if w.isascii() else w.decode("latin-1").encode(), lead) for w in found], np.uint32)
    for k in np.nonzero(sums % DAMAGED == 0)[0].tolist():
        w, at = found[k], int(sums[k]) % len(found[k])
        found[k] = w[:at] + w[at + 1 :]
    return [w for w in found if len(w) >= LEAST_LETTERS]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all whole texts with at least LEAST_COUNT occurrences. Counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update(runs(doc_id, text))
                if len(held) > HELD_WORDS:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    def batch(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def blocks(words: DataFrame, scratch: Scratch, most: int = BLOCK) -> DataFrame:
    """(key, word, n, base, i, j): words that agree but for an open part meet under one key.

    Let a be the shorter of two near words (or one of two of equal length `base`), and c the number of letters with which
    both begin. They agree in the first c letters and in all after the edit at c. So for an open part [i, j) of a's places
    that holds c, they share the first i letters and the last base - j ones. At first there are two parts, the halves of the
    word; a word is in the blocks of its own length and of the one below. A block of over `most` words is split into those of
    both halves of its open part, until the part is one place, when the alphabet bounds it. No pair is lost by a split.
    """
    longest = F.length("word")
    bases = F.filter(F.array(longest, longest - 1), lambda b: b >= LEAST_LETTERS)
    parts = words.select("word", "n", F.explode(bases).alias("base")).withColumn("m", F.floor(F.col("base") / 2).cast("int"))
    parts = parts.select("word", "n", "base", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("m").alias("j")), F.struct(F.col("m").alias("i"), F.col("base").alias("j")))).alias("p"))
    parts = keyed(parts.select("word", "n", "base", "p.i", "p.j"))
    k = 0
    while True:
        large = parts.where(F.col("j") - F.col("i") > 1).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key")
        large = scratch.save(large, f"large{k}")
        if large.isEmpty():
            return parts
        m = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("i", m.alias("j")), F.struct(m.alias("i"), "j"))).alias("p")
        split = parts.join(large, "key", "left_semi").select("word", "n", "base", halves).select("word", "n", "base", "p.i", "p.j")
        parts = scratch.save(parts.join(large, "key", "left_anti").unionByName(keyed(split)), f"parts{k}")
        k += 1


def keyed(parts: DataFrame) -> DataFrame:
    begin = F.substr(F.col("word"), F.lit(1), F.col("i"))
    end = F.right(F.col("word"), F.col("base") - F.col("j"))
    return parts.withColumn("key", F.xxhash64("base", "i", "j", begin, end))


def row_steps() -> list[list[int]]:
    """Steps between rows of the edit matrix in a band of one on each side, all values of 2 or more being 2.

    A row is (x, y, z) for the query's first r-1, r, r+1 letters; as a number, 9x + 3y + z. Step s, bits: the row after s
    when the candidate's next letter equals the query's letter r-1 (bit 1), r (2), r+1 (4).
    """
    steps = []
    for s in range(27):
        x, y, z = s // 9, s // 3 % 3, s % 3
        row = []
        for bits in range(8):
            left = min(2, x + (not bits & 1), y + 1)
            mid = min(2, y + (not bits & 2), z + 1, left + 1)
            right = min(2, z + (not bits & 4), mid + 1)
            row.append(9 * left + 3 * mid + right)
        steps.append(row)
    return steps


STEPS = row_steps()
START, DEAD = 2 * 9 + 0 * 3 + 1, 2 * 9 + 2 * 3 + 2  # the row of no letters; the row over one edit whatever follows


def near_in_block(parts: list[str], base: int) -> list[tuple[int, int, int]]:
    """(a, b, common) for all pairs of one edit in a sorted list of distinct open parts of `base` or base + 1 letters, a of
    `base` letters; pairs of equal length in both orders; common: with how many letters both begin.

    For each query the list is scanned in order. Rows of the edit matrix up to the prefix that a candidate shares with the
    one before are reused. Once a row has no value under two, all candidates with that prefix are skipped.
    """
    n = len(parts)
    shared = [0] * n + [-1]
    for k in range(1, n):
        a, b = parts[k - 1], parts[k]
        most, c = min(len(a), len(b)), 0
        while c < most and a[c] == b[c]:
            c += 1
        shared[k] = c
    # the next place whose shared prefix is shorter: skips go along these
    shorter, stack = [n] * (n + 1), [n]
    for k in range(n - 1, -1, -1):
        while shared[stack[-1]] >= shared[k]:
            stack.pop()
        shorter[k] = stack[-1]
        stack.append(k)
    found, rows, steps = [], [START] * (base + 2), STEPS
    for q, query in enumerate(parts):
        if len(query) != base:
            continue
        # bits of row_steps() for each place and letter
        masks: list[dict[str, int]] = []
        for r in range(base + 1):
            m: dict[str, int] = {}
            for bit, at in ((1, r - 1), (2, r), (4, r + 1)):
                if 0 <= at < base:
                    m[query[at]] = m.get(query[at], 0) | bit
            masks.append(m)
        k = 0
        while k < n:
            word = parts[k]
            r = shared[k]
            s = rows[r]
            size = len(word)
            while r < size:
                s = steps[s][masks[r].get(word[r], 0)]
                if s == DEAD:
                    break
                r += 1
                rows[r] = s
            if r < size:  # all that share r + 1 letters with this one are out
                k += 1
                while shared[k] > r:
                    k = shorter[k]
                continue
            if (s // 3 % 3 if size == base else s // 9) == 1:
                common = 0
                while common < base and query[common] == word[common]:
                    common += 1
                found.append((q, k, common))
            k += 1
    return found


def neighbours(members: DataFrame) -> DataFrame:
    """(word, n_near, best: (less, form)): for each block of members, what near words a word has in it; less: -n of the form.
    Each pair counts in one block only, the one whose open part holds the place of its edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, tuple[int, int, str]] = {}

        def add(word: str, form: str, n: int) -> None:
            count, less, best = out.get(word, (0, 1, ""))
            out[word] = (count + 1, *min((less, best), (-n, form)))

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            block = list(group)
            if len(block) == 1:
                continue
            for (base, i, j), same in groupby(sorted(block, key=lambda r: (r[3:], r[1][: r[4]], r[1][len(r[1]) - r[3] + r[5] :])), key=lambda r: r[3:]):
                # two blocks of one key (a collision) stay apart: their outer parts differ
                for _, one in groupby(same, key=lambda r: (r[1][:i], r[1][len(r[1]) - base + j :])):
                    own = sorted((r[1][i : len(r[1]) - base + j], r[1], r[2]) for r in one)
                    for a, b, common in near_in_block([p for p, _, _ in own], j - i):
                        if common < j - i or j == base:
                            add(own[a][1], own[b][1], own[b][2])
                            if len(own[b][0]) > j - i:
                                add(own[b][1], own[a][1], own[a][2])
            if len(out) >= 50_000:
                yield batch(out)
                out = {}
        yield batch(out)

    def batch(out: dict[str, tuple[int, int, str]]) -> pa.RecordBatch:
        values = list(zip(*out.values(), strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), *(pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["word", "n_near", "less", "form"])

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("key", "word", "n", "base", "i", "j").repartition(tasks, "key").sortWithinPartitions("key")
    part = dealt.mapInArrow(run, "word string, n_near long, less long, form string")
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of all words of forms(word, form), by pointer doubling: a form is more frequent than its word by a factor,
    so chains are as long as the logarithm of the counts, and rounds as many as the logarithm of that."""
    at, k = scratch.save(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        onward = at.toDF("_word", "_root")
        moved = at.join(onward, at.root == onward._word, "left")
        at = scratch.save(moved.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), f"roots{k + 1}")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at, k = at.drop("moved"), k + 1


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the texts of docs with enough letters and occurrences.

    Near words differ by exactly one inserted, deleted or replaced letter. A word's form is its near word of largest n, ties
    to the first in code-point order, if that n is at least TIMES its own, else null; root follows forms to the last one.
    Null and empty texts have no words; a null doc_id counts as an empty one in the checksum; repeated rows count each.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.save(vocabulary(docs), "words")
    near = neighbours(blocks(words, scratch, block))
    most = -F.col("best.less")
    good = most >= TIMES * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, most).alias("form_n")
    )
    found = scratch.save(found, "found")
    ends = roots(found.where("form is not null"), scratch)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spelling_variants() of all rows of documents; see there for nulls, repeats and ties."""
    return spelling_variants(table(spark, sf_dir, "documents"))
