"""Exact duplicates, importance resampling and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.llm import exact, resampling, variants
from genolake.llm.queries import QUERIES

rnd = random.Random(5)
SYLLABLES = ["the", "ing", "and", "ré", "on", "th", "ÿa", "be", "ti"]
COLUMNS = "doc_id long, text string, row long, score string, h int, word string, t int, weight int, key string"


def prose(n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def rows_of_texts():
    rows = [(i, prose(rnd.randint(5, 80))) for i in range(150)]
    rows += [(200 + i, "One  Text\tof\x0bmany copies\n" if i % 2 else "One Text of many copies ") for i in range(300)]
    rows += [(600, None), (601, ""), (602, " \n\t "), (603, "İstanbul ﬁne ×÷ ÀÉ abcdefÿ"), (604, "\0\0 a\0b"), (605, "x" * 3000), (606, "ab" * 200_000), (None, prose(30)), (None, None)]
    return rows + [rows[3], rows[3], (1000, rows[3][1]), (-5, rows[7][1])]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """(folder, rows of documents, texts of benchmark)"""
    rows, target = rows_of_texts(), [prose(40) for _ in range(5)] + [None, "", "The ING words, 12 34 and é"]
    d = str(tmp_path_factory.mktemp("sets"))
    spark.createDataFrame([(*r, 1, "a", 2, "b", 3, 4, "c") for r in rows], COLUMNS).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, target


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def plain_exact(rows):
    texts = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, texts, strict=True):
        groups.setdefault(t, []).append(i)
    out, stays = [], set()
    for (i, _), t in zip(rows, texts, strict=True):
        keep = min((x for x in groups[t] if x is not None), default=None)
        kept = i == keep and t not in stays
        if kept:
            stays.add(t)
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=key)


def test_exact_duplicates(spark, table):
    got = QUERIES["op12_exact_dedup"](spark, table[0])
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == plain_exact(table[1])


def test_colliding_hashes_do_not_join_texts(spark, table):
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    got = exact.exact_duplicates(docs, lambda t: F.substring(t, 1, 1))
    assert sorted(map(tuple, got.collect()), key=key) == plain_exact(table[1])


def test_one_row_of_each_text_stays_with_its_columns(spark, table):
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    got = exact.without_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((r[0] for r in plain_exact(table[1]) if r[3]), key=str)


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_resampling(rows, target):
    where = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(where, features(x)[1]))
    for x in target:
        t.update(map(where, features(x)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        words, found = features(x)
        weight = sum(gain[where(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {}
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        rank.setdefault(r[:4], []).append(k + 1)
    return sorted(((*r[:4], rank[r[:4]].pop(0) if r[4] >= 20 and rank.get(r[:4]) else None) for r in out), key=key)


def test_resampling(spark, table):
    got = QUERIES["op13_resampling"](spark, table[0])
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=key) == plain_resampling(*table[1:])


@pytest.mark.parametrize("low, high", [(-1, 0), (0, 0), (-13_000, 9_000), (-(1 << 20), 1 << 20)])
def test_bit_planes_sum_exactly(low, high):
    draw = np.random.default_rng(3)
    gains = draw.integers(low, high, resampling.BUCKETS, endpoint=True).tolist()
    of = resampling.Gains(gains)
    for n in (1, 7, 1000, 300_000):
        found = draw.integers(0, resampling.BUCKETS, n) if n < 300_000 else np.repeat([3, 9999, 0], [299_000, 600, 400])
        assert of.total(found) == sum(gains[b] for b in found)


def plain_variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {a: min(b, key=lambda x: (-n[x], x)) for a, b in near.items() if b}
    form = {a: b for a, b in form.items() if n[b] >= 5 * n[a]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    c = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[c + (len(a) == len(b)) :] == b[c + 1 :]


@pytest.fixture(scope="module")
def spelled(spark, tmp_path_factory):
    """Words in chains of near ones with rising counts, and long, repeated and accented ones."""
    texts, at = [], 0
    for base, times in (("abcdef", 130), ("abcdeg", 25), ("abcdegh", 5), ("abcdeghh", 5), ("éabcdef", 30), ("aaaaaa", 40), ("aaaaaaa", 8), ("aaaaaaaa", 7), ("abcdefabcdef" * 900, 6), ("abcdefabcdef" * 899 + "abcdeabcdef", 6), ("xbcdef", 5), ("ÿÿÿÿÿÿ", 30), ("ÿÿÿÿÿÿÀ", 5), ("ghijkl", 25), ("ghijkm", 25), ("ghijkn", 5)):
        texts += [(10 * (at := at + 1), f"{base} 1 {base.upper() if k % 7 == 3 and base.isascii() else base}") for k in range(times // 2)] + [(at * 10 + 1, base)] * (times % 2)
    texts += [(i, t) for i, t in rows_of_texts()]
    d = str(tmp_path_factory.mktemp("spelled"))
    spark.createDataFrame([(*r, 1, "a", 2, "b", 3, 4, "c") for r in texts], COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d, texts


def test_variants(spark, spelled):
    got = QUERIES["op11_variants"](spark, spelled[0])
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(spelled[1])
    assert any(r[2] != r[1] and r[1] for r in want) and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("most", [1, 4])
def test_large_blocks_are_split_without_loss(spark, spelled, most):
    docs = spark.read.parquet(f"{spelled[0]}/documents.parquet")
    assert sorted(map(tuple, variants.spelling_variants(docs, most).collect())) == plain_variants(spelled[1])


def test_near_words_of_a_sorted_list():
    draw = random.Random(9)
    for base in (1, 2, 4):
        parts = sorted({"".join(draw.choice("abc") for _ in range(base + draw.randint(0, 1))) for _ in range(40)})
        got = sorted((parts[a], parts[b]) for a, b, _ in variants.near_in_block(parts, base))
        assert got == sorted((a, b) for a in parts for b in parts if len(a) == base and one_edit(a, b))


def test_empty_tables(spark, table, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{table[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op11_variants", "op12_exact_dedup", "op13_resampling"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0
