"""The ten operators against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from genolake.llm import bpe, fitting, language, lm, mixing, packing, pii, piecewise, quality, simhash, toxicity, vectors
from genolake.llm.common import Scratch, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, language_found string, grade_tail string"
rnd = random.Random(3)
SYLLABLES = {"en": ["the", "ing", "and", "er", "on", "th"], "fr": ["eau", "le", "que", "é", "ou", "ch"], "de": ["sch", "ung", "ver", "ü", "keit", "ein"]}


def words(lang: str, n: int) -> str:
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


TEXTS = [words(lang, rnd.randint(5, 80)) for lang in ("en", "fr", "de") for _ in range(25)]
TEXTS += [None, "", "   ", "12 34", "x", TEXTS[0], TEXTS[0], words("en", 6000), "a" * 20000, "<|endoftext|> mixed Çà 漢字 😀"]


def docs(spark, texts=TEXTS, repeat=1):
    langs = ["en"] * 25 + ["fr"] * 25 + ["de"] * 25
    rows = [(i, t, langs[i] if i < 75 else None, "s", len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)] * repeat
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_language(spark):
    d = docs(spark)
    model = language.learn(d, (d.doc_id % 3) != 1)
    out = {r.doc_id: r for r in language.identify(d, model).collect()}
    assert len(out) == len(TEXTS)
    right = sum(out[i].lang_pred == lang for lang, at in (("en", 0), ("fr", 25), ("de", 50)) for i in range(at, at + 25))
    assert right >= 74
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (75, 76, 77, 78))
    two = language.proportions(words("fr", 300) + " " + words("de", 300), *language.pickle.loads(model))
    assert set(two) == {"fr", "de"} and abs(two["fr"] - 0.5) < 0.2
    kept = language.accepted(docs(spark, repeat=2), model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()}.isdisjoint({75, 76, 77, 78})
    assert language.accepted(d.limit(0), language.learn(d.limit(0), d.doc_id > 0)).count() == 0


def test_language_mixture_matches_plain_em():
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(3), 200))
    share = np.ones(3) / 3
    for _ in range(500):
        share = np.mean([np.exp(r) * share / (np.exp(r) @ share) for r in logp], 0)
    assert np.allclose(language.mixture(logp)[0], share, atol=5e-3)


def test_letters_are_unicode_letters():
    assert not any(map(language.has_letter, ("²", "½", "Ⅷ", "①", "12 _ 3", "")))
    assert all(map(language.has_letter, ("1a", "² ñ", "漢")))


def test_samples_are_bounded_at_any_count():
    for most, n in ((1500, 10), (1500, 1500), (1500, 10**6), (1500, 2 * 10**9), (1500, 10**10), (1500, 10**14)):
        share = fitting.below(most, n) / fitting.DRAWS
        assert share > 0 and abs(share - min(1, most / n)) <= 1e-6 * share


def test_fitting_takes_no_more_than_its_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "doc_id long, text string").repartition(7)
    fit = lambda rows: ",".join(str(r["doc_id"]) for r in rows).encode()
    some = fitting.fitted(rows, fit, 10_000).decode().split(",")
    assert len(some) == 11 and some == fitting.fitted(rows.repartition(3), fit, 10_000).decode().split(",")
    assert len(fitting.fitted(rows, fit).decode().split(",")) == 50 and fitting.fitted(rows.limit(0), fit) == b""


def test_lm_base_is_exact_and_scores_are_log_probabilities(spark):
    d = docs(spark)
    out = {r.doc_id: r for r in lm.score(d, (d.doc_id % 10) != 0).collect()}
    train = [lm_words(TEXTS[i]) for i in range(len(TEXTS)) if i % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in enumerate(TEXTS):
        own = lm_words(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert out[i].n_tokens == len(own) + 1 and out[i].train_tokens == n
        assert out[i].n_known == sum(c[w] > 0 for w in own) + 1
        assert abs(out[i].base_score - base) < 1e-6 * max(1, abs(base)) and out[i].score < 0
    assert lm.score(d.limit(0), d.doc_id > 0).count() == 0
    none = lm.score(d, d.doc_id < 0).collect()
    assert len(none) == len(TEXTS) and all(r.base_score == pytest.approx(0) or r.n_tokens for r in none)


def small_model(texts, head=40):
    tokens = mixing.Tokens(pa.array([t.encode() for t in texts], pa.binary()))
    seen = Counter(w for t in texts for w in lm_words(t))
    top = [(w, n) for w, n in seen.most_common(head) if n > 1]
    coder = mixing.Coder([w for w, _ in top], np.array([n for _, n in top], np.int64), len(texts), sum(seen.values()) - sum(n for _, n in top), 12)
    counts = np.zeros(mixing.counters(12), np.int32)
    mixing.count_into(counts, coder, tokens)
    return mixing.Model(coder, counts.astype(np.float32))


def lm_words(text):
    return (text or "").encode().lower().split()


NO_RUNS = lm.run_arrays(pa.array([], pa.list_(pa.struct([("key", pa.int64()), ("run", pa.binary()), ("n", pa.int64()), ("total", pa.int64())]))))


def test_tokens_are_the_words_of_the_texts():
    texts = [" Ab  c\td\x0b\x0ce ", "", "   ", None, "x", "É é\u00a0z", "w" * 100 + " v", " "]
    t = mixing.Tokens(pa.array([None if x is None else x.encode() for x in texts], pa.binary()))
    want = [lm_words(x) for x in texts]
    assert t.sizes.tolist() == list(map(len, want)) and [t.word(c) for c in t.codes] == sum(want, [])
    begin = np.concatenate(([0], t.ends[:-1] + 1))
    assert [bytes(t.data[b:e]).lstrip() for b, e in zip(begin, t.ends, strict=True)] == sum(want, [])
    assert max(map(len, t.keys().to_pylist())) <= mixing.LONGEST_NAME


def test_lm_symbol_probabilities_sum_to_one():
    model = small_model(TEXTS[:20])
    coder, n = model.coder, len(model.coder.weights)
    of, turns, depth = coder.paths(np.arange(n))
    x = [coder.alone[turns].astype(np.float32), model.after[coder.slots(np.full(len(of), 7, np.uint32), turns)].astype(np.float32)]
    lp = mixing.Mixer(n, mixing.DEPTH, mixing.WORD_START, coder.local).block(of, depth, x, turns & 1, turns >> 1)
    assert abs(np.exp(np.bincount(of, lp, n) + coder.rest).sum() - 1) < 1e-4
    big = mixing.Coder([b"%d" % k for k in range(20_000)], np.arange(20_000, 0, -1), 5, 9, 12)  # paths longer than DEPTH
    known = {}
    of, turns, _ = big.paths(np.arange(20_002))
    for k, t in zip(of.tolist(), turns.tolist(), strict=True):
        known.setdefault(k, []).append(t)
    by: dict = {}
    for k, path in known.items():
        by.setdefault(tuple(path), []).append(math.exp(big.rest[k]))
    assert max(map(len, by)) == mixing.DEPTH and all(abs(sum(v) - 1) < 1e-6 for v in by.values())


def plain_mixing(events, gates, start, local=None):
    """The mixer one bit at a time: events are (block, gate, inputs, bit, node)."""
    w = {g: list(map(float, start)) for g in range(gates)}
    fix, total, k = {}, 0.0, 0
    counts = None if local is None else [list(map(float, row)) for row in local]
    while k < len(events):
        block, moves, fixes, adds, many = events[k][0], {}, {}, [], Counter()
        while k < len(events) and events[k][0] == block:
            _, g, x, y, node = events[k]
            x = list(x)
            if counts is not None:
                x.append(math.log(counts[1][node] / counts[0][node]) if node < mixing.LOCAL_NODES else 0.0)
                if node < mixing.LOCAL_NODES:
                    adds.append((y, node))
            s = sum(a * b for a, b in zip(w[g], x, strict=True))
            cell = (g, int(min(max(s, -7.9), 7.9) + 8))
            s += fix.get(cell, 0.0)
            p = 1 / (1 + math.exp(-min(max(s, -14), 14)))
            total += math.log(p if y else 1 - p)
            many[g] += 1
            moves.setdefault(g, []).append([(y - p) * v for v in x])
            fixes.setdefault(cell, []).append(y - p)
            k += 1
        for g, rows in moves.items():
            for i in range(len(w[g])):
                w[g][i] += mixing.RATE * sum(r[i] for r in rows) / max(1, many[g] / 8)
        for cell, errors in fixes.items():
            fix[cell] = fix.get(cell, 0.0) + mixing.REFINE_RATE * sum(errors) / max(1, many[cell[0]] / 8)
        for y, node in adds:
            counts[y][node] += 1
    return total


@pytest.mark.parametrize("counted", [False, True])
def test_lm_scores_match_a_plain_mixer(counted):
    model, texts = small_model(TEXTS[:20]), [TEXTS[3], TEXTS[40], words("en", 700), ""]
    coder, after, alone = model.coder, model.after, model.coder.alone
    tokens = mixing.Tokens(pa.array([t.encode() for t in texts], pa.binary()))
    got = model.score(tokens, np.full(len(texts), counted), NO_RUNS)
    ids, kinds = coder.symbols(tokens)
    step = lambda place: int(np.searchsorted(mixing.BOUNDS, place, side="right"))
    spelled = iter(got["spelled"])
    for k in range(len(texts)):
        own_ids = [*ids[tokens.lane == k].tolist(), coder.end]
        own_kinds = kinds[tokens.lane == k].tolist()
        events, rest, letters, cost = [], 0.0, [], 0.0
        for place, i in enumerate(own_ids):
            before = own_kinds[place - 1] + 1 if place else 0
            rest += coder.rest[i]
            _, turns, depth = coder.paths(np.array([i]))
            for t, d in zip(turns.tolist(), depth.tolist(), strict=True):
                slot = int(coder.slots(np.array([before], np.uint32), np.array([t], np.int32))[0])
                x = [float(alone[counted * len(alone) // 2 + t]), float(after[counted * len(after) // 2 + slot])]
                events.append((step(place), d, x, t & 1, t >> 1))
            if i == coder.escape:
                x, contexts, _, open_ = coder.letters([lm_words(texts[k])[place]], np.array([before]))
                cost += next(spelled)
                rest_here = float(open_.sum())
                cost -= rest_here
                n = len({e[5] for e in letters})
                for at, letter in enumerate(x.tolist()):
                    for level in range(5):
                        node, bit = 1 << level | letter >> (5 - level), letter >> (4 - level) & 1
                        tables = [float(p[counted * len(p) // 2 + (int(contexts[c][at]) << 6) + node * 2 + bit]) for c, p in enumerate(model.spelled)]
                        letters.append((step(8 * n), level, tables, bit, node, place))
        assert got["total"][k] == pytest.approx(rest + plain_mixing(events, mixing.DEPTH, mixing.WORD_START, coder.local), rel=2e-3, abs=1e-3)
        assert cost == pytest.approx(plain_mixing([e[:5] for e in letters], 5, mixing.LETTER_START), rel=2e-3, abs=1e-3)


def test_lm_tells_copies_from_single_texts(spark):
    single = [words("en", 150) for _ in range(30)]
    twice = [words("fr", 150) for _ in range(6)]
    texts = [*single, *twice, *twice, twice[0] + " und " + words("de", 50), None, "", "=" * 70 + " x " + "=" * 70]
    rows = [(i, t) for i, t in enumerate(texts)] + [(41, twice[5]), (None, "x y")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lm.score(d, d.doc_id % 10 != 0).collect()
    out = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in found)
    rate = lambda i: out[i].score / out[i].n_tokens
    apart = [rate(i) for i in range(30) if i % 10]
    copies = [rate(i) for i in range(30, 42) if i != 34]  # the copy of 34 is held out, so nothing tells 34
    assert min(copies) > max(apart)
    assert out[36].score == pytest.approx(rate(36) * out[36].n_tokens) and {r.score for r in found if r.doc_id == 41} == {out[41].score}
    assert out[43].n_tokens == out[44].n_tokens == 1
    assert rate(34) < max(apart)


def test_packing(spark):
    from tokenizers import Tokenizer

    spec = packing.vocabulary()
    t = Tokenizer.from_str(spec)
    out = packing.pack_documents(docs(spark, repeat=2), spec, keep_ids=True).collect()
    whole: dict = {}
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
        whole.setdefault((r.doc_id, r.start), bytes(r.ids))
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        got = b"".join(whole[k] for k in sorted(k for k in whole if k[0] == i))
        assert np.frombuffer(got, "<u4").tolist() == ids
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in out) // 2048) + 2
    assert packing.pack_documents(docs(spark).limit(0), spec).count() == 0


def test_packing_of_another_vocabulary_and_clashing_names(spark):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(packing.vocabulary())
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}]}  # no lower case: the short cut must not apply
    text = "The Quick BROWN fox's 12 THE"
    assert packing.has_known_rules(json.loads(packing.vocabulary())) and not packing.has_known_rules(spec)
    want = Tokenizer.from_str(json.dumps(spec)).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordIds(json.dumps(spec)).encode(text.encode()), "<u4").tolist() == want
    items = spark.createDataFrame([(5, "a", "b"), (7, "a", "b")], "length long, place string, dealt_to string")
    assert {(r.length, r.place, r.dealt_to) for r in packing.pack(items, 12).collect()} == {(5, "a", "b"), (7, "a", "b")}


def test_first_fit_decreasing_matches_a_plain_scan():
    sizes = np.random.default_rng(1).integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for item in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[item]), len(room))
        room += [100] * (k == len(room))
        want[item] = (k, 100 - room[k])
        room[k] -= sizes[item]
    assert all((bins[i], offsets[i]) == want[i] for i in range(300))


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[100:200] = x[0] + 0.1 * rng.standard_normal((100, 16))
    x[200:230] = x[1]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0, 0.0], 1), (906, [2.0, 0.0], 1)]
    out = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = np.array([out[i].n_links for i in range(400)])
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()
    assert all(out[i].component_id == 1 for i in range(200, 230)) and out[1].kept
    assert all(out[i].n_links == 0 and out[i].component_id == i for i in (900, 901, 902, 903, 904))
    assert out[905].n_links == out[906].n_links == 1 and out[906].component_id == 905


@pytest.mark.parametrize("n", [6_000, 50_000, 500_000])
def test_filters_catch_pairs_at_any_size(n):
    rng, at = np.random.default_rng(n), vectors.Rotations(n, 64)

    def filters(x):
        row, code = at.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
        return [set(c.tolist()) for c in np.split(code, np.searchsorted(row, np.arange(1, len(x))))]

    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = filters(x)
    assert min(map(len, own)) >= len(at.caps) * vectors.FLOOR and np.mean(list(map(len, own))) < 14
    for cosine in (0.951, 0.97, 0.99):
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        assert np.mean([bool(a & b) for a, b in zip(own, filters(y), strict=True)]) >= 0.98


def cone(rng, n, dim, mean):
    """n vectors of mean cosine `mean`."""
    g = rng.standard_normal((n, dim))
    return math.sqrt(mean) * np.eye(dim)[0] + math.sqrt(1 - mean) * g / np.linalg.norm(g, axis=1, keepdims=True)


@pytest.mark.parametrize("mean", [0.0, 0.2, 0.5, 0.8])
def test_filters_in_a_cone_compare_few_pairs(mean):
    rng = np.random.default_rng(4)
    x = cone(rng, 20_000, 64, mean)
    rest = x[:1000] - math.sqrt(mean) * np.eye(64)[0]  # partners in the cone, just over the bar
    z = rng.standard_normal(rest.shape)
    z -= (z * rest).sum(1, keepdims=True) * rest / (rest * rest).sum(1, keepdims=True)
    keep = 1 - 0.049 / (1 - mean)
    y = math.sqrt(mean) * np.eye(64)[0] + keep * rest + math.sqrt(1 - keep**2) * np.linalg.norm(rest, axis=1, keepdims=True) * z / np.linalg.norm(z, axis=1, keepdims=True)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    near = (x[:1000] * y).sum(1) >= vectors.COSINE
    at = vectors.Rotations(20_000, 64, x.mean(0))
    row, code = at.decode(x)
    sizes = np.unique(code, return_counts=True)[1]
    assert (sizes * (sizes - 1) // 2).sum() < 20_000_000
    of_x, of_y = ([set(c.tolist()) for c in np.split(code, np.searchsorted(row, np.arange(1, 1000)))] for row, code in (at.decode(x[:1000]), at.decode(y)))
    assert near.sum() > 300 and np.mean([bool(a & b) for a, b in zip(of_x, of_y, strict=True)]) >= 0.95


def test_centres_are_means_of_unit_vectors(spark):
    rng = np.random.default_rng(6)
    x = 3 * cone(rng, 1500, 8, 0.6)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000 + i, [1.0, float(i)]) for i in range(20)]
    got = vectors.centres(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4))
    assert list(got) == [8] and np.allclose(got[8], (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(0))


def test_links_in_a_cone_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = cone(rng, 3000, 32, 0.7)
    x[:400] = x[400:800] + 0.03 * rng.standard_normal((400, 32))
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    links = np.array([got[i] for i in range(3000)])
    assert (links <= want).all() and want.sum() > 500 and links.sum() >= 0.95 * want.sum()


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    for k in range(0, 2000, 2):  # pairs just over and just under the bar, and a chain of links
        z = rng.standard_normal(64)
        u = x[k] / np.linalg.norm(x[k])
        z -= (z @ u) * u
        x[k + 1] = (0.951 if k % 4 else 0.949) * u + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z)
    for k in range(3000, 3020):
        x[k] = x[k - 1] / np.linalg.norm(x[k - 1]) + 0.02 * rng.standard_normal(64)
    ids = [None if i == 3999 else i for i in range(4000)]
    x[3999] = x[3010]
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)] + [(5, [float(v) for v in x[2500]])]
    got = {(r.vec_id, r.n_links): r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    links = near.sum(1) - 1
    found = [(i, int(n)) in got for i, n in zip([*ids, 5], links, strict=True)]
    assert np.mean(np.array(found)[links > 0]) >= 0.97 and all(np.array(found)[links == 0])
    assert got[None, int(links[3999])].component_id <= 3010
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_simhash(spark):
    import xxhash

    base = words("en", 400).split()
    near = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in (50, 399)]
    texts = [*TEXTS, " ".join(base), *near]
    out = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}

    def plain(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [plain(t) for t in texts]
    assert all(out[i].fingerprint == f"{f:016x}" for i, f in enumerate(fps))
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(fps):
            for j, b in enumerate(fps[:i]):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert [out[i].component_id for i in range(len(texts))] == root
    kept = simhash.one_of_each(docs(spark, texts, repeat=3))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == docs(spark).columns
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_dedup_stage_drops_edited_copies(spark):
    import corpus_pipeline

    def plain(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}

    base, other = words("en", 300).split(), words("de", 90).split()
    texts = [*TEXTS, " ".join(base), *(" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in range(10, 290, 10))]
    texts += [" ".join([*other[:30], *(f"x{k}" for _ in range(n)), *other[30:]]) for n in (1, 2, 12, 40, 90) for k in range(3)]
    sets = [plain(t) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8
    kept = corpus_pipeline.dedup_stage(spark, docs(spark, texts, repeat=2), "").collect()
    left = sorted(r.doc_id for r in kept)
    assert kept[0].asDict().keys() == dict.fromkeys(docs(spark).columns).keys() and len(set(left)) == len(left)
    root, before = list(range(len(texts))), None
    while root != before:
        before = root[:]
        for i, a in enumerate(sets):
            root[i] = min(root[j] for j, b in enumerate(sets) if like(a, b))
        root = [root[r] for r in root]
    assert left == sorted(set(root)) and len(texts) - len(left) > 30


def test_dedup_stage_takes_candidates_from_simhash(spark):
    fps = [5, 7, 6, 5, 1 << 40, -1, -4, (1 << 40) + 1023]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "i int, fp long")
    key = {r.i: r.key for r in simhash.fingerprint_keys(rows).collect()}
    assert len(key) == 8 and key[0] == key[1] == key[2] == key[3] and key[5] == key[6] and len(set(key.values())) == 4


def test_dedup_stage_shuffles_sketches_of_texts_with_a_common_key_only(spark, monkeypatch):
    seen, links = [], simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda members, *a: seen.append(members.select("me.doc_id").distinct().collect()) or links(members, *a))
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(12)]
    kept = simhash.one_of_similar(docs(spark, [*texts, texts[3] + " more"])).collect()
    assert len(kept) == 12 and sorted(r.doc_id for r in seen[0]) == [3, 12]


def test_similarity_of_shingles():
    assert simhash.jaccard("a b c d e f", "A  b c d e f\n") == 1 and simhash.jaccard("a b c d e f", "a b c d e g") == 1 / 3
    assert simhash.jaccard(None, "") == 1 and simhash.jaccard("a b", "a c") == 0


def test_close_fingerprints_finds_every_pair_within_two_bits(spark):
    r = random.Random(8)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        f = r.getrandbits(64)
        fps |= {f, f ^ 1 << r.randrange(64), f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), f ^ 7 << r.randrange(60)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {tuple(x) for x in simhash.close_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(40, 50), (50, 41), (60, 60)] + [(70, k) for k in range(71, 90)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    assert all(got[k] == 1 for k in range(1, 31)) and got[50] == got[41] == 40 and all(got[k] == 70 for k in range(70, 90)) and 60 not in got


def luhn(s: str) -> int:
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10


def plain_permutation(x: int, n: int, key: str, tag: str) -> int:
    """The Feistel network and its walk in plain Python."""

    def keyed(*parts) -> int:
        return int(hashlib.sha256("|".join(map(str, (key, *parts))).encode()).hexdigest()[:15], 16)

    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for k in range(pii.ROUNDS):
            if k % 2 == 0:
                left = (left + keyed(tag, n, k, right)) % a
            else:
                right = (right + keyed(tag, n, k, left)) % b
        x = left * b + right
        if x < n:
            return x


def test_pii(spark):
    text = "id 4111111111111111, 4111 1111 1111 1111; b.34@mail7.example.com 10.2.255.1 1999-02-28 1999-02-31 12/31/2001 123-45-6789 +1 (017) 555-7713"
    texts = [text, "again 4111111111111111 on 31.12.2001", "plain text 12, 34.", None, "", "4111111111111112", f"{pii.EDGE} 4111-1111-1111-1111", "3782 822463 10005"]
    d = docs(spark, [*texts, "x 1 " * 50_000 + "4111111111111111"], repeat=2)
    out = {r.doc_id: r.text for r in pii.pseudonymise(d, "k").collect()}
    assert pii.pseudonymise(d, "k").columns == d.columns and pii.pseudonymise(d, "k").count() == 18
    assert pii.pseudonymise(d.limit(0), "k").count() == 0
    number = out[1].split()[1]
    assert out[0].split()[1] == number + "," and luhn(number) == 0
    assert number[:15] == str(plain_permutation(411111111111111, 10**15, "k", "number")).zfill(15)
    assert out[5] == "4111111111111112"  # a wrong check digit: no such number
    assert out[6] == f"{pii.EDGE} " + "-".join(number[k : k + 4] for k in range(0, 16, 4))
    assert out[7] != "3782 822463 10005" and luhn(out[7].replace(" ", "")) == 0 and [len(x) for x in out[7].split()] == [4, 6, 5]
    assert out[0].split()[2:6] == [f"{number[k:k+4]}" + (";" if k == 12 else "") for k in range(0, 16, 4)]
    for secret in ("b.34@", "mail7", "example", "10.2.255.1", "1999-02-28", "12/31/2001", "123-45-6789", "555-7713"):
        assert secret not in out[0]
    assert "1999-02-31" in out[0] and out[2] == "plain text 12, 34." and out[3] is None and out[4] == ""
    assert out[8] == "x 1 " * 50_000 + number
    assert {r.text for r in pii.pseudonymise(d.where("doc_id = 1"), "other").collect()}.isdisjoint({out[1]})


def test_pii_permutations(spark):
    for n in (1, 2, 97, 1000):
        got = [r[0] for r in spark.range(n).select(pii.permuted(pii.F.col("id"), n, "k", "t")).collect()]
        assert sorted(got) == list(range(n)) and got == [plain_permutation(x, n, "k", "t") for x in range(n)]
    got = {r[0] for r in spark.range(100, 1000).select(pii.permuted_text(pii.F.concat(pii.F.lit("aB"), pii.F.col("id").cast("string")), "k", "t")).collect()}
    assert len(got) == 900 and all(g[0].islower() and g[1].isupper() and g[2:].isdigit() for g in got)


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    t = Tokenizer.from_str(spec)
    out = {r.doc_id: r for r in bpe.encode(docs(spark), spec).collect()}
    short = {r.doc_id: r for r in bpe.encode(docs(spark), spec, keep=False).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(out[i].ids, "<u4").tolist() == ids and out[i].n_tokens == len(ids)
        assert out[i].decoded == t.decode(ids, skip_special_tokens=False) == (text or "")
        assert short[i].ids_sha256 == hashlib.sha256(out[i].ids).hexdigest()
    made = bpe.encoder(spec)
    fuzz = ["".join(rnd.choice("abc de\n\t'stlr.,!<|>09éß漢😀\x1c\xa0") for _ in range(40)) for _ in range(500)]
    for text, ids in zip(fuzz, made.encode(fuzz), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    for a, b in zip(range(0, 40000, 411), range(300, 40300, 411), strict=True):
        assert made.agree(a, b) == (made.merge(made.bytes_of[a] + made.bytes_of[b]) == [a, b])


def test_toxicity_chain_matches_plain_forward_backward():
    rng = np.random.default_rng(0)
    sizes = [0, 3, 64, 65, 200]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    odds, step = rng.exponential(1, starts[-1]), np.array([[3, 0.5], [0.7, 2.0]])
    p, moves = toxicity.chain(odds, starts, step)
    want, total = [], np.zeros((2, 2))
    for a, b in zip(starts, starts[1:], strict=False):
        alpha = [np.array([1.0, 0.0])]
        for o in odds[a:b]:
            alpha.append(alpha[-1] @ step * [1, o])
            alpha[-1] /= alpha[-1].sum()
        beta, own = np.ones(2), []
        for k in range(b - a - 1, -1, -1):
            both = alpha[k + 1] * beta
            own.append(both[1] / both.sum())
            pair = alpha[k][:, None] * step * (beta * [1, odds[a + k]])
            total += pair / pair.sum()
            beta = step @ (beta * [1, odds[a + k]])
            beta /= beta.sum()
        want += own[::-1]
    assert np.allclose(p, want) and np.allclose(moves, total)


def test_toxicity(spark):
    texts = [words("en", 40) for _ in range(160)]
    bad = [i for i in range(160) if i % 4 == 0]
    for i in bad:
        w = texts[i].split()
        for _ in range(3):
            w.insert(rnd.randrange(len(w)), rnd.choice(["scumbag", "morons"]))
        texts[i] = " ".join(w)
    texts += [None, ""]
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(160)] + [(161, None)], "doc_id long, toxic int")
    d = docs(spark, texts)
    model = toxicity.learn(d.where("doc_id % 3 <> 1"), labels)
    out = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(out) == 162 and all(0 <= r.score <= 1 for r in out.values())
    assert all((out[i].score >= 0.3) == (i in bad) for i in range(160)) and out[160].score < 0.3
    for i in bad:
        found = [w for s in out[i].spans for w in texts[i][s.begin : s.end].split()]
        assert found and set(found) <= {"scumbag", "morons"}
    assert toxicity.score(d.limit(0), model).count() == 0


def plain_fingerprint(data: bytes) -> str:
    """Byte by byte, in whole numbers."""
    m = (1 << 32) - 1
    factors = [pow(0x9E3779B1, k + 1, 1 << 32) | 1 for k in range(7)]
    window, hashes = [0] * 7, []
    for c in data:
        window = [c, *window[:6]]
        h = sum(x * f for x, f in zip(window, factors, strict=True)) + 0x7F4A7C15 & m
        h ^= h >> 15
        h = h * 0x85EBCA6B & m
        h ^= h >> 13
        hashes.append(h * 0xC2B2AE35 & m)

    def signature(level: int) -> str:
        out, total = "", 0
        for k, h in enumerate(hashes):
            total += h
            if h < 1 << (32 - level) or k == len(hashes) - 1:
                out += piecewise.LETTERS[(total * 0x9E3779B1 & m) >> 26]
                total = 0
        return out if len(out) <= 64 or level < 29 else piecewise.LETTERS[(sum(hashes) * 0x9E3779B1 & m) >> 26]

    level = max(2, (max(1, len(data) - 1) // 64).bit_length() - 4)
    while level < 29 and len(signature(level)) > 64:
        level += 1
    return ":".join([str(level), *(signature(level + k) for k in range(3))])


def plain_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        run = max(3, min(7, min(len(x), len(y)) // 4))
        if not any(x[k : k + run] in y for k in range(len(x) - run + 1)):
            return 0.0
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + 2 * (c != e)))
            row = new
        return 1 - row[-1] / (len(x) + len(y))

    of_a, of_b = ({int(f.split(":")[0]) + k: s for k, s in enumerate(f.split(":")[1:])} for f in (a, b))
    return max((one(of_a[k], of_b[k]) for k in of_a if k in of_b), default=0.0)


def test_piecewise(spark):
    out = {r.doc_id: r for r in piecewise.fingerprints(docs(spark)).collect()}
    order = sorted(range(len(TEXTS)), reverse=True)
    for k, i in enumerate(order):
        own, after = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = out[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain_fingerprint(own.encode()) and r.edited_fingerprint == plain_fingerprint(edited.encode())
        assert r.near_edited == pytest.approx(plain_likeness(r.fingerprint, r.edited_fingerprint))
    assert out[0].fingerprint == out[80].fingerprint and out[75].fingerprint == "2:::"
    assert piecewise.fingerprints(docs(spark).limit(0)).count() == 0
    assert len(piecewise.fingerprints(docs(spark, repeat=3)).collect()) == 3 * len(TEXTS)


def test_piecewise_of_uniform_and_binary_texts(spark, monkeypatch):
    texts = ["\0" * 65, "\0" * 100, "\0" * 5000, "\0\1" * 3000, "a" * 4000, "".join(map(chr, range(128))) * 90, "\x7f\0" + " " * 900, "\U0001f600" * 700]
    noise = [bytes(rnd.randrange(256) for _ in range(3000)).decode("latin-1") for _ in range(3)]
    for t in texts + noise:
        assert piecewise.fingerprint(t.encode()) == plain_fingerprint(t.encode())
    for c in range(256):
        assert int(piecewise.fingerprint(bytes([c]) * 400).split(":")[0]) < 20
    out = piecewise.fingerprints(docs(spark, texts)).collect()
    assert len(out) == len(texts) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    # a window whose hash is below every threshold, again and again
    monkeypatch.setattr(piecewise, "window_hashes", lambda data: np.where(data == 65, np.uint32(0), np.uint32(1 << 31)))
    level, *signatures = piecewise.fingerprint(b"A" * 500).split(":")
    assert level == "29" and [len(x) for x in signatures] == [1, 1, 1] and len(piecewise.fingerprint(b"B" * 500).split(":")[1]) == 1


def test_piecewise_distance_and_blocks():
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 64))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
            row = new
        assert piecewise.edit_distance(a, b) == row[-1]
    text = words("en", 5000).encode()
    whole, size = piecewise.fingerprint(text), piecewise.BLOCK_BYTES
    piecewise.BLOCK_BYTES = 1000
    assert piecewise.fingerprint(text) == whole
    piecewise.BLOCK_BYTES = size


def test_quality(spark):
    good = [words("en", 60) for _ in range(60)]
    texts = good + [w.upper().replace(" ", "!! ") for w in good] + [w.replace(" ", "%%% ") for w in good] + [None, ""]
    grades = spark.createDataFrame([(i, 2 if i < 60 else 1 if i < 120 else 0) for i in range(180)], "doc_id long, grade int")
    d = docs(spark, texts)
    model = quality.learn(d, grades)
    out = {r.doc_id: r for r in quality.grade(d, model, 2).collect()}
    means = [np.mean([out[i].expected_grade for i in range(a, a + 60)]) for a in (0, 60, 120)]
    assert means[0] > 1.6 > means[1] > 0.5 > means[2] and len(out) == 182
    cuts = quality.pickle.loads(model)[2]
    assert (np.diff(cuts) > 0).all()
    kept = quality.accepted(d, model, 1, 0.5)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= set(range(60))
    assert quality.accepted(d, quality.learn(d, grades.limit(0))).count() == 182


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = d
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns, name
    left = {r.doc_id: r.text for r in now.collect()}
    assert left.keys().isdisjoint({75, 76, 77, 78, 80, 81})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left.keys()
