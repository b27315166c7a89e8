"""The opN queries and the pipeline as they are registered, on small written tables, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from genolake.llm import language, packing, pii, quality
from genolake.llm.queries import QUERIES

rnd = random.Random(11)
SYLLABLES = {"en": ["the", "ing", "and", "er", "on", "th"], "fr": ["eau", "le", "que", "é", "ou", "ch"]}
BAD = ["zorkgrub", "grubzork", "vexgrub"]


def words(lang, n, toxic=False):
    out = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    if toxic:
        for _ in range(6):
            out[rnd.randrange(n)] = rnd.choice(BAD)
    return " ".join(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents): good and poor, toxic, near and exact copies, nulls, empties, a long text, a repeated row."""
    rows, labels = [], []
    for i in range(120):
        lang, toxic, poor = ("en", "fr")[i % 2], i % 6 == 0, i % 5 == 1
        text = words(lang, rnd.randint(30, 60), toxic)
        if poor:
            text = " ".join(["## @@ || %% ~~"] * rnd.randint(5, 9)) + " " + words(lang, 6)
        rows.append((i, text, lang if i % 11 else None, f"s{i % 3}"))
        labels.append((i, 0 if poor else 1, int(toxic)))
    base = rows[2][1].split()
    rows += [(200, rows[2][1], "en", "s0"), (201, " ".join([*base[:-1], "changed"]), "en", "s0"), (202, " ".join(base[3:] + base[:3][::-1]), "en", "s1")]
    rows += [(203, None, None, "s1"), (204, "", "en", None), (205, "  \n", None, "s2"), (206, "card 4111 1111 1111 1111 and a.b@mail.example.org " + words("en", 30), "en", "s2")]
    rows += [(207, words("fr", 4000), "fr", "s2"), (None, words("en", 20), "en", "s2"), (208, "² ½ 12", None, "s1")]
    rows.append(rows[4])
    labels += [(3, 0, 1), (500, 1, 0), (7, None, None)]
    d = str(tmp_path_factory.mktemp("tables"))
    documents = [(*r, len(r[1]) if r[1] is not None else None, 7, "x", "y") for r in rows]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, row int, score string, training string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(k, [float(k % 7), 1.0, 2.0 + k % 3], 0) for k in range(40)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, rows


def crc(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def got(spark, tables, name):
    return QUERIES[name](spark, tables[0]).collect()


def ids_of(rows):
    return sorted((r.doc_id for r in rows), key=str)


def held(rows, n, k):
    return all(r.held_out is (crc(r.doc_id, n) == k) for r in rows)


def test_every_query_keeps_every_row(spark, tables):
    want = sorted((r[0] for r in tables[1]), key=str)
    for name in ("op1_language", "op2_lm", "op5_simhash", "op6_pii", "op7_bpe", "op8_toxicity", "op9_piecewise", "op10_quality"):
        assert ids_of(got(spark, tables, name)) == want, name


def test_op1(spark, tables):
    out = got(spark, tables, "op1_language")
    assert list(out[0].asDict())[:4] == ["doc_id", "held_out", "lang_pred", "score"] and held(out, 3, 1)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (203, 204, 205, 208))
    plain = [i for i in range(120) if i % 5 != 1]
    assert np.mean([by[i].lang_pred == ("en", "fr")[i % 2] for i in plain]) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_op2(spark, tables):
    out = got(spark, tables, "op2_lm")
    assert list(out[0].asDict())[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and held(out, 10, 0)
    tok = lambda t: (t or "").encode().lower().split()
    train = [tok(t) for i, t, *_ in tables[1] if i is not None and crc(i, 10) != 0]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    log = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    by = {r.doc_id: r for r in out}
    for i, t, *_ in tables[1]:
        own = tok(t)
        assert by[i].n_tokens == len(own) + 1 and by[i].train_tokens == n and by[i].n_known == 1 + sum(c[w] > 0 for w in own)
        assert by[i].base_score == pytest.approx(sum(log(c[w]) for w in own) + log(len(train)), rel=1e-9) and by[i].score < 0


def test_op3(spark, tables):
    out = got(spark, tables, "op3_packing")
    ids = packing.WordIds(packing.vocabulary())
    lengths: Counter = Counter()
    for r in out:
        lengths[r.doc_id] += r.length
    for i, t, *_ in tables[1]:
        whole = np.append(np.frombuffer(ids.encode((t or "").encode()), "<u4"), 1).astype("<u4")
        own = [r for r in out if r.doc_id == i]
        assert lengths[i] == len(whole) * (2 if i == 4 else 1)
        assert all(r.doc_tokens == len(whole) and zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for seq in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_op4(spark, tables):
    out = {r.vec_id: r for r in got(spark, tables, "op4_vectors")}
    x = np.array([[k % 7, 1.0, 2.0 + k % 3] for k in range(40)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    root = list(range(40))
    for _ in range(40):
        root = [min(root[j] for j in range(40) if near[i, j]) for i in range(40)]
    assert [out[i].n_links for i in range(40)] == (near.sum(1) - 1).tolist()
    assert [out[i].component_id for i in range(40)] == root and all(out[i].kept == (root[i] == i) for i in range(40))


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5(spark, tables):
    out = got(spark, tables, "op5_simhash")
    fp = [plain_simhash(t) for _, t, *_ in tables[1]]
    ids = [i for i, *_ in tables[1]]
    least = [math.inf if i is None else i for i in ids]
    while True:
        new = [min(least[b] for b in range(len(fp)) if (fp[a] ^ fp[b]).bit_count() <= 2) for a in range(len(fp))]
        if new == least:
            break
        least = new
    want = sorted((str(i), f"{f:016x}", None if m == math.inf else m) for i, f, m in zip(ids, fp, least, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == want


def test_op6(spark, tables):
    spark.conf.set(pii.KEY_SETTING, "test")
    by, again = ({r.doc_id: r for r in got(spark, tables, "op6_pii")} for _ in range(2))
    spark.conf.unset(pii.KEY_SETTING)
    assert by[206].kinds == "card,email" and by[206].text == again[206].text and "4111 1111" not in by[206].text
    assert all(by[i].text == t for i, t, *_ in tables[1] if i != 206)
    assert pii.key_of(spark) != pii.key_of(spark)  # without a key each run has its own


def test_op7(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {r.doc_id: r for r in got(spark, tables, "op7_bpe")}
    for i, text, *_ in tables[1]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert by[i].n_tokens == len(ids) and by[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8(spark, tables):
    out = got(spark, tables, "op8_toxicity")
    assert list(out[0].asDict())[:4] == ["doc_id", "held_out", "score", "predicted"] and held(out, 4, 2)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    by = {r.doc_id: r for r in out}
    test = [i for i in range(120) if crc(i, 4) == 2]
    assert np.mean([by[i].predicted == int(i % 6 == 0 and i % 5 != 1) for i in test]) > 0.9
    text = dict((i, t) for i, t, *_ in tables[1])
    spans = [tuple(map(int, s.split("-"))) for s in by[0].spans.split(",") if s]
    assert spans and all(any(b in text[0][a:e] for b in BAD) for a, e in spans)


def test_op9(spark, tables):
    out = got(spark, tables, "op9_piecewise")
    order = sorted(tables[1], key=lambda r: (-(r[0] if r[0] is not None else -math.inf), r[1] or ""))
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_op10(spark, tables):
    out = got(spark, tables, "op10_quality")
    by = {r.doc_id: r for r in out}
    assert held(out, 4, 3) and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.tail >= quality.KEEP_TAIL) for r in out)
    test = [i for i in range(120) if crc(i, 4) == 3]
    assert np.mean([(by[i].tail >= 0.5) == (i % 5 != 1) for i in test]) > 0.9


def test_queries_of_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {b" ".join(w)}


def plain_pipeline(spark, d, rows):
    """The rows that each stage keeps, decided one by one; models are fitted by the stages' own fits."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    in_training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    languages, logp = language.pickle.loads(language.learn(docs, in_training))
    kept = []
    for r in rows:
        share = language.proportions(r[1], languages, logp)
        if share and max(share.values()) >= 0.4:
            kept.append(r)
    left = spark.createDataFrame([r[:2] for r in kept], "doc_id long, text string")
    model = quality.pickle.loads(quality.learn(left, quality.ratings(spark.read.parquet(f"{d}/labels.parquet"))))
    good = [r for r in kept if quality.graded([r[1].encode()], model, 1)[1][0].as_py() >= quality.KEEP_TAIL]
    sets, group = [shingles(r[1]) for r in good], list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for r, g in zip(good, group, strict=True):
        key = (r[0] is None, r[0] if r[0] is not None else 0)
        if g not in first or key < first[g][0]:
            first[g] = key, r
    return [r for _, r in first.values()]


def test_pipeline_against_a_plain_version(spark, tables):
    d, rows = tables
    spark.conf.set(pii.KEY_SETTING, "test")
    out = corpus_pipeline.run(spark, d).collect()
    spark.conf.unset(pii.KEY_SETTING)
    kept = plain_pipeline(spark, d, rows)
    assert {r.doc_id for r in out} == {r[0] for r in kept} and not {200, 201, 203, 204, 205, 208} & {r[0] for r in kept} and 2 in {r[0] for r in kept}
    texts = {r[0]: r[1] for r in kept}
    if 206 in texts:
        clean = spark.createDataFrame([(206, texts[206])], "doc_id long, text string")
        texts[206] = pii.pseudonymise(clean, "test").first().text
        assert "4111 1111 1111 1111" not in texts[206]
    ids = packing.WordIds(packing.vocabulary())
    for i, text in texts.items():
        whole = np.append(np.frombuffer(ids.encode(text.encode()), "<u4"), 1).astype("<u4")
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(whole) and [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for seq in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
