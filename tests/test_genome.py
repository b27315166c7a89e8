"""Literal cases and plain-Python checks of the genome operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.functions.mutations import parse_mutation
from genolake.functions.seq import codon_table, gap_counts, reverse_complement, translate_codons
from genolake.operators import aa, align, catalog, detect, muts, nuc, placement, qc, ranges, results, tree
from genolake.operators.tour import euler_tour, last_on_path
from genolake.plans.numbering import numbered
from genolake.plans.scratch import cut_lineage
from genolake.queries import QUERIES
from genolake.sources import fasta, tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def mut(spark, *texts):
    return spark.createDataFrame([(1, "nuc", int(t[1:-1]) - 1, t[0], t[-1]) for t in texts], "k int, cds string, pos int, ref string, qry string")


def text(df):
    return sorted(f"{r.ref}{r.pos + 1}{r.qry}" for r in df.collect())


def test_adjacent_points(spark):
    points = [1, 3, 4, 6, 8, 9, 10, 12, 14, 16, 17, 19, 21, 23, 24, 26]
    got = rows(ranges.group_adjacent(spark.createDataFrame([(0, p) for p in points] + [(1, 5)], "k int, pos int"), ["k"]))
    want = [(1, 2), (3, 5), (6, 7), (8, 11), (12, 13), (14, 15), (16, 18), (19, 20), (21, 22), (23, 25), (26, 27)]
    assert got == [(0, *w) for w in want] + [(1, 5, 6)]


def test_mutation_lists(spark):
    split = muts.split_muts(mut(spark, "A1G", "A3C", "C4G"), mut(spark, "C2T", "A3C", "C4T"), ["k"])
    by = {s: text(split.where(F.col("side") == s)) for s in ("left", "shared", "right")}
    assert by == {"left": ["A1G", "C4G"], "shared": ["A3C"], "right": ["C2T", "C4T"]}
    assert text(muts.subtract_muts(mut(spark, "A1G", "C2T", "A3C", "C4G"), mut(spark, "C2T", "G3C", "C4A"), ["k"])) == ["A1G", "A3G", "A4G"]
    assert text(muts.compose_muts(mut(spark, "A1G", "A3G", "A4G"), mut(spark, "C2T", "G3C", "C4A"), ["k"])) == ["A1G", "A3C", "C2T", "C4G"]
    assert not muts.compose_muts(mut(spark, "A1G"), mut(spark, "C1T"), ["k"]).first().valid


@pytest.mark.parametrize(
    ("subs", "node", "missing", "aligned", "masks", "want"),
    [
        ([], [], [], (0, 100), [], 0),
        ([(3, "C"), (7, "C"), (12, "C")], [], [], (0, 100), [], 3),
        ([], [(3, "T"), (12, "C"), (15, "T"), (23, "G"), (35, "G")], [], (0, 100), [], 5),
        ([(3, "C"), (7, "C"), (12, "C")], [(3, "T"), (12, "C"), (15, "T"), (23, "G"), (35, "G")], [], (0, 100), [], 5),
        ([(3, "C"), (7, "C"), (12, "C")], [(3, "T"), (12, "C"), (15, "T"), (23, "G"), (35, "G")], [(8, 10), (20, 30)], (0, 100), [], 4),
        ([(3, "C"), (7, "C"), (12, "C")], [(3, "T"), (12, "C"), (15, "T"), (23, "G"), (35, "G")], [], (0, 20), [], 3),
        ([(3, "C"), (7, "C"), (12, "C")], [(3, "T"), (12, "C"), (15, "T"), (23, "G"), (35, "G")], [], (0, 100), [(0, 100)], 0),
        ([(3, "C"), (7, "C"), (12, "C")], [(3, "T"), (12, "C"), (15, "T"), (23, "G"), (35, "G")], [], (0, 100), [(0, 5), (30, 50)], 3),
    ],
)
def test_placement_distance(spark, subs, node, missing, aligned, masks, want):
    s = spark.createDataFrame([(1, "nuc", p, q) for p, q in subs], "seq_index long, cds string, pos int, qry string")
    n = spark.createDataFrame([(7, "nuc", p, q) for p, q in node], "node_id long, cds string, pos int, qry string")
    r = lambda x: spark.createDataFrame([(1, *p) for p in x], "seq_index long, begin int, end int")
    m = spark.createDataFrame(masks, "begin int, end int")
    d = tree.placement_distance(s, r([aligned]), r(missing), r([]), n, m, 100)
    assert [r.distance for r in d.collect()] in ([], [want])
    if not (missing or masks):
        return  # the nearest node in all these ways is tested in test_tree.py
    nodes = spark.createDataFrame([(7, None, 0, 0.0)], "node_id long, parent_id long, preorder int, prior double")
    near = placement.place(spark.createDataFrame([(1,)], "seq_index long"), s, r([aligned]), r(missing), r([]), nodes, euler_tour(nodes), n, m, 100).collect()
    assert [(r.node_id, r.distance) for r in near] == [(7, want)]


def test_placement_distances_in_groups(spark, monkeypatch):
    """Several groups of sequences and of nodes, overlapping holes and repeated rows give what plain sets give."""
    monkeypatch.setattr(tree, "PROFILES", 7)
    monkeypatch.setattr(tree, "NODES", 4)
    rng = random.Random(3)
    subs = {(s, p): rng.choice("ACGT") for s in range(20) for p in rng.sample(range(60), 5)}
    node = {(n, p): rng.choice("ACGT-") for n in range(11) for p in rng.sample(range(60), rng.choice([1, 3, 9]))}
    holes = [(s, b, b + rng.randrange(1, 12)) for s in range(3, 24) for b in rng.sample(range(50), 2)]
    spans = [(s, None, None) if s == 5 else (s, s % 4, 60 - s % 3) for s in range(22)]
    r = lambda x: spark.createDataFrame(x, "seq_index long, begin int, end int")
    s, n = (spark.createDataFrame([(i, "nuc", p, q) for (i, p), q in x.items()], f"{name} long, cds string, pos int, qry string") for x, name in ((subs, "seq_index"), (node, "node_id")))
    masks = [(10, 14)]
    got = tree.placement_distance(s, r(spans), r(holes[::2]), r(holes[1::2]), n, spark.createDataFrame(masks, "begin int, end int"), 60)
    unknown = {(s, p) for s, b, e in holes for p in range(b, e)} | {(s, p) for s, b, e in spans for p in range(60) if b is None or p < b or p >= e}
    seen = lambda x: {k: q for k, q in x.items() if not 10 <= k[1] < 14}
    subs, node, want = seen(subs), {k: q for k, q in seen(node).items() if q != "-"}, []
    for i in range(24):
        for k in range(11):
            own, its = ({p: q for (j, p), q in x.items() if j == of} for x, of in ((subs, i), (node, k)))
            less = sum((p in own) + (own.get(p) == q) + ((i, p) in unknown) for p, q in its.items())
            if less:
                want.append((i, k, len(own) + len(its) - less))
    assert sorted(map(tuple, got.collect())) == want


def test_sequence_functions(spark):
    df = spark.createDataFrame([("--AC-G-",), ("-",), ("---",), ("ACG",), ("",)], "s string")
    got = [tuple(r[0]) for r in df.select(gap_counts(F.col("s"))).collect()]
    assert got == [(2, 1, 1, 4), (0, 0, 0, 0), (3, 0, 0, 3), (0, 0, 0, 0), (0, 0, 0, 0)]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(reverse_complement(F.lit("ACGTRN-"))) == "-NYACGT"
    assert one(translate_codons(F.lit("ATGAAR---TAATTTNN"))) == "MK-*F" and codon_table()["AAR"] == "K"
    assert one(translate_codons(F.lit("ATGTAAATG"), True)) == "M*"
    assert tuple(one(parse_mutation(F.lit("S:N501Y")))) == ("S", "N", 500, "Y", True)
    assert one(parse_mutation(F.lit("A0T"))).valid is False and one(parse_mutation(F.lit("x"))).valid is False


def test_insertions_and_calls(spark):
    a = spark.createDataFrame([(1, "AC-GTTA-", "ACTG--AC"), (2, "GGACTGAC", "--ACTGAC")], "seq_index long, qry_aln string, ref_aln string")
    aligned, ins = nuc.strip_insertions(a)
    assert rows(aligned) == [(1, "AC-GA-"), (2, "ACTGAC")] and rows(ins) == [(1, 3, "TT"), (2, -1, "GG")]
    x = spark.createDataFrame([(1, "-ACR-TN-"), (2, "--------")], "seq_index long, aln string")
    assert rows(nuc.find_nuc_subs(x, "AAAAAAAA")) == [(1, 2, "A", "C"), (1, 5, "A", "T")]
    assert rows(nuc.find_nuc_dels(x)) == [(1, 4, 5)]
    assert sorted(map(tuple, nuc.alignment_range(x).collect()), key=str) == [(1, 1, 7), (2, None, None)]


def test_calls_in_one_pass_are_those_of_each_step(spark):
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(70))
    pairs = [("-" * 70, ref), ("NN" + ref[2:], ref), ("é" + ref[1:], ref), (ref[:9] + "-A-" + ref[9:], ref[:9] + "---" + ref[9:]), ("AC" + ref, "--" + ref)]
    for _ in range(20):
        r = "".join(c + "-" * rng.choice([0, 0, 0, 2]) for c in ref)
        pairs.append(("".join(rng.choice("ACGTNR-----") for _ in r), r))
    a = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "seq_index long, qry_aln string, ref_aln string")
    one, (aligned, insertions) = nuc.calls(a, ref), nuc.strip_insertions(a)
    listed = lambda c: rows(one.select("seq_index", F.inline(c)))
    assert rows(one.select("seq_index", "aln")) == rows(aligned) and listed("insertions") == rows(insertions)
    assert listed("subs") == rows(nuc.find_nuc_subs(aligned, ref)) and listed("dels") == rows(nuc.find_nuc_dels(aligned))
    assert listed("missing") == rows(ranges.islands(nuc.points(aligned, "N"), ["seq_index"])) and listed("unknown") == rows(ranges.islands(nuc.points(aligned, "[^ACGT-]"), ["seq_index"]))
    assert sorted(map(tuple, one.select("seq_index", "begin", "end").collect()), key=str) == sorted(map(tuple, nuc.alignment_range(aligned).collect()), key=str)
    want = ["".join(q for q, r in zip(*x, strict=True) if r != "-") for x in pairs]
    assert [r.aln for r in aligned.orderBy("seq_index").collect()] == want
    assert rows(nuc.find_nuc_subs(aligned, ref)) == [(k, p, r, q) for k, t in enumerate(want) for p, (r, q) in enumerate(zip(ref, t, strict=True)) if q in "ACGT" and q != r]
    assert "Window" not in one._jdf.queryExecution().toString() and "Exchange" not in one._jdf.queryExecution().toString()


def plain_frame_shifts(size, runs):
    out, frame, open_at = [], 0, None
    for begin, end, shift in runs:
        if begin == 0 or end >= size:
            continue
        old, frame = frame, (frame + shift) % 3
        if old == 0 and frame:
            open_at = end
        elif old and frame == 0:
            out.append((open_at, begin))
            open_at = None
    return out + ([(open_at, size)] if open_at is not None else [])


def test_frame_shifts_match_a_plain_loop(spark):
    rnd, seqs, want = random.Random(4), [], []
    for k in range(150):
        s = "".join("-" if rnd.random() < 0.15 else "A" for _ in range(30))
        runs, i = [], 0
        while i < 30:
            j = i
            while j < 30 and s[j] == s[i]:
                j += 1
            runs += [(i, j, j - i)] * (s[i] == "-")
            i = j
        seqs.append((k, "c", s))
        want += [(k, "c", *r) for r in plain_frame_shifts(30, runs)]
    none = spark.createDataFrame([], "seq_index long, cds string, pos int, size int")
    got = aa.frame_shifts(spark.createDataFrame(seqs, "seq_index long, cds string, nuc string"), none)
    assert rows(got.select("seq_index", "cds", "nuc_begin", "nuc_end")) == sorted(want)


def test_snp_clusters_match_a_plain_loop(spark):
    rnd, data, want = random.Random(5), [], []
    for k in range(100):
        places = sorted(rnd.sample(range(300), 25))
        data += [(k, p) for p in places]
        clusters, before = [], None
        for p in places:
            near = [q for q in places if p - 30 <= q <= p]
            if len(near) > 3:
                if clusters and clusters[-1][-1] == before:
                    clusters[-1].append(p)
                else:
                    clusters.append(near)
            before = p
        want += [(k, c[0], c[-1], len(c)) for c in clusters]
    assert rows(qc.snp_clusters(spark.createDataFrame(data, "seq_index long, pos int"), 30, 3)) == sorted(want)


def test_aa_groups(spark):
    x = spark.createDataFrame([(1, "S", p, "A", "B") for p in (1, 4, 5, 20)], "seq_index long, cds string, pos int, ref string, qry string")
    r = spark.createDataFrame([(1, "S", 0, 22)], "seq_index long, cds string, begin int, end int")
    assert rows(aa.group_aa_changes(x, r)) == [(1, "S", 0, 8, 3), (1, "S", 18, 22, 1)]


def test_motifs(spark):
    p = spark.createDataFrame([(1, "S", "NASNNTTNXT")], "seq_index long, cds string, aa string")
    r = spark.createDataFrame([(1, "S", 0, 10)], "seq_index long, cds string, begin int, end int")
    m = aa.find_motifs(p, r, {"g": "N[^P][ST]"})
    assert rows(m) == [(1, "g", "S", 0, "NAS"), (1, "g", "S", 3, "NNT"), (1, "g", "S", 7, "NXT")]


def plain_minimizers(text, k, cutoff):
    t, out, m = text.upper().replace("-", ""), set(), (1 << 32) - 1
    for i in range(len(t) - k):
        s = [t[i + j] for j in range(k) if j % 3 != 2]
        if set(s) <= set("ACGT"):
            x = sum("GCTA".index(c) << (2 * n) for n, c in enumerate(s))
            x = (~x + (x << 21)) & m
            x ^= x >> 24
            x = (x + (x << 3) + (x << 8)) & m
            x ^= x >> 14
            x = (x + (x << 2) + (x << 4)) & m
            x ^= x >> 28
            x = (x + (x << 31)) & m
            if x < cutoff:
                out.add(x)
    return sorted(out)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 11, 17, 19])
def test_minimizers_match_a_plain_loop(k, monkeypatch):
    rnd = random.Random(k)
    texts = ["".join(rnd.choice("ACGTacgtN-é*") if rnd.random() < 0.1 else rnd.choice("ACGT") for _ in range(rnd.randint(0, 300))) for _ in range(40)] + ["", None, "ACG"]
    for block in (50, 64, 1 << 20):
        monkeypatch.setattr(detect, "BLOCK_LETTERS", block)
        row, h = detect.sketch(texts, k, 1 << 30)
        for i, t in enumerate(texts):
            assert h[row == i].tolist() == plain_minimizers(t or "", k, 1 << 30)


def test_global_datasets_match_a_plain_loop(spark):
    rnd, hits = random.Random(6), []
    for s in range(60):
        for rank, ref in enumerate(rnd.sample(range(6), rnd.randint(1, 3)), 1):
            hits.append((s, ref, f"d{ref}", 20, 0.5, rank))
    got = [tuple(r) for r in detect.global_datasets(spark.createDataFrame(hits, "seq_index long, ref_id long, name string, n_hits long, score double, rank int")).orderBy("suggestion").collect()]
    left, chosen = {h[0] for h in hits}, []
    while left:
        count = lambda top: [sum(h[0] in left and h[1] == r and (h[5] == 1 or not top) for h in hits) for r in range(6)]
        n, t = count(False), count(True)
        a, b = n.index(max(n)), t.index(max(t))
        pick = b if n[b] == n[a] else a
        own = {h[0] for h in hits if h[1] == pick}
        chosen.append((pick, n[b], len(own)))
        left -= own
    want = sorted(enumerate(chosen), key=lambda x: (x[1][2], x[0]), reverse=True)
    assert [(r[1], r[3], r[4]) for r in got] == [w for _, w in want]


def test_global_datasets_leave_no_sequence_unmatched(spark):
    hits = spark.createDataFrame([(s, s, f"d{s}", 20, 0.5, 1) for s in range(23)], "seq_index long, ref_id long, name string, n_hits long, score double, rank int")
    found = cut_lineage(detect.global_datasets(hits))
    assert {r.ref_id for r in found.collect()} == set(range(23))
    assert {r.seq_index: r.name for r in detect.assign_global(hits.select("seq_index"), hits, found).collect()} == {s: f"d{s}" for s in range(23)}


def pair(a, b):
    if "N" in (a, b):
        return 2
    return 3 if a == b or "R" in (a, b) and {a, b} <= set("AGR") else -1


def full_score(q, r, cost):
    h, gap_r = np.zeros((len(r) + 1, len(q) + 1)), np.full((len(r) + 1, len(q) + 1), -1e9)
    for i in range(1, len(r) + 1):
        along = -1e9
        for j in range(len(q) + 1):
            gap_r[i, j] = max(gap_r[i - 1, j], h[i - 1, j] - (0 if j == len(q) else cost[i - 1])) if j else 0
            diagonal = h[i - 1, j - 1] + pair(r[i - 1], q[j - 1]) if j else -1e9
            best = max(diagonal, gap_r[i, j])
            h[i, j] = max(best, along)
            along = max(along, best - (0 if i == len(r) else cost[i - 1]))
    return h[-1, -1]


def score_of(q, r, cost):
    """The score of an alignment as written, its end gaps free."""
    first = next(k for k, (x, y) in enumerate(zip(q, r, strict=True)) if "-" not in (x, y))
    last = max(k for k, (x, y) in enumerate(zip(q, r, strict=True)) if "-" not in (x, y))
    i, total, before = sum(y != "-" for y in r[:first]), 0, ""
    for x, y in zip(q[first : last + 1], r[first : last + 1], strict=True):
        now = "del" if x == "-" else "ins" if y == "-" else ""
        if now and now != before:
            total -= cost[i - (now == "ins")]
        elif not now:
            total += pair(x, y)
        i, before = i + (y != "-"), now
    return total


def test_alignment_has_the_best_score():
    rnd = random.Random(7)
    for _ in range(150):
        r = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(5, 60)))
        q = list(r)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(q)) if q else 0
            q[k : k + rnd.randint(0, 4)] = [rnd.choice("ACGTNR") for _ in range(rnd.randint(0, 4))]
        q, cost = "".join(q)[rnd.randint(0, 5) :] or "A", np.array([rnd.choice([6, 7, 8]) for _ in r])
        ((a, b, score, errors),) = align.aligned_batch([(q, [])], r, cost)
        assert a.replace("-", "") == q and b.replace("-", "") == r and len(a) == len(b) and errors is None
        assert score == full_score(q, r, cost) and (score <= 0 or score_of(a, b, cost) == score)


@pytest.mark.parametrize("cells", [1, 900, 40_000])
def test_alignment_in_stretches_is_the_same(cells, monkeypatch):
    rnd = random.Random(cells)
    jobs, r = [], "".join(rnd.choice("ACGT") for _ in range(400))
    for _ in range(12):
        a, b = sorted(rnd.sample(range(400), 2))
        q = r[rnd.randint(0, 30) : a] + "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 40))) + r[a:b] + r[min(400, b + rnd.randint(0, 80)) :]
        jobs.append((q, [(0, len(q), 0)] if rnd.random() < 0.5 else []))
    cost = np.array([rnd.choice([6, 7, 8]) for _ in r])
    whole = align.aligned_batch(jobs, r, cost, extra=5)
    monkeypatch.setattr(align, "BATCH_CELLS", cells)
    assert align.aligned_batch(jobs, r, cost, extra=5) == whole


def test_unknown_letters_count_one_less():
    r = "ACGTTGCAAC" * 5
    for at in (0, 13, 40):
        q = r[:at] + "N" * 10 + r[at + 10 :]
        for pair_ in ((q, r), (r, q)):
            assert align.aligned_batch([(pair_[0], [])], pair_[1], np.full(50, 6))[0][2] == 3 * 40 + 2 * 10
    # the deletion takes what is known as far as the reference has it: the unknown letters stand beside the gap
    ((a, b, score, _),) = align.aligned_batch([(r[:20] + "NNN" + r[26:], [])], r, np.full(50, 6))
    assert score == 3 * 44 + 2 * 3 - 6 and a.replace("-", "") == r[:20] + "NNN" + r[26:] and a.count("-") == 3 and b == r


@pytest.mark.parametrize(
    "q, r, want",
    [
        ("ACGCTCGCT", "ACGCTCGCT", "ACGCTCGCT"), ("CGCTCGCT", "ACGCTCGCT", "-CGCTCGCT"), ("CTCGCT", "ACGCTCGCT", "---CTCGCT"),
        ("TCCAATCA", "AACAAACCAACCA", "-----TCCAATCA"), ("TGTTACCTGCGC", "AAGGTTTATACCTGCGC", "-----TGTTACCTGCGC"), ("ACGCTC", "ACGCTCGCT", "ACGCTC---"),
        ("CCAATCAT", "CCAACCAAACAAA", "CCAATCAT-----"), ("CCGATCAT", "CCGACCAAACAAA", "CCGATCAT-----"), ("ACGCTC", "GCCACGCTCGCT", "---ACGCTC---"),
    ],
)
def test_alignment_of_padded_and_contained_sequences(q, r, want):
    ((a, b, _, _),) = align.aligned_batch([(q, [])], r, np.full(len(r), 6))
    assert (a, b) == (want, r)


def test_banded_alignment_equals_the_full_one():
    rnd = random.Random(5)
    r = "".join(rnd.choice("ACGT") for _ in range(1200))
    at, cost, jobs = {r[i : i + 20]: i for i in range(1180)}, np.full(1200, 6), []
    for _ in range(12):
        d, ins, size = rnd.randint(500, 700), rnd.randint(100, 400), rnd.randint(0, 90)
        q = r[rnd.randint(0, 60) : ins] + "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 30))) + r[ins:d] + r[d + size :]
        spans = {}
        for i in range(0, len(q) - 20, 10):
            if q[i : i + 20] in at:
                spans.setdefault(at[q[i : i + 20]] - i, []).append(i)
        jobs.append((q, align.chain([(min(v), max(v) + 20, o) for o, v in spans.items()])))
    side = align.aligned_batch(jobs, r, cost)
    for (q, _), (a, b, score, errors) in zip(jobs, side, strict=True):
        ((_, _, best, _),) = align.aligned_batch([(q, [])], r, cost)
        assert score == best == score_of(a, b, cost) and errors is None and a.replace("-", "") == q
    assert align.aligned_batch([(jobs[0][0], [(0, 20, 0)])], r, cost, extra=1, retries=0)[0][2] <= side[0][2]


def test_alignment_of_a_table(spark):
    rnd = random.Random(2)
    ref = "".join(rnd.choice("ACGT") for _ in range(900))
    turned = ref[:400] + ref[430:]
    turned = turned[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = [(0, ref), (1, ref[50:]), (2, turned), (3, "ACGT" * 10), (4, "".join(rnd.choice("ACGT") for _ in range(600)))]
    s = spark.createDataFrame(seqs, "seq_index long, seq string")
    found = align.oriented(s, spark.createDataFrame([(0, ref)], "seq_index long, seq string"), 900)
    out = {r.seq_index: r for r in align.align_to_reference(found, ref, [6] * 900).collect()}
    assert (out[0].score, out[1].score, out[2].score) == (2700, 2550, 3 * 870 - 6) and out[2].is_rc and not out[1].is_rc
    assert out[1].qry_aln == "-" * 50 + ref[50:] and "too short" in out[3].errors and "seeds" in out[4].errors
    assert align.align_to_reference(found.limit(0), ref, [6] * 900).count() == 0


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).repartition(7).orderBy(F.desc("id"))
    assert rows(numbered(df, "n").select("n", "id")) == [(k, 999 - k) for k in range(1000)]
    assert numbered(df.limit(0), "n").count() == 0


def test_circle_of_parents_is_an_error(spark):
    t = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "node_id long, parent_id long")
    with pytest.raises(ValueError, match="circle"):
        tree.ancestors(t)


def test_written_sequences_keep_their_order(spark, tmp_path):
    s = spark.createDataFrame([(k, f"s{k}", "ACGT"[k % 4] * 3, k % 2 == 0) for k in range(50)], "seq_index long, seq_name string, seq string, is_rc boolean").repartition(6)
    fasta.write_fasta(s, str(tmp_path / "o"), ref=("ref", "AC"))
    (tmp_path / "b.fasta").write_text(">last\nGG\n")
    got = rows(fasta.read_fasta(spark, [str(tmp_path / "o"), str(tmp_path / "b.fasta")]).select("seq_index", "seq_name"))
    assert got == [(0, "ref"), *[(k + 1, f"s{k}" + " |reverse complement|" * (k % 2 == 0)) for k in range(50)], (51, "last")]
    hits = spark.createDataFrame([(0, "a/b"), (0, "a/c"), (1, "a/b")], "seq_index long, name string")
    same = s.withColumns({"seq_name": F.lit("x"), "seq": F.lit("A")})
    fasta.split_output(same, hits, str(tmp_path / "split"))
    back = spark.read.text(str(tmp_path / "split"), lineSep="\n>")
    assert back.groupBy("dataset").count().count() == 3 and back.count() == 5


def test_refinement_moves_to_child_and_parent(spark):
    nodes = spark.createDataFrame([(0, None, 0), (1, 0, 1), (2, 1, 2)], "node_id long, parent_id long, preorder int")
    branch = spark.createDataFrame([(1, "nuc", 5, "A", "C"), (2, "nuc", 9, "A", "G")], "node_id long, cds string, pos int, ref string, qry string")
    near = spark.createDataFrame([(10, 0), (11, 2), (12, 1)], "seq_index long, node_id long")
    private = spark.createDataFrame([(10, "nuc", 5, "A", "C"), (10, "nuc", 9, "A", "G"), (11, "nuc", 9, "G", "A"), (12, "nuc", 9, "A", "T")], "seq_index long, cds string, pos int, ref string, qry string")
    masks = spark.createDataFrame([], "begin int, end int")
    place, left = tree.refine_placement(private, near, nodes, branch, masks)
    assert rows(place) == [(10, 2), (11, 1), (12, 1)] and rows(left) == [(12, "nuc", 9, "A", "T")]


def test_refinement_goes_on_until_nothing_moves(spark):
    n = 52
    nodes = spark.createDataFrame([(k, k - 1 if k else None, k) for k in range(n + 1)], "node_id long, parent_id long, preorder int")
    site = "cds string, pos int, ref string, qry string"
    branch = spark.createDataFrame([(k, "nuc", k, "A", "C") for k in range(1, n + 1)], f"node_id long, {site}")
    private = spark.createDataFrame([(10, "nuc", k, "A", "C") for k in range(1, n + 1)], f"seq_index long, {site}")
    near, masks = spark.createDataFrame([(10, 0)], "seq_index long, node_id long"), spark.createDataFrame([], "begin int, end int")
    place, left = tree.refine_placement(private, near, nodes, branch, masks)
    assert rows(place) == [(10, n)] and left.isEmpty()


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text("\n\n>seq1 some > text\nacg-t\nN*\n>seq2\nTT\n")
    got = rows(fasta.read_fasta(spark, [str(p)]))
    assert got == [(0, "seq1 some > text", "seq1", "some > text", "ACGTN*"), (1, "seq2", "seq2", None, "TT")]
    p.write_text("ACGT\n>x\nA\n")
    with pytest.raises(Exception, match="not FASTA"):
        fasta.read_fasta(spark, [str(p)]).collect()


def test_columns_and_catalogue(spark):
    with pytest.raises(ValueError, match="clade"):
        tables.choose_columns(names=["clad"])
    assert tables.choose_columns(names=["missing", "clade"], after_clade=["x"], after_missing=["y"]) == ["clade", "x", "missing", "y"]
    v = spark.createDataFrame([("a", ["s"], {}, "t1", "2020"), ("a", ["s"], {}, "unreleased", None), ("b", None, {"deprecated": "true"}, "t2", "2021")], "path string, shortcuts array<string>, attributes map<string,string>, tag string, updated_at string")
    assert [r.tag for r in catalog.find_dataset(v, "s").collect()] == ["unreleased"]
    assert [r.path for r in catalog.list_datasets(v).collect()] == ["a"] and catalog.list_datasets(v, tag="t2").count() == 1
    assert results.nuc_pattern("A23") == ("A", 22, None) and results.nuc_pattern("..T") == (None, None, "T") and results.nuc_pattern("??") is None


def test_annotation_tree_and_primers(spark, tmp_path):
    g = tmp_path / "a.gff3"
    g.write_text("##gff-version 3\nr\t.\tgene\t1\t30\t.\t+\t.\tID=g1;Name=G\nr\t.\tCDS\t1\t9\t.\t+\t0\tID=c1;Parent=g1;Name=C\nr\t.\tCDS\t13\t21\t.\t+\t0\tID=c1;Parent=g1;Name=C\n")
    got = rows(tables.read_annotation(spark, str(g)))
    assert got == [("G", "C", 0, 0, 9, 0, 9, "+", 0), ("G", "C", 1, 12, 21, 9, 18, "+", 0)]
    doc = '{"tree": {"name": "r", "node_attrs": {"div": 0}, "children": [{"name": "x", "node_attrs": {"div": 7, "clade_membership": {"value": "c"}}, "branch_attrs": {"mutations": {"nuc": ["A5T"], "S": ["N2K"]}}}]}}'
    n, m, per_site = tables.tree_from_json(spark, doc)
    assert n.count() == 2 and rows(m) == [(1, "S", 1, "N", "K"), (1, "nuc", 4, "A", "T")] and not per_site
    p = spark.createDataFrame([("f", "CGR"), ("x_R", "TTT"), ("no", "GGGG")], "name string, seq string")
    found = {r.name: (r.begin, r.end, r.errors) for r in tables.find_primers(p, "AACGAAAC").collect()}
    assert found["f"][:2] == (2, 5) and found["x_R"][:2] == (4, 7) and found["no"][2]


def test_primers_that_fit_at_several_places(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,seq,place\na,ACG,\nb,ACG,0\nc,ACG,1\nd,ACG,7\ne_R,CGT,4\nf,ACR,2\ng,GGG,1\nh,ACG,90\n")
    p = tables.read_primers(spark, str(tmp_path / "p.csv"))
    found = {r.name: r.begin for r in tables.find_primers(p, "ACGTACGTAC").collect()}
    assert found == {"a": 0, "b": 0, "c": 4, "d": 0, "e_R": 4, "f": 4, "g": None, "h": 0}


def test_every_part_is_a_primer(spark, tmp_path):
    spark.createDataFrame([(1,), (41,), (2,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(9, 308, 6.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["c8_primer_changes"](spark, str(tmp_path))
    assert rows(got) == [(9, "p1", 8, "A", "G"), (9, "p41", 8, "A", "G")]


def test_tree_and_index_files_of_rows(spark, tmp_path):
    nodes = spark.createDataFrame([(5, None, "root", "a", 0.0, None, {}, 0), (7, 5, "x", "b", 1.5, -2.0, {"region": "r"}, 2), (6, 5, "y", None, 2.0, None, None, 1)], "node_id long, parent_id long, name string, clade string, div double, prior double, attrs map<string,string>, preorder int")
    branch = spark.createDataFrame([(7, "nuc", 22, "A", "T"), (7, "nuc", 3, "C", "-"), (6, "S", 500, "N", "Y")], "node_id long, cds string, pos int, ref string, qry string")
    tables.write_tree(nodes, branch, f"{tmp_path}/tree")
    n, m = tables.read_tree(spark, f"{tmp_path}/tree")
    assert [(r.node_id, r.parent_id, r.name, r.clade, r.div, r.prior) for r in n.orderBy("node_id").collect()] == [(0, None, "root", "a", 0.0, None), (1, 0, "y", None, 2.0, None), (2, 0, "x", "b", 1.5, -2.0)]
    assert sorted(map(tuple, m.collect())) == [(1, "S", 500, "N", "Y"), (2, "nuc", 3, "C", "-"), (2, "nuc", 22, "A", "T")]
    with pytest.raises(Exception, match="can't be read"):
        tables.tree_mutations(spark.createDataFrame([(1, "nuc", "A23"), (1, "nuc", "A23T")], "node_id long, cds string, text string")).collect()

    refs = spark.createDataFrame([(0, "a", 30, 2), (1, "b", 40, 1)], "ref_id long, name string, length int, n_minimizers long")
    tables.write_index(spark.createDataFrame([(9, 0), (9, 1), (4, 0)], "hash long, ref_id long"), refs, 17, 99, f"{tmp_path}/index")
    found, r, params = tables.read_index(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, found.collect())) == [(4, 0), (9, 0), (9, 1)] and sorted(map(tuple, r.collect())) == [(0, "a", 30, 2), (1, "b", 40, 1)] and tuple(params.first()) == (17, 99)


def test_band_holds_both_diagonals_where_letters_are_put_in_between_two_seeds():
    rnd = random.Random(8)
    r = "".join(rnd.choice("ACGT") for _ in range(128))
    q = r[:61] + "".join(rnd.choice("ACGT") for _ in range(40)) + r[61:]
    ((a, b, score, errors),) = align.aligned_batch([(q, [(0, 61, 0), (101, 168, -40)])], r, np.full(128, 6), extra=5)
    assert score == score_of(a, b, np.full(128, 6)) >= 3 * 128 - 6 and errors is None


def test_cells_by_diagonal_move_along_with_the_band():
    """Sequences that drift far from one diagonal, begin late or end early, beside each other; rows of a score are few."""
    rnd = random.Random(9)
    r, jobs = "".join(rnd.choice("ACGT") for _ in range(700)), []
    for cuts in ([(100, 160), (300, 360), (500, 560)], [(0, 350)], [(300, 700)], [(0, 129), (400, 480)], []):
        q, at, spans = "", 0, []
        for begin, end in [*cuts, (700, 700)]:
            spans += [(len(q), len(q) + begin - at, at - len(q))] if begin > at else []
            q, at = q + r[at:begin], end
        jobs.append((q, spans))
    rows = align.Rows([q for q, _ in jobs], r, np.full(700, 6), [align.band(s, len(q), 700, 3) for q, s in jobs])
    assert rows.width < 150  # all diagonals of the first two would be 350
    for (q, _), (a, b, score, _) in zip(jobs, align.aligned_batch(jobs, r, np.full(700, 6), extra=3), strict=True):
        ((_, _, best, _),) = align.aligned_batch([(q, [])], r, np.full(700, 6))
        assert score == best and a.replace("-", "") == q and b == r


def test_few_small_sequences_are_spread_over_all_tasks(spark):
    rnd = random.Random(4)
    ref = "".join(rnd.choice("ACGT") for _ in range(400))
    s = spark.createDataFrame([(k, ref[k:]) for k in range(40)], "seq_index long, seq string").coalesce(1)
    one = spark.createDataFrame([(0, ref)], "seq_index long, seq string")
    used = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert used(align.seed_hits(s, one)) == 4
    assert used(align.align_to_reference(cut_lineage(align.oriented(s, one, 400).coalesce(1)), ref, [6] * 400)) == 4


def test_skip_kmers_are_those_of_plain_python(spark):
    rnd = random.Random(6)
    texts = ["", "ACGT", "".join(rnd.choice("ACGTN") if k % 50 == 0 else rnd.choice("ACGT") for k in range(3000)), "é" + "ACGTTGCA" * 30 + "漢" + "TTGCAACG" * 9, None]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_index long, seq string")
    for k, distance in ((15, 30), (5, 1), (4, 2)):
        span = k + (k - 1) // 2
        want = []
        for no, t in enumerate(texts):
            for p in range(len(t or "") - span + 1):
                kmer = "".join(t[p + x] for x in range(span) if x % 3 != 2)
                if p % distance < min(3, distance) and not set(kmer) - set("ACGT"):
                    want.append((no, p, kmer))
        assert rows(align.skip_kmers(s, k, distance)) == sorted(want)
