"""Refinement of placements and growing of the tree against plain walks over random trees."""

import random
from collections import Counter

import pytest

from genolake.operators import growth, tree

SITE = "cds string, pos int, ref string, qry string"
MASKS = [(0, 3), (27, 30)]


def random_case(seed, n_nodes, n_seqs, size=30):
    """(parent, states, branches, places, sequences' states): letters A but where said; a fifth of the sequences are copies."""
    rnd = random.Random(seed)
    parent, state = {}, {}
    for v in range(n_nodes):
        parent[v] = rnd.randrange(v) if v else None
        state[v] = dict(state[parent[v]]) if v else {}
        for _ in range(rnd.randint(0, 3)):
            state[v][rnd.choice(["nuc", "nuc", "S"]), rnd.randrange(size)] = rnd.choice("ACGT-")
    place, seqs, hot = {}, {}, [{("nuc", rnd.randrange(size)): rnd.choice("CGT") for _ in range(2)} for _ in range(4)]
    for i in range(n_seqs):
        if i % 5 == 4:
            place[i], seqs[i] = place[i - 1], seqs[i - 1]
            continue
        place[i] = rnd.randrange(n_nodes)
        v = place[i] if rnd.random() < 0.5 else parent[place[i]] or 0
        seqs[i] = dict(state[v]) | (rnd.choice(hot) if rnd.random() < 0.7 else {})
        for _ in range(rnd.randint(0, 2)):
            seqs[i][rnd.choice(["nuc", "S"]), rnd.randrange(size)] = rnd.choice("ACGTN")
    return parent, state, {v: diff(state[p] if p is not None else {}, state[v]) for v, p in parent.items()}, place, seqs


def diff(a, b):
    return {(*k, a.get(k, "A"), b.get(k, "A")) for k in a.keys() | b.keys() if a.get(k, "A") != b.get(k, "A")}


def counts(changes):
    plain = lambda c: c[2] in "ACGT" and c[3] in "ACGT"
    masked = lambda c: any(b <= c[1] < e for b, e in MASKS)
    nuc = [c for c in changes if c[0] == "nuc"]
    return sum(plain(c) and not masked(c) for c in nuc), sum(plain(c) and masked(c) for c in nuc), sum(not plain(c) for c in nuc)


def tables(spark, parent, branch, place, private):
    nodes = [(v, p, v, f"c{v % 3}" if v % 4 else None, float(v)) for v, p in parent.items()]
    return (
        spark.createDataFrame(nodes, "node_id long, parent_id long, preorder int, clade string, div double"), spark.createDataFrame([(v, *c) for v, m in branch.items() for c in m], f"node_id long, {SITE}"),
        spark.createDataFrame(list(place.items()), "seq_index long, node_id long"), spark.createDataFrame([(i, *c) for i, m in private.items() for c in m], f"seq_index long, {SITE}"),
        spark.createDataFrame(MASKS, "begin int, end int"),
    )


def walked(parent, state, branch, at, seq):
    """The node at which a sequence comes to rest."""
    score = lambda m: (lambda n, masked, other: n + 0.5 * (masked > 0) + 0.1 * (other > 0))(*counts(m))
    nuc = lambda m: {c for c in m if c[0] == "nuc"}
    while True:
        private = nuc(diff(state[at], seq))
        back = {(c, p, q, r) for c, p, r, q in nuc(branch[at])}
        kids = [(-score(private & nuc(branch[v])), v) for v, p in parent.items() if p == at and private & nuc(branch[v])]
        own = score(private & back) if parent[at] is not None else 0
        if kids and -min(kids)[0] > own:
            at = min(kids)[1]
        elif parent[at] is not None and back <= private:
            at = parent[at]
        else:
            return at


@pytest.mark.parametrize("seed", [1, 2])
def test_refined_placements_match_a_walk(spark, seed):
    parent, state, branch, place, seqs = random_case(seed, 25, 40)
    nodes, muts, near, private, masks = tables(spark, parent, branch, place, {i: diff(state[place[i]], s) for i, s in seqs.items()})
    at, left = tree.refine_placement(private, near, nodes, muts, masks)
    got = {r.seq_index: r.node_id for r in at.collect()}
    assert got == {i: walked(parent, state, branch, place[i], s) for i, s in seqs.items()}
    assert {tuple(r) for r in left.select("seq_index", "cds", "pos", "ref", "qry").collect()} == {(i, *c) for i, v in got.items() for c in diff(state[v], seqs[i])}


def test_changes_that_do_not_follow_are_an_error(spark):
    nodes, muts, near, private, masks = tables(spark, {0: None, 1: 0}, {1: {("nuc", 5, "A", "C"), ("nuc", 6, "A", "C")}}, {7: 0}, {7: {("nuc", 5, "A", "C"), ("nuc", 6, "G", "T")}})
    with pytest.raises(Exception, match="follow"):
        tree.refine_placement(private, near, nodes, muts, masks)[1].collect()


def grown(parent, state, branch, place, seqs):
    """(node: (parent, kind, div, clade, changes)) one group at a time."""
    leaf = {v for v in parent if v not in parent.values()}
    clade = lambda v: f"c{v % 3}" if v % 4 else None
    length = lambda m: (lambda n, masked, other: 0.06 if n == 0 and masked + other else float(n))(*counts(m))
    out = {str(v): (None if p is None else str(p), "reference", float(v), clade(v), frozenset(branch[v])) for v, p in parent.items()}
    sites = {}
    for i, v in place.items():
        back = {(c, p, q, r) for c, p, r, q in branch[v] if c == "nuc"}
        up = parent[v] is not None and (v in leaf or bool(back & diff(state[v], seqs[i])))
        above = parent[v] if up else v
        sites.setdefault((v, up), []).append((f"new_{i}", i, v, frozenset(diff(state[above], seqs[i]))))
    for (v, up), kids in sites.items():
        above = parent[v] if up else v
        settle([*kids, *([(str(v), None, v, frozenset(branch[v]))] if up else [])], str(above), above, float(above), 0, out, length, clade)
    return out


def settle(kids, under, above, base, level, out, length, clade):
    votes = []
    while kids:
        n = Counter((c[1], c[3]) for k in kids for c in k[3] if c[0] == "nuc")
        most = min(((-m, pos, q) for (pos, q), m in n.items() if m > 1), default=None)
        if most is None:
            break
        group = [k for k in kids if any(c[0] == "nuc" and (c[1], c[3]) == most[1:] for c in k[3])]
        shared = frozenset.intersection(*(k[3] for k in group))
        name = f"inner_{level}_{min(k[1] for k in group if k[1] is not None)}"
        div = base + length(shared)
        below = settle([(*k[:3], k[3] - shared) for k in group], name, above, div, level + 1, out, length, clade)
        tally = Counter(x for x in [*below, clade(above)] if x)
        won = min(tally, key=lambda x: (-tally[x], x != clade(above), x)) if tally else None
        out[name] = (under, "inner", div, won, shared)
        votes.append(won)
        kids = [k for k in kids if k not in group]
    for name, seq, v, changes in kids:
        out[name] = (under, "reference" if seq is None else "leaf", float(v) if seq is None else base + length(changes), clade(v), changes)
        votes.append(clade(v))
    return votes


@pytest.mark.parametrize(("seed", "n_nodes", "n_seqs"), [(1, 12, 60), (2, 30, 50), (3, 1, 20), (4, 3, 60)])
def test_grown_tree_matches_one_group_at_a_time(spark, seed, n_nodes, n_seqs):
    parent, state, branch, place, seqs = random_case(seed, n_nodes, n_seqs)
    private = {i: diff(state[place[i]], s) for i, s in seqs.items()}
    nodes, muts, near, private, masks = tables(spark, parent, branch, place, private)
    got, changes = growth.grow_tree(near, private.repartition(5), nodes, muts, masks)
    of = {}
    for r in changes.collect():
        of.setdefault(r.node_id, set()).add((r.cds, r.pos, r.ref, r.qry))
    got = {r.node_id: (r.parent_id, r.kind, round(r.div, 6), r.clade, frozenset(of.get(r.node_id, ()))) for r in got.collect()}
    want = {v: (p, kind, round(div, 6), c, m) for v, (p, kind, div, c, m) in grown(parent, state, branch, place, seqs).items()}
    assert got == want and (n_nodes < 2 or any(v.startswith("inner_1") for v in got))
    for i, s in seqs.items():  # the changes down to a leaf make its sequence, each site at most once a branch
        way, v = [], f"new_{i}"
        while v is not None:
            way.append(v)
            v = got[v][0]
        now = {}
        for v in reversed(way):
            for cds, pos, ref, qry in got[v][4]:
                assert now.get((cds, pos), "A") == ref
                now[cds, pos] = qry
        assert not diff(now, s)


def test_growing_without_sequences_and_with_a_hot_place(spark):
    parent, branch = {0: None, 1: 0}, {0: set(), 1: {("nuc", 5, "A", "C")}}
    nodes, muts, near, private, masks = tables(spark, parent, branch, {7: 1}, {7: {("nuc", 9, "A", "G")}})
    same, changes = growth.grow_tree(near.limit(0), private.limit(0), nodes, muts, masks)
    assert sorted(r.node_id for r in same.collect()) == ["0", "1"] and changes.count() == 1
    n = 3_000  # all on one leaf, a third of them equal
    many = spark.range(n).selectExpr("id seq_index", "1L node_id")
    theirs = spark.range(n).selectExpr("id seq_index", "'nuc' cds", "case when id % 3 = 0 then 9 else cast(10 + id as int) end pos", "'A' ref", "'G' qry")
    got, _ = growth.grow_tree(many, theirs, nodes, muts, masks)
    by = {r["parent_id"]: r["count"] for r in got.groupBy("parent_id").count().collect()}
    assert by == {None: 1, "0": 1, "inner_0_0": 2 + 2_000, "inner_1_0": 1_000}


@pytest.mark.parametrize(("most", "letters"), [(40, 1 << 23), (40, 80), (1, 1)])
def test_places_too_large_for_one_step_are_shared_out(spark, monkeypatch, most, letters):
    parent, state, branch, place, seqs = random_case(4, 3, 90)
    nodes, muts, near, private, masks = tables(spark, parent, branch, place, {i: diff(state[place[i]], s) for i, s in seqs.items()})
    want = {v: (p, kind, round(div, 6), c) for v, (p, kind, div, c, _) in grown(parent, state, branch, place, seqs).items()}
    monkeypatch.setattr(growth, "MOST", most)
    monkeypatch.setattr(growth, "LETTERS", letters)
    got = growth.grow_tree(near, private, nodes, muts, masks)[0].collect()
    assert {r.node_id: (r.parent_id, r.kind, round(r.div, 6), r.clade) for r in got} == want


def test_tables_written_do_not_follow_the_depth(spark, monkeypatch):
    """Each sequence has the changes of the one before and one more, so each inner node hangs below another."""
    parent, branch, n = {0: None, 1: 0}, {1: {("nuc", 5, "A", "C")}}, 12
    nodes, muts, near, private, masks = tables(spark, parent, branch, dict.fromkeys(range(n), 1), {i: {("nuc", 6 + k, "A", "G") for k in range(i + 1)} for i in range(n)})
    written, write = [], growth.cut_lineage
    monkeypatch.setattr(growth, "cut_lineage", lambda df: written.append(df) or write(df))
    got = growth.grow_tree(near, private, nodes, muts, masks)[0].where("kind = 'inner'").collect()
    assert {r.node_id for r in got} == {"inner_0_0", *[f"inner_{k}_{k - 1}" for k in range(1, n)]} and len(written) < n
