"""The Euler tour, and the search for nearest nodes, against plain walks over random trees."""

import random

import pytest

from genolake.operators import placement, tree
from genolake.operators.tour import euler_tour, last_on_path
from genolake.plans.scratch import cut_lineage

LETTERS = "ACGT"


def random_tree(seed, n, roots=1, near=20):
    rnd = random.Random(seed)
    ids = rnd.sample(range(100, 100 + 3 * n), n)
    parent = {v: None for v in ids[:roots]}
    for i in range(roots, n):
        parent[ids[i]] = ids[rnd.randrange(max(0, i - near), i)]
    return parent, {v: rnd.randrange(n // 2 + 1) for v in ids}


def frame(spark, parent, preorder):
    rows = [(v, p, preorder[v], f"c{v % 3}" if v % 7 else None, None if v % 5 == 0 else float(-(v % 4))) for v, p in parent.items()]
    return spark.createDataFrame(rows, "node_id long, parent_id long, preorder int, clade string, prior double").repartition(3)


def path(parent, v):
    while v is not None:
        yield v
        v = parent[v]


@pytest.mark.parametrize(("seed", "n", "roots"), [(1, 120, 1), (2, 60, 4), (3, 1, 1)])
def test_euler_tour_matches_a_walk(spark, seed, n, roots):
    parent, preorder = random_tree(seed, n, roots)
    kids, want, clock = {}, {}, 0
    for v, p in parent.items():
        kids.setdefault(p, []).append(v)

    def walk(v, depth):
        nonlocal clock
        enter, clock = clock, clock + 1
        leaves = sum(walk(c, depth + 1) for c in sorted(kids.get(v, []), key=lambda c: (preorder[c], c))) or 1
        want[v] = (parent[v], enter, clock, depth, leaves)
        return leaves

    for v in sorted(kids[None], key=lambda c: (preorder[c], c)):
        walk(v, 0)
    got = {r.node_id: (r.parent_id, r.enter, r.exit, r.depth, r.leaves) for r in euler_tour(frame(spark, parent, preorder)).collect()}
    assert got == want


def test_tour_of_a_long_chain_and_a_wide_star(spark):
    n = 5_000
    chain = spark.range(n).selectExpr("id node_id", "case when id > 0 then id - 1 end parent_id", "0 preorder")
    r = euler_tour(chain).where("enter <> node_id or exit <> 5000 or depth <> node_id or leaves <> 1").count()
    star = spark.range(n).selectExpr("id node_id", "case when id > 0 then 0 end parent_id", "0 preorder")
    assert r == 0 and euler_tour(star).where("node_id = 0").first()[2:] == (0, n, 0, n - 1)
    assert euler_tour(chain.limit(0)).count() == 0


def test_tour_of_a_circle_is_an_error(spark):
    for rows in ([(1, None, 0), (2, 3, 0), (3, 2, 0)], [(1, None, 0), (2, 9, 0)], [(1, 1, 0)]):
        with pytest.raises(ValueError, match="circle"):
            euler_tour(spark.createDataFrame(rows, "node_id long, parent_id long, preorder int"))


def test_states_founders_and_marks_match_plain_walks(spark):
    parent, preorder = random_tree(5, 80)
    rnd = random.Random(6)
    nodes = frame(spark, parent, preorder)
    tour = euler_tour(nodes)
    changes = {(v, rnd.randrange(6)): rnd.choice(LETTERS) for v in parent for _ in range(2)}
    want = set()
    for v in parent:
        for pos in range(6):
            found = [changes[a, pos] for a in path(parent, v) if (a, pos) in changes]
            want |= {(v, pos, found[0])} if found else set()
    got = last_on_path(spark.createDataFrame([(v, p, q) for (v, p), q in changes.items()], "node_id long, pos int, qry string"), tour, ["pos"], "qry")
    assert set(map(tuple, got.collect())) == want

    clade = {r.node_id: r.clade for r in nodes.collect()}
    near = spark.createDataFrame([(i, v) for i, v in enumerate(parent)], "seq_index long, node_id long")
    founders = {r.seq_index: r.founder_id for r in tree.clade_founder(near, tour, nodes).collect()}
    assert founders == {i: [a for a in path(parent, v) if clade[a] == clade[v]][-1] for i, v in enumerate(parent)}

    marks = [(v, g) for v in parent for g in "xy" if rnd.random() < 0.2]
    above = {(r.node_id, r.g): (r.near, r.far) for r in tree.marked_above(nodes, spark.createDataFrame(marks, "node_id long, g string"), ["g"]).collect()}
    plain = {}
    for v in parent:
        for g in "xy":
            if found := [a for a in list(path(parent, v))[1:] if (a, g) in marks]:
                plain[v, g] = (found[0], found[-1])
    assert above == plain


def random_placement(spark, seed, n_nodes=45, n_seqs=40, size=40):
    """A tree with mutations that come, change and go back; sequences near random nodes, with holes, some over mutations."""
    rnd = random.Random(seed)
    parent, preorder = random_tree(seed, n_nodes, near=n_nodes)
    state = {}
    for v, p in parent.items():
        state[v] = dict(state[p]) if p is not None else {3: "T"}
        for _ in range(rnd.randint(0, 3)):
            pos, q = rnd.randrange(size), rnd.choice(LETTERS + "-")
            if q == "A":  # the reference is A everywhere
                state[v].pop(pos, None)
            else:
                state[v][pos] = q
    seqs = []
    for i in range(n_seqs):
        own = {p: q for p, q in state[rnd.choice(list(state))].items() if q != "-" and rnd.random() < 0.9} if i % 5 else {}
        own |= {rnd.randrange(size): rnd.choice("CGT") for _ in range(rnd.randint(0, 3))}
        holes = [(b, b + rnd.randint(1, 6)) for b in (rnd.randrange(size) for _ in range(rnd.randint(0, 2)))]
        gone = [(b, b + 2) for b in (rnd.randrange(size - 2) for _ in range(rnd.randint(0, 1)))]
        seqs.append((own, holes, gone, (rnd.randrange(5), size - rnd.randrange(5)) if i % 4 else None))
    return parent, preorder, state, seqs


def tables_of(spark, state, seqs):
    r = "seq_index long, begin int, end int"
    return SimpleTables(
        spark.createDataFrame([(i,) for i in range(len(seqs))], "seq_index long"),
        spark.createDataFrame([(i, "nuc", p, q) for i, s in enumerate(seqs) for p, q in s[0].items()], "seq_index long, cds string, pos int, qry string"),
        spark.createDataFrame([(i, *s[3]) for i, s in enumerate(seqs) if s[3]], r), spark.createDataFrame([(i, *h) for i, s in enumerate(seqs) for h in s[1]], r),
        spark.createDataFrame([(i, *h) for i, s in enumerate(seqs) for h in s[2]], r), spark.createDataFrame([(v, "nuc", p, q) for v, m in state.items() for p, q in m.items()], "node_id long, cds string, pos int, qry string"),
    )


class SimpleTables:
    def __init__(self, *tables):
        self.seqs, self.subs, self.aligned, self.missing, self.dels, self.states = tables


def plain_distance(own, holes, gone, span, node, masks, size):
    masked = lambda p: any(b <= p < e for b, e in masks)
    own = {p: q for p, q in own.items() if not masked(p)}
    node = {p: q for p, q in node.items() if q != "-" and not masked(p)}
    unknown = {p for b, e in holes + gone for p in range(b, e)} | (set(range(size)) - set(range(*span)) if span else set())
    return len(own) + len(node) - sum(1 + (own[p] == q) for p, q in node.items() if p in own) - len(unknown & set(node))


def test_nearest_nodes_match_all_distances(spark):
    parent, preorder, state, seqs = random_placement(spark, 1)
    nodes, masks, size = frame(spark, parent, preorder), [(0, 2), (35, 40)], 40
    t = tables_of(spark, state, seqs)
    prior = {r.node_id: -10.0 if r.prior is None else r.prior for r in nodes.collect()}
    m = spark.createDataFrame(masks, "begin int, end int")
    got = placement.place(t.seqs, t.subs, t.aligned, t.missing, t.dels, nodes, euler_tour(nodes), t.states, m, size, ties=True)
    got = cut_lineage(got)
    ties = {r.seq_index: (r.distance, r.nodes) for r in tree.nearest_ties(got).collect()}
    for i, s in enumerate(seqs):
        d = {v: plain_distance(*s, state[v], masks, size) for v in parent}
        least = min(d.values())
        assert ties[i] == (least, sorted((v for v in d if d[v] == least), key=lambda v: (-prior[v], preorder[v], v)))
    first = {r.seq_index: (r.distance, r.node_id) for r in tree.nearest_node(got).collect()}
    assert first == {i: (d, v[0]) for i, (d, v) in ties.items()}
    few = t.seqs.where("seq_index < 12")  # with one node for each sequence at once
    one = placement.place(few, *(x.where("seq_index < 12") for x in (t.subs, t.aligned, t.missing, t.dels)), nodes, euler_tour(nodes), t.states, m, size)
    assert {r.seq_index: (r.distance, r.node_id) for r in one.collect()} == {i: first[i] for i in range(12)}


def test_copies_are_one_profile_and_few_pairs_are_looked_at(spark):
    parent, preorder, state, seqs = random_placement(spark, 4, 120, 10)
    t = tables_of(spark, state, [seqs[i % 10] for i in range(1000)])
    masks = spark.createDataFrame([], "begin int, end int")
    nodes = frame(spark, parent, preorder)
    placed = cut_lineage(placement.placed_muts(t.states, masks))
    ranks = cut_lineage(placement.site_ranks(placed, 40))
    of_seq, own = placement.profiles(t.seqs, t.subs, t.aligned, t.missing, t.dels, ranks, masks, 40)
    own = cut_lineage(own)
    assert own.count() == 10 and of_seq.count() == 1000
    found, pairs = placement.search(own, placement.children(nodes, euler_tour(nodes), placed, ranks))
    assert found.select("digest").distinct().count() == 10 and 0 < pairs() < 10 * 120


def test_placement_without_nodes_or_sequences(spark):
    parent, preorder, state, seqs = random_placement(spark, 3, 10, 3)
    t, nodes = tables_of(spark, state, seqs), frame(spark, parent, preorder)
    m, tour = spark.createDataFrame([], "begin int, end int"), euler_tour(nodes)
    none = nodes.limit(0)
    assert placement.place(t.seqs, t.subs, t.aligned, t.missing, t.dels, none, euler_tour(none), t.states.limit(0), m, 40).count() == 0
    assert placement.place(t.seqs.limit(0), t.subs, t.aligned, t.missing, t.dels, nodes, tour, t.states, m, 40).count() == 0


def test_changes_back_in_many_branches_are_not_added_up(spark):
    # 1 has ten changes, and each of its ten children sets another of them back; a plain sequence is nearest to the root
    parent = {0: None, 1: 0} | {v: 1 for v in range(10, 20)} | {v + 10: v for v in range(10, 20)}
    full = {p: "T" for p in range(10)}
    state = {0: {}, 1: full} | {v: {p: q for p, q in full.items() if p != v % 10} for v in range(10, 30)}
    t, nodes = tables_of(spark, state, [({}, [], [], None)] * 3 + [({0: "T", 1: "T", 3: "T"}, [(5, 6)], [(8, 9)], None)]), frame(spark, parent, {v: v for v in parent})
    masks, tour = spark.createDataFrame([], "begin int, end int"), euler_tour(nodes)
    most = {r.node_id: r.most for r in placement.most_below(tour, spark.createDataFrame([(v, 1) for v in range(10, 20)], "node_id long, n long")).collect()}
    assert most == {v: int(v < 2) for v in parent}
    placed = cut_lineage(placement.placed_muts(t.states, masks))
    ranks = cut_lineage(placement.site_ranks(placed, 40))
    own = cut_lineage(placement.profiles(t.seqs.where("seq_index < 3"), t.subs.limit(0), t.aligned, t.missing.limit(0), t.dels.limit(0), ranks, masks, 40)[1])
    found, pairs = placement.search(own, placement.children(nodes, tour, placed, ranks))
    assert [(r.node_id, r.distance) for r in found.collect()] == [(0, 0)] and pairs() == 4
