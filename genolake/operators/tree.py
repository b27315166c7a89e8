"""Joins against the reference tree.

tree_nodes(node_id, parent_id, preorder, clade, prior, div, ...), branch_muts(node_id, cds, pos, ref, qry). A reference
tree has at most some 10^5 nodes whatever the number of sequences; sequences' tables are the large side everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from genolake.operators.muts import compose_muts, inverted, label_mutations
from genolake.operators.placement import NODES, PROFILES, SEQUENCES, distances_in, placed_muts
from genolake.operators.ranges import in_range, is_sequenced, islands
from genolake.operators.tour import last_on_path
from genolake.plans.numbering import numbered
from genolake.plans.scratch import cut_lineage

PLAIN = ("A", "C", "G", "T")


def ancestors(tree_nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance), each node being its own ancestor at 0. By doubling: the number of joins grows
    with the logarithm of the depth. Lineage is cut after each round. A circle of parents is an error."""
    n_nodes = tree_nodes.count()
    up = tree_nodes.select("node_id", "parent_id").where("parent_id is not null")
    out = tree_nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    jump, size = up.select(F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("next_id")), 1
    while True:
        more = out.join(jump, "ancestor_id").select("node_id", F.col("next_id").alias("ancestor_id"), (F.col("distance") + size).alias("distance"))
        out = cut_lineage(out.union(more))
        further = jump.alias("a").join(jump.alias("b"), F.col("a.next_id") == F.col("b.ancestor_id")).select("a.ancestor_id", "b.next_id")
        jump, size = cut_lineage(further), size * 2
        if jump.isEmpty():
            return out
        if size > 2 * max(1, n_nodes):
            raise ValueError("the tree has a circle of parents")


def node_mutations(branch_muts: DataFrame, tour: DataFrame, ref: DataFrame) -> DataFrame:
    """(node_id, cds, pos, qry): the state of each node where it isn't the reference's: the last change on its path.
    ref: (cds, pos, ref)."""
    last = last_on_path(branch_muts.select("node_id", "cds", "pos", "qry"), tour, ["cds", "pos"], "qry")
    return last.join(ref.withColumnRenamed("ref", "_ref"), ["cds", "pos"], "left").where(~F.col("qry").eqNullSafe(F.col("_ref"))).select("node_id", "cds", "pos", "qry")


def validate_tree(branch_muts: DataFrame, tour: DataFrame, ref: DataFrame) -> DataFrame:
    """(node_id, cds, pos, ref, expected, problem) of the branch mutations whose first letter is not the state above (or
    the reference's), or whose place lies outside the reference."""
    last = last_on_path(branch_muts.select("node_id", "cds", "pos", "qry"), tour, ["cds", "pos"], "qry")
    above = tour.select("node_id", "parent_id").join(last.select(F.col("node_id").alias("parent_id"), "cds", "pos", F.col("qry").alias("_above")), "parent_id").drop("parent_id")
    j = branch_muts.join(above, ["node_id", "cds", "pos"], "left").join(ref.withColumnRenamed("ref", "_ref"), ["cds", "pos"], "left")
    j = j.withColumn("expected", F.coalesce("_above", "_ref"))
    problem = F.when(F.col("_ref").isNull(), "outside").when(F.col("ref") != F.col("expected"), "origin")
    return j.withColumn("problem", problem).where("problem is not null").select("node_id", "cds", "pos", "ref", "expected", "problem")


def placement_distance(subs: DataFrame, aligned: DataFrame, missing: DataFrame, dels: DataFrame, node_muts: DataFrame, masks: DataFrame, ref_length: int) -> DataFrame:
    """(seq_index, node_id, distance) for the pairs of a sequence and a node that share a mutated site, or where a node's
    site is undetermined in the sequence; every other pair is at n_node + n_seq. For the nearest nodes see placement.place().

    distance = n_node + n_seq - 2 shared - shared sites - undetermined. Groups of sequences meet groups of nodes, so that no row is
    made of a site of a pair and pairs aren't shuffled: a sequence is sent once for each NODES nodes, a node once for each
    group of sequences, of which there are as many as tasks need, and one for each SEQUENCES at least. aligned, missing,
    dels: (seq_index, begin, end).
    """
    spark, span = subs.sparkSession, ["seq_index", "begin", "end"]
    letter = lambda c: F.shiftleft(F.col("pos").cast("long"), 8) + F.ascii(c)
    nodes = placed_muts(node_muts, masks).groupBy("node_id").agg(F.collect_list(letter("node_qry")).alias("letters"))
    seq = in_range(subs.where("cds = 'nuc'"), masks, [], "left_anti").groupBy("seq_index").agg(F.collect_list(letter("qry")).alias("letters"))
    holes = missing.select(*span).union(dels.select(*span))
    holes = holes.union(aligned.select("seq_index", F.lit(0), F.coalesce("begin", F.lit(ref_length)))).union(aligned.select("seq_index", F.coalesce("end", F.lit(ref_length)), F.lit(ref_length)))
    holes = holes.where("begin < end").groupBy("seq_index").agg(F.flatten(F.collect_list(F.array("begin", "end"))).alias("holes"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    seq = cut_lineage(seq.join(holes, "seq_index", "full_outer").select("seq_index", none("letters", "bigint"), none("holes", "int")))
    nodes = cut_lineage(nodes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    all_seqs, n_node = seq.count(), max(1, -(-nodes.count() // NODES))
    together = min(SEQUENCES, max(PROFILES, all_seqs * n_node // (4 * parts)))
    n_seq = max(1, -(-all_seqs // together))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    id_types = seq.schema["seq_index"].dataType, nodes.schema["node_id"].dataType
    seq = seq.select(F.lit(False).alias("is_node"), "seq_index", F.lit(None).cast(id_types[1]).alias("node_id"), "letters", "holes", dealt("seq_index", n_seq).alias("_s"), every(n_node).alias("_n"))
    nodes = nodes.select(F.lit(True).alias("is_node"), F.lit(None).cast(id_types[0]).alias("seq_index"), "node_id", "letters", F.lit(None).cast("array<int>").alias("holes"), every(n_seq).alias("_s"), dealt("node_id", n_node).alias("_n"))
    out_type = StructType([StructField("seq_index", id_types[0]), StructField("node_id", id_types[1]), StructField("distance", LongType())])
    return seq.unionByName(nodes).repartition(parts, "_s", "_n").groupBy("_s", "_n").applyInArrow(distances_in(to_arrow_schema(out_type)), out_type)


def nearest_node(ranked: DataFrame) -> DataFrame:
    """(seq_index, node_id, distance): least distance, then greatest prior, then first in preorder. A reduction to one row
    for each sequence that is combined before the shuffle."""
    key = F.struct("distance", (-F.col("prior")).alias("p"), "preorder", "node_id")
    return ranked.groupBy("seq_index").agg(F.min(key).alias("k")).select("seq_index", "k.node_id", "k.distance")


def nearest_ties(ranked: DataFrame) -> DataFrame:
    """(seq_index, distance, nodes): all nodes at the least distance, in rank order."""
    least = ranked.groupBy("seq_index").agg(F.min("distance").alias("_d"))
    tied = ranked.join(least, "seq_index").where("distance = _d")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("prior")).alias("p"), "preorder", "node_id")))
    return tied.groupBy("seq_index", "distance").agg(F.transform(ordered, lambda x: x["node_id"]).alias("nodes"))


def private_mutations(subs: DataFrame, dels: DataFrame, targets: DataFrame, node_muts: DataFrame, aligned: DataFrame, unknown: DataFrame, ref: DataFrame, keep_undeletions: bool = False) -> DataFrame:
    """(seq_index, cds, pos, ref, qry, reversion): what sets a sequence apart from its target node.

    subs: (seq_index, cds, pos, qry); dels: points (seq_index, cds, pos); targets: (seq_index, node_id); aligned and
    unknown: ranges (seq_index, cds, begin, end) of what is sequenced, and of missing or ambiguous letters; ref: (cds, pos,
    ref). Equal states vanish; another letter gives node to sequence; a new site reference to sequence; a site changed in
    the node alone is a reversion if it is sequenced. Un-deletions are dropped for nucleotides, kept for amino acids.
    """
    state = subs.select("seq_index", "cds", "pos", "qry").union(dels.select("seq_index", "cds", "pos", F.lit("-").alias("qry")))
    node = targets.join(node_muts.withColumnRenamed("qry", "node_qry"), "node_id").select("seq_index", "cds", "pos", "node_qry")
    j = state.join(node, ["seq_index", "cds", "pos"], "full_outer").join(ref, ["cds", "pos"], "left")
    own = j.where(F.col("qry").isNotNull() & ~F.col("qry").eqNullSafe(F.col("node_qry")))
    own = own.select("seq_index", "cds", "pos", F.coalesce("node_qry", "ref").alias("ref"), "qry", F.lit(False).alias("reversion"))
    back = j.where("qry is null").select("seq_index", "cds", "pos", F.col("node_qry").alias("ref"), F.col("ref").alias("qry"), F.lit(True).alias("reversion"))
    back = is_sequenced(back, aligned, unknown, ["seq_index", "cds"])
    return own.union(back if keep_undeletions else back.where("ref <> '-'"))


def private_summary(private: DataFrame, labels: DataFrame, seqs: DataFrame) -> DataFrame:
    """Counts of a sequence's private nucleotide mutations: substitutions, reversions, labelled, unlabelled, deletions and
    deletion ranges; zeros for sequences without any."""
    nuc = private.where("cds = 'nuc'")
    subs = label_mutations(nuc.where("qry <> '-'"), labels)
    counts = subs.groupBy("seq_index").agg(
        F.count("*").alias("n_subs"), F.count_if("reversion").alias("n_reversions"),
        F.count_if(~F.col("reversion") & F.col("labels").isNotNull()).alias("n_labelled"), F.count_if(~F.col("reversion") & F.col("labels").isNull()).alias("n_unlabelled"),
    )
    gone = islands(nuc.where("qry = '-'"), ["seq_index"]).groupBy("seq_index").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("n_deletions"), F.count("*").alias("n_deletion_ranges"))
    out = seqs.select("seq_index").join(counts, "seq_index", "left").join(gone, "seq_index", "left")
    return out.na.fill(0)


def clade_founder(nearest: DataFrame, tour: DataFrame, tree_nodes: DataFrame, attribute: str = "clade") -> DataFrame:
    """(seq_index, founder_id): the farthest ancestor with the attribute of the nearest node, else the node itself.

    Among the nodes of one attribute, those that lie in no other's range are founders of all in their own range; as ranges
    never cross, a node's founder is the last of these that begins before it. One sort by attribute and place."""
    t = tour.select("node_id", "enter", "exit").join(tree_nodes.select("node_id", F.col(attribute).alias("_a")), "node_id")
    so_far = Window.partitionBy("_a").orderBy("enter")
    covered = F.max("exit").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_outer", F.when(covered.isNull() | (covered <= F.col("enter")), F.col("node_id")))
    founders = t.select("node_id", F.last("_outer", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("founder_id"))
    return nearest.join(founders, "node_id", "left").select("seq_index", F.coalesce("founder_id", "node_id").alias("founder_id"))


def marked_above(tree_nodes: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """(node_id, keys, near, far): for each node and group of keys, the nearest and the farthest of its proper ancestors that
    are in marks(node_id, keys); no row without any. By doubling: in each round a node takes over what the node it points to has
    seen above itself, and points on. Rows: nodes times groups, whatever the depth."""
    groups = marks.select(*keys).distinct()
    marked = marks.select(F.col("node_id").alias("to"), *keys, F.lit(True).alias("is_marked")).distinct()
    at = tree_nodes.select("node_id", F.col("parent_id").alias("to")).crossJoin(F.broadcast(groups)).join(marked, ["to", *keys], "left")
    seen = F.when(F.col("is_marked"), F.col("to"))
    at = cut_lineage(at.select("node_id", *keys, "to", seen.alias("near"), seen.alias("far")))
    while True:
        above = at.select(F.col("node_id").alias("to"), *keys, F.col("to").alias("_to"), F.col("near").alias("_near"), F.col("far").alias("_far"))
        at = cut_lineage(at.join(above, ["to", *keys], "left").select("node_id", *keys, F.col("_to").alias("to"), F.coalesce("near", "_near").alias("near"), F.coalesce("_far", "far").alias("far")))
        if at.where("to is not null").isEmpty():
            return at.where("near is not null").drop("to")


def ancestor_search(nearest: DataFrame, tree_nodes: DataFrame, criteria: DataFrame) -> DataFrame:
    """(seq_index, search, found_id): for each search, the node that the first fitting criterion finds.

    criteria: (search, rank, qry_clade, target_clade, target_name, strategy); a null qry_clade fits any sequence;
    strategy: nearest or earliest ancestor (never the node itself), or first in preorder of the whole tree. The criteria are a
    few rows of a configuration.
    """
    # what a criterion asks of the sequence: its clade, or nothing; as keys of an equal join
    about = tree_nodes.select("node_id", F.explode(F.array(F.concat(F.lit("c"), "clade"), F.lit("any"))).alias("asked")).where("asked is not null")
    asked = F.coalesce(F.concat(F.lit("c"), "qry_clade"), F.lit("any")).alias("asked")
    node = tree_nodes.select(F.col("node_id").alias("found_id"), F.col("clade").alias("_c"), F.col("name").alias("_n"), "preorder")
    cols = ["search", "rank", asked, "strategy", "found_id", "preorder"]
    by_name = criteria.join(node, F.col("_n") == F.col("target_name")).select(*cols)
    wanted = by_name.union(criteria.join(node, F.col("_c") == F.col("target_clade")).select(*cols)).distinct()
    keys = ["search", "rank", "asked", "strategy"]
    above = marked_above(tree_nodes, wanted.where("strategy <> 'first'").select(F.col("found_id").alias("node_id"), *keys), keys)
    on_path = above.join(about, ["node_id", "asked"]).select("node_id", "search", "rank", F.when(F.col("strategy") == "nearest", F.col("near")).otherwise(F.col("far")).alias("found_id"))
    first = wanted.where("strategy = 'first'").groupBy("search", "rank", "asked").agg(F.min_by("found_id", "preorder").alias("found_id"))
    options = on_path.union(first.join(about, "asked").select("node_id", "search", "rank", "found_id"))
    best = options.groupBy("node_id", "search").agg(F.min(F.struct("rank", "found_id")).alias("b"))
    return nearest.select("seq_index", "node_id").join(best, "node_id").select("seq_index", "search", "b.found_id")


def relative_mutations(subs: DataFrame, dels: DataFrame, targets: DataFrame, node_muts: DataFrame, aligned: DataFrame, unknown: DataFrame, ref: DataFrame) -> DataFrame:
    """Private mutations against any node: targets may hold several kinds (seq_index, ref_kind, node_id); one pass for all."""
    key = F.concat_ws("|", F.col("seq_index").cast("string"), "ref_kind")
    kinds = targets.select("seq_index", "ref_kind", "node_id", key.alias("_k"))
    spread = lambda t: t.join(kinds.select("seq_index", "_k"), "seq_index").drop("seq_index").withColumnRenamed("_k", "seq_index")
    out = private_mutations(spread(subs), spread(dels), kinds.select(F.col("_k").alias("seq_index"), "node_id"), node_muts, spread(aligned), spread(unknown), ref)
    parts = F.split("seq_index", r"\|")
    return out.select(parts[0].cast("long").alias("seq_index"), parts[1].alias("ref_kind"), "cds", "pos", "ref", "qry", "reversion")


def counted(muts: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_masked, n_other): plain mutations outside masks, inside masks, and those with other letters."""
    plain = F.col("ref").isin(*PLAIN) & F.col("qry").isin(*PLAIN)
    masked = in_range(muts.select("pos").distinct(), masks, []).withColumn("_m", F.lit(True))
    j = muts.join(masked, "pos", "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    return j.groupBy(*keys).agg(F.count_if(plain & ~F.col("_m")).alias("n"), F.count_if(plain & F.col("_m")).alias("n_masked"), F.count_if(~plain).alias("n_other"))


def branch_length(n: Column, n_masked: Column, n_other: Column, per_site: int | None = None) -> Column:
    size = F.when((n == 0) & (n_masked + n_other > 0), 0.06).otherwise(n.cast("double"))
    return size / per_site if per_site else size


def divergence(private: DataFrame, nearest: DataFrame, tree_nodes: DataFrame, masks: DataFrame, per_site: int | None = None) -> DataFrame:
    """(seq_index, divergence): that of the node plus the branch to the sequence."""
    c = counted(private.where("cds = 'nuc'"), masks, ["seq_index"])
    j = nearest.select("seq_index", "node_id").join(tree_nodes.select("node_id", "div"), "node_id").join(c, "seq_index", "left").na.fill(0, ["n", "n_masked", "n_other"])
    return j.select("seq_index", (F.col("div") + branch_length(F.col("n"), F.col("n_masked"), F.col("n_other"), per_site)).alias("divergence"))


def branch_score(muts: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): unmasked count, plus 0.5 if any is masked, plus 0.1 if any has another letter."""
    c = counted(muts, masks, keys)
    return c.select(*keys, (F.col("n") + F.when(F.col("n_masked") > 0, 0.5).otherwise(0.0) + F.when(F.col("n_other") > 0, 0.1).otherwise(0.0)).alias("score"))


def refine_placement(private: DataFrame, nearest: DataFrame, tree_nodes: DataFrame, branch_muts: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks all sequences through the tree at once until none moves: (placements, private mutations there).

    In each round a sequence compares the score of what its private mutations share with its own branch (reversed) and
    with each child's branch. A child that scores more than the own branch wins, ties by preorder. Else the sequence moves
    to the parent if it reverts the whole own branch (an empty one too). Private mutations are then rewritten for the new
    node; one that doesn't follow the branch's letters is an error (validate_tree() finds such branches). Lineage is cut after each round.
    """
    key, site = ["seq_index"], ["cds", "pos", "ref", "qry"]
    muts = branch_muts.select("node_id", *site)
    edges = tree_nodes.where("parent_id is not null").select("node_id", "parent_id", "preorder")
    down = edges.join(muts, "node_id").select(F.col("parent_id").alias("at"), F.col("node_id").alias("to"), "preorder", *site, F.lit(0).alias("up"))
    back = edges.join(inverted(muts), "node_id").select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"), F.lit(-1).alias("preorder"), *site, F.lit(1).alias("up"))
    steps = cut_lineage(down.union(back))
    own = back.where("cds = 'nuc'").groupBy("at").agg(F.count("*").alias("n_own"))
    parents = edges.select(F.col("node_id").alias("at"), F.col("parent_id").alias("parent")).join(own, "at", "left").na.fill(0, ["n_own"])
    parents = cut_lineage(parents)
    place, priv = nearest.select("seq_index", F.col("node_id").alias("at")), private.select("seq_index", *site)
    going = place
    while True:
        shared = going.join(priv.where("cds = 'nuc'"), "seq_index").join(steps, ["at", *site])
        by = ["seq_index", "at", "to", "up", "preorder"]
        scores = branch_score(shared.select(*by, *site), masks, by).join(shared.groupBy(*by).agg(F.count("*").alias("n")), by)
        child = F.min(F.when(F.col("up") == 0, F.struct((-F.col("score")).alias("s"), "preorder", "to")))
        best = scores.groupBy("seq_index").agg(child.alias("c"), F.max(F.when(F.col("up") == 1, F.col("score"))).alias("s_own"), F.max(F.when(F.col("up") == 1, F.col("n"))).alias("n"))
        j = going.join(best, "seq_index", "left").join(parents, "at", "left")
        better = -F.col("c.s") > F.coalesce("s_own", F.lit(0.0))
        to = F.when(F.coalesce(better, F.lit(False)), F.col("c.to")).when(F.coalesce("n", F.lit(0)) == F.col("n_own"), F.col("parent"))
        moves = cut_lineage(j.select("seq_index", "at", to.alias("to"), F.when(F.coalesce(better, F.lit(False)), 0).otherwise(1).alias("up")).where("to is not null"))
        if moves.isEmpty():
            break
        change = moves.join(steps, ["at", "to", "up"]).select("seq_index", *site)
        theirs = priv.join(moves.select("seq_index"), "seq_index", "left_semi")
        kept = theirs.join(change, [*key, *site], "left_anti")
        rest = inverted(change.join(theirs, [*key, *site], "left_anti"))
        broken = F.raise_error(F.concat(F.lit("mutations don't follow one another at "), "cds", F.lit(":"), F.col("pos") + 1))
        rewritten = compose_muts(kept, rest, key).withColumn("qry", F.when(F.col("valid"), F.col("qry")).otherwise(broken)).drop("valid")
        priv = cut_lineage(priv.join(moves.select("seq_index"), "seq_index", "left_anti").unionByName(rewritten))
        place = cut_lineage(place.join(moves.select("seq_index", "to"), "seq_index", "left").select("seq_index", F.coalesce("to", "at").alias("at")))
        going = place.join(moves.select("seq_index"), "seq_index", "left_semi")
    return place.withColumnRenamed("at", "node_id"), priv


def attach_nodes(place: DataFrame, private: DataFrame, divergences: DataFrame, tree_nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """New leaves: (seq_index, parent_id, muts, div, clade, ..., rank). muts: text by CDS in order of position; rank: by
    number of private mutations, then input order."""
    text = F.concat("ref", (F.col("pos") + 1).cast("string"), "qry")
    by_cds = private.groupBy("seq_index", "cds").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), ",").alias("t"), F.count("*").alias("n"))
    muts = by_cds.groupBy("seq_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cds", "t")))).alias("muts"), F.sum("n").alias("n_private"))
    j = place.join(tree_nodes.select("node_id", "clade"), "node_id", "left").join(muts, "seq_index", "left").join(divergences, "seq_index", "left").join(attributes, "seq_index", "left")
    out = j.select("seq_index", F.col("node_id").alias("parent_id"), "muts", F.coalesce("n_private", F.lit(0)).alias("n_private"), F.col("divergence").alias("div"), "clade", *[c for c in attributes.columns if c != "seq_index"])
    return numbered(out.orderBy("n_private", "seq_index"), "rank")


def ladderize(tree_nodes: DataFrame, tour: DataFrame) -> DataFrame:
    """(node_id, parent_id, leaves, child_no): children in order of the number of leaves below, then preorder."""
    w = Window.partitionBy("parent_id").orderBy("leaves", "preorder")
    return tree_nodes.join(tour.select("node_id", "leaves"), "node_id").select("node_id", "parent_id", "leaves", F.row_number().over(w).alias("child_no"))
