"""The nearest nodes of the reference tree, by a search down the tree that leaves out subtrees which can't hold any.

Sequences that the tree can't tell apart are one profile, and only profiles are placed. A profile first dives from the root along
the best children, which bounds its distance from above. Then all children of a frontier are reached from their parents: the
distance changes by the few sites that differ between both, so no sequence meets the whole state of a node. A subtree is left
out when what it can't win back is over the bound already. Blocks of some levels of the tree are shuffled to groups of
profiles, and a group takes each level in array steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from genolake.operators.ranges import in_range
from genolake.plans.scratch import cut_lineage

#: Children of a node that stand in one row; a node with more has several rows.
TOGETHER = 64
#: Levels of the tree in a block; profiles that meet a block in a group; pairs of a profile and a node in one array step.
BAND, PROFILES, PAIRS = 8, 2048, 1 << 20
#: Groups that one task of the search takes on average, at most.
GROUPS = 64
#: Where all pairs are listed: sequences and nodes that meet in a group at most; nodes that meet PROFILES of its sequences in an array step.
SEQUENCES, NODES, STEP = 1 << 17, 1 << 14, 1024


def placed_muts(node_muts: DataFrame, masks: DataFrame) -> DataFrame:
    """(node_id, pos, node_qry) that count for placement: nucleotides, no deletions, outside the masks. A masked site would
    count as undetermined for every sequence, so leaving it out on both sides gives the same distances."""
    nuc = node_muts.where("cds = 'nuc' and qry <> '-'").select("node_id", "pos", F.col("qry").alias("node_qry"))
    return in_range(nuc, masks, [], "left_anti")


def distances_in(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distances of the sequences and nodes of a group, for pairs with anything in common. Rows: (is_node, seq_index, node_id,
    letters, holes), a letter being place << 8 | code, holes begins and ends by turns. A group is held as it is sent; its pairs are
    made and told by PROFILES sequences and STEP nodes.

    What each letter of a node takes off each sequence is a row of a table, and a node adds up the rows of its letters; nodes
    are taken by so many letters that the table stays small."""

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(lists.chunks)
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def counts(keys: np.ndarray, found: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
        """How often each owner has each of the sorted keys."""
        at = np.searchsorted(keys, found)
        here = np.append(keys, -1)[at] == found
        return np.bincount(at[here] * width + owner[here], minlength=len(keys) * width).reshape(len(keys), width).astype(np.int32)

    def pairs(seqs: pa.Table, nodes: pa.Table) -> Iterator[pa.RecordBatch]:
        n, (n_seq, code), (n_holes, ends), (n_node, node_code) = seqs.num_rows, flat(seqs["letters"]), flat(seqs["holes"]), flat(nodes["letters"])
        owner, hole = np.repeat(np.arange(n), n_seq), np.repeat(np.arange(n), n_holes // 2)
        pos, begin, end, last = code >> 8, ends[::2], ends[1::2], np.cumsum(n_node)
        seq_ids, node_ids = seqs["seq_index"].combine_chunks(), nodes["node_id"].combine_chunks()
        for piece in np.split(np.arange(len(n_node)), np.flatnonzero(np.diff(last // max(1, 8 * PAIRS // n))) + 1):
            begin_at, first = last[piece[0]] - n_node[piece[0]], last[piece] - n_node[piece]
            letters, row = np.unique(node_code[begin_at : last[piece[-1]]], return_inverse=True)
            sites, site = np.unique(letters >> 8, return_inverse=True)
            edges = np.zeros((len(sites) + 1, n), np.int32)
            np.add.at(edges, (np.searchsorted(sites, begin), hole), 1)
            np.add.at(edges, (np.searchsorted(sites, end), hole), -1)
            at_site = counts(sites, pos, owner, n) + (np.cumsum(edges[:-1], axis=0, dtype=np.int32) > 0)
            off = at_site[site] + counts(letters, code, owner, n)
            less = np.stack([off[row[a:b]].sum(0, dtype=np.int32) for a, b in zip(first - begin_at, last[piece] - begin_at, strict=True)])
            i, j = np.nonzero(less)
            distance = n_node[piece[i]] + n_seq[j] - less[i, j]
            yield pa.RecordBatch.from_arrays([seq_ids.take(pa.array(j)), node_ids.take(pa.array(piece[i])), pa.array(distance)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        seqs, nodes = rows.filter(pc.invert(rows["is_node"])), rows.filter(rows["is_node"])
        for s in range(0, seqs.num_rows, PROFILES):
            for n in range(0, nodes.num_rows, STEP):
                yield from pairs(seqs.slice(s, PROFILES), nodes.slice(n, STEP))

    return run


def site_ranks(placed: DataFrame, ref_length: int) -> DataFrame:
    """(p, k, is_site): for each place of the reference and the one after its end, how many sites of the tree lie before it.
    A row a reference base, whatever the number of sequences and nodes."""
    sites = placed.select(F.col("pos").alias("p"), F.lit(1).alias("s")).distinct()
    places = placed.sparkSession.range(ref_length + 1).select(F.col("id").cast("int").alias("p")).join(sites, "p", "left").na.fill(0, ["s"])
    before = F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    return places.select("p", F.coalesce(before, F.lit(0)).cast("int").alias("k"), (F.col("s") == 1).alias("is_site"))


def merged(ranges: Column) -> Column:
    """Sorted ranges (b, e) as disjoint ones with gaps between."""

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["b"].alias("b"), F.greatest(last["e"], r["e"]).alias("e"))))
        return F.when((F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["e"] < r["b"]), F.concat(done, F.array(r))).otherwise(longer)

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<b:int,e:int>>"), add)


def in_ranges(k: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["b"] <= k) & (k < r["e"]))


def profiles(seqs: DataFrame, subs: DataFrame, aligned: DataFrame, missing: DataFrame, dels: DataFrame, ranks: DataFrame, masks: DataFrame, ref_length: int) -> tuple[DataFrame, DataFrame]:
    """((seq_index, digest, others), (digest, muts, unknown, v)): what the tree can tell of each sequence.

    muts: its letters at sites of the tree, by number of the site; unknown: ranges of such sites that are missing, deleted or not
    aligned; others: its number of mutations elsewhere, which add to every distance alike; v: how many of muts are unknown. The
    digest (128 bits) of both sorted lists is the profile's name.
    """
    seq = in_range(subs.where("cds = 'nuc'"), masks, [], "left_anti").select("seq_index", "pos", "qry")
    at = seq.join(ranks, F.col("pos") == F.col("p"), "left").withColumn("is_site", F.coalesce("is_site", F.lit(False)))
    letters = at.groupBy("seq_index").agg(F.array_sort(F.collect_list(F.when(F.col("is_site"), F.struct("k", "qry")))).alias("muts"), F.count_if(~F.col("is_site")).alias("others"))
    span = ["seq_index", "begin", "end"]
    holes = missing.select(*span).union(dels.select(*span))
    holes = holes.union(aligned.select("seq_index", F.lit(0), F.coalesce("begin", F.lit(ref_length)))).union(aligned.select("seq_index", F.coalesce("end", F.lit(ref_length)), F.lit(ref_length)))
    inside = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(ref_length))
    holes = holes.where("begin < end").select("seq_index", inside("begin").alias("begin"), inside("end").alias("end"))
    first, last = ranks.select(F.col("p").alias("begin"), F.col("k").alias("b")), ranks.select(F.col("p").alias("end"), F.col("k").alias("e"))
    holes = holes.join(first, "begin").join(last, "end").where("b < e").groupBy("seq_index").agg(F.collect_list(F.struct("b", "e")).alias("r"))
    none = F.array().cast("array<struct<b:int,e:int>>")
    each = seqs.select("seq_index").join(letters, "seq_index", "left").join(holes, "seq_index", "left").select(
        "seq_index", F.coalesce("muts", F.array().cast("array<struct<k:int,qry:string>>")).alias("muts"), F.coalesce("others", F.lit(0)).alias("others"), merged(F.coalesce("r", none)).alias("unknown")
    )
    each = cut_lineage(each.withColumn("digest", F.md5(F.to_json(F.struct("muts", "unknown")))))
    own = each.groupBy("digest").agg(F.first("muts").alias("muts"), F.first("unknown").alias("unknown"))
    v = F.size(F.filter("muts", lambda m: in_ranges(m["k"], F.col("unknown"))))
    return each.select("seq_index", "digest", "others"), own.select("digest", F.transform("muts", lambda m: F.struct(m["k"].alias("k"), F.ascii(m["qry"]).alias("qry"))).alias("letters"), "unknown", v.alias("v"))


def bands(tour: DataFrame) -> DataFrame:
    """(node_id, band): the last node on the path to each node (itself included) at which a new block of the tree begins: one in
    BAND levels. Null: the block above the roots. By doubling."""
    at = tour.select("node_id", F.when((F.col("depth") + 1) % BAND == 0, F.col("node_id")).otherwise(F.col("parent_id")).alias("band"))
    for _ in range((BAND - 1).bit_length()):
        up = at.select(F.col("node_id").alias("_n"), F.col("band").alias("_b"))
        at = cut_lineage(at.join(up, F.col("band") == F.col("_n"), "left").select("node_id", F.col("_b").alias("band")))
    return at


def most_below(tour: DataFrame, gains: DataFrame) -> DataFrame:
    """(node_id, most): the greatest sum of gains(node_id, n) on a path down from the node, its own left out. By doubling: in
    each round paths are twice as long, so rounds grow with the logarithm of the depth and rows with the nodes."""
    at = tour.join(gains, "node_id", "left").select("node_id", F.col("parent_id").alias("to"), F.coalesce("n", F.lit(0)).cast("int").alias("n"), F.lit(0).alias("most"))
    at, reach, depth = cut_lineage(at), 1, (tour.agg(F.max("depth")).first()[0] or 0) + 1
    while reach < depth:
        below = at.where("to is not null").groupBy(F.col("to").alias("_to")).agg(F.max(F.col("n") + F.col("most")).alias("_most"))
        up = at.select(F.col("node_id").alias("_n"), F.col("to").alias("_up"), F.col("n").alias("_sum"))
        j = at.join(below, F.col("node_id") == F.col("_to"), "left").join(up, F.col("to") == F.col("_n"), "left")
        at, reach = cut_lineage(j.select("node_id", F.col("_up").alias("to"), (F.col("n") + F.coalesce("_sum", F.lit(0))).alias("n"), F.greatest("most", F.coalesce("_most", F.lit(0))).alias("most"))), 2 * reach
    return at.select("node_id", "most")


def children(tree_nodes: DataFrame, tour: DataFrame, placed: DataFrame, ranks: DataFrame) -> DataFrame:
    """(block, parent, kids): for each node (null: above the roots) its children, at most TOGETHER a row; a kid has node_id,
    steps (k, was, now: sites that differ from the parent's, letters by their code; 0 is the reference), regain, inner, less and
    preorder. block: the node at which the block of the tree begins that parent lies in, as text ("" above the roots).

    regain bounds what a subtree can win back at sites where a node is mutated and a sequence is not: the most sites that
    one path down sets back to the reference.
    """
    sites = ranks.where("is_site").select(F.col("p").alias("pos"), "k")
    state = placed.join(sites, "pos").select("node_id", "k", F.ascii("node_qry").alias("now"))
    above = tree_nodes.select("node_id", F.col("parent_id").alias("_p")).join(state.select(F.col("node_id").alias("_p"), "k", F.col("now").alias("was")), "_p").drop("_p")
    differ = cut_lineage(state.join(above, ["node_id", "k"], "full_outer").where(~F.col("now").eqNullSafe(F.col("was"))).na.fill(0, ["was", "now"]))
    regain = most_below(tour, differ.where("now = 0").groupBy("node_id").agg(F.count("*").alias("n")))
    steps = differ.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("k", "was", "now"))).alias("steps"))
    each = tree_nodes.join(steps, "node_id", "left").join(regain, "node_id", "left").join(tour.select("node_id", (F.col("exit") - F.col("enter") > 1).alias("inner")), "node_id")
    each = each.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("parent_id").orderBy("preorder", "node_id")) - 1) / TOGETHER))
    kid = F.struct(
        "node_id", F.coalesce("steps", F.array().cast("array<struct<k:int,was:int,now:int>>")).alias("steps"), F.coalesce("most", F.lit(0)).alias("regain"),
        "inner", (-F.coalesce("prior", F.lit(-10.0))).alias("less"), F.col("preorder").cast("int").alias("preorder"),
    )
    rows = each.groupBy(F.col("parent_id").alias("parent"), "part").agg(F.collect_list(kid).alias("kids")).drop("part")
    in_block = rows.join(bands(tour).withColumnRenamed("node_id", "parent"), "parent", "left")
    return cut_lineage(in_block.select(F.coalesce(F.col("band").cast("string"), F.lit("")).alias("block"), "parent", "kids"))


def runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, number) of the numbers starts[i], starts[i] + 1, .. of runs of counts[i] numbers each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts) - counts - starts)[which]


class Block:
    """A block of the tree as arrays: rows (parent, kids) of children()."""

    def __init__(self, rows: pa.Table):
        parent = rows["parent"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = parent.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        lists = rows["kids"].combine_chunks().take(pa.array(order))
        owner = np.repeat(code[order], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.parents, kids = parent.dictionary, lists.flatten()
        self.first, self.n_kids = np.searchsorted(owner, np.arange(len(self.parents))), np.bincount(owner, minlength=len(self.parents))
        field = lambda x, name: pc.struct_field(x, name).to_numpy(zero_copy_only=False)
        self.node_id, self.regain, self.inner, self.less, self.preorder = pc.struct_field(kids, "node_id"), *(field(kids, c) for c in ("regain", "inner", "less", "preorder"))
        self.inner = self.inner.astype(bool)
        self.as_parent = self.at(self.node_id)
        steps = pc.struct_field(kids, "steps")
        self.n_steps = pc.list_value_length(steps).to_numpy(zero_copy_only=False)
        self.first_step, steps = np.cumsum(self.n_steps) - self.n_steps, steps.flatten()
        self.sites, self.k = np.unique(field(steps, "k"), return_inverse=True)
        self.was, self.now = field(steps, "was"), field(steps, "now")

    def at(self, node_ids: pa.Array) -> np.ndarray:
        """Numbers of the parents that these nodes are; -1: none here."""
        return pc.fill_null(pc.index_in(node_ids, value_set=self.parents), -1).to_numpy(zero_copy_only=False)


def letters_at(rows: pa.Table, sites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter, unknown) of each profile at each of some sites; letter 0: the reference's."""
    lists = rows["letters"].combine_chunks()
    which = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    k, qry = (pc.struct_field(lists.flatten(), c).to_numpy(zero_copy_only=False) for c in ("k", "qry"))
    letter = np.zeros((len(lists), len(sites) + 1), np.int8)
    at = np.searchsorted(sites, k)
    here = np.append(sites, -1)[at] == k
    letter[which[here], at[here]] = qry[here]
    lists = rows["unknown"].combine_chunks()
    which = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    edges = np.zeros((len(lists), len(sites) + 1), np.int8)
    for c, sign in (("b", 1), ("e", -1)):
        np.add.at(edges, (which, np.searchsorted(sites, pc.struct_field(lists.flatten(), c).to_numpy(zero_copy_only=False))), np.int8(sign))
    return letter, np.cumsum(edges, axis=1, dtype=np.int8) > 0


def in_block(dive: bool, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search of some profiles, each from one node, in one block of the tree, level by level.

    A site costs 1 where only the sequence is mutated; where the node is, 1, less 1 if it is undetermined and less 1 if the
    sequence has the same letter. mismatch: the part of sites where the sequence is not mutated. No node of a subtree is nearer
    than mismatch - regain - v, as all other sites cost 0 at best (-1 where undetermined). A dive follows the best child alone
    and tells the bound; else all nodes within the bound are told. `on`: the search goes on below, in another block. A row
    without a digest tells the number of pairs looked at.
    """

    def run(rows: pa.Table, tree: pa.Table) -> pa.Table:
        if not rows.num_rows or not tree.num_rows:
            return schema.empty_table()
        block, looked = Block(tree), 0
        letter, unknown = letters_at(rows, block.sites)
        number = lambda c: rows[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        v, best = number("v"), number("bound").copy()
        front = np.arange(len(v)), block.at(rows["at"].combine_chunks()), number("distance"), number("mismatch")
        told: list[tuple[np.ndarray, ...]] = []
        while len(front[0]):
            onward = []
            size = np.cumsum(block.n_kids[front[1]]) // PAIRS
            for piece in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size)) + 1):
                p, par, d, x = (c[piece] for c in front)
                i, kid = runs(block.first[par], block.n_kids[par])
                j, step = runs(block.first_step[kid], block.n_steps[kid])
                p, d, x, looked = p[i], d[i], x[i], looked + len(kid)
                m, u = (a[p[j], block.k[step]] for a in (letter, unknown))
                own = (m != 0).astype(np.int64)
                cost = lambda now: np.where(now == 0, own, 1 - u.astype(np.int64) - (m == now))  # noqa: B023, E731
                change = cost(block.now[step]) - cost(block.was[step])
                d = d + np.bincount(j, change, len(kid)).astype(np.int64)
                x = x + np.bincount(j, change * (m == 0), len(kid)).astype(np.int64)
                np.minimum.at(best, p, d)
                least = x - v[p] - block.regain[kid]
                keep = block.inner[kid] & (least <= best[p])
                if dive:
                    order = np.lexsort((block.preorder[kid], block.less[kid], d, p))
                    chosen = np.zeros(len(kid), bool)
                    chosen[order[np.diff(p[order], prepend=-1) != 0]] = True
                    keep &= chosen
                elif (near := keep & (block.as_parent[kid] < 0) | (d <= best[p])).any():
                    told.append((p[near], kid[near], d[near], x[near], least[near]))
                if dive and (out := keep & (block.as_parent[kid] < 0)).any():
                    told.append((p[out], kid[out], d[out], x[out], least[out]))
                inside = keep & (block.as_parent[kid] >= 0)
                onward.append((p[inside], block.as_parent[kid[inside]], d[inside], x[inside]))
            front = tuple(np.concatenate(c) for c in zip(*onward, strict=True))
        p, kid, d, x, least = (np.concatenate(c) for c in zip(*told, strict=True)) if told else [np.zeros(0, np.int64)] * 5
        on = block.inner[kid] & (block.as_parent[kid] < 0) & (least <= best[p])
        told_now = on if dive else on | (d <= best[p])
        p, kid, d, x, on = (c[told_now] for c in (p, kid, d, x, on))
        n, digest = len(p), rows["digest"].combine_chunks()
        bounds = np.arange(len(v)) if dive else np.zeros(0, np.int64)  # a row for the bound of each
        rest = len(bounds) + 1
        none = lambda kind: pa.nulls(rest, kind)
        columns = {
            "digest": pa.concat_arrays([digest.take(pa.array(np.concatenate([p, bounds]))), pa.nulls(1, digest.type)]),
            "node_id": pa.concat_arrays([block.node_id.take(pa.array(kid)), none(block.node_id.type)]),
            "distance": pa.concat_arrays([pa.array(d, pa.int32()), none(pa.int32())]),
            "less": pa.concat_arrays([pa.array(block.less[kid], pa.float64()), none(pa.float64())]),
            "preorder": pa.concat_arrays([pa.array(block.preorder[kid], pa.int32()), none(pa.int32())]),
            "mismatch": pa.concat_arrays([pa.array(x, pa.int32()), none(pa.int32())]),
            "on": pa.array(np.concatenate([on, np.zeros(rest, bool)])),
            "bound": pa.array(np.concatenate([best[p], best[bounds], [0]]), pa.int32()),
            "looked": pa.array(np.concatenate([np.zeros(n + rest - 1, np.int64), [looked]])),
        }
        return pa.table(columns).cast(schema)

    return run


def search(own: DataFrame, kids: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """((digest, node_id, distance, less, preorder) of all nodes at the least distance of each profile; a function that counts
    the pairs of a profile and a node whose distance was computed). Two passes by blocks of BAND levels: at most PROFILES
    profiles and one block of the tree meet in a group. Lineage is cut at each round."""
    spark = own.sparkSession
    id_type = kids.schema["parent"].dataType
    kinds = {"digest": StringType(), "node_id": id_type, "distance": IntegerType(), "less": DoubleType(), "preorder": IntegerType(), "mismatch": IntegerType(), "on": BooleanType(), "bound": IntegerType(), "looked": LongType()}
    out_type = StructType([StructField(c, k) for c, k in kinds.items()])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    about, done = ["digest", "letters", "unknown", "v"], []

    def rounds(level: DataFrame, dive: bool) -> list[DataFrame]:
        """Levels until none goes on. level: about, block, at, distance, mismatch, bound."""
        outs = []
        while True:
            salts = cut_lineage(level.groupBy("block").agg(F.ceil(F.count("*") / PROFILES).cast("int").alias("salts")))
            n = max(parts, -(-(salts.agg(F.sum("salts")).first()[0] or 0) // GROUPS))  # so that a task's rows don't grow with the table
            rows = level.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("digest"), "salts").cast("int")).drop("salts")
            tree = kids.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
            groups = [x.repartition(n, "block", "salt").groupBy("block", "salt") for x in (rows, tree)]
            out = cut_lineage(groups[0].cogroup(groups[1]).applyInArrow(in_block(dive, to_arrow_schema(out_type)), out_type))
            outs.append(out)
            on = out.where("on")
            if on.isEmpty():
                return outs
            bound = reduce(DataFrame.union, outs).where("digest is not null").groupBy("digest").agg(F.min("bound").alias("bound"))
            on = on.select("digest", F.col("node_id").alias("at"), F.col("node_id").cast("string").alias("block"), "distance", "mismatch").join(bound, "digest")
            level = own.select(*about).join(on, "digest")

    top = own.select(*about, F.lit("").alias("block"), F.lit(None).cast(id_type).alias("at"), F.size("letters").alias("distance"), F.lit(0).alias("mismatch"))
    dives = rounds(top.withColumn("bound", F.lit(1 << 30)), True)
    bounds = reduce(DataFrame.union, dives).where("digest is not null").groupBy("digest").agg(F.min("bound").alias("bound"))
    passes = rounds(top.join(bounds, "digest"), False)
    done = [*dives, *passes]
    found = reduce(DataFrame.union, passes).where("node_id is not null")
    least = found.groupBy("digest").agg(F.min("distance").alias("_least"))
    best = found.join(least, "digest").where(F.col("distance") == F.col("_least"))
    return best.select("digest", "node_id", "distance", "less", "preorder"), lambda: reduce(DataFrame.union, done).agg(F.sum("looked")).first()[0] or 0


def place(seqs: DataFrame, subs: DataFrame, aligned: DataFrame, missing: DataFrame, dels: DataFrame, tree_nodes: DataFrame, tour: DataFrame, node_muts: DataFrame, masks: DataFrame, ref_length: int, ties: bool = False) -> DataFrame:
    """(seq_index, node_id, distance, prior, preorder): the nearest node of each of seqs, of equally near ones that of the
    greatest prior, then the first in preorder; with `ties` all of the nearest. Distances are those of placement_distance().
    tour: that of euler_tour(tree_nodes).     Without any node there is no row."""
    placed = cut_lineage(placed_muts(node_muts, masks))
    ranks = cut_lineage(site_ranks(placed, ref_length))
    of_seq, own = profiles(seqs, subs, aligned, missing, dels, ranks, masks, ref_length)
    found, _ = search(cut_lineage(own), children(tree_nodes, tour, placed, ranks))
    if not ties:
        best = found.groupBy("digest").agg(F.min(F.struct("less", "preorder", "node_id", "distance")).alias("b"))
        found = best.select("digest", "b.*")
    out = of_seq.join(cut_lineage(found), "digest")
    return out.select("seq_index", "node_id", (F.col("distance") + F.col("others")).cast("long").alias("distance"), (-F.col("less")).alias("prior"), "preorder")
