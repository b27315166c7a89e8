"""Operator 4: near-duplicate vectors by spherical-cap filters with list-decoded random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm.common import Scratch, components, table

COSINE = 0.95
#: Vectors expected behind a filter, whatever the table's size.
BUCKET = 200
#: Independent rotations, each with a code of its own; a vector takes at least its best FLOOR filters of each. So every
#: vector has filters, and misses of one rotation are not misses of the next. In a cone (see centres()) linked vectors are less
#: alike once the centre is taken out, so there are more rotations, of as many more filters: the same number of pairs, better
#: spread. (least cosine that remains, rotations)
ROTATIONS, FLOOR = ((0.94, 4), (0.9, 6), (0.8, 10), (0.65, 16)), 2
#: Vectors of one length from which on their centre is looked for.
CENTRED = 1000
#: A vector passes a filter if it comes this near to its best one of the rotation.
NEAR_BEST = 0.98
HOT_ROWS = 2000
BLOCK_ROWS = 1000
#: Comparisons of filters that are held in memory at once.
COMPARED = 2_000_000


class Caps:
    """Filter directions are all ways to put one code word of each block side by side, after a random rotation. There are
    so many of them that one holds about BUCKET of n random vectors; words a block follow from that, and the number of blocks
    keeps a block's words below 64, so that scoring all words costs far less than scoring all filters."""

    def __init__(self, n: float, dim: int, rotation: int, seed: int = 11):
        filters = max(4, FLOOR * n / BUCKET)
        blocks = min(dim, max(2, math.ceil(math.log(filters, 64))))
        words = max(2, math.ceil(filters ** (1 / blocks)))
        rng = np.random.default_rng([seed, dim, rotation])
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        edges = np.linspace(0, dim, blocks + 1).astype(int)
        self.codes, self.first = [], rotation << 56
        for a, b in zip(edges, edges[1:], strict=False):
            c = rng.standard_normal((words, b - a))
            self.codes.append((turn[:, a:b] @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T) / math.sqrt(blocks))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, filter) for each filter that a row exceeds: its own bar is NEAR_BEST of its best filter's score, or
        its FLOOR-th best score where that is lower. Part sums that can't reach the bar any more, even with the best words of
        the blocks to come, are dropped block by block."""
        scores = [x @ c for c in self.codes]
        best = [s.max(1) for s in scores]
        # the second best filter of a row changes the one word whose second choice costs least
        loss = np.min([b - np.partition(s, -2, 1)[:, -2] for b, s in zip(best, scores, strict=True)], 0)
        top = np.sum(best, 0)
        bar = np.minimum(NEAR_BEST * top, top - loss if FLOOR > 1 else top) - 1e-12
        row, total, code = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for k, s in enumerate(scores):
            rest = sum((b[row] for b in best[k + 1 :]), np.zeros(len(row)))
            sums = total[:, None] + s[row]
            at, word = np.nonzero(sums + rest[:, None] >= bar[row][:, None])
            row, total, code = row[at], sums[at, word], code[at] * s.shape[1] + word
        return row, code + self.first


class Rotations:
    """The filters of all rotations, for unit vectors of one dimension, coded by what remains of them without the centre."""

    def __init__(self, n: int, dim: int, centre: np.ndarray | None = None):
        remains = 1.0 if centre is None else 1 - (1 - COSINE) / (1 - float(centre @ centre))
        first = ROTATIONS[0][1]
        rotations = next((r for least, r in ROTATIONS if remains >= least), None)
        self.centre = None if rotations is None else centre  # of a narrower cone the whole vectors are coded
        rotations = rotations or first
        self.caps = [Caps(n * rotations / first, dim, k) for k in range(rotations)]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.centre is not None:
            rest = x - self.centre
            x = np.where(np.linalg.norm(rest, axis=1, keepdims=True) > 1e-6, rest, x)
        found = [c.decode(x) for c in self.caps]
        row, code = np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])
        order = np.lexsort((code, row))
        return row[order], code[order]


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(reps: DataFrame) -> dict[int, np.ndarray]:
    """The mean unit vector of each length of vectors that is frequent enough. Embeddings of texts lie in a cone around it, and
    filters on whole vectors would put most of them behind the few filters near its axis. Summed in each task first; a vector a
    length comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = pa.Table.from_batches([b]).filter(pa.array(sizes == dim)).combine_chunks()
                n, total = sums.get(dim, (0, np.zeros(dim)))
                sums[dim] = (n + len(part), total + unit(part.column(0).chunk(0)).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], ["dim", "n", "total"])

    part = reps.select("embedding").mapInArrow(run, "dim int, n long, total array<double>")
    enough = part.groupBy("dim").agg(F.sum("n").alias("n")).where(F.col("n") >= CENTRED)
    places = part.select("dim", F.posexplode("total").alias("at", "x")).groupBy("dim", "at").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in places.join(enough, "dim").select("dim", "at", F.col("x") / F.col("n")).collect():
        out.setdefault(r[0], np.zeros(r[0]))[r[1]] = r[2]
    return out


def filtered(reps: DataFrame, n: int, middle: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(bucket, dim, id, filters): one row for each vector and filter that it exceeds, without the vector. middle: the centres
    that are taken out for the filters; cosines are those of whole vectors."""
    middle = middle or {}
    caps: dict[int, Rotations] = {}

    def caps_of(dim: int) -> Rotations:
        if dim not in caps:
            caps[dim] = Rotations(n, dim, middle.get(dim))
        return caps[dim]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                part = pa.Table.from_batches([b]).filter(pa.array(sizes == dim)).combine_chunks()
                row, code = caps_of(int(dim)).decode(unit(part.column(1).chunk(0)))
                edges = np.searchsorted(row, np.arange(len(part) + 1))  # rows come in order
                lists = [code[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), pa.array(np.full(len(row), dim, np.int32)), part.column(0).chunk(0).take(take), pa.array(lists, pa.binary()).take(take)],
                    ["bucket", "dim", "id", "filters"],
                )

    return reps.select("id", "embedding").mapInArrow(run, "bucket long, dim int, id long, filters binary")


def verified(group: pa.Table) -> pa.Table:
    """Of one bucket (or two blocks of a hot one): links counted at the first filter that both ends share, so that each
    is counted once, and edges that connect what is linked here."""
    bucket, left, right = (group.column(c)[0].as_py() for c in ("bucket", "left", "right"))
    ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
    x, side = unit(group.column("vector").combine_chunks()), group.column("block").to_numpy()
    raw = group.column("filters").to_pylist()
    lists = np.full((len(ids), max(map(len, raw)) // 8), -1, np.int64)
    for k, r in enumerate(raw):
        lists[k, : len(r) // 8] = np.frombuffer(r, np.int64)
    counted, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(ids), 500):
        i, j = np.nonzero(x[a : a + 500] @ x.T >= COSINE)
        i = i + a
        keep = (i < j) & ((left == right) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        pairs.append((i, j))
        step = max(1, COMPARED // lists.shape[1] ** 2)
        for c in range(0, len(i), step):
            p, q = i[c : c + step], j[c : c + step]
            same = (lists[p][:, :, None] == lists[q][:, None, :]).any(2) & (lists[p] >= 0)
            first = np.where(same, lists[p], np.iinfo(np.int64).max).min(1)
            p, q = p[first == bucket], q[first == bucket]
            np.add.at(counted, p, copies[q])
            np.add.at(counted, q, copies[p])
    i, j = (np.concatenate(z) for z in zip(*pairs, strict=True))
    while len(i):  # least label among neighbours, again and again, with short cuts
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    some, tied = counted > 0, root != np.arange(len(ids))
    return pa.table(
        {
            "a": np.concatenate([ids[some], ids[tied]]),
            "b": pa.array(np.concatenate([ids[some], ids[root[tied]]]), mask=np.arange(some.sum() + tied.sum()) < some.sum()),
            "n": np.concatenate([counted[some], np.zeros(tied.sum(), np.int64)]),
        }
    )


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Two rows link if their cosine in double precision is at least 0.95; vectors of different lengths never do, nor do
    null, empty or zero ones or any with a null or non-finite component: these have 0 links and their own id as
    component. Equal vectors are collapsed first and counted with their number, so a group of copies costs one row. Rows
    with a null or repeated vec_id link like any other; a component without any id has a null component_id.
    A bucket of over HOT_ROWS rows is cut into blocks whose pairs are verified by different tasks; none is dropped. Vectors
    travel once to their filters; what decides on blocks is a table of filters alone.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    x = F.col("embedding")
    good = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), x).alias("embedding"))
    valid = rows.where("embedding is not null")
    reps = valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    reps = scratch.save(reps.withColumn("id", F.monotonically_increasing_id()), "distinct")
    n = reps.count()
    coded = scratch.save(filtered(reps, n, centres(reps)), "coded")
    hot = coded.groupBy("bucket", "dim").count().where(F.col("count") > HOT_ROWS)
    hot = hot.select("bucket", "dim", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = coded.join(hot, ["bucket", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).drop("other", "blocks")
    dealt = dealt.join(reps.select("id", "copies", F.col("embedding").alias("vector")), "id")
    found = scratch.save(dealt.groupBy("bucket", "dim", "left", "right").applyInArrow(verified, "a long, b long, n long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(spark, found.where("b is not null").select("a", "b"), scratch)
    about = reps.join(links, "id", "left").join(roots, reps.id == roots.node, "left").withColumn("root", F.coalesce("root", "id"))
    about = scratch.save(about.select("embedding", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "about")
    names = about.groupBy("root").agg(F.min("least").alias("component_id"))
    about = about.drop("least").join(names, "root").drop("root")
    out = rows.join(about, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors() of all rows of embeddings; see there for nulls, repeats and other cases."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
