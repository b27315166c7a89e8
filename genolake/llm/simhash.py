"""Operator 5: SimHash near-duplicates by multi-index hashing. The pipeline's stage keeps one of each similar text
(one_of_similar): its candidates come from SimHash and from bands of minima, and word shingles decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, LongType, StructField, StructType

from genolake.llm.common import Scratch, components, free_name, small_batches, table, with_result

SHINGLE_WORDS = 3
MAX_BITS = 2
#: The stage: words of a shingle and least Jaccard similarity; bands and minima in each. Two texts of similarity s meet in
#: a band with a chance of 1 - (1 - s^ROWS)^BANDS: 0.9997 at 0.8.
SIMILAR_WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
#: One byte of each of so many minima makes a sketch. Two texts of similarity 0.8 agree in 128 of them, give or take 5; with
#: fewer than ALIKE (a chance of about 0.00005 at 0.8) they are not verified.
SKETCH, ALIKE = 160, 107
#: Odd factors, one for each minimum: a permutation of 64-bit hashes each.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes | None, n_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= n_words:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n_words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[n_words - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], np.uint64)
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, n_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, n_words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def close_fingerprints(fps: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints fp that differ in at most two bits, a < b.

    Two segments of 32 bits. Of two fingerprints at distance 2 or less, either the upper segments differ in at most one
    bit, or the lower segments are equal. So each fingerprint looks up its ball of radius 1 (33 keys) in the table of
    upper segments and its own lower segment in the other; matches are verified on all 64 bits. The looked-up side has
    34 rows for each distinct fingerprint whatever the table size.
    """
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    lower_key = lower + F.lit(1 << 32)
    stored = fps.select(F.col("fp").alias("b"), F.explode(F.array(upper, lower_key)).alias("key"))
    ball = F.array(upper, lower_key, *[upper.bitwiseXOR(F.lit(1 << i)) for i in range(32)])
    probes = fps.select(F.col("fp").alias("a"), F.explode(ball).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return probes.join(stored, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")


def groups(hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, root) for each distinct fingerprint of hashed: root is the same for all fingerprints linked by a chain."""
    nodes = scratch.save(hashed.select("fp").distinct(), "distinct")
    roots = components(hashed.sparkSession, close_fingerprints(nodes), scratch)
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Documents link if their fingerprints differ in at most two bits; component_id is the least doc_id reachable by
    links. Equal fingerprints are collapsed to one node first, so a group of copies costs one row, and only distinct
    fingerprints are joined. Empty and null texts have fingerprint 0 and link like any others. Repeated rows stay, each
    with the same component. A null doc_id gets the component of its fingerprint (null if no other id is there).
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    hashed = scratch.save(simhash(docs), "fingerprints")
    linked = hashed.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups(hashed, scratch), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(least, "root").select("fp", "component_id")
    return hashed.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the least doc_id (null ids last, then the first
    written of equal ones). All columns stay. Groups are as in near_duplicates()."""
    scratch = Scratch(docs.sparkSession, "deduplicated")
    fp, row = free_name(docs, "fp"), free_name(docs, "row")

    def make():
        return lambda texts: pa.array(np.array([fingerprint(t.encode() if t else None) for t in texts], np.uint64).view(np.int64))

    hashed = scratch.save(with_result(docs, fp, LongType(), make).withColumn(row, F.monotonically_increasing_id()), "hashed")
    slim = hashed.select(F.col(fp).alias("fp"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))
    first = F.min(F.struct("no_id", "doc_id", "row"))
    best = slim.groupBy("fp").agg(first.alias("best")).join(groups(slim, scratch), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = best.select(F.col("best.row").alias(row))
    return hashed.join(kept, row, "left_semi").drop(fp, row)


def shingles(text: bytes | None, n_words: int = SIMILAR_WORDS) -> tuple[bytes, np.ndarray]:
    """The normalised text (as in fingerprint()) and the sorted distinct hashes of its word shingles. A text of fewer words
    is one shingle, an empty one too."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= n_words:
        return joined, np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n_words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return joined, np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[n_words - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(a key for each band: the hash of its number and minima; the sketch: a byte of each minimum)."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k : k + 4096, None] * FACTORS).min(0))
    bands = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    mixed = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(bands)], mixed.astype(np.uint8).view(np.int8)


@lru_cache(maxsize=64)
def shingles_kept(text: str) -> np.ndarray:
    return shingles(text.encode())[1]


def jaccard(a: str | None, b: str | None) -> float:
    x, y = shingles_kept(a or ""), shingles_kept(b or "")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def similar_links(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): rows of members(key, me, sketch) that share a key and are similar, as far as they decide what is kept.

    First every member is compared with one other, the least of all that come first under any of its keys, on all shingles
    of texts(row, text). If they are similar it takes the other's label. Then, in each round, the first 1 (then 4, 16, ..)
    members of a key are its centres, and every member is compared with the centres before it, unless their labels are
    equal: then a link to one and the same member joins them already. Pairs whose sketches tell that they can't be similar are
    left out where keys are joined, and verify nothing. Members joined to a centre and the centres leave; the
    rest goes to the next round, until no key has two. So two members that share a key are both first of their groups only
    if they were compared and are not similar, and a group of copies costs about a pair a member.
    """

    @F.arrow_udf(BooleanType())
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([jaccard(x, y) >= SIMILAR for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        # texts are the bulk of the table: only those of a pair go through the joins, and they are few
        pairs = scratch.save(pairs, f"{label}_ids")
        named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        some = scratch.save(texts.join(named, "row", "left_semi"), f"{label}_texts")
        found = scratch.save(pairs.join(some.toDF("a", "text_a"), "a").join(some.toDF("b", "text_b"), "b").where(similar("text_a", "text_b")).select("a", "b"), label)
        scratch.drop(f"{label}_texts")
        return found

    def leading(rows: DataFrame, centres: int) -> DataFrame:
        order = Window.partitionBy("key").orderBy("me")
        return rows.withColumn("no", F.row_number().over(order)).where(F.col("no") <= centres).drop("no").withColumnsRenamed({"me": "c", "sketch": "c_sketch"})

    equal = F.aggregate(F.zip_with("sketch", "c_sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    alike = (F.col("me") > F.col("c")) & (equal >= ALIKE)

    centres, k = 1, 0
    rest = scratch.save(members, "shared")
    texts = scratch.save(texts.join(rest.select(F.col("me.row").alias("row")).distinct(), "row", "left_semi"), "texts")
    lead = rest.join(leading(rest, 1), "key").where(alike).groupBy("me").agg(F.min("c").alias("c"))
    found = verified(lead.select(F.col("me.row").alias("a"), F.col("c.row").alias("b")), "leads")
    labels = found.select(F.col("a").alias("_row"), F.col("b").alias("label"))
    labelled = rest.join(labels, F.col("me.row") == F.col("_row"), "left")
    rest = scratch.save(labelled.select("key", "me", "sketch", F.coalesce("label", "me.row").alias("label")), "members0")
    while not rest.isEmpty():
        first = leading(rest.withColumnRenamed("label", "c_label"), centres)
        pairs = scratch.save(rest.join(first, "key").where(alike).select("key", "me", "c", (F.col("label") == F.col("c_label")).alias("known")), f"pairs{k}")
        distinct = pairs.where("not known").select(F.col("me.row").alias("a"), F.col("c.row").alias("b")).distinct()
        links = verified(distinct, f"links{k}")
        found = found.union(links)
        linked = pairs.where("not known").join(links, (F.col("me.row") == links.a) & (F.col("c.row") == links.b), "left_semi").select("key", "me")
        gone = pairs.where("known").select("key", "me").union(linked).union(first.select("key", F.col("c").alias("me"))).distinct()
        k, centres = k + 1, min(4 * centres, 256)
        rest = scratch.save(rest.join(gone, ["key", "me"], "left_anti"), f"members{k}")
        scratch.drop(f"members{k - 1}")
        scratch.drop(f"pairs{k - 1}")
    return found


def fingerprint_keys(hashed: DataFrame) -> DataFrame:
    """hashed(fp, ..) with a column key, equal for rows whose fingerprints near_duplicates() links."""
    scratch = Scratch(hashed.sparkSession, "fingerprints")
    return hashed.join(groups(hashed, scratch), "fp").withColumn("key", F.xxhash64(F.lit("fp"), "root"))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: the one
    with the least doc_id (null ids last, then the first written of equal ones). All columns stay.

    Equal normalised texts are collapsed first. Candidates are the groups of SimHash fingerprints that near_duplicates() links, and
    texts that share one of 20 bands of minima, as fingerprints of similar texts mostly differ in more than two bits. All
    are verified on all their shingles. Every dropped row is linked to a kept one, over others at most; kept rows that share
    a band or a group of fingerprints are not similar.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    mark, row = free_name(docs, "mark"), free_name(docs, "row")
    kind = StructType([StructField("digest", BinaryType()), StructField("fp", LongType()), StructField("keys", ArrayType(LongType())), StructField("sketch", ArrayType(ByteType()))])

    def make():
        def compute(texts):
            found = [shingles(t.encode() if t else None) for t in texts]
            digests = pa.array([xxhash.xxh3_128_digest(joined) for joined, _ in found], pa.binary())
            fps = pa.array(np.array([fingerprint(joined) for joined, _ in found], np.uint64).view(np.int64))
            keys, sketches = zip(*(band_keys(h) for _, h in found), strict=True)
            return pa.StructArray.from_arrays([digests, fps, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int8()))], ["digest", "fp", "keys", "sketch"])

        return compute

    hashed = scratch.save(with_result(docs, mark, kind, make).withColumn(row, F.monotonically_increasing_id()), "hashed")
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))
    nodes = scratch.save(hashed.select(F.col(f"{mark}.digest").alias("digest"), me.alias("me")).groupBy("digest").agg(F.min("me").alias("me")).select("me"), "nodes")
    # 21 keys a text are shuffled by row and key alone; order and sketch go with the rows whose key another row has
    about = hashed.join(nodes.select(F.col("me.row").alias(row)), row, "left_semi")
    about = scratch.save(about.select(F.col(row).alias("row"), F.col(f"{mark}.fp").alias("fp"), F.col(f"{mark}.keys").alias("keys")), "about")
    keys = scratch.save(about.select("row", F.explode("keys").alias("key")).union(fingerprint_keys(about.select("row", "fp")).select("row", "key")), "keys")
    common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = scratch.save(keys.join(common, "key", "left_semi"), "shared_keys")
    sketches = hashed.select(F.col(row).alias("row"), me.alias("me"), F.col(f"{mark}.sketch").alias("sketch")).join(shared.select("row").distinct(), "row", "left_semi")
    members = shared.join(sketches, "row").select("key", "me", "sketch")
    links = similar_links(members, hashed.select(F.col(row).alias("row"), "text"), scratch)
    roots = components(docs.sparkSession, links, scratch)
    best = nodes.join(roots, F.col("me.row") == roots.node, "left").groupBy(F.coalesce("root", "me.row").alias("root")).agg(F.min("me").alias("me"))
    return hashed.join(best.select(F.col("me.row").alias(row)), row, "left_semi").drop(mark, row)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all rows of documents; see there for nulls, empties, ties and repeats."""
    return near_duplicates(table(spark, sf_dir, "documents"))
