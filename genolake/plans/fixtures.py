"""Sequence tables derived from the given tables, each with the same definition in SQL.

The reference genome has a fixed size, whatever the tables, and its letters follow a rule. aligned: every document's letters,
cut into stretches as long as the reference, read as changes against it. edited: one sequence for each document, the reference
with changes planted by its id and letters. muts, ranges and dels: small genomes of 300 places from line items and orders. nodes
and branch_muts: a tree from suppliers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from genolake.operators.tour import last_on_path
from genolake.plans.scratch import new_folder, save

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
TO_REF, TO_SEQ = "ACGTACGTACGTACGTACGTACGTAC", "ACGTACGNACGTACGTACG-ACGRTA"
SIZE = 300
REF_SIZE = 3000
REF = "".join("ACGT"[(i * i * 7 + i * 31 + i // 5 * 13) % 1009 % 4] for i in range(REF_SIZE))
#: Stretches of one document have neighbouring numbers.
STRETCHES = 100_000

SQL = {
    "ref": f"SELECT string_agg(substr('ACGT', ((i*i*7 + i*31 + (i//5)*13) % 1009 % 4 + 1)::INT, 1), '' ORDER BY i) r FROM range({REF_SIZE}) t(i)",
    "chars": "SELECT doc_id, unnest(string_split(t,'')) ch, generate_subscripts(string_split(t,''),1)-1 i FROM (SELECT doc_id, regexp_replace(lower(text),'[^a-z]','','g') t FROM documents) WHERE t <> ''",
    "refpos": "SELECT unnest(string_split(r,'')) ref, generate_subscripts(string_split(r,''),1)-1 pos FROM ref",
    "cells": "SELECT (doc_id*100000 + i // size)::BIGINT seq_index, m::INT pos, p.ref, CASE WHEN ch='z' THEN 'N' WHEN ch='x' THEN 'R' WHEN ch IN ('q','j') THEN '-' WHEN ch IN ('k','b') THEN translate(p.ref,'ACGT','CGTA') WHEN ch='w' THEN translate(p.ref,'ACGT','GTAC') WHEN ch='v' THEN translate(p.ref,'ACGT','TACG') ELSE p.ref END qry FROM (SELECT c.*, size, i % size m FROM chars c, (SELECT length(r) size FROM ref)) c JOIN refpos p ON p.pos = c.m",
    "spans": "SELECT seq_index, min(pos) FILTER (qry <> '-') b, max(pos) FILTER (qry <> '-') + 1 e, max(pos)+1 size FROM cells GROUP BY 1",
    "muts": "SELECT seq_index, 'nuc' cds, pos, substr('ACGT', pos%4+1, 1) ref, qry FROM (SELECT l_orderkey::BIGINT seq_index, (l_partkey % 300)::INT pos, min(substr('ACGT', cast(l_quantity as INT) % 4 + 1, 1)) qry FROM lineitem GROUP BY 1,2) WHERE qry <> substr('ACGT', pos%4+1, 1)",
    "seqs": "SELECT o_orderkey::BIGINT seq_index FROM orders",
    "missing": "SELECT o_orderkey::BIGINT seq_index, (o_custkey%280)::INT b, (o_custkey%280 + 1 + o_orderkey%20)::INT e FROM orders",
    "span": "SELECT o_orderkey::BIGINT seq_index, (o_orderkey%7)::INT b, (300 - o_orderkey%5)::INT e FROM orders",
    "dels": "SELECT o_orderkey::BIGINT seq_index, ((o_orderkey*7)%290)::INT b, ((o_orderkey*7)%290 + 1 + o_orderkey%3)::INT e FROM orders",
    "delpos": "SELECT d.seq_index, 'nuc' cds, unnest(range(b, e))::INT pos FROM dels d",
    "gone": "SELECT * FROM delpos ANTI JOIN muts USING (seq_index, cds, pos)",
    "masks": "SELECT * FROM (VALUES (0, 10), (290, 300)) t(b, e)",
    "nodes": "SELECT s_suppkey::BIGINT node_id, CASE WHEN s_suppkey > 1 THEN (s_suppkey+1)//3 END::BIGINT parent_id, s_suppkey::INT preorder, 'n' || s_suppkey AS name, 'c' || (s_nationkey % 5) AS clade, (-(s_suppkey % 7))::DOUBLE prior, (s_acctbal/1000)::DOUBLE div FROM supplier",
    "cl": "SELECT node_id, node_id ancestor_id, 0 distance FROM nodes UNION ALL SELECT cl.node_id, n.parent_id, distance + 1 FROM cl JOIN nodes n ON n.node_id = cl.ancestor_id WHERE n.parent_id IS NOT NULL",
    "rawmuts": "SELECT s_suppkey::BIGINT node_id, ((s_suppkey*37 + k*53) % 300)::INT pos, min(substr('ACGT', ((s_suppkey*3 + k*2 + 1) % 4 + 1)::INT, 1)) qry FROM supplier, range(3) t(k) GROUP BY 1, 2",
    "above": "SELECT r.node_id, r.pos, r.qry, coalesce(arg_min(u.qry, cl.distance) FILTER (u.qry IS NOT NULL), substr('ACGT', r.pos%4+1, 1)) ref FROM rawmuts r LEFT JOIN cl ON cl.node_id = r.node_id AND cl.distance > 0 LEFT JOIN rawmuts u ON u.node_id = cl.ancestor_id AND u.pos = r.pos GROUP BY 1,2,3",
    "branch": "SELECT node_id, 'nuc' cds, pos, ref, qry FROM above WHERE ref <> qry",
    "nodemuts": "SELECT node_id, cds, pos, qry FROM (SELECT cl.node_id, cds, pos, arg_min(qry, distance) qry FROM cl JOIN branch b ON b.node_id = cl.ancestor_id GROUP BY 1,2,3) WHERE qry <> substr('ACGT', pos%4+1, 1)",
    "placed": "SELECT node_id, pos, qry FROM nodemuts WHERE pos >= 10 AND pos < 290",
    "pmuts": "SELECT * FROM muts WHERE pos >= 10 AND pos < 290",
    "unknown": "SELECT DISTINCT s.seq_index, p.pos FROM span s CROSS JOIN (SELECT DISTINCT pos FROM placed) p JOIN missing m ON m.seq_index = s.seq_index JOIN dels d ON d.seq_index = s.seq_index WHERE p.pos < s.b OR p.pos >= s.e OR (p.pos >= m.b AND p.pos < m.e) OR (p.pos >= d.b AND p.pos < d.e)",
    "less": "SELECT seq_index, node_id, sum(x)::BIGINT less FROM (SELECT m.seq_index, p.node_id, CASE WHEN m.qry = p.qry THEN 2 ELSE 1 END x FROM pmuts m JOIN placed p USING (pos) UNION ALL SELECT u.seq_index, p.node_id, 1 FROM unknown u JOIN placed p USING (pos)) GROUP BY 1, 2",
    "dist": "SELECT s.seq_index, n.node_id, n.prior, n.preorder, (coalesce(a.c,0) + coalesce(b.c,0) - coalesce(l.less,0))::BIGINT distance FROM seqs s CROSS JOIN nodes n LEFT JOIN (SELECT seq_index, count(*) c FROM pmuts GROUP BY 1) a USING (seq_index) LEFT JOIN (SELECT node_id, count(*) c FROM placed GROUP BY 1) b ON b.node_id = n.node_id LEFT JOIN less l ON l.seq_index = s.seq_index AND l.node_id = n.node_id",
    "nearest": "SELECT seq_index, node_id, distance FROM dist QUALIFY row_number() OVER (PARTITION BY seq_index ORDER BY distance, prior DESC, preorder) = 1",
    "state": "SELECT seq_index, cds, pos, qry FROM muts UNION ALL SELECT seq_index, cds, pos, '-' FROM gone",
    "nodestate": "SELECT n.seq_index, m.cds, m.pos, m.qry node_qry FROM nearest n JOIN nodemuts m USING (node_id)",
    "joint": "SELECT seq_index, cds, pos, s.qry, n.node_qry, substr('ACGT', pos%4+1, 1) ref FROM state s FULL JOIN nodestate n USING (seq_index, cds, pos)",
    "private": "SELECT seq_index, cds, pos, coalesce(node_qry, ref) ref, qry, false reversion FROM joint WHERE qry IS NOT NULL AND qry IS DISTINCT FROM node_qry UNION ALL SELECT x.seq_index, x.cds, x.pos, x.node_qry, x.ref, true FROM joint x JOIN span s USING (seq_index) JOIN missing m USING (seq_index) WHERE x.qry IS NULL AND x.pos >= s.b AND x.pos < s.e AND NOT (x.pos >= m.b AND x.pos < m.e)",
    "labels_": "SELECT * FROM (VALUES ('nuc', 20, 'A', 'x'), ('nuc', 41, 'G', 'y'), ('nuc', 150, 'C', 'z'), ('nuc', 201, 'T', 'x')) t(cds, pos, qry, label)",
    "summary": "SELECT s.seq_index, coalesce(n_subs,0)::BIGINT n_subs, coalesce(n_reversions,0)::BIGINT n_reversions, coalesce(n_labelled,0)::BIGINT n_labelled, coalesce(n_unlabelled,0)::BIGINT n_unlabelled, coalesce(n_deletions,0)::BIGINT n_deletions, coalesce(n_deletion_ranges,0)::BIGINT n_deletion_ranges FROM seqs s LEFT JOIN (SELECT p.seq_index, count(*) n_subs, count(*) FILTER (reversion) n_reversions, count(*) FILTER (NOT reversion AND label IS NOT NULL) n_labelled, count(*) FILTER (NOT reversion AND label IS NULL) n_unlabelled FROM private p LEFT JOIN labels_ l ON l.pos = p.pos AND l.qry = p.qry WHERE p.qry <> '-' GROUP BY 1) a USING (seq_index) LEFT JOIN (SELECT seq_index, sum(n) n_deletions, count(*) n_deletion_ranges FROM (SELECT seq_index, g, count(*) n FROM (SELECT seq_index, pos - row_number() OVER (PARTITION BY seq_index ORDER BY pos) g FROM private WHERE qry = '-') GROUP BY 1, 2) GROUP BY 1) b USING (seq_index)",
}


#: Columns of the views that refer to themselves.
RECURSIVE = {"cl": "node_id, ancestor_id, distance", "rec_qry": "seq_index, name, cds, b, p", "rec_ref": "seq_index, name, cds, b, p", "rec_cover": "round, ref_id, name, n_hits, done", "rec_walk": "node_id, path"}


def with_views(names: str, select: str) -> str:
    """A query over the named views and all that they need, as one statement."""
    import re

    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in SQL:
            if other != name and re.search(rf"\b{other}\b", SQL[name]):
                add(other)
        needed.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n}({RECURSIVE[n]}) AS ({SQL[n]})" if n in RECURSIVE else f"{n} AS ({SQL[n]})" for n in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(column: str = "text") -> F.Column:
    return F.regexp_replace(F.lower(column), "[^a-z]", "")


_written: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() makes, written once for each session and folder of tables: queries share it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        df, path = build(), new_folder(spark, name)
        save(df, path)
        _written[key] = path, df.schema
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def once(spark: SparkSession, sf_dir: str, name: str, df: DataFrame) -> DataFrame:
    return shared(spark, sf_dir, name, lambda: df)


def _read_as_changes() -> np.ndarray:
    """The letter that a text's letter (first index) makes of the reference's (second)."""
    out = np.tile(np.arange(256, dtype=np.uint8), (256, 1))
    for letters, to in {"z": "NNNN", "x": "RRRR", "qj": "----", "kb": "CGTA", "w": "GTAC", "v": "TACG"}.items():
        for ch in letters:
            out[ord(ch), list(b"ACGT")] = list(to.encode())
    return out


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_index, aln): every stretch of every document's letters, as changes of the reference's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", clean().alias("t")).where("t <> ''")
    changes, ref = _read_as_changes(), np.frombuffer(REF.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = np.frombuffer(text.as_buffer(), np.uint8)
                pieces = [t[at : at + REF_SIZE] for at in range(0, len(t), REF_SIZE)]
                index = [None if doc is None else doc * STRETCHES + k for k in range(len(pieces))]
                yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array([changes[p, ref[: len(p)]].tobytes().decode() for p in pieces], pa.string())], ["seq_index", "aln"])

    return once(spark, sf_dir, "aligned", docs.mapInArrow(run, "seq_index long, aln string"))


SQL["edits"] = (
    "SELECT doc_id::BIGINT seq_index, t, doc_id%40 skip, 300+doc_id*37%900 del_at, 3+doc_id%25 del_size, 1800+doc_id*53%800 ins_at, "
    f"substr(t, 1, (1+doc_id%12)::INT) ins FROM (SELECT doc_id, translate(regexp_replace(lower(text),'[^a-z]','','g'),'{ALPHABET}','{TO_REF}') t FROM documents)"
)
SQL["edit_subs"] = (
    "SELECT seq_index, count(*) n FROM edits JOIN refpos ON pos%97 = seq_index%97 WHERE pos >= skip+25 AND pos < 2950 AND NOT (pos >= del_at-25 AND pos < del_at+del_size+25) "
    "AND NOT (pos >= ins_at-25 AND pos < ins_at+25) GROUP BY 1"
)


#: One in so many sequences has unknown letters beside its deletion; so many.
UNKNOWN_EVERY, UNKNOWN = 5, 7
OTHER, TURNED = dict(zip("ACGT", "CGTA", strict=True)), str.maketrans("ACGT", "TGCA")


def edited(spark: SparkSession, sf_dir: str, unknown: bool = False) -> DataFrame:
    """(seq_index, seq): the reference without its first letters, with one deletion, one insertion of the document's own letters
    and substitutions far from both; one in seven is reverse-complemented, and one in fifty is cut to 60 letters. With `unknown`
    the letters before some deletions are N."""
    letters = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("seq_index"), F.translate(clean(), ALPHABET, TO_REF).alias("t"))

    def edit(i: int | None, t: str | None) -> str | None:
        if i is None or t is None:
            return None
        skip, del_at, del_size, ins_at = i % 40, 300 + i * 37 % 900, 3 + i % 25, 1800 + i * 53 % 800
        spots = np.arange(i % 97, 2950, 97)
        beside = ((spots >= del_at - 25) & (spots < del_at + del_size + 25)) | ((spots >= ins_at - 25) & (spots < ins_at + 25))
        s = list(REF)
        for p in spots[(spots >= skip + 25) & ~beside].tolist():
            s[p] = OTHER[s[p]]
        s = "".join(s)
        before = s[skip : del_at - UNKNOWN] + "N" * UNKNOWN if unknown and i % UNKNOWN_EVERY == 2 else s[skip:del_at]
        seq = before + s[del_at + del_size : ins_at] + t[: 1 + i % 12] + s[ins_at:]
        if i % 50 == 1:
            return seq[:60]
        return seq[::-1].translate(TURNED) if i % 7 == 3 else seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [edit(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["seq_index", "seq"])

    return letters.mapInArrow(run, "seq_index long, seq string")


#: Amino acids that the reference peptide of a CDS does not have, with a codon of each; places where codons may be put in (first
#: codon, number of places); the genome position of the CDS's first base and the direction.
PLANTS = {"S": ("WEGQ", ["TGG", "GAA", "GGA", "CAA"], 3, 15, 0, 1), "M": ("WCDH", ["TGG", "TGC", "GAC", "CAC"], 12, 6, 60, 1), "N": ("WHKM", ["TGG", "CAC", "AAA", "ATG"], 3, 14, 260, -1)}
_COUNT = "(length(t) - length(replace(t, '{}', '')))"
_LETTERS = ", ".join(f"substr(aas, ({_COUNT.format(c)} % 4 + 1)::INT, 1)" for c in "aiot")
SQL["stretches"] = f"SELECT (doc_id*{STRETCHES} + k)::BIGINT seq_index, substr(t, (k*{REF_SIZE}+1)::INT, {REF_SIZE}) t FROM (SELECT doc_id, t, unnest(range((length(t)-1)//{REF_SIZE}+1)) k FROM (SELECT doc_id, regexp_replace(lower(text),'[^a-z]','','g') t FROM documents) WHERE t <> '')"
SQL["plantrules"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{cds}', '{v[0]}', {v[2]}, {v[3]})" for i, (cds, v) in enumerate(PLANTS.items())) + ") v(no, cds, aas, low, n)"
SQL["plants"] = f"SELECT seq_index, cds, (low + {_COUNT.format('n')} % n - 1)::INT pos, substr(concat({_LETTERS}), 1, (1 + {_COUNT.format('e')} % 4)::INT) ins FROM stretches JOIN plantrules ON no = seq_index % 3"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_index, qry_aln, ref_aln): for each stretch of a document's letters the reference with codons put in between two of a
    CDS, told by the stretch's letters. Where the same sequence can be aligned with the gap one letter later, so that it cuts two
    codons, it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", clean().alias("t")).where("t <> ''")
    steps = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / REF_SIZE).cast("int"))
    s = docs.select("doc_id", F.posexplode(F.transform(steps, lambda k: F.substr(F.col("t"), k * REF_SIZE + 1, F.lit(REF_SIZE)))).alias("k", "t"))
    s = s.withColumn("seq_index", F.col("doc_id") * STRETCHES + F.col("k"))
    count = lambda c: F.length("t") - F.length(F.replace(F.col("t"), F.lit(c), F.lit("")))

    def choose(f: Callable[[str], F.Column]) -> F.Column:
        first, second, third = (f(cds) for cds in PLANTS)
        return F.when(F.col("seq_index") % 3 == 0, first).when(F.col("seq_index") % 3 == 1, second).otherwise(third)

    def codons(cds: str) -> F.Column:
        text = F.array_join(F.slice(F.array(*[F.get(F.array(*map(F.lit, PLANTS[cds][1])), count(c) % 4) for c in "aiot"]), F.lit(1), 1 + count("e") % 4), "")
        return text if PLANTS[cds][5] > 0 else F.reverse(F.translate(text, "ACGT", "TGCA"))

    place = lambda cds: F.lit(PLANTS[cds][4]) + PLANTS[cds][5] * 3 * (F.lit(PLANTS[cds][2]) + count("n") % PLANTS[cds][3])
    s = s.select("seq_index", choose(place).alias("at"), choose(codons).alias("ins"))
    part = lambda a, b: F.substr(F.lit(REF), a + 1, b - a)
    at, end = F.col("at"), F.lit(REF_SIZE)
    later = at + (part(at, at + 1) == F.left("ins", F.lit(1))).cast("int")
    return s.select("seq_index", F.concat(part(F.lit(0), at), "ins", part(at, end)).alias("qry_aln"), F.concat(part(F.lit(0), later), F.repeat(F.lit("-"), F.length("ins")), part(later, end)).alias("ref_aln"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_index, seq_name, seq): unaligned sequences, one for each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_index"), F.concat_ws(" ", F.concat(F.lit("s"), "doc_id"), "lang").alias("seq_name"), F.translate(clean(), ALPHABET, TO_SEQ).alias("seq"))


def mini_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, name, seq): one reference for each benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.concat(F.lit("org/"), (F.col("item_id") % 4).cast("string"), F.lit("/"), F.col("item_id").cast("string")).alias("name"), F.translate(clean(), ALPHABET, TO_SEQ).alias("seq"))


def small_ref(spark: SparkSession) -> DataFrame:
    return spark.range(SIZE).select(F.lit("nuc").alias("cds"), F.col("id").cast("int").alias("pos"), F.expr("substr('ACGT', cast(id % 4 as int) + 1, 1)").alias("ref"))


def muts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_index, cds, pos, ref, qry)."""
    letter = F.expr("substr('ACGT', cast(cast(l_quantity as int) % 4 as int) + 1, 1)")
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("seq_index"), (F.col("l_partkey") % SIZE).cast("int").alias("pos")).agg(F.min(letter).alias("qry"))
    return m.withColumn("ref", F.expr("substr('ACGT', pos % 4 + 1, 1)")).where("qry <> ref").select("seq_index", F.lit("nuc").alias("cds"), "pos", "ref", "qry")


def _orders(spark: SparkSession, sf_dir: str, begin: str, end: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("seq_index"), F.expr(f"cast({begin} as int)").alias("begin"), F.expr(f"cast({end} as int)").alias("end"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("seq_index"))


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "o_custkey % 280", "o_custkey % 280 + 1 + o_orderkey % 20")


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "o_orderkey % 7", "300 - o_orderkey % 5")


def dels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "(o_orderkey * 7) % 290", "(o_orderkey * 7) % 290 + 1 + o_orderkey % 3")


def gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_index, cds, pos): deleted places that aren't substituted."""
    d = dels(spark, sf_dir).select("seq_index", F.lit("nuc").alias("cds"), F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    return d.join(muts(spark, sf_dir), ["seq_index", "cds", "pos"], "left_anti")


def masks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 10), (290, 300)], "begin int, end int")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("long").alias("node_id"), F.expr("case when s_suppkey > 1 then cast((s_suppkey + 1) div 3 as long) end").alias("parent_id"),
        F.col("s_suppkey").cast("int").alias("preorder"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("c"), (F.col("s_nationkey") % 5).cast("string")).alias("clade"),
        (-(F.col("s_suppkey") % 7)).cast("double").alias("prior"), (F.col("s_acctbal") / 1000).cast("double").alias("div"),
    )


def branch_muts(spark: SparkSession, sf_dir: str, tour: DataFrame) -> DataFrame:
    """(node_id, cds, pos, ref, qry); the first letter is the state above, so the tree is valid."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    raw = s.groupBy("node_id", F.expr("cast((node_id * 37 + k * 53) % 300 as int)").alias("pos")).agg(F.min(F.expr("substr('ACGT', cast((node_id * 3 + k * 2 + 1) % 4 as int) + 1, 1)")).alias("qry"))
    last = last_on_path(raw, tour, ["pos"], "qry").select(F.col("node_id").alias("parent_id"), "pos", F.col("qry").alias("u"))
    up = tour.select("node_id", "parent_id").join(last, "parent_id").drop("parent_id")
    out = raw.join(up, ["node_id", "pos"], "left").withColumn("ref", F.coalesce("u", F.expr("substr('ACGT', pos % 4 + 1, 1)")))
    return out.where("ref <> qry").select("node_id", F.lit("nuc").alias("cds"), "pos", "ref", "qry")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("nuc", 20, "A", ["x"]), ("nuc", 41, "G", ["y"]), ("nuc", 150, "C", ["z"]), ("nuc", 201, "T", ["x"])], "cds string, pos int, qry string, labels array<string>")


def segments(spark: SparkSession) -> DataFrame:
    rows = [("S", 0, 0, 90, "+"), ("S", 1, 120, 180, "+"), ("N", 0, 200, 260, "-"), ("M", 0, 60, 120, "+")]
    return spark.createDataFrame(rows, "cds string, seg_no int, begin int, end int, strand string")
