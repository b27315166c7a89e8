"""Quality rules: each gives (seq_index, score), with counts where the rule has any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolake.functions.seq import letters
from genolake.plans.scratch import cut_lineage

#: Sequences, and primers, in a block of many_primer_changes(): a pair of blocks makes at most some 65,000 rows at once.
SEQUENCES, PRIMERS = 512, 128


def missing_score(n_missing: Column, bias: float = 10, threshold: float = 100) -> Column:
    return F.greatest((n_missing - bias) * 100.0 / threshold, F.lit(0.0))


def mixed_score(n_ambiguous: Column, threshold: float = 10) -> Column:
    return n_ambiguous * 100.0 / threshold


def private_score(summary: DataFrame, reversions: float = 1, labelled: float = 2, unlabelled: float = 1, typical: float = 5, cutoff: float = 15) -> DataFrame:
    """From the counts of private mutations; each range of deleted places counts once."""
    total = F.col("n_reversions") * reversions + F.col("n_labelled") * labelled + F.col("n_unlabelled") * unlabelled + F.col("n_deletion_ranges")
    return summary.select("seq_index", total.cast("double").alias("weighted_total"), (F.greatest(total - typical, F.lit(0.0)) * 100.0 / cutoff).alias("score"))


def snp_clusters(subs: DataFrame, window: int = 100, cutoff: int = 5) -> DataFrame:
    """(seq_index, begin, end, n): clusters of private substitutions.

    A place is hot if more than cutoff places lie in [pos - window, pos]. Hot places that follow each other in the list
    form a cluster; it begins with the first place in the first hot window. Windows are by sequence, so partitions are
    small and no key is hot.
    """
    order = Window.partitionBy("seq_index").orderBy("pos")
    near = order.rangeBetween(-window, 0)
    w = subs.select("seq_index", "pos", F.count("*").over(near).alias("n"), F.first("pos").over(near).alias("first"))
    w = w.withColumn("hot", F.col("n") > cutoff)
    w = w.withColumn("fresh", F.col("hot") & ~F.coalesce(F.lag("hot").over(order), F.lit(False)))
    w = w.withColumn("no", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("hot")
    size = F.sum(F.when(F.col("fresh"), F.col("n")).otherwise(1))
    return w.groupBy("seq_index", "no").agg(F.min("first").alias("begin"), F.max("pos").alias("end"), size.alias("n")).drop("no")


def cluster_score(clusters: DataFrame, weight: float = 50) -> DataFrame:
    return clusters.groupBy("seq_index").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_snps"), (F.count("*") * float(weight)).alias("score"))


def frame_shift_score(shifts: DataFrame, ignored: DataFrame, weight: float = 75) -> DataFrame:
    """shifts: (seq_index, cds, codon_begin, codon_end); ignored: (cds, codon_begin, codon_end), a small list."""
    j = shifts.join(ignored.withColumn("_i", F.lit(1)), ["cds", "codon_begin", "codon_end"], "left")
    return j.groupBy("seq_index").agg(F.count_if(F.col("_i").isNull()).alias("n"), F.count_if(F.col("_i").isNotNull()).alias("n_ignored"), (F.count_if(F.col("_i").isNull()) * float(weight)).alias("score"))


def stop_codons(peptides: DataFrame) -> DataFrame:
    """(seq_index, cds, codon): stops before the last codon of (seq_index, cds, aa)."""
    at = F.filter(F.transform(letters(F.col("aa")), lambda a, i: F.struct(i.alias("codon"), a.alias("a"))), lambda c: (c["a"] == "*") & (c["codon"] < F.length("aa") - 1))
    return peptides.select("seq_index", "cds", F.explode(at).alias("c")).select("seq_index", "cds", "c.codon")


def stop_score(stops: DataFrame, ignored: DataFrame, weight: float = 75) -> DataFrame:
    """ignored: (cds, codon), a small list."""
    j = stops.join(ignored.withColumn("_i", F.lit(1)), ["cds", "codon"], "left")
    return j.groupBy("seq_index").agg(F.count_if(F.col("_i").isNull()).alias("n"), F.count_if(F.col("_i").isNotNull()).alias("n_ignored"), (F.count_if(F.col("_i").isNull()) * float(weight)).alias("score"))


def overall(scores: list[Column]) -> Column:
    """Sum of squares / 100; a null score (rule off, or nothing found) adds 0."""
    total = F.lit(0.0)
    for s in scores:
        total = total + F.coalesce(s * s, F.lit(0.0)) / 100.0
    return total


def status(score: Column) -> Column:
    return F.when(score < 30, "good").when(score < 100, "mediocre").otherwise("bad")


def primer_cells(primers: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(name, pos, _l): the places of each primer, with the letters of an ambiguous base or null. A primer has some 20 places: as
    rows they make the range join an equal join."""
    cells = primers.select("name", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")).where("pos is not null")
    return cells.join(ambiguous.select("name", "pos", F.col("letters").alias("_l")), ["name", "pos"], "left")


def primer_changes(subs: DataFrame, primers: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(seq_index, name, pos, ref, qry): substitutions inside a primer, but not where the primer has an ambiguous base that
    covers the new one. primers: (name, begin, end), small; ambiguous: (name, pos, letters)."""
    cells = primer_cells(primers, ambiguous)
    return subs.join(cells, "pos").where("_l is null or not contains(_l, qry)").select("seq_index", "name", "pos", "ref", "qry")


def many_primer_changes(subs: DataFrame, primers: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """primer_changes() for any number of primers. At each place blocks of SEQUENCES sequences meet blocks of PRIMERS primers, so
    that only pairs of blocks are shuffled, over all tasks, and rows are made where they are read."""

    def blocks(rows: DataFrame, keys: list[str], item: str, size: int) -> DataFrame:
        rows = cut_lineage(rows.where("pos is not null"))
        n = rows.groupBy("pos").agg(F.ceil(F.count("*") / size).alias("_n"))
        dealt = rows.join(n, "pos").withColumn("_b", F.pmod(F.xxhash64(item), "_n"))
        return dealt.groupBy("pos", *keys, "_b").agg(F.transform(F.collect_list(F.struct(item)), lambda x: x[item]).alias(f"_{item}")).drop("_b")  # nulls stay

    changed = blocks(subs.select("seq_index", "pos", "ref", "qry"), ["ref", "qry"], "seq_index", SEQUENCES)
    primed = blocks(primer_cells(primers, ambiguous), ["_l"], "name", PRIMERS)
    spark = subs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    pairs = changed.join(primed, "pos").where("_l is null or not contains(_l, qry)").drop("_l").repartition(parts)
    each = pairs.select(F.explode("_seq_index").alias("seq_index"), "_name", "pos", "ref", "qry")
    return each.select("seq_index", F.explode("_name").alias("name"), "pos", "ref", "qry")
