"""Coding sequences, peptides and amino-acid calls. Codons are read in reference coordinates.

segments: (cds, seg_no, begin, end, strand), small. peptides: (seq_index, cds, aa).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolake.functions.seq import letters, reverse_complement, translate_codons
from genolake.operators.nuc import cds_positions
from genolake.operators.ranges import in_range


def extract_cds(aligned: DataFrame, segments: DataFrame) -> DataFrame:
    """(seq_index, cds, nuc): segments in order, reverse ones reverse-complemented; gaps beyond the end of a sequence. The few
    segments of a genome become columns: a filter on the text of a cross join is set on its wrong side by Spark's optimiser."""
    of_cds: dict[str | None, list[tuple]] = {}
    for r in segments.orderBy("cds", "seg_no", "begin", "end", "strand").select("cds", "begin", "end", "strand").collect():
        of_cds.setdefault(r["cds"], []).append((r["begin"], r["end"], r["strand"]))

    def one(begin: int, end: int, strand: str | None) -> Column:
        text = F.rpad(F.substr("aln", F.lit(begin + 1), F.lit(end - begin)), F.lit(end - begin), F.lit("-"))
        return reverse_complement(text) if strand == "-" else text

    known = {cds: [one(*s) for s in segs if None not in s[:2]] for cds, segs in of_cds.items()}
    parts = F.array(*[F.struct(F.lit(cds).alias("cds"), F.concat_ws("", *texts).alias("nuc")) for cds, texts in known.items()])
    return aligned.select("seq_index", F.inline(parts.cast("array<struct<cds:string,nuc:string>>")))


def translate(cds_seqs: DataFrame, stop_at_first: bool = False) -> DataFrame:
    """(seq_index, cds, aa) of every CDS that has a letter; see missing_cds for the others."""
    return cds_seqs.where(F.col("nuc").rlike("[^-]")).select("seq_index", "cds", translate_codons(F.col("nuc"), stop_at_first).alias("aa"))


def missing_cds(cds_seqs: DataFrame) -> DataFrame:
    """(seq_index, cds): coding sequences that are empty or all gaps, which aren't translated."""
    return cds_seqs.where(~F.col("nuc").rlike("[^-]")).select("seq_index", "cds")


def indel_runs(cds_seqs: DataFrame, insertions: DataFrame) -> DataFrame:
    """(seq_index, cds, begin, end, shift) of runs of adjacent gaps and insertions in CDS coordinates; shift is deleted
    minus inserted bases. insertions: (seq_index, cds, pos, size), pos being the base before."""
    cells = F.filter(F.transform(letters(F.col("nuc")), lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda c: c["x"] == "-")
    gone = cds_seqs.select("seq_index", "cds", F.explode(cells).alias("c")).select("seq_index", "cds", F.col("c.pos").alias("begin"), (F.col("c.pos") + 1).alias("end"), F.lit(1).alias("shift"))
    added = insertions.select("seq_index", "cds", (F.col("pos") + 1).alias("begin"), (F.col("pos") + 1).alias("end"), (-F.col("size")).cast("int").alias("shift"))
    w = Window.partitionBy("seq_index", "cds").orderBy("begin", "end")
    rows = gone.union(added).withColumn("new", (F.col("begin") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("seq_index", "cds", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("shift").alias("shift")).drop("run")


def frame_shifts(cds_seqs: DataFrame, insertions: DataFrame) -> DataFrame:
    """(seq_index, cds, nuc_begin, nuc_end, codon_begin, codon_end): from the first base read out of frame to the run that
    restores the frame, or the end. A run at the very start or to the very end opens none."""
    size = cds_seqs.select("seq_index", "cds", F.length("nuc").alias("size"))
    runs = indel_runs(cds_seqs, insertions).join(size, ["seq_index", "cds"]).where("begin > 0 and end < size")
    w = Window.partitionBy("seq_index", "cds").orderBy("begin")
    runs = runs.withColumn("frame", F.pmod(F.sum("shift").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(3)))
    runs = runs.withColumn("before", F.coalesce(F.lag("frame").over(w), F.lit(0)))
    edge = runs.where("(before = 0) <> (frame = 0)").withColumn("close", F.lead("begin").over(w))
    out = edge.where("before = 0").select("seq_index", "cds", F.col("end").alias("nuc_begin"), F.coalesce("close", "size").alias("nuc_end"))
    return out.withColumn("codon_begin", F.floor(F.col("nuc_begin") / 3).cast("int")).withColumn("codon_end", F.ceil(F.col("nuc_end") / 3).cast("int"))


def mask_frame_shifts(peptides: DataFrame, shifts: DataFrame) -> DataFrame:
    """peptides with X in shifted codons; a shifted codon that is a gap stays a gap."""
    spans = shifts.groupBy("seq_index", "cds").agg(F.collect_list(F.struct("codon_begin", "codon_end")).alias("spans"))
    inside = lambda i: F.exists("spans", lambda s: (i >= s["codon_begin"]) & (i < s["codon_end"]))
    masked = F.array_join(F.transform(letters(F.col("aa")), lambda a, i: F.when((a != "-") & inside(i), "X").otherwise(a)), "")
    return peptides.join(spans, ["seq_index", "cds"], "left").select("seq_index", "cds", F.when(F.col("spans").isNull(), F.col("aa")).otherwise(masked).alias("aa"))


def aa_ranges(alignment: DataFrame, segments: DataFrame) -> DataFrame:
    """(seq_index, cds, begin, end): sequenced codons of each segment; both ends are rounded down, so a partly covered
    first codon counts and a partly covered last one does not. alignment: (seq_index, begin, end)."""
    w = Window.partitionBy("cds").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("begin")).over(w), F.lit(0)))
    s = s.select("cds", F.col("begin").alias("b"), F.col("end").alias("e"), "before")
    j = alignment.join(F.broadcast(s), (F.col("begin") < F.col("e")) & (F.col("end") > F.col("b")))
    local = lambda x: F.floor((x - F.col("b") + F.col("before")) / 3).cast("int")
    return j.select("seq_index", "cds", local(F.greatest("begin", "b")).alias("begin"), local(F.least("end", "e")).alias("end"))


def unsequenced_ranges(ranges: DataFrame, peptides: DataFrame) -> DataFrame:
    """(seq_index, cds, begin, end): what the sequenced ranges leave of each peptide."""
    w = Window.partitionBy("seq_index", "cds").orderBy("begin")
    ends = peptides.select("seq_index", "cds", F.length("aa").alias("begin"), F.length("aa").alias("end"))
    rows = ranges.select("seq_index", "cds", "begin", "end").union(ends).withColumn("prev", F.coalesce(F.lag("end").over(w), F.lit(0)))
    return rows.where("begin > prev").select("seq_index", "cds", F.col("prev").alias("begin"), F.col("begin").alias("end"))


def find_aa_changes(peptides: DataFrame, ref_peptides: DataFrame, ranges: DataFrame) -> DataFrame:
    """(seq_index, cds, pos, ref, qry) of sequenced codons that differ from the reference's and are known; qry is '-' for a
    deletion. Only differing codons become rows."""
    pairs = F.zip_with(letters(F.col("aa")), letters(F.col("r")), lambda q, r: F.struct(r.alias("ref"), q.alias("qry")))
    cells = F.filter(F.transform(pairs, lambda c, i: F.struct(i.alias("pos"), c["ref"].alias("ref"), c["qry"].alias("qry"))), lambda c: (c["ref"] != c["qry"]) & (c["qry"] != "X"))
    j = peptides.join(F.broadcast(ref_peptides.select("cds", F.col("aa").alias("r"))), "cds")
    return in_range(j.select("seq_index", "cds", F.inline(cells)), ranges, ["seq_index", "cds"])


def group_aa_changes(changes: DataFrame, ranges: DataFrame, spacing: int = 3, padding: int = 2) -> DataFrame:
    """(seq_index, cds, begin, end, n): sessions of changed codons at most `spacing` apart, widened by up to `padding`
    codons on each side as far as those are sequenced."""
    w = Window.partitionBy("seq_index", "cds").orderBy("pos")
    rows = changes.withColumn("new", F.coalesce(F.col("pos") > F.lag("pos").over(w) + spacing, F.lit(True)).cast("int"))
    rows = rows.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy("seq_index", "cds", "no").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))
    pads = g.select("seq_index", "cds", "no", F.explode(F.array(*[F.struct((F.col("first") - d).alias("pos"), F.lit(0).alias("right")) for d in range(1, padding + 1)], *[F.struct((F.col("last") + d).alias("pos"), F.lit(1).alias("right")) for d in range(1, padding + 1)])).alias("p"))
    pads = in_range(pads.select("seq_index", "cds", "no", "p.pos", "p.right").where("pos >= 0"), ranges, ["seq_index", "cds"])
    wide = pads.groupBy("seq_index", "cds", "no").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    out = g.join(wide, ["seq_index", "cds", "no"], "left")
    return out.select("seq_index", "cds", F.least("first", F.coalesce("low", "first")).alias("begin"), (F.greatest("last", F.coalesce("high", "last")) + 1).alias("end"), "n")


def nuc_changes_in_groups(groups: DataFrame, subs: DataFrame, segments: DataFrame) -> DataFrame:
    """(seq_index, cds, begin, end, changes): for each group of changed codons the nucleotide changes inside it, `C12T,...` in
    the order of the genome. Codons of the groups meet the genome places of changes in an equal join."""
    spots = cds_positions(segments).select("cds", F.col("codon").alias("at"), F.col("pos"))
    cells = groups.select("seq_index", "cds", "begin", "end", F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
    muts = subs.select("seq_index", "pos", "ref", "qry").join(F.broadcast(spots), "pos")  # one genome's places: a fixed size
    text = F.struct("pos", F.concat("ref", (F.col("pos") + 1).cast("string"), "qry").alias("t"))
    found = cells.join(muts, ["seq_index", "cds", "at"]).groupBy("seq_index", "cds", "begin", "end").agg(F.array_sort(F.collect_list(text)).alias("c"))
    return found.select("seq_index", "cds", "begin", "end", F.array_join(F.transform("c", lambda x: x["t"]), ",").alias("changes"))


def codon_states(states: DataFrame, key: str, segments: DataFrame, ref: DataFrame) -> DataFrame:
    """(key, cds, pos, qry): the amino acid of each codon that some nucleotide state touches. states: (key, pos, qry) where a
    sequence or a node differs from the reference; ref: (pos, ref). Codons that can't be read are X, all-gap ones '-'."""
    spots = cds_positions(segments).join(segments.select("cds", "begin", "end", "strand"), "cds").where("pos >= begin and pos < end")
    base = lambda c: F.when(F.col("strand") == "-", reverse_complement(F.col(c))).otherwise(F.col(c))
    whole = spots.join(ref.select("pos", "ref"), "pos").select("cds", "codon", "cds_pos", base("ref").alias("ref"))
    changed = states.join(F.broadcast(spots), "pos").select(key, "cds", "codon", "cds_pos", base("qry").alias("qry"))
    touched = changed.select(key, "cds", "codon").distinct().join(F.broadcast(whole), ["cds", "codon"])
    cells = touched.join(changed, [key, "cds", "codon", "cds_pos"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cds_pos", F.coalesce("qry", "ref").alias("x")))), lambda c: c["x"]), "")
    return cells.groupBy(key, "cds", F.col("codon").alias("pos")).agg(text.alias("codon")).select(key, "cds", "pos", translate_codons(F.col("codon")).alias("qry"))


def nuc_to_aa(changes: DataFrame, segments: DataFrame) -> DataFrame:
    """(seq_index, pos, changes): for each genome position of a changed codon the sorted distinct amino-acid changes."""
    spots = cds_positions(segments).select("cds", F.col("codon").alias("codon"), F.col("pos").alias("nuc_pos"))
    j = changes.join(F.broadcast(spots), (changes.cds == spots.cds) & (changes.pos == spots.codon)).select("seq_index", "nuc_pos", F.concat(changes.cds, F.lit(":"), "ref", (F.col("pos") + 1).cast("string"), "qry").alias("t"))
    return j.groupBy("seq_index", F.col("nuc_pos").alias("pos")).agg(F.array_sort(F.collect_set("t")).alias("changes"))


def cds_coverage(peptides: DataFrame, ranges: DataFrame, ref_peptides: DataFrame) -> DataFrame:
    """(seq_index, cds, coverage): sequenced codons less unknown ones, over the length of the reference peptide."""
    n = ranges.groupBy("seq_index", "cds").agg(F.sum(F.col("end") - F.col("begin")).alias("n"))
    unknown = F.length("aa") - F.length(F.replace(F.col("aa"), F.lit("X"), F.lit("")))
    j = peptides.join(n, ["seq_index", "cds"], "left").join(F.broadcast(ref_peptides.select("cds", F.length("aa").alias("size"))), "cds")
    known = F.greatest(F.coalesce("n", F.lit(0)) - unknown, F.lit(0))
    return j.select("seq_index", "cds", F.when(F.col("size") > 0, known / F.col("size")).otherwise(0.0).alias("coverage"))


def _place(found: Column, rest: Column):
    """The place of match i: the lengths of the pieces up to it and of the matches before it."""
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    return lambda t, i: F.struct((size(rest, i + 1) + size(found, i)).alias("at"), t.alias("text"))


def find_motifs(peptides: DataFrame, ranges: DataFrame, motifs: dict[str, str]) -> DataFrame:
    """(seq_index, name, cds, pos, text): non-overlapping matches of each pattern inside the sequenced ranges. Positions come
    from the lengths of the pieces between the matches."""
    spans = peptides.join(ranges, ["seq_index", "cds"]).select("seq_index", "cds", "begin", F.substr("aa", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("s"))
    out = None
    for name, pattern in sorted(motifs.items()):
        found, rest = F.regexp_extract_all("s", F.lit(pattern), F.lit(0)), F.split("s", pattern, -1)
        place = F.transform(found, _place(found, rest))
        one = spans.where(F.col("s").rlike(pattern)).select("seq_index", F.lit(name).alias("name"), "cds", "begin", F.inline(place)).select("seq_index", "name", "cds", (F.col("begin") + F.col("at")).alias("pos"), "text")
        out = one if out is None else out.union(one)
    return out


def motif_changes(motifs: DataFrame, ref_motifs: DataFrame, peptides: DataFrame, ranges: DataFrame) -> DataFrame:
    """(seq_index, name, cds, pos, ref_text, qry_text, change): gained, lost, preserved or ambiguous. A motif of the
    reference is lost only where the query is fully sequenced; it is ambiguous if the query's letters there have an X."""
    r = ref_motifs.select("name", "cds", "pos", F.col("text").alias("ref_text"))
    wanted = peptides.join(F.broadcast(r), "cds").select("seq_index", "name", "cds", "pos", "ref_text", F.substr("aa", F.col("pos") + 1, F.length("ref_text")).alias("here"))
    q = motifs.select("seq_index", "name", "cds", "pos", F.col("text").alias("qry_text"))
    j = wanted.join(q, ["seq_index", "name", "cds", "pos"], "full_outer")
    both, gained = j.where("qry_text is not null and ref_text is not null"), j.where("ref_text is null")
    gone = j.where("qry_text is null").withColumn("last", F.col("pos") + F.length("ref_text"))
    r2 = ranges.select("seq_index", "cds", F.col("begin").alias("b"), F.col("end").alias("e"))
    gone = gone.join(r2, (gone.seq_index == r2.seq_index) & (gone.cds == r2.cds) & (F.col("pos") >= F.col("b")) & (F.col("last") <= F.col("e")), "left_semi")
    cols = ["seq_index", "name", "cds", "pos", "ref_text"]
    out = both.select(*cols, "qry_text", F.lit("preserved").alias("change")).union(gained.select(*cols, "qry_text", F.lit("gained").alias("change")))
    return out.union(gone.select(*cols, "here", F.when(F.col("here").contains("X"), "ambiguous").otherwise("lost").alias("change")))


def phenotype(seqs: DataFrame, aa_subs: DataFrame, coefficients: DataFrame, weights: DataFrame, cds: str) -> DataFrame:
    """(seq_index, score): -ln of the weighted sum over entries of exp(-sum of coefficients). coefficients: (entry, pos, aa,
    coef), a null aa being the default of its place; weights: (entry, weight). Sequences without substitutions score too."""
    c = coefficients.where("aa is not null").withColumnRenamed("coef", "exact")
    d = coefficients.where("aa is null").select("entry", "pos", F.col("coef").alias("default"))
    spots = coefficients.select("entry", "pos").distinct()
    j = aa_subs.where(F.col("cds") == cds).join(F.broadcast(spots), "pos")
    j = j.join(F.broadcast(c), (j.pos == c.pos) & (j.entry == c.entry) & (j.qry == c.aa), "left").select("seq_index", j.entry, j.pos, "exact").join(F.broadcast(d), ["entry", "pos"], "left")
    sums = j.groupBy("seq_index", "entry").agg(F.sum(F.coalesce("exact", "default", F.lit(0.0))).alias("s"))
    full = seqs.select("seq_index").join(F.broadcast(weights), F.lit(True)).join(sums, ["seq_index", "entry"], "left")
    total = F.sum(F.col("weight") * F.exp(-F.coalesce("s", F.lit(0.0))))
    return full.groupBy("seq_index").agg((-F.ln(total) + 0.0).alias("score"))
