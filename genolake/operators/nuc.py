"""Calls on aligned nucleotide sequences: table aligned(seq_index, aln), aln in reference coordinates from position 0."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from genolake.functions.seq import CODES, gap_counts, letters
from genolake.operators.ranges import islands


GAPS = re.compile("-+")


def by_text(texts: DataFrame, out: str, found: Callable[..., list[list]]) -> DataFrame:
    """texts(seq_index, text, ..) without nulls -> (seq_index, columns of `out`): the rows that `found` gives for each row's texts, as
    one list a column. For what looks at every letter of a text and finds few."""
    schema = StructType([texts.schema["seq_index"], *StructType.fromDDL(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            made = [found(*row) for row in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
            sizes = [len(m[0]) for m in made]
            owner = pa.array(np.repeat(np.arange(len(made)), sizes))
            columns = [pa.array([x for m in made for x in m[k]], arrow.field(k + 1).type) for k in range(len(arrow) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner).cast(arrow.field(0).type), *columns], schema=arrow)

    return texts.dropna(subset=texts.columns[1:]).mapInArrow(run, schema)


def points(seqs: DataFrame, keep: str, column: str = "aln") -> DataFrame:
    """(seq_index, pos, letter) of the letters in `keep` (a regular expression of one letter); others never become rows."""
    wanted = re.compile(keep)

    def found(text: str) -> list[list]:
        at = [m.start() for m in wanted.finditer(text)]
        return [at, [text[k] for k in at]]

    return by_text(seqs.select("seq_index", column), "pos int, letter string", found)


def letter_composition(seqs: DataFrame, column: str = "aln", alphabet: str = CODES) -> DataFrame:
    """(seq_index, letter, n): one scan of the text for each code, no row for each letter."""
    size = F.length(column)
    counts = F.array(*[F.struct(F.lit(c).alias("letter"), (size - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))).cast("long").alias("n")) for c in alphabet])
    return seqs.select("seq_index", F.inline(counts)).where("n > 0")


def letter_ranges(seqs: DataFrame, pattern: str, column: str = "aln") -> DataFrame:
    """(seq_index, letter, begin, end): maximal runs of one letter that matches the pattern."""
    return islands(points(seqs, pattern, column), ["seq_index", "letter"])


def gap_summary(seqs: DataFrame, column: str = "aln") -> DataFrame:
    g = gap_counts(F.col(column))
    return seqs.select("seq_index", g["leading"].alias("leading"), g["internal"].alias("internal"), g["trailing"].alias("trailing"), g["total"].alias("total"))


def alignment_range(aligned: DataFrame) -> DataFrame:
    """(seq_index, begin, end) from the first to after the last letter that is no gap; nulls for all-gap sequences."""
    begin, end = F.length(F.regexp_extract("aln", "^-*", 0)), F.length(F.rtrim(F.col("aln"), F.lit("-")))
    some = begin < end
    return aligned.select("seq_index", F.when(some, begin).alias("begin"), F.when(some, end).alias("end"))


def find_nuc_subs(aligned: DataFrame, ref: str) -> DataFrame:
    """(seq_index, pos, ref, qry) where the query has a plain nucleotide other than the reference's. Only these places
    become rows; ambiguous letters and gaps never count."""
    return by_text(aligned.select("seq_index", "aln"), "pos int, ref string, qry string", subs_found(ref))


def subs_found(ref: str) -> Callable[[str], list[list]]:
    whole, plain = np.frombuffer(ref.encode(), np.uint8), np.isin(np.arange(256), list(b"ACGT"))

    def found(text: str) -> list[list]:
        own = np.frombuffer(text.encode("ascii", "replace"), np.uint8)[: len(whole)]  # a byte a letter
        at = np.flatnonzero((own != whole[: len(own)]) & plain[own]).tolist()
        return [at, [ref[k] for k in at], [text[k] for k in at]]

    return found


def ends(text: str) -> tuple[int, int]:
    """From the first to after the last letter that is no gap; an empty range where all are."""
    end = len(text.rstrip("-"))
    return min(end, len(text) - len(text.lstrip("-"))), end


def find_nuc_dels(aligned: DataFrame) -> DataFrame:
    """(seq_index, begin, end): runs of gaps between the first and the last letter that is no gap."""

    def found(text: str) -> list[list]:
        return [[k for m in GAPS.finditer(text, *ends(text)) for k in range(m.start(), m.end())]]

    return islands(by_text(aligned.select("seq_index", "aln"), "pos int", found), ["seq_index"])


def coverage(aligned: DataFrame, ref_length: int) -> DataFrame:
    """(seq_index, coverage): share of the reference that is aligned, known and unambiguous."""
    total = lambda r: F.length(F.regexp_replace("aln", f"[^{r}]", ""))
    begin, end = F.length(F.regexp_extract("aln", "^-*", 0)), F.length(F.rtrim(F.col("aln"), F.lit("-")))
    span = F.greatest(end - begin, F.lit(0))
    return aligned.select("seq_index", ((span - total("N") - total("YRWSKMDVHB")) / F.lit(float(ref_length))).alias("coverage"))


def validate_alphabet(seqs: DataFrame, column: str = "seq", replace: bool = False) -> DataFrame:
    """seqs with `errors` filled where a letter is none of the 16 codes; or, with replace, such letters made N."""
    bad = f"[^{CODES}]"
    if replace:
        return seqs.withColumn(column, F.regexp_replace(column, bad, "N")).withColumn("errors", F.lit(None).cast("string"))
    found = F.regexp_extract(column, bad, 0)
    return seqs.withColumn("errors", F.when(found != "", F.concat(F.lit("unknown letter: "), found)))


def validate_ref(ref: str) -> None:
    """Raises if a reference is empty or has a letter that is no nucleotide code, or a gap."""
    if not ref:
        raise ValueError("the reference sequence is empty")
    if bad := sorted(set(ref) - set(CODES.replace("-", ""))):
        raise ValueError(f"the reference sequence has {', '.join(bad)}")


def ref_positions(alignments: DataFrame) -> DataFrame:
    """(seq_index, aln_pos, ref_pos, qry_pos) for each alignment column of (seq_index, qry_aln, ref_aln): the index of the
    reference and query base at or before it; columns before the first reference base map to 0."""
    w = Window.partitionBy("seq_index").orderBy("aln_pos").rowsBetween(Window.unboundedPreceding, 0)
    cells = F.zip_with(letters(F.col("qry_aln")), letters(F.col("ref_aln")), lambda q, r: F.struct((q != "-").cast("int").alias("q"), (r != "-").cast("int").alias("r")))
    rows = alignments.select("seq_index", F.posexplode(cells).alias("aln_pos", "c"))
    running = lambda x: F.greatest(F.sum(F.col(f"c.{x}")).over(w) - 1, F.lit(0)).cast("int")
    return rows.select("seq_index", "aln_pos", running("r").alias("ref_pos"), running("q").alias("qry_pos"))


def strip_insertions(alignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aligned, insertions) of (seq_index, qry_aln, ref_aln): aligned(seq_index, aln) without the columns where the
    reference has a gap; insertions(seq_index, pos, ins), pos being the reference index before (-1 at the start)."""
    out = stripped(alignments)
    return out.select("seq_index", "aln"), out.select("seq_index", F.inline("insertions"))


def without_gap_columns(qry: str, ref: str) -> tuple[str, list[dict]]:
    """The query in the reference's columns, and what stands between them."""
    kept, gone, at, added = [], 0, 0, []
    for g in GAPS.finditer(ref):
        kept.append(qry[at : g.start()])
        if ins := qry[g.start() : g.end()].replace("-", ""):
            added.append({"pos": g.start() - gone - 1, "ins": ins})
        at, gone = g.end(), gone + g.end() - g.start()
    return "".join([*kept, qry[at:]]), added


def stripped(alignments: DataFrame) -> DataFrame:
    """(seq_index, aln, insertions): both tables of strip_insertions() in one; insertions: array<struct<pos,ins>>."""
    found = lambda qry, ref: [[x] for x in without_gap_columns(qry, ref)]
    return by_text(alignments.select("seq_index", "qry_aln", "ref_aln"), "aln string, insertions array<struct<pos:int,ins:string>>", found)


def calls(alignments: DataFrame, ref: str) -> DataFrame:
    """(seq_index, aln, insertions, subs, dels, missing, unknown, begin, end): one row for each of (seq_index, qry_aln, ref_aln), with what
    strip_insertions(), find_nuc_subs(), find_nuc_dels() and alignment_range() give, and the ranges of N and of letters other
    than A, C, G and T, as arrays."""
    subs_of, missing, unknown = subs_found(ref), re.compile("N+"), re.compile("[^ACGT-]+")

    def found(qry: str, ref_aln: str) -> list[list]:
        aln, added = without_gap_columns(qry, ref_aln)
        begin, end = ends(aln)
        ranges = [[{"begin": m.start(), "end": m.end()} for m in x] for x in (GAPS.finditer(aln, begin, end), missing.finditer(aln), unknown.finditer(aln))]
        subs = [dict(zip(("pos", "ref", "qry"), x, strict=True)) for x in zip(*subs_of(aln), strict=True)]
        some = begin < end
        return [[aln], [added], [subs], *[[r] for r in ranges], [begin if some else None], [end if some else None]]

    spans = ", ".join(f"{c} array<struct<begin:int,end:int>>" for c in ("dels", "missing", "unknown"))
    out = f"aln string, insertions array<struct<pos:int,ins:string>>, subs array<struct<pos:int,ref:string,qry:string>>, {spans}, begin int, end int"
    return by_text(alignments.select("seq_index", "qry_aln", "ref_aln"), out, found)


def cds_positions(segments: DataFrame) -> DataFrame:
    """(cds, pos, cds_pos, codon): each genome position of each CDS. segments: (cds, seg_no, begin, end, strand); a reverse
    segment counts from its end. Circular genomes give two segments. A position may be in several CDSes."""
    w = Window.partitionBy("cds").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("_before", F.coalesce(F.sum(F.col("end") - F.col("begin")).over(w), F.lit(0)))
    s = s.select("cds", "begin", "end", "strand", "_before", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    local = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("begin"))
    return s.select("cds", "pos", (local + F.col("_before")).cast("int").alias("cds_pos")).withColumn("codon", F.floor(F.col("cds_pos") / 3).cast("int"))
