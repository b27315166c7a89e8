"""Result tables: text cells, filters, sorts, unions and comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolake.functions.mutations import mutation_text, range_text


def joined(rows: DataFrame, keys: list[str], text: Column, order: list[str], name: str, sep: str = ",") -> DataFrame:
    """(keys, name): text of each key's rows, in order, joined."""
    packed = F.array_sort(F.collect_list(F.struct(*order, text.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["t"]), sep).alias(name))


def substitution_cells(subs: DataFrame) -> DataFrame:
    """`A23T,C44G` for each sequence; with CDS names for amino acids; `A23T|label1&label2` where labels are given."""
    cds = F.col("cds") if "cds" in subs.columns else F.lit("nuc")
    text = mutation_text(cds, F.col("ref"), F.col("pos"), F.col("qry"))
    if "labels" in subs.columns:
        text = F.when(F.col("labels").isNotNull(), F.concat(text, F.lit("|"), F.array_join("labels", "&"))).otherwise(text)
    return joined(subs, ["seq_index"], text, ["pos", "qry"] if "cds" not in subs.columns else ["cds", "pos", "qry"], "substitutions")


def range_cells(ranges: DataFrame, name: str) -> DataFrame:
    """`5-9,12` for each sequence; with the letter (`R:5-9`) where one is given."""
    text = range_text(F.col("begin"), F.col("end"))
    if "letter" in ranges.columns:
        text = F.concat("letter", F.lit(":"), text)
    return joined(ranges, ["seq_index"], text, ["begin", "end"], name)


def insertion_cells(insertions: DataFrame) -> DataFrame:
    """`22:ACG` for each sequence."""
    return joined(insertions, ["seq_index"], F.concat((F.col("pos") + 1).cast("string"), F.lit(":"), "ins"), ["pos", "ins"], "insertions")


def primer_cells(changes: DataFrame) -> DataFrame:
    """`name:A23T;C25G` for each primer and sequence."""
    one = joined(changes, ["seq_index", "name"], mutation_text(F.lit("nuc"), F.col("ref"), F.col("pos"), F.col("qry")), ["pos", "qry"], "m", ";")
    return joined(one, ["seq_index"], F.concat_ws(":", "name", "m"), ["name"], "primer_changes")


def score_text(score: Column) -> Column:
    """Six decimals unless whole."""
    return F.when(score == F.round(score), F.format_string("%.0f", score)).otherwise(F.format_string("%.6f", score))


def aa_cells(changes: DataFrame, name: str = "aa_changes") -> DataFrame:
    """`S:N501Y,S:L5-` for each sequence, by CDS and position."""
    return joined(changes, ["seq_index"], mutation_text(F.col("cds"), F.col("ref"), F.col("pos"), F.col("qry")), ["cds", "pos", "qry"], name)


def combine_outputs_and_errors(ok: DataFrame, failed: DataFrame) -> DataFrame:
    """Good and failed rows together; failed ones keep index, name and errors. seq_index gives the input order; sort at the
    sink if order is wanted."""
    return ok.unionByName(failed.select("seq_index", "seq_name", "errors"), allowMissingColumns=True)


def in_input_order(results: DataFrame) -> DataFrame:
    return results.orderBy("seq_index")


def filter_by_name(results: DataFrame, terms: str) -> DataFrame:
    """Names with any of the terms (split at line ends, commas and semicolons) inside, whatever the case."""
    parts = [t.strip().lower() for t in terms.replace("\n", ",").replace(";", ",").split(",") if t.strip()]
    return results.where(reduce(lambda a, b: a | b, [F.lower("seq_name").contains(t) for t in parts])) if parts else results


def nuc_pattern(text: str) -> tuple[str | None, int | None, str | None] | None:
    """(ref, pos, qry) of a partial pattern `A23T`, `A23`, `23T`, `23`; `.` and absence mean any; null if not of that form."""
    import re

    if not (m := re.fullmatch(r"([A-Z.*-]?)([0-9]*|\.)([A-Z.*-]?)", text.strip().upper())) or not any(m.groups()):
        return None
    ref, pos, qry = (None if x in ("", ".") else x for x in m.groups())
    return ref, None if pos is None else int(pos) - 1, qry


def filter_by_nuc(results: DataFrame, subs: DataFrame, patterns: str) -> DataFrame:
    """Results with any substitution that fits any pattern."""
    tests = [F.lit(False)]
    for text in patterns.replace("\n", ",").replace(";", ",").split(","):
        if (p := nuc_pattern(text)) is not None:
            ref, pos, qry = p
            t = F.lit(True)
            for name, value in (("ref", ref), ("pos", pos), ("qry", qry)):
                t = t & (F.col(name) == value) if value is not None else t
            tests.append(t)
    hit = subs.where(reduce(lambda a, b: a | b, tests)).select("seq_index").distinct()
    return results.join(hit, "seq_index", "left_semi")


def filter_by_aa(results: DataFrame, changes: DataFrame, patterns: str) -> DataFrame:
    """Results with any amino-acid change that fits any of `S:N501Y`, `S:`, `:484`, `S:501`; deletions have the letter -."""
    tests = [F.lit(False)]
    for text in patterns.replace("\n", ",").replace(";", ",").split(","):
        cds, colon, rest = text.strip().partition(":")
        if not colon:
            continue
        t = F.lower("cds") == cds.lower() if cds not in ("", ".") else F.lit(True)
        if rest and (p := nuc_pattern(rest)) is not None:
            for name, value in zip(("ref", "pos", "qry"), p, strict=True):
                t = t & (F.col(name) == value) if value is not None else t
        tests.append(t)
    hit = changes.where(reduce(lambda a, b: a | b, tests)).select("seq_index").distinct()
    return results.join(hit, "seq_index", "left_semi")


def filter_by_clade(results: DataFrame, clades: str) -> DataFrame:
    """Clades that begin with any of the terms, whatever the case; rows without a result go."""
    parts = [t.strip().lower() for t in clades.replace("\n", ",").replace(";", ",").split(",") if t.strip()]
    return results.where(reduce(lambda a, b: a | b, [F.lower("clade").startswith(t) for t in parts])) if parts else results


def filter_by_qc(results: DataFrame, statuses: list[str], errors: bool) -> DataFrame:
    ok = F.coalesce(F.col("qc_status").isin(statuses), F.lit(False))
    return results.where(ok | F.col("errors").isNotNull() if errors else ok & F.col("errors").isNull())


def run_filters(results: DataFrame, subs: DataFrame, changes: DataFrame, name: str = "", nuc: str = "", aa: str = "", clade: str = "", statuses: list[str] | None = None, errors: bool = True) -> DataFrame:
    """All filters that are not empty, one after another."""
    out = filter_by_name(results, name) if name else results
    out = filter_by_nuc(out, subs, nuc) if nuc else out
    out = filter_by_aa(out, changes, aa) if aa else out
    out = filter_by_clade(out, clade) if clade else out
    return out if statuses is None else filter_by_qc(out, statuses, errors)


def sort_results(results: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Sorted by a column, or by frame shifts or stops (total * 1000 + ignored); missing values last either way, ties by
    input order. Failed rows have no values, so they come last too."""
    key = F.col(f"n_{by}") * 1000 + F.col(f"n_{by}_ignored") if by in ("frame_shifts", "stop_codons") else F.col(by)
    return results.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "seq_index")


def sort_by_entry(results: DataFrame, column: str, key: str, descending: bool = False) -> DataFrame:
    """Sorted by one entry of a map column (attribute, phenotype, motif count); an absent entry counts as empty text."""
    v = F.coalesce(F.try_element_at(column, F.lit(key)).cast("string"), F.lit(""))
    return results.orderBy(v.desc() if descending else v.asc(), "seq_index")


def mutations_relative_to(tables: dict[str, DataFrame], which: str) -> DataFrame:
    """Mutations against one of several targets (root, parent, clade founder, attribute founder, named searches)."""
    stacked = reduce(DataFrame.unionByName, [t.withColumn("ref_kind", F.lit(k)) for k, t in sorted(tables.items())])
    return stacked.where(F.col("ref_kind") == which)


def qc_status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("qc_status").agg(F.count("*").alias("n"))


def diff_runs(base: DataFrame, evaluated: DataFrame, columns: list[str], lists: list[str], key: str = "index") -> DataFrame:
    """(key, column, base, eval, gone, new, shared) for each differing cell of two runs; lists are compared item by item.
    One outer join; rows of one run alone have the column `row`."""
    a = base.select(key, F.lit(True).alias("a_"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = evaluated.select(key, F.lit(True).alias("b_"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    j = a.join(b, key, "full_outer")
    items = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    empty = F.lit(None).cast("string")
    cells = [F.struct(F.lit("row").alias("column"), F.when(F.col("a_"), "present").alias("base"), F.when(F.col("b_"), "present").alias("eval"), empty.alias("gone"), empty.alias("new"), empty.alias("shared"))]
    for c in columns:
        x, y = items(F.col(f"a_{c}")), items(F.col(f"b_{c}"))
        sets = [F.array_join(F.array_sort(s), ",") if c in lists else empty for s in (F.array_except(x, y), F.array_except(y, x), F.array_intersect(x, y))]
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("base"), F.col(f"b_{c}").alias("eval"), sets[0].alias("gone"), sets[1].alias("new"), sets[2].alias("shared")))
    rows = j.select(key, F.coalesce(F.col("a_") & F.col("b_"), F.lit(False)).alias("both"), F.inline(F.array(*cells)))
    return rows.where((F.col("column") == "row") & ~F.col("both") | (F.col("column") != "row") & F.col("both") & ~F.col("base").eqNullSafe(F.col("eval"))).drop("both")
