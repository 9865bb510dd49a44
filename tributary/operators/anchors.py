"""Heading anchors: each entry of a table of contents gets one heading of its document, and no heading two.

Entries and headings of a document meet on a shared word, and their match is judged by tiers: A the same
title, B the same section or the title with a qualifier behind it, C most words in common, D one within
the other. Matches of tiers A and B tell how far printed page numbers are off, for each way of
numbering, if enough of them agree. Then the entries of a document choose in their order: the best
heading left, by tier, likeness, and distance from where the offset expects it. A heading that is
chosen is gone for later entries. That last step is a loop over candidates in this order, streamed through
Arrow batches of whatever size; everything before it is joins and grouped sums.

Weights and limits are fixed values of the score. Likeness is the share of words in common (twice the
words of both over the words of each).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
LEAST_SCORE, NEAR_TIE = 0.68, 0.12
TIERS = {"A": 4, "B": 3, "C": 2, "D": 1}
BONUS = {"heading_role": 0.07, "uppercase": 0.03, "top_of_page": 0.05, "page_label": 0.03, "before_table": 0.02}
HEADING_ROLES = ("title", "sectionheading", "section_heading", "heading")
TOP_SHARE, UPPER_SHARE = 0.35, 0.8
OFFSET_LEAST, OFFSET_SHARE = 2, 0.72
#: Words that don't tell titles apart, and words that may stand behind a whole title.
PLAIN_WORDS = ("the", "of", "and", "to", "for", "in", "on", "a", "an", "by", "as", "at")
QUALIFIERS = ("continued", "cont", "consolidated", "group", "company", "notes")

ANCHORS = "doc_id {doc}, entry_no long, heading_id {heading}, page int, tier string, method string, score double, distance int, near_tie boolean, same_page_tie boolean"


def normalized(title: Column) -> Column:
    """Lower-case words, without leaders and page numbers at the end or a number before."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[\s.]*\d*\s*$", "")
    t = F.regexp_replace(t, r"^\s*(note\s+)?\d+(\.\d+)*[.)]?\s+", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def words(norm: Column) -> Column:
    return F.filter(F.array_distinct(F.split(norm, " ")), lambda w: ~w.isin("", *PLAIN_WORDS))


def matches(entries: DataFrame, headings: DataFrame, sections: dict[str, str] | None = None) -> DataFrame:
    """Trusted pairs of entries and headings of a document, with tier, method, likeness and score.

    entries: doc_id, entry_no, title, printed_page (null: unknown), printed_label, scheme. headings: doc_id,
    heading_id, page (from 1), text, and, null where unknown, role, top, page_height, page_labels,
    before_table. sections: normalised title -> section; equal sections are a match of tier B.
    """
    e = entries.select("doc_id", "entry_no", "printed_page", "printed_label", "scheme", normalized(F.col("title")).alias("e_norm"))
    c = F.col
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    own = {
        "heading_role": F.lower("role").isin(*HEADING_ROLES),
        "uppercase": (letters > 0) & (F.regexp_count("text", F.lit(r"\p{Lu}")) >= UPPER_SHARE * letters),
        "top_of_page": (c("page_height") > 0) & (c("top") <= TOP_SHARE * c("page_height")),
        "before_table": c("before_table"),
    }
    h = headings.select("doc_id", "heading_id", "page", "page_labels", normalized(F.col("text")).alias("h_norm"), *(F.coalesce(x, F.lit(False)).alias(k) for k, x in own.items()))
    e, h = e.withColumn("e_words", words(F.col("e_norm"))), h.withColumn("h_words", words(F.col("h_norm")))
    known = F.create_map(*(F.lit(x) for kv in sections.items() for x in kv)) if sections else None
    # the section is one more word to meet on
    met_on = lambda words, norm: F.concat(words, F.when(F.element_at(known, norm).isNotNull(), F.array(F.concat(F.lit("\u0000"), F.element_at(known, norm)))).otherwise(F.array().cast("array<string>"))) if known is not None else words
    left = e.select("doc_id", "entry_no", F.size("e_words").alias("_m"), F.explode(met_on(F.col("e_words"), F.col("e_norm"))).alias("w"))
    right = h.select("doc_id", "heading_id", F.size("h_words").alias("_n"), F.explode(met_on(F.col("h_words"), F.col("h_norm"))).alias("w"))
    met_by = left.join(right, ["doc_id", "w"]).groupBy("doc_id", "entry_no", "heading_id")
    counted = met_by.agg(F.count("*").alias("_k"), F.min("_m").alias("_m"), F.min("_n").alias("_n"), F.bool_or(F.startswith("w", F.lit("\u0000"))).alias("_section"))
    # every method but same_section has all words of the entry in common, or four fifths of those of both
    pairs = counted.where((c("_k") >= c("_m")) | (10 * c("_k") >= 4 * (c("_m") + c("_n"))) | c("_section")).select("doc_id", "entry_no", "heading_id")
    met = pairs.join(e, ["doc_id", "entry_no"]).join(h, ["doc_id", "heading_id"])
    both = F.size(F.array_intersect("e_words", "h_words"))
    met = met.withColumns({"_k": both, "_m": F.size("e_words"), "_n": F.size("h_words"), "_a": F.length(F.replace("e_norm", F.lit(" "), F.lit(""))), "_b": F.length(F.replace("h_norm", F.lit(" "), F.lit("")))})
    alike = F.when(F.col("e_norm") == F.col("h_norm"), 1.0).otherwise(2 * F.col("_k") / (F.col("_m") + F.col("_n")))
    met = met.withColumns({"alike": F.round(alike, 4), "expected": F.col("_k") / F.col("_m"), "observed": F.col("_k") / F.col("_n"), "lengths": F.least("_a", "_b") / F.greatest("_a", "_b")})
    cover = F.least("expected", "observed")
    needed = F.when(c("_m") <= 3, 1.0).otherwise(0.8)
    after = F.split(F.substring("h_norm", F.length("e_norm") + 2, F.length("h_norm")), " ")[0]
    section = (F.element_at(known, c("e_norm")) == F.element_at(known, c("h_norm"))) if known is not None else F.lit(False)
    qualified = F.startswith("h_norm", F.concat("e_norm", F.lit(" "))) & (after.isin(*QUALIFIERS) | after.rlike("^[0-9]+$"))
    within = F.contains("h_norm", c("e_norm")) | F.contains("e_norm", c("h_norm"))
    rules = [
        ("A", "same_title", c("e_norm") == c("h_norm"), F.lit(0.90)),
        ("B", "same_section", F.coalesce(section, F.lit(False)), F.lit(0.88)),
        ("B", "same_words", F.array_sort("e_words") == F.array_sort("h_words"), F.lit(0.89)),
        ("B", "title_and_qualifier", qualified, 0.87 + F.least(F.lit(0.08), c("alike") * 0.08)),
        ("C", "most_words", (c("alike") >= 0.84) & (cover >= 0.6) & (c("lengths") >= 0.6), 0.78 + c("alike") * 0.16 + cover * 0.04),
        ("D", "one_within_the_other", within & (F.least("_a", "_b") >= 8) & (c("expected") >= needed) & (c("observed") >= 0.8) & (c("lengths") >= 0.45), 0.74 + cover * 0.12 + c("lengths") * 0.06),
    ]
    first = lambda k: reduce(lambda rest, r: F.when(r[2], r[k] if k == 3 else F.lit(r[k])).otherwise(rest), reversed(rules), F.lit(None))
    label = F.coalesce(F.array_contains("page_labels", F.lower(F.coalesce("printed_label", c("printed_page").cast("string")))), F.lit(False))
    plus = reduce(lambda a, k: a + F.when(label if k == "page_label" else c(k), BONUS[k]).otherwise(0.0), BONUS, F.lit(0.0))
    out = met.select(
        "doc_id", "entry_no", "heading_id", "page", "printed_page", "scheme", "alike", F.round("expected", 4).alias("expected"),
        first(0).alias("tier"), first(1).alias("method"), F.round(F.least(F.lit(1.0), first(3) + plus), 4).alias("score"),
    )
    return out.where(F.col("tier").isNotNull() & (F.col("score") >= LEAST_SCORE))


def order_of_tiers() -> Column:
    return reduce(lambda rest, t: F.when(F.col("tier") == t, TIERS[t]).otherwise(rest), TIERS, F.lit(0))


def with_offset(found: DataFrame) -> DataFrame:
    """found with offset: by how many pages the printed numbers of its scheme are off, where most of tiers A and B agree."""
    c = F.col
    sure = c("tier").isin("A", "B") & c("printed_page").isNotNull() & c("scheme").isNotNull()
    best = Window.partitionBy("doc_id", "entry_no", "_sure").orderBy(F.desc(order_of_tiers()), F.desc("alike"), F.desc("expected"), F.desc("score"), "page", "heading_id")
    weight = F.when(c("tier") == "A", 1.0).otherwise(0.9) * (0.65 + 0.35 * c("alike"))
    # the others' vote is null, and counts nowhere
    rows = found.repartition("doc_id").withColumn("_sure", sure).withColumn("_vote", F.when(c("_sure") & (F.row_number().over(best) == 1), weight))
    rows = rows.withColumn("_off", F.when(c("_vote").isNotNull(), c("page") - 1 - c("printed_page")))
    same, scheme = Window.partitionBy("doc_id", "scheme", "_off"), Window.partitionBy("doc_id", "scheme")
    rows = rows.withColumns({"_support": F.round(F.sum("_vote").over(same), 9), "_n": F.count("_vote").over(same), "_nth": F.row_number().over(same.orderBy("entry_no", "heading_id"))})
    first = F.first(F.struct("_support", "_n", "_off")).over(scheme.orderBy(F.desc("_support"), F.desc("_n"), F.abs("_off"), "_off"))
    rows = rows.withColumns({"_first": first, "_all": F.sum(F.when(c("_nth") == 1, c("_support"))).over(scheme)})
    agreed = (c("_first._n") >= OFFSET_LEAST) & (c("_first._support") >= OFFSET_SHARE * c("_all"))
    return rows.select(*found.columns, F.when(agreed, c("_first._off")).alias("offset"))


def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates in the order of documents, entries and places, streamed: each entry takes the first heading that is left.

    What is kept are the headings taken in one document and the choice of one entry.
    """
    doc = entry = object()
    used: set = set()
    top, near, same = None, False, False
    names, types = [c.split()[0] for c in ANCHORS.split(", ")], None

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    for rows in batches:
        types = [rows.schema.field(n).type for n in names[:8]] + [pa.bool_()] * 2
        out = []
        for row in zip(*(rows.column(n).to_pylist() for n in names[:8]), strict=True):
            if row[0] != doc or row[1] != entry:
                if top:
                    out.append((*top, near, same))
                if row[0] != doc:
                    used = set()
                doc, entry, top, near, same = row[0], row[1], None, False, False
            if row[2] in used:
                continue
            if top is None:
                top = row
                used.add(row[2])
            elif row[4] == top[4] and round(top[6] - row[6], 4) <= NEAR_TIE:
                near, same = near or row[3] != top[3], same or row[3] == top[3]
        yield batch(out)
    if top:
        yield batch([(*top, near, same)])


def anchors(entries: DataFrame, headings: DataFrame, sections: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, entry_no, heading_id, page, tier, method, score, distance, near_tie, same_page_tie).

    distance: pages between the heading and where the document's offset expects it, null if unknown.
    near_tie, same_page_tie: another heading of the same tier was as good within NEAR_TIE, on another or
    on the same page. Entries without a trusted heading left have no row. Keys are unique in a document;
    rows with a null key are in no pair.
    """
    found = with_offset(matches(entries, headings, sections))
    found = found.withColumn("distance", F.abs(F.col("page") - 1 - F.col("printed_page") - F.col("offset")).cast("int"))
    order = [F.desc(order_of_tiers()), F.desc("alike"), F.desc("expected"), F.coalesce("distance", F.lit(0)), F.desc("score"), "page", "heading_id"]
    placed = found.repartition("doc_id").sortWithinPartitions("doc_id", "entry_no", *order).select("doc_id", "entry_no", "heading_id", "page", "tier", "method", "score", "distance")
    types = dict(headings.select("doc_id", "heading_id").dtypes)
    return placed.mapInArrow(chosen, ANCHORS.format(doc=types["doc_id"], heading=types["heading_id"]))
