"""Named queries over the driver's tables. Each is an operator of this library on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions import amounts, labels, similarity
from tributary.operators import duplicates, joins, ordered, quality_gates, ranking, rollups, rulebook, state, vectors, windows_time
from tributary.sources import xbrl
from tributary.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def number(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def revenue() -> Column:
    return money("l_extendedprice") * (1 - money("l_discount"))


# --- rollups and counts


@query
def calc_rollup_validation(spark: SparkSession, d: str) -> DataFrame:
    """Order totals against the sum of their lines."""
    orders = table(spark, d, "orders").select("o_orderkey", money("o_totalprice").alias("total"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (revenue() * (1 + money("l_tax"))).alias("amount"))
    out = rollups.validate_rollup(orders, lines, ["o_orderkey"], "total", "amount", share=0.02, least=1.0)
    return out.select("o_orderkey", number("total").alias("total"), number("computed").alias("computed"), "n_children", number("difference").alias("difference"), "status")


@query
def count_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query
def stats_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Customers in all, by segment, and by nation, in one pass."""
    c = table(spark, d, "customer")
    out = c.groupingSets([[], [c.c_mktsegment], [c.c_nationkey]], c.c_mktsegment, c.c_nationkey).agg(F.count("*").alias("n"))
    return out.select("c_mktsegment", "c_nationkey", "n")


@query
def rollup_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), number(F.sum(money("l_quantity"))).alias("quantity"))


@query
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    met = o.join(c, o.o_custkey == c.c_custkey)
    big = F.col("o_totalprice") > 1000
    return met.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(big).alias("big"), F.count_if(big & (F.col("o_orderstatus") == "F")).alias("big_done"))


@query
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Per nation the orders by status, zero-filled, for nations without orders too."""
    n, c, o = (table(spark, d, x) for x in ("nation", "customer", "orders"))
    met = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return met.groupBy("n_name").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(k) for s, k in (("F", "done"), ("O", "open"), ("P", "pending"))), F.count("o_orderkey").alias("total"))


@query
def having_top1(spark: SparkSession, d: str) -> DataFrame:
    """The supplier with most returned lines among those with enough lines and returns."""
    out = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returned"))
    return out.where("n >= 10 and returned >= 3").orderBy(F.desc("returned"), F.desc("n"), "l_suppkey").limit(1)


@query
def distinct_gap(spark: SparkSession, d: str) -> DataFrame:
    """Parts less the distinct parts that were ordered, at least 0."""
    total = table(spark, d, "part").agg(F.count("*").alias("total"))
    used = table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("used"))
    return total.join(used).select("total", "used", F.greatest(F.col("total") - F.col("used"), F.lit(0)).cast("long").alias("gap"))


@query
def integrity_orphans(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for child, ck, parent, pk in pairs:
        one = joins.orphans(table(spark, d, child), table(spark, d, parent), ck, pk).agg(F.lit(f"{child}.{ck}").alias("relation"), F.count("*").alias("orphans"))
        out = one if out is None else out.union(one)
    return out


@query
def required_minus_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every nation needs customers of every segment: how much is there."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    segments = c.select("c_mktsegment").distinct()
    required = n.select("n_nationkey", F.explode(F.array(*(F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))).alias("c_mktsegment")).join(segments, "c_mktsegment", "left_semi")
    filled = c.where("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    out = joins.required_minus_filled(required, filled, ["n_nationkey", "c_mktsegment"])
    return out.groupBy("n_nationkey").agg(F.count("*").alias("required"), F.count_if(~F.col("filled")).alias("missing")).withColumn("completion", F.round(1 - F.col("missing") / F.col("required"), 6))


@query
def owned_three_way_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty of a segment's lines, with whether there is more."""
    c, o, li = (table(spark, d, x) for x in ("customer", "orders", "lineitem"))
    met = c.where("c_mktsegment = 'BUILDING'").join(o, c.c_custkey == o.o_custkey).join(li, o.o_orderkey == li.l_orderkey)
    rows = met.select("o_orderkey", "l_linenumber", "c_custkey", number("l_extendedprice").alias("price")).orderBy("o_orderkey", "l_linenumber", "c_custkey").offset(100).limit(51)
    return rows.withColumn("_n", F.row_number().over(Window.orderBy("o_orderkey", "l_linenumber"))).withColumn("has_next", F.max("_n").over(Window.partitionBy()) > 50).where("_n <= 50").drop("_n")


@query
def outer_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs, marks = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    return docs.join(marks, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


@query
def semi_delete_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query
def label_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Part names that contain a word: exact before prefix before the rest, then by name and key; fifty."""
    q = "ring"
    name = F.lower("p_name")
    rank = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    return table(spark, d, "part").where(name.contains(q)).select("p_partkey", "p_name", rank.cast("long").alias("rank")).orderBy("rank", "p_name", "p_partkey").limit(50)


@query
def blank_and_range_filters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where((F.trim(F.coalesce("p_type", F.lit(""))) != "") & F.col("p_size").between(5, 20) & F.col("p_brand").isin("Brand#1", "Brand#2"))
    return p.select("p_partkey", "p_size", number("p_retailprice").alias("p_retailprice")).orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(40)


# --- keys, multisets, tolerance


def _keyed_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"), F.round("value", 0).alias("amount"))


@query
def cascading_key_match(spark: SparkSession, d: str) -> DataFrame:
    e = _keyed_events(spark, d)
    left, right = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").select(F.col("event_id").alias("other_id"), "user_id", "event_type", "hour", "day")
    out = joins.cascading_match(left, right, [["user_id", "event_type", "day", "hour"], ["user_id", "event_type", "day"], ["user_id", "day"]], "other_id")
    return out.select("event_id", "tier", "status", "matched_other_id")


@query
def multiset_match(spark: SparkSession, d: str) -> DataFrame:
    """What day 2 expects of (user, kind), and what day 3 brought."""
    e = _keyed_events(spark, d)
    return joins.multiset_match(e.where("day = 2"), e.where("day = 3"), ["user_id", "event_type"]).select("user_id", "event_type", *(F.col(c).cast("long").alias(c) for c in ("matched", "missing", "extra")))


@query
def tolerance_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances against suppliers' of the same nation, within 25: classes, best match, ambiguity."""
    c = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("nation"), money("c_acctbal").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), money("s_acctbal").alias("b"))
    met = joins.tolerance_join(c, s, "a", "b", 25.0, ["nation"]).withColumn("class", joins.match_class(F.col("a"), F.col("b"), 5.0))
    near = F.greatest(F.lit(0), 60 - F.ceil(F.abs(F.col("a") - F.col("b")) * 2)).cast("long")
    met = met.withColumn("score", joins.class_score(F.col("class")).cast("long") + near)
    out = joins.alignment_buckets(met, ["c_custkey"], "s_suppkey", "score")
    return out.select("c_custkey", "s_suppkey", F.coalesce("class", F.lit("none")).alias("class"), "score", "gap", "n_candidates", "bucket")


# --- quality gates


def _issues(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.length(text).alias("n"), F.md5(text).alias("h"), text.rlike("^[0-9 ]+$").alias("digits"), text.rlike(r"[#$%&*]{3}").alias("marks"))
    docs = docs.withColumn("copies", F.count("*").over(Window.partitionBy("h")))
    rules = {"empty": F.col("n") == 0, "too_short": F.col("n") < 80, "too_long": F.col("n") > 12000, "numeric_only": F.col("digits"), "marked": F.col("marks"), "duplicate": F.col("copies") > 1}
    docs = docs.withColumn("codes", quality_gates.issues(rules))
    ready = quality_gates.readiness(F.col("codes"), ["empty", "numeric_only"], ["too_short", "marked"], ["too_long", "duplicate"])
    return docs.withColumn("ready", ready).withColumn("gate", quality_gates.gate(F.col("ready"), F.col("source") == "src0"))


@query
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).select(F.explode("codes").alias("code"), "doc_id").groupBy("code").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    out = _issues(spark, d).withColumn("priority", quality_gates.review_priority(F.col("gate"), F.col("n") > 0))
    return out.select("doc_id", F.array_join("codes", ",").alias("codes"), "ready", "gate", "priority")


@query
def gate_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return quality_gates.crosstab(_issues(spark, d), "lang", "gate", ["auto", "suggest", "manual", "blocked", "reference_only"])


@query
def readiness_scores(spark: SparkSession, d: str) -> DataFrame:
    c = {v: F.count_if(F.col("ready") == v) for v in ("high", "medium", "low", "not_ready")}
    return _issues(spark, d).groupBy("source").agg(quality_gates.readiness_score(*c.values()).alias("score"))


@query
def handoff_exclusions(spark: SparkSession, d: str) -> DataFrame:
    reasons = quality_gates.issues({"gate": ~F.col("gate").isin("auto", "suggest"), "language": ~F.col("lang").isin("en", "de"), "repeat": F.col("copies") > 1})
    out = quality_gates.handed_off(_issues(spark, d), reasons)
    return out.groupBy(F.array_join("exclusion_reasons", ",").alias("reasons")).agg(F.count("*").alias("n"), F.count_if("handed_off").alias("handed_off"))


# --- duplicates


@query
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"), F.md5(labels.compact_label(F.col("text"))).alias("k"))
    out = duplicates.duplicate_groups(docs, {"exact": ["h"], "same_source": ["source", "h"], "folded": ["k"]}, "doc_id")
    return out.groupBy("kind").agg(F.count("*").alias("n_groups"), F.sum("size").alias("n_rows"), F.max("size").alias("largest"), F.sum("first_id").alias("ids"))


@query
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    return ranking.first_per_key(docs, ["h"], [F.asc("doc_id")]).select("doc_id", "lang")


@query
def duplicate_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return duplicates.with_duplicate_rank(docs, ["h"], [F.asc("doc_id")]).where("group_size > 1").select("doc_id", "duplicate_rank", "group_size")


@query
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.conflicts(table(spark, d, "conversations"), ["conv_id", "role"], "text")


@query
def duplicate_excess(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.md5("text").alias("h"))
    return duplicates.excess(docs, ["source"], ["h"])


@query
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    """The unweighted mean of the sources' rates; exact sums of rounded rates."""
    rates = duplicate_excess(spark, d)
    return rates.agg(F.count("*").alias("n_sources"), F.round(number(F.sum(F.col("rate").cast("decimal(18,6)"))) / F.count("*"), 4).alias("mean_rate"))


@query
def survivors(spark: SparkSession, d: str) -> DataFrame:
    e = _keyed_events(spark, d)
    return duplicates.survivors(e, ["user_id", "day", "hour"], "event_type", ["purchase", "signup", "click", "view"], "event_id", "amount")


@query
def unique_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A part's type, blank for some, taken from its brand and size where there is only one."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).otherwise("").alias("kind"))
    return duplicates.unique_backfill(p, ["p_brand", "p_size"], "kind", "filled").select("p_partkey", "kind", "filled")


# --- ranking


@query
def rank_topk_gap(spark: SparkSession, d: str) -> DataFrame:
    """The top three lines of each order by revenue, with the lead of the first."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", revenue().alias("rev"))
    order = [F.desc("rev"), F.asc("l_linenumber")]
    out = ranking.with_gap(ranking.ranked(li, ["l_orderkey"], order), ["l_orderkey"], "rev", order, 100).where("rank <= 3")
    return out.select("l_orderkey", "l_linenumber", number("rev").alias("revenue"), "rank", number("gap").alias("gap"), "ambiguous")


@query
def source_capped_topk(spark: SparkSession, d: str) -> DataFrame:
    """Per customer at most two orders of each status, five in all."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return ranking.capped_top_k(o, ["o_custkey"], "o_orderstatus", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 5).select("o_custkey", "o_orderkey", "o_orderstatus", "rank")


@query
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranking.latest_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Nations as candidates of a segment, from three sources of evidence, merged by a fold in source order."""
    c = table(spark, d, "customer")
    score = lambda x, s: F.round(F.least(F.lit(1.0), x / s), 4)
    by = ["c_mktsegment", "c_nationkey"]
    parts = [
        c.groupBy(*by).agg(score(F.count("*"), 20.0).alias("score")).select(*by, F.lit("deterministic").alias("source"), "score", F.lit("low").alias("risk")),
        c.where("c_acctbal > 5000").groupBy(*by).agg(score(F.count("*"), 12.0).alias("score")).select(*by, F.lit("dictionary").alias("source"), "score", F.lit("medium").alias("risk")),
        c.where("c_acctbal < 0").groupBy(*by).agg(score(F.count("*"), 8.0).alias("score")).select(*by, F.lit("lexical").alias("source"), "score", F.lit("high").alias("risk")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    out = ranking.merge_candidates(rows, by, "source", "score", "risk", ["deterministic", "dictionary", "lexical"])
    return ranking.advisory(out.withColumn("sources", F.array_join("sources", ",")))


# --- ordered


@query
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ordered.neighbours(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "role", "previous_role", "next_role")


@query
def nearby_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("n", F.length("text").cast("string"))
    return ordered.nearby(rows, ["conv_id"], ["turn"], "n", 2).select("conv_id", "turn", F.array_join("nearby", ",").alias("nearby"))


@query
def asof_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last signup before it."""
    e = table(spark, d, "events")
    out = ordered.as_of(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "signup_id", strict=True)
    return out.where("event_type = 'purchase'").select("event_id", "user_id", "signup_id")


@query
def asof_same_page(spark: SparkSession, d: str) -> DataFrame:
    """As before, but only a signup of the same day counts."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    out = ordered.as_of(e, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "signup_id", strict=True)
    return out.where("event_type = 'purchase'").select("event_id", "user_id", "signup_id")


@query
def nearest_total(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the user's nearest error; of two equally near the later one."""
    e = table(spark, d, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    out = ordered.nearest(e, ["user_id"], ["place"], F.col("place"), F.col("event_type") == "error", F.col("event_id"), "error_id")
    return out.where("event_type = 'click'").select("event_id", "error_id")


@query
def point_in_range_assign(spark: SparkSession, d: str) -> DataFrame:
    """Views within the spans that run from each signup to the user's next one, on days of two spans or more."""
    e = table(spark, d, "events")
    s = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("s"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("e"))
    out = joins.point_in_range(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), s, ["user_id"], "ts", "s", "e", "event_id")
    return out.select("event_id", "n_ranges", "status")


@query
def range_end_inference(spark: SparkSession, d: str) -> DataFrame:
    """Customers' order days as starts: each lasts until the day before the next, the last until the end of 2000."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01")).alias("day")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", day)
    out = ordered.range_ends(o, ["o_custkey"], "day", F.lit(4017))
    return out.select("o_custkey", "o_orderkey", F.col("day").cast("long").alias("day"), F.col("end").cast("long").alias("end_day"), "shared_start")


@query
def range_topology(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate"), F.lit("1990-01-01")).alias("day"))
    spans = o.select("o_custkey", "o_orderkey", "day", (F.col("day") + F.col("o_orderkey") % 200).alias("until"))
    out = ordered.range_topology(spans, ["o_custkey"], "day", "until")
    return out.groupBy("o_custkey").agg(F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("gaps"), F.coalesce(F.sum("overlap"), F.lit(0)).cast("long").alias("overlaps"))


@query
def weighted_consensus(spark: SparkSession, d: str) -> DataFrame:
    e = _keyed_events(spark, d).select("user_id", (F.col("hour") % 4).cast("long").alias("shift"), F.when(F.col("event_type") == "purchase", F.lit(3)).otherwise(1).cast("long").alias("w"))
    return ordered.weighted_consensus(e, ["user_id"], "shift", "w", 0.3, 2)


@query
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    legal = [(a, b) for a in ("view", "click", "signup", "purchase", "error") for b in ("view", "click", "signup", "purchase", "error") if a != "error" and (a, b) != ("purchase", "signup")]
    e = state.transitions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", legal)
    return e.groupBy("previous", "event_type").agg(F.count("*").alias("n"), F.count_if("legal").alias("legal"))


@query
def terminal_once(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ends", F.col("event_type") == "purchase")
    out = state.terminal_once(e, ["user_id"], ["ts", "event_id"], "ends")
    return out.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.max("sequence").alias("last"))


# --- vectors and labels


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ranking.ranked(vectors.nearest_vectors(e.where("vec_id % 100 = 0"), e, 5, "vec_id", "vec_id", "embedding"), ["query_id"], [F.desc("score"), F.asc("vec_id")]).select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


@query
def vector_restricted(spark: SparkSession, d: str) -> DataFrame:
    """As before, among vectors of the query's own label, and only above a threshold."""
    e = table(spark, d, "embeddings")
    out = vectors.nearest_vectors(e.where("vec_id % 100 = 0"), e, 3, "vec_id", "vec_id", "embedding", same="label")
    return out.where("score >= 0.2").select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query
def ranking_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Do the nearest vectors of each vector have its label."""
    out = vectors.nearest_of_each(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), 5, "vec_id", "embedding")
    return rulebook.ranking_metrics(out, "query_id", "rank", F.col("label") == F.col("query_label"))


@query
def token_jaccard_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct part names that share a word, with their likeness."""
    names = table(spark, d, "part").select(labels.normalize_label(F.col("p_name")).alias("name")).distinct().withColumn("t", labels.tokens(F.col("name")))
    words = names.select("name", "t", F.explode("t").alias("w"))
    pairs = words.alias("a").join(words.alias("b"), "w").where("a.name < b.name").select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), F.col("a.t").alias("x"), F.col("b.t").alias("y")).distinct()
    return pairs.select("left_name", "right_name", F.round(labels.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


@query
def label_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names that share their first word, by matching blocks."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("k", F.element_at(F.split("name", " "), 1))
    pairs = names.alias("a").join(names.alias("b"), "k").where("a.name < b.name").select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"))
    return similarity.label_similarity(pairs, "left_name", "right_name")


# --- rules and evaluation


def _rule_rows(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("target"), F.col("c_nationkey").alias("fold"))


@query
def rule_induction(spark: SparkSession, d: str) -> DataFrame:
    out = rulebook.induce(_rule_rows(spark, d), ["segment", "priority"], "target", "fold")
    return out.select("segment", "priority", "target", "support", "folds", F.col("n_targets").cast("long").alias("n_targets"), F.col("total").cast("long").alias("total"), "precision", "tier")


@query
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    out = rulebook.leave_one_out(_rule_rows(spark, d), ["segment", "priority"], "target", "fold", 2)
    return out.select("fold", *(F.col(c).cast("long").alias(c) for c in ("observations", "predicted", "correct")), "coverage", "precision")


@query
def sliced_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A guess of quality from the length of the text, against the labels, by language and source."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rulebook.sliced_rates(docs, ["lang", "source"], F.col("n_chars") >= 200, F.col("quality") == 1)


@query
def profile_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Three profiles of caps over the same candidates: coverage, hits, quality, and which to take."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    n = o.select("o_custkey").distinct().agg(F.count("*").alias("rows"))
    out = None
    for name, cap, k, least in (("strict", 1, 3, 3000.0), ("balanced", 2, 4, 1500.0), ("recall", 3, 5, 0.0)):
        top = ranking.capped_top_k(o.where(F.col("o_totalprice") >= least), ["o_custkey"], "o_orderstatus", [F.desc("o_totalprice"), F.asc("o_orderkey")], cap, k)
        first = top.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("rank"))).alias("hit"))
        one = first.agg(F.lit(name).alias("profile"), F.count("*").alias("covered"), *(F.count_if(F.col("hit") <= x).alias(f"top{x}") for x in (1, 3, 5)))
        out = one if out is None else out.union(one)
    rate = lambda c, whole: F.round(labels.safe_rate(F.col(c), F.col(whole), 0.0), 6)
    out = out.join(n).select("profile", "covered", rate("covered", "rows").alias("coverage"), *(rate(f"top{x}", "covered").alias(f"top{x}") for x in (1, 3, 5)))
    out = out.withColumn("quality", ranking.profile_quality(F.col("coverage"), F.col("top1"), F.col("top3"), F.col("top5"), F.lit(0.0), F.lit(0.0)))
    return out.withColumn("selected", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("quality"), "profile")) == 1)


@query
def hybrid_blend(spark: SparkSession, d: str) -> DataFrame:
    """Two scores of suppliers, by balance and by volume, blended .3 and .7 over the union of their ids."""
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.round(F.least(F.lit(1.0), F.col("s_acctbal") / 10000), 4).alias("x"))
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.least(F.lit(1.0), F.count("*") / 1000), 4).alias("y"))
    return s.join(v, "id", "full").select("id", F.round(0.3 * F.coalesce("x", F.lit(0.0)) + 0.7 * F.coalesce("y", F.lit(0.0)), 4).alias("score"))


# --- scalars, JSON, markup, trees, hashes, time


@query
def json_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON text; what can't be parsed falls back to -1."""
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    k = F.coalesce(F.get_json_object(broken, "$.k").try_cast("long"), F.lit(-1))
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count_if(F.col("k") == -1).alias("bad"), F.sum("k").alias("total"))


AMOUNTS = ["1,234", "(50)", "-", "--", "12%", "RM 1,000.50", "USD 7", "-0.00", "2023", "31/12/2023", "1,23", "", "abc", "(1,234.500)", "−45", "$ 9"]


@query
def amount_grammars(spark: SparkSession, d: str) -> DataFrame:
    """All grammars over a table of literals."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(AMOUNTS)], "id long, x string")
    x = F.col("x")
    return rows.select(
        "id", amounts.amount_layout(x).alias("layout"), amounts.amount_native(x).alias("native"), number(amounts.amount_quality(x)).alias("quality"), number(amounts.amount_shadow(x)).alias("shadow"),
        number(amounts.amount_align(x)).alias("align"), number(amounts.amount_xbrl(x)).alias("xbrl"), amounts.amount_calc(x).alias("calc"), amounts.amount_xbrl_out(x)["value"].alias("out_value"), amounts.amount_xbrl_out(x)["decimals"].alias("out_decimals"),
    )


@query
def label_normaliser(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", labels.normalize_label(F.concat(n, F.lit(" & (Note 12) "), F.col("p_brand"))).alias("normal"), labels.camel_words(F.regexp_replace(F.initcap(n), " ", "")).alias("words"), labels.without_prefix(F.concat(F.lit("Add: "), n, F.lit(" (continued)"))).alias("bare"))


@query
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"))


@query
def hierarchy_paths(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as one tree."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"), F.col("n_nationkey").alias("ord")).union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"), F.col("s_suppkey")))
    return state.hierarchy_paths(edges, 2)


@query
def fiscal_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Current and prior fiscal windows that end with each order's month."""
    end = F.last_day(F.to_date("o_orderdate"))
    o = table(spark, d, "orders").select("o_orderkey", end.alias("fye"))
    first = F.trunc("fye", "year")
    return o.select("o_orderkey", F.col("fye").cast("string").alias("current_end"), F.trunc("fye", "month").cast("string").alias("month_start"), F.year("fye").cast("long").alias("year"), (F.year("fye") - 1).cast("long").alias("prior_year"), F.datediff("fye", first).cast("long").alias("day_of_year"))


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query
def xbrl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as instances, parsed again, and counted by nation."""
    c = table(spark, d, "customer").select("c_nationkey", F.concat(F.lit("x:Balance"), F.col("c_mktsegment")).alias("qname"), F.concat(F.lit("c"), F.col("c_custkey")).alias("context_ref"), F.lit("2023-12-31").alias("instant"), F.lit("EUR").alias("unit"), money("c_acctbal").alias("value"))
    made = xbrl.instance_text(c, "c_nationkey").select(F.concat_ws("/", F.col("part").cast("string"), F.col("c_nationkey").cast("string")).alias("path"), "text", F.lit(False).alias("rejected"))
    facts = xbrl.facts(made)
    return facts.groupBy(F.get(F.split("path", "/"), F.lit(1)).cast("int").alias("c_nationkey")).agg(F.count("*").alias("n"), number(F.sum(amounts.amount_xbrl(F.col("value")))).alias("total"), F.sum(F.size("warnings")).alias("warnings"))


@query
def events_window(spark: SparkSession, d: str) -> DataFrame:
    return windows_time.tumbling(table(spark, d, "events").withColumn("value", money("value")), "ts", "1 day", ["event_type"], "value").select("window_start", "event_type", "n", number("total").alias("total"), number("largest").alias("largest"))


@query
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return windows_time.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"])
