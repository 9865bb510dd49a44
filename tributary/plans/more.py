"""More named queries, with their SQL beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions import shapes
from tributary.operators import cells, comparison, examples, frames, lines, review
from tributary.plans.oracles import ORACLES
from tributary.plans.queries import money, number, query
from tributary.sources.tables import table


def micros(at: str) -> Column:
    """Microseconds of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))


@query
def frame_distribution(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    out = frames.distribution(o, ["o_custkey"], ["o_orderkey"])
    return out.select("o_orderkey", F.col("tile").cast("long").alias("tile"), F.round("percent_rank", 6).alias("percent_rank"), F.round("cume_dist", 6).alias("cume_dist"), "second")


ORACLES["frame_distribution"] = """
SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS tile, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist,
 nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""


@query
def frame_range_sum(spark: SparkSession, d: str) -> DataFrame:
    """What a customer ordered in the ninety days up to each order."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", money("o_totalprice").alias("p"), F.unix_date(F.to_date("o_orderdate")).alias("day"))
    return o.select("o_orderkey", number(frames.within(o, ["o_custkey"], "day", 90, F.col("p"))).alias("total_90_days"))


ORACLES["frame_range_sum"] = """
WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)
SELECT o_orderkey, CAST(sum(p) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS DOUBLE) AS total_90_days FROM o"""


@query
def quantile_stats(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles and distinct counts of quantities; the approximate count must lie within a twentieth."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    keys = ["l_returnflag", "l_linestatus"]
    exact = lines.groupBy(*keys).agg(F.count_distinct("l_quantity").alias("exact"))
    out = frames.quantiles(lines, keys, "l_quantity", [0.25, 0.5, 0.75]).join(exact, keys)
    return out.select(*keys, "n", *(F.col("quantiles")[i].alias(x) for i, x in enumerate(("q1", "q2", "q3"))), (F.abs(F.col("n_distinct") - F.col("exact")) * 20 <= F.col("exact")).alias("near"))


ORACLES["quantile_stats"] = """
SELECT l_returnflag, l_linestatus, count(*) AS n, quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_quantity, 0.5) AS q2, quantile_disc(l_quantity, 0.75) AS q3, true AS near
FROM lineitem GROUP BY 1, 2"""


@query
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a review queue: critical, high, medium, low, others; by customer within."""
    o = table(spark, d, "orders")
    name = F.lower(F.regexp_replace("o_orderpriority", r"^[0-9]-", ""))
    name = F.when(name == "urgent", "critical").otherwise(name)
    return o.select("o_orderkey", "o_custkey", review.priority_rank(name).cast("long").alias("rank")).orderBy("rank", "o_custkey", "o_orderkey")


ORACLES["review_queue"] = r"""
WITH n AS (SELECT o_orderkey, o_custkey, lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS name FROM orders)
SELECT o_orderkey, o_custkey, CAST(CASE name WHEN 'urgent' THEN 0 WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END AS BIGINT) AS rank FROM n"""


@query
def validation_thresholds(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", "l_discount")
    out = review.validation(lines, "l_orderkey", F.col("l_linestatus") == "F", F.col("l_returnflag") != "N", F.col("l_discount") > 0.05)
    return out.select("l_orderkey", "n", "n_reviewed", "n_tagged", "n_valued", F.array_join("warnings", ",").alias("warnings"))


ORACLES["validation_thresholds"] = """
WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_reviewed, count(*) FILTER (l_returnflag <> 'N') AS n_tagged, count(*) FILTER (l_discount > 0.05) AS n_valued FROM lineitem GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN n_reviewed < 0.5 * n THEN 'reviewed' END, CASE WHEN n_tagged < 0.3 * n THEN 'tagged' END, CASE WHEN n_valued < 0.5 * n THEN 'valued' END) AS warnings FROM c"""


@query
def compared_sets(spark: SparkSession, d: str) -> DataFrame:
    """Who has open orders, against whose balance is above nothing."""
    expected = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("custkey"))
    predicted = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return review.compared_sets(expected, predicted, ["custkey"])


ORACLES["compared_sets"] = """
WITH a AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal > 0)
SELECT coalesce(a.custkey, b.custkey) AS custkey, CASE WHEN a.custkey IS NULL THEN 'extra' WHEN b.custkey IS NULL THEN 'missing' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.custkey = b.custkey"""


@query
def first_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Per order the line of the largest quantity, the first of equal ones, if above twenty."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return review.best_match(lines, "l_orderkey", "l_quantity", "l_linenumber", 20.0).withColumnsRenamed({"place": "l_linenumber", "score": "l_quantity"})


ORACLES["first_best_match"] = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity FROM r WHERE k = 1 AND l_quantity > 20"""


@query
def cell_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every kind, as texts: sizes, prices with thousands and brackets, percentages, years, codes."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", money("p_retailprice").alias("price"))
    cells = [F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"), F.concat(F.lit("("), F.format_number("price", 2), F.lit(")")), F.concat((F.col("p_size") / 2).cast("decimal(8,1)").cast("string"), F.lit(" %")), (1900 + F.col("p_partkey") % 150).cast("string")]
    own = p.select("p_partkey", F.posexplode(F.array(*cells)).alias("kind", "cell"))
    c = F.col("cell")
    return own.select("p_partkey", F.col("kind").cast("long").alias("kind"), shapes.is_percent(c).alias("percent"), shapes.is_year(c).alias("year"), shapes.is_amount_like(c).alias("amount"))


ORACLES["cell_shapes"] = r"""
WITH p AS (SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5]) AS kind, unnest([p_name, p_brand, CAST(p_size AS VARCHAR), '(' || format('{:,.2f}', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE)) || ')', CAST(CAST(p_size / 2 AS DECIMAL(8,1)) AS VARCHAR) || ' %', CAST(1900 + p_partkey % 150 AS VARCHAR)]) AS c FROM part),
 s AS (SELECT *, regexp_matches(replace(c, ' ', ''), '^\(?-?\d+(\.\d+)?%\)?$') AS percent, regexp_matches(trim(c), '^(?:19|20)\d{2}$') AS year FROM p)
SELECT p_partkey, CAST(kind AS BIGINT) AS kind, percent, year, regexp_matches(trim(c), '^\(?-?\d[\d,]*(\.\d+)?\)?$') AND NOT year AND NOT percent AS amount FROM s"""


@query
def year_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Years named in a heading that is made of an order's date and its customer, against a carried pair."""
    o = table(spark, d, "orders")
    year, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("As at "), year.cast("string"), F.lit(" and "), (year - 1).cast("string"))).when(k == 1, F.concat(F.lit("Year "), year.cast("string"))).when(k == 2, F.concat(F.lit("No. "), F.col("o_custkey").cast("string"), F.lit("x")))
    pair = shapes.year_pair(text, F.lit(1996), F.lit(1995))
    return o.select("o_orderkey", pair.alias("y")).select("o_orderkey", F.col("y.current").cast("long").alias("current_year"), F.col("y.prior").cast("long").alias("prior_year"))


ORACLES["year_pairs"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate) WHEN o_orderkey % 4 = 1 THEN greatest(year(o_orderdate), 1996) ELSE 1996 END AS current_year,
 CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate) - 1 WHEN o_orderkey % 4 = 1 AND year(o_orderdate) < 1996 THEN year(o_orderdate) ELSE 1995 END AS prior_year FROM orders"""


@query
def fact_periods(spark: SparkSession, d: str) -> DataFrame:
    """Year and type of the periods of facts: an instant, or a start and an end."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate")
    instant = F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate"))
    start, end = (F.when(F.col("l_linestatus") != "F", x) for x in (F.trunc("l_shipdate", "year"), F.to_date("l_shipdate")))
    return lines.select("l_orderkey", "l_linenumber", shapes.period_year(instant, end).cast("long").alias("period_year"), shapes.period_type(instant, start, end).alias("period_type"))


ORACLES["fact_periods"] = "SELECT l_orderkey, l_linenumber, year(l_shipdate) AS period_year, CASE WHEN l_linestatus = 'F' THEN 'instant' ELSE 'duration' END AS period_type FROM lineitem"


@query
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The words of a part's name and type, each where it comes first."""
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_name")), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(words), " ").alias("words"))


ORACLES["ordered_distinct"] = """
WITH w AS (SELECT p_partkey, string_split(lower(concat_ws(' ', p_name, p_type, p_name)), ' ') AS ws FROM part)
SELECT p_partkey, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS words FROM w"""


@query
def sorted_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of event types per user, as one sorted text."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entry = F.struct("event_type", "n")
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat(x["event_type"], F.lit(":"), x["n"].cast("string")))
    return counts.groupBy("user_id").agg(F.array_join(texts, ",").alias("counters"))


ORACLES["sorted_counters"] = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counters FROM c GROUP BY 1"""


@query
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of the last thirty minutes before the latest one."""
    events = table(spark, d, "events")
    latest = events.agg(F.max("ts")).scalar()
    return events.where(F.col("ts") >= latest - F.expr("INTERVAL 30 MINUTES")).select("event_id", "user_id", "event_type")


ORACLES["recent_events"] = "SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE"


# --- comparisons


def _mappers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two ways to say what an order's kind is: by its heaviest line, and by its dearest."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_partkey")
    by = lambda c, least: lines.where(F.col("l_quantity") > least).groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct(c, -F.col("l_linenumber"), "l_partkey")).alias("kind"))
    return by("l_quantity", 30), by("l_extendedprice", 10)


MAPPERS = """
 a AS (SELECT l_orderkey, l_returnflag AS kind FROM lineitem WHERE l_quantity > 30 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey DESC) = 1),
 b AS (SELECT l_orderkey, l_returnflag AS kind FROM lineitem WHERE l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey DESC) = 1),
 m AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.kind AS left_value, b.kind AS right_value,
   CASE WHEN b.kind IS NULL THEN 'left_only' WHEN a.kind IS NULL THEN 'right_only' WHEN a.kind = b.kind THEN 'agree' ELSE 'conflict' END AS outcome FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey)"""


@query
def mapper_comparison(spark: SparkSession, d: str) -> DataFrame:
    return comparison.compared(*_mappers(spark, d), "l_orderkey", "kind")


ORACLES["mapper_comparison"] = f"WITH {MAPPERS} SELECT * FROM m"


@query
def mapper_comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = comparison.compared(*_mappers(spark, d), "l_orderkey", "kind")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return comparison.summary(rows.join(orders, "l_orderkey"), ["o_orderpriority"])


ORACLES["mapper_comparison_summary"] = f"""
WITH {MAPPERS}, c AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (outcome IN ('agree', 'conflict')) AS comparable, count(*) FILTER (outcome = 'agree') AS agreed FROM m JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT *, round(CASE WHEN comparable > 0 THEN agreed / comparable ELSE 0.0 END, 6) AS agreement FROM c"""


@query
def rows_losing_all_candidates(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return comparison.losing_all(lines, lines.where("l_quantity > 30 AND l_discount < 0.05"), "l_orderkey")


ORACLES["rows_losing_all_candidates"] = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05)"


@query
def pipeline_overlap(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return comparison.overlap(lines.where("l_quantity > 25"), lines.where("l_discount > 0.05"), "l_orderkey")


ORACLES["pipeline_overlap"] = """
WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.05)
SELECT count(a.l_orderkey) AS n_left, count(b.l_orderkey) AS n_right, count(*) FILTER (a.l_orderkey = b.l_orderkey) AS n_both, round(count(*) FILTER (a.l_orderkey = b.l_orderkey) / count(*), 6) AS jaccard
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey"""


@query
def review_confusion(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return comparison.confusion(lines, ["l_returnflag"], F.col("l_quantity") > 25, F.col("l_extendedprice") > 30000)


ORACLES["review_confusion"] = """
WITH c AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 25 AND l_extendedprice > 30000) AS tp, count(*) FILTER (l_quantity > 25 AND NOT l_extendedprice > 30000) AS fp,
 count(*) FILTER (NOT l_quantity > 25 AND l_extendedprice > 30000) AS fn, count(*) FILTER (NOT l_quantity > 25 AND NOT l_extendedprice > 30000) AS tn FROM lineitem GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall FROM c"""


# --- cells and lines


@query
def cell_matrix(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("cell"))
    return cells.matrix(own, ["l_orderkey"], "l_linenumber", "cell").select("l_orderkey", F.array_join("cells", "|").alias("cells"))


ORACLES["cell_matrix"] = "SELECT l_orderkey, string_agg(l_returnflag || CAST(CAST(l_quantity AS INT) AS VARCHAR), '|' ORDER BY l_linenumber, l_returnflag || CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS cells FROM lineitem GROUP BY 1"


@query
def header_year_map(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a customer's orders: the first that names a year gives it to its column."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("row"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Year "), F.year("o_orderdate").cast("string"))).otherwise(F.lit("Group")).alias("cell"))
    return cells.header_years(o, ["o_custkey"], "o_orderstatus", "cell").withColumn("year", F.col("year").cast("long"))


ORACLES["header_year_map"] = "SELECT o_custkey, o_orderstatus, arg_min(year(o_orderdate), o_orderkey) AS year FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2"


@query
def trailing_amounts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("  ", "p_name", F.format_number(money("p_retailprice"), 2), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).alias("line"))
    x = cells.trailing_amounts(F.col("line"))
    return p.select("p_partkey", x.alias("x")).select("p_partkey", F.col("x.label").alias("label"), F.array_join("x.amounts", " ").alias("amounts"))


ORACLES["trailing_amounts"] = "SELECT p_partkey, p_name AS label, format('{:,.2f}', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE)) || ' (' || p_size || ')' AS amounts FROM part"


@query
def adjacent_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", micros("ts").alias("at"))
    return cells.merged(e, ["user_id"], ["at", "event_id"], "event_type", "at", F.lit(12 * 3_600_000_000))


ORACLES["adjacent_merge"] = """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events),
 n AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS block FROM n)
SELECT user_id, min(us) AS first, max(us) AS last, any_value(event_type) AS event_type, count(*) AS n FROM b GROUP BY user_id, block"""


@query
def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("answer: "), "props", F.lit(" end"))).otherwise("event_type").alias("t"))
    found = cells.embedded_json(F.col("t"))
    return e.select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


ORACLES["embedded_json"] = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"


@query
def elapsed_millis(spark: SparkSession, d: str) -> DataFrame:
    """Whole milliseconds since the same user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = micros("ts")
    return table(spark, d, "events").select("event_id", F.floor((at - F.lag(at).over(w)) / 1000).alias("elapsed_ms"))


ORACLES["elapsed_millis"] = "SELECT event_id, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000) AS BIGINT) AS elapsed_ms FROM events"


@query
def text_line_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, as a row, amounts or a paragraph, with its label, section and years."""
    return lines.line_candidates(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


ORACLES["text_line_candidates"] = rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, CAST(unnest(range(len(t))) AS BIGINT) AS line, unnest(t) AS x FROM s),
 k AS (SELECT *, regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS clean,
  CASE WHEN length(x) <= {lines.SHORT} AND regexp_matches(x, '{lines.YEARS}') THEN 'years' WHEN regexp_matches(x, '{lines.AMOUNTS}') THEN 'amounts' WHEN regexp_matches(x, '{lines.ROW}') THEN 'row'
   WHEN length(x) <= {lines.SHORT} AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') THEN 'heading'
   WHEN length(x) <= {lines.SHORT} AND NOT regexp_matches(x, '[.!?][ \t\r]*$') THEN 'label' ELSE 'paragraph' END AS kind
  FROM l WHERE NOT regexp_matches(x, '{lines.BLANK}')),
 o AS (SELECT *, lag(CASE kind WHEN 'label' THEN clean END) OVER w AS before, last_value(CASE kind WHEN 'heading' THEN clean END IGNORE NULLS) OVER w AS section,
  last_value(CASE kind WHEN 'years' THEN array_to_string(regexp_extract_all(x, '{lines.YEAR}'), ' ') END IGNORE NULLS) OVER w AS years FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, kind, CASE kind WHEN 'row' THEN regexp_extract(x, '{lines.ROW}', 1) WHEN 'amounts' THEN before END AS label,
 CASE WHEN kind <> 'paragraph' THEN array_to_string(regexp_extract_all(CASE kind WHEN 'row' THEN regexp_extract(x, '{lines.ROW}', 2) ELSE x END, '{lines.AMOUNT}'), ' ') END AS amounts, section, years
FROM o WHERE kind IN ('row', 'amounts', 'paragraph')"""


@query
def fewshot_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """For every benchmark item the three labelled documents that have most of its words."""
    items = table(spark, d, "benchmark").select("item_id", examples.word_set(F.col("text")).alias("words"))
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    own = docs.select("doc_id", examples.word_set(F.col("text")).alias("words"))
    return examples.similar_examples(items, own, "item_id", "doc_id", 0.3, 3)


ORACLES["fewshot_retrieval"] = """
WITH i AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))) AS a FROM benchmark),
 e AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))) AS b FROM documents JOIN labels USING (doc_id)),
 p AS (SELECT item_id, doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_shared, len(a) AS n FROM i, e)
SELECT item_id, doc_id, n_shared, round(CAST(n_shared AS DOUBLE) / n, 6) AS share, row_number() OVER w AS rank FROM p WHERE n > 0 AND n_shared * 10 >= n * 3
WINDOW w AS (PARTITION BY item_id ORDER BY n_shared DESC, doc_id) QUALIFY row_number() OVER w <= 3"""
