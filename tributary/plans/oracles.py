"""The queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

REV = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
ISSUES = r"""
  d0 AS (SELECT doc_id, lang, source, length(coalesce(text,'')) AS n, md5(coalesce(text,'')) AS h,
      regexp_matches(coalesce(text,''), '^[0-9 ]+$') AS digits, regexp_matches(coalesce(text,''), '[#$%&*]{3}') AS marks FROM documents),
  d1 AS (SELECT *, count(*) OVER (PARTITION BY h) AS copies FROM d0),
  d2 AS (SELECT *, list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n < 80 THEN 'too_short' END, CASE WHEN n > 12000 THEN 'too_long' END,
      CASE WHEN digits THEN 'numeric_only' END, CASE WHEN marks THEN 'marked' END, CASE WHEN copies > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL) AS codes FROM d1),
  d3 AS (SELECT *, CASE WHEN list_has_any(codes, ['empty','numeric_only']) THEN 'not_ready' WHEN list_has_any(codes, ['too_short','marked']) THEN 'low'
      WHEN list_has_any(codes, ['too_long','duplicate']) THEN 'medium' ELSE 'high' END AS ready FROM d2),
  d AS (SELECT *, CASE WHEN ready = 'not_ready' THEN 'blocked' WHEN source = 'src0' THEN 'reference_only' WHEN ready = 'low' THEN 'manual' WHEN ready = 'medium' THEN 'suggest' ELSE 'auto' END AS gate FROM d3)
"""
KEYED = "e AS (SELECT event_id, user_id, event_type, hour(ts) AS hour, day(ts) AS day, round(value, 0) AS amount, ts FROM events)"
VECTORS = """
  v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS ql, e.label AS el,
      round(list_dot_product(q.embedding, e.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(e.embedding, e.embedding))), 6) AS score
    FROM v q JOIN v e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
"""

ORACLES["calc_rollup_validation"] = f"""
WITH k AS (SELECT l_orderkey, sum({REV} * (1 + CAST(l_tax AS DECIMAL(18,2)))) AS computed, count(*) AS n FROM lineitem GROUP BY 1),
 j AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, computed, n FROM orders JOIN k ON o_orderkey = l_orderkey)
SELECT o_orderkey, CAST(total AS DOUBLE) AS total, CAST(computed AS DOUBLE) AS computed, n AS n_children, CAST(abs(total - computed) AS DOUBLE) AS difference,
 CASE WHEN abs(total - computed) > greatest(0.02 * abs(total), 1.0) THEN 'mismatch' ELSE 'valid' END AS status FROM j"""
ORACLES["count_by_key"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
ORACLES["stats_grouping_sets"] = "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((), (c_mktsegment), (c_nationkey))"
ORACLES["rollup_cube"] = "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"
ORACLES["filtered_counts"] = """
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 1000) AS big,
 count(*) FILTER (o_totalprice > 1000 AND o_orderstatus = 'F') AS big_done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
ORACLES["status_pivot"] = """
SELECT n_name, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending, count(o_orderkey) AS total
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
ORACLES["having_top1"] = """
SELECT l_suppkey, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY 1
HAVING count(*) >= 10 AND sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 3 ORDER BY returned DESC, n DESC, l_suppkey LIMIT 1"""
ORACLES["distinct_gap"] = """
SELECT total, used, greatest(total - used, 0) AS gap FROM (SELECT count(*) AS total FROM part), (SELECT count(DISTINCT l_partkey) AS used FROM lineitem)"""
ORACLES["integrity_orphans"] = " UNION ALL ".join(
    f"SELECT '{c}.{ck}' AS relation, count(*) AS orphans FROM {c} WHERE {ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pk} = {c}.{ck})"
    for c, ck, p, pk in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")]
)
ORACLES["required_minus_filled"] = """
WITH r AS (SELECT n_nationkey, s FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'))),
 f AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0)
SELECT n_nationkey, count(*) AS required, count(*) FILTER (c_nationkey IS NULL) AS missing, round(1 - count(*) FILTER (c_nationkey IS NULL) / count(*), 6) AS completion
FROM r LEFT JOIN f ON n_nationkey = c_nationkey AND s = c_mktsegment GROUP BY 1"""
ORACLES["owned_three_way_page"] = """
WITH p AS (SELECT o_orderkey, l_linenumber, c_custkey, l_extendedprice AS price FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
 WHERE c_mktsegment = 'BUILDING' ORDER BY 1, 2, 3 LIMIT 51 OFFSET 100),
 n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey, l_linenumber) AS rn, count(*) OVER () AS c FROM p)
SELECT o_orderkey, l_linenumber, c_custkey, price, c > 50 AS has_next FROM n WHERE rn <= 50"""
ORACLES["outer_lookup"] = """
SELECT lang, count(*) AS n, count(quality) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""
ORACLES["semi_delete_set"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
ORACLES["label_search_ranked"] = """
SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN starts_with(lower(p_name), 'ring') THEN 1 ELSE 2 END AS BIGINT) AS rank
FROM part WHERE contains(lower(p_name), 'ring') ORDER BY rank, p_name, p_partkey LIMIT 50"""
ORACLES["blank_and_range_filters"] = """
SELECT p_partkey, p_size, p_retailprice FROM part WHERE trim(coalesce(p_type, '')) <> '' AND p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#1', 'Brand#2')
ORDER BY p_retailprice DESC, p_partkey LIMIT 40 OFFSET 5"""
ORACLES["cascading_key_match"] = f"""
WITH {KEYED}, l AS (SELECT * FROM e WHERE event_id % 2 = 0), r AS (SELECT * FROM e WHERE event_id % 2 = 1),
 a AS (SELECT user_id, event_type, day, hour, count(*) AS n, min(event_id) AS m FROM r GROUP BY ALL), b AS (SELECT user_id, event_type, day, count(*) AS n, min(event_id) AS m FROM r GROUP BY ALL),
 c AS (SELECT user_id, day, count(*) AS n, min(event_id) AS m FROM r GROUP BY ALL),
 j AS (SELECT l.event_id, CASE WHEN a.n > 0 THEN 1 WHEN b.n > 0 THEN 2 WHEN c.n > 0 THEN 3 ELSE 0 END AS tier, coalesce(a.n, b.n, c.n, 0) AS n, coalesce(a.m, b.m, c.m) AS m
  FROM l LEFT JOIN a USING (user_id, event_type, day, hour) LEFT JOIN b ON l.user_id = b.user_id AND l.event_type = b.event_type AND l.day = b.day LEFT JOIN c ON l.user_id = c.user_id AND l.day = c.day)
SELECT event_id, CAST(tier AS BIGINT) AS tier, CASE WHEN n = 0 THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN m END AS matched_other_id FROM j"""
ORACLES["multiset_match"] = f"""
WITH {KEYED}, x AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE day = 2 GROUP BY 1, 2), g AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE day = 3 GROUP BY 1, 2)
SELECT user_id, event_type, least(coalesce(x.n, 0), coalesce(g.n, 0)) AS matched, greatest(coalesce(x.n, 0) - coalesce(g.n, 0), 0) AS missing, greatest(coalesce(g.n, 0) - coalesce(x.n, 0), 0) AS extra
FROM x FULL JOIN g USING (user_id, event_type)"""
ORACLES["tolerance_alignment"] = """
WITH m AS (SELECT c_custkey, s_suppkey, CAST(c_acctbal AS DECIMAL(18,2)) AS a, CAST(s_acctbal AS DECIMAL(18,2)) AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(CAST(c_acctbal AS DECIMAL(18,2)) - CAST(s_acctbal AS DECIMAL(18,2))) <= 25),
 k AS (SELECT *, CASE WHEN a = b THEN 'exact' WHEN abs(a - b) <= 5 THEN 'tolerance' WHEN abs(a) = abs(b) THEN 'sign' WHEN abs(abs(a) - abs(b)) <= 5 THEN 'sign_tolerance' END AS class FROM m),
 s AS (SELECT *, CAST(coalesce(CASE class WHEN 'exact' THEN 40 WHEN 'tolerance' THEN 36 WHEN 'sign' THEN 25 WHEN 'sign_tolerance' THEN 22 END, 0) + greatest(0, 60 - ceil(abs(a - b) * 2)) AS BIGINT) AS score FROM k),
 r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second, count(*) OVER (PARTITION BY c_custkey) AS n_candidates FROM s WINDOW w AS (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey)),
 b AS (SELECT *, score - second AS gap, CASE WHEN score - second <= 8 THEN 'ambiguous' WHEN score >= 80 THEN 'high' WHEN score >= 65 THEN 'medium' ELSE 'low' END AS b0 FROM r WHERE place = 1)
SELECT c_custkey, s_suppkey, coalesce(class, 'none') AS class, score, gap, n_candidates,
 CASE WHEN b0 IN ('high', 'medium') AND count(*) FILTER (b0 IN ('high', 'medium')) OVER (PARTITION BY s_suppkey) > 1 THEN 'ambiguous' ELSE b0 END AS bucket FROM b"""
ORACLES["quality_issues"] = f"WITH {ISSUES} SELECT code, count(*) AS n, min(doc_id) AS first_id FROM (SELECT unnest(codes) AS code, doc_id FROM d) GROUP BY 1"
ORACLES["gate_status"] = f"""
WITH {ISSUES} SELECT doc_id, coalesce(array_to_string(codes, ','), '') AS codes, ready, gate,
 CASE WHEN gate = 'blocked' AND n > 0 THEN 'critical' WHEN gate = 'blocked' THEN 'high' WHEN gate = 'manual' THEN 'medium' ELSE 'low' END AS priority FROM d"""
ORACLES["gate_crosstab"] = f"WITH {ISSUES} SELECT lang, {', '.join(f'''count(*) FILTER (gate = '{g}') AS {g}''' for g in ('auto', 'suggest', 'manual', 'blocked', 'reference_only'))} FROM d GROUP BY 1"
ORACLES["readiness_scores"] = f"""
WITH {ISSUES} SELECT source, round((count(*) FILTER (ready = 'high') + CAST(0.65 AS DOUBLE) * count(*) FILTER (ready = 'medium') + CAST(0.25 AS DOUBLE) * count(*) FILTER (ready = 'low') - CAST(0.15 AS DOUBLE) * count(*) FILTER (ready = 'not_ready')) / count(*) * 100, 4) AS score FROM d GROUP BY 1"""
ORACLES["handoff_exclusions"] = f"""
WITH {ISSUES}, x AS (SELECT concat_ws(',', CASE WHEN gate NOT IN ('auto', 'suggest') THEN 'gate' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END, CASE WHEN copies > 1 THEN 'repeat' END) AS reasons FROM d)
SELECT reasons, count(*) AS n, count(*) FILTER (reasons = '') AS handed_off FROM x GROUP BY 1"""
ORACLES["duplicate_groups"] = r"""
WITH d AS (SELECT doc_id, source, md5(text) AS h, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS k FROM documents),
 g AS (SELECT 'exact' AS kind, count(*) AS size, min(doc_id) AS f FROM d GROUP BY h UNION ALL SELECT 'same_source', count(*), min(doc_id) FROM d GROUP BY source, h UNION ALL SELECT 'folded', count(*), min(doc_id) FROM d GROUP BY k)
SELECT kind, count(*) AS n_groups, CAST(sum(size) AS BIGINT) AS n_rows, max(size) AS largest, CAST(sum(f) AS BIGINT) AS ids FROM g WHERE size > 1 GROUP BY 1"""
ORACLES["dedupe_first"] = "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1"
ORACLES["duplicate_rank"] = """
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS duplicate_rank, count(*) OVER (PARTITION BY md5(text)) AS group_size FROM documents) WHERE group_size > 1"""
ORACLES["conflict_groups"] = "SELECT conv_id, role, count(*) AS n_rows, count(DISTINCT text) AS n_values FROM conversations GROUP BY 1, 2 HAVING count(DISTINCT text) > 1"
EXCESS = "SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS excess, round(CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS rate FROM (SELECT source, md5(text) AS h, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1"
ORACLES["duplicate_excess"] = EXCESS
ORACLES["macro_average"] = f"SELECT count(*) AS n_sources, round(CAST(sum(CAST(rate AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS mean_rate FROM ({EXCESS})"
ORACLES["survivors"] = f"""
WITH {KEYED}, o AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS place FROM e),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, hour ORDER BY place, event_id) AS rn, count(*) OVER (PARTITION BY user_id, day, hour) AS size FROM o),
 v AS (SELECT user_id, day, hour, count(DISTINCT amount) AS values_ FROM e GROUP BY ALL)
SELECT user_id, CAST(day AS INT) AS day, CAST(hour AS INT) AS hour, event_id AS survivor, size, CASE WHEN size = 1 THEN 'keep' WHEN values_ = 1 THEN 'dedupe' ELSE 'manual' END AS action
FROM r JOIN v USING (user_id, day, hour) WHERE rn = 1"""
ORACLES["unique_backfill"] = """
WITH p AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END AS kind FROM part),
 k AS (SELECT p_brand, p_size, min(kind) AS v FROM p WHERE trim(coalesce(kind, '')) <> '' GROUP BY 1, 2 HAVING count(DISTINCT kind) = 1)
SELECT p_partkey, kind, CASE WHEN trim(coalesce(kind, '')) <> '' THEN kind ELSE v END AS filled FROM p LEFT JOIN k USING (p_brand, p_size)"""
ORACLES["rank_topk_gap"] = f"""
WITH l AS (SELECT l_orderkey, l_linenumber, {REV} AS rev FROM lineitem),
 r AS (SELECT *, row_number() OVER w AS rank, lead(rev) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY rev DESC, l_linenumber)),
 g AS (SELECT *, max(CASE WHEN rank = 1 THEN rev - nxt END) OVER (PARTITION BY l_orderkey) AS gap FROM r)
SELECT l_orderkey, l_linenumber, CAST(rev AS DOUBLE) AS revenue, rank, CAST(gap AS DOUBLE) AS gap, rank <= 2 AND coalesce(gap <= 100, false) AS ambiguous FROM g WHERE rank <= 3"""
ORACLES["source_capped_topk"] = """
WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 2)
SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM a QUALIFY rank <= 5"""
ORACLES["latest_per_key"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
ORACLES["candidate_merge"] = """
WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS n2, count(*) FILTER (c_acctbal < 0) AS n3 FROM customer GROUP BY 1, 2),
 p AS (SELECT c_mktsegment, c_nationkey, round(least(1.0::DOUBLE, n / 20.0::DOUBLE), 4) AS a, CASE WHEN n2 > 0 THEN round(least(1.0::DOUBLE, n2 / 12.0::DOUBLE), 4) END AS b, CASE WHEN n3 > 0 THEN round(least(1.0::DOUBLE, n3 / 8.0::DOUBLE), 4) END AS d FROM c),
 q AS (SELECT *, CASE WHEN b IS NULL THEN a ELSE least(1.0::DOUBLE, greatest(a, b) + 0.025::DOUBLE) END AS s1, 1 + (b IS NOT NULL)::INT AS k FROM p)
SELECT c_mktsegment, c_nationkey, round(CASE WHEN d IS NULL THEN s1 ELSE least(1.0::DOUBLE, greatest(s1, d) + least(0.08::DOUBLE, 0.025::DOUBLE * k)) END, 4) AS score,
 CAST(k + (d IS NOT NULL)::INT AS BIGINT) AS n_sources, concat_ws(',', 'deterministic', CASE WHEN b IS NOT NULL THEN 'dictionary' END, CASE WHEN d IS NOT NULL THEN 'lexical' END) AS sources,
 CASE WHEN d IS NOT NULL THEN 'high' WHEN b IS NOT NULL THEN 'medium' ELSE 'low' END AS risk, true AS requires_human_review, false AS safe_for_auto_apply FROM q"""
ORACLES["neighbours"] = "SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
ORACLES["nearby_frame"] = """
SELECT conv_id, turn, concat_ws(',', lag(n, 2) OVER w, lag(n) OVER w, lead(n) OVER w, lead(n, 2) OVER w) AS nearby FROM (SELECT conv_id, turn, CAST(length(text) AS VARCHAR) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
FILL = "SELECT event_id, user_id, signup_id FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY {} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup_id FROM events) WHERE event_type = 'purchase'"
ORACLES["asof_forward_fill"] = FILL.format("user_id")
ORACLES["asof_same_page"] = FILL.format("user_id, CAST(ts AS DATE)")
ORACLES["nearest_total"] = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
 f AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN p END IGNORE NULLS) OVER b AS bp, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER b AS bv,
   first_value(CASE WHEN event_type = 'error' THEN p END IGNORE NULLS) OVER a AS ap, first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER a AS av
  FROM e WINDOW b AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN av IS NOT NULL AND (bv IS NULL OR ap - p <= p - bp) THEN av ELSE bv END AS error_id FROM f WHERE event_type = 'click'"""
ORACLES["point_in_range_assign"] = """
WITH s AS (SELECT user_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events WHERE event_type = 'signup'),
 n AS (SELECT p.event_id, count(s.user_id) AS n_ranges FROM events p LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.s AND (p.ts < s.e OR s.e IS NULL) WHERE p.event_type = 'view' GROUP BY 1)
SELECT event_id, n_ranges, CASE n_ranges WHEN 0 THEN 'unassigned' WHEN 1 THEN 'assigned' ELSE 'ambiguous' END AS status FROM n"""
DAYS = "o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)"
ORACLES["range_end_inference"] = f"""
WITH {DAYS}, s AS (SELECT o_custkey, day, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS nxt FROM (SELECT DISTINCT o_custkey, day FROM o))
SELECT o_custkey, o_orderkey, day, coalesce(nxt - 1, 4017) AS end_day, count(*) OVER (PARTITION BY o_custkey, day) > 1 AS shared_start FROM o JOIN s USING (o_custkey, day)"""
ORACLES["range_topology"] = f"""
WITH {DAYS}, x AS (SELECT *, day + o_orderkey % 200 AS until FROM o), y AS (SELECT *, lead(day) OVER (PARTITION BY o_custkey ORDER BY day, until) - until - 1 AS step FROM x)
SELECT o_custkey, CAST(coalesce(sum(CASE WHEN step > 0 THEN step ELSE 0 END), 0) AS BIGINT) AS gaps, CAST(coalesce(sum(CASE WHEN step < 0 THEN -step ELSE 0 END), 0) AS BIGINT) AS overlaps FROM y GROUP BY 1"""
ORACLES["weighted_consensus"] = f"""
WITH {KEYED}, v AS (SELECT user_id, hour % 4 AS shift, sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END) AS w, count(*) AS n FROM e GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, shift) AS rn, sum(w) OVER (PARTITION BY user_id) AS total FROM v)
SELECT user_id, shift, round(CAST(w AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share, n AS votes, CAST(w AS DOUBLE) / CAST(total AS DOUBLE) >= 0.3 AND n >= 2 AS dominant FROM r WHERE rn = 1"""
ORACLES["state_transitions"] = """
WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type FROM events)
SELECT previous, event_type, count(*) AS n, count(*) FILTER (previous IS NULL OR (previous <> 'error' AND NOT (previous = 'purchase' AND event_type = 'signup'))) AS legal FROM t GROUP BY 1, 2"""
ORACLES["terminal_once"] = """
WITH t AS (SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ended FROM events)
SELECT user_id, count(*) FILTER (NOT ended) AS accepted, count(*) FILTER (ended) AS rejected, count(*) FILTER (NOT ended) AS last FROM t GROUP BY 1"""
ORACLES["vector_topk"] = f"WITH {VECTORS} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 4) AS score FROM s QUALIFY rank <= 5"
ORACLES["vector_restricted"] = f"""
WITH {VECTORS}, t AS (SELECT * FROM s WHERE ql = el QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3)
SELECT query_id, vec_id, round(score, 4) AS score FROM t WHERE score >= 0.2"""
ORACLES["ranking_evaluation"] = f"""
WITH {VECTORS.replace(" WHERE q.vec_id % 100 = 0", "")}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
 f AS (SELECT query_id, min(CASE WHEN ql = el THEN rank END) AS first FROM t GROUP BY 1)
SELECT count(*) AS rows, {', '.join(f'round(avg(CASE WHEN first <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS top{k}' for k in (1, 3, 5))} FROM f"""
ORACLES["token_jaccard_match"] = """
WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part), t AS (SELECT name, list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) AS t FROM n)
SELECT a.name AS left_name, b.name AS right_name, round(CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / len(list_distinct(list_concat(a.t, b.t))), 6) AS score FROM t a JOIN t b ON a.name < b.name AND list_has_any(a.t, b.t)"""
RULES = "r AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS target, c_nationkey AS fold FROM orders JOIN customer ON o_custkey = c_custkey)"
ORACLES["rule_induction"] = f"""
WITH {RULES}, g AS (SELECT segment, priority, target, count(*) AS support, count(DISTINCT fold) AS folds FROM r GROUP BY 1, 2, 3),
 p AS (SELECT *, row_number() OVER (PARTITION BY segment, priority ORDER BY support DESC, target) AS rn, count(*) OVER (PARTITION BY segment, priority) AS n_targets, CAST(sum(support) OVER (PARTITION BY segment, priority) AS BIGINT) AS total FROM g)
SELECT segment, priority, target, support, folds, n_targets, total, round(CAST(support AS DOUBLE) / total, 6) AS precision,
 CASE WHEN n_targets > 1 AND support < 10 THEN 'excluded' WHEN support >= 10 AND folds >= 3 AND n_targets = 1 THEN 'strong' WHEN support >= 3 AND folds >= 2 THEN 'usable' ELSE 'weak' END AS tier FROM p WHERE rn = 1"""
ORACLES["leave_one_out"] = f"""
WITH {RULES}, f AS (SELECT DISTINCT fold FROM r), o AS (SELECT f.fold, segment, priority, target, count(*) AS support FROM f JOIN r ON f.fold <> r.fold GROUP BY ALL HAVING count(*) >= 2),
 u AS (SELECT fold, segment, priority, target AS predicted FROM o QUALIFY row_number() OVER (PARTITION BY fold, segment, priority ORDER BY support DESC, target) = 1),
 a AS (SELECT r.fold, count(*) AS observations, count(predicted) AS predicted, count(*) FILTER (predicted = target) AS correct FROM r LEFT JOIN u USING (fold, segment, priority) GROUP BY 1)
SELECT fold, observations, predicted, correct, round(CAST(predicted AS DOUBLE) / observations, 6) AS coverage, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE round(CAST(correct AS DOUBLE) / predicted, 6) END AS precision FROM a"""
ORACLES["sliced_metrics"] = """
WITH d AS (SELECT lang, source, n_chars >= 200 AS c, quality = 1 AS g FROM documents JOIN labels USING (doc_id)),
 s AS (SELECT 'all' AS slice, NULL AS value, c, g FROM d UNION ALL SELECT 'lang', lang, c, g FROM d UNION ALL SELECT 'source', source, c, g FROM d)
SELECT slice, value, count(*) AS n, round(CAST(count(*) FILTER (c) AS DOUBLE) / count(*), 6) AS coverage, CASE WHEN count(*) FILTER (c) = 0 THEN 0.0::DOUBLE ELSE round(CAST(count(*) FILTER (c AND g) AS DOUBLE) / count(*) FILTER (c), 6) END AS precision FROM s GROUP BY 1, 2"""


def _profile(name: str, cap: int, k: int, least: float) -> str:
    return f"""SELECT '{name}' AS profile, count(*) AS covered, count(*) FILTER (hit <= 1) AS h1, count(*) FILTER (hit <= 3) AS h3, count(*) FILTER (hit <= 5) AS h5 FROM (
 SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN rank END) AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM (
   SELECT * FROM orders WHERE o_totalprice >= {least} QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= {cap}) QUALIFY rank <= {k}) GROUP BY 1)"""


ORACLES["profile_calibration"] = f"""
WITH p AS ({_profile('strict', 1, 3, 3000)} UNION ALL {_profile('balanced', 2, 4, 1500)} UNION ALL {_profile('recall', 3, 5, 0)}), n AS (SELECT count(DISTINCT o_custkey) AS rows FROM orders),
 r AS (SELECT profile, covered, round(CAST(covered AS DOUBLE) / rows, 6) AS coverage, {', '.join(f'coalesce(round(CAST(h{k} AS DOUBLE) / nullif(covered, 0), 6), 0) AS top{k}' for k in (1, 3, 5))} FROM p, n),
 q AS (SELECT *, round(22 * coverage + 34 * top1 + 20 * top3 + 14 * top5 + 8 * (1 - 0.0::DOUBLE) - 6 * 0.0::DOUBLE, 4) AS quality FROM r)
SELECT *, row_number() OVER (ORDER BY quality DESC, profile) = 1 AS selected FROM q"""
ORACLES["hybrid_blend"] = """
WITH s AS (SELECT s_suppkey AS id, round(least(1.0::DOUBLE, s_acctbal / 10000), 4) AS x FROM supplier WHERE s_acctbal > 0), v AS (SELECT l_suppkey AS id, round(least(1.0::DOUBLE, CAST(count(*) AS DOUBLE) / 1000), 4) AS y FROM lineitem GROUP BY 1)
SELECT id, round(0.3::DOUBLE * coalesce(x, 0) + 0.7::DOUBLE * coalesce(y, 0), 4) AS score FROM s FULL JOIN v USING (id)"""
ORACLES["json_tolerant"] = """
WITH k AS (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN -1 ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) END AS k FROM events)
SELECT event_type, count(*) FILTER (k = -1) AS bad, CAST(sum(k) AS BIGINT) AS total FROM k GROUP BY 1"""
ORACLES["label_normaliser"] = r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' and ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS normal, lower(p_name) AS words, p_name AS bare FROM part"""
ORACLES["html_extract"] = """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(string_split(html, '<p>')) - 1 AS paragraphs FROM pages"""
ORACLES["hierarchy_paths"] = """
SELECT DISTINCT 'r' || n_regionkey AS node, 'r' || n_regionkey AS path, CAST(0 AS BIGINT) AS depth FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey || '/' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0'), 1 FROM nation
UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey || '/' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') || '/' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
ORACLES["fiscal_contexts"] = """
WITH o AS (SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS f FROM orders)
SELECT o_orderkey, CAST(f AS VARCHAR) AS current_end, CAST(CAST(date_trunc('month', f) AS DATE) AS VARCHAR) AS month_start, year(f) AS year, year(f) - 1 AS prior_year, date_diff('day', CAST(date_trunc('year', f) AS DATE), f) AS day_of_year FROM o"""
ORACLES["content_hash"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"
ORACLES["xbrl_roundtrip"] = "SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(0 AS BIGINT) AS warnings FROM customer GROUP BY 1"
ORACLES["events_window"] = """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(max(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS largest FROM events GROUP BY 1, 2"""
ORACLES["events_session"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
