"""XML instances and linkbases: what regular expressions would get wrong."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tributary.sources import xbrl

INSTANCE = """<?xml version="1.0" encoding="UTF-8"?>
<!-- <a:No contextRef="c1">1</a:No> -->
<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:a="urn:a" xmlns:link="l" xmlns:xlink="x" xmlns:xsi="i" xmlns:xbrldi="d">
<link:schemaRef xlink:href="a&amp;b.xsd"/>
<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="http://s">E &amp; Co</xbrli:identifier><xbrli:segment>
 <xbrldi:explicitMember dimension="a:D">a:M</xbrldi:explicitMember><xbrldi:typedMember dimension="a:T"><a:key>007</a:key></xbrldi:typedMember></xbrli:segment></xbrli:entity>
 <xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id='c2'><xbrli:entity><xbrli:identifier scheme="s">E</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate> 2024-12-31 </xbrli:endDate></xbrli:period>
 <xbrli:scenario><xbrldi:explicitMember dimension="a:E">a:N</xbrldi:explicitMember></xbrli:scenario></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:MYR</xbrli:measure></xbrli:unit>
<xbrli:unit id="v"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:MYR</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
<a:Code contextRef="c1">007</a:Code>
<a:Rev contextRef="c2" unitRef="u" decimals="0">1.50</a:Rev><a:Rev contextRef="c1" unitRef="v">-2</a:Rev>
<a:Note contextRef="c2" title="a > b"><![CDATA[<p>x & y</p> <!-- kept -->]]></a:Note>
<a:Cut contextRef="c1">1<!-- not this -->2 &#233;&lt;</a:Cut>
<b:Rich xmlns:b="urn:b" contextRef="c1">some <i>nested</i> text</b:Rich>
<a:Nil contextRef="c1" xsi:nil="true"/><a:Lost contextRef="c9" unitRef="u9">1</a:Lost><a:Free>0</a:Free>
</xbrli:xbrl>"""


def instances(spark, *texts):
    return spark.createDataFrame([(str(k), t, False) for k, t in enumerate(texts)], "path string, text string, rejected boolean")


def test_facts_keep_their_text(spark):
    got = {(r.qname, r.context_ref): r for r in xbrl.facts(instances(spark, INSTANCE)).collect()}
    assert {k: v.value for k, v in got.items()} == {
        ("a:Code", "c1"): "007", ("a:Rev", "c2"): "1.50", ("a:Rev", "c1"): "-2", ("a:Note", "c2"): "<p>x & y</p> <!-- kept -->", ("a:Cut", "c1"): "12 é<", ("b:Rich", "c1"): "some nested text",
        ("a:Nil", "c1"): "", ("a:Lost", "c9"): "1", ("a:Free", None): "0",
    }
    assert [k[0] for k, r in got.items() if r.is_nil] == ["a:Nil"] and got["b:Rich", "c1"].namespace == "urn:b" and got["a:Code", "c1"].namespace == "urn:a"
    assert got["a:Lost", "c9"].warnings == ["missing_context_ref", "missing_unit_ref"] and got["a:Free", None].warnings == ["missing_context_ref"]
    assert got["a:Rev", "c1"].measures == ["iso4217:MYR", "/xbrli:shares"] and got["a:Rev", "c2"].is_numeric and not got["a:Code", "c1"].is_numeric


def test_contexts_with_typed_dimensions(spark):
    got = {r.context_ref: r for r in xbrl.contexts(instances(spark, INSTANCE)).collect()}
    assert (got["c1"].entity, got["c1"].instant, got["c1"].dimensions) == ("E & Co", "2024-12-31", ["a:D=a:M", "a:T=007"])
    assert [tuple(m) for m in got["c1"].members] == [("explicit", "a:D", "a:M", None), ("typed", "a:T", None, "007")]
    assert (got["c2"].period_start, got["c2"].period_end, got["c2"].dimensions) == ("2024-01-01", "2024-12-31", ["a:E=a:N"])
    assert [r.href for r in xbrl.schema_refs(instances(spark, INSTANCE)).collect()] == ["a&b.xsd"]


def test_bad_files_are_named(spark):
    bad = instances(spark, INSTANCE, "<a><b></a>", "", None, '<!DOCTYPE x [<!ENTITY e "f">]><x>&e;</x>')
    assert {(r.path, r.problem) for r in xbrl.problems(bad).collect()} == {(k, "not_well_formed") for k in "1234"}
    assert {r.path for r in xbrl.facts(bad).collect()} == {"0"}
    assert xbrl.facts(instances(spark, INSTANCE).limit(0)).count() == 0


def plain_forest(arcs, nodes):
    """Depth first, written as a loop. arcs: (start, end, priority) in order."""
    kids = {}
    for place, (a, b, p) in enumerate(arcs):
        kids.setdefault(a, []).append((p, place, b))
    out = []
    for root in [a for a in kids if a not in {b for _, b, _ in arcs}]:
        todo = [(root, 0, None, (root,))]
        while todo:
            node, level, parent, trail = todo.pop()
            if node not in nodes:
                continue
            if not any(x in nodes[node] for x in ("Abstract", "Table", "LineItems")):
                out.append((nodes[node], level, parent))
            todo += [(b, level + 1, nodes[node], (*trail, b)) for _, _, b in sorted(kids.get(node, []), reverse=True) if b not in trail]
    return [(c, lv, p, i) for i, (c, lv, p) in enumerate(out)]


def test_forests_against_a_loop(spark):
    rng = random.Random(5)
    texts, want = [], {}
    for k in range(6):
        names = [f"n{i}" for i in range(25)]
        nodes = {n: f"p:C{i}{rng.choice(['', '', 'Abstract'])}" for i, n in enumerate(names) if i % 9 != 8}
        arcs = [(names[rng.randrange(i)], names[i], rng.choice([1.0, 2.0, 2.0, 10.0])) for i in range(1, 25) if i % 7]
        arcs += [(names[20], names[20], 1.0), (names[24], names[3], 1.0)]
        rng.shuffle(arcs)
        body = "".join(f'<link:loc xlink:label="{n}" xlink:href="x.xsd#{c.replace(":", "_")}"/>' for n, c in nodes.items())
        body += "".join(f'<link:presentationArc xlink:from="{a}" xlink:to="{b}" order="{p}"/>' for a, b, p in arcs)
        texts.append(f'<link:linkbase xmlns:link="l" xmlns:xlink="x"><link:presentationLink>{body}</link:presentationLink></link:linkbase>')
        want[str(k)] = plain_forest(arcs, nodes)
    arcs, nodes = xbrl.presentation_arcs(instances(spark, *texts))
    got = {k: [] for k in want}
    for r in sorted(xbrl.forest(arcs, nodes, ["path", "link"]).collect(), key=lambda r: r.position):
        got[r.path].append((r.concept, r.level, r.parent, r.position))
    assert got == want


def test_a_deep_chain(spark):
    arcs = spark.createDataFrame([("p", i, i + 1, 0.0, i) for i in range(150)], "path string, start int, end int, priority double, place int")
    nodes = spark.createDataFrame([("p", i, f"c{i}") for i in range(151)], "path string, node int, concept string")
    assert xbrl.forest(arcs, nodes, ["path"]).agg({"level": "max"}).first()[0] == 150


def test_forests_send_no_arcs_to_the_driver(spark, monkeypatch):
    arcs = spark.range(1, 64).selectExpr("'p' AS path", "id DIV 2 AS start", "id AS end", "0.0D AS priority", "id AS place")
    nodes = spark.range(64).selectExpr("'p' AS path", "id AS node", "concat('c', id) AS concept")
    got = []
    for few in (10_000, 0):
        monkeypatch.setattr(xbrl, "FEW", few)
        out = xbrl.forest(arcs, nodes, ["path"])
        assert "UnionLoop" not in out._jdf.queryExecution().optimizedPlan().toString()
        got.append(sorted((r.position, r.concept, r.level) for r in out.collect()))
    assert got[0] == got[1] and [r[1:] for r in got[0]][:4] == [("c0", 0), ("c1", 1), ("c2", 2), ("c4", 3)] and len(got[0]) == 64
    with pytest.raises(ValueError):
        xbrl.forest(arcs, nodes, ["path"], deepest=3)


def test_instances_of_a_key_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(xbrl, "FACTS_A_FILE", 20)
    rows = spark.createDataFrame([(i % 3, "x:A", f"c{i // 2}", "2023-12-31", "EUR", i) for i in range(600)], "k int, qname string, context_ref string, instant string, unit string, value int")
    made = xbrl.instance_text(rows, "k").select("k", F.concat_ws("/", "part", "k").alias("path"), "text", F.lit(False).alias("rejected"))
    facts = xbrl.facts(made)
    assert sorted(int(r.value) for r in facts.collect()) == list(range(600))
    assert facts.where("size(warnings) > 0 OR instant IS NULL OR measures IS NULL").count() == 0
    assert facts.groupBy("path").count().agg(F.max("count")).first()[0] < 60 and made.groupBy("k").count().agg(F.min("count")).first()[0] > 5
