"""XBRL instances and linkbases: contexts and units by Spark's XML functions, facts and arcs by an XML parser in Arrow batches.

Facts keep their text: Spark's XML functions name every element in a schema, or, as a variant, turn 007
into 7. An instance is one row, parsed in one task; its size is that of a report.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.sources.shared import new_folder


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of instance files; those that declare a DOCTYPE or an entity are marked and not parsed."""
    df = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return df.withColumn("rejected", F.col("text").rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)"))


#: What the reader of an instance needs of contexts and units, whatever their prefixes.
_CONTEXT = """struct<_id: string, entity: struct<identifier: struct<_VALUE: string, _scheme: string>, segment: {0}>, scenario: {0}, period: struct<instant: string, startDate: string, endDate: string>>""".format(
    "struct<explicitMember: array<struct<_VALUE: string, _dimension: string>>, typedMember: array<struct<_dimension: string, xs_any: array<string>>>>"
)
_INSTANCE = f"context array<{_CONTEXT}>, unit array<struct<_id: string, measure: array<string>, divide: struct<unitNumerator: struct<measure: array<string>>, unitDenominator: struct<measure: array<string>>>>>, schemaRef array<struct<_href: string>>"
#: Children of an instance that are no facts.
NO_FACTS = ("context", "unit", "schemaRef", "linkbaseRef", "roleRef", "arcroleRef", "footnoteLink")
#: Nodes of a level of a forest that are broadcast.
FEW = 10_000
#: Facts of an instance that is written, and instances that a task writes, on average.
FACTS_A_FILE, FILES_A_TASK = 4000, 8
#: Characters that are parsed at once.
SLICE = 1_000_000
_ELEMENTS = "array<struct<place: int, above: int, depth: int, name: string, attributes: map<string, string>, text: string>>"


def _elements_of(text: str | None) -> list[tuple] | None:
    """Elements of one document in order: place, place of the parent, depth, name, attributes, text with that of what is inside.

    Null for text that is not well-formed, or that declares a document type (entities could be anything).
    """
    found: list[list] = []
    open_at: list[int] = []

    def begin(name: str, attributes: dict[str, str]) -> None:
        found.append([len(found), open_at[-1] if open_at else None, len(open_at), name, attributes, []])
        open_at.append(len(found) - 1)

    def data(piece: str) -> None:
        for at in open_at[1:]:  # the root's text is that of the whole document
            found[at][5].append(piece)

    def refuse(*_) -> None:
        raise ValueError("document type")

    reader = expat.ParserCreate()
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler, reader.StartDoctypeDeclHandler = begin, lambda _: open_at.pop(), data, refuse
    try:
        reader.Parse(text or "", True)
    except (expat.ExpatError, ValueError):
        return None
    return [(*x[:5], "".join(x[5])) for x in found]


def elements(text: str) -> Column:
    """All elements of an XML document, by an XML parser: entities, CDATA and comments are what they are."""

    @F.pandas_udf(_ELEMENTS)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # a batch has thousands of documents: what is parsed at once is a slice of it
        for texts in batches:
            part = (texts.str.len().fillna(0).cumsum() // SLICE).astype("int64")
            for _, few in texts.groupby(part.to_numpy(), sort=False):
                yield few.map(_elements_of)

    return parsed(text)


def problems(instances: DataFrame) -> DataFrame:
    """(path, problem): files that are not read, and why. instances: path, text, rejected."""
    why = F.when(F.col("rejected"), "document_type_declared").when(elements("text").isNull(), "not_well_formed")
    return instances.select("path", why.alias("problem")).where("problem IS NOT NULL")


def _read(instances: DataFrame) -> DataFrame:
    return instances.where("not rejected").select("path", F.from_xml("text", F.lit(_INSTANCE), {"ignoreNamespace": "true"}).alias("x"))


def contexts(instances: DataFrame) -> DataFrame:
    """(path, context_ref, entity, scheme, period_start, period_end, instant, dimensions, members).

    dimensions: dimension=member, or dimension=value of a typed member; members: (type, dimension, member,
    value). Both from segment and scenario.
    """
    rows = _read(instances).select("path", F.explode("x.context").alias("c"))
    none = F.array()
    member = "struct<type: string, dimension: string, member: string, value: string>"
    parts = []
    for at in ("c.entity.segment", "c.scenario"):
        explicit = F.transform(F.col(f"{at}.explicitMember"), lambda m: F.named_struct(F.lit("type"), F.lit("explicit"), F.lit("dimension"), m["_dimension"], F.lit("member"), F.trim(m["_VALUE"]), F.lit("value"), F.lit(None).cast("string")))
        typed = F.transform(F.col(f"{at}.typedMember"), lambda m: F.named_struct(F.lit("type"), F.lit("typed"), F.lit("dimension"), m["_dimension"], F.lit("member"), F.lit(None).cast("string"), F.lit("value"), F.trim(F.array_join(m["xs_any"], ""))))
        parts += [F.coalesce(x, none).cast(f"array<{member}>") for x in (explicit, typed)]
    period = lambda name: F.nullif(F.trim(F.col(f"c.period.{name}")), F.lit(""))
    out = rows.select(
        "path", F.col("c._id").alias("context_ref"), F.trim("c.entity.identifier._VALUE").alias("entity"), F.col("c.entity.identifier._scheme").alias("scheme"),
        period("startDate").alias("period_start"), period("endDate").alias("period_end"), period("instant").alias("instant"), F.concat(*parts).alias("members"),
    )
    return out.withColumn("dimensions", F.transform("members", lambda m: F.concat(m["dimension"], F.lit("="), F.coalesce(m["member"], m["value"]))))


def units(instances: DataFrame) -> DataFrame:
    """(path, unit_ref, measures): of a ratio its numerator's measures, then its denominator's with a slash."""
    rows = _read(instances).select("path", F.explode("x.unit").alias("u"))
    none = F.array().cast("array<string>")
    below = F.transform(F.col("u.divide.unitDenominator.measure"), lambda m: F.concat(F.lit("/"), F.trim(m)))
    measures = F.concat(F.coalesce("u.measure", none), F.coalesce("u.divide.unitNumerator.measure", none))
    return rows.select("path", F.col("u._id").alias("unit_ref"), F.concat(F.transform(measures, lambda m: F.trim(m)), F.coalesce(below, none)).alias("measures"))


def schema_refs(instances: DataFrame) -> DataFrame:
    """(path, href) of the schemas that an instance names."""
    return _read(instances).select("path", F.explode("x.schemaRef").alias("r")).select("path", F.col("r._href").alias("href"))


def facts(instances: DataFrame) -> DataFrame:
    """A row per fact, joined to its context and unit; what is missing is a warning.

    Facts are the root's children that are no infrastructure, in order (place). A fact's value is its text as
    written: numbers stay text, markup inside gives its text. namespace: what the fact's prefix stands for
    on the root or the fact itself.
    """
    rows = instances.where("not rejected").select("path", elements("text").alias("e"))
    root = rows.select("path", F.explode("e").alias("x"), F.col("e")[0]["attributes"].alias("root"))
    a = lambda name: F.element_at("x.attributes", F.lit(name))
    local = F.element_at(F.split("x.name", ":"), -1)
    prefix = F.when(F.contains("x.name", F.lit(":")), F.split("x.name", ":")[0])
    xmlns = F.when(prefix.isNull(), "xmlns").otherwise(F.concat(F.lit("xmlns:"), prefix))
    nil = F.exists(F.map_entries("x.attributes"), lambda kv: kv["key"].isin("nil", "xsi:nil") & F.lower(F.trim(kv["value"])).isin("true", "1"))
    found = root.where((F.col("x.depth") == 1) & ~local.isin(*NO_FACTS)).select(
        "path", F.col("x.place").alias("place"), F.col("x.name").alias("qname"), local.alias("local_name"), F.coalesce(F.element_at("x.attributes", xmlns), F.element_at("root", xmlns)).alias("namespace"),
        a("id").alias("fact_id"), a("contextRef").alias("context_ref"), a("unitRef").alias("unit_ref"), a("decimals").alias("decimals"), F.trim("x.text").alias("value"), nil.alias("is_nil"),
    )
    out = found.join(contexts(instances), ["path", "context_ref"], "left").join(units(instances), ["path", "unit_ref"], "left")
    warnings = F.filter(F.array(F.when(F.col("entity").isNull(), "missing_context_ref"), F.when(F.col("unit_ref").isNotNull() & F.col("measures").isNull(), "missing_unit_ref")), lambda x: x.isNotNull())
    return out.withColumns({"is_numeric": F.col("unit_ref").isNotNull(), "warnings": warnings})


# --- linkbases


def _links(linkbases: DataFrame) -> DataFrame:
    """Elements of linkbases: path, link (place of the extended link), place, kind (local name), attributes, text."""
    rows = linkbases.select("path", F.explode(elements("text")).alias("x"))
    return rows.select("path", F.col("x.above").alias("link"), F.col("x.place").alias("place"), F.element_at(F.split("x.name", ":"), -1).alias("kind"), F.col("x.attributes").alias("a"), F.trim("x.text").alias("text"))


def _of(rows: DataFrame, kind: str, **names: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select("path", "link", "place", "text", *(F.element_at("a", F.lit(v)).alias(k) for k, v in names.items()))


def concept_labels(linkbases: DataFrame) -> DataFrame:
    """(concept, label): locators, arcs and labels of label linkbases joined. linkbases: path, text."""
    rows = _links(linkbases)
    loc = _of(rows, "loc", start="xlink:label", href="xlink:href").select("path", "link", "start", F.element_at(F.split("href", "#"), -1).alias("concept"))
    arc = _of(rows, "labelArc", start="xlink:from", end="xlink:to").select("path", "link", "start", "end")
    label = _of(rows, "label", end="xlink:label").select("path", "link", "end", F.col("text").alias("label"))
    return loc.join(arc, ["path", "link", "start"]).join(label, ["path", "link", "end"]).select("concept", "label").distinct()


def presentation_arcs(linkbases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (path, link, start, end, priority, place) and nodes (path, link, node, concept) of presentation linkbases."""
    rows = _links(linkbases)
    nodes = _of(rows, "loc", node="xlink:label", href="xlink:href").where(F.contains("href", F.lit("#")))
    arcs = _of(rows, "presentationArc", start="xlink:from", end="xlink:to", priority="order").where("start IS NOT NULL AND end IS NOT NULL")
    concept = F.replace(F.element_at(F.split("href", "#"), -1), F.lit("_"), F.lit(":"))
    return arcs.select("path", "link", "start", "end", F.coalesce(F.col("priority").try_cast("double"), F.lit(0.0)).alias("priority"), "place"), nodes.select("path", "link", "node", concept.alias("concept"))


def forest(arcs: DataFrame, nodes: DataFrame, keys: list[str], passed: str = "Abstract|Table|LineItems", deepest: int = 1000) -> DataFrame:
    """(keys, concept, level, parent, position): the forests of arcs, depth first, siblings by priority.

    Roots begin arcs and end none; they come in the order of their first arc. A concept that `passed`
    matches is left out, its children stay, with the level that they have. An arc to a node of its own
    path is cut, a node under two parents comes twice; a node without a concept ends its branch. As
    many steps as the tallest tree has levels, each a join with the nodes of a level, which are written to
    the shared folder: only levels of at most ``FEW`` nodes are broadcast, and no arcs.
    """
    spark, folder = arcs.sparkSession, new_folder(arcs.sparkSession, "forest")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    ranked = arcs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "start").orderBy("priority", "place")).cast("long"))
    begun = arcs.groupBy(*keys, F.col("start").alias("node")).agg(F.min("place").alias("first")).join(arcs.select(*keys, F.col("end").alias("node")), [*keys, "node"], "left_anti")
    ends = nodes.select(*keys, F.col("node").alias("end"), F.col("concept").alias("below"))
    steps = written(ranked.select(*keys, F.col("start").alias("node"), "end", "rank").join(ends.hint("merge"), [*keys, "end"]), "steps")
    first = begun.join(nodes.hint("merge"), [*keys, "node"])
    level = written(first.select(*keys, "node", "concept", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.array("node").alias("trail"), F.array(F.col("first").cast("long")).alias("way")), "level-0")
    done = 0
    while n := level.count():
        if done >= deepest:
            raise ValueError(f"a tree has more than {deepest} levels")
        done += 1
        met = steps.join(level.hint("broadcast" if n <= FEW else "merge"), [*keys, "node"]).where(~F.array_contains("trail", F.col("end")))
        down = met.select(*keys, F.col("end").alias("node"), F.col("below").alias("concept"), F.col("concept").alias("parent"), (F.col("level") + 1).alias("level"), F.array_append("trail", F.col("end")).alias("trail"), F.array_append("way", F.col("rank")).alias("way"))
        level = written(down, f"level-{done}")
    found = spark.read.schema(level.schema).parquet(*(f"{folder}/level-{i}" for i in range(done + 1))).select(*keys, "concept", "level", "parent", "way")
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("way")) - 1
    return found.where(~F.col("concept").rlike(passed)).withColumn("position", position).drop("way")


def instance_text(rows: DataFrame, key: str) -> DataFrame:
    """(key, part, text): instances of a key from rows of qname, context_ref, instant, unit and value.

    A key's rows are dealt over as many instances as FACTS_A_FILE asks for, each with the contexts and units of its own
    facts, so what a task writes or reads at once doesn't grow with the rows of a key.
    """
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    context = F.concat(F.lit('<context id="'), F.col("context_ref"), F.lit('"><entity><identifier scheme="http://example.org">'), F.col(key).cast("string"), F.lit("</identifier></entity><period><instant>"), F.col("instant"), F.lit("</instant></period></context>"))
    unit = F.concat(F.lit('<unit id="'), F.col("unit"), F.lit('"><measure>iso4217:'), F.col("unit"), F.lit("</measure></unit>"))
    fact = F.concat(F.lit("<"), F.col("qname"), F.lit(' contextRef="'), F.col("context_ref"), F.lit('" unitRef="'), F.col("unit"), F.lit('" decimals="2">'), esc("value"), F.lit("</"), F.col("qname"), F.lit(">"))
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / FACTS_A_FILE).alias("_files"))
    dealt = rows.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn("part", F.pmod(F.xxhash64("qname", "context_ref", "value"), "_files"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (FACTS_A_FILE * FILES_A_TASK)))
    parts = dealt.repartition(tasks, key, "part").groupBy(key, "part").agg(F.array_sort(F.collect_set(context)).alias("c"), F.array_sort(F.collect_set(unit)).alias("u"), F.array_sort(F.collect_list(fact)).alias("f"))
    return parts.select(key, "part", F.concat(F.lit("<xbrl>"), F.array_join("c", ""), F.array_join("u", ""), F.array_join("f", ""), F.lit("</xbrl>")).alias("text"))
