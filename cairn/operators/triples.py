"""Typed entity edges with history: storing, as-of reads, path joins and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.base import cut


def store_triples(triples: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Arrivals as a history: each valid triple opens an edge; the next one of its key closes it. triples: id, subject,
    predicate, object, profile, at. Unknown predicates, self-edges and missing ends are refused."""
    good = triples.filter(F.col("predicate").isin(vocabulary) & F.col("subject").isNotNull() & F.col("object").isNotNull() & (F.col("subject") != F.col("object")))
    w = Window.partitionBy("subject", "predicate", "object", "profile").orderBy("at", "id")
    return good.select("id", "subject", "predicate", "object", "profile", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"), F.lead("id").over(w).alias("superseded_by"))


def current_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("valid_to").isNull())


def edges_as_of(edges: DataFrame, at: Column) -> DataFrame:
    return edges.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def edges_as_of_table(times: DataFrame, edges: DataFrame) -> DataFrame:
    """subject's edges at each asked time: an equi-join on the subject and a range on the time. times: ask_id, subject, at."""
    return times.join(edges, "subject").filter((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))


def resolve_entities(refs: DataFrame, entities: DataFrame, aliases: DataFrame, types: list[str]) -> DataFrame:
    """ref_id, entity_id, ambiguous: by `type:name`, else by name (smallest id), else by alias in the profile. refs: ref_id, ref, profile."""
    kind, name = F.split_part("ref", F.lit(":"), F.lit(1)), F.expr("substring(ref, instr(ref, ':') + 1)")
    qualified = F.contains("ref", F.lit(":")) & kind.isin(types)
    asked = refs.select("ref_id", "ref", "profile", F.when(qualified, kind).alias("kind"), F.when(qualified, name).otherwise(F.col("ref")).alias("name"))
    exact = entities.select(F.col("entity_type").alias("kind"), F.col("canonical_name").alias("name"), F.col("entity_id").alias("exact_id"))
    named = entities.groupBy(F.col("canonical_name").alias("name")).agg(F.min("entity_id").alias("named_id"), (F.count("*") > 1).alias("many"))
    known = aliases.select(F.col("alias").alias("ref"), "profile", F.col("entity_id").alias("alias_id"))
    out = asked.join(exact, ["kind", "name"], "left").join(named, "name", "left").join(known, ["ref", "profile"], "left")
    by_name = F.when(F.col("kind").isNull(), F.col("named_id"))
    return out.select("ref_id", F.coalesce("exact_id", by_name, "alias_id").alias("entity_id"), (F.col("exact_id").isNull() & by_name.isNotNull() & F.col("many")).cast("int").alias("ambiguous"))


def query_join(starts: DataFrame, path: list[str], edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """start, hop, subject, predicate, object: the edges met along a path of predicates, one hop for each. Entities met
    before aren't entered again, though their edge is reported; a start whose hop finds nothing has no rows. starts: start, profile."""
    near, far = ("subject", "object") if direction == "outgoing" else ("object", "subject")
    front = starts.select("start", "profile", F.col("start").alias("node")).distinct()
    seen, hops = front, []
    for hop, predicate in enumerate(path, 1):
        step = edges.filter(F.col("predicate") == predicate).select(F.col(near).alias("node"), "profile", F.col(far).alias("next"), "subject", "predicate", "object")
        met = cut(front.join(step, ["node", "profile"]))
        hops.append(met.select("start", "profile", F.lit(hop).alias("hop"), "subject", "predicate", "object"))
        front = met.select("start", "profile", F.col("next").alias("node")).distinct()
        if hop < len(path):
            front = front.join(seen, ["start", "profile", "node"], "left_anti")
            seen = seen.unionByName(front)
    every = hops[0]
    for h in hops[1:]:
        every = every.unionByName(h)
    whole = every.groupBy("start", "profile").agg(F.countDistinct("hop").alias("n")).filter(F.col("n") == len(path)).drop("n")
    return every.join(whole, ["start", "profile"], "left_semi").distinct()


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("id").alias("edge_id"), F.explode("derived_from").alias("d")).select("edge_id", F.col("d.source_edge_id").alias("source_edge_id"), F.col("d.source_memory_id").alias("source_memory_id"))


def trace_provenance(starts: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """start, edge_id, depth: an edge and those it derives from, back to `depth` levels; ids of edges that aren't there are
    left out. edges: id, derived_from (array of source_edge_id, source_memory_id, reasoning)."""
    parents = _links(edges).filter(F.col("source_edge_id").isNotNull()).select("edge_id", "source_edge_id").distinct()
    there = edges.select(F.col("id").alias("edge_id"))
    front = starts.select("start", F.col("start").alias("edge_id")).distinct().join(there, "edge_id", "left_semi")
    seen = front.select("start", "edge_id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        front = front.join(parents, "edge_id").select("start", F.col("source_edge_id").alias("edge_id")).distinct().join(there, "edge_id", "left_semi").join(seen.select("start", "edge_id"), ["start", "edge_id"], "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("start", "edge_id", F.lit(d).alias("depth")))
    return seen


def provenance_roots(traced: DataFrame, edges: DataFrame) -> DataFrame:
    """start, memory_id: the memories at the bottom of traced edges, from their facts and their sources."""
    facts = edges.select(F.col("id").alias("edge_id"), F.col("fact_id").alias("memory_id")).unionByName(_links(edges).select("edge_id", F.col("source_memory_id").alias("memory_id")))
    return traced.select("start", "edge_id").join(facts.filter(F.col("memory_id").isNotNull()), "edge_id").select("start", "memory_id").distinct()


def find_derivatives(sources: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """start, edge_id, depth: edges that derive from a given edge or memory, each once. sources: start, edge_id, memory_id (one is null)."""
    links = _links(edges)
    first = sources.filter(F.col("edge_id").isNotNull()).select("start", F.col("edge_id").alias("source_edge_id")).join(links, "source_edge_id").select("start", "edge_id")
    first = first.unionByName(sources.filter(F.col("memory_id").isNotNull()).select("start", F.col("memory_id").alias("source_memory_id")).join(links, "source_memory_id").select("start", "edge_id")).distinct()
    children = links.filter(F.col("source_edge_id").isNotNull()).select("source_edge_id", F.col("edge_id").alias("child")).distinct()
    first = cut(first)
    front, seen = first, first.select("start", "edge_id", F.lit(1).alias("depth"))
    for d in range(2, depth + 1):
        front = front.join(children, front["edge_id"] == children["source_edge_id"]).select("start", F.col("child").alias("edge_id")).distinct().join(seen.select("start", "edge_id"), ["start", "edge_id"], "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("start", "edge_id", F.lit(d).alias("depth")))
    return seen


def validate_derived_from(edges: DataFrame) -> DataFrame:
    """edges with ok: each element names an edge or a memory."""
    return edges.withColumn("ok", F.forall(F.coalesce("derived_from", F.array().cast(edges.schema["derived_from"].dataType)), lambda d: d["source_edge_id"].isNotNull() | (F.length(d["source_memory_id"]) > 0)).cast("int"))


def edge_vocabulary(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges with their predicate's label, and the inverse edges of predicates that have one. vocabulary: predicate, label, inverse."""
    named = edges.join(F.broadcast(vocabulary), "predicate", "left")  # a fixed vocabulary
    label = vocabulary.select(F.col("predicate").alias("inverse"), F.col("label").alias("inverse_label"))
    back = named.filter(F.col("inverse").isNotNull()).join(F.broadcast(label), "inverse", "left")
    return named.select("subject", "predicate", "object", "label", F.lit(0).alias("is_inverse")).unionByName(
        back.select(F.col("object").alias("subject"), F.col("inverse").alias("predicate"), F.col("subject").alias("object"), F.col("inverse_label").alias("label"), F.lit(1).alias("is_inverse"))
    )


def apply_graph_bundle(concepts: DataFrame, concept_edges: DataFrame, entities: DataFrame, edges: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Each bundle edge with its fate: unknown_predicate, missing_object, self, already_present or written.

    concepts: path, canonical_name, entity_type; concept_edges: path, predicate, target_path. Concepts that aren't
    entities yet count as created; so both ends exist if both are concepts.
    """
    return _judged(concepts, concept_edges, edges, vocabulary).select("path", "predicate", "target_path", "fate")


def _judged(concepts: DataFrame, concept_edges: DataFrame, edges: DataFrame, vocabulary: list[str]) -> DataFrame:
    known = concepts.select(F.col("path"), F.concat_ws(":", "entity_type", "canonical_name").alias("name"))
    ends = concept_edges.join(known.select("path", F.col("name").alias("subject")), "path", "left").join(known.select(F.col("path").alias("target_path"), F.col("name").alias("object")), "target_path", "left")
    have = edges.filter(F.col("valid_to").isNull()).select("subject", "predicate", "object", F.lit(1).alias("have")).distinct()
    fate = F.when(~F.col("predicate").isin(vocabulary), "unknown_predicate").when(F.col("object").isNull(), "missing_object").when(F.col("subject") == F.col("object"), "self").when(F.col("have") == 1, "already_present").otherwise("written")
    return ends.join(have, ["subject", "predicate", "object"], "left").withColumn("fate", fate)


def graph_bundle_changes(concepts: DataFrame, concept_edges: DataFrame, entities: DataFrame, edges: DataFrame, aliases: DataFrame, vocabulary: list[str]) -> dict[str, DataFrame]:
    """What a bundle would change: `entities` (canonical_name, entity_type) to create, `aliases` (alias, profile,
    canonical_name, entity_type) that are free, `edges` (subject, predicate, object) to write, and `counts` (what, n).

    Concepts are matched by name and type. An alias that two concepts want goes to the one of smallest name. Nothing is written
    here: a dry run looks at the counts, another appends the tables. concepts: path, canonical_name, entity_type, profile,
    aliases (array); aliases: alias, profile.
    """
    named = concepts.select("canonical_name", "entity_type").distinct()
    created = named.join(entities.select("canonical_name", "entity_type"), ["canonical_name", "entity_type"], "left_anti")
    wanted = concepts.select("profile", "canonical_name", "entity_type", F.explode("aliases").alias("alias")).filter(F.length("alias") > 0)
    free = wanted.join(aliases.select("alias", "profile"), ["alias", "profile"], "left_anti").groupBy("alias", "profile").agg(F.min(F.struct("canonical_name", "entity_type")).alias("of"))
    free = free.select("alias", "profile", "of.canonical_name", "of.entity_type")
    judged = cut(_judged(concepts, concept_edges, edges, vocabulary))
    total = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    counts = judged.groupBy(F.col("fate").alias("what")).agg(F.count("*").alias("n")).unionByName(total(created, "created")).unionByName(total(named.join(entities, ["canonical_name", "entity_type"], "left_semi"), "matched")).unionByName(total(free, "aliases"))
    return {"entities": created, "aliases": free, "edges": judged.filter("fate = 'written'").select("subject", "predicate", "object").distinct(), "counts": counts}
