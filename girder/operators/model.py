"""Scenes, packages and workspaces as relations: the joins between their parts, and what is reported of them.

Null keys join nothing unless said otherwise; rows that repeat count once where a set is asked for, and each elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.operators.ranking import dense_rank_all, within

# ---- prototypes and representations --------------------------------------------------------------------------


def renderable(occurrences: DataFrame, geometry: DataFrame) -> DataFrame:
    """Occurrences whose prototype has geometry (P08). geometry(prototype_id)."""
    return occurrences.join(geometry.select("prototype_id").distinct(), "prototype_id", "left_semi")


def display_representation(prototypes: DataFrame, representations: DataFrame) -> DataFrame:
    """prototype_id, representation_id and problem (P09): the one representation a prototype lists for display; none is null,
    several are a problem. prototypes(prototype_id, representation_ids), representations(representation_id, purpose)."""
    shown = representations.where("purpose = 'display'").select("representation_id")
    listed = prototypes.select("prototype_id", F.explode(F.array_distinct("representation_ids")).alias("representation_id")).join(shown, "representation_id")
    found = listed.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n"), F.min("representation_id").alias("one"))
    picked = prototypes.select("prototype_id").join(found, "prototype_id", "left")
    return picked.select("prototype_id", F.when(F.col("n") == 1, F.col("one")).alias("representation_id"), F.when(F.col("n") > 1, "several").alias("problem"))


def derivation_rules(occurrences: DataFrame) -> DataFrame:
    """document_id and how its occurrences' semantic_id and source_ref follow from other ids (A17): by the rule that most of them
    keep, the first listed of equals, or null where none keeps any. occurrences(document_id, occurrence_id, prototype_id,
    semantic_id, source_ref)."""
    from_semantic = F.col("source_ref") == F.concat(F.lit("source:"), F.regexp_replace("semantic_id", "^semantic:", ""))
    from_occurrence = F.col("source_ref") == F.concat(F.lit("source:"), F.regexp_replace("occurrence_id", "^semantic:", ""))
    counted = occurrences.groupBy("document_id").agg(
        F.count_if(F.col("semantic_id") == F.concat(F.lit("semantic:"), "prototype_id")).alias("p"), F.count_if(from_semantic).alias("s"), F.count_if(from_occurrence).alias("o")
    )
    source = F.when(F.greatest("s", "o") == 0, None).when(F.col("o") > F.col("s"), "occurrenceId").otherwise("semanticId")
    return counted.select("document_id", F.when(F.col("p") > 0, "prototypeId").alias("semantic_rule"), source.alias("source_rule"))


# ---- relations and documents ---------------------------------------------------------------------------------


def semantic_relations(links: DataFrame, semantics: DataFrame) -> DataFrame:
    """entity_id, position, type, target (J20): each relation once, ordered by type and target entity; a target outside the scene
    is dropped. links(entity_id, type, target_id), semantics(entity_id, semantic_id)."""
    targets = semantics.select(F.col("entity_id").alias("target_id"), F.col("semantic_id").alias("target"))
    kept = links.where("type in ('typed-by', 'member-of')").select("entity_id", "type", "target_id").distinct().join(targets, "target_id")
    position = F.row_number().over(Window.partitionBy("entity_id").orderBy("type", "target_id")) - 1
    return kept.select("entity_id", position.alias("position"), "type", "target")


def assembly_tree(aggregated: DataFrame, contained: DataFrame) -> DataFrame:
    """node, index and parent_index (J25): nodes are numbered in id order; of several relations that place a node the last one
    holds, containment coming after aggregation. Both are (turn, parent, child)."""
    both = aggregated.select(F.lit(0).alias("kind"), "turn", "parent", "child").unionByName(contained.select(F.lit(1).alias("kind"), "turn", "parent", "child")).where("parent is not null")
    placed = both.where("child is not null").groupBy("child").agg(F.max_by("parent", F.struct("kind", "turn", "parent")).alias("parent"))
    nodes = both.select(F.col("parent").alias("node")).union(both.select("child")).where("node is not null").distinct()
    numbered = dense_rank_all(nodes, ["node"], "index")
    up = numbered.select(F.col("node").alias("parent"), F.col("index").alias("parent_index"))
    return numbered.join(placed, F.col("node") == F.col("child"), "left").join(up, "parent", "left").select("node", "index", "parent_index")


def occurrence_documents(occurrences: DataFrame, sources: DataFrame, semantics: DataFrame, prototypes: DataFrame) -> DataFrame:
    """occurrence_id, document (J14): by its own source_ref, else by its semantic_id, else every document of its prototype.
    sources(source_ref, document), semantics(semantic_id, document), prototypes(prototype_id, document)."""
    own = occurrences.join(sources.withColumnRenamed("document", "by_source"), "source_ref", "left").join(semantics.withColumnRenamed("document", "by_semantic"), "semantic_id", "left")
    known = own.withColumn("document", F.coalesce("by_source", "by_semantic"))
    rest = known.where("document is null").drop("document").join(prototypes, "prototype_id")
    return known.where("document is not null").select("occurrence_id", "document").unionByName(rest.select("occurrence_id", "document"))


def merged_hierarchy(document: DataFrame, sidecar: DataFrame, nodes: int) -> DataFrame:
    """position, node_index and problem (J05): the sidecar's entries in order; relocated ones get numbers from `nodes` on; an
    entry that names no node of the document, or one named before, is a problem, and so is a node that no entry names.
    document(node_index), sidecar(position, node_index; null where relocated)."""
    moved = dense_rank_all(sidecar.where("node_index is null").select("position"), ["position"], "turn")
    moved = moved.select("position", (F.col("turn") + nodes).alias("node_index"), F.lit(None).cast("string").alias("problem"))
    turn = F.row_number().over(Window.partitionBy("node_index").orderBy("position"))
    named = sidecar.where("node_index is not null").withColumn("turn", turn).join(document.select(F.col("node_index").alias("known")).distinct(), F.col("node_index") == F.col("known"), "full_outer")
    problem = F.when(F.col("known").isNull(), "unknown-node").when(F.col("node_index").isNull(), "left-out").when(F.col("turn") > 1, "named-twice")
    return moved.unionByName(named.select("position", F.coalesce("node_index", "known").alias("node_index"), problem.alias("problem")))


def coverage(sources: DataFrame, reported: DataFrame) -> DataFrame:
    """source, status (J11): whether a report covers each source exactly once, as a hit or as a miss; what it names beside them is
    unknown. sources(source), reported(source, hit)."""
    seen = reported.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.bool_or("hit").alias("hit"))
    both = sources.select("source", F.lit(1).alias("own")).distinct().join(seen, "source", "full_outer")
    return both.select("source", F.when(F.col("own").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("hit"), "hit").otherwise("miss").alias("status"))


def retained(ids: DataFrame, known: DataFrame) -> DataFrame:
    """id, status (J10): which ids of a saved view a scene still has. Both are (id)."""
    seen = known.select("id", F.lit(1).alias("there")).distinct()
    return ids.select("id").join(seen, "id", "left").select("id", F.when(F.col("there") == 1, "retained").otherwise("dropped").alias("status"))


def captured(objects: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(object_id, occurrence_id) of the objects that are mapped, and the object_ids that are not."""
    both = objects.select("object_id").distinct().join(mapping.select("object_id", "occurrence_id"), "object_id", "left")
    return both.where("occurrence_id is not null"), both.where("occurrence_id is null").select("object_id")


def labelled_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """key, digest and reason (J23): the selected file of a source's label. A label that two sources have, that no file has or that
    several files have is refused with a reason. sources(key, label), files(label, digest)."""
    named = sources.join(sources.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("sources")), F.col("label").eqNullSafe(F.col("l"))).drop("l")
    found = files.groupBy("label").agg(F.count(F.lit(1)).alias("files"), F.min("digest").alias("digest"))
    reason = F.when(F.col("sources") > 1, "label-not-unique").when(F.col("files").isNull(), "no-file").when(F.col("files") > 1, "several-files")
    both = named.join(found, "label", "left").withColumn("reason", reason)
    return both.select("key", F.when(F.col("reason").isNull(), F.col("digest")).alias("digest"), "reason")


def assigned_keys(sources: DataFrame) -> DataFrame:
    """position and key (W15): the preferred key; where several sources prefer it, with the label behind; where that is taken by an
    earlier one, with the position too. sources(position from 0, preferred, label)."""
    # counts and first positions are sums by key, so that no key's sources are gathered
    counts = sources.groupBy(F.col("preferred").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    wanted = sources.join(counts, F.col("preferred").eqNullSafe(F.col("p"))).withColumn("own", F.when(F.col("n") > 1, F.concat_ws(":", "preferred", "label")).otherwise(F.col("preferred")))
    firsts = wanted.groupBy(F.col("own").alias("o")).agg(F.min("position").alias("first"))
    again = F.col("position") > F.col("first")
    return wanted.join(firsts, F.col("own").eqNullSafe(F.col("o"))).select("position", F.when(again, F.concat_ws("#", "own", F.col("position").cast("string"))).otherwise(F.col("own")).alias("key"))


# ---- demand, reports, timing ---------------------------------------------------------------------------------


def demanded_bytes(views: DataFrame, chunks: DataFrame) -> DataFrame:
    """view, bytes, missing (A34): the bytes of the chunks that a view's list names, each as often as it is named. A chunk without
    a length is an error: the least one is given and the sum is null. views(view, demand), chunks(chunk_id, byte_length)."""
    ids = views.select("view", F.explode_outer(F.filter(F.split(F.coalesce("demand", F.lit("")), ","), lambda c: c != "")).alias("chunk_id"))
    priced = ids.join(chunks.select("chunk_id", "byte_length"), "chunk_id", "left")
    missing = F.min(F.when(F.col("byte_length").isNull(), F.col("chunk_id")))
    return priced.groupBy("view").agg(F.when(missing.isNull(), F.coalesce(F.sum("byte_length"), F.lit(0))).alias("bytes"), missing.alias("missing"))


def packing_census(leaves: DataFrame, packed: DataFrame) -> DataFrame:
    """leaf, chunks, requested, useful and off_view bytes (J21): what a leaf's prototypes need, and what comes along as it shares
    their chunks. leaves(leaf, prototype_id), packed(prototype_id, chunk, byte_length)."""
    used = leaves.select("leaf", "prototype_id").distinct().join(packed, "prototype_id")
    size = packed.groupBy("chunk").agg(F.sum("byte_length").alias("chunk_bytes"))
    by_chunk = used.groupBy("leaf", "chunk").agg(F.sum("byte_length").alias("useful")).join(size, "chunk")
    summed = by_chunk.groupBy("leaf").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chunk_bytes").alias("requested"), F.sum("useful").alias("useful"))
    return summed.withColumn("off_view", F.col("requested") - F.col("useful"))


def scene_counts(occurrences: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of counts (A33): deepest level, occurrences, prototypes, prototypes used again and the occurrences they save, and
    diagnostics by severity. occurrences(prototype_id, depth), diagnostics(severity)."""
    per = occurrences.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    counts = per.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count(F.lit(1)).alias("prototypes"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("saved"))
    told = diagnostics.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "error")])
    return counts.crossJoin(told)  # a row each


def reuse_lists(occurrences: DataFrame) -> DataFrame:
    """prototype_id, occurrences, place and occurrence_id of prototypes that occur again (A33): a row for each place in a list, as a
    list may be as long as the table."""
    counts = occurrences.groupBy(F.col("prototype_id").alias("p")).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    again = occurrences.select("prototype_id", "occurrence_id").join(counts, F.col("prototype_id") == F.col("p")).drop("p")
    return within(again, ["prototype_id"], ["occurrence_id"], "place").select("prototype_id", "occurrences", "place", "occurrence_id")


def frame_durations(ticks: DataFrame, period_ns: float) -> DataFrame:
    """frame, ms (W13): end - begin in ticks of period_ns; reversed and incomplete pairs are skipped. ticks(frame, begin, end)."""
    return ticks.where("end >= begin").select("frame", ((F.col("end") - F.col("begin")) * (period_ns / 1_000_000)).alias("ms"))


def first_errors(issues: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """by, text (T03): the first n errors by code and path, a line each. Only n of a group are gathered."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("code", "path"))
    first = issues.where("severity = 'error'").withColumn("turn", turn).where(F.col("turn") <= n)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(" ", "code", "path").alias("line"))))
    return first.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def some_references(refs: Column, n: int = 3) -> Column:
    """The first n of an array, and how many there are beside them."""
    more = F.when(F.size(refs) > n, F.array(F.concat(F.lit("+ "), (F.size(refs) - n).cast("string"), F.lit(" more")))).otherwise(F.expr("array()").cast("array<string>"))
    return F.when(F.coalesce(F.size(refs), F.lit(0)) <= 0, F.array(F.lit("none"))).otherwise(F.concat(F.slice(refs, 1, n).cast("array<string>"), more))


def visibility_update(previous: DataFrame, instances: DataFrame, hidden: DataFrame, changed: DataFrame) -> DataFrame:
    """batch, visible and recomputed (ST07): a batch that was there and whose filter did not change keeps its count; only the
    others' instances are looked at. previous(batch, visible), instances(batch, object_id), hidden(object_id), changed(batch)."""
    kept = previous.join(changed.select("batch").distinct(), "batch", "left_anti")
    now = instances.select("batch").distinct()
    same = kept.join(now, "batch", "left_semi").select("batch", "visible", F.lit(False).alias("recomputed"))
    fresh = instances.join(kept.select("batch"), "batch", "left_anti").join(hidden.select("object_id", F.lit(1).alias("off")).distinct(), "object_id", "left")
    made = fresh.groupBy("batch").agg(F.count_if(F.col("off").isNull()).alias("visible")).select("batch", "visible", F.lit(True).alias("recomputed"))
    return same.unionByName(made)


def within_windows(points: DataFrame, at: str, windows: DataFrame, width: int) -> DataFrame:
    """points beside each window (a, b, both ends included) that holds their `at` (ST09, J24 in one dimension): windows are dealt
    to the slots of `width` that they touch, so it is an equal join and a point meets no window far from it."""
    slots = windows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    return points.withColumn("slot", F.floor(F.col(at) / width)).join(slots, "slot").where(F.col(at).between(F.col("a"), F.col("b"))).drop("slot")
