"""Snapshots: differences, components of documents, invalidation, reopening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.ranking import within
from girder.tables import cut, drop

SEVERITY = {"verified": 0, "unverifiable": 1, "changed": 2, "missing": 3}


def keyed_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and what happens to it: keep, replace, create or drop."""
    joined = before.select(key, F.col(value).alias("old"), F.lit(1).alias("was")).join(after.select(key, F.col(value).alias("new"), F.lit(1).alias("now")), key, "full_outer")
    return joined.select(key, F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "drop").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("replace").alias("action"))


def snapshot_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """kind, discipline, renamed_from (J07). Both sides are (discipline, digest, uri). What is left over after matching by
    discipline counts as a rename where its digest is left over exactly once on both sides."""
    p, c = (d.select("discipline", F.col("digest").alias(f"{n}_digest"), F.col("uri").alias(f"{n}_uri"), F.lit(1).alias(n)) for d, n in ((previous, "p"), (current, "c")))
    both = p.join(c, "discipline", "full_outer")
    same = both.where("p = 1 and c = 1")
    none = F.lit(None).cast("string")
    changed = same.where("p_digest <> c_digest").select(F.lit("changed").alias("kind"), "discipline", none.alias("renamed_from"))
    moved = same.where("p_digest = c_digest and not (p_uri <=> c_uri)").select(F.lit("renamed").alias("kind"), "discipline", F.col("discipline").alias("renamed_from"))
    gone, new = (both.where(w).select("discipline", F.col(d).alias("digest")) for w, d in (("c is null", "p_digest"), ("p is null", "c_digest")))
    once = lambda d: d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("discipline").alias("discipline")).where("n = 1").drop("n")
    renames = once(gone).withColumnRenamed("discipline", "renamed_from").join(once(new), "digest").select(F.lit("renamed").alias("kind"), "discipline", "renamed_from")
    added = new.join(renames, "discipline", "left_anti").select(F.lit("added").alias("kind"), "discipline", none.alias("renamed_from"))
    deleted = gone.join(renames.select(F.col("renamed_from").alias("discipline")), "discipline", "left_anti").select(F.lit("deleted").alias("kind"), "discipline", none.alias("renamed_from"))
    return changed.unionByName(moved).unionByName(renames).unionByName(added).unionByName(deleted)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of undirected edges(a, b) (G06): each round takes the least label around
    and then the label's own label, until a round changes nothing."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        closer = label.join(around, label.node == around.a).select("node", F.least("label", "near").alias("next"))
        jumped = closer.join(label.select(F.col("node").alias("next"), F.col("label").alias("further")), "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label"))
        after = cut(jumped, "labels")
        same = after.exceptAll(label).isEmpty()
        drop(label)
        if same:
            drop(both)
            return after.withColumnRenamed("label", "component")
        label = after


def invalidated(changed: DataFrame, reconciled: DataFrame, owns: DataFrame) -> DataFrame:
    """document, target: what the documents that share a component with a changed one own."""
    groups = components(reconciled).withColumnRenamed("node", "document")
    hit = changed.select("document").distinct()
    whole = groups.join(groups.join(hit, "document", "left_semi").select("component").distinct(), "component", "left_semi").select("document")
    return owns.join(hit.union(whole).distinct(), "document", "left_semi")


def reopened(expected: DataFrame, observed: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """key, status: verified, unverifiable (seen without a digest), changed or missing."""
    seen = observed.select(key, F.col(digest).alias("seen"), F.lit(1).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("seen").isNull(), "unverifiable").when(F.col("seen") == F.col(digest), "verified").otherwise("changed")
    return expected.join(seen, key, "left").select(key, status.alias("status"))


def worst(statuses: DataFrame, by: list[str]) -> DataFrame:
    """The worst status of each group."""
    rank = F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])
    name = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])
    return statuses.groupBy(*by).agg(F.max(rank[F.col("status")]).alias("r")).select(*by, name[F.col("r")].alias("status"))


def matched_sources(documents: DataFrame, sources: DataFrame, place: str = "document") -> DataFrame:
    """document, source: sources claim in order of discipline, then id. Each claims the first document, in order of `place`, of its
    discipline and digest that no source has claimed, or else the one document of its digest that is left, if exactly one is
    (J06). Digests that are null match nothing; a source or document without a match has no row.

    A digest's claims are settled by counts: until one of its documents is left only claims by discipline succeed, so the first
    source in order that has none and finds all but one claimed takes the last. Numbers are given by ranges, so no digest is one
    task's."""
    pair, known = ["discipline", "digest"], "digest is not null"
    first = within(documents.where(known), pair, list(dict.fromkeys([place, "document"])), "turn").select("document", *pair, "turn")
    exact = within(sources.where(known), pair, ["source"], "turn").join(first, [*pair, "turn"], "left").withColumn("own", F.col("document").isNotNull().cast("long"))
    ordered = within(exact, ["digest"], ["discipline", "source"], "claimed", value="own")  # claims by discipline before each source
    asked = cut(ordered.join(documents.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest"), "claims")
    taker = asked.where("own = 0 and claimed = n - 1").groupBy("digest").agg(F.min(F.struct("discipline", "source")).alias("f")).select("digest", F.col("f.source").alias("taker"))
    kept = asked.join(taker, "digest", "left").where("own = 1 and (taker is null or claimed < n - 1)").select("document", "source")
    rest = documents.join(taker, "digest").join(kept, "document", "left_anti").select("document", F.col("taker").alias("source"))
    return kept.unionByName(rest)
