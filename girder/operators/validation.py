"""Rules of the scene model: each is a query of violations (severity, code, path, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.operators.ranking import dense_rank_all
from girder.tables import cut

# fixed values: the codes; the messages are our own
MESSAGES = {
    "ACCESSOR_BUFFER_VIEW": "an accessor names no view", "ACCESSOR_RANGE": "an accessor leaves its view", "ACCESSOR_SHAPE": "an accessor has no elements or an odd number of components",
    "ATTRIBUTE_COUNT_MISMATCH": "an attribute has another count than the positions", "BUFFER_ALIGNMENT": "a view is not aligned to four bytes", "BUFFER_COUNT": "a package has one buffer",
    "BUFFER_LENGTH": "the buffer is not as long as declared", "BUFFER_RANGE": "a view leaves its buffer", "BUFFER_REFERENCE": "a view names no buffer",
    "DATASET_KIND": "an unknown kind of data set", "DATASET_LICENCE": "the licence is not the registered one", "DATASET_REVISION": "the revision is not a commit",
    "DUPLICATE_ID": "the id is declared more than once", "DUPLICATE_PROPERTY_KEY": "the key is declared more than once", "EMPTY_ID": "the id is empty", "EMPTY_PROPERTY_KEY": "the key is empty",
    "GLTF_VERSION": "the document has another version", "INDEX_ACCESSOR": "a primitive's indices name no accessor", "INDEX_OUT_OF_RANGE": "an index names no vertex",
    "INVALID_EDGE_LAYOUT": "edges have two indices each", "INVALID_POSITION_COUNT": "positions have three numbers each", "INVALID_SCENE_HEADER": "the scene's id, version or revision is missing",
    "INVALID_TRANSFORM": "a transform has sixteen finite numbers", "INVALID_TRIANGLE_COUNT": "triangles have three indices each", "INVALID_UNIT_SCALE": "the scale to metres is positive and finite",
    "INVERTED_BOUNDS": "a least corner exceeds the greatest", "MATERIAL_GROUP_OUT_OF_RANGE": "a material group leaves the indices", "MATERIAL_REFERENCE": "a primitive names no material",
    "MESH_EMPTY": "a mesh has no primitive", "MISSING_PROPERTY_COLUMNS": "a row of values has no columns to stand in", "MISSING_PROPERTY_INDEX": "a key set has no index to stand in",
    "MISSING_REFERENCE": "the reference names nothing", "NODE_CHILD": "a child is no node", "NODE_COARSE_MESH": "a coarse mesh is no mesh", "NODE_CYCLE": "the nodes run in a circle",
    "NODE_MATRIX": "a matrix has sixteen finite numbers", "NODE_MESH": "a node's mesh is no mesh", "NODE_PARENT": "a node has several parents", "NODE_REACHABILITY": "no root leads to the node",
    "NODE_TRANSFORM": "a node has a matrix and a translation", "NODE_TRANSLATION": "a translation has three finite numbers", "NON_FINITE_BOUNDS": "a bound is not finite",
    "NON_FINITE_PROPERTY": "a number is not finite", "OCCURRENCE_CYCLE": "the occurrences run in a circle", "POSITION_ACCESSOR": "a primitive's positions name no accessor", "POSITION_BOUNDS": "positions have bounds",
    "PRIMITIVE_COUNT": "a primitive's indices fill no whole shapes", "PROPERTY_KEY_OUT_OF_RANGE": "a set names no key", "PROPERTY_ROW_OUT_OF_RANGE": "the row is not among the columns' rows",
    "PROPERTY_SET_NOT_ASCENDING": "a set's keys do not ascend", "PROPERTY_SET_OUT_OF_RANGE": "the bag names no set", "PROPERTY_VALUE_ARITY": "a row has another number of values than its set has keys",
    "REPRESENTATION_NOT_OWNED": "a representation is another prototype's", "SEQUENCE_GAP": "the numbers do not count up by one", "SOURCE_MAP_COUNT_MISMATCH": "sources and elements differ in number",
    "SOURCE_MAP_OUT_OF_RANGE": "a source is not in the table", "UNDECLARED_UNITS": "no unit is declared", "UNKNOWN_EDGE_CLASS": "an edge's class is unknown",
}


def issue(code: str, path: Column, severity: str = "error") -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.cast("string").alias("path"), F.lit(MESSAGES[code]).alias("message")]


def not_finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def missing_reference(rows: DataFrame, column: str, target: DataFrame, key: str, path: Column) -> DataFrame:
    """Rows whose reference is not null and names nothing."""
    known = target.select(F.col(key).alias("known")).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("known"), "left_anti").select(*issue("MISSING_REFERENCE", path))


def duplicate_ids(ids: DataFrame, column: str) -> DataFrame:
    """Each id that is declared more than once, over all relations together."""
    return ids.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*issue("DUPLICATE_ID", F.col(column)))


def repeated_declarations(relations: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """Each declaration of an id that an earlier one has, over relations(name, rows, id column, order) in the given order: the first
    wins, the others name both places, as `name[place].id` with places from 0 in the relation's order. Null ids declare nothing."""
    numbered = []
    for turn, (name, rows, column, order) in enumerate(relations):
        by = [f"o{i}" for i in range(len(order))]
        placed = dense_rank_all(rows.select(F.col(column).alias("id"), *[F.col(c).alias(b) for c, b in zip(order, by)]), by, "place")
        numbered.append(placed.select(F.lit(turn).alias("turn"), "place", "id", F.concat(F.lit(f"{name}["), F.col("place").cast("string"), F.lit("].id")).alias("path")))
    told = cut(reduce(DataFrame.union, numbered).where("id IS NOT NULL"), "declarations")
    # a row for each id that is declared again, however often
    first = told.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "place", "path")).alias("f")).where("n > 1").select(F.col("id").alias("known"), F.col("f.path").alias("first"))
    again = told.join(first, F.col("id") == F.col("known")).where("path <> first")
    severity, code, path, _ = issue("DUPLICATE_ID", F.col("path"))
    return again.select(severity, code, path, F.concat(F.lit("the id "), "id", F.lit(" is declared already at "), "first").alias("message"))


def empty_ids(rows: DataFrame, column: str, path: Column) -> DataFrame:
    return rows.where(F.coalesce(F.trim(F.col(column)), F.lit("")) == "").select(*issue("EMPTY_ID", path))


def bounds(boxes: DataFrame, key: str) -> DataFrame:
    """Bounds that are not finite, or whose least corner exceeds the greatest."""
    odd = reduce(lambda a, b: a | b, [not_finite(f"{s}_{a}") for s in ("min", "max") for a in "xyz"])
    turned = reduce(lambda a, b: a | b, [F.col(f"min_{a}") > F.col(f"max_{a}") for a in "xyz"])
    return boxes.where(odd).select(*issue("NON_FINITE_BOUNDS", F.col(key))).unionByName(boxes.where(~odd & turned).select(*issue("INVERTED_BOUNDS", F.col(key))))


def transforms(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Matrices that are not sixteen finite numbers."""
    odd = (F.size(column) != 16) | F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.coalesce(odd, F.lit(True))).select(*issue("INVALID_TRANSFORM", F.col(key)))


def property_keys(keys: DataFrame) -> DataFrame:
    """keys(key_id, key): empty ones, and those declared again."""
    again = F.row_number().over(Window.partitionBy("key").orderBy("key_id")) > 1
    return keys.where(F.trim("key") == "").select(*issue("EMPTY_PROPERTY_KEY", F.col("key_id"))).unionByName(keys.withColumn("again", again).where("again").select(*issue("DUPLICATE_PROPERTY_KEY", F.col("key_id"))))


def property_sets(sets: DataFrame, key_count: int) -> DataFrame:
    """sets(set_id, key_ids): indexes out of range, and sets that do not ascend strictly."""
    outside = sets.where(F.exists("key_ids", lambda k: (k < 0) | (k >= key_count))).select(*issue("PROPERTY_KEY_OUT_OF_RANGE", F.col("set_id")))
    pairs = F.arrays_zip(F.slice("key_ids", F.lit(1), F.greatest(F.size("key_ids") - 1, F.lit(0))).alias("a"), F.slice("key_ids", F.lit(2), F.greatest(F.size("key_ids") - 1, F.lit(0))).alias("b"))
    return outside.unionByName(sets.where(F.exists(pairs, lambda p: p["a"] >= p["b"])).select(*issue("PROPERTY_SET_NOT_ASCENDING", F.col("set_id"))))


def property_rows(bags: DataFrame, sets: DataFrame) -> DataFrame:
    """bags(bag_id, set_id, n_values): unknown sets, and rows with another number of values than their set has keys."""
    joined = bags.join(sets.select("set_id", F.size("key_ids").alias("n_keys")), "set_id", "left")
    return joined.where("n_keys is null").select(*issue("PROPERTY_SET_OUT_OF_RANGE", F.col("bag_id"))).unionByName(joined.where("n_keys <> n_values").select(*issue("PROPERTY_VALUE_ARITY", F.col("bag_id"))))


def meshes(rows: DataFrame) -> DataFrame:
    """rows(mesh_id, n_position_values, n_indices, max_index, n_normal_values): counts that do not fit together."""
    vertices = F.col("n_position_values") / 3
    rules: list[tuple[str, Column]] = [
        ("INVALID_POSITION_COUNT", F.col("n_position_values") % 3 != 0),
        ("INVALID_TRIANGLE_COUNT", F.col("n_indices") % 3 != 0),
        ("INDEX_OUT_OF_RANGE", F.col("max_index") >= vertices),
        ("ATTRIBUTE_COUNT_MISMATCH", F.col("n_normal_values") != F.col("n_position_values")),
    ]
    return reduce(DataFrame.unionByName, [rows.where(w).select(*issue(code, F.col("mesh_id"))) for code, w in rules])


def ranges(rows: DataFrame, total: int) -> DataFrame:
    """rows(view_id, byte_offset, byte_length): slices of a buffer that are misaligned or leave it."""
    return rows.where("byte_offset % 4 <> 0").select(*issue("BUFFER_ALIGNMENT", F.col("view_id"))).unionByName(rows.where((F.col("byte_offset") < 0) | (F.col("byte_offset") + F.col("byte_length") > total)).select(*issue("BUFFER_RANGE", F.col("view_id"))))


def gaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """Sequences that do not count up from 0 by one."""
    return df.withColumn("want", F.row_number().over(Window.partitionBy(by).orderBy(number)) - 1).where(F.col(number) != F.col("want")).select(*issue("SEQUENCE_GAP", F.concat_ws(":", by, number)))


def report(issues: DataFrame) -> DataFrame:
    """code, issues of each severity."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("code").agg(of("error").alias("errors"), of("warning").alias("warnings"))


def ok(issues: DataFrame) -> bool:
    return issues.where("severity = 'error'").isEmpty()

