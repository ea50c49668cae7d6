"""Rules that look at one row, by relation: code -> when it is violated. See validation.py for those that compare rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.validation import MESSAGES, issue

_ODD = "({0} is null or isnan({0}) or abs({0}) = double('infinity'))"

# fixed values: the codes and what breaks them; relation: rules, its columns above each
RULES: dict[str, dict[str, str]] = {
    # scene_id, schema_version, revision
    "scene": {"INVALID_SCENE_HEADER": "coalesce(trim(scene_id), '') = '' or coalesce(schema_version, 0) < 1 or coalesce(trim(revision), '') = ''"},
    # unit, scale
    "units": {"UNDECLARED_UNITS": "unit is null", "INVALID_UNIT_SCALE": f"{_ODD.format('scale')} or scale <= 0"},
    # value double, is_number
    "values": {"NON_FINITE_PROPERTY": f"is_number and {_ODD.format('value')}"},
    # n_groups_end, n_indices, n_sources, n_triangles, max_source, n_table
    "surfaces": {
        "MATERIAL_GROUP_OUT_OF_RANGE": "n_groups_end > n_indices",
        "SOURCE_MAP_COUNT_MISMATCH": "n_sources is not null and n_sources <> n_triangles",
        "SOURCE_MAP_OUT_OF_RANGE": "max_source >= n_table",
    },
    # set_id, n_sets, row, n_rows, has_index, has_columns
    "bags": {
        "MISSING_PROPERTY_INDEX": "set_id is not null and not has_index",
        "MISSING_PROPERTY_COLUMNS": "row is not null and not has_columns",
        "PROPERTY_ROW_OUT_OF_RANGE": "has_columns and row is not null and (row < 0 or row >= n_rows)",
    },
    # owner of the representation, and the prototype that lists it
    "representations": {"REPRESENTATION_NOT_OWNED": "owner is distinct from prototype_id"},
    # a package's document: version, buffers and their bytes
    "packages": {
        "GLTF_VERSION": "coalesce(version, '') <> '2.0'",
        "BUFFER_COUNT": "buffers <> 1",
        "BUFFER_LENGTH": "declared_bytes <> actual_bytes",
    },
    "views": {"BUFFER_REFERENCE": "buffer is null or buffer < 0 or buffer >= buffers"},
    # view, views, count, components, component_bytes, byte_offset, view_bytes
    "accessors": {
        "ACCESSOR_BUFFER_VIEW": "view is null or view < 0 or view >= views",
        "ACCESSOR_SHAPE": "count < 1 or components not in (1, 2, 3, 4, 16)",
        "ACCESSOR_RANGE": "byte_offset + count * components * component_bytes > view_bytes",
    },
    # one primitive of a mesh
    "primitives": {
        "POSITION_ACCESSOR": "position is null or position < 0 or position >= accessors",
        "POSITION_BOUNDS": "not has_bounds",
        "INDEX_ACCESSOR": "indices is not null and (indices < 0 or indices >= accessors)",
        "PRIMITIVE_COUNT": "mode = 4 and n % 3 <> 0 or mode = 1 and n % 2 <> 0",
        "MATERIAL_REFERENCE": "material is not null and (material < 0 or material >= materials)",
    },
    "meshes": {"MESH_EMPTY": "primitives = 0"},
    # matrix, translation: arrays or null; mesh, coarse_mesh, meshes
    "nodes": {
        "NODE_MATRIX": "matrix is not null and (size(matrix) <> 16 or exists(matrix, v -> v is null or isnan(v) or abs(v) = double('infinity')))",
        "NODE_TRANSLATION": "translation is not null and (size(translation) <> 3 or exists(translation, v -> v is null or isnan(v) or abs(v) = double('infinity')))",
        "NODE_TRANSFORM": "matrix is not null and translation is not null",
        "NODE_MESH": "mesh is not null and (mesh < 0 or mesh >= meshes)",
        "NODE_COARSE_MESH": "coarse_mesh is not null and (coarse_mesh < 0 or coarse_mesh >= meshes)",
    },
    # child index of each node, number of nodes
    "links": {"NODE_CHILD": "child is null or child < 0 or child >= nodes"},
    # a registered data set
    "datasets": {
        "DATASET_KIND": "kind not in ('ifc', 'step', 'parquet')",
        "DATASET_REVISION": "not coalesce(revision rlike '^[0-9a-f]{40}$', false)",
        "DATASET_LICENCE": "licence is distinct from expected_licence",
    },
}


def check(relation: str, rows: DataFrame, key: str) -> DataFrame:
    """severity, code, path and message of every violation, in one pass over the rows."""
    told = lambda code: F.struct(F.lit(code).alias("code"), F.lit(MESSAGES[code]).alias("message"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(when), F.lit(False)), told(code)) for code, when in RULES[relation].items()]))
    return rows.select(F.col(key).cast("string").alias("path"), F.explode(found).alias("i")).select(F.lit("error").alias("severity"), "i.code", "path", "i.message")


def check_all(relations: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [check(name, rows, key) for name, (rows, key) in relations.items()])


def unreachable(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes that no root leads to."""
    return nodes.join(reached.select("node_id"), "node_id", "left_anti").select(*issue("NODE_REACHABILITY", F.col("node_id")))
