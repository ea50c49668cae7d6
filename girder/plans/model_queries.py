"""Queries of scene, package and workspace relations over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder import fixtures as fx
from girder.functions import scalars
from girder.operators import chunks, digests, geometry, hierarchy, model, rules, spatial, validation
from girder.operators.ranking import dense_rank_all
from girder.sources import columnar, documents, federation, part21, scene_json, stream_store
from girder.tables import load, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- exchange files ------------------------------------------------------------------------------------------

_IFC = ["nothing", "ISO-10303-21; FILE_SCHEMA(('IFC4X3_ADD2'));", " ISO-10303-21; file_schema ( ( 'X' , 'ifc2x3' ) );", "ISO-10303-21; FILE_SCHEMA(());", "ISO-10303-21; FILE_SCHEMA(('IFC5'));", "ISO-10303-21; FILE_SCHEMA(('IFC4'));"]
_STEP = ["ISO-10303-21; FILE_SCHEMA(('AP242_MANAGED_MODEL'));", "ISO-10303-21; FILE_SCHEMA(('X { 1 0 10303 214 }'));", "ISO-10303-21; FILE_SCHEMA(('CONFIG_CONTROL_DESIGN'));", "ISO-10303-21; FILE_SCHEMA(('Y','Z'));"]


def _heads(spark: SparkSession, d: str, heads: list[str], extension: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k, F.when(k % 5 == 0, ".txt").otherwise(extension))
    head = F.get(F.array(*map(F.lit, heads)), (k % len(heads)).cast("int"))
    return load(spark, d, "part").select(name.alias("name"), F.octet_length(head).cast("long").alias("byte_length"), F.sha2(head, 256).alias("sha256"), head.alias("head"))


def _heads_sql(heads: list[str], extension: str) -> str:
    each = ", ".join("'" + h.replace("'", "''") + "'" for h in heads)
    return f"h AS (SELECT 'f' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '{extension}' END AS name, p_partkey % 5 = 0 AS odd, p_partkey % {len(heads)} AS k, list_extract([{each}], (p_partkey % {len(heads)} + 1)::INT) AS head FROM part)"


@query(f"""WITH {_heads_sql(_IFC, '.IFC')} SELECT name, strlen(head) AS byte_length, sha256(head) AS sha256, CASE k WHEN 1 THEN 'IFC4X3' WHEN 2 THEN 'IFC2X3' WHEN 5 THEN 'IFC4' END AS schema,
  CASE WHEN odd THEN 'extension' WHEN k = 0 THEN 'magic' WHEN k = 3 THEN 'undeclared' WHEN k = 4 THEN 'schema' END AS problem FROM h""")
def ifc_headers(spark, d):  # S01
    return part21.inspected_ifc(_heads(spark, d, _IFC, ".IFC"))


@query(f"""WITH {_heads_sql(_STEP, '.step')} SELECT name, strlen(head) AS byte_length, sha256(head) AS sha256, ['AP242', 'AP214', 'AP203', 'UNKNOWN'][k + 1] AS schema,
  CASE WHEN odd THEN 'extension' WHEN k > 1 THEN 'schema' END AS problem FROM h""")
def step_headers(spark, d):  # S02, S03
    return part21.inspected_step(_heads(spark, d, _STEP, ".step"))


@query("""SELECT count(*) + 5 AS lines, count(*) FILTER (p_partkey % 9 <> 0) AS instances, max(p_partkey) FILTER (p_partkey % 9 <> 0) AS last_id, count(*) FILTER (p_partkey % 9 <> 0 AND p_partkey % 4 = 0) AS relations,
  0::BIGINT AS mapped_items, 0::BIGINT AS representation_maps, 0::BIGINT AS projects, 0::BIGINT AS sites, 0::BIGINT AS buildings, count(*) FILTER (p_partkey % 9 <> 0 AND p_partkey % 4 = 1) AS storeys, count(*) FILTER (p_partkey % 9 <> 0 AND p_partkey % 4 = 2) AS spaces,
  count(*) FILTER (p_partkey % 9 <> 0 AND p_partkey % 4 = 3) AS property_sets, 0::BIGINT AS single_value_properties, true AS enclosed FROM part""")
def entity_readiness(spark, d):  # S04
    k, part = F.col("p_partkey"), load(spark, d, "part")
    kind = F.get(F.array(*map(F.lit, ("IfcRelAggregates", "IFCBUILDINGSTOREY", "IfcSpace", "IFCPROPERTYSET"))), (k % 4).cast("int"))
    line = F.when(k % 9 == 0, F.concat(F.lit("not #"), k, F.lit("=X()"))).otherwise(F.concat(F.lit("#"), k, F.lit(" = ("), kind, F.lit("('')")))
    ends = spark.createDataFrame([(-3, " ISO-10303-21;"), (-2, "HEADER;"), (-1, "DATA;"), (1 << 60, "END-ISO-10303-21;"), ((1 << 60) + 1, "  ")], "place long, value string")
    return part21.readiness(part.select(k.alias("place"), line.alias("value")).unionByName(ends), "place")


@query("""SELECT 'suppliers' AS collection, row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_suppkey AS k, s_name AS name FROM supplier""")
def scene_document(spark, d):  # S06: one JSON document with the table as a top-level array
    supplier = load(spark, d, "supplier")
    row = F.to_json(F.struct("s_suppkey", "s_name"))
    rows = supplier.select(F.col("s_suppkey").alias("turn"), F.concat(row, F.lit(",")).alias("value"))
    ends = spark.range(2).select(F.when(F.col("id") == 0, -1).otherwise((1 << 62) + 1).alias("turn"), F.when(F.col("id") == 0, '{"suppliers":[').otherwise('null],"meta":{"a":"]"}}').alias("value"))
    path = shared_path(spark, "scene-json")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("turn").select("value").write.text(path)
    found = scene_json.read_scene(spark, scene_json.only_file(spark, path)).where("collection = 'suppliers' and record <> 'null'")
    return found.select("collection", "position", F.get_json_object("record", "$.s_suppkey").cast("long").alias("k"), F.get_json_object("record", "$.s_name").alias("name"))


@query("""SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS value_id, p_name AS value FROM part""")
def property_columns(spark, d):  # S12: heaps of a few thousand values with their offsets, read from a store of streams
    part = load(spark, d, "part").select(F.col("p_brand").alias("doc"), "p_partkey", "p_name")
    placed = dense_rank_all(part, ["doc", "p_partkey", "p_name"], "place")
    first = placed.groupBy("doc").agg(F.min("place").alias("first"))
    at = shared_path(spark, "properties")
    stream_store.write(columnar.heaps(placed.join(first, "doc").select("doc", (F.col("place") - F.col("first")).alias("value_id"), F.col("p_name").alias("value"))), at)
    back = stream_store.read(spark, at, "doc string, block long, heap binary, offsets array<int>")
    heap = back.select(F.struct("doc", "block").alias("doc"), "heap", "offsets")
    each = columnar.sliced(heap.select("doc", "heap"), heap.select("doc", "offsets"))
    return each.select("doc.doc", (F.col("doc.block") * columnar.BLOCK + F.col("value_id")).alias("value_id"), "value")


@query("""SELECT c_nationkey AS folder, sha256(string_agg(c_name || chr(10) || sha256(c_mktsegment) || chr(10), '' ORDER BY c_name)) AS digest FROM customer GROUP BY 1""")
def folder_fingerprints(spark, d):  # S25
    return digests.fingerprint(load(spark, d, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_name").alias("name"), F.sha2("c_mktsegment", 256).alias("d")), ["folder"])


@query("""SELECT 'error' AS severity, code, s_suppkey::VARCHAR AS path, message FROM (
  SELECT *, 'DATASET_KIND' AS code, 'an unknown kind of data set' AS message FROM supplier WHERE s_suppkey % 4 = 3 UNION ALL SELECT *, 'DATASET_REVISION', 'the revision is not a commit' FROM supplier WHERE s_suppkey % 6 = 0
  UNION ALL SELECT *, 'DATASET_LICENCE', 'the licence is not the registered one' FROM supplier WHERE s_suppkey % 5 = 0) UNION ALL SELECT 'error', 'DUPLICATE_ID', s_nationkey::VARCHAR, 'the id is declared more than once' FROM supplier GROUP BY s_nationkey HAVING count(*) > 1""")
def dataset_registry(spark, d):  # S26
    k, supplier = F.col("s_suppkey"), load(spark, d, "supplier")
    kind = F.get(F.array(*map(F.lit, ("ifc", "step", "parquet", "zip"))), (k % 4).cast("int"))
    data = supplier.select(k, kind.alias("kind"), F.substring(F.sha2(k.cast("string"), 256), 1, F.when(k % 6 == 0, 39).otherwise(40)).alias("revision"), F.when(k % 10 != 0, F.when(k % 5 == 0, "other").otherwise("open")).alias("licence"), F.lit("open").alias("expected_licence"))
    return rules.check("datasets", data, "s_suppkey").unionByName(validation.duplicate_ids(supplier, "s_nationkey"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN url END AS member FROM pages""")
def json_members(spark, d):  # S27
    p, k = load(spark, d, "pages"), F.col("page_id")
    text = F.when(k % 3 == 0, F.to_json(F.struct("url", F.struct("url").alias("other"), F.col("html").alias("wanted")))).when(k % 3 == 1, F.to_json(F.struct(F.col("url").alias("wanted"), "html"))).otherwise(F.to_json(F.struct("html")))
    return p.select("page_id", documents.member(text, "wanted").alias("member"))


# ---- sinks ---------------------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def package_report(spark, d):  # K01
    return documents.write_package({t: load(spark, d, t) for t in ("supplier", "nation", "orders")}, shared_path(spark, "package")).select("name", "rows")


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"' || CASE WHEN event_id % 3 <> 0 THEN ',"user_id":' || user_id ELSE '' END || '}' AS value FROM events""")
def event_lines(spark, d):  # K02, K09
    path = shared_path(spark, "event-lines")
    documents.write_lines(load(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id")), path)
    return spark.read.text(path)


@query("""SELECT p_brand, p_partkey, coalesce(sum((p_size + 3) // 4 * 4) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM part""")
def binary_layout(spark, d):  # K04
    return chunks.offsets(load(spark, d, "part"), "p_brand", "p_partkey", "p_size").select("p_brand", "p_partkey", "byte_offset")


@query("SELECT * FROM (VALUES (1, 'created'), (2, 'same'), (3, 'conflict')) t(turn, outcome)")
def publishing(spark, d):  # K05
    path, df = shared_path(spark, "published"), load(spark, d, "customer")
    outcomes = [digests.publish(x, path, F.concat_ws(":", *df.columns)) for x in (df, df)]
    try:
        digests.publish(df.where("c_custkey > 1"), path, F.concat_ws(":", *df.columns))
    except ValueError:
        outcomes.append("conflict")
    return spark.createDataFrame(list(enumerate(outcomes, 1)), "turn int, outcome string")


@query("SELECT o_custkey::VARCHAR AS document_id, count(*) AS entries FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 10 = 0)")
def staged_documents(spark, d):  # K06, ST06
    path = shared_path(spark, "staged")
    rows = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), "o_orderkey", (F.col("o_orderkey") % 10 == 0).alias("last"))
    rows.write.parquet(f"{path}/in")
    federation.staged(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out/index").groupBy("document_id").agg(F.sum("entries").alias("entries"))


@query("""SELECT s_suppkey, '{"version":1' || CASE WHEN s_suppkey % 2 = 0 THEN ',"name":"' || s_name || '"' ELSE '' END || ',"hidden":["a","b"]' || CASE WHEN s_suppkey % 3 = 0 THEN ',"isolated":"x"' ELSE '' END || '}' AS text FROM supplier""")
def canonical_workspaces(spark, d):  # K08: the order of keys and of hidden ids does not matter
    k = F.col("s_suppkey")
    name, alone = F.when(k % 2 == 0, F.concat(F.lit('"name":"'), "s_name", F.lit('",'))).otherwise(""), F.when(k % 3 == 0, '"isolated":"x",').otherwise("")
    text = F.concat(F.lit("{"), alone, F.when(k % 5 == 0, '"hidden":["a","b"],').otherwise('"hidden":["b","a"],'), name, F.lit('"version":1}'))
    return scene_json.parsed_manifests(load(spark, d, "supplier").select(k, text.alias("t")), "t").select("s_suppkey", scene_json.canonical(F.col("manifest")).alias("text"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_extendedprice::FLOAT::DOUBLE AS high, (l_extendedprice - l_extendedprice::FLOAT::DOUBLE)::FLOAT::DOUBLE AS low FROM lineitem""")
def split_precision(spark, d):  # K10
    high, low = scalars.high_low(F.col("l_extendedprice"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", high.cast("double").alias("high"), low.cast("double").alias("low"))


# ---- projections ---------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 20 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' WHEN 3 THEN '0.0' ELSE round(value, 9)::VARCHAR END AS text FROM events""")
def property_numbers(spark, d):  # P04
    k = F.col("event_id") % 20
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, F.lit(-0.0)).otherwise(F.col("value"))
    return load(spark, d, "events").select("event_id", scalars.rounded(x).alias("text"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [n_regionkey + 3, n_regionkey + 1, n_regionkey + 2] WHEN 1 THEN [n_regionkey + 1, n_regionkey + 2, n_regionkey + 3] ELSE [n_regionkey + 1, n_regionkey + 3, -n_regionkey - 2] END::VARCHAR AS point FROM nation""")
def up_axes(spark, d):  # P07: the point (1, 2, 3), moved along, in each basis
    k = F.col("n_nationkey") % 3
    basis = geometry.up_axis_basis(F.when(k == 0, "X").when(k == 1, "Y").otherwise("Z"))
    point = [F.col("n_regionkey") + i for i in (1, 2, 3)]
    rows = load(spark, d, "nation").withColumn("m", basis)
    moved = [sum((F.element_at("m", c * 4 + r + 1) * point[c] for c in (1, 2)), F.element_at("m", r + 1) * point[0]) for r in range(3)]
    return rows.select("n_nationkey", F.concat(F.lit("["), F.concat_ws(", ", *[m.cast("int") for m in moved]), F.lit("]")).alias("point"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 4 = 0 THEN 'identity' WHEN p_partkey % 4 = 1 THEN 'translation' ELSE 'matrix' END AS kind, p_partkey % 7 = 0 AS replaced FROM part""")
def node_transforms(spark, d):  # P17, P21
    k = F.col("p_partkey")
    cell = lambda i: F.lit(1.0) if i in (0, 5, 15) else F.when(k % 7 == 0, float("nan")).otherwise(F.when(k % 4 == 2, 2.0).when(k % 4 == 3, float("-1")).otherwise(1.0)) if i == 10 else F.when(k % 4 == 1, k.cast("double")).otherwise(0.0) if i == 13 else F.lit(0.0)
    rows = load(spark, d, "part").select("p_partkey", F.array(*[cell(i) for i in range(16)]).alias("m")).withColumn("kept", scalars.finite_matrix(F.col("m")))
    return rows.select("p_partkey", scalars.transform_kind(F.col("kept")).alias("kind"), F.exists("m", F.isnan).alias("replaced"))


@query(r"""SELECT p_partkey, replace(CASE p_partkey % 6 WHEN 0 THEN 'cannot read <path>, N' WHEN 1 THEN 'at <path>; N' WHEN 2 THEN 'run <path> "x" N' WHEN 3 THEN 'job <path>/x N' WHEN 4 THEN 'one /segment N and a/b/c' ELSE 'job <path> and <path>.' END, 'N', p_name) AS text FROM part""")
def redacted_messages(spark, d):  # P18
    texts = ["cannot read /home/u@x/a.b/c+d, N", r"at C:\a\b(1; N", r'run \\host\share\f "x" N', "job /known/of/job/x N", "one /segment N and a/b/c", r"job C:\known here and C:/known here."]
    text = F.replace(F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 6).cast("int")), F.lit("N"), F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", scalars.redacted(text, ["/known/of/job", r"C:\known here"]).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_size || ' mm' WHEN 2 THEN p_brand WHEN 3 THEN p_size || ', ' || p_name || ', 2 m' WHEN 4 THEN 'null' ELSE '1, ' || p_brand || ', 3' END AS text FROM part""")
def property_display(spark, d):  # P20
    k, part = F.col("p_partkey") % 6, load(spark, d, "part")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    value = (
        F.when(k == 0, quoted("p_name")).when(k == 1, cat('{"type":"quantity","unit":"mm","value":', F.col("p_size"), "}")).when(k == 2, cat('{"type":"enum","value":', quoted("p_brand"), "}"))
        .when(k == 3, cat('{"type":"array","values":[', F.col("p_size"), ",", quoted("p_name"), ',{"type":"quantity","value":2,"unit":"m"}]}')).when(k == 4, "null")
        .otherwise(cat('{"type":"array","values":[1,{"type":"array","values":[', quoted("p_brand"), ',3]}]}'))
    )
    return part.select("p_partkey", geometry.display(value).alias("text"))


@query("""SELECT p_partkey, sha256(string_agg(label || chr(31) || kind || chr(31) || coalesce(sha256(content), 'absent'), chr(30) ORDER BY label)) AS digest FROM (
  SELECT p_partkey, 'positions' AS label, 'f64' AS kind, p_name AS content FROM part UNION ALL SELECT p_partkey, 'indices', 'u32', CASE WHEN p_partkey % 3 <> 0 THEN p_brand END FROM part) GROUP BY 1""")
def representation_digests(spark, d):  # A32
    part = load(spark, d, "part").withColumnRenamed("p_partkey", "representation_id")
    one = part.select("representation_id", F.lit("positions").alias("label"), F.lit("f64").alias("kind"), F.col("p_name").alias("content"))
    two = part.select("representation_id", F.lit("indices").alias("label"), F.lit("u32").alias("kind"), F.when(F.col("representation_id") % 3 != 0, F.col("p_brand")).alias("content"))
    return geometry.representation_digest(one.unionByName(two)).withColumnRenamed("representation_id", "p_partkey")


@query(f"WITH {fx.PROTOTYPES_SQL}, {fx.OCCURRENCES_SQL} SELECT occurrence_id FROM occ WHERE prototype_id IN (SELECT prototype_id FROM proto WHERE triangles > 240)")
def renderable_occurrences(spark, d):  # P08
    return model.renderable(fx.occurrences(spark, d), fx.prototypes(spark, d).where("triangles > 240")).select("occurrence_id")


@query("""SELECT p_partkey AS prototype_id, CASE WHEN n = 1 THEN one END AS representation_id, CASE WHEN n > 1 THEN 'several' END AS problem FROM part LEFT JOIN (
  SELECT l_partkey, count(*) AS n, min(l_suppkey) AS one FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3) GROUP BY 1) ON l_partkey = p_partkey""")
def display_representations(spark, d):  # P09
    listed = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("representation_ids"))
    protos = load(spark, d, "part").select(F.col("p_partkey").alias("prototype_id")).join(listed.withColumnRenamed("l_partkey", "prototype_id"), "prototype_id", "left")
    shown = load(spark, d, "supplier").select(F.col("s_suppkey").alias("representation_id"), F.when(F.col("s_nationkey") == 3, "display").otherwise("analysis").alias("purpose"))
    return model.display_representation(protos, shown)


# ---- joins ---------------------------------------------------------------------------------------------------


@query("""SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY type, t) - 1 AS position, type, target FROM (
  SELECT DISTINCT l_orderkey AS entity_id, CASE l_returnflag WHEN 'R' THEN 'typed-by' ELSE 'member-of' END AS type, l_suppkey AS t, 'semantic:' || s_name AS target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('R', 'A') AND s_acctbal > 0)""")
def semantic_relations(spark, d):  # J20
    kind = F.when(F.col("l_returnflag") == "R", "typed-by").when(F.col("l_returnflag") == "A", "member-of").otherwise("other")
    links = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), kind.alias("type"), F.col("l_suppkey").alias("target_id"))
    known = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("semantic:"), "s_name").alias("semantic_id"))
    return model.semantic_relations(links, known).withColumn("position", F.col("position").cast("long"))


@query("""WITH both_ AS (SELECT 0 AS kind, o_orderkey AS turn, 'c' || o_custkey AS parent, 'x' || o_orderkey % 5000 AS child FROM orders UNION ALL SELECT 1, l_orderkey * 10 + l_linenumber, 's' || l_suppkey, 'x' || l_orderkey % 4000 FROM lineitem),
placed AS (SELECT child, parent FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY kind DESC, turn DESC, parent DESC) AS r FROM both_) WHERE r = 1),
nodes AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS index FROM (SELECT parent AS node FROM both_ UNION SELECT child FROM both_))
SELECT n.node, n.index, p.index AS parent_index FROM nodes n LEFT JOIN placed ON child = n.node LEFT JOIN nodes p ON p.node = parent""")
def assembly_tree(spark, d):  # J25
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    one = load(spark, d, "orders").select(F.col("o_orderkey").alias("turn"), text("c", F.col("o_custkey")).alias("parent"), text("x", F.col("o_orderkey") % 5000).alias("child"))
    two = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("turn"), text("s", F.col("l_suppkey")).alias("parent"), text("x", F.col("l_orderkey") % 4000).alias("child"))
    return model.assembly_tree(one, two)


@query("""WITH o AS (SELECT o_orderkey, s_name AS by_source, n_name AS by_semantic, o_custkey FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey LEFT JOIN nation ON n_nationkey = o_orderkey % 50)
SELECT o_orderkey AS occurrence_id, coalesce(by_source, by_semantic) AS document FROM o WHERE coalesce(by_source, by_semantic) IS NOT NULL
UNION ALL SELECT o_orderkey, c_mktsegment FROM o JOIN customer ON c_custkey = o_custkey WHERE by_source IS NULL AND by_semantic IS NULL UNION ALL SELECT o_orderkey, c_name FROM o JOIN customer ON c_custkey = o_custkey WHERE by_source IS NULL AND by_semantic IS NULL""")
def occurrence_documents(spark, d):  # J14
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("occurrence_id"), F.col("o_orderkey").alias("source_ref"), (F.col("o_orderkey") % 50).alias("semantic_id"), F.col("o_custkey").alias("prototype_id"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("source_ref"), F.col("s_name").alias("document"))
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("semantic_id"), F.col("n_name").alias("document"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("prototype_id"), F.explode(F.array("c_mktsegment", "c_name")).alias("document"))
    return model.occurrence_documents(o, s, n, c)


@query("""WITH side AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS node_index FROM orders), doc AS (SELECT c_custkey AS known FROM customer WHERE c_acctbal > 0)
SELECT position, 9000000 + row_number() OVER (ORDER BY position) - 1 AS node_index, NULL AS problem FROM side WHERE node_index IS NULL
UNION ALL SELECT position, coalesce(node_index, known), CASE WHEN known IS NULL THEN 'unknown-node' WHEN node_index IS NULL THEN 'left-out' WHEN turn > 1 THEN 'named-twice' END
FROM (SELECT *, row_number() OVER (PARTITION BY node_index ORDER BY position) AS turn FROM side WHERE node_index IS NOT NULL) FULL JOIN doc ON known = node_index""")
def merged_hierarchy(spark, d):  # J05
    document = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node_index"))
    sidecar = load(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("node_index"))
    return model.merged_hierarchy(document, sidecar, 9_000_000)


@query("""SELECT coalesce(c_custkey, o_custkey) AS source, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN hit THEN 'hit' ELSE 'miss' END AS status
FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'F') AS hit FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) ON c_custkey = o_custkey""")
def report_coverage(spark, d):  # J11
    sources = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("source"))
    return model.coverage(sources, load(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("source"), (F.col("o_orderstatus") == "F").alias("hit")))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'retained' ELSE 'dropped' END AS status, o_custkey AS k FROM orders")
def retained_ids(spark, d):  # J10
    orders, known = load(spark, d, "orders"), load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    status = model.retained(orders.select(F.col("o_custkey").alias("id")).distinct(), known).withColumnRenamed("id", "o_custkey")
    return orders.join(status, "o_custkey").select(F.col("o_orderkey").alias("id"), "status", F.col("o_custkey").alias("k"))


@query("""SELECT DISTINCT l_partkey AS object_id, p_name AS occurrence_id FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON p_partkey = l_partkey""")
def captured_objects(spark, d):  # J26
    mapping = load(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("occurrence_id"))
    mapped, rest = model.captured(load(spark, d, "lineitem").select(F.col("l_partkey").alias("object_id")), mapping)
    return mapped.unionByName(rest.withColumn("occurrence_id", F.lit(None).cast("string")))


@query("""SELECT s_suppkey AS key, CASE WHEN sources = 1 AND files = 1 THEN digest END AS digest, CASE WHEN sources > 1 THEN 'label-not-unique' WHEN files IS NULL THEN 'no-file' WHEN files > 1 THEN 'several-files' END AS reason
FROM (SELECT s_suppkey, s_suppkey - s_suppkey % 5 // 4 AS label, count(*) OVER (PARTITION BY s_suppkey - s_suppkey % 5 // 4) AS sources FROM supplier)
LEFT JOIN (SELECT p_partkey % 1500 AS label, count(*) AS files, min(p_name) AS digest FROM part WHERE p_size < 25 GROUP BY 1) USING (label)""")
def labelled_files(spark, d):  # J23
    k = F.col("s_suppkey")
    sources = load(spark, d, "supplier").select(k.alias("key"), (k - F.floor(k % 5 / 4)).alias("label"))
    return model.labelled_files(sources, load(spark, d, "part").where("p_size < 25").select((F.col("p_partkey") % 1500).alias("label"), F.col("p_name").alias("digest")))


@query("""SELECT p_partkey, CASE WHEN turn > 1 THEN own || '#' || position ELSE own END AS key FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY position) AS turn FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS position, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ':' || p_brand ELSE p_name END AS own FROM (SELECT p_partkey, CASE WHEN p_size < 40 THEN p_type ELSE p_name END AS p_name, p_brand FROM part)))""")
def unique_keys(spark, d):  # W15
    from girder.operators.ranking import dense_rank_all

    part = load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 40, F.col("p_type")).otherwise(F.col("p_name")).alias("preferred"), F.col("p_brand").alias("label"))
    placed = dense_rank_all(part, ["p_partkey"], "position")
    return model.assigned_keys(placed).join(placed.select("position", "p_partkey"), "position").select("p_partkey", "key")


# ---- demand and reports --------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS view, CASE WHEN min(CASE WHEN p_size >= 48 THEN l_partkey END) IS NULL THEN sum(p_size * 100)::BIGINT END AS bytes, min(CASE WHEN p_size >= 48 THEN 'k' || lpad(l_partkey::VARCHAR, 9, '0') END) AS missing FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def demanded_bytes(spark, d):  # A34
    name = lambda c: F.concat(F.lit("k"), F.lpad(F.col(c).cast("string"), 9, "0"))
    views = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("view")).agg(F.array_join(F.collect_list(name("l_partkey")), ",").alias("demand"))
    priced = load(spark, d, "part").where("p_size < 48").select(name("p_partkey").alias("chunk_id"), (F.col("p_size") * 100).cast("long").alias("byte_length"))
    return model.demanded_bytes(views, priced)


@query("""WITH used AS (SELECT DISTINCT l_orderkey AS leaf, l_partkey FROM lineitem), c AS (SELECT p_brand AS chunk, sum(p_size)::BIGINT AS chunk_bytes FROM part GROUP BY 1)
SELECT leaf, count(*) AS chunks, sum(chunk_bytes)::BIGINT AS requested, sum(useful)::BIGINT AS useful, (sum(chunk_bytes) - sum(useful))::BIGINT AS off_view
FROM (SELECT leaf, p_brand AS chunk, sum(p_size) AS useful FROM used JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) JOIN c USING (chunk) GROUP BY 1""")
def packing_census(spark, d):  # J21
    packed = load(spark, d, "part").select(F.col("p_partkey").alias("prototype_id"), F.col("p_brand").alias("chunk"), F.col("p_size").cast("long").alias("byte_length"))
    return model.packing_census(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("leaf"), F.col("l_partkey").alias("prototype_id")), packed)


@query("""SELECT max(l_linenumber)::BIGINT AS depth, count(*) AS occurrences, count(DISTINCT l_partkey) AS prototypes, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS repeated, count(*) - count(DISTINCT l_partkey) AS saved,
  (SELECT count(*) FROM events WHERE event_type = 'view') AS info, (SELECT count(*) FROM events WHERE event_type = 'click') AS warning, (SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click')) AS error FROM lineitem""")
def scene_counts(spark, d):  # A33
    kind = F.when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "warning").otherwise("error")
    return model.scene_counts(load(spark, d, "lineitem").select(F.col("l_partkey").alias("prototype_id"), F.col("l_linenumber").cast("long").alias("depth")), load(spark, d, "events").select(kind.alias("severity")))


@query(f"""WITH {fx.OCCURRENCES_SQL} SELECT prototype_id, occurrences, place, occurrence_id FROM (
  SELECT prototype_id, occurrence_id, count(*) OVER (PARTITION BY prototype_id) AS occurrences, row_number() OVER (PARTITION BY prototype_id ORDER BY occurrence_id) - 1 AS place FROM occ) WHERE occurrences > 1""")
def reuse_lists(spark, d):  # A33
    return model.reuse_lists(fx.occurrences(spark, d))


@query("""SELECT p_brand AS document_id, CASE WHEN count(*) FILTER (p_size > 45) > 0 THEN 'prototypeId' END AS semantic_rule,
  CASE WHEN greatest(count(*) FILTER (p_size < 10), count(*) FILTER (p_size BETWEEN 20 AND 29)) = 0 THEN NULL WHEN count(*) FILTER (p_size BETWEEN 20 AND 29) > count(*) FILTER (p_size < 10) THEN 'occurrenceId' ELSE 'semanticId' END AS source_rule FROM part GROUP BY 1""")
def derivation_rules(spark, d):  # A17
    size, k = F.col("p_size"), F.col("p_partkey").cast("string")
    semantic = F.when(size > 45, F.concat(F.lit("semantic:p"), k)).otherwise(F.concat(F.lit("semantic:q"), k))
    source = F.when(size < 10, F.concat(F.lit("source:q"), k)).when(size.between(20, 29), F.concat(F.lit("source:o"), k)).when(size < 40, "source:other")
    rows = load(spark, d, "part").select(F.col("p_brand").alias("document_id"), F.concat(F.lit("o"), k).alias("occurrence_id"), F.concat(F.lit("p"), k).alias("prototype_id"), semantic.alias("semantic_id"), source.alias("source_ref"))
    return model.derivation_rules(rows)


@query("SELECT o_orderkey AS frame, round((o_custkey - o_orderkey % 97) * 0.08, 6)::DOUBLE AS ms FROM orders WHERE o_custkey >= o_orderkey % 97 AND o_orderkey % 13 <> 0")
def frame_durations(spark, d):  # W13: reversed and incomplete pairs are skipped
    k = F.col("o_orderkey")
    ticks = load(spark, d, "orders").select(k.alias("frame"), (k % 97).alias("begin"), F.when(k % 13 != 0, F.col("o_custkey")).alias("end"))
    return model.frame_durations(ticks, 80_000.0).select("frame", F.round("ms", 6).alias("ms"))


@query("""SELECT s_nationkey, string_agg(code || ' ' || path, chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY code, path) AS turn FROM (
  SELECT s_nationkey, s_name AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'A' END AS code FROM supplier WHERE s_suppkey % 5 <> 0)) WHERE turn <= 5 GROUP BY 1""")
def first_errors(spark, d):  # T03
    k = F.col("s_suppkey")
    issues = load(spark, d, "supplier").select("s_nationkey", F.when(k % 5 == 0, "warning").otherwise("error").alias("severity"), F.when(k % 2 == 0, "B").otherwise("A").alias("code"), F.col("s_name").alias("path"))
    return model.first_errors(issues, ["s_nationkey"])


@query("""SELECT o_orderkey, CASE WHEN n = 0 THEN 'none' WHEN n > 3 THEN array_to_string(s[1:3], '|') || '|+ ' || (n - 3) || ' more' ELSE array_to_string(s, '|') END AS shown FROM (
  SELECT o_orderkey, count(l_suppkey) AS n, list(l_suppkey ORDER BY l_suppkey) FILTER (l_suppkey IS NOT NULL) AS s FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 10) ON l_orderkey = o_orderkey GROUP BY 1)""")
def some_references(spark, d):  # T04
    refs = load(spark, d, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("refs"))
    both = load(spark, d, "orders").select("o_orderkey").join(refs, "o_orderkey", "left")
    return both.select("o_orderkey", F.array_join(model.some_references(F.col("refs")), "|").alias("shown"))


@query("""SELECT l_orderkey AS batch, CASE WHEN kept THEN 1000 ELSE n END AS visible, NOT kept AS recomputed FROM (SELECT l_orderkey, l_orderkey % 3 = 0 AND l_orderkey % 5 <> 0 AS kept, count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) AS n FROM lineitem GROUP BY 1)""")
def visibility_update(spark, d):  # ST07
    orders = load(spark, d, "orders")
    before = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("batch"), F.lit(1000).cast("long").alias("visible"))
    changed = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("batch"))
    hidden = load(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("object_id"))
    return model.visibility_update(before, load(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_suppkey").alias("object_id")), hidden, changed)


# ---- split scenes and packages -------------------------------------------------------------------------------


@query(f"""WITH {fx.ENTRIES_SQL}, odd AS (SELECT 's:' || lpad(p_partkey::VARCHAR, 8, '0') AS bag_id, CASE WHEN p_partkey % 11 = 0 THEN 'no-set' ELSE 'arity' END AS problem FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0)
SELECT bag_id, key, value, NULL AS problem FROM entries WHERE bag_id NOT IN (SELECT bag_id FROM odd) UNION ALL SELECT bag_id, NULL, NULL, problem FROM odd""")
def hydrated_properties(spark, d):  # S07: bags, key sets and keys
    from girder.operators import properties

    entries = fx.entries(spark, d)
    bags = load(spark, d, "part").select(fx.padded("s:", "p_partkey", 8).alias("bag_id"), (F.col("p_partkey") % 11).alias("k"), (F.col("p_partkey") % 13).alias("m"))
    keys = properties.key_index(entries)
    sets, own = properties.key_sets(bags, entries)
    rows = entries.join(keys, "key").groupBy("bag_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key_id", "value"))), lambda e: e["value"]).alias("row"))
    split = bags.join(own, "bag_id").join(rows, "bag_id", "left").withColumn("set_id", F.when(F.col("k") != 0, F.col("set_id")))
    return documents.hydrated(split.select("bag_id", "set_id", F.when(F.col("m") == 0, F.concat("row", F.array(F.lit("x")))).otherwise(F.col("row")).alias("row")), sets, keys)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'alignment' WHEN p_partkey % 100 * 8 + p_size * 8 > 1000 THEN 'range' END AS problem FROM part""")
def geometry_streams(spark, d):  # S07
    k, size = F.col("p_partkey"), F.col("p_size")
    problem = documents.stream_problem(k % 100 * 8, size * 8 + F.when(k % 4 == 1, 3).otherwise(0), F.lit(8), F.lit(1000))
    return load(spark, d, "part").select("p_partkey", problem.alias("problem"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'version' WHEN 2 THEN 'missing-meshes' WHEN 3 THEN 'no-buffer' WHEN 4 THEN CASE WHEN s_nationkey > 12 THEN 'too-many-nodes' END END AS problem FROM supplier""")
def package_documents(spark, d):  # S11
    k = F.col("s_suppkey") % 6
    nodes = F.array_join(F.transform(F.sequence(F.lit(0), F.when(k == 4, F.col("s_nationkey")).otherwise(3)), lambda i: F.lit("{}")), ",")
    version = F.when(k == 1, "1.0").otherwise("2.0")
    meshes = F.when(k == 2, "").otherwise('"meshes":[],')
    text = F.concat(F.lit('{"asset":{"version":"'), version, F.lit('"},"scenes":[],"nodes":['), nodes, F.lit("],"), meshes, F.lit('"materials":[],"buffers":['), F.when(k == 3, "").otherwise("{}"), F.lit('],"bufferViews":[],"accessors":[]}'))
    rows = load(spark, d, "supplier").select("s_suppkey", F.when(k == 0, "{").otherwise(text).alias("text"))
    return rows.select("s_suppkey", documents.package_problem(F.col("text"), {"nodes": 13}).alias("problem"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'r' || p_partkey END AS representation_id, CASE WHEN p_partkey % 7 <> 0 THEN 'display' END AS purpose, CASE WHEN p_partkey % 7 <> 0 THEN p_size::BIGINT END AS vertices,
  CASE WHEN p_partkey % 7 <> 0 THEN 1::BIGINT END AS triangles, CASE WHEN p_partkey % 7 = 0 THEN 'no-representations' END AS problem FROM part""")
def scene_representations(spark, d):  # S22
    k = F.col("p_partkey")
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") * 3), lambda i: (i / 2).cast("string")), ",")
    text = F.concat(F.lit('{"id":"s","representations":[{"id":"r'), k, F.lit('","purpose":"display","surface":{"positions":['), numbers, F.lit('],"indices":[0,1,2]}}]}'))
    return documents.representations(load(spark, d, "part").select("p_partkey", F.when(k % 7 == 0, '{"id":"s"}').otherwise(text).alias("text")), "text", "p_partkey")


# ---- trees, boxes, checks ------------------------------------------------------------------------------------


@query(f"""WITH {fx.TREE_SQL} SELECT t.node_id, (length(t.name) * 3 - coalesce(length(p.name) * 3, 0))::BIGINT AS x, CASE WHEN p.node_id IS NULL THEN 1 ELSE 0 END::BIGINT AS y FROM tree t LEFT JOIN tree p ON p.node_id = t.parent_id""")
def local_transforms(spark, d):  # G02: what moves a node from its parent's place
    cells = [F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)]
    cells[12], cells[13] = (F.length("name") * 3).cast("double"), F.lit(1.0)
    placed = geometry.local_transforms(fx.tree(spark, d).select("node_id", "parent_id", F.array(*cells).alias("world")))
    return placed.select("node_id", F.element_at("local", 13).cast("long").alias("x"), F.element_at("local", 14).cast("long").alias("y"))


@query("""SELECT 'NODE_PARENT' AS code, p_partkey AS node_id FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'MISSING_REFERENCE', p_partkey FROM part WHERE p_partkey % 77 = 0
UNION ALL SELECT 'OCCURRENCE_CYCLE', p_partkey FROM part WHERE p_partkey IN (1, 2)""")
def tree_checks(spark, d):  # G05: several parents, unknown parents, circles
    k, part = F.col("p_partkey"), load(spark, d, "part")
    up = F.when(k == 1, 2).when(k == 2, 1).when(k % 77 == 0, k + 1_000_000_000).when(k > 3, k - k % 10 + 3 - F.when(k % 10 <= 3, 10).otherwise(0))
    first = part.select(k.alias("node_id"), F.when(up > 2, up).when(k <= 2, up).alias("parent_id"))
    return hierarchy.checks(first.unionByName(part.where("p_partkey % 50 = 0").select(k.alias("node_id"), (k - 4).alias("parent_id"))))


@query(f"WITH {fx.TREE_SQL} SELECT 'error' AS severity, 'NODE_REACHABILITY' AS code, node_id AS path, 'no root leads to the node' AS message FROM tree WHERE parent_id IN (SELECT 'n:' || lpad(n_nationkey::VARCHAR, 2, '0') FROM nation WHERE n_regionkey = 1)")
def unreachable_nodes(spark, d):  # NODE_REACHABILITY: a region's nations are cut off
    tree = fx.tree(spark, d)
    cut_off = load(spark, d, "nation").where("n_regionkey = 1").select(fx.padded("n:", "n_nationkey", 2).alias("node_id"))
    left = tree.join(cut_off, "node_id", "left_anti")
    return rules.unreachable(left, hierarchy.descend(left, {"root": F.col("node_id")}, {"root": F.col("_root")}))


@query(f"""WITH {fx.OCCURRENCES_SQL} SELECT occurrence_id, (2 * (max_x - min_x))::BIGINT AS sx, (max_y - min_y)::BIGINT AS sy, (min_x + max_x + 5)::BIGINT AS cx, ((min_y + max_y) / 2)::DOUBLE AS cy FROM occ""")
def box_instances(spark, d):  # G11: a unit cube put around each box, the world doubling x and moving it by five
    world = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 0, 0, 1)])
    made = geometry.box_instances(fx.occurrences(spark, d).withColumn("world", world))
    at = lambda i: F.element_at("instance", i + 1)
    return made.select("occurrence_id", at(0).cast("long").alias("sx"), at(5).cast("long").alias("sy"), at(12).cast("long").alias("cx"), at(13).alias("cy"))


@query("""WITH m AS (SELECT n_nationkey AS k, (n_nationkey + 1)::DOUBLE AS a, (n_regionkey + 2)::DOUBLE AS b, 0.5 AS t FROM nation)
SELECT k, side, round(x / n, 9) AS x, round(y / n, 9) AS y, round(w / n, 9) AS w FROM (SELECT *, sqrt(x * x + y * y) AS n FROM (
  SELECT k, 'left' AS side, a AS x, 0.0 AS y, (1 + t)::DOUBLE AS w FROM m UNION ALL SELECT k, 'right', -a, 0.0, (1 - t)::DOUBLE FROM m UNION ALL SELECT k, 'bottom', 0.0, b, 1.0 FROM m UNION ALL SELECT k, 'top', 0.0, -b, 1.0 FROM m))""")
def frustum_planes(spark, d):  # G16: a frame for each nation; frames are few, and their planes are constants of a plan
    rows = []
    for r in load(spark, d, "nation").collect():  # 25 rows
        m = [r.n_nationkey + 1.0, 0, 0, 0, 0, r.n_regionkey + 2.0, 0, 0, 0, 0, 1.0, 0, 0.5, 0, 0, 1.0]
        rows += [(r.n_nationkey, side, round(p[0], 9) + 0.0, round(p[1], 9) + 0.0, round(p[3], 9)) for side, p in zip(("left", "right", "bottom", "top"), spatial.frustum_planes(m))]
    return spark.createDataFrame(rows, "k int, side string, x double, y double, w double")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS before FROM lineitem)
SELECT DISTINCT 'error' AS severity, 'PROPERTY_SET_NOT_ASCENDING' AS code, l_orderkey::VARCHAR AS path, 'a set''s keys do not ascend' AS message FROM s WHERE before >= l_suppkey
UNION ALL SELECT DISTINCT 'error', 'PROPERTY_KEY_OUT_OF_RANGE', l_orderkey::VARCHAR, 'a set names no key' FROM lineitem WHERE l_suppkey >= 90""")
def ascending_sets(spark, d):  # W04
    rows = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("r"))
    return validation.property_sets(rows.select("set_id", F.col("r.l_suppkey").alias("key_ids")), 90)


# relation of rules.RULES: (its columns made of p_partkey k and p_size s, as SQL; code -> when the SQL side expects it)
_BROKEN: dict[str, tuple[str, dict[str, str]]] = {
    "scene": ("IF(k % 5 = 0, ' ', 's') AS scene_id, CAST(k % 3 AS INT) AS schema_version, 'r' AS revision", {"INVALID_SCENE_HEADER": "k % 5 = 0 OR k % 3 = 0"}),
    "units": ("IF(k % 9 <> 0, 'm', NULL) AS unit, IF(k % 8 = 0, CAST('NaN' AS DOUBLE), CAST(s - 10 AS DOUBLE)) AS scale", {"UNDECLARED_UNITS": "k % 9 = 0", "INVALID_UNIT_SCALE": "k % 8 = 0 OR s <= 10"}),
    "values": ("IF(k % 4 = 0, CAST('Infinity' AS DOUBLE), 1D) AS value, k % 3 = 0 AS is_number", {"NON_FINITE_PROPERTY": "k % 12 = 0"}),
    "surfaces": (
        "k % 10 AS n_groups_end, 6 AS n_indices, IF(k % 4 = 0, NULL, k % 4) AS n_sources, 2 AS n_triangles, s AS max_source, 40 AS n_table",
        {"MATERIAL_GROUP_OUT_OF_RANGE": "k % 10 > 6", "SOURCE_MAP_COUNT_MISMATCH": "k % 4 IN (1, 3)", "SOURCE_MAP_OUT_OF_RANGE": "s >= 40"},
    ),
    "bags": (
        "IF(k % 2 = 0, k, NULL) AS set_id, 9 AS n_sets, IF(k % 5 = 0, NULL, k % 5 - 2) AS row, 2 AS n_rows, k % 3 = 0 AS has_index, k % 7 <> 0 AS has_columns",
        {"MISSING_PROPERTY_INDEX": "k % 2 = 0 AND k % 3 <> 0", "MISSING_PROPERTY_COLUMNS": "k % 5 <> 0 AND k % 7 = 0", "PROPERTY_ROW_OUT_OF_RANGE": "k % 5 IN (1, 4) AND k % 7 <> 0"},
    ),
    "representations": ("IF(k % 6 = 0, NULL, k % 3) AS owner, 1 AS prototype_id", {"REPRESENTATION_NOT_OWNED": "k % 6 = 0 OR k % 3 <> 1"}),
    "packages": ("IF(k % 3 = 0, NULL, '2.0') AS version, k % 2 AS buffers, s AS declared_bytes, 20 AS actual_bytes", {"GLTF_VERSION": "k % 3 = 0", "BUFFER_COUNT": "k % 2 = 0", "BUFFER_LENGTH": "s <> 20"}),
    "views": ("IF(k % 5 = 0, NULL, k % 5 - 2) AS buffer, 2 AS buffers", {"BUFFER_REFERENCE": "k % 5 IN (0, 1, 4)"}),
    "accessors": (
        "s AS view, 40 AS views, s AS count, k % 6 AS components, 4 AS component_bytes, 0 AS byte_offset, 500 AS view_bytes",
        {"ACCESSOR_BUFFER_VIEW": "s >= 40", "ACCESSOR_SHAPE": "k % 6 IN (0, 5)", "ACCESSOR_RANGE": "s * (k % 6) > 125"},
    ),
    "primitives": (
        "IF(k % 5 = 0, NULL, k % 5) AS position, 4 AS accessors, k % 4 <> 0 AS has_bounds, IF(k % 3 = 0, NULL, k % 6) AS indices, IF(k % 2 = 0, 4, 1) AS mode, s AS n, k % 3 AS material, 2 AS materials",
        {"POSITION_ACCESSOR": "k % 5 IN (0, 4)", "POSITION_BOUNDS": "k % 4 = 0", "INDEX_ACCESSOR": "k % 6 IN (4, 5)", "PRIMITIVE_COUNT": "(k % 2 = 0 AND s % 3 <> 0) OR (k % 2 = 1 AND s % 2 <> 0)", "MATERIAL_REFERENCE": "k % 3 = 2"},
    ),
    "meshes": ("k % 4 AS primitives", {"MESH_EMPTY": "k % 4 = 0"}),
    "nodes": (
        "IF(k % 4 = 0, array_repeat(1D, 15 + CAST(s % 2 AS INT)), NULL) AS matrix, IF(k % 3 = 0, array(1D, 2D, IF(k % 5 = 0, CAST('NaN' AS DOUBLE), 3D)), NULL) AS translation, k % 3 AS mesh, IF(k % 2 = 0, NULL, k % 5) AS coarse_mesh, 2 AS meshes",
        {"NODE_MATRIX": "k % 4 = 0 AND s % 2 = 0", "NODE_TRANSLATION": "k % 15 = 0", "NODE_TRANSFORM": "k % 12 = 0", "NODE_MESH": "k % 3 = 2", "NODE_COARSE_MESH": "k % 2 = 1 AND k % 5 > 1"},
    ),
    "links": ("IF(k % 3 = 0, NULL, k % 3) AS child, 2 AS nodes", {"NODE_CHILD": "k % 3 IN (0, 2)"}),
}


def _rules_sql() -> str:
    told = lambda c: validation.MESSAGES[c].replace("'", "''")
    return "WITH t AS (SELECT p_partkey AS k, p_size AS s FROM part) " + " UNION ALL ".join(f"SELECT 'error' AS severity, '{c}' AS code, k::VARCHAR AS path, '{told(c)}' AS message FROM t WHERE {when}" for _, codes in _BROKEN.values() for c, when in codes.items())


@query(_rules_sql())
def broken_rows(spark, d):  # section 2.12: every rule on one row, each with rows that break it
    t = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    return rules.check_all({name: (t.selectExpr("k", *_columns(columns)), "k") for name, (columns, _) in _BROKEN.items()})


def _columns(text: str) -> list[str]:
    """The expressions of a select list: commas within brackets do not part them."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS s FROM part), r AS (
  SELECT k, unnest([CASE WHEN s % 3 <> 0 THEN 'INVALID_POSITION_COUNT' END, CASE WHEN k % 3 <> 0 THEN 'INVALID_TRIANGLE_COUNT' END, CASE WHEN k % 20 >= s / 3.0 THEN 'INDEX_OUT_OF_RANGE' END, CASE WHEN k % 4 = 0 THEN 'ATTRIBUTE_COUNT_MISMATCH' END,
    CASE WHEN k % 6 = 0 THEN 'INVALID_TRANSFORM' END, CASE WHEN k % 5 = 1 THEN 'NON_FINITE_BOUNDS' WHEN s > 25 THEN 'INVERTED_BOUNDS' END, CASE WHEN k % 4 <> 0 THEN 'BUFFER_ALIGNMENT' END, CASE WHEN k + s > 1000 THEN 'BUFFER_RANGE' END, CASE WHEN k % 10 = 0 THEN 'EMPTY_ID' END,
    CASE WHEN k % 8 = 7 THEN 'PROPERTY_SET_OUT_OF_RANGE' WHEN k % 8 <> s % 3 THEN 'PROPERTY_VALUE_ARITY' END, CASE WHEN k % 40 = 0 THEN 'EMPTY_PROPERTY_KEY' END]) AS code FROM t)
SELECT code, count(*) AS errors, sum(k)::BIGINT AS keys FROM r WHERE code IS NOT NULL GROUP BY 1""")
def broken_tables(spark, d):  # section 2.12: rules that look at several columns or rows
    k, s, part = F.col("p_partkey"), F.col("p_size"), load(spark, d, "part")
    zero = lambda v: F.lit(float(v))
    sets = spark.range(7).select(F.col("id").alias("set_id"), F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id"))).otherwise(F.expr("array()").cast("array<bigint>")).alias("key_ids"))
    boxes = part.select(k, *[zero(0).alias(f"min_{a}") for a in "xyz"], F.when(k % 5 == 1, float("inf")).otherwise(zero(1)).alias("max_x"), (F.lit(25.0) - s).alias("max_y"), zero(1).alias("max_z"))
    matrix = F.when(k % 6 == 0, F.array_repeat(zero(1), 15)).otherwise(F.array_repeat(zero(1), 16))
    found = [
        validation.meshes(part.select(k.alias("mesh_id"), s.alias("n_position_values"), (k % 3).alias("n_indices"), (k % 20).alias("max_index"), (s + F.when(k % 4 == 0, 1).otherwise(0)).alias("n_normal_values"))),
        validation.transforms(part.select(k, matrix.alias("m")), "m", "p_partkey"), validation.bounds(boxes, "p_partkey"),
        validation.ranges(part.select(k.alias("view_id"), k.alias("byte_offset"), s.alias("byte_length")), 1000),
        validation.empty_ids(part.select(k, F.when(k % 10 != 0, F.col("p_name")).otherwise(" ").alias("id")), "id", k),
        validation.property_rows(part.select(k.alias("bag_id"), (k % 8).alias("set_id"), (s % 3).alias("n_values")), sets),
        validation.property_keys(part.select(k.alias("key_id"), F.when(k % 40 == 0, F.lit(" ")).otherwise(F.concat(F.lit("k"), k)).alias("key"))).where("code = 'EMPTY_PROPERTY_KEY'"),
    ]
    from functools import reduce

    return reduce(DataFrame.unionByName, found).groupBy("code").agg(F.count(F.lit(1)).alias("errors"), F.sum(F.col("path").cast("long")).alias("keys"))


_TWO_TREES = f"""WITH {fx.TREE_SQL}, b AS (
  SELECT node_id, CASE WHEN node_id LIKE 'c:%' AND substr(node_id, 3)::BIGINT % 50 = 7 THEN 'n:00' ELSE parent_id END AS parent_id, CASE WHEN node_id LIKE 'c:%' AND substr(node_id, 3)::BIGINT % 60 = 9 THEN name || '!' ELSE name END AS name, renderable
  FROM tree WHERE NOT (node_id LIKE 'c:%' AND substr(node_id, 3)::BIGINT % 70 = 11) AND node_id <> 'n:03' AND parent_id IS DISTINCT FROM 'n:03'
  UNION ALL SELECT node_id, parent_id, name, renderable FROM tree WHERE node_id LIKE 'c:%' AND substr(node_id, 3)::BIGINT % 80 = 13 AND parent_id <> 'n:03' AND substr(node_id, 3)::BIGINT % 70 <> 11)"""


@query(f"""{_TWO_TREES}, p AS (SELECT parent_id, node_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS v FROM tree GROUP BY 1, 2), q AS (SELECT parent_id, node_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS v FROM b GROUP BY 1, 2),
j AS (SELECT coalesce(p.node_id, q.node_id) AS node_id, CASE WHEN p.node_id IS NULL THEN q.parent_id ELSE p.parent_id END AS parent_id, p.n AS pn, q.n AS qn, p.v AS pv, q.v AS qv FROM p FULL JOIN q ON p.node_id = q.node_id AND p.parent_id IS NOT DISTINCT FROM q.parent_id),
k AS (SELECT CASE WHEN qn IS NULL THEN 'lost' WHEN pn IS NULL THEN 'added' WHEN pn <> qn THEN 'copies' WHEN pv <> qv THEN 'changed' END AS kind, node_id, parent_id, coalesce(pn, qn) || coalesce(pv, qv) AS v FROM j),
m AS (SELECT node_id, v, max(parent_id) FILTER (kind = 'added') AS dest FROM k WHERE kind IN ('lost', 'added') AND parent_id IS DISTINCT FROM 'n:03' GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'lost') = 1 AND count(*) FILTER (kind = 'added') = 1)
SELECT kind, node_id, parent_id FROM k WHERE kind IS NOT NULL AND parent_id IS DISTINCT FROM 'n:03' AND NOT (kind IN ('lost', 'added') AND EXISTS (SELECT 1 FROM m WHERE m.node_id = k.node_id AND m.v = k.v))
UNION ALL SELECT 'moved', node_id, dest FROM m""")
def package_differences(spark, d):  # J27
    from girder.operators import roundtrip

    a = fx.tree(spark, d)
    n = F.when(F.col("node_id").startswith("c:"), F.expr("try_cast(substring(node_id, 3) AS long)"))
    outside = F.coalesce(F.col("parent_id") != "n:03", F.lit(True))
    number = lambda every, rest: F.coalesce(n % every == rest, F.lit(False))
    kept = a.where(~number(70, 11) & (F.col("node_id") != "n:03") & outside)
    b = kept.withColumns({"parent_id": F.when(number(50, 7), "n:00").otherwise(F.col("parent_id")), "name": F.when(number(60, 9), F.concat("name", F.lit("!"))).otherwise(F.col("name"))})
    b = b.unionByName(kept.where(number(80, 13)))
    found, _ = roundtrip.compare(*(roundtrip.digests(x, ["name"]) for x in (a, b)))
    return found
