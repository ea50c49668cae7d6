"""Queries of the source operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import scalars
from girder.operators import model, ranking, validation
from girder.sources import json_bytes, parquet_footers, part21, scene_json, workload
from girder.tables import cut, load, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT upper(replace(p_type, ' ', '_')) AS type, count(*) AS n, max(p_partkey) AS last_id FROM part GROUP BY 1""")
def entity_scan(spark, d):  # S04: parts as instance lines
    line = F.concat(F.lit("  #"), F.col("p_partkey").cast("string"), F.lit("= "), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.lit("('',(#1));"))
    return part21.histogram(load(spark, d, "part").select(line.alias("value")))


@query("""SELECT 'source:' || p_partkey AS source_ref, upper(replace(p_type, ' ', '_')) AS type, 'UNSUPPORTED_ENTITY:' || upper(replace(p_type, ' ', '_')) AS diagnostic FROM part WHERE p_type NOT LIKE 'S%'""")
def unsupported_entities(spark, d):  # S10
    part = load(spark, d, "part")
    line = F.concat(F.lit("#"), F.col("p_partkey").cast("string"), F.lit("="), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.lit("();"))
    known = part.where("p_type like 'S%'").select(F.upper(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))).alias("type"))
    return part21.unsupported(part.select(line.alias("value")), known)


@query(r"""SELECT sum(len(regexp_extract_all(html, '\bdiv\b')))::BIGINT AS div, sum(len(regexp_extract_all(html, '\bscript\b')))::BIGINT AS script FROM pages""")
def keyword_scan(spark, d):  # S05
    return part21.keyword_counts(load(spark, d, "pages"), "html", ["div", "script"])


@query("""SELECT prototype, count(*) AS n, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y, sum(z)::BIGINT AS z FROM (
  SELECT ((i * 73 + (i // 17) * 19) % 256)::INTEGER AS prototype, i % 22 AS x, (i // 22) % 22 AS y, i // 484 AS z FROM (SELECT unnest(range(10000)) AS i)) GROUP BY 1""")
def synthetic_workload(spark, d):  # S23
    return workload.workload(spark, 10_000, 256).groupBy("prototype").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z"))


@query("""SELECT source, count(*) AS records, count(text) AS payloads, count(DISTINCT doc_id) AS identities, count(DISTINCT lang) AS generators, count(DISTINCT 'open') AS licences,
  CASE WHEN count(text) < count(*) THEN 'payload' WHEN count(DISTINCT doc_id) < count(*) THEN 'identity' WHEN count(DISTINCT lang) <> 1 THEN 'generator' END AS problem FROM (SELECT *, 'open' AS licence FROM documents) GROUP BY 1""")
def corpus_evidence(spark, d):  # S20: payloads and identities of each corpus, and one generator and licence
    docs = load(spark, d, "documents").withColumn("licence", F.lit("open"))
    return ranking.corpus_evidence(docs, ["source"], "text", "doc_id", "lang", "licence")


_CORPORA = {"documents": ("text", "doc_id", "lang"), "pages": ("html", "page_id", "html"), "events": ("props", "event_id", "event_type"), "embeddings": ("embedding", "vec_id", "label"), "benchmark": ("text", "item_id", "text"), "labels": ("quality", "doc_id", "toxic"), "orders": ("o_orderpriority", "o_orderkey", "o_orderstatus")}


def _evidence_sql(name: str, payload: str, identity: str, one: str) -> str:
    single = f"count(DISTINCT {one}) = 1 AND count({one}) = count(*)"
    return f"""SELECT '{name}' AS name, count(*) AS records, count({payload}) AS payloads, count({identity}) AS identities, count(DISTINCT {identity}) AS unique_identities, {single} AS single,
  (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {name})) AS columns,
  CASE WHEN count({payload}) < count(*) THEN 'payload' WHEN count(DISTINCT {identity}) < count(*) THEN 'identity' WHEN NOT ({single}) THEN '{one}' END AS problem FROM {name}"""


@query(" UNION ALL ".join(_evidence_sql(n, *c) for n, c in _CORPORA.items()))
def parquet_evidence(spark, d):  # S20: footers first, and the columns that they leave open
    of = lambda name, payload, identity, one: parquet_footers.evidence(spark, f"{d}/{name}.parquet", payload, identity, (one,)).select(F.lit(name).alias("name"), F.col("rows").alias("records"), "payloads", "identities", "unique_identities", F.col("generators")[one].alias("single"), "columns", "problem")
    return reduce(DataFrame.unionByName, [of(n, *c) for n, c in _CORPORA.items()])


# headers that exchange files of the query begin with, by the file's number
_EXCHANGE = ("ISO-10303-21;HEADER;FILE_SCHEMA(('IFC4X3_ADD2'));ENDSEC;", " ISO-10303-21;FILE_SCHEMA (( 'IFC2X3' ));", "ISO-10303-21;HEADER;ENDSEC;", "ISO-10303-21;FILE_SCHEMA(('IFC5'));", "PK", "ISO-10303-21;FILE_SCHEMA(('ifc4'));")


@query(f"""WITH l AS (SELECT o_custkey AS f, o_orderkey AS place, '#' || o_orderkey || '= IFC' || replace(o_orderpriority[3:], ' ', '') || '(' || o_orderstatus || ');' AS value FROM orders),
t AS (SELECT 'c' || f || CASE WHEN f % 7 = 0 THEN '.txt' ELSE '.ifc' END AS name, f % 7 = 0 AS odd, f % 6 AS k, count(*) AS n, count(DISTINCT split_part(value, '(', 1)[strpos(value, 'IFC'):]) AS types, max(place) AS last_id,
  list_extract([{", ".join("'" + h.replace("'", "''") + "'" for h in _EXCHANGE)}], (f % 6 + 1)::INT) || chr(10) || string_agg(value, chr(10) ORDER BY place) || chr(10) || 'END-ISO-10303-21;' || chr(10) AS body FROM l GROUP BY f)
SELECT name, strlen(body) AS byte_length, sha256(body) AS sha256, CASE k WHEN 0 THEN 'IFC4X3' WHEN 1 THEN 'IFC2X3' WHEN 5 THEN 'IFC4' END AS schema,
  CASE WHEN odd THEN 'extension' WHEN k = 4 THEN 'magic' WHEN k = 2 THEN 'undeclared' WHEN k = 3 THEN 'schema' END AS problem, (n + 2)::BIGINT AS lines, n AS instances, types, last_id FROM t""")
def exchange_files(spark, d):  # S01, S04: a file for each customer's orders, written, inspected and scanned
    o, f = load(spark, d, "orders"), F.col("o_custkey")
    name = F.concat(F.lit("c"), f, F.when(f % 7 == 0, ".txt").otherwise(".ifc"))
    value = F.concat(F.lit("#"), F.col("o_orderkey"), F.lit("= IFC"), F.replace(F.substring("o_orderpriority", 3, 99), F.lit(" "), F.lit("")), F.lit("("), "o_orderstatus", F.lit(");"))
    head = F.get(F.array(*map(F.lit, _EXCHANGE)), (f % 6).cast("int"))
    names = o.select("o_custkey").distinct()
    lines = o.select(name.alias("name"), F.col("o_orderkey").alias("place"), value.alias("value")).unionByName(names.select(name.alias("name"), F.lit(-1).alias("place"), head.alias("value"))).unionByName(names.select(name.alias("name"), F.lit(1 << 62).alias("place"), F.lit("END-ISO-10303-21;").alias("value")))
    folder = shared_path(spark, "exchange")
    cut(part21.write_files(lines, folder), "exchange-files")
    return part21.inspect_ifc(spark, folder).join(part21.census(spark, folder), "name")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'unknown-key' WHEN 1 THEN 'version' WHEN 2 THEN 'unreadable' END AS problem FROM supplier""")
def workspace_manifests(spark, d):  # S21, U05
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, '{"version":1,"color":2}').when(k == 1, '{"version":2,"name":"a"}').when(k == 2, "{").otherwise('{"version":1,"name":"a","hidden":["b","a"]}')
    return scene_json.parsed_manifests(load(spark, d, "supplier").select("s_suppkey", text.alias("t")), "t").select("s_suppkey", "problem")


@query(r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS name FROM pages")
def basenames(spark, d):  # P23
    return load(spark, d, "pages").select("page_id", scalars.basename(F.col("url")).alias("name"))


@query("""SELECT event_type, sum(v)::BIGINT AS bytes, max(n)::BIGINT AS most FROM (SELECT event_type, user_id, sum(strlen(props)) AS v, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def byte_census(spark, d):  # A23
    per = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum(F.octet_length("props")).alias("v"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("event_type").agg(F.sum("v").alias("bytes"), F.max("n").alias("most"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS pid, p_partkey // 3 AS ppid, p_size AS mb FROM part WHERE p_partkey >= 1), t AS (SELECT pid AS top, pid, mb FROM p WHERE ppid = 0 UNION ALL SELECT t.top, p.pid, p.mb FROM t JOIN p ON p.ppid = t.pid)
SELECT top, count(*) AS processes, sum(mb)::BIGINT AS mb FROM t GROUP BY 1""")
def process_trees(spark, d):  # A24, G13
    from girder.operators.hierarchy import descend

    k = F.col("p_partkey")
    p = load(spark, d, "part").where("p_partkey >= 1").select(k.alias("node_id"), F.when(k >= 3, F.floor(k / 3)).alias("parent_id"), "p_size")
    return descend(p, {"top": F.col("node_id")}, {"top": F.col("_top")}).groupBy("top").agg(F.count(F.lit(1)).alias("processes"), F.sum("p_size").alias("mb"))


@query("""SELECT w, count(*) AS samples, max(value) AS peak FROM (SELECT e.value, x.w FROM events e JOIN (SELECT o_custkey AS w, min(o_orderkey) AS a, min(o_orderkey) + 200 AS b FROM orders GROUP BY 1) x ON e.event_id BETWEEN x.a AND x.b) GROUP BY 1""")
def observation_windows(spark, d):  # ST09: a window for each customer
    windows = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("w")).agg(F.min("o_orderkey").alias("a"), (F.min("o_orderkey") + 200).alias("b"))
    return model.within_windows(load(spark, d, "events"), "event_id", windows, 100).groupBy("w").agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("peak"))


@query("""SELECT p_type, row_number() OVER (ORDER BY n DESC, p_type) - 1 AS place FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)""")
def ranked_types(spark, d):  # T01, T05
    counts = load(spark, d, "part").groupBy("p_type").agg((-F.count(F.lit(1))).alias("less"))
    return ranking.dense_rank_all(counts, ["less", "p_type"], "place").select("p_type", "place")


_TEXT = """'{"id": ' || event_id || ', "tags": ["' || event_type || '", null], "props": ' || props || '}'"""


@query(f"""WITH t AS (SELECT event_type, event_id, props FROM events), n AS (SELECT event_type, count(*) AS n, sum(strlen(event_id::VARCHAR)) AS ids, sum(strlen(event_type) + 6) AS tags, sum(strlen(props) - 7) AS ks FROM t GROUP BY 1)
SELECT event_type, p.path, p.kind, p.bytes::BIGINT AS bytes, (p.each * n)::BIGINT AS tokens FROM n, LATERAL (SELECT unnest([
  {{'path': '$', 'kind': 'punctuation', 'bytes': 7 * n, 'each': 7}}, {{'path': '$', 'kind': 'space', 'bytes': 5 * n, 'each': 5}}, {{'path': '$.id', 'kind': 'key', 'bytes': 4 * n, 'each': 1}},
  {{'path': '$.id', 'kind': 'value', 'bytes': ids, 'each': 1}}, {{'path': '$.tags', 'kind': 'key', 'bytes': 6 * n, 'each': 1}}, {{'path': '$.tags', 'kind': 'punctuation', 'bytes': 3 * n, 'each': 3}},
  {{'path': '$.tags', 'kind': 'space', 'bytes': n, 'each': 1}}, {{'path': '$.tags[]', 'kind': 'value', 'bytes': tags, 'each': 2}}, {{'path': '$.props', 'kind': 'key', 'bytes': 7 * n, 'each': 1}},
  {{'path': '$.props', 'kind': 'punctuation', 'bytes': 3 * n, 'each': 3}}, {{'path': '$.props', 'kind': 'space', 'bytes': n, 'each': 1}}, {{'path': '$.props.k', 'kind': 'key', 'bytes': 3 * n, 'each': 1}},
  {{'path': '$.props.k', 'kind': 'value', 'bytes': ks, 'each': 1}}]) AS p)""")
def json_byte_census(spark, d):  # A23: every byte of each event as a document
    return json_bytes.census(load(spark, d, "events").select("event_type", F.expr(_TEXT).alias("text")), "text", "event_type")


@query("""WITH d AS (
  SELECT 0 AS turn, row_number() OVER (ORDER BY n_nationkey) - 1 AS place, 'e' || n_nationkey AS id, 'nations' AS name FROM nation
  UNION ALL SELECT 1, row_number() OVER (ORDER BY s_suppkey) - 1, 'e' || s_suppkey % 40, 'suppliers' FROM supplier UNION ALL SELECT 2, row_number() OVER (ORDER BY p_partkey) - 1, 'e' || p_partkey, 'parts' FROM part),
p AS (SELECT *, name || '[' || place || '].id' AS path, first_value(name || '[' || place || '].id') OVER (PARTITION BY id ORDER BY turn, place) AS first FROM d)
SELECT 'error' AS severity, 'DUPLICATE_ID' AS code, path, 'the id ' || id || ' is declared already at ' || first AS message FROM p WHERE path <> first""")
def declarations(spark, d):  # ids over all relations
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    return validation.repeated_declarations([
        ("nations", load(spark, d, "nation").select("n_nationkey", name(F.col("n_nationkey")).alias("id")), "id", ["n_nationkey"]),
        ("suppliers", load(spark, d, "supplier").select("s_suppkey", name(F.col("s_suppkey") % 40).alias("id")), "id", ["s_suppkey"]),
        ("parts", load(spark, d, "part").select("p_partkey", name(F.col("p_partkey")).alias("id")), "id", ["p_partkey"]),
    ])
