"""Scene queries over the driver's tables: operators on one side, an independent SQL text on the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder import fixtures as fx
from girder.functions import scalars
from girder.operators import changes, chunks, digests, hierarchy, properties, ranking, spatial, validation
from girder.streaming import folds
from girder.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- reuse, counts, distributions ----------------------------------------------------------------------------


@query("SELECT 'p:' || lpad(l_partkey::VARCHAR, 8, '0') AS prototype_id, count(*) AS occurrences FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def prototype_reuse(spark, d):  # A01
    return ranking.reuse(load(spark, d, "lineitem").select(fx.padded("p:", "l_partkey", 8).alias("prototype_id")))


@query("""SELECT document, prototype_id, occurrences, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY document ORDER BY occurrences DESC, prototype_id) AS rank FROM (
    SELECT lower(p_brand) AS document, 'p:' || lpad(p_partkey::VARCHAR, 8, '0') AS prototype_id, count(*) AS occurrences FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE rank <= 20""")
def top_reuse_per_document(spark, d):  # T02, J03
    protos = fx.prototypes(spark, d).select("prototype_id", F.col("document_id").alias("document"))
    counts = load(spark, d, "lineitem").groupBy(fx.padded("p:", "l_partkey", 8).alias("prototype_id")).agg(F.count(F.lit(1)).alias("occurrences"))
    return ranking.top(counts.join(protos, "prototype_id"), ["document"], [F.desc("occurrences"), F.asc("prototype_id")], 20).select("document", "prototype_id", "occurrences", "rank")


@query("SELECT lower(p_brand) AS document_id, sum(p_size * 12 * n)::BIGINT AS triangles FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def submitted_triangles(spark, d):  # A11
    counts = load(spark, d, "lineitem").groupBy(fx.padded("p:", "l_partkey", 8).alias("prototype_id")).agg(F.count(F.lit(1)).alias("n"))
    return fx.prototypes(spark, d).join(counts, "prototype_id").groupBy("document_id").agg(F.sum(F.col("triangles") * F.col("n")).alias("triangles"))


@query("""WITH per AS (SELECT o_orderkey % 7 AS document, count(*) AS lines, max(l_linenumber) AS depth FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
reuse AS (SELECT o_orderkey % 7 AS document, l_partkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT (SELECT sum(lines) FROM per)::BIGINT AS lines, (SELECT max(depth) FROM per)::BIGINT AS depth, (SELECT sum(greatest(0, n - 1)) FROM reuse)::BIGINT AS reused""")
def federation_totals(spark, d):  # A03: counters are summed, depth is the largest
    both = load(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("document"), "l_partkey", F.col("l_linenumber").cast("long").alias("depth"))
    per = both.groupBy("document", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    return per.agg(F.sum("n").alias("lines"), F.max("depth").alias("depth"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("reused"))


@query("SELECT upper(event_type) AS entity, count(*) AS n, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1")
def entity_histogram(spark, d):  # A05
    return load(spark, d, "events").groupBy(F.upper("event_type").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("""SELECT event_type, count(*) AS samples, round(min(value), 6) AS least, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95,
  round(quantile_disc(value, 0.99), 6) AS p99, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def duration_distribution(spark, d):  # A06, A07, A35
    found = ranking.distribution(load(spark, d, "events"), ["event_type"], "value")
    return found.select("event_type", "samples", *[F.round(c, 6).alias(c) for c in ("least", "p50", "p95", "p99", "most", "mean")])


@query("""SELECT user_id, round(quantile_disc(value, 0.5), 6) AS lower_median, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 4) AS deviation FROM events GROUP BY 1""")
def medians_and_deviation(spark, d):  # A08, A09, A10
    found = ranking.medians(load(spark, d, "events"), ["user_id"], "value")
    return found.select("user_id", F.round("lower_median", 6).alias("lower_median"), F.round("median", 6).alias("median"), F.round("deviation", 4).alias("deviation"))


@query("""SELECT user_id, round(one, 4) AS one, round(other, 4) AS other, round(one / nullif(other, 0), 4) AS ratio FROM (
  SELECT user_id, sum(value) FILTER (event_type = 'view') AS one, sum(value) FILTER (event_type = 'click') AS other FROM events GROUP BY 1) WHERE one IS NOT NULL AND other IS NOT NULL""")
def paired_comparison(spark, d):  # J17
    found = ranking.paired(load(spark, d, "events"), ["user_id"], "event_type", "view", "click", "value")
    return found.select("user_id", *[F.round(c, 4).alias(c) for c in ("one", "other", "ratio")])


@query("""SELECT l_suppkey, l_returnflag, run, count(*) AS length FROM (
  SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount, l_linestatus ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS run FROM (
    SELECT *, CASE WHEN lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END AS new FROM lineitem
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount, l_linestatus))) GROUP BY ALL""")
def material_runs(spark, d):  # A19
    order = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_tax", "l_discount", "l_linestatus")]
    return ranking.runs(load(spark, d, "lineitem"), ["l_suppkey"], order, "l_returnflag").select("l_suppkey", "l_returnflag", "run", "length")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, round(o_totalprice)::BIGINT AS ms, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice) DESC, o_orderkey) AS k FROM orders),
f AS (SELECT DISTINCT o_custkey, 0::BIGINT AS k, [0, 0, 0]::BIGINT[] AS lanes FROM o UNION ALL SELECT f.o_custkey, o.k, list_sort(list_append(lanes[2:], lanes[1] + o.ms)) FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.k = f.k + 1)
SELECT o_custkey, max(list_max(lanes)) AS makespan FROM f GROUP BY 1""")
def lpt_makespan(spark, d):  # A25
    rows = load(spark, d, "orders").select("o_custkey", F.round(F.col("o_totalprice")).cast("long").alias("ms"))
    return ranking.makespan(rows, "o_custkey", "ms", 3)


@query(f"""WITH {fx.OCCURRENCES_SQL} SELECT prototype_id, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z FROM occ GROUP BY 1""")
def bounds_union(spark, d):  # A02
    return ranking.bounds_union(fx.occurrences(spark, d), ["prototype_id"])


@query("""SELECT p_type, row_number() OVER (ORDER BY first) - 1 AS number FROM (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY 1)""")
def first_seen_interning(spark, d):  # A14
    return ranking.first_seen(load(spark, d, "part"), "p_type", "p_partkey")


@query("""SELECT s_nationkey, sum(amount)::BIGINT AS attributed, (max(total) - sum(amount))::BIGINT AS unattributed FROM (
  SELECT s_nationkey, round(s_acctbal)::BIGINT AS amount, sum(round(s_acctbal)::BIGINT) OVER (PARTITION BY s_nationkey) + 5 AS total FROM supplier) GROUP BY 1""")
def stage_ledger(spark, d):  # A26
    return load(spark, d, "supplier").select("s_nationkey", F.round("s_acctbal").cast("long").alias("amount")).groupBy("s_nationkey").agg(F.sum("amount").alias("attributed"), F.lit(5).cast("long").alias("unattributed"))


@query("""SELECT c_nationkey, bool_and(c_acctbal > -900) AS every_within, bool_or(c_acctbal > 9900) AS any_over, count(*) FILTER (c_acctbal < 0) AS below FROM customer GROUP BY 1""")
def budget_verdicts(spark, d):  # A27
    return load(spark, d, "customer").groupBy("c_nationkey").agg(F.bool_and(F.col("c_acctbal") > -900).alias("every_within"), F.bool_or(F.col("c_acctbal") > 9900).alias("any_over"), F.count_if(F.col("c_acctbal") < 0).alias("below"))


@query("""SELECT substr(regexp_replace(event_type || ' at ' || event_id || ' of ' || user_id, '[0-9]+', 'N', 'g'), 1, 160) AS kind, count(*) AS n FROM events GROUP BY 1""")
def error_tallies(spark, d):  # A28, P19
    text = F.concat(F.col("event_type"), F.lit(" at "), F.col("event_id"), F.lit(" of "), F.col("user_id"))
    return load(spark, d, "events").groupBy(scalars.normal_error(text).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, count(DISTINCT l_orderkey) AS objects, count(*) AS instances, count(DISTINCT l_orderkey) FILTER (l_linestatus = 'O') AS visible FROM lineitem GROUP BY 1""")
def visible_counts(spark, d):  # A31: an object may span several batches
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("objects"), F.count(F.lit(1)).alias("instances"), F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey"))).alias("visible"))


# ---- properties ----------------------------------------------------------------------------------------------


def _bags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(fx.padded("s:", "p_partkey", 8).alias("bag_id"))


@query(f"WITH {fx.ENTRIES_SQL} SELECT key, row_number() OVER (ORDER BY key) - 1 AS key_id FROM (SELECT DISTINCT key FROM entries)")
def property_keys(spark, d):  # A12
    return properties.key_index(fx.entries(spark, d))


@query(f"""WITH {fx.ENTRIES_SQL}, keys AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS key_id FROM (SELECT DISTINCT key FROM entries)),
bags AS (SELECT 's:' || lpad(p_partkey::VARCHAR, 8, '0') AS bag_id FROM part),
own AS (SELECT bag_id, coalesce(string_agg(key_id::VARCHAR, ',' ORDER BY key_id), '') AS key_ids, coalesce(list(key_id ORDER BY key_id) FILTER (key_id IS NOT NULL), []) AS l FROM bags LEFT JOIN (entries JOIN keys USING (key)) USING (bag_id) GROUP BY 1)
SELECT bag_id, key_ids, (dense_rank() OVER (ORDER BY l) - 1)::BIGINT AS set_id FROM own""")
def property_key_sets(spark, d):  # A12
    sets, own = properties.key_sets(_bags(spark, d), fx.entries(spark, d))
    return own.join(sets, "set_id").select("bag_id", F.array_join(F.transform("key_ids", lambda k: k.cast("string")), ",").alias("key_ids"), "set_id")


@query(f"""WITH {fx.ENTRIES_SQL} SELECT value, value_id, n AS byte_length, coalesce(sum(n) OVER (ORDER BY value_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (
  SELECT value, strlen(value)::BIGINT AS n, row_number() OVER (ORDER BY value) - 1 AS value_id FROM (SELECT DISTINCT value FROM entries))""")
def property_values(spark, d):  # A13, W03
    return properties.value_heap(fx.entries(spark, d))


@query(f"WITH {fx.ENTRIES_SQL} SELECT bag_id, key, value FROM entries WHERE bag_id IN (SELECT 's:' || lpad(p_partkey::VARCHAR, 8, '0') FROM part WHERE p_size = 7)")
def property_lookup(spark, d):  # J01, J22
    wanted = load(spark, d, "part").where("p_size = 7").select(fx.padded("s:", "p_partkey", 8).alias("bag_id"))
    return properties.lookup(fx.entries(spark, d), wanted).select("bag_id", "key", "value")


@query("SELECT event_id::VARCHAR AS bag_id, 'k' AS key, (props::JSON ->> 'k') AS value FROM events")
def flattened_properties(spark, d):  # P03
    nested = load(spark, d, "events").select(F.col("event_id").cast("string").alias("bag_id"), F.parse_json("props").alias("v"))
    return properties.flattened(nested, "v")


# ---- hierarchy -----------------------------------------------------------------------------------------------

_WALK = f"""WITH RECURSIVE {fx.TREE_SQL}, walk AS (
  SELECT node_id, name, renderable, 0 AS depth, node_id AS path FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.node_id, t.name, t.renderable, depth + 1, path || chr(1) || t.node_id FROM tree t JOIN walk w ON t.parent_id = w.node_id),
ordered AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS node_index FROM walk)"""


@query(f"{_WALK} SELECT node_id, depth, node_index FROM ordered")
def hierarchy_preorder(spark, d):  # W06, W11
    return hierarchy.preorder(fx.tree(spark, d)).select("node_id", "depth", "node_index")


@query(f"""{_WALK}, hit AS (SELECT * FROM ordered WHERE contains(lower(name) || chr(10) || node_id, 'at') AND contains(lower(name) || chr(10) || node_id, '1')),
asm AS (SELECT path FROM hit WHERE NOT renderable),
shown AS (SELECT * FROM ordered o WHERE EXISTS (SELECT 1 FROM hit h WHERE h.path = o.path OR starts_with(h.path, o.path || chr(1))) OR EXISTS (SELECT 1 FROM asm a WHERE starts_with(o.path, a.path || chr(1))))
SELECT node_index, node_index IN (SELECT node_index FROM hit) AS matching,
  node_index = (SELECT coalesce(min(node_index) FILTER (node_index IN (SELECT node_index FROM hit)), min(node_index)) FROM shown WHERE renderable) AS first FROM shown""")
def hierarchy_search(spark, d):  # P12, W07, W08, W09
    text = scalars.nfkc_lower(F.concat_ws("\n", "name", "node_id"))
    return hierarchy.search(hierarchy.preorder(fx.tree(spark, d)), "AT 1", text)


@query(f"""WITH RECURSIVE {fx.TREE_SQL}, walk AS (
  SELECT node_id, length(name)::BIGINT AS x, 1::BIGINT AS y FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.node_id, w.x + length(t.name), w.y + 1 FROM tree t JOIN walk w ON t.parent_id = w.node_id) SELECT node_id, x, y FROM walk""")
def world_translation(spark, d):  # G01
    unit = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    cells = [F.lit(v) for v in unit]
    cells[12], cells[13] = F.length("name").cast("double"), F.lit(1.0)
    world = hierarchy.world_transforms(fx.tree(spark, d).withColumn("local", F.array(*cells)))
    return world.select("node_id", F.element_at("world", 13).cast("long").alias("x"), F.element_at("world", 14).cast("long").alias("y"))


@query(f"WITH {fx.TREE_SQL} SELECT parent_id, count(*) AS children, min(node_id) AS first_child FROM tree WHERE parent_id IS NOT NULL GROUP BY 1")
def children(spark, d):  # J04
    return fx.tree(spark, d).where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"), F.min("node_id").alias("first_child"))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey AS at, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 3) * 5 + 5 ELSE p_partkey - p_partkey % 5 END AS next, 0 AS n FROM part
  UNION ALL SELECT node, next, CASE WHEN next % 5 = 0 THEN (next % 3) * 5 + 5 ELSE next - next % 5 END, n + 1 FROM up WHERE n < 64 AND next > 0)
SELECT DISTINCT 'OCCURRENCE_CYCLE' AS code, node::VARCHAR AS node_id FROM up WHERE n = 64""")
def cycle_report(spark, d):  # G04: nodes whose parents lead round
    k = F.col("p_partkey")
    up = F.when(k % 5 == 0, (k % 3) * 5 + 5).otherwise(k - k % 5)
    own = load(spark, d, "part").select(k.cast("string").alias("node_id"), F.when(up > 0, up.cast("string")).alias("parent_id"))
    return hierarchy.cycles(own)


# ---- joins and sets ------------------------------------------------------------------------------------------


@query("""SELECT 'error' AS severity, 'MISSING_REFERENCE' AS code, l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS path, 'the reference names nothing' AS message FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)""")
def fk_violations(spark, d):  # J02
    path = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey")
    return validation.missing_reference(load(spark, d, "lineitem"), "l_suppkey", load(spark, d, "supplier").where("s_nationkey < 20"), "s_suppkey", path)


@query("""SELECT 'error' AS severity, 'DUPLICATE_ID' AS code, l_orderkey || ':' || l_linenumber AS path, 'the id is declared more than once' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_ids(spark, d):  # A21
    return validation.duplicate_ids(load(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")), "id")


@query("""SELECT code, errors, 0::BIGINT AS warnings FROM (
  SELECT 'INVERTED_BOUNDS' AS code, count(*) AS errors FROM part WHERE p_size > 25
  UNION ALL SELECT 'EMPTY_ID', count(*) FROM part WHERE p_partkey % 10 = 0
  UNION ALL SELECT 'SEQUENCE_GAP', count(*) FROM (SELECT l_linenumber - 1 AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS w FROM lineitem) WHERE n <> w) WHERE errors > 0""")
def validation_report(spark, d):  # section 2.12, A04
    part = load(spark, d, "part")
    zero = [F.lit(0.0).alias(f"min_{a}") for a in "xyz"] + [(F.lit(25.0) - F.col("p_size")).alias(f"max_{a}") for a in "xyz"]
    boxes = part.select(F.col("p_partkey").cast("string").alias("id"), *zero)
    ids = part.select(F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("id"), "p_partkey")
    lines = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"))
    issues = validation.bounds(boxes, "id").unionByName(validation.empty_ids(ids, "id", F.col("p_partkey"))).unionByName(validation.gaps(lines, "l_orderkey", "n"))
    return validation.report(issues)


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'create' WHEN b.k IS NULL THEN 'drop' WHEN a.v = b.v THEN 'keep' ELSE 'replace' END AS action
FROM (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 5 <> 0) b ON a.k = b.k""")
def keyed_reconcile(spark, d):  # J18
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return changes.keyed_diff(s.where("k % 3 <> 0"), s.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 4 == 0, -1).otherwise(F.col("v"))), "k", "v")


@query("""SELECT o_orderkey AS id, CASE WHEN hit IS NULL THEN 'cold' ELSE 'hot' END AS pool FROM (
  SELECT o_orderkey, (SELECT max(1) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS hit FROM orders WHERE o_orderpriority LIKE '1%')""")
def hot_and_cold(spark, d):  # J16
    orders = load(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("id"))
    wanted = load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return orders.join(wanted, "id", "left_semi").select("id", F.lit("hot").alias("pool")).unionByName(orders.join(wanted, "id", "left_anti").select("id", F.lit("cold").alias("pool")))


@query("""SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn DESC) AS r FROM (
  SELECT l_suppkey AS id, 'line' AS source, 1 AS turn FROM lineitem UNION ALL SELECT s_suppkey, 'supplier', 2 FROM supplier WHERE s_acctbal > 0)) WHERE r = 1""")
def last_wins_union(spark, d):  # U01, U02
    one = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.lit("line").alias("source"), F.lit(1).alias("turn"))
    two = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.lit(2).alias("turn"))
    return one.unionByName(two).groupBy("id").agg(F.max_by("source", "turn").alias("source"))


@query("""SELECT 'missing' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'covered', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def coverage_sets(spark, d):  # U03, U04
    all_, used = load(spark, d, "customer").select(F.col("c_custkey").alias("id")), load(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return all_.subtract(used).select(F.lit("missing").alias("kind"), "id").unionByName(all_.intersect(used).select(F.lit("covered").alias("kind"), "id"))


@query("""SELECT n_nationkey, coalesce(a, b, c) AS parent FROM nation LEFT JOIN (SELECT c_nationkey, min(c_name) AS a FROM customer WHERE c_acctbal > 9990 GROUP BY 1) ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT s_nationkey, min(s_name) AS b FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT r_regionkey, r_name AS c FROM region) ON r_regionkey = n_regionkey""")
def parent_precedence(spark, d):  # J19
    a = load(spark, d, "customer").where("c_acctbal > 9990").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("a"))
    b = load(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("b"))
    c = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("c"))
    return load(spark, d, "nation").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").join(c, "n_regionkey", "left").select("n_nationkey", F.coalesce("a", "b", "c").alias("parent"))


@query("""SELECT DISTINCT l_partkey AS prototype, r_name AS document FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
UNION SELECT l_partkey, r_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_quantity > 40""")
def prototype_documents(spark, d):  # J13, A22
    line = load(spark, d, "lineitem")
    place = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("document"))
    by_supplier = line.select("l_partkey", "l_suppkey").distinct().join(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    owner = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    by_order = line.where("l_quantity > 40").select("l_partkey", "l_orderkey").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return by_supplier.select(F.col("l_partkey").alias("prototype"), "document").unionByName(by_order.select(F.col("l_partkey").alias("prototype"), "document")).distinct()


# ---- projections ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, coalesce(nullif(trim(both '-' from regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')), ''), 'unnamed') AS slug,
  CASE WHEN p_partkey % 4 = 0 THEN 'step:' || p_partkey ELSE 'guid:' || p_brand END AS id, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END), ''), p_type) AS label FROM part""")
def slugs_and_labels(spark, d):  # P01, P02, P05
    k = F.col("p_partkey")
    return load(spark, d, "part").select(
        "p_partkey", scalars.slug(F.col("p_name")).alias("slug"), scalars.stable_id(F.when(k % 4 != 0, F.col("p_brand")), k).alias("id"),
        scalars.first_nonblank(F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("p_name")), F.col("p_type")).alias("label"),
    )


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(CASE WHEN abs(x - x::FLOAT::DOUBLE) <= 1e-8 THEN x::FLOAT::DOUBLE ELSE x END, 9) AS metres, x::FLOAT::DOUBLE = x AS exact
FROM (SELECT *, l_extendedprice * 0.001 AS x FROM lineitem)""".replace("0.001", "0.001::DOUBLE"))
def unit_scaling(spark, d):  # P06
    x = F.col("l_extendedprice") * F.lit(0.001)
    high, _ = scalars.high_low(x)
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.round(scalars.metres(F.col("l_extendedprice"), F.lit(0.001)), 9).alias("metres"), (high.cast("double") == x).alias("exact"))


@query("""SELECT s_suppkey, CASE WHEN v IS NULL THEN 0 WHEN v = w THEN 1 ELSE 2 END AS state, v AS value FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'x' || s_suppkey END AS v, s_name AS w FROM supplier)""")
def identity_elision(spark, d):  # P16 and its inverse
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier").withColumn("v", F.when(k % 3 == 1, F.col("s_name")).when(k % 3 == 2, F.concat(F.lit("x"), k)))
    s = s.withColumn("state", scalars.identity_state(F.col("v"), F.col("s_name"))).withColumn("kept", F.when(F.col("state") == 2, F.col("v")))
    return s.select("s_suppkey", "state", scalars.identity_value(F.col("state"), F.col("kept"), F.col("s_name")).alias("value"))


@query("""SELECT c_custkey, CASE WHEN iso IS NOT NULL THEN c_custkey = iso ELSE c_acctbal >= 0 END AS shown FROM (SELECT *, CASE WHEN c_nationkey = 3 THEN (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3) END AS iso FROM customer)""")
def visibility(spark, d):  # P10
    c = load(spark, d, "customer")
    alone = c.where("c_nationkey = 3").agg(F.min("c_custkey").alias("iso"))
    both = c.crossJoin(F.broadcast(alone))  # one row
    return both.select("c_custkey", scalars.visible(F.col("c_custkey"), F.col("c_acctbal") < 0, F.when(F.col("c_nationkey") == 3, F.col("iso"))).alias("shown"))


@query(f"WITH {fx.OCCURRENCES_SQL} SELECT occurrence_id FROM occ WHERE 2 * min_x + min_y <= 900000")
def section_plane(spark, d):  # P11
    return fx.occurrences(spark, d).where(scalars.within_section(F.col("min_x"), F.col("min_y"), F.col("min_z"), (2, 1, 0, 900000))).select("occurrence_id")


@query(f"WITH {fx.OCCURRENCES_SQL} SELECT occurrence_id FROM occ WHERE min_x - 1000 >= -50 AND 4000 - min_x >= -50 AND min_y - 100000 >= -50 AND 3000000 - min_y >= -50 AND min_z - 2 >= -50 AND 8 - min_z >= -50")
def sphere_cull(spark, d):  # P13
    planes = [(1, 0, 0, -1000), (-1, 0, 0, 4000), (0, 1, 0, -100000), (0, -1, 0, 3000000), (0, 0, 1, -2), (0, 0, -1, 8)]
    return fx.occurrences(spark, d).where(scalars.sphere_in_planes(F.col("min_x"), F.col("min_y"), F.col("min_z"), F.lit(50), planes)).select("occurrence_id")


# ---- chunks, boxes, demand -----------------------------------------------------------------------------------


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    protos = fx.prototypes(spark, d).select("prototype_id", "document_id", F.col("payload_bytes").alias("byte_length"))
    return chunks.offsets(protos, "document_id", "prototype_id", "byte_length")


@query(f"""WITH RECURSIVE {fx.PROTOTYPES_SQL}, r AS (SELECT document_id, prototype_id, payload_bytes AS n, row_number() OVER (PARTITION BY document_id ORDER BY prototype_id) AS k,
  coalesce(sum(payload_bytes) OVER (PARTITION BY document_id ORDER BY prototype_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM proto),
f AS (SELECT document_id, prototype_id, n, k, begin_at, n AS total, 0 AS g FROM r WHERE k = 1
  UNION ALL SELECT r.document_id, r.prototype_id, r.n, r.k, r.begin_at, CASE WHEN f.total + r.n > {chunks.BUDGET} THEN r.n ELSE f.total + r.n END, CASE WHEN f.total + r.n > {chunks.BUDGET} THEN g + 1 ELSE g END FROM f JOIN r ON r.document_id = f.document_id AND r.k = f.k + 1),
c AS (SELECT 'p:' || lpad(l_partkey::VARCHAR, 8, '0') AS prototype_id, count(*) AS occurrences FROM lineitem GROUP BY 1),
x AS (SELECT document_id, g, min(begin_at) AS byte_offset, sum(n)::BIGINT AS byte_length, count(*) AS prototype_count, sum(occurrences)::BIGINT AS occurrence_count, min(prototype_id) AS first_prototype FROM f JOIN c USING (prototype_id) GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (ORDER BY occurrence_count DESC, byte_length DESC, first_prototype) - 1 AS priority FROM x)
SELECT 'target:' || CASE WHEN priority > 9999 THEN priority::VARCHAR ELSE lpad(priority::VARCHAR, 4, '0') END || ':' || first_prototype AS chunk_id, priority, document_id, byte_offset, byte_length, prototype_count, occurrence_count FROM y""")
def chunk_coalesce(spark, d):  # W01, W03, W05, J12
    counts = load(spark, d, "lineitem").groupBy(fx.padded("p:", "l_partkey", 8).alias("prototype_id")).agg(F.count(F.lit(1)).alias("occurrences"))
    found = chunks.target_chunks(_ranges(spark, d), counts)
    return found.select("chunk_id", "priority", "document_id", "byte_offset", "byte_length", "prototype_count", "occurrence_count")


@query("""WITH b AS (SELECT l_orderkey % 50 AS chunk, l_suppkey % 7 AS pool_id, max(l_linenumber * 100) AS vertex_bytes FROM lineitem GROUP BY 1, 2),
i AS (SELECT l_orderkey % 50 AS chunk, sum(l_partkey % 90) AS bytes, sum(greatest(4, ceil((l_partkey % 90) / 4.0) * 4) + 96 * l_linenumber) AS gpu FROM lineitem GROUP BY 1)
SELECT chunk, (any_value(bytes) + sum(vertex_bytes))::BIGINT AS decoded_bytes, (any_value(gpu) + sum(greatest(4, ceil(vertex_bytes / 4.0) * 4)))::BIGINT AS gpu_bytes FROM b JOIN i USING (chunk) GROUP BY 1""")
def residency_cost(spark, d):  # A18
    rows = load(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("chunk"), (F.col("l_suppkey") % 7).alias("pool_id"), (F.col("l_linenumber") * 100).alias("vertex_bytes"), (F.col("l_partkey") % 90).alias("index_bytes"), F.col("l_linenumber").alias("instances"))
    return chunks.residency_cost(rows, "chunk")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return fx.occurrences(spark, d).withColumnRenamed("occurrence_id", "id").drop("order_id", "prototype_id")


LEAVES_SQL = f"""WITH RECURSIVE {fx.OCCURRENCES_SQL}, t AS (
  SELECT occurrence_id AS id, prototype_id, min_x, max_x, min_y, max_y, min_z, max_z, '' AS leaf, 0 AS level FROM occ
  UNION ALL SELECT id, prototype_id, min_x, max_x, min_y, max_y, min_z, max_z, leaf || CASE WHEN row_number() OVER (PARTITION BY leaf ORDER BY centre, id) - 1 < n // 2 THEN '0' ELSE '1' END, level + 1 FROM (
    SELECT *, CASE WHEN wx >= wy AND wx >= wz THEN min_x + max_x WHEN wy >= wz THEN min_y + max_y ELSE min_z + max_z END AS centre FROM (
      SELECT *, count(*) OVER w AS n, max(max_x) OVER w - min(min_x) OVER w AS wx, max(max_y) OVER w - min(min_y) OVER w AS wy, max(max_z) OVER w - min(min_z) OVER w AS wz FROM t WINDOW w AS (PARTITION BY leaf)) WHERE n > 64)),
leaf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC) AS r FROM t) WHERE r = 1)"""


@query(f"{LEAVES_SQL} SELECT id, leaf FROM leaf")
def bvh_leaves(spark, d):  # G08
    return spatial.leaves(_boxes(spark, d)).select("id", "leaf")


_VIEW = [0.001, 0, 0, 0, 0, 0.000001, 0, 0, 0, 0, 0.01, 0, -2.5, -1.0, 0.0, 1.0]
_SEEN = "NOT (0.001 * max_x - 2.5 < -1 OR 0.001 * min_x - 2.5 > 1 OR 0.000001 * max_y - 1 < -1 OR 0.000001 * min_y - 1 > 1 OR 0.01 * max_z < 0 OR 0.01 * min_z > 1)"


@query(f"""WITH {fx.OCCURRENCES_SQL} SELECT occurrence_id, {_SEEN.replace('0.000001', '0.000001::DOUBLE').replace('0.001 ', '0.001::DOUBLE ').replace('0.01 ', '0.01::DOUBLE ')} AS seen FROM occ""")
def box_cull(spark, d):  # P14, P15: for an affine view both tests agree
    o = fx.occurrences(spark, d)
    return o.select("occurrence_id", (spatial.in_frustum(_VIEW) & spatial.projected_visible(_VIEW)).alias("seen"))


@query(f"""{LEAVES_SQL}, box AS (SELECT leaf, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, min(min_z) AS min_z, max(max_z) AS max_z FROM leaf GROUP BY 1),
seen AS (SELECT leaf, pow(greatest(min_x - 2000, 2000 - max_x, 0), 2) + pow(greatest(min_y - 1000000, 1000000 - max_y, 0), 2) + pow(greatest(min_z - 5, 5 - max_z, 0), 2) AS dist FROM box WHERE {_SEEN})
SELECT chunk, round(min(dist), 3) AS distance, count(DISTINCT leaf) AS leaves FROM seen JOIN (SELECT DISTINCT leaf, substr(prototype_id, 8, 3) AS chunk FROM leaf) USING (leaf) GROUP BY 1""")
def leaf_demand(spark, d):  # G09, A15, J15, J24, T06
    boxes = fx.occurrences(spark, d).select(F.col("occurrence_id").alias("id"), F.substring("prototype_id", 8, 3).alias("chunk"), *[f"{s}_{a}" for a in "xyz" for s in ("min", "max")])
    placed = spatial.leaves(boxes)
    return spatial.demand(ranking.bounds_union(placed, ["leaf"]), placed.select("leaf", "chunk").distinct(), _VIEW, (2000.0, 1000000.0, 5.0)).select("chunk", F.round("distance", 3).alias("distance"), "leaves")


@query(f"""{LEAVES_SQL} SELECT prototype_id, leaf, uses FROM (SELECT *, row_number() OVER (PARTITION BY prototype_id ORDER BY uses DESC, leaf) AS r FROM (SELECT prototype_id, leaf, count(*) AS uses FROM leaf GROUP BY 1, 2)) WHERE r = 1""".replace("AS r FROM t) WHERE r = 1)", "AS q FROM t) WHERE q = 1)"))
def dominant_leaf(spark, d):  # A16, G10
    o = fx.occurrences(spark, d).withColumnRenamed("occurrence_id", "id").drop("order_id")
    return chunks.dominant(spatial.leaves(o))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice > 200000 DESC, o_totalprice, o_orderkey) - 1 AS rank, o_orderstatus FROM orders) WHERE o_orderstatus = 'F' AND rank BETWEEN 40 AND 79""")
def viewport_slice(spark, d):  # W02, W10
    rows = load(spark, d, "orders").where("o_orderstatus = 'F'").withColumn("behind", (F.col("o_totalprice") <= 200000).cast("int"))
    first = rows.orderBy("behind", "o_totalprice", "o_orderkey").select("o_orderkey").offset(40).limit(40)
    return first.orderBy("o_orderkey")


# ---- snapshots -----------------------------------------------------------------------------------------------

_SNAP = """prev AS (SELECT source || ':' || doc_id AS discipline, sha256(text) AS digest, lang AS uri FROM documents WHERE doc_id % 7 <> 0),
curr AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved:' || doc_id ELSE source || ':' || doc_id END AS discipline, CASE WHEN doc_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS digest, CASE WHEN doc_id % 17 = 0 THEN 'zz' ELSE lang END AS uri FROM documents WHERE doc_id % 5 <> 0)"""


@query(f"""WITH {_SNAP}, j AS (SELECT coalesce(p.discipline, c.discipline) AS discipline, p.discipline IS NOT NULL AS was, c.discipline IS NOT NULL AS now, p.digest AS pd, c.digest AS cd, p.uri AS pu, c.uri AS cu FROM prev p FULL JOIN curr c ON p.discipline = c.discipline),
g AS (SELECT pd AS digest, min(discipline) AS f, count(*) AS n FROM j WHERE NOT now GROUP BY 1), a AS (SELECT cd AS digest, min(discipline) AS t, count(*) AS n FROM j WHERE NOT was GROUP BY 1),
r AS (SELECT t, f FROM g JOIN a USING (digest) WHERE g.n = 1 AND a.n = 1)
SELECT 'changed' AS kind, discipline, NULL AS renamed_from FROM j WHERE was AND now AND pd <> cd UNION ALL SELECT 'renamed', discipline, discipline FROM j WHERE was AND now AND pd = cd AND pu <> cu
UNION ALL SELECT 'renamed', t, f FROM r UNION ALL SELECT 'added', discipline, NULL FROM j WHERE NOT was AND discipline NOT IN (SELECT t FROM r) UNION ALL SELECT 'deleted', discipline, NULL FROM j WHERE NOT now AND discipline NOT IN (SELECT f FROM r)""")
def snapshot_changes(spark, d):  # J07
    docs = load(spark, d, "documents")
    k, name = F.col("doc_id"), F.concat_ws(":", "source", "doc_id")
    before = docs.where(k % 7 != 0).select(name.alias("discipline"), F.sha2("text", 256).alias("digest"), F.col("lang").alias("uri"))
    text = F.when(k % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    after = docs.where(k % 5 != 0).select(F.when(k % 11 == 0, F.concat(F.lit("moved:"), k)).otherwise(name).alias("discipline"), F.sha2(text, 256).alias("digest"), F.when(k % 17 == 0, "zz").otherwise(F.col("lang")).alias("uri"))
    return changes.snapshot_changes(before, after)


_EDGES = """edges AS (SELECT 1000000 + c_custkey AS a, c_nationkey AS b FROM customer UNION ALL SELECT 2000000000 + s_suppkey, s_nationkey FROM supplier)"""
_REGIONS = """, edges2 AS (SELECT * FROM edges UNION ALL SELECT n_nationkey, 100 + n_regionkey FROM nation), sides AS (SELECT a, b FROM edges2 UNION SELECT b, a FROM edges2)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers with their nations."""
    one = load(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    return one.unionByName(load(spark, d, "supplier").select((F.col("s_suppkey") + 2_000_000_000).alias("a"), F.col("s_nationkey").cast("long").alias("b")))


@query(f"""WITH RECURSIVE {_EDGES}{_REGIONS}, reach AS (SELECT a AS node, a AS other FROM sides UNION SELECT r.node, e.b FROM reach r JOIN sides e ON e.a = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY 1""")
def components(spark, d):  # G06: nations are joined to their regions, so there is one for each region
    regions = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b"))
    return changes.components(_edges(spark, d).unionByName(regions))


@query(f"""WITH RECURSIVE {_EDGES}, sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT 2000000000 + s_suppkey AS node FROM supplier WHERE s_acctbal < -500 UNION SELECT e.b FROM reach r JOIN sides e ON e.a = r.node)
SELECT DISTINCT 1000000 + o_custkey AS document, o_orderkey AS target FROM orders WHERE 1000000 + o_custkey IN (SELECT node FROM reach)""")
def invalidation(spark, d):  # G07: what the customers of a changed supplier's nation own
    changed = load(spark, d, "supplier").where("s_acctbal < -500").select((F.col("s_suppkey") + 2_000_000_000).alias("document"))
    return changes.invalidated(changed, _edges(spark, d), load(spark, d, "orders").select((F.col("o_custkey") + 1_000_000).alias("document"), F.col("o_orderkey").alias("target")))


@query("""SELECT source, CASE max(r) WHEN 0 THEN 'verified' WHEN 1 THEN 'unverifiable' WHEN 2 THEN 'changed' ELSE 'missing' END AS status FROM (
  SELECT source, CASE WHEN l.doc_id IS NULL THEN 3 WHEN quality IS NULL THEN 1 WHEN quality = 1 THEN 0 ELSE 2 END AS r FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def reopen_verdicts(spark, d):  # J08, J09, A20
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    expected = docs.select("doc_id", "source", F.lit(1).alias("digest"))
    seen = labels.select("doc_id", F.col("quality").alias("digest"))
    status = changes.reopened(expected, seen, "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    return changes.worst(status, ["source"])


@query("""WITH d AS (SELECT s_suppkey AS document, s_nationkey % 5 AS k, s_suppkey % 40 AS g FROM supplier WHERE s_suppkey % 2 = 0), s AS (SELECT s_suppkey AS source, s_nationkey % 5 AS k, (s_suppkey - 1) % 40 AS g FROM supplier WHERE s_suppkey % 2 = 1),
e AS (SELECT document, source FROM (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY document) AS r FROM d) JOIN (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY source) AS r FROM s) USING (k, g, r)),
o AS (SELECT g, k, s.source, document, count(document) OVER (PARTITION BY g ORDER BY k, s.source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM s LEFT JOIN e ON e.source = s.source),
m AS (SELECT * FROM o JOIN (SELECT g, count(*) AS n FROM d GROUP BY g) USING (g)),
f AS (SELECT g, source AS taker FROM (SELECT g, source, row_number() OVER (PARTITION BY g ORDER BY k, source) AS r FROM m WHERE document IS NULL AND c = n - 1) WHERE r = 1),
x AS (SELECT document, source FROM m LEFT JOIN f USING (g) WHERE document IS NOT NULL AND (taker IS NULL OR c < n - 1))
SELECT * FROM x UNION ALL SELECT document, taker FROM d JOIN f USING (g) WHERE document NOT IN (SELECT document FROM x)""")
def source_match(spark, d):  # J06
    k, nation, s = F.col("s_suppkey"), (F.col("s_nationkey") % 5).alias("discipline"), load(spark, d, "supplier")
    docs = s.where("s_suppkey % 2 = 0").select(k.alias("document"), nation, (k % 40).alias("digest"))
    return changes.matched_sources(docs, s.where("s_suppkey % 2 = 1").select(k.alias("source"), nation, ((k - 1) % 40).alias("digest")))


@query("""SELECT o_custkey AS document, sha256(string_agg(sha256(o_orderkey || chr(0) || o_orderstatus), chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1""")
def federation_digest(spark, d):  # A29
    return digests.ordered_digest(load(spark, d, "orders").withColumnRenamed("o_custkey", "document"), ["document"], ["o_orderkey", "o_orderstatus"], "o_orderkey")


@query("""SELECT 's' || s_suppkey AS name, s_suppkey % 4 <> 0 AND s_suppkey % 6 <> 0 AS ok FROM supplier""")
def verified_restore(spark, d):  # K07
    k = F.col("s_suppkey")
    own = load(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("name"), F.length("s_name").alias("byte_length"), F.sha2("s_name", 256).alias("digest"), k.alias("k"))
    there = own.where("k % 4 <> 0").withColumn("digest", F.when(F.col("k") % 6 == 0, F.lit("other")).otherwise(F.col("digest")))
    return digests.verified(own, there)


# ---- ordered folds (tests hold them against plain loops) ------------------------------------------------------


_STATES = ", ".join(f"'{s}'" for s in (*folds.STATES, *folds.TERMINAL))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, [{_STATES}][event_id % 9 + 1] AS event, event_id % 9 AS r, round(value)::BIGINT AS el FROM events),
f AS (SELECT DISTINCT job_id, 0::BIGINT AS k, -1::BIGINT AS rank, false AS ended, 0::BIGINT AS clock, 0::BIGINT AS seq, NULL::VARCHAR AS plan, false AS published, NULL::VARCHAR AS event, NULL::VARCHAR AS verdict, NULL::BIGINT AS sequence, false AS before FROM e
UNION ALL SELECT job_id, k, CASE WHEN verdict = 'accepted' AND r < 6 THEN r ELSE rank END, ended OR (verdict = 'accepted' AND r >= 6), CASE WHEN verdict = 'accepted' THEN greatest(clock, el) ELSE clock END, seq + (verdict = 'accepted')::BIGINT,
    CASE WHEN verdict = 'accepted' AND plan IS NULL AND r BETWEEN 2 AND 5 THEN CASE WHEN r = 4 THEN 'restore' ELSE 'rebuild' END ELSE plan END, published OR (verdict = 'accepted' AND r = 5), event, verdict,
    CASE WHEN verdict = 'accepted' THEN seq END, event = 'cancelled' AND verdict = 'accepted' AND published
  FROM (SELECT f.job_id, e.k, e.event, e.r, e.el, rank, ended, clock, seq, plan, published,
    CASE WHEN ended THEN 'after-end' WHEN e.r >= 6 THEN 'accepted' WHEN e.r = rank THEN 'repeated' WHEN e.r < rank THEN 'backwards' WHEN plan = 'restore' AND e.r NOT IN (0, 1, 4) THEN 'off-plan' ELSE 'accepted' END AS verdict FROM f JOIN e ON e.job_id = f.job_id AND e.k = f.k + 1))
SELECT job_id, event, verdict, sequence, clock AS elapsed, CASE plan WHEN 'rebuild' THEN 6 WHEN 'restore' THEN 3 END::BIGINT AS total, before AS published_before FROM f WHERE k > 0""")
def lifecycle_check(spark, d):  # ST01, ST02, W12
    e = load(spark, d, "events")
    names = F.array(*[F.lit(s) for s in (*folds.STATES, *folds.TERMINAL)])
    events = e.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.element_at(names, (F.pmod(F.col("event_id"), F.lit(9)) + 1).cast("int")).alias("event"), F.round("value").cast("long").alias("elapsed"))
    return folds.job_lifecycle(events)


@query()
def residency_fold(spark, d):  # ST03, ST04, ST08: a session for each supplier; tests hold it against a plain loop
    chunk = F.col("l_partkey") % 60
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.xxhash64("l_orderkey", "l_partkey", "l_linenumber").alias("seq"), F.concat(F.lit("c"), chunk.cast("string")).alias("chunk"), (chunk * 1000 + 500).alias("decoded_bytes"), (chunk * 900 + 400).alias("gpu_bytes"), (F.col("l_partkey") % 10).alias("priority"), (chunk == 7).alias("pin"))
    return folds.residency(rows, 200_000, 180_000)


@query()
def scheduler_trace(spark, d):  # ST05: a session for each customer, a frame for each order
    w = F.struct(F.concat(F.lit("c"), (F.col("l_partkey") % 60).cast("string")).alias("chunk"), (F.col("l_partkey") % 60 * 1000 + 500).alias("decoded"), (F.col("l_partkey") % 60 * 900 + 400).alias("gpu"))
    frames = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(w)).alias("wanted"))
    owners = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return folds.scheduled(frames.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("session"), F.col("l_orderkey").alias("frame"), "wanted"), 200_000, 180_000)
