"""Analyzer payloads read to nodes, edges and counts of what was left out."""

from pyspark.sql import functions as F

from loomgrid.operators import payload
from loomgrid.plans.registry import query
from loomgrid.sources.corpus import view

_BAD = "case when node_id % 11 = 0 then '<empty>' else file end"
_M = f"m as (select 'cpg' || (node_id % 8) as ns, node_id as k, {_BAD} as file, 1 + node_id % 50 as line, full_name as fname, file as own from methods), src as (select distinct file as path from methods)"


def _payloads(spark, d):
    """JSON texts of at most a few hundred rows each, as an analyzer of each language writes them; one in some is cut short."""
    m = view(spark, d, "methods").selectExpr("concat('cpg', node_id % 8) as namespace", "node_id as k", f"{_BAD} as file", "1 + node_id % 50 as line", "name", "full_name", "file as own")
    piece = F.expr("k div 100")
    element = lambda n, owner: f"named_struct('nodeId', {n}, 'file', own, 'line', line, 'label', concat('v', {n}), 'ownerMethod', {owner})"
    own = m.groupBy("namespace", piece.alias("piece")).agg(
        F.collect_list(F.expr("named_struct('nodeId', k, 'file', file, 'line', line, 'name', name, 'fullName', full_name)")).alias("methods"),
        F.collect_list(F.expr("named_struct('methodId', k, 'file', file, 'nodes', transform(sequence(0, 2), i -> named_struct('i', i, 'nodeId', k * 10 + i, 'file', '', 'line', line + i, 'label', concat('s', i))), 'edges', array(named_struct('from', 0, 'to', 1), named_struct('from', 1, 'to', if(k % 13 = 0, 9, 2))))")).alias("cfg"),
        F.collect_list(F.expr("named_struct('nodeId', cast(k as string), 'file', own, 'line', line, 'code', if(k % 5 = 0, '<empty>', concat('import x', k)))")).alias("imports"),
        F.collect_list(F.expr(f"named_struct('source', {element('k', 'full_name')}, 'target', {element('k + 8', 'if(k % 2 = 0, full_name, name)')})")).alias("reachingDefs"),
        F.collect_list(F.expr(f"named_struct('methodId', k, 'sampled', true, 'elements', array({element('k', 'null')}, {element('k + 16', 'null')}, {element('k + 24', 'null')}))")).alias("dataflowPaths"),
        F.sum(F.expr("k % 3")).alias("callsWithoutOwner"),
    )
    s = view(spark, d, "sites")
    calls = s.groupBy("namespace", piece.alias("piece")).agg(F.collect_list(F.expr(
        "named_struct('nodeId', node, 'callerFile', path, 'callerId', if(node % 7 = 0, null, k), 'caller', caller, 'line', line, 'name', name, 'code', code, 'methodFullName', full, 'sourceCode', source_code, 'callees', array(named_struct('nodeId', 1, 'fullName', 'x', 'external', false, 'line', line)))")).alias("calls"))
    text = lambda df: F.to_json(F.struct(*(c for c in df.columns if c not in ("namespace", "piece"))))
    cut_ = F.when(F.col("piece") == 3, F.expr("substring(payload, 1, length(payload) - 2)")).otherwise(F.col("payload"))
    return own.select("namespace", text(own).alias("payload")).unionByName(calls.withColumn("macros", F.array(F.lit("MAX"))).select("namespace", "piece", text(calls.withColumn("macros", F.array(F.lit("MAX")))).alias("payload")).select("namespace", cut_.alias("payload")))


_C = "c as (select * replace (case when expected is null and s = 5 and k % 8 = 2 and (namespace, path, line) in (select (ns, own, line) from m where k % 5 <> 0) then 'import_statement' else expected end as expected) from sites where k // 100 <> 3)"
_NODES = f"""{_M}, {_C}, made as (select distinct namespace || '/caller/' || path || ':' || line || ':' || caller as id, 'function' as kind, path, line as start_line, caller as name, null::varchar as owner from c where node % 7 = 0 and expected is null),
 every as (
  select ns || '/method/' || k as id, case when contains(fname, '.') then 'method' else 'function' end as kind, file as path, line as start_line, fname as name, null::varchar as owner from m
  union all select * from made
  union all select ns || '/cfg/' || k || '/' || i, 'cfg_node', file, line + i, 's' || i, ns || '/method/' || k from m, range(3) t(i)
  union all select distinct 'file:' || own, 'file', own, null::bigint, regexp_extract(own, '[^/]+$'), null from m where k % 5 <> 0)"""


@query(f"with {_NODES} select id, kind, case when path in (select path from src) then path end as path, start_line, name, owner from every", "methods", "sites")
def payload_nodes(spark, d):
    """Nodes of all payloads but those of data flow, whose owners are many."""
    nodes, _, _ = payload.normalised(_payloads(spark, d), view(spark, d, "methods").select(F.col("file").alias("path")))
    return nodes.filter("kind <> 'dataflow_node'")


@query(
    f"""with {_M}, {_C}
    select namespace || '/call/' || node as id, case when node % 7 = 0 then namespace || '/caller/' || path || ':' || line || ':' || caller else namespace || '/method/' || k end as source, null::varchar as target, 'call' as kind, 'unresolved' as status, path, line, null::varchar as scope from c where expected is null
    union all select ns || '/cfgedge/' || k || '/0->1', ns || '/cfg/' || k || '/0', ns || '/cfg/' || k || '/1', 'cfg', 'resolved', file, null, null from m
    union all select ns || '/cfgedge/' || k || '/1->2', ns || '/cfg/' || k || '/1', ns || '/cfg/' || k || '/2', 'cfg', 'resolved', file, null, null from m where k % 13 <> 0
    union all select ns || '/import/' || k, 'file:' || own, null, 'import', 'unresolved', own, line, null from m where k % 5 <> 0
    union all select ns || '/rd/' || k || '->' || (k + 8), ns || '/dfn/' || k, ns || '/dfn/' || (k + 8), 'dataflow', 'resolved', own, null, case when k % 2 = 0 then 'reaching_def_intra' else 'reaching_def_inter' end from m
    union all select ns || '/vfp/' || k || '/1', ns || '/dfn/' || k, ns || '/dfn/' || (k + 16), 'dataflow', 'resolved', own, null, 'value_flow_path' from m
    union all select ns || '/vfp/' || k || '/2', ns || '/dfn/' || (k + 16), ns || '/dfn/' || (k + 24), 'dataflow', 'resolved', own, null, 'value_flow_path' from m""",
    "methods", "sites",
)
def payload_edges(spark, d):
    """Edges of all payloads, before calls and imports are resolved."""
    return payload.normalised(_payloads(spark, d), view(spark, d, "methods").select(F.col("file").alias("path")))[1]


@query(
    f"""with {_M}, {_C}
    select namespace, 'call:' || expected as what, count(*) as count from c where expected <> 'operator' group by all
    union all select ns, 'unknown_node_location', sum(case when file = '<empty>' then 4 else 0 end)::bigint from m group by ns having sum(case when file = '<empty>' then 1 else 0 end) > 0
    union all select ns, 'cfg_edge_without_node', count(*) from m where k % 13 = 0 group by ns union all select ns, 'calls_without_owner', sum(k % 3)::bigint from m group by ns having sum(k % 3) > 0
    union all select namespace, 'unreadable', 1 from (select distinct namespace from sites where k // 100 = 3)""",
    "methods", "sites",
)
def payload_omitted(spark, d):
    """What all payloads left out, by kind."""
    return payload.normalised(_payloads(spark, d), view(spark, d, "methods").select(F.col("file").alias("path")))[2]


@query("select node, k, line, path, expected as reason from sites", "sites")
def call_reasons(spark, d):
    """Why each call site of eight languages is no call."""
    rows = view(spark, d, "sites").withColumn("dispatch", F.lit(None).cast("string")).withColumn("callees", F.array(F.struct(F.lit(1).cast("long").alias("nodeId"), F.lit("x").alias("fullName"), F.lit(False).alias("external"), F.col("line").cast("long").alias("line"))))
    none = lambda ddl: spark.createDataFrame([], ddl)
    macros = rows.select("namespace").distinct().withColumn("name", F.lit("MAX"))
    found = payload.reasons(rows, none("namespace string, path string, line long"), none("namespace string, name string, full string, file string"), macros)
    return found.select("node", "k", "line", "path", "reason")
