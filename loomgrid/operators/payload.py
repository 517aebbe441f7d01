"""Analyzer payloads to a graph: nodes, edges and what was left out.

A payload is a JSON text with lists of methods, calls, control flow, imports, reaching
definitions and value-flow paths, numbered by the analyzer. It is read by schema, each
list is exploded to rows where the text is, and ids are made of the payload's name
and the analyzer's number, so that payloads never share an id. Everything after that
is a union of row-wise projections; of several rows of one node the first kind wins.

Defined results: a text that is no JSON gives no rows and is counted as unreadable; a
missing list is empty. A node's path is one of the known files or none; calls that
are no calls, flow edges between unknown nodes and calls without an owner are left
out and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.rounds import stored
from loomgrid.operators.scan import LANGUAGES, canonical_path, suffix

_ELEMENT = "struct<nodeId:bigint,file:string,line:bigint,label:string,ownerMethod:string>"
_CALLEE = "struct<nodeId:bigint,fullName:string,external:boolean,line:bigint>"
SCHEMA = (
    "methods array<struct<nodeId:bigint,file:string,line:bigint,name:string,fullName:string>>, "
    f"calls array<struct<nodeId:bigint,callerFile:string,callerId:bigint,caller:string,line:bigint,column:bigint,name:string,code:string,methodFullName:string,dispatchType:string,sourceCode:string,callees:array<{_CALLEE}>>>, "
    "cfg array<struct<methodId:bigint,file:string,nodes:array<struct<i:bigint,nodeId:bigint,file:string,line:bigint,label:string>>,edges:array<struct<`from`:bigint,`to`:bigint>>>>, "
    "imports array<struct<nodeId:string,file:string,line:bigint,code:string>>, types array<struct<fullName:string,name:string,file:string,inherits:array<string>>>, "
    f"reachingDefs array<struct<source:{_ELEMENT},target:{_ELEMENT}>>, dataflowPaths array<struct<methodId:bigint,sampled:boolean,elements:array<{_ELEMENT}>>>, callsWithoutOwner bigint, macros array<string>, _bad string"
)
#: Types of Go and C++ whose calls convert, and names that an analyzer makes up.
GO_TYPES = ["string", "bool", "byte", "rune", "error", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "float32", "float64", "complex64", "complex128"]
CPP_TYPES = ["bool", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "wchar_t", "char8_t", "char16_t", "char32_t"]
SYNTHETIC = r"^(?:<operators?>|__ecma\.|_?tmp\d+\.)"
_C, _CPP = r"\.(c|h|cc|cpp|cxx|hpp|hh)$", r"\.(cc|cpp|cxx|h|hpp|hh)$"
_SCRIPT = r"\.(js|jsx|ts|tsx|mjs|cjs|mts|cts)$"


def read(payloads: DataFrame) -> DataFrame:
    """namespace and the lists of each payload (namespace, payload)."""
    return payloads.select("namespace", F.from_json("payload", SCHEMA, {"columnNameOfCorruptRecord": "_bad"}).alias("p")).select("namespace", "p.*")


def _each(read_: DataFrame, name: str) -> DataFrame:
    return read_.select("namespace", F.posexplode(name).alias("place", "x")).select("namespace", "place", "x.*")


def reasons(calls: DataFrame, imports: DataFrame, types: DataFrame, macros: DataFrame) -> DataFrame:
    """The calls with `reason`, why one is no call of the source: operator, synthetic, macro, type_conversion, literal, import_statement; null for calls.

    calls: namespace, name, code, full, path, caller, line, dispatch, source_code and callees; imports: namespace, path, line;
    types: namespace, name, full, file; macros: namespace, name.
    """
    on_line = imports.select("namespace", "path", "line", F.lit(True).alias("_import")).distinct()
    typed = types.select("namespace", "name", "full", F.lit(True).alias("_typed")).distinct()
    begun = types.filter(F.endswith("file", F.lit(".go"))).select("namespace", F.concat("full", F.lit(".<init>")).alias("full"), F.lit(True).alias("_go_type")).distinct()
    macro = macros.select("namespace", "name", F.lit(True).alias("_macro")).distinct()
    rows = calls.join(on_line, ["namespace", "path", "line"], "left").join(typed, ["namespace", "name", "full"], "left").join(begun, ["namespace", "full"], "left").join(macro, ["namespace", "name"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name, code, full, path, caller, source = (text(c) for c in ("name", "code", "full", "path", "caller", "source_code"))
    braces = F.contains(code, F.lit("{")) & F.contains(code, F.lit("}"))
    script, python, go, ruby = path.rlike(_SCRIPT), F.endswith(path, F.lit(".py")), F.endswith(path, F.lit(".go")), F.endswith(path, F.lit(".rb"))
    first = F.get("callees", F.lit(0))
    module = F.endswith(caller, F.lit(":<module>")) | F.contains(caller, F.lit("<metaClassAdapter>"))
    declared = module & (F.size("callees") == 1) & ~F.coalesce(first["external"], F.lit(False)) & first["line"].eqNullSafe(F.col("line")) & code.rlike(r"(?U)^[A-Za-z_]\w*\([^)]*\)$")
    made = F.contains(code, F.lit("<fakeNew>")) | F.contains(code, F.lit("__newInstance.__init__")) | F.startswith(code, F.lit("def <body>")) | code.rlike(r"^enter_tmp\d+\(\)$") | (code == "__exit__()")
    reason = (
        F.when(F.startswith(name, F.lit("<operator>")) | F.startswith(name, F.lit("<operators>")), "operator")
        .when(name.rlike(SYNTHETIC) | F.startswith(full, F.lit("ANY.ANY:")), "synthetic")
        .when(path.rlike(_C) & (F.col("dispatch").eqNullSafe("INLINED") | F.col("_macro").isNotNull()), "macro")
        .when(path.rlike(_CPP) & name.isin(CPP_TYPES) & F.startswith(full, F.concat(name, F.lit("."), name, F.lit(":"))), "type_conversion")
        .when(path.rlike(_CPP) & F.startswith(full, F.lit("struct.struct:")) & braces, "literal")
        .when(script & (name == "require") & (F.col("_import").isNotNull() | source.rlike(r"^(?:import|export)\b[\s\S]*\bfrom\b")), "import_statement")
        .when(script & (code.rlike(r"^_iterator_\d+\.next\(\)$") | code.rlike(r"^_tmp_\d+\.push\(.*\)$")), "synthetic")
        .when(python & (made | ((full == "<unknownFullName>") & name.isin("__iter__", "__next__")) | declared), "synthetic")
        .when((name == "") & F.endswith(full, F.lit(".")) & code.rlike(r"^(?:\[\])?(?:string|bool|byte|rune|error|int(?:8|16|32|64)?|uint(?:8|16|32|64)?|uintptr|float(?:32|64)|complex(?:64|128))\("), "type_conversion")
        .when((go | F.col("_go_type").isNotNull()) & F.endswith(full, F.lit(".<init>")) & braces, "literal")
        .when(ruby & (full == "<unknownFullName>") & F.startswith(code, F.lit("defined?(")), "synthetic")
        .when(ruby & (full == "__core.Array.initialize") & (F.startswith(code, F.lit("%w[")) | (F.startswith(code, F.lit("[")) & F.endswith(code, F.lit("]")))), "literal")
        .when(go & (name.isin(GO_TYPES) | ((name == "") & F.endswith(full, F.lit("."))) | F.col("_typed").isNotNull()), "type_conversion")
        .when(name == "<body>", "synthetic")
    )
    return rows.withColumn("reason", reason).drop("_import", "_typed", "_go_type", "_macro")


def _id(kind: str, *parts: Column) -> Column:
    return F.concat(F.col("namespace"), F.lit(f"/{kind}/"), *(p.cast("string") for p in parts))


def normalised(payloads: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (id, kind, path, start_line, name, owner), edges (id, source, target, kind, status, path, line, scope) and omitted (namespace, what, count).

    payloads: namespace, payload; files: path. Calls and imports are unresolved: their resolvers take them from here.
    """
    # texts are read once, not once a list
    p = stored(read(payloads))
    path = lambda c: canonical_path(F.coalesce(c, F.lit("")))
    none = F.lit(None).cast("string")
    methods = _each(p, "methods").select("namespace", F.when(F.col("nodeId").isNotNull(), _id("method", F.col("nodeId"))).otherwise(_id("method", F.coalesce(path(F.col("file")), F.lit("None")), F.lit(":"), F.coalesce("line", F.lit(-1)), F.lit(":"), F.coalesce("fullName", F.lit("")))).alias("id"), F.col("nodeId").alias("native"), path(F.col("file")).alias("path"), "line", F.coalesce(F.nullif("fullName", F.lit("")), "name", F.lit("")).alias("full"), "place")
    known = methods.filter("native is not null").select("namespace", F.col("native").alias("callerId"), F.col("id").alias("_caller")).distinct()
    imports = _each(p, "imports").filter("file <> '' and code not in ('', '<empty>')")
    raw = _each(p, "calls").select("namespace", "place", "nodeId", "callerId", F.col("callerFile").alias("path"), "caller", "line", "name", "code", F.col("methodFullName").alias("full"), F.col("dispatchType").alias("dispatch"), F.col("sourceCode").alias("source_code"), F.coalesce("callees", F.array().cast(f"array<{_CALLEE}>")).alias("callees"))
    types = _each(p, "types").select("namespace", "name", F.col("fullName").alias("full"), F.coalesce("file", F.lit("")).alias("file"))
    macros = p.select("namespace", F.explode("macros").alias("name"))
    judged = reasons(raw, imports.select("namespace", F.col("file").alias("path"), "line"), types, macros)
    calls = judged.filter("reason is null").join(known, ["namespace", "callerId"], "left")
    made = _id("caller", F.coalesce(path(F.col("path")), F.lit("None")), F.lit(":"), F.coalesce("line", F.lit(-1)), F.lit(":"), F.coalesce("caller", F.lit("")))
    calls = calls.select("namespace", "nodeId", F.coalesce("_caller", made).alias("source"), F.col("_caller").isNull().alias("_made"), path(F.col("path")).alias("path"), "line", "caller", "place")

    cfg = _each(p, "cfg").withColumnRenamed("file", "_file")
    owner = cfg.join(known.withColumnRenamed("callerId", "methodId").withColumnRenamed("_caller", "owner"), ["namespace", "methodId"], "left")
    steps = owner.select("namespace", "methodId", "owner", "_file", F.explode("nodes").alias("n")).select("namespace", "methodId", "owner", F.col("n.i").alias("i"), F.coalesce(path(F.col("n.file")), path(F.col("_file"))).alias("path"), F.col("n.line").alias("line"), F.col("n.label").alias("label"))
    step = lambda i: _id("cfg", F.col("methodId"), F.lit("/"), F.coalesce(i.cast("string"), F.lit("None")))
    jumps = owner.select("namespace", "methodId", "_file", F.transform("nodes", lambda n: n["i"]).alias("_known"), F.explode("edges").alias("e")).select("namespace", "methodId", "_file", F.col("e.from").alias("a"), F.col("e.to").alias("b"), (F.array_contains("_known", F.col("e.from")) & F.array_contains("_known", F.col("e.to"))).alias("ok"))

    defs = _each(p, "reachingDefs")
    ways = _each(p, "dataflowPaths")
    legs = ways.select("namespace", "methodId", "sampled", F.posexplode("elements").alias("at", "e"), F.col("elements"))
    flows = defs.select("namespace", F.explode(F.array("source", "target")).alias("e")).unionByName(legs.select("namespace", "e"))
    flow = lambda e: _id("dfn", F.coalesce(F.col(f"{e}.nodeId").cast("string"), F.lit("None")))

    def nodes_of(rows: DataFrame, rank: int, id: Column, kind: Column | str, at: Column, line: Column, name: Column, own: Column = none) -> DataFrame:
        return rows.select("namespace", F.lit(rank).alias("_rank"), id.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), at.alias("path"), line.cast("long").alias("start_line"), name.alias("name"), own.alias("owner"))

    nodes = nodes_of(methods, 0, F.col("id"), F.when(F.contains("full", F.lit(".")), "method").otherwise("function"), F.col("path"), F.col("line"), F.col("full"))
    nodes = nodes.unionByName(nodes_of(calls.filter("_made"), 1, F.col("source"), "function", F.col("path"), F.col("line"), F.col("caller")))
    nodes = nodes.unionByName(nodes_of(steps, 2, step(F.col("i")), "cfg_node", F.col("path"), F.col("line"), F.col("label"), F.col("owner")))
    own_files = imports.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    nodes = nodes.unionByName(nodes_of(own_files, 3, F.concat(F.lit("file:"), "file"), "file", F.col("file"), F.lit(None), F.regexp_extract("file", "[^/]+$", 0)))
    nodes = nodes.unionByName(nodes_of(flows, 4, flow("e"), "dataflow_node", path(F.col("e.file")), F.col("e.line"), F.col("e.label"), F.col("e.ownerMethod")))
    # of several rows of one id the first kind, then its least content
    order = F.struct("_rank", "kind", F.coalesce("path", F.lit("")), F.coalesce("start_line", F.lit(-1)), F.coalesce("name", F.lit("")))
    once = nodes.groupBy("id").agg(F.min_by(F.struct("namespace", "kind", "path", "start_line", "name", "owner"), order).alias("n")).select("id", "n.*")
    sources = files.select("path", F.lit(True).alias("_source")).filter(suffix(F.col("path")).isin([s for s, _ in LANGUAGES])).distinct()
    placed = once.join(sources, "path", "left")
    lost = placed.filter("path is not null and _source is null")
    nodes = placed.select("id", "kind", F.when(F.col("_source"), F.col("path")).alias("path"), "start_line", "name", "owner")

    def edges_of(rows: DataFrame, id: Column, source: Column, target: Column, kind: str, status: str, at: Column, line: Column, scope: Column = none) -> DataFrame:
        return rows.select(id.alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), at.alias("path"), line.cast("long").alias("line"), scope.alias("scope"))

    edges = edges_of(calls, _id("call", F.col("nodeId")), F.col("source"), none, "call", "unresolved", F.col("path"), F.col("line"))
    edges = edges.unionByName(edges_of(jumps.filter("ok"), F.concat(_id("cfgedge", F.col("methodId")), F.lit("/"), F.col("a").cast("string"), F.lit("->"), F.col("b").cast("string")), step(F.col("a")), step(F.col("b")), "cfg", "resolved", path(F.col("_file")), F.lit(None)))
    file_node = imports.join(own_files.select("file", F.lit(True).alias("_own")).distinct(), "file", "left")
    edges = edges.unionByName(edges_of(file_node, _id("import", F.col("nodeId")), F.when(F.col("_own"), F.concat(F.lit("file:"), "file")), none, "import", "unresolved", path(F.col("file")), F.col("line")))
    same = F.coalesce((F.col("source.ownerMethod") != "") & (F.col("source.ownerMethod") == F.col("target.ownerMethod")), F.lit(False))
    edges = edges.unionByName(edges_of(defs, F.concat(_id("rd", F.col("source.nodeId")), F.lit("->"), F.col("target.nodeId").cast("string")), flow("source"), flow("target"), "dataflow", "resolved", path(F.col("source.file")), F.lit(None), F.when(same, "reaching_def_intra").otherwise("reaching_def_inter")))
    next_ = legs.filter("at > 0").withColumn("before", F.get("elements", F.col("at") - 1))
    edges = edges.unionByName(edges_of(next_, _id("vfp", F.col("methodId"), F.lit("/"), F.col("at")), flow("before"), flow("e"), "dataflow", "resolved", path(F.col("e.file")), F.lit(None), F.lit("value_flow_path")))

    def count(rows: DataFrame, what: Column | str) -> DataFrame:
        return rows.groupBy("namespace", (F.lit(what) if isinstance(what, str) else what).alias("what")).agg(F.count("*").alias("count"))

    omitted = count(judged.filter("reason <> 'operator'"), F.concat(F.lit("call:"), "reason")).unionByName(count(lost, "unknown_node_location")).unionByName(count(jumps.filter("not ok"), "cfg_edge_without_node"))
    omitted = omitted.unionByName(p.filter("callsWithoutOwner > 0").groupBy("namespace").agg(F.lit("calls_without_owner").alias("what"), F.sum("callsWithoutOwner").alias("count")).select("namespace", "what", "count"))
    return nodes, edges, omitted.unionByName(count(p.filter("_bad is not null"), "unreadable"))
