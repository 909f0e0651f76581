"""Queries that run the engine's own operators over a code model bound to the star schema.

A nation is a package, a customer a file, an order a symbol with a scope of its own, a lineitem a statement in it and a call to the
symbol that its part's number names. Customers with a negative balance have no file entity; a low-priority order with status P is
a compile error of its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import incremental, labels, layout, tree, validate, view
from terrane.plans.tables import table
from terrane.sources import model as models
from terrane.sources.model import Model

S = F.col


def _range(file: Column, a: Column, b: Column) -> Column:
    return F.struct(file.alias("file"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"))


def code_model(spark, sf_dir) -> Model:
    t = lambda name: table(spark, sf_dir, name)
    text = lambda prefix, c: F.concat(F.lit(prefix), S(c).cast("string"))
    customer, nothing, false = t("customer"), F.lit(""), F.lit(False)
    files = customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(text("c", "c_custkey"))).alias("files"))
    packages = t("nation").join(files, S("n_nationkey") == S("c_nationkey")).select(text("p", "n_nationkey").alias("id"), S("n_name").alias("name"), text("d", "n_nationkey").alias("dir"), "files")
    kind = F.when(S("o_orderstatus") == "F", "function").when(S("o_orderstatus") == "O", "method").otherwise("variable")
    first = S("o_orderkey") % 997 * 10 + 2
    o = t("orders").join(customer.select("c_custkey", "c_nationkey"), S("o_custkey") == S("c_custkey"))
    o = o.select("o_orderkey", "o_orderpriority", "o_orderstatus", kind.alias("kind"), text("O", "o_orderkey").alias("name"), text("p", "c_nationkey").alias("package"), text("c", "o_custkey").alias("file"), first.alias("s"))
    source = _range(S("file"), S("s"), S("s") + 9)
    exported = S("o_orderpriority").isin("1-URGENT", "2-HIGH")
    symbols = o.select(text("o", "o_orderkey").alias("id"), "kind", "name", "package", source.alias("source"), F.lit("").alias("signature"), exported.alias("is_exported"), false.alias("is_async"))
    l = t("lineitem").join(o.select("o_orderkey", "file", "s"), S("l_orderkey") == S("o_orderkey"))
    at = _range(S("file"), S("s") + S("l_linenumber"), S("s") + S("l_linenumber"))
    calls = l.select(text("o", "l_orderkey").alias("from"), text("o", "l_partkey").alias("to"), at.alias("source"))
    n = S("l_linenumber")
    what = F.when(n == 1, "if").when(n == 2, "call").when(n == 3, "loop").when(n == 4, "return").when(n == 5, "else").otherwise("expression")
    word = F.when(n == 2, text("O", "l_partkey")).when(n == 3, F.when(S("l_suppkey") % 2 == 0, "range").otherwise("for")).otherwise("")
    condition = F.when(n.isin(1, 3, 4) & (S("l_quantity") > 25), "q > 25").otherwise("")
    lid = F.concat_ws(":", text("l", "l_orderkey"), n.cast("string"), S("l_partkey").cast("string"), S("l_suppkey").cast("string"), S("l_quantity").cast("long").cast("string"))
    kids = F.array().cast("array<string>")

    def entity(df, eid, k, name, symbol, callee, cond, coverage, src, parent):
        return df.select(eid.alias("id"), k.alias("kind"), name.alias("name"), nothing.alias("label"), symbol.alias("symbol"), callee.alias("callee"), cond.alias("condition"), nothing.alias("code"), F.lit(coverage).alias("coverage"), src.alias("source"), parent.alias("parent_id"), kids.alias("children"))

    file = text("c", "c_custkey")
    entities = entity(customer.filter("c_acctbal >= 0"), F.concat(F.lit("file:"), file), F.lit("file"), file, nothing, nothing, nothing, False, _range(file, F.lit(1), F.lit(10000)), nothing)
    entities = entities.unionByName(entity(o, text("f", "o_orderkey"), S("kind"), S("name"), text("o", "o_orderkey"), nothing, nothing, False, source, F.concat(F.lit("file:"), "file")))
    entities = entities.unionByName(entity(l, lid, what, word, nothing, F.when(n == 2, text("o", "l_partkey")).otherwise(""), condition, True, at, text("f", "l_orderkey")))
    effects = l.filter("l_returnflag = 'R'").select(text("o", "l_orderkey").alias("symbol"), F.lit("log").alias("kind"), F.lit("x").alias("detail"), at.alias("source"))
    errors = o.filter("o_orderstatus = 'P' and o_orderpriority = '5-LOW'").select("file", F.concat(F.lit("bad "), "name").alias("message"), S("s").cast("int").alias("start_line"), (S("s") + 9).cast("int").alias("end_line"))
    return Model(packages, symbols, calls, effects, entities, errors)


def _files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), S("c_custkey").cast("string")).alias("path"))


#: The same relations in SQL: symbols sym, calls, statements st, tree rows of all files nodes.
MODEL_SQL = """
sym AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'function' WHEN 'O' THEN 'method' ELSE 'variable' END AS kind, 'O' || o_orderkey AS name, 'p' || c_nationkey AS package,
  'c' || o_custkey AS file, CAST(o_orderkey % 997 * 10 + 2 AS INTEGER) AS s, CAST(o_orderkey % 997 * 10 + 11 AS INTEGER) AS e, o_orderpriority IN ('1-URGENT', '2-HIGH') AS ex, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
calls AS (SELECT 'o' || l_orderkey AS f, 'o' || l_partkey AS t, file, s + l_linenumber AS line FROM lineitem JOIN sym ON l_orderkey = k),
st AS (SELECT 'l' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || CAST(l_quantity AS BIGINT) AS id, 'f' || l_orderkey AS parent, file, s + l_linenumber AS line, l_linenumber AS n, 'o' || l_partkey AS callee, 'O' || l_partkey AS cname,
  CASE WHEN l_suppkey % 2 = 0 THEN 'range' ELSE 'for' END AS word, CASE WHEN l_linenumber IN (1, 3, 4) AND l_quantity > 25 THEN 'q > 25' ELSE '' END AS cond FROM lineitem JOIN sym ON l_orderkey = k),
fnode AS (SELECT file AS report, 'f' || k AS id, 'file:' || file AS parent_id, row_number() OVER (PARTITION BY file ORDER BY s, 'f' || k) AS ord, kind, name, id AS symbol, s, e FROM sym),
snode AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY line, id) AS ord, CASE n WHEN 1 THEN trim('if ' || cond) WHEN 2 THEN 'Вызов ' || cname WHEN 3 THEN CASE WHEN cond = '' THEN word ELSE word || ' ' || cond END WHEN 4 THEN trim('return ' || cond) WHEN 5 THEN 'else' ELSE 'expression' END AS label,
  CASE n WHEN 1 THEN 'decision' WHEN 2 THEN 'call' WHEN 3 THEN 'loop' WHEN 4 THEN 'output' WHEN 5 THEN 'decision' ELSE 'action' END AS nkind, CASE n WHEN 2 THEN 'calls' WHEN 4 THEN 'data' ELSE 'flow' END AS nlayer FROM st),
stmts AS (SELECT f.report, x.id, x.parent AS parent_id, x.ord, f.ord AS ford, x.nkind AS kind, x.label, x.nlayer AS layer, x.file, x.line, CASE WHEN n = 2 THEN callee END AS symbol, CASE WHEN n = 2 THEN '→ ' || callee WHEN cond <> '' THEN cond END AS summary FROM snode x JOIN fnode f ON x.parent = f.id),
nodes AS (
  SELECT 'c' || c_custkey AS report, 'file:c' || c_custkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 1 AS ord, 0 AS depth, '00000001' AS path, 'group' AS kind, 'c' || c_custkey AS label, 'flow' AS layer, 'c' || c_custkey AS file, 1 AS start_line,
    CASE WHEN c_acctbal >= 0 THEN 10000 ELSE 1 END AS end_line, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS summary, '' AS coverage FROM customer
  UNION ALL SELECT report, id, parent_id, CAST(ord AS INTEGER), 1, '00000001/' || lpad(CAST(ord AS VARCHAR), 8, '0'), CASE kind WHEN 'variable' THEN 'state' ELSE 'group' END, CASE kind WHEN 'variable' THEN 'Переменная ' ELSE 'Функция ' END || name, CASE kind WHEN 'variable' THEN 'state' ELSE 'flow' END, report, s, e, symbol, NULL, '' FROM fnode
  UNION ALL SELECT report, id, parent_id, CAST(ord AS INTEGER), 2, '00000001/' || lpad(CAST(ford AS VARCHAR), 8, '0') || '/' || lpad(CAST(ord AS VARCHAR), 8, '0'), kind, label, layer, file, line, line, symbol, summary, id FROM stmts)"""
_WITH = f"WITH RECURSIVE {MODEL_SQL}"

_SHOWN = ["report", "id", "parent_id", "ord", "depth", "path", "kind", "label", "layer", "file", "start_line", "end_line", "symbol", "summary"]


def _nodes(spark, sf_dir) -> DataFrame:
    return tree.file_reports(code_model(spark, sf_dir), _files(spark, sf_dir))


def file_scopes(spark, sf_dir):
    """Every node of every file's report."""
    return _nodes(spark, sf_dir).select(*_SHOWN, F.array_join("coverage_ids", ",").alias("coverage"))


FILE_SQL = f"{_WITH} SELECT * FROM nodes"


def function_scopes(spark, sf_dir):
    """Every node of every symbol's report; a symbol without a function entity stands for itself."""
    m = code_model(spark, sf_dir)
    return tree.function_reports(m, m.symbols.select("id")).select(*_SHOWN)


FUNCTION_SQL = f"""{_WITH}
SELECT id AS report, CASE kind WHEN 'variable' THEN 'func:' || id ELSE 'f' || k END AS id, CAST(NULL AS VARCHAR) AS parent_id, 1 AS ord, 0 AS depth, '00000001' AS path, 'group' AS kind, 'Функция ' || name AS label, 'flow' AS layer, file, s AS start_line, e AS end_line, id AS symbol, CAST(NULL AS VARCHAR) AS summary FROM sym
UNION ALL SELECT sym.id, x.id, x.parent_id, CAST(x.ord AS INTEGER), 1, '00000001/' || lpad(CAST(x.ord AS VARCHAR), 8, '0'), x.kind, x.label, x.layer, x.file, x.line, x.line, x.symbol, x.summary FROM stmts x JOIN sym ON x.parent_id = 'f' || sym.k WHERE sym.kind <> 'variable'"""


def package_map(spark, sf_dir):
    """Package > file > symbol of all exported symbols."""
    return tree.project_map(code_model(spark, sf_dir)).select("id", "parent_id", "ord", "depth", "path", "kind", "label", "file", "start_line", "end_line", "symbol")


MAP_SQL = f"""{_WITH},
x AS (SELECT * FROM sym WHERE ex),
p AS (SELECT *, row_number() OVER (ORDER BY id) AS ord FROM (SELECT DISTINCT package AS id, n_name FROM x JOIN nation ON package = 'p' || n_nationkey)),
f AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY 'file:' || file) AS ord FROM (SELECT DISTINCT package, file FROM x)),
v AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id) AS ord FROM x)
SELECT id, CAST(NULL AS VARCHAR) AS parent_id, CAST(ord AS INTEGER) AS ord, 0 AS depth, lpad(CAST(ord AS VARCHAR), 8, '0') AS path, 'group' AS kind, n_name AS label, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line, CAST(NULL AS VARCHAR) AS symbol FROM p
UNION ALL SELECT 'file:' || file, package, CAST(f.ord AS INTEGER), 1, lpad(CAST(p.ord AS VARCHAR), 8, '0') || '/' || lpad(CAST(f.ord AS VARCHAR), 8, '0'), 'group', file, file, 1, 1, NULL FROM f JOIN p ON package = p.id
UNION ALL SELECT v.id, 'file:' || v.file, CAST(v.ord AS INTEGER), 2, lpad(CAST(p.ord AS VARCHAR), 8, '0') || '/' || lpad(CAST(f.ord AS VARCHAR), 8, '0') || '/' || lpad(CAST(v.ord AS VARCHAR), 8, '0'), CASE v.kind WHEN 'variable' THEN 'action' ELSE 'group' END, v.name, v.file, v.s, v.e, v.id
FROM v JOIN f USING (package, file) JOIN p ON v.package = p.id"""


def references(spark, sf_dir):
    """The cross references of every node, in call order."""
    refs = tree.cross_refs(_nodes(spark, sf_dir), code_model(spark, sf_dir))
    return refs.select("report", "id", F.array_join(F.transform("cross_refs", lambda r: F.concat_ws("|", r["id"], r["file"], r["label"])), ";").alias("refs"))


REFERENCES_SQL = f"""{_WITH}
SELECT n.report, n.id, sym.id || '|' || sym.file || '|→ ' || sym.name || ' in ' || sym.file AS refs FROM nodes n JOIN sym ON n.symbol = sym.id WHERE n.kind = 'call'
UNION ALL SELECT n.report, n.id, string_agg(sym.id || '|' || sym.file || '|← ' || sym.name || ' in ' || sym.file, ';' ORDER BY c.f, c.file, c.line) FROM nodes n JOIN calls c ON n.symbol = c.t JOIN sym ON c.f = sym.id WHERE n.kind <> 'call' GROUP BY 1, 2"""


def _moved(nodes: DataFrame) -> DataFrame:
    """Nodes with lines that are off by a little."""
    off = (F.length("id") % 4).cast("int")
    return nodes.withColumn("start_line", F.when(S("depth") == 2, S("start_line") + off).otherwise(S("start_line"))).withColumn("end_line", F.when(S("depth") == 2, S("end_line") - off).otherwise(S("end_line")))


def snapped_ranges(spark, sf_dir):
    """Lines snapped to the symbol or to the nearest call, then clamped."""
    return validate.snapped(_moved(_nodes(spark, sf_dir)), code_model(spark, sf_dir)).select("report", "id", "start_line", "end_line")


_SNAPPED = """
mv AS (SELECT * REPLACE (CASE WHEN depth = 2 THEN start_line + length(id) % 4 ELSE start_line END AS start_line, CASE WHEN depth = 2 THEN end_line - length(id) % 4 ELSE end_line END AS end_line) FROM nodes),
lastline AS (SELECT file, max(e) AS m FROM sym GROUP BY 1),
own AS (SELECT mv.*, sym.s AS ss, sym.e AS se, m FROM mv LEFT JOIN sym ON mv.symbol = sym.id AND mv.file = sym.file LEFT JOIN lastline ON mv.file = lastline.file),
near AS (SELECT report, id, line FROM (SELECT o.report, o.id, c.line, row_number() OVER (PARTITION BY o.report, o.id ORDER BY abs((start_line + end_line) // 2 - c.line), c.f, c.line, c.t) AS r FROM own o JOIN calls c ON o.file = c.file AND abs((start_line + end_line) // 2 - c.line) <= 5 WHERE ss IS NULL AND kind IN ('call', 'action', 'error', 'async')) WHERE r = 1),
cut AS (SELECT o.*, least(greatest(coalesce(ss, line, start_line), 1), coalesce(m, 1)) AS a, least(greatest(coalesce(se, line, end_line), 1), coalesce(m, 1)) AS b FROM own o LEFT JOIN near USING (report, id))"""
SNAPPED_SQL = f"{_WITH}, {_SNAPPED} SELECT report, id, CAST(least(a, b) AS INTEGER) AS start_line, CAST(greatest(a, b) AS INTEGER) AS end_line FROM cut"


def symbols_cleared(spark, sf_dir):
    """Symbols of nodes that the model does not have are cleared."""
    return validate.known_symbols(_nodes(spark, sf_dir), code_model(spark, sf_dir)).select("report", "id", "symbol")


CLEARED_SQL = f"{_WITH} SELECT n.report, n.id, sym.id AS symbol FROM nodes n LEFT JOIN sym ON n.symbol = sym.id"


def _faulty(nodes: DataFrame) -> DataFrame:
    """Reports with faults of each kind: no label, no summary, units lost, twice there or unknown."""
    tail = F.substring("id", -1, 1)
    units = F.when((S("depth") == 2) & (tail == "3"), F.array().cast("array<string>")).when((S("depth") == 2) & (tail == "5"), F.array("id", "id"))
    units = units.when((S("depth") == 1) & (tail == "7"), F.array(F.concat(F.lit("x"), "id"))).otherwise(S("coverage_ids"))
    label = F.when((S("depth") == 1) & S("id").endswith("77"), "").otherwise(S("label"))
    kind = F.when((S("depth") == 1) & S("id").endswith("88"), "odd").otherwise(S("kind"))
    return nodes.withColumn("coverage_ids", units).withColumn("label", label).withColumn("kind", kind).withColumn("summary", F.when(tail == "9", " ").otherwise("ok"))


def validation_texts(spark, sf_dir):
    """All faults of each report in one text; a report that breaks the schema shows those faults only."""
    nodes = _faulty(_nodes(spark, sf_dir)).withColumn("element_type", F.when(S("depth") == 1, F.concat(F.lit("t"), F.substring("id", -1, 1))))
    nodes = nodes.withColumn("branches", F.when(S("kind") == "decision", F.array(F.struct(F.lit("yes").alias("condition"), F.concat("id", F.when(S("id").endswith("1"), "?").otherwise("")).alias("target")))))
    palette = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), S("n_nationkey").cast("string")).alias("type")).filter("type <> 't6'")
    edges = view.structural_edges(nodes).withColumn("to", F.when(S("to").endswith("44"), F.concat("to", F.lit("?"))).otherwise(S("to")))
    errors = validate.validate(nodes, code_model(spark, sf_dir), "file", palette, edges)[1]
    return validate.error_texts(errors)


VALIDATION_SQL = f"""{_WITH},
bad AS (SELECT *, right(id, 1) AS tail FROM nodes),
schema_faults AS (SELECT report, 'schema: node ''' || id || ''': label must not be empty' AS message FROM bad WHERE depth = 1 AND ends_with(id, '77')
  UNION ALL SELECT report, 'schema: node ''' || id || ''': kind is unknown' FROM bad WHERE depth = 1 AND ends_with(id, '88')),
sound AS (SELECT * FROM bad WHERE report NOT IN (SELECT report FROM schema_faults)),
roots AS (SELECT DISTINCT report FROM sound),
want AS (SELECT st.file AS report, st.id FROM st JOIN roots ON st.file = report),
have AS (SELECT report, unit AS id, count(*) AS n FROM (SELECT report, id AS unit FROM sound WHERE depth = 2 AND tail <> '3' UNION ALL SELECT report, id FROM sound WHERE depth = 2 AND tail = '5' UNION ALL SELECT report, 'x' || id FROM sound WHERE depth = 1 AND tail = '7') GROUP BY 1, 2),
messages AS (
  FROM schema_faults
  UNION ALL SELECT report, 'node ''' || id || ''' references unknown file ''' || file || '''' FROM sound WHERE file NOT IN (SELECT file FROM sym)
  UNION ALL SELECT report, 'node ''' || id || ''' missing Russian summary' FROM sound WHERE tail = '9'
  UNION ALL SELECT report, 'node ''' || id || ''' uses unknown element_type ''t6''' FROM sound WHERE depth = 1 AND tail = '6'
  UNION ALL SELECT report, 'node ''' || id || ''' branch targets unknown node ''' || id || '?''' FROM sound WHERE kind = 'decision' AND ends_with(id, '1')
  UNION ALL SELECT report, 'edge ''' || parent_id || '→' || id || '?'' references unknown node ''' || id || '?''' FROM sound WHERE depth > 0 AND ends_with(id, '44')
  UNION ALL SELECT want.report, 'coverage: missing AST unit ''' || want.id || '''' FROM want LEFT JOIN have USING (report, id) WHERE n IS NULL
  UNION ALL SELECT have.report, 'coverage: unknown AST unit ''' || have.id || '''' FROM have LEFT JOIN want USING (report, id) WHERE want.id IS NULL
  UNION ALL SELECT have.report, 'coverage: AST unit ''' || have.id || ''' appears ' || n || ' times' FROM have JOIN want USING (report, id) WHERE n > 1)
SELECT report, string_agg(message, '; ' ORDER BY message) AS error FROM messages GROUP BY 1"""


def _edges(nodes: DataFrame) -> DataFrame:
    """Parent to child, and back, all claimed to be verified."""
    down = view.structural_edges(nodes)
    back = down.select("report", S("to").alias("from"), S("from").alias("to"))
    return down.unionByName(back).withColumn("status", F.lit("verified"))


def edges_backed(spark, sf_dir):
    """An edge stays verified only where a call from the one symbol to the other backs it."""
    nodes = _nodes(spark, sf_dir)
    return validate.backed_edges(_edges(nodes), nodes, code_model(spark, sf_dir))


BACKED_SQL = f"""{_WITH},
down AS (SELECT report, parent_id AS a, id AS b FROM nodes WHERE parent_id IS NOT NULL), e AS (FROM down UNION ALL SELECT report, b, a FROM down),
pairs AS (SELECT DISTINCT f, t FROM calls)
SELECT e.report, a AS "from", b AS "to", CASE WHEN f IS NULL THEN 'inferred' ELSE 'verified' END AS status FROM e JOIN nodes x ON e.report = x.report AND a = x.id JOIN nodes y ON e.report = y.report AND b = y.id LEFT JOIN pairs ON f = x.symbol AND t = y.symbol"""


def reference_faults(spark, sf_dir):
    """Unknown element types, branch targets and edge ends, by the rules that validation has for them."""
    nodes = _nodes(spark, sf_dir)
    typed = nodes.withColumn("element_type", F.concat(F.lit("t"), F.substring("id", -1, 1)))
    palette = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), S("n_nationkey").cast("string")).alias("type")).filter("type <> 't7'")
    far = F.when(S("id").endswith("1"), F.concat("id", F.lit("?"))).otherwise(S("id"))
    branches = nodes.filter("kind = 'decision'").select("report", "id", far.alias("target"))
    edges = view.structural_edges(nodes).withColumn("to", F.when(S("to").endswith("4"), F.concat("to", F.lit("?"))).otherwise(S("to")))
    return validate.palette_errors(typed, palette).unionByName(validate.branch_errors(branches, nodes)).unionByName(validate.edge_errors(edges, nodes))


FAULTS_SQL = f"""{_WITH}
SELECT report, 'node ''' || id || ''' uses unknown element_type ''t7''' AS message FROM nodes WHERE right(id, 1) = '7'
UNION ALL SELECT report, 'node ''' || id || ''' branch targets unknown node ''' || id || '?''' FROM nodes WHERE kind = 'decision' AND ends_with(id, '1')
UNION ALL SELECT report, 'edge ''' || parent_id || '→' || id || '?'' references unknown node ''' || id || '?''' FROM nodes WHERE parent_id IS NOT NULL AND ends_with(id, '4')"""


def error_nodes(spark, sf_dir):
    """The error node of each file that does not compile."""
    m = code_model(spark, sf_dir)
    return tree.error_reports(m, _files(spark, sf_dir)).select("report", "id", "kind", "layer", "start_line", "end_line", "summary")


ERRORS_SQL = f"""{_WITH}, e AS (SELECT file, 'bad ' || name AS message, s, e FROM sym WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
SELECT file AS report, 'error:' || file AS id, 'error' AS kind, 'flow' AS layer, first(s ORDER BY s, message) AS start_line, first(e ORDER BY s, message) AS end_line, string_agg(file || ':' || s || ': ' || message, chr(10) ORDER BY s, message) AS summary FROM e GROUP BY 1"""


def callable_symbols(spark, sf_dir):
    """Functions and methods, as a picker lists them."""
    return tree.callables(code_model(spark, sf_dir).symbols)


CALLABLE_SQL = f"{_WITH} SELECT id, name, kind, file FROM sym WHERE kind <> 'variable'"


def joined_models(spark, sf_dir):
    """All symbols and calls of two models in one, and what each relation holds."""
    a = code_model(spark, sf_dir)
    b = Model(**{n: df.withColumn("id", F.concat(F.lit("ts:"), "id")) if "id" in df.columns else df for n, df in a.relations().items()})
    both = models.union(a, b)
    parts = [df.select(F.lit(n).alias("relation"), *(df[c] if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("id",))) for n, df in both.relations().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


JOINED_SQL = f"""{_WITH},
ids AS (SELECT 'packages' AS relation, 'p' || n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'symbols', id FROM sym
  UNION ALL SELECT 'entities', 'file:c' || c_custkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'entities', 'f' || k FROM sym UNION ALL SELECT 'entities', id FROM st),
r AS (FROM ids UNION ALL SELECT relation, 'ts:' || id FROM ids UNION ALL SELECT 'calls', NULL FROM calls, range(2) UNION ALL SELECT 'effects', NULL FROM lineitem, range(2) WHERE l_returnflag = 'R'
  UNION ALL SELECT 'errors', NULL FROM sym, range(2) WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
SELECT relation, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY 1"""


def labelling_windows(spark, sf_dir):
    """The window of source lines that each node is labelled in."""
    return labels.label_windows(_nodes(spark, sf_dir)).select("report", "id", S("window_no").cast("int").alias("window_no"))


WINDOWS_SQL = f"""{_WITH},
ls AS (SELECT DISTINCT report, start_line AS line FROM nodes),
w AS (SELECT report, 1 AS no, min(line) AS a FROM ls GROUP BY 1
  UNION ALL SELECT report, no + 1, a FROM (SELECT w.report, w.no, min(ls.line) AS a FROM w JOIN ls ON ls.report = w.report AND ls.line > w.a + 127 GROUP BY 1, 2))
SELECT n.report, n.id, w.no AS window_no FROM nodes n JOIN w ON n.report = w.report AND n.start_line BETWEEN w.a AND w.a + 127"""


def labelled(spark, sf_dir):
    """Labels by the offline labeller, checked and applied window by window."""
    return labels.label(_nodes(spark, sf_dir)).select("report", "id", "label", "summary", "group_id")


LABELLED_SQL = f"{_WITH} SELECT report, id, label, coalesce(nullif(trim(summary), ''), label) AS summary, CAST(NULL AS VARCHAR) AS group_id FROM nodes"


def visible_nodes(spark, sf_dir):
    """Nodes that show with the layer of calls off and the scopes of variables collapsed."""
    nodes = _nodes(spark, sf_dir)
    return view.visible(nodes, ["flow", "data", "state"], nodes.filter("kind = 'state'")).select("report", "id")


VISIBLE_SQL = f"{_WITH} SELECT n.report, n.id FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id AND n.report = p.report WHERE n.layer <> 'calls' AND NOT (n.depth = 2 AND p.kind = 'state')"


def drilled(spark, sf_dir):
    """The nodes below each function's node, with that node's id."""
    nodes = _nodes(spark, sf_dir)
    return view.drill_down(nodes, nodes.filter("depth = 1 and kind = 'group'")).select("root", "report", "id")


DRILLED_SQL = f"{_WITH} SELECT CASE n.depth WHEN 1 THEN n.id ELSE n.parent_id END AS root, n.report, n.id FROM nodes n JOIN nodes p ON p.id = CASE n.depth WHEN 1 THEN n.id ELSE n.parent_id END AND p.report = n.report WHERE n.depth > 0 AND p.kind = 'group' AND p.depth = 1"


def opened_files(spark, sf_dir):
    """The file that a request for a symbol opens: the one it names, or else the symbol's own."""
    m = code_model(spark, sf_dir)
    wanted = m.calls.select(S("to").alias("symbol"), F.when(S("source.start_line") % 3 == 0, S("source.file")).alias("file"))
    return view.navigate(wanted, m.symbols).groupBy("symbol", "file").agg(F.count("*").alias("n"))


OPENED_SQL = f"{_WITH} SELECT c.t AS symbol, coalesce(CASE WHEN c.line % 3 = 0 THEN c.file END, sym.file) AS file, count(*) AS n FROM calls c LEFT JOIN sym ON c.t = sym.id GROUP BY 1, 2"


def chained_arcs(spark, sf_dir):
    """The ways out of a node that is no decision, as a chain by line; a decision keeps its own."""
    nodes = _nodes(spark, sf_dir)
    arcs = view.structural_edges(nodes.filter("depth = 2"))
    decided = nodes.withColumn("kind", F.when((S("depth") == 1) & S("id").endswith("2"), "decision").otherwise(S("kind")))
    return view.sequential_arcs(arcs, decided)


CHAINED_SQL = f"""{_WITH} SELECT report, CASE WHEN ends_with(parent_id, '2') THEN parent_id ELSE coalesce(lag(id) OVER (PARTITION BY report, parent_id ORDER BY start_line, id), parent_id) END AS "from", id AS "to" FROM nodes WHERE depth = 2"""


def decision_arcs(spark, sf_dir):
    """The labelled arcs of decisions whose targets exist; here each points to itself, to its parent and to nothing."""
    nodes = _nodes(spark, sf_dir)
    branch = lambda c, t: F.struct(F.lit(c).alias("condition"), t.alias("target"))
    nodes = nodes.withColumn("branches", F.array(branch("yes", S("id")), branch("no", S("parent_id")), branch("else", F.lit("?"))))
    return view.branch_arcs(nodes)


DECISION_SQL = f"""{_WITH} SELECT report, id AS "from", CASE k WHEN 0 THEN id ELSE parent_id END AS "to", CASE k WHEN 0 THEN 'yes' ELSE 'no' END AS label FROM nodes, range(2) r(k) WHERE kind = 'decision'"""


def node_colors(spark, sf_dir):
    """The color of each node: its element type's, its kind's, or that of actions."""
    nodes = _nodes(spark, sf_dir).withColumn("element_type", F.when(S("id").endswith("0"), "t0").when(S("id").endswith("1"), "t?"))
    palette = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("t0").alias("type"), F.lit("#00f").alias("color"))
    kinds = palette.select(F.explode(F.array(F.struct(F.lit("action").alias("kind"), F.lit("#aaa").alias("color")), F.struct(F.lit("call").alias("kind"), F.lit("#0c0").alias("color")))).alias("r")).select("r.*")
    return view.styles(nodes, palette, kinds)


COLORS_SQL = f"{_WITH} SELECT report, id, CASE WHEN ends_with(id, '0') THEN '#00f' WHEN kind = 'call' THEN '#0c0' ELSE '#aaa' END AS color FROM nodes"


def shown_edges(spark, sf_dir):
    """Call edges between what shows, with the scopes of variables collapsed: parents' edges first, each pair once. All files are one report here."""
    nodes = _nodes(spark, sf_dir).withColumn("path", F.concat("report", F.lit("/"), "path"))
    edges = nodes.filter("kind = 'call'").select(S("id").alias("from"), F.concat(F.lit("f"), F.substring("symbol", 2, 20)).alias("to"))
    out = view.lifted_edges(edges, nodes, nodes.filter("kind = 'state'").select("path"))
    return out.select("from", "to", "priority")


SHOWN_SQL = f"""{_WITH},
up AS (SELECT n.id, CASE WHEN n.depth = 2 AND p.kind = 'state' THEN p.id ELSE n.id END AS shown FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id AND n.report = p.report),
e AS (SELECT parent_id AS a, id AS b, 0 AS priority FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT id, 'f' || substr(symbol, 2), 1 FROM nodes WHERE kind = 'call')
SELECT x.shown AS "from", y.shown AS "to", min(priority) AS priority FROM e JOIN up x ON a = x.id JOIN up y ON b = y.id WHERE x.shown <> y.shown GROUP BY 1, 2"""


def _state(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("c"), S("c_custkey").cast("string"))
    return c.select(path.alias("path"), S("c_mktsegment").alias("hash"), F.lit("k").alias("cache_key"), F.when(S("c_acctbal") > 0, path).alias("report_path"), F.when(S("c_nationkey") == 3, "x").alias("error"))


def state_after(spark, sf_dir):
    """The state table after a refresh of the files with orders, without those whose package is gone."""
    state, o = _state(spark, sf_dir), table(spark, sf_dir, "orders")
    path = F.concat(F.lit("c"), S("o_custkey").cast("string"))
    fresh = o.groupBy(path.alias("path")).agg(F.count("*").alias("n")).select("path", F.concat(F.lit("h"), S("n").cast("string")).alias("hash"), F.lit("new").alias("cache_key"), S("path").alias("report_path"), F.lit(None).cast("string").alias("error"))
    kept = table(spark, sf_dir, "customer").filter("c_nationkey <> 7").select(F.concat(F.lit("c"), S("c_custkey").cast("string")).alias("path"))
    return incremental.retain(incremental.upsert(state, fresh), kept)


STATE_SQL = """WITH f AS (SELECT 'c' || o_custkey AS path, 'h' || count(*) AS hash FROM orders GROUP BY 1)
SELECT 'c' || c_custkey AS path, coalesce(f.hash, c_mktsegment) AS hash, CASE WHEN f.path IS NULL THEN 'k' ELSE 'new' END AS cache_key, CASE WHEN f.path IS NOT NULL OR c_acctbal > 0 THEN 'c' || c_custkey END AS report_path,
  CASE WHEN f.path IS NULL AND c_nationkey = 3 THEN 'x' END AS error FROM customer LEFT JOIN f ON f.path = 'c' || c_custkey WHERE c_nationkey <> 7"""


def _plan(spark, sf_dir) -> DataFrame:
    state = _state(spark, sf_dir)
    files = state.select("path", F.when(S("path").endswith("5"), "other").otherwise(S("hash")).alias("hash"), "cache_key")
    errors = code_model(spark, sf_dir).errors.filter("start_line % 4 = 0").select(S("file").alias("path"), "message")
    return incremental.update_plan(files, state, errors)


def work_queue(spark, sf_dir):
    """Files to be analysed, in order of their path."""
    return view.queue(_plan(spark, sf_dir)).select("place", "path", "status")


_PLANNED = """bad AS (SELECT DISTINCT file FROM sym WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND s % 4 = 0),
plan AS (SELECT 'c' || c_custkey AS path, CASE WHEN bad.file IS NOT NULL OR (NOT ends_with('c' || c_custkey, '5') AND c_nationkey = 3) THEN 'error' WHEN NOT ends_with('c' || c_custkey, '5') AND c_acctbal > 0 THEN 'ready' ELSE 'pending' END AS status, c_acctbal > 0 AS has FROM customer LEFT JOIN bad ON bad.file = 'c' || c_custkey)"""
QUEUE_SQL = f"{_WITH}, {_PLANNED} SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place, path, status FROM plan WHERE status = 'pending' OR (status = 'error' AND NOT has)"


def work_progress(spark, sf_dir):
    """How many files are done, and how many of them failed."""
    return view.progress(_plan(spark, sf_dir).select("path", "error", (S("status") != "pending").alias("done")))


PROGRESS_SQL = f"{_WITH}, {_PLANNED} SELECT count(*) AS total, count(*) FILTER (status <> 'pending') AS completed, count(*) FILTER (status = 'error') AS failed FROM plan"

_ALL = {
    "file_scopes": (file_scopes, FILE_SQL),
    "function_scopes": (function_scopes, FUNCTION_SQL),
    "package_map": (package_map, MAP_SQL),
    "references": (references, REFERENCES_SQL),
    "snapped_ranges": (snapped_ranges, SNAPPED_SQL),
    "symbols_cleared": (symbols_cleared, CLEARED_SQL),
    "validation_texts": (validation_texts, VALIDATION_SQL),
    "edges_backed": (edges_backed, BACKED_SQL),
    "reference_faults": (reference_faults, FAULTS_SQL),
    "error_nodes": (error_nodes, ERRORS_SQL),
    "callable_symbols": (callable_symbols, CALLABLE_SQL),
    "joined_models": (joined_models, JOINED_SQL),
    "labelling_windows": (labelling_windows, WINDOWS_SQL),
    "labelled": (labelled, LABELLED_SQL),
    "visible_nodes": (visible_nodes, VISIBLE_SQL),
    "drilled": (drilled, DRILLED_SQL),
    "opened_files": (opened_files, OPENED_SQL),
    "chained_arcs": (chained_arcs, CHAINED_SQL),
    "decision_arcs": (decision_arcs, DECISION_SQL),
    "node_colors": (node_colors, COLORS_SQL),
    "shown_edges": (shown_edges, SHOWN_SQL),
    "state_after": (state_after, STATE_SQL),
    "work_queue": (work_queue, QUEUE_SQL),
    "work_progress": (work_progress, PROGRESS_SQL),
}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
