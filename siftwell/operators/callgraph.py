"""Call graphs of code as two frames, and their traversals by frontier joins.

    nodes   repo, id, name, class_name, file_path, start_line, end_line, is_entry, is_sink   (one row per id)
    edges   repo, caller_id, callee, call_line (a bag: one row per call; ``callee`` is ``receiver.name`` or ``name``)
    links   repo, a, b (distinct resolved edges between ids)

Any frames of these shapes will do; ``nodes``/``edges`` build them from functions. A traversal keeps its frontier as a
table and joins it to the links once per level; each level is written to the shared folder, so a lost executor costs
one level and plans stay short. Paths are simple: each carries the ids on it. Forward search is pruned to the nodes
from which a sink is still within reach, so no partial path is kept that cannot become one (up to the rule of simple
paths). Nothing is collected but the size of a level.

Defined cases: functions without a name or code are no nodes; calls into nothing known stay in the bag of edges and
are no links; ids that several functions share (overloads) are one node, the last by line; empty frames give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import catalogs as c
from siftwell.plans.dialect import Dialect
from siftwell.storage import cut

_D = Dialect()
_JAVA, _PYTHON, _SCRIPT = r"[.]java$", r"[.]py$", r"[.](?:js|jsx|ts|tsx)$"
# Words before a parenthesis that call nothing, by language.
NO_CALLS = {
    "java": (),
    "python": ("if", "for", "while", "with", "def", "class", "return", "print", "range", "len", "str", "int", "list", "dict"),
    "javascript": ("if", "for", "while", "switch", "catch", "function", "return", "new", "typeof", "instanceof"),
}


def language(path: str = "file_path") -> Column:
    return F.when(F.col(path).rlike(_JAVA), "java").when(F.col(path).rlike(_PYTHON), "python").when(F.col(path).rlike(_SCRIPT), "javascript")


def _id() -> Column:
    """Java: Class.method; Python: dotted.module.function; scripts: relative/path:function."""
    stem = F.regexp_extract("file_path", r"([^/]*)\.\w+$", 1)
    bare = F.regexp_replace("file_path", r"\.\w+$", "")
    return (
        F.when(F.col("lang") == "java", F.concat_ws(".", F.coalesce("class_name", stem), "name"))
        .when(F.col("lang") == "python", F.concat_ws(".", F.translate(bare, "/", "."), "name"))
        .when(F.col("lang") == "javascript", F.concat_ws(":", bare, "name"))
    )


def code_of(functions: DataFrame) -> DataFrame:
    """Functions of known languages with name and code, with ``lang`` and ``id``."""
    return functions.where("name IS NOT NULL AND source_code IS NOT NULL AND source_code <> ''").withColumn("lang", language()).where("lang IS NOT NULL").withColumn("id", _id())


def nodes(functions: DataFrame) -> DataFrame:
    """One row per id; flags by the patterns of the language, of decorators and annotations too."""
    text = "concat_ws('\\n', decorators, annotations, source_code)" if {"decorators", "annotations"} <= set(functions.columns) else "source_code"
    flag = lambda table: "CASE lang " + " ".join(f"WHEN '{k}' THEN {_D.any('text', v, '')}" for k, v in table.items()) + " END"
    rows = code_of(functions).withColumn("text", F.expr(text)).selectExpr("repo", "id", "function_id", "name", "class_name", "file_path", "start_line", "end_line", f"{flag(c.ENTRY_POINTS)} AS is_entry", f"{flag(c.CODE_SINKS)} AS is_sink")
    rest = [x for x in rows.columns if x not in ("repo", "id")]
    last = rows.groupBy("repo", "id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("start_line", F.lit(0)), "file_path", "function_id")).alias("n"))
    return last.select("repo", "id", *[F.col(f"n.{x}").alias(x) for x in rest if x != "function_id"])


def edges(functions: DataFrame) -> DataFrame:
    """The bag of calls: one row for each, copies of a function counted once."""
    f = code_of(functions).selectExpr("function_id", "repo", "lang", "id", "name", "start_line", "split(source_code, '\\\\n', -1) AS ls")
    # The first line on which the function's own name stands before a parenthesis, without a receiver, defines it.
    own = "array_position(transform(ls, x -> x RLIKE concat('(?:^|[^.\\\\w])\\\\Q', name, '\\\\E\\\\s*[(]')), true) - 1"
    f = f.selectExpr("function_id", "repo", "lang", "id", "name", "start_line", f"{own} AS own", "inline(transform(ls, (x, i) -> named_struct('i', i, 't', x)))")
    pattern = _D.lit(r"(?:(\w+)\.)?(\w+)\s*\(")
    calls = f.where(F.col("t").contains("(")).selectExpr("function_id", "repo", "lang", "id", "name", "start_line", "own", "i", f"posexplode(arrays_zip(regexp_extract_all(t, {pattern}, 1), regexp_extract_all(t, {pattern}, 2))) AS (n, z)")
    calls = calls.selectExpr("function_id", "repo", "lang", "id AS caller_id", "name", "CAST(coalesce(start_line, 1) + i AS BIGINT) AS call_line", "own", "i", "n", "z.`0` AS receiver", "z.`1` AS callee_name")
    stop = reduce(lambda a, b: a | b, [(F.col("lang") == k) & F.col("callee_name").isin(*v) for k, v in NO_CALLS.items() if v])
    defined = (F.col("i") == F.col("own")) & (F.col("callee_name") == F.col("name")) & (F.col("receiver") == "")
    kept = calls.where(~stop & ~defined).dropDuplicates(["function_id", "i", "n"])
    return kept.select("repo", "lang", "caller_id", F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "callee_name")).otherwise(F.col("callee_name")).alias("callee"), "receiver", "callee_name", "call_line")


def united(*graphs: DataFrame) -> DataFrame:
    """Union of edges as a bag; of nodes with ``last_wins``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), graphs)


def last_wins(*graphs: DataFrame) -> DataFrame:
    """Union of node frames: of rows with the same id the one of the last frame stays."""
    rows = reduce(lambda a, b: a.unionByName(b), [g.withColumn("_frame", F.lit(i)) for i, g in enumerate(graphs)])
    rest = [x for x in graphs[0].columns if x not in ("repo", "id")]
    return rows.groupBy("repo", "id").agg(F.max_by(F.struct(*rest), F.col("_frame")).alias("n")).select("repo", "id", *[F.col(f"n.{x}").alias(x) for x in rest])


def links(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """repo, a, b: the callee is the node of that very id, else one whose class is the receiver, else the only one of its name in the repository."""
    called = edge_rows.select("repo", F.col("caller_id").alias("a"), "callee", "receiver", "callee_name").distinct()
    exact = node_rows.select("repo", F.col("id").alias("callee"), F.col("id").alias("b0"))
    by_class = node_rows.where("class_name IS NOT NULL").groupBy("repo", F.col("class_name").alias("receiver"), F.col("name").alias("callee_name")).agg(F.min("id").alias("b1"))
    by_name = node_rows.groupBy("repo", F.col("name").alias("callee_name")).agg(F.min("id").alias("b2"), F.count("*").alias("n")).where("n = 1").drop("n")
    found = called.join(exact, ["repo", "callee"], "left").join(by_class, ["repo", "receiver", "callee_name"], "left").join(by_name, ["repo", "callee_name"], "left")
    return found.select("repo", "a", F.coalesce("b0", "b1", "b2").alias("b")).where("b IS NOT NULL").distinct()


def first_edges(edge_rows: DataFrame) -> DataFrame:
    """repo, caller_id, callee, call_line, calls: the first call between two ids, and how many there are."""
    return edge_rows.groupBy("repo", "caller_id", "callee").agg(F.min("call_line").alias("call_line"), F.count("*").alias("calls"))


def stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Per repository: nodes, edges (the bag), entries, sinks, mean callers and callees (distinct pairs, unknown ids too, over the nodes)."""
    v = node_rows.groupBy("repo").agg(F.count("*").alias("nodes"), F.count_if("is_entry").alias("entries"), F.count_if("is_sink").alias("sinks"))
    e = edge_rows.groupBy("repo", "caller_id", "callee").agg(F.count("*").alias("n")).groupBy("repo").agg(F.sum("n").alias("edges"), F.count("*").alias("pairs"))
    mean = F.round(F.coalesce(F.col("pairs"), F.lit(0)) / F.greatest(F.col("nodes"), F.lit(1)), 6)
    return v.join(e, "repo", "left").select("repo", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "entries", "sinks", mean.alias("mean_callers"), mean.alias("mean_callees"))


def neighbours(link_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """repo, id, callers, callees of every node."""
    out = link_rows.groupBy("repo", F.col("a").alias("id")).agg(F.count("*").alias("callees"))
    into = link_rows.groupBy("repo", F.col("b").alias("id")).agg(F.count("*").alias("callers"))
    return node_rows.select("repo", "id").join(out, ["repo", "id"], "left").join(into, ["repo", "id"], "left").select("repo", "id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def distances_to_sink(link_rows: DataFrame, node_rows: DataFrame, depth: int) -> DataFrame:
    """repo, id, distance: the least number of edges to a sink, for nodes within ``depth``; one join and one written level per step."""
    level = cut(node_rows.where("is_sink").select("repo", "id", F.lit(0).alias("distance")), "sink-distance")
    known = level
    for step in range(1, depth + 1):
        above = level.select("repo", F.col("id").alias("b")).join(link_rows, ["repo", "b"]).select("repo", F.col("a").alias("id")).distinct()
        level = cut(above.join(known, ["repo", "id"], "left_anti").withColumn("distance", F.lit(step)), "sink-distance")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def paths_to_sinks(link_rows: DataFrame, node_rows: DataFrame, depth: int = 10) -> DataFrame:
    """repo, source, sink, path, edges: simple paths from entry points to the first sink on them, of at most ``depth`` edges.

    A sink that is an entry point is a path of no edges; sinks are never expanded.
    """
    link_rows = cut(link_rows, "links")
    node_rows = cut(node_rows.select("repo", "id", "is_entry", "is_sink"), "graph-nodes")
    near = distances_to_sink(link_rows, node_rows, depth)
    steps = link_rows.join(near.select("repo", F.col("id").alias("b"), "distance"), ["repo", "b"])
    level = near.join(node_rows.where("is_entry"), ["repo", "id"]).select("repo", F.col("id").alias("source"), F.col("id").alias("at"), F.col("distance"), F.array("id").alias("path"))
    level = cut(level, "paths")
    done = [level.where("distance = 0")]
    for used in range(1, depth + 1):
        open_ = level.where("distance > 0").drop("distance")
        level = open_.join(steps, (open_.repo == steps.repo) & (open_["at"] == steps.a)).where((F.col("distance") <= depth - used) & ~F.array_contains("path", F.col("b")))
        level = cut(level.select(open_.repo, "source", F.col("b").alias("at"), "distance", F.array_append("path", F.col("b")).alias("path")), "paths")
        if level.isEmpty():
            break
        done.append(level.where("distance = 0"))
    whole = reduce(lambda a, b: a.unionByName(b), done)
    return whole.select("repo", "source", F.col("at").alias("sink"), F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).cast("bigint").alias("edges"))


def caller_chains(link_rows: DataFrame, node_rows: DataFrame, depth: int = 5) -> DataFrame:
    """repo, start, node, chain, distance: backward from each sink all chains of at most ``depth`` nodes, entry points not expanded.

    Sorting a start's rows by the array ``chain`` gives depth-first order, a node before what calls it.
    """
    link_rows = cut(link_rows, "links")
    entry = node_rows.select("repo", F.col("id").alias("a"), "is_entry")
    into = cut(link_rows.join(entry, ["repo", "a"]), "links-in")
    level = node_rows.where("is_sink").select("repo", F.col("id").alias("start"), F.col("id").alias("node"), "is_entry", F.array("id").alias("chain"))
    every = []
    for step in range(depth):
        if step:
            open_ = level.where("NOT is_entry").drop("is_entry")
            level = open_.join(into, (open_.repo == into.repo) & (open_.node == into.b)).where(~F.array_contains("chain", F.col("a"))).select(open_.repo, "start", F.col("a").alias("node"), "is_entry", F.array_append("chain", F.col("a")).alias("chain"))
        level = cut(level, "chains")
        if level.isEmpty():
            break
        every.append(level)
    whole = reduce(lambda a, b: a.unionByName(b), every) if every else level
    return whole.select("repo", "start", "node", F.array_join("chain", " <- ").alias("chain"), (F.size("chain") - 1).cast("bigint").alias("distance"), "is_entry")


def _first(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Ranking filters push a limit per key below the shuffle, so a hot key sends few rows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def top_callers(link_rows: DataFrame, n: int) -> DataFrame:
    """repo, b, a: the first ``n`` callers of each node by id, none of itself."""
    return _first(link_rows.where("a <> b"), ["repo", "b"], ["a"], n)


def shared_chain(link_rows: DataFrame, starts: DataFrame, depth: int = 3, callers: int = 5) -> DataFrame:
    """repo, start, node, level: callers of callers of ``starts`` (repo, start), each node once for a start, on its first level.

    The five first callers of each node are followed. Levels are taken whole (breadth first), so a node reached on
    two ways stands on the nearer one; a depth-first search with the same memory gives the same nodes unless its depth
    bound cuts a longer way that it happens to try first.
    """
    top = cut(top_callers(link_rows, callers), "top-callers")
    level = starts.select("repo", "start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("level")).distinct()
    known = level = cut(level, "shared-chain")
    for step in range(1, depth + 1):
        above = level.join(top, (level.repo == top.repo) & (level.node == top.b)).select(level.repo, "start", F.col("a").alias("node"), F.lit(step).cast("bigint").alias("level")).distinct()
        level = cut(above.join(known, ["repo", "start", "node"], "left_anti").select("repo", "start", "node", "level"), "shared-chain")
        known = known.unionByName(level)
    return known.where("level > 0")


def level_report(link_rows: DataFrame, node_rows: DataFrame, starts: DataFrame, roots: int = 20, upstream: int = 5, breadth: int = 10, depth: int = 5) -> DataFrame:
    """repo, start, level, place, node, is_entry: callers level by level as a report shows them.

    The limits are the report's: ``roots`` direct callers, then ``upstream`` for each node and ``breadth`` on a level;
    entry points are not expanded; a node may come again. Callers stand in order of their ids.
    """
    entry = node_rows.select("repo", F.col("id").alias("a"), "is_entry")
    first, later = top_callers(link_rows, roots).join(entry, ["repo", "a"]), cut(top_callers(link_rows, upstream).join(entry, ["repo", "a"]), "report-callers")
    rank = lambda rows: rows.withColumn("place", F.row_number().over(Window.partitionBy("repo", "start").orderBy("above", "node")).cast("bigint"))
    one = starts.select("repo", F.col("start").alias("b"), "start").distinct().join(first, ["repo", "b"]).select("repo", "start", F.lit(1).cast("bigint").alias("level"), F.lit(0).cast("bigint").alias("above"), F.col("a").alias("node"), "is_entry")
    level = cut(rank(one), "report")
    every = [level]
    for step in range(2, depth + 1):
        open_ = level.where("NOT is_entry").select("repo", "start", F.col("place").alias("above"), F.col("node").alias("b"))
        level = rank(open_.join(later, ["repo", "b"]).select("repo", "start", F.lit(step).cast("bigint").alias("level"), "above", F.col("a").alias("node"), "is_entry"))
        level = cut(level.where(F.col("place") <= breadth), "report")
        if level.isEmpty():
            break
        every.append(level)
    return reduce(lambda a, b: a.unionByName(b), every).select("repo", "start", "level", "place", "node", "is_entry")


def candidate_callers(edge_rows: DataFrame, node_rows: DataFrame, n: int = 10) -> DataFrame:
    """repo, id, caller_id, tier: callers of each node by the first way that finds any.

    Tier 0: calls of its very id; 1: of ``Class.name``; 2: of the bare name, whatever the class. The first ``n`` by id.
    """
    called = edge_rows.select("repo", "callee", "caller_id").distinct()
    keys = node_rows.select("repo", "id", F.explode(F.array(
        F.struct(F.lit(0).alias("tier"), F.col("id").alias("callee")),
        F.struct(F.lit(1).alias("tier"), F.concat("class_name", F.lit("."), "name").alias("callee")),
        F.struct(F.lit(2).alias("tier"), F.col("name").alias("callee")),
    )).alias("k")).select("repo", "id", "k.tier", "k.callee")
    known = node_rows.select("repo", F.col("id").alias("caller_id"))
    found = keys.join(called, ["repo", "callee"]).join(known, ["repo", "caller_id"], "left_semi")
    best = found.groupBy("repo", "id").agg(F.min("tier").alias("tier"))
    return _first(found.join(best, ["repo", "id", "tier"]).select("repo", "id", "caller_id", "tier").distinct(), ["repo", "id"], ["caller_id"], n).withColumn("tier", F.col("tier").cast("bigint"))


def cross_file_context(link_rows: DataFrame, node_rows: DataFrame, starts: DataFrame) -> DataFrame:
    """repo, start, kind, node, place: the context of functions across files, the callers before the chain, none twice.

    Kinds: ``caller`` (the first five), ``chain`` (further ones up to three levels above), ``related`` (the other
    functions of its file, in line order).
    """
    chain = shared_chain(link_rows, starts)
    named = chain.select("repo", "start", F.when(F.col("level") == 1, "caller").otherwise("chain").alias("kind"), "node", (F.col("level") * 1_000_000).alias("rank"))
    place = node_rows.select("repo", "file_path", "id", "start_line")
    own = starts.select("repo", F.col("start").alias("id")).distinct().join(place.select("repo", "id", "file_path"), ["repo", "id"]).withColumnRenamed("id", "start")
    related = own.join(place.withColumnRenamed("id", "node"), ["repo", "file_path"]).where("node <> start").select("repo", "start", F.lit("related").alias("kind"), "node", F.coalesce("start_line", F.lit(0)).cast("bigint").alias("rank"))
    rows = named.unionByName(related)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo", "start", "kind").orderBy("rank", "node")).cast("bigint")).drop("rank")
