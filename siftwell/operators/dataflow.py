"""Data flow within and across functions: every variable a source taints, its sinks, and what cleans it in between.

All of it is folded inside the row of a function, over an array of its lines; nothing is exploded before the paths
are known, and the only shuffle removes copies of short results. Functions without a source are left out by one
alternation over the whole text before any line is looked at.

Semantics (those a user of line-based taint analysis expects):

    source      a line with a source pattern that assigns a variable; each pattern on it counts
    tainted     one forward pass over all lines: a line that names a tainted variable as a word and assigns another
                taints that one, from the next line on
    path        a source and a tainted variable that stands on a line with a sink. It begins on the first line of the
                last source pattern (in catalog order) that occurs in the function and ends on the first such sink line
    sanitized   some line between the two names the variable, or one it taints in between, and holds a sanitizer

Defined cases: null and empty code give no rows; rows delivered twice count once; a function without paths is safe;
a sink above the source ends a path with nothing between, which is not sanitized; any line end is a line end of its
text (a carriage return is part of the line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import catalogs as c
from siftwell.plans.dialect import Dialect

_D = Dialect()
_SOURCES = [row[0] for row in c.TAINT_SOURCES]
_FOLD = "({lines}, array({first}), (acc, x) -> IF(x.v IS NOT NULL AND exists(acc, a -> a <> x.v AND array_contains(x.w, a)), array_union(acc, array(x.v)), acc))"


def held(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with more columns, each computed once per row.

    A generator over one element: unlike a projection it is never merged into its consumers, which would compute an
    array of lines again for every element of a lambda that reads it.
    """
    return df.selectExpr("*", "inline(array(named_struct(" + ", ".join(f"'{name}', {value}" for name, value in columns.items()) + ")))")


def _last_source(text: str) -> str:
    """Number of the last pattern (from 1, in catalog order) on a line, 0 for none."""
    return f"CASE WHEN NOT {_D.any(text, _SOURCES)} THEN 0 " + " ".join(f"WHEN {_D.rx(text, '(?i)' + p)} THEN {i}" for i, p in reversed(list(enumerate(_SOURCES, 1)))) + " ELSE 0 END"


def _sources_on(text: str) -> str:
    return " + ".join(f"CAST({_D.rx(text, '(?i)' + p)} AS INT)" for p in _SOURCES)


def lined(functions: DataFrame, only_with_sources: bool = True) -> DataFrame:
    """The functions with ``ls``: per line its text, assigned variable, words, and what it holds."""
    kept = functions.where("source_code IS NOT NULL AND source_code <> ''")
    if only_with_sources:
        kept = kept.where(_D.any("source_code", _SOURCES))
    line = f"""named_struct('t', x, 'v', {_D.first_group("x", c.ASSIGNED)}, 'w', regexp_extract_all(x, '\\\\w+', 0), 'k', {_last_source("x")},
        'sink', {_D.any("x", [p for p, _ in c.SINKS])}, 'clean', {_D.any("x", [p for p, _ in c.SANITIZERS])})"""
    return held(kept, ls=f"transform(split(source_code, '\\\\n', -1), x -> {line})")


def _with_paths(functions: DataFrame) -> DataFrame:
    """The functions with a source, with ``srcs`` (sources) and ``paths``."""
    f = lined(functions)
    f = held(f, srcs=f"filter(transform(ls, (x, i) -> named_struct('line', i + 1, 'var', x.v, 'n', IF(x.k > 0, {_sources_on('x.t')}, 0))), s -> s.n > 0 AND s.var IS NOT NULL)").where("size(srcs) > 0")
    f = held(f, last_k="array_max(transform(ls, x -> x.k))")
    f = held(f, at="CAST(array_position(transform(ls, x -> x.k), last_k) AS INT)")
    flows = f"flatten(transform(srcs, s -> transform(aggregate{_FOLD.format(lines='ls', first='s.var')}, a -> named_struct('line', s.line, 'source', s.var, 'n', s.n, 'var', a, 'sink', CAST(array_position(transform(ls, x -> x.sink AND array_contains(x.w, a)), true) AS INT)))))"
    f = held(f, flow=f"filter({flows}, p -> p.sink > 0)")
    between = "slice(ls, at, greatest(p.sink - at + 1, 0))"
    f = held(f, flows=f"transform(flow, p -> named_struct('p', p, 'known', aggregate{_FOLD.format(lines=between, first='p.var')}))")
    cleaned = "size(filter(slice(ls, at, greatest(q.p.sink - at + 1, 0)), x -> x.clean AND arrays_overlap(x.w, q.known)))"
    sink = _D.first_label("element_at(ls, q.p.sink).t", c.SINKS)
    return held(f, paths=f"""transform(flows, q -> named_struct('line', q.p.line, 'source', q.p.source, 'n', q.p.n, 'variable', q.p.var, 'from_line', at, 'sink_line', q.p.sink, 'sink', {sink},
        'aliases', array_join(array_sort(array_remove(q.known, q.p.var)), ','), 'cleaned', {cleaned}))""")  # fmt: skip


def tainted(functions: DataFrame) -> DataFrame:
    """function_id, line_no, variable, tainted: per source what it taints, in name order."""
    f = held(lined(functions), srcs="filter(transform(ls, (x, i) -> named_struct('line', i + 1, 'var', IF(x.k > 0, x.v, NULL))), s -> s.var IS NOT NULL)")
    rows = f.selectExpr("function_id", f"inline(transform(srcs, s -> named_struct('line_no', s.line, 'variable', s.var, 'tainted', array_join(array_sort(aggregate{_FOLD.format(lines='ls', first='s.var')}), ','))))")
    return rows.dropDuplicates(["function_id", "line_no"])


def paths(functions: DataFrame) -> DataFrame:
    """One row per source and tainted variable with a sink: where the path begins and ends, and what cleans it."""
    types = "element_at(array(" + ", ".join(_D.lit(t) for _, t, _ in c.TAINT_SOURCES) + "), last_k)"
    rows = _with_paths(functions).selectExpr("function_id", f"{types} AS source_type", "inline(paths)")
    return rows.selectExpr("function_id", "line AS line_no", "source", "variable", "from_line", "source_type", "sink_line", "sink", "aliases", "cleaned AS sanitizer_lines", "cleaned > 0 AS is_sanitized").dropDuplicates(["function_id", "line_no", "variable"])


def safety(functions: DataFrame) -> DataFrame:
    """function_id, sources, paths, unsafe_paths, is_safe of the functions with a source."""
    total = lambda rows, when: f"aggregate({rows}, CAST(0 AS BIGINT), (n, p) -> n + IF({when}, p.n, 0))"
    rows = _with_paths(functions).selectExpr("function_id", f"{total('srcs', 'true')} AS sources", f"{total('paths', 'true')} AS paths", f"{total('paths', 'p.cleaned = 0')} AS unsafe_paths")
    return rows.dropDuplicates(["function_id"]).withColumn("is_safe", F.expr("CAST(unsafe_paths = 0 AS INT)"))


def summaries(functions: DataFrame) -> DataFrame:
    """function_id, summary: counts of sources and paths in words, for every function with code."""
    counted = safety(functions)
    known = functions.where("source_code IS NOT NULL AND source_code <> ''").select("function_id").distinct()
    text = """CASE WHEN sources IS NULL THEN 'No taint sources'
        WHEN paths = 0 THEN concat(sources, ' source(s), no path to a sink')
        ELSE concat(sources, ' source(s), ', paths, ' path(s): ', paths - unsafe_paths, ' sanitized, ', unsafe_paths, ' unsanitized') END"""
    return known.join(counted, "function_id", "left").selectExpr("function_id", f"{text} AS summary")


def hits_of_variables(functions: DataFrame, catalog: str) -> DataFrame:
    """function_id, variable, line_no, labels: the lines where a variable assigned in the function meets a sink or sanitizer.

    ``catalog`` is ``sink`` or ``sanitizer``; labels are all that match on the line, in catalog order.
    """
    flag, rules = {"sink": ("sink", c.SINKS), "sanitizer": ("clean", c.SANITIZERS)}[catalog]
    f = lined(functions.where(_D.any("source_code", [p for p, _ in rules])), only_with_sources=False)
    rows = f.selectExpr("function_id", "array_distinct(filter(transform(ls, x -> x.v), v -> v IS NOT NULL)) AS vs", f"filter(transform(ls, (x, i) -> named_struct('line_no', i + 1, 't', x.t, 'w', x.w, 'hit', x.{flag})), x -> x.hit) AS hits")
    pairs = "flatten(transform(hits, h -> transform(array_intersect(vs, h.w), v -> named_struct('variable', v, 'line_no', h.line_no, 'labels', {}))))".format(_D.all_labels("h.t", rules))
    return rows.selectExpr("function_id", f"inline({pairs})").dropDuplicates(["function_id", "variable", "line_no"])


def line_trace(functions: DataFrame, variable: str, sink: str) -> DataFrame:
    """function_id, uses, sanitizers, sinks, first_sink: a variable (last part of a dotted name) and a sink call followed by their letters, in any case."""
    name, call = variable.split("(")[0].split(".")[-1].lower(), sink.lower()
    rows = functions.where("source_code IS NOT NULL").where(F.lower("source_code").contains(name) | F.lower("source_code").contains(call))
    rows = rows.selectExpr("function_id", "split(source_code, '\\\\n', -1) AS ls").selectExpr(
        "function_id", f"transform(ls, x -> named_struct('use', contains(lower(x), {_D.lit(name)}), 'clean', {_D.any('x', c.LOOKUP_SANITIZERS)}, 'sink', contains(lower(x), {_D.lit(call)}))) AS ls"
    )
    n = lambda when: f"CAST(size(filter(ls, x -> {when})) AS BIGINT)"
    first = "nullif(CAST(array_position(transform(ls, x -> x.sink), true) AS BIGINT), 0)"
    return rows.selectExpr("function_id", f"{n('x.use')} AS uses", f"{n('x.use AND x.clean')} AS sanitizers", f"{n('x.sink')} AS sinks", f"{first} AS first_sink").dropDuplicates(["function_id"])


def variable_states(functions: DataFrame) -> DataFrame:
    """function_id, line_no, variable, aliases, transformations, sanitizers: what happens to each source variable, in line order.

    A transformation is ``label@Ln``: the source itself, then each alias where it is first assigned from a tainted
    variable; a sanitizer likewise for the lines that name the variable. A variable is no alias of itself, and
    none stands twice.
    """
    f = held(lined(functions), srcs="filter(transform(ls, (x, i) -> named_struct('line', i + 1, 'var', IF(x.k > 0, x.v, NULL), 't', x.t)), s -> s.var IS NOT NULL)")
    # The fold keeps [variables known, transformations].
    step = "aggregate(ls, named_struct('k', array(s.var), 'a', array('{src}'), 'i', 0), (acc, x) -> named_struct('k', IF({new}, array_union(acc.k, array(x.v)), acc.k), 'a', IF({new}, array_append(acc.a, concat('alias ', x.v, '@L', acc.i + 1)), acc.a), 'i', acc.i + 1))"
    new = "x.v IS NOT NULL AND NOT array_contains(acc.k, x.v) AND exists(acc.k, a -> a <> x.v AND array_contains(x.w, a))"
    folded = step.format(src="source", new=new)
    cleaned = f"filter(transform(ls, (x, i) -> IF(x.clean AND array_contains(x.w, s.var), concat({_D.first_label('x.t', c.SANITIZERS)}, '@L', i + 1), NULL)), z -> z IS NOT NULL)"
    rows = f.selectExpr("function_id", f"inline(transform(srcs, s -> named_struct('line_no', s.line, 'variable', s.var, 'folded', {folded}, 'sanitizers', array_join({cleaned}, '; '))))")
    return rows.selectExpr("function_id", "line_no", "variable", "array_join(array_remove(folded.k, variable), ',') AS aliases", "concat('source@L', line_no, array_join(transform(slice(folded.a, 2, size(folded.a)), z -> concat('; ', z)), '')) AS transformations", "sanitizers").dropDuplicates(["function_id", "line_no"])


_NAME = r"^\w+$"


def argument_list(text: str) -> str:
    """SQL: the arguments inside a parenthesis (without it), split at commas outside brackets and trimmed."""
    return f"""transform(aggregate(split({text}, ''), named_struct('a', array(''), 'd', 0), (s, ch) ->
        CASE WHEN ch = ',' AND s.d = 0 THEN named_struct('a', array_append(s.a, ''), 'd', s.d)
             ELSE named_struct('a', concat(slice(s.a, 1, size(s.a) - 1), array(concat(element_at(s.a, -1), ch))), 'd', s.d + CASE WHEN ch IN ('(', '[', '{{') THEN 1 WHEN ch IN (')', ']', '}}') THEN -1 ELSE 0 END) END).a, a -> trim(BOTH ' \\t\\r\\n' FROM a))"""


def across_functions(functions: DataFrame) -> DataFrame:
    """Taint handed to another function of the repository: caller, callee, parameter, and what the callee does with it.

    From the first source of a caller on, each later call that passes the tainted variable by its name, or one it
    taints, is joined to the functions of that name in the repository, by the place of the argument. Both
    sides are reduced in their rows first: the join carries names, places and verdicts, no code.
    """
    f = held(lined(functions), src="element_at(filter(transform(ls, (x, i) -> named_struct('line', i + 1, 'var', IF(x.k > 0, x.v, NULL))), s -> s.var IS NOT NULL), 1)").where("src IS NOT NULL")
    f = held(f, known=f"aggregate{_FOLD.format(lines='slice(ls, src.line, size(ls))', first='src.var')}")
    call = r"(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)"
    calls = f.selectExpr("function_id", "repo", "name", "src", "known", "ls", "inline(filter(transform(ls, (x, i) -> named_struct('call_line', i + 1, 't', x.t)), z -> z.call_line > src.line AND exists(known, a -> array_contains(ls[z.call_line - 1].w, a)))) AS (call_line, t)")
    calls = calls.selectExpr("function_id", "repo", "name", "src", "known", "slice(ls, src.line, call_line - src.line + 1) AS ls", "call_line", f"regexp_extract_all(t, {_D.lit(call)}, 1) AS callees", f"regexp_extract_all(t, {_D.lit(call)}, 2) AS lists")
    calls = calls.selectExpr("function_id", "repo", "name", "src", "known", "ls", "call_line", "inline(arrays_zip(callees, lists)) AS (callee, list)").where("callee <> name AND list <> ''")
    passed = calls.selectExpr("function_id", "repo", "src", "known", "ls", "call_line", "callee", f"posexplode({argument_list('list')}) AS (place, argument)").where("array_contains(known, argument)")
    cleaned = "exists(ls, x -> x.clean AND arrays_overlap(x.w, known))"
    passed = passed.selectExpr("function_id AS caller_id", "repo", "src.line AS source_line", "src.var AS source", "call_line", "callee", "place", "argument", f"{cleaned} AS cleaned_before").dropDuplicates(["caller_id", "call_line", "callee", "place"])

    g = lined(functions.where("parameters IS NOT NULL AND size(parameters) > 0"), only_with_sources=False)
    g = held(g, names=r"transform(parameters, p -> regexp_extract(regexp_replace(p, '\\s*(?::|=).*$', ''), '(\\w+)\\W*$', 1))")
    g = held(g, uses="filter(transform(names, (p, i) -> named_struct('place', i, 'param', p, 'sink', CAST(array_position(transform(ls, x -> x.sink AND array_contains(x.w, p)), true) AS INT))), z -> z.param <> '')")
    end = "IF(z.sink > 0, z.sink, size(ls))"
    g = held(g, ps=f"transform(uses, z -> named_struct('place', z.place, 'param', z.param, 'sink', z.sink, 'cleaned', exists(slice(ls, 1, {end}), x -> x.clean AND arrays_overlap(x.w, aggregate{_FOLD.format(lines=f'slice(ls, 1, {end})', first='z.param')}))))")
    # ``self`` and ``cls`` are no arguments of a call.
    g = g.selectExpr("function_id AS callee_id", "repo", "name AS callee", "exists(ps, z -> z.place = 0 AND z.param IN ('self', 'cls')) AS bound", "inline(ps)")
    taken = g.selectExpr("callee_id", "repo", "callee", "place - CAST(bound AS INT) AS place", "param", "nullif(CAST(sink AS BIGINT), 0) AS sink_line", "cleaned").where("place >= 0").dropDuplicates(["callee_id", "place"])
    both = passed.join(taken, ["repo", "callee", "place"])
    return both.selectExpr("caller_id", "callee_id", "CAST(source_line AS BIGINT) AS source_line", "source", "CAST(call_line AS BIGINT) AS call_line", "CAST(place AS BIGINT) AS place", "argument", "param AS parameter", "sink_line", "cleaned_before OR cleaned AS is_sanitized")


def files_of(functions: DataFrame) -> DataFrame:
    """The files of ``functions`` as units: function_id (the least of the file), repo, file_path, source_code (its functions by line, copies once).

    A file's text is gathered in one row; its size is that of a file, whatever the size of its repository.
    """
    one = functions.where("repo IS NOT NULL AND file_path IS NOT NULL AND source_code IS NOT NULL AND source_code <> ''").select("repo", "file_path", "function_id", "start_line", "source_code").dropDuplicates(["function_id"])
    rows = one.groupBy("repo", "file_path").agg(F.min("function_id").alias("function_id"), F.array_sort(F.collect_list(F.struct("start_line", "function_id", "source_code"))).alias("fs"))
    return rows.selectExpr("function_id", "repo", "file_path", "array_join(transform(fs, x -> x.source_code), '\\n') AS source_code")


def cleaned_words(functions: DataFrame) -> DataFrame:
    """function_id, word: the words on lines with a sanitizer."""
    lines = functions.where(_D.any("source_code", [p for p, _ in c.SANITIZERS])).selectExpr("function_id", f"filter(split(source_code, '\\\\n', -1), x -> {_D.any('x', [p for p, _ in c.SANITIZERS])}) AS ls")
    return lines.selectExpr("function_id", "explode(array_distinct(flatten(transform(ls, x -> regexp_extract_all(x, '\\\\w+', 0))))) AS word").distinct()


def safety_through_callers(functions: DataFrame, callers: int = 5) -> DataFrame:
    """Unsafe files and the first callers (by id) of their functions from other files: does one clean a source variable, which makes it safe?

    function_id (of the file), unsafe_paths, callers, sanitizing_callers, safe_through_caller.
    """
    from siftwell.operators.callgraph import code_of, edges, links, nodes
    from siftwell.storage import cut

    files = cut(files_of(functions), "files")
    unsafe = safety(files).where("is_safe = 0").select("function_id", "unsafe_paths")
    variables = paths(files).where("NOT is_sanitized").select("function_id", F.col("source").alias("word")).distinct()
    known = cut(nodes(functions), "nodes")
    file_of = files.join(unsafe, "function_id", "left_semi").select("function_id", "repo", "file_path")
    inner = file_of.join(known.select("repo", "file_path", F.col("id").alias("b")), ["repo", "file_path"]).select("repo", "function_id", "file_path", "b")
    outer = known.select("repo", F.col("id").alias("a"), F.col("file_path").alias("caller_path"))
    called = inner.join(links(edges(functions), known), ["repo", "b"]).join(outer, ["repo", "a"]).where("caller_path <> file_path").select("function_id", "repo", "a").distinct()
    # The least ids are kept by a bounded sort within each file; a hot callee sends at most ``callers`` rows of each partition.
    first = called.withColumn("k", F.expr("row_number() OVER (PARTITION BY function_id ORDER BY a)")).where(F.col("k") <= callers).drop("k")
    words = code_of(functions).select("function_id", "repo", F.col("id").alias("a")).join(cleaned_words(functions).withColumnRenamed("function_id", "caller"), F.col("function_id") == F.col("caller")).select("repo", "a", "word").distinct()
    helped = first.join(words, ["repo", "a"]).join(variables, ["function_id", "word"], "left_semi").select("function_id", "a").distinct()
    n, m = first.groupBy("function_id").agg(F.count("*").alias("callers")), helped.groupBy("function_id").agg(F.count("*").alias("sanitizing_callers"))
    return unsafe.join(n, "function_id", "left").join(m, "function_id", "left").selectExpr("function_id", "unsafe_paths", "coalesce(callers, 0) AS callers", "coalesce(sanitizing_callers, 0) AS sanitizing_callers", "coalesce(sanitizing_callers, 0) > 0 AS safe_through_caller")
