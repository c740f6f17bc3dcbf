"""Generated, minified, third-party and data files among source files known by their findings.

The evidence of a file is its path and the set of its snippets. From it come
    * Merkle hashes, bottom-up over directory trees: a leaf hashes a file's name with one snippet, and each directory
      above hashes its name with what is below. Copies of a library that were scanned at different lines still agree
      in the leaves they have in common, so a subtree is shared where enough of its code has leaves with the same
      hash in an unrelated repository; a single file is the least subtree. A directory's own hash is the XOR of
      its leaves' hashes. Repositories whose roots are equal (forks, mirrors) count as one;
    * layout rules on the path (dependency and output directories, names given by generators);
    * header rules on the leading comment of the file (generator marks, licence banners of others);
    * density rules on the snippets (minified code, tables and encoded data kept as code).

Shuffles carry hashes and counters, never snippets: each snippet is reduced to them where it is read. Levels are not
visited one by one: a leaf knows its ancestors, and only leaves that some other repository has too (found by
one aggregation, combined map-side) are spread over theirs.

Defined cases: rows without repo or path are left out; null and empty snippets leave the path as only
evidence; rows delivered twice count once; files with the same snippets in one repository are no shared
subtree; code under ``LEAST_SHARED`` characters in all is no evidence, short files agree by chance; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.storage import cut

# Directories and names that package managers, build tools and generators give.
VENDORED = (
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|third[_-]?party|_vendor|vendored|Pods|Carthage|Godeps)/"
    r"|^(?:vendor|vendors|external|externals|extern)/"
    r"|^(?!.*(?:^|/)src/).*/(?:vendor|external)/"
    r"|(?:^|/)deps/[^/]*\d+\.\d+[^/]*/|(?:^|/)\.?(?:venv|virtualenv)/lib"
)
GENERATED = (
    r"(?:^|/)(?:__generated__|generated|generated-(?:test-)?sources|autogen|gen/(?:java|kotlin|go|py|python|js|ts|src|main)|src/gen)/"
    r"|(?:_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts)|_grpc_pb\.js|\.pb\.\w+|\.g\.(?:ts|dart|cs)|\.generated\.\w+|\.designer\.cs|OuterClass\.java)$"
)
OUTPUT = r"\.min\.(?:js|mjs|css)$|[.\-](?:bundle|chunk)\.js$|(?:^|/)dist/(?:.*/)?bundle\.js$|\.[0-9a-f]{8,20}\.(?:js|mjs|css)$"

_MARK = r"(?im)^[ \t]*(?://|#|/?\*|--|<!--|\"\"\"|'''|;)[^\n]*?"
# The words of generator marks and of licence banners.
GENERATOR_MARK = _MARK + (
    r"(?:(?<!not )\bauto(?:matically)?[- _]?generated\b|\bcode generated\b|(?<!not )\bgenerated (?:code|file|source|automatically|by \S+|from \S+)|\bproduced automatically\b"
    r"|\boutput of \S+ (?:for|from)\b|\b(?:created|written|made) by \S+ from\b|\bregenerate (?:instead|it)\b|\bchanges (?:are|will be) (?:overwritten|lost)\b|@generated\b"
    r"|\bautomatisch\b[^\n]{0,60}\b(?:erzeugt|generiert)\b|\bg[ée]n[ée]r[ée] automatiquement\b|\bgenerado autom[áa]ticamente\b)"
)
GENERATOR_ANNOTATION = r"(?m)^[ \t]*@(?:[\w.]+\.)?Generated\b"
BANNER = (
    _MARK + r"(?:@license\s+\S+\s+v?\d|\bupstream:\s*https?://|\bthe \S+ (?:contributors|authors|developers)\b|\b(?:released|licen[cs]ed|distributed) under the [^\n]{0,40}\blicen[cs]e\b)"
    r"|(?s)__version__\s*=.*__license__\s*="
)
NOT_GENERATED = r"(?i)\bnot (?:auto[- ]?)?generated\b"
HEAD_LINES = 6
#: The comments a text begins with, however long they are.
_LEAD = r"^(?:[ \t\r]*+(?:(?://|#|;|--)[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/[^\n]*+)?|<!--(?:[^-]|-(?!->))*+(?:-->[^\n]*+)?)?(?:\n|$))*+"
#: So many characters of agreeing code, blanks folded, make a subtree a shared one; half of a file's code must agree.
LEAST_SHARED = 160


def _snippet(code: Column, first_line: Column) -> dict[str, Column]:
    """Flags of one snippet."""
    head = F.when(F.coalesce(first_line, F.lit(1)) <= 3, F.concat(F.substring_index(code, "\n", HEAD_LINES), F.lit("\n"), F.regexp_extract(code, _LEAD, 0)))
    lines = F.regexp_count(code, F.lit("\n")) + 1
    bare = F.regexp_replace(code, "\"(?:[^\"\\\\\\n]|\\\\.)*(?:\"|$)|'(?:[^'\\\\\\n]|\\\\.)*(?:'|$)", "")
    size = F.length(bare)
    rest = F.length(F.regexp_replace(code, "0x[0-9a-fA-F]+|\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?|[A-Za-z0-9+/=_\\-]{96,}|[\\s\\[\\]{}(),;.\"'+\\-]", ""))
    return {
        "mark": head.rlike(GENERATOR_MARK) & ~head.rlike(NOT_GENERATED) | head.rlike(GENERATOR_ANNOTATION),
        "banner": head.rlike(BANNER),
        # Many signs and letters to a line, hardly a blank among them.
        "dense": (size >= 120) & (size / lines > 110) & (F.regexp_count(bare, F.lit("\\s")) / size < 0.07) & (F.regexp_count(bare, F.lit("[;{}()=,.]")) / size > 0.15),
        # Little is left without numbers, encoded runs and separators.
        "data": (F.length(code) >= 60) & (rest / F.length(code) < 0.2) & ~code.contains("-----BEGIN"),
    }


def leaves(findings: DataFrame) -> DataFrame:
    """repo, path, snippet (a hash, blanks folded), size and the flags of each different snippet of a file."""
    folded = F.regexp_replace("code_snippet", "\\s+", " ")
    kept = findings.where("repo IS NOT NULL AND file_path IS NOT NULL").select(
        "repo", F.col("file_path").alias("path"), F.xxhash64(folded).alias("snippet"), F.coalesce(F.length(folded), F.lit(0)).alias("size"),
        *[F.coalesce(flag.cast("int"), F.lit(0)).alias(name) for name, flag in _snippet(F.col("code_snippet"), F.col("start_line")).items()],
    )
    return kept.groupBy("repo", "path", "snippet").agg(F.max("size").alias("size"), *[F.max(c).alias(c) for c in ("mark", "banner", "dense", "data")])


def kin(tree: DataFrame) -> DataFrame:
    """repo, kin: repositories whose roots are equal, with the least name that stands for them; one number per repository is grouped."""
    roots = tree.groupBy("repo").agg(F.bit_xor(F.xxhash64("path", "snippet")).alias("root"), F.count("*").alias("n"))
    same = roots.groupBy("root", "n").agg(F.min("repo").alias("kin"), F.count("*").alias("k")).where("k > 1")
    return roots.join(same, ["root", "n"]).select("repo", "kin")


def shared_files(tree: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """repo, path of the files in a subtree that stands in unrelated repositories too (``tree``: rows of ``leaves``)."""
    parts = F.split("path", "/")
    leaf = tree.where("size > 0").select("repo", "path", "size", F.xxhash64(F.element_at(parts, -1), F.col("snippet")).alias("leaf"))
    both = leaf.groupBy("leaf").agg(F.min("repo").alias("r0"), F.max("repo").alias("r1")).where("r0 <> r1").select("leaf")
    some = leaf.join(both, "leaf", "left_semi").join(kin(tree), "repo", "left").withColumn("owner", F.coalesce("kin", "repo"))
    # Bottom-up along the path: the hash below each ancestor, the file itself first.
    names = F.reverse(F.slice(parts, 1, F.size(parts) - 1))
    chain = F.aggregate(names, F.array("leaf"), lambda acc, name: F.array_append(acc, F.xxhash64(name, F.element_at(acc, -1))))
    spread_ = some.select("repo", "path", "owner", "size", F.size(parts).alias("depth"), F.posexplode(chain).alias("up", "hash"))
    node = F.xxhash64("repo", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth") - F.col("up")), "/"))
    spread_ = spread_.withColumn("node", node)
    common = spread_.groupBy("hash", "up").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("hash", "up")
    agreeing = spread_.join(common, ["hash", "up"], "left_semi")
    marked = agreeing.groupBy("node").agg(F.sum("size").alias("shared")).where(F.col("shared") >= least).select("node")
    # Of the files under a marked node, those that agree in half of their code at least.
    agreed = agreeing.join(marked, "node", "left_semi").groupBy("repo", "path", "up").agg(F.sum("size").alias("agreed")).groupBy("repo", "path").agg(F.max("agreed").alias("agreed"))
    whole = tree.groupBy("repo", "path").agg(F.sum("size").alias("whole"))
    return agreed.join(whole, ["repo", "path"]).where("agreed * 2 >= whole").select("repo", "path")


def not_hand_written(findings: DataFrame) -> DataFrame:
    """repo, file_path, kind: files that are generated, minified, vendored or data, with the first rule that says so."""
    tree = cut(leaves(findings), "source-leaves")
    copies = shared_files(tree).withColumn("copy", F.lit(True))
    files = tree.groupBy("repo", "path").agg(F.max("mark").alias("mark"), F.max("banner").alias("banner"), F.max("dense").alias("dense"), F.avg("data").alias("data"))
    path = F.col("path")
    kind = (
        F.when(F.col("copy"), "shared subtree")
        .when(path.rlike(VENDORED), "vendored")
        .when(path.rlike(GENERATED), "generated")
        .when(F.col("mark") == 1, "generated")
        .when(F.col("banner") == 1, "vendored")
        .when(path.rlike(OUTPUT) | (F.col("dense") == 1), "minified")
        .when(F.col("data") >= 0.5, "data")
    )
    return files.join(copies, ["repo", "path"], "left").select("repo", path.alias("file_path"), kind.alias("kind")).where("kind IS NOT NULL")
