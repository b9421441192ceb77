"""Graph walks over edge tables: one hop, bounded many hops, extends chains.

Many hops are rounds of one join each, with the frontier reduced to nodes not seen before; the number of rounds is
bounded. Nested trees within one row are walked a level a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.imports import import_edges  # noqa: F401  G5
from ledgerlens.operators.intervals import points_in
from ledgerlens.registry import REGISTRY, table
from ledgerlens.tables import descended, dropped, kept

#: Blocks that the symbols of one range are dealt to.
SYMBOL_BLOCKS = 4


def consumers(edges: DataFrame, name: str) -> DataFrame:
    """Who depends on a package: src of edges to it (G1)."""
    return edges.where(F.col("dst") == name).select(F.col("src").alias("consumer")).distinct()


def producers(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("src") == name).select(F.col("dst").alias("producer")).distinct()


def reverse_lookup(edges: DataFrame) -> DataFrame:
    """(module, file) of every importing file, once (G2): rows and not a list, as a common module has a file in each repository."""
    return edges.select(F.col("dst").alias("module"), F.col("src").alias("file")).distinct()


def references(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, file, line, col) of every occurrence of the asked symbols, each once."""
    return occurrences.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "file", "line", "col").distinct()


def tests_exercising(coverage: DataFrame, definitions: DataFrame) -> DataFrame:
    """(symbol, test) where a test covers a line of the symbol's definition.

    Of a test's lines in a range, only the first counts: the one whose predecessor in the file lies before the range. So a range
    meets a test once, and its symbols, which come as blocks, need no `distinct`; only symbols of several ranges do.
    """
    before = F.lag("line").over(Window.partitionBy("file", "test").orderBy("line"))
    lines = coverage.select("file", "line", "test", before.alias("before")).where("before is null or before < line")
    place = ["file", "first_line", "last_line"]
    own = definitions.groupBy("symbol").agg(F.collect_set(F.struct(*place)).alias("places"))
    symbols = kept(own.select("symbol", (F.size("places") > 1).alias("several"), F.explode("places").alias("place")).select("symbol", "several", "place.*"))

    def met(of: DataFrame) -> DataFrame:
        ranges = of.groupBy(*place, F.pmod(F.xxhash64("symbol"), F.lit(SYMBOL_BLOCKS)).alias("block")).agg(F.collect_list(F.struct("symbol")).alias("symbols"))
        pairs = points_in(lines, ranges, ["file"], "line", "first_line", "last_line").where("before is null or before < first_line")
        return pairs.select(F.explode("symbols").alias("s"), "test").select("s.symbol", "test")

    single, several = symbols.where("not several"), symbols.where("several")
    return met(single) if several.isEmpty() else met(single).unionByName(met(several).distinct())


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = 5, max_nodes: int | None = None) -> DataFrame:
    """(root, node, depth): nodes within max_depth steps, each at its least depth, the root at 0.

    max_nodes keeps the first nodes of each root in breadth-first order, by depth and name. Each round's frontier is a table
    in the shared folder, so that no round computes the ones before it again; they are removed when the driver ends.
    """
    frontier = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    if max_nodes is not None:
        order = Window.partitionBy("root").orderBy("depth", "node")
        seen = seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_nodes).drop("n")
    return seen


def _cut(chain: Column, name: Column) -> Column:
    """A chain of parents up to the first that is the node itself or was met before, that one included."""
    places = F.filter(F.sequence(F.lit(1), F.size(chain)), lambda i: F.array_contains(F.slice(chain, 1, i - 1), F.element_at(chain, i.cast("int"))) | (F.element_at(chain, i.cast("int")) == name))
    first = F.get(places, F.lit(0))
    return F.when(F.size(chain) == 0, chain).when(first.isNull(), chain).otherwise(F.slice(chain, 1, first.cast("int")))


def parent_chains(nodes: DataFrame, max_depth: int) -> DataFrame:
    """(name, chain): each node's parents from the nearest on, `max_depth` at most, up to a root or to the first one met twice.

    Pointer doubling: after round k a chain has its first 2^k parents, and the next round joins it with the chain of its
    last one; so depth d takes log2(d) joins of one row a node.
    """
    links = nodes.where("parent is not null").select("name", F.array("parent").alias("chain")).distinct()
    now = kept(links.withColumn("open", F.col("chain")[0] != F.col("name")))
    length = 1
    while length < max_depth:
        tails = now.select(F.col("name").alias("tail"), F.col("chain").alias("more"), F.col("open").alias("tail_open"))
        joined = now.withColumn("tail", F.when(F.col("open"), F.element_at("chain", -1))).join(tails, "tail", "left")
        whole = F.concat("chain", F.coalesce("more", F.array().cast(now.schema["chain"].dataType)))
        after = joined.select("name", whole.alias("whole"), F.col("open") & F.coalesce("tail_open", F.lit(False)) & (F.size("more") == length)).toDF("name", "whole", "going")
        cut = after.withColumn("chain", _cut(F.col("whole"), F.col("name")))
        then = kept(cut.select("name", "chain", (F.col("going") & (F.size("chain") == F.size("whole")) & ~_repeats(F.col("chain"), F.col("name"))).alias("open")))
        dropped(now)
        now, length = then, 2 * length
    return now.select("name", F.slice("chain", 1, max_depth).alias("chain"))


def _repeats(chain: Column, name: Column) -> Column:
    """Whether a chain's last node is the node itself or was met before; others can't be, once it is cut."""
    last = F.element_at(chain, -1)
    return (last == name) | F.array_contains(F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0))), last)


def extends_chain(nodes: DataFrame, max_depth: int = 8) -> DataFrame:
    """(start, name, depth, path, issue) along each node's parents; a name seen before is a cycle.

    `nodes` has (name, parent); a name may have several parents. See `parent_chains` for the joins.
    """
    starts = nodes.select("name").distinct()
    own = starts.select(F.col("name").alias("start"), "name", F.lit(0).alias("depth"), F.array("name").alias("path"), F.lit(None).cast("string").alias("issue"))
    chains = parent_chains(nodes, max_depth)
    at = chains.select(F.col("name").alias("start"), "chain", F.posexplode("chain").alias("p", "name"))
    path = F.concat(F.array("start"), F.slice("chain", 1, F.col("p") + 1))
    issue = F.when(F.array_contains(F.slice(path, 1, F.col("p") + 1), F.col("name")), "cycle").when(F.col("p") + 1 >= max_depth, "too_deep")
    rows = at.select("start", "name", (F.col("p") + 1).alias("depth"), path.alias("path"), issue.alias("issue"))
    return own.unionByName(rows.distinct())


def fallback_chain(attempts: DataFrame, most: int = 4) -> DataFrame:
    """First trusted attempt among the first `most`, else the last of them (G10); deeper ones aren't made."""
    made = attempts.where(F.col("depth") < most)
    trusted = F.min(F.when(F.col("trusted"), F.struct("depth", "name"))).alias("t")
    return made.groupBy("query").agg(trusted, F.max(F.struct("depth", "name")).alias("l")).select(
        "query", F.coalesce("t.name", "l.name").alias("name"), F.col("t").isNotNull().alias("trusted"), F.coalesce("t.depth", "l.depth").alias("degradations")
    )


def nested_dependencies(spark: SparkSession, locks: str) -> DataFrame:
    """(id, path, name, version) of every entry of a nested dependency tree in JSON (G9); `locks` has (id, tree)."""
    parsed = spark.sql(f"SELECT id, CAST('' AS STRING) AS path, try_parse_json(tree) AS node FROM {locks}")
    return dependency_levels(parsed, lambda path, name: F.concat(path, F.lit("/"), name)).select("id", "path", "name", "version")


def dependency_levels(roots: DataFrame, path_of: Callable[[Column, Column], Column]) -> DataFrame:
    """The columns of `roots` with name and version in place of the variant `node`, for each entry below it; `path_of` makes an entry's path of its parent's and its name."""
    kept_columns = [c for c in roots.columns if c not in ("path", "node")]

    def entries(parents: DataFrame) -> DataFrame:
        inside = F.try_variant_get("node", F.lit("$.dependencies"), "variant").alias("inside")
        below = parents.select(*kept_columns, F.col("path").alias("above"), inside).where("inside is not null")
        rows = below.lateralJoin(below.sparkSession.tvf.variant_explode(F.col("inside").outer()))
        return rows.select(*kept_columns, path_of(F.col("above"), F.col("key")).alias("path"), F.col("key").alias("name"), F.try_variant_get("value", F.lit("$.version"), "string").alias("version"), F.col("value").alias("node"))

    return descended(entries(roots), entries).drop("node")


def _page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("url", links.alias("dst")).distinct()


@REGISTRY.query("reverse_lookup", r"""SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS module, url AS file FROM pages""")
def reverse_lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse_lookup(_page_edges(spark, sf_dir).withColumnRenamed("url", "src"))


@REGISTRY.query(
    "bounded_reach",
    """
    WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part),
    r(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part
      UNION SELECT root, dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 4)
    SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2
    """,
)
def bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")).union(part.select("p_partkey", F.expr("p_partkey div 3"))).distinct()
    return reach(edges, part.select(F.col("p_partkey").alias("node")), 4)


_PARENT = "CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 7 THEN p_partkey + 1 WHEN p_partkey % 10 = 8 THEN p_partkey - 1 ELSE CAST(floor(p_partkey * 0.9) AS BIGINT) END"


@REGISTRY.query(
    "extends_chain",
    f"""
    WITH RECURSIVE n AS (SELECT p_partkey AS name, {_PARENT} AS parent FROM part),
    c(start, name, depth, path, issue) AS (
      SELECT name, name, 0, [name], NULL::VARCHAR FROM n
      UNION ALL SELECT c.start, n.parent, c.depth + 1, list_append(c.path, n.parent), CASE WHEN list_contains(c.path, n.parent) THEN 'cycle' WHEN c.depth + 1 >= 8 THEN 'too_deep' END
      FROM c JOIN n ON c.name = n.name WHERE n.parent IS NOT NULL AND c.issue IS NULL)
    SELECT * FROM c
    """,
)
def extends_chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extends_chain(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("name"), F.expr(_PARENT).cast("bigint").alias("parent")))


@REGISTRY.query(
    "fallback_chain",
    """
    WITH a AS (SELECT l_orderkey AS query, l_linenumber - 1 AS depth, l_partkey AS name, l_returnflag = 'N' AS trusted FROM lineitem WHERE l_linenumber <= 4)
    SELECT query, coalesce(min_by(name, (depth, name)) FILTER (trusted), max_by(name, (depth, name))) AS name, bool_or(trusted) AS trusted,
           coalesce(min(depth) FILTER (trusted), max(depth)) AS degradations FROM a GROUP BY query
    """,
)
def fallback_chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), (F.col("l_linenumber") - 1).alias("depth"), F.col("l_partkey").alias("name"), (F.col("l_returnflag") == "N").alias("trusted")
    )
    return fallback_chain(rows)


@REGISTRY.query("refs_to", "SELECT DISTINCT l_partkey AS symbol, l_orderkey AS file, l_linenumber AS line, l_suppkey AS col FROM lineitem SEMI JOIN (SELECT p_partkey AS l_partkey FROM part WHERE p_size > 40) USING (l_partkey)")
def refs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the large parts stand."""
    occurrences = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("col"))
    return references(occurrences, table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("symbol")))


@REGISTRY.query(
    "covering_tests",
    """
    WITH d AS (SELECT p_partkey AS symbol, p_size AS file, p_partkey * 7 % 5000 AS first_line, p_partkey * 7 % 5000 + CASE WHEN p_partkey % 50 = 0 THEN 3000 ELSE p_partkey % 40 END AS last_line FROM part WHERE p_partkey % 4 = 0),
    c AS (SELECT l_partkey % 50 + 1 AS file, l_orderkey % 8000 AS line, l_suppkey AS test FROM lineitem)
    SELECT DISTINCT symbol, test FROM c JOIN d ON c.file = d.file AND line BETWEEN first_line AND last_line
    """,
)
def covering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large files, definitions from one line to three thousand."""
    first = F.col("p_partkey") * 7 % 5000
    last = first + F.when(F.col("p_partkey") % 50 == 0, 3000).otherwise(F.col("p_partkey") % 40)
    definitions = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("symbol"), F.col("p_size").alias("file"), first.alias("first_line"), last.alias("last_line"))
    coverage = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50 + 1).alias("file"), (F.col("l_orderkey") % 8000).alias("line"), F.col("l_suppkey").alias("test"))
    return tests_exercising(coverage, definitions)
