"""Graph queries over edges (callee, caller): callers, ambiguity, bounded reach, traces, cycles.

Frontiers are DataFrames: a step is a join with the edges and an anti-join with what has been visited. Each step is
checkpointed, so that plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import saved


def fan_in(edges: DataFrame) -> DataFrame:
    """(callee, n_calls, n_callers)."""
    return edges.groupBy("callee").agg(F.count("*").alias("n_calls"), F.count_distinct("caller").alias("n_callers"))


def top_callers(edges: DataFrame, most: int) -> DataFrame:
    """(callee, caller, n, place): the first callers of each by number of calls, then name."""
    n = edges.groupBy("callee", "caller").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("callee").orderBy(F.desc("n"), "caller"))
    return n.withColumn("place", place).where(F.col("place") <= most)


def ambiguous(declarations: DataFrame) -> DataFrame:
    """(key, n) of keys that are declared more than once."""
    return declarations.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def reach(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, key, depth): keys that reach each root backwards within ``depth`` calls, with the least depth; roots have 0."""
    steps = saved(edges.select(F.col("callee").alias("_to"), F.col("caller").alias("_from")).distinct())
    visited = frontier = saved(roots.select(F.col("key").alias("root"), "key", F.lit(0).alias("depth")).distinct())
    for k in range(1, depth + 1):
        ahead = frontier.join(steps, F.col("key") == F.col("_to")).select("root", F.col("_from").alias("key")).distinct()
        frontier = saved(ahead.join(visited.select("root", "key"), ["root", "key"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def bounded(reached: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Roots whose search met the limit while a key there still had callers."""
    last = reached.where(F.col("depth") == depth)
    return last.join(edges.select(F.col("callee").alias("key")).distinct(), "key", "left_semi").select("root").distinct()


def trace(root: str, edges: DataFrame, declarations: DataFrame, depth: int = 6, nodes: int = 60) -> DataFrame:
    """(callee, caller, depth): the reverse call tree of one key. Keys declared more than once are met but not followed.

    The limit on nodes holds breadth first; within a depth, keys are admitted by name.
    """
    many = saved(ambiguous(declarations).select("key"))
    steps = saved(edges.select("callee", "caller").distinct())
    spark = edges.sparkSession
    visited = frontier = saved(spark.createDataFrame([(root, 0)], "key string, depth int"))
    out = None
    for k in range(1, depth + 1):
        ahead = frontier.join(steps, F.col("key") == F.col("callee")).select("callee", "caller", F.lit(k).alias("depth"))
        new = ahead.select(F.col("caller").alias("key")).distinct().join(visited.select("key"), "key", "left_anti")
        room = nodes - visited.count()
        admitted = saved(new.orderBy("key").limit(max(0, room)).withColumn("depth", F.lit(k)))
        known = visited.select("key").unionByName(admitted.select("key"))
        ahead = saved(ahead.join(known.select(F.col("key").alias("caller")), "caller", "left_semi").select("callee", "caller", "depth"))
        out = ahead if out is None else out.unionByName(ahead)
        visited = saved(visited.unionByName(admitted))
        frontier = admitted.join(many, "key", "left_anti")
        if frontier.isEmpty():
            break
    first = out.groupBy("callee", "caller").agg(F.min("depth").alias("depth"))
    return first


def _degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, next) of edges (a, b): ``next`` is the only successor where ``n_out`` is 1; a written table."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(None).alias("out"), F.lit(1).alias("into"))))
    each = edges.select(ends.alias("x")).select("x.*")
    return saved(each.groupBy("node").agg(F.count("out").alias("n_out"), F.sum("into").alias("n_in"), F.min("out").alias("next")))


def _followed(chain: DataFrame, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pointers (node, next) of ``n`` nodes followed to their ends by doubling.

    (node, jump, low, open): ``jump`` is the first node ahead that isn't in ``chain``; where there is none (``open``), the
    way runs into a ring, ``jump`` lies on it, and ``low`` is the smallest node met. Then the tables of each doubling
    (node, jump), which lead 1, 2, 4, ... nodes ahead, or to the end.
    """
    now = saved(chain.select("node", F.col("next").alias("jump"), F.col("node").alias("low")))
    steps, reach, left = [now], 1, None
    while True:
        ahead = now.select(F.col("node").alias("_n"), F.col("jump").alias("_jump"), F.col("low").alias("_low"))
        both = now.join(ahead, F.col("jump") == F.col("_n"), "left")
        now = saved(both.select("node", F.coalesce("_jump", "jump").alias("jump"), F.least("low", "_low").alias("low"), F.col("_n").isNotNull().alias("open")))
        reach *= 2
        before, left = left, now.where("open").count()
        # once as many nodes are passed as there are, what is open can only go round
        if not left or reach >= 2 * n:
            return now, steps
        steps.append(now)


def _contracted(edges: DataFrame, degrees: DataFrame, n: int) -> tuple[DataFrame, tuple, DataFrame]:
    """``edges`` without nodes that have one successor: each is merged into the first node ahead that has more, or none.

    A cycle through a merged node goes through that end, so that the others' components stay as they are. Also what is
    needed to place the merged nodes later (edges into them, steps), and (node, colour) of rings of merged nodes alone.
    """
    end, steps = _followed(degrees.where("n_out = 1").select("node", "next"), n)
    end = end.select(F.col("node").alias("_node"), "jump", "low", "open")
    turning = end.where("open").select(F.col("jump").alias("_on")).distinct()
    rings = saved(end.join(turning, F.col("_node") == F.col("_on")).select(F.col("_node").alias("node"), F.col("low").alias("colour")))
    # an edge out of a merged node is the one that it is merged along
    rest = edges.join(end.select(F.col("_node").alias("_a")), F.col("a") == F.col("_a"), "left_anti")
    rest = saved(rest.join(end, F.col("b") == F.col("_node"), "left").where("open is null or not open").select("a", "b", "jump"))
    entries = rest.where("jump is not null")
    edges = saved(rest.select("a", F.coalesce("jump", "b").alias("b")).where("a <> b").distinct())
    return edges, (entries, steps), rings


def _placed(colour: DataFrame, entries: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``colour`` (node, colour) with the merged nodes that are in their end's component.

    Those are where an edge enters from that component, and all nodes from there to the end.
    """
    of = lambda x: colour.select(F.col("node").alias(f"_{x}"), F.col("colour").alias(f"c_{x}"))
    met = entries.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("e"), F.col("jump") == F.col("_e"), "left")
    met = met.withColumns({"c_a": F.coalesce("c_a", "a"), "c_e": F.coalesce("c_e", "jump")}).where("c_a = c_e")
    marked = saved(met.select(F.col("b").alias("node"), F.col("c_e").alias("colour")).distinct())
    if marked.isEmpty():
        return colour
    for step in steps:
        ahead = marked.join(step.select(F.col("node").alias("_n"), "jump"), F.col("node") == F.col("_n")).select(F.col("jump").alias("node"), "colour")
        marked = saved(marked.union(ahead).distinct())
    return saved(colour.union(marked).distinct())


def _coloured(now: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, colour) of those ``nodes`` whose component is found: each node takes the smallest node that reaches it as its
    colour, and those that reach that node inside the colour are its component."""
    colour = nodes.select("node", F.col("node").alias("colour"))
    changed = True
    while changed:
        near = now.join(colour, F.col("a") == F.col("node")).groupBy(F.col("b").alias("_b")).agg(F.min("colour").alias("_c"))
        after = saved(colour.join(near, F.col("node") == F.col("_b"), "left").select("node", F.least("colour", "_c").alias("colour"), (F.col("_c") < F.col("colour")).alias("moved")))
        changed = not after.where("moved").isEmpty()
        colour = after.select("node", "colour")
    inside = now.join(colour.withColumnsRenamed({"node": "_n", "colour": "ca"}), F.col("a") == F.col("_n")).join(colour.withColumnsRenamed({"node": "_m", "colour": "cb"}), F.col("b") == F.col("_m")).where("ca = cb")
    inside = saved(inside.select("a", "b"))
    ahead = met = saved(colour.where("node = colour"))
    while not ahead.isEmpty():
        back = inside.join(ahead, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "colour").distinct()
        ahead = saved(back.join(met.select("node"), "node", "left_anti"))
        met = met.unionByName(ahead)
    return saved(met)


def components(edges: DataFrame) -> DataFrame:
    """(node, colour) of edges (a, b), distinct and without loops: nodes of one strongly connected component share a colour.

    Nodes that can't be told from a single one may be missing. A round drops nodes that nothing enters or nothing leaves,
    and merges nodes that have one successor into the end of their way, which is found by doubling; the next round
    looks at the edges turned round, so that nodes with one predecessor follow. Paths, rings, trees and what hangs on them are gone after
    rounds that grow with the logarithm of their length. What is left has two edges in and two out at every node, and is
    coloured, after which the rest goes round again.
    """
    now, found, layers = edges, None, []
    while True:
        degrees = _degrees(now)
        n, dead, chain, turned = degrees.agg(F.count("*"), *(F.count_if(F.expr(x)) for x in ("n_out = 0 or n_in = 0", "n_out = 1", "n_in = 1"))).first()
        if not n:
            break
        # turned round, the chains of predecessors are those of successors
        idle = not (chain or dead or turned)
        if chain:
            now, layer, rings = _contracted(now, degrees, chain)
            layers.append(layer)
            found = rings if found is None else found.union(rings)
        elif dead:
            for end, none in (("a", "n_in = 0"), ("b", "n_out = 0")):
                now = now.join(degrees.where(none).select(F.col("node").alias("_n")), F.col(end) == F.col("_n"), "left_anti")
            now = saved(now)
        elif idle:
            met = _coloured(now, degrees)
            found = met if found is None else found.union(met)
            if met.count() == n:
                break
            for end in ("a", "b"):
                now = now.join(met.select(F.col("node").alias("_n")), F.col(end) == F.col("_n"), "left_anti")
            now = saved(now)
        now = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
    colour = edges.select(F.col("a").alias("node"), F.col("a").alias("colour")).limit(0) if found is None else found
    for entries, steps in reversed(layers):
        colour = _placed(colour, entries, steps)
    return colour


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component, size): nodes on cycles of two or more, by the smallest node of their component.

    A row is a node or an edge: no closure is made.
    """
    now = saved(edges.where("callee <> caller").select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct())
    out = components(now).withColumnRenamed("colour", "_c")
    # a component's rows are counted before they meet their nodes, and one may be as large as the graph
    size = out.groupBy("_c").agg(F.count("*").alias("size"), F.min("node").alias("component")).where("size > 1")
    return out.join(size, "_c").select("node", "component", "size")
