"""Reachability, routes, components and dominators over edge tables.

Loops keep a frontier table and write it to the folder that the cluster shares
(spark.checkpoint.dir) each round, so plans stay short and lost executors cost
one round.
"""

from __future__ import annotations

import uuid
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_SCRATCH = "file:///tmp/checkpoints"


def _shared(spark) -> str:
    """The folder that the cluster shares, from the session's or the context's settings; a local session has one of its own."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset, and this cluster's machines share no local folder")
    return LOCAL_SCRATCH


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again; it goes when the driver's JVM ends."""
    spark = df.sparkSession
    where = f"{_shared(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", stop: DataFrame | None = None) -> DataFrame:
    """node, depth: nodes that paths from ``roots`` (node) reach, with the fewest steps; roots at depth 0.

    Paths don't leave nodes of ``stop`` (node).
    """
    seen = frontier = staged(roots.select(node).distinct().withColumn("depth", F.lit(0)))
    steps = edges.select(F.col(src).alias(node), F.col(dst).alias("_next")).distinct()
    if stop is not None:
        steps = steps.join(stop.select(node), node, "left_anti")
    depth = 0
    while True:
        depth += 1
        step = frontier.join(steps, node).select(F.col("_next").alias(node)).distinct()
        frontier = staged(step.join(seen, node, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def route(edges: DataFrame, start: DataFrame, goal: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """start, goal, path: a shortest path from each start to each goal it reaches; of several the first in order of names."""
    seen = frontier = staged(start.select(F.col(start.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path")))
    steps = edges.select(F.col(src).alias("at"), F.col(dst).alias("_next")).distinct()
    while True:
        step = frontier.join(steps, "at").select("start", F.col("_next").alias("at"), F.concat("path", F.array("_next")).alias("path"))
        best = step.groupBy("start", "at").agg(F.min("path").alias("path")).join(seen.select("start", "at"), ["start", "at"], "left_anti")
        frontier = staged(best)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(goal.select(F.col(goal.columns[0]).alias("at")).distinct(), "at").select("start", F.col("at").alias("goal"), "path")


def _forest(batches):
    """The links of each batch as links of its own nodes to the least that they reach there; a batch is bounded."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ends = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
        nodes, index = np.unique(np.concatenate(ends), return_inverse=True)
        parent = np.arange(len(nodes))
        x, y = index[: len(ends[0])], index[len(ends[0]) :]
        while len(x):
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(parent, high, low)  # each node hangs below its least neighbour, then below that one's own root
            while not (parent[parent] == parent).all():
                parent = parent[parent]
            x, y = parent[x], parent[y]
            apart = x != y
            x, y = x[apart], y[apart]
        below = np.flatnonzero(parent != np.arange(len(nodes)))
        kinds = [f.type for f in batch.schema]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below], kinds[0]), pa.array(nodes[parent[below]], kinds[1])], names=["u", "v"])


def _towards_least(edges: DataFrame, whole: bool) -> DataFrame:
    """One star step on edges u > v.  The large star (``whole``) hangs each node's greater neighbours below the least of its neighbours
    and itself; the small star hangs its lesser neighbours, and itself, below the least of those."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(turned) if whole else edges
    # Minima combine before the shuffle, so the neighbours of a hub don't gather.
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    moved = (turned if whole else edges).join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not whole:
        moved = moved.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", told: list[int] | None = None) -> DataFrame:
    """node, component: nodes of links with the least node they reach.

    Large and small stars alternate until every node hangs below its least one;
    what a batch holds is contracted before.  Rounds grow with the logarithm of
    the longest chain, and edges never outgrow the links.  Links with a null
    end are left out; a node linked with itself alone is its own component.
    The number of rounds is appended to ``told``.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    kind = ends.schema["u"].dataType.simpleString()
    ends = ends.select("u", F.col("v").cast(kind).alias("v"))
    proper = ends.where("u <> v").mapInArrow(_forest, f"u {kind}, v {kind}")
    edges = staged(proper.distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())  # noqa: E731  two numbers
    now, rounds = mark(edges), 0
    while now[0]:
        rounds += 1
        after = staged(_towards_least(_towards_least(edges, True), False))
        before, now, edges = now, mark(after), after
        if now == before:
            break
    if told is not None:
        told.append(rounds)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    lone = ends.where("u = v").select(F.col("u").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(lone.select("node", F.col("node").alias("component")))


def one_caller(calls: DataFrame, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """callee, caller: functions that exactly one other function calls."""
    found = calls.where(F.col(caller) != F.col(callee)).groupBy(callee).agg(F.min(caller).alias("_lo"), F.max(caller).alias("_hi"))
    return found.where("_lo = _hi").select(callee, F.col("_lo").alias(caller))


def fixed_point(start: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """Nodes of ``start`` and all that call them, by any chain of calls: ``src`` calls ``dst``."""
    backwards = edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"))
    return reachable(backwards, start.select(F.col(node).alias("node"))).select(F.col("node").alias(node))


def _preorder(starts, after) -> tuple[array, array]:
    """Nodes in the order in which a depth-first walk from node 0 meets them, and for each the place of the one it came from.

    Node x leads to ``after[starts[x]:starts[x + 1]]``.
    """
    order, origin = array("i"), array("i")
    met = bytearray(len(starts) - 1)
    nodes, came = array("i", [0]), array("i", [0])
    while nodes:
        node, above = nodes.pop(), came.pop()
        if met[node]:
            continue
        met[node] = 1
        here = len(order)
        order.append(node)
        origin.append(above)
        for i in range(starts[node + 1] - 1, starts[node] - 1, -1):
            if not met[after[i]]:
                nodes.append(after[i])
                came.append(here)
    return order, origin


def _packed(a, b, n: int) -> tuple[array, array]:
    """Links from a to b of n nodes as starts and ends, in order."""
    import numpy as np

    order = np.lexsort((b, a))
    starts = np.append(0, np.cumsum(np.bincount(a, minlength=n)))
    return array("i", starts.astype(np.int32).tobytes()), array("i", np.asarray(b)[order].astype(np.int32).tobytes())


def immediate_dominators(after: list[list[int]]) -> tuple[list[int], list[int]]:
    """For a graph given as each node's successors: the nodes that node 0 reaches, in preorder, and the place of each one's immediate dominator there."""
    starts = array("i", [0])
    for x in after:
        starts.append(starts[-1] + len(x))
    order, idom = _idoms(starts, array("i", [y for x in after for y in x]))
    return list(order), list(idom)


def _idoms(starts, after) -> tuple[array, array]:
    """The same for a graph whose node x leads to ``after[starts[x]:starts[x + 1]]``; four bytes for each number it holds.

    Semi-dominators from the last node to the first, over paths that compress
    as they are walked; then each immediate dominator is the nearest node above
    that comes no later than the semi-dominator.
    """
    import numpy as np

    order, origin = _preorder(starts, after)
    n = len(order)
    place = np.full(len(starts) - 1, -1, np.int32)
    place[np.asarray(order)] = np.arange(n, dtype=np.int32)
    ends = np.repeat(place, np.diff(np.asarray(starts)))
    reached = ends >= 0
    begin, before = _packed(place[np.asarray(after)[reached]], ends[reached], n) if len(after) else (array("i", bytes(4 * (n + 1))), array("i"))
    del place, ends, reached
    semi, best, above = array("i", range(n)), array("i", range(n)), array("i", origin)

    def least_on_path(v: int, done: int) -> int:
        """Of the nodes from v up that are done (beyond ``done``), the one with the least semi-dominator; v itself if it isn't."""
        if v <= done:
            return v
        path = [v]
        while above[path[-1]] > done:
            path.append(above[path[-1]])
        top = path.pop()
        for u in reversed(path):
            if semi[best[above[u]]] < semi[best[u]]:
                best[u] = best[above[u]]
            above[u] = above[top]
        return best[v]

    for w in range(n - 1, 0, -1):
        least = origin[w]
        for i in range(begin[w], begin[w + 1]):
            least = min(least, semi[least_on_path(before[i], w)])
        semi[w] = least
    idom = array("i", origin)
    for w in range(1, n):
        at = origin[w]
        while at > semi[w]:
            at = idom[at]
        idom[w] = at
    return order, idom


def _dominated(least: int | None, names):
    """An applyInArrow function over one graph's nodes and edges, in any order: every node's dominator, sums and whether it is a part.

    All is held in arrays of numbers, none as objects.
    """

    def run(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        graph = rows.column("graph")[0].as_py()
        is_edge = pc.is_valid(rows.column("dst"))
        links = rows.filter(is_edge).select(["src", "dst"])
        facts = rows.filter(pc.invert(is_edge)).drop_columns(["graph", "dst"])
        kinds = [rows.schema.field("graph").type, rows.schema.field("src").type, rows.schema.field("src").type, pa.int64(), pa.int64(), pa.bool_()]
        del rows, is_edge
        # In one order whatever the rows' order; ends of edges that are no nodes weigh nothing.
        nodes = pc.unique(pa.chunked_array([*facts.column("src").chunks, *links.column("src").chunks, *links.column("dst").chunks], kinds[1]))
        nodes = nodes.take(pc.sort_indices(nodes))
        n = len(nodes)
        number = lambda c: pc.index_in(c, value_set=nodes).to_numpy().astype(np.int32) + 1
        of = number(facts.column("src"))

        def fact(name, default, kind):
            out = np.full(n + 1, default, kind)
            out[0] = 0
            out[of] = pc.fill_null(facts.column(name), default).to_numpy().astype(kind)
            return out

        total, items, told, pinned = fact("weight", 0, np.int64), fact("items", 1, np.int64), fact("entered", False, bool), fact("pinned", False, bool)
        a, b = number(links.column("src")), number(links.column("dst"))
        del facts, links, of
        a, b = a[a != b], b[a != b]
        if not told.any():
            told = np.ones(n + 1, bool)
            told[b] = False
        told[0] = False

        def entered():
            first = np.flatnonzero(told).astype(np.int32)
            return _packed(np.concatenate([np.zeros(len(first), np.int32), a]), np.concatenate([first, b]), n + 1)

        met = np.zeros(n + 1, bool)
        met[np.asarray(_preorder(*entered())[0])] = True
        told |= ~met
        told[0] = False
        order, idom = _idoms(*entered())
        del a, b, met, told
        order = np.asarray(order)
        total, items, pinned = array("q", total[order].tobytes()), array("q", items[order].tobytes()), pinned[order]
        for w in range(len(order) - 1, 0, -1):
            total[idom[w]] += total[w]
            items[idom[w]] += items[w]
        above, sums, counts = np.asarray(idom), np.asarray(total), np.asarray(items)
        movable = np.zeros(len(order), bool)
        if least is not None:
            movable = ~pinned & (counts >= 2) & (sums >= least) & (sums[0] - sums >= least)
        movable[0] = False
        taken = bytearray(movable.tobytes())
        for w in range(1, len(order)):
            taken[w] |= taken[idom[w]]
        part = movable & ~np.frombuffer(taken, bool)[above]
        name = nodes.take(pa.array(order[1:] - 1))
        over = order[above[1:]]
        dominator = nodes.take(pa.array(np.maximum(over - 1, 0), mask=over == 0))
        return pa.table([pa.array([graph], kinds[0]).take(pa.array(np.zeros(n, np.int32))), name, dominator, pa.array(sums[1:]), pa.array(counts[1:]), pa.array(part[1:])], names=names)

    return run


def _judged(nodes: DataFrame, edges: DataFrame, least: int | None) -> DataFrame:
    kind, graph = nodes.schema["node"].dataType, nodes.schema["graph"].dataType
    have = set(nodes.columns)
    fact = lambda name, as_, default: (F.col(name) if name in have else F.lit(default)).cast(as_).alias(name)
    rows = nodes.where("node is not null").select("graph", F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), fact("weight", "bigint", 0), fact("items", "bigint", 1), fact("entered", "boolean", None), fact("pinned", "boolean", None))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("weight", "bigint"), ("items", "bigint"), ("entered", "boolean"), ("pinned", "boolean"))]
    steps = edges.where("src is not null and dst is not null").select("graph", F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct()
    rows = rows.unionByName(steps.select("graph", "src", "dst", *none))
    names = ["graph", "node", "idom", "total", "items", "part"]
    schema = f"graph {graph.simpleString()}, node {kind.simpleString()}, idom {kind.simpleString()}, total bigint, items bigint, part boolean"
    return rows.groupBy("graph").applyInArrow(_dominated(least, names), schema)


def dominators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, idom, total: each node's immediate dominator (null at the outside) and its weight with all it dominates.

    ``nodes`` is graph, node, weight, and if known ``entered``: the nodes that
    the outside reaches; without any such, those that no edge enters.  ``edges``
    is graph, src, dst.  Nodes that the outside doesn't reach so get an edge
    from it, every one of them.  A graph is one file's items, judged in one
    task in time that grows nearly with its edges.  Rows with null nodes or
    ends are left out; edges that repeat count once.
    """
    return _judged(nodes, edges, None).select("graph", "node", "idom", "total")


def largest_parts(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """graph, node, total, items: the parts that could move as a whole, with what they hold, that no larger such part holds.

    A part is a node with all it dominates.  It may move if the node isn't
    ``pinned``, it holds two items (``items`` of nodes, 1 where not given) and a
    weight of ``least``, and the graph keeps as much besides.
    """
    return _judged(nodes, edges, least).where("part").select("graph", "node", "total", "items")
