"""Graph analytics over edges ``src, dst``: ranks, cycles, communities and bounded traversals.

Loops run on the driver, but all they hold there are counts; every round's frontier or
state is a checkpointed table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, dealt, discard

DAMPING, ROUNDS, TOLERANCE = 0.85, 20, 1e-6
#: Rounds of an iteration between stored tables.
CUT_ROUNDS = 5
#: Edges that a task sorts or groups at once.
TASK_ROWS = 1 << 19
#: Levels of contraction, and rounds of moves in each.
LEVELS, MOVES = 64, 8
#: Modes of a trace and the kinds of edges that each follows.
MODES = {
    "calls": ("call",),
    "data_flow": ("call", "data_flow"),
    "cross_service": ("http_call", "emit", "listen", "data_flow"),
    "all": ("call", "data_flow", "http_call", "emit", "listen", "import", "type_ref", "extend", "implement"),
}


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()


def tasks(df: DataFrame) -> int:
    """Over how many tasks ``df``, a table, is spread so that none holds more than about ``TASK_ROWS`` of its rows."""
    return max(1, math.ceil(df.count() / TASK_ROWS))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def pagerank(edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``node, rank`` over the largest rank.  Loops are left out, parallel edges count each, and what ends in a sink is lost.

    Edges are summed up to weights once and lie in buckets by source; each round joins them there with the ranks and sums by target, so that it shuffles what
    goes to targets alone.  Ranks are stored every fifth round, where their movement is tested too, so that the rounds between are one plan.
    """
    lines = edges.where("src <> dst").select("src", "dst")
    n = max(tasks(lines), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    e = lines.repartition(n, "src").groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = dealt(e.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share"), "src", n)
    all_nodes = cut(nodes(edges))
    count = all_nodes.count()
    ranks = cut(all_nodes.withColumn("rank", F.lit(1.0 / max(count, 1))))
    for r in range(1, rounds + 1):
        got = out.join(ranks.hint("shuffle_hash"), F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = all_nodes.join(got, F.col("node") == F.col("dst"), "left").select("node", (F.lit((1 - damping) / max(count, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if r % CUT_ROUNDS and r < rounds:
            ranks = cut(new) if (r + 1) % CUT_ROUNDS == 0 else new
            continue
        new = cut(new)
        moved = new.join(ranks.select(F.col("node").alias("_n"), F.col("rank").alias("old")), F.col("node") == F.col("_n")).agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0 if tolerance > 0 else 1.0
        ranks = new
        if moved < tolerance:
            break
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(top).select("node", (F.col("rank") / F.col("top")).alias("rank"))  # top is one row


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each reaches, whatever the direction.

    Each node first hangs on its smallest smaller neighbour, which leaves edges between what others hang on.  These are contracted in rounds: a node goes
    to that of itself and its neighbours which comes first by a hash, another one in each round, so that every round takes a share of the nodes away
    whatever the shape of the graph.  A round reads only what is left; the places of nodes are read back once.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a is not null"))
    under = cut(e.where("a > b").groupBy("a").agg(F.min("b").alias("to")))
    ends = e.select(F.col("b").alias("node"), F.lit(None).alias("to"), F.lit(True).alias("held")).unionByName(under.select(F.col("a").alias("node"), "to", F.lit(False).alias("held")))
    known = cut(ends.groupBy("node").agg(F.max("to").alias("to"), F.max("held").alias("held")))
    moved = e.where("a > b").join(under, "a").where("b <> to").select(F.col("b").alias("a"), F.col("to").alias("b"))
    left = cut(moved.unionByName(known.where("held and to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))).distinct())
    discard(e)
    discard(under)
    steps = []
    while not left.isEmpty():
        met = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select("b", "a").toDF("node", "other"))
        place = lambda c: F.xxhash64(c, F.lit(len(steps)))  # noqa: B023, E731
        first = met.withColumn("h", place("other")).groupBy("node").agg(F.min_by("other", "h").alias("to"), F.min("h").alias("h"))
        steps.append(cut(first.select("node", F.when(place("node") <= F.col("h"), F.col("node")).otherwise(F.col("to")).alias("to"))))
        x, y = steps[-1].toDF("a", "x"), steps[-1].toDF("b", "y")
        after = cut(left.join(x, "a").join(y, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        discard(left)
        left = after
    own = known.select("node", F.coalesce("to", "node").alias("to"))
    if not steps:
        return own.withColumnRenamed("to", "component")
    roots = steps.pop()
    while steps:
        to = steps.pop()
        roots = to.join(roots.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        if len(steps) % CUT_ROUNDS == 0:
            roots = cut(roots)
    names = roots.join(roots.groupBy("to").agg(F.min("node").alias("component")), "to").select(F.col("node").alias("to"), "component")
    return own.join(names, "to", "left").select("node", F.coalesce("component", "to").alias("component"))


def _reach(edges: DataFrame, start: DataFrame, within: DataFrame) -> DataFrame:
    """Pairs ``node, colour`` reached from ``start(node, colour)`` along edges that stay in the colour; every two hops add a table."""
    front = seen = cut(start)

    def hop(of: DataFrame) -> DataFrame:
        step = of.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "colour").join(within, ["node", "colour"], "left_semi")
        return step.distinct().join(seen, ["node", "colour"], "left_anti")

    hops = 0
    while True:
        one = hop(front)
        two = hop(one).join(one, ["node", "colour"], "left_anti")
        new = cut(one.withColumn("last", F.lit(False)).unionByName(two.withColumn("last", F.lit(True))))
        front = new.where("last").drop("last")
        hops += 1
        seen = seen.unionByName(new.drop("last")) if hops % CUT_ROUNDS else cut(seen.unionByName(new.drop("last")))
        if front.isEmpty():
            return seen


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node, component``: strongly connected components with more than one node, or a loop; named by their smallest node.

    Nodes without edges in or out are trimmed; then each node takes the smallest node that reaches it as its
    colour, and what goes back to that node within the colour is a component.
    """
    spark = edges.sparkSession
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    kind = dict(e.dtypes)["src"]
    found = spark.createDataFrame([], f"node {kind}, component {kind}")

    def trimmed(e: DataFrame) -> DataFrame:
        into = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        return into.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")

    def spread(colours: DataFrame) -> DataFrame:
        near = e.join(colours, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("near"))
        return colours.join(near, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", F.coalesce("near", "colour")).alias("colour"))

    def mark(colours: DataFrame) -> int | None:
        return colours.agg(F.bit_xor(F.xxhash64("node", "colour"))).first()[0]

    n = e.count()
    while n:
        while n:
            e = cut(trimmed(trimmed(e)))  # two rounds a table
            left, n = n, e.count()
            if left == n:
                break
        if not n:
            break
        colours = cut(nodes(e).withColumn("colour", F.col("node")))
        before = mark(colours)
        while True:
            colours = cut(spread(spread(colours)))
            after = mark(colours)
            if after == before:
                break
            before = after
        roots = colours.where("node = colour")
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        scc = cut(_reach(back, roots, colours))
        sizes = scc.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found = cut(found.unionByName(scc.join(sizes, "colour", "left_semi").select("node", F.col("colour").alias("component"))))
        gone = scc.select("node")
        e = cut(e.join(gone, F.col("src") == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"))
        n = e.count()
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)


def hops(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """``node, hop``: the fewest edges from a seed, up to ``depth``; seeds are at 0.  ``most`` keeps the first of each hop by node."""
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    front = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    seen = front
    for h in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(h))
        if most is not None:
            step = step.orderBy("node").limit(most)
        front = cut(step)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def impact(imports: DataFrame, changed: DataFrame, centrality: DataFrame, depth: int = 2, limit: int = 100) -> DataFrame:
    """``node, depth, risk`` of the files that import changed ones, directly or not: 0.6 of their centrality and 0.4
    of their nearness, which is one over the hop of the file that they import, counted from 1."""
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = hops(back, changed, depth).where("hop > 0")
    risk = 0.6 * F.coalesce("rank", F.lit(0.0)) + 0.4 / F.col("hop")
    return reached.join(centrality, "node", "left").select("node", F.col("hop").cast("long").alias("depth"), F.round(risk, 4).alias("risk")).orderBy(F.col("risk").desc(), "node").limit(limit)


def weighted_paths(edges: DataFrame, start: Column, depth: int = 3, limit: int = 10) -> DataFrame:
    """The heaviest paths without repeated nodes from the ``start`` nodes: ``path, weight``, the weight a product."""
    paths = edges.where(start & (F.col("src") != F.col("dst"))).select(F.array("src", "dst").alias("path"), F.col("weight").cast("double").alias("weight"))
    found = paths
    for _ in range(depth - 1):
        e = edges.select("src", "dst", F.col("weight").alias("w"))
        paths = cut(
            paths.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            .select(F.array_append("path", F.col("dst")).alias("path"), (F.col("weight") * F.col("w")).alias("weight"))
        )
        found = found.unionByName(paths)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("weight", 6).alias("weight")).orderBy(F.col("weight").desc(), "path").limit(limit)


def shortest_path(edges: DataFrame, a: object, b: object, depth: int = 5) -> list | None:
    """A shortest path of at most ``depth`` edges between two nodes, whatever the direction, by parents: the smallest parent of each.

    All neighbours of a node are followed.
    """
    once = cut(edges.where("src <> dst").select("src", "dst"))
    e = cut(both_ways(once).repartition(2 * tasks(once), "src").groupBy("src", "dst").agg(F.count("*").alias("_n")).select("src", "dst"))
    seen = cut(e.sparkSession.createDataFrame([(a, None)], f"node {dict(e.dtypes)['src']}, parent {dict(e.dtypes)['src']}").withColumn("hop", F.lit(0)))
    front = seen
    if a == b:
        return [a]
    for h in range(1, depth + 1):
        front = cut(front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("next")).agg(F.min("node").alias("parent")).withColumnRenamed("next", "node").join(seen, "node", "left_anti").withColumn("hop", F.lit(h)))
        if front.isEmpty():
            return None
        seen = cut(seen.unionByName(front))
        if front.where(F.col("node") == F.lit(b)).limit(1).count():
            path = [b]
            while path[-1] != a:  # at most ``depth`` lookups of one row
                path.append(seen.where(F.col("node") == F.lit(path[-1])).first()["parent"])
            return path[::-1]
    return None


def traced(edges: DataFrame, seeds: DataFrame, mode: str = "calls", direction: str = "outbound", depth: int = 3, most: int = 2000, tests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a walk along typed ``edges(src, dst, kind)`` from ``seeds(node)``, outbound, inbound or both.

    Nodes are ``node, hop`` and at most ``most``, nearest first and then by name; the edges are those that lead from one that was expanded, at less than
    ``depth``, to one that is kept.  ``tests(node)`` are test files' nodes, which are left out unless they are seeds.
    """
    depth = max(0, min(6, depth))
    typed = edges.where(F.col("kind").isin(*MODES[mode])).select("src", "dst", "kind").distinct()
    if tests is not None:
        hidden = tests.select(F.col("node").alias("dst")).join(seeds.select(F.col("node").alias("dst")), "dst", "left_anti")
        typed = typed.join(hidden, "dst", "left_anti").join(hidden.withColumnRenamed("dst", "src"), "src", "left_anti")
    typed = cut(typed.select("src", "dst", "kind"))
    ways = {"outbound": [typed], "inbound": [typed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")]}
    ways["both"] = ways["outbound"] + ways["inbound"]
    found = [cut(hops(w, seeds, depth)) for w in ways[direction]]
    seen = found[0]
    for f in found[1:]:
        seen = seen.unionByName(f)
    kept = cut(seen.groupBy("node").agg(F.min("hop").alias("hop")).orderBy("hop", "node").limit(most))
    walked = []
    for way, f in zip(ways[direction], found, strict=True):
        ahead = way.join(f.where(F.col("hop") < depth).select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi").join(kept.select(F.col("node").alias("src")), "src", "left_semi")
        walked.append(ahead.select("src", "dst", "kind") if way is typed else ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    out = walked[0]
    for w in walked[1:]:
        out = out.unionByName(w)
    return kept, cut(out.distinct())


def chains(edges: DataFrame, start: DataFrame, depth: int = 64, limit: int = 50) -> DataFrame:
    """``chain``: paths from ``start(node)`` that end at a leaf, at ``depth``, or where they meet themselves, which is marked."""
    e = cut(edges.select("src", "dst").distinct())
    out = e.select("src").distinct()
    paths = cut(start.join(e, F.col("node") == F.col("src"), "left_semi").select(F.array("node").alias("path")))
    done = paths.where("false").select("path", F.lit(False).alias("cycle"))
    for _ in range(depth):
        ahead = paths.join(e, F.element_at("path", -1) == F.col("src"))
        leaf = paths.join(out, F.element_at("path", -1) == F.col("src"), "left_anti").where(F.size("path") > 1)
        cycle = F.array_contains("path", F.col("dst"))
        done = done.unionByName(leaf.select("path", F.lit(False).alias("cycle"))).unionByName(ahead.where(cycle).select(F.array_append("path", F.col("dst")).alias("path"), F.lit(True).alias("cycle")))
        paths = cut(ahead.where(~cycle).select(F.array_append("path", F.col("dst")).alias("path")))
        if paths.isEmpty():
            break
    done = done.unionByName(paths.select("path", F.lit(False).alias("cycle")))
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), " → ")
    return done.select(F.when(F.col("cycle"), F.concat(text, F.lit("↺"))).otherwise(text).alias("chain")).orderBy("chain").limit(limit)


def related(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: float = 0.3, per_node: int = 20, limit: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """``node, hop, weight`` near the seeds, whatever the direction: along the ``per_node`` heaviest edges of each node that weigh
    at least ``least``; the first ``limit``, near ones first, then heavy ones.  ``kinds`` keeps edges of these kinds alone."""
    some = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    once = cut(some.where((F.col("weight") >= least) & (F.col("src") != F.col("dst"))).select("src", "dst", "weight"))
    both = both_ways(once).repartition(2 * tasks(once), "src").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))
    e = cut(both.withColumn("n", nth).where(F.col("n") <= per_node).select("src", "dst", "weight"))
    front = cut(seeds.select("node").distinct())
    seen, found = front, front.where("false").select("node", F.lit(0).alias("hop"), F.lit(0.0).alias("weight"))
    for h in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("next")).agg(F.max("weight").cast("double").alias("weight"))
        step = cut(step.join(seen, F.col("next") == F.col("node"), "left_anti").select(F.col("next").alias("node"), F.lit(h).alias("hop"), "weight"))
        if step.isEmpty():
            break
        front = step.select("node")
        seen, found = seen.unionByName(front), found.unionByName(step)
    return found.orderBy("hop", F.col("weight").desc(), "node").limit(limit)


def decision_chain(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """:func:`related` along the edges that tell what a memory comes from."""
    return related(edges, seeds, depth, kinds=["DERIVED_FROM", "CAUSES", "SUPPORTS"])


def contradictions(edges: DataFrame, texts: DataFrame, then: list[Column], limit: int = 20) -> DataFrame:
    """``first, second, weight``: texts at both ends of the heaviest contradictions, ties in the order of ``then``; pairs without a text are left out."""
    top = edges.where(F.col("kind") == "CONTRADICTS").orderBy(F.col("weight").desc(), *then).limit(limit)
    one, two = texts.select(F.col("id").alias("src"), F.col("content").alias("first")), texts.select(F.col("id").alias("dst"), F.col("content").alias("second"))
    return top.join(one, "src").join(two, "dst").select("first", "second", "weight")


def neighbourhood_summary(edges: DataFrame, node: object, texts: DataFrame, least: float = 0.3, limit: int = 10, most: int = 120) -> DataFrame:
    """One row with ``summary``: a line for each of the heaviest neighbours, with the edge's direction and kind and the start of its text."""
    some = edges.where((F.col("weight") >= least) & ((F.col("src") == node) | (F.col("dst") == node)) & (F.col("src") != F.col("dst")))
    out = F.col("src") == node
    near = some.select(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), F.when(out, "→").otherwise("←").alias("arrow"), "kind", "weight")
    nth = F.row_number().over(Window.partitionBy("other").orderBy(F.col("weight").desc(), "arrow", "kind"))
    first = near.withColumn("n", nth).where("n = 1").orderBy(F.col("weight").desc(), "other").limit(limit)
    text = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    line = F.concat(F.lit("  "), "arrow", F.lit(" ["), F.lower(F.regexp_replace("kind", "_", " ")), F.lit("] ("), "type", F.lit(") "), text)
    rows = first.join(texts, F.col("other") == F.col("id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "other", line.alias("line")))).alias("lines"))
    return rows.select(F.when(F.size("lines") == 0, "").otherwise(F.concat_ws("\n", F.lit("Related memories:"), F.array_join(F.col("lines.line"), "\n"))).alias("summary"))


def _moved(adj: DataFrame, size: DataFrame, rounds: int, n: int) -> DataFrame:
    """``node, c``: communities by rounds of moves to the neighbouring one with the largest gain of modularity.

    ``adj(src, dst, w)`` goes both ways without loops and lies in ``n`` buckets by ``dst``; ``size(node, k)`` holds weighted degrees.  Half of the nodes, by a hash,
    may move in a round, so that neighbours don't swap places.  Only their edges are shuffled, once, with the mass of the community at the other end.
    """
    total = F.lit(size.agg(F.sum("k")).first()[0] or 1.0)
    state = cut(size.select("node", "k", F.col("node").alias("c")))
    still = 0
    for r in range(rounds):
        turn = lambda x: F.pmod(F.xxhash64(x, F.lit(r // 2)), F.lit(2)) == r % 2  # noqa: B023, E731
        placed = state.join(state.groupBy("c").agg(F.sum("k").alias("mass")), "c")
        at = placed.select(F.col("node").alias("dst"), "c", "mass")
        votes = adj.where(turn("src")).join(at.hint("shuffle_hash"), "dst").select("src", "c", "mass", "w").repartition(n, "src").groupBy("src", "c").agg(F.sum("w").alias("links"), F.max("mass").alias("mass"))
        mine = placed.where(turn("node")).select(F.col("node").alias("src"), "k", F.col("c").alias("own"), F.col("mass").alias("held"))
        gain = F.col("links") - (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) * F.col("k") / total
        alone = 0.0 - (F.col("held") - F.col("k")) * F.col("k") / total
        scored = votes.join(mine.hint("shuffle_hash"), "src").withColumn("gain", gain).withColumn("alone", alone)
        best = scored.groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("c"))).alias("best"), F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))), F.max("alone")).alias("stay"))
        gone = best.where(-F.col("best.g") > F.col("stay") + 1e-12).select(F.col("src").alias("node"), F.col("best.c").alias("to"))
        after = cut(state.join(gone, "node", "left").select("node", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
        discard(state)
        still = 0 if not after.where("moved").isEmpty() else still + 1
        state = after.drop("moved")
        state.scratch = after.scratch
        if still == 2:  # neither half has moved
            break
    return state


def communities(edges: DataFrame, levels: int = LEVELS, rounds: int = MOVES) -> DataFrame:
    """``node, community`` by rounds of greedy modularity moves and contraction, at any size; then each community
    is cut into its connected parts, which are named by their smallest node.

    A level counts only if it makes modularity larger.  Edges lie in buckets by one end, so that a step shuffles them once at most.
    """
    simple = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    graph, base, member, before = cut(simple), None, None, None
    for _ in range(levels):
        n = max(2 * tasks(graph), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        open_, loops = graph.where("a <> b"), graph.where("a = b").select(F.col("a").alias("node"), "w")
        adj = dealt(open_.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(open_.select("b", "a", "w").toDF("src", "dst", "w")), "dst", n)
        ends = adj.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("k")).unionByName(loops.select("node", (2 * F.col("w")).alias("k")))
        size = cut(ends.groupBy("node").agg(F.sum("k").alias("k")))
        if base is None:
            base, member, before = adj, size.select("node", F.col("node").alias("c")), _singles(graph, size)
        home = _moved(adj, size, rounds, n)
        to = home.select(F.col("node").alias("_n"), F.col("c").alias("_c"))
        across = _at_both(adj, to, n).unionByName(loops.join(to, F.col("node") == F.col("_n")).select(F.col("_c").alias("ca"), F.col("_c").alias("cb"), "w"))
        joined = cut(across.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")))
        after = _singles(joined, joined.select(F.col("a").alias("node"), "w").unionByName(joined.select(F.col("b").alias("node"), "w")).groupBy("node").agg(F.sum("w").alias("k")))
        if adj is not base:
            discard(adj)
        if after <= before + 1e-9:
            break
        before = after
        member = cut(member.join(to, F.col("c") == F.col("_n")).select("node", F.col("_c").alias("c")))
        discard(home)
        discard(graph)
        graph = joined
    own = member.select(F.col("node").alias("_n"), F.col("c").alias("_c"))
    n = max(tasks(base), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inner = _at_both(base, own, n, "src", "dst").where("ca = cb").select("src", "dst")
    parts = cut(components(inner))
    alone = member.join(parts, "node", "left_anti").select("node", F.col("node").alias("community"))
    return parts.select("node", F.col("component").alias("community")).unionByName(alone)


def _at_both(adj: DataFrame, home: DataFrame, n: int, *more: str) -> DataFrame:
    """``ca, cb, w``, and ``more`` columns, of each edge of ``adj``, taken once: its ends' communities in ``home(_n, _c)``."""
    x, y = home.select(F.col("_n").alias("src"), F.col("_c").alias("ca")), home.select(F.col("_n").alias("dst"), F.col("_c").alias("cb"))
    one = adj.where("src < dst").join(y.hint("shuffle_hash"), "dst").select("src", "cb", "w", *[c for c in more if c != "src"])
    return one.repartition(n, "src").join(x.hint("shuffle_hash"), "src").select("ca", "cb", "w", *more)


def _singles(graph: DataFrame, size: DataFrame) -> float:
    """Modularity of ``graph(a, b, w)``, loops included, when each node of ``size(node, k)`` is a community."""
    inside, all_ = graph.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.sum("w")).first()
    squares = size.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return 0.0 if not all_ else (inside or 0.0) / all_ - squares / (4 * all_ * all_)


def label_propagation(edges: DataFrame, labels: DataFrame | None = None, rounds: int = 4) -> DataFrame:
    """``node, community``: labels, at first each node's own or ``labels(node, label)``, that spread to the heaviest among a node's neighbours, ties to the smallest."""
    once = cut(edges.where("src <> dst").select("src", "dst"))
    n = 2 * tasks(once)
    both = cut(both_ways(once).repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("w")))
    labels = cut(nodes(edges).withColumn("label", F.col("node")) if labels is None else labels.select("node", "label"))
    for _ in range(rounds):
        votes = both.repartition(n, "dst").join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("w").alias("n"))
        won = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m"))
        labels = cut(labels.join(won.select("src", F.col("m.label").alias("new")), F.col("node") == F.col("src"), "left").select("node", F.coalesce("new", "label").alias("label")))
    return labels.withColumnRenamed("label", "community")


def fallback_communities(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """``node, community``: components, and labels that spread from there.

    All neighbours of a node have its component as their label, so that no number of ``rounds`` changes one: none is run.
    """
    return components(edges).withColumnRenamed("component", "community")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row with ``modularity``, and ``modularity_half``: the same sums over twice the total degree, as some tools report it."""
    e = cut(edges.where("src <> dst").select("src", "dst"))
    n = tasks(e)
    a, b = groups.select(F.col("node").alias("src"), F.col("community").alias("ca")), groups.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    ends = cut(e.repartition(n, "src").join(a, "src").select("dst", "ca").repartition(n, "dst").join(b, "dst").groupBy("ca", "cb").agg(F.count("*").alias("n")))
    m = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n"))), F.lit(0)).alias("inside"))
    degree = ends.select(F.col("ca").alias("c"), "n").unionAll(ends.select("cb", "n")).groupBy("c").agg(F.sum("n").alias("k"))
    squares = degree.agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    two = 2 * F.col("m")
    inside, expected = 2 * F.col("inside"), F.col("k2") / two
    return m.crossJoin(squares).select(F.round((inside - expected) / two, 6).alias("modularity"), F.round(inside / (2 * two) - F.col("k2") / (2 * two * 2 * two), 6).alias("modularity_half"))
