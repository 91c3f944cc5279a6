"""Traversals over edge frames: loops whose rounds are equi joins, by frontier from asked roots, by path doubling from all nodes.

Every round is written to the shared checkpoint folder, so the plan stays short and no round is lost with an executor.
The frontier holds distinct nodes only.  A frontier counted as small is broadcast, so that round neither shuffles the edges
nor gathers a hub's edges in one task; a larger one joins by shuffle, where Spark splits skewed partitions.  Nothing is
collected.  The number of rounds is the depth of the graph, its logarithm for closures, never the number of nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from curatrix.operators.skew import broadcast_if_small
from curatrix.session import cut_lineage, settled


def node_key(kind: str, ident: str):
    return F.concat_ws(":", F.col(kind), F.col(ident).cast("string"))


def directed(edges: DataFrame, direction: str = "down") -> DataFrame:
    """Distinct (src, dst) steps for ``down``, ``up`` or ``both``."""
    down = edges.select("src", "dst")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = {"down": down, "up": up, "both": down.unionByName(up)}[direction]
    return out.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def reach(steps: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): everything reachable from each root, at its smallest depth; the root itself at 0.

    ``steps`` holds distinct (src, dst), ``seeds`` one column ``root`` (None: every source of a step, see ``closure``).  Without ``max_depth`` the loop
    runs until no new node is found, which cycles cannot prevent.
    """
    if seeds is None:
        return closure(steps, max_depth)
    steps = cut_lineage(steps)
    front = cut_lineage(seeds.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    seen, size, depth = [front], front.count(), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = steps.join(broadcast_if_small(front, size), front.node == steps.src).select("root", F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, seen).select("root", "node")
        front = cut_lineage(found.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        size = front.count()
        if size == 0:
            break
        seen.append(front)
    return reduce(DataFrame.unionByName, seen)


def closure(steps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) from every source of a step, by path doubling: the rounds are the logarithm of the depth.

    A round knows all pairs up to ``span`` steps apart. Every pair up to twice as far meets in a node exactly ``span`` steps from its
    root, so only the farthest pairs are extended, by all pairs known, and the smallest sum is the depth.
    """
    steps = settled(steps.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct())
    far = steps.filter("root <> node").withColumn("depth", F.lit(1))
    known, span = [far], 1
    while max_depth is None or span < max_depth:
        so_far = reduce(DataFrame.unionByName, known)
        onward = so_far.select(F.col("root").alias("mid"), F.col("node").alias("end"), F.col("depth").alias("more"))
        longer = far.filter(F.col("depth") == span).select("root", F.col("node").alias("mid")).join(onward, "mid").filter("root <> end")
        found = longer.groupBy("root", F.col("end").alias("node")).agg((F.min("more") + span).cast("int").alias("depth"))
        if max_depth is not None:
            found = found.filter(F.col("depth") <= max_depth)
        far, rows = _counted(found.join(so_far.select("root", "node"), ["root", "node"], "left_anti"), F.lit(True))
        if rows == 0:
            break
        known.append(far)
        span *= 2
    out = reduce(DataFrame.unionByName, known) if max_depth is None or max_depth > 0 else far.limit(0)
    return out.unionByName(steps.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())


def _counted(df: DataFrame, what) -> tuple[DataFrame, int]:
    """The settled frame, and how many of its rows hold ``what``, observed while they are written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count_if(what).alias("rows")))
    return out, seen.get["rows"]


def ancestors(parents: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth) over (child, parent) rows; all nodes, or those in ``roots`` (column ``node``)."""
    steps = parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    seeds = None if roots is None else roots.select(F.col("node").alias("root"))
    out = reach(steps, seeds, max_depth).filter("depth > 0")
    return out.select(F.col("root").alias("node"), F.col("node").alias("ancestor"), "depth")


def descendants(parents: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    steps = parents.select(F.col("parent").alias("src"), F.col("child").alias("dst")).distinct()
    out = reach(steps, roots.select(F.col("node").alias("root")), max_depth).filter("depth > 0")
    return out.select(F.col("root").alias("node"), F.col("node").alias("descendant"), "depth")


def siblings(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that share any parent with a root."""
    mine = parents.join(roots.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("child").alias("node"), "parent").distinct()
    out = mine.join(parents.select(F.col("child").alias("sibling"), "parent"), "parent").filter(F.col("sibling") != F.col("node"))
    return out.select("node", "sibling").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that something leads to and that lead on, as long as a round takes a quarter of the edges away."""
    size = edges.count()
    while size:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = settled(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left > 0.75 * size:
            break
        size = left
    return edges


def _merged(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame], DataFrame]:
    """Edges after every node that one edge leaves was merged into the node where its single edges end; what ``_unmerged`` needs; rings.

    A cycle through such a node goes on along its edge, so merging keeps every cycle, however many edges enter the node. Pointers double: the rounds
    are the logarithm of the longest way. Single edges without an end run into a ring, and nothing in front of a ring lies on another cycle.
    Returned: edges, loops among them; (src, dst, root) of the edges that were no single ones; (node, to) for 1, 2, 4, ... steps; (node, component) of the rings.
    """
    single = settled(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")).filter("n = 1").select(F.col("src").alias("node"), "to"))
    ptr = single.join(single.select(F.col("node").alias("to"), F.lit(True).alias("more")), "to", "left")
    ptr, going = _counted(ptr.select("node", "to", F.coalesce("more", F.lit(False)).alias("more"), F.least("node", "to").alias("low")), F.col("more"))
    steps, made, bound = [ptr], 1, 1 + going
    while going and made < bound:  # a way that ends has no more steps than were made, and nodes that still went on then
        nxt = ptr.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("more").alias("more2"), F.col("low").alias("low2"))
        ahead = ptr.filter("more").join(nxt, "to").select("node", F.col("to2").alias("to"), F.col("more2").alias("more"), F.least("low", "low2").alias("low"))
        ptr, going = _counted(ptr.filter("NOT more").unionByName(ahead), F.col("more"))
        steps.append(ptr)
        made *= 2
        bound = min(bound, made + going)
    endless = ptr.filter("more")
    rings = endless.join(endless.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("component"))
    others = edges.join(single.select(F.col("node").alias("src")), "src", "left_anti").join(ptr.select(F.col("node").alias("dst"), "to", "more"), "dst", "left")
    others = settled(others.filter("more IS NULL OR NOT more").select("src", "dst", F.coalesce("to", "dst").alias("root")))
    return settled(others.select("src", F.col("root").alias("dst")).distinct()), others, [p.select("node", "to") for p in steps], rings


def _unmerged(known: DataFrame, others: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``known`` with the merged nodes: where an edge within a component enters the merged nodes, all from there to their end belong to it."""
    inner = others.filter("dst <> root").join(known.select(F.col("node").alias("src"), F.col("component").alias("a")), "src")
    inner = inner.join(known.select(F.col("node").alias("root"), F.col("component").alias("b")), "root").filter("a = b")
    inner, entered = _counted(inner.select(F.col("dst").alias("node"), F.col("a").alias("component")).distinct(), F.lit(True))
    if not entered:
        return known
    for ptr in steps:
        inner = settled(inner.unionByName(inner.join(ptr, "node").select(F.col("to").alias("node"), "component")).distinct())
    return settled(known.join(inner, "node", "left_anti").unionByName(inner))  # also for a node that was a loop of its own


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _highest(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, top): the highest ranked node that leads to each node, itself included; only nodes whose top rose pass it on."""
    tops = front = ranks.select("node", F.col("rank").alias("top"))
    while front.head(1):
        sent = edges.join(front, edges.src == front.node).groupBy(F.col("dst").alias("node")).agg(F.max("top").alias("sent"))
        new = settled(tops.join(sent, "node", "left").select("node", F.greatest("top", F.coalesce("sent", "top")).alias("top"), F.coalesce(F.col("sent") > F.col("top"), F.lit(False)).alias("rose")))
        tops, front = new.select("node", "top"), new.filter("rose").select("node", "top")
    return tops


# A core of at most this many edges is settled by the closure of its few nodes: the logarithm of its depth in rounds.
CORE_EDGES = 1000


def _mutual(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that reach each other, from the closure of a small graph."""
    pairs = settled(closure(edges).filter("depth > 0").select("root", "node"))
    back = pairs.select(F.col("node").alias("root"), F.col("root").alias("node"))
    return settled(pairs.join(back, ["root", "node"]).groupBy(F.col("root").alias("node")).agg(F.min("node").alias("least")).select("node", F.least("node", "least").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on a cycle of (src, dst) edges; ``component`` is the smallest node that it shares cycles with.

    Nodes without a way in or out are trimmed; nodes with a single edge out, then those with a single edge in, are merged into the node where their single
    edges end, as long as that takes a quarter of the edges. A small core that is left is settled by its closure, a large one
    by forward and backward colouring: a node's colour is the highest ranked node that leads to it, and the nodes of a colour that lead
    back to that node are its strongly connected component. Every colour is settled at once; what is left goes on with new ranks. Ranks are
    hashes, so the passes do not follow an order in the ids. Merged nodes are settled last, in the opposite order.
    """
    edges = settled(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    loops = lambda df: df.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found, inside, turn = [loops(edges)], [], 0
    left = settled(edges.filter("src <> dst"))
    while left.head(1):
        size = 0
        while size == 0 or 0 < left.count() < 0.75 * size:
            left = _trimmed(left)
            size = left.count()
            if not size:
                break
            for _ in ("out", "in"):
                left, *merged, rings = _merged(left)
                inside.append(merged)
                found += [rings, loops(left)]
                left = _flipped(left.filter("src <> dst"))
        size = left.count()
        if not size:
            break
        if size <= CORE_EDGES:
            found.append(_mutual(left))
            break
        turn += 1
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        ranks = settled(nodes.select("node", F.struct(F.xxhash64(F.lit(turn), "node").alias("hash"), F.col("node").alias("id")).alias("rank")))
        of = _highest(left, ranks).select("node", F.col("top.id").alias("colour"))
        src, dst = of.select(F.col("node").alias("src"), F.col("colour").alias("a")), of.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        within = settled(left.join(src, "src").join(dst, "dst").filter("a = b").select("src", "dst"))
        returning = _highest(_flipped(within), ranks).select("node", F.col("top.id").alias("returns"))
        same = settled(of.join(returning, "node").filter("colour = returns").select("node", "colour"))
        sized = same.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("colour", "component")
        found.append(same.join(sized, "colour").select("node", "component"))
        gone = same.select(F.col("node").alias("src"))
        left = settled(within.join(gone, "src", "left_anti").join(gone.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"))
    known = settled(reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("component").alias("component")))
    for others, steps in reversed(inside):
        known = _unmerged(known, others, steps)
    least = known.groupBy("component").agg(F.min("node").alias("least"))  # a merged node may be the smallest
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def cycle_members(refs: DataFrame) -> DataFrame:
    """(node, cycle) for every node on a cycle of references, through any of its parents; ``cycle`` is the smallest node it shares cycles with.

    ``refs`` holds (node, parent), a row per parent.
    """
    found = components(refs.select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    return found.select("node", F.col("component").alias("cycle"))


def cycle_paths(refs: DataFrame) -> DataFrame:
    """(cycle, position, node): a cycle of every component as a path from its smallest node, position 0.

    Each member follows its smallest parent within the component. These pointers end in cycles, found by doubling; doubling also counts the
    steps to the smallest node, which is the path's order. Rows, not arrays: a cycle may be long.
    """
    steps = refs.filter("parent IS NOT NULL").select("node", "parent").distinct()
    member = settled(cycle_members(refs))
    mine, theirs = member.select("node", F.col("cycle").alias("a")), member.select(F.col("node").alias("parent"), F.col("cycle").alias("b"))
    succ = settled(steps.join(mine, "node").join(theirs, "parent").filter("a = b").groupBy("node").agg(F.min("parent").alias("to")))
    ptr, made, n = succ.withColumn("low", F.least("node", "to")), 1, succ.count()
    while made <= n:  # a pointer that made more steps than there are nodes stands on a cycle
        nxt = ptr.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        ptr = settled(ptr.join(nxt, "to").select("node", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
        made *= 2
    ring = settled(ptr.join(ptr.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("cycle")))
    # steps to the smallest node: pointers that reach it stay there
    dist = settled(ring.join(succ, "node").select("node", "cycle", F.col("to"), F.lit(1).cast("long").alias("steps")))
    size = ring.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"))
    longest, made = size.agg(F.max("size")).first()[0] or 0, 1
    while made < longest:
        nxt = dist.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"))
        home = F.col("to") == F.col("cycle")
        dist = settled(dist.join(nxt, "to").select("node", "cycle", F.when(home, F.col("to")).otherwise(F.col("to2")).alias("to"), (F.col("steps") + F.when(home, 0).otherwise(F.col("more"))).alias("steps")))
        made *= 2
    return dist.join(size, "cycle").select("cycle", ((F.col("size") - F.col("steps")) % F.col("size")).alias("position"), "node")


def delete_order(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots and everything below them, children before parents."""
    steps = refs.filter("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst")).distinct()
    out = reach(steps, roots.select(F.col("node").alias("root")))
    return out.groupBy("node").agg(F.max("depth").alias("depth")).orderBy(F.col("depth").desc(), "node")


def propagate_max(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(node, inherited): the highest level of any certified entity upstream of a node.

    One state frame (node, own, inherited) is carried from round to round. Only nodes whose inherited level just rose above everything
    they passed on before, their own level included, pass it on, so the messages follow the changes; the outcome does not depend on the
    order of arrival. The steps are spread by source once, and the rises of a round are counted while its state is written.
    """
    steps = cut_lineage(directed(edges).repartition("src"))
    own = levels.filter("level IS NOT NULL").groupBy("node").agg(F.max("level").alias("own"))
    state, size = _counted(own.select("node", "own", F.lit(None).cast(own.schema["own"].dataType).alias("inherited"), F.lit(True).alias("rose")), F.lit(True))
    while size > 0:
        front = state.filter("rose").select("node", F.coalesce("inherited", "own").alias("level"))
        sent = steps.join(broadcast_if_small(front, size), front.node == steps.src).groupBy(F.col("dst").alias("node")).agg(F.max("level").alias("sent"))
        rose = F.col("sent").isNotNull() & (F.col("inherited").isNull() | (F.col("sent") > F.col("inherited")))
        news = rose & (F.col("own").isNull() | (F.col("sent") > F.col("own")))
        state, size = _counted(state.drop("rose").join(sent, "node", "full").select("node", "own", F.greatest("inherited", "sent").alias("inherited"), F.coalesce(news, F.lit(False)).alias("rose")), F.col("rose"))
    return state.filter("inherited IS NOT NULL").select("node", "inherited")
