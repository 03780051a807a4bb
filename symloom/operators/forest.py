"""Parent-child links of unknown depth to full hierarchies.

Leaves are peeled bottom-up as long as a round removes a fair share of what
is left, so the rounds are few and their work shrinks geometrically. What
remains are long chains and circles; they are shortened by pointer doubling
(each node learns the node 2, 4, 8 ... steps up), which takes the logarithm
of the depth in rounds. A doubled pointer that never reaches a top belongs to
a circle. Peeled nodes then take root, depth and path from their parents in
the reverse order of peeling.

Subtree sizes go the other way: every node passes what it knows of the nodes
below it to the node 1, 2, 4, 8 ... steps up, so that no list of descendants
and no path is ever spread out for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.plans.scratch import Scratch, Table

#: Peeling goes on while a round removes at least this share of the nodes.
PEEL_SHARE = 0.2


def _whole(links: DataFrame) -> DataFrame:
    ok = F.col("node").isNotNull() & F.col("parent").isNotNull() & F.col("tree").isNotNull()
    return links.select("tree", "node", "parent").where(ok)


def _links(links: DataFrame) -> DataFrame:
    """One parent per tree and node: of several, the smallest. What that
    leaves out :func:`further_parents` has."""
    return _whole(links).groupBy("tree", "node").agg(F.min("parent").alias("parent"))


def further_parents(links: DataFrame) -> DataFrame:
    """``tree, node, parent``: the links that :func:`hierarchy` does not follow,
    as a node of a tree has one parent: of several all but the smallest, each
    once. Links with a null are none; no links, no rows."""
    followed = _links(links).withColumnRenamed("parent", "first")
    return _whole(links).distinct().join(followed, ["tree", "node"]).where("parent <> first").drop("first")


def _peel(core: Table, scratch: Scratch, peel_share: float, max_rounds: int) -> tuple[Table, list[Table]]:
    peeled: list[Table] = []
    left = core.seen["n"]
    while left and len(peeled) < max_rounds:
        inner = core.df.select("tree", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
        marked = scratch.cut(core.df.join(inner, ["tree", "node"], "left"), kept=F.count("inner"))
        kept = marked.seen["kept"]
        if left - kept < peel_share * left:
            marked.drop()
            break
        peeled.append(marked)
        if len(peeled) == 1:
            core.drop()
        core, left = _view(marked, "inner IS NOT NULL"), kept
    return core, peeled


class _view:
    """The rows of a written table that a condition keeps."""

    def __init__(self, table: Table, condition: str) -> None:
        self.table, self.condition = table, condition

    @property
    def df(self) -> DataFrame:
        return self.table.df.where(self.condition).select("tree", "node", "parent")

    def drop(self) -> None:
        pass


def _double(core, scratch: Scratch, with_path: bool) -> Table:
    """Columns tree, node, up, dist, done[, path]: ``up`` is the top, or for
    nodes whose way ends in a circle (``done`` false) a node on that circle."""
    own = core.df
    tops = own.select("tree", F.col("node").alias("parent")).withColumn("inner", F.lit(True))
    now = own.join(tops, ["tree", "parent"], "left").select(
        "tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("dist"), F.col("inner").isNull().alias("done"),
        *([F.array("parent").alias("path")] if with_path else []),
    )
    still_open = F.count_if(~F.col("done"))
    table, last_open, last_ends = scratch.cut(now, open=still_open), None, None
    while True:
        n_open, n_ends = table.seen["open"], None
        open_ = table.df.where(~F.col("done"))
        if n_open == last_open:
            n_ends = open_.select("tree", "up").distinct().count()
        # no open node finished and no end dropped out: every end lies on a circle
        if not n_open or (n_ends is not None and n_ends == last_ends):
            return table
        last_open, last_ends = n_open, n_ends
        ahead = table.df.select(
            "tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"),
            *([F.col("path").alias("path2")] if with_path else []),
        )
        stepped = open_.join(ahead, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"),
            # distances around a circle have no meaning and would overflow
            F.when(F.col("done2"), F.col("dist") + F.col("dist2")).otherwise(F.least(F.col("dist") + F.col("dist2"), F.lit(1 << 60))).alias("dist"),
            F.col("done2").alias("done"),
            *([F.concat("path", "path2").alias("path")] if with_path else []),
        )
        new = scratch.cut(table.df.where("done").unionByName(stepped), open=still_open)
        table.drop()
        table = new


def _circle_ids(doubled: Table, core, scratch: Scratch) -> DataFrame | None:
    """(tree, node, root) of every node on a circle, root the smallest id on it."""
    ends = doubled.df.where(~F.col("done")).select("tree", F.col("up").alias("node")).distinct()
    state = {"n": F.count(F.lit(1)), "sums": F.sum(F.xxhash64("tree", "node", "low").cast("decimal(38,0)"))}
    ring = scratch.cut(ends.join(core.df, ["tree", "node"]).select("tree", "node", F.col("parent").alias("up"), F.col("node").alias("low")), **state)
    n = None
    while True:
        sums = ring.seen["sums"]
        if not ring.seen["n"]:
            return None
        if sums == n:
            return ring.df.select("tree", "node", F.col("low").alias("root"))
        n = sums
        ahead = ring.df.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        new = scratch.cut(ring.df.join(ahead, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), F.least("low", "low2").alias("low")), **state)
        ring.drop()
        ring = new


def hierarchy(links: DataFrame, with_path: bool = True, peel_share: float = PEEL_SHARE, max_rounds: int = 40) -> DataFrame:
    """Root, depth and path of every node that has a parent.

    ``links``: ``tree`` (kinds are separate forests), ``node``, ``parent``.
    Returns ``tree, node, parent, root, depth, in_circle`` and, if asked for,
    ``path`` (ids from the root down to the node itself). Where the way up
    ends in a circle, ``root`` is the smallest id on it, ``depth`` and
    ``path`` are null and ``in_circle`` is true for the nodes on the circle
    themselves. Rows with a null are skipped, repeated links count once; of
    several parents of a node the smallest is followed, and
    :func:`further_parents` reports the others. No links, no rows.
    """
    scratch = Scratch(links.sparkSession, "forest")
    core, peeled = _peel(scratch.cut(_links(links), n=F.count(F.lit(1))), scratch, peel_share, max_rounds)
    doubled = _double(core, scratch, False)
    ways = doubled
    if with_path:  # only of nodes that reach a top, as a path around a circle would grow for ever
        sound = core.df.join(doubled.df.where("done").select("tree", "node"), ["tree", "node"], "left_semi")
        ways = _double(scratch.cut(sound), scratch, True)
    rings = _circle_ids(doubled, core, scratch) if doubled.seen["open"] else None
    up = F.col("up")
    path = [F.concat(F.reverse("path"), F.array("node")).alias("path")] if with_path else []
    no_path = [F.lit(None).cast(ways.df.select(*path).schema[0].dataType).alias("path")] if with_path else []
    done = ways.df.where("done").join(core.df, ["tree", "node"])
    out = done.select("tree", "node", "parent", up.alias("root"), F.col("dist").alias("depth"), F.lit(False).alias("in_circle"), *path)
    if rings is not None:
        ring_root = rings.select("tree", F.col("node").alias("up"), "root")
        on_ring = rings.select("tree", "node", F.lit(True).alias("in_circle"))
        stuck = doubled.df.where(~F.col("done")).select("tree", "node", "up").join(ring_root, ["tree", "up"]).join(on_ring, ["tree", "node"], "left")
        out = out.unionByName(
            stuck.join(core.df, ["tree", "node"]).select(
                "tree", "node", "parent", "root", F.lit(None).cast("long").alias("depth"), F.coalesce("in_circle", F.lit(False)).alias("in_circle"), *no_path
            )
        )
    levels = [scratch.cut(out)] if peeled else []
    for marked in reversed(peeled):
        leaves = marked.df.where(F.col("inner").isNull()).select("tree", "node", "parent")
        known = reduce(DataFrame.unionByName, [t.df for t in levels])
        above = known.select(
            "tree", F.col("node").alias("parent"), "root", "depth", *([F.col("path").alias("up_path")] if with_path else []), F.lit(True).alias("inner")
        )
        is_top = F.col("inner").isNull()
        got = leaves.join(above, ["tree", "parent"], "left").select(
            "tree", "node", "parent",
            F.when(is_top, F.col("parent")).otherwise(F.col("root")).alias("root"),
            F.when(is_top, F.lit(1).cast("long")).otherwise(F.col("depth") + 1).alias("depth"),
            F.lit(False).alias("in_circle"),
            *([F.when(is_top, F.array("parent", "node")).otherwise(F.concat("up_path", F.array("node"))).alias("path")] if with_path else []),
        )
        levels.append(scratch.cut(got))
    if not levels:
        return out
    for table in {*peeled, doubled, ways}:  # all that they told is in the levels
        table.drop()
    return reduce(DataFrame.unionByName, [t.df for t in levels])


def open_circles(links: DataFrame) -> DataFrame:
    """The links without those of the nodes on a circle, so that in their
    :func:`hierarchy` each such node is the top of what hangs below it and the
    nodes there have a path that starts where their way enters the circle."""
    on_circle = hierarchy(links, with_path=False).where("in_circle").select("tree", "node")
    return links.join(on_circle, ["tree", "node"], "left_anti")


def descendants(paths: DataFrame) -> DataFrame:
    """All pairs of ancestor and descendant with their distance, one row each
    (a list per ancestor would not be bounded), from :func:`hierarchy`. Nodes
    without a path, those on or below a circle, are in no pair; with the
    hierarchy of :func:`open_circles` those below one are."""
    at = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_at", "ancestor")
    return (
        paths.where(F.col("path").isNotNull())
        .select("tree", "node", "depth", at)
        .select("tree", "ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("_at")).alias("distance"))
    )


def sound_links(links: DataFrame) -> DataFrame:
    """The links of the nodes whose way up reaches a top."""
    good = hierarchy(links, with_path=False).where("depth IS NOT NULL").select("tree", "node")
    return links.join(good, ["tree", "node"], "left_semi")


def subtree_sizes(links: DataFrame) -> DataFrame:
    """``tree, ancestor, n_descendants, height`` of every node with nodes below
    it, of links without circles (:func:`sound_links`, :func:`open_circles`);
    a circle raises an error. Parents are chosen as in :func:`hierarchy`.

    In round k a node knows how many nodes are less than 2^k steps below it
    and passes that on to the node 2^k steps up, sums being combined before
    they are shuffled; so there are as many rounds as the height has bits,
    each over one row a node, and the rows do not grow with the depth.
    """
    scratch = Scratch(links.sparkSession, "sizes")
    own = scratch.cut(_links(links), n=F.count(F.lit(1)))
    tops = own.df.select("tree", F.col("parent").alias("node")).distinct().join(own.df.select("tree", "node"), ["tree", "node"], "left_anti")
    nodes = own.df.select("tree", "node", F.col("parent").alias("up")).unionByName(tops.select("tree", "node", F.lit(None).cast(own.df.schema["parent"].dataType).alias("up")))
    left = F.count("up")
    now = scratch.cut(nodes.withColumn("size", F.lit(1).cast("long")).withColumn("height", F.lit(0).cast("long")), left=left)
    step = 1
    while now.seen["left"]:
        if step > 2 * own.seen["n"]:
            raise ValueError("the links run in a circle")
        open_ = now.df.where("up IS NOT NULL")
        given = open_.groupBy("tree", F.col("up").alias("node")).agg(F.sum("size").alias("more"), (F.max("height") + step).alias("deeper"))
        ahead = now.df.select("tree", F.col("node").alias("up"), F.col("up").alias("up2")).where("up2 IS NOT NULL")
        moved = now.df.join(ahead, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), "size", "height")
        new = moved.join(given, ["tree", "node"], "left").select(
            "tree", "node", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.greatest("height", F.coalesce("deeper", F.lit(0))).alias("height")
        )
        table = scratch.cut(new, left=left)
        now.drop()
        now, step = table, step * 2
    return now.df.where("size > 1").select("tree", F.col("node").alias("ancestor"), (F.col("size") - 1).alias("n_descendants"), "height")
