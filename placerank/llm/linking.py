"""Linking of near-equal items that meet in buckets, and connected components.

``link`` finds the connected groups of the graph "two items share a bucket and pass a check"
without forming all pairs of a large bucket. Members of a bucket of at most ``SMALL`` are compared with each other. In
a larger one each member is compared with the bucket's most central member (the one whose buckets hold most others, as
the text that all copies come from). The components of what passed name groups. Later rounds look only at
large buckets that still hold several groups: members are compared once with ``NEIGHBOURS`` members of other groups next to
them in the order of the marks, which puts alike ones side by side in some of their buckets, and with further pivots, as
long as these join groups or until the pairs between different groups are few, which are then compared. So the number of compared
pairs stays in proportion to the rows as long as pivots join groups. Where they no longer do, all pairs of different groups
that are left are compared, block by block, so that no link of a large bucket is missed. With a ``sieve``, an exact filter
on what the nodes hold, only the pairs that it leaves are compared in the end, and no neighbours.

All of this but the search for central members is done bucket by bucket, so many buckets are taken in up to ``SLICES`` slices, one after
the other: the shuffle files of one slice go before the next. ``link_lists`` is for buckets of strangers with a sharp condition.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import discard, saved, tidy

# Pairs between different groups are all compared once there is at most one for so many member rows.
ROWS_PER_PAIR = 4
SMALL, NEIGHBOURS = 16, 6
# members of a large bucket that one task compares with as many others
BLOCK = 4_096
PARTS, PART_PAIRS = 4, 200_000
SLICES, SLICE_ROWS = 8, 2_000_000
# buckets that a member carries, so that two of them are paired in one bucket only
OWN = 12
# at most 32 bytes a row: 3.2 MB
BROADCAST_ROWS = 100_000
# 1.6 MB of edges
ONE_TASK_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a long, b long)`` -> (node, root), root the smallest node.

    Alternates the large-star and small-star steps of the published map-reduce algorithm: each
    step hangs neighbours on the smallest node seen; the edge set converges to stars. Each node's
    minimum is a partial aggregate and the join back on the node may be split when it is skewed.
    Self edges are ignored; an empty input gives an empty result. Once a count shows at most ``ONE_TASK_EDGES``
    edges, the same steps run in one partition, which saves shuffles of next to nothing. Read more than
    once, so give ``edges`` as a saved table.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        if e.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
            e = e.coalesce(1)
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").filter("u <> v").distinct())
        e = saved(e, "star")
        # done when each node hangs on one node, which hangs on none
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))).alias("x"), "v").select("x.*", "v")
        loose = ends.groupBy("node").agg(F.max("hangs").alias("up"), F.min("hangs").alias("down"),
                                         F.min("v").alias("v0"), F.max("v").alias("v1")).filter("up = 1 and (down = 0 or v0 < v1)")
        if loose.isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def few(df: DataFrame) -> DataFrame:
    """``df``, narrow rows in a saved table, marked for broadcast if they are at most ``BROADCAST_ROWS``: a join with
    texts then moves no text. Beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _checks(details: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame],
            by_node: bool, label: str = "") -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """(known, linked): the details of nodes, each read once, and the pairs among given ones that pass ``check``."""
    about = None

    def known(nodes: DataFrame) -> DataFrame:
        """The details of all nodes so far, with those of ``nodes``."""
        nonlocal about
        need = saved(nodes if about is None else nodes.join(about.select("node"), "node", "left_anti"), "nodes")
        parts = min(PARTS, 1 + need.count() // BROADCAST_ROWS) if by_node else 1
        for i in range(parts):
            more = saved(details(need if parts == 1 else need.filter(F.pmod(F.xxhash64("node"), F.lit(parts)) == i)), f"{label}details")
            about = more if about is None else about.unionByName(more)
            if parts > 1:
                tidy(need.sparkSession)
        discard(need)
        return about

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs.select("a", "b").distinct(), "pairs")
        about = known(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        a, b = (about.select(F.col("node").alias(c), F.col("t").alias(f"t_{c}")) for c in "ab")
        # the details of many pairs are joined and checked in a few parts, so that one part's shuffle files go before the next
        parts = min(PARTS, 1 + pairs.count() // PART_PAIRS)
        mine = lambda df, i: df if parts == 1 else df.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == i)
        out = None
        for i in range(parts):
            links = saved(check(mine(pairs, i).join(mine(a, i), "a").join(b, "b")), "links")
            out = links if out is None else out.unionByName(links)
            tidy(links.sparkSession)
        discard(pairs)
        return out

    return known, linked


def link(members: DataFrame, near: Callable[[Column, Column], Column], details: Callable[[DataFrame], DataFrame],
         check: Callable[[DataFrame], DataFrame], order: Callable[[Column, Column], Column],
         central: bool = True, spent: tuple[DataFrame, ...] = (),
         sieve: Callable[[DataFrame], DataFrame] | None = None, by_node: bool = False) -> DataFrame:
    """Groups of ``members (bucket long, node long, mark)`` -> (node, root) for nodes in groups of two or more.

    ``near`` is a cheap condition on the marks of two nodes that linked pairs always meet; it is tested where
    members of a bucket are joined. ``order`` sorts the members of a large bucket by (mark, bucket) so that alike
    ones come together, in another way for each bucket. ``details`` takes nodes (node) of pairs that passed ``near``, each node
    once, and returns (node, t); ``check`` takes distinct pairs (a, b, t_a, t_b) and returns those (a, b) that belong together.
    ``spent`` are saved tables that only ``members`` is made of. Without ``central`` the first pivots are any members, for buckets that say little about the likeness of their members.
    ``sieve`` takes nodes (node, root, t), each once, and returns pairs (a, b) of different roots, among them all that belong together.
    With ``by_node`` ``details`` joins a table by node, and is given many nodes in parts, so that a part's shuffle files go before the next.
    """
    def counted(members: DataFrame) -> DataFrame:
        """The members of buckets with several nodes, with the number n of the bucket's members."""
        seen = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low < high")
        return saved(members.join(seen.select("bucket", "n"), "bucket"), "buckets")

    def done(*tables: DataFrame) -> None:
        for table in tables:
            discard(table)
        tidy(members.sparkSession)

    if central:
        slices = [counted(members)]
        done(*spent)
    else:
        whole = saved(members, "members")
        done(*spent)
        n = min(SLICES, 1 + whole.count() // SLICE_ROWS)
        slices = []
        for i in range(n):
            slices.append(counted(whole.filter(F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(n)) == i)))
            done()
        done(whole)
    rows = sum(hold.count() for hold in slices)
    known, linked = _checks(details, check, by_node)

    def each(pairs: Callable[..., DataFrame], *tables: list[DataFrame]) -> DataFrame:
        """The pairs (a, b), a < b, that ``pairs`` gives for each slice."""
        out = None
        for of in zip(*tables, strict=True):
            found = pairs(*of).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            if len(slices) > 1:
                found = saved(found.distinct(), "slice-pairs")
                done()
            out = found if out is None else out.unionByName(found)
        return out

    def both(left: DataFrame, right: DataFrame, other: Column) -> DataFrame:
        """Pairs of members of a bucket, the smaller node first."""
        x = left.select("bucket", F.col("node").alias("a"), F.col("mark").alias("ma"), *[c for c in ("root",) if c in left.columns])
        y = right.select("bucket", F.col("node").alias("b"), F.col("mark").alias("mb"), *[F.col(c).alias("root_b") for c in ("root",) if c in right.columns])
        return x.join(y, "bucket").filter(other & near(F.col("ma"), F.col("mb"))).select("a", "b")

    def every(members: DataFrame) -> DataFrame:
        """All pairs of members of different groups of a bucket, in blocks of at most about ``BLOCK`` by ``BLOCK``."""
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        at, others = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
        x = members.select("bucket", F.col("node").alias("a"), F.col("mark").alias("ma"), "root", at.alias("i"), others.alias("j"))
        y = members.select("bucket", F.col("node").alias("b"), F.col("mark").alias("mb"), F.col("root").alias("root_b"), others.alias("i"), at.alias("j"))
        return x.join(y, ["bucket", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b"))
                                                      & near(F.col("ma"), F.col("mb"))).select("a", "b")

    def sieved(members: DataFrame) -> DataFrame:
        """The pairs of members of different groups of a bucket that the sieve leaves."""
        own = members.groupBy("node").agg(F.first("root").alias("root"), F.first("mark").alias("mark"), F.collect_list("bucket").alias("in"))
        own = saved(own, "members")
        pairs = saved(sieve(known(own.select("node")).join(own.select("node", "root"), "node")), "sieved")
        a, b = (own.select(F.col("node").alias(c), F.col("mark").alias(f"m{c}"), F.col("in").alias(f"in_{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").filter(F.arrays_overlap("in_a", "in_b") & near(F.col("ma"), F.col("mb"))).select("a", "b")

    def beside(members: DataFrame) -> DataFrame:
        """Pairs of members of different groups that are neighbours in the order of their bucket."""
        place, ks = Window.partitionBy("bucket").orderBy(order(F.col("mark"), F.col("bucket")), "node"), range(1, NEIGHBOURS + 1)
        rows = members.select("node", "mark", "root", *[F.lag(F.struct("node", "mark", "root"), k).over(place).alias(f"o{k}") for k in ks])
        wanted = F.filter(F.array(*[f"o{k}" for k in ks]), lambda o: o.isNotNull() & (o["root"] != F.col("root")) & near(F.col("mark"), o["mark"]))
        rows = rows.select("node", F.explode(wanted).alias("o"))
        return rows.select(F.col("node").alias("a"), F.col("o.node").alias("b"))

    def first(hold: DataFrame, large: DataFrame) -> DataFrame:
        small = hold.filter(F.col("n") <= SMALL)
        pairs = both(small, small, F.col("a") < F.col("b"))
        if large.isEmpty():
            return pairs
        pivot = large.groupBy("bucket").agg(F.max_by(F.struct("node", "mark"), F.struct("central", "node")).alias("p")).select("bucket", "p.*")
        return pairs.unionByName(both(large, pivot, F.col("a") != F.col("b")))

    large = [hold.filter(F.col("n") > SMALL) for hold in slices]
    if central:
        large = [saved(x.join(x.groupBy("node").agg(F.sum("n").alias("central")), "node"), "large") for x in large]
    else:
        large = [x.withColumn("central", F.xxhash64("node")) for x in large]
    edges = linked(each(first, slices, large))
    left, turn, groups = None, 0, None
    while True:
        # after the first round the groups so far, each a star, stand for the links that made them
        last, groups = groups, saved(components(edges), "groups")
        if last is not None:
            discard(last)
        stars = groups.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        labelled = [x.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")) for x in large]
        # the next pivots are the most central members of the bucket's largest group, which most others should join,
        # and of its smallest, whose strangers are settled first
        open_, todo = [], 0
        for x in labelled:
            per_root = x.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
            open_.append(saved(per_root.groupBy("bucket").agg(
                F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("m2"),
                F.min_by("root", F.struct("m", "root")).alias("few"), F.max_by("root", F.struct("m", "root")).alias("many"))
                .filter("m * m > m2"), "open"))
            done()
            todo += open_[-1].agg(F.sum((F.col("m") * F.col("m") - F.col("m2")) / 2)).first()[0] or 0
        if not todo:
            return groups
        still = [x.join(o, "bucket") for x, o in zip(labelled, open_, strict=True)]
        turn += 1
        stalled = left is not None and todo > 0.9 * left
        if todo <= rows / ROWS_PER_PAIR + 1000 or stalled:
            found = linked(each(sieved if sieve else every, still))
            return saved(components(stars.unionByName(found)), "groups")
        left = todo

        def pivots(still: DataFrame, turn: int = turn) -> DataFrame:
            rank = F.struct("central", "node") if turn == 1 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
            pivot = still.filter("root = few or root = many").groupBy("bucket", "root").agg(
                F.max_by(F.struct("node", "mark"), rank).alias("p")).select("bucket", "root", "p.*")
            pairs = both(still, pivot, F.col("root") != F.col("root_b"))
            return pairs.unionByName(beside(still)) if turn == 1 and sieve is None else pairs

        edges = stars.unionByName(linked(each(pivots, still)))


def link_lists(nodes: DataFrame, near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
               details: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame],
               extra: str | None = None, alike: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
               start: DataFrame | None = None, label: str = "") -> DataFrame:
    """Groups of ``nodes (node long, buckets array<long>, ...)``, a saved table that is spent here -> (node, root) for nodes in
    groups of two or more. For buckets whose members are mostly strangers and an exact, sharp ``near``.

    Each member of a bucket is first compared with two other members, others in each bucket, so that copies of a text come
    together. Then all members of different groups of a bucket are. Nodes that met a near one in the first comparison may meet
    many a node of a large group in many buckets; they carry their first ``OWN`` buckets then, and two of them are paired in the first common one only
    (in each common bucket, if they carry none of these). ``near`` takes, for two nodes, a function from a column's
    name to the column; linked pairs always meet it, and ``alike``, for the few nodes whose column ``extra`` is not null and only
    among these, so that the other members do not carry the column and keep a condition that is compiled. ``details`` and ``check`` as in ``link``. The members of buckets are never
    saved: a slice of them is made of ``nodes`` when it is dealt. ``start``, a saved table that is spent here, has groups (node, root) known before;
    ``nodes`` then has a column root, the node itself outside of groups, and only members of different groups are compared. ``label`` begins the names of saved buckets and details.
    """
    spark = nodes.sparkSession
    known, linked = _checks(details, check, True, label)
    n = min(SLICES, 1 + (nodes.agg(F.sum(F.size("buckets"))).first()[0] or 0) // SLICE_ROWS)

    def members(of: DataFrame, i: int) -> DataFrame:
        out = of.withColumn("bucket", F.explode("buckets")).drop("buckets")
        return out if n == 1 else out.filter(F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(n)) == i)

    def meet(x: DataFrame, y: DataFrame, on: list[str], other: Column, once: Column = F.lit(True)) -> DataFrame:
        def joined(x: DataFrame, y: DataFrame, also: Column) -> DataFrame:
            a, b = (df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in on]) for df, s in ((x, "a"), (y, "b")))
            pairs = a.join(b, on).filter(other & near(*of) & also & once)
            return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

        of = [lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")]
        if extra is None:
            return joined(x, y, F.lit(True))
        has = F.col(extra).isNotNull()
        plain = [df.withColumn(extra, has) for df in (x, y)]
        return joined(*plain, ~(of[0](extra) & of[1](extra))).unionByName(joined(x.filter(has), y.filter(has), alike(*of)))

    def each(pairs: Callable[[int], DataFrame]) -> DataFrame:
        out = None
        for i in range(n):
            found = saved(pairs(i).distinct(), "slice-pairs")
            tidy(spark)
            out = found if out is None else out.unionByName(found)
        return out

    counts = []

    def first(i: int) -> DataFrame:
        turn = F.xxhash64("node", "bucket")
        all_ = members(nodes, i)
        counts.append(saved(all_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("low"), F.max(turn).alias("high")).filter("n > 1"), f"{label}buckets"))
        tidy(spark)
        pivot = all_.join(counts[i].select("bucket", "low", "high"), "bucket").filter(turn.isin(F.col("low"), F.col("high"))).drop("low", "high")
        return meet(all_, pivot, ["bucket"], F.col("node_a") != F.col("node_b") if start is None else F.col("root_a") != F.col("root_b"))

    met = each(first)
    edges, met = linked(met), met.select(F.explode(F.array("a", "b")).alias("node"))
    if start is not None:
        edges = saved(edges.unionByName(start.select(F.col("node").alias("a"), F.col("root").alias("b"))), "edges")
        met = met.unionByName(start.select("node"))
    groups = saved(components(edges), "groups")
    met = met.distinct().join(groups, "node", "left").withColumn("met", F.lit(True))
    first_own = F.slice(F.sort_array("buckets"), 1, OWN)
    labelled = nodes.drop("root").join(met, "node", "left").withColumns(
        {"root": F.coalesce("root", "node"), "own": F.when(F.col("met"), first_own)}).drop("met")
    labelled = saved(labelled, "labelled")
    discard(nodes)
    if start is not None:
        discard(start)
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    once = F.coalesce(F.array_min(F.array_intersect("own_a", "own_b")) == F.col("bucket"), F.lit(True))

    def rest(i: int) -> DataFrame:
        """All pairs of members of different groups of a bucket; in blocks of about ``BLOCK`` by ``BLOCK`` where they are many."""
        all_, wide = members(labelled, i), counts[i].filter(F.col("n") > BLOCK).select("bucket", "n")
        if wide.isEmpty():
            return meet(all_, all_, ["bucket"], apart, once)
        wide = few(wide)
        narrow, many = all_.join(wide, "bucket", "left_anti"), all_.join(wide, "bucket")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        at, others = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
        x, y = many.withColumns({"i": at, "j": others}).drop("n"), many.withColumns({"i": others, "j": at}).drop("n")
        return meet(narrow, narrow, ["bucket"], apart, once).unionByName(meet(x, y, ["bucket", "i", "j"], apart, once))

    found = linked(each(rest))
    discard(labelled)
    stars = groups.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return saved(components(saved(stars.unionByName(found), "edges")), "groups")
