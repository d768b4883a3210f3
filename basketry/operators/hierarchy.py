"""Parent-child links to full hierarchies: paths, depths, roots, descendants and rings.

Level-wise frontier joins throughout: a level joins the rows that are new since the last one with the links, and
nothing else moves. The links are stored once in buckets of their parent, so a level sorts and shuffles only its
frontier; parents with many children are salted over several buckets, and items without children leave the
frontier at once. Each level is a table in the shared scratch folder, so an executor's loss costs a level at most.
Row counts are all that comes to the driver.

A level is a job, and the driver's memory grows with jobs. Without paths, links are therefore first told apart by
what hangs together: what has at most :data:`PIECE` rows is read by one task and followed there, however deep it is;
only what is larger goes down level by level. The names of the larger ones (at most one for each :data:`PIECE` rows)
are all that is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_name
from ..session import cut, cut_counted, discard, scratch_dir, together

#: Links of a bucket, and children of a parent from which on it is spread over several buckets.
BUCKET, HOT = 250_000, 100_000
#: Rows that hang together and are still followed by one task; names that a task joins at a time.
PIECE, JOINED = 250_000, 500_000
#: Rows of a batch that a task gives.
BATCH = 10_000

_ROWS = "item string, root string, depth bigint, on_ring boolean"


def _clean(pairs: DataFrame, child: str, parent: str) -> tuple[DataFrame, int]:
    """Distinct ``(child, parent)`` with stripped names, and their number; the parent may be void, the child may not."""
    return cut_counted(pairs.select(clean_name(F.col(child)).alias("child"), clean_name(F.col(parent)).alias("parent")).where(F.col("child").isNotNull()).distinct())


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(links, items)`` of the rows of :func:`_clean`."""
    return rows.where(F.col("parent").isNotNull()), rows.select(F.explode(F.array_distinct(F.array_compact(F.array("child", "parent")))).alias("item")).distinct()


def clean_links(pairs: DataFrame, child: str = "child", parent: str = "parent") -> tuple[DataFrame, DataFrame]:
    """``(links(child, parent), items(item))``: stripped names, repeated links once.

    Rows with a void child are ignored; a void parent states no parent, but the child is an item.
    """
    return _split(_clean(pairs, child, parent)[0])


class _Links:
    """Distinct links ``(child, parent)`` in buckets of the parent, with what a frontier needs to know of the child.

    ``fan`` is the number of salts of an item as a parent: 0 without children, more than 1 from :data:`HOT`
    children on. ``need`` is the number of an item's parents.
    """

    def __init__(self, links: DataFrame) -> None:
        spark = links.sparkSession
        fans, self.count = cut_counted(links.groupBy(F.col("parent").alias("item")).agg(F.count(F.lit(1)).alias("n")), F.coalesce(F.sum("n"), F.lit(0)))
        self.fans = fans.select("item", (F.floor(F.col("n") / HOT) + 1).cast("int").alias("fan"))
        needs = links.groupBy("child").agg(F.count(F.lit(1)).alias("need"))
        rows = links.join(self.fans.withColumnRenamed("item", "parent").withColumnRenamed("fan", "spread"), "parent").withColumn("salt", F.pmod(F.xxhash64("child"), F.col("spread")).cast("int"))
        rows = rows.join(needs, "child").join(self.fans.withColumnRenamed("item", "child"), "child", "left").select("parent", "salt", "child", F.coalesce("fan", F.lit(0)).alias("fan"), "need")
        buckets = 1 + self.count // BUCKET
        self.name = f"basketry_links_{uuid.uuid4().hex}"
        writer = rows.repartition(buckets, "parent", "salt").write.bucketBy(buckets, "parent", "salt").sortBy("parent", "salt")
        writer.option("compression", "zstd").option("path", f"{scratch_dir(spark)}/{self.name}").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def down(self, frontier: DataFrame) -> DataFrame:
        """The frontier's rows (``item``, ``fan``, others) with the links to the item's children."""
        asked = frontier.where("fan > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
        own = self.table.select("parent", "salt", F.col("child"), F.col("fan").alias("child_fan"), "need")
        return asked.drop("fan").join(own.hint("merge"), (asked["item"] == own["parent"]) & (asked["salt"] == own["salt"])).drop("item", "parent", "salt")

    def fanned(self, frame: DataFrame) -> DataFrame:
        """Rows with ``item``, and the item's fan."""
        return frame.join(self.fans, "item", "left").withColumn("fan", F.coalesce("fan", F.lit(0)))

    def peel(self, start: DataFrame) -> DataFrame:
        """``(item)``: what is left when items whose parents are all gone go, again and again, beginning with ``start``.

        Each level tells the children of what went; children that have lost some parents but not all wait. The
        rest is what :meth:`hung` gives: items that no order from above ever frees.
        """
        level, count = cut_counted(self.fanned(start).select("item", "fan", F.lit(0).cast("bigint").alias("need"), F.lit(0).cast("bigint").alias("lost")))
        levels = [level]
        while count:
            told = self.down(level.where("lost = need").select("item", "fan")).select(F.col("child").alias("item"), F.col("child_fan").alias("fan"), "need", F.lit(1).cast("bigint").alias("lost"))
            told = told.unionByName(level.where("lost < need").select("item", "fan", "need", "lost")).groupBy("item", "fan", "need").agg(F.sum("lost").alias("lost"))
            level, count = cut_counted(told, F.count_if(F.col("lost") == F.col("need")))
            levels.append(level)
        return together(levels).where("lost = need").select("item")

    def descend(self, roots: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame]:
        """``(item, root, depth[, path])`` of the ways down from ``roots`` (``item``), each length of a way once (each
        way with ``paths``), and the items that no ring is above.

        Two things go down in the same join of a level: the ways, and the news to an item that a parent is done
        (rows without a root, as in :meth:`peel`). An item with all parents done is on no ring and below none, and
        no way to it is longer than its level; so the last level that frees an item ends the ways. Ways into the
        items that are never freed are left to the caller to drop.
        """
        keys = ["item", "root", *(["path"] if paths else [])]
        zero = F.lit(0).cast("bigint")
        both = self.fanned(roots).select("item", "fan", F.explode(F.array(F.col("item"), F.lit(None).cast("string"))).alias("root"))
        columns = [*keys[:2], *([F.when(F.col("root").isNotNull(), F.array("item")).alias("path")] if paths else [])]
        level, count = cut_counted(both.select(*columns, "fan", zero.alias("need"), F.lit(1).cast("bigint").alias("depth"), zero.alias("lost")), F.count_if(F.col("root").isNull()))
        levels = [level]
        while count:
            found = self.down(level.where("root is not null or lost = need").drop("need", "lost"))
            step = [F.concat("path", F.array("child")).alias("path")] if paths else []
            found = found.select(F.col("child").alias("item"), "root", *step, F.col("child_fan").alias("fan"), "need", (F.col("depth") + 1).alias("depth"), F.col("root").isNull().cast("bigint").alias("lost"))
            waiting = level.where("root is null and lost < need")
            new = found.unionByName(waiting).groupBy(*keys, "fan", "need").agg(F.max("depth").alias("depth"), F.sum("lost").alias("lost"))
            level, count = cut_counted(new, F.count_if(F.col("root").isNull() & (F.col("lost") == F.col("need"))))
            levels.append(level)
        every = together(levels)
        return every.where("root is not null").select("item", "root", "depth", *keys[2:]), every.where("root is null and lost = need").select("item")

    def reach(self, start: DataFrame) -> DataFrame:
        """Distinct ``(item, root)`` of ``start`` and of all that hangs below; rings are allowed."""
        level, count = cut_counted(self.fanned(start.select("item", "root").distinct()))
        parts = [level]
        while count:
            new = self.down(level).select(F.col("child").alias("item"), "root", F.col("child_fan").alias("fan")).distinct()
            seen = together(parts).select("item", "root")
            level, count = cut_counted(new.join(seen.hint("merge"), ["item", "root"], "left_anti"))
            parts.append(level)
        return together(parts).select("item", "root")

    def colours(self, items: DataFrame) -> DataFrame:
        """``(item, colour)``: the smallest name at or above each item. Only items whose colour changed tell it on."""
        now, count = cut_counted(self.fanned(items.withColumn("colour", F.col("item"))).withColumn("new", F.lit(True)))
        while count:
            told = self.down(now.where("new").select("item", "fan", "colour")).groupBy(F.col("child").alias("item")).agg(F.min("colour").alias("told"))
            both = now.select("item", "colour", "fan").join(told.hint("merge"), "item", "left").select("item", F.least("colour", "told").alias("colour"), "fan", F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("new"))
            now, count = cut_counted(both, F.count_if("new"))
        return now.select("item", "colour")

    def drop(self) -> None:
        """Forget the table; its files stay until the scratch folder is cleared, for results that read it."""
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("parent").alias("child"), F.col("child").alias("parent"))


def _among(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links both of whose ends are among the items."""
    kept = links.join(items.withColumnRenamed("item", "child").hint("merge"), "child", "left_semi")
    return kept.join(items.withColumnRenamed("item", "parent").hint("merge"), "parent", "left_semi").select("child", "parent")


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("child", "parent")).alias("item")).distinct()


def _hung(links: DataFrame) -> DataFrame:
    """Items of the links that are on or below a ring: those that no way down frees."""
    tops = links.select(F.col("parent").alias("item")).distinct().join(links.select(F.col("child").alias("item")), "item", "left_anti")
    return cut(_ends(links).join(_Links(links).peel(tops).hint("merge"), "item", "left_anti"))


def rings(links: DataFrame, hung: DataFrame | None = None) -> DataFrame:
    """``(item, ring)``: items of rings with the smallest name of their ring. ``hung``: items on or below rings, if known.

    Links that hang on no ring above or lead to none below are peeled away from both sides. Colours flow down
    what is left until each item has the smallest name above it; an item that keeps its own name closes a ring
    with those of its colour from which it can be reached. Found rings leave, and the rest is peeled again.
    """
    found = [links.where("child = parent").select(F.col("child").alias("item"), F.col("child").alias("ring"))]
    links = links.where("child <> parent")
    while True:
        links, hung = cut(_among(links, _hung(links) if hung is None else hung)), None
        links, count = cut_counted(_among(links, _hung(_turned(links)))) if not links.isEmpty() else (links, 0)
        if not count:
            break
        colour = cut(_Links(links).colours(_ends(links)))
        tint = lambda name: colour.withColumnRenamed("item", name).hint("merge")
        inner = cut(links.join(tint("child"), "child").join(tint("parent"), ["parent", "colour"]).select("child", "parent", "colour"))
        # up from the items that gave their colour, within it: a colour is one item's, so it stands for the root
        up = _Links(_turned(inner.select("child", "parent")))
        closed = cut(up.reach(colour.where("item = colour").select("item", F.col("colour").alias("root"))))
        # an item alone in its colour is no ring: a ring's first item has a parent within the ring
        real = inner.where("child = colour").join(closed.select(F.col("item").alias("parent"), F.col("root").alias("colour")).hint("merge"), ["parent", "colour"], "left_semi").select(F.col("colour").alias("root")).distinct()
        found.append(cut(closed.join(real.hint("merge"), "root", "left_semi").select("item", F.col("root").alias("ring"))))
        gone = closed.select("item").distinct()
        links = cut(links.join(gone.withColumnRenamed("item", "child").hint("merge"), "child", "left_anti").join(gone.withColumnRenamed("item", "parent").hint("merge"), "parent", "left_anti").select("child", "parent"))
    return reduce(DataFrame.unionByName, found).groupBy("item").agg(F.min("ring").alias("ring"))


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of each run of links, ``(item, component)``: the smallest name that the item hangs together with, if not its own."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def told() -> Iterator[pa.RecordBatch]:
        pairs = [(x, y) for x in above if (y := top(x)) != x]
        for k in range(0, len(pairs), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs[k : k + BATCH])], ["item", "component"])

    for batch in batches:
        for child, parent in zip(*(c.to_pylist() for c in batch.columns)):
            above.setdefault(child, child)
            above.setdefault(parent, parent)
            low, high = sorted((top(child), top(parent)))
            above[high] = low
        if len(above) >= size:
            yield from told()
            above.clear()
    yield from told()


def components(links: DataFrame, number: int) -> DataFrame:
    """``(item, component)``: the smallest name that hangs together with the item, for items of which it is not the own name.

    ``number``: of the links, about. Tasks join what they read; what is left is joined in rounds. In each, every item
    ties its larger neighbours to the smallest around it, and then its smaller ones, which shortens all ways at once.
    """
    size = JOINED
    dealt = links.where("child <> parent").select("child", "parent").repartition(1 + 2 * number // size, "child")
    table, moved = cut_counted(dealt.mapInArrow(lambda batches: _joined(batches, size), "item string, component string"))
    while moved:
        both = table.select("item", "component").union(table.select("component", "item")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        tied = both.where("v > u").join(least.hint("merge"), "u").groupBy(F.col("v").alias("item"), F.col("low").alias("to")).agg(F.max(F.col("low") < F.col("u")).alias("moved"))
        least = tied.groupBy("item").agg(F.min("to").alias("component"), (F.count(F.lit(1)) > 1).alias("several"))
        tied = tied.join(least.hint("merge"), "item").withColumn("moved", F.col("moved") | F.col("several"))
        tied = tied.select(F.explode(F.array("item", "to")).alias("item"), "component", "moved").where("item <> component")
        done, (table, moved) = table, cut_counted(tied.groupBy("item", "component").agg(F.max("moved").alias("moved")), F.count_if("moved"))
        discard(done)
    return table.select("item", "component")


def _tagged(rows: DataFrame, number: int) -> DataFrame:
    """Rows of :func:`_clean` with the ``component`` that they belong to."""
    known = components(rows.where(F.col("parent").isNotNull()), number).withColumnRenamed("item", "child")
    return rows.join(known.hint("merge"), "child", "left").select(F.coalesce("component", "child").alias("component"), "child", "parent")


def _closed(below: list[list[int]], hung: list[int]) -> dict[int, int]:
    """Items of rings among the hung ones, with the smallest of their ring."""
    above: dict[int, list[int]] = {i: [] for i in hung}
    for i in hung:
        for c in below[i]:
            above[c].append(i)
    finished, seen = [], set()
    for i in hung:
        if i in seen:
            continue
        seen.add(i)
        todo = [(i, iter(below[i]))]
        while todo:
            c = next((c for c in todo[-1][1] if c not in seen), None)
            if c is None:
                finished.append(todo.pop()[0])
            else:
                seen.add(c)
                todo.append((c, iter(below[c])))
    ring: dict[int, int] = {}
    for i in reversed(finished):
        if i in seen:
            seen.discard(i)
            own = [i]
            for x in own:
                new = {p for p in above[x] if p in seen}
                seen -= new
                own += new
            if len(own) > 1 or i in below[i]:
                ring |= dict.fromkeys(own, min(own))
    return ring


def _followed_piece(rows: list[tuple[str, str | None]]) -> Iterator[tuple[str, str, int, bool]]:
    """The rows of :func:`hierarchy` of all links that hang together; memory is in proportion to the links."""
    names = sorted({x for row in rows for x in row if x is not None})
    number = {x: k for k, x in enumerate(names)}
    below: list[list[int]] = [[] for _ in names]
    need = [0] * len(names)
    for child, parent in rows:
        if parent is not None:
            below[number[parent]].append(number[child])
            need[number[child]] += 1
    order = [i for i, n in enumerate(need) if not n]
    roots = len(order)
    for i in order:
        for c in below[i]:
            need[c] -= 1
            if not need[c]:
                order.append(c)
    place = [-1] * len(names)
    for k, i in enumerate(order):
        place[i] = k
    ring = _closed(below, [i for i, k in enumerate(place) if k < 0])
    for root in [*order[:roots], *sorted(set(ring.values()))]:
        reached, seen = [root], {root}
        for i in reached:
            for c in below[i]:
                if c not in seen:
                    seen.add(c)
                    reached.append(c)
        depth = {root: 1}
        for k in sorted(place[i] for i in reached if place[i] >= 0):
            step = depth[order[k]] + 1
            for c in below[order[k]]:
                if step > depth.get(c, 0):
                    depth[c] = step
        for i in reached:
            yield names[i], names[root], depth[i] if place[i] >= 0 else 0, i in ring


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`hierarchy` of ``(component, child, parent)`` sorted by component."""
    links = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    kinds = {"item": pa.string(), "root": pa.string(), "depth": pa.int64(), "on_ring": pa.bool_()}
    out: list[tuple] = []
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds.values())], list(kinds))
    for _, own in groupby(links, itemgetter(0)):
        for row in _followed_piece([x[1:] for x in own]):
            out.append(row)
            if len(out) == BATCH:
                yield give()
                out.clear()
    if out:
        yield give()


def hierarchy(pairs: DataFrame, child: str = "child", parent: str = "parent", paths: bool = True, every: bool = False) -> DataFrame:
    """``(item, root, depth bigint, on_ring boolean[, path array<string>])``: one row per item and root above it.

    With ``every`` (and ``paths``) each way from the root is a row of its own; ``depth`` stays that of the longest.

    A root is an item without a parent (depth 1, its own row included); depth is 1 + the links of the longest
    way from the root, ``path`` that way (of several the smallest). For items on or below a ring (items that
    are each other's ancestors, or one that is its own parent) the smallest name of each such ring is a root
    too, depth is 0 in all their rows and ``path`` null. ``on_ring`` says whether the item is in a ring.
    Void children and repeated rows count for nothing; an empty table gives no rows; other columns are not read.
    """
    rows, number = _clean(pairs, child, parent)
    if paths:
        return _levels(rows, True, every)
    tagged = cut(_tagged(rows, number))
    large, count = cut_counted(tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE).select("component"))
    small = tagged.join(F.broadcast(large), "component", "left_anti") if count else tagged
    out = small.repartition("component").sortWithinPartitions("component").select("component", "child", "parent").mapInArrow(_followed, _ROWS)
    if count:
        out = out.unionByName(_levels(tagged.join(F.broadcast(large), "component", "left_semi").select("child", "parent"), False, False))
    return out


def _levels(rows: DataFrame, paths: bool, every: bool) -> DataFrame:
    """:func:`hierarchy` of the rows of :func:`_clean`, level by level."""
    links, items = _split(rows)
    roots = items.join(links.select(F.col("child").alias("item")), "item", "left_anti")
    ways, freed = _Links(links).descend(roots, paths)
    hung, ringed = cut_counted(items.join(freed.hint("merge"), "item", "left_anti"))
    if ringed:
        ways = ways.join(hung.hint("merge"), "item", "left_anti")
    depth = F.max("depth").alias("depth")
    if paths and every:
        longest = ways.groupBy("item", "root").agg(depth)
        above = ways.drop("depth").join(longest.hint("merge"), ["item", "root"]).select("item", "root", "depth", "path")
    elif paths:  # of the longest ways the smallest
        above = ways.groupBy("item", "root").agg(F.min(F.struct(-F.col("depth"), "path")).alias("s")).select("item", "root", (-F.col("s.col1")).alias("depth"), "s.path")
    else:
        above = ways.groupBy("item", "root").agg(depth)
    out = above.withColumn("on_ring", F.lit(False))
    if ringed:
        out = cut(out)
        rest = cut(links.join(hung.withColumnRenamed("item", "child").hint("merge"), "child", "left_semi").select("child", "parent"))
        ring = cut(rings(rest, hung))
        # from clean items straight into the ringed part, and from the rings themselves
        entering = rest.join(out.select(F.col("item").alias("parent"), "root").distinct().hint("merge"), "parent").select(F.col("child").alias("item"), "root")
        below = _Links(rest).reach(entering.union(ring.select("item", F.col("ring").alias("root"))))
        marked = below.join(ring.select("item", F.lit(True).alias("on_ring")).hint("merge"), "item", "left").select("item", "root", F.lit(0).cast("bigint").alias("depth"), F.coalesce("on_ring", F.lit(False)).alias("on_ring"))
        if paths:
            marked = marked.withColumn("path", F.lit(None).cast("array<string>"))
        out = out.unionByName(marked)
    return out.select("item", "root", "depth", "on_ring", *(["path"] if paths else []))


def descendants(pairs: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Distinct ``(item, descendant)``: all items below each item; an item on a ring is below itself."""
    links, _ = clean_links(pairs, child, parent)
    down = _Links(links)
    below = down.reach(links.select(F.col("child").alias("item"), F.col("parent").alias("root")))
    return below.select(F.col("root").alias("item"), F.col("item").alias("descendant"))
