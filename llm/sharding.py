"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are equal texts. Group sizes are summed in the cluster, and groups are counted by size: the driver packs
runs of (size, number of groups), of which there are few, whatever the number of groups: distinct sizes add up to
no more than all bytes, so there are at most sqrt(2 * bytes). Beyond EXACT bytes sizes count in units that
keep that number below 2**19. Sizes descend; a group enters the bin with the tightest remaining capacity that
holds it, found in a balanced tree. As that bin stays the tightest while it holds the size, a run is placed bin by
bin, which puts every group where placing them one by one would. Groups of a size are told apart by their rank by
digest, so each group goes to the bin that its place in the run has.

Law `bytes`: shard sizes are as equal as indivisible groups allow: the least capacity for which ``shards`` bins
suffice is found by bisection (a group larger than a fair share fills a shard alone). With a fixed capacity
instead, as many shards as best-fit-decreasing opens.

Edge cases: a null text counts no bytes and groups with the empty text; each row counts one byte more;
repeated rows are one group; extra columns are ignored; an empty table gives an empty result; groups of one size
are placed by digest, so ties don't depend on the order of rows.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, table

EXACT = 1 << 36
PART_ROWS = 50_000


class CapacityTree:
    """Bins ordered by (remaining capacity, number) in a treap: a balanced search tree in expectation."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.random = random.Random(11)

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, left: int, number: int) -> None:
        low, high = self._split(self.root, (left, number))
        self.root = self._join(self._join(low, [(left, number), self.random.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity that holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._join(low, rest)
        return key


Run = tuple[int, int]  # size of a group, number of groups


def best_fit_decreasing(runs: list[Run], capacity: int, bins: int | None = None) -> list[list[tuple[int, int]]] | None:
    """(bin, number of groups) in order for each run (sizes descend), bins of one capacity, opened as needed.

    Groups larger than the capacity get bins of their own. None if more than ``bins`` bins are needed.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, left in runs:
        places: list[tuple[int, int]] = []
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if opened == bins:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, number = found
            n = min(left, max(1, room // size))
            tree.add(room - n * size, number)
            places.append((number, n))
            left -= n
        out.append(places)
    return out


def pack_into(runs: list[Run], bins: int) -> list[list[tuple[int, int]]]:
    """Best-fit decreasing with the least capacity (by bisection) that needs no more than ``bins`` bins.

    A group of a fair share of what is left or more has a bin to itself, so it does not widen the others.
    """
    total = sum(s * n for s, n in runs)
    rest, alone, out = [list(r) for r in runs], 0, [[] for _ in runs]
    for k, r in enumerate(rest):
        while r[1] and bins - alone > 1 and r[0] * (bins - alone) >= total:
            out[k].append((alone, 1))
            total -= r[0]
            alone, r[1] = alone + 1, r[1] - 1
        if r[1]:
            break
    some = [(s, n) for s, n in rest]
    largest = max((s for s, n in some if n), default=0)
    low = max(-(-total // (bins - alone)), largest)
    high = low + largest  # enough: all bins but one are filled to within the largest group, or none is left over
    best = None
    while best is None:
        best, high = best_fit_decreasing(some, high, bins - alone), 2 * high
    high //= 2
    while low < high:
        middle = (low + high) // 2
        packed = best_fit_decreasing(some, middle, bins - alone)
        if packed is not None:
            best, high = packed, middle
        else:
            low = middle + 1
    return [[*o, *((alone + b, n) for b, n in places)] for o, places in zip(out, best, strict=True)]


def _numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Numbers the rows of each key without a gap in column ``name``: within parts by hash of ``order``, behind the parts before."""
    parts = max(256, rows.count() // PART_ROWS)
    cut = materialise(rows.withColumn("part", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int")), "cut")
    counts = cut.groupBy(*keys, "part").count()
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = materialise(counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select(*keys, "part", "offset"), "offsets")
    within = Window.partitionBy(*keys, "part").orderBy(order)
    return cut.withColumn(name, F.row_number().over(within).cast("long") - 1).join(offsets, [*keys, "part"]).withColumn(name, F.col(name) + F.col("offset")).drop("part", "offset")


def shard(docs: DataFrame, shards: int = 16, capacity: int | None = None, exact: int = EXACT) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document; ``capacity`` in place of ``shards``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")),
        "rows",
    )
    sizes = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    unit = max(1, (rows.agg(F.sum("size")).head()[0] or 0) // exact)
    groups = materialise(sizes.select("group", F.ceil(F.col("bytes") / unit).cast("long").alias("units")), "groups")
    counted = groups.groupBy("units").count().orderBy(F.desc("units")).collect()  # distinct sizes: at most 2**19
    runs = [(r["units"], r["count"]) for r in counted]
    packed = pack_into(runs, shards) if capacity is None else best_fit_decreasing(runs, max(1, capacity // unit))
    spans = []
    for (size, _), places in zip(runs, packed, strict=True):
        first = 0
        for number, n in places:
            spans.append((size, first, first + n, number))
            first += n
    # at most one row for each size and bin, less what bins too full for a size leave out
    where = spark.createDataFrame(spans, "units long, first long, last long, shard int")
    ranked = _numbered(groups, ["units"], "group", "rank")
    chosen = materialise(ranked.join(where, (ranked["units"] == where["units"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).select("group", "shard"), "where")
    placed = materialise(rows.join(chosen, "group").select("doc_id", "size", "text_crc32", "shard"), "placed")
    discard(rows, groups, chosen)
    return _numbered(placed, ["shard"], "doc_id", "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=16)
