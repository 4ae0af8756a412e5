"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups enter by falling size; each goes to the fullest shard that still has room,
found in a balanced tree of the rooms left. Groups of one size are alike to this
rule, so the packing is done on the histogram of group sizes: a run of equal groups
fills one shard as far as it goes, then the next. The result is that of packing one
by one. The histogram, at most the square root of twice all bytes long, is what
the driver sees; documents are grouped, ranked and numbered on the cluster.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbor.llm.common import ROW, whole_text, with_row
from harbor.sources.scratch import materialize

PARTS = 64  # least number of parts in which rows of a shard, or groups of a size, are ranked
PART_ROWS = 1_000_000  # rows to a part


class RoomTree:
    """An AA tree of (room left, shard): insert, remove, least entry not below, greatest entry."""

    def __init__(self):
        self.root = None  # nodes are [level, key, left, right]

    @staticmethod
    def _skew(node):
        if node and node[2] and node[2][0] == node[0]:
            left = node[2]
            node[2], left[3] = left[3], node
            return left
        return node

    @staticmethod
    def _split(node):
        if node and node[3] and node[3][3] and node[3][3][0] == node[0]:
            right = node[3]
            node[3], right[2] = right[2], node
            right[0] += 1
            return right
        return node

    def insert(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [1, key, None, None]
            side = 2 if key < node[1] else 3
            node[side] = put(node[side])
            return self._split(self._skew(node))

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(node, key):
            if key != node[1]:
                side = 2 if key < node[1] else 3
                node[side] = cut(node[side], key)
            elif node[2] is None:
                return node[3]
            else:
                before = node[2]
                while before[3]:
                    before = before[3]
                node[1] = before[1]
                node[2] = cut(node[2], before[1])
            level = 1 + min(node[2][0] if node[2] else 0, node[3][0] if node[3] else 0)
            if level < node[0]:
                node[0] = level
                if node[3] and node[3][0] > level:
                    node[3][0] = level
            node = self._skew(node)
            node[3] = self._skew(node[3])
            if node[3]:
                node[3][3] = self._skew(node[3][3])
            node = self._split(node)
            node[3] = self._split(node[3])
            return node

        self.root = cut(self.root, key)

    def least_from(self, key: tuple[int, int]) -> tuple[int, int] | None:
        node, found = self.root, None
        while node:
            if node[1] >= key:
                node, found = node[2], node[1]
            else:
                node = node[3]
        return found

    def greatest(self) -> tuple[int, int]:
        node = self.root
        while node[3]:
            node = node[3]
        return node[1]


def pack(histogram: Iterable[tuple[int, int]], capacity: int, shards: int | None = None) -> list[tuple[int, int, int, int]]:
    """Runs (size, first, last, shard) of groups of one size, ranked from 0, for (size, number of groups).

    Without ``shards`` a group that fits nowhere opens another shard; one above the
    capacity gets a shard of its own. With ``shards`` it goes to the one with most room.
    """
    tree, runs, opened = RoomTree(), [], 0
    if shards:
        for shard in range(shards):
            tree.insert((capacity, shard))
    for size, count in sorted(histogram, reverse=True):
        first = 0
        while first < count:
            entry = tree.least_from((size, -1))
            if entry is None and shards is None:
                entry, opened = (max(capacity, size), opened), opened + 1
            elif entry is None:
                entry = tree.greatest()
                tree.remove(entry)
            else:
                tree.remove(entry)
            room, shard = entry
            fit = max(1, min(count - first, room // size))
            runs.append((size, first, first + fit - 1, shard))
            tree.insert((room - fit * size, shard))
            first += fit
    return runs


def ranked(rows: DataFrame, within: str, order: list[str], spread: Column, parts: int, name: str) -> DataFrame:
    """Number the rows of each value of ``within`` without gaps from 0.

    Rows are ranked inside parts, dealt by ``spread``; the sizes of the parts before
    are added. No task ranks a whole value.
    """
    dealt = rows.withColumn("__part", F.pmod(spread, F.lit(parts)))
    sizes = dealt.groupBy(within, "__part").agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(within, "__part", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(within, "__part").orderBy(*order))
    numbered = dealt.withColumn("__inside", inside.cast("long")).join(sizes, [within, "__part"])
    return numbered.withColumn(name, F.col("__inside") - 1 + F.col("__before")).drop("__part", "__inside", "__before")


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; rows of equal texts share a shard.

    A size is the bytes of the text and 1; a null text counts as empty. Shards are near
    equal in bytes, as far as the largest group of equal texts lets them. Slots number
    the rows of a shard from 0. An empty table gives no rows.
    """
    body = whole_text(text)
    rows = with_row(docs).select(
        ROW, F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("key"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "groups")
    histogram = [(row[0], row[1]) for row in groups.groupBy("weight").count().collect()]
    total = sum(weight * count for weight, count in histogram)
    number = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(PARTS, -(-number // (shards * PART_ROWS)))
    runs = pack(histogram, -(-total // shards), shards) or [(0, 0, -1, 0)]
    runs = docs.sparkSession.createDataFrame(runs, "weight long, first long, last long, shard int")
    order = ranked(groups, "weight", ["key"], F.xxhash64("key"), parts, "rank")
    placed = order.join(runs, "weight").filter("rank BETWEEN first AND last").select("key", "shard")
    placed = rows.join(materialize(placed, "placed"), "key")
    return ranked(placed, "shard", ["doc_id", "key", ROW], F.xxhash64(ROW), parts, "slot").drop("key", ROW)
