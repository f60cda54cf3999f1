"""Sharding by histogram sort: shards of equal bytes that are consecutive ranges of a total order.

Rows are ordered by a 64-bit key, then by a 64-bit hash of the id. Pass after pass counts the exact bytes and rows
below candidate boundaries: the first pass places them evenly over the range of keys, later ones only within
intervals that are still open. An interval is open if a shard boundary falls in it too far from either
edge, or if it holds too many rows for one task. Only sums for intervals reach the driver; their number follows
``MAX_INTERVALS`` and not the input. The boundaries known, rows are exchanged once, to their interval; a row's
slot is its rank there plus the rows of the shard before it.

By default the key is a hash of the text, so equal texts lie together, and a boundary falls between equal
texts only if their common key alone is too heavy for the tolerance.

Defined results: a null text has no bytes (size 1, CRC of no bytes); a null key or tie counts as the least number, a null size
as none; rows that tie in key and tie are ordered by the kept columns, and repeated rows each get a slot of their own; an
empty table gives no rows; other columns are ignored, and of kept columns named size, shard or slot the output's win; a text of
any length is one row, so a shard may be off by half of the longest. Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, table

TOLERANCE = 0.001
MIN_INTERVALS, MAX_INTERVALS = 1 << 10, 1 << 16
ROWS_PER_INTERVAL = 20_000
REFINE_BITS = 6
#: Intervals up to which their table is broadcast, some tens of bytes each; beyond, rows are joined by a shuffle.
BROADCAST_INTERVALS = 1 << 19
LEAST_LONG = -(1 << 63)


def _top(col: Column, shift: int) -> Column:
    return F.shiftright(col, shift) if shift < 64 else F.lit(0).cast("bigint")


class _Histogram:
    """Intervals of (key, tie) with exact sums, refined level by level.

    Level i cuts the key by key_shift bits and the tie by tie_shift bits (64: not at all).
    """

    def __init__(self, rows: DataFrame, low: int, high: int, intervals: int):
        span = (high - low).bit_length()
        first = max(0, span - (intervals - 1).bit_length())
        shifts = [*range(first, 0, -REFINE_BITS), 0]
        self.levels = [(s, 64) for s in shifts] + [(0, t) for t in (*range(64 - REFINE_BITS, 0, -REFINE_BITS), 0)]
        self.rows = rows
        self.open: list[set[tuple[int, int]]] = []  # intervals of each level that the next level refines
        self.sums: dict[tuple[int, int, int], tuple[int, int]] = {}

    def _is_open(self, level: int) -> Column:
        key_shift, tie_shift = self.levels[level]
        by_key: dict[int, list[int]] = {}
        for a, b in self.open[level]:
            by_key.setdefault(a, []).append(b)
        key, tie = _top(F.col("key"), key_shift), _top(F.col("tie"), tie_shift)
        if tie_shift == 64:
            return key.isin(*by_key)
        out = F.lit(False)
        for a, bs in by_key.items():
            out = out | ((key == a) & tie.isin(*bs))
        return out

    def interval(self) -> list[Column]:
        """The level and coordinates of a row's final interval."""
        depth = len(self.open)
        level: Column = F.lit(depth)
        for i in reversed(range(depth)):
            level = F.when(~self._is_open(i), F.lit(i)).otherwise(level)
        return [level.alias("level"), *self.cut(F.col("level"), depth)]

    def cut(self, level: Column, depth: int) -> list[Column]:
        key, tie = (_top(F.col(c), self.levels[depth][j]) for j, c in enumerate(("key", "tie")))
        for i in reversed(range(depth)):
            key, tie = (F.when(level == i, _top(F.col(c), self.levels[i][j])).otherwise(x) for j, (c, x) in enumerate((("key", key), ("tie", tie))))
        return [key.alias("key_part"), tie.alias("tie_part")]

    def count(self) -> None:
        """One pass: exact sums of the intervals of the deepest level."""
        level = len(self.open)
        key_shift, tie_shift = self.levels[level]
        rows = self.rows.where(self._is_open(level - 1)) if level else self.rows
        cells = rows.groupBy(_top(F.col("key"), key_shift).alias("a"), _top(F.col("tie"), tie_shift).alias("b")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        for r in cells.collect():
            self.sums[level, r["a"], r["b"]] = (r["bytes"], r["n"])
        for a, b in self.open[level - 1] if level else ():
            del self.sums[level - 1, a, b]

    def ordered(self) -> list[tuple[tuple[int, int, int], int, int]]:
        """All intervals in order: (interval, bytes, rows)."""

        def first_key(cell):
            key_shift, tie_shift = self.levels[cell[0]]
            return cell[1] << key_shift, (cell[2] << tie_shift) if tie_shift < 64 else -(1 << 63)

        return [(c, *self.sums[c]) for c in sorted(self.sums, key=first_key)]


def histogram_shards(docs: DataFrame, n_shards: int, size: Column, key: Column, tie: Column, keep: list[Column], tolerance: float = TOLERANCE) -> DataFrame:
    """The kept columns, ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in a shard) of each row.

    Shards differ from an equal share by at most the tolerance or by half of one row, whichever is more.
    """
    spark = docs.sparkSession
    whole = F.struct(*keep) if keep else F.struct(F.lit(0).alias("size"))
    least = F.lit(LEAST_LONG)
    rows = checkpointed(docs.select(whole.alias("_kept"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("size"), F.coalesce(key.cast("bigint"), least).alias("key"), F.coalesce(tie.cast("bigint"), least).alias("tie")))
    kept = [F.col(f"_kept.`{f.name}`").alias(f.name) for f in rows.schema["_kept"].dataType if f.name not in ("size", "shard", "slot")]
    seen = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not seen["n"]:
        return rows.select(*kept, "size", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    wanted = min(MAX_INTERVALS, max(MIN_INTERVALS, seen["n"] // ROWS_PER_INTERVAL))
    heavy = max(256, 4 * seen["n"] // wanted)
    h = _Histogram(rows, seen["lo"], seen["hi"], wanted)
    share = seen["bytes"] / n_shards
    while True:
        h.count()
        depth, below, opened, shards = len(h.open), 0, set(), []
        targets = [share * j for j in range(1, n_shards)]
        cuts = [0] * len(targets)
        for at, (cell, size_, n) in enumerate(h.ordered()):
            refinable = cell[0] == depth and depth + 1 < len(h.levels) and n > 1
            if refinable and n > heavy:
                opened.add(cell[1:])
            for j, t in enumerate(targets):
                if below < t <= below + size_:
                    near = min(t - below, below + size_ - t)
                    if refinable and near > tolerance * share:
                        opened.add(cell[1:])
                    cuts[j] = at if t - below <= below + size_ - t else at + 1
            below += size_
        if not opened:
            break
        h.open.append(opened)
    shard, before = 0, 0
    for at, (cell, _, n) in enumerate(h.ordered()):
        while shard < len(cuts) and cuts[shard] <= at:
            shard, before = shard + 1, 0
        shards.append((*cell, shard, before))
        before += n
    places = spark.createDataFrame(shards, T.StructType([T.StructField(n, t) for n, t in (("level", T.IntegerType()), ("key_part", T.LongType()), ("tie_part", T.LongType()), ("shard", T.IntegerType()), ("before", T.LongType()))]))
    level, *parts = h.interval()
    cells = rows.withColumn("level", level).select("*", *parts)
    rank = F.row_number().over(Window.partitionBy("level", "key_part", "tie_part").orderBy("key", "tie", "size", "_kept")) - 1
    small = len(shards) <= BROADCAST_INTERVALS
    placed = cells.withColumn("rank", rank).join(F.broadcast(places) if small else places, ["level", "key_part", "tie_part"])
    return placed.select(*kept, "size", "shard", (F.col("before") + F.col("rank")).cast("bigint").alias("slot"))


def op1_query(spark, sf_dir: str, n_shards: int = 8) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    out = histogram_shards(docs, n_shards, F.octet_length(text) + 1, F.xxhash64(text), F.xxhash64("doc_id"), [F.col("doc_id"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
