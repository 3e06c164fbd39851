"""Sharding by bytes: histogram sort.

A document's key is a hash of its text followed by a hash of its doc_id, so that equal texts lie together and even a
group of copies that is larger than a shard can be cut. Exact bytes below candidate boundaries are counted over all
partitions at once; only the cells that hold a wanted boundary are probed again, 4096 times finer, until the boundary
is within tolerance. Then rows move once. The driver holds one histogram of at most 4096 cells for each boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of the key that are left below a cell after each round; at 32 a cell is one text's hash, at 0 one document's.
ROUNDS = (51, 39, 32, 20, 8, 0)
TEXT_BITS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def key_of(text: Column, doc_id: Column) -> Column:
    high = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1))
    low = F.xxhash64(doc_id, F.lit(1)).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))
    return F.shiftleft(high, TEXT_BITS).bitwiseOR(low)


def splitters(keyed: DataFrame, n: int, tolerance: float = 0.001, group_tolerance: float = 0.02) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """n - 1 keys at which keyed (key, size) is cut into parts of near equal bytes, and the first histogram: bytes and
    rows of each cell.

    A boundary stops where it is off by no more than `tolerance` of a part; one between two texts' hashes stops at
    `group_tolerance`, so that groups of equal texts are cut only if they are larger than that: of 8 parts of 1 GB, copies
    that take up more than 20 MB together may lie in two neighbouring shards, and a shard is off by 20 MB at most.
    """
    first = {r["cell"]: (r["bytes"], r["rows"]) for r in keyed.groupBy(F.shiftright("key", ROUNDS[0]).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    total = sum(b for b, _ in first.values())
    part = total / n if total else 0.0
    cuts: dict[int, int] = {}
    #: Wanted boundary -> (key at which its cell begins, bytes below that).
    open_: dict[int, tuple[int, int]] = {j: (0, 0) for j in range(1, n)}
    cells = {0: [(c << ROUNDS[0], b) for c, (b, _) in sorted(first.items())]}
    for k, bits in enumerate(ROUNDS):
        if k:
            above, starts = ROUNDS[k - 1], sorted({at for at, _ in open_.values()})
            probe = keyed.filter(F.shiftright("key", above).isin([at >> above for at in starts]))
            cells = {at: [] for at in starts}
            for r in probe.groupBy(F.shiftright("key", bits).alias("cell")).agg(F.sum("size").alias("bytes")).orderBy("cell").collect():
                cells[(r["cell"] << bits) >> above << above].append((r["cell"] << bits, r["bytes"]))
        ahead: dict[int, tuple[int, int]] = {}
        for j, (at, below) in open_.items():
            wanted = part * j
            for start, size in cells.get(at, []):
                if below + size >= wanted:
                    near_start = wanted - below <= below + size - wanted
                    off = min(wanted - below, below + size - wanted)
                    if off <= part * (group_tolerance if bits == TEXT_BITS else tolerance) or bits == 0:
                        cuts[j] = start if near_start else start + (1 << bits)
                    else:
                        ahead[j] = (start, below)
                    break
                below += size
            else:
                cuts[j] = 1 << 63
        open_ = ahead
        if not open_:
            break
    out, last = [], 0
    for j in range(1, n):
        last = max(last, min(cuts.get(j, (1 << 63) - 1), (1 << 63) - 1))
        out.append(last)
    return out, first


def sharded(keyed: DataFrame, n: int = 8) -> DataFrame:
    """keyed (key, size, doc_id, ...) with shard and slot.

    Slots follow the order of keys and have no gaps; in a cell with many rows they follow the second hash first, so that
    one text's copies are numbered by many tasks. Equal keys are numbered by doc_id, then in any order: such rows are
    equal. A null or empty text has size 1 and is placed like any other; an empty table gives none.
    """
    cuts, cells = splitters(keyed, n)
    shard = sum([(F.col("key") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    rows = sum(r for _, r in cells.values())
    hot = [c for c, (_, r) in cells.items() if r > max(2000, rows // 512)]
    cell = F.shiftright("key", ROUNDS[0])
    fine = F.when(cell.isin(hot), F.shiftright("key", TEXT_BITS - 8).bitwiseAND(F.lit(255))).otherwise(F.lit(0)) if hot else F.lit(0)
    cut = keyed.withColumns({"shard": shard, "__cell": cell, "__fine": fine.cast("int")})
    group = ("shard", "__cell", "__fine")
    numbers = cut.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    numbers = numbers.withColumn("__before", F.sum("__n").over(Window.partitionBy("shard").orderBy("__cell", "__fine")) - F.col("__n")).drop("__n")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("key", "doc_id"))
    return cut.withColumn("__nth", nth).join(numbers, list(group)).withColumn("slot", (F.col("__before") + F.col("__nth") - 1).cast("long")).drop("__cell", "__fine", "__nth", "__before")


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of each row, stored once for the rounds of counting."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stored(docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), key_of(F.col("text"), F.col("doc_id")).alias("key")), "shard-keys")


def shard_documents(docs: DataFrame, n: int = 8) -> DataFrame:
    """docs, all columns, with shard: the boundaries are found on stored keys, and rows are then cut by them."""
    cuts, _ = splitters(keyed_documents(docs), n)
    key = key_of(F.col("text"), F.col("doc_id"))
    return docs.withColumn("shard", sum([(key >= F.lit(c)).cast("int") for c in cuts], F.lit(0)))
