"""Mixing sources to target weights.

Each source's words, its documents one after the other, are cut into blocks of a fixed number of words. The mix has as
many words as the sources together, in output shards of a fixed number of block slots. Every slot draws its source, so
that a shard's counts are multinomial; the draws of the last shards are turned over to sources that were drawn too
seldom, so that each source gets its quota of slots exactly. A source's slots, numbered over all shards, go through a
pseudorandom permutation of its blocks, a new one for each pass over the source (swap-or-not, which works on any size
of domain), and blocks are joined by index. Everything is DataFrame functions; hashes of fixed seeds make reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RX, stored

#: Rounds of the swap-or-not permutation.
ROUNDS = 16
#: Rows that share one running sum within a source.
ROWS_A_RUN = 1000


@dataclass
class Mix:
    """sources: source, sid, weight, source_size, target, quota, n_blocks. slots: shard, sid, i, block.
    docs: doc_id, tie, sid, size, source_size, target, taken."""

    sources: DataFrame
    slots: DataFrame
    docs: DataFrame


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, block_words: int, most: int = 3, seed: int = 11) -> DataFrame:
    """sizes: source, source_size, rows. Weights 1, 2, 3 in turn by code point, null last; a target stops at `most` times
    its source's size and the rest is shared anew by weight. That is min(cap, level * weight) with one level for all,
    found by running sums over the sources in order of cap / weight. The quota is the number of slots whose words come
    nearest to the target, at least one where there is a target: a source's last block is short, and the permutation of
    the last pass says whether that block is among the slots."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("all_words", F.sum("source_size").over(everything)).withColumn("all_weights", F.sum("weight").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("capped", left * F.col("weight") >= F.col("cap") * weights)
    full = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0.0)).over(everything)
    level = F.try_divide(F.col("all_words") - full("cap"), F.col("all_weights") - full("weight"))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")))
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    # Whole passes first; of the next one, as many slots without the short block, or more with it.
    n = F.greatest("n_blocks", F.lit(1).cast("long"))
    s = s.withColumn("passes", F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most).cast("long")))
    s = s.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    s = s.withColumn("short_at", permuted(n - 1, n, F.lit(seed), F.col("sid"), F.col("passes"), back=True)).withColumn("lacks", F.col("n_blocks") * block_words - F.col("source_size"))
    s = s.withColumn("without", F.least(F.round(F.col("rest") / block_words).cast("long"), F.col("short_at")))
    s = s.withColumn("with", F.least(F.greatest(F.round((F.col("rest") + F.col("lacks")) / block_words).cast("long"), F.col("short_at") + 1), n))
    nearer = F.abs(F.col("with") * block_words - F.col("lacks") - F.col("rest")) < F.abs(F.col("without") * block_words - F.col("rest"))
    slots = F.col("passes") * F.col("n_blocks") + F.when(nearer, F.col("with")).otherwise(F.col("without"))
    quota = F.when(F.col("target") > 0, F.greatest(F.lit(1).cast("long"), F.least(slots, most * F.col("n_blocks")))).otherwise(F.lit(0).cast("long"))
    return s.select("source", "sid", "weight", "source_size", "rows", "target", quota.alias("quota"), "n_blocks")


def permuted(i: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """The place of i in a pseudorandom permutation of 0 to n - 1 that the key fixes; with `back`, what has its place at i."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        swap = F.xxhash64(*key, r, F.greatest(x, other), F.lit(7)) % 2 == 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1)), i, step)


def mix(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 11) -> Mix:
    """Mix docs (doc_id, text, source; other columns play no part). The driver gets two numbers.

    A null source is one more source, the last. Null and empty texts have size 0 and are taken 0 times; an empty table
    gives empty results. Repeated rows are separate documents. No block, and so no document, is taken more than 3 times
    over. `tie` hashes text and source, to find a document again.
    """
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text", "source").alias("tie"), size_of(F.col("text")).alias("size")), "mix-sizes")
    sources = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), block_words, seed=seed), "mix-sources")

    # The sources' shares of the slots lie end to end; a draw finds its source by the cell of that line that it falls into.
    # There are four cells a source, so that a large source spreads over many and no cell holds many small ones on average.
    row = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    total, width = row["total"], max(1, row["total"] // (4 * max(row["n"], 1)))
    n_shards = -(-total // shard_slots)
    ends = sources.filter("quota > 0").select("sid", "quota", F.sum("quota").over(Window.orderBy("sid")).alias("past")).withColumn("begin", F.col("past") - F.col("quota"))
    cells = ends.select("sid", "begin", "past", F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"(past - 1) div {width}"))).alias("cell"))
    draws = spark.range(n_shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.lit(total) - F.col("id") * shard_slots).cast("int") - 1)).alias("slot"))
    u = F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(total, 1)))
    draws = draws.select("shard", u.alias("u")).withColumn("cell", F.expr(f"u div {width}")).join(cells, "cell").filter("u >= begin and u < past")
    drawn = draws.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))

    start = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    drawn = drawn.withColumn("start", start).join(sources.select("sid", "quota"), "sid")
    drawn = stored(drawn.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("start")))), "mix-draws")
    # Few rows become many slots below: they are dealt out evenly first.
    dealt = drawn.filter("keep > 0").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "sid")
    kept = dealt.select("shard", "sid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("keep") - 1)).alias("i"))
    # Slots drawn beyond a source's quota, which only the last shards have, go to the sources that lack some.
    over = drawn.filter("n > keep").select("shard", "sid", (F.col("n") - F.col("keep")).alias("n"))
    over = over.withColumn("e", F.sum("n").over(Window.orderBy("shard", "sid")) - F.col("n"))
    over = over.select("shard", F.explode(F.sequence(F.col("e"), F.col("e") + F.col("n") - 1)).alias("e"))
    lack = sources.join(drawn.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").select("sid", F.coalesce("got", F.lit(0)).alias("got"), "quota").filter("quota > got")
    lack = lack.withColumn("e", F.sum(F.col("quota") - F.col("got")).over(Window.orderBy("sid")) - (F.col("quota") - F.col("got")))
    lack = lack.select("sid", F.explode(F.transform(F.sequence(F.lit(0), F.col("quota") - F.col("got") - 1), lambda k: F.struct((F.col("e") + k).alias("e"), (F.col("got") + k).alias("i")))).alias("x")).select("sid", "x.*")
    slots = kept.unionByName(over.join(lack, "e").select("shard", "sid", "i"))
    slots = slots.join(sources.select("sid", "n_blocks"), "sid")
    epoch = F.floor(F.col("i") / F.col("n_blocks"))
    slots = slots.select("shard", "sid", "i", permuted(F.col("i") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("sid"), epoch).alias("block"))

    # Where each document lies among its source's words: running sums in runs of rows, and the runs' sums before them.
    placed = sized.join(sources.select("source", "sid", "source_size", "target", "rows"), sized["source"].eqNullSafe(sources["source"])).drop("source")
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "tie"), F.ceil(F.col("rows") / ROWS_A_RUN)))
    runs = placed.groupBy("sid", "run").agg(F.sum("size").alias("words"))
    runs = runs.select("sid", "run", (F.sum("words").over(Window.partitionBy("sid").orderBy("run")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("sid", "run").orderBy("doc_id", "tie")
    placed = placed.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(runs, ["sid", "run"])
    first = F.col("before") + F.col("upto") - F.col("size")
    piece = lambda b: F.struct(b.alias("block"), (F.least(first + F.col("size"), (b + 1) * block_words) - F.greatest(first, b * block_words)).alias("words"))
    spans = F.when(F.col("size") > 0, F.transform(F.sequence(F.floor(first / block_words), F.floor((first + F.col("size") - 1) / block_words)), piece))
    pieces = placed.select("doc_id", "tie", "sid", "run", "nth", "size", "source_size", "target", F.explode_outer(spans).alias("p")).select("*", "p.block", "p.words").drop("p")
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(times, ["sid", "block"], "left").groupBy("sid", "run", "nth", "doc_id", "tie", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("times") * F.col("words")), F.lit(0)).cast("long").alias("taken"))
    return Mix(sources, slots, taken.select("doc_id", "tie", "sid", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as often as the mix takes them, in whole copies: a document's taken words over its size, rounded up or down
    by a hash, so that the sources' words stay near their targets. Same columns; rows equal in doc_id, text and source
    share what is taken of them evenly. Documents without words are kept once."""
    got = mix(docs, **how).docs.groupBy("doc_id", "tie").agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    got = got.withColumnsRenamed({"doc_id": "__doc", "tie": "__tie"})
    tie = F.xxhash64("text", F.col("source").cast("string"))
    joined = docs.join(got, docs["doc_id"].eqNullSafe(F.col("__doc")) & (tie == F.col("__tie")))
    share = F.col("__taken") / F.col("__size")
    chance = F.pmod(F.xxhash64("__doc", "__tie", F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    copies = F.when(F.col("__size") == 0, 1).otherwise((F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("int"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies))).filter("__copy > 0").select(*[docs[c] for c in docs.columns])
