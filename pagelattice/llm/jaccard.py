"""Documents linked by the Jaccard similarity of their word shingles, without loss.

Copies with equal sets become one class. A class that links with another shares tokens with it among its first ones in
any order that both follow: with n tokens, at least L of its first n - ceil(0.8 n) + L. So classes without that many
tokens that any other class has among its first ones are done. The rest fall into clusters that share such tokens. The
order puts frequent tokens last, as far as a bounded sample knows them; clusters that are large all the same are sorted
out once more in the order of their tokens' exact frequency, which parts classes that only share passages. Each cluster
is joined by a signature tree in one task; one with more tokens than fit a task, which is a group of near copies then,
is cut into blocks, and each two blocks are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, last_scratch, partitions_for, removed, stored
from .components import components

K, PERCENT = 5, 80
#: One in how many documents the sample is made of that frequent tokens are looked for in, its documents at most, in how
#: many of those a frequent token is, and how many of them are kept at most. They steer the order of tokens and how they
#: are counted, never the result.
ONE_IN, SAMPLE, FREQUENT, MOST_FREQUENT = 12, 50_000, 4, 100_000
#: Tokens from which on a cluster is sorted out once more; tokens of a cluster's block that one task holds.
LARGE_TOKENS, BLOCK_TOKENS = 1_000_000, 1_000_000
#: Low bits of a token that are left out where classes meet by tokens: fewer bytes travel, and what meets by chance is
#: told apart by the exact check.
SPARED_BITS = np.uint64(16)
#: Powers of two that the filter's bits lie between, 32 MB at most: it spares most documents the way to the clusters.
LEAST_BITS, MOST_BITS = 20, 28


def _extra(n):
    """L for a set of n tokens."""
    return 1 + n // 12


def _class(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens in many documents of a bounded sample by hash, sorted; MOST_FREQUENT at most. Only those
    of the lower half of hashes are counted: the others are hardly ever among a set's first ones."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                got = np.concatenate(shingle_sets(batch.slice(at, 128).column(0).to_pylist(), K))
                yield pa.RecordBatch.from_arrays([pa.array(got[got < 1 << 63].view(np.int64))], ["token"])

    rows = docs.count()
    if not rows:
        return np.zeros(0, np.uint64)
    share = max(ONE_IN, rows // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(share)) == 0).select("text")
    often = in_arrow(sample, tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    top = often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow().column("token")
    return np.sort(np.array(top, np.int64).view(np.uint64))


def described(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """doc_id, tie (hash of the text), n (tokens), cls (hash of the set), first and last (the rare and the frequent ones of
    its first tokens), for every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        def lists(of: list[np.ndarray]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in of]), pa.int32()), pa.array(np.concatenate(of)))

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sizes, classes, firsts, lasts = [], [], [], []
                for some in shingle_sets(part.column(2).to_pylist(), K):
                    n = len(some)
                    sizes.append(n)
                    classes.append(_class(some) if n else None)
                    most = n - -(-PERCENT * n // 100) + _extra(n) if n else 0
                    known = np.zeros(n, bool)
                    if len(often) and n:
                        known = often[np.minimum(np.searchsorted(often, some), len(often) - 1)] == some
                    rare = some[~known][:most]
                    firsts.append((rare >> SPARED_BITS).view(np.int64))
                    lasts.append((some[known][: most - len(rare)] >> SPARED_BITS).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists(firsts), lists(lasts)], ["doc_id", "tie", "n", "cls", "first", "last"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text"), describe, "doc_id long, tie long, n long, cls long, first array<long>, last array<long>")


def _met(rare: DataFrame, often: DataFrame) -> DataFrame:
    """cls, token of rare and of frequent tokens -> cls, token, df (rows with the token), near (its least class), of
    tokens that several classes have.

    Rare tokens meet by one exchange and are few for each token; the frequent ones, MOST_FREQUENT at most, which hold the
    hot groups, are counted by an aggregate that is broadcast back."""
    of = Window.partitionBy("token")
    met = rare.select("cls", "token", F.count(F.lit(1)).over(of).alias("df"), F.min("cls").over(of).alias("near"), F.max("cls").over(of).alias("far")).filter("near < far").drop("far")
    counts = often.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("cls").alias("near"), F.max("cls").alias("far")).filter("near < far").drop("far")
    return met.unionByName(often.join(F.broadcast(counts), "token").select("cls", "token", "df", "near"))


def _enough(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """hits: cls, token, near; sizes: cls, n -> cls, n, with, of the classes with as many hits as a link calls for: the
    partner may be smaller by a fifth."""
    hits = hits.groupBy("cls", "token").agg(F.min("near").alias("near")).groupBy("cls").agg(F.count(F.lit(1)).alias("hits"), F.collect_set("near").alias("with"))
    return hits.join(sizes, "cls").filter(F.col("hits") >= 1 + F.floor(F.ceil(F.col("n") * PERCENT / 100) / 12)).select("cls", "n", "with")


def _suspects(rows: DataFrame) -> DataFrame:
    """cls, n, with: the classes that share enough of their first tokens with others."""
    hits = _met(rows.select("cls", F.explode("first").alias("token")), rows.select("cls", F.explode("last").alias("token")))
    return _enough(hits, rows.groupBy("cls").agg(F.min("n").alias("n")))


def _sorted_out(members: DataFrame, docs: DataFrame, often: np.ndarray) -> DataFrame:
    """members: cls, n, doc_id of large clusters -> cls, n, with, by their first tokens in the order of exact frequency
    among the members. A set's tokens that no other member has come first of all, and are only counted."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for cls, some in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), K), strict=True):
                    if _class(some) == cls:
                        known = often[np.minimum(np.searchsorted(often, some), len(often) - 1)] == some if len(often) else np.zeros(len(some), bool)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), cls)), pa.array((some >> SPARED_BITS).view(np.int64)), pa.array(known)], ["cls", "token", "known"])

    every = stored(in_arrow(_texts_of(members, docs).select("cls", "text"), tokens, "cls long, token long, known boolean"), "jaccard-tokens")
    tokens_path = last_scratch()
    met = _met(every.filter("not known").select("cls", "token"), every.filter("known").select("cls", "token"))
    by_class = met.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("ts")).join(members.select("cls", "n").distinct(), "cls")
    extra = 1 + F.floor(F.col("n") / 12)
    most = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + extra - (F.col("n") - F.size("ts"))
    first = by_class.select("cls", F.explode(F.slice("ts", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))).alias("t")).select("cls", "t.token")
    first = stored(first, "jaccard-first")
    removed(docs.sparkSession, [tokens_path])
    near = first.groupBy("token").agg(F.min("cls").alias("near"), F.max("cls").alias("far")).filter("near < far").drop("far")
    return _enough(first.join(near, "token"), members.select("cls", "n").distinct())


def _filtered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id may be in wanted, by a bitmap that is broadcast: 16 bits for each that is wanted, as
    far as MOST_BITS go; beyond that it lets more rows pass, which the join then drops."""
    size = 1 << max(LEAST_BITS, min(MOST_BITS, (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(9)), F.lit(size))
    bits = wanted.select(place("doc_id").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))
    rows = docs.withColumn("__h", place("doc_id"))
    rows = rows.join(F.broadcast(bits), F.bitmap_bucket_number("__h") == F.col("__bucket"))
    at = F.bitmap_bit_position("__h")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.expr("true") & (F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1)).drop("__h", "__bucket", "__bits")


def _texts_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members (doc_id, ...) with their texts. A doc_id may stand beside several texts; who reads them tells by the class."""
    named = members.withColumnRenamed("doc_id", "__doc")
    texts = _filtered(docs, members)
    return texts.join(named, texts["doc_id"].eqNullSafe(F.col("__doc"))).drop("__doc", "doc_id")


def _join_clusters(rows: DataFrame) -> DataFrame:
    """rows: task (long), side (int or null), cls, text. Returns a, b: each linked class beside its task's least one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets
        from .signature_tree import linked

        held: dict[int, np.ndarray] = {}
        sides: dict[int, int | None] = {}
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                names = sorted(held)
                side = [sides[x] for x in names]
                root = linked([held[x] for x in names], PERCENT, None if None in side else np.array(side))
                names = np.array(names, np.int64)
                moved = root != np.arange(len(names))
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                task, side, cls = (part.column(k).to_pylist() for k in range(3))
                for t, s, c, some in zip(task, side, cls, shingle_sets(part.column(3).to_pylist(), K), strict=True):
                    if t != now:
                        yield from done()
                        held, sides, now = {}, {}, t
                    if c not in held and _class(some) == c:  # a doc_id may stand beside several texts
                        held[c], sides[c] = some, s
        yield from done()

    return in_arrow(rows, join, "a long, b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, tie, n, cls) of every row of docs, and links (a, b) that join linked classes, directly or by others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")  # hashes of int and long differ
    often = frequent_tokens(docs)
    described_rows = stored(described(docs, often), "jaccard-rows")
    rows_path = last_scratch()
    rows = stored(described_rows.select("doc_id", "tie", "n", "cls"), "jaccard-ids")
    one = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))

    def clustered(suspects: DataFrame) -> DataFrame:
        """cls, n, with -> cls, n, doc_id, cluster, tokens of the cluster; clusters of one class are left out."""
        clusters = components(suspects.select(F.col("cls").alias("a"), F.explode("with").alias("b")))
        members = suspects.select("cls", "n").join(clusters, suspects["cls"] == clusters["node"]).select("cls", "n", F.col("comp").alias("cluster"))
        sizes = members.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
        return stored(members.join(sizes, "cluster").join(one, "cls"), "jaccard-members")

    suspects = stored(_suspects(described_rows.filter("n > 0")), "jaccard-suspects")
    removed(docs.sparkSession, [rows_path])  # the first tokens have met
    members = clustered(suspects)
    large = members.filter(F.col("tokens") > LARGE_TOKENS)
    if large.limit(1).count():
        members = members.filter(F.col("tokens") <= LARGE_TOKENS).unionByName(clustered(stored(_sorted_out(large.select("cls", "n", "doc_id"), docs, often), "jaccard-suspects")))
    members = members.select("cls", "cluster", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"), "doc_id")
    several = members.filter("blocks > 1").limit(1).count() > 0
    rows_of = _texts_of(members, docs)
    if not several:
        tasks = rows_of.select(F.col("cluster").alias("task"), F.lit(None).cast("int").alias("side"), "cls", "text")
    else:
        # Block pairs i <= j of a cluster; a block by itself has no sides.
        block = F.pmod(F.xxhash64("cls", F.lit(13)), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
        tasks = rows_of.withColumn("block", block).withColumn("p", F.explode(pair))
        side = F.when(F.col("p.i") != F.col("p.j"), (F.col("block") == F.col("p.j")).cast("int"))
        tasks = tasks.select(F.when(F.col("blocks") == 1, F.col("cluster")).otherwise(F.xxhash64("cluster", "p.i", "p.j")).alias("task"), side.alias("side"), "cls", "text")
    tasks = tasks.repartition(partitions_for(docs, 32 << 20), "task").sortWithinPartitions("task")
    links = stored(_join_clusters(tasks), "jaccard-links")
    if several:
        links = components(links).select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return rows, links


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; others play no part).

    component_id is the smallest doc_id reachable by links. Null, empty and blank texts have no shingle and stand alone;
    equal sets are linked; repeated rows are in one component. A null doc_id takes part but is never the smallest unless
    there is no other. An empty table gives an empty result.
    """
    rows, links = classes(docs)
    # Least ids by class first: no task gathers the rows of a class, and classes, not rows, meet by component.
    least = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = least.join(links, least["cls"] == links["a"], "left").select("cls", "least", F.coalesce("b", "cls").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least").alias("least"))
    named = least.select("cls", "root").join(of_root, "root").select(F.col("cls").alias("__cls"), "least")
    out = rows.join(named, rows["cls"] == F.col("__cls"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("__cls").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are linked to one of a smaller doc_id, all columns as they were; of linked rows with one
    doc_id, one stays, and texts that are not linked stay whatever their doc_id; rows without shingles all stay.

    A null doc_id is the last. What stays of a component is named by doc_id and a hash of the text."""
    rows, links = classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("first")
    least = rows.filter("n > 0").groupBy("cls").agg(first)
    least = least.join(links, least["cls"] == links["a"], "left").select(F.coalesce("b", "cls").alias("root"), "first.*")
    kept = least.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__doc"), F.col("first.tie").alias("__tie"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t-\r]")
    joined = docs.filter(~blank).join(kept, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__tie")))
    return joined.dropDuplicates(["__doc", "__tie"]).select(*[docs[c] for c in docs.columns]).unionByName(docs.filter(blank))
