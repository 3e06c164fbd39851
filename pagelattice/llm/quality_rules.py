"""Quality rules whose cut-offs come from the corpus.

Each document gets a few counts and ratios. For every language and source, the ratios go into quantile sketches:
counts in buckets whose ends grow by a constant factor, so that sketches are merged by adding counts and a quantile is
off by a known share of its value at most. A group's sketch is merged with its language's, which weighs as much as
PRIOR documents, and that one with the sketch of all documents likewise: a group of few documents leans on its parent,
a large one on itself. The cut-off lies beyond the 90th percentile by a multiple of its distance from the median, and
where both are zero, at what the sketch can't tell from zero. The cut-offs are joined back; a document fails where its
ratio is beyond one by more than the error that its own counts leave. All of it is built-in functions, one pass for the
counts and one small join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, words_of

SYMBOL_RX = r"[#*$%&|<>]"
#: Characters that running prose has few of.
SHOUT_RX = r"[A-Z!?_^~]"
WINDOW = 8
#: Growth of the sketches' buckets, and the least ratio that they tell from zero.
GROWTH, LEAST = 1.02, 0.01
_ZERO = -1_000_000
#: Documents that a parent's sketch counts as in its children's.
PRIOR = 200
#: The percentile that a group's documents reach, how many times its distance from the median may be added, and the
#: standard errors of its own ratio that a document is given.
UPPER, DISTANCES, ERRORS = 0.9, 3.0, 3.0
#: Groups whose cut-offs are broadcast at most, some 100 bytes each; with more they are joined by key.
MOST_GROUPS = 50_000


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts, in units that come by themselves (a repeated window is 8 words), and whether it may be too
    small as well as too large."""

    name: str
    count: str
    of: str
    unit: int = 1
    both: bool = False

    def counted(self, q: Column) -> Column:
        return q[self.count] / self.unit

    def whole(self, q: Column) -> Column:
        return F.greatest(q[self.of], F.lit(1)) / self.unit

    def ratio(self, q: Column) -> Column:
        return q[self.count] / F.greatest(q[self.of], F.lit(1))


RULES = (
    Rule("symbols", "n_symbols", "word_chars"),
    Rule("word_length", "word_chars", "n_words", both=True),
    Rule("shouting", "n_shout", "word_chars"),
    Rule("dup_lines", "n_dup_lines", "n_lines"),
    Rule("repeats", "n_repeat_words", "n_words", unit=WINDOW),
)


def _covered(words: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more, by 64-bit hashes of the windows."""

    def marked(h: Column) -> Column:
        def count(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

        def twice(s: Column) -> Column:
            hit = F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"]))
            return let(F.sort_array(F.filter(hit, lambda x: x.isNotNull())), count)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, twice))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: let(windows(w), marked))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(hashed)


def counts(text: Column) -> Column:
    """The counts of a text as one struct; null has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")), lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dups")))
    from_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _covered(w).alias("repeats")))
    return F.struct(
        from_words.alias("w"),
        lines.alias("l"),
        F.regexp_count(text, F.lit(SYMBOL_RX)).alias("n_symbols"),
        F.regexp_count(text, F.lit(SHOUT_RX)).alias("n_shout"),
    )


def measured(docs: DataFrame, column: str = "__q") -> DataFrame:
    """docs with a struct column of counts and the fixed base rule."""
    out = docs.withColumn(column, counts(F.col("text")))
    c = F.col(column)
    n, repeats = c["w"]["n"].cast("long"), c["w"]["repeats"].cast("long")
    whole = {
        "n_words": n,
        "word_chars": c["w"]["chars"].cast("long"),
        "n_symbols": c["n_symbols"].cast("long"),
        "n_dup_lines": c["l"]["dups"].cast("long"),
        "n_repeat_words": repeats,
        "n_lines": c["l"]["lines"].cast("long"),
        "n_shout": c["n_shout"].cast("long"),
        "base_failed": (n < 20) | (100 * repeats > 30 * n),
    }
    return out.withColumn(column, F.struct(*[v.alias(k) for k, v in whole.items()]))


def sketches(rows: DataFrame, column: str = "__q") -> DataFrame:
    """lang, source, rule, bucket, n: the sketches of all documents that the base rule leaves. Adding up n merges them."""
    place = lambda x: F.when(x <= LEAST, F.lit(_ZERO)).otherwise(F.ceil(F.log(x) / F.log(F.lit(GROWTH))).cast("int"))
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), place(r.ratio(F.col(column))).alias("bucket")) for r in RULES])
    left = rows.filter(~F.col(column)["base_failed"]).select("lang", "source", F.explode(values).alias("v"))
    return left.groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def _leaning(own: DataFrame, keys: list[str], parent: DataFrame, shared: list[str]) -> DataFrame:
    """own and parent: keys, rule, bucket, n -> own merged with the sketch of its parent, scaled to PRIOR documents."""
    names = {c: f"__{c}" for c in shared}
    scaled = parent.withColumn("n", PRIOR * F.col("n") / F.sum("n").over(Window.partitionBy(*shared, "rule"))).withColumnsRenamed(names | {"rule": "__rule"})
    on = F.col("rule") == F.col("__rule")
    for c in shared:
        on = on & F.col(c).eqNullSafe(F.col(names[c]))
    lent = own.select(*keys, "rule").distinct().join(scaled, on).select(*keys, "rule", "bucket", "n")
    return own.select(*keys, "rule", "bucket", F.col("n").cast("double").alias("n")).unionByName(lent).groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], **at: float) -> DataFrame:
    """keys, rule, and a column for each wanted quantile: the end of the bucket that holds it."""
    group = Window.partitionBy(*keys, "rule")
    upto = F.sum("n").over(group.orderBy("bucket")) / F.sum("n").over(group) + 1e-9
    value = F.when(F.col("bucket") == _ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), F.col("bucket")))
    rows = sketch.withColumn("upto", upto).withColumn("value", value)
    return rows.groupBy(*keys, "rule").agg(*[F.min(F.when(F.col("upto") >= q, F.col("value"))).alias(name) for name, q in at.items()])


def cutoffs(sketch: DataFrame) -> DataFrame:
    """lang, source, then low_ and high_ of each rule, from the group's sketch leaning on its language's, and that one on
    the sketch of all documents. A ratio of LEAST or less is no more than zero to a sketch, so that much is added."""
    everything = sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    languages = _leaning(sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n")), ["lang"], everything, [])
    groups = _leaning(sketch, ["lang", "source"], languages, ["lang"])
    q = quantiles(groups, ["lang", "source"], lower=1 - UPPER, middle=0.5, upper=UPPER)
    high = F.col("upper") + DISTANCES * (F.col("upper") - F.col("middle")) + LEAST
    low = (F.col("lower") - DISTANCES * (F.col("middle") - F.col("lower"))) / GROWTH - LEAST
    q = q.select("lang", "source", "rule", low.alias("low"), high.alias("high"))
    return q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r.name, F.col(c))).alias(f"{c}_{r.name}") for r in RULES for c in ("low", "high")])


def judged(rows: DataFrame, cuts: DataFrame, column: str = "__q") -> DataFrame:
    """rows with a column __kept. A count of k is off by the root of k: a document is beyond a cut-off only if its ratio
    is so with ERRORS times that given."""
    cuts = cuts.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    # A row for each language and source: broadcast if there are few, by count; else joined by key, hot ones split by AQE.
    cuts = stored(cuts, "quality-cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= MOST_GROUPS else cuts
    joined = rows.join(cuts, rows["lang"].eqNullSafe(cuts["__lang"]) & rows["source"].eqNullSafe(cuts["__source"]), "left")
    q = F.col(column)
    bad = F.lit(False)
    for r in RULES:
        error = ERRORS * F.sqrt(r.counted(q)) / r.whole(q)
        bad = bad | (r.ratio(q) - error > F.col(f"high_{r.name}"))
        if r.both:
            bad = bad | (r.ratio(q) + error < F.col(f"low_{r.name}"))
    return joined.withColumn("__kept", ~q["base_failed"] & ~F.coalesce(bad, F.lit(False))).drop("__lang", "__source", *[f"{c}_{r.name}" for r in RULES for c in ("low", "high")])


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs (doc_id, text, lang, source; others play no part).

    A null text has no words and fails the base rule, as an empty one does. Null languages and sources are groups of
    their own. Equal rows get equal verdicts; an empty table gives an empty result. Texts are read whole.
    """
    rows = stored(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    cuts = cutoffs(sketches(rows))
    keep = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(rows, cuts).select("doc_id", *[F.col("__q")[c].alias(c) for c in keep], F.col("__kept").alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, all columns as they were."""
    rows = stored(measured(docs), "quality")
    return judged(rows, cutoffs(sketches(rows))).filter("__kept").select(*docs.columns)
