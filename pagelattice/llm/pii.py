"""Personal data: candidates, boosted trees, calibrated thresholds.

High-recall generators propose spans, which may overlap: the four base patterns, their near misses, other ways to write
the same things, and long runs of letters and digits. Base matches that pass their check are always spans. Boosted trees
score all others, from format and context alone: what the checks look at (a check digit, the size of a part, the "+" and
the country's code, the characters between parts) is masked, so that a written-out address looks like an address and a
number without a country's code like one with it. Trees learn which formats, in which surroundings, passed the checks
(secrets: stood behind a name such as token or password); all else that was proposed counts as a counter-example, so
that a format is taken only where the corpus's validated examples outnumber its look-alikes. Thresholds are calibrated
for each kind on held-out candidates.

Training needs no rows: features take a few values each, so that a table of distinct feature values with counts says all
that the rows would; one aggregate makes it, and trees are fitted to all of it on the driver, whatever the input's size.
The features' values bound it to 1.7 million rows of 27 bytes: for each fold 3,072 of addresses, 384 of IPs, 58,752 each
of cards and phones and 705,024 of secrets. Trees come back as CASE expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns, possessive and tied to the start of a run so that no text makes them quadratic; they match what the
#: plain patterns match. Fixed values.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What the base patterns leave out: written-out addresses, other separators, numbers without a country's code, secrets.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[](?:dot|DOT)[)\]] ?|\.)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{3,4}){1,2}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,200}+[0-9])(?=[0-9_+/-]{0,200}+[A-Za-z])[A-Za-z0-9_+/-]{20,}+",
}
#: Near misses, which are never spans: an address without a domain.
MISS = {"email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?!\.?[A-Za-z0-9-]|@)"}
#: A text without any of these has no candidate.
TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
TRIGGER_MORE = {"email": r"[(\[](?:at|AT)[)\]]", "ip": r"\[\.\][0-9]", "card": r"[0-9][._/][0-9]{4}", "phone": r"[0-9]{2}[) .-]{1,2}[0-9]{3}", "secret": r"[A-Za-z0-9_+/-]{20}"}
_NEAR = r"(?i)(?:mail|phone|tel|call|mobile|fax|card|visa|ip|host|server|address|contact)[^A-Za-z0-9]{0,4}$"
_NOT = r"(?i)(?:version|id|no|number|order|invoice|isbn|sku|hash|page|commit|digest)[^A-Za-z0-9]{0,4}$"
#: What a secret is called where it is written down.
_NAMED = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|bearer|credential)[\"']?\s{0,2}[:= ]\s{0,2}[\"']?$"
#: Feature -> the largest value that it takes. parts: runs of letters and digits; long and short: the lengths of the
#: longest and the shortest; form: how letters and digits mix; distinct: different characters, in steps of three.
FEATURES = {"kind": 4, "parts": 7, "long": 16, "short": 16, "form": 5, "distinct": 7, "near": 2, "before": 3, "after": 3, "top": 8}


_PLACED = "array<struct<start:int,piece:string,pre:string,post:string>>"


def _places(text: Column, rx: str, run: int = 128) -> Column:
    """Matches in order: start, piece, what stands before and after. Matches and the gaps between them add up to the text;
    sums are taken over runs of matches and over the runs, so that no text with many matches takes their square."""
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def walk(m: Column) -> Column:
        def summed(g: Column) -> Column:
            steps = F.transform(m, lambda x, k: F.length(F.get(g, k)) + F.length(x))

            def placed(both: Column) -> Column:
                n, runs = both["n"], both["runs"]
                start = lambda k: total(F.slice(runs, 1, F.floor(k / run).cast("int"))) + total(F.slice(n, (F.floor(k / run) * run + 1).cast("int"), k % run)) + F.length(F.get(g, k))
                return F.transform(m, lambda x, k: F.struct(start(k).cast("int").alias("start"), x.alias("piece"), F.right(F.get(g, k), F.lit(24)).alias("pre"), F.left(F.get(g, k + 1), F.lit(1)).alias("post")))

            in_runs = lambda n: F.struct(n.alias("n"), F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / run).cast("int")), lambda r: total(F.slice(n, r * run + 1, F.lit(run)))).alias("runs"))
            return let(let(steps, in_runs), placed)

        return F.when(F.size(m) == 0, F.array().cast(_PLACED)).otherwise(let(F.split(text, rx, -1), summed))

    return let(found, walk)


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a run of up to 19 digits passes Luhn's check."""
    from_right = F.reverse(F.split(F.left(digits, F.lit(19)), ""))
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(F.filter(from_right, lambda d: d != ""), value), F.lit(0), lambda a, b: a + b)
    return (total % 10 == 0) & (digits != "")


def _passes(kind: str, piece: Column) -> Column:
    """The base check of a match of its kind's base pattern."""
    d = _digits(piece)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(piece, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(d).between(14, 19) & _luhn(d)
    return F.length(d).between(10, 15)


def _class(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z]$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^[^ \t-\r]$"), 3).otherwise(0)


def _masked(kind: str, piece: Column) -> Column:
    """A match without what its kind's check looks at: one mark between parts, an address as it is written with signs, a
    number without the country's code, which is up to three digits behind a plus."""
    if kind == "email":
        piece = F.regexp_replace(F.regexp_replace(piece, r" ?[(\[](?:at|AT)[)\]] ?", "@"), r" ?[(\[](?:dot|DOT)[)\]] ?", ".")
    if kind == "phone":
        piece = F.regexp_replace(piece, r"^\+[0-9]{1,3}(?=[ (.-])|^\+", "")
    return piece if kind in ("email", "secret") else F.trim(F.regexp_replace(piece, "[^0-9]+", " "))


def _candidate(kind: str, base: bool, miss: bool = False):
    def made(x: Column) -> Column:
        piece, pre, post = x["piece"], x["pre"], x["post"]
        plain = _masked(kind, piece)
        domain = F.split(F.substring_index(plain, "@", -1), r"\.")
        last = F.element_at(domain, -1)
        parts = F.filter(F.split(domain[0] if kind == "email" else plain, "[^A-Za-z0-9]+"), lambda p: p != "")
        lengths = F.transform(parts, lambda p: F.length(p))
        top = F.when((F.size(domain) > 1) & last.rlike("^[A-Za-z]{2,}$"), F.least(F.length(last), F.lit(8))).otherwise(0)
        form = F.when(~plain.rlike("[A-Za-z]"), 0).when(~plain.rlike("[0-9]"), 1).when(plain.rlike("^[0-9a-f]+$"), 2).when(~plain.rlike("[A-Z]"), 3).when(plain.rlike("[a-z]"), 4).otherwise(5)
        values = {
            "kind": F.lit(KINDS.index(kind)),
            "parts": F.least(F.size(domain) if kind == "email" else F.size(parts), F.lit(7)),
            "long": F.least(F.coalesce(F.array_max(lengths), F.lit(0)), F.lit(16)) if kind not in ("email", "ip") else F.lit(0),
            "short": F.least(F.coalesce(F.array_min(lengths), F.lit(0)), F.lit(16)) if kind not in ("email", "ip") else F.lit(0),
            "form": form if kind == "secret" else F.lit(0),
            "distinct": F.least(F.floor(F.size(F.array_distinct(F.split(plain, ""))) / 3), F.lit(7)) if kind == "secret" else F.lit(0),
            "near": F.when(pre.rlike(_NEAR), 1).when(pre.rlike(_NOT), 2).otherwise(0),
            "before": _class(F.right(pre, F.lit(1))),
            "after": _class(post),
            "top": top if kind == "email" else F.lit(0),
        }
        ok = _passes(kind, piece) if base and not miss else F.lit(False)
        # An address with a bad top-level label is a base span all the same, but no example to learn from.
        example = ok & (top > 0) if kind == "email" else pre.rlike(_NAMED) if kind == "secret" else ok
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.length(piece)).alias("end"), ok.alias("ok"), F.lit(miss).alias("miss"), example.alias("example"), F.struct(*[v.cast("int").alias(k) for k, v in values.items()]).alias("f"))

    return made


_TYPE = "array<struct<start:int,kind:int,end:int,ok:boolean,miss:boolean,example:boolean,f:struct<" + ",".join(f"{k}:int" for k in FEATURES) + ">>>"


def candidates(text: Column) -> Column:
    """All candidate spans of a text, which may overlap; null has none. Offsets count code points."""
    text = F.coalesce(text, F.lit(""))
    lists = []
    for rx, triggers, base in ((BASE, TRIGGER, True), (MORE, TRIGGER_MORE, False), (MISS, TRIGGER, True)):
        for kind in rx:
            found = F.transform(_places(text, rx[kind]), _candidate(kind, base, rx is MISS)).cast(_TYPE)
            lists.append(F.when(text.rlike(triggers[kind]), found).otherwise(F.array().cast(_TYPE)))
    return F.concat(*lists)


@dataclass
class Tree:
    """A leaf's value, or a feature, the last value that goes left, and two trees."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    sides: list[Tree] = field(default_factory=list)

    def column(self, f: Column) -> Column:
        return F.lit(self.value) if not self.sides else F.when(f[self.feature] <= self.at, self.sides[0].column(f)).otherwise(self.sides[1].column(f))

    def score(self, x: dict) -> np.ndarray | float:
        """x: a value of each feature, or an array of them."""
        return self.value if not self.sides else np.where(x[self.feature] <= self.at, self.sides[0].score(x), self.sides[1].score(x))


@dataclass
class Model:
    trees: list[Tree]
    thresholds: dict[int, float]
    bias: float = 0.0

    def probability(self, f: Column) -> Column:
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [t.column(f) for t in self.trees], F.lit(self.bias))))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Tree:
    """x: for each feature its values; g, h: sums of gradients and hessians. The split of the greatest gain, by values'
    running sums. Steps are bounded by 4, as in LogitBoost: where sure scores are wrong, h is near 0, and a step would be as
    large as the counts."""
    all_g, all_h = g.sum(), h.sum()
    best = (1e-6, -1, 0)
    for k in range(len(x) if depth else 0):
        a, b = np.bincount(x[k], g).cumsum()[:-1], np.bincount(x[k], h).cumsum()[:-1]
        if len(a):
            gain = a * a / (b + 1) + (all_g - a) ** 2 / (all_h - b + 1) - all_g * all_g / (all_h + 1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), k, at)
    if best[1] < 0:
        return Tree(float(rate * np.clip(all_g / (all_h + 1), -4, 4)))
    _, k, at = best
    left = x[k] <= at
    return Tree(0.0, list(FEATURES)[k], at, [_grow(x[:, side], g[side], h[side], depth - 1, rate) for side in (left, ~left)])


def fit(table: list[tuple[dict, int, float, float]], **how: float) -> Model:
    """table: features, fold (0 or 1), examples, counter-examples; how and what comes out: see fitted."""
    x = np.array([[r[0][k] for k in FEATURES] for r in table], np.int64).reshape(-1, len(FEATURES)).T
    return fitted(x, *(np.array([r[k] for r in table], np.float64) for k in (1, 2, 3)), **how)


def fitted(x: np.ndarray, fold: np.ndarray, p: np.ndarray, n: np.ndarray, n_trees: int = 20, depth: int = 4, rate: float = 0.4, precision: float = 0.98) -> Model:
    """x: for each feature its values; fold (0 or 1), p examples and n counter-examples of the same rows. Trees are fitted to
    fold 0; fold 1 gives each kind the least score at which the share of examples among all that score as much is at least
    `precision`. A kind without held-out examples takes no candidates, and none does if there is nothing to fit to."""
    values, fits = dict(zip(FEATURES, x, strict=True)), fold == 0
    own, yes, no = x[:, fits], p[fits], n[fits]
    bias = math.log((yes.sum() + 1) / (no.sum() + 1))
    scores, trees = np.full(len(fold), bias), []
    for _ in range(n_trees if yes.any() and no.any() else 0):
        q = 1 / (1 + np.exp(-scores[fits]))
        trees.append(_grow(own, yes * (1 - q) - no * q, (yes + no) * q * (1 - q), depth, rate))
        scores = scores + trees[-1].score(values)
    thresholds = {}
    for kind in range(len(KINDS)):
        held = np.flatnonzero((fold == 1) & (values["kind"] == kind))
        held = held[np.argsort(-scores[held], kind="stable")]
        s, yes, no = 1 / (1 + np.exp(-scores[held])), p[held].cumsum(), n[held].cumsum()
        last = np.append(s[1:] < s[:-1], True)[: len(s)]  # of those that score the same
        good = s[last & (yes > 0) & (yes / np.maximum(yes + no, 1) >= precision)]
        thresholds[kind] = max(float(good[-1]) - 1e-9, 0.5) if trees and len(good) else 2.0
    return Model(trees, thresholds, bias)


def train(spans: DataFrame) -> Model:
    """Fit to the candidates in spans (doc_id, and a column c of candidates): base matches that pass their check and secrets by name
    are examples, all others counter-examples. Features are counted by one aggregate, which comes to the driver as arrays."""
    one = spans.select("c", F.pmod(F.xxhash64("doc_id", "c"), F.lit(2)).alias("fold")).select(F.explode("c").alias("c"), "fold")
    counted = one.groupBy(F.col("c.f").alias("f"), "fold").agg(F.sum(F.col("c.example").cast("long")).alias("p"), F.sum((~F.col("c.example")).cast("long")).alias("n"))
    rows = counted.select(*[F.col(f"f.{k}").cast("tinyint").alias(k) for k in FEATURES], F.col("fold").cast("tinyint").alias("fold"), "p", "n").toArrow()
    x, fold = np.stack([rows[k].to_numpy() for k in FEATURES]), rows["fold"].to_numpy()
    order = np.lexsort([fold, *x])
    return fitted(x[:, order], fold[order], *(rows[k].to_numpy()[order].astype(np.float64) for k in ("p", "n")))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans for every row of docs (doc_id, text; others
    play no part).

    Null and empty texts have no span. Equal rows get equal results; an empty table gives none. Counts and base_sha256
    are of the base spans alone; spans and n_spans hold those that the trees add too, without repeats.
    """
    rows = stored(docs.select("doc_id", candidates(F.col("text")).alias("c")), "pii")
    model = train(rows)
    c = F.col("c")
    base = F.filter(c, lambda x: x["ok"])
    limit = lambda x: reduce(lambda a, k: F.when(x["kind"] == k, F.lit(model.thresholds[k])).otherwise(a), range(len(KINDS)), F.lit(2.0))
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    plain = lambda spans: F.array_distinct(F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter(F.col("base"), lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    every = F.filter(c, lambda x: x["ok"] | (~x["miss"] & (model.probability(x["f"]) >= limit(x)))) if model.trees else base
    rows = rows.select("doc_id", plain(base).alias("base"), plain(every).alias("every"))
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))
