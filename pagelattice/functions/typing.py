"""A word's type, magnitude, brand and node type, told from its text alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V
from .expr import let, stripped


def _any(text: Column, patterns: Iterable[str], flags: str = "(?U)") -> Column:
    """Whether any of the patterns, all of them anchored, is found: one alternation, compiled once."""
    patterns = tuple(patterns)
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def patterns_of(brand: str | None = None) -> dict[str, tuple[str, ...]]:
    """The patterns of a brand, or of all brands together. An unknown brand is an error."""
    if brand is not None and brand not in V.BRANDS:
        raise ValueError(f"unknown brand: {brand}; there are {', '.join(V.BRANDS)}")
    chosen = [V.BRANDS[brand]] if brand else list(V.BRANDS.values())
    return {k: tuple(p for b in chosen for p in b[k]) for k in ("model", "model_any_case", "size", "size_any_case")}


def matches(text: Column, patterns: dict[str, tuple[str, ...]], kind: str) -> Column:
    return _any(text, patterns[kind]) | _any(text, patterns[f"{kind}_any_case"], "(?iU)")


def numeric_text(text: Column, lowered: Column) -> Column:
    """Numbers in their many forms: lists, ranges, dimensions, supplies, refrigerants."""
    dense = F.regexp_replace(lowered, r"(?U)\s", "")
    signs = dense.rlike(r"(?U)^[\d.,/\-()x×°%~+:]+$") & dense.rlike(r"(?U)\d")
    size = F.regexp_replace(text, ",", "").rlike(r"(?U)^[\d.]+x[\d.]+x[\d.]+$")
    return signs | size | _any(text, (r"^-?\d+~", r"^\d+N?~/", r"^R\d{3}"))


def type_of(text: Column, patterns: dict[str, tuple[str, ...]] | None = None, domain: bool = True) -> Column:
    """The type of a word, one of V.TYPES: the first rule that fits, from exclusions to vocabulary. Without `domain`
    only numbers, units and plain text are told apart. A null or blank word is TEXT.

    Digits with one point or comma inside, which no rule before that of numbers can fit, are told first; so are, without
    `domain`, words whose first letter no number begins with (R and X may begin one)."""

    def cascade(w: Column) -> Column:
        t, tl = w["t"], w["tl"]
        rule = F.when((t == "") | _any(t, V.EXCLUDED, "(?iuU)"), "TEXT")
        if domain:
            if patterns:
                rule = rule.when(matches(t, patterns, "size"), "SIZE_HEADER").when(matches(t, patterns, "model"), "MODEL")
            rule = rule.when(t.rlike(r"(?U)^\d+[.,]?\d*\s*kW$"), "KW_HEADER")
        rule = rule.when(stripped(tl).isin(*V.UNITS), "UNIT").when(t.rlike(r"(?U)^\(\d{1,2}\)$"), "TEXT").when(numeric_text(t, tl), "NUMERIC")
        if domain:
            words = F.split(tl, r"(?U)\s+")
            has = lambda terms: F.arrays_overlap(words, F.array(*[F.lit(x) for x in terms]))
            rule = rule.when(has(V.SECTION_WORDS) & (F.length(t) > 8), "SECTION").when(has(V.LABEL_WORDS), "SPEC_LABEL")
            rule = rule.when((F.length(t) > 12) & _any(tl, V.LABEL_PARTS, ""), "SPEC_LABEL")
        return rule.otherwise("TEXT")

    t = stripped(F.coalesce(text, F.lit("")))
    every = let(t, lambda t: let(F.struct(t.alias("t"), F.rtrim(F.lower(t), F.lit(".")).alias("tl")), cascade))
    rule = F.when(text.rlike(r"^[0-9]+(?:[.,][0-9]+)?\z"), "NUMERIC")
    if not domain:
        rule = rule.when(text.rlike("^[A-QS-WYZa-qs-wyz]"), F.when(stripped(F.rtrim(F.lower(t), F.lit("."))).isin(*V.UNITS), "UNIT").otherwise("TEXT"))
    return rule.otherwise(every)


def base_type_of(text: Column) -> Column:
    """The smaller cascade, with its own units: numbers, units, text."""
    t = stripped(F.coalesce(text, F.lit("")))
    tl = F.regexp_replace(F.lower(t), r"\.+$", "")
    dense = F.regexp_replace(tl, r"(?U)\s", "")
    number = dense.rlike(r"(?U)^[\d.,/\-()x×°%~+:]+$") & dense.rlike(r"(?U)\d")
    return F.when(tl.isin(*V.BASE_UNITS), "UNIT").when(number | t.rlike(r"(?U)^R\d{3}"), "NUMERIC").otherwise("TEXT")


def magnitude(text: Column) -> Column:
    """log10(|v| + 1) of the first number in a text, a comma being a decimal point; null without one."""
    first = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), " ", ""), r"(?U)[-+]?\d+[.,]?\d*", 0)
    v = F.abs(F.regexp_replace(first, ",", ".").try_cast("double"))
    return F.when(v < 0.001, 0.0).otherwise(F.log10(v + 1))


def brand_of(text: Column) -> Column:
    """The first brand with a pattern of models or sizes that fits; null without one."""
    t = stripped(text)
    return F.coalesce(*[F.when(matches(t, patterns_of(b), "model") | matches(t, patterns_of(b), "size"), b) for b in V.BRANDS])


def node_type_of(name: Column) -> Column:
    rule = F.when(F.lit(False), "")
    for pattern, kind in V.NODE_TYPES:
        rule = rule.when(name.rlike("(?U)" + pattern), kind)
    return rule.otherwise("product_unit")


def label_and_section(key: Column) -> Column:
    """'[Section] Label' as section and label; without brackets the section is empty."""
    rx = r"^\[([^\]]*)\]\s*(.*)"
    both = F.struct(stripped(F.regexp_extract(key, rx, 1)).alias("section"), stripped(F.regexp_extract(key, rx, 2)).alias("label"))
    return F.when(key.rlike(rx), both).otherwise(F.struct(F.lit("").alias("section"), stripped(key).alias("label")))


def normalised(text: Column) -> Column:
    """Lower case without signs other than points, for comparing field values."""
    return stripped(F.regexp_replace(F.lower(text), r"(?U)[^\w\s.]", ""))


def particles(words: DataFrame, patterns: dict[str, tuple[str, ...]] | None = None, domain: bool = False) -> DataFrame:
    """words (page_key, ord, text, x0, y0, x1, y1, size) -> particles: non-blank words, centres, types, 80 characters of text."""
    text = stripped(F.col("text"))
    rows = words.filter(text != "").withColumn("type", type_of(F.col("text"), patterns, domain))
    return rows.withColumns({"text": F.substring(text, 1, 80), "x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})
