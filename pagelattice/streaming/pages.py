"""Pages as a stream: each page arrives whole, layers one and two need no state, merging over pages keeps the last three."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assemble import LEAST_MAPPED, fingerprint
from ..operators.field import bonds, fact_rows
from ..operators.sense import sensed


def page_facts(pages: DataFrame) -> DataFrame:
    """A stream (or table) of pages (page_key, ps) -> facts, page by page, without an exchange."""
    return fact_rows(bonds(sensed(pages)))


def continued(pages: DataFrame, least: int = LEAST_MAPPED) -> DataFrame:
    """A stream of pages (page_key, doc_id, page, ps) -> doc_id, page, base: the page whose table each goes on with.

    As in the merging of whole documents, a page of data looks back over the last three such pages, no more than three
    numbers away, for the nearest one with a compatible fingerprint; these three are all the state that a document has.
    Other pages are their own base. Pages of a document must arrive in order over triggers, in any order within one."""
    places = pages.select("page_key", F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "ps")
    spots = sensed(places.select(F.struct("page_key", "doc_id", "page").alias("page_key"), "ps"))
    bound = bonds(spots).select("page_key.*", fingerprint(F.col("headings")).alias("fp"), F.size(F.filter("nums", lambda n: n["spec"].isNotNull())).alias("mapped"))
    marked = bound.select("doc_id", "page", "fp.col_type", F.when(F.col("mapped") >= least, F.col("fp.labels")).alias("labels"))

    def follow(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        rows = sorted((r for pdf in batches for r in zip(pdf["page"], pdf["col_type"], pdf["labels"], strict=True)), key=lambda r: r[0])
        out = []
        for page, kind, labels in rows:
            base = page
            if labels is not None:
                near = [b for was, k, names, b in reversed(held) if page - was <= 3 and k == kind and set(names) & set(labels)]
                base = near[0] if near else page
                held = [*held, (int(page), kind, list(labels), int(base))][-3:]
            out.append((key[0], int(page), int(base)))
        state.update(tuple(map(list, zip(*held, strict=True))) if held else ([], [], [], []))
        yield pd.DataFrame(out, columns=["doc_id", "page", "base"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return marked.groupBy("doc_id").applyInPandasWithState(follow, "doc_id string, page int, base int", "pages array<int>, kinds array<string>, labels array<array<string>>, bases array<int>", "append", GroupStateTimeout.NoTimeout)
