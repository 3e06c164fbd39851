"""What a catalogue run leaves behind: nodes, flat rows, chunks, and the chunks as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, path: str) -> None:
    """Nodes as JSON, a folder for each catalogue. Edges aren't made here; readers find none."""
    nodes.write.mode("overwrite").partitionBy("catalog").json(path)


def write_rows(rows: DataFrame, path: str, form: str = "json") -> None:
    rows.write.mode("overwrite").format(form).save(path)


def chunk_lines(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks (doc, page, chunk, section, text) -> doc and its text: a remark where the page changes, sections as headings."""
    order = Window.partitionBy(doc).orderBy("page", "chunk")
    turn = F.lag("page").over(order).eqNullSafe(F.col("page"))
    block = F.concat(F.when(~turn, F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"))).otherwise(""), F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("text"))
    rows = chunks.withColumn("block", block)
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "chunk", "block"))), lambda s: s["block"]), "\n\n").alias("value"))


def write_markdown(chunks: DataFrame, path: str, doc: str = "doc_id") -> None:
    chunk_lines(chunks, doc).select(F.col(doc), "value").write.mode("overwrite").partitionBy(doc).text(path)
