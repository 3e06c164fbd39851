"""The pipeline, stage by stage, against plain Python on each stage's own input."""

from collections import Counter

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from pagelattice.llm import quality_rules
from pagelattice.llm.queries import queries, tokenizer_path


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    ids = lambda d: Counter(r.doc_id for r in d.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
        if k == 0:
            want = {r.doc_id for r in quality_rules.verdicts(docs).collect() if r.kept}
            assert ids(out) == Counter(want)
        elif k == 1:
            found = brute.linked([(d, r.text) for d, r in before.items()])
            assert ids(out) == Counter({d for d, (n, c) in found.items() if c == d or not n})
        elif k == 2:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            bad = brute.contamination([(d, r.text) for d, r in before.items()], items)
            assert ids(out) == Counter({d for d in before if not bad[d][4]})
        elif k == 3:
            size = {d: len(brute.WORD.findall(r.text or "")) for d, r in before.items()}
            times = ids(out)
            assert set(times) <= set(before) and max(times.values()) <= 3
            sources = Counter()
            for d, r in before.items():
                sources[r.source] += size[d]
            want = sum(brute.targets(dict(sources)).values())
            assert abs(sum(size[d] * n for d, n in times.items()) / want - 1) < 0.1
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_path())
            n = {d: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in before.items()}
            rows = out.orderBy("start").collect()
            assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))] and all(r.n_tokens == n[r.doc_id] for r in rows)
            assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == docs.count()
        docs = out


def test_run_is_registered_and_repeats(spark, small):
    a, b = (queries()["pipeline"](spark, small) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_run_on_nothing(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.filter(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_odd_rows(spark, odd, small, tmp_path):
    """Nulls, repeats, long and empty texts and clashing columns through all stages: columns are handed on, and the stages
    keep what their docstrings say."""
    rows = odd.unionByName(odd.limit(4))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{k}"))
        kept.append(docs.count())
        assert k == 4 or docs.columns == odd.columns
    assert kept[0] <= rows.count() and kept[1] <= kept[0] and kept[2] <= kept[1] and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4]
