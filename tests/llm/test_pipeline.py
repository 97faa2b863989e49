"""Every stage on what the one before kept, against plain answers."""

import corpus_pipeline
import pytest
from brute import base_spans, contamination, term_spans
from test_near_copies import groups

import __spark_entry__ as entry


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
        if k < 4:
            assert docs.columns == columns
    raw = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good, single, clean, private, tokens = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert all(raw[d] == r for d, r in good.items())
    judged = [(d in good) == (q == 1) for d, q in labels.items()]
    assert sum(judged) / len(judged) > 0.95
    assert set(single) == {d for d, c in groups([(d, r.text) for d, r in good.items()]).items() if c == d} and all(good[d] == r for d, r in single.items())
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(clean) == {x[0] for x in contamination([(d, r.text) for d, r in single.items()], items) if not x[5]} and all(single[d] == r for d, r in clean.items())
    assert set(private) == set(clean)
    rows = sorted((d, r.text) for d, r in clean.items())
    spans = {d: sorted([*((a, b, kind) for kind, a, b in base_spans(t)), *((a, b, "term") for a, b in own)]) for (d, t), own in zip(rows, term_spans(rows), strict=True)}
    for d, text in rows:
        masked, at = [], 0
        for a, b, kind in spans[d]:
            if a >= at:
                masked += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert private[d].text == (text if text is None else "".join([*masked, text[at:]])), d
    for d, r in private.items():
        assert not base_spans(r.text)
        if not spans[d]:
            assert r == clean[d]
    import public_tokenizers as P

    from trailweave.llm import bpe

    coder = bpe.Bpe(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    assert set(tokens) == set(private) and all(coder.decode(r.token_ids) == private[d].text.encode() for d, r in tokens.items())


def test_registered():
    assert "pipeline" in entry.queries() and len([n for n in entry.queries() if n.startswith("op")]) == 10
    assert corpus_pipeline.ORACLE_SQL is None or "pipeline" in entry.oracle_sql()


@pytest.mark.parametrize("name", ["documents", "labels", "benchmark"])
def test_stages_on_empty_tables(spark, sf_dir, tmp_path, name):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (df.where("false") if t == name else df.limit(40)).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert docs.count() <= 40


def test_repeated_and_null_ids(spark, sf_dir, tmp_path):
    """Different texts of one id and rows without an id stay; equal rows are one."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) between 300 and 3000").orderBy("doc_id").limit(12)
    a, b = own.where("doc_id % 2 = 0").withColumn("doc_id", own.doc_id * 0 + 1), own.where("doc_id % 2 = 1").withColumn("doc_id", own.doc_id * 0).replace(0, None, ["doc_id"])
    docs = a.unionByName(a).unionByName(b).unionByName(own.withColumn("text", own.text.substr(1, 0)).limit(1).replace("", None, ["text"]))
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()
    out = spark.createDataFrame(kept, docs.schema)
    single = corpus_pipeline.dedup_stage(spark, out, str(tmp_path)).collect()
    key = lambda rows: sorted((repr(r.doc_id), repr(r.text)) for r in rows)
    with_id = {(r.doc_id, r.text) for r in kept if r.doc_id is not None}
    of = groups(list(enumerate(t for _, t in sorted(with_id, key=repr))))
    assert len([r for r in single if r.doc_id is not None]) == len(set(of.values())) and {k for k in key(single)} <= {k for k in key(kept)}
    assert key(r for r in single if r.doc_id is None) == key(r for r in kept if r.doc_id is None)
    rows = spark.createDataFrame(single, docs.schema)
    for _, stage in corpus_pipeline.STAGES[2:]:
        after = stage(spark, rows, str(tmp_path)).collect()
        assert len(after) <= len(single) and {"doc_id", "text"} <= set(after[0].asDict())
