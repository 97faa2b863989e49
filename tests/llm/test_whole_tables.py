"""Each query over whole driver tables against the plain answer."""

import base64
import hashlib

import numpy as np
import pytest
from brute import base_spans, contamination, embeddings, sha, simhash, substring

from trailweave.llm import queries


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_pii(spark, sf_dir, docs):
    rows = queries.op1_pii(spark, sf_dir).collect()
    want = {d: base_spans(t) for d, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        spans = want[r.doc_id]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        every = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        assert [s for s in every if s[0] != "term"] == [[k, str(a), str(b)] for k, a, b in spans]
        assert [int(s[1]) for s in every] == sorted(int(s[1]) for s in every)


def test_decontamination(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.op2_decontamination(spark, sf_dir), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(contamination(docs, items))


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op3_embedding_dedup(spark, sf_dir), "vec_id", "n_links", "component_id", "kept") == sorted(embeddings(rows))


def test_substring(spark, sf_dir, docs):
    assert got(queries.op4_substring_dedup(spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(substring(docs))


def test_simhash(spark, sf_dir, docs):
    assert got(queries.op5_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id", "kept") == sorted(simhash(docs))


def test_bpe(spark, sf_dir, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {d: own.encode_ordinary(t or "") for d, t in docs}
    want = [(d, len(ids[d]), hashlib.sha256(np.array(ids[d], "<u4").tobytes()).hexdigest(), sha(t or "")) for d, t in docs]
    assert got(queries.op7_bpe(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_html(spark, sf_dir):
    """The article's blocks, cut out by the marks that these pages happen to have."""
    import html
    import re

    for r in queries.op6_html_extraction(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b), r.page_id
        assert r.n_chars == len(r.text)


def test_quality(spark, sf_dir):
    from trailweave.llm.quality import crc_fold

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, sf_dir).collect()
    assert all(r.held_out == (crc_fold(r.doc_id) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.9


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        columns = sorted(df.columns)
        same = lambda rows: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in rows)
        key = lambda rows: sorted(map(repr, rows))
        assert key(same_rows(df.select(*columns).collect())) == key(same_rows(con.execute(f"select {', '.join(columns)} from ({sql})").fetchall())), name
        assert same


def same_rows(rows):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
