"""The pipeline's near-duplicates against the Jaccard similarity of all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from brute import component_of, lower

from trailweave.llm import near_copies


def groups(docs, least=0.8):
    words = {d: lower(t or "").split() for d, t in docs}
    sets = {d: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for d, w in words.items()}
    alike = lambda a, b: a == b or len(a & b) >= least * len(a | b)
    return component_of(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])])


def edited(r, words, n):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_edited_copies(spark):
    r = random.Random(3)
    docs = [(0, None), (1, ""), (2, " "), (3, "one two"), (4, "One  two")]
    for g in range(12):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(40, 400))]
        docs += [(100 * (g + 1) + k, edited(r, words, k * len(words) // 100)) for k in range(6)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    of = groups(docs)
    got = {x.doc_id: (x.component_id, x.kept) for x in near_copies.near_copies(table).collect()}
    assert got == {d: (c, c == d) for d, c in of.items()}
    assert {x.doc_id for x in near_copies.deduplicated(table).collect()} == {d for d, c in of.items() if c == d}


def test_stage_drops_near_copies_of_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = groups([(x.doc_id, x.text) for x in docs.collect()])
    assert {x.doc_id for x in corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()} == {d for d, c in of.items() if c == d}


def test_null_ids_repeats_and_empty(spark):
    table = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (8, "A b  c"), (None, "z")], "doc_id bigint, text string")
    assert sorted((repr(x.doc_id), x.text) for x in near_copies.deduplicated(table).collect()) == [("7", "a b c"), ("None", "a b c"), ("None", "z")]
    assert near_copies.deduplicated(table.where("false")).count() == 0


def test_large_group_makes_few_pairs(spark, monkeypatch):
    """Copies of one text, each edited for itself to about 0.7 of the text, are compared by what they differ in."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    docs = [(k, edited(r, base, r.choice((1, 2, 5, 6, 7, 9, 12)))) for k in range(150)]
    docs += [(1000 + k, docs[k][1] + " tail") for k in range(0, 150, 3)] + [(2000, " ".join(base))]
    made, alike = [], near_copies._alike

    def counted(pairs, *rest):
        made.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(near_copies, "_alike", counted)
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(table).collect()}
    assert got == groups(docs) and len(set(got.values())) > 10
    assert sum(made) < 20 * len(docs)


def test_stage_links_by_simhash(spark, sf_dir, monkeypatch):
    """Fingerprints and their multi-index hashing link near copies in the stage, without any band."""
    hashed = near_copies._hashed
    monkeypatch.setattr(near_copies, "_hashed", lambda docs: hashed(docs).withColumn("bands", near_copies.F.array().cast("array<bigint>")))
    words = [f"w{k}" for k in range(2000)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "a b c d e f g")], "doc_id bigint, text string")
    assert {x.doc_id for x in corpus_pipeline.dedup_stage(spark, table, sf_dir).collect()} == {1, 3}
