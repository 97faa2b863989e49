"""Which terms disclose an entity, and where they are marked."""

from trailweave.llm import pii


def filler(n):
    return "".join(chr(97 + int(c)) for c in str(n)) + "y"


def terms(spark, rows):
    out = pii.protected_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    text = dict(rows)
    return {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r._spans if s.kind == "term"] for r in out}


def test_copies_count_on_both_sides(spark):
    rows = [(40 * t + c, f"{filler(t)} zorblax wrote from boss@corp.example.org {filler(t + 9)} today") for t in range(3) for c in range(40)]
    rows += [(1000 + k, f"{filler(k)} wrote {filler(k + 1)} today") for k in range(1000)]
    got = terms(spark, rows)
    assert all("zorblax" in got[k] and not {"wrote", "today"} & set(got[k]) for k in range(120))
    assert not any(got[1000 + k] for k in range(1000))


def test_entities_of_one_document_have_terms(spark):
    rows = [(1, "the chief zorblax wrote from boss@corp.example.org today")]
    rows += [(1000 + k, f"the {filler(k)} chief wrote from {filler(k + 1)} today") for k in range(200)]
    got = terms(spark, rows)
    assert got[1] == ["zorblax"] and not any(got[1000 + k] for k in range(200))


def test_terms_far_from_the_mention(spark):
    far = " ".join(filler(k % 150) for k in range(300))
    rows = [(1, f"Zorblax began. {far} boss@corp.example.org {far} then zorblax ended"), (2, f"a x@y.example z@y.example b@y.example qux {far}")]
    rows += [(1000 + k, f"{filler(k)} wrote then {filler(k + 1)} began") for k in range(200)]
    got = terms(spark, rows)
    assert got[1] == ["Zorblax", "zorblax", "ended"] and got[2] == ["qux"] and not any(got[1000 + k] for k in range(200))


def test_eight_copies_give_the_terms_of_one(spark):
    rows = [(k, f"{filler(k)} chief zorblax wrote {filler(k + 20)} from boss@corp.example.org to the {filler(k + 40)} team") for k in range(12)]
    rows += [(100 + k, f"the {filler(k)} team wrote to the {filler(k + 7)} from {filler(k + 9)}") for k in range(150)]
    once = terms(spark, rows)
    many = terms(spark, [(1000 * c + d, t) for c in range(8) for d, t in rows])
    assert {"chief", "zorblax"} <= set(once[3]) and all(many[1000 * c + d] == own for c in range(8) for d, own in once.items())


def test_terms_of_an_entity_that_stands_elsewhere(spark):
    """Marked where the evidence is strong: 12 of 13 documents with the word hold the address."""
    rows = [(k, f"{filler(k)} chief zorblax wrote {filler(k + 20)} from boss@corp.example.org") for k in range(12)]
    rows += [(50, "at noon Zorblax left"), (51, "at noon Zorblax left"), (52, None)] + [(100 + k, f"the {filler(k)} wrote {filler(k + 20)} noon left at") for k in range(1500)]
    got = terms(spark, [r for r in rows if r[0] != 51])
    assert got[50] == ["Zorblax"] and not any(got[100 + k] for k in range(1500)) and got[52] == []
    assert terms(spark, rows)[51] == ["Zorblax"]


def test_added_spans_of_whole_documents(spark):
    from brute import term_spans

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = docs[:400] + docs[:30] + [(None, None), (7, ""), (7, "x")]
    got = sorted(((repr(r.doc_id), r.text or "", [(s.start, s.end) for s in r._spans if s.kind == "term"]) for r in pii.protected_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == sorted((repr(d), t or "", s) for (d, t), s in zip(rows, term_spans(rows), strict=True))
    assert any(s for _, _, s in got)


def test_any_column_name(spark):
    names = ["_row", "_h", "_maybe", "_word", "_bits", "key", "h", "doc", "body", "email", "base", "spans", "clean", "copies"]
    table = spark.createDataFrame([(1, "a zorblax x@y.example", *range(len(names))), (2, "plain", *range(len(names)))], f"doc_id bigint, text string, {', '.join(f'{n} int' for n in names)}")
    for out in (pii.base_spans(table), pii.protected_spans(table), pii.sanitised(table)):
        assert out.columns[:2 + len(names)] == table.columns and all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
    twice = pii.protected_spans(table.withColumn("_base", table.key).withColumn("_spans", table.key))
    assert twice.columns == [*table.columns, "_base", "_spans"] and twice.count() == 2
