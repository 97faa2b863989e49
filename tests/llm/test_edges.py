"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import base64
import random

import numpy as np
import pytest
from brute import base_spans, contamination, embeddings, sha, simhash, substring
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailweave.llm import bpe, chat, decontam, embedding_dedup, html_extract, pii, quality, simhash as sh, substring_dedup, urlfilter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row bigint, key string, fp bigint, items string, label string"
rng = random.Random(5)
WORDS = [f"w{k}" for k in range(400)]
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))
PASSAGE = " ".join(f"p{k}" for k in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, 0.5, 3, "k", 4, "i", "l") for d, t in rows], DOCS)


ROWS = [
    (1, None), (2, ""), (3, "  \t\n "), (4, LONG), (5, LONG), (6, f"{LONG} more"), (7, "one"), (8, "One two"), (9, PASSAGE), (10, f"before {PASSAGE} after"),
    (11, " ".join(["again"] * 90)), (12, "mail a@b.example.org, 10.0.0.1 and +49 (30) 123456789 or 4111 1111 1111 1111."), (13, "\u00e9\u00a0\u2003x \U0001f600 caf\u00e9@example.com \U0001f600 1.2.3.4"), (14, f"{PASSAGE} {PASSAGE}"),
]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_substring_edges(spark):
    got = rows_of(substring_dedup.without_repeats(frame(spark, ROWS)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(substring(ROWS), key=repr)


def test_substring_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, f"x {PASSAGE}"), (None, None), (2, "short"), (2, "other short")]
    got = rows_of(substring_dedup.without_repeats(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(substring(rows), key=repr)
    assert substring_dedup.without_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 13])
def test_substring_windows(spark, window):
    r = random.Random(window)
    rows = [(k, " ".join(r.choice("abcd") for _ in range(r.randrange(30)))) for k in range(25)]
    got = rows_of(substring_dedup.without_repeats(frame(spark, rows), window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(substring(rows, window), key=repr)


def test_simhash_edges(spark):
    got = rows_of(sh.near_duplicates(frame(spark, ROWS)), "doc_id", "fingerprint", "component_id", "kept")
    assert got == sorted(simhash(ROWS), key=repr)
    assert sh.near_duplicates(frame(spark, [])).count() == 0
    got = rows_of(sh.near_duplicates(frame(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "z")])), "doc_id", "component_id", "kept")
    assert got == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (None, None, False)], key=repr)


def test_simhash_links_within_three_bits(spark):
    base = 0x0123456789ABCDEF
    r = random.Random(1)
    fps = {base} | {base ^ sum(1 << b for b in r.sample(range(64), n)) for n in (1, 2, 3, 4, 5) for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(x) for x in sh.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_deduplicated_keeps_one_of_each_group(spark):
    docs = frame(spark, [*ROWS, (None, "no id"), (5, LONG)])
    out = sh.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    kept = {r.doc_id for r in sh.near_duplicates(docs.where("doc_id is not null")).where("kept").collect()}
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 1


def test_decontamination_edges(spark):
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "one"), (5, "ONE two"), (6, PASSAGE), (None, "x"), (7, " ".join(["again"] * 20))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    want = sorted(contamination(ROWS, [x for x in items if x[0] is not None]), key=repr)
    for block in (decontam.BLOCK_BYTES, 200):
        out = decontam.contamination(frame(spark, ROWS), table, block_bytes=block)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), decontam.item_digest(r["items"]), r.contaminated) for r in out.collect()), key=repr)
        assert got == want
        bad = {w[0] for w in want if w[5]}
        for mode in ("drop", "cut"):
            left = {r.doc_id: r.text for r in decontam.decontaminated(frame(spark, ROWS), table, mode=mode, block_bytes=block).collect()}
            assert set(left) == {d for d, _ in ROWS} - (bad if mode == "drop" else set())
            assert all(left[d] == t for d, t in ROWS if d not in bad)
        assert "p5" not in left[10] and left[10].startswith("before ")
    assert decontam.contamination(frame(spark, []), table).count() == 0
    none = decontam.contamination(frame(spark, ROWS), table.where("false"))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(ROWS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=6), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton(items, doc, window):
    docs, table = [(0, " ".join(doc))], [(k, " ".join(w)) for k, w in enumerate(items)]
    spans, found = decontam.Automaton(((str(k), [x.encode() for x in w]) for k, w in enumerate(items)), window).hits([x.encode() for x in doc])
    (_, n, hit, n_items, ids, _), = contamination(docs, table, window)
    assert (sum(b - a for a, b in spans), len(found), decontam.item_digest(found)) == (hit, n_items, ids)


def test_pii_edges(spark):
    rows = [*ROWS, (20, "a@b.c_d@e.f x@y"), (21, "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1"), (22, "4111-1111-1111-1111 " * 300), (23, "+1234567890123456 ++12 3456789 +1 2"), (24, None), (25, "4" * 5000), (26, "a." * 3000 + "@x")]
    out = pii.protected_spans(frame(spark, rows)).collect()
    want = {d: base_spans(t) for d, t in rows}
    assert len(out) == len(rows)
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r._base] == want[r.doc_id], r.doc_id
    assert pii.protected_spans(frame(spark, [])).count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1.@+-_ 4(5)\U0001f600\u00e9", max_size=60), min_size=1, max_size=40))
def test_pii_random(spark, texts):
    rows = list(enumerate(texts))
    for r in pii.base_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert [(pii.KINDS[s.order], s.start, s.end) for s in r._base] == base_spans(texts[r.doc_id])


def test_pii_disclosing_terms_and_masks(spark):
    filler = [f"f{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300)]
    rows = [(k, f"{filler[k]} the chief zorblax wrote {filler[k + 20]} from boss@corp.example.org to the {filler[k + 40]} team") for k in range(12)]
    rows += [(100 + k, f"the {filler[k]} team wrote to the {filler[k + 7]} from {filler[k + 9]}") for k in range(150)]
    out = {r.doc_id: r for r in pii.protected_spans(frame(spark, rows)).collect()}
    terms = {rows[k][1][s.start : s.end] for k in range(12) for s in out[k]._spans if s.kind == "term"}
    assert {"chief", "zorblax"} <= terms and not terms & {"the", "team", "wrote", "to", "from"}
    assert all(not out[100 + k]._spans for k in range(150))
    clean = {r.doc_id: r.text for r in pii.sanitised(frame(spark, [*rows, (500, None), (501, "")])).collect()}
    assert "[EMAIL]" in clean[3] and "[TERM]" in clean[3] and "boss" not in clean[3] and "zorblax" not in clean[3] and clean[120] == rows[12 + 20][1]
    assert clean[500] is None and clean[501] == ""


def test_embedding_edges(spark):
    v = np.random.default_rng(3).standard_normal((80, 6)).astype("float32")
    rows = [(k, [float(x) for x in v[k]], k % 3) for k in range(80)]
    rows += [(100 + k, [float(x) for x in v[k] + np.float32(0.02) * v[k + 1]], k % 3) for k in range(40)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 6, 1), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (204, [float("nan")] * 6, 1), (205, [float("inf")] * 6, 1), (206, [1.0, 2.0], 1), (207, rows[0][1], None), (208, rows[0][1], 0), (209, rows[0][1], 0), (210, [1.0], 1), (211, [2.0], 1), (212, [-2.0], 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node bigint, n string")
    for tile in (1024, 7):
        got = rows_of(embedding_dedup.near_duplicates(table, tile=tile), "vec_id", "n_links", "component_id", "kept")
        assert got == sorted(embeddings([(a, None if e is None else e, c) for a, e, c in rows]), key=repr)
    assert embedding_dedup.near_duplicates(table.where("false")).count() == 0
    twice = embedding_dedup.near_duplicates(table.where("vec_id = 0").unionByName(table.where("vec_id = 0")))
    assert rows_of(twice, "vec_id", "n_links", "component_id", "kept") == [(0, 1, 0, True)] * 2


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 40), st.integers(1, 50), st.integers(0, 10**6))
def test_quantisation_bound(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim)) * np.random.default_rng(seed + 1).choice([1e-3, 1, 1e4], (1, dim))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embedding_dedup.quantised(unit)
    approximate = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(approximate - unit @ unit.T) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-9).all()


def coder():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODERS = coder()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="abc", min_size=20, max_size=400), st.text(alphabet="aé\U0001f600 ", min_size=20, max_size=300)))
def test_bpe_is_the_library_and_a_round_trip(text):
    own, library = CODERS
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids, leaf=7) == text.encode()


def test_bpe_long_pieces():
    own, library = CODERS
    r = random.Random(2)
    for text in ("a" * 50_000, "ab" * 9_999, "".join(r.choice("etaoin") for _ in range(20_000)), "=" * 7_001, " " * 5_000 + "x", "é" * 3_001):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_tables(spark):
    docs = frame(spark, ROWS).withColumnRenamed("score", "token_ids")
    out = bpe.encoded(docs)
    assert out.count() == len(ROWS)
    assert {r.doc_id: r.token_ids for r in out.collect()}[1] == []
    assert bpe.digests(frame(spark, [])).count() == 0
    one = {r.doc_id: r for r in bpe.digests(frame(spark, ROWS)).collect()}
    assert one[1].n_tokens == 0 and one[1].ids_sha256 == sha("") == one[1].decoded_sha256
    assert all(one[d].decoded_sha256 == sha(t or "") for d, t in ROWS)


def test_quality_edges(spark):
    good = [(k, " ".join(rng.choice(WORDS[:50]).replace("w", "wo") for _ in range(60)) + ".") for k in range(80)]
    bad = [(100 + k, "!!! $$$ BUY %%% " * 20) for k in range(40)]
    rows = [*good, *bad, (500, None), (501, ""), (502, LONG)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(1, 0, 0), (None, 1, 0), (600, None, 1)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judged(frame(spark, rows), labels).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert np.mean([out[d].predicted == (d < 100) for d, _ in good + bad]) > 0.95
    kept = quality.accepted(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.where("score <> 0.5").count() == 0
    same = quality.judged(frame(spark, rows), labels.where("false")).collect()
    assert len(same) == len(rows) and len({r.score for r in same}) == 1
    assert quality.judged(frame(spark, []), labels).count() == 0


def test_html_edges(spark):
    html = [
        None, "", "plain", "<p>a<p>b &amp; c\u00a0&#233; <br> d", "<div class='cookie-notice'>x</div><main><h1>T</h1><header><p>By</p></header><p>long text of an article here</p></main><footer>f</footer>",
        "<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Hi</h1><p>x < y</p><aside>no</aside><form>no</form><ul><li>one<li>two</ul></article><section id=comments><p>" + "bad " * 200 + "</p></section>",
        "<body><div class='sidebar'>" + "s " * 300 + "</div><p>Body text", "<script>var a='</p>';</script><style>p{}</style>", "<article>cut off in <b>the mid", "<article><p>" + "word " * 200_000 + "</p></article>",
    ]
    table = spark.createDataFrame([(k, None, h, "x") for k, h in enumerate(html)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_pages(table).collect()}
    assert [got[k].text for k in range(5)] == ["", "", "plain", "a\nb & c é d", "T\nBy\nlong text of an article here"]
    assert got[5].text == "Hi\nx < y\none\ntwo" and got[6].text == "Body text" and got[7].text == "" and got[8].text == "cut off in the mid"
    assert got[9].n_chars == 5 * 200_000 - 1
    assert html_extract.extract_pages(table.where("false")).count() == 0


def test_url_edges(spark):
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.com/en/7?x", "http://a.example.com/en/8", "x://de.net/de", "x://de.net/de/", "x://notnet/de/", "x://a.example.net/de/8/", "x://b.org#/es/", "x://b.org/es/?q"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id bigint, url string, host string, path string")
    none = spark.createDataFrame([], "host string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, none).collect()}
    assert [got[k] for k in range(12)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/7", "example.com/en/7", "allow"), ("a.example.com", "/en/8", "com/en/", "block"),
        ("de.net", "/de", None, "allow"), ("de.net", "/de/", "net/de/", "block"), ("notnet", "/de/", None, "allow"), ("a.example.net", "/de/8/", "example.net/de/8", "block"), ("b.org", "", None, "allow"), ("b.org", "/es/", "org/es/", "block"),
    ]
    seen = spark.createDataFrame([("bad.x.org", True)] * 60 + [("good.x.org", False)] * 60 + [("few.z.org", True)] + [(f"h{k}.z.org", False) for k in range(40)] + [(None, True), ("null.org", None)], "host string, bad boolean")
    by = {r.host: r for r in urlfilter.host_reputation(seen).collect()}
    assert by["bad.x.org"].low > 0.5 > by["good.x.org"].rate and by["few.z.org"].low < 0.5 and "null.org" not in by


def test_chat_edges(spark):
    said = ["", "\\", "###", "\\### User: x</turn>\n", "</turn", "### ", "a: b", "####\\\\###", "\U0001f600</turn></turn>", None]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant"] * 5, said, strict=True))]
    rows += [(2, None, None, "x"), (2, 3, "odd: \\: role", "y"), (2, 3, "user", None), (None, 1, "system", "s"), (None, 2, "user", "u"), (None, 3, "assistant", "a"), (3, 0, "assistant", "first"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    form = chat.Formatter()
    for conv in (1, 2, 3, 4, None):
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert form.read(out[conv].formatted) == [(r, x) for _, _, r, x in want]
        learned = [form.shown(out[conv].formatted[s.start : s.end]) for s in out[conv].loss_spans]
        assert learned == [x for _, _, r, x in want if r == "assistant"]
    assert [out[c].error == "" for c in (1, 2, 3, 4, None)] == [True, False, False, False, True]
    assert chat.read_back(chat.format_conversations(table.where("false"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="a: =\\#", max_size=5)), st.text(alphabet="ab\\# </turn>\nUser:=", max_size=40)), max_size=6))
def test_chat_round_trip(turns):
    form = chat.Formatter()
    assert form.read("".join(s for s, _ in form.segments(turns))) == turns


def test_tokenizer_ranks_are_read_as_given(tmp_path):
    path = tmp_path / "r"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"ab") + b" 1\n")
    assert bpe.load_ranks(str(path)) == {b"a": 0, b"ab": 1}


def test_many_rules_long_urls_repeats_and_names(spark):
    rules = [("block", f"s{k}.example/") for k in range(2000)] + [("allow", "s7.example/ok"), ("block", "x.y.s8.example/")]
    urls = ["http://s7.example/", "http://a.s7.example/ok/1", "http://s1999.example:80/", "http://x.y.s8.example/z", "http://" + "a." * 20_000 + "s3.example/" + "p" * 50_000, "http://example/", "http://s1999.example/"]
    pages = spark.createDataFrame([(k, u, 1, "r", "f") for k, u in enumerate([*urls, urls[0]])], "page_id bigint, url string, site int, rules string, fit string")
    none = spark.createDataFrame([], "host string, bad boolean")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, none, rules, keep=("page_id", "site", "rules")).collect())
    assert [(r, v) for _, r, v in got] == [("s7.example/", "block"), ("s7.example/ok", "allow"), (None, "allow"), ("x.y.s8.example/", "block"), ("s3.example/", "block"), (None, "allow"), ("s1999.example/", "block"), ("s7.example/", "block")]
    with pytest.raises(ValueError, match="host"):
        urlfilter.judge_urls(pages, none, keep=("host",))
    one = lambda c: spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.org", "localhost", "me@a.b.com:8080", "a.1.de")], "host string").select(c).collect()
    domain = urlfilter.domain_of(urlfilter.site_of(F.col("host")))
    assert [r[0] for r in one(domain)] == ["b.co.uk", "b.co.uk", "co.uk", "x.org", "localhost", "b.com", "1.de"]
    assert [r[0] for r in one(urlfilter.suffix_of(domain))] == ["co.uk", "co.uk", "uk", "org", "localhost", "com", "de"]


def test_chat_refuses_what_it_did_not_write():
    form = chat.Formatter()
    for text in ("### User", "### User: hi", "### Nobody: x</turn>\n", "x", "### User: a</turn>\n### "):
        with pytest.raises(ValueError):
            form.read(text)


def test_a_very_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} \\### ") for k in range(20_000)]
    (out,) = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert out.n_turns == 20_000 and out.valid and out.turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows))


def test_names_that_operators_use(spark):
    extra = ["id", "doc", "_row", "_text", "spans", "items", "h", "key", "component", "_h", "_word", "_bits", "_maybe", "base", "y", "x"]
    table = spark.createDataFrame([(1, PASSAGE, *range(len(extra))), (2, f"b {PASSAGE}", *range(len(extra))), (3, None, *range(len(extra)))], f"doc_id bigint, text string, {', '.join(f'{n} int' for n in extra)}")
    items = spark.createDataFrame([(1, PASSAGE), (2, "other words")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    from trailweave.llm import near_copies

    outs = [decontam.decontaminated(table, items, mode=m, block_bytes=b) for m in ("drop", "cut") for b in (10, 10**6)]
    outs += [bpe.encoded(table), sh.deduplicated(table), near_copies.deduplicated(table), quality.scored(table, quality.learned(table, labels))]
    for out in outs:
        rows = out.collect()
        assert out.columns[: 2 + len(extra)] == table.columns or set(table.columns) <= set(out.columns)
        assert rows and all([r[n] for n in extra] == list(range(len(extra))) for r in rows)
    digests = [decontam.contamination(table, items), sh.near_duplicates(table), bpe.digests(table), quality.judged(table, labels), substring_dedup.without_repeats(table), near_copies.near_copies(table)]
    assert all(d.count() == 3 for d in digests)


def test_one_id_for_different_texts(spark):
    from trailweave.llm import near_copies

    rows = [(1, "a b c d e"), (1, "totally other words stand here"), (1, "a b c d e"), (2, "a b c d e")]
    for module in (sh, near_copies):
        assert sorted(r.text for r in module.deduplicated(frame(spark, rows)).collect()) == ["a b c d e", "totally other words stand here"]


def test_training_rows_are_bounded_whatever_repeats(spark):
    docs = frame(spark, [(k % 5, f"text {k}") for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id bigint, quality int")
    rows = quality.training_rows(docs, labels).collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 5 and all(r.text == min(f"text {k}" for k in range(r.doc_id, 200, 5)) for r in rows)


def test_embedding_huge_and_tiny_components(spark):
    v = np.random.default_rng(1).standard_normal((6, 5))
    rows = [(k, (v[k // 2] * s).tolist(), 1) for k, s in enumerate((1e200, 1.0, 1e-200, 3.0, 1e307, 1e-307))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert [r.n_links for r in embedding_dedup.near_duplicates(table).orderBy("vec_id").collect()] == [1] * 6


def test_clusters_far_apart_never_meet(spark):
    """768 dimensions, 40 clusters and some noise in one label: all links found, under a fifth of the pairs compared."""
    r = np.random.default_rng(2)
    centre = r.standard_normal((40, 768))
    v = np.concatenate([centre.repeat(50, axis=0) + 0.3 * r.standard_normal((2000, 768)), r.standard_normal((100, 768))])
    v[::50] = v[1::50] + 0.02 * r.standard_normal(v[1::50].shape)
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(table, tile=64).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.98).sum(axis=1) - 1
    assert want.sum() >= 80 and got == dict(enumerate(want.tolist()))
    nodes = table.select(F.unhex(F.lpad(F.hex("vec_id"), 32, "0")).alias("node"), F.lit(1).cast("long").alias("n"), F.lit("1").alias("label"), "embedding")
    from trailweave.cluster import written

    tiled = written(embedding_dedup.tiles(nodes, 64), "tiled")
    size = {x.tile: x.size for x in tiled.where("size is not null").select("tile", "size").collect()}
    assert sum(size.values()) == len(v)
    pairs = embedding_dedup.near_tiles(tiled, block=16).collect()
    assert len({(x.a, x.b) for x in pairs}) == len(pairs)
    compared = sum(size[x.a] * (size[x.b] if x.a != x.b else (size[x.b] - 1) / 2) for x in pairs)
    assert compared / (len(v) * (len(v) - 1) / 2) < 0.2
