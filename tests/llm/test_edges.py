"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import bottomk, decontam, html_extract, langid, line_dedup, mixing, projections, quality, sharding, warc
from riskloom.session import cut_lineage

LONG = " ".join(f"w{i}" for i in range(60_000))
DOC_ROWS = [
    (1, "the first text of them all\nwith a second line\nand a third line", "en", "a"),
    (1, "the first text of them all\nwith a second line\nand a third line", "en", "a"),       # a repeated row
    (2, "the first text of them all\nwith a second line\nand a third line", None, "b"),       # a tie
    (2, "another text under the same id as one before", "en", None),
    (3, None, "en", "a"), (4, "", "fr", "b"), (5, " \t\n ", None, None), (6, "!?", "en", "c"),
    (None, "a text without an id that nobody shares", "en", "a"), (None, None, None, None),
    (7, LONG, "en", "a"), (8, LONG + " tail", "en", "b"), (9, "un texte en français, voilà", "fr", "c"), (10, "ok", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ["size", "n_words", "class_id", "component", "label", "score", "value", "shard_id", "taken", "row_", "text_key", "kept",
           "n_lines", "cell", "doc", "bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOC_ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(c + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, 1), (None, 0), (6, None), (10, 0), (4, 0), (99, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "with a second line"), (2, None), (3, ""), (None, "ok"), (1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"),
                                  (4, "not there")], "item_id long, text string")


@pytest.fixture(scope="module")
def tables(spark, docs, labels, benchmark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def text_rows(df):
    return sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in df.collect())


def by_id(df, *names):
    return sorted(((r["doc_id"], *[r[n] for n in names]) for r in df.collect()), key=repr)


def operators(spark, docs, labels, benchmark):
    return {
        "line_dedup": line_dedup.deduplicated(docs), "sketch": bottomk.near_duplicates(docs), "dedup": bottomk.deduplicated(docs),
        "scores": quality.scores(docs, labels), "good": quality.good_documents(docs, labels), "hits": decontam.annotate(docs, benchmark),
        "clean": decontam.clean_documents(docs, benchmark), "matches": decontam.longest_matches(docs, benchmark),
        "shards": sharding.shard(docs, 1000), "lang": langid.predictions(docs), "mix": mixing.mix(docs), "mixed": mixing.mixed_documents(docs),
    }


def test_empty_tables(spark, docs, labels, benchmark):
    none = docs.limit(0)
    for name, df in operators(spark, none, labels.limit(0), benchmark.limit(0)).items():
        assert df.collect() == [], name
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(pages).collect() == [] and warc.page_digests(pages).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert projections.near_duplicates(vectors).collect() == []
    full = operators(spark, docs, labels.limit(0), benchmark.limit(0))
    assert {r.contaminated for r in full["hits"].collect()} == {False} and {r.score for r in full["scores"].collect()} == {0.5}


def test_row_counts(spark, docs, labels, benchmark):
    for name, df in operators(spark, docs, labels, benchmark).items():
        if name in ("line_dedup", "sketch", "scores", "hits", "shards", "lang", "mix"):
            assert df.count() == len(DOC_ROWS), name


def test_clashing_columns(spark, docs, clashing, labels, benchmark):
    plain, clash = operators(spark, docs, labels, benchmark), operators(spark, clashing, labels, benchmark)
    for name in plain:
        shown = [c for c in plain[name].columns if c not in SCHEMA or c == "doc_id"]
        assert by_id(plain[name], *shown) == by_id(clash[name], *shown), name
    for name in ("dedup", "good", "clean", "mixed"):
        assert clash[name].columns == clashing.columns
        assert all(r["value"] == f"value of {'none' if r.doc_id is None else r.doc_id}" and r["n_words"].startswith("n_words of")
                   for r in clash[name].collect()), name


def test_line_dedup_cases(docs):
    rows = line_dedup.deduplicated(docs).collect()
    assert sorted((r.n_removed, r.longest_run) for r in rows if r.doc_id in (1, 2)) == [(0, 0), (0, 0), (0, 0), (3, 3)]
    assert [r.text for r in rows if r.doc_id == 3] == [None] and [(r.text, r.n_lines) for r in rows if r.doc_id == 4] == [("", 0)]


def test_line_dedup_runs(spark):
    rows = [(1, "a\nb\nc\nd\n\ne"), (2, "x\nb\nc\n\nd\ny\na\nb"), (3, "c\nd\nq\na\nb\nc\nd\ne\na\nb\nc"), (4, "z " * 60 + "\nr"), (5, "s\n" + "z " * 60)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "x\ny\na\nb" and got[3].text == "c\nd\nq" and got[3].longest_run == 5
    assert got[4].n_removed == 0 and got[5].text == "s"


def test_line_dedup_plans_have_no_runtime_filters(spark, monkeypatch, tmp_path):
    """The sizes of the joined rows are guessed so large that each join got a filter, gathered in the driver."""
    plans = []

    def told(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(line_dedup, "cut_lineage", told)
    rows = [(i, "\n".join(f"line {n}" for n in range(i % 3, 20))) for i in range(12)]
    kept = spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.enabled")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")     # a table whose size is known
    got = line_dedup.deduplicated(spark.read.parquet(f"{tmp_path}/docs"))
    assert len(plans) > 8 and not [p for p in plans if "might_contain" in p]
    assert sum(r.n_removed for r in got.collect()) == sum(20 - i % 3 for i in range(1, 12))
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.enabled") == kept


def test_near_dedup_cases(docs):
    rows = {(r.doc_id, r.n_shingles): r for r in bottomk.near_duplicates(docs).collect()}
    assert rows[(1, 10)].component_id == 1 and rows[(2, 10)].component_id == 1 and not rows[(2, 10)].kept
    assert rows[(8, 59_997)].component_id == 7 and rows[(3, 0)].kept and rows[(4, 0)].component_id == 4
    assert rows[(None, 4)].kept is None
    left = text_rows(bottomk.deduplicated(docs))
    assert len(left) == len(DOC_ROWS) - 3 and sum(r[1] == 1 for r in left) == 1 and not any(r[1] == 8 for r in left)


def test_near_dedup_of_a_large_group(spark):
    """A hub, many near copies that are far from each other, and a template that many otherwise different texts share."""
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(base[:5 * (i % 40)] + [f"own{i}"] + base[5 * (i % 40) + 1:])) for i in range(1, 400)] + [(1000, " ".join(base))]
    rows += [(2000 + i, " ".join([f"line{j}" for j in range(30)] + [f"x{i}n{j}" for j in range(60)])) for i in range(300)]
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id <= 1000} == {1}
    assert all(r.kept for r in got if r.doc_id >= 2000)


def test_decontamination_cases(docs, benchmark):
    rows = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontam.annotate(docs, benchmark, keep=["doc_id"]).collect()))
    assert (1, 14, 4, 1) in rows and (3, 0, 0, 0) in rows and (10, 1, 1, 1) in rows and (7, 60_000, 11, 1) in rows
    blocks = decontam.annotate(docs, benchmark, keep=["doc_id"], block_bytes=10)       # a pass per item
    assert by_id(blocks, "n_hit", "n_items", "items_sha256") == by_id(decontam.annotate(docs, benchmark), "n_hit", "n_items", "items_sha256")
    best = {(r.item_id, r.doc_id): (r.item_word, r.doc_word, r.n_words) for r in decontam.longest_matches(docs, benchmark).collect()}
    assert best[("1", 7)] == (0, 5, 11) and best[("1", 1)] == (0, 6, 4)


def test_mixing_cases(docs):
    rows = mixing.mix(docs).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows) and {r.size for r in rows if r.text is None} == {0}
    assert rows and by_id(mixing.mix(docs), "taken") == by_id(mixing.mix(docs.repartition(3)), "taken")


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(5, 1, 1), share=1.2).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3.5


def test_sharding_cases(docs):
    rows = sharding.shard(docs, 1000).collect()
    assert {r.oversize for r in rows if r.doc_id in (7, 8)} == {True}
    assert all(r.shard_bytes <= 1000 for r in rows if not r.oversize)


def test_sharding_splits_only_what_is_too_large(spark):
    rows = [(i, "x" * (i % 50)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 150).collect()
    sizes = {}
    for r in got:
        sizes[r.shard_id] = sizes.get(r.shard_id, 0) + r.n_bytes
    assert max(sizes.values()) <= 150 and len(sizes) > 700 and max(len(s) for s in sizes) > 10
    for s in sizes:      # a bucket was split because it was too large, so both halves hold more than the limit together
        assert s == "" or sum(n for t, n in sizes.items() if t.startswith(s[:-1])) > 150


def test_language_cases(docs):
    rows = langid.predictions(docs).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 6)} == {"und"} and {r.score for r in rows if r.doc_id == 3} == {0.0}


def test_language_mixture():
    import numpy as np
    from riskloom.llm.langid import Model, mixture, trigrams
    english, french = b"the house that stands on the hill was old " * 40, "la maison que voilà est très vieille ".encode() * 40
    rows = [(lang, int(b), int(n)) for lang, t in (("en", english), ("fr", french)) for b, n in zip(*np.unique(trigrams([t])[0], return_counts=True))]
    model = Model(rows)
    assert model.predict(trigrams([english[:200]])[0])[0] == "en" and model.predict(trigrams([french[:200]])[0])[0] == "fr"
    lang, score = model.predict(trigrams([english[:800] + french[:400]])[0])
    assert lang == "en" and 0.5 < score < 0.85
    shares, value = mixture(np.array([3.0, 1.0]), np.array([[0.9, 0.1], [0.1, 0.9]]), rounds=2000)
    grid = np.linspace(0, 1, 1001)
    best = grid[np.argmax([3 * np.log(0.9 * p + 0.1 * (1 - p)) + np.log(0.1 * p + 0.9 * (1 - p)) for p in grid])]
    assert abs(shares[0] - best) < 2e-3


def test_pages(spark):
    body = ("<html><head><title>t</title><style>p{}</style></head><body><div id=top-menu><a href=/>home</a></div><div class='post-{n}'><h1>A &amp; B"
            "</h1><p>One<br>two <b>bold</b>&nbsp;x<p>Three &#233;<ul><li>a<li>b</ul><div class=ad>buy</div><form>q<input></form><!-- <p>c -->"
            "<script>var x='<p>';</script><section class=comments><p>so good</section></div><footer>f</footer></body></html>")
    rows = [(i, f"http://Host.example/{i}?x", body.replace("{n}", str(i))) for i in range(1, 5)]
    rows += [(5, "http://host.example/5", "<p>only " + "x" * 200_000), (6, None, None), (None, "", ""), (7, "nonsense", "<<a <b c='"), (1, rows[0][1], rows[0][2])]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (1, 2, 3, 4)} == {"A & B\nOne two bold x\nThree é\na\nb"}
    assert [r.n_chars for r in got if r.page_id == 5] == [200_005] and {r.text for r in got if r.page_id in (6, None)} == {""}


def test_archives(spark, tmp_path):
    tricky = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"
    rows = [(3, "u3", "y" * 100), (1, "u1", "y" * 100), (2, None, "y" * 100), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", tricky), (7, "u7", None),
            (None, "u8", "é" * 500_000), (9, "a\r\nb", "\r\r\n\n\r"), (6, "u6", tricky), (10, "u10", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.page_digests(pages).collect()}
    assert (got[1].record_type, got[1].refers_to) == ("response", None)
    assert {(got[i].record_type, got[i].refers_to, got[i].payload_bytes) for i in (2, 3)} == {("revisit", 1, 100)}
    assert got[4].record_type == got[5].record_type == "response" and got[7].payload_bytes == got[10].payload_bytes == 0
    assert got[None].payload_bytes == 1_000_000 and len(got) == 10
    warc.write_archives(pages, str(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w"))
    captures = warc.assemble(read).collect()
    assert len(captures) == len(rows) and sum(r.metadata[0]["fields"].get("page_id") == "6" for r in captures) == 2
    # Page 6 stands twice: its second capture revisits the first and has no payload of its own.
    whole = {r.metadata[0]["fields"].get("page_id"): r for r in sorted(captures, key=lambda r: r.response.payload is not None)}
    assert bytes(whole["6"].response.payload) == tricky.encode() and bytes(whole["9"].response.payload) == rows[8][2].encode()
    assert whole["1"].request.target_uri == "u1" and whole["2"].response.payload is None
    assert read.where("type = 'broken'").count() == 0


def test_broken_archives(spark, tmp_path):
    import gzip
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"junk\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\nWARC-Type: metadata\r\n"
                                                  b"WARC-Record-ID: <m>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\nab"))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.type for r in rows) == ["broken", "broken", "broken", "metadata"]
    alone = warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert len(alone) == 1 and alone[0].response is None


def test_transactions_by_either_direction(spark):
    from riskloom.llm.warc import RECORD
    none = [None] * 7
    rows = [("f", "response", "r1", None, None, ["q1"], *none), ("f", "request", "q1", None, None, [], *none),
            ("f", "metadata", "m1", None, None, ["q1"], *none), ("f", "response", "r2", None, None, [], *none),
            ("f", "request", "q2", None, None, ["r2"], *none), ("f", "metadata", "m2", None, None, ["r2"], *none),
            ("f", "metadata", "m0", None, None, ["r2"], *none)]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, RECORD)).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.record_id == "q1" and [m.record_id for m in got["r1"].metadata] == ["m1"]
    assert got["r2"].request.record_id == "q2" and [m.record_id for m in got["r2"].metadata] == ["m0", "m2"]


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
            (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.19], 1), (13, [1.0, 0.21], 1),
            (14, [], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (15, [1e30, 0.0], 2), (16, [1e-30, 0.0], 2)]
    got = projections.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    links = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in got))
    assert (1, 5, 1) in links and links.count((3, 5, 1)) == 2 and (12, 6, 1) in links and (13, 1, 1) in links and (0, 5, 1) in links
    assert (4, 2, 4) in links and (15, 2, 4) in links and (16, 2, 4) in links
    assert all((i, 0, i) in links for i in (5, 6, 7, 8, 9, 10, 11, 14))


def test_vectors_against_brute_force(spark):
    import numpy as np
    rng = np.random.RandomState(3)
    centres = rng.randn(60, 48)
    x = np.concatenate([centres[i % 60] + rng.randn(48) * rng.choice([0.02, 0.12, 0.2]) for i in range(900)]).reshape(900, 48).astype(np.float32)
    label = rng.randint(0, 2, 900)
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(900)], "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(900, dtype=bool)
    old = projections.BLOCK
    projections.BLOCK = 100      # cells are split, and nothing changes
    try:
        got = {r.vec_id: r.n_links for r in projections.near_duplicates(df).collect()}
    finally:
        projections.BLOCK = old
    assert sum(got.values()) >= 0.999 * near.sum() and all(got[i] <= near[i].sum() for i in got)


def test_stages(spark, docs, clashing, tables):
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, clashing, docs.limit(0)):
            out = stage(spark, given, tables)
            if name != "sharding":
                assert out.columns == given.columns
            assert out.count() <= 2 * len(DOC_ROWS)
    assert corpus_pipeline.run(spark, tables).count() > 0
