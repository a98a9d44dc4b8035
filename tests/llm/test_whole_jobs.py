"""Inputs on which an operator once did less than its whole job."""

import duckdb

import corpus_pipeline
from riskloom.llm import bottomk, html_extract, sharding, warc
from riskloom.llm.queries import SQL


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_stage_at_eighty(spark):
    """Pairs on both sides of 0.80 and 0.85, in sets that are whole in their sketch and in larger ones, against brute force."""
    rows = []
    for k, (words, changed) in enumerate([(24, 2), (24, 5), (40, 4), (40, 9), (60, 6), (200, 20), (200, 18), (200, 25), (900, 90), (900, 101)]):
        base = [f"t{k}w{i}" for i in range(words)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:-changed] + [f"t{k}own{i}" for i in range(changed)]))]
    sets = {d: shingles(t) for d, t in rows}
    alike = {d: len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in sets if d % 10 == 0}
    assert sum(0.8 <= j < 0.85 for j in alike.values()) >= 4 and sum(j < 0.8 for j in alike.values()) >= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["minhash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {d for d in sets if d % 10 == 0 or alike[d - 1] < 0.8}
    assert {r.doc_id for r in bottomk.deduplicated(docs, 85).collect()} == {d for d in sets if d % 10 == 0 or alike[d - 1] < 0.85}


def test_near_dedup_bounds_follow_the_threshold():
    assert [bottomk.least_shared(p) for p in (80, 85, 100)] == [6, 8, bottomk.LISTED]
    assert bottomk.least_estimate(80) < bottomk.least_estimate(85) < 0.61


def page_text(html):
    return html_extract.Page(html).text([])


BODY = "<h1>The title</h1><p>" + "Some words of the article. " * 20 + "</p>"
WHOLE = "The title\n" + ("Some words of the article. " * 20).strip()


def test_layouts_around_the_article_are_kept():
    article = f"<article>{BODY}</article>"
    around = "<nav><a href=/>home</a></nav>{}<div class=ad>buy this now</div><footer>the footer of the page</footer>"
    for tag in ("div class='layout no-sidebar'", "div class='content has-sidebar'", "div class=nav-open", "div id=hasSidebar", "form action=/x",
                "div class=layout-sidebar", "div title='the hidden cost'", "div data-x=\"a hidden b\"", "div class=\"page comments-enabled\""):
        for inner in (article, f"<main><div>{BODY}</div></main>"):
            assert page_text(around.format(f"<{tag}>{inner}</{tag.split()[0]}>")) == WHOLE, tag
    for tag in ("div class=elementor-widget-text-editor", "form", "div class='layout no-sidebar'", "div class=sidebar-left"):
        assert page_text(around.format(f"<{tag}>{BODY}</{tag.split()[0]}>")) == WHOLE, tag
    widget = "<main><h1>The title</h1><div class=elementor-widget-text-editor>" + BODY[len("<h1>The title</h1>"):] + "</div></main>"
    assert html_extract.Page(around.format(widget)).blocks == [(t, i + 1, 0) for i, t in enumerate(WHOLE.split("\n"))]


def test_what_is_left_out_stays_out():
    long = "Words that are not of the article. " * 40
    for drop in (f"<section class=comments><article class=comment><p>{long}</p></article></section>", f"<footer>{long}</footer>",
                 f"<aside><article>{long}</article></aside>", f"<div hidden>{long}</div>", f"<div class='modal is-open'>{long}</div>",
                 f"<div class=related><article>{long}</article></div>", "<form>Search <label>here</label></form>"):
        assert page_text(f"<body><article>{BODY}</article>{drop}</body>") == WHOLE, drop
    assert page_text(f"<p>{'x' * 300} <span class=ad>buy</span> y</p>") == "x" * 300 + " y"
    assert page_text(f"<article></article><div class=ad>{long}</div><footer>{long}</footer><form>Search</form>") == ""


def test_parts_beside_the_inner_container(spark):
    body, lead = "<div class=body><p>" + "Inner text of the page. " * 50 + "</p></div>", "A lead that stands above the rest of the article."
    inner = ("Inner text of the page. " * 50).strip()
    more = "<ul>" + "".join(f"<li><a href=/{i}>Another page of this site</a></li>" for i in range(9)) + "</ul>"
    parts = f"<h1>Title</h1><p>{lead}</p><div class=intro>Short intro.</div>{body}<div class=end>The end.</div>"
    whole = "\n".join(["Title", lead, "Short intro.", inner, "The end."])
    frames = ["<article>{}</article>", "<main><section>{}</section></main>", "<main><h2></h2><article>{}</article></main>", "<div class=post>{}</div>",
              "<div class=post>{}</div>" + f"<div class=more>{more}</div>", "<div><article>{}</article><article class=teaser>A teaser.</article></div>",
              "<article>{}</article><div class=end2>Copyright.</div>", "{}"]
    rows = [(10 * k + i, f"http://h{k}.example/{i}", "<nav><a href=/>home</a></nav>" + f.format(parts)) for k, f in enumerate(frames) for i in range(3)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: whole for r in rows}
    linked = f"<div class=all>{more}{body}</div>"
    assert page_text(linked) == inner


def test_copies_of_a_row_are_spread_over_shards(spark):
    rows = [(1, "x" * 300, str(i)) for i in range(40)] + [(i, "y" * 50, "") for i in range(2, 80)] + [(100, "z" * 1500, "")] * 2 + [(None, None, None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(4)
    got = sharding.shard(docs, 1000).collect()
    assert sorted((r.doc_id or 0, r.note or "") for r in got) == sorted((r[0] or 0, r[2] or "") for r in rows)
    sizes, counts = {}, {}
    for r in got:
        sizes[r.shard_id] = sizes.get(r.shard_id, 0) + r.n_bytes
        counts[r.shard_id] = counts.get(r.shard_id, 0) + 1
    assert all((r.shard_bytes, r.shard_docs) == (sizes[r.shard_id], counts[r.shard_id]) for r in got)
    assert [r.doc_id for r in got if r.oversize] == [100, 100] and all(r.shard_bytes <= 1000 for r in got if r.doc_id != 100)
    again = sharding.shard(docs.repartition(7), 1000).collect()
    assert sorted((r.doc_id or 0, r.shard_id) for r in again) == sorted((r.doc_id or 0, r.shard_id) for r in got)


def test_long_document_taken_twice(spark):
    docs = spark.createDataFrame([(1, "a long text " * 60_000)] * 2 + [(2, "short")], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["sharding"](spark, docs, "").collect()
    assert len(got) == 3 and max(r.shard_bytes for r in got) <= corpus_pipeline.SHARD_BYTES and not any(r.oversize for r in got)


def test_repeated_pages_are_captures_of_their_own(spark, tmp_path):
    rows = [(1, "u1", "y" * 200)] * 30 + [(2, "u2", "y" * 200)] + [(3, "u3", "short")] * 5 + [(None, "u4", "n" * 150)] * 4 + [(None, None, None)] * 3
    rows += [(i, f"u{i}", f"page {i} " * 20) for i in range(10, 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    con.execute(SQL["op4_warc"])
    names = [d[0] for d in con.description]
    expected = sorted(repr(r) for r in con.fetchall())
    got = warc.page_digests(pages).select(*names).collect()
    assert len(got) == len(rows) and sorted(repr(tuple(r)) for r in got) == expected
    warc.write_archives(pages, str(tmp_path / "w"))
    ids = [r.record_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()]
    assert len(ids) == len(set(ids)) == 3 * len(rows)
