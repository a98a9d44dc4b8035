"""The queries on the smallest tables: against their SQL, or against a brute-force version where SQL can't express them."""

import hashlib
import os
import re
import zlib

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from riskloom.checks.compare import duck
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(repr(r[n]) for n in names) for r in df.collect())


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    con.execute(SQL[name])
    columns = [d[0] for d in con.description]
    names = sorted(df.columns)
    assert sorted(columns) == names
    expected = sorted(tuple(repr(r[columns.index(n)]) for n in names) for r in con.fetchall())
    assert expected and rows_of(df) == expected


def test_registered(spark):
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert "pipeline" in entry_module.queries()


def lowered(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def brute_hits(docs, items, window=10):
    """doc_id -> (words, hit words, item ids), by looking for every window at every position."""
    windows = {}
    for item, text in items:
        w = lowered(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = lowered(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out[doc] = (len(w), len(hit), found)
    return out


def test_decontamination_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    expected = brute_hits(docs, items)
    assert any(e[1] for e in expected.values())
    for r in QUERIES["op7_decontamination"](spark, SF).collect():
        n, hit, found = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = QUERIES["op6_quality_classifier"](spark, SF).collect()
    assert len(got) == table(spark, SF, "documents").count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    good = [r.score for r in got if labels.get(r.doc_id) == 1 and r.held_out]
    bad = [r.score for r in got if labels.get(r.doc_id) == 0 and r.held_out]
    assert sum(x > y for x in good for y in bad) >= 0.9 * len(good) * len(bad)


def test_language_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    got = [r for r in QUERIES["op9_language_id"](spark, SF).collect() if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.97 * len(got)


def test_main_text_of_plain_articles(spark):
    from html import unescape
    html = {r.page_id: r.html or "" for r in table(spark, SF, "pages").collect()}
    for r in QUERIES["op2_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article[1])]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before it kept; the classifier's own decisions are taken as they are."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "sharding":
            assert docs.columns == columns
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    good = {r.doc_id: r.text for r in kept["quality classifier"]}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    # The classifier is owed no single row: nearly all good rows stay, also those it hasn't learned from (at sf0.01: 282 of 282 and
    # 59 of 59), and most of the bad ones go. Held-out bad rows are too few here to hold a share to.
    rated = lambda q, held: [d for d, label in labels.items() if label == q and (zlib.crc32(str(d).encode()) % 5 == 0) == held]
    assert all(sum(d in good for d in rated(1, held)) >= 0.95 * len(rated(1, held)) for held in (False, True))
    assert sum(d in good for d in rated(0, False)) <= 0.1 * len(rated(0, False)) and not all(d in good for d, q in labels.items() if q == 0)
    sets = {d: shingles(t) for d, t in good.items()}
    unique = {r.doc_id for r in kept["minhash near-dedup"]}
    near = {d: {e for e in sets if e != d and sets[d] and 100 * len(sets[d] & sets[e]) >= corpus_pipeline.NEAR_PERCENT * len(sets[d] | sets[e])} for d in sets}
    seen = set()
    for d in sorted(sets):
        if d in seen:
            continue
        group, todo = {d}, [d]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        assert unique & group == {min(group)}
    hits = brute_hits([(d, good[d]) for d in unique], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    clean = {r.doc_id for r in kept["benchmark decontamination"]}
    assert clean == {d for d in unique if not hits[d][1]}
    mix, sizes, sources = {}, {}, {}
    for r in kept["mixing"]:
        mix[r.doc_id] = mix.get(r.doc_id, 0) + 1
    for r in kept["benchmark decontamination"]:
        sizes[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sources.setdefault(r.source, []).append(r.doc_id)
    assert set(mix) <= clean and max(mix.values()) <= 2
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sources))}
    totals = {s: sum(sizes[d] for d in ds) for s, ds in sources.items()}
    left, target, open_ = 1.5 * sum(totals.values()), {}, set(sources)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * totals[s]}
        for s in over or open_:
            target[s] = 2 * totals[s] if over else level * weights[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s, ds in sources.items():
        assert abs(sum(sizes[d] * mix.get(d, 0) for d in ds) - target[s]) <= max(sizes[d] for d in ds) / 2 + 1e-6
    shards = {}
    for r in kept["sharding"]:
        shards.setdefault(r.shard_id, []).append(len((r.text or "").encode()))
    assert sorted(n for s in shards.values() for n in s) == sorted(len((r.text or "").encode()) for r in kept["mixing"])
    assert all(sum(s) <= corpus_pipeline.SHARD_BYTES for s in shards.values())
