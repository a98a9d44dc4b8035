"""Licence scan, collocations and spelling variants: brute force on small tables, and nulls, ties, hot keys, long texts, clashes."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import collocations, licenses, variants
from riskloom.llm.license_rules import RULES

DOCS = "doc_id long, text string, lang string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------ licences
LICENCE_TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\").", "SPDX-License-Identifier: MIT", "Released under the MIT License. CC BY cc by",
    "GNU General Public License v3 or any later version; gnu general public license", "CC BY-NC-SA 4.0 and CC\nBY 4.0", "cc-by x cc . by éMIT License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "license: gpl-2.0 only, see the LICENSE file", "All rights reserved",
    "mozilla public license 2.0 and Mozilla Public License", "", None, "the the the", "x " * 3000 + "apache license " * 300, "MİT License MIT LICENSE",
]


def brute_scan(text, base, rules):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in base for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    framed = "".join(f"<{w}:{i}>" for i, w in enumerate(words))
    found = []
    for n, r in enumerate(rules):       # without gates
        for m in re.finditer(licenses.framed_pattern(r.pattern), framed):
            at = re.findall(r":([0-9]+)>", m[0])
            found.append((int(at[0]), int(at[-1]), n))
    key = lambda d: (rules[d[2]].priority, d[0] - d[1], d[0], d[2])
    left, seen = [], []
    for d in sorted(found, key=key):
        if not any(a <= d[0] and d[1] <= b for a, b in seen):
            left.append(d)
        seen.append(d[:2])
    own = {label for _, label in places}
    score = max([rules[d[2]].confidence for d in left] + [licenses.BASE_SCORE] * bool(places) + [0.0])
    starts = [i for i, _ in places]
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | {rules[d[2]].label for d in left})), score), sorted((a, b, rules[n].rule_id) for a, b, n in left)


def test_licences_against_brute_force(spark):
    docs = frame(spark, [(i, t, None) for i, t in enumerate(LICENCE_TEXTS)] + [(None, LICENCE_TEXTS[0], "x")])
    spans = defaultdict(list)
    for r in licenses.spans(docs).collect():
        spans[r.doc_id].append((r.first_word, r.last_word, r.rule_id))
    texts = dict(enumerate(LICENCE_TEXTS)) | {None: LICENCE_TEXTS[0]}
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want, left = brute_scan(texts[r.doc_id], licenses.BASE, RULES)
        assert tuple(r)[1:] == want, r
        assert sorted(spans[r.doc_id]) == left
    assert {r.doc_id: r.labels for r in rows}[4] == "cc-by,cc-by-nc-sa"


def test_licence_rules(spark):
    assert len(RULES) >= 300 and len({r.rule_id for r in RULES}) == len(RULES)
    docs = frame(spark, [(1, "a b a b a c", "x")])
    got = licenses.scan(docs, base=(("a b a", "t"),), rules=()).first()
    assert (got.n_base, got.first_word, got.last_word, got.labels, got.score) == (2, 0, 2, "t", licenses.BASE_SCORE)


def test_licences_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "mit license", 7, "x", "y")], "doc_id long, text string, present_ int, labels string, words_ string")
    got = licenses.labelled(docs)
    assert got.columns[:4] == ["doc_id", "text", "present_", "words_"] and got.first().labels == "mit" and got.first().present_ == 7


# ------------------------------------------------------------------ collocations
def brute_phrases(rows, threshold, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[(lang or "und", tuple(w[i:i + k]))] += 1
    often = {(g, p): c for (g, p), c in f.items() if c >= threshold}
    hidden = {(g, p[i:j]) for (g, p), c in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and c >= f[(g, p[i:j])]}
    out = defaultdict(list)
    for (g, p), a in often.items():
        if len(p) >= 2 and (g, p) not in hidden:
            score, k = min((1000 * a * n[g] // (f[(g, p[:k])] * f[(g, p[k:])]), k) for k in range(1, len(p)))
            out[g].append((-score, -a, " ".join(p).encode(), a, f[(g, p[:k])], f[(g, p[k:])], n[g], score))
    return sorted((g, i, x[2].decode(), *x[3:]) for g, xs in out.items() for i, x in enumerate(sorted(xs)[:top], start=1))


def phrase_rows():
    rng = np.random.RandomState(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "Zug", "x y", "ÀB"]
    rows = [(i, " ".join(rng.choice(vocabulary, 40, p=np.r_[.3, np.full(33, .7 / 33)])) + rng.choice([".", "\n", "", "; "]) + " fixed phrase of five words\tA", lang)
            for i, lang in enumerate(["en", "de", None, "und"] * 25)]
    return rows + [(1, "A a A a a", "en")] * 40 + [(None, None, "en"), (2, "", None), (3, "hot hot " * 4000, "en")]


@pytest.mark.parametrize("threshold", [5, 100])
def test_collocations_against_brute_force(spark, threshold):
    rows = phrase_rows()
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows), threshold, 50).collect()))
    assert got == brute_phrases(rows, threshold, 50) and len(got) > 5


def test_summaries_are_cut_and_nothing_frequent_is_lost(spark, monkeypatch):
    """Few hash partitions and long texts that are cut: the result stays."""
    monkeypatch.setattr(collocations, "PARTITIONS", 1)
    rows = phrase_rows()
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows).repartition(3), 20).collect())) == brute_phrases(rows, 20, 2000)


def test_summary_keeps_its_promise():
    rng = np.random.RandomState(1)
    keys = np.concatenate([rng.randint(0, 1 << 40, 200_000), np.repeat(np.arange(20), 700)]).astype(np.int64)
    rng.shuffle(keys)
    threshold = 500
    s = collocations.Summary(len(keys) // threshold)
    for part in np.array_split(keys, 50):
        s.add(*np.unique(part, return_counts=True))
    assert set(range(20)) <= set(s.survivors(threshold).tolist())
    assert s.lost < threshold and len(s.keys[0]) <= 2 * s.capacity and s.held < len(keys) // 10


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 64)
    text = b"one two three. " * 50 + b"x" * 500 + b" y"
    parts = list(collocations._stretches(iter([text, b"a", b"b"])))
    assert len(parts) > 5 and b"".join(parts).replace(b"\n", b"") == text + b"ab"
    assert all(p.rstrip(b" ").endswith((b".", b"y", b"b")) for p in parts)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert collocations.collocations(none).collect() == licenses.scan(none).collect() == variants.spelling_groups(none).collect() == []
    blank = frame(spark, [(1, None, None), (None, "", "en")])
    assert collocations.collocations(blank).collect() == variants.spelling_groups(blank).collect() == []


# ------------------------------------------------------------------ variants
def brute_counts(rows):
    n = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def got_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_variants_against_brute_force(spark):
    rng = np.random.RandomState(3)
    alphabet = list("abé")
    words = {"".join(rng.choice(alphabet, rng.randint(1, 9))) for _ in range(400)} | {"a" * k for k in range(1, 12)} | {"internationalé", "internationale", "internationalisé"}
    words = {w: int(5 ** rng.randint(0, 4)) + int(rng.randint(0, 3)) for w in sorted(words)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got_variants(variants.variants(table)) == brute_variants(words)


def test_word_counts_against_brute_force(spark):
    rng = np.random.RandomState(4)
    pool = ["Straße", "STRASSE", "Äpfelchen", "äpfelchen", "letters", "lettters", "short", "x×y÷zzz", "Ünïcode"]
    rows = [(int(i), " ".join(rng.choice(pool, 30)) + "7" + "q" * 6, "x") for i in range(300)] + [(None, "Straße, letters " * 9, None), (7, None, "x"), (8, "", "x")]
    docs = frame(spark, rows + rows[:20])
    want = brute_counts(rows + rows[:20])
    assert {r.word: r.n for r in variants.word_counts(docs).collect()} == want and len(want) > 8
    assert got_variants(variants.spelling_groups(docs)) == brute_variants(want)


def test_long_and_shared_words(spark):
    long = "ab" * 3000
    words = {long: 5, long + "c": 50, "z" + long: 300, "abcdef": 7, "xbcdef": 36}
    got = got_variants(variants.variants(spark.createDataFrame([(w, n) for w, n in words.items() if w != long + "c"], "word string, n long")))
    assert got == brute_variants({w: n for w, n in words.items() if w != long + "c"})
