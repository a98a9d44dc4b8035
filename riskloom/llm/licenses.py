"""Licence scan by ordered signature rules, in DataFrame functions only; a row is scanned where it lies, nothing is shuffled.

A text's words (runs of ASCII letters, digits and all other code points from 0x80 on; A-Z lower-cased) are looked up in the set
of gate words. Only a text that holds a rule's gate word is searched for the rule. For the search the words are framed with their
numbers, `<the:0><mit:1><license:2>`, and a rule's spaces are compiled to frames, so one match tells the words it spans.

Overlaps: a detection is suppressed if its span lies within that of a detection that comes before it in the order (priority,
longer first, rule). So the name in a notice goes, and a hint around a name does not hide the name. Partial overlaps both stay.
The sweep goes over the detections by start with the farthest end per priority, in blocks, so that it is linear in their number.

`base` phrases are counted apart from the rules: every place where their words stand one after another, overlaps included. Their
labels are always among the text's labels. The score is the confidence of the surest detection that is left; a base phrase alone
gives 0.5; nothing found gives 0.

Nulls and odd input: a null or empty text has no words, no places, empty labels and score 0; a null doc_id stays null. Repeated
rows are scanned one by one and give equal rows. An empty table gives an empty result. Extra columns stay out of `scan`; `labelled`
keeps them, and replaces those named like its results. Texts are scanned whole; the memory a row needs is in proportion to its text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.license_rules import RULES, Rule

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BASE_SCORE = 0.5
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # Java is slow on negated classes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 256
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
DETECTION = "struct<start: int, back: int, priority: int, rule: int, label: string, confidence: double, rule_id: string>"


def framed_pattern(pattern: str) -> str:
    """A rule's pattern over framed words: every space ends a frame and opens the next."""
    return "<" + pattern.replace(" ", ":[0-9]+><") + ":[0-9]+>"


def _catalog(rules: tuple[Rule, ...]) -> Column:
    rows = [{"gate": r.gate, "regex": framed_pattern(r.pattern), "priority": r.priority, "rule": n, "label": r.label,
             "confidence": r.confidence, "rule_id": r.rule_id} for n, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<gate: string, regex: string, priority: int, rule: int, label: string, "
                                                "confidence: double, rule_id: string>>")


def _framed(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w, i: F.concat(F.lit("<"), w, F.lit(":"), i, F.lit(">"))), "")


def _found(framed: Column, present: Column, rules: tuple[Rule, ...]) -> Column:
    """All detections in order of (start, longer first, priority, rule); `back` is minus the last word's number."""
    def of(rule):
        return F.transform(F.regexp_extract_all(framed, rule["regex"], F.lit(0)), lambda m: F.struct(
            F.regexp_extract(m, r":([0-9]+)>", 1).cast("int").alias("start"),
            (-F.regexp_extract(m, r":([0-9]+)>$", 1).cast("int")).alias("back"),
            rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"),
            rule["confidence"].alias("confidence"), rule["rule_id"].alias("rule_id")))

    due = F.filter(_catalog(rules), lambda r: F.array_contains(present, r["gate"]))
    return F.array_sort(F.flatten(F.transform(due, of))).cast(f"array<{DETECTION}>")


def _kept(found: str, priorities: int) -> Column:
    """The detections that no earlier one in the order contains. ends[p]: the farthest last word so far of a priority up to p."""
    farthest = f"array_repeat(-1, {priorities + 1})"
    one = f"""(s, d) -> named_struct(
        'ends', transform(s.ends, (e, p) -> if(p >= d.priority, greatest(e, -d.back), e)),
        'kept', if(s.ends[d.priority] >= -d.back, s.kept, concat(s.kept, array(d))))"""
    none, nothing = f"cast(array() as array<{DETECTION}>)", f"cast(array() as array<array<{DETECTION}>>)"
    block = f"aggregate(slice({found}, b * {BLOCK} + 1, {BLOCK}), named_struct('ends', t.ends, 'kept', {none}), {one})"
    return F.expr(f"""aggregate(sequence(0, cast(size({found}) div {BLOCK} as int)), named_struct('ends', {farthest}, 'kept', {nothing}),
        (t, b) -> transform(array({block}), r -> named_struct('ends', r.ends, 'kept', concat(t.kept, array(r.kept))))[0], t -> flatten(t.kept))""")


def _places(words: Column, n_words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")

    def stands(i):
        test = words[i] == parts[0]
        for k, part in enumerate(parts[1:], start=1):
            test = test & (words[i + k] == part)
        return test
    return F.when(n_words >= len(parts), F.filter(F.sequence(F.lit(0), n_words.cast("int") - len(parts)), stands))


def labelled(docs: DataFrame, base=BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections (the spans that are left).

    A detection holds start (its first word), back (minus its last word), priority, rule, label, confidence and rule_id.
    """
    keep = [c for c in docs.columns if c not in RESULT]
    gates = sorted({r.gate for r in rules} | {w for phrase, _ in base for w in phrase.split(" ")})
    text = F.coalesce(F.col("text_").cast("string"), F.lit(""))
    none = F.array().cast("array<int>")
    inner = docs.select(*[F.col(f"`{c}`").alias(f"extra_{i}_") for i, c in enumerate(keep)], F.col("text").alias("text_"))
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")
    seen = inner.withColumn("words_", words).withColumn("n_words", F.size("words_").cast("long")) \
        .withColumn("present_", F.array_intersect("words_", F.array(*map(F.lit, gates))))
    due = F.arrays_overlap("present_", F.array(*map(F.lit, sorted({r.gate for r in rules})))) if rules else F.lit(False)
    # A phrase whose words aren't all there has no place; its words aren't walked.
    whole = [F.forall(F.array(*map(F.lit, phrase.split(" "))), lambda w: F.array_contains("present_", w)) for phrase, _ in base]
    at = [F.coalesce(F.when(ok, _places(F.col("words_"), F.col("n_words"), phrase)), none) for ok, (phrase, _) in zip(whole, base)]
    seen = seen.withColumn("places_", F.array(*at).cast("array<array<int>>")).withColumn("framed_", F.when(due, _framed(F.col("words_")))) \
        .withColumn("found_", F.when(F.col("framed_").isNotNull(), _found(F.col("framed_"), F.col("present_"), rules))) \
        .withColumn("found_", F.coalesce("found_", F.array().cast(f"array<{DETECTION}>")))
    seen = seen.withColumn("detections", _kept("found_", max((r.priority for r in rules), default=1))) \
        .withColumn("flat_", F.flatten("places_")) \
        .withColumn("base_", F.array_sort(F.array_distinct(F.array_compact(F.array(
            *[F.when(F.size(F.col("places_")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(base)]).cast("array<string>")))))
    surest = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    base_score = F.when(F.size("flat_") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))
    results = {
        "n_words": F.col("n_words"), "n_base": F.size("flat_").cast("long"), "first_word": F.array_min("flat_").cast("long"),
        "last_word": F.array_max("flat_").cast("long"), "base_labels": F.array_join("base_", ","),
        "labels": F.array_join(F.array_sort(F.array_union("base_", F.transform("detections", lambda d: d["label"]))), ","),
        "score": F.greatest(F.coalesce(surest, F.lit(0.0)), base_score), "detections": F.col("detections"),
    }
    return seen.select(*[F.col(f"extra_{i}_").alias(c) for i, c in enumerate(keep)], *[results[n].alias(n) for n in RESULT])


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per detection that is left: doc_id, rule_id, label, priority, confidence, first_word, last_word."""
    found = labelled(docs.select("doc_id", "text"), (), rules).select("doc_id", F.explode("detections").alias("d"))
    return found.select("doc_id", "d.rule_id", "d.label", "d.priority", "d.confidence",
                        F.col("d.start").alias("first_word"), (-F.col("d.back")).alias("last_word"))


def scan(docs: DataFrame, base=BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return labelled(docs.select("doc_id", "text"), base, rules).select("doc_id", *RESULT[:-1])


def scan_sql(base=BASE, rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB SQL, with containment as an anti-join."""
    def quote(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    catalog = ", ".join(f"({n}, {r.priority}, {r.confidence}, {quote(r.label)}, {quote(r.gate)}, {quote(framed_pattern(r.pattern))})" for n, r in enumerate(rules))
    phrases = ", ".join(f"({quote(label)}, [{', '.join(map(quote, phrase.split(' ')))}])" for phrase, label in base)
    return rf"""
with d as materialized (select row_number() over () id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
f as materialized (select id, w, array_to_string(list_transform(w, lambda x, i: '<' || x || ':' || (i - 1) || '>'), '') t from d),
rules(rule, priority, confidence, label, gate, rx) as (values {catalog}),
m as (select id, rule, priority, confidence, label, unnest(regexp_extract_all(t, rx)) m from f join rules on list_contains(w, gate)),
s as materialized (select id, rule, priority, confidence, label, regexp_extract(m, ':([0-9]+)>', 1)::int a, regexp_extract(m, ':([0-9]+)>$', 1)::int b from m),
k as (select * from s where not exists (select 1 from s o where o.id = s.id and o.a <= s.a and o.b >= s.b
      and (o.priority < s.priority or o.priority = s.priority and (o.b - o.a > s.b - s.a or o.a = s.a and o.b = s.b and o.rule < s.rule)))),
best as (select id, list(distinct label) l, max(confidence) c from k group by all),
base(label, p) as (values {phrases}),
every as (select id, w, unnest(range(1, len(w) + 1)) i from d),
places as (select id, i - 1 i, label from every, base where w[i:i + len(p) - 1] = p),
found as (select id, count(*) n, min(i) lo, max(i) hi, list(distinct label) l from places group by all)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_base, lo::bigint first_word, hi::bigint last_word,
       array_to_string(list_sort(coalesce(found.l, [])), ',') base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(found.l, []), coalesce(best.l, [])))), ',') labels,
       greatest(coalesce(c, 0), case when n > 0 then {BASE_SCORE} else 0 end)::double score
from d left join found using (id) left join best using (id)
"""
