"""Spelling variants: words one edit apart, found by walking all words through a trie of all words, one level of it per join.

The trie is a table of edges, made level by level: (node, letter, child, and how many words lie below the child). A node is the
prefix it stands for. A state (word, pos, node, edits) says that the word's first `pos` letters can be turned into `node` with so
many edits. At each level the states meet the edges of their node: a state without an edit takes its own letter's edge, or another
one as a replaced letter, or drops a letter; a state with an edit takes its own letter's edge only. A state
that arrives at a word's end with one edit is a neighbour. A child with one word below it is a leaf with the rest of that word: the
states that reach it are settled there by comparing the two words, so the walk is as deep as the longest prefix that two words share.

Only edges whose child holds several words go on, so a level's tables shrink with what is shared. A state without an edit lies on its
own word's path, so these states are the words from which the next level's edges are made. A level's edges are stored, counted, and
broadcast if few: the upper levels, on whose few nodes all words stand, have at most 91 and 8,281 edges. Below, nodes are many, and an
adaptive join splits a hot one.

Nulls and odd input: a null text has no words; a null doc_id counts as the empty text in the checksum. Repeated rows count as often
as they stand. Ties between equally frequent neighbours go to the smallest word. Long words cost one level per letter only as far as
two words share it. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checked_broadcast, discard, stored, work_folder
from riskloom.session import cut_lineage

LEAST_LETTERS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE = ["word", "pos", "node", "edits"]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least so many letters and occurrences; by checksum, some runs of letters lose a letter before."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")) \
        .select("id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))).alias("run")) \
        .select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hit = runs.withColumn("h", h).withColumn("cut", F.when(F.col("h") % EVERY == 0, (F.col("h") % F.char_length("run")).cast("int")))
    word = F.when(F.col("cut").isNull(), F.col("run")).otherwise(F.expr("concat(substring(run, 1, cut), substring(run, cut + 2))"))
    return hit.select(word.alias("word")).where(F.char_length("word") >= least_letters) \
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letter(at: Column) -> Column:
    return F.substring(F.col("word"), at + 1, F.lit(1))


def _edges(states: DataFrame) -> DataFrame:
    """The edges from the nodes of a level: node, letter, child, below (words under the child), only (that word, if it is one), ends, and
    the letters that follow the child. The states without an edit are the words below nodes that several words share, each at its node."""
    pos = F.col("pos")
    return states.where((F.col("edits") == 0) & (F.char_length("word") > pos)).groupBy("node", _letter(pos).alias("letter")) \
        .agg(F.count("*").alias("below"), F.min("word").alias("only"), F.max(F.char_length("word") == pos + 1).alias("ends"),
             F.array_join(F.collect_set(F.when(F.char_length("word") > pos + 1, _letter(pos + 1))), "").alias("follow")) \
        .withColumn("child", F.concat("node", "letter"))


def _can_go_on(letter: Column) -> Column:
    """Whether a state with an edit, whose word goes on with this letter (empty at its end), has a future behind the child."""
    return F.when(letter != "", F.col("follow").contains(letter)).otherwise(F.col("ends"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words that differ by exactly one inserted, deleted or replaced letter, both ways; stored.

    Every word is walked forwards with the edit in its second half, and backwards with the edit in its first half, so that nothing
    branches near the root. Both are one trie: its first letter tells the direction. Being near goes both ways, so letters are dropped
    but not inserted, and replaced by later ones only; the pairs are turned round at the end.
    """
    spark = words.sparkSession
    folder = work_folder(spark, "variants")
    both = words.select(F.concat(F.lit(">"), "word").alias("word")).union(words.select(F.concat(F.lit("<"), F.reverse("word")).alias("word")))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))    # words end up in few files where they are few
    pos, half = F.col("pos"), F.expr("(char_length(word) - 1) div 2")
    first = F.when(F.col("word").startswith(">"), half + 1).otherwise(F.char_length("word") - half)
    both = stored(both.repartition(spread, "word"), f"{folder}/words")
    start = both.agg(F.min(first)).first()[0] or 0    # above this level, each word has its own path only
    states = both.select("word", F.lit(start).alias("pos"), F.substring("word", 1, start).alias("node"), F.lit(0).alias("edits"))
    found, level = [], 0
    while True:
        edges = checked_broadcast(stored(_edges(states), f"{folder}/{level}-edges").withColumnRenamed("node", "at_node"))
        # The word's next two letters, empty behind its end.
        ahead = lambda df: df.withColumn("own", _letter(pos)).withColumn("next", _letter(pos + 1))
        own, next_, leaf = F.col("own"), F.col("next"), F.col("below") == 1
        free = (F.col("edits") == 0) & (pos >= first)
        dropped = states.where(free & (pos < F.char_length("word"))).select("word", (pos + 1).alias("pos"), "node", F.lit(1).alias("edits"))
        at_node = F.col("node") == F.col("at_node")
        # The own letter's edge: one row at most.
        kept = ahead(states.union(dropped)).join(edges, at_node & (own == F.col("letter")) & (leaf | (F.col("edits") == 0) | _can_go_on(next_))) \
            .select("word", (pos + 1).alias("pos"), "edits", "child", "below", "only", "ends")
        # Where an edit is free, the edges of later letters replace the own one; at a leaf, lengths tell first.
        same = F.char_length("word") == F.char_length("only")
        edited = ahead(states.where(free)).where(own != "") \
            .join(edges, at_node & (own < F.col("letter")) & F.when(leaf, same).otherwise(_can_go_on(next_))) \
            .select("word", (pos + 1).alias("pos"), F.lit(1).alias("edits"), "child", "below", "only", "ends")
        met = kept.union(edited)
        on = met.where("below > 1").select("word", "pos", F.col("child").alias("node"), "edits", "ends", F.lit(None).cast("string").alias("near"))
        settled = met.where("below = 1 and word <> only").where(F.levenshtein("word", "only", 1) == 1) \
            .select("word", "pos", F.lit("").alias("node"), F.lit(1).alias("edits"), F.lit(False).alias("ends"), F.col("only").alias("near"))
        arrived = stored(on.union(settled), f"{folder}/{level}")
        level += 1
        # At a node that is a word: the word's end with one edit, or its last letter still to be dropped.
        rest = F.char_length("word") - pos
        at_end = F.when(F.col("ends") & (F.col("edits") + rest == 1), F.col("node"))
        found.append(arrived.select("word", F.coalesce("near", at_end).alias("near")).where("near is not null"))
        states = arrived.where("near is null").select(*STATE)
        if not states.limit(1).count():
            break
    plain = lambda name: F.when(F.col(name).startswith(">"), F.substring(name, 2, 1 << 30)).otherwise(F.reverse(F.substring(name, 2, 1 << 30))).alias(name)
    pairs = reduce(DataFrame.union, found).select(plain("word"), plain("near"))
    near = cut_lineage(pairs.union(pairs.select("near", "word")).distinct())
    discard(spark, folder)
    return near


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n)."""
    words = cut_lineage(words)
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b")) \
        .select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("m"))
    usual = F.col("m") >= ratio * F.col("n")
    formed = cut_lineage(words.join(best, "word", "left").select(
        "word", F.when(usual, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(usual, F.col("m")).alias("form_n")))
    # A form is at least `ratio` times as frequent, so chains are short; each round doubles the steps taken.
    roots = cut_lineage(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs))


# The steps of the checksum, built by its rule, for the SQL.
_CRC = ", ".join(str(zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0")) for i in range(256))

VARIANT_SQL = rf"""
with recursive
r as (select coalesce(doc_id::varchar, '') id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')) run from documents),
u as (select id, translate(run, '{UPPER}', '{LOWER}') run, count(*) c from r group by all),
x as (select id, run, c, hex(encode(id || ':' || run)) x from u),
s as (select id, run, c, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::bigint)),
                                lambda a, b: xor(a >> 8, ([{_CRC}]::bigint[])[((xor(a, b) & 255) + 1)::int])) a from x),
h as (select run, c, xor(a, 4294967295::bigint) h from s),
o as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, c from h),
v as materialized (select word, sum(c)::bigint n from o where length(word) >= 6 group by all having sum(c) >= 5),
e as materialized (select word, n, i, left(word, i) || substr(word, i + 2) d from (select word, n, unnest(range(0, length(word))) i from v)),
near as materialized (
  select a.word, b.word near, b.n m from e a join e b on a.d = b.d and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union select e.word, v.word, v.n from e join v on e.d = v.word
  union select v.word, e.word, e.n from e join v on e.d = v.word),
best as (select word, count(*) n_near, arg_min(near, (-m, near)) near, max(m) m from near group by all),
formed as materialized (select v.word, case when m >= 5 * n then near end form, n, coalesce(n_near, 0)::bigint n_near, case when m >= 5 * n then m end::bigint form_n
           from v left join best using (word)),
walk as (select word, word at_, 0 step from formed union all select walk.word, form, step + 1 from walk join formed on at_ = formed.word where form is not null),
root as (select word, arg_max(at_, step) root from walk group by all)
select word, form, root, n, n_near, form_n from formed join root using (word)
"""
