"""License scans with built-in functions only: phrase places, and an exact set-similarity join of text
blocks with license templates by prefix, length and positional filters."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public license notices by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-license", "Released under the MIT License"),
    ("mit-license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lines of a block at most, those without a word not counted.
RUN = 12
#: The same class and its complement with every character listed, which Java looks up in a table.
_LISTED = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum())
NOT_WORD = f"[{_LISTED}]++"
#: Any run of other characters and the word behind it.
TO_WORD_END = f"[{_LISTED}]*+[^{_LISTED}]++"
#: ``NOT_WORD`` but for the line feed.
NOT_WORD_IN_LINE = f"[{_LISTED.replace(chr(92) + 'x0a', '')}]++"


def lowered(text: Column) -> Column:
    """A-Z in lower case.  lower() maps the Kelvin sign to an ASCII letter too, so that one is shielded."""
    return F.when(F.contains(text, F.lit("K")), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def tokens(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.lower())))


def count_words(text: Column) -> Column:
    """Each word becomes one character; a word more at the end takes what stands behind the last one."""
    return F.length(F.regexp_replace(F.concat(text, F.lit(" a")), TO_WORD_END, "x")).cast("long") - 1


def phrase_scan(low: str, phrases: dict[str, str] = PHRASES):
    """A function from a table with the lower-cased text column ``low`` to the same table with n_words, n_base,
    first_word, last_word and base_labels (array).

    A text is laid out only if it holds all words of some phrase and then the phrase.  In the laid-out text
    every word has a space of its own on both sides, so places that follow each other are both found when it
    is split at a phrase; a piece's spaces give its words.
    """
    listed = list(phrases.items())
    for phrase, _ in listed:
        words = phrase.split()
        if words[0] == words[-1] and len(words) > 1:
            raise ValueError("a phrase must not overlap itself")
    in_piece = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")

    def may_hold(phrase: str) -> Column:
        test = F.lit(True)
        for w in sorted(set(phrase.split()), key=len, reverse=True):
            test = test & F.contains(F.col(low), F.lit(w))
        return test & F.rlike(F.col(low), F.lit(NOT_WORD.join(map(re.escape, phrase.split()))))

    def run(rows: DataFrame) -> DataFrame:
        some = F.lit(False)
        for phrase, _ in listed:
            some = some | may_hold(phrase)
        laid = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.col(low), NOT_WORD, "  ")), F.lit(" "))
        found = rows.withColumn("__laid", F.when(some, laid)).withColumn("n_words", count_words(F.col(low)))
        pieces = [F.split("__laid", " " + "  ".join(map(re.escape, p.split())) + " ", -1) for p, _ in listed]
        # per phrase: its places, the words before the first and behind the last one
        digest = lambda x: F.struct((F.size(x) - 1).alias("n"), in_piece(F.element_at(x, 1)).alias("lo"), in_piece(F.element_at(x, -1)).alias("hi"))
        found = found.withColumn("__hits", F.when(F.col("__laid").isNotNull(), F.transform(F.array(*pieces), digest)))
        hit = [F.col("__hits")[i] for i in range(len(listed))]
        is_in = [F.coalesce(h["n"] > 0, F.lit(False)) for h in hit]
        first = [F.when(t, h["lo"]) for t, h in zip(is_in, hit, strict=True)]
        last = [F.when(t, F.col("n_words") - h["hi"] - len(p.split())) for t, h, (p, _) in zip(is_in, hit, listed, strict=True)]
        edge = lambda best, x: F.array_min(F.array(*x)) if best == "min" else F.array_max(F.array(*x))
        return found.withColumns({
            "n_base": sum((F.coalesce(h["n"], F.lit(0)) for h in hit), F.lit(0)).cast("long"), "first_word": edge("min", first), "last_word": edge("max", last),
            "base_labels": F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(label)) for t, (_, label) in zip(is_in, listed, strict=True)]))),
        }).drop("__laid", "__hits")

    return run


def template_sets(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words and how many of them a block must hold, of every template that has words.

    Templates are a parameter of at most 10,000 (else ValueError), so their table may be broadcast."""
    if len(templates) > 10_000:
        raise ValueError("too many templates for a broadcast")
    sets = [(i, label, tokens(text)) for i, (label, text) in enumerate(templates)]
    return [(i, label, words, max(1, math.ceil(threshold * len(words) - 1e-9))) for i, label, words in sets if words]


def span_of(templates: list[tuple[str, str]]) -> int:
    """Words that lines may have together to be one block: as many as the longest template, repeats counted."""
    return max((len(re.findall(WORD, text.lower())) for _, text in templates), default=0)


def with_blocks(rows: DataFrame, low: str, sets: list[tuple[int, str, list[str], int]], span: int) -> DataFrame:
    """The rows with blocks, array<struct<block, words>>: the blocks of a lower-cased text as sets of the words that
    templates have; blocks with fewer of them than any template needs are left out (the length filter).

    A block is a line, with the lines behind it as long as it has at most ``span`` words and ``RUN`` lines, lines without
    a word not counted: so notices are found that are wrapped.  Every such run of lines is a part of the block that starts
    at its first line, and a set that holds another's words contains as much of any template, so the runs need not be
    looked at one by one."""
    vocabulary = sorted({w for _, _, words, _ in sets for w in words})
    least = min((need for *_, need in sets), default=1)
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    lines = F.split(F.regexp_replace(F.col(low), NOT_WORD_IN_LINE, " "), "\n", -1)
    words = F.transform(lines, lambda line, i: F.struct(i.alias("block"), F.array_remove(F.split(line, " ", -1), "").alias("w")))
    sized = F.transform(F.filter(words, lambda x: F.size(x["w"]) > 0), lambda x: F.struct(x["block"].alias("block"), F.size(x["w"]).alias("n"), F.array_intersect(x["w"], known).alias("words")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("words"))

    def add(run: Column, line: Column) -> Column:
        """A run that is full counts more words than fit, so nothing is added behind."""
        total = run["n"] + line["n"]
        more = F.when((total <= span) | (run["n"] == 0), F.concat(run["words"], line["words"])).otherwise(run["words"])
        return F.struct(F.when((total <= span) | (run["n"] == 0), total).otherwise(F.lit(span + 1)).alias("n"), more.alias("words"))

    run = lambda i: F.aggregate(F.slice("__lines", i + 1, F.lit(RUN)), start, add, lambda x: F.array_distinct(x["words"]))
    blocks = F.transform("__lines", lambda x, i: F.struct(x["block"].alias("block"), run(i).alias("words")))
    # a column of its own: the lines are laid out once, not for each block
    return rows.withColumn("__lines", sized).withColumn("blocks", F.filter(blocks, lambda b: F.size(b["words"]) >= least)).drop("__lines")


def _joined(rows: DataFrame, sets: list[tuple[int, str, list[str], int]]) -> DataFrame:
    """The set-similarity join of rows (doc_id, text_hash, blocks) with the template sets."""
    spark = rows.sparkSession
    if not sets:
        kind = rows.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, text_hash long, block int, template int, label string, containment double")
    each = rows.select("doc_id", "text_hash", F.explode("blocks").alias("b")).select("doc_id", "text_hash", "b.block", "b.words")
    # at most the templates' words reach the driver
    seen = {r.w: r["count"] for r in each.select(F.explode("words").alias("w")).groupBy("w").count().collect()}
    vocabulary = sorted({w for _, _, words, _ in sets for w in words}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    prefixes = []
    for i, label, words, need in sets:
        ranks = sorted(rank[w] for w in words)
        prefixes += [(i, label, need, ranks, r, at) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    keys = sorted({r[4] for r in prefixes})
    least = min(need for *_, need in sets)
    prefixes = spark.createDataFrame(prefixes, "template int, label string, need int, t_ranks array<int>, rank int, t_at int")
    ranks_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    b = each.withColumn("b_ranks", F.array_sort(F.transform("words", lambda w: ranks_of[w])))
    probe = b.select("doc_id", "text_hash", "block", "b_ranks", F.posexplode(F.slice("b_ranks", F.lit(1), F.size("b_ranks") - least + 1)).alias("b_at", "rank")).where(F.col("rank").isin(keys))
    size_b, size_t = F.size("b_ranks"), F.size("t_ranks")
    joined = probe.join(F.broadcast(prefixes), "rank").where(
        (size_b >= F.col("need")) & (F.col("b_at") <= size_b - F.col("need")) & (F.least(size_b - F.col("b_at"), size_t - F.col("t_at")) >= F.col("need"))
    )
    common = F.array_intersect("b_ranks", "t_ranks")
    # of several shared prefix words only the first one reports the pair, so none comes twice
    return joined.where((F.size(common) >= F.col("need")) & (F.array_min(common) == F.col("rank"))).select(
        "doc_id", "text_hash", "block", "template", "label", (F.size(common) / size_t).alias("containment")
    )


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, block (number of its first line, from 0), template, label, containment: every text block
    (see ``with_blocks``) that holds at least ``threshold`` of a template's distinct words.

    All template words are ranked by how many blocks of the corpus hold them, rarest first, among the blocks
    long enough to match at all.  A block and a template that share enough words share one in the prefix of
    each: the first |T| - need + 1 words of the template and the first |B| - need + 1 of the block.  Blocks
    are joined with templates on the words of both prefixes; a pair lives on if the places of the shared
    word leave enough words behind it; then the sets are compared whole.  Exact: no block is missed.

    Null texts are empty; repeated rows are answered each; other columns are ignored.
    """
    sets = template_sets(templates, threshold)
    low = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("low"))
    rows = with_blocks(low.withColumn("text_hash", F.xxhash64("low")), "low", sets, span_of(templates)).select("doc_id", "text_hash", "blocks")
    return _joined(materialize(rows, "blocks"), sets)


def scan_once(docs: DataFrame, phrases: dict[str, str], sets: list[tuple[int, str, list[str], int]], span: int) -> DataFrame:
    """The phrase columns of every text and its blocks, in one pass over the texts."""
    low = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("low"))
    return with_blocks(phrase_scan("low", phrases)(low), "low", sets, span).select(
        "doc_id", F.xxhash64("low").alias("text_hash"), "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"
    )


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score.

    One row per input row.  n_base: all places where a phrase's words stand consecutively; first_word and
    last_word: their smallest and largest start (null if none).  labels: the phrases' and the matching
    templates'; score: the highest containment of a template that some block matches, else 0.

    Null texts are empty (0 words); repeated rows are answered each; an empty table gives an empty result;
    other columns are ignored.  The texts are read once: what the join needs of them, the template words of
    the lines that can match, is written beside the phrase columns.  No text is shuffled.
    """
    sets = template_sets(templates, threshold)
    rows = materialize(scan_once(docs, phrases, sets, span_of(templates)), "license-scan")
    found = _joined(rows.where(F.size("blocks") > 0), sets).groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    both = rows.drop("blocks").join(found, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base_labels").alias("base_labels"),
        F.array_sort(F.array_union("base_labels", F.coalesce("more", none))).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for the op8 digest: every line and every run of lines against every template, without filters."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(label)}, [{', '.join(map(quoted, tokens(text)))}], {max(1, math.ceil(threshold * len(tokens(text)) - 1e-9))})" for label, text in templates)
    hits = " UNION ALL ".join(
        f"SELECT doc_id, {quoted(label)} AS label, i - 1 AS place FROM w, unnest(range(1, len(ws) - {len(p.split()) - 2})) AS t(i) WHERE "
        + " AND ".join(f"ws[i + {j}] = {quoted(x)}" for j, x in enumerate(p.split()))
        for p, label in PHRASES.items()
    )
    return f"""
WITH w AS (SELECT doc_id, {low} AS low, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
hits AS ({hits}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS ls FROM hits GROUP BY doc_id),
t(label, ts, need) AS (VALUES {values}),
split AS (SELECT doc_id, i, regexp_extract_all(string_split(low, chr(10))[i], '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS bs FROM w, unnest(range(1, len(string_split(low, chr(10))) + 1)) AS t(i)),
filled AS (SELECT doc_id, bs, len(bs) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, sum(len(bs)) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM split WHERE len(bs) > 0),
lines AS (SELECT a.doc_id, list_distinct(flatten(list(b.bs))) AS bs FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {RUN - 1} AND (b.i = a.i OR b.total - a.total + a.k <= {span_of(templates)})
  GROUP BY a.doc_id, a.i),
more AS (SELECT doc_id, list(DISTINCT label) AS ls, max(len(list_intersect(bs, ts)) / len(ts)) AS best
  FROM lines JOIN t ON len(bs) >= need AND len(list_intersect(bs, ts)) >= need GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(more.ls, [])))), ','), '') AS labels,
  CAST(coalesce(round(best, 6), 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""
