"""License scans by diagonal voting, with DataFrame functions alone.

All rolling word k-grams of every text are hashed and joined to the template positions that hold the same
k-gram (the words are compared too). A hit votes for the diagonal text position - template position;
neighbouring diagonals (words put in or left out) merge, and a merged diagonal is a span if the template
words it covers are a large enough share. A phrase is a template of which all words must stand on one
diagonal. Short phrases use 2-grams, notices 4-grams.

Defined results: a null text counts as empty: no words, no labels, score 0; null ids and repeated rows are
kept and scored alike; an empty table gives an empty result; other columns are ignored. The whole text is
scanned, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ids_and_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Every word of these must stand in order: (label, words).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Notices that may be changed in places: (label, words). Well-known wording of public licences.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc by nc", "licensed under cc by nc 4 0"),
    ("cc by", "this work is licensed under a creative commons attribution 4 0 international license"),
]


def _by_k(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def _hits(k: int, hashes: list[int]):
    """The positions whose k-gram has one of the hashes, with that k-gram."""
    h = F.col(f"h{k}")
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get(h, i).isin(*hashes))
    return F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), i.alias("pos"), F.get(h, i).alias("g"), F.slice("w", i + 1, F.lit(k)).alias("gram")))


def template_grams(phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k_phrase: int = 2, k_notice: int = 4) -> list[tuple]:
    """(template, label, phrase?, grams in all, words, position, k, w0, w1, w2, w3) of every template k-gram."""
    out = []
    for t, (label, text) in enumerate([*phrases, *notices]):
        is_phrase = t < len(phrases)
        words, k = text.split(), k_phrase if is_phrase else k_notice
        n = len(words) - k + 1
        out += [(t, label, is_phrase, n, len(words), i, k, *(words[i : i + k] + ["", ""])[:4]) for i in range(n)]
    return out


def rolling_hashes(words: DataFrame) -> DataFrame:
    """words (column w) with h2 and h4: hashes of the 2 and 4 words from each position on, made of the
    hashes of single words."""
    one = words.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    size = F.size("w")
    two = one.withColumn("h2", F.zip_with("h1", F.slice("h1", F.lit(2), size), lambda x, y: F.xxhash64(x, y)))
    return two.withColumn("h4", F.zip_with("h2", F.slice("h2", F.lit(3), size), lambda x, y: F.xxhash64(x, y))).drop("h1")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, min_covered: float = 0.6, max_drift: int = 8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with n_words, spans). A span: doc_id, text_hash, label, is_phrase, first_word, last_word,
    covered (share of the template's k-grams)."""
    spark = docs.sparkSession
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    grams = template_grams(phrases, notices)
    # the table of templates is a constant of this module or of the caller: a few hundred rows
    table = spark.createDataFrame(grams, "tpl int, label string, is_phrase boolean, n_grams int, n_tpl int, at int, k int, t0 string, t1 string, t2 string, t3 string")
    table = table.withColumn("w", F.slice(F.array("t0", "t1", "t2", "t3"), F.lit(1), F.col("k")))
    table = rolling_hashes(table).withColumn("g", F.when(F.col("k") == 2, F.col("h2")[0]).otherwise(F.col("h4")[0])).select("tpl", "label", "is_phrase", "n_grams", "n_tpl", "at", "k", "w", "g")
    wanted = {k: sorted({r[1] for r in rows}) for k, rows in _by_k(table.select("k", "g").collect()).items()}
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    split = ids_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.array_remove(F.split(low, NOT_WORD, -1), "").alias("w"))
    hashed = rolling_hashes(split)
    none = F.array().cast("array<struct<k:int,pos:int,g:bigint,gram:array<string>>>")
    found = none
    for k, values in wanted.items():
        found = F.concat(found, _hits(k, values))
    # one pass over the texts leaves counts and hits; a few numbers a document
    base = cut(hashed.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.when(F.size("w") > 0, found).otherwise(none).alias("hits")), "hits")
    counted = base.select("doc_id", "text_hash", "n_words")
    here = base.where(F.size("hits") > 0).select("doc_id", "text_hash", F.explode("hits").alias("x")).select("doc_id", "text_hash", "x.k", "x.pos", F.col("x.g").alias("h"), "x.gram")
    tpl = F.broadcast(table.select("tpl", "label", "is_phrase", "n_grams", "n_tpl", "at", F.col("k").alias("tk"), "w", "g"))
    hits = here.join(tpl, (F.col("h") == F.col("g")) & (F.col("k") == F.col("tk")) & (F.col("gram") == F.col("w"))).select("doc_id", "text_hash", "tpl", "label", "is_phrase", "n_grams", "n_tpl", "pos", "at")
    # from here on only hits; one shuffle brings a text's hits together. Rows of one text repeat: once is enough
    hits = hits.withColumn("diag", F.col("pos") - F.col("at")).repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "tpl", "pos", "at"])
    by = ["doc_id", "text_hash", "tpl", "label", "is_phrase", "n_grams", "n_tpl"]
    votes = hits.groupBy(*by, "diag").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = Window.partitionBy("doc_id", "text_hash", "tpl").orderBy("diag")
    fresh = F.col("is_phrase") | F.coalesce(F.col("diag") - F.lag("diag").over(w) > max_drift, F.lit(True))
    merged = votes.withColumn("part", F.sum(fresh.cast("int")).over(w))
    # at most a template's positions come together in one set
    spans = merged.groupBy(*by, "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n_hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diag").alias("diag"))
    covered = F.col("n_hits") / F.col("n_grams")
    k = F.col("n_tpl") - F.col("n_grams") + 1
    spans = spans.withColumn("covered", covered).where(F.when(F.col("is_phrase"), F.col("n_hits") == F.col("n_grams")).otherwise(covered >= min_covered))
    return counted, spans.select("doc_id", "text_hash", "label", "is_phrase", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + k - 1).cast("long").alias("last_word"), "covered")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word, last_word and base_labels are of the phrases; labels are of notices too; score is
    the largest covered share."""
    counted, spans = scan(docs, id_col=id_col, text_col=text_col, **options)
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    base = F.col("is_phrase")
    per = spans.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("covered").alias("score"),
    ).withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    out = counted.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.select("doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def report_sql(min_covered: float = 0.6, max_drift: int = 8) -> str:
    """DuckDB SQL for license_report over the table documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",".join(f"({t},{q(label)},{str(p).lower()},{n},{m},{i},{k},{q(' '.join(x for x in w if x))})" for t, label, p, n, m, i, k, *w in template_grams(PHRASES, NOTICES))
    return f"""
WITH g(tpl, label, is_phrase, n_grams, n_tpl, tpos, k, gram) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM d),
f AS (SELECT r, pos, x || ' ' || lead(x) OVER s AS g2, x || ' ' || lead(x) OVER s || ' ' || lead(x, 2) OVER s || ' ' || lead(x, 3) OVER s AS g4 FROM e WINDOW s AS (PARTITION BY r ORDER BY pos)),
h AS (SELECT r, tpl, label, is_phrase, n_grams, pos, tpos, pos - tpos AS diag FROM f JOIN g ON g.k = 2 AND f.g2 = g.gram
  UNION ALL SELECT r, tpl, label, is_phrase, n_grams, pos, tpos, pos - tpos AS diag FROM f JOIN g ON g.k = 4 AND f.g4 = g.gram),
o AS (SELECT DISTINCT r, tpl, is_phrase, diag FROM h),
p AS (SELECT *, sum(CASE WHEN is_phrase OR coalesce(diag - before > {max_drift}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY r, tpl ORDER BY diag) AS part
  FROM (SELECT *, lag(diag) OVER (PARTITION BY r, tpl ORDER BY diag) AS before FROM o)),
s AS (SELECT h.r, h.tpl, h.label, h.is_phrase, h.n_grams, p.part, count(DISTINCT tpos) AS n_hits, min(pos) AS lo FROM h JOIN p ON h.r = p.r AND h.tpl = p.tpl AND h.diag = p.diag GROUP BY ALL),
v AS (SELECT *, n_hits::DOUBLE / n_grams AS covered FROM s WHERE CASE WHEN is_phrase THEN n_hits = n_grams ELSE n_hits::DOUBLE / n_grams >= {min_covered} END),
a AS (SELECT r, count(*) FILTER (WHERE is_phrase) AS n_base, min(lo) FILTER (WHERE is_phrase) AS first_word, max(lo) FILTER (WHERE is_phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM v GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a ON d.r = a.r
"""
