"""License scans by diagonal voting.

Every k-gram of neighbouring words of a text is joined, by hash and then by the words themselves, to the places of the
same k-gram in the templates: pairs for phrases, which may have two words only, triples for notices. A hit votes for
the diagonal "place in the text minus place in the template"; an unbroken copy of a template puts all its votes on one
diagonal, a copy with some words more or less on neighbouring ones, which are merged. A span counts if the hits on it
cover enough of its template's words, each of them compared, and it is not much longer than the template. Phrases are
templates that must be there unbroken, and each place counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole

# fixed values: the phrases with their labels, and notices of well-known licenses, in their own words
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("all rights reserved", "proprietary"),
)
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a k-gram: of a phrase, of a notice.
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: Diagonals so near to each other are merged.
GAP = 4
#: Of a notice's words so many must be there.
SHARE = 0.85
#: A merged span may have so many words more than its template.
SLACK = 4


def template_rows() -> list[tuple]:
    """(template, label, phrase, words, k, place, first, second, third): one for each k-gram; third is empty where k is 2."""
    out = []
    for t, (text, label, phrase) in enumerate([(*p, True) for p in PHRASES] + [(*n, False) for n in NOTICES]):
        words, k = text.split(), PHRASE_GRAM if phrase else NOTICE_GRAM
        out += [(t, label, phrase, len(words), k, place, *words[place : place + k], *[""] * (3 - k)) for place in range(len(words) - k + 1)]
    return out


def lowered(text: Column) -> Column:
    """Only A-Z change; where all is ASCII the faster lower() does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_COLUMNS = ("t", "label", "phrase", "t_words", "k", "place", "t_a", "t_b", "t_c")
#: One row more, which no k-gram of words is, carries every document through the join.
_CARRIER = (-1, "", False, 0, 0, 0, "", "", "")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(c) for x, c in zip(row, _COLUMNS, strict=True)]) for row in [*template_rows(), _CARRIER]]
    out = spark.range(1).select(F.inline(F.array(*rows)))
    return out.withColumn("gram", F.xxhash64("k", "t_a", "t_b", "t_c"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts every place of a phrase, first_word and last_word are the least and greatest of their starts
    (null without one). spans lists (label, first_word, last_word, share) of all that was found, in order. score is
    the greatest share of a template found, 0 without any. Null text counts as empty; repeated rows repeat.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(lowered(whole(F.col(text_col))), F.lit(WORDS), F.lit(0))
    # the tables' rows are told apart by a number given in this one pass over them
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words.alias("w"))
    n = F.size("w").cast("long").alias("n_words")
    none = F.lit("")
    rest = lambda k: F.slice("w", F.lit(k), F.greatest(F.size("w") - k + 1, F.lit(0)))
    firsts, seconds, thirds = (F.concat(F.array(none), x) for x in (F.col("w"), rest(2), rest(3)))  # the extra first one meets the carrier
    # outer, lest Catalyst infers a filter on the array and so finds the words twice; no array is empty
    rows = rows.select("row", "doc_id", n, F.posexplode_outer(F.arrays_zip(firsts.alias("a"), seconds.alias("b"), thirds.alias("c"))).alias("i", "g"))
    pair = F.struct(F.lit(PHRASE_GRAM).alias("n"), F.col("g.a").alias("a"), F.col("g.b").alias("b"), none.alias("c"))
    triple = F.struct(F.lit(NOTICE_GRAM).alias("n"), F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c"))
    carrier = F.struct(F.lit(0).alias("n"), none.alias("a"), none.alias("b"), none.alias("c"))
    of_place = F.when(F.col("i") == 0, F.array(carrier)).otherwise(F.array(pair, triple))
    grams = rows.select("row", "doc_id", "n_words", (F.col("i") - 1).alias("i"), F.explode(of_place).alias("g")).select("row", "doc_id", "n_words", "i", "g.*")
    grams = grams.withColumn("gram", F.xxhash64("n", "a", "b", "c"))
    t = F.broadcast(_templates(spark))  # a fixed list
    hits = grams.join(t, "gram").filter("n = k and a = t_a and b = t_b and c = t_c")

    doc = ["row", "doc_id", "n_words"]
    kind = ["t", "label", "phrase", "t_words", "k"]
    covered = lambda places: F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("k") - 1)))))
    diagonal = hits.withColumn("d", F.col("i") - F.col("place")).groupBy(*doc, *kind, "d").agg(
        F.min("i").alias("lo"), (F.max("i") + F.col("k") - 1).alias("hi"), F.collect_list("place").alias("places")
    )
    diagonal = diagonal.withColumn("there", F.when(F.col("t") >= 0, covered(F.col("places"))).otherwise(0))
    by_template = Window.partitionBy(*doc, *kind).orderBy("d")
    apart = F.coalesce(F.col("d") - F.lag("d").over(by_template), F.lit(0)) > GAP
    merged = diagonal.withColumn("run", F.sum(apart.cast("int")).over(by_template)).withColumn("run", F.when(F.col("phrase"), F.col("d")).otherwise(F.col("run")))
    spans = merged.groupBy(*doc, *kind, "run").agg(
        F.max("there").alias("there"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.flatten(F.collect_list("places")).alias("places"),
        F.max(F.struct("there", (-F.col("d")).alias("nd"), "lo", "hi")).alias("best"),
    )
    fits = F.col("hi") - F.col("lo") + 1 <= F.col("t_words") + SLACK
    share = F.try_divide(F.greatest(F.col("there"), F.when(fits & (F.col("t") >= 0), covered(F.col("places"))).otherwise(0)), F.col("t_words"))
    alone = ~fits
    spans = spans.select(
        *doc, "t", "label", "phrase", F.when(alone, F.col("best.lo")).otherwise(F.col("lo")).alias("lo"), F.when(alone, F.col("best.hi")).otherwise(F.col("hi")).alias("hi"), share.alias("share")
    )
    found = (F.col("t") >= 0) & F.when(F.col("phrase"), F.col("share") >= 1).otherwise(F.col("share") >= SHARE)
    base = found & F.col("phrase")
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    span = F.struct("label", F.col("lo").cast("long").alias("first_word"), F.col("hi").cast("long").alias("last_word"), "share")
    out = spans.groupBy(*doc).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"), labels(base).alias("base_labels"),
        labels(found).alias("labels"), F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
    )
    return out.drop("row")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("spans")


def _values() -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in [*template_rows(), _CARRIER])


OP9_SQL = f"""
WITH t(t, label, phrase, t_words, k, place, a, b, c) AS (VALUES {_values()}),
w AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
p AS (SELECT row, doc_id, len(w) AS n_words, unnest(range(0, len(w))) AS i, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b, unnest(list_concat(w[3:], [NULL, NULL])) AS c FROM w),
g AS (
  SELECT row, doc_id, n_words, i, {PHRASE_GRAM} AS k, a, b, '' AS c FROM p WHERE a IS NOT NULL
  UNION ALL SELECT row, doc_id, n_words, i, {NOTICE_GRAM}, a, b, c FROM p WHERE a IS NOT NULL
  UNION ALL SELECT row, doc_id, len(w), -1, 0, '', '', '' FROM w),
hits AS (
  SELECT row, doc_id, n_words, t.t, label, phrase, t_words, t.k, i, place, i - place AS d
  FROM g JOIN t ON g.k = t.k AND g.a = t.a AND g.b = t.b AND g.c = t.c),
diag AS (SELECT row, t, phrase, d, min(i) AS lo, max(i) + any_value(k) - 1 AS hi FROM hits GROUP BY row, t, phrase, d),
gaps AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY row, t ORDER BY d) > {GAP} THEN 1 ELSE 0 END AS apart FROM diag),
runs AS (SELECT *, CASE WHEN phrase THEN d ELSE sum(apart) OVER (PARTITION BY row, t ORDER BY d) END AS run FROM gaps),
places AS (SELECT h.row, h.doc_id, h.n_words, h.t, h.label, h.phrase, h.t_words, r.run, h.d, unnest(range(place, place + greatest(k, 1))) AS place FROM hits h JOIN runs r ON h.row = r.row AND h.t = r.t AND h.d = r.d),
one AS (SELECT row, t, run, max(n) AS there FROM (SELECT row, t, run, d, count(DISTINCT place) AS n FROM places GROUP BY row, t, run, d) GROUP BY row, t, run),
together AS (SELECT row, doc_id, n_words, t, label, phrase, t_words, run, count(DISTINCT place) AS together FROM places GROUP BY row, doc_id, n_words, t, label, phrase, t_words, run),
extent AS (SELECT row, t, run, min(lo) AS lo, max(hi) AS hi FROM runs GROUP BY row, t, run),
shares AS (
  SELECT a.*, e.lo, e.hi, greatest(o.there, CASE WHEN e.hi - e.lo + 1 <= t_words + {SLACK} THEN together ELSE 0 END)::DOUBLE / nullif(t_words, 0) AS share
  FROM together a JOIN one o ON a.row = o.row AND a.t = o.t AND a.run = o.run JOIN extent e ON a.row = e.row AND a.t = e.t AND a.run = e.run),
found AS (SELECT *, t >= 0 AND (CASE WHEN phrase THEN share >= 1 ELSE share >= {SHARE} END) AS found FROM shares)
SELECT doc_id, n_words, count(*) FILTER (found AND phrase) AS n_base,
       min(lo) FILTER (found AND phrase) AS first_word, max(lo) FILTER (found AND phrase) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (found AND phrase)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (found)), ','), '') AS labels,
       coalesce(max(share) FILTER (found), 0.0::DOUBLE) AS score
FROM found GROUP BY row, doc_id, n_words
"""
