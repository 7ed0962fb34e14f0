"""License scans by diagonal voting, in DataFrame functions only.

Templates are word sequences. Every rolling word k-gram of a text is hashed and joined to the template
positions with that hash (templates are fixed text, so that side is broadcast); a match is kept if its
words are the same. A match at text word p and template word t votes for the diagonal p - t. Votes are
counted by diagonal; where all of a template's k-grams vote for one diagonal, the template stands there
word for word. Diagonals of one template that are at most `gap` apart are merged (words inserted or
left out shift the diagonal), and the merged span is a label of the text if its verified votes cover at
least `cover` of the template.

Phrases (the base labels) are templates of a few words and use k = 2; whole notices use k = 5.

Cases: a null or empty text has no words and score 0; a very long text is an array of words in its row, and its matches alone, which
are few, leave it; labels that tie are sorted by name; rows that repeat both id and text each get their
row; ids may be null or of any type; an empty table stays empty; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Opening or core sentences of well-known public license notices.
NOTICES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files to deal in the software without restriction",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee "
    "is hereby granted",
    "warranty-disclaimer": "the software is provided as is without warranty of any kind express or implied including "
    "but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP, COVER = 3, 0.5


def words(text: Column) -> Column:
    """Lower-cased words of whole texts. Only A-Z are folded: of all other characters lower() turns only
    the Kelvin sign into an ASCII letter by itself, so that is kept from it; n_words is the same for any folding
    and templates are ASCII."""
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def _grams(spark: SparkSession, templates: list[tuple[str, str]], k: int, suffix: str) -> DataFrame:
    rows = [
        (label, i, len(w), w[i : i + k]) for label, text in templates for w in [text.split()] for i in range(len(w) - k + 1)
    ]
    grams = spark.createDataFrame(rows, "label string, t int, size int, gram array<string>")
    return grams.select(
        F.xxhash64(*(F.col("gram")[j] for j in range(k))).alias(f"h{suffix}"),
        F.struct("label", "t", "size", F.lit(k).alias("k"), "gram").alias(f"m{suffix}"),
    )


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    gap: int = GAP,
    cover: float = COVER,
    k: int = 5,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    short = list({label: text for text, label in (phrases or PHRASES).items()}.items())
    long = list((notices or NOTICES).items())
    w = F.col("w")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), words(F.col(text_col)).alias("w"))
    # position -1 carries the word count of each text; it matches nothing
    rows = rows.select("id", "tag", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("p"))
    hashed = lambda n: F.when(F.col("p") >= 0, F.xxhash64(*(F.get(w, F.col("p") + j) for j in range(n))))
    rows = rows.select("id", "tag", "w", "p", hashed(2).alias("hs"), hashed(k).alias("hl"))
    rows = rows.join(F.broadcast(_grams(spark, short, 2, "s")), "hs", "left").join(
        F.broadcast(_grams(spark, long, k, "l")), "hl", "left"
    )
    found = rows.filter("p < 0 or ms is not null or ml is not null").select(
        "id", "tag", "w", "p", F.explode(F.filter(F.array("ms", "ml"), lambda m: m.isNotNull() | (F.col("p") < 0))).alias("m")
    )
    # of the two empty slots at position -1 one is enough
    votes = found.filter((F.col("p") < 0) | (F.slice(w, F.greatest(F.col("p") + 1, F.lit(1)), F.coalesce("m.k", F.lit(1))) == F.col("m.gram")))
    votes = votes.groupBy(
        "id", "tag", F.col("m.label").alias("label"), F.col("m.t").alias("t"), (F.col("p") - F.col("m.t")).alias("d"),
        F.col("m.size").alias("size"), F.col("m.k").alias("k"),
    ).agg(F.count(F.lit(1)).alias("copies"), F.max(F.when(F.col("p") < 0, F.size("w"))).alias("n"))
    votes = votes.repartition("id", "tag")
    lines = votes.groupBy("id", "tag", "label", "size", "k", "d").agg(
        F.count("t").alias("votes"), F.max("copies").alias("copies"), F.max("n").alias("n"),
    )
    along = Window.partitionBy("id", "tag", "label").orderBy("d")
    lines = lines.withColumn("group", F.sum(F.when(F.col("d") - F.lag("d").over(along) <= gap, 0).otherwise(1)).over(along))
    merged = Window.partitionBy("id", "tag", "label", "group")
    grams = F.col("size") - F.col("k") + 1
    lines = lines.withColumn("cover", F.least(F.lit(1.0), F.sum("votes").over(merged) / grams))
    base = (F.col("k") == 2) & (F.col("votes") == grams)
    other = (F.col("k") == k) & (F.col("cover") >= cover)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = lines.groupBy("id", "tag").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("d"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("d"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(base | other, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(base | (F.col("k") == k), F.col("cover"))), F.lit(0.0)).alias("score"),
        (F.max(F.when(F.col("label").isNull(), F.col("copies"))) / 2).cast("int").alias("copies"),
    )
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))


def _values(templates: dict[str, str], k: int) -> str:
    return ", ".join(f"('{label}', '{text}', {k})" for label, text in templates.items())


#: The same votes by an equality join of k-grams, without hashes.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT label, string_split(body, ' ') AS w, k
      FROM (VALUES {_values({v: k for k, v in PHRASES.items()}, 2)}, {_values(NOTICES, 5)}) AS x(label, body, k)),
tg AS (SELECT label, k, len(w) - k + 1 AS grams, i - 1 AS t, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)),
dg AS (SELECT doc_id, k, i - 1 AS p, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (2), (5)) AS ks(k))),
lines AS (SELECT doc_id, label, tg.k, grams, p - t AS dg, count(*) AS votes
          FROM dg JOIN tg ON dg.g = tg.g AND dg.k = tg.k GROUP BY ALL),
marked AS (SELECT *, CASE WHEN dg - lag(dg) OVER (PARTITION BY doc_id, label ORDER BY dg) <= {GAP} THEN 0 ELSE 1 END AS new FROM lines),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, label ORDER BY dg) AS grp FROM marked),
cov AS (SELECT *, least(1.0, sum(votes) OVER (PARTITION BY doc_id, label, grp) / CAST(grams AS DOUBLE)) AS cover,
               k = 2 AND votes = grams AS base FROM grouped),
agg AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(dg) FILTER (base) AS first_word, max(dg) FILTER (base) AS last_word,
               list_sort(list(DISTINCT label) FILTER (base)) AS bl,
               list_sort(list(DISTINCT label) FILTER (base OR (k = 5 AND cover >= {COVER}))) AS ll,
               max(cover) FILTER (base OR k = 5) AS score FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(ll, ','), '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN agg USING (doc_id)
"""
