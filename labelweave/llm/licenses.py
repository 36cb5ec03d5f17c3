"""License scans, with DataFrame functions only: phrases, and an exact set-similarity join with templates.

A text block is a run of as many words of the text as the template has, wherever lines end, or a whole line of at
most LINE times as many. So notices wrapped over lines are found, and words of a template scattered over a long text or line are none. Blocks and
templates are sets of words; a block matches a template if it holds at least THRESHOLD of the template's words. Tokens are ordered by their frequency over all
texts, the rarest first. A template that needs `a` of its `t` words can only match a block that
holds one of its first t - a + 1 tokens (prefix filter), that has `a` template words at all (length
filter), and whose rest behind the shared token is long enough (positional filter); what passes is
verified by intersecting the sets. Templates and their tokens are a fixed list, so the index that
is broadcast has a fixed size.

Every template that a block matches gives its label, so ties need no rule; `score` is the best containment. Null and empty texts have no words, no places and no labels. Rows are told apart by a number, not
by their ids, so repeated rows and null ids keep their own results. Texts are scanned whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import checkpoint

# The phrases of the base rule and the notices that serve as templates.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "All rights reserved."),
]
THRESHOLD = 0.9
#: A line is a block of a template with at least so much of its words: longer lines only count by their runs.
LINE = 2

_CHAR = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_WORDS = rf"[{_CHAR}]+"


def _bounded(inner: str) -> str:
    return rf"(?<![{_CHAR}])(?i:{inner})(?![{_CHAR}])"


def _phrase(words: str) -> str:
    return rf"[^{_CHAR}]+".join(words.split())


def _any_of(tokens) -> str:
    """An alternation of words, by first letter."""
    letters: dict[str, list[str]] = {}
    for token in sorted(tokens):
        letters.setdefault(token[0], []).append(token[1:])
    return "|".join(f"{k}(?:{'|'.join(sorted(rest, reverse=True))})" for k, rest in sorted(letters.items()))


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def words_of(text: str) -> list[str]:
    """A template's words, in order."""
    return re.findall(r"[a-z0-9]+", text.lower())


def template_words(text: str) -> list[str]:
    return sorted(set(words_of(text)))


def token_order(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template token by its frequency over all texts, the rarest first; ties by token."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(_bounded(_any_of(vocabulary))), F.lit(0)))
    counts = {
        r["token"]: r["n"]
        for r in docs.select(found.alias("token")).groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n")).collect()
    }
    return {token: rank for rank, token in enumerate(sorted(vocabulary, key=lambda x: (counts.get(x, 0), x)))}


def template_index(spark: SparkSession, templates, order: dict[str, int], threshold: float) -> tuple[DataFrame, list[str]]:
    """A row for each template and prefix token, and the prefix tokens."""
    rows, prefixes = [], set()
    for number, (label, text) in enumerate(templates):
        tokens = sorted(template_words(text), key=order.__getitem__)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            prefixes.add(token)
            rows.append((order[token], place, number, label, [order[t] for t in tokens], need, len(words_of(text))))
    schema = "token int, t_place int, template int, label string, t_tokens array<int>, need int, length int"
    return spark.createDataFrame(rows, schema), sorted(prefixes)


def similar_blocks(blocks: DataFrame, index: DataFrame, order: dict[str, int]) -> DataFrame:
    """(_row, template, label, containment) for every line (_row, block) of at most LINE times a template's words that meets its threshold."""
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    words = F.array_distinct(F.transform(F.regexp_extract_all("block", F.lit(_bounded(_any_of(order))), F.lit(0)), lambda w: F.lower(w)))
    tokens = blocks.select("_row", _count(F.col("block"), _WORDS).alias("size"), F.array_sort(F.transform(words, lambda w: ranks[w])).alias("tokens"))
    probes = tokens.select("_row", "size", "tokens", F.posexplode("tokens").alias("place", "token"))
    rest = F.least(F.size("tokens") - F.col("place"), F.size("t_tokens") - F.col("t_place"))
    overlap = F.size(F.array_intersect("tokens", "t_tokens"))
    return (
        probes.join(F.broadcast(index), "token")
        .where((F.col("size") <= LINE * F.col("length")) & (F.size("tokens") >= F.col("need")) & (rest >= F.col("need") - F.least("place", "t_place")))
        .where(overlap >= F.col("need"))
        .select("_row", "template", "label", (overlap / F.size("t_tokens")).alias("containment"))
    )


def prefix_places(ranks: str, prefixes: list[int], longest: int) -> Column:
    """For each prefix token of a text's word ranks (null for words of no template): its rank, the ranks around it, and where it stands in them."""
    wanted = F.array(*[F.lit(x) for x in prefixes])
    places = F.filter(F.transform(ranks, lambda r, k: F.when(F.array_contains(wanted, r), k + 1)), lambda k: k.isNotNull())

    def around(at: Column) -> Column:
        first = F.greatest(at - longest + 1, F.lit(1))
        return F.struct(F.get(ranks, at - 1).alias("token"), (at - first + 1).alias("here"), F.slice(ranks, first, F.lit(2 * longest - 1)).alias("near"))

    return F.transform(places, around)


def similar_runs(around: DataFrame, index: DataFrame) -> DataFrame:
    """(_row, template, label, containment) for every text with a run of words, as long as a template, that meets its threshold.

    around (_row, token, here, near) is what prefix_places() gives.
    """
    starts = F.sequence(F.greatest(F.col("here") - F.col("length") + 1, F.lit(1)), F.col("here"))
    held = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice("near", k, F.col("length")), "t_tokens"))))
    return (
        around.join(F.broadcast(index), "token")
        .where(F.size(F.array_intersect("near", "t_tokens")) >= F.col("need"))
        .select("_row", "template", "label", "need", held.alias("held"), F.size("t_tokens").alias("all"))
        .where("held >= need")
        .select("_row", "template", "label", (F.col("held") / F.col("all")).alias("containment"))
    )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row's key with words, base places and their labels, labels of both rules and the best containment."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    order = token_order(docs, text, vocabulary)
    index, prefixes = template_index(docs.sparkSession, templates, order, threshold)
    body = F.col(text)
    places = _bounded("|".join(_phrase(p) for p in phrases))
    has_prefix = _bounded(_any_of(prefixes))
    hits = F.when(F.col("_hit"), _count(body, places)).otherwise(F.lit(0)).cast("long")
    before = lambda head: F.when(F.col("_hit"), _count(F.regexp_extract(body, rf"(?s)^({head}){places}", 1), _WORDS))
    named = [F.when(body.rlike(_bounded(_phrase(p))), F.lit(label)) for p, label in phrases.items()]
    blocks = F.when(F.col("_near"), F.filter(F.split(body, "\n"), lambda line: line.rlike(has_prefix)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    known = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ranks = F.transform(F.regexp_extract_all(F.translate(body, upper, lower), F.lit(_WORDS), F.lit(0)), lambda w: known[w])
    longest = max((len(words_of(t)) for _, t in templates), default=1)
    light = checkpoint(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(key).alias("key"),
            body.alias(text),
            body.rlike(places).alias("_hit"),
            body.rlike(has_prefix).alias("_near"),
        ).select(
            "_row",
            "key",
            _count(body, _WORDS).alias("n_words"),
            hits.alias("n_base"),
            before(".*?").alias("first_word"),
            before(".*").alias("last_word"),
            F.when(F.col("_hit"), F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))).otherwise(F.array().cast("array<string>")).alias("base"),
            blocks.alias("blocks"),
            F.when(F.col("_near"), ranks).alias("ranks"),
        ).withColumn("around", prefix_places("ranks", [order[x] for x in prefixes], longest)).drop("ranks")
    )
    found = (
        similar_blocks(light.where("blocks IS NOT NULL").select("_row", F.explode("blocks").alias("block")), index, order)
        .unionByName(similar_runs(light.select("_row", F.explode("around").alias("a")).select("_row", "a.*"), index))
        .groupBy("_row")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    )
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return light.join(found, "_row", "left").select(
        F.col("key").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
