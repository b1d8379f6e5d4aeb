"""Operator 3: license scans by an exact set-similarity join, in DataFrame operations only.

A block is any run of consecutive words, across line breaks, as long as a template of which ``100 - t`` percent more words are
foreign: ceil(100 / t * words of the template). Runs overlap, one ends at every word; longer runs are no blocks, so words
scattered over a long line or text don't add up.
Tokens are ordered by how many documents hold them, rarest first, ties by the token. A block can hold ``t`` percent of a
template's distinct tokens only if its text has one of the template's first |T| - need + 1 tokens in that order (prefix filter),
need tokens at all (length filter), and, from the first shared token on, need tokens in the template's order and in the text's own
(positional filter: what the text holds before that token is of other templates).
Only tokens of templates matter: one pass over every text writes which of them it has, and statistics and filters read that table. Candidate pairs (text, template)
come from an equi-join on prefix tokens and are verified by whole sets; in the texts left, a pass over the places of the template's
tokens finds the blocks, from left to right: of runs that overlap the one that holds most (the first of equals), then the next behind its end.
The templates are a parameter and few; they are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustwatch.llm.stage import id_text, with_ids, written

#: Label and short notice text.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    return F.regexp_extract_all(_lower(c), F.lit(WORD), F.lit(0))


def _vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({w for t in templates.values() for w in _plain(t)})


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _ordered_templates(sets: DataFrame, templates: dict[str, str], percent: int) -> tuple[list[str], list[dict]]:
    """All tokens in the global order, and label, tokens in that order, need, prefix length and width of a block of each template (the driver holds the templates' tokens alone)."""
    df = {r.token: r.n for r in sets.select(F.explode("has").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(_vocabulary(templates), key=lambda w: (df.get(w, 0), w))
    out = []
    for label, t in templates.items():
        tokens = [w for w in order if w in set(_plain(t))]
        need = -(-percent * len(tokens) // 100)
        out.append({"label": label, "tokens": tokens, "need": need, "prefix": len(tokens) - need + 1, "width": -(-100 * len(_plain(t)) // percent)})
    return order, out


def _plain(t: str) -> list[str]:
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()


def token_sets(docs: DataFrame, templates: dict[str, str], phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (of the phrases) and has (the distinct template tokens) of every row: its words are cut once, the table is written once."""
    known = _strings(_vocabulary(templates))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w, phrases or {}).alias("places"), F.array_intersect(w, known).alias("has"))

    # a generator's rows are made once; a plain column would be cut again wherever it is used
    one = F.explode(F.transform(F.array(words(F.col("text"))), of))
    return written(id_text(docs).select("doc_id", one.alias("x")).select("doc_id", "x.*"), "license-words")


def candidate_pairs(sets: DataFrame, templates: dict[str, str], percent: int, positional: bool = True) -> DataFrame:
    """(doc_id, has, label, tokens, need, width) of the texts and templates that the filters leave; ``has``: the text's template tokens in the global order."""
    order, known = _ordered_templates(sets, templates, percent)
    prefixes = _strings(sorted({w for t in known for w in t["tokens"][:t["prefix"]]}))
    least = min(t["need"] for t in known)
    texts = sets.filter((F.size("has") >= least) & F.arrays_overlap("has", prefixes)).select("doc_id", F.array_intersect(_strings(order), "has").alias("has"))
    side = sets.sparkSession.createDataFrame([(w, t["label"], t["tokens"], t["need"], t["width"], i) for t in known for i, w in enumerate(t["tokens"][:t["prefix"]])], "token string, label string, tokens array<string>, need int, width int, place int")
    pairs = texts.withColumn("token", F.explode(F.array_intersect("has", prefixes))).join(F.broadcast(side), "token")
    # a pair stands at its first shared prefix token only; array_position counts from 1
    pairs = pairs.filter("size(has) >= need AND NOT exists(slice(tokens, 1, place), x -> array_contains(has, x))")
    if positional:
        pairs = pairs.filter("least(size(tokens) - place, size(has) - array_position(has, token) + 1) >= need")
    return pairs.select("doc_id", "has", "label", "tokens", "need", "width")


def similar_blocks(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, sets: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, start, end, containment): every block (words from 0, end exclusive) that holds at least ``percent`` of a template's distinct tokens.

    Of runs that overlap, the one that holds most counts, the first of equals; it begins and ends with a token of the template. No templates: no rows.
    ``sets``: the table of ``token_sets``, if there is one.
    """
    templates = TEMPLATES if templates is None else templates
    if not templates:
        return id_text(docs).select("doc_id", F.lit("").alias("label"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("containment")).limit(0)
    pairs = candidate_pairs(token_sets(docs, templates) if sets is None else sets, templates, percent).filter(F.size(F.array_intersect("tokens", "has")) >= F.col("need"))
    pairs = written(pairs.drop("has").dropDuplicates(["doc_id", "label"]), "license-pairs")
    pairs = with_ids(id_text(docs), pairs.select("doc_id"), "doc_id").select("doc_id", words(F.col("text")).alias("w")).join(pairs, "doc_id")
    # near: the last place of each token within a block's width, in order of places, so its size is what the block ending there holds
    places = "filter(transform(w, (x, i) -> named_struct('i', i, 't', x)), y -> array_contains(tokens, y.t))"
    near = "concat(filter(s.near, z -> z.t <> y.t AND z.i > y.i - width), array(y))"
    block = "array(named_struct('start', n[0].i, 'end', y.i + 1, 'shared', size(n)))"
    last = "get(s.got, size(s.got) - 1)"
    got = f"""CASE WHEN size(n) < need THEN s.got WHEN size(s.got) = 0 OR n[0].i >= {last}.end THEN concat(s.got, {block})
        WHEN size(n) > {last}.shared THEN concat(slice(s.got, 1, size(s.got) - 1), {block}) ELSE s.got END"""
    blocks = F.expr(f"""aggregate({places}, named_struct('near', CAST(array() AS array<struct<i: int, t: string>>), 'got', CAST(array() AS array<struct<start: int, end: int, shared: int>>)),
        (s, y) -> transform(array({near}), n -> named_struct('near', n, 'got', {got}))[0], s -> s.got)""")
    found = pairs.select("doc_id", "label", F.size("tokens").alias("all"), F.explode(blocks).alias("b"))
    return found.select("doc_id", "label", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"), (F.col("b.shared") / F.col("all")).alias("containment"))


def phrase_places(w: Column, phrases: dict[str, str]) -> Column:
    """Sorted array of (start, label): where the words of a phrase stand consecutively in the word array."""
    found = []
    for phrase, label in phrases.items():
        p = phrase.split(" ")
        here = F.filter(F.transform(w, lambda x, i: F.when((x == p[0]) & _follow(w, i, p), i)), lambda i: i.isNotNull())
        found.append(F.transform(F.when(F.array_contains(w, p[0]), here).otherwise(F.array().cast("array<int>")), _place(label)))
    return F.array_sort(F.concat(F.array().cast("array<struct<start:bigint,label:string>>"), *found))


def _place(label: str):
    return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))


def _follow(w: Column, i: Column, p: list[str]) -> Column:
    ok = F.lit(True)
    for k, x in enumerate(p[1:], 1):
        ok = ok & (F.get(w, i + k) == x)
    return F.coalesce(ok, F.lit(False))


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """doc_id, n_words, places (start, label of each phrase), blocks (of each label met: the most containment, number of blocks, first start, last end), one row per row of ``docs``.

    Null texts are empty: no words, no places. Blocks are runs of words, whatever the lines. Repeated doc_ids get the blocks of all their rows; empty
    tables give no rows; extra columns are ignored.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    sets = token_sets(docs, templates, phrases)
    met = similar_blocks(docs, templates, percent, sets).groupBy("doc_id", "label") \
        .agg(F.max("containment").alias("containment"), F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "containment", "n", "start", "end"))).alias("blocks"))
    return sets.drop("has").join(written(met, "blocks"), "doc_id", "left") \
        .withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<label:string,containment:double,n:bigint,start:bigint,end:bigint>>")))
