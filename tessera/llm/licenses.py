"""Licence scan by a positional index of rare template words."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.core import let

#: Phrases that always give their label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """Words of a usual notice and the key phrase, a part of them, that must stand complete."""

    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> range:
        key, words = self.key.split(), self.words
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        return range(at, at + len(key))


#: Openings of usual licence notices.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "use in source and binary forms"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII characters that are no letter or digit.

    Two letters whose lower case is ASCII although they are not (the Kelvin sign, the dotted capital I) are put out of the way first,
    so that only A-Z become a-z.
    """
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(kept), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def word_weights(docs: DataFrame, words: Column, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of the template words over all documents."""
    inside = F.array_intersect(words, _table(vocabulary, "string"))
    counts = docs.select(F.explode(F.concat(inside, F.array(F.lit(""))))).groupBy("col").count()
    seen = {r["col"]: r["count"] for r in counts.collect()}
    total = seen.get("", 0)
    return {w: 1 + math.log((1 + total) / (1 + seen.get(w, 0))) for w in vocabulary}


def _at(i: Column) -> Column:
    return F.get("_words", i)


def _table(rows: list, ddl: str) -> Column:
    """A constant array of parameters; the plan holds it once, whatever its length."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{ddl}>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
                  phrases: tuple[tuple[str, str], ...] = PHRASES, anchors: int = 3, share: float = 0.7) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    Index: the ``anchors`` rarest words of each template over all documents, from the rarest on, each with its postings (template, place in it); words that a
    template holds more than once come after its others and count at their first place. A file's rarest index words are its own words in the
    order of the index; all of them are looked up. The postings, moved back by their places, are sorted, so that places of one
    template on which two different words agree stand side by side; there the template is laid over the text (one word is
    enough for a template of one word). It gives its label if its key phrase stands there complete and the matched words carry at least ``share`` of
    its weight (inverse document frequency). ``score`` is the best such share, 0 without one. ``n_base``, ``first_word`` and ``last_word`` are the number of
    places of ``phrases`` and their smallest and largest word number.

    All of it is one row at a time after a first pass that counts the template words; the plan does not grow with the templates. A null or empty text has no words,
    empty labels and null places; a very long one is one row's work. Repeated rows stay; other columns are ignored; an empty table gives an
    empty result. Places of one phrase never tie, equal shares of several templates give all their labels.
    """
    if anchors < 1:
        raise ValueError("at least one anchor is needed")
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words"))
    weight = word_weights(docs.select(F.col(text_col).alias("_text")), words_of(F.col("_text")), vocabulary)
    rare = [sorted(set(t.words), key=lambda w: (t.words.count(w) > 1, -weight[w], w))[:anchors] for t in templates]
    index: dict[str, list[dict]] = {}
    for n, (t, own) in enumerate(zip(templates, rare)):
        for w in own:
            index.setdefault(w, []).append({"t": n, "o": t.words.index(w)})
    order = sorted(index, key=lambda w: (-weight[w], w))
    # per template: its words and their weights, where its key begins and ends, how many words must agree
    facts = [{"w": t.words, "x": [weight[w] for w in t.words], "all": sum(weight[w] for w in t.words), "a": t.key_at.start, "b": len(t.key_at),
              "need": min(2, len(own)), "label": t.label} for t, own in zip(templates, rare)]
    known, postings = _table(order, "string"), _table([index[w] for w in order], "array<struct<t:int,o:int>>")
    facts = _table(facts, "struct<w:array<string>,x:array<double>,`all`:double,a:int,b:int,need:int,label:string>")
    lasts = sorted({p.split()[-1] for p, _ in phrases})
    looked = F.array_union(F.array_intersect(known, F.col("_words")), F.array_intersect(F.array(*map(F.lit, lasts)) if lasts else known, F.col("_words")))
    hit = F.transform("_words", lambda w, i: F.when(F.array_contains("_looked", w), F.struct(w.alias("w"), i.alias("i"))))
    found = rows.withColumn("_looked", looked).withColumn("_hits", F.when(F.size("_looked") > 0, F.filter(hit, lambda x: x.isNotNull())))

    def base(phrase: str) -> Column:
        words = phrase.split()

        def stands(o: Column) -> Column:
            out = o >= 0
            for n, w in enumerate(words[:-1]):
                out = out & (_at(o + n) == w)
            return out

        places = F.transform(F.filter("_hits", lambda x: x["w"] == words[-1]), lambda x: x["i"] - (len(words) - 1))
        return F.filter(places, stands)

    def lookups(x: Column) -> Column:
        own = F.get(postings, (F.array_position(known, x["w"]) - 1).cast("int"))
        return F.transform(F.coalesce(own, F.expr("array()").cast("array<struct<t:int,o:int>>")), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["o"]).alias("s"), x["w"].alias("w")))

    def agreed(laid: Column) -> Column:
        """Places of a template that enough different words name: of sorted, different (template, place, word) those followed by the same place."""
        def next_too(x: Column, i: Column) -> Column:
            after = F.get(laid, i + 1)
            twice = F.coalesce((after["t"] == x["t"]) & (after["s"] == x["s"]), F.lit(False))
            return F.when(twice | (F.get(facts, x["t"])["need"] < 2), F.struct(x["t"].alias("t"), x["s"].alias("s")))
        return F.array_distinct(F.filter(F.transform(laid, next_too), lambda c: c.isNotNull()))

    def worth(c: Column) -> Column:
        def judged(fact: Column) -> Column:
            def measured(same: Column) -> Column:
                key = F.forall(F.slice(same, fact["a"] + 1, fact["b"]), lambda x: x)
                matched = F.aggregate(F.zip_with(same, fact["x"], lambda on, x: F.when(on, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
                return F.struct(fact["label"].alias("label"), F.when(key, F.least(F.lit(1.0), matched / fact["all"])).otherwise(0.0).alias("share"))
            same = F.transform(fact["w"], lambda w, i: (c["s"] + i >= 0) & F.coalesce(_at(c["s"] + i) == w, F.lit(False)))
            return let(same, measured)
        return let(F.get(facts, c["t"]), judged)

    empty = F.expr("array()").cast("array<int>")
    some = F.col("_hits").isNotNull()
    laid = let(F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lookups)))), agreed)
    given = F.filter(F.transform(laid, worth), lambda g: g["share"] >= share)
    bases = F.struct(*[F.coalesce(base(p), empty).alias(f"p{i}") for i, (p, _) in enumerate(phrases)])
    scored = found.select("_id", F.size("_words").cast("bigint").alias("n_words"), F.when(some, bases).alias("_b"), F.when(some, given).alias("_g"))
    every = F.coalesce(F.flatten(F.array(*[F.col(f"_b.p{i}") for i in range(len(phrases))])), empty)
    from_base = F.array_compact(F.array(*[F.when(F.size(f"_b.p{i}") > 0, label) for i, (_, label) in enumerate(phrases)]))
    from_all = F.coalesce(F.col("_g.label"), F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scored.select(F.col("_id").alias(id_col), "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
                         F.array_max(every).cast("bigint").alias("last_word"), joined(from_base).alias("base_labels"),
                         joined(F.concat(from_base, from_all)).alias("labels"), F.coalesce(F.array_max(F.col("_g.share")), F.lit(0.0)).alias("score"))
