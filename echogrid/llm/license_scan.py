"""Licence scan by a positional rare-token index (operator 4).

Templates are base phrases and standard notices. One scan of the texts keeps each file's licence
words (words of any template) with their places; nothing else of a text can match, so the texts
are not read again. The words' document frequencies over the whole table give their inverse
document frequency. A template is posted under the ``RARE`` rarest words that must stand (of a
notice, of its mandatory key phrase) with their places in it; as these words must all be there,
no edit elsewhere can hide a notice. A file is looked up by those of its words that are some
template's rarest; every place of one gives a start of the template, the other postings of the
template are intersected with it by relative position, the key phrase is verified, and the
template's words are compared at their places. A base phrase counts where all its words stand; a
notice gives its label if its key phrase stands whole and at least ``SHARE`` of its words do. The
score is the best share of any place whose key phrase stands. DataFrame functions only; the
templates are a fixed, small list, so their frequencies fit the driver.

Rows: a null text is an empty one, without words. Repeated ids and rows keep their rows. Equal
rarities go to the word that stands first. Long texts cost in proportion to their words: a place
looks at no more words than its template has. Other columns, whatever their names, are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import LOWER, UPPER, id_text
from echogrid.shared import materialize

NOT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.8
#: Postings of a template that are intersected.
RARE = 3
#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Words of a notice, its mandatory key phrase, its label. First one-line notices, then standard headers and grants.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", "mit"),
    ("released under the mit license", "mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    ("it under the terms of the gnu general public license version 2 as published by", "gnu general public license version 2", "gpl-2"),
    ("under the terms of the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the "
        "following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "deal in the software without restriction",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law or agreed to in writing",
        "apache-2",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions in binary form must reproduce the above copyright notice",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee",
        "isc",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at "
        "your option any later version",
        "gnu general public license as published by the free software foundation either version 3",
        "gpl-3",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at "
        "your option any later version",
        "gnu general public license as published by the free software foundation either version 2",
        "gpl-2",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "if a copy of the mpl was not distributed with this file",
        "mpl-2",
    ),
    (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "unlicense",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to "
        "use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "alter it and redistribute it freely",
        "zlib",
    ),
)
#: Words of a template, its mandatory words, their place in it, its label.
TEMPLATES = tuple((t.split(), k.split(), next(i for i in range(len(t.split())) if t.split()[i : i + len(k.split())] == k.split()), label) for t, k, label in (*((t, t, label) for t, label in BASE), *NOTICES))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({NOT_WORD})"), F.lit(1))


def vocabulary() -> list[str]:
    return sorted({w for t, *_ in TEMPLATES for w in t})


def licence_words(docs: DataFrame) -> DataFrame:
    """``doc_id, n, v, hits``: number of words, distinct licence words and all licence words with places."""
    vocab = vocabulary()
    every = id_text(docs).select("doc_id", words(F.col("text")).alias("w"))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda p: F.get("w", p).isin(vocab))
    # The sequence of no words would run backwards.
    found = every.select("doc_id", "w", F.size("w").alias("n"), F.when(F.size("w") > 0, places).otherwise(F.array().cast("array<int>")).alias("p"))
    hits = F.transform("p", lambda p: F.struct(p.alias("p"), F.get("w", p).alias("w")))
    return found.select("doc_id", "n", F.array_intersect("w", F.array(*map(F.lit, vocab))).alias("v"), hits.alias("hits"))


def document_frequencies(found: DataFrame) -> dict[str, int]:
    """How many documents hold each licence word."""
    return {r.word: r.n for r in found.select(F.explode("v").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def postings(df: dict[str, int]) -> list[list[tuple[int, str]]]:
    """Of each template the places and words of its mandatory words of highest IDF, the rarest first."""
    return [[(i, t[i]) for i in sorted(range(at, at + len(k)), key=lambda i: (df.get(t[i], 0), i))[:RARE]] for t, k, at, _ in TEMPLATES]


def literal(w: list[str]) -> Column:
    return F.array(*map(F.lit, w))


def starts(template: tuple, posted: list[tuple[int, str]]) -> Column:
    """``array<struct<s, same>>``: starts of a template whose mandatory words stand, and how many of all its words do."""
    t, key, key_at, _ = template
    (at, word), others = posted[0], posted[1:]
    begin = lambda k: F.get("hits", k)["p"] - at
    # A template of n words covers at most n hits, those beside its rarest word.
    near = lambda k: F.sequence(F.greatest(k - at, F.lit(0)), F.least(k - at + len(t), F.size("hits")) - 1)
    around = lambda k: F.transform(near(k), lambda j: F.get("hits", j))

    def same(x: Column, w: list[str], first: int) -> Column:
        listed = literal(w)
        return F.size(F.filter(x["c"], lambda h: F.get(listed, h["p"] - x["s"] - first) == h["w"]))

    def stands(x: Column, off: int, other: str) -> Column:
        return F.exists(x["c"], lambda h: (h["w"] == other) & (h["p"] == x["s"] + off))

    def intersected(x: Column) -> Column:
        there = (x["s"] >= 0) & (x["s"] + len(t) <= F.col("n"))
        for off, other in others:
            there = there & stands(x, off, other)
        return there

    candidates = F.transform(F.filter("look", lambda k: F.get("hits", k)["w"] == word), lambda k: F.struct(begin(k).alias("s"), around(k).alias("c")))
    verified = F.filter(F.filter(candidates, intersected), lambda x: same(x, key, key_at) == len(key))
    return F.transform(verified, lambda x: F.struct(x["s"].alias("s"), same(x, t, 0).alias("same")))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; label columns are arrays."""
    found = materialize(licence_words(docs), "licence-words")
    posted = postings(document_frequencies(found))
    rarest = sorted({p[0][1] for p in posted})
    # Files without any template's rarest word need no look: nearly all of them.
    look = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda k: F.get("hits", k)["w"].isin(rarest))
    looked = found.withColumn("look", F.when(F.arrays_overlap("v", literal(rarest)), look))
    names = [f"t{k}" for k in range(len(TEMPLATES))]
    places = looked.select("doc_id", "n", *(F.when(F.col("look").isNotNull(), starts(t, p)).alias(c) for t, p, c in zip(TEMPLATES, posted, names, strict=True)))
    base, notices = names[: len(BASE)], names[len(BASE) :]
    every = F.concat(*(F.coalesce(F.col(c)["s"], F.array().cast("array<int>")) for c in base))
    best = [F.array_max(F.col(c)["same"]) / F.lit(len(t[0])) for c, t in zip(notices, TEMPLATES[len(BASE) :], strict=True)]
    base_labels = F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(base, BASE, strict=True)))
    more = F.array(*(F.when(s >= SHARE, F.lit(t[-1])) for s, t in zip(best, TEMPLATES[len(BASE) :], strict=True)))
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull())))
    score = F.greatest(F.when(F.size(every) > 0, 1.0).otherwise(0.0), *(F.coalesce(s, F.lit(0.0)) for s in best))
    return places.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        tidy(base_labels).alias("base_labels"),
        tidy(F.concat(base_labels, more)).alias("labels"),
        score.alias("score"),
    )


def flat(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def sql() -> str:
    """The same by votes of all words of all templates at all places, without an index."""
    low = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}')"
    listed = ", ".join(f"({k}, {len(t)}, {len(key)}, {i}, '{x}', {at <= i < at + len(key)}, '{label}', {k < len(BASE)})" for k, (t, key, at, label) in enumerate(TEMPLATES) for i, x in enumerate(t))
    named = lambda test: f"array_to_string(coalesce(list_sort(list(DISTINCT label) FILTER ({test})), []), ',')"
    return f"""WITH t(k, n, must, j, x, keyed, label, base) AS (VALUES {listed}),
d AS (SELECT *, len(w) AS size FROM (SELECT row_number() OVER () AS r, doc_id, {low} AS w FROM documents)),
p AS (SELECT r, size, unnest(w) AS x, unnest(range(0, size)) AS i FROM d),
v AS (SELECT r, k, i - j AS s, base, label, n, count(*) / n AS share FROM p JOIN t USING (x) WHERE i >= j AND i - j + n <= size
  GROUP BY r, k, i - j, base, label, n, must HAVING count(*) FILTER (keyed) = must),
h AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, {named("base")} AS base_labels, {named(f"base OR share >= {SHARE}")} AS labels, max(share) AS score FROM v GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN h USING (r)"""
