"""Licence scan with a positional index of licence words.

Texts become words (runs of ASCII letters and digits and of any other character beyond
ASCII; A-Z in lower case). Licence notices are kept as templates, and phrases that count
wherever they stand as templates that must agree whole. The index lists the places of
their words, each with the number of files that hold the word: the fewer, the higher its
IDF. A file ranks its licence words by that. It must hold all words of a template's
mandatory phrases, and those of at least t places where t must agree; of the m places whose
words it holds, an offset that reaches t misses at most m - t, so the rarest m - t + 1 hold
one that it hits. Only these are looked up: every hit gives the offset at which the template
would start in the file. There the other words are counted, and the template holds if enough
agree on the offset and the mandatory phrases stand in the words that it covers.

Only DataFrame functions are used. A file stays one row; nothing is shuffled but counts of
licence words.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import ref, text_of
from strikeline.plans.tables import settle

#: Characters that part words. A-Z count as letters here: they are lowered afterwards.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that give a label wherever they stand.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices: label, words, mandatory phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ["gnu lesser general public license", "version 3"]),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ["redistribution and use in source and binary forms", "neither the name of"]),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "conditions are met"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
]


def words_line(text: Column) -> Column:
    """The words of a text in lower case, one space between them.

    ``lower`` also changes letters beyond ASCII, which no licence word has; the two that
    would turn into ASCII letters are replaced first.
    """
    plain = F.replace(F.replace(text, F.lit("K"), F.lit("κ")), F.lit("İ"), F.lit("ı"))
    return F.lower(F.trim(F.regexp_replace(plain, GAPS, " ")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; lambdas inside would evaluate an expression for every element."""
    return F.transform(F.array(value), body)[0]


def index_of(notices: list[tuple[list[str], float | None]], files_with: dict[str, int]) -> list[tuple[int, list[tuple[str, int]]]]:
    """Per notice (words, share that must agree) the least agreeing places and its postings, rarest word first.

    Words that no file holds cannot be hit and do not count. Without a share the whole notice must agree, these words too.
    """
    out = []
    for words, agree in notices:
        postings = sorted(((w, i) for i, w in enumerate(words) if w in files_with), key=lambda x: (files_with[x[0]], x))
        out.append((len(words) if agree is None else math.ceil(max(1.0, agree * len(postings))), postings))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str, list[str]]] | None = None, agree: float = 0.6) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: one row per document.

    Each file is looked up by its rarest licence words, as many as decide every template. A template is a candidate where the words at one offset agree on at least ``agree`` of its
    places that could be hit. ``score`` is 1 with a base label, else the best such share among the labels given, else 0.

    Null text is empty: no words, no labels (empty strings), null first and last word. Repeated rows and null ids
    are kept. Other columns are not read. Without rows the result is empty.
    """
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    notices = [*[(label, t.split(), phrases, agree) for label, t, phrases in templates], *[(label, p.split(), [], None) for p, label in base.items()]]
    known = sorted({w for _, words, phrases, _ in notices for w in [*words, *" ".join(phrases).split()]})
    lines = docs.select(ref(id_col).alias("doc_id"), words_line(text_of(text_col)).alias("line"))
    split = F.split("line", " ")
    own = F.array_intersect(split, F.array(*map(F.lit, known)))
    files_with = {r.w: r.n for r in lines.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per licence word

    empty = {"asks": F.array().cast("array<struct<k:int,w:string,place:int>>"), "found": F.array().cast("array<struct<k:int,start:int,n:int>>")}
    postings = index_of([(words, share) for _, words, _, share in notices], files_with)

    def must(words: list[str], phrases: list[str], share: float | None) -> list[str]:
        """Words without which a notice cannot hold, rarest first."""
        return sorted(set(words if share is None else " ".join(phrases).split()), key=lambda w: (files_with.get(w, 0), w))

    items = [F.struct(F.lit(k).alias("k"), F.lit(need).alias("need"), F.lit(len(words)).alias("span"), F.array(*[F.lit(f" {p} ") for p in phrases]).cast("array<string>").alias("phrases"), F.array(*map(F.lit, must(words, phrases, share))).cast("array<string>").alias("must"), F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("place")) for w, i in at]).alias("at"))
             for k, ((need, at), (_, words, phrases, share)) in enumerate(zip(postings, notices)) if at]
    index = F.array(*items)

    def asked(have: Column) -> Column:
        """Postings to look up: of every notice that the file's words can reach, the rarest, until it is decided."""
        possible = F.filter(index, lambda t: F.forall(t["must"], lambda w: F.array_contains(have, w)))
        held = F.transform(possible, lambda t: F.struct(t["k"].alias("k"), t["need"].alias("need"), F.filter(t["at"], lambda x: F.array_contains(have, x["w"])).alias("at")))
        within = F.filter(held, lambda t: F.size(t["at"]) >= t["need"])
        return F.flatten(F.transform(within, lambda t: F.transform(F.slice(t["at"], F.lit(1), F.size(t["at"]) - t["need"] + 1), lambda x: F.struct(t["k"].alias("k"), x["w"].alias("w"), x["place"].alias("place")))))

    # The words stay only for files that have something to look up. They are written first.
    n_words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    files = lines.select("doc_id", n_words.cast("long").alias("n_words"), "line", (let(own, asked) if items else empty["asks"]).alias("asks"))
    files = settle(files.select("doc_id", "n_words", F.when(F.size("asks") > 0, split).alias("words"), F.when(F.size("asks") > 0, F.col("asks")).alias("asks"), F.array_distinct("asks.w").alias("sought")), "files")

    # An offset of a notice is one long, since structs are made distinct pair by pair.
    low = F.lit(1 << 31)
    code = lambda a, h: F.shiftleft(a["k"].cast("long"), 32) + h["i"] - a["place"] + low
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains("sought", h["w"]))
    offsets = let(hits, lambda hs: F.array_distinct(F.flatten(F.transform("asks", lambda a: F.transform(F.filter(hs, lambda h: h["w"] == a["w"]), lambda h: code(a, h))))))
    by_k = F.map_from_entries(F.transform(index, lambda t: F.struct(t["k"], t)))

    def counted(c: Column) -> Column:
        k, start = F.shiftright(c, 32).cast("int"), (F.pmod(c, F.lit(1 << 32)) - low).cast("int")
        agreeing = F.filter(by_k[k]["at"], lambda x: F.get("words", start + x["place"]) == x["w"])
        return F.struct(k.alias("k"), start.alias("start"), F.size(agreeing).alias("n"))

    def holds(x: Column) -> Column:
        covered = F.concat(F.lit(" "), F.array_join(F.slice("words", F.greatest(x["start"], F.lit(0)) + 1, by_k[x["k"]]["span"] + F.least(x["start"], F.lit(0))), " "), F.lit(" "))
        return (x["n"] >= by_k[x["k"]]["need"]) & let(covered, lambda text: F.forall(by_k[x["k"]]["phrases"], lambda p: F.contains(text, p)))

    found = F.filter(F.transform(offsets, counted), holds) if items else empty["found"]
    marked = settle(files.select("doc_id", "n_words", F.when(F.col("asks").isNotNull(), found).alias("found")), "found").withColumn("found", F.coalesce("found", empty["found"]))

    first = len(templates)  # the base phrases come last
    names = F.array(*[F.lit(label) for label, *_ in notices]).cast("array<string>")
    reach = F.array(*[F.lit(len(at)) for _, at in postings]).cast("array<int>")
    labels = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: names[x["k"]]))), ",")
    based = F.filter("found", lambda x: x["k"] >= first)
    starts = F.transform(based, lambda x: x["start"])
    return marked.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(based).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: F.least(F.lit(1.0), x["n"] / reach[x["k"]]))), F.lit(0.0))).cast("double").alias("score"),
    )
