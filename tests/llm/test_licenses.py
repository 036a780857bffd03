"""Licence phrases against a plain search; templates by rare words."""

import re

from helpers import ODD, docs_frame, prose

from strikeline.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for p, label in licenses.BASE.items():
        q = p.split()
        at = [i for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    *ODD, "Released under the MIT License.", "under the mit license under the mit license", "CC BY-NC, cc_by_nc cc by NC cc by nc 4.0", "under the MIT Lİcense under the mit licenſe under the mit ʟicense",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "license version of nothing, public domain general", "under the\x00mit\nlicense",
]


def test_base_columns_match_a_plain_search(spark):
    filler = [" ".join(prose(50, i)) for i in range(150)]
    texts = [*TEXTS, *filler]
    got = licenses.scan(docs_frame(spark, texts, clashes=True)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [plain(t) for t in texts]
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    named = {t: r.labels for r, t in zip(got, texts)}
    assert named["This work is licensed under the GNU General Public License, version 3."] == "gpl-3"
    assert named["license version of nothing, public domain general"] == ""


def test_templates_hold_with_some_words_changed_but_not_without_their_phrases(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"
    texts = [isc, isc.replace("hereby", "gladly"), isc.replace("distribute this software", "distribute that software"), *[" ".join(prose(50, i)) for i in range(60)]]
    got = licenses.scan(docs_frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in got[:4]] == ["isc", "isc", "", ""]
    assert 0.6 <= got[1].score < got[0].score == 1.0


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = docs_frame(spark, ["Released under the MIT License."] * 3 + ["x"] * 30, [None, 7, 7, *range(10, 40)])
    assert licenses.scan(df).where("labels = 'mit'").count() == 3
    assert licenses.scan(df.limit(0)).count() == 0


def test_a_notice_in_every_document_is_labelled(spark):
    gpl = next(t for label, t, _ in licenses.TEMPLATES if label == "gpl-3")
    got = licenses.scan(docs_frame(spark, [f"{gpl} {' '.join(prose(20, i))}" for i in range(40)])).collect()
    assert {r.labels for r in got} == {"gpl-3"} and {r.score for r in got} == {1.0}


def test_a_file_with_many_licences_gets_every_label(spark):
    own = [(label, t) for label, t, phrases in licenses.TEMPLATES if label != "lgpl-3"]
    got = licenses.scan(docs_frame(spark, [" ".join(f"{t} xx{k}" for k, (_, t) in enumerate(own)), *[" ".join(prose(50, i)) for i in range(60)]])).orderBy("doc_id").first()
    assert got.labels.split(",") == sorted({label for label, _ in own})


def test_postings_are_ranked_by_files_and_words_that_no_file_holds_do_not_count():
    (need, at), (whole, rest) = licenses.index_of([("a b c a d".split(), 0.6), ("a d".split(), None)], {"a": 9, "b": 2, "c": 5})
    assert (need, [i for _, i in at]) == (3, [1, 2, 0, 3])
    assert whole == 2 > len(rest)


def test_rarest_first_gives_every_template_that_counting_all_words_gives(spark):
    import random

    rng, templates = random.Random(3), [("x", "a b c d e f a b", ["c d"]), ("y", "a b a b a", ["a b"]), ("z", "g h a", []), ("w", "g q q q", [])]
    texts = [" ".join(rng.choices("abcdefgh", [9, 6, 3, 2, 2, 2, 1, 1], k=rng.randrange(30))) for _ in range(150)]
    seen = {w for t in texts for w in t.split()}

    def expected(text):
        words, best = text.split(), {}
        for label, t, phrases in templates:
            t, reach = t.split(), sum(w in seen for w in t.split())
            for start in range(-len(t), len(words)):
                n = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t))
                covered = " " + " ".join(words[max(start, 0) : start + len(t)]) + " "
                if n >= max(1.0, 0.6 * reach) and all(f" {p} " in covered for p in phrases):
                    best[label] = max(best.get(label, 0), min(1.0, n / reach))
        return ",".join(sorted(best)), max(best.values(), default=0.0)

    got = licenses.scan(docs_frame(spark, texts), base={"a b a": "u"}, templates=templates).orderBy("doc_id").collect()
    base = [sum(t.split()[i : i + 3] == ["a", "b", "a"] for i in range(30)) for t in texts]
    assert [r.n_base for r in got] == base
    assert [(",".join(x for x in r.labels.split(",") if x != "u"), r.score) for r in got] == [(e[0], 1.0 if n else e[1]) for e, n in zip(map(expected, texts), base)]
