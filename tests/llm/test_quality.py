"""Line-first rules against a plain count of everything that the definition names."""

import re

from helpers import ODD, docs_frame, prose

from strikeline.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 5))
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, r, n < 10 or 100 * r > 20 * n


def test_counts_match_the_definition(spark):
    repeated = " ".join(prose(30, 1)[:7] * 3 + prose(40, 2))
    texts = [*ODD[:8], *ODD[9:], repeated, "a b c d e f\na b c d e f\nx # * $ % & | < >", " ".join(prose(60, 3)), "ab " * 40, "\x1c\x1d a\u0085b   c"]
    got = quality.score_lines(docs_frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t), t
        assert not (r.kept and r.base_failed)


def test_lines_that_fail_go_and_documents_that_lose_much_are_rejected(spark):
    good = " ".join(prose(90, 4)).capitalize() + "."
    junk = "Home | About | Contact | Login | Help | FAQ | News | Blog | Shop | Cart"
    shout = "BUY!! NOW!! THE!! BEST!! DEAL!! EVER!! TODAY!! ONLY!! HERE!! YES!!"
    texts = [good, f"{good}\n{junk}", f"{good}\n{shout}\nmenu", f"{junk}\n{shout}\nRead more.", f"{good}\nAll rights reserved."]
    got = quality.keep_good(docs_frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 5]
    assert all(r.text == good and r.n_chars == len(good) for r in got)


def test_clashing_columns_repeated_rows_and_no_rows(spark):
    df = docs_frame(spark, ODD, [None, *range(1, len(ODD))], clashes=True)
    out = quality.score_lines(df)
    assert out.columns[: len(df.columns)] == df.columns and out.count() == len(ODD)
    assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(df.limit(0)).count() == 0
