"""Spelling variants against all pairs of words in plain Python."""

import random
import zlib
from collections import Counter

import pytest
import regex
from helpers import ODD, docs_frame

from strikeline.llm import spelling


def plain_words(rows, slips, least=3):
    counts = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, ratio=2):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long") if words else spark.createDataFrame([], "word string, n long")


@pytest.mark.parametrize("letters,size,list_size", [("ab", 400, 512), ("ab", 400, 3), ("abcdé", 600, 512), ("abcdé", 600, 2), ("a", 30, 1), ("xyzÿàbc", 500, 1)])
def test_words_of_few_letters_lose_no_pair(spark, letters, size, list_size):
    rng = random.Random(len(letters) * size + list_size)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))): rng.randint(3, 400) for _ in range(size)}
    words |= {w * k: 7 for w in letters for k in range(5, 12)}
    assert got(spelling.variants(frame(spark, words), list_size=list_size)) == plain_variants(words)


def test_edits_of_long_words_at_every_place(spark):
    rng, words = random.Random(3), {}
    for k in range(12):
        w = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(5, 16)))
        words[w] = 1000 + k
        for i in range(len(w)):
            words.setdefault(w[:i] + w[i + 1 :], 40) if len(w) > 5 else None
            words.setdefault(w[:i] + "z" + w[i:], 30)
            words.setdefault(w[:i] + "q" + w[i + 1 :], 20)
        words.setdefault(w + "x", 10)
    want = plain_variants(words)
    assert got(spelling.variants(frame(spark, words))) == want
    assert got(spelling.variants(frame(spark, words), list_size=4)) == want


def test_chains_of_forms_and_ties(spark):
    chain = {"a" * 5 + "bcdefghijklm"[:k]: 3 * 2**k for k in range(13)}
    words = chain | {"zzzzzq": 4, "zzzzza": 8, "zzzzzb": 8, "lonely": 3}
    want = plain_variants(words)
    assert want["aaaaa"][1] == "aaaaabcdefghijklm" and want["zzzzzq"][0] == "zzzzza"
    assert got(spelling.variants(frame(spark, words))) == want


def test_pivots_are_disjoint_and_of_least_count():
    rng = random.Random(9)
    for _ in range(2000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(5, 12)))
        counts = {a + b: rng.randint(1, 9) for a in "abcd" for b in "abcd"}
        prefix, pivots, last = spelling.prefix_and_pivots(w, counts)
        grams = spelling.grams_of(w)
        assert len(prefix) >= 3 and abs(pivots[0] - pivots[1]) >= 2
        cost = lambda p: sum(counts[grams[i]] for i in p)
        assert cost(pivots) == min(cost((i, j)) for i in prefix for j in prefix if j - i >= 2)
        assert all((counts[grams[i]], grams[i]) <= last for i in prefix) and all((counts[g], g) >= last for k, g in enumerate(grams) if k not in prefix)


def test_whole_texts_repeated_rows_nulls_and_clashing_names(spark):
    rng = random.Random(21)
    base = ["hello", "World", "straße", "Àéîõü", "naïveté", "spelling", "×÷×÷×÷"]
    texts = [*ODD, *[" ".join(rng.choice(base) for _ in range(60)) + "1x" for _ in range(40)], "spelling " * 50, "spelling " * 50, "helloĀworld helloĀworld helloĀworld"]
    ids = [None if k % 9 == 0 else k // 2 for k in range(len(texts))]
    df = docs_frame(spark, texts, ids, clashes=True)
    for slips in (0, 3):
        words = plain_words(zip(ids, texts), slips)
        assert got(spelling.spelling_variants(df, slips=slips)) == plain_variants(words)


def test_a_text_of_one_long_run_and_no_rows(spark):
    a, b = "a" * 2_000_000, "a" * 1_999_999
    df = docs_frame(spark, [a] * 7 + [b] * 3 + ["short words here"])
    assert got(spelling.spelling_variants(df)) == {a: (None, a, 7, 1, None), b: (a, a, 3, 1, 7)}
    assert got(spelling.spelling_variants(df.limit(0))) == {}


def test_words_around_the_length_at_which_hashes_take_over(spark):
    rng, words = random.Random(8), {}
    for n in (62, 63, 64, 65, 66, 200):
        for k in range(3):
            w = "".join(rng.choice("abé") for _ in range(n))
            i = rng.randrange(n)
            words |= {w: 100, w[:i] + w[i + 1 :]: 9, w[:i] + "z" + w[i:]: 8, w[:i] + "z" + w[i + 1 :]: 7, w[:-1] + "ÿ": 30, w[1:]: 3, "q" + w[2:]: 4}
    assert got(spelling.variants(frame(spark, words))) == plain_variants(words)


def test_a_list_that_a_third_of_all_words_share_makes_no_pairs_of_all(spark):
    """Words that share their rarest bigrams at one place: rows grow with words times letters, not with their square."""
    rng = random.Random(5)
    words = {"qz" + "".join(rng.choice("abcdefghijkl") for _ in range(6)): 3 for _ in range(3000)}
    words |= {"qzabcdefgh": 90, "qzabcdefg": 30}
    sample = rng.sample(sorted(words), 40) + ["qzabcdefgh", "qzabcdefg"]
    out = got(spelling.variants(frame(spark, words), list_size=16))
    for w in sample:
        assert out[w][3] == sum(one_apart(w, x) for x in words)


def test_tasks_send_counts_on_when_they_hold_many(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    df = docs_frame(spark, ["alpha bravo charlie delta alpha bravo alpha"] * 3)
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == {"alpha": 9, "bravo": 6, "charlie": 3, "delta": 3}
