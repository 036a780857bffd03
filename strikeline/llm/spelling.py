"""Spelling variants of the words of a corpus by pivotal grams.

Two words at edit distance one share, of any two disjoint bigrams of one of them, at
least one at the same place, give or take one. Bigrams are ordered by the number of words
that hold them. A word's prefix is its three rarest bigrams with their places (and all
further places of the last of them); its pivots are the two disjoint bigrams of the prefix that the
fewest words hold, chosen by dynamic programming over the places. Where the prefix of
s does not reach further than that of r, a pivot of s that survives in r lies
in the prefix of r. So pivots look up prefixes of words whose prefix ends no earlier, by bigram, place and
length, and the few pairs found are verified.

A list (bigram, place, length) in which more than ``LIST`` squared pairs would meet is not
paired: its words are looked up by what is left of them without one letter, under which at
most one word per letter of the alphabet can meet. So no list grows into all pairs. Words
of more than ``LONG`` code points are always looked up in that way, by hashes of their rests.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import ref, text_of
from strikeline.plans.tables import settle

SHORTEST, LEAST = 5, 3  # code points of a word, and occurrences
HELD = 250_000  # distinct words counted in a task before they are sent on
LIST, LONG = 512, 64
MERSENNE, BASE = (1 << 61) - 1, 1_000_003  # of the polynomial hashes of rests
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # UTF-8 of a-z and U+00C0 to U+00FF


def words_of(text: bytes, row: bytes, slips: int) -> Iterator[tuple[str, int]]:
    """Words of a lower-cased text with their numbers; one in ``slips`` distinct runs loses a letter, by checksum of row and run."""
    for run, n in Counter(RUNS.findall(text)).items():
        h = zlib.crc32(run, zlib.crc32(row + b":"))
        word = run.decode()
        if slips and h % slips == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        if len(word) >= SHORTEST:
            yield word, n


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0, least: int = LEAST) -> DataFrame:
    """``word, n``: words of at least five code points and ``least`` occurrences in whole texts, counted in the tasks first."""

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in words_of(text.encode("utf-8", "surrogatepass").lower(), row.encode(), slips):
                    counts[word] += n
                if len(counts) > HELD:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    rows = docs.select(F.coalesce(ref(id_col).cast("string"), F.lit("")).alias("row"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def grams_of(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Number of words that hold each bigram: at most (letters of the alphabet)^2 entries, 8,100 for a-z and U+00C0 to U+00FF."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.array_distinct(F.transform(at, lambda i: F.col("word").substr(i, F.lit(2))))
    rows = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def prefix_and_pivots(word: str, counts: dict[str, int]) -> tuple[list[int], list[int], tuple[int, str]]:
    """Places of the prefix bigrams, places of the two pivots, and the order of the last bigram of the prefix."""
    grams = grams_of(word)
    order = sorted(range(len(grams)), key=lambda i: (counts[grams[i]], grams[i], i))
    last = grams[order[2]]
    prefix = sorted(order[:3] + [i for i in order[3:] if grams[i] == last])
    # cheapest pair of disjoint places: best single place so far two or more before this one
    best, pair, cost = None, None, None
    waiting = []
    for i in prefix:
        while waiting and waiting[0] <= i - 2:
            j = waiting.pop(0)
            if best is None or counts[grams[j]] < counts[grams[best]]:
                best = j
        if best is not None:
            c = counts[grams[best]] + counts[grams[i]]
            if cost is None or c < cost:
                pair, cost = (best, i), c
        waiting.append(i)
    return prefix, list(pair), (counts[last], last)


POSTING = "word string, pivot boolean, gram string, place int, size int, more int, last long, last_gram string"


def postings(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Prefix entries of every word, and its pivots at every place and length at which a word one edit away may have them.

    ``more``: letters that the other word has more than the pivot's.
    """
    shared = words.sparkSession.sparkContext.broadcast(counts)
    moves = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]  # letters more, and how far a bigram may move then

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for word in b.column(0).to_pylist():
                n = len(word)
                prefix, pivots, (last, gram) = prefix_and_pivots(word, counts)
                rows = [(False, word[i : i + 2], i, n, 0) for i in prefix]
                rows += [(True, word[i : i + 2], i + d, n + e, e) for i in pivots for e, d in moves if i + d >= 0]
                for r in rows:
                    for col, v in zip(out, (word, *r, last, gram)):
                        col.append(v)
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[f.split()[0] for f in POSTING.split(", ")])

    return words.select("word").mapInArrow(run, POSTING)


def _without_one(word: Column) -> Column:
    """What is left of a word without one letter, each with the letter's place."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word))))


def near_pairs(words: DataFrame, list_size: int = LIST) -> DataFrame:
    """``a, b``: all ordered pairs of words that differ by one inserted, deleted or replaced code point, each once."""
    usual = words.where(F.length("word") <= LONG)
    posted = settle(postings(usual, gram_counts(usual)), "postings")
    key = ["gram", "place", "size"]
    sizes = posted.groupBy(*key).agg(F.count_if("pivot").alias("k"), F.count_if(~F.col("pivot")).alias("m"))
    long_lists = settle(sizes.where((F.col("k") * F.col("m") > list_size * list_size)).select(*key), "lists")
    s = posted.where("pivot").select(*key, F.col("word").alias("s"), "more", "last", "last_gram")
    r = posted.where("NOT pivot").select(*key, F.col("word").alias("r"), F.col("last").alias("r_last"), F.col("last_gram").alias("r_last_gram"))
    reaches = (F.col("last") < F.col("r_last")) | ((F.col("last") == F.col("r_last")) & (F.col("last_gram") <= F.col("r_last_gram")))
    one = (F.col("s") != F.col("r")) & (F.call_function("levenshtein", F.col("s"), F.col("r"), F.lit(1)) == 1)
    if long_lists.isEmpty():
        found = s.join(r, key).where(reaches & one).select("s", "r")
    else:
        found = s.join(long_lists, key, "left_anti").join(r.join(long_lists, key, "left_anti"), key).where(reaches & one).select("s", "r")
        found = found.unionByName(_by_rest(s.join(long_lists, key, "left_semi"), r.join(long_lists, key, "left_semi")))
    found = found.unionByName(_long_pairs(words.where(F.length("word") >= LONG)))
    pairs = settle(found.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b")).distinct(), "pairs")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _by_rest(s: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs of two sets of words one edit apart, found by their rests without one letter: an equal rest at an equal
    place is a replacement, a rest equal to the other word a deletion. At most one word per letter has the same rest."""
    own = {n: x.select(n, *(["more"] if n == "s" else [])).distinct() for n, x in (("s", s), ("r", r))}
    rest = {n: x.select("*", F.posexplode(_without_one(F.col(n))).alias("at", "rest")) for n, x in own.items()}
    swapped = rest["s"].where("more = 0").join(rest["r"], ["at", "rest"])
    grown = own["s"].where("more = 1").join(rest["r"], F.col("s") == F.col("rest"))
    shrunk = rest["s"].where("more = -1").join(own["r"], F.col("rest") == F.col("r"))
    return swapped.select("s", "r").unionByName(grown.select("s", "r")).unionByName(shrunk.select("s", "r")).where("s != r")


def _long_pairs(words: DataFrame) -> DataFrame:
    """``s, r``: pairs of long words of which one or both, less a letter, have equal 61-bit hashes, verified at that place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ends = [0]  # hashes of what follows each place
                power = 1
                for c in reversed(word):
                    ends.append((ends[-1] + ord(c) * power) % MERSENNE)
                    power = power * BASE % MERSENNE
                ends.reverse()
                step, before, hashes = pow(BASE, -1, MERSENNE), 0, [ends[0]]
                weight = power * step % MERSENNE  # of the first letter of the word; of a rest, one power less
                for c, end in zip(word, ends[1:]):
                    hashes.append((before + end) % MERSENNE)
                    weight = weight * step % MERSENNE
                    before = (before + ord(c) * weight) % MERSENNE
                n = len(word)
                yield pa.RecordBatch.from_arrays([pa.array([key] * (n + 1), pa.int64()), pa.array([n] + [n - 1] * n, pa.int32()), pa.array(range(-1, n), pa.int32()), pa.array(hashes, pa.int64())], names=["key", "size", "at", "hash"])

    keyed = words.select("word", F.xxhash64("word").alias("key"))
    rests = settle(keyed.mapInArrow(run, "key long, size int, at int, hash long"), "rests")
    whole = rests.where("at < 0").select("size", "hash", F.col("key").alias("s_key"))
    cut = rests.where("at >= 0")
    swapped = cut.select("size", "hash", "at", F.col("key").alias("s_key")).join(cut.select("size", "hash", "at", F.col("key").alias("r_key")), ["size", "hash", "at"]).where("s_key < r_key")
    grown = whole.join(cut.select("size", "hash", "at", F.col("key").alias("r_key")), ["size", "hash"])
    keys = swapped.select("s_key", "r_key", "at", F.lit(True).alias("both")).unionByName(grown.select("s_key", "r_key", "at", F.lit(False).alias("both")))
    keys = keys.groupBy("s_key", "r_key", "both").agg(F.min("at").alias("at"))
    named = {n: keyed.select(F.col("word").alias(n), F.col("key").alias(f"{n}_key")) for n in "sr"}
    rest = {n: F.concat(F.col(n).substr(F.lit(1), F.col("at")), F.col(n).substr(F.col("at") + 2, F.length(n))) for n in "sr"}
    same = (F.col("s") != F.col("r")) & (F.when(F.col("both"), rest["s"]).otherwise(F.col("s")) == rest["r"])
    return keys.join(named["s"], "s_key").join(named["r"], "r_key").where(same).select("s", "r")


def variants(words: DataFrame, ratio: int = 2, list_size: int = LIST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n`` (distinct words of at least five code points).

    ``form`` is the near word of largest ``n`` (of equals the first in code-point order), if it has
    ``ratio`` times the word's own at least; ``root`` is the end of the chain of forms, the word
    itself where there is none. Chains rise by the ratio, so they end.
    """
    near = near_pairs(words, list_size).join(words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("b"))).alias("top"))
    top_n = -F.col("top.less")
    fits = top_n >= ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("top.b")).alias("form"), F.when(fits, top_n).alias("form_n"))
    found = settle(found, "forms")
    # each round doubles the reach of a link, so the rounds are the logarithm of the longest chain
    links = settle(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "chains")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(further, "root", "left_semi").isEmpty():
            break
        links = settle(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "chains")
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0, least: int = LEAST) -> DataFrame:
    """Every word of the corpus with its near words counted, its form and its root.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z in lower case, of at least five code points
    and ``least`` occurrences in all rows. ``slips`` > 0 plants errors: of the distinct runs of a row, one in so many
    loses a letter. Null texts have no words, null ids count as an empty id, repeated rows count each. Other columns
    are not read. Without words the result is empty.
    """
    return variants(settle(count_words(docs, id_col, text_col, slips, least), "words"))
