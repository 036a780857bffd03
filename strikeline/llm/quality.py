"""Line-first cleaning: rules per line, then one decision per document.

Each line that has a word is judged alone:

* symbols: more than ``symbols_per_word`` of the characters ``#*$%&|<>`` a word;
* punctuation: more than half of four or more words end in an exclamation mark, or the
  line ends a short run of words (fewer than ``short_words``) without a closing mark;
* navigation: a short line made of menu words or of parts between ``>``, ``»``, ``/`` or ``·``;
* boilerplate: a short line that holds one of the fixed notice phrases.

Failing lines are taken out. A document whose failing lines hold more than
``most_lost`` of its words is rejected. Documents under ten words, or with more
than a fifth of their words in repeated five-word windows, are rejected first.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import fresh, map_rows, ref

WINDOW = 5
LONG = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "n_words_removed")
NOT_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")
#: Words of menus; a line made of nothing else is navigation.
MENU = frozenset("home about contact login logout register search menu next previous prev back top share tweet print help faq news blog shop cart sitemap subscribe more".split())
#: Phrases of notices that are not content.
NOTICES = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|javascript is (?:disabled|required)"
    rb"|lorem ipsum|click here|read more|sign up|log in|subscribe to our|share this|follow us|skip to (?:main )?content|powered by|page not found"
)
PARTS = re.compile(rb"\s(?:>|\xc2\xbb|/|\xc2\xb7|\xe2\x80\xba)\s")
CLOSING = (b".", b"!", b"?", b":", b";", b",", b'"', b"'", b")", b"]", "…".encode(), "”".encode(), "»".encode(), "。".encode(), "！".encode(), "？".encode())


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(known) + WINDOW > len(words):  # n windows repeat only where words do
        return 0
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    likely = np.flatnonzero(np.isin(key, twice)).tolist()  # equal keys may still be different windows
    windows = [tuple(words[i : i + WINDOW]) for i in likely]
    counts = Counter(windows)
    hit = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(likely, windows):
        if counts[w] > 1:
            hit[i] += 1
            hit[i + WINDOW if i + WINDOW < len(hit) else -1] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def line_fails(line: bytes, words: list[bytes], symbols_per_word: float, short_words: int) -> bool:
    n = len(words)
    if len(line.translate(None, NOT_SYMBOL)) > symbols_per_word * n:
        return True
    if b"!" in line and n >= 4 and 2 * sum(w.endswith(b"!") for w in words) > n:
        return True
    if n >= 3 * short_words:
        return False
    bare = line.strip(b" \t\n\r\x0b\x0c").lower()
    if n < short_words and not bare.endswith(CLOSING):
        return True
    if all(w.strip(b".,:;!?|>/") in _MENU_BYTES for w in bare.split()) or len(PARTS.findall(line)) * 3 >= n:
        return True
    return bool(NOTICES.search(bare))


_MENU_BYTES = frozenset(w.encode() for w in MENU) | {b""}


def measure(text: str | None, symbols_per_word: float, short_words: int) -> tuple[list[int], list[bytes]]:
    """The counts named in ``LONG`` and the lines that stay."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup = n_lines = gone = gone_words = 0
    stay: list[bytes] = []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            n_lines += 1
            dup += line in seen
            seen.add(line)
            if line_fails(line, own, symbols_per_word, short_words):
                gone += 1
                gone_words += len(own)
                continue
        stay.append(line)
    chars = sum(map(len, words)) - len(b"".join(words).translate(None, _NOT_CONTINUED))
    return [len(words), chars, len(raw.translate(None, NOT_SYMBOL)), dup, repeated_words(words), n_lines, gone, gone_words], stay


_NOT_CONTINUED = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def score_lines(docs: DataFrame, text_col: str = "text", symbols_per_word: float = 0.25, short_words: int = 4, most_lost: float = 0.3, base_words: int = 10, base_repeat: int = 20) -> DataFrame:
    """All rows and columns of ``docs`` plus counts, the verdict and the cleaned text.

    Added (renamed with a leading underscore where a column of that name exists):
    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_lines_removed, n_words_removed, base_failed, kept, clean_text``.

    Null text counts as empty: no words, base_failed, clean_text null. Repeated rows are
    judged each; a line that fails everywhere it stands is taken out everywhere.
    """
    names = fresh(docs, *LONG, "base_failed", "kept", "clean_text")
    fields = [T.StructField(n, T.LongType()) for n in names[: len(LONG)]] + [T.StructField(names[-3], T.BooleanType()), T.StructField(names[-2], T.BooleanType()), T.StructField(names[-1], T.StringType())]

    def run(texts: list[str | None]) -> dict[str, list]:
        cols: dict[str, list] = {n: [] for n in names}
        for text in texts:
            counts, stay = measure(text, symbols_per_word, short_words)
            n, repeat, gone = counts[0], counts[4], counts[7]
            failed = n < base_words or 100 * repeat > base_repeat * n
            values = [*counts, failed, not failed and gone <= most_lost * n, None if text is None else text if not counts[6] else b"\n".join(stay).decode("utf-8", "surrogatepass")]
            for name, v in zip(names, values):
                cols[name].append(v)
        import pyarrow as pa

        kinds = [pa.int64()] * len(LONG) + [pa.bool_(), pa.bool_(), pa.string()]
        return {n: pa.array(v, k) for (n, v), k in zip(cols.items(), kinds)}

    return map_rows(docs, run, fields, text_col)


def keep_good(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **rules) -> DataFrame:
    """Documents that pass, in their own columns, with the failing lines taken out of the text."""
    kept, clean = fresh(docs, "kept", "clean_text")
    out = score_lines(docs, text_col, **rules).where(ref(kept))
    swap = {text_col: ref(clean)} | ({chars_col: F.length(ref(clean)).cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return out.select(*[(swap[c] if c in swap else ref(c)).alias(c) for c in docs.columns])
