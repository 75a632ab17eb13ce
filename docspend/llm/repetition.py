"""Quality rules with suffix-array repetition.

For each text: the basic counts, and a suffix array over its words.  Sorting the suffixes brings
equal beginnings together; the longest-common-prefix value between neighbours bounds an interval
of suffixes that share a maximal repeated substring.  A word is covered if it lies in a repeat of
at least MIN_WORDS words.  A text passes if the covered part of its characters and its longest
repeat are within limits, and the basic rules hold.

The suffix arrays of many texts are built together by prefix doubling: ranks start from (text,
word), so suffixes of different texts never meet, and only suffixes that still share a rank with
another are sorted again.

Defined cases: a null text has no words; a text without words fails the basic rule; line ends are
\\n only; rows that repeat are measured each; broken UTF-8 is read as U+FFFD; no rows give no rows;
other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspend.llm.bytesops import SpanHash, chunked, code_points, span_ids, string_bytes, sums, words
from docspend.llm.common import clean_text
from docspend.shipping import ship

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: The method's own limits: repeats count from this many words; share of word characters in them;
#: longest repeat, as a share of the words and as a number below which it is never held against a text.
MIN_WORDS, MOST_COVERED, LONGEST_SHARE, LONGEST_FREE = 4, 0.40, 0.25, 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered double, longest_repeat long"


def longest_repeats(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs elsewhere in its text too.

    word: a number for each word, equal for equal words only; bounds: the n+1 bounds of the texts.
    """
    m = len(word)
    out = np.zeros(m, np.int64)
    if m == 0:
        return out
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][text]
    order = np.lexsort((word, text))
    fresh = np.append(True, (word[order][1:] != word[order][:-1]) | (text[order][1:] != text[order][:-1]))
    rank = np.empty(m, np.int64)
    head = np.flatnonzero(fresh)
    rank[order] = np.repeat(head, np.diff(np.append(head, m)))
    suffixes, levels, h = order, [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=m)
        at = np.flatnonzero(size[rank[suffixes]] > 1)  # places of suffixes that are not alone yet
        if not len(at):
            break
        i = suffixes[at]
        beyond = i + h
        after = np.where(beyond < end[i], rank[np.minimum(beyond, m - 1)] + 1, 0)
        turn = np.lexsort((after, rank[i]))
        i, after, own = i[turn], after[turn], rank[i][turn]
        suffixes = suffixes.copy()
        suffixes[at] = i
        fresh = np.append(True, (own[1:] != own[:-1]) | (after[1:] != after[:-1]))
        head = np.flatnonzero(fresh)
        rank = rank.copy()
        rank[i] = np.repeat(at[head], np.diff(np.append(head, len(i))))
        levels.append(rank.astype(np.int32))
        h *= 2
    # longest common prefix of neighbours, from the largest power of two down
    near = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    a, b = suffixes[near], suffixes[near + 1]
    x, y, common = a.copy(), b.copy(), np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        same = (x < end[a]) & (y < end[b])
        same[same] = level[x[same]] == level[y[same]]
        step = same * (1 << k)
        x, y, common = x + step, y + step, common + step
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """The words in a repeat of at least `least` words."""
    starts = np.flatnonzero(lengths >= least)
    change = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths[starts], -1)
    return np.cumsum(change[:-1]) > 0


def measured(data: np.ndarray, offsets: np.ndarray, span: SpanHash) -> dict[str, np.ndarray]:
    """The columns of OUT but doc_id for the texts of a chunk of bytes."""
    n = len(offsets) - 1
    starts, ends, bounds = words(data, offsets)
    n_words = np.diff(bounds)
    chars = code_points(data, starts, ends)
    lengths = longest_repeats(span_ids(data, starts, ends, span)[0], bounds)
    # lines: each text ends one, each \n another
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_text = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(breaks, offsets)))
    line_ends = np.append(line_starts[1:], len(data))
    inner = np.append(line_text[1:] == line_text[:-1], False)
    line_ends = np.where(inner, line_ends - 1, offsets[1:][line_text])
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    h, t = span_ids(data, line_starts[filled], line_ends[filled], span)[0], line_text[filled]
    order = np.lexsort((h, t))
    again = (h[order][1:] == h[order][:-1]) & (t[order][1:] == t[order][:-1])
    dup_lines = np.bincount(t[order][1:][again], minlength=n)
    repeat_words = sums(covered(lengths, WINDOW), bounds)
    word_chars = sums(chars, bounds)
    in_repeats = sums(chars * covered(lengths, MIN_WORDS), bounds)
    part = in_repeats / np.maximum(word_chars, 1)
    longest = np.zeros(n, np.int64)
    some = n_words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(lengths, bounds[:-1][some])
    failed = (n_words < LEAST_WORDS) | (100 * repeat_words > MOST_REPEATED * n_words)
    fine = (part <= MOST_COVERED) & ((longest <= LONGEST_FREE) | (longest <= LONGEST_SHARE * n_words))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": sums(SYMBOLS[data], offsets), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "base_failed": failed, "kept": ~failed & fine, "covered": part, "longest_repeat": longest,
    }


def judged(docs: DataFrame) -> DataFrame:
    """The measures and the verdict for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = SpanHash()
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for lo, hi in chunked(offsets):
                found = measured(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], span)
                columns = [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x) for x in found.values())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *found])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), clean_text().alias("text")).mapInArrow(run, OUT)
