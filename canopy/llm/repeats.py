"""Quality rules on repetition inside a document, by suffix arrays over words.

The words of a batch of texts are sorted as suffixes by prefix doubling; the
first key of a suffix holds its text's number, so no match crosses texts. The
interval of the longest-common-prefix array that lies deepest above a suffix
gives the longest repeated substring that starts there; the spans of all that
reach a minimum length are united.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopy.llm.common import WORD_RE, kept, slices


@dataclass(frozen=True)
class Rules:
    #: Base rules: fewest words, and the share of words in repeated windows.
    min_words: int = 10
    window: int = 5
    max_repeat_words: float = 0.20
    #: Repetition rules: words from which a repeated substring counts, the share of words such substrings may cover, and the longest one allowed.
    min_repeat: int = 8
    max_covered: float = 0.20
    max_longest: int = 60


SYMBOLS = "#*$%&|<>"
_SYMBOLS = str.maketrans("", "", SYMBOLS)


def suffix_order(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of word numbers, and the ranks after 1, 2, 4, ... words. ``text`` is the (ascending) number of each word's text.

    Only suffixes that are still tied take part in the next doubling.
    """
    n = len(keys)
    first = text.astype(np.int64) * (int(keys.max(initial=0)) + 1) + keys
    order = np.argsort(first, kind="stable")
    sorted_keys = first[order]
    head = np.ones(n, bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(n, np.int64)
    # A rank is the place of its group's first suffix, plus one; 0 stands for the end of a text.
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    ranks, k = [rank], 1
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order, ranks
        suf = order[at]
        nxt = suf + k
        inside = nxt < n
        nxt[~inside] = 0
        inside &= text[nxt] == text[suf]
        second = np.where(inside, rank[nxt], 0)
        by = np.lexsort((second, rank[suf]))
        suf, second = suf[by], second[by]
        group = rank[suf]
        order[at] = suf
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        head[at] = new
        rank = rank.copy()
        rank[suf] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        ranks.append(rank)
        k *= 2


def longest_repeats(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring of its text that starts there and occurs again (overlaps count)."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    order, ranks = suffix_order(keys, text)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n + 1, np.int64)
    live = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b, length = a[live], b[live], np.zeros(len(live), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        x, y = a[ok], b[ok]
        same[ok] = (ranks[level][x] == ranks[level][y]) & (text[x] == text[y])
        same[ok] &= text[x] == text[order[:-1][live]][ok]
        step = 1 << level
        a, b, length = a + step * same, b + step * same, length + step * same
    lcp[live + 1] = length
    # The deepest interval above a suffix is the one it shares with its nearer neighbour.
    deepest = np.maximum(lcp[:-1], lcp[1:])
    out = np.empty(n, np.int64)
    out[order] = deepest
    return out


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of the repeated substrings of at least ``least`` words."""
    n = len(repeat)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(repeat >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + repeat[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += 1
        elif WORD_RE.search(line):
            seen.add(line)
    return n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def measure(texts: list[str | None], rules: Rules) -> dict[str, np.ndarray]:
    """The columns of ``SCHEMA`` for a batch of texts."""
    m = len(texts)
    words = [WORD_RE.findall(t) if t else [] for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    numbers: dict[str, int] = {}
    keys = np.array([numbers.setdefault(x, len(numbers)) for w in words for x in w], np.int64)
    text = np.repeat(np.arange(m), lens)
    per = lambda flags: np.bincount(text[flags], minlength=m).astype(np.int64)
    repeat = longest_repeats(keys, text)
    longest = np.zeros(m, np.int64)
    np.maximum.at(longest, text, repeat)
    out = {
        "n_words": lens,
        "word_chars": np.array([sum(map(len, w)) for w in words], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(_SYMBOLS)) if t else 0 for t in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) if t else 0 for t in texts], np.int64),
        # A window that is found twice is a repeated substring of that length, so the windows' union is that of the substrings.
        "n_repeat_words": per(covered(repeat, rules.window)),
        "n_covered": per(covered(repeat, rules.min_repeat)),
        "longest_repeat": longest,
    }
    out["base_failed"] = (lens < rules.min_words) | (100 * out["n_repeat_words"] > round(100 * rules.max_repeat_words) * lens)
    out["kept"] = ~out["base_failed"] & (100 * out["n_covered"] <= round(100 * rules.max_covered) * lens) & (longest <= rules.max_longest)
    return out


def _measured(rules: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats", dict)  # nothing; what another operator kept goes
        for b in slices(batches):
            got = measure(b.column(1).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[c]) for c in COLUMNS)], names=["doc_id", *COLUMNS])

    return run


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: doc_id and the columns of ``SCHEMA``; no shuffle.

    Null, empty and blank texts have no words, fail the base rule and are not
    kept. Rows are judged one by one, so equal rows get equal verdicts.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_measured(rules), "doc_id long, " + SCHEMA)


def _filtered(rules: Rules, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats", dict)
        for b in slices(batches):
            keep = measure(b.column(at).to_pylist(), rules)["kept"]
            yield b.filter(pa.array(keep))

    return run


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Null, empty and blank texts go; ids play no part; equal rows stay or go
    together; an empty table gives an empty one.
    """
    return docs.mapInArrow(_filtered(rules, docs.columns.index("text")), docs.schema)
