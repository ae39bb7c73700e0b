"""Dense statistics of texts for the classifiers, a row a text, from whole texts."""

from __future__ import annotations

import numpy as np

from . import textkit as T

_LINES = np.ones(256, dtype=bool)
_LINES[0x0A] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_ALPHA = _UPPER | np.roll(_UPPER, 32)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_HIGH = np.arange(256) >= 0x80
_BLANK = ~T.SPACE_WORDS
_STOP = np.isin(np.arange(256), list(b".,;:!?"))
_SYMBOL = ~(_ALPHA | _DIGIT | _HIGH | _BLANK | _STOP)

NAMES = (
    "log_bytes log_words word_mean word_std word_max upper digit blank stop symbol high distinct top_word repeat caps "
    "odd_end bang pipe lines same_line same_gram short_word sentence title at_sign question line_mean"
).split()


def _per_row(words: T.Words, value: np.ndarray) -> np.ndarray:
    return np.bincount(words.row, value, words.n_rows)


def statistics(raw: np.ndarray, off: np.ndarray, words: T.Words) -> np.ndarray:
    """len(off) - 1 rows of NAMES; an empty text has zeros throughout."""
    n = len(off) - 1
    base = int(off[0])
    buf = raw[base : int(off[-1])]
    rel = off - base
    size = np.diff(rel).astype(float)
    hist = np.stack([np.bincount(buf[a:b], minlength=256) for a, b in zip(rel[:-1].tolist(), rel[1:].tolist(), strict=True)]) if n else np.zeros((0, 256))
    share = lambda t: hist @ t.astype(float)
    count = np.diff(words.first).astype(float)
    some, any_byte = np.maximum(count, 1), np.maximum(size, 1)
    length = (words.end - words.start).astype(float)
    mean = _per_row(words, length) / some
    var = _per_row(words, length**2) / some - mean**2
    longest = np.zeros(n)
    np.maximum.at(longest, words.row, length)
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    big = upper[words.end] - upper[words.start]
    caps = _per_row(words, ((big >= 2) & (2 * big > length)).astype(float))
    last, head = (buf[words.end - 1], buf[words.start]) if len(length) else (buf[:0], buf[:0])
    odd = _per_row(words, _SYMBOL[last].astype(float))
    sentence = _per_row(words, np.isin(last, list(b".!?")).astype(float))
    title = _per_row(words, (_UPPER[head] & (big == 1)).astype(float))
    short = _per_row(words, (length <= 3).astype(float))
    again = np.zeros(len(length))
    if len(length) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    repeat = _per_row(words, again)
    lines = T.Words(raw, off, _LINES, lower=False)
    grams = T.ngram_hashes(words.hash, 3)
    distinct, top, same_line, same_gram = (np.zeros(n) for _ in range(4))
    for r in np.flatnonzero(count).tolist():
        a, b = words.first[r], words.first[r + 1]
        s = np.sort(words.hash[a:b])
        runs = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
        distinct[r], top[r] = len(runs), runs.max()
        if b - a > 3:
            g = np.sort(grams[a : b - 2])
            same_gram[r] = (g[1:] == g[:-1]).sum() / len(g)
        la, lb = lines.first[r], lines.first[r + 1]
        if lb - la > 1:
            same_line[r] = 1 - len(np.unique(lines.hash[la:lb])) / (lb - la)
    n_lines = np.diff(lines.first).astype(float)
    letters = np.maximum(share(_ALPHA), 1)
    return np.column_stack([
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(var, 0)), np.log1p(longest), share(_UPPER) / letters, share(_DIGIT) / any_byte,
        share(_BLANK) / any_byte, share(_STOP) / any_byte, share(_SYMBOL) / any_byte, share(_HIGH) / any_byte, distinct / some, top / some, repeat / some,
        caps / some, odd / some, hist[:, 0x21] / some, hist[:, 0x7C] / some, n_lines / some, same_line, same_gram, short / some, sentence / some, title / some,
        hist[:, 0x40] / some, hist[:, 0x3F] / some, np.log1p(size / np.maximum(n_lines, 1)),
    ])
