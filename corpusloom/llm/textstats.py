"""Statistics of one whole text, by numpy. Used inside Arrow tasks."""

from __future__ import annotations

from itertools import count

import numpy as np

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_PUNCT = b"!?.,;:"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word's first position, the same for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n ids."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ (ids[k : k + len(h)].astype(np.uint64) + np.uint64(1))) * _MIX
            h ^= h >> np.uint64(29)
    return h


def covered_by_repeats(ids: np.ndarray, n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more in the text."""
    h = window_hashes(ids, n)
    if len(h) < 2:
        return 0
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


#: Columns of ``text_statistics``: first the five counts of the contract, then what models add.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_punct", "n_digits", "n_capital_words")


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in COLUMNS; null counts as the empty text."""
    if not text:
        return (0,) * len(COLUMNS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COLUMNS)
    n_blank = len(raw) - len(raw.translate(None, _BLANKS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids = word_ids(words)
    return (
        n,
        len(text) - n_blank,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        covered_by_repeats(ids),
        len(lines),
        int((ids == np.arange(n)).sum()),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LOWER)),
        len(raw) - len(raw.translate(None, _PUNCT)),
        len(raw) - len(raw.translate(None, b"0123456789")),
        sum(map(bytes.isupper, words)),
    )
