"""Statistics of one whole text: the counts of the quality rules and the features of the models.

Features depend on the text alone.  Words are runs of bytes other than space and code points 9 to 13.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

SYMBOLS = b"#*$%&|<>"
#: Words in a repeated window.
WINDOW = 5
SMOOTH_WORDS, SMOOTH_CHARS = 8, 50

FEATURES = (
    "log_words", "mean_word", "upper", "digit", "symbol", "pipe", "shout", "punct", "other_ascii", "non_ascii", "line_words",
    "dup_lines", "repeat_words", "distinct_words", "short_text", "stop_marks", "lone_symbols", "markup", "title_words", "longest_word", "stutter",
)
#: Features of which more can only lower a document's quality (for models with monotonic constraints).
DECREASING = ("symbol", "pipe", "shout", "dup_lines", "repeat_words", "markup", "lone_symbols", "stutter")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, g in enumerate(grams) if often[g] > 1], np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else [data] if data.strip() else []
    return len(lines), len(lines) - len(set(lines))


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8"))


def base_counts(data: bytes) -> tuple[list[bytes], int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    spaces = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    return words, code_points(data) - spaces, symbols, duplicate_lines(data)[1], repeated_words(words)


def features(data: bytes, words: list[bytes] | None = None, repeats: int | None = None) -> list[float]:
    """``FEATURES`` of a UTF-8 text; an empty text has zeros and ``short_text`` 1."""
    words = data.split() if words is None else words
    n = len(words)
    if not n:
        return [0.0] * FEATURES.index("short_text") + [1.0] + [0.0] * (len(FEATURES) - FEATURES.index("short_text") - 1)
    repeats = repeated_words(words) if repeats is None else repeats
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, int(seen[33:].sum()))
    count = lambda chars: int(sum(seen[c] for c in chars))
    lines, dups = duplicate_lines(data)
    upper = int(seen[65:91].sum())
    # Ratios are drawn towards 0 by a few words and characters, so that a text of a word or two is not extreme.
    w, c = n + SMOOTH_WORDS, size + SMOOTH_CHARS
    return [
        float(np.log1p(n)), size / w, upper / c, int(seen[48:58].sum()) / c, count(SYMBOLS) / w, int(seen[124]) / w, int(seen[33]) / w,
        count(b".,;:?") / w, count(b"@=_^~`\\/{}[]()\"'+-") / w, int(seen[128:].sum()) / c, np.log1p(n / max(1, lines)),
        dups / max(1, lines), repeats / w, (len(set(words)) + SMOOTH_WORDS) / w, float(n < 10), count(b".!?") / w, sum(x in (b"|", b"*", b"#", b"$", b"&", b"%") for x in words) / w,
        count(b"<>") / w, sum(65 <= x[0] <= 90 for x in words) / w, np.log1p(max(map(len, words))), sum(map(eq, words, words[1:])) / w,
    ]
