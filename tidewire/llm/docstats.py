"""Statistics of whole texts, shared by the quality classifier and the quality rules."""

from __future__ import annotations

import numpy as np

#: Names of the statistics, in the order of the columns of `statistics`.
NAMES = (
    "log_words", "log_chars", "mean_word", "long_words", "distinct_words", "top_word", "log_lines", "mean_line", "short_lines", "dup_lines",
    "repeat_words", "symbols", "bars", "marks", "upper", "digits", "points", "commas", "closed_lines", "other_bytes", "symbol_words", "mark_words",
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = list(b" \t\n\v\f\r")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    size = len(number)
    if size == n:
        return 0
    if size < 2_000_000:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # the product would not fit in 64 bits
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pair[:-1] * size + ids[2:]
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows) and the statistics.

    Words are runs of anything but space and \\t to \\r; lines are parted by \\n. A null text is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    n, chars = len(words), len(text)
    word_chars = chars - int(bins[_SPACE].sum())
    symbols = int(bins[_SYMBOL].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    k, m, b = max(n, 1), max(len(lines), 1), max(len(raw), 1)
    letters = max(int(bins[65:91].sum() + bins[97:123].sum()), 1)
    stats = np.array(
        [
            np.log1p(n), np.log1p(chars), word_chars / k, sum(len(w) > 12 for w in counts) / max(len(counts), 1), len(counts) / k, max(counts.values(), default=0) / k,
            np.log1p(len(lines)), np.log1p(n / m), sum(len(x) < 20 for x in lines) / m, dup_lines / m, repeats / k,
            symbols / k, bins[124] / k, bins[33] / k, bins[65:91].sum() / letters, bins[48:58].sum() / b, bins[46] / k, bins[44] / k,
            sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m, bins[128:].sum() / b,
            sum(c for w, c in counts.items() if w[-1] in b"#*$%&|<>") / k, sum(c for w, c in counts.items() if w[-2:] == b"!!") / k,
        ],
        dtype=np.float64,
    )
    return (n, word_chars, symbols, dup_lines, repeats), stats


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (integers) and statistics of each text."""
    both = [measure(t) for t in texts]
    return np.array([c for c, _ in both], dtype=np.int64).reshape(len(both), 5), np.array([s for _, s in both]).reshape(len(both), len(NAMES))
