"""Text statistics and hashed n-gram features shared by the two quality models.

Words are the longest runs without ASCII white space. A text without words has no
n-grams and all statistics 0.
"""

from __future__ import annotations

import numpy as np
import xxhash

from lamina.llm import workers

BITS = 12
SIZE = 1 << BITS
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words of more bytes are hashed anew each time.
LONG_WORD = 64
#: Names of the dense statistics, in order.
STATS = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "punct_share", "distinct_share", "line_words", "stutter_share")


class WordHashes(dict):
    """64-bit hashes of words, kept for the words of a task; emptied when large. Only words of usual length are kept, which bounds its bytes."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = workers.kept("word hashes", WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, in order."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = mixed(out) + h[j : j + n] * np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """Words inside a k-word window that occurs at least twice."""
    if len(h) <= k:
        return 0
    windows = window_hashes(h, k)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for j in range(k):
        covered[j : j + len(windows)] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def analyse(text: str) -> dict:
    """Words, counts and the word hashes of a text."""
    words = text.encode().split()
    h = word_hashes(words)
    return {
        "words": words,
        "hashes": h,
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(h),
    }


def statistics(text: str, found: dict) -> np.ndarray:
    """The dense statistics, each of the order of 1."""
    n = found["n_words"]
    if not n:
        return np.zeros(len(STATS), np.float32)
    x = np.frombuffer(text.encode(), np.uint8)
    chars = max(1, found["word_chars"])
    kinds = np.bincount(x, minlength=256)
    upper, digits = kinds[65:91].sum(), kinds[48:58].sum()
    punct = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    lines = text.count("\n") + 1
    values = (
        np.log1p(n) / 5, chars / n / 6, found["n_symbols"] / chars * 5, upper / chars * 2, digits / chars * 5, found["n_dup_lines"] / lines * 2,
        found["n_repeat_words"] / n * 2, punct / chars * 5, len(np.unique(found["hashes"])) / n, np.log1p(n / lines) / 4,
        (found["hashes"][1:] == found["hashes"][:-1]).sum() / n * 5,
    )
    return np.array(values, np.float32)


def gram_groups(text: str, found: dict) -> list[np.ndarray]:
    """Buckets of word 1- and 2-grams and of character 3- and 4-grams; each group has a part of the table."""
    groups = []
    quarter = BITS - 2
    h = found["hashes"]
    for k in (1, 2):
        own = window_hashes(h, k) if len(h) >= k else h[:0]
        groups.append((own >> np.uint64(64 - quarter)).astype(np.int32) + (k - 1) * (1 << quarter))
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for k in (3, 4):
        n = max(0, len(x) - k + 1)
        code = np.zeros(n, np.uint32)
        for j in range(k):
            code = code * np.uint32(1000003) + x[j : j + n]
        groups.append(((code * np.uint32(2654435761)) >> np.uint32(32 - quarter)).astype(np.int32) + (k - 1) * (1 << quarter))
    return groups


def vector(text: str) -> np.ndarray:
    """Parts of the buckets (each group's add up to 1), then the statistics."""
    found = analyse(text)
    out = np.zeros(SIZE + len(STATS), np.float32)
    for group in gram_groups(text, found):
        if len(group):
            out[:SIZE] += np.bincount(group, minlength=SIZE) / len(group)
    out[SIZE:] = statistics(text, found)
    return out
