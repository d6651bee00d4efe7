"""Counts and structure of whole texts, for all texts of a slice at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cohortry.llm.common import WHITE, buffer_of, mixed, span_hashes, window_hashes, word_bounds, word_ranges

# fixed values of the quality contract
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _SIGN = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b".,;:!?")
_FIRST_BYTE = np.array([(b & 0xC0) != 0x80 for b in range(256)])


@dataclass
class Stats:
    """Arrays over the texts of a slice; ``words`` and ``owner`` are over their words."""

    data: np.ndarray
    offsets: np.ndarray
    words: np.ndarray  # hashes
    owner: np.ndarray  # text of each word
    ranges: np.ndarray  # each text's words
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray  # with a word
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    def share(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a kind, per byte of text."""
        return _sums(table[self.data], self.offsets) / np.maximum(np.diff(self.offsets), 1)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _met_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: an equal one stands before it; an equal one stands anywhere else."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    before, anywhere = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    anywhere[order[1:]] |= same
    anywhere[order[:-1]] |= same
    return before, anywhere


def stats_of(batch: pa.RecordBatch, column: str = "text") -> Stats:
    """Equal words, windows and lines are found by 64-bit hashes; a null text is empty."""
    raw, offsets = buffer_of(batch, column)
    data = np.frombuffer(raw, np.uint8)
    n = len(offsets) - 1
    starts, ends = word_bounds(data, offsets, WHITE)
    words = span_hashes(data, starts, ends)
    ranges = word_ranges(starts, offsets)
    n_words = np.diff(ranges)
    owner = np.repeat(np.arange(n), n_words)
    running = np.concatenate([[0], np.cumsum(_FIRST_BYTE[data], dtype=np.int64)])
    word_chars = np.bincount(owner, running[ends] - running[starts], n).astype(np.int64)

    windows = window_hashes(words, REPEAT_WINDOW)
    inside = np.flatnonzero(owner[: len(windows)] == owner[len(words) - len(windows) :])
    _, twice = _met_before(windows[inside] + mixed(owner[inside].astype(np.uint64)))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, inside[twice], 1)
    np.add.at(step, inside[twice] + REPEAT_WINDOW, -1)
    repeated = np.bincount(owner, np.cumsum(step[:-1]) > 0, n).astype(np.int64)

    newline = data == 10
    line_starts = np.union1d(np.flatnonzero(newline) + 1, offsets[:-1])
    line_starts = line_starts[line_starts < len(data)]
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    stops = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_text + 1])
    stops = np.where((stops > line_starts) & newline[np.maximum(stops - 1, 0)], stops - 1, stops)
    worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, stops)
    line_starts, stops, line_text = line_starts[worded], stops[worded], line_text[worded]
    again, _ = _met_before(span_hashes(data, line_starts, stops) + mixed(line_text.astype(np.uint64)))
    return Stats(
        data, offsets, words, owner, ranges, n_words, word_chars, _sums(_SYMBOL[data], offsets),
        np.bincount(line_text, minlength=n), np.bincount(line_text, again, n).astype(np.int64), repeated,
    )


STRUCTURE = 12


def structure_of(s: Stats) -> np.ndarray:
    """(texts, STRUCTURE) numbers that describe a text's make-up."""
    words, size = np.maximum(s.n_words, 1), np.diff(s.offsets)
    distinct = np.zeros(len(words), np.int64)
    if len(s.words):
        before, _ = _met_before(s.words + mixed(s.owner.astype(np.uint64)))
        distinct = np.bincount(s.owner, ~before, len(words)).astype(np.int64)
    columns = [
        np.log1p(s.n_words),
        np.log1p(size),
        s.word_chars / words,
        s.n_symbols / words,
        s.n_dup_lines / np.maximum(s.n_lines, 1),
        s.n_repeat_words / words,
        words / np.maximum(s.n_lines, 1),
        distinct / words,
        s.share(_UPPER),
        s.share(_DIGIT),
        s.share(_SIGN),
        s.share(_SYMBOL),
    ]
    return np.stack(columns, axis=1).astype(np.float64)
