"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps, for every segment, an agenda of adjacent symbol pairs that form a piece, ordered by score and then by
position; its head is merged and the two pairs beside it are renewed until the agenda is empty. Segments are cut
where no piece can reach across (ahead of a run of word marks, around line ends), so they are independent. Short segments
are worked off together: one array step takes the head of every segment's agenda. Long ones use a heap each.

Distinct segments are encoded once and held for a while; each is checked against the sentencepiece library when it is new.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from cohortry.llm.common import query, table, text_slices, texts_of

MARK = "▁"  # stands for a space inside pieces
_LONG = 64  # symbols; longer segments have a heap of their own and are not held
_SLICE = 1 << 20  # text bytes worked off together
_HELD = 250_000  # segments held by a task, about 100 MB
_NO_PAIR = np.int64(1) << 62


@dataclass
class Vocabulary:
    """Lookup tables of a merge-type model. Symbols are piece ids, or ``size`` + code point for other characters."""

    size: int
    char_ids: np.ndarray  # by code point
    pair_keys: np.ndarray  # left * span + right, sorted
    pair_pieces: np.ndarray
    rank: np.ndarray  # by piece: 0 for the best score
    byte_ids: np.ndarray
    texts: list[bytes]  # by id, as decoded
    marked: np.ndarray  # by id: starts with the mark

    @property
    def span(self) -> int:
        return self.size + 0x110000

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i][1:] or "\n" in pieces[i][:-1] for i in plain):
            raise ValueError("a piece reaches across a word mark or a line end, so segments are not independent")
        ids = {pieces[i]: i for i in plain}
        chars = np.arange(n, n + 0x110000, dtype=np.int64)
        for i in plain:
            if len(pieces[i]) == 1:
                chars[ord(pieces[i])] = i
        symbol = lambda s: int(chars[ord(s)]) if len(s) == 1 else ids.get(s)
        pairs = {}
        for i in plain:
            for cut in range(1, len(pieces[i])):
                left, right = symbol(pieces[i][:cut]), symbol(pieces[i][cut:])
                if left is not None and right is not None:
                    pairs[left * (n + 0x110000) + right] = i
        keys = np.array(sorted(pairs), np.int64)
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        scores = np.array([sp.get_score(i) for i in order])
        rank = np.zeros(n, np.int64)  # equal scores share a rank, so that position decides between them
        rank[order] = np.concatenate([[0], np.cumsum(scores[1:] != scores[:-1])])
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        texts = [b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        texts[sp.unk_id()] = " ⁇ ".encode()
        for b, i in enumerate(byte_ids):
            texts[i] = bytes([b])
        marked = np.array([p.startswith(MARK) for p in pieces])
        return cls(n, chars, keys, np.array([pairs[int(k)] for k in keys], np.int64), rank, byte_ids, texts, marked)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair forms, or -1."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_pieces[at], -1)

    def ids_of(self, symbols: list[int]) -> list[int]:
        """Piece ids; a character outside the vocabulary becomes its UTF-8 bytes' pieces."""
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.size else [int(self.byte_ids[b]) for b in chr(s - self.size).encode()]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


def _by_heap(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merge one segment's agenda from a heap of (rank, position of the left symbol, left, right, piece)."""
    n = len(symbols)
    syms, before, after = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    pieces = v.merged(symbols[:-1], symbols[1:])
    at = np.flatnonzero(pieces >= 0)
    agenda = [(int(v.rank[pieces[i]]), int(i), syms[i], syms[i + 1], int(pieces[i])) for i in at]
    heapq.heapify(agenda)
    known: dict[tuple[int, int], int] = {}
    while agenda:
        _, i, left, right, piece = heapq.heappop(agenda)
        j = after[i]
        if syms[i] != left or j >= n or syms[j] != right:  # one of the two has been merged meanwhile
            continue
        syms[i], syms[j] = piece, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                pair = (syms[x], syms[y])
                if pair not in known:
                    known[pair] = int(v.merged(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] >= 0:
                    heapq.heappush(agenda, (int(v.rank[known[pair]]), x, *pair, known[pair]))
    return np.array([s for s in syms if s >= 0], np.int64)


def _together(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the agendas of many short segments: every step merges the head of each. Symbols left, and counts."""
    done: dict[str, list[np.ndarray]] = {"segment": [], "symbols": []}
    live = np.arange(len(lengths))
    syms, counts = symbols, lengths
    last = np.cumsum(counts) - 1

    def entries(left, right, position):
        piece = v.merged(left, right)
        return np.where(piece >= 0, (v.rank[np.maximum(piece, 0)] << np.int64(20)) | position, _NO_PAIR), piece

    following = np.append(syms[1:], -1)
    starts = last + 1 - counts
    inner = np.arange(len(syms)) - np.repeat(starts, counts)
    head, piece = entries(syms, following, inner)
    head[last] = _NO_PAIR
    while len(live):
        best = np.minimum.reduceat(head, starts)
        on = best < _NO_PAIR
        if not on.all():  # segments with an empty agenda leave
            gone = np.repeat(~on, counts)
            done["segment"].append(np.repeat(live[~on], counts[~on]))
            done["symbols"].append(syms[gone])
            stay = ~gone
            syms, head, piece = syms[stay], head[stay], piece[stay]
            live, counts, best = live[on], counts[on], best[on]
            if not len(live):
                break
            starts = np.cumsum(counts) - counts
        at = starts + (best & ((1 << 20) - 1))
        syms[at] = piece[at]
        stay = np.ones(len(syms), bool)
        stay[at + 1] = False
        syms, head, piece = syms[stay], head[stay], piece[stay]
        at = at - np.arange(len(at))  # one symbol of every earlier segment is gone, too
        counts = counts - 1
        starts = np.cumsum(counts) - counts
        inner = at - starts
        # positions inside the segment changed for the pairs after the merged one
        after = np.repeat(at, counts) < np.arange(len(syms))
        head[after & (head < _NO_PAIR)] -= 1
        ends = starts + counts - 1
        right = np.flatnonzero(at < ends)
        head[at], piece[at] = _NO_PAIR, -1
        head[at[right]], piece[at[right]] = entries(syms[at[right]], syms[at[right] + 1], inner[right])
        left = np.flatnonzero(at > starts)
        head[at[left] - 1], piece[at[left] - 1] = entries(syms[at[left] - 1], syms[at[left]], inner[left] - 1)
    segment = np.concatenate(done["segment"])
    order = np.argsort(segment, kind="stable")
    return np.concatenate(done["symbols"])[order], np.bincount(segment, minlength=len(lengths))


def encode_segments(v: Vocabulary, segments: list[str]) -> list[list[int]]:
    """Piece ids of every segment; word marks are part of the segments' text."""
    points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
    symbols = v.char_ids[points]
    lengths = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(lengths)
    out: list[list[int]] = [[] for _ in segments]
    brief = (lengths > 0) & (lengths <= _LONG)
    short = np.flatnonzero(brief)
    if len(short):
        merged, counts = _together(v, symbols[np.repeat(brief, lengths)], lengths[short])
        stops = np.cumsum(counts)
        odd = np.add.reduceat(merged >= v.size, stops - counts).tolist()
        flat, low = merged.tolist(), 0
        for k, high, strange in zip(short.tolist(), stops.tolist(), odd):
            out[k] = v.ids_of(flat[low:high]) if strange else flat[low:high]
            low = high
    for k in np.flatnonzero(lengths > _LONG):
        out[k] = v.ids_of(_by_heap(v, symbols[ends[k] - lengths[k] : ends[k]]).tolist())
    return out


def segment_keys(text: str) -> list[str]:
    """The segments of a text. A key starts with a line end for a segment without a mark ahead; else a mark goes ahead of it.

    The library puts one mark ahead of the text and turns every space into a mark; "\\n" alone is a line end.
    """
    if not text:
        return []
    out: list[str] = []
    for i, line in enumerate(text.replace(MARK, " ").split("\n")):
        words = line.split(" ")
        if i:
            out.append("\n")
            if words[0]:
                words[0] = "\n" + words[0]
            else:
                del words[0]
        if "" in words:  # runs of spaces belong to what follows them
            run = 0
            for w in words:
                if w:
                    out.append(" " * run + w)
                    run = 0
                else:
                    run += 1
            if run:
                out.append(" " * (run - 1))
        else:
            out += words
    return out


def _symbols_text(key: str) -> str:
    if key.startswith("\n"):
        return key[1:] or "\n"
    return (" " + key).replace(" ", MARK)


class Encoder:
    """Encodes texts, holding distinct segments for a while."""

    def __init__(self, v: Vocabulary, model: bytes):
        self.v, self.sp = v, sentencepiece.SentencePieceProcessor(model_proto=model)
        self.places: dict[str, int] = {}
        self.ids: list[str] = []
        self.counts: list[int] = []
        self.decoded: list[bytes] = []
        self.unequal: list[int] = []

    def learn(self, keys: list[list[str]]) -> None:
        if len(self.places) > _HELD:
            self.__init__(self.v, self.sp.serialized_model_proto())
        new = list(dict.fromkeys(k for text in keys for k in text if k not in self.places))
        for key, ids, right in zip(new, encode_segments(self.v, [_symbols_text(k) for k in new]), self._library(new)):
            self.places[key] = len(self.ids)
            self.ids.append(",".join(map(str, ids)))
            self.counts.append(len(ids))
            self.decoded.append(self.v.decode(ids))
            self.unequal.append(int(ids != right))

    def _library(self, keys: list[str]) -> list[list[int]]:
        """The library's ids; a segment without a mark is encoded behind a line end, whose ids are cut off."""
        ahead = len(self.sp.encode("\n"))
        out = []
        for key, ids in zip(keys, self.sp.encode(keys, num_threads=1)):
            if key == "":  # a mark alone, which the library never gets as a text of its own
                ids = [self.sp.piece_to_id(MARK)]
            elif key == "\n":
                ids = ids[1:]
            elif key.startswith("\n"):
                ids = ids[ahead:]
            out.append(ids)
        return out


_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_unequal long"


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary, model: bytes) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(v, model)
    for batch in text_slices(batches, limit=_SLICE):
        keys = [segment_keys(t) for t in texts_of(batch)]
        encoder.learn(keys)
        places, ids, counts, decoded, unequal = encoder.places, encoder.ids, encoder.counts, encoder.decoded, encoder.unequal
        rows = []
        for text in keys:
            at = [places[k] for k in text]
            joined = ",".join(map(ids.__getitem__, at))
            plain = b"".join(map(decoded.__getitem__, at))[1:]  # the mark put ahead of the text is not part of it
            rows.append(
                (
                    sum(map(counts.__getitem__, at)),
                    hashlib.sha256(joined.encode()).hexdigest(),
                    hashlib.sha256(plain).hexdigest(),
                    sum(map(unequal.__getitem__, at)),
                )
            )
        columns = [pa.array(c) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_unequal"]
        )


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: n_tokens, ids_sha256, decoded_sha256, n_unequal (segments that differ from the library).

    A null or empty text has no ids and decodes to an empty text. Repeated rows and null ids give rows like any other; an
    empty table gives an empty result; other columns are ignored. The model file is read by the driver (a tokenizer's
    size, not the data's) and sent to the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    held = docs.sparkSession.sparkContext.broadcast((Vocabulary.load(model), model))
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: _encoded(batches, *held.value), _DDL)


@query("op7_agenda_pieces")
def _(spark, sf):
    return encode_texts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
