"""Token ids as Arrow files of equal-length sequences.

Every file holds record batches with two fixed-size-list columns, ``ids`` (uint16 or uint32, by vocabulary size) and
``mask`` (booleans: real token or padding of the file's last sequence), in the Arrow file format: a reader maps the file
and reaches any sequence of it without a copy. Beside it lies an Arrow file with the documents: id, first token and count
inside the file. Files follow each other in id order, and so do the documents in a file.

One task writes one range of ids as one file, in a single pass over its texts; totals per file give every file's place in
the whole. Files get a fresh name for every attempt, and only those named by the finished attempt's row are ever read, so
lost or repeated attempts do no harm.

The shared folder must be one that pyarrow can write to (a mounted path, HDFS with its client library, S3, GCS).
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from cohortry.llm.common import query, stored, table, text_slices, texts_of
from cohortry.session import shared_dir

_BATCH_ROWS = 256  # sequences in one record batch
_HELD = 1_200_000  # words held by a Python worker, about 200 MB
_SLICE = 4 << 20  # text bytes encoded together
# a space ahead of one of these characters may belong to a run of white space, so no cut is made there
_UNSURE = r"\t\n\v\f\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_UNSURE_SPACE = re.compile(f" (?:[{_UNSURE}]|$)")
_LINE = re.compile(r"(?<=[!-~])\n(?=[!-~])")
_LATIN = "\u0250"  # below it, letters are letters to every version of the Unicode tables
#: How byte-level vocabularies write bytes: visible ones of latin1 as themselves, the others as characters from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
# ASCII signs without the apostrophe, which may begin a word part of its own
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if ":/" in folder else (pa.fs.LocalFileSystem(), folder)


class _Held(dict):
    """Ids of words, kept from slice to slice; of a slice's other segments, for that slice only."""

    def __init__(self):
        super().__init__()
        self.passing: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        return self.passing[segment]


class TextEncoder:
    """Ids of whole texts, by encoding distinct segments with the tokenizers library once and holding them for a while.

    A segment begins with a space that is followed by a character that is surely no white space: the byte-level pattern
    begins a new word at every such space, whatever comes before, and merges stay inside words. New segments are cut
    further where the pattern always cuts: around a line end between visible ASCII characters, and between letters and
    the signs behind them. Texts with a special token's own text go to the library whole.
    """

    def __init__(self, tokenizer: str):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        layout = json.loads(tokenizer)
        split = layout.get("pre_tokenizer") or {}
        #: a word of letters is one unit of the byte-level pattern, so the library's merges can be asked for it directly
        self.by_word = layout.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        self.by_word = self.by_word and not split.get("add_prefix_space", False)
        self.spaced = _Held()  # ids of a segment behind its space, by what follows the space
        self.bare: dict[str, bytes] = {}  # of others

    @classmethod
    def of_worker(cls, tokenizer: str) -> TextEncoder:
        """One encoder for all tasks of a Python worker, so that segments are held from task to task.

        It hangs on ``sys`` because code that came by value has fresh module variables in every task.
        """
        held = sys.__dict__.setdefault("_text_encoders", {})
        key = hashlib.sha256(tokenizer.encode()).digest()
        if key not in held:
            held.clear()
            held[key] = cls(tokenizer)
        return held[key]

    def _segments(self, text: str) -> list[str]:
        """First what stands ahead of the first cut, then the rest of each segment behind its space."""
        if any(s in text for s in self.special):
            return [text]
        if _UNSURE_SPACE.search(text) is None:
            return text.split(" ")
        return re.split(f" (?=[^{_UNSURE}])", text)

    def _encode_parts(self, parts: Iterable[str], ahead: str, into: dict[str, bytes]) -> None:
        """Ids of every part behind ``ahead`` (a space or nothing) that is not held yet, from the library."""
        kind, tokenize, others = self.kind, self.tokenizer.model.tokenize, []
        shown = "".join(map(_SHOWN.__getitem__, ahead.encode()))
        for part in parts:
            if part in into:
                continue
            if self.by_word and part.isalpha() and max(part) < _LATIN:
                word = part if part.isascii() else part.encode().decode("latin-1").translate(_SHOWN)
                into[part] = array(kind, [t.id for t in tokenize(shown + word)]).tobytes()
            else:
                others.append(part)
        for part, encoding in zip(others, self.tokenizer.encode_batch_fast([ahead + p for p in others], add_special_tokens=False)):
            into[part] = array(kind, encoding.ids).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Find the ids of segments behind a space.

        They are looked up in shorter independent parts, so that a word met with other signs or lines around it is not
        encoded again; only the parts are held for later slices.
        """
        spaced, passing, pairs, lined, words, signs = self.spaced, {}, [], [], set(), set()
        for segment in new:
            if "\n" in segment:
                first, *others = _LINE.split(segment)
                if others:
                    lined.append((segment, first, others))
                    words.add(first)
                    signs.update(others)
                    continue
            word = segment.rstrip(_SIGNS)
            if word != segment and word[-1:].isalpha():
                pairs.append((segment, word, segment[len(word) :]))
                words.add(word)
                signs.add(pairs[-1][2])
            else:
                words.add(segment)
        self._encode_parts(signs | {"\n"}, "", self.bare)
        self._encode_parts(words, " ", spaced)
        bare = self.bare
        for segment, word, tail in pairs:
            passing[segment] = spaced[word] + bare[tail]
        for segment, first, others in lined:
            passing[segment] = bare["\n"].join([spaced[first], *[bare[p] for p in others]])
        spaced.passing = passing

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as bytes of ``kind``."""
        if len(self.spaced) + len(self.bare) > _HELD:
            self.spaced, self.bare = _Held(), {}
        keys = [self._segments(t) for t in texts]
        first = [k[0] for k in keys]
        for k in keys:
            k[0] = ""  # of no segment's own
        new = set(chain.from_iterable(keys)).difference(self.spaced)
        new.discard("")
        self._learn(new)
        self._encode_parts(set(first), "", self.bare)
        self.spaced[""] = b""
        found = self.spaced.__getitem__
        return [self.bare[f] + b"".join(map(found, k)) for f, k in zip(first, keys)]


class SequenceWriter:
    """Appends ids to one file of equal-length sequences."""

    def __init__(self, sink, length: int, kind):
        self.length, self.kind = length, np.dtype(kind)
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))]
        )
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.n_waiting = 0

    def append(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids) // self.kind.itemsize
        if self.n_waiting >= _BATCH_ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        """Write full batches; at the end the other whole sequences, too, and the padded last one."""
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        full = _BATCH_ROWS * self.length
        whole = len(ids) // self.length * self.length if last else len(ids) // full * full
        rest = ids[whole:]
        for at in range(0, whole, full):
            self._write(ids[at : min(whole, at + full)], None)
        if last and len(rest):
            self._write(np.pad(rest, (0, self.length - len(rest))), len(rest))
            rest = rest[:0]
        self.waiting, self.n_waiting = [rest.tobytes()], len(rest)

    def _write(self, ids: np.ndarray, real: int | None) -> None:
        mask = np.arange(len(ids)) < (len(ids) if real is None else real)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class SequenceReader:
    """Random access to the sequences and tokens of one file."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.last_first: int | None = None
        self.held: tuple[int, pa.RecordBatch | None, np.ndarray | None] = (-1, None, None)

    def batch(self, i: int) -> pa.RecordBatch:
        return self.file.get_batch(i)

    def ids(self, i: int) -> np.ndarray:
        """A view of all ids of one batch; the last one asked for stays at hand."""
        if self.held[0] != i:
            part = self.batch(i)
            self.held = (i, part, part.column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.held[2]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence ``i``. All batches but the last two are full."""
        for b in range(min(i // _BATCH_ROWS, self.file.num_record_batches - 1), self.file.num_record_batches):
            part = self.batch(b)
            first = b * _BATCH_ROWS if b < self.file.num_record_batches - 1 else self._before(b)
            if i < first + part.num_rows:
                ids = part.column("ids").slice(i - first, 1).flatten()
                return ids.to_numpy(zero_copy_only=True), part.column("mask").slice(i - first, 1).flatten().to_numpy(False)
        raise IndexError(i)

    def _before(self, b: int) -> int:
        return (b - 1) * _BATCH_ROWS + self.batch(b - 1).num_rows if b else 0

    def _last_first(self) -> int:
        """First token of the last batch."""
        if self.last_first is None:
            self.last_first = self._before(self.file.num_record_batches - 1) * self.length
        return self.last_first

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from token ``start`` on, batch by batch."""
        full = _BATCH_ROWS * self.length
        b = min(start // full, self.file.num_record_batches - 1)
        first = b * full if b < self.file.num_record_batches - 1 else self._last_first()
        while n > 0:
            ids = self.ids(b)
            if start < first + len(ids):
                part = ids[start - first : start - first + n]
                yield part
                start, n = start + len(part), n - len(part)
            first += len(ids)
            b += 1


_FILES_DDL = "first_id long, n_docs long, n_tokens long, path string"
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _written(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    encoder, writer, index = TextEncoder.of_worker(tokenizer), None, None
    start = docs = 0
    first_id = None
    fs, base = opened(folder)
    path = f"{base}/{uuid.uuid4().hex}"
    end = array(encoder.kind, [end_id]).tobytes()
    width = len(end)
    for batch in text_slices(batches, limit=_SLICE):
        if writer is None:
            fs.create_dir(base, recursive=True)
            sinks = [fs.open_output_stream(f"{path}.{kind}.arrow") for kind in ("ids", "docs")]
            writer, index = SequenceWriter(sinks[0], length, encoder.kind), pa.ipc.new_file(sinks[1], _INDEX)
            first_id = batch.column("doc_id")[0].as_py()
        counts = []
        for ids in encoder.encode(texts_of(batch)):
            writer.append(ids + end)
            counts.append(len(ids) // width + 1)
        counts = np.array(counts, np.int64)
        starts = start + np.cumsum(counts) - counts
        index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(counts)], schema=_INDEX))
        start, docs = start + int(counts.sum()), docs + batch.num_rows
    if writer is not None:
        for closing in (writer, index, *sinks):
            closing.close()
        yield pa.RecordBatch.from_pylist(
            [{"first_id": first_id, "n_docs": docs, "n_tokens": start, "path": path.removeprefix(base).lstrip("/")}],
            pa.schema([("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("path", pa.string())]),
        )


def write_sequences(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 2,
    length: int = 2048,
    files: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents and return one row per file, in order: n_docs, n_tokens, path, first_token (in the whole).

    ``files`` bounds the number of files (default: the session's shuffle partitions). Null ids come first; rows with equal
    ids stay together and are ordered by text, so repeated rows are written one after the other. A null or empty text is
    its end id alone. No documents give no files and no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ranged = picked.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    done = ranged.mapInArrow(lambda b: _written(b, folder, tokenizer.value, end_id, length), _FILES_DDL)
    done = stored(done.filter(F.col("n_docs") > 0), "sequence-files")
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "path")  # one row per file
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return done.select("n_docs", "n_tokens", "path", F.coalesce(before, F.lit(0)).alias("first_token"))


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = opened(folder)
    local = isinstance(fs, pa.fs.LocalFileSystem)
    for batch in batches:
        for row in batch.to_pylist():
            path = f"{base}/{row['path']}"
            source, places = (pa.memory_map(f"{path}.{k}.arrow") if local else fs.open_input_file(f"{path}.{k}.arrow") for k in ("ids", "docs"))
            reader, index = SequenceReader(source), pa.ipc.open_file(places)
            for b in range(index.num_record_batches):
                part = index.get_batch(b)
                sums = []
                for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist()):
                    crc = 0
                    for ids in reader.tokens(start, n):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                starts = pa.compute.add(part.column("start"), row["first_token"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), starts, part.column("n_tokens"), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_sequences(files: DataFrame, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start (in the whole), n_tokens, ids_crc32."""
    n = max(1, files.count())
    return files.repartitionByRange(n, "first_token").mapInArrow(
        lambda b: _read(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


@query("op3_arrow_sequences")
def _(spark, sf):
    folder = shared_dir(spark, "sequences")
    files = write_sequences(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_sequences(files, folder)
