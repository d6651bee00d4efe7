"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

Text around digits and at-signs is cut into regions of tokens. A segmentation of a region splits it into single other
tokens and entities of bounded length; its score adds, for every segment, the weights of features of the *whole span*
(digit count, checksum, separators, parts, borders, the word ahead) and of the pair of neighbouring types. The best
segmentation, found by dynamic programming over segment ends, chooses borders and types together.

The weights maximise the likelihood of regions from a bounded sample of documents whose segments are the pattern matches
(no feature repeats a pattern). Spans found by the patterns always stay; the field adds others.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.common import query, table, text_slices, texts_of

# fixed values of the contract
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so the lookbehind only saves time; possessive marks, too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_NOTED = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
LONGEST = 24  # tokens of a span that the field may add; matches that it learns from have any length
PIECE = 400  # characters of a piece of a region that the field learns from, or more up to the next place outside a match
OTHER = len(KINDS)
SAMPLE = 4_000  # documents that the field is fitted on, at most
_EPOCHS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without trying every start: a match must hold an at-sign, and begins where the run ahead of it does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, leftmost and non-overlapping per kind, sorted."""
    if not _NOTED.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---------------------------------------------------------------- regions and candidate segments


@dataclass
class Region:
    """Tokens of a stretch of words that hold a digit or an at-sign, and the segments that may be entities."""

    starts: list[int]
    ends: list[int]
    by_end: list[list[tuple[int, int, tuple[str, ...]]]]  # at each end token: (begin token, type, features)
    other: list[tuple[str, ...]]


def regions_of(text: str) -> list[tuple[int, int]]:
    """Neighbouring words with a digit or an at-sign, a space or less apart."""
    out: list[list[int]] = []
    for m in _WORD.finditer(text):
        if _NOTED.search(m[0]):
            if out and m.start() - out[-1][1] == 1 and text[out[-1][1]] == " ":
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
    return [(s, e) for s, e in out]


_NUMERIC = re.compile(r"[+(]?[0-9][0-9\x20().-]*")


def _features(kind: int, span: str, ahead: str, behind: str) -> tuple[str, ...] | None:
    """Names of the features that a whole span has as an entity of a kind; None if it cannot be one."""
    clean = ahead in ("", " ", "\n", "(", '"', ":", "=", ",", "<") and not behind.isalnum()
    out = ["bias", "clean" if clean else "unclean"]
    if kind == 0:
        local, _, domain = span.partition("@")
        if not local or not domain or "@" in domain or " " in span or not domain[-1].isalnum():
            return None
        labels = domain.split(".")
        out += ["dotted" if len(labels) > 1 else "undotted", "local_edge" if local[0].isalnum() and local[-1].isalnum() else "local_odd"]
        out.append("tld" if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 12 else "no_tld")
        out.append("host" if all(x and x.replace("-", "").isalnum() for x in labels) else "odd_host")
        out.append("further" if behind in "-." or ahead and ahead in "._%+-" else "whole")
    else:
        digits = re.sub("[^0-9]", "", span)
        if len(digits) < 4 or not _NUMERIC.fullmatch(span) or not span[-1].isdigit():
            return None
        signs = re.sub("[0-9]", "", span)
        out.append(f"digits_{min(len(digits), 20)}")
        out.append(f"signs_{''.join(sorted(set(signs.replace('+', ''))))}" if signs.replace("+", "") else "signs_none")
        out.append("plus" if span[0] == "+" else "no_plus")
        if kind == 1:
            parts = span.split(".")
            out.append(f"parts_{min(len(parts), 6)}")
            out.append("bytes" if all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts) else "no_bytes")
        elif kind == 2:
            groups = re.split("[^0-9]+", span.lstrip("+("))
            out += ["sum" if luhn(digits) else "no_sum", "even" if len(set(map(len, groups))) == 1 else "uneven"]
            out.append("length" if 13 <= len(digits) <= 19 else "no_length")
        else:
            out.append("length" if 10 <= len(digits) <= 15 else "no_length")
        out.append("further" if behind in "-." or ahead and ahead in "+-." else "whole")
    return tuple(f"{KINDS[kind]}:{x}" for x in out)


def region(text: str, begin: int, end: int) -> Region:
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, begin, end)]
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    by_end: list[list[tuple[int, int, tuple[str, ...]]]] = [[] for _ in tokens]
    last_at = text.rfind("@", begin, end)
    for i, s in enumerate(starts):
        first = text[s]
        if not (first.isalnum() or first in "+(._%-"):
            continue
        ahead = text[s - 1] if s else ""
        for j in range(i, min(i + LONGEST, len(tokens))):
            span = text[s : ends[j]]
            if span[-1] == " ":
                continue
            behind = text[ends[j]] if ends[j] < len(text) else ""
            kinds = [0] if "@" in span else ([1, 2, 3] if _NUMERIC.fullmatch(span) else [])
            for kind in kinds:
                names = _features(kind, span, ahead, behind)
                if names:
                    by_end[j].append((i, kind, names))
            if not kinds and s > last_at:
                break  # no longer span from here is of any kind
    other = [(f"other:{'digit' if text[s].isdigit() else 'letter' if text[s].isalpha() else text[s]}",) for s in starts]
    return Region(starts, ends, by_end, other)


# ---------------------------------------------------------------- the field


class Field:
    """Feature and transition weights."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def _edges(self, r: Region) -> list[list[tuple[int, int, float]]]:
        """At each end token: (begin, type, score) of the segments that end there."""
        w = self.weights.get
        return [
            [(j, OTHER, sum(w(n, 0.0) for n in r.other[j])), *[(i, k, sum(w(n, 0.0) for n in names)) for i, k, names in r.by_end[j]]]
            for j in range(len(r.starts))
        ]

    def _pairs(self) -> np.ndarray:
        """Scores of neighbouring types; the last row is the region's begin."""
        n = OTHER + 1
        return np.array([[self.weights.get(f"pair:{a}:{b}", 0.0) for b in range(n)] for a in range(n + 1)])

    def best(self, r: Region) -> list[tuple[int, int, int]]:
        """(begin token, end token, kind) of the entities of the best segmentation; ties to the shorter, other first."""
        n, pairs = OTHER + 1, self._pairs()
        score = np.full((len(r.starts) + 1, n + 1), -np.inf)
        score[0, n] = 0.0
        back: list[list[tuple[int, int] | None]] = [[None] * (n + 1) for _ in range(len(r.starts) + 1)]
        for j, edges in enumerate(self._edges(r)):
            for i, k, s in edges:
                ways = score[i] + pairs[:, k]
                a = int(np.argmax(ways))
                if ways[a] + s > score[j + 1, k]:
                    score[j + 1, k] = ways[a] + s
                    back[j + 1][k] = (i, a)
        out, at, k = [], len(r.starts), int(np.argmax(score[-1]))
        while at > 0:
            i, a = back[at][k]
            if k != OTHER:
                out.append((i, at - 1, k))
            at, k = i, a
        return out[::-1]

    def learn(self, r: Region, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log likelihood of a region's segmentation (forward and backward over segment ends)."""
        n, size, pairs = OTHER + 1, len(r.starts), self._pairs()
        edges = self._edges(r)
        alpha = np.full((size + 1, n + 1), -np.inf)
        alpha[0, n] = 0.0
        for j in range(size):
            for i, k, s in edges[j]:
                alpha[j + 1, k] = np.logaddexp(alpha[j + 1, k], s + np.logaddexp.reduce(alpha[i] + pairs[:, k]))
        beta = np.full((size + 1, n + 1), -np.inf)
        beta[size, :n] = 0.0
        for j in range(size - 1, -1, -1):
            for i, k, s in edges[j]:
                beta[i] = np.logaddexp(beta[i], pairs[:, k] + s + beta[j + 1, k])
        whole = np.logaddexp.reduce(alpha[size])
        change: dict[str, float] = {}

        def add(names: Sequence[str], x: float) -> None:
            for name in names:
                change[name] = change.get(name, 0.0) + x

        for j in range(size):
            names = {(j, OTHER): r.other[j]} | {(i, k): f for i, k, f in r.by_end[j]}
            for i, k, s in edges[j]:
                ways = np.exp(np.minimum(alpha[i] + pairs[:, k] + s + beta[j + 1, k] - whole, 0.0))
                total = float(ways.sum())
                if total > 1e-9:
                    add(names[i, k], -total)
                    for a in np.flatnonzero(ways > 1e-9):
                        add((f"pair:{a}:{k}",), -float(ways[a]))
        before, at, wanted = n, 0, {i: (j, k) for i, j, k in gold}
        while at < size:
            j, k = wanted.get(at, (at, OTHER))
            add(r.other[at] if k == OTHER else next(f for i, kind, f in r.by_end[j] if (i, kind) == (at, k)), 1.0)
            add((f"pair:{before}:{k}",), 1.0)
            before, at = k, j + 1
        for name, x in change.items():
            self.weights[name] = 0.9999 * self.weights.get(name, 0.0) + rate * x


def gold_segments(r: Region, text: str, base: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The pattern matches inside a region as token segments, leftmost first.

    A match is a candidate at any length: one that the region has no segment for is given one, over the tokens that it meets.
    """
    out, done = [], -1
    for s, k, e in base:
        i, j = bisect_right(r.starts, s) - 1, min(bisect_left(r.ends, e), len(r.ends) - 1)  # a match may go on in the next region
        if i <= done:
            continue
        if not any((b, kind) == (i, k) for b, kind, _ in r.by_end[j]):
            begin, end = r.starts[i], r.ends[j]
            ahead, behind = text[begin - 1] if begin else "", text[end] if end < len(text) else ""
            r.by_end[j].append((i, k, _features(k, text[begin:end], ahead, behind) or (f"{KINDS[k]}:bias", f"{KINDS[k]}:odd")))
        out.append((i, j, k))
        done = j
    return out


def pieces_of(text: str, begin: int, end: int, base: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """A region in pieces of about ``PIECE`` characters, cut where neither a match nor a token goes on; ``base`` is sorted."""
    at, k = begin, 0
    while end - at > PIECE:
        stop, before = at + PIECE, -1
        while before != stop:
            before = stop
            while k < len(base) and base[k][0] < stop:
                stop, k = max(stop, base[k][2]), k + 1
            while stop < end and text[stop - 1].isalnum() and text[stop].isalnum():
                stop += 1
        yield at, min(stop, end)
        at = stop
    if at < end:
        yield at, end


def fit_field(texts: Sequence[str], epochs: int = _EPOCHS) -> Field:
    """A field from all pattern matches of texts, in their order; long regions are learnt from in pieces."""
    examples = []
    for text in texts:
        base = base_spans(text)
        begins = [b[0] for b in base]
        for begin, end in regions_of(text):
            own = base[bisect_left(begins, begin) : bisect_left(begins, end)]
            for a, b in pieces_of(text, begin, end, own):
                r = region(text, a, b)
                examples.append((r, gold_segments(r, text, [x for x in own if a <= x[0] < b])))
    field = Field({"other:letter": 1.0})
    for epoch in range(epochs):
        for r, gold in examples:
            field.learn(r, gold, 0.3 / (1 + epoch))
    return field


def fit_on(docs: DataFrame, rows: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``rows`` documents (doc_id, text), drawn by a hash of the id, fitted in one task."""
    drawn = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("draw"))
    drawn = drawn.distinct().orderBy("draw", "doc_id").limit(rows)
    sample = docs.join(F.broadcast(drawn), "doc_id").filter(F.col("text").rlike("[0-9@]"))

    def task(part: pd.DataFrame) -> pd.DataFrame:
        weights = fit_field(part.sort_values(["draw", "text"])["text"].tolist()).weights
        return pd.DataFrame({"name": list(weights), "weight": [float(x) for x in weights.values()]})

    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(task, "name string, weight double").collect()
    return {r["name"]: r["weight"] for r in fitted}


def find_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pattern matches of a text, and all spans: (start, kind index, end), sorted."""
    base = base_spans(text)
    if not _NOTED.search(text):
        return base, base
    per_kind = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
    more = []
    for begin, end in regions_of(text):
        r = region(text, begin, end)
        if not any(r.by_end):
            continue
        for i, j, k in field.best(r):
            s, e = r.starts[i], r.ends[j]
            at = bisect_left(per_kind[k], (e, -1))  # those before it start ahead of the span's end
            if not at or per_kind[k][at - 1][1] <= s:
                more.append((s, k, e))
    return base, sorted(base + more)


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _scanned(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    field = Field(weights)
    for batch in text_slices(batches):
        rows = []
        for text in texts_of(batch):
            base, every = find_spans(text, field)
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((*[sum(k == kind for _, k, _ in base) for kind in range(4)], digest, joined(every), len(every) - len(base)))
        columns = [batch.column("doc_id"), *[pa.array(c) for c in zip(*rows)]]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _DDL.split(", ")])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: counts of the pattern matches by kind, their digest, all spans, n_added by the field.

    A null or empty text has no spans. Repeated rows give equal rows, a null id stays null, an empty table gives an empty
    result, other columns are ignored. Spans of one kind never overlap; of equal starts the kinds come in their fixed order.
    Very long texts are read whole, in time linear in their length; an added span has at most ``LONGEST`` tokens.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    weights = fit_on(picked, rows)
    return picked.mapInArrow(lambda b: _scanned(b, weights), _DDL)


def redacted(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = e
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with personal data replaced in ``text``, all columns kept.

    A null text stays null. A column ``n_chars`` is brought up to date where the text changed.
    """
    weights = fit_on(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), rows)
    schema = docs.schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in text_slices(batches):
            old = batch.column("text").to_pylist()
            new = [None if t is None else redacted(t, find_spans(t, field)[1]) for t in old]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in columns:
                counts = [c if a == b else len(b) for c, a, b in zip(batch.column("n_chars").to_pylist(), old, new)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(replace, schema)


@query("op8_semi_markov_pii")
def _(spark, sf):
    return find_personal_data(table(spark, sf, "documents"))
