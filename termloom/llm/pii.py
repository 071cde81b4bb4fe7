"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained on the small labelled table of
``pii_examples`` (maximum likelihood, forward-backward, AdaGrad) and adds what the patterns do not
cover: spelled-out addresses, numbers without country code, identity and account numbers. Its words are
runs of non-blank characters, its features their shape (letters, digits by run length, signs) and the
shapes beside them; a line is a sequence. Texts are decoded in numpy batches: a word whose label is
"none" whatever its neighbours are labelled, by the largest gain that transitions could give, is fixed,
which is exact; Viterbi decodes the runs between fixed words, many in step.

Defined cases: a null text is empty and has no spans; rows are independent of each other, so repeated
rows, ties and extra columns have no effect; a long text is decoded line by line.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termloom.llm import pii_examples
from termloom.llm.common import ship, text_groups

ship(__name__)
ship(pii_examples.__name__)

KINDS = ("email", "ip", "card", "phone", "id")
LABELS = ("none", *KINDS)
BASE = 4
SHAPES = 1 << 12
EDGE = 2 * SHAPES
IMPOSSIBLE = -1e3
#: Where training starts for the label "none": unseen shapes are no personal data without evidence beside them.
PRIOR = 2.0
CHUNK = 1 << 20
PUNCTUATION = ".,;:!?()[]{}<>\"'"

# ---- base patterns ---------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match takes whole runs of digits, so it can only start at the first digit of one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, index of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every sign @ belongs to the run of local characters before it, from the last match on."""
    after, at = 0, text.find("@")
    while at >= 0:
        before = text[after:at]
        start = after + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        after = domain.end() if domain else at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[Span]:
    found = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- word shapes -----------------------------------------------------------------------------

#: Classes of characters: 0 blank, 1 upper, 2 lower and all beyond ASCII, 3 digit, 5 signs, 6 and on: each sign its own.
_CLASS = np.full(129, 2, np.uint8)
_CLASS[:128] = [0 if c in b" \t\n\x0b\f\r" else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 5 for c in range(128)]
for _i, _c in enumerate("@([.-+)/:_#'\","):
    _CLASS[ord(_c)] = 6 + _i
_BRACKET = 8  # the last class that, like a digit, lets a word be personal data
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def shapes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape) of the words of a text given as code points.

    Words without a digit, @, ( or [ have a shape of SHAPES or more: they are no personal data.
    """
    kind = _CLASS[np.minimum(codes, 128)]
    change = np.empty(len(kind), bool)
    change[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    at = np.flatnonzero(change)
    runs = kind[at]
    length = np.diff(at, append=len(kind))
    word = runs != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = np.flatnonzero(first)
    if not len(heads):
        none = np.empty(0, np.int64)
        return none, none, none
    symbol = runs.astype(np.uint64) * np.uint64(8)
    digits = runs == 3
    symbol[digits] += np.minimum(length[digits], 7).astype(np.uint64)
    number = np.cumsum(first) - 1
    place = np.minimum(np.arange(len(runs)) - heads[np.maximum(number, 0)], len(_POWERS) - 1)
    symbol = np.where(word, (symbol + np.uint64(1)) * _POWERS[np.maximum(place, 0)], np.uint64(0))
    total = np.add.reduceat(symbol, heads)
    total ^= total >> np.uint64(29)
    shape = ((total * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64) % SHAPES
    signs = (digits | ((runs >= 6) & (runs <= _BRACKET))).astype(np.int64)
    shape += np.where(np.add.reduceat(signs, heads) > 0, 0, SHAPES)
    last = np.append(heads[1:], len(runs)) - 1
    last -= ~word[last]
    return at[heads], at[last] + length[last], shape


# ---- the field -------------------------------------------------------------------------------


class Field:
    """Weights of a linear-chain conditional random field: shape at, before and after; transitions."""

    def __init__(self, at: np.ndarray, before: np.ndarray, after: np.ndarray, steps: np.ndarray) -> None:
        self.at, self.before, self.after, self.steps = at, before, after, steps
        # the most that label k can win over "none" from both of its transitions
        gain = (steps[:, None, :] - steps[:, None, :1]).transpose(2, 0, 1).max(axis=(1, 2))
        onward = (steps - steps[:1]).max(axis=1)
        self.gain = gain + np.maximum(onward, 0)

    def emissions(self, shape: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """head, tail: whether a word is the first or last of its line (its neighbour is shape EDGE)."""
        before = np.where(head, EDGE, np.roll(shape, 1))
        after = np.where(tail, EDGE, np.roll(shape, -1))
        return self.at[shape] + self.before[before] + self.after[after]

    def decode(self, shape: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The most probable labels of the lines that ``head`` and ``tail`` mark."""
        scores = self.emissions(shape, head, tail)
        labels = np.zeros(len(shape), np.int64)
        open_ = (scores[:, 1:] + self.gain[1:]).max(axis=1) > scores[:, 0]
        where = np.flatnonzero(open_)
        if not len(where):
            return labels
        starts = np.ones(len(where), bool)
        starts[1:] = (np.diff(where) > 1) | head[where[1:]]
        first = np.flatnonzero(starts)
        length = np.diff(first, append=len(where))
        order = np.argsort(-length, kind="stable")
        begin, length = where[first[order]], length[order]
        states = len(LABELS)
        best = scores[begin] + np.where(head[begin, None], 0, self.steps[0])
        back = np.zeros((len(begin), int(length[0]), states), np.int8)
        for t in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -t, "left"))  # runs longer than t
            ways = best[:n, :, None] + self.steps
            back[:n, t] = ways.argmax(axis=1)
            best[:n] = ways.max(axis=1) + scores[begin[:n] + t]
        final = begin + length - 1
        best += np.where(tail[final, None], 0, self.steps[:, 0])
        state = best.argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            n = int(np.searchsorted(-length, -t, "left"))
            labels[begin[:n] + t] = state[:n]
            state[:n] = back[np.arange(n), t, state[:n]]
        return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood by AdaGrad, a step for each line; the same weights on every run."""
    states = len(LABELS)
    weights = [np.zeros((EDGE + 1, states)) for _ in range(3)] + [np.zeros((states, states))]
    seen = [np.full_like(w, 1e-2) for w in weights]
    weights[0][:, 0] = PRIOR
    weights[0][SHAPES:, 1:] = IMPOSSIBLE
    lines = []
    for text, spans in examples:
        start, end, shape = shapes(np.frombuffer(text.encode("utf-32-le"), "<u4"))
        gold = np.zeros(len(shape), np.int64)
        for kind, s, e in spans:
            gold[(start < e) & (end > s)] = LABELS.index(kind)
        around = (shape, np.r_[EDGE, shape[:-1]], np.r_[shape[1:], EDGE])
        lines.append((around, gold))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(lines)):
            around, gold = lines[i]
            n, steps = len(gold), weights[3]
            scores = sum(w[a] for w, a in zip(weights, around))
            ahead, behind = np.zeros((n, states)), np.zeros((n, states))
            ahead[0] = scores[0]
            for t in range(1, n):
                ahead[t] = _log_sum(ahead[t - 1][:, None] + steps, 0) + scores[t]
            for t in range(n - 2, -1, -1):
                behind[t] = _log_sum(steps + (scores[t + 1] + behind[t + 1])[None], 1)
            total = _log_sum(ahead[-1], 0)
            wrong = np.exp(ahead + behind - total)
            wrong[np.arange(n), gold] -= 1
            slope = np.zeros_like(steps)
            for t in range(1, n):
                slope += np.exp(ahead[t - 1][:, None] + steps + (scores[t] + behind[t])[None] - total)
                slope[gold[t - 1], gold[t]] -= 1
            for w, s, a in zip(weights, seen, around):
                which, inverse = np.unique(a, return_inverse=True)
                step = np.zeros((len(which), states))
                np.add.at(step, inverse, wrong)
                step += decay * np.where(w[which] == IMPOSSIBLE, 0, w[which])
                s[which] += step**2
                w[which] -= rate * step / np.sqrt(s[which])
            slope += decay * steps
            seen[3] += slope**2
            steps -= rate * slope / np.sqrt(seen[3])
    return Field(*(w.astype(np.float32) for w in weights))


@functools.cache
def trained() -> Field:
    return train(pii_examples.rows())


# ---- spans of texts --------------------------------------------------------------------------


def _line_blocks(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (text number, where it starts, whole lines) of about CHUNK characters together."""
    block, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                cut = text.rfind("\n", at, at + CHUNK)
                if cut < 0:
                    cut = text.find("\n", at + CHUNK)
                end = cut + 1 if cut >= 0 else end
            block.append((i, at, text[at:end]))
            size += end - at
            at = end
            if size >= CHUNK:
                yield block
                block, size = [], 0
    if block:
        yield block


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans of equally labelled neighbouring words, without punctuation at their ends."""
    out: list[list[Span]] = [[] for _ in texts]
    for block in _line_blocks(texts):
        joined = "\n".join(part for _, _, part in block)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        start, end, shape = shapes(codes)
        if not len(start):
            continue
        line = np.searchsorted(np.flatnonzero(codes == 10), start)
        head = np.ones(len(start), bool)
        head[1:] = line[1:] != line[:-1]
        tail = np.append(head[1:], True)
        labels = field.decode(shape, head, tail)
        hits = np.flatnonzero(labels)
        if not len(hits):
            continue
        begins = np.ones(len(hits), bool)
        begins[1:] = (np.diff(hits) > 1) | (labels[hits[1:]] != labels[hits[:-1]]) | head[hits[1:]]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(hits)) - 1
        sizes = np.array([len(part) + 1 for _, _, part in block])
        offsets = np.cumsum(sizes) - sizes
        for a, b in zip(hits[first].tolist(), hits[last].tolist()):
            s, e = int(start[a]), int(end[b])
            while s < e and joined[s] in PUNCTUATION and not (joined[s] == "(" and ")" in joined[s:e]):
                s += 1
            while e > s and joined[e - 1] in PUNCTUATION:
                e -= 1
            if s < e:
                k = int(np.searchsorted(offsets, s, "right")) - 1
                i, at, _ = block[k]
                shift = at - int(offsets[k])
                out[i].append((s + shift, int(labels[a]) - 1, e + shift))
    return out


def spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Per text: the base spans, and these with those of the field that overlap none of them."""
    out = []
    for text, more in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        # a span meets one that begins before its end if the furthest end of those is behind its start
        starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
        own = [x for x in more if not (n := bisect_left(starts, x[2])) or reach[n - 1] <= x[0]]
        out.append((base, sorted(base + own)))
    return out


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _found(field: Field):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for texts in text_groups(batch.column(1), CHUNK):
                for base, all_ in spans(texts, field):
                    n = [sum(k == i for _, k, _ in base) for i in range(BASE)]
                    rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(all_)))
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:BASE]] + [pa.array(c, pa.string()) for c in columns[BASE:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], FOUND)

    return find


FOUND = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def found(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: doc_id, the number of base spans by kind, their digest, and all spans."""
    fields = [docs.schema["doc_id"]]
    fields += [StructField(n, LongType()) for n in FOUND[1:5]] + [StructField(n, StringType()) for n in FOUND[5:]]
    return docs.select("doc_id", "text").mapInArrow(_found(field or trained()), StructType(fields))


def redact(text: str, all_: list[Span]) -> str:
    """Each span, or group of overlapping spans, as the kind of its first in angle brackets."""
    out, at, i = [], 0, 0
    while i < len(all_):
        start, kind, end = all_[i]
        i += 1
        while i < len(all_) and all_[i][0] < end:
            end = max(end, all_[i][2])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _redacted(field: Field):
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            old, new = batch.column(at), []
            for texts in text_groups(old, CHUNK):
                new += [redact(t, all_) if all_ else t for t, (_, all_) in zip(texts, spans(texts, field))]
            new = [x if was.is_valid else None for x, was in zip(new, old)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                counts = [
                    n.as_py() if not was.is_valid or was.as_py() == x else len(x) for n, was, x in zip(columns[k], old, new)
                ]
                columns[k] = pa.array(counts, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return change


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data replaced; columns as before, ``n_chars`` (if there) recounted."""
    return docs.mapInArrow(_redacted(field or trained()), docs.schema)
