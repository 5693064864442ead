"""Cost-balanced packing of tokenized documents into fixed-length training sequences.

A document's ids are those of the tokenizer, then an end id. A task reads its documents in
order and packs them in groups of about ``GROUP_TOKENS`` tokens, so its memory is bounded,
nothing is shuffled, and padding is under one sequence for each group. In a group:

1. Whole sequences are cut off documents longer than a sequence.
2. The rest needs S = ceil(tokens / sequence) sequences. In descending order of length, each
   goes to the sequence with the lowest estimated attention cost (linear plus quadratic in the
   length of each piece) among those with room for it. Where none has room, the document is
   cut at the largest room left; S sequences have room for all, so every token is placed.

Sequences are numbered by partition and order in it: a retried task numbers them alike.

Texts are cut where the tokenizer's own rule surely begins a new word: before a space or line break
between two characters that aren't white space, behind such a line break, and where letters,
digits and signs meet (not behind an apostrophe, which may take letters along). Pieces are byte
ranges of a slice of a batch; a table of hashes, kept by the worker, tells those whose ids are known
(their bytes are compared, too), and only the others reach the tokenizer. Ids are gathered in
numpy. A text that holds the string of one of the tokenizer's added tokens is encoded by it whole,
as it finds them in the text.

Defined results: a null or empty text has the end id only. Ids may be null or repeat; each row
is a document. An empty table has no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frauddeck.llm import common as C

SEQUENCE, END_ID, GROUP_TOKENS = 2048, 1, 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE
#: Places for known pieces (half of them are filled before the table starts anew), and the longest piece kept.
PLACES, KEPT_LENGTH = 1 << 21, 48

RESULT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A word of letters of one or two bytes, and a space before it.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]){1,40}")
#: First bytes of characters some of which are white space, and all other bytes of characters that are.
_MAYBE_SPACE = C.byte_table([(0, 32), (127, 127), (0xC2, 0xC2), (0xE1, 0xE3)])
#: Letters, digits and signs among the bytes of one-byte characters.
_KIND = C.byte_table([(65, 90), (97, 122)]) + 2 * C.byte_table([(48, 57)]) + 3 * C.byte_table([(33, 47), (58, 64), (91, 96), (123, 126)])


def _shown() -> list[str]:
    """How a byte-level vocabulary shows each byte: itself if it prints, else a sign from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


_SHOWN = dict(enumerate(_shown()))


def begins(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: the first bytes of texts, and the places told in the module's text."""
    out = np.zeros(len(data) + 1, bool)
    kind = _KIND[data]
    left, right = kind[:-1], kind[1:]
    out[1:-1] = (left != right) & (left > 0) & (right > 0) & ~((data[:-1] == 39) & (right == 1))
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[_MAYBE_SPACE[data[at + 1]] == 0]
    # the first byte of the character before: one to four bytes back
    first = data[at - 1]
    for k in (2, 3, 4):
        inside = (first & 0xC0) == 0x80
        first = np.where(inside, data[np.maximum(at - k, 0)], first)
    at = at[_MAYBE_SPACE[first] == 0]
    out[at] = True
    out[at[data[at] == 10] + 1] = True
    out[off] = True
    return np.flatnonzero(out[:-1])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Kept:
    """Byte strings or ids of known pieces, one after another in one array that doubles when full."""

    def __init__(self, kind: str):
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def add(self, new: np.ndarray) -> int:
        at, self.n = self.n, self.n + len(new)
        if self.n > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(max(at, len(new)) + len(new), self.data.dtype)])
        self.data[at:self.n] = new
        return at


class Encoder:
    """Token ids of the texts in a UTF-8 buffer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line, = self._ids("\n").tolist()
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(PLACES, np.uint64)
        self.at = np.zeros((PLACES, 4), np.int32)  # bytes: start, size; ids: start, size
        self.bytes, self.ids, self.filled = Kept("u1"), Kept("<u4"), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and their numbers: a word of letters by the model
        itself; all others as one text, parted by line breaks, each of which is one id."""
        found: list = [None] * len(pieces)
        together, tokenize = [], self.tokenizer.model.tokenize
        for i, x in enumerate(pieces):
            word = x[1:] if x[0] == 32 else x
            if word.isalpha():  # one-byte letters
                found[i] = [t.id for t in tokenize(("Ġ" if x[0] == 32 else "") + word.decode())]
            elif _WORD.fullmatch(x):
                found[i] = [t.id for t in tokenize(x.decode("latin-1").translate(_SHOWN))]
            else:
                text = x.decode()
                word = text[text[0] in " \n":]
                if word.split() == [word]:  # no white space inside or behind
                    together.append((i, text))
                else:
                    found[i] = self._ids(text)
        if together:
            ids = self._ids("".join([x if x[0] == "\n" else "\n" + x for _, x in together]))
            at = np.append(np.flatnonzero(ids == self.line), len(ids))
            for (i, x), s, e in zip(together, at[:-1].tolist(), at[1:].tolist()):
                found[i] = ids[s if x[0] == "\n" else s + 1:e]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin (one entry more than texts)."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        starts = begins(data, off)
        text = np.searchsorted(off, starts, side="right") - 1
        apart = None
        if self._holds_added(data):  # a text of added tokens is one piece
            whole = np.array([any(x in data[off[i]:off[i + 1]].tobytes() for x in self.added) for i in range(n)])
            keep = ~whole[text] | (starts == off[text])
            starts, text = starts[keep], text[keep]
            apart = whole[text]
        ends = np.append(starts[1:], len(data))
        ids, sizes = self._of_pieces(data, starts, ends, apart)
        counts = np.bincount(text, sizes, n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _holds_added(self, data: np.ndarray) -> bool:
        raw = data.tobytes()
        return any(x in raw for x in self.added)

    def _of_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        h = C.run_hashes(data, starts, ends)
        place = (h & np.uint64(PLACES - 1)).astype(np.int64)
        at = self.at[place]
        known = (self.hashes[place] == h) & (at[:, 1] == size) & (size <= KEPT_LENGTH)
        if apart is not None:
            known &= ~apart
        k = np.flatnonzero(known)
        same = self.bytes.data[spread(at[k, 0].astype(np.int64), size[k])] == data[spread(starts[k], size[k])]
        if not same.all():  # equal hashes of different bytes
            begin = np.cumsum(size[k]) - size[k]
            known[k[~np.logical_and.reduceat(same, begin)]] = False
            k = np.flatnonzero(known)
        new = np.flatnonzero(~known)
        id_at, id_size = at[:, 2].astype(np.int64), at[:, 3].astype(np.int64)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(x, len(number)) for x in pieces), np.int64, len(pieces))
            learnt, sizes = self._learn(list(number))
            begin, base = np.cumsum(sizes) - sizes, self.ids.n
            id_at[new], id_size[new] = base + begin[which], sizes[which]
            self.ids.add(learnt)
        out = self.ids.data[spread(id_at, id_size)]
        if len(new):
            self.ids.n = base  # of all that was learnt, short pieces whose places are free stay
            if self.filled > PLACES // 2:
                self._clear()
            first = np.zeros(len(number), np.int64)
            first[which[::-1]] = new[::-1]
            short = np.flatnonzero((size[first] <= KEPT_LENGTH) & (self.at[place[first], 1] == 0))
            if apart is not None:
                short = short[~apart[first[short]]]
            self.filled += len(short)
            first, sizes, begin = first[short], sizes[short], begin[short]
            i = self.ids.add(learnt[spread(begin, sizes)])
            b = self.bytes.add(data[spread(starts[first], size[first])])
            self.hashes[place[first]] = h[first]
            self.at[place[first]] = np.stack([b + np.cumsum(size[first]) - size[first], size[first], i + np.cumsum(sizes) - sizes, sizes], axis=1)
        return out, id_size


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder: tasks that it runs one after another share the pieces it has seen."""
    return Encoder(path)


def pack(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence number, offset) of every piece; all tokens are placed."""
    out, number = [], 0
    for d in np.flatnonzero(lengths >= sequence).tolist():
        for k in range(int(lengths[d]) // sequence):
            out.append((d, k * sequence, sequence, number, 0))
            number += 1
    rest = lengths % sequence
    count = -(-int(rest.sum()) // sequence)
    cost, room = np.zeros(count), np.full(count, sequence)

    def put(d: int, start: int, n: int, q: int) -> None:
        out.append((d, start, n, number + q, sequence - int(room[q])))
        room[q] -= n
        cost[q] += LINEAR * n + QUADRATIC * n * n

    order = np.argsort(-rest, kind="stable")
    for d in order[rest[order] > 0].tolist():
        n = int(rest[d])
        start = int(lengths[d]) - n
        while n:
            q = int(np.argmin(np.where(room >= n, cost, np.inf)))
            if room[q] < n:  # nowhere is room for all of it
                q = int(np.argmax(room))
            part = min(n, int(room[q]))
            put(d, start, part, q)
            start, n = start + part, n - part
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, sequence: int = SEQUENCE, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id`` and ``RESULT``. Each id of each document lies in one piece."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + T.StructType.fromDDL(RESULT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        base, number = TaskContext.get().partitionId() << 33, 0
        ids, counts, texts, size = [], [], [], 0

        def group() -> pa.RecordBatch:
            nonlocal number
            lengths = np.concatenate(counts)
            begin, tokens = np.cumsum(lengths) - lengths, np.concatenate(texts)
            rows = pack(lengths, sequence)
            d, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*rows))
            raw = memoryview(tokens).cast("B")
            crc = [zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip((begin[d] + start).tolist(), length.tolist())]
            first, number = base + number, number + int(seq.max()) + 1
            return pa.record_batch([pa.concat_arrays(ids).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                                    pa.array(lengths[d]), pa.array(seq + first), pa.array(offset)], schema.names)

        for batch in batches:
            for a, b in C.slices(batch.column(1)):
                data, off = C.utf8(batch.column(1).slice(a, b - a))
                tokens, at = encode(data, off)
                ids.append(batch.column(0).slice(a, b - a))
                texts.append(np.insert(tokens, at[1:], end_id).astype("<u4"))  # the end id after each text's ids
                counts.append(np.diff(at) + 1)
                size += len(texts[-1])
                if size >= group_tokens:
                    yield group()
                    ids, counts, texts, size = [], [], [], 0
        if texts:
            yield group()

    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, schema)
