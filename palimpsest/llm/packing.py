"""Sum-of-squares online packing of token ids into windows of a fixed length."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidied

#: Windows held open by a task; beyond that, the open ones are filled up from one another.
MOST_OPEN = 2048
#: Pre-tokens whose ids a task remembers, at most (some 200 bytes each); then it begins anew.
MOST_KNOWN = 300_000
SLICE = 2 << 20
#: Texts of these characters alone split into pre-tokens in the same way here as in the tokenizer.
PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-/:-@\[-`{-~ \t-\r]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
WHITE = re.compile(r"[ \t-\r]+")
JOINED = 512


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitIds:
    """Ids of whole texts, put together from the remembered ids of their pre-tokens.

    The tokenizer composes (NFC), lower-cases and splits before it merges, so that a pre-token's ids
    don't depend on its neighbours. Texts where that could fail (combining marks after
    letters that are lower-cased here, or the strings of special tokens) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        names = self.tok.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Encodes many pre-tokens at a time and cuts the ids where a word ends; other units one by one."""
        words = [x for x in new if PLAIN.fullmatch(x)]
        odd = [x for x in new if not PLAIN.fullmatch(x)]
        self.known.update(zip(odd, self.encode(odd), strict=True))
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, got in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            ends = (np.flatnonzero(self.ends[np.frombuffer(got, "<u4")]) + 1) * 4
            if len(ends) == len(group) and ends[-1] == len(got):
                bounds = [0, *ends.tolist()]
                self.known.update(zip(group, [got[i:j] for i, j in zip(bounds, bounds[1:], strict=False)], strict=True))
            else:
                self.known.update(zip(group, self.encode(group), strict=True))

    def split(self, text: bytes) -> list[str] | None:
        """Pre-tokens, or where a unit has other characters, that unit; None where the text must be encoded whole."""
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return None
        s = text.decode()
        if PLAIN.fullmatch(lower := s.lower()):
            return PIECE.findall(lower)
        out: list[str] = []
        for unit in WHITE.split(s):
            if PLAIN.fullmatch(lower := unit.lower()):
                out += PIECE.findall(lower)
            else:
                out.append(unit)
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        split = [self.split(t) for t in texts]
        new = set().union(*(x for x in split if x)).difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [self.encode([t.decode()])[0] if x is None else b"".join(map(get, x)) for t, x in zip(texts, split, strict=True)]


class SumOfSquares:
    """Open windows by fill level; a run of s ids goes to the level that makes the sum of squared level counts smallest.

    With N(h) windows at level h, the change is 2 N(s) + 1 for a new window, 2 (N(h + s) - N(h) + 1)
    for one at level h, and 1 - 2 N(h) where that fills it. Equal changes go to the fullest window.
    """

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level(self, s: int) -> int:
        here = self.count[1 : self.size - s + 1]
        change = 2 * (self.count[1 + s : self.size + 1] - here + 1)
        if len(change):
            change[-1] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if here[best] and change[best] <= 2 * self.count[s] + 1:
                return best + 1
        return 0

    def put(self, piece: tuple, s: int) -> list | None:
        """The window, if that filled it."""
        if s == self.size:
            return [piece]
        h = self.level(s)
        window = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        self.n_open += (h == 0) - (h + s == self.size)
        window.append(piece)
        if h + s == self.size:
            return window
        self.count[h + s] += 1
        self.open.setdefault(h + s, []).append(window)
        return None

    def drain(self) -> Iterator[list]:
        """All open windows, filled up: pieces of the emptiest are cut to fill the fullest, so that one at most stays short."""
        left = sorted(((h, w) for h, ws in self.open.items() for w in ws), key=lambda x: -x[0])
        self.count[:], self.open, self.n_open = 0, {}, 0
        loose: list[tuple] = []
        first, last = 0, len(left)
        while first < last or loose:
            room, window = (self.size - left[first][0], left[first][1]) if first < last else (self.size, [])
            first += first < last
            while room and (loose or first < last):
                if not loose:
                    last -= 1
                    loose = left[last][1]
                doc, start, ids, total = loose.pop()
                take = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                room -= take
                if 4 * take < len(ids):
                    loose.append((doc, start + take, ids[4 * take :], total))
            yield window


def packed(docs: Iterable[tuple[object, bytes]], size: int) -> Iterator[list[tuple]]:
    """Windows of pieces (document, start, ids as little-endian 32-bit numbers, ids of the document)."""
    pack = SumOfSquares(size)
    for doc, ids in docs:
        total = len(ids) // 4
        for start in range(0, total, size):
            piece = ids[4 * start : 4 * (start + size)]
            if window := pack.put((doc, start, piece, total), len(piece) // 4):
                yield window
        if pack.n_open > MOST_OPEN:
            yield from pack.drain()
    yield from pack.drain()


_ids: dict[str, UnitIds] = {}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Packs the token ids of all texts, each ended by `end_id`, into windows of `size` ids.

    Returns a row per piece: key, start, length, ids (binary, unsigned little-endian 32 bits),
    doc_tokens, sequence_id, offset. Every task packs the documents of its own input split, so that
    nothing is shuffled; documents longer than a window fill whole windows first; at its end a task
    fills its open windows from one another and leaves one at most short, as it does whenever
    MOST_OPEN windows are open, which bounds its memory. sequence_id holds the split's number above
    2**33, so that a repeated task gives the same ids.

    Null and empty texts are one piece that holds the end id. Repeated rows are packed one by one.
    An empty table gives no rows; other columns are left out.
    """
    path = path or tokenizer_path()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids.setdefault(path, None) or _ids.update({path: UnitIds(path)}) or _ids[path]
        base = TaskContext.get().partitionId() << 33

        def read() -> Iterator[tuple[object, bytes]]:
            for part in slices(batches, "_text", SLICE):
                texts = [x or b"" for x in part.column("_text").to_pylist()]
                yield from zip(part.column(key).to_pylist(), (ids + end for ids in encode(texts)), strict=True)

        rows: list[tuple] = []
        types = [pa.field(key, key_type[0]), *(pa.field(n, pa.binary() if n == "ids" else pa.int64()) for n in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"))]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=pa.schema(types))

        for n, window in enumerate(packed(read(), size)):
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, ids, total, base + n, offset))
                offset += len(ids) // 4
            if len(rows) >= 2000:
                yield batch()
        if rows:
            yield batch()
        encode.known.clear()

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = [to_arrow_type(docs.schema[key].dataType)]
    return docs.select(F.col(key), F.col(text).cast("binary").alias("_text")).mapInArrow(tidied(run), schema)
