"""Sum-of-squares packing of tokenized documents into sequences.

Each document becomes its token ids and an end id; one longer than a sequence is cut
into pieces of whole sequences, the first piece taking what is over. Pieces are placed
one by one: into the open bin, or a new one, for which the sum over residual gaps of
the squared count of open bins with that gap becomes smallest.

Only (doc_id, piece, start, length) rows move, dealt evenly to tasks of about TASK_ROWS
rows. A task places its pieces in about descending order; then it closes the bins whose
gap is within a tolerance, and places the pieces of all others anew, with twice the
tolerance, until none is left. So every placement is by the sum of squares, and a task
ends with hardly a bin that is not full, if its pieces have complements at all. As a
task has many thousands of bins, tasks need not hand pieces to each other.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import checkpointed, record_batch, to_arrow
from perdura.llm.words import blocks, padded, stretch_hashes

SIZE, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Rows that one task packs, whatever the table's size.
TASK_ROWS = 200_000
#: Standard deviation, in tokens, of what is added to lengths before they are put in descending order.
STIR = 20
#: Slots (a power of two) of the table of chunks whose ids a Python worker keeps, and the ids that it keeps before it begins anew.
SLOTS, KEPT_IDS = 20, 6_000_000
#: Chunks that are encoded as the lines of one text, and bytes of texts whose chunks are looked up at once.
GROUP, PART_BYTES = 200, 60_000
PLAIN_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
#: White space (or near it) of any other kind: in such texts chunks might cut a run of white space.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class Encoder:
    """Ids of the byte-level vocabulary, by its tokenizer with its own settings, as little-endian uint32 bytes.

    A text is a row of chunks: runs of plain white space, each with the run of other
    characters after it. Pre-tokens hold no white space after another character, so none
    spans two chunks, and a chunk has the same ids by itself. The ids of chunks are kept in
    a table by hashes, with the chunks' bytes, which are compared; all chunks of some texts are looked up at once. Texts with
    an added token's literal, with other white space or at whose end is white space are
    encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known = np.zeros(1 << SLOTS, dtype=np.uint64)  # the hash in each slot; none is 0
        self.first = np.zeros(1 << SLOTS, dtype=np.int64)  # where its ids begin
        self.count = np.zeros(1 << SLOTS, dtype=np.int64)
        self.ids = np.empty(KEPT_IDS + PART_BYTES, dtype="<u4")
        self.used = 0
        self.head = np.zeros((2, 1 << SLOTS), dtype=np.uint64)  # its first 16 bytes
        self.from_byte = np.zeros(1 << SLOTS, dtype=np.int64)  # where all its bytes begin, if it has more
        self.size = np.zeros(1 << SLOTS, dtype=np.int64)
        self.bytes = np.empty(4 * (KEPT_IDS + PART_BYTES), dtype=np.uint8)
        self.used_bytes = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks and their ids. Those without other white space than one space before them are encoded as lines of
        one text, as a line break between others is a pre-token of its own; all others one by one."""
        lines = [c for c in chunks if c[0] > " " or c[0] == " " < c[1:2]] if len(self.line_break) == 1 else []
        single = list(set(chunks).difference(lines))
        yield from zip(single, self.whole(single), strict=True)
        groups = [lines[i : i + GROUP] for i in range(0, len(lines), GROUP)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids, at = array("I", found.ids), -1
            for c in group[:-1]:
                start = at + 1
                at = ids.index(self.line_break[0], start)
                yield c, ids[start:at].tobytes()
            yield group[-1], ids[at + 1 :].tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            if not t or t[-1] in " \t\n\r" or OTHER_SPACE.search(t) or any(a in t for a in self.added):
                out[i].append(self.whole([t])[0])
                continue
            for part in parts_of(t.encode()):
                if held and size + len(part) > PART_BYTES:
                    self.look_up(held, out)
                    held, size = [], 0
                if len(part) > PART_BYTES:
                    out[i].append(self.whole([part.decode()])[0])  # one very long chunk
                else:
                    held.append((i, part))
                    size += len(part)
        if held:
            self.look_up(held, out)
        return [b"".join(x) for x in out]

    def holds(self, a: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which chunks of the bytes a are in the table, byte for byte."""
        size, more_bytes = end - start, padded(a)
        out = (self.known[slot] == h) & (self.size[slot] == size)
        for k in (0, 1):
            out &= self.head[k][slot] == blocks(more_bytes, start + 8 * k, size - 8 * k)
        at = np.flatnonzero(out & (size > 16))
        if len(at):
            size = size[at]
            begin = np.cumsum(size) - size
            step = np.arange(size.sum())
            same = a[np.repeat(start[at] - begin, size) + step] == self.bytes[np.repeat(self.from_byte[slot[at]] - begin, size) + step]
            out[at] = np.logical_and.reduceat(same, begin)
        return out

    def keep(self, a: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, slot: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Puts chunks into the table; of those with one slot one stays."""
        slot, at = np.unique(slot, return_index=True)
        size, more_bytes = (end - start)[at], padded(a)
        self.known[slot], self.first[slot], self.count[slot], self.size[slot] = h[at], first[at], count[at], size
        for k in (0, 1):
            self.head[k][slot] = blocks(more_bytes, start[at] + 8 * k, size - 8 * k)
        long = size > 16
        slot, at, size = slot[long], at[long], size[long]
        begin, n = np.cumsum(size) - size, int(size.sum())
        self.bytes[self.used_bytes : self.used_bytes + n] = a[np.repeat(start[at] - begin, size) + np.arange(n)]
        self.from_byte[slot] = self.used_bytes + begin
        self.used_bytes += n

    def look_up(self, parts: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Appends the ids of each part (a text's number and whole chunks of it, PART_BYTES together at most)."""
        if self.used > KEPT_IDS or self.used_bytes > 4 * KEPT_IDS:
            self.known[:] = 0
            self.used = self.used_bytes = 0
        raw = b"".join([p for _, p in parts])
        a = np.frombuffer(raw, dtype=np.uint8)
        part_end = np.cumsum([len(p) for _, p in parts])
        other = ~PLAIN_SPACE[a]
        last = other.copy()
        last[:-1] &= ~other[1:]
        last[part_end - 1] = True
        end = np.flatnonzero(last) + 1
        start = np.concatenate([[0], end[:-1]])
        h = stretch_hashes(a, start, end) | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        first, count = self.first[slot], self.count[slot]
        missing = np.flatnonzero(~self.holds(a, start, end, h, slot))
        if len(missing):
            chunks = [raw[s:e].decode() for s, e in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
            number = dict.fromkeys(chunks)
            new_first, new_count = np.empty(len(number), dtype=np.int64), np.empty(len(number), dtype=np.int64)
            for k, (c, ids) in enumerate(self.each(list(number))):
                n = len(ids) // 4
                number[c], new_first[k], new_count[k] = k, self.used, n
                self.ids[self.used : self.used + n] = np.frombuffer(ids, dtype="<u4")
                self.used += n
            k = np.array([number[c] for c in chunks])
            first[missing], count[missing] = new_first[k], new_count[k]
            self.keep(a, start[missing], end[missing], h[missing], slot[missing], first[missing], count[missing])
        done = np.cumsum(count)
        ids = self.ids[np.repeat(first - done + count, count) + np.arange(done[-1])]
        cut = done[np.searchsorted(end, part_end)].tolist()
        for (i, _), s, e in zip(parts, [0, *cut[:-1]], cut, strict=True):
            out[i].append(ids[s:e].tobytes())


def parts_of(raw: bytes) -> list[bytes]:
    """A text's bytes cut before white space that follows another character, into parts of PART_BYTES at most where there is such a place."""
    if len(raw) <= PART_BYTES:
        return [raw]
    space = PLAIN_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    places = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    out, a = [], 0
    while len(raw) - a > PART_BYTES:
        k = int(np.searchsorted(places, a + PART_BYTES, side="right"))
        b = int(places[k - 1]) if k and places[k - 1] > a else int(places[k]) if k < len(places) else len(raw)
        out.append(raw[a:b])
        a = b
    return [*out, raw[a:]] if a < len(raw) else out


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is over."""
    if n <= size:
        return [(0, n)]
    over = n % size
    return ([(0, over)] if over else []) + [(s, size) for s in range(over, n, size)]


def tokenize_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """PIECES of docs (doc_id, text); a null or empty text is the end id alone."""
    target = to_arrow(docs.sparkSession, PIECES)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for a in range(0, b.num_rows, 200):
                part = b.slice(a, 200)
                ids_of = enc.encode_all([t or "" for t in part.column("text").to_pylist()])
                out = []
                for i, ids in zip(part.column("doc_id").to_pylist(), ids_of, strict=True):
                    ids += end
                    out += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
                yield record_batch(dict(zip(target.names, zip(*out, strict=True), strict=True)), target)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class SumOfSquares:
    """Online packer: add() gives the bin's number."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.open: list[list[int]] = [[] for _ in range(size + 1)]  # bins by gap
        self.count = np.zeros(size + 1, dtype=np.int64)  # open bins by gap; full bins don't count
        self.bins = 0

    def add(self, n: int) -> int:
        size, count = self.size, self.count
        # Into gap g: the sum of squares changes by 2*N(g-n) - 2*N(g) + 2, or 1 - 2*N(g) if it fills the bin; a new bin by 2*N(size-n) + 1.
        best, best_gap = (2 * int(count[size - n]) + 1 if n < size else 0), size
        if n < size:
            change = 2 * (count[: size - n] - count[n:size]) + 2
            change[0] = 1 - 2 * int(count[n])
            change[count[n:size] == 0] = 1 << 40
            k = int(change.argmin())
            if change[k] <= best:
                best_gap = n + k
        if best_gap == size:
            b = self.bins
            self.bins += 1
        else:
            b = self.open[best_gap].pop()
            count[best_gap] -= 1
        left = best_gap - n
        if left:
            self.open[left].append(b)
            count[left] += 1
        return b


def pack_rows(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each length, placed in the order given."""
    packer = SumOfSquares(size)
    return np.array([packer.add(n) for n in lengths.tolist()], dtype=np.int64)


def pack_all(lengths: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Bin of each length: rounds of sum-of-squares placements, keeping the bins within a tolerance that doubles."""
    out = np.empty(len(lengths), dtype=np.int64)
    left, bins, tolerance = np.arange(len(lengths)), 0, 1
    rng = np.random.default_rng(len(lengths))
    while len(left):
        order = np.argsort(rng.normal(0, STIR, len(left)) - lengths[left], kind="stable")
        left = left[order]
        found = pack_rows(lengths[left], size)
        gaps = size - np.bincount(found, weights=lengths[left]).astype(np.int64)
        tolerance = max(tolerance, int(gaps.min()))
        done = gaps <= tolerance
        numbers = np.cumsum(done) - 1 + bins
        own = done[found]
        out[left[own]] = numbers[found[own]]
        bins += int(done.sum())
        left = left[~own]
        tolerance *= 2
    return out


def pack(pieces: DataFrame, size: int = SIZE, task_rows: int = TASK_ROWS) -> DataFrame:
    """pieces (stored; PIECES) with sequence_id and offset, gapless in each sequence.

    Rows are dealt round robin, so repeated rows are packed each for itself and no key
    gathers rows in a task. Pieces of a whole sequence are not dealt at all.
    """
    target = to_arrow(pieces.sparkSession, PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        length = rows.column("length").to_numpy()
        bins = pack_all(length, size)
        by_bin = np.argsort(bins, kind="stable")
        starts = np.cumsum(length[by_bin]) - length[by_bin]
        offset = np.empty(len(length), dtype=np.int64)
        offset[by_bin] = starts - starts[np.searchsorted(bins[by_bin], bins[by_bin])]
        number = (1 << 62) + (TaskContext.get().partitionId() << 32) + bins
        rows = rows.select(target.names[:5]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        for b in rows.to_batches(20_000):
            yield record_batch({n: b.column(n) for n in target.names}, target)

    whole = pieces.filter(F.col("length") == size).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < size)
    tasks = max(1, -(-short.count() // task_rows))
    return whole.unionByName(short.repartition(tasks).mapInArrow(run, PACKED))


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Sequences for all docs (doc_id, text); other columns, whatever their names, are ignored.

    A null or empty text is a piece of the end id alone. Repeated rows, rows of one
    doc_id and rows without one are packed each for itself. Pieces of equal length are
    alike. An empty table gives no rows. A text of any length is encoded whole.
    """
    return pack(checkpointed(tokenize_pieces(docs, path, size)), size)
