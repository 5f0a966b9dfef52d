"""Order-preserving sequence packing by dynamic programming over cut positions.

Documents keep their order inside a task's share of the input.  Cuts may fall at document ends (free), at sentence ends
(``SENTENCE_CUT``) and, only where neither comes for ``FREE_STEP`` tokens, between any two tokens (``FREE_CUT``).  The
cuts minimise padding plus these truncation penalties: with ``key[i] = cost[i] + position[i]`` the best start of a
window that ends at candidate j is the least key within ``length`` tokens, held by a monotone queue, so a block of m
candidates takes O(m).  After each block all windows but the last are emitted and the last one is carried on, so memory
is bounded by a block and the longest text.  The last windows of SHARES tasks' shares are put in order and packed again as
one stream.  Its end is part of the search: it is padded, or cut into windows whose lengths are powers of two, which need no
padding, each cut at its penalty, whichever is cheaper.

Tokens: a text is cut at space, line feed and tab, which the tokenizer drops; each distinct piece is encoded once and
kept in a bounded cache.  Defined cases: null and empty texts are the end token alone; null ids pass through; repeated rows
are packed once each; an empty table gives no pieces; a text that is longer than a block is held whole while it is packed; ids
must be numbers (they are returned as long); extra columns don't matter.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.bytegrams import lean
from kvlog.llm.common import ship, stored, table

LENGTH = 4096
END_ID = 2
SENTENCE_CUT, FREE_CUT, FREE_STEP = 8, 16, 32
BLOCK_TOKENS = 1 << 19
CACHE_PIECES = 150_000
#: The ends of so many shares are packed together (at most LENGTH tokens each).
SHARES = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks that never join letters to one token (the apostrophe does).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE has for each byte: printable Latin-1 stands for itself, the others count up from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Encoder(dict):
    """White-space-delimited piece -> little-endian uint32 ids, filled as pieces come.

    Letters, or letters and then marks, are put together from a lower-case word, which the BPE model gets directly, and
    a run of marks; everything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model.tokenize
        self.letters = dict(enumerate(_byte_letters()))
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith((".</w>", "!</w>", "?</w>"))]] = True

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            low = word.lower()
            ids = self.get(low)
            if ids is None:
                plain = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                ids = self[low] = array("I", [t.id for t in self.model(plain)]).tobytes()
            if len(word) < len(piece):
                ids += self[piece[len(word) :]]
        else:
            ids = array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


def cuts(positions: list[int], penalties: list[int], length: int, last: Callable[[int], int] | None = None) -> list[int]:
    """Ends of the cheapest windows from positions[0] to positions[-1]; neighbours are at most ``length`` apart.

    last: the cost of the last window by its tokens, where it isn't padding."""
    m = len(positions)
    key, prev, queue, head = [positions[0]] + [0] * (m - 1), [0] * m, [0], 0
    for j in range(1, m):
        low = positions[j] - length
        while positions[queue[head]] < low:
            head += 1
        i = queue[head]
        prev[j] = i
        key[j] = k = key[i] + length + penalties[j]
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    if last is not None and m > 1:
        near = range(bisect.bisect_left(positions, positions[-1] - length), m - 1)
        prev[-1] = min(near, key=lambda i: key[i] - positions[i] + last(positions[-1] - positions[i]))
    out, j = [], m - 1
    while j:
        out.append(positions[j])
        j = prev[j]
    return out[::-1]


def tail(tokens: int, length: int, penalty: Callable[[int], int]) -> tuple[list[int], int]:
    """Lengths of the windows of a stream's end of at most ``length`` tokens, powers of two and then a padded rest if any, and
    their cost.

    penalty(n) is that of a cut after n of the tokens; the cheapest number of powers is taken.
    """
    best, cost, taken, at = [tokens], length - tokens, [], 0
    if tokens & (tokens - 1) == 0:
        return best, 0
    spent = 0
    while at < tokens:
        taken.append(1 << (tokens - at).bit_length() - 1)
        at += taken[-1]
        left = tokens - at
        spent += penalty(at) if left else 0
        now = spent + (length - left if left and left & (left - 1) else 0)
        if now < cost:
            best, cost = [*taken, *([left] if left else [])], now
    return best, cost


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that tasks which follow each other share its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    def __init__(self, ends: np.ndarray, length: int, first_sequence: int):
        self.ends, self.length, self.sequence = ends, length, first_sequence
        self.docs: list[tuple[object, bytes, int, int]] = []  # id, ids, tokens, place in the stream
        self.at = self.done = 0  # end of the stream; everything before `done` is emitted
        self.positions, self.penalties, self.rows = [0], [0], []

    def _candidate(self, where: int, penalty: int) -> None:
        last = self.positions[-1]
        while where - last > min(FREE_STEP, self.length):
            last += min(FREE_STEP, self.length)
            self.positions.append(last)
            self.penalties.append(FREE_CUT)
        if where > last:
            self.positions.append(where)
            self.penalties.append(penalty)

    def add(self, doc_id, ids: bytes, start: int = 0, total: int | None = None) -> None:
        """A document's tokens from ``start`` on to its end."""
        n = len(ids) // 4
        inner = (np.flatnonzero(self.ends[np.frombuffer(ids, dtype="<u4")]) + 1 + self.at).tolist()
        for x in inner:
            if x < self.at + n - 1:
                self._candidate(x, SENTENCE_CUT)
        self._candidate(self.at + n, 0)
        self.docs.append((doc_id, ids, n, self.at, start, total or n))
        self.at += n
        if self.at - self.done >= BLOCK_TOKENS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        """Emits all windows but the last, which is carried on and costs nothing yet; that one too if ``last``."""
        if self.at == self.done:
            return
        if last:
            known = dict(zip(self.positions, self.penalties, strict=True))
            end = lambda n: tail(n, self.length, lambda i: known.get(self.at - n + i, FREE_CUT))
            ends = cuts(self.positions, self.penalties, self.length, lambda n: end(n)[1])
            at = ends[-2] if len(ends) > 1 else self.done
            for n in end(ends.pop() - at)[0]:
                at += n
                ends.append(at)
        else:
            ends = cuts(self.positions, self.penalties, self.length, lambda n: 0)[:-1]
        k, begin = 0, self.done
        for end in ends:
            at = begin
            while at < end:
                doc_id, ids, n, place, start, total = self.docs[k]
                stop = min(end, place + n)
                piece = memoryview(ids)[(at - place) * 4 : (stop - place) * 4]
                self.rows.append((doc_id, start + at - place, stop - at, zlib.crc32(piece), total, self.sequence, at - begin))
                at = stop
                if stop == place + n:
                    k += 1
            self.sequence += 1
            begin = end
        self.docs = self.docs[k:]
        self.done = begin
        keep = np.searchsorted(self.positions, begin)
        self.positions, self.penalties = self.positions[keep:], self.penalties[keep:]

    def rest(self) -> list[tuple]:
        """(doc_id, ids, start, total) of what isn't emitted."""
        out = []
        for doc_id, ids, n, place, start, total in self.docs:
            skip = max(self.done - place, 0)
            if skip < n:
                out.append((doc_id, ids[skip * 4 :], start + skip, total))
        return out

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece of a document; see the module's text."""
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
    first = pa.schema([*schema, ("share", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        share = TaskContext.get().partitionId()
        own = encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        packer = Packer(own.ends, length, share << 40)
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(i.as_py(), own.encode(t.as_py() or "") + end)
            if packer.rows:
                yield _to_batch([(*r, None, None, None) for r in packer.take()], first)
        packer.flush(False)
        rows = [(*r, None, None, None) for r in packer.take()]
        rows += [(i, start, len(ids) // 4, None, total, None, None, share, k, ids) for k, (i, ids, start, total) in enumerate(packer.rest())]
        if rows:
            yield _to_batch(rows, first)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, current = encoder(path), None, None
        for batch in batches:
            for i, start, total, share, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "share", "ids")), strict=True):
                if share // SHARES != current:
                    if packer:
                        packer.flush(True)
                        yield _to_batch(packer.take(), schema)
                    current = share // SHARES
                    packer = Packer(own.ends, length, (1 << 62) + (current << 40))
                packer.add(i, ids, start, total)
            if packer and packer.rows:
                yield _to_batch(packer.take(), schema)
        if packer:
            packer.flush(True)
            if packer.rows:
                yield _to_batch(packer.take(), schema)

    wide = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), SCHEMA + ", share long, place long, ids binary")
    wide = stored(wide, "pieces")
    ends = wide.where(F.col("ids").isNotNull()).repartition(F.floor(F.col("share") / SHARES)).sortWithinPartitions("share", "place")
    return wide.where(F.col("ids").isNull()).select(*schema.names).unionByName(ends.mapInArrow(lean(finish), SCHEMA))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
