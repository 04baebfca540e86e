"""Best-fit packing of token sequences.

Method: bounded-space online best fit.  A packer keeps at most ``open_bins`` sequences open.  Which
free spaces occur among them is held in one integer used as a bitset, so the tightest sequence that
still takes a piece is the lowest set bit at or above the piece's length.  When one more sequence
must be opened and none is left, the fullest open one closes first.

Spark does the rest in two passes.  The first pass tokenises and packs each input partition without
any shuffle.  What is still open at the end of a partition (at most ``open_bins`` sequences, whatever
the partition's size) is shuffled to a few groups and packed once more, so that many small partitions
do not each leave a row of half-filled sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import Encoder
from tidewell.llm.common import TEXTS_A_BATCH, stage

CAPACITY = 2048
OPEN_BINS = 4096
TAIL_PIECES = 4096
#: Chunks between white space whose ids a worker remembers, and their bytes, in each of two generations: what wasn't met in the younger one is forgotten.
REMEMBERED, REMEMBERED_BYTES = 250_000, 10_000_000

_STOPS = frozenset(b".,;:!?")

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"


class Packer:
    """Places lengths into sequences of ``capacity``; ids count from 0."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.spaces = 0  # bit f: some open sequence has f places free
        self.by_space: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        got = bins.pop()
        if not bins:
            del self.by_space[space]
            self.spaces ^= 1 << space
        self.n_open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset in it) of a piece of this length."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} places doesn't fit into {self.capacity}")
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            got = self._take(space)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, got = self.capacity, self.n_bins
            self.n_bins += 1
        left = space - length
        if left:
            self.by_space.setdefault(left, []).append(got)
            self.spaces |= 1 << left
            self.n_open += 1
        return got, self.capacity - space

    def still_open(self) -> set[int]:
        return {b for bins in self.by_space.values() for b in bins}


class ChunkTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, and its own splitting doesn't cross ASCII white space, so a text's ids are those of its lower-cased chunks
    in a row, and each chunk is encoded once per worker.  A closing stop after an ASCII letter is an id
    of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.words = Tokenizer.from_file(path), Encoder(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the chunks known
        self.stops = {s: np.array(self.tokenizer.encode(chr(s), add_special_tokens=False).ids, "<u4").tobytes() for s in _STOPS}

    def forget(self) -> None:
        """Workers outlive their tasks, and other stages need their memory."""
        self.known, self.older, self.held = {}, {}, 0

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        missing = chunks.difference(self.known)
        self.held += sum(map(len, missing))
        new = missing.difference(self.older)
        self.known.update((c, self.older[c]) for c in missing.difference(new))
        words = list(filter(bytes.isalpha, new))  # ASCII letters
        lower = words.copy()
        stops, others, known = [], [], self.known
        for chunk in new.difference(words):
            if chunk[-1] in _STOPS:
                base = chunk[:-1]
                if base[-1:].isalpha():
                    stops.append(chunk)
                    if base in known or base in new:
                        continue
                    if base.isalpha():
                        words.append(base)
                        lower.append(base)
                        continue
                    chunk = base
            text = chunk.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0130":
                words.append(chunk)
                lower.append(text.lower().encode())
            else:
                others.append(chunk)
        # A chunk of letters is one word to the vocabulary: its merges are found side by side.
        self.known.update(zip(words, self.words.merged_all(lower)))
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            for chunk, got in zip(part, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)):
                self.known[chunk] = np.array(got.ids, "<u4").tobytes()
        ends = self.stops
        known.update([(c, known[c[:-1]] + ends[c[-1]]) for c in stops])

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):  # a stretch of texts of about 2 MB at a time
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < 2_000_000):
                size += len(texts[upto])
                upto += 1
            split = [t.lower().split() for t in texts[at:upto]]
            self.learn(set().union(*split))
            known = self.known
            for chunks in split:
                yield b"".join(map(known.__getitem__, chunks))
            at = upto


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's own, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document of its own, also where ids repeat or are null (the id is
    passed on as it is).  A null text counts as empty; an empty text is the end id alone.  Documents
    longer than ``capacity`` are cut into pieces of that length, the last one may be shorter.  An
    empty table gives no rows.  Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packer, tok = Packer(capacity, open_bins), tokenizer(vocabulary)
        waiting: dict[int, list[tuple]] = {}  # pieces of sequences that may still be open

        def out(rows: list[tuple], closed: bool) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array([closed] * len(rows), pa.bool_())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "closed"])

        for batch in batches:
            arrived = []
            for doc_id, got in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1).to_pylist())):
                got += end
                for piece, start in enumerate(range(0, len(got) // 4, capacity)):
                    part = got[4 * start : 4 * (start + capacity)]
                    arrived.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            # What arrives together is placed longest first: its short pieces then find the gaps.
            arrived.sort(key=lambda p: -p[3])
            for p in arrived:
                place, offset = packer.place(p[3])
                waiting.setdefault(place, []).append((*p, base + place, offset))
            still = packer.still_open()
            if done := [row for place in [p for p in waiting if p not in still] for row in waiting.pop(place)]:
                yield out(done, True)
        tok.forget()
        yield out([row for rows in waiting.values() for row in rows], False)

    packed = stage(narrow.mapInArrow(first_pass, _PIECES), "packed", batch=TEXTS_A_BATCH)
    loose = packed.filter(~F.col("closed")).drop("closed")
    groups = max(1, -(-loose.count() // TAIL_PIECES))

    def second_pass(pdf):
        packer = Packer(capacity, open_bins)
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        places = [packer.place(n) for n in pdf["length"]]
        pdf["sequence_id"] = [-1 - ((int(g) << 36) + p) for g, (p, _) in zip(pdf["part"], places)]
        pdf["offset"] = [o for _, o in places]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    # Whole former sequences go to one group, dealt evenly by their number.
    dealt = loose.withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int"))
    tail = dealt.groupBy("part").applyInPandas(second_pass, _PIECES.rpartition(",")[0])
    return packed.filter("closed").drop("closed").unionByName(tail)
