"""Byte-level BPE encoding and decoding.

Method: a piece of a text (a word with the space before it, digits, signs or white space) starts as its
bytes.  A segment tree stands over the ranks of its adjacent pairs, with the place in the low bits, so
that its root is the leftmost pair of lowest rank.  That pair is merged, which changes the pairs at up
to three places: each is a point update along one path, logarithmic in the piece's length.  It ends when
the root holds no pair.

Pieces that a worker hasn't met lately are merged many at a time: pieces of a like length are the rows of
one array of trees, and each step takes every row's root.  A long piece has a tree of its own.  Texts are
split and joined in stretches of bounded size.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tidewell.llm.terms import stretches

# Fixed value: how byte-level vocabularies of this kind split a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of so many bytes at most are merged side by side.
SIDE_BY_SIDE = 64
#: Rows of an array of trees.
ROWS = 20_000
#: Pieces whose ids a worker remembers, and their bytes, in each of two generations: what wasn't met in the younger one is forgotten.
REMEMBERED, REMEMBERED_BYTES = 200_000, 8_000_000
_NONE = np.int64(1) << 62  # no pair


def byte_characters() -> list[str]:
    """The character that stands for each byte in such vocabularies: itself if it is seen on paper, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@lru_cache(1)
def newer() -> tuple[re.Pattern, dict[int, int]]:
    """What finds, and maps to an unassigned character, the letters and numbers that the pattern's library knows but that are neither to the vocabulary's library, which has an older Unicode: it is asked for each in question."""
    unassigned = "".join(chr(c) for c in range(0x100, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    asked = regex.findall(r"[\p{L}\p{N}]", unassigned)
    own = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"a{c}1{c} " for c in asked))
    begins = {at for _, (at, _) in own}
    found = [ord(c) for i, c in enumerate(asked) if {5 * i + 1, 5 * i + 3} <= begins]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in runs) + "]" if runs else r"(?!)"), dict.fromkeys(found, 0x378)


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, where none is newer."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def latin_pattern() -> re.Pattern:
    """PIECES for texts below U+0100, where the classes are short lists; faster."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x100) if regex.match(kind, chr(c)))
    letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(PIECES.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]"))


class Encoder:
    """Ids of texts by a vocabulary file, and texts of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.special = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        of_byte = byte_characters()
        to_byte = {c: b for b, c in enumerate(of_byte)}
        # A piece's last byte, where the vocabulary marks the ends of words, is another symbol.
        end = model.get("end_of_word_suffix") or ""
        self.of_byte, self.of_last = (np.array([vocab[c + x] for c in of_byte], np.int64) for x in ("", end))
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        # Ranks by pair, as a hash table of arrays and by the pair's two bytes.
        self.new_id = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.pairs = keys
        self.shift = 64 - (4 * len(keys) + 1).bit_length()
        self.keys, self.rank_of = np.full((1 << 64 - self.shift) + 1, -1, np.int64), np.zeros((1 << 64 - self.shift) + 1, np.int32)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):  # who finds its slot taken goes to the next one
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) % (len(self.keys) - 1)
        self.rank_of[slots] = np.arange(len(keys))
        self.byte_rank, self.last_rank = (self._found((self.of_byte[:, None] * self.size + right).ravel()).astype(np.int32) for right in (self.of_byte, self.of_last))
        self.pattern, self.latin_pattern = regex.compile(PIECES), latin_pattern()
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        bytes_of = [b""] * (self.size + 1)  # the last for unknown ids
        for word, i in [*vocab.items(), *self.special.items()]:
            bytes_of[i] = bytes(to_byte[c] for c in word) if all(c in to_byte for c in word) else word.encode()
        self.token_bytes = pa.array(bytes_of, pa.large_binary())

    @cached_property
    def rank(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), range(len(self.pairs))))

    # -- merging ---------------------------------------------------------------------------------

    def merged(self, piece: bytes) -> np.ndarray:
        """The ids of one piece, by a tree of its own."""
        raw, n = np.frombuffer(piece, np.uint8), len(piece)
        ids = [*self.of_byte[raw[:-1]].tolist(), *self.of_last[raw[-1:]].tolist()]
        if n < 2:
            return np.array(ids, "<u4")
        size, bits, none = 1 << (n - 2).bit_length(), n.bit_length(), int(_NONE)
        rank, new_id, width = self.rank, self.new_id, self.size
        key = lambda a, b, at: none if (r := rank.get(a * width + b)) is None else r << bits | at
        tree = [none] * size + [key(ids[i], ids[i + 1], i) for i in range(n - 1)] + [none] * (size - n + 1)
        for at in range(size - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def update(at: int, value: int) -> None:
            at += size
            if tree[at] == value:
                return
            tree[at] = value
            while at > 1:
                at >>= 1
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    return
                tree[at] = least

        while tree[1] < none:
            at = tree[1] & (1 << bits) - 1
            ids[at] = int(new_id[tree[1] >> bits])
            gone = after[at]
            after[at] = then = after[gone]
            if gone < n - 1:
                update(gone, none)
            if then < n:
                before[then] = at
                update(at, key(ids[at], ids[then], at))
            else:
                update(at, none)
            if (first := before[at]) >= 0:
                update(first, key(ids[first], ids[at], first))
            ids[gone] = -1
        return np.array([i for i in ids if i >= 0], "<u4")

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The ranks of pairs, -1 of such as have none."""
        slots = self._slots(keys)
        held = self.keys.take(slots)
        out = np.where(held == keys, self.rank_of.take(slots), -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) % (len(self.keys) - 1)
            held = self.keys.take(slots[left])
            hit = held == keys[left]
            out[left[hit]] = self.rank_of.take(slots[left[hit]])
            left = left[~hit & (held >= 0)]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        """The trees' entries of pairs of ids at their places."""
        found = self._found(a * self.size + b)
        return np.where(found >= 0, found.astype(np.int64) << bits | at, _NONE)

    def merged_rows(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, which of them are there) of pieces, each a row of bytes and its length of 2 or more: a tree for each row.  What a row holds beyond its length doesn't count."""
        rows, width = raw.shape
        leaves, bits = 1 << (width - 2).bit_length(), width.bit_length()
        place = np.arange(width)
        ids, there, every = self.of_byte[raw], place < lengths[:, None], np.arange(rows)
        ids[every, lengths - 1] = self.of_last[raw[every, lengths - 1]]
        trees = np.full((rows, 2 * leaves), _NONE)
        two = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        pairs = self.byte_rank.take(two).astype(np.int64)
        pairs[every, lengths - 2] = self.last_rank.take(two[every, lengths - 2])
        trees[:, leaves : leaves + width - 1] = np.where(there[:, 1:] & (pairs >= 0), pairs << bits | place[:-1], _NONE)
        for low in (leaves >> k for k in range(1, leaves.bit_length())):
            trees[:, low : 2 * low] = np.minimum(trees[:, 2 * low : 4 * low : 2], trees[:, 2 * low + 1 : 4 * low : 2])
        # Arrays of all rows in one, with the beginnings of a row in each.
        ids_of, there_of, tree = ids.reshape(-1), there.reshape(-1), trees.reshape(-1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), rows)
        before = np.tile(np.arange(-1, width, dtype=np.int32), rows)

        def update(base: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
            at = at + leaves
            tree[base + at] = value
            for _ in range(leaves.bit_length() - 1):
                at = at >> 1
                two = base + 2 * at
                tree[base + at] = np.minimum(tree.take(two), tree.take(two + 1))

        of = np.flatnonzero(trees[:, 1] < _NONE)
        while len(of):
            base, own, links = of * (2 * leaves), of * width, of * (width + 1)
            top = tree.take(base + 1)
            at = top & (1 << bits) - 1
            gone = after.take(links + at)
            then = after.take(links + gone)
            left = self.new_id.take(top >> bits)
            ids_of[own + at] = left
            there_of[own + gone] = False
            after[links + at], before[links + then] = then, at
            inner = np.flatnonzero(gone < width - 1)
            update(base[inner], gone[inner], _NONE)
            last = then >= lengths.take(of)
            right = ids_of.take(own + np.where(last, at, then))
            update(base, at, np.where(last, _NONE, self._ranks(left, right, at, bits)))
            first = before.take(links + at)
            some = np.flatnonzero(first >= 0)
            f = first[some].astype(np.int64)
            update(base[some], f, self._ranks(ids_of.take(own[some] + f), left[some], f, bits))
            of = of[tree.take(base + 1) < _NONE]
        return ids, there

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of the pieces into ``known``."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        missing = pieces.difference(self.known)
        new = list(missing.difference(self.older))
        if len(new) < len(missing):
            self.known.update((p, self.older[p]) for p in missing.difference(new))
        raws = list(map(str.encode, new))
        self.held += sum(map(len, raws))
        self.known.update(zip(new, self.merged_all(raws)))

    def merged_all(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit numbers."""
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        out = np.empty(len(raws), object)
        flat = np.frombuffer(b"".join(raws) + bytes(SIDE_BY_SIDE + 1), np.uint8)
        begins = np.cumsum(sizes) - sizes
        for i in np.flatnonzero((sizes < 2) | (sizes > SIDE_BY_SIDE)).tolist():
            out[i] = self.merged(raws[i]).tobytes()
        # A tree of 2^k leaves takes the pairs of pieces of 2^k + 1 bytes.
        for least, most in ((1, 2), (2, 3), *(((1 << k) + 1, (2 << k) + 1) for k in range(1, SIDE_BY_SIDE.bit_length() - 1))):
            group = np.flatnonzero((sizes > least) & (sizes <= min(most, SIDE_BY_SIDE)))
            for at in range(0, len(group), ROWS):
                part = group[at : at + ROWS]
                ids, there = self.merged_rows(flat[begins[part][:, None] + np.arange(most)], sizes[part])
                found, ends = ids[there].astype("<u4").tobytes(), (np.cumsum(there.sum(axis=1)) * 4).tolist()
                out[part] = np.fromiter((found[a:z] for a, z in zip([0, *ends], ends)), object, len(part))
        return out.tolist()

    # -- texts -----------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """The text's pieces in their order; a special token's name is a piece as it is."""
        if self.cut and (parts := self.cut.split(text))[1:]:
            return [p for part in parts for p in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if latin(text):
            return self.latin_pattern.findall(text)
        found, plain = newer()
        if not found.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for p in self.pattern.findall(text.translate(plain)):
            out.append(text[at : at + len(p)])
            at += len(p)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        for start, stop in stretches(texts):
            split = [self.pieces(t) for t in texts[start:stop]]
            new = set().union(*split)
            self.learn(new.difference(self.special))
            # A piece that is a special token's name is that token.
            own = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items() if s in new}
            ids = (self.known | own).__getitem__ if own else self.known.__getitem__
            out += [b"".join(map(ids, p)) for p in split]
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of runs of ids, each between two neighbouring ``ends``.  Ids outside the vocabulary are left out; bytes that aren't UTF-8 show as U+FFFD."""
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        tokens = self.token_bytes.take(pa.array(known, pa.int32()))
        raw, at = tokens.buffers()[2], np.frombuffer(tokens.buffers()[1], np.int64)[ends].tolist()
        return [str(raw[a:z], "utf-8", "replace") for a, z in zip(at, at[1:])] if raw is not None else [""] * (len(ends) - 1)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's own, kept between tasks."""
    return Encoder(path)


def _texts(raw: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in raw.to_pylist()]


def _decoded(own: Encoder, ids: pa.ListArray) -> pa.Array:
    # A null among ids is outside the vocabulary, and a null list has no ids.
    plain = pc.if_else(ids.is_valid(), ids, pa.scalar([], ids.type)) if ids.null_count else ids
    return pa.array(own.decode(pc.fill_null(plain.values, -1).to_numpy(), plain.offsets.to_numpy()), pa.string())


def _listed(raw: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) // 4 for r in raw)]), pa.int32()), pa.array(flat))


def encode(text: Column, vocabulary: str) -> Column:
    """The ids of a text, array<int>; none of a null or empty text.  Bytes that aren't UTF-8 count as U+FFFD."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _listed(encoder(vocabulary).encode(_texts(texts)))

    return ids(text.cast("binary"))


def decode(ids: Column, vocabulary: str) -> Column:
    """The text of ids; '' of null or none.  Null ids and such as aren't in the vocabulary are left out."""

    @F.arrow_udf("string")
    def texts(each: pa.Array) -> pa.Array:
        return _decoded(encoder(vocabulary), each)

    return texts(ids)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of every row of ``docs``: the ids of its whole text, and the text that they give.

    A null text counts as empty and has no ids.  Repeated rows, and rows of equal or null ids, are rows of their own.  Columns other than the two
    named are not read.  An empty table gives no rows.
    """

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        # decode(encode()) would encode twice, once for either column.
        own = encoder(vocabulary)
        ids = _listed(own.encode(_texts(texts)))
        return pa.StructArray.from_arrays([ids, _decoded(own, ids)], names=["ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), both(F.col(text_col).cast("binary")).alias("got")).select("doc_id", "got.ids", "got.decoded")


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    got = encoded(docs, vocabulary)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
