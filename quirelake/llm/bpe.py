"""Encoding of texts with a byte-level BPE vocabulary.

Every distinct pre-token is merged once per worker: a segment tree over its byte positions holds the leftmost pair of
least rank; each merge takes the root and makes two point updates, for the live neighbours of the merged pair, each
logarithmic in the pre-token's length, so that a pre-token of a million bytes is no worse than as many short ones.
Splitting into pre-tokens, finding known ones and writing out the ids is array code over whole blocks of texts.
Known pre-tokens are found by a hash and then compared letter by letter, so that no id rests on a hash alone.

Defined results: a null text and an empty text have no ids (an empty list, never null); special tokens are neither
made nor recognised, their spellings are ordinary text; lone surrogates are encoded as U+FFFD; repeated texts get
equal ids; other columns do not matter, whatever they are called.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirelake.llm.textkernel import LETTER, NUMBER, OTHER, SPACE, Block, HashIndex, blocks, class_table

TOKENIZER_DIR = os.environ.get("QUIRELAKE_TOKENIZERS", "/opt/tokenizers")
#: Distinct pre-tokens, and their characters, that a worker remembers before it starts afresh; this changes speed only.
REMEMBERED, REMEMBERED_CHARS = 1 << 20, 1 << 24


def read_ranks(path: str) -> bytes:
    """The rank file of a vocabulary (a line for each token: base64, rank)."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    never = 1 << 62
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [never] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def update(i: int) -> None:
        value, j = never, after[i]
        if j < n and parts[i] is not None:
            rank = ranks.get(parts[i] + parts[j])
            if rank is not None:
                value = rank << 32 | i
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least and k < size >> 1:
                break
            tree[k] = least
            k >>= 1

    while tree[1] != never:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        update(j)
        update(i)
        if before[i] >= 0:
            update(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[parts[i]])
        i = after[i]
    return ids


def pretoken_starts(block: Block) -> np.ndarray:
    """Where the pre-tokens of a block begin: contractions, runs of letters, of numbers and of other characters, each
    with one blank before it, and what is left of the white space."""
    cps, n = block.cps, block.n
    if not n:
        return np.zeros(0, np.int64)
    kinds = class_table()[cps]
    opens = np.zeros(n + 1, bool)
    opens[block.bounds] = True
    run = opens[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cps[:-1] == 32) & ~opens[1:n]
    starts = run & (space | ~blank_before)
    # the last of the white space before something else stands alone or goes with it
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
    starts |= last
    # contractions: a lone apostrophe that begins a pre-token, and the letters after it
    for p in np.flatnonzero(starts & (cps == 39) & (kinds == OTHER)).tolist():
        if p + 1 >= n or kinds[p + 1] != LETTER or opens[p + 1]:
            continue
        one = cps[p + 1]
        if one in (115, 116, 109, 100):  # s t m d
            length = 2
        elif (
            p + 2 < n
            and not opens[p + 2]
            and (int(one), int(cps[p + 2])) in ((114, 101), (118, 101), (108, 108))  # re ve ll
        ):
            length = 3
        else:
            continue
        starts[p + 1] = False
        if p + length < n and kinds[p + length] == LETTER:
            starts[p + length] = True
    return np.flatnonzero(starts)


class Encoder:
    """Encodes blocks of texts and remembers the pre-tokens it has seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex()
        self.n = 0
        #: per pre-token: place and number of its ids, place and length of its spelling
        self.begins, self.counts, self.spelt, self.lengths = (np.zeros(1024, np.int64) for _ in range(4))
        self.ids, self.letters = np.zeros(4096, np.int32), np.zeros(4096, np.uint32)
        self.used = self.used_letters = 0
        #: pre-tokens whose hash belongs to another one
        self.odd: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers for new pre-tokens."""
        numbers = np.arange(self.n, self.n + len(pieces))
        self.n += len(pieces)
        while len(self.begins) < self.n:
            self.begins, self.counts, self.spelt, self.lengths = (np.resize(x, 2 * len(x)) for x in (self.begins, self.counts, self.spelt, self.lengths))
        for number, piece in zip(numbers.tolist(), pieces):
            ids = merge(piece.encode() if piece.isascii() else _utf8(piece), self.ranks)
            letters = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            while self.used_letters + len(letters) > len(self.letters):
                self.letters = np.resize(self.letters, 2 * len(self.letters))
            self.ids[self.used : self.used + len(ids)] = ids
            self.letters[self.used_letters : self.used_letters + len(letters)] = letters
            self.begins[number], self.counts[number] = self.used, len(ids)
            self.spelt[number], self.lengths[number] = self.used_letters, len(letters)
            self.used += len(ids)
            self.used_letters += len(letters)
        return numbers

    def _known(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pre-tokens and their numbers."""
        starts = pretoken_starts(block)
        ends = np.append(starts[1:], block.n)
        hashes = block.hashes(starts, ends)
        numbers = self.index.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            if self.n > REMEMBERED or self.used_letters > REMEMBERED_CHARS:
                self._forget()
                missing = np.arange(len(starts))
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self.index.add(new, self._learn([block.joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]))
            numbers[missing] = self.index.find(hashes[missing])
        if not len(starts):
            return starts, numbers
        # the pre-tokens tile the block: their spellings, one after the other, must be its text
        size = ends - starts
        wrong = np.flatnonzero(self.lengths[numbers] != size)
        if not len(wrong):
            spelt = self.letters[np.repeat(self.spelt[numbers] - starts, size) + np.arange(block.n)]
            wrong = np.unique(np.searchsorted(starts, np.flatnonzero(spelt != block.cps), side="right") - 1)
        else:
            wrong = np.flatnonzero([self._spelling(k) != block.joined[s:e] for k, s, e in zip(numbers.tolist(), starts.tolist(), ends.tolist())])
        for i in wrong.tolist():
            piece = block.joined[starts[i] : ends[i]]
            if piece not in self.odd:
                self.odd[piece] = int(self._learn([piece])[0])
            numbers[i] = self.odd[piece]
        return starts, numbers

    def _spelling(self, number: int) -> str:
        begin = self.spelt[number]
        return self.letters[begin : begin + self.lengths[number]].tobytes().decode("utf-32-le", "surrogatepass")

    def count(self, block: Block) -> np.ndarray:
        """Number of tokens of each text of the block."""
        starts, numbers = self._known(block)
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(self.counts[numbers], out=total[1:])
        at = np.searchsorted(starts, block.bounds)
        return total[at[1:]] - total[at[:-1]]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of the block's texts."""
        starts, numbers = self._known(block)
        counts = self.counts[numbers]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        source = np.repeat(self.begins[numbers] - total[:-1], counts) + np.arange(total[-1])
        return total[np.searchsorted(starts, block.bounds)], self.ids[source]


def _utf8(piece: str) -> bytes:
    try:
        return piece.encode("utf-8")
    except UnicodeEncodeError:
        return piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(content: bytes) -> Encoder:
    """This worker's encoder for a rank file."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_ranks(content))
    return _ENCODERS[key]


def encode_column(df: DataFrame, id_column: str, text_column: str, ranks_path: str) -> DataFrame:
    """id, ids: the token ids of each text. The rank file (under 1 MB for 50,000 tokens) is read on the driver and
    sent to the workers; nothing is shuffled."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content.value)
        for batch in batches:
            for block in blocks(batch.column(1).to_pylist()):
                offsets, ids = encoder.encode(block)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block.texts)), lists], ["doc_id", "ids"]
                )

    source = df.select(df[id_column].cast("bigint").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids array<int>")


def count_column(df: DataFrame, id_column: str, text_column: str, ranks_path: str) -> DataFrame:
    """id, n_tokens: the number of tokens of each text (0 for null and empty ones)."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content.value)
        for batch in batches:
            counts = [encoder.count(block) for block in blocks(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))],
                ["doc_id", "n_tokens"],
            )

    source = df.select(df[id_column].cast("bigint").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint")
