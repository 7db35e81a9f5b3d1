"""Token ids of whole texts by a public byte-level BPE: forced-boundary splitting.

Two bytes that stand beside each other in no token of the vocabulary can never be merged across, so a cut between
them is certain. A batch of texts is one run of bytes; a lookup table of 65,536 byte pairs finds all such cuts at
once. The fragments repeat very much: each distinct one is encoded once, and the ids are put together by index.

A cut must not change how the tokenizer's own pattern splits the text. The pattern looks ahead only behind white
space and treats apostrophes specially, so cuts are made only in front of a whole character, behind a character
that is neither white space nor closely behind an apostrophe, and not in front of an apostrophe. Everything else
stays together in one fragment and is split by the pattern as usual.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tempolex.llm.arrow import plain, small_batches

#: Distinct fragments a worker remembers between batches.
MEMORY = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def free_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """free[256 * a + b]: no token holds byte b directly behind byte a."""
    free = np.ones(1 << 16, bool)
    for token in ranks:
        if len(token) > 1:
            t = np.frombuffer(token, np.uint8).astype(np.int64)
            free[t[:-1] * 256 + t[1:]] = False
    return free


def forced_cuts(data: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Positions i such that a cut in front of data[i] is certain and leaves the pattern's own splits as they are."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    pad = np.concatenate([np.zeros(3, np.uint8), data])
    a, a2, a3, b = pad[2:-1][: len(data)], pad[1:-2][: len(data)], pad[0:-3][: len(data)], data
    candidates = np.flatnonzero(free[a.astype(np.int64) * 256 + b])
    a, a2, a3, b = a[candidates], a2[candidates], a3[candidates], b[candidates]
    apostrophe = 0x27
    ascii_mark = (a > 0x20) & (a < 0x7F)
    two_bytes = ((a & 0xC0) == 0x80) & (a2 >= 0xC3) & (a2 <= 0xDF)  # white space of two bytes begins with 0xC2
    three_bytes = ((a & 0xC0) == 0x80) & ((a2 & 0xC0) == 0x80) & ((a3 == 0xE0) | (a3 >= 0xE4)) & (a3 < 0xF0)  # of three with 0xE1 to 0xE3
    whole = (b & 0xC0) != 0x80
    free_of_marks = (a != apostrophe) & (b != apostrophe) & (a2 != apostrophe) & (a3 != apostrophe)
    return candidates[(candidates > 0) & whole & free_of_marks & (ascii_mark | two_bytes | three_bytes)]


class Encoder:
    """Encodes batches of texts; made once per Python worker and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.free = free_pairs(ranks)
        self.known: dict[bytes, np.ndarray] = {}

    def ids_of(self, fragment: bytes) -> np.ndarray:
        found = self.known.get(fragment)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[fragment] = np.asarray(self.bpe.encode_ordinary(fragment.decode("utf-8")), np.int32)
        return found

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """One list of ids per row; null and empty texts give an empty list."""
        rows = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pa.concat_arrays([texts])  # offsets from 0
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if not len(data):
            return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.int32()))
        starts = np.unique(np.concatenate([forced_cuts(data, self.free), offsets[:-1], offsets[-1:]]))
        fragments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), raw])
        coded = fragments.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = [self.ids_of(f) for f in coded.dictionary.to_pylist()]
        sizes = np.array([len(e) for e in encoded], np.int64)
        flat = np.concatenate(encoded)
        at = np.cumsum(sizes) - sizes
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(at[index] - (ends - lengths), lengths) + np.arange(ends[-1])]
        # ids in front of each row: those of all fragments that begin before the row
        before = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids))


_encoders: dict = {}


def encode_texts(df: DataFrame, record_id: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(record_id, ids): the ids of every text without special tokens; their strings in a text are ordinary text.

    Null and empty texts have an empty list, repeated rows stay repeated, other columns are ignored. There is no
    shuffle. The vocabulary (a fixed file of about 1 MB, its path a parameter) is broadcast.
    """
    import public_tokenizers

    path, pattern = vocabulary or default_vocabulary(), pattern or public_tokenizers.PATTERN
    shared = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    key = (path, pattern)
    kind = "string" if dict(df.dtypes)[record_id] == "string" else "bigint"
    schema = pa.schema([(record_id, pa.string() if kind == "string" else pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(key)
        if encoder is None:
            lines = (line.split() for line in shared.value.splitlines() if line)
            encoder = _encoders[key] = Encoder({base64.b64decode(t): int(r) for t, r in lines}, pattern)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field(0).type), encoder.encode(plain(b.column(1)))], schema=schema)

    return small_batches(df).select(record_id, text).mapInArrow(run, f"{record_id} {kind}, ids array<int>")
