"""Byte-level BPE through a sentencepiece model that is written from the ranks.

Every byte string of the vocabulary becomes a piece over 256 printable
characters, one for each byte, with minus its rank as the score and the rank
as its id; the normaliser is the identity.  sentencepiece then joins the pair
with the best score first, which is the pair with the lowest rank.  Pre-tokens
(matches of the pattern) are encoded one by one; decoding looks ids up in the
vocabulary and joins the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffers, spans

#: Distinct words whose ids a task keeps, and their most characters; a fuller cache is started anew.
CACHE_WORDS, CACHED_LENGTH = 300_000, 100


def _characters() -> str:
    """The character of each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


CHARACTERS = _characters()


def load_ranks(path: str) -> list[bytes]:
    """Byte strings in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised model; field numbers are those of sentencepiece's public schema."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score)
                      + _number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece("".join(CHARACTERS[b] for b in t), -float(rank), normal)
              for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    no_id = (1 << 64) - 1
    trainer = (_number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens))
               + b"".join(_number(f, no_id) for f in (41, 42, 43)))
    normaliser = _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encodes texts to uint32 ids and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.split = regex.compile(pattern).findall
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        decimals = [b"%d " % i for i in range(len(tokens))]
        self.decimal_lengths = np.array([len(d) for d in decimals], np.int64)
        self.decimal_places = np.concatenate(([0], np.cumsum(self.decimal_lengths)))
        self.decimal_flat = np.frombuffer(b"".join(decimals), np.uint8)
        self.inner_gap = re.compile(r" \s").search
        self.cache: dict[str, bytes] = {}

    def pre_tokens(self, words: list[str]) -> list[bytes]:
        """Packed ids of each string, its pre-tokens encoded one by one."""
        split = [self.split(word) for word in words]
        # 0xFF is in no UTF-8 text.
        line = b"\xff".join([p.encode() for parts in split for p in parts])
        mapped = line.decode("latin-1").translate(CHARACTERS).split(CHARACTERS[255])
        found = self.processor.encode(mapped, num_threads=1)
        packed = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        out, at, ids = [], 0, iter(map(len, found))
        for parts in split:
            size = 4 * sum(islice(ids, len(parts)))
            out.append(packed[at:at + size])
            at += size
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """A pre-token never reaches across the place before a single blank that a
        visible character follows, so texts are cut there and the parts' ids kept.
        A text with longer gaps is matched as a whole."""
        cut = []
        for text in texts:
            if text.endswith(" ") or self.inner_gap(text):
                cut.append([text])
            else:
                first, *rest = text.split(" ")
                cut.append([first, *map(" ".__add__, rest)])
        known = self.cache
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list({w for parts in cut for w in parts if w and w not in known})
        known[""] = b""
        long = {}
        for word, ids in zip(new, self.pre_tokens(new) if new else ()):
            (known if len(word) <= CACHED_LENGTH else long)[word] = ids
        if not long:
            return [np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4") for parts in cut]
        return [np.frombuffer(b"".join([long[w] if w in long else known[w] for w in parts]), "<u4") for parts in cut]

    @staticmethod
    def _gather(ids, flat, places, lengths) -> bytes:
        size = lengths[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return flat[np.repeat(places[ids] - (end - size), size) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return self._gather(ids, self.flat, self.places, self.lengths)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return self._gather(ids, self.decimal_flat, self.decimal_places, self.decimal_lengths)[:-1]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id",
                      text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256 (and ids).

    A null text is empty: no ids, digests of nothing.  Texts are encoded whole.
    Repeated rows each give a row; other columns are not read.
    """
    tokens = load_ranks(ranks_path)

    def run(batches):
        codec = Codec(tokens, pattern)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            data, at = memoryview(data), offsets.tolist()
            counts, of_ids, of_bytes, lists = [], [], [], []
            for i, j in spans(offsets):
                for ids in codec.encode([str(data[at[k]:at[k + 1]], "utf-8") for k in range(i, j)]):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(codec.decimals(ids)).hexdigest())
                    of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        lists.append(ids.astype("<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                       pa.array(of_bytes, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
            .withColumnRenamed("key", key))
