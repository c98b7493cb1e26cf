"""Operator 5, byte-pair encoding and decoding by content-defined chunk reuse.

A rolling hash over the last bytes of a text cuts it into chunks, so equal passages of different documents give
equal chunks. Each distinct chunk is encoded once (a task keeps a bounded memory of them). A chunk's tokens are
right except near its ends. There the join is repaired: the text from the last sync point of the left chunk to
the first of the right one is encoded again. A sync point is a place between a non-space and a white-space
character; no token of the vocabulary's pattern spans it, so outer tokens agree exactly there. If the encodings
of chunk and repair disagree at a sync point, the repair grows to the chunks' whole text.

The strings of special tokens in a text become those tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from velado.llm.util import text_rows
from velado.llm.words import Tile, tiles

#: White space of the pre-tokenizer's pattern (Unicode property White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SYNC = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
LAST_SYNC = re.compile(f".*(?<=[^{SPACE}])(?=[{SPACE}])", re.DOTALL)
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A cut falls where the rolling hash is 0 modulo this: the mean chunk in bytes.
MEAN_CHUNK = 512
ROLL = 8
MEMORY_BYTES = 64 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Bounded(dict):
    """A dict that fills itself by ``make(key)`` and forgets everything past a byte bound."""

    def __init__(self, make, cost, limit: int = MEMORY_BYTES):
        super().__init__()
        self.make, self.cost, self.limit, self.held = make, cost, limit, 0

    def __missing__(self, key):
        if self.held > self.limit:
            self.forget()
        self[key] = value = self.make(key)
        self.held += self.cost(key, value)
        return value

    def forget(self) -> None:
        self.clear()
        self.held = 0


class Codec:
    """Encoder and decoder of one byte-level BPE file; exact for texts between sync points."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        to_byte = _byte_letters()
        self.bytes = {i: bytes(to_byte[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        ranks = {b: i for i, b in self.bytes.items()}
        self.bytes.update({x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])})
        self.bytes = [self.bytes[i] for i in range(len(self.bytes))]
        self.csv = [b"%d," % i for i in range(len(self.bytes))]
        self.units = Bounded(self._unit, lambda k, v: 240 + 3 * len(k))
        # Token ids are merge ranks in such files; the same merges then run without a pre-tokenizer cache.
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})

    def _unit(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("i", self.fast.encode_ordinary(text)).tobytes()

    def id_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. Units (white space and the word after it) begin and end at sync
        points, so each is encoded by itself, and frequent ones once."""
        return b"".join(map(self.units.__getitem__, UNIT.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.id_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The byte for each letter of a byte-level vocabulary: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class Chunk:
    """Encoding of a chunk: the tokens between its first and last sync point, and the text before and after."""

    __slots__ = ("head", "tail", "n", "csv", "raw", "synced")

    def __init__(self, text: str, c: Codec):
        self.head, self.tail, self.n, self.csv, self.raw, self.synced = text, "", 0, b"", b"", False
        first = SYNC.search(text)
        if first is None:
            return
        at, last = first.start(), LAST_SYNC.match(text).end()
        ids = c.encode(text)
        i = agree(ids, len(text[:at].encode()), c.bytes)
        j = agree(ids[::-1], len(text[last:].encode()), c.bytes)
        if i is None or j is None:  # a token spans a sync point: the repair takes the whole chunk
            return
        ids = ids[i : len(ids) - j]
        self.head, self.tail, self.synced, self.n = text[:at], text[last:], True, len(ids)
        self.csv, self.raw = b"".join(map(c.csv.__getitem__, ids)), b"".join(map(c.bytes.__getitem__, ids))


def agree(ids: list[int], size: int, token_bytes: list[bytes]) -> int | None:
    """How many of the first ids make up exactly ``size`` bytes; None if one of them spans that place."""
    n = 0
    while size > 0:
        size -= len(token_bytes[ids[n]])
        n += 1
    return n if size == 0 else None


class ChunkEncoder:
    """Encodes whole texts from remembered chunks and repaired joins."""

    def __init__(self, path: str):
        self.codec = codec(path)
        self.chunks = Bounded(lambda t: Chunk(t.decode(), self.codec), lambda k, v: 600 + 6 * len(k), MEMORY_BYTES // 2)
        self.joins = Bounded(self._plain, lambda k, v: 300 + 6 * len(k), MEMORY_BYTES // 4)

    def _plain(self, text: str) -> tuple[int, bytes, bytes]:
        ids = self.codec.encode(text)
        return len(ids), b"".join(map(self.codec.csv.__getitem__, ids)), b"".join(map(self.codec.bytes.__getitem__, ids))

    def pieces(self, raw: list[bytes]) -> tuple[int, bytes, bytes]:
        """Number of ids, decimal ids each followed by a comma, and decoded bytes of the joined chunks."""
        n, csv, out, open_text = 0, [], [], ""
        for r in raw:
            c = self.chunks[r]
            open_text += c.head
            if not c.synced:
                continue
            for got in ((self.joins[open_text],) if open_text else ()):
                n += got[0]
                csv.append(got[1])
                out.append(got[2])
            n += c.n
            csv.append(c.csv)
            out.append(c.raw)
            open_text = c.tail
        if open_text:
            got = self.joins[open_text] if len(open_text) < 4096 else self._plain(open_text)
            n += got[0]
            csv.append(got[1])
            out.append(got[2])
        return n, b"".join(csv), b"".join(out)

    def ids(self, text: str) -> list[int]:
        raw = text.encode()
        parts = np.split(np.frombuffer(raw, np.uint8), chunk_starts(np.frombuffer(raw, np.uint8)))
        return [int(x) for x in self.pieces([p.tobytes() for p in parts])[1].split(b",")[:-1]]


def chunk_starts(data: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Byte places where a chunk begins: after ROLL bytes whose rolling hash is 0 modulo ``mean``, never inside a
    UTF-8 character. Content alone decides, so equal passages are cut alike."""
    if len(data) <= ROLL:
        return np.zeros(0, np.int64)
    mul, h = np.uint32(0x01000193), np.zeros(len(data) - ROLL, np.uint32)
    for i in range(ROLL):
        h = (h ^ data[i : len(data) - ROLL + i]) * mul
    at = np.flatnonzero((h >> np.uint32(12)) % np.uint32(mean) == 0) + ROLL
    return at[(data[at] & 0xC0) != 0x80]


def encode_rows(t: Tile, encoder: ChunkEncoder) -> Iterator[tuple[int, bytes, bytes]]:
    cut = chunk_starts(t.data)
    raw = t.data.tobytes()
    first = np.searchsorted(cut, t.offsets, "right")
    until = np.searchsorted(cut, t.offsets, "left")
    for d in range(len(t)):
        lo, hi = int(t.offsets[d]), int(t.offsets[d + 1])
        at = [lo, *map(int, cut[first[d] : until[d + 1]]), hi]
        yield encoder.pieces([raw[a:b] for a, b in zip(at, at[1:])] if hi > lo else [])


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded`` if asked) of every document row.

    Null and empty texts have no ids (both digests are of the empty string). Repeated rows come back each; an
    empty table gives no rows; other columns are ignored. Text that is all one word, however long, has no sync
    point and is encoded as one piece.
    """
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for t in tiles(batches):
            n, a, b, ids, decoded = [], [], [], [], []
            for count, csv, out in encode_rows(t, encoder):
                n.append(count)
                a.append(hashlib.sha256(csv[:-1]).hexdigest())
                out = out.decode("utf-8", "replace")
                b.append(hashlib.sha256(out.encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(csv[:-1].decode(), np.int32, sep=",") if csv else np.zeros(0, np.int32))
                    decoded.append(out)
            columns = [t.batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*columns, *more], names[: 4 + len(more)])
        encoder.codec.units.forget()  # the worker lives on

    rows = text_rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
