"""SentencePiece encoding and decoding that keeps byte offsets.

``CharMap`` reads a model's compiled character map (a double array of byte transitions followed by the
replacement strings) and rewrites a text by the longest prefix at each place, noting for every normalised
byte the original byte it comes from. With the model's rules for white space (extra spaces, the mark before the text, spaces as
marks) this gives the normalised text, and that is what is encoded; by the alignment every piece is
projected to a span of original bytes. Pieces are the library's own: the normalised text is cut where no piece of the vocabulary can
reach across (before a white space mark, and at line ends), and each distinct unit is encoded once
per task by the library. A vocabulary with such pieces has its normalised texts encoded whole.

Nulls and empty texts have no pieces (with begin and end ids: these two). Very long texts are encoded whole; a task holds one with its
alignment (8 bytes for each byte). Equal texts give equal rows, repeated rows each give one. Extra columns are not read, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts

SPACE = "▁"
#: Distinct units that one task remembers, of at most LONG characters; beyond it the memory is emptied, so it stays bounded.
UNITS, LONG = 1_000_000, 256
UNIT = re.compile(f"\n+[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")


class CharMap:
    """Longest-prefix rewriting by a compiled character map; an empty map rewrites nothing."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.trie = array("I", blob[4 : 4 + size])
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place of the replacement) of the longest key that starts at ``at``."""
        units, found = self.trie, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the original byte it starts from."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.trie:
            return data, np.arange(len(data) + 1)
        out, source, at = bytearray(), array("q"), 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit:
                used, place = hit
                new = self.strings[place : self.strings.index(b"\0", place)]
            else:
                lead = data[at]
                used = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + used]
            out += new
            source.extend([at] * len(new))
            at += used
        source.append(len(data))
        return bytes(out), np.frombuffer(source, np.int64)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte, at = data[at], at + 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a serialised message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def normaliser_spec(model: bytes) -> dict:
    """The character map and the switches of a model's normaliser (field 3 of the model)."""
    spec = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
    for k, v in _fields(model):
        if k == 3:
            spec |= dict(_fields(v))
    return {"charsmap": spec[2], "dummy_prefix": bool(spec[3]), "drop_extra": bool(spec[4]), "escape": bool(spec[5])}


class Encoder:
    """Ids and original byte spans of texts, equal to the library's."""

    def __init__(self, model_file: str):
        import sentencepiece

        with open(model_file, "rb") as f:
            self.spec = normaliser_spec(f.read())
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.map = CharMap(self.spec["charsmap"])
        vocabulary = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        no_inner = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in vocabulary)
        defined = any(self.sp.is_control(i) is False and self.sp.is_unused(i) for i in range(len(vocabulary)))
        #: Whether units can be encoded one by one.
        self.by_unit = self.spec["dummy_prefix"] and self.spec["escape"] and not self.spec["drop_extra"] and no_inner and not defined
        self.widths = np.array([1 if self.sp.is_byte(i) else len(p.encode()) for i, p in enumerate(vocabulary)])
        self.unknown = self.sp.unk_id()
        self.mark = self.sp.piece_to_id(SPACE)
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is cut into pieces, and for each of its bytes (and the end) the original byte it starts from."""
        data, source = self.map.normalise(text)
        raw = np.frombuffer(data, np.uint8)
        end = source[-1:]
        if self.spec["drop_extra"]:  # runs of spaces count as one, those at the ends go
            space = raw == 0x20
            keep = ~space
            keep[1:] |= space[1:] & ~space[:-1]
            keep[: len(raw) - len(data.lstrip(b" "))] = False
            keep[len(data.rstrip(b" ")) :] = False
            raw, source = raw[keep], np.append(source[:-1][keep], end)
            data = raw.tobytes()
        if self.spec["escape"]:
            source = np.append(np.repeat(source[:-1], np.where(raw == 0x20, 3, 1)), end)
            data = data.replace(b" ", SPACE.encode())
            if self.spec["drop_extra"]:  # written marks at the end count as spaces
                data = re.sub(b"(?:%b)+\\Z" % SPACE.encode(), b"", data)
                source = np.append(source[: len(data)], end)
        if self.spec["dummy_prefix"] and data:
            data, source = SPACE.encode() + data, np.concatenate([np.zeros(3, np.int64), source])
        return data.decode("utf-8", "surrogatepass"), source

    def _of_library(self, normal: str) -> list[int]:
        """Pieces of a normalised text: the library puts the first mark there itself."""
        if normal[:1] == SPACE and self.spec["dummy_prefix"]:
            return self.sp.encode(normal[1:]) if len(normal) > 1 else [self.mark]
        return self.sp.encode(normal)

    def _unit(self, unit: str) -> bytes:
        if unit[0] == "\n":  # encoded after a lone white space mark, which goes
            ids = self.sp.encode(unit)
            if ids[0] != self.mark:
                raise ValueError("a line end joined the white space mark")
            ids = ids[1:]
        else:
            ids = self._of_library(unit)
        if len(self.known) >= UNITS:
            self.known.clear()
        packed = array("I", ids).tobytes()
        if len(unit) <= LONG:
            self.known[unit] = packed
        return packed

    def _units(self, normal: str) -> list[str]:
        return UNIT.findall(normal)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids without begin and end, and the original byte span of each: two columns, begin and end."""
        normal, source = self.normalise(text)
        if not normal:
            return np.zeros(0, np.uint32), np.zeros((0, 2), np.int64)
        if self.by_unit:
            known, make = self.known, self._unit
            ids = np.frombuffer(b"".join([known.get(u) or make(u) for u in self._units(normal)]), np.uint32)
        else:
            ids = np.array(self._of_library(normal), np.uint32)
        widths = self.widths[ids]
        if (ids == self.unknown).any():  # such a piece is as wide as what it stands for
            widths = np.array([len(p.encode()) if i == self.unknown else w for i, p, w in zip(ids, self._surfaces(normal), widths)])
        place = np.minimum(np.concatenate(([0], np.cumsum(widths))), len(source) - 1)
        at = source[place]
        return ids, np.stack([at[:-1], at[1:]], axis=1)

    def _surfaces(self, normal: str) -> list[str]:
        """The pieces as the library writes them: an unknown one as its characters."""
        if not self.by_unit:
            return self._pieces(normal)
        return [p for u in self._units(normal) for p in (self.sp.encode(u, out_type=str)[1:] if u[0] == "\n" else self._pieces(u))]

    def _pieces(self, normal: str) -> list[str]:
        marked = normal[:1] == SPACE and self.spec["dummy_prefix"]
        return [SPACE] if marked and len(normal) == 1 else self.sp.encode(normal[1:] if marked else normal, out_type=str)


def encode(df: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """``keep`` + ids array<int> (+ spans array<struct<begin, end>> of original bytes), without begin and end ids."""

    def make():
        enc = Encoder(model_file)

        def run(texts):
            found = [enc.encode(t) for t in texts]
            out = [[ids.astype(np.int32) for ids, _ in found]]
            if spans:
                out.append([[{"begin": a, "end": b} for a, b in at.tolist()] for _, at in found])
            return out

        return run

    return map_texts(df, make, "ids array<int>" + ", spans array<struct<begin:bigint,end:bigint>>" * spans, text, list(keep))


def decode(df: DataFrame, model_file: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + decoded: the library's text of each array of ids (null: empty)."""
    @F.pandas_udf("string")
    def text_of(col: pd.Series) -> pd.Series:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return col.map(lambda x: "" if x is None else sp.decode([int(i) for i in x]))

    return df.select(*keep, text_of(ids).alias("decoded"))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: count and digest of all ids with begin and end, digest of the decoded text, and of the pieces' spans.

    spans_sha256 is over begin and end of each piece in order, as little-endian signed 64-bit numbers; n_empty_spans
    counts pieces that stand for no original byte (the mark before the text), n_covered_bytes what the spans cover.
    """

    def make():
        import hashlib

        enc = Encoder(model_file)
        bos, eos = (np.array([i], np.uint32) for i in (enc.sp.bos_id(), enc.sp.eos_id()))

        def run(texts):
            cols: list[list] = [[], [], [], [], [], []]
            for t in texts:
                ids, spans = enc.encode(t)
                whole = np.concatenate([bos, ids, eos])
                size = spans[:, 1] - spans[:, 0]
                row = (
                    len(whole), hashlib.sha256(whole.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.sp.decode(whole.tolist()).encode()).hexdigest(),
                    hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest(), int((size == 0).sum()), int(size.sum()),
                )
                for c, v in zip(cols, row):
                    c.append(v)
            return cols

        return run

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_empty_spans bigint, n_covered_bytes bigint", "text", ["doc_id"])
