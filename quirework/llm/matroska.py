"""Media columns: Matroska files as packet tables.

``parse`` walks the variable-length EBML elements of a file (known and unknown sizes, void and
checksum elements skipped), its tracks, clusters, block groups and simple blocks with every kind of
lacing, and its cues. ``packets``, ``tracks`` and ``cues`` turn a binary column into tables with
timestamps, tracks and byte ranges; ``mux`` stores a payload losslessly as 8-bit mono samples.

Nulls: a null file has no tracks, packets or cues and gives no rows; a file that is not EBML, or is
cut short, gives the packets before the fault. Equal bytes give equal rows, repeated rows repeat. A null or empty text is
stored as 64 zero bytes; a very long one becomes one file of many clusters and is held whole by its task. Extra columns are not
read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts, slices

# Element ids of the format.
EBML, SEGMENT, INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")
#: Elements that may end a cluster or segment of unknown size.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}

PACKET = (
    "track:bigint,timestamp_ns:bigint,cluster_offset:bigint,byte_offset:bigint,byte_length:bigint,"
    "lacing:string,lace_index:int,keyframe:boolean"
)


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """Element id, marker kept, and the place after it."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError("bad element id")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """Variable-length number without its marker (None: all ones, that is unknown)."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("bad element size")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, its end) of each child in a range."""
    while at < end:
        start = at
        try:
            kind, at = read_id(data, at)
            size, body = read_size(data, at)
        except (ValueError, IndexError):
            return
        if kind in stop:
            return
        if size is None:
            at = body
            for k, s, _, e in elements(data, body, end, TOP_LEVEL if kind == CLUSTER else {SEGMENT, EBML}):
                at = e
            yield kind, start, body, at
        else:
            at = body + size
            yield kind, start, body, min(at, end)


def _uint(data: bytes, body: int, end: int) -> int:
    return int.from_bytes(data[body:end], "big")


def _laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if lacing == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
            sizes.append(size)
    elif lacing == 3:
        for i in range(count - 1):
            width = 9 - data[at].bit_length()
            value, at = read_size(data, at)
            if value is None:
                value = (1 << 7 * width) - 1
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("lace beyond its block")
        out.append((at, size))
        at += size
    return out


def parse(data: bytes | None) -> dict[str, list[dict]]:
    """Tracks, packets and cues of one file; byte offsets count from the start of the file."""
    out: dict[str, list[dict]] = {"tracks": [], "packets": [], "cues": []}
    try:
        if data and read_id(data, 0)[0] == EBML:
            for kind, _, body, end in elements(data, 0, len(data)):
                if kind == SEGMENT:
                    _segment(data, body, end, out)
    except (ValueError, IndexError):
        pass
    return out


def _segment(data: bytes, at: int, last: int, out: dict[str, list[dict]]) -> None:
    scale, durations = 1_000_000, {}
    for kind, start, body, end in elements(data, at, last, {SEGMENT, EBML}):
        if kind == INFO:
            for k, _, b, e in elements(data, body, end):
                scale = _uint(data, b, e) if k == TIMESTAMP_SCALE else scale
        elif kind == TRACKS:
            for k, _, b, e in elements(data, body, end):
                if k == TRACK_ENTRY:
                    track = _track(data, b, e)
                    durations[track["track"]] = track["default_duration_ns"]
                    out["tracks"].append(track)
        elif kind == CLUSTER:
            base = 0
            for k, _, b, e in elements(data, body, end, TOP_LEVEL):
                if k == TIMESTAMP:
                    base = _uint(data, b, e)
                elif k == SIMPLE_BLOCK:
                    _block(data, b, e, base, scale, start, durations, None, out)
                elif k == BLOCK_GROUP:
                    inner = {x: (y, z) for x, _, y, z in elements(data, b, e)}
                    if BLOCK in inner:
                        length = _uint(data, *inner[BLOCK_DURATION]) * scale if BLOCK_DURATION in inner else None
                        _block(data, *inner[BLOCK], base, scale, start, durations, REFERENCE_BLOCK not in inner, out, length)
        elif kind == CUES:
            for k, _, b, e in elements(data, body, end):
                time = 0
                for x, _, y, z in elements(data, b, e) if k == CUE_POINT else ():
                    if x == CUE_TIME:
                        time = _uint(data, y, z)
                    elif x == CUE_TRACK_POSITIONS:
                        p = {i: _uint(data, j, m) for i, _, j, m in elements(data, y, z)}
                        out["cues"].append({"track": p.get(CUE_TRACK, 0), "timestamp_ns": time * scale, "cluster_offset": at + p.get(CUE_CLUSTER_POSITION, 0)})


def _track(data: bytes, body: int, end: int) -> dict:
    x = {k: (b, e) for k, _, b, e in elements(data, body, end)}
    audio = {k: (b, e) for k, _, b, e in elements(data, *x[AUDIO])} if AUDIO in x else {}
    number = lambda at, k, none=None: _uint(data, *at[k]) if k in at else none
    rate = data[slice(*audio[SAMPLING_FREQUENCY])] if SAMPLING_FREQUENCY in audio else b""
    return {
        "track": number(x, TRACK_NUMBER, 0), "kind": number(x, TRACK_TYPE), "codec": data[slice(*x[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in x else None,
        "default_duration_ns": number(x, DEFAULT_DURATION), "channels": number(audio, CHANNELS, 1 if audio else None), "bit_depth": number(audio, BIT_DEPTH),
        "sampling_hz": struct.unpack(">d" if len(rate) == 8 else ">f", rate)[0] if len(rate) in (4, 8) else None,
    }


def _block(data: bytes, body: int, end: int, base: int, scale: int, cluster: int, durations: dict, key: bool | None, out: dict, length: int | None = None) -> None:
    track, at = read_size(data, body)
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    lacing = flags >> 1 & 3
    frames = _laces(data, at + 3, end, lacing)
    # frames of a lace follow each other by the track's default duration, else by their share of the block's
    step = durations.get(track) or (length // len(frames) if length else 0)
    keyframe = bool(flags & 0x80) if key is None else key
    for i, (offset, size) in enumerate(frames):
        out["packets"].append({"track": track, "timestamp_ns": (base + relative) * scale + i * step, "cluster_offset": cluster, "byte_offset": offset, "byte_length": size, "lacing": LACINGS[lacing], "lace_index": i, "keyframe": keyframe})


def size_bytes(value: int, width: int = 0) -> bytes:
    n = width or next(i for i in range(1, 9) if value < (1 << 7 * i) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def _laced(frames: list[bytes], lacing: int) -> bytes:
    head = b"" if lacing == 0 else bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3 and len(frames) > 1:  # the last size is not written
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            head += size_bytes(b - a + (1 << 13) - 1, 2)
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = 1024, laces: int = 8, blocks: int = 16, rate: int = 8000) -> bytes:
    """One track of 8-bit mono samples: frames laced in blocks (every kind of lacing in turn), blocks in clusters, a cue for each cluster."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    step = frame * 1_000_000_000 // rate
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    entry = element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, step) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    place, cues, at, turn = sum(map(len, parts)), [], 0, 0
    while at < len(frames):
        base, body = at * step // 1_000_000, b""
        for _ in range(blocks):
            if at >= len(frames):
                break
            lacing, turn = turn % 4, turn + 1
            group = frames[at : at + (laces if lacing else 1)]
            if lacing == 2 and len(group[-1]) != frame:  # a fixed-size lace needs equal frames
                lacing = 1
            ms = at * step // 1_000_000 - base
            body += element(SIMPLE_BLOCK, size_bytes(1) + struct.pack(">h", ms) + bytes([0x80 | lacing << 1]) + _laced(group, lacing))
            at += len(group)
        cluster = element(CLUSTER, element(TIMESTAMP, base) + body)
        cues.append(element(CUE_POINT, element(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, place))))
        parts.append(cluster)
        place += len(cluster)
    head = element(EBML, element(0x4286, 1) + element(0x4282, b"matroska") + element(0x4287, 4) + element(0x4285, 2))
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def padded(text: str, unit: int = 64) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of ``unit``."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def store_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + n_bytes, media: each text (null: empty) as a padded payload in a Matroska file."""

    def make():
        return lambda texts: [[len(t.encode("utf-8", "surrogatepass")) for t in texts], [mux(padded(t)) for t in texts]]

    return map_texts(df, make, "n_bytes bigint, media binary", text, list(keep))


def parsed(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """``df`` + tracks, packets, cues arrays (+ stored: the bytes of all packets in file order, read back by their ranges)."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = (
        "tracks array<struct<track:bigint,kind:bigint,codec:string,default_duration_ns:bigint,channels:bigint,bit_depth:bigint,sampling_hz:double>>,"
        f"packets array<struct<{PACKET}>>, cues array<struct<track:bigint,timestamp_ns:bigint,cluster_offset:bigint>>" + ", stored binary" * payload
    )
    kept = df.schema.fields
    arrow = to_arrow_schema(T.StructType([*kept, *T._parse_datatype_string(fields).fields]))
    n = len(kept)

    def run(batches):
        for whole in batches:
            for b in slices(whole, media):
                files = b.column(media).to_pylist()
                found = [parse(f) for f in files]
                cols = [[x[k] for x in found] for k in ("tracks", "packets", "cues")]
                if payload:
                    cols.append([b"".join(f[p["byte_offset"] : p["byte_offset"] + p["byte_length"]] for p in x["packets"]) for f, x in zip(files, found)])
                yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(n)] + [pa.array(c, type=arrow.field(n + i).type) for i, c in enumerate(cols)], schema=arrow)

    return df.mapInArrow(run, T.StructType([*kept, *T._parse_datatype_string(fields).fields]))


def packets(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Packet table: ``keep``, packet_no, and a column for each field of a packet."""
    return parsed(df.select(*keep, media), media).select(*keep, F.posexplode("packets").alias("packet_no", "p")).select(*keep, "packet_no", "p.*")


def tracks(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return parsed(df.select(*keep, media), media).select(*keep, F.explode("tracks").alias("t")).select(*keep, "t.*")


def cues(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return parsed(df.select(*keep, media), media).select(*keep, F.explode("cues").alias("c")).select(*keep, "c.*")


def payload_digests(docs: DataFrame) -> DataFrame:
    """Digest of each stored text: stores it, parses the file back, and describes bytes and packets."""
    read = parsed(store_texts(docs), payload=True)
    last = F.element_at("packets", -1)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("stored").cast("bigint").alias("payload_bytes"),
        F.sha2("stored", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(stored, -64)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("packets="), F.size("packets")),
            F.concat(F.lit("cues="), F.size("cues")),
            F.concat(F.lit("laced="), F.size(F.filter("packets", lambda p: p["lacing"] != "none"))),
            F.concat(F.lit("last_ns="), last["timestamp_ns"]),
            F.concat(F.lit("last_bytes="), last["byte_length"]),
            F.concat(F.lit("codec="), F.element_at("tracks", 1)["codec"]),
        ).alias("feature"),
    )
