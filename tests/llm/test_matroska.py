import random

import pytest

from quirework.llm import matroska as m

@pytest.mark.parametrize("n", [64, 65 * 64, 1024, 1024 * 9, 200_000 // 64 * 64])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = m.mux(payload)
    x = m.parse(data)
    assert b"".join(data[p["byte_offset"] : p["byte_offset"] + p["byte_length"]] for p in x["packets"]) == payload
    times = [p["timestamp_ns"] for p in x["packets"]]
    assert all(abs(t - i * 128_000_000) < 1_000_000 for i, t in enumerate(times))
    clusters = sorted({p["cluster_offset"] for p in x["packets"]})
    assert [c["cluster_offset"] for c in x["cues"]] == clusters and all(data[c : c + 4] == b"\x1f\x43\xb6\x75" for c in clusters)


def test_round_trip_of_every_number_of_frames():
    """Whatever lace the last frames fall into, down to a lace of one."""
    for frames in range(1, 80):
        for last in (64, 1024):
            payload = random.Random(frames).randbytes((frames - 1) * 1024 + last)
            data = m.mux(payload)
            assert b"".join(data[p["byte_offset"] : p["byte_offset"] + p["byte_length"]] for p in m.parse(data)["packets"]) == payload, (frames, last)


def test_ebml_lace_with_uneven_sizes():
    frames = [bytes([i]) * n for i, n in enumerate((300, 5, 900, 70, 1))]
    for lacing in (1, 3):
        block = m.size_bytes(3) + b"\x00\x07" + bytes([lacing << 1]) + m._laced(frames, lacing)
        data = m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.TIMESTAMP, 20) + m.element(m.SIMPLE_BLOCK, block)))
        p = m.parse(data)["packets"]
        assert [data[x["byte_offset"] :][: x["byte_length"]] for x in p] == frames
        assert {x["track"] for x in p} == {3} and p[0]["timestamp_ns"] == 27_000_000 and not p[0]["keyframe"]


def test_unknown_sizes_voids_and_block_groups():
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.size_bytes(1) + b"\x00\x00\x00" + b"abc") + m.element(m.BLOCK_DURATION, 5) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    unknown = b"\x01" + b"\xff" * 7
    cluster = b"\x1f\x43\xb6\x75" + unknown + m.element(m.TIMESTAMP, 9) + m.element(0xEC, b"void") + group
    data = m.element(m.EBML, b"") + b"\x18\x53\x80\x67" + unknown + cluster + cluster
    p = m.parse(data)["packets"]
    assert [data[x["byte_offset"] :][:3] for x in p] == [b"abc", b"abc"] and p[0]["cluster_offset"] < p[1]["cluster_offset"]
    assert not p[0]["keyframe"] and p[0]["timestamp_ns"] == 9_000_000


def test_faulty_files():
    data = m.mux(bytes(5000 // 64 * 64))
    for bad in (None, b"", b"RIFF", data[:40], b"\x1a"):
        assert m.parse(bad)["packets"] == [] or bad == data[:40]
    assert len(m.parse(data[: len(data) // 2])["packets"]) <= len(m.parse(data)["packets"])


def test_query(spark):
    import hashlib
    import zlib

    rows = [(1, "abc", "x"), (2, None, "x"), (3, "", None), (4, "é" * 3000, "x"), (4, "é" * 3000, "x"), (None, "z" * 64, "x")]
    out = m.payload_digests(spark.createDataFrame(rows, "doc_id bigint, text string, media string")).collect()
    assert len(out) == 6
    for r in out:
        text = next((t or "") for d, t, _ in rows if d == r.doc_id)
        raw = m.padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert m.payload_digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    media = m.store_texts(spark.createDataFrame(rows, "doc_id bigint, text string, media string"))
    assert m.tracks(media).filter("codec = 'A_PCM/INT/LIT' and bit_depth = 8").count() == 6
    assert m.packets(media).count() == m.packets(media).filter("byte_length > 0").count() == 4 + 2 * 6
    assert m.cues(media).count() == 6


def test_long_null_and_repeated_texts_with_clashing_columns(spark):
    import hashlib
    import zlib

    rows = [(1, "é" * 700_000, "a", 1), (2, None, "a", 1), (3, "", "a", 1), (1, "é" * 700_000, "a", 1), (None, "x", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media string, packets int")
    out = m.payload_digests(df).collect()
    assert len(out) == len(rows) and m.payload_digests(df.limit(0)).count() == 0
    for r in out:
        raw = next((t or "") for d, t, *_ in rows if d == r.doc_id).encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
