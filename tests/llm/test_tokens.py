import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quirework.llm import packing, pieces, token_counts

TEXTS = [
    "", " ", "  a  b ", "\n\n x ", "a▁b ▁", "\x00\x01é😀  \n", "a b <|endoftext|> c<|endoftext|>", "\n", "x" * 5000, "ab cd" * 1000, "a\n b\t c  d" * 500, "\x1c a \x1fb c d　e",
    " " * 3000, "don't  we'll 123abc " * 300, "Zwölf Boxkämpfer\r\njagen  Viktor ", "日本語のテキスト です。", "é ́x", "<s></s> <unk>", "İstanbul ΣΑΣ",
]


def noise(seed, n=3000):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["a", "b ", " ", "\n", "é", "1", "'s", "▁", ". ", "the ", "  ", "\t", "😀"]) for _ in range(n))


ALL = TEXTS + [noise(i) for i in range(4)]


def check_spans(t, normal, ids, spans, sp):
    """Spans follow each other over the whole text, and what a piece writes comes from its span."""
    raw = t.encode()
    if not normal:
        assert len(ids) == len(spans) == 0
        return
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(raw)
    for i, (a, b) in zip(ids.tolist(), spans):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i) or i == sp.unk_id():
            continue
        shown = piece.lstrip("▁")
        if shown and "▁" not in t:
            assert norm_of(sp, raw[a:b].decode("utf-8", "ignore")).replace(" ", "").endswith(shown.replace("▁", ""))


def norm_of(sp, text):
    return sp.normalize(text).replace("▁", " ").strip(" ")


def test_pieces_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    enc, sp = pieces.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert enc.by_unit
    for t in ALL:
        ids, spans = enc.encode(t)
        assert ids.tolist() == sp.encode(t)
        spans = spans.tolist()
        check_spans(t, enc.normalise(t)[0], ids, spans, sp)
        for i, (a, b) in zip(ids.tolist(), spans):
            if sp.is_byte(i):
                assert b - a == 1 and f"<0x{t.encode()[a]:02X}>" == sp.id_to_piece(i)


def spliced_model(tmp_path, rule, drop_extra):
    """The public model with the character map of one of the library's own rules."""
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    charsmap = pieces.normaliser_spec(norm.serialized_model_proto())["charsmap"]

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, data: varint(k << 3 | 2) + varint(len(data)) + data
    spec = field(1, rule.encode()) + field(2, charsmap) + varint(3 << 3) + b"\1" + varint(4 << 3) + bytes([drop_extra]) + varint(5 << 3) + b"\1"
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    kept, at = b"", 0
    while at < len(model):
        start = at
        key, at = pieces._varint(model, at)
        n, at = pieces._varint(model, at)
        assert key & 7 == 2
        at += n
        if key >> 3 != 3:
            kept += model[start:at]
    path = tmp_path / f"{rule}{drop_extra}.model"
    path.write_bytes(kept + field(3, spec))
    return str(path)


@pytest.mark.parametrize("rule,drop_extra", [("nmt_nfkc", 1), ("nmt_nfkc", 0), ("nfkc_cf", 1)])
def test_pieces_of_models_with_a_character_map(tmp_path, rule, drop_extra):
    """The map decides the pieces: what is encoded is normalised here, and the spans lead back over it."""
    path = spliced_model(tmp_path, rule, drop_extra)
    enc, sp = pieces.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert enc.map.trie and enc.spec["drop_extra"] == bool(drop_extra)
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    changed = 0
    for t in [*ALL, "ﬁ Ａ①ｶﾞ", "ＡＢＣ　ｄ", "㌔㍉  ½ﬀ​x", "한글 ㄱㅏ", "  Ｆｕｌｌ   ｗｉｄｔｈ  "]:
        ids, spans = enc.encode(t)
        assert ids.tolist() == sp.encode(t), t
        normal, source = enc.normalise(t)
        assert normal == sp.normalize(t) and len(source) == len(normal.encode()) + 1 and (np.diff(source) >= 0).all()
        edges = {len(t[:i].encode()) for i in range(len(t) + 1)}
        assert {x for i, s in zip(ids.tolist(), spans.tolist()) if not sp.is_byte(i) for x in s} <= edges
        changed += ids.tolist() != plain.encode(t)
    assert changed > 5


def test_character_map_against_the_library():
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = pieces.normaliser_spec(norm.serialized_model_proto())
    assert spec["charsmap"]
    charmap = pieces.CharMap(spec["charsmap"])
    for t in ["ﬁ Ａ①ｶﾞ", "plain", "ＡＢＣ　ｄ", "㌔㍉", "é ½", "½ﬀ​x", "한글 ㄱㅏ"]:
        want = norm.normalize(t)
        got, source = charmap.normalise(t)
        squeeze = lambda s: " ".join(s.replace("▁", " ").split())
        assert squeeze(got.decode()) == squeeze(want)
        assert len(source) == len(got) + 1 and (np.diff(source) >= 0).all() and source[-1] == len(t.encode())
        starts = {len(t[:i].encode()) for i in range(len(t) + 1)}
        assert set(source.tolist()) <= starts


def test_longest_prefix_wins():
    # a hand-made double array: "a" -> X, "ab" -> YZ
    units = np.zeros(1024, np.uint32)
    leaf = 1 << 31
    units[0] = 256 << 10
    units[256 ^ ord("a")] = ord("a") | 1 << 8 | ((512 ^ 256 ^ ord("a")) << 10)
    units[512] = leaf | 0
    units[512 ^ ord("b")] = ord("b") | 1 << 8 | ((768 ^ 512 ^ ord("b")) << 10)
    units[768] = leaf | 2
    m = pieces.CharMap(struct.pack("<I", units.nbytes) + units.tobytes() + b"X\0YZ\0")
    got, source = m.normalise("abaé")
    assert got == "YZXé".encode() and source.tolist() == [0, 0, 2, 3, 3, 5]


@pytest.mark.parametrize("chunk,overlap", [(16_384, 256), (64, 8), (50, 1)])
def test_counts_equal_the_library(chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, lib = token_counts.Counter(path, chunk, overlap), Tokenizer.from_file(path)
    assert counter.proven
    for t in ALL:
        e = lib.encode(t, add_special_tokens=False)
        assert counter.many([t])[0] == [len(e.ids)]
        assert counter.spliced(t)[0] == [a for a, _ in e.offsets]


def test_splices_and_widenings_decide_the_count():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, lib = token_counts.Counter(path, 64, 8), Tokenizer.from_file(path)
    prose, solid = "some words of prose " * 200, "antidisestablishmentarianism" * 200
    _, splices, widenings = counter.spliced(prose)
    assert splices > 50 and widenings < splices
    _, splices, widenings = counter.spliced(solid)
    assert splices == 0 and 5 < widenings < 64  # overlaps and chunks are doubled each time
    mixed = prose + solid + " " + prose
    starts, splices, widenings = counter.spliced(mixed)
    assert splices > 62 and widenings > 5 and len(starts) == len(lib.encode(mixed, add_special_tokens=False).ids)
    # without the splice the chunks' own counts do not add up
    cut = [mixed[i : i + 64] for i in range(0, len(mixed), 64)]
    assert sum(len(lib.encode(c, add_special_tokens=False).ids) for c in cut) != len(starts)


def test_no_proof_no_chunks():
    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"), 64, 8)
    text = "Some Words " * 40
    assert not counter.proven and counter.spliced(text)[1:] == (0, 0)
    assert counter.spliced(text)[0] == [a for a, _ in counter.tokenizer.encode(text, add_special_tokens=False).offsets]


def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib = packing.WordEncoder(path), Tokenizer.from_file(path)
    for t in ALL:
        assert np.frombuffer(enc(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_parts_are_encoded_once_whatever_their_forms(monkeypatch):
    """Case and marks make many words of a part; they do not fill the memory, so that it is not emptied and learned anew."""
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib, asked = packing.WordEncoder(path), Tokenizer.from_file(path), []
    encode_parts = enc._encode_parts
    monkeypatch.setattr(packing, "WORDS", 1000)
    monkeypatch.setattr(enc, "_encode_parts", lambda parts: asked.extend(parts) or encode_parts(parts))
    rnd = random.Random(8)
    stems = sorted({"".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(300)})
    forms = "{}", "{},", "{}.", "{}...", "({})", "{}!?", '"{}"', "-{}-"
    for text in [" ".join(form.format(case(s)) for s in stems) for _ in range(2) for case in (str.lower, str.title, str.upper) for form in forms]:
        assert np.frombuffer(enc(text), enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) < 320


@pytest.mark.parametrize("memory", [0, packing.WORDS])
def test_words_of_any_characters_equal_the_library(monkeypatch, memory):
    """Every character that is lower-cased and split here, and some that are not; with the memory emptied before each call, too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib, rnd = packing.WordEncoder(path), Tokenizer.from_file(path), random.Random(9)
    monkeypatch.setattr(packing, "WORDS", memory)
    some = [chr(c) for c in range(0x260) if c not in (0x85, 0xA0) and not 0x1C <= c <= 0x1F] + ["'s", "'LL", "'", ".", ",", " ", "\n", "<|endoftext|>", "<|", "Ⱥ", "日", "😀", "é", "²", "１"] * 9
    texts = [rnd.choice(["", "Word", "x1", " "]).join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(900)] + [" ".join(some)]
    for i in range(0, len(texts), 300):
        got = enc.many(texts[i : i + 300])
        assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts[i : i + 300]]


ROWS = [(i, t, "x", 1) for i, t in enumerate(ALL)] + [(900, None, "x", 1), (901, "a b", "x", 1), (901, "a b", "x", 1), (None, "null id", "x", 1)]
SCHEMA = "doc_id bigint, text string, shard string, n_tokens bigint"


def test_piece_queries(spark):
    import hashlib

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = pieces.digests(df, path).collect()
    want = []
    for d, t, *_ in ROWS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(([r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256] for r in out), key=repr) == sorted(map(list, want), key=repr)
    enc = pieces.Encoder(path)
    texts = {d: t or "" for d, t, *_ in ROWS}
    for r in out:
        assert r.spans_sha256 == hashlib.sha256(enc.encode(texts[r.doc_id])[1].astype("<i8").tobytes()).hexdigest() and r.n_covered_bytes == len(texts[r.doc_id].encode())
    encoded = pieces.encode(df, path)
    assert {(r.doc_id, len(r.ids), len(r.spans)) for r in encoded.collect()} == {(d, n, n) for d, t in texts.items() for n in [len(sp.encode(t))]}
    back = pieces.decode(encoded, path)
    assert {(r.doc_id, r.decoded) for r in back.collect()} == {(d, sp.decode(sp.encode(t))) for d, t in texts.items()}
    assert pieces.digests(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_count_query(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [*ROWS, (950, "long text of words " * 60_000, "x", 1), (951, "x" * 1_000_000, "x", 1)]
    out = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), path).collect()
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in out}
    assert by[950].n_splices > 60 and by[951].n_widenings > 3
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), path).count() == 0


@pytest.mark.parametrize("shard,window", [(2000, 2048), (6, 64)])
def test_packing(spark, shard, window):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(spark.createDataFrame(ROWS, SCHEMA), path, window=window, shard=shard, with_ids=True).collect()
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in ROWS}
    pieces_of, windows = {}, {}
    for r in rows:
        pieces_of.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    copies = {901: 2}
    for d, x in ids.items():
        assert sum(n for _, n in pieces_of[d]) == len(x) * copies.get(d, 1)
        covered = [i for a, n in pieces_of[d] for i in range(a, a + n)]
        assert sorted(set(covered)) == list(range(len(x)))
    padded = 0
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= window
        padded += at < window
    assert padded <= len({r.sequence_id >> 32 for r in rows}) <= 2 * -(-len(ROWS) // shard)


def test_packing_puts_like_documents_together():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1000 * k, 1000 * k + 60, 100) for k in range(10)]
    rests = [rng.permutation(topics[i % 10]).astype(np.uint16) for i in range(100)]
    windows = packing.fill(rests, 200)
    same = [len({d % 10 for d, _, _ in w}) == 1 for w in windows]
    assert sum(same) > 0.9 * len(same)


def test_every_shared_term_of_a_seed_is_looked_up():
    """Forty telling terms of the seed lead nowhere else; the one that another rest shares is found all the same."""
    seed = np.concatenate([np.repeat(np.arange(100, 140), 3), [7]])
    rests = [seed, np.repeat(np.arange(100, 140), 2), np.array([7, 8, 9]), np.arange(500, 520), np.repeat(np.arange(100, 140), 2)]
    index = packing.Bm25(rests)
    assert index.neighbours(0, np.array([False, True, True, True, True])).tolist() == [1, 4, 2]
    assert index.neighbours(0, np.array([False, False, True, True, False])).tolist() == [2]  # after used ones have gone from the postings


def topic_rows(n=2400, topics=12, seed=4):
    rnd = random.Random(seed)
    vocabulary = [w for w in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha() and len(w) > 8]
    vocabulary.sort()
    rnd.shuffle(vocabulary)
    of = [vocabulary[i * 40 : i * 40 + 40] for i in range(topics)]
    common = vocabulary[2000:2100]
    rows = []
    for i in range(n):
        w = [rnd.choice(of[i % topics] if rnd.random() < 0.4 else common)[:-4] for _ in range(60)]
        rows.append((i, " ".join(w)))
    return rows


def test_neighbours_share_windows_over_several_shards(spark, monkeypatch):
    topics = 40
    df = spark.createDataFrame(topic_rows(topics=topics), "doc_id bigint, text string").repartition(5)

    def purity(shard=100):
        """Mean share of a window's pieces that are of its commonest topic."""
        rows = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), shard=shard, window=1024).collect()
        assert len({r.sequence_id >> 32 for r in rows}) >= 2000 // shard
        windows = {}
        for r in rows:
            windows.setdefault(r.sequence_id, []).append(r.doc_id % topics)
        return np.mean([max(w.count(x) for x in set(w)) / len(w) for w in windows.values()])

    by_term = purity()
    by_chain = purity(20)  # every term of a topic has more rests than a shard takes, as with a hundred times as many documents
    make = packing.Deal.__init__
    monkeypatch.setattr(packing.Deal, "__init__", lambda self, frequency, shard: make(self, frequency * 0, shard))  # dealt by row
    by_row = purity()
    assert by_term > 0.6 and by_chain > 0.6 and by_row < 0.3


def test_near_copies_are_dealt_to_one_shard():
    """Keys of rests that differ in a tenth of their terms, where shards hold a hundredth of what they hold now."""
    rng = np.random.default_rng(6)
    rank = lambda n: np.minimum((rng.pareto(0.8, n) * 20).astype(np.int64), 8999)
    rests = [np.unique(rank(120)) for _ in range(4000)]
    copies = [np.unique(np.where(rng.random(len(r)) < 0.1, rank(len(r)), r)) for r in rests[:400]]
    every = [*rests, *copies]
    deal = packing.Deal(np.bincount(np.concatenate(every), minlength=9000), 20)
    keys = deal.keys([r.astype("<u2").tobytes() for r in every], "<u2")
    order = sorted(range(len(every)), key=lambda i: (keys[i], i))
    shard, number = {}, 0
    while order:
        cut = packing.next_shard([keys[i] for i in order[:21]], 20)
        shard |= dict.fromkeys(order[:cut], number)
        order, number = order[cut:], number + 1
    together = np.mean([shard[i] == shard[4000 + i] for i in range(400)])
    assert together > 0.75  # by chance: one in two hundred


def test_repeated_rows_are_dealt_apart(spark):
    same = " ".join(["alpha beta gamma delta"] * 5)
    df = spark.createDataFrame([(None, same)] * 700 + [(1, same)] * 700 + [(i, None) for i in range(2, 400)], "doc_id bigint, text string").repartition(7)
    rows = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), shard=100).collect()
    per = {}
    for r in rows:
        per[r.sequence_id >> 32] = per.get(r.sequence_id >> 32, 0) + 1
    assert max(per.values()) < 250 and sum(r.start == 0 for r in rows) == 1798


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0
