"""Each operator against brute force over tables with odd rows, and over empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import bpe, gif, media, token_shards
from foliospark.llm.components import components
from foliospark.llm.decontaminate import best_match, leaks
from foliospark.llm.licenses import TEMPLATES, license_scan, winnow
from foliospark.llm.ngram_join import jaccard_components
from foliospark.llm.packing import cut_lengths, pack
from foliospark.llm.quality_rules import fit, quality_scores, train, with_statistics
from foliospark.llm.run_index import build, repeated_starts
from foliospark.llm.suffix_dedup import dedup_report, dedup_texts, removed_spans
from foliospark.llm.token_counts import token_counts
from foliospark.llm.token_shards import shard_index

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, start int, n_tokens long, length int, cls long, gram long, item_id long, quality string, label_id long, wanted long, carried long, spans long, media binary, shard int, block int, row_key long, family long, part long, class long, salt long"
WORDS = [bytes(random.Random(i).choices(b"abcdefghij", k=2 + i % 7)).decode() for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def odd_texts():
    rng = random.Random(5)
    base, passage, item = prose(rng, 120), prose(rng, 70), prose(rng, 40)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", "  \t\n ", "one two", "One  TWO", "one two three four", base, base, " ".join(near), base + " " + prose(rng, 8),
        prose(rng, 60) + " " + passage + " " + prose(rng, 50), passage + "\n" + prose(rng, 90), prose(rng, 30) + ". " + passage,
        "a" * 3000, "ab" * 1200 + "c", "é" * 250 + " naïve ẞtraße ÅΣ😀 " + "é" * 250, "<|endoftext|> x <|startoftext|>", "\x1c\x1d odd\x85space", "it's 12345 don't!!",
        prose(rng, 20) + " " + item + " " + prose(rng, 15), prose(rng, 9_000), "x", "x",
    ]
    return texts, item


@pytest.fixture(scope="module")
def docs(spark):
    texts, _ = odd_texts()
    rows = [(i, t, None if i % 4 == 0 else "en", f"src{i % 2}", len(t or ""), 1, 2, 3, 4, 5, 6, 7, 8, "q", 1, 2, 3, 4, b"GIF", *range(7)) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a row twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_id(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def library(name):
    return Tokenizer.from_file(bpe.tokenizer_path(name))


def test_token_counts(docs, empty):
    t = library("word_bpe_49k.json")
    got = sorted(map(tuple, token_counts(docs, "word_bpe_49k.json").collect()))
    want = []
    for i, x in texts_by_id(docs):
        n = len(t.encode(x, add_special_tokens=False).ids)
        want.append((i, len(x.encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts(empty, "word_bpe_49k.json").collect() == []


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_random_strings_as_the_library(name, spaced):
    rng, t = random.Random(1), library(name)
    pool = [chr(i) for i in range(0x250)] + list("ΣςİŒ́̈<|>'  　漢字😀٣²½Ⅷ") + ["<|endoftext|>", "<|startoftext|>", "'ll", "  ", " the"]
    encoder, counts = bpe.IdEncoder(bpe.tokenizer_path(name), spaced), bpe.HeapBpe(bpe.tokenizer_path("word_bpe_49k.json"))
    for _ in range(1500):
        s = "".join(rng.choices(pool, k=rng.randint(0, 40)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(s), "<u4").tolist() == ids
        if not spaced:
            assert sum(map(counts.count_chunk, bpe.chunks_of(s))) == len(ids)


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_groups_of_texts_as_the_library(name, spaced, monkeypatch):
    """Groups, pieces of long texts and emptied tables, each smaller than in production."""
    monkeypatch.setattr(bpe, "SLOTS", 256)
    monkeypatch.setattr(bpe, "LOOKUP_BYTES", 300)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    rng, t = random.Random(4), library(name)
    parts = [*WORDS, "  ", "\n\n", "\t ", "<|endoftext|>", "\x85", "\u3000", "\0", "x\0y", "é", "Σ", "it's", "", "12,5"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.choice([0, 1, 5, 40, 600]))) for _ in range(120)] + ["", " ", "z" * 2000]
    encoder, counter = bpe.IdEncoder(bpe.tokenizer_path(name), spaced), bpe.token_counter(bpe.tokenizer_path("word_bpe_49k.json"))
    counter.clear()
    for _ in range(2):
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in encoder.ids(texts)] == want
        if not spaced:
            assert [int(x.sum()) for x in counter.of(texts)] == list(map(len, want))
    bpe.KEPT.clear()


def test_media(docs, empty):
    stored = media.store(docs)
    got = {r.doc_id: r for r in media.features(stored).collect()}
    for i, x in texts_by_id(docs):
        raw = x.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = [r for r in media.features(stored).collect() if r.doc_id in (6, 7)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1 and len(same) == 3
    frames = media.frames(stored.where("doc_id = 20")).orderBy("frame").collect()
    assert [f.start_ms for f in frames] == [100 * k for k in range(len(frames))] and all(sum(f.red) == f.width * f.height for f in frames)
    assert media.features(media.store(empty)).collect() == []
    none = media.features(stored.where("doc_id = 20").withColumn("media", F.lit(None).cast("binary"))).collect()
    assert [(r.doc_id, r.media_bytes, r.feature) for r in none] == [(20, None, None)]
    # the histogram is that of the colours shown, but for what follows the payload in the last frame
    r = next(iter(media.features(stored.where("doc_id = 20")).collect()))
    for name, channel in zip(r.feature.split(";")[2:], ("red", "green", "blue"), strict=True):
        counts = np.array(list(map(int, name[2:].split(","))))
        shown = np.sum([f[channel] for f in frames], 0)
        assert counts.sum() == r.payload_bytes and (counts <= shown).all() and shown.sum() - counts.sum() < frames[-1].width * frames[-1].height


def test_lzw_round_trips():
    rng = random.Random(2)
    for _ in range(60):
        n, k = rng.choice([1, 5, 576, 3000, 20000]), rng.choice([1, 2, 10, 256])
        p = bytes(rng.randrange(k) for _ in range(n))
        assert gif.lzw_decode(gif.pack_codes([gif.lzw_codes(p)])[0], 8, n) == p
    with pytest.raises(ValueError):
        gif.decode(b"JFIF..")


def test_gif_disposal_transparency_and_interlace():
    """A hand-made file: 2-bit codes, local palette, offsets, all three ways to dispose of a frame."""

    def stream(pixels):  # a clear code before each pixel keeps codes at three bits
        bits = "".join(f"{c:03b}"[::-1] for p in pixels for c in (4, p)) + "101"
        bits += "0" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        return b"\x02" + bytes([len(data)]) + data + b"\0"

    def frame(disposal, clear, box, pixels, interlaced=False, palette=b""):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 7, 0, clear or 0]) + b"\0"
        head = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in box) + bytes([(0x40 if interlaced else 0) | (0x81 if palette else 0)])
        return control + head + palette + stream(pixels)

    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    size = b"\x02\0\x04\0"
    data = b"GIF89a" + size + b"\x81\0\0" + colours
    data += frame(1, None, (0, 0, 2, 4), [1, 1, 2, 2, 3, 3, 0, 0], interlaced=True)
    data += frame(2, 0, (0, 0, 2, 1), [0, 3]) + frame(3, None, (0, 3, 2, 1), [2, 2]) + frame(0, None, (1, 1, 1, 1), [1], palette=bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])) + b"\x3b"
    image = gif.decode(data)
    shown = image.shown()
    assert [f.delay for f in image.frames] == [7] * 4 and not image.simple()
    assert shown[0, :, 0, :3].tolist() == [[255, 0, 0], [0, 0, 255], [0, 255, 0], [0, 0, 0]]  # lines 0, 2, 1, 3
    assert shown[1, 0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255]]  # the first pixel is transparent
    assert shown[2, 0].tolist() == [[0, 0, 0, 0]] * 2 and shown[2, 3, 0].tolist() == [0, 255, 0, 255]  # cleared; drawn
    assert shown[3, 3, 0].tolist() == [0, 0, 0, 255] and shown[3, 1, 1].tolist() == [8, 8, 8, 255]  # brought back; local palette


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, percent=75):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def test_jaccard_components(spark, docs, empty):
    rows = texts_by_id(docs)
    assert sorted(map(tuple, jaccard_components(spark, docs).collect())) == brute_components(rows)
    assert jaccard_components(spark, empty).collect() == []


def test_jaccard_chains_and_large_groups(spark):
    rng = random.Random(9)
    base = [prose(rng, 60).split(" ") for _ in range(4)]
    rows = []
    for g, words in enumerate(base):
        for k in range(25):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(30)}"
            rows.append((1000 - len(rows), " ".join(w)))
        for k in range(12):  # a chain: each is linked with the next only
            rows.append((1000 - len(rows), " ".join(words[k * 2 :] + [f"tail{g}{j}" for j in range(k * 2)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard_components(spark, df).collect())) == brute_components(rows)


@pytest.mark.parametrize("part_rows,tile,row_bytes", [(4096, 512, 6 << 20), (7, 3, 2000)])
def test_jaccard_families_in_parts(spark, monkeypatch, part_rows, tile, row_bytes):
    """One family whose clusters are apart from each other, with copies in several row blocks."""
    from foliospark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "PART_ROWS", part_rows)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "ROW_BLOCK_BYTES", row_bytes)
    monkeypatch.setattr(ngram_join, "COLUMN_BLOCK_BYTES", 4000)
    rng = random.Random(10)
    common = prose(rng, 14)
    rows = []
    for _ in range(9):
        own = prose(rng, 50).split(" ")
        for _ in range(rng.choice([1, 2, 3, 14])):
            w = list(own)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(90)}"
            rows += [(len(rows), common + " " + " ".join(w))] * rng.choice([1, 1, 1, 3])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard_components(spark, df).collect())) == brute_components(rows)


def test_maybe_in(spark, monkeypatch):
    from foliospark.llm import common

    rows = spark.range(-500, 500).selectExpr("id * 7919 AS key", "id AS x")
    keys = spark.createDataFrame([(7919 * i,) for i in range(-90, 90, 3)] + [(None,)], "k long")
    for bits in (1 << 26, 64):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = {r.x for r in common.maybe_in(rows, "key", keys).collect()}
        assert got >= set(range(-90, 90, 3)) and (bits == 64 or len(got) == 60)
    assert common.maybe_in(rows, "key", keys.where("false")).collect() == []


@pytest.mark.parametrize("part_links", [1 << 20, 4])
def test_components_of_a_path(spark, monkeypatch, part_links):
    from foliospark.llm import components as module

    monkeypatch.setattr(module, "PART_LINKS", part_links)
    assert components(spark, spark.createDataFrame([], "a long, b long")).collect() == []
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 50), (60, 60)], "a long, b long")
    got = {r.node: r.component for r in components(spark, links).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40}


def brute_removed(rows, length):
    raws = [t.encode() for _, t in rows]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,many", [(200, 2000), (40, 2000), (40, 1)])
def test_long_repeats(spark, docs, monkeypatch, length, many):
    from foliospark.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "INDEXED_STRETCHES", many)  # with 1, windows are compared one by one
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 5000)
    got = dedup_report(removed_spans(spark, docs, length=length)).collect()
    assert sorted(map(tuple, got)) == brute_removed(texts_by_id(docs), length)


def test_long_repeats_of_nothing(spark, docs, empty):
    assert dedup_report(removed_spans(spark, empty)).collect() == []
    kept = dedup_texts(removed_spans(spark, docs, carry=("lang", "source")))
    assert kept.columns == ["doc_id", "text", "lang", "source"] and kept.count() == docs.count()


def test_long_repeats_in_pieces(monkeypatch):
    from foliospark.llm import suffix_dedup

    rng = random.Random(4)
    text = bytes(rng.choices(b"ab", k=5000))
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 700)
    starts = []
    for group in suffix_dedup.pieces_of([text, b"short", text[:300]], 50):
        own, first, last, _, _ = suffix_dedup.stretches([p for *_, p in group], 50, 25)
        starts += [(group[o][0], group[o][1] + k) for o, a, b in zip(own, first, last, strict=True) for k in range(a, b + 1)]
    assert sorted(starts) == [(0, k) for k in range(4951)] + [(2, k) for k in range(251)]


def test_run_index():
    rng = random.Random(3)
    for _ in range(150):
        k, length = rng.choice([1, 2, 3]), rng.choice([1, 2, 5, 8, 20])
        base = bytes(rng.randrange(k) for _ in range(60))
        strings = []
        for _ in range(rng.choice([1, 2, 5, 12])):
            i = rng.randrange(40)
            strings.append(base[i : i + rng.randrange(1, 60)] if rng.random() < 0.5 else bytes(rng.randrange(k) for _ in range(rng.randrange(50))))
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
        assert [g.tolist() for g in repeated_starts(strings, length)] == want
    index = build([b"abracadabra" * 20])
    assert len(index.symbols) < 40 < index.size  # runs, not positions


def test_token_shards(spark, docs, empty):
    t = library("word_bpe_49k.json")
    got = shard_index(spark, docs, "word_bpe_49k.json", end_id=1).orderBy("start").collect()
    at = 0
    rows = sorted(texts_by_id(docs))
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    for r, (_, x) in zip(got, rows, strict=True):
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert shard_index(spark, empty, "word_bpe_49k.json", end_id=1).collect() == []


@pytest.mark.parametrize("block_ids", [1 << 20, 300])
def test_random_access_to_shards(spark, docs, tmp_path, monkeypatch, block_ids):
    monkeypatch.setattr(token_shards, "BLOCK_IDS", block_ids)
    path, t = str(tmp_path / "shards"), library("word_bpe_49k.json")
    token_shards.write_shards(spark, docs, path, "word_bpe_49k.json", 1)
    got = token_shards.read_documents(spark, path, spark.createDataFrame([(20,), (0,), (6,), (77,)], "doc_id long")).collect()
    texts = dict(texts_by_id(docs))
    assert sorted(r.doc_id for r in got) == [0, 6, 6, 20]
    assert all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids + [1] for r in got)


def test_re_pair():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile(rng.integers(2, 50, 30), 200), rng.integers(2, 70_000, 5000), [5] * 999, [1]]).astype("<u4")
    g = token_shards.compress(ids, 1)
    assert len(g.symbols) < len(ids) // 2 and (g.expand(0, len(g.symbols)) == ids).all() and int(g.symbol_lengths().sum()) == len(ids)
    for a, b in ((0, 1), (17, 900), (5990, 6050), (len(ids) - 3, len(ids))):
        assert (g.decode(a, b) == ids[a:b]).all()


def test_packing(spark, docs, empty):
    t = library("byte_bpe_50k.json")
    ids = {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in texts_by_id(docs)}
    got = pack(spark, docs, "byte_bpe_50k.json", end_id=0).collect()
    used = defaultdict(list)
    covered = defaultdict(Counter)
    for r in got:
        x = ids[r.doc_id]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()), len(x))
        covered[r.doc_id].update(range(r.start, r.start + r.length))
        used[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert set(covered[i]) == set(range(len(x))) and set(covered[i].values()) == {2 if i == 6 else 1}
    for spans in used.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 1024
    assert pack(spark, empty, "byte_bpe_50k.json", end_id=0).collect() == []


def test_packing_levels(spark, monkeypatch):
    from foliospark.llm import packing

    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = random.Random(1)
    rows = [(i, s, n, i, 9) for i in range(700) for s, n in enumerate(cut_lengths(rng.randrange(1, 2500), 1024, 64))]
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.pack_pieces(spark, cut, 1024).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in got) == sorted(r[:3] for r in rows)
    sizes = Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes.values())
    assert max(sizes.values()) <= 1024 and padding < 0.01 * sum(sizes.values())


def test_leaks(spark, docs, empty):
    _, item = odd_texts()
    words = item.split(" ")
    near = list(words)
    near[3], near[20:22] = "other", []
    far = [w if k % 3 else "zz" for k, w in enumerate(words)]
    more = spark.createDataFrame([(100, "Lead in. " + ", ".join(near).upper() + " tail"), (101, " ".join(far)), (102, " ".join(words[:12])), (103, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "..."), (10, "one two three four")], "item_id long, text string")
    got = leaks(spark, docs.select("doc_id", "text").unionByName(more), items).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert set(found) == {(19, 7), (100, 7), (5, 10)}
    assert found[19, 7].distance == 0 and found[100, 7].distance == 3 and found[100, 7].item_words == 40
    text = [r.text for r in docs.where("doc_id = 19").collect()][0]
    assert text.encode()[found[19, 7].start : found[19, 7].stop].decode() == item
    assert leaks(spark, empty, items).collect() == [] and leaks(spark, docs, items.where("false")).collect() == []


def test_leak_recall(spark):
    """Random edits within the limit: at least the target recall is found, unrelated texts never."""
    rng = random.Random(8)
    items = [prose(rng, rng.randrange(20, 60)) for _ in range(12)]
    rows = []
    for i in range(240):
        w = items[i % 12].split(" ")
        for _ in range(len(w) // 5):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        rows.append((i, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30)))
    rows += [(1000 + i, prose(rng, 120)) for i in range(100)]
    got = leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    hit = {r.doc_id for r in got if r.item_id == r.doc_id % 12}
    assert len([i for i in hit if i < 240]) >= 0.98 * 240 and not [i for i in hit if i >= 1000]


def least_edits(item, words):
    """Least edits from the item to any run of the words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(words, 1):
            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_as_all_pairs_by_brute_force(spark):
    """Items of several sizes, some alike, edited up to and beyond the limit: nothing false, and the target recall."""
    rng = random.Random(15)
    items = [prose(rng, n) for n in (3, 8, 8, 12, 20, 20, 33)]
    items += [" ".join([*items[4].split(" ")[:17], "x", "y", "z"])]
    rows = []
    for i in range(160):
        w = items[i % 8].split(" ")
        for _ in range(rng.randrange(0, len(w) // 3 + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
            w = w or ["left"]
        rows.append((i, " ".join([prose(rng, rng.randrange(1, 20)), *w, prose(rng, rng.randrange(1, 20))])))
    got = leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = {(i, j): e for i, t in rows for j, x in enumerate(items) for e in [least_edits(x.split(" "), t.split(" "))] if e <= len(x.split(" ")) * 0.25}
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert set(found) <= set(want) and len(found) >= 0.98 * len(want) and all(want[k] <= d for k, d in found.items())
    assert sum(want[k] == d for k, d in found.items()) >= 0.98 * len(found)


def test_best_match():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert best_match(a, np.array([9, 1, 2, 3, 4, 9], np.uint64)) == (0, 5)
    assert best_match(a, np.array([1, 3, 4], np.uint64))[0] == 1 and best_match(a, np.array([], np.uint64))[0] == 4


def test_license_scan(spark, docs, empty):
    rng = random.Random(6)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    rows = [(1, prose(rng, 50) + "\nReleased under the MIT License.\n" + prose(rng, 20)), (2, "/* " + mit.replace(" ", "\n * ", 9) + " */"), (3, "the license of the mit"), (4, None), (5, "licensed under the   APACHE license, version 2.0"), (6, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.license): r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (5, "Apache-2.0"), (6, "CC-BY-NC-4.0")}  # the second holds 59 % of the notice
    full = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    whole = license_scan(spark.createDataFrame([(1, prose(rng, 9) + " /* " + full.replace(" ", "\n * ") + " */ " + prose(rng, 9))], "doc_id long, text string")).collect()
    assert [(r.license, r.coverage) for r in whole] == [("MIT", 1.0)]
    r = got[1, "MIT"]
    assert r.coverage == 1 and rows[0][1].lower()[r.start : r.stop] == "released under the mit license"
    assert license_scan(docs).collect() == [] and license_scan(empty).collect() == []
    assert winnow(np.array([5, 1, 7, 1, 9], np.uint64), 3) == [1, 3] and winnow(np.array([], np.uint64), 3) == []


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split(" "))) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = train(table, labels, sample_rows=400)
    assert 0 < len(model.rules) < 120
    got = quality_scores(table, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got if r.held_out]) > 0.98
    odd = quality_scores(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    stats = with_statistics(table).toPandas().sort_values("doc_id")
    by_column = sorted((r.doc_id, r.score) for r in got)
    assert np.allclose([s for _, s in by_column], model.scores(stats[list(stats.columns[1:])].to_numpy()))
    assert quality_scores(empty, train(empty, labels.where("false"))).collect() == []
    assert train(docs, labels.where("quality IS NOT NULL")).rules is not None  # docs have a column quality of their own
    assert fit(np.zeros((3, 24)), np.ones(3)).rules == []
