"""Fingerprints, lines, passages, packing and benchmark windows against plain rules."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
import corpus

from edurank.llm import contamination, linededup, packing, passages, simhash
from edurank.llm.components import components


def fingerprint(text, shingle=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", corpus.lowered(text))
    grams = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(marks, bits):
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {m: find(m) for m in marks}


@pytest.mark.parametrize("shard", [16_384, 4])
def test_near_duplicates(spark, shard):
    docs, rows = corpus.documents(spark), corpus.rows()
    marks = [fingerprint(r[1]) for r in rows]
    root = roots(set(marks), 2)
    ids = {}
    for row, mark in zip(rows, marks, strict=True):
        ids.setdefault(root[mark], []).append(row[0])
    expected = [
        (r[0], f"{m:016x}", min((i for i in ids[root[m]] if i is not None), default=None), len(ids[root[m]]))
        for r, m in zip(rows, marks, strict=True)
    ]
    corpus.same(map(tuple, simhash.near_duplicates(docs, shard=shard).collect()), expected)


def test_near_pairs_of_dense_balls():
    rng = random.Random(4)
    points = set()
    for center in (0, rng.getrandbits(64)):
        for _ in range(900):
            x = center
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    values = np.array(sorted(points), np.uint64)
    old, simhash.LEAF = simhash.LEAF, 64
    try:
        found = {(int(a), int(b)) for x, y in simhash.near_pairs(values, values, 2) for a, b in zip(x, y, strict=True)}
    finally:
        simhash.LEAF = old
    ordered = sorted(points)
    assert found == {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 2}


def test_keep_one_and_empty_table(spark):
    docs = corpus.documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    firsts = {r.component_id for r in simhash.near_duplicates(docs).collect()} - {None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(firsts)
    assert got.count(None) == 1
    assert simhash.near_duplicates(corpus.empty(spark)).count() == 0
    assert simhash.keep_one(corpus.empty(spark)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(40)}}


def removed(rows, similarity=80):
    lines = []
    for doc_id, text, *_ in rows:
        if doc_id is not None and text is not None:
            for n, line in enumerate(text.split("\n")):
                lines.append(((doc_id, n), set(re.findall(rb"[^\x20\x09-\x0D]+", corpus.lowered(line)))))
    gone = set()
    for at, own in lines:
        if own and any(
            b < at and other and 100 * len(own & other) >= similarity * len(own | other) for b, other in lines
        ):
            gone.add(at)
    return gone


@pytest.mark.parametrize("similarity", [80, 50])
def test_line_dedup(spark, similarity):
    rows = corpus.rows()
    gone = removed(rows, similarity)
    done = linededup.dedup_lines(corpus.documents(spark), similarity=similarity)
    expected = []
    for doc_id, text, *_ in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for n, x in enumerate(lines) if doc_id is None or (doc_id, n) not in gone]
        expected.append((doc_id, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    corpus.same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in done.collect()], expected)
    assert done.columns == [*corpus.documents(spark).columns, "n_lines", "n_removed"]
    assert gone


def test_line_dedup_of_an_empty_table(spark):
    assert linededup.dedup_lines(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("window, phrase, block", [(35, 8, 1 << 23), (35, 8, 2_000), (5, 5, 700), (6, 2, 10_000)])
def test_repeated_passages(spark, window, phrase, block):
    rows = corpus.rows()
    docs = [corpus.words(r[1]) for r in rows]
    starts = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    expected = []
    for row, w in zip(rows, docs, strict=True):
        cover = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                cover.update(range(i, i + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in cover)
        expected.append((row[0], len(w), len(cover), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = passages.remove_repeats(corpus.documents(spark), window=window, phrase=phrase, block_bytes=block, with_text=True)
    corpus.same(map(tuple, got.collect()), expected)


def test_repeated_passages_of_an_empty_table(spark):
    assert passages.remove_repeats(corpus.empty(spark)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


@pytest.mark.parametrize("longest", [2048, 64])
def test_packing_is_a_round_trip(spark, tokenizer, longest):
    rows = corpus.rows()
    pieces = packing.pack(corpus.documents(spark), longest=longest, with_ids=True).collect()
    found = {}
    for p in pieces:
        assert p.length == len(p.ids) and p.length & (p.length - 1) == 0 and p.length <= longest and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        found.setdefault(p.doc_id, []).append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    expected = Counter()
    for r in rows:
        expected[r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])] += 1
    got = Counter()
    for doc_id, own in found.items():
        own.sort(key=lambda p: (p.sequence_id & ((1 << 33) - 1), p.start))
        copies = sum(p.start == 0 for p in own)
        for n in range(copies):
            ids = [x for start in sorted({p.start for p in own}) for x in [p for p in own if p.start == start][n].ids]
            got[doc_id, tuple(ids)] += 1
    assert got == expected
    assert packing.pack(corpus.empty(spark)).count() == 0


def test_token_ids_of_odd_texts(tokenizer):
    rng = random.Random(2)
    parts = "a|Be|é| |  |\n|\n\n|\t| \n|\n |'s|'|''|12|!|...|<|endoftext|>|日本| | |\x1c|word|don't|\r\n|_|\x85".split("|") + ["<|endoftext|>"]
    encode = packing.Encoder(packing.default_vocabulary())
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_contamination(spark):
    rows = corpus.rows()
    passage = rows[26][1]
    items = [
        (1, " ".join(passage.split()[:14])),
        (12, " ".join(passage.split()[20:50])),
        (2, "one  Two"),
        (3, None),
        (4, " ... "),
        (None, "the END"),
        (5, "never said"),
        (5, " ".join(passage.split()[30:41])),
        (2, "one  Two"),
    ]
    windows = {}
    for item, text in items:
        w = ITEM_WORD.findall(corpus.lowered(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    expected = []
    for row in rows:
        w = ITEM_WORD.findall(corpus.lowered(row[1]))
        hit, met = set(), set()
        for i in range(len(w)):
            for size in range(1, 11):
                if i + size <= len(w) and tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    met |= windows[tuple(w[i : i + size])]
        names = sorted(str(x) for x in met if x is not None)
        expected.append((row[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = corpus.documents(spark)
    got = list(map(tuple, contamination.contamination(docs, table).collect()))
    corpus.same(got, expected)
    assert sum(r[5] for r in got) > 5
    clean = {r[0] for r in got} - {r[0] for r in got if r[5]}
    assert {r.doc_id for r in contamination.drop_contaminated(docs, table).collect()} == clean
    assert not any(r.contaminated for r in contamination.contamination(docs, table.limit(0)).collect())
    assert contamination.contamination(corpus.empty(spark), table).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta x x x x alpha"), (3, "alpha"), (4, "beta alpha beta")], "doc_id bigint, text string")
    spelled = contamination.item_words(spark.createDataFrame([(9, "Alpha beta")], "item_id bigint, text string"))
    index = contamination.build_index(docs, spelled)
    terms = spelled.join(index.terms, "word")
    found = contamination.proximity_matches(index, terms, 3).join(index.rows, "row")
    lead = {1: {0, 3}, 4: {0, 1, 2}}
    got = {(r.doc_id, r.pos) for r in found.collect()}
    assert {d for d, _ in got} == {1, 4} and all(p in lead[d] for d, p in got)


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_collide_are_told_apart(spark):
    from edurank.llm.hashing import RangeHasher, word_hashes

    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    data = np.frombuffer((one + two).encode(), np.uint8)
    starts, ends = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(RangeHasher(3)(data, starts, ends).tolist())) == 1
    assert all(len(set(word_hashes(data, starts, ends, i).tolist())) == 2 for i in range(5))
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")
    assert [r.n_removed for r in linededup.dedup_lines(docs).collect()] == [0, 0]
    shared = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}")], "doc_id bigint, text string")
    assert [r.n_removed for r in passages.remove_repeats(docs).collect()] == [0, 0]


def test_hashes_of_sequences():
    from edurank.llm import hashing

    rng = random.Random(7)
    words = [rng.choice([b"a", b"bc", b"longer-than-eight", b"x" * 300]) for _ in range(500)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = hashing.word_ranges(data)
    hasher = hashing.SequenceHasher(2)
    own = hashing.word_hashes(data, starts, ends, 2).tolist()

    def plain(part: list[int]) -> int:
        value = sum(h * pow(hasher.base, i, hashing.PRIME) for i, h in enumerate(part)) % hashing.PRIME
        return int(hashing.mixed(np.array([value], np.uint64))[0])

    for width in (1, 35, 500):
        expected = [plain(own[i : i + width]) for i in range(501 - width)]
        assert hasher(data, starts, ends, width).tolist() == expected
        at = np.array([0, (500 - width) // 2])
        assert hasher(data, starts, ends, width, at).tolist() == [expected[i] for i in at]
    # Patterns that defeat polynomials modulo powers of two.
    one, two = (np.frombuffer(" ".join(thue_morse(2048, *x)).encode(), np.uint8) for x in ("ab", "ba"))
    marks = [hasher(x, *hashing.word_ranges(x), 2048)[0] for x in (one, two)]
    assert marks[0] != marks[1]


def test_hashes_of_words():
    from edurank.llm import hashing

    words = sorted({b"", b"a", b"b", b"a\0", b"abcdefgh", b"abcdefghi", b"abcdefghabcdefgh", b"x" * 300, b"x" * 301, "日本語の言葉".encode(), thue_morse(2048, "a", "b").encode(), thue_morse(2048, "b", "a").encode()})
    data = np.frombuffer(b" ".join(words * 3), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words * 3]) - 1
    starts = ends - np.array([len(w) for w in words * 3])
    found = hashing.word_hashes(data, starts, ends).reshape(3, -1)
    assert (found == found[0]).all() and len(set(found[0].tolist())) == len(words)


def test_windows_around_one_phrase_are_spread(spark):
    rng = random.Random(8)
    phrase = " ".join(f"p{i}" for i in range(12))
    texts = []
    for i in range(40):
        before, behind = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
        texts += [f"{before} {phrase} {behind}"] * (2 if i % 2 else 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    blocks = passages.in_blocks(docs, "doc_id", "text", 6)
    found = passages._recurring(passages._anchor_report(blocks, 35, 8, 6))
    report = passages._window_report(blocks, found, 35, 8, 6).toPandas()
    per_bucket = report.groupby("bucket")["one"].apply(lambda x: sum(map(len, x)) // 8)
    assert len(per_bucket) == 6 and per_bucket.max() < 2 * per_bucket.mean()
    got = {r.doc_id: r.n_removed for r in passages.remove_repeats(docs, block_bytes=2000).collect()}
    assert got == {i: (92 if texts.count(t) > 1 else 0) for i, t in enumerate(texts)}
