"""Token counts, fill-in-middle and the Merkle manifest against plain rules."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus

from edurank.llm import infill, manifest, tokens

SAMPLES = [
    "", " ", "  ", "\n", " a", "a  b ", "a\nb\n\nc", "<s> hi </s> <unk>", "▁a▁b", "日本語 と 日本", "x" * 3000, "é" * 900,
    "🙂🙂 ok 🙂", "1234567 89", "\u0000 a", "word " * 700, "a \t b\r\n c", "    deep   blanks    ", "<|endoftext|> x <|endoftext|>",
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_count_as_the_whole(name):
    count = tokens.counter(public_tokenizers.path(name))
    rng = random.Random(3)
    texts = SAMPLES + ["".join(rng.choice("ab é日\n .▁1<") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    whole = tokens.batch_lengths(texts, count).tolist()
    assert whole == [count.lengths([t], False)[0] for t in texts]
    cut = 0
    for most in (1, 2, 7, 50):
        assert tokens.batch_lengths(texts, count, most).tolist() == whole
        cut += sum(len(tokens.parts(t, count, most)) > 1 for t in texts)
    assert (cut > 0) == count.cuttable


def test_token_counts(spark, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus.rows()
    expected = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows]
    for limit, most in ((4096, 1 << 16), (5, 16)):
        got = tokens.count_tokens(corpus.documents(spark), limit=limit, most=most)
        corpus.same(map(tuple, got.collect()), [(*e, e[2] > limit) for e in expected])
    none = tokens.count_tokens(corpus.empty(spark))
    assert none.collect() == [] and none.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    named = corpus.documents(spark).withColumnsRenamed({"doc_id": "doc.id", "text": "the text"})
    corpus.same([r.n_tokens for r in tokens.count_tokens(named, "doc.id", "the text").collect()], [e[2] for e in expected])


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infilled(doc_id, text, unit="token", rate=50):
    text = text or ""
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = UNITS.findall(text) if unit == "token" else list(text)
    n = len(parts)
    assert "".join(parts) == text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fill_in_middle(spark, unit):
    texts = SAMPLES + corpus.texts() + ["a <P> b c d", "<S>", "x<", "<<S", "P> <", " lone blank ", "é 日本 🙂 z" * 50]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "no name here é"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for rate in (50, 100):
        done = infill.fill_in_middle(docs, unit=unit, rate=rate).withColumn("back", infill.restored(F.col("output"), F.col("form")))
        expected = [(*infilled(*r, unit, rate), r[1] or "") for r in rows]
        assert {e[2] for e in expected} == {"plain", "spm", "psm"}
        corpus.same(map(tuple, done.collect()), expected)


def test_fill_in_middle_query(spark, tmp_path):
    corpus.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    expected = [(*infilled(*r[:2])[:5], sha(infilled(*r[:2])[5]), sha(r[1] or "")) for r in corpus.rows()]
    corpus.same(map(tuple, infill.query(spark, str(tmp_path)).collect()), expected)
    none = infill.fill_in_middle(corpus.empty(spark).withColumnRenamed("text", "the.text"), text="the.text")
    assert none.collect() == []


def test_places_of_multibyte_characters():
    text = "aé日🙂b" * 5 + "plain ascii" + "ß"
    index = infill.Exceptions(np.frombuffer(text.encode(), np.uint8))
    cuts = np.arange(len(text) + 1)
    places = np.array([len(text[:c].encode()) for c in cuts])
    assert len(index.at_byte) == sum(len(c.encode()) > 1 for c in text)
    assert index.bytes(cuts).tolist() == places.tolist()
    assert index.points(places).tolist() == cuts.tolist()


def told(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves, fan):
    """Root, and per leaf the siblings (left, right) level by level."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // fan * fan
            steps[i].append(("".join(level[run:place]), "".join(level[place + 1 : run + fan])))
        level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        at = [place // fan for place in at]
    return level[0], steps


def plain_manifest(rows, fan=16):
    """(doc_id, leaf, tampered leaf or none, subroot, root, steps) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        low = None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
        crc = None if r[0] is None else zlib.crc32(str(r[0]).encode())
        other = sha("".join(map(told, (*r[:4], low)))) if crc is not None and crc % 5 == 0 else None
        groups.setdefault(r[1], []).append((r[0], sha("".join(map(told, r))), other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = plain_tree([x[1] for x in groups[name]], fan)
    root, higher = plain_tree([trees[n][0] for n in names], fan)
    return [
        (*leaf, trees[name][0], root, own + above)
        for name, above in zip(names, higher, strict=True)
        for leaf, own in zip(groups[name], trees[name][1], strict=True)
    ]


def plain_fold(leaf, steps):
    for left, right in steps:
        leaf = sha(left + leaf + right)
    return leaf


def table_rows():
    rng = random.Random(5)
    rows = [(i, f"s{rng.choice('aaaaabc')}", rng.choice(["en", None]), i, f"Text {i} É") for i in range(700)]
    rows += [(i, f"lone{i}", "de", None, None) for i in range(1000, 1020)]
    rows += [(5, "sa", None, None, "Again"), (5, "sa", None, None, "Again"), (None, None, None, None, None), (None, "", "", 0, "")]
    return rows + [(2000 + i, None, "x", 1, "") for i in range(40)] + [(None, "sb", "en", 3, "No Name"), (-7, "Ä", "|", 3, "A:B" * 999)]


TREE_SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("fan", [16, 2])
def test_manifest(spark, fan):
    rows = table_rows()
    docs = spark.createDataFrame(rows, TREE_SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "pos", "hash", "size", "_key", "run", "a.b")})
    got = manifest.manifest(docs, fan=fan, carried={"hash": F.col("n_chars")}).collect()
    expected = plain_manifest(rows, fan)
    corpus.same(
        [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in got],
        [(e[0], e[1], *e[3:]) for e in expected],
    )
    assert all(plain_fold(e[1], e[5]) == e[4] for e in expected)
    assert {r.doc_id: r.hash for r in got if (r.doc_id or 0) > 5}.items() == {r[0]: r[3] for r in rows if (r[0] or 0) > 5}.items()


def test_manifest_query(spark, tmp_path):
    rows = table_rows()
    spark.createDataFrame(rows, TREE_SCHEMA).withColumn("tree", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc_id, leaf, other, subroot, root, steps in plain_manifest(rows):
        end = plain_fold(other or leaf, steps)
        expected.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in steps)), end, end == root))
    assert {e[-1] for e in expected} == {True, False}
    corpus.same(map(tuple, manifest.query(spark, str(tmp_path)).collect()), expected)


@pytest.mark.parametrize("count", [0, 1, 16, 17])
def test_small_manifests(spark, count):
    rows = [(i, "one", "en", 1, "t") for i in range(count)]
    got = manifest.manifest(spark.createDataFrame(rows, TREE_SCHEMA)).collect()
    corpus.same(
        [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in got],
        [(e[0], e[1], *e[3:]) for e in plain_manifest(rows)] if rows else [],
    )
