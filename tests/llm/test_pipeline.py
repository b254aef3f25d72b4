"""The pipeline's stages, and checking SQL of the corpus queries."""

import random
import re
import sys
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus
import corpus_pipeline
from test_models import labelled
from test_texts import fingerprint, roots

from edurank.llm import toxicity
from edurank.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.packing(spark, docs, SF)
    assert pieces.where("start = 0").count() == before


ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_lines(rows):
    """Lines that an earlier line matches go; ids ascend, rows without one come last, each by itself."""
    named = {n: (0, r[0]) for n, r in enumerate(rows) if r[0] is not None}
    place = named | {n: (1, n) for n in range(len(rows)) if n not in named}
    lines = [((*place[n], i), n, i, set(corpus.words((line or "").lower()))) for n, r in enumerate(rows) for i, line in enumerate((r[1] or "").split("\n"))]
    gone = {(n, i) for at, n, i, own in lines if own and any(b < at and o and 100 * len(own & o) >= 80 * len(own | o) for b, _, _, o in lines)}
    out = []
    for n, r in enumerate(rows):
        text = r[1] and "\n".join(x for i, x in enumerate(r[1].split("\n")) if (n, i) not in gone)
        out.append((r[0], text, r[2], r[3], None if text is None else len(text), *r[5:]))
    return out


def plain_near(rows):
    """The row of the smallest id of each group of fingerprints that differ in two bits or fewer."""
    marks = [fingerprint(r[1]) for r in rows]
    root = roots(set(marks), 2)
    best = {}
    for r, m in zip(rows, marks, strict=True):
        if root[m] not in best or (r[0] is None, r[0] or 0) < (best[root[m]][0] is None, best[root[m]][0] or 0):
            best[root[m]] = r
    return list(best.values())


def plain_clean(rows, items):
    windows = set()
    for text in items:
        w = ITEM_WORD.findall(corpus.lowered(text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}

    def hit(text):
        w = ITEM_WORD.findall(corpus.lowered(text))
        return any(tuple(w[i : i + n]) in windows for i in range(len(w)) for n in range(1, 11))

    return [r for r in rows if not hit(r[1])]


def test_every_stage_does_its_work(spark, tmp_path, monkeypatch):
    """Planted cases under clashing and dotted column names, stage by stage against plain rules."""
    rng = random.Random(4)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    bench, near, shared = prose(14), prose(80), prose(20)
    texts = [prose(30) + "\n" + prose(20) for _ in range(12)]
    texts += [prose(9) + " awfulness " + prose(9), "awfulness", f"{prose(15)}\n{shared}", f"{shared}\n{prose(25)}", f"{shared} tail\n{prose(12)}"]
    texts += [near, near.upper(), prose(12) + " " + bench + " " + prose(12), prose(4) + "\n" + bench.upper(), None, "", " \n ", texts[0]]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", None if t is None else len(t), i, f"x{i}", "d", 1) for i, t in enumerate(texts)]
    rows += [(None, prose(40), "en", None, 1, None, None, None, None), (3, prose(33), None, None, None, 5, "t", "u", 2), (None, "awfulness", "en", None, 1, 1, "", "", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines int, n_removed string, `a.b` string, `c``d` int"
    docs, labels = labelled(spark)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None), (3, prose(30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "fit", lambda *_, **__: model)

    def calm(r):
        score, cut = toxicity.judged(model, [(r[1] or "").encode()], [r[2]])
        return bool(score[0] < cut[0])

    plain = {
        "toxicity": lambda kept: [r for r in kept if calm(r)],
        "line_dedup": plain_lines,
        "simhash_near_dedup": plain_near,
        "benchmark_decontamination": lambda kept: plain_clean(kept, [bench, None]),
    }
    kept, table = rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = list(kept)
        kept = plain[name](kept)
        table = corpus_pipeline.materialize(stage(spark, table, str(tmp_path)))
        corpus.same(map(tuple, table.collect()), kept)
        assert table.columns == [f.name for f in docs.schema] + ["n_lines", "n_removed", "a.b", "c`d"]
        assert sorted(map(repr, kept)) != sorted(map(repr, before)), name
        assert len(kept) > 12
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = [(r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in kept]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in pieces.collect()) == sum(n for _, n in lengths)
    corpus.same([(r.doc_id, r.doc_tokens) for r in pieces.where("start = 0").collect()], lengths)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    expected = connection.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(expected.columns)]
    columns = list(expected.columns)
    expected, got = (f.sort_values(columns).reset_index(drop=True).astype(str) for f in (expected, got))
    assert got.equals(expected)
