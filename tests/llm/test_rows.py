"""Rows with null and repeated ids are judged one by one."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus
from test_models import labelled

from edurank.llm import contamination, linededup, simhash, toxicity


def test_rejections_go_by_row(spark):
    docs, labels = labelled(spark)
    more = [(None, "word1 word2 word3", "en", "a", 1), (None, "word4 awfulness word5", "en", "b", 2), (None, None, "en", None, None)]
    more += [(1, "word7 awfulness", "en", "c", 3), (0, "word8 word9", "de", "d", 4), (0, "word8 word9", "de", "d", 4)]
    own = spark.createDataFrame(more, docs.schema)
    model = toxicity.fit(docs, labels)
    rejected = [bool((s >= c)[0]) for s, c in (toxicity.judged(model, [(r[1] or "").encode()], [r[2]]) for r in more)]
    assert rejected == [False, True, False, True, False, False]
    old = toxicity.fit
    toxicity.fit = lambda *_, **__: model
    try:
        kept = toxicity.drop_toxic(own, labels).collect()
    finally:
        toxicity.fit = old
    corpus.same(map(tuple, kept), [r for r, gone in zip(more, rejected, strict=True) if not gone])


def test_contaminated_rows_go_alone(spark):
    words = " ".join(f"item{i}" for i in range(10))
    rows = [(None, f"a {words} b", "x"), (None, "clean", "y"), (None, "clean", "y"), (None, None, "z"), (None, "", "z")]
    rows += [(1, words, "x"), (1, "also clean", "y"), (2, words.upper(), None), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    items = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    kept = contamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    corpus.same(map(tuple, kept.collect()), [r for r in rows if not r[1] or "clean" in r[1]])


def lines_left(rows, similarity=80):
    """Plain rule: earlier lines are those of smaller ids, null ids last and each a document of its own."""
    nameless = sorted((n for n, r in enumerate(rows) if r[0] is None), key=lambda n: (-1 if rows[n][1] is None else 0, n))
    place = {n: (0, r[0]) for n, r in enumerate(rows) if r[0] is not None} | {n: (1, k) for k, n in enumerate(nameless)}
    lines = [
        ((*place[n], i), n, i, set(corpus.words(line.lower())))
        for n, r in enumerate(rows)
        for i, line in enumerate((r[1] or "").split("\n"))
    ]
    gone = {
        (n, i)
        for at, n, i, own in lines
        if own and any(b < at and other and 100 * len(own & other) >= similarity * len(own | other) for b, _, _, other in lines)
    }
    return [
        (r[0], r[1] if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if (n, i) not in gone), r[2])
        for n, r in enumerate(rows)
    ]


def test_lines_of_null_and_repeated_ids(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, "first line here\nsame", "a"), (2, "first line here\nkept alone", "a"), (2, "quite another\nstays too", "b")]
    rows += [(None, "hello there world\n\nmore words", "c")] * 3 + [(None, None, "c"), (None, "", "c"), (None, "first line here", "d")]
    # Near copies: under a repeated id, and without ids.
    rows += [(3, long, "e"), (4, "unlike\n" + long, "e"), (4, "other\n" + long + " eleven", "e"), (None, long + " twelve", "f")]
    # Equal places of one id do not remove each other; both go with an earlier line.
    rows += [(5, "alpha beta gamma delta epsilon", "g"), (6, "alpha beta gamma delta epsilon zeta\nx", "g"), (6, "alpha beta gamma delta epsilon zeta\ny", "g")]
    rows += [(7, "mu nu xi omicron pi rho\np", "h"), (7, "mu nu xi omicron pi rho sigma\nq", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = linededup.dedup_lines(docs).select("doc_id", "text", "lang").collect()
    corpus.same(map(tuple, got), lines_left(rows))


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    third = " ".join(f"u{i}" for i in range(50))
    rows = [(5, text, "a"), (None, text, "b"), (None, text, "b")] + [(None, other, "c")] * 4
    rows += [(7, third, "d"), (7, third.upper(), "d"), (7, third, "d"), (8, text, "e"), (8, "alone with its id", "f"), (5, other, "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [(r.doc_id, r.text.lower(), r.lang) for r in simhash.keep_one(docs).collect()]
    corpus.same(got, [(5, text, "a"), (5, other, "g"), (7, third, "d"), (8, "alone with its id", "f")])
    nameless = docs.where("doc_id is null")
    corpus.same([r.text for r in simhash.keep_one(nameless).collect()], [text, other])
