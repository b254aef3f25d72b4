"""Classifiers, language model, neighbours and transcripts."""

import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus

from edurank.llm import chat, neighbours, ppm, quality, toxicity


def labelled(spark, n=400):
    rng = random.Random(8)
    calm = [f"word{i}" for i in range(120)]
    docs, labels = [], []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        w = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            w[rng.randrange(len(w))] = ("awfulness", "scheusal")[i % 2] + rng.choice(["", "en", "ly", "s"])
        if poor:
            w += ["JUNK!!"] * 30
        docs.append((i, " ".join(w), lang, "src", 0))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(None, "awfulness", "en", "src", 0), (n, None, None, None, None), (n + 1, "", "en", "src", 0)]
    labels += [(3, None, None), (None, 1, 1), (5, 0, 0)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert {r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None} == {True}
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[400].score == got[401].score < 0.5
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def plain_toxicity(model, text):
    """Score by loops over words, widths and filters."""
    words = "".join(c.lower() if c.isascii() else c for c in text)
    words = [w.encode() for w in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", words) if w]

    def vector(word):
        rows = [zlib.crc32(word) % (toxicity.BUCKETS - 1) + 1]
        for n in toxicity.STEMS:
            if len(word) >= n:
                mixed = (int.from_bytes(word[:n], "little") * 0x9E3779B97F4A7C15 + n * 0x632BE59BD9B4E019) % (1 << 64)
                mixed = (mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
                rows.append((mixed >> 40) % (toxicity.BUCKETS - 1) + 1)
        return sum(model.embedding[r].astype(float) for r in rows)

    vectors = [vector(w) for w in words]
    logit, place = model.offset, 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(words)):
                answer = float(model.bias[width][f])
                for k in range(min(width, len(words) - i)):
                    answer += float(vectors[i + k] @ model.filters[width][k][:, f].astype(float))
                best = max(best, answer)
            logit += best * float(model.output[place])
            place += 1
    return 1 / (1 + math.exp(-logit))


def test_toxicity_score_equals_plain_loops(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    own = [("one awfulness, two", "en"), ("", "de"), (None, None), ("...", "xx"), ("É ÉA Scheusal-ly x9 word1 word2", "de"), ("awful " * 30, "en")]
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(own)], "doc_id bigint, text string, lang string")
    old, toxicity.fit = toxicity.fit, lambda *_, **__: model
    try:
        got = {r.doc_id: r for r in toxicity.score_toxicity(table, labels).collect()}
    finally:
        toxicity.fit = old
    for i, (text, lang) in enumerate(own):
        score = plain_toxicity(model, text or "")
        assert abs(got[i].score - score) < 1e-5 and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].threshold == model.thresholds.get(lang or "", 0.5) and got[i].rejected == (got[i].score >= got[i].threshold)


def plain_quality(model, text):
    """Logit by loops over passages and their words."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    mark = quality.RangeHasher(9)

    def number(word):
        own = np.frombuffer(re.sub(rb"[A-Z]", lambda m: m[0].lower(), word), np.uint8)
        return int(mark(own, np.array([0]), np.array([len(own)]))[0])

    kinds = [rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[\x80-\xff]", rb"[.,]", rb"[!-+\-/:-@\[-`{-}]"]
    states = []
    for at in range(0, max(1, len(words)), quality.PASSAGE):
        part = words[at : at + quality.PASSAGE]
        x = np.zeros(quality.SHAPES + quality.WORD_BUCKETS)
        if part:
            joined, numbers = b"".join(part), [number(w) for w in part]
            flags = [
                [n > 0 and numbers[n] == numbers[n - 1] for n in range(len(part))],
                [w[-1:] in b"!?" for w in part], [w[-1:] == b"." for w in part], [w == b"|" for w in part],
                [w[:1].isupper() for w in part], [len(w) > 15 for w in part],
            ]
            found = [len(re.findall(k, joined)) / len(joined) for k in kinds] + [sum(f) / len(part) for f in flags]
            found += [len(set(numbers)) / len(part), len(joined) / len(part) / 8, len(part) / quality.PASSAGE]
            x[: len(found)] = found
            for n in numbers:
                x[quality.SHAPES + n % quality.WORD_BUCKETS] += 1 / len(part)
        w = model.weights
        h = np.tanh(((x - model.middle) / model.spread) @ w["encode"] + w["encode_bias"])
        raw = sum(math.tanh(h @ w["tanh"][:, j]) / (1 + math.exp(-(h @ w["gate"][:, j]))) * w["attend"][j] for j in range(quality.ATTENTION))
        states.append((raw, h))
    total = sum(math.exp(raw) for raw, _ in states)
    z = sum(math.exp(raw) / total * h for raw, h in states)
    return float(z @ w["out"] + w["bias"][0] + model.offset)


def test_quality_score_equals_plain_loops():
    rng = random.Random(3)
    texts = ["", " \n", "One two. three! | | Four? JUNK!! JUNK!!", "é" * 20 + " x1 -/- A", " ".join(rng.choice(["a", "Bb.", "c1,", "{x}", "日本"]) for _ in range(100))]
    features, _ = quality.passage_features([t.encode() for t in texts], quality.RangeHasher(9))
    model = quality.Model.fresh(features)
    model.offset = 0.25
    got = model.logits([t.encode() for t in texts], quality.RangeHasher(9))
    assert np.allclose(got, [plain_quality(model, t) for t in texts], atol=1e-9)


def test_classifiers_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert {r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None} == {True}
    assert np.mean([r.predicted == (r.doc_id % 7 != 0) for r in held]) > 0.95
    assert got[400].score == got[401].score


def test_attention_gradient():
    rng = np.random.default_rng(0)
    features, first = rng.normal(size=(7, quality.SHAPES + quality.WORD_BUCKETS)), np.array([0, 3, 4])
    model, label = quality.Model.fresh(features), np.array([1.0, 0, 1])

    def loss():
        p = quality.sigmoid(model.forward(features, first)["logit"])
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).sum()

    seen = model.forward(features, first)
    slopes = model.gradient(seen, first, quality.sigmoid(seen["logit"]) - label)
    for name, slope in slopes.items():
        weight = model.weights[name]
        at = tuple(rng.integers(0, s) for s in weight.shape)
        weight[at] += 1e-5
        high = loss()
        weight[at] -= 2e-5
        low = loss()
        weight[at] += 1e-5
        assert slope[at] == pytest.approx((high - low) / 2e-5, abs=1e-5)


def plain_ppm(texts):
    """log10 probability of a text by the rules, over dictionaries."""
    order = ppm.ORDER
    counts = [defaultdict(Counter) for _ in range(order + 1)]

    def framed(text):
        return bytes([ppm.START]) * order + (text or "").encode() + bytes([ppm.END])

    for text in texts:
        data = framed(text)
        for i in range(order, len(data)):
            counts[order][data[i - order : i]][data[i]] += 1
    for k in range(order - 1, -1, -1):
        for context, seen in counts[k + 1].items():
            for x in seen:
                counts[k][context[1:]][x] += 1

    def symbol(context, x):
        out, barred = 0.0, set()
        for k in range(order, -1, -1):
            seen = counts[k].get(context[order - k :], {})
            left = {s: n for s, n in seen.items() if s not in barred}
            if left:
                total = sum(left.values())
                if x in left:
                    return out + math.log10((left[x] - 0.5) / total)
                out += math.log10(0.5 * len(left) / total)
            barred |= set(seen)
        return out - math.log10(ppm.SYMBOLS - len(barred))

    def score(text):
        data = framed(text)
        return sum(symbol(data[i - order : i], data[i]) for i in range(order, len(data)))

    return score


@pytest.mark.parametrize("size", [1 << 23, 500])
def test_language_model(spark, size):
    docs, rows = corpus.documents(spark), corpus.rows()
    train = [r for r in rows if r[0] is None or r[0] % 4]
    trie = ppm.pretrain(docs.where("doc_id is null or doc_id % 4 <> 0"), shard_bytes=size)
    got = ppm.score(docs, trie, block_bytes=size).collect()
    tokens = {r[1]: [*corpus.lowered(r[1]).split(), None] for r in rows}
    counts = Counter(w for r in train for w in tokens[r[1]])
    total = math.log10(sum(counts.values()) + len(counts) + 1)
    plain = plain_ppm([r[1] for r in train])
    expected = sorted(
        (-1 if r[0] is None else r[0], len(own), sum(w in counts for w in own), sum(math.log10(counts[w] + 1) for w in own) - len(own) * total, plain(r[1]))
        for r in rows
        for own in [tokens[r[1]]]
    )
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    np.testing.assert_allclose([x[3:] for x in found], [x[3:] for x in expected], rtol=1e-9)
    assert {r.train_tokens for r in got} == {sum(counts.values())}


def test_language_model_of_nothing(spark):
    trie = ppm.pretrain(corpus.empty(spark))
    assert ppm.score(corpus.empty(spark), trie).count() == 0
    (row,) = ppm.score(spark.createDataFrame([(1, "ab")], "doc_id bigint, text string"), trie).collect()
    assert row.score == pytest.approx(-3 * math.log10(ppm.SYMBOLS)) and row.n_known == 0


@pytest.mark.parametrize("shard", [4_096, 50])
def test_nearest_neighbours(spark, shard):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)).round(3)
    rows = [(i, base[i].tolist() if i % 3 else base[0].tolist()) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6)]
    rows += [(305, [1.0, 2.0]), (320, [3.0, 4.0]), (None, [1.0] * 6), rows[40]]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = vectors.where("vec_id % 20 = 0")
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = v
    expected = []
    for i in good:
        if i % 20 == 0:
            scored = sorted((-float(neighbours.inner_products(np.array([v]), np.array(good[i]))[0]), j) for j, v in good.items() if j != i and len(v) == len(good[i]))
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:20])]
    got = neighbours.nearest(vectors, asked, shard=shard).collect()
    corpus.same(map(tuple, got), expected)
    assert neighbours.nearest(vectors.limit(0), asked.limit(0)).count() == 0


def test_pruning_factor_trades_recall(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(3000, 3))
    length = float(np.sqrt((points**2).sum(axis=1)).max())
    tree = neighbours.VantageTree.build(np.arange(3000), points, length)
    exact = tree.search(points[:50], np.full(50, -1), 5, 1.0)
    loose = tree.search(points[:50], np.full(50, -1), 5, 20.0)
    best = np.argsort(-(points[:50] @ points.T), axis=1, kind="stable")[:, :5]
    assert exact[1].reshape(50, 5).tolist() == best.tolist()
    shared = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(loose[1].reshape(50, 5), best, strict=True)])
    assert 0.2 < shared <= 1
    with pytest.raises(ValueError):
        neighbours.nearest(spark.range(0), spark.range(0), factor=0.5)


def turns(n_conv=40, length=9):
    rng, out = random.Random(6), []
    for c in range(n_conv):
        for t in range(length if c else 1500):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            n = {"system": 1, "user": 2, "assistant": 5}[role]
            out.append((c, t, role, "\n".join(" ".join("word" for _ in range(rng.randint(2, 12 * n))) for _ in range(rng.randint(1, n)))))
    return out


def test_transcripts(spark):
    rows = turns()
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    lines = chat.as_transcripts(talks)
    model = chat.fit(lines)
    pieces = {}
    for r in lines.orderBy("conv_id", "turn").collect():
        pieces.setdefault(r.conv_id, []).append((r.turn, [line.code for line in chat.read_piece(r.text)]))
    expected = {}
    for conv, own in pieces.items():
        codes = [c for _, part in own for c in part]
        last = int(model.matrix(codes)[chat.STATES].argmax())
        states, at = model.decode(codes, chat.STATES, last), 0
        for turn, part in own:
            expected[conv, turn] = (chat.ROLES[states[at] % 3], sum(s < 3 for s in states[at : at + len(part)]))
            at += len(part)
    got = chat.parse(lines, model).collect()
    assert {(r.conv_id, r.turn): (r.role, r.n_begun) for r in got} == expected
    truth = {(c, t): role for c, t, role, _ in rows}
    assert np.mean([r.role == truth[r.conv_id, r.turn] for r in got]) > 0.9


def plain_counts(rows):
    """Start, step and emission counts over whole transcripts of (conv, turn, role, text)."""
    start, step, emit = np.zeros(chat.STATES), np.zeros((chat.STATES, chat.STATES)), np.zeros((chat.STATES, chat.CODES))
    talks = {}
    for n, (conv, turn, role, text) in enumerate(rows):
        key = (conv,) if conv is not None and turn is not None else ("alone", n)
        talks.setdefault(key, []).append((turn or 0, text is not None, text or "", role))
    for own in talks.values():
        before = None
        for _, _, text, role in sorted(own):
            for n, line in enumerate(chat.read_piece(text)):
                state = chat.ROLES.index(role) + 3 * (n > 0)
                emit[state, line.code] += 1
                if before is None:
                    start[state] += 1
                else:
                    step[before, state] += 1
                before = state
    return start, step, emit


def test_counts_of_the_model_cross_blocks(spark):
    lines = chat.as_transcripts(spark.createDataFrame(turns(9, 5), "conv_id bigint, turn bigint, role string, text string"))
    more = [(None, 3, "user", "Q: alone"), (4, None, "assistant", "a\nb"), (4, 2, "user", "twice?"), (4, 2, "user", "twice?")]
    more += [(7, 100 + i, "user", None) for i in range(300)] + [(7, 900, "assistant", "after a gap"), (7, -5, "system", "first")]
    both = lines.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string"))
    model = chat.fit(both)
    plain = chat.Markov.counted(*plain_counts([tuple(r) for r in both.collect()]))
    for got, expected in ((model.start, plain.start), (model.step, plain.step), (model.emit, plain.emit)):
        assert np.array_equal(got, expected)


def test_odd_transcripts(spark):
    rows = [(1, 0, "user", "User: hi"), (1, 0, "user", "User: hi"), (1, 1, None, None), (1, 2, None, "\n \n"), (1, 70, None, "Bot: yes?\nmore")]
    rows += [(None, 1, "user", "User: x"), (None, 1, "user", "User: x"), (2, None, "user", "Bot: y"), (3, -1, None, "User: a"), (3, 5, None, "Bot: b"), (3, -(1 << 60), None, "System: c")]
    rows += [(1 << 60, (1 << 60) + 1, None, "Bot: far")]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    known = chat.as_transcripts(spark.createDataFrame(turns(12, 5), "conv_id bigint, turn bigint, role string, text string"))
    model = chat.fit(known)
    found = chat.parse(talks, model).collect()
    corpus.same([(r.conv_id, r.turn) for r in found], [r[:2] for r in rows])
    got = {(r.conv_id, r.turn): r for r in found}
    # The repeat may go on with the turn; then its marker is text.
    assert "<|user|>\nhi" in {r.rendered for r in found if r.turn == 0} <= {"<|user|>\nhi", "User: hi"}
    assert got[1, 1].rendered == "" and got[1, 2].role is None
    assert got[1, 70].rendered == "<|assistant|>\nyes?\nmore" and got[None, 1].rendered == "<|user|>\nx"
    assert got[2, None].rendered == "<|assistant|>\ny" and got[3, 5].rendered == "<|assistant|>\nb"
    assert got[3, -(1 << 60)].rendered == "<|system|>\nc" and got[1 << 60, (1 << 60) + 1].n_begun == 1
    assert chat.parse(talks.limit(0), chat.fit(talks.limit(0))).count() == 0


def test_only_the_marker_of_a_begun_turn_goes():
    first, second, third = chat.read_piece("\nUser: ask\n\n user: bob\na: 1")
    assert first.rendered(1) == "<|user|>\nask" and first.rendered(2) == "<|assistant|>\nUser: ask"
    assert second.rendered(4) == "\n user: bob" and third.rendered(5) == "a: 1"


def test_thresholds_use_all_labelled_rows(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(1500):
        # A minority language whose toxic texts look calmer than those of the others.
        lang, toxic = ("xx" if i % 12 == 0 else "en"), int(rng.random() < 0.3)
        w = [f"word{rng.randrange(90)}" for _ in range(25)] + ["awfulness"] * (toxic or rng.random() < 0.2)
        docs.append((i, " ".join(w + ["scheusal"] * (toxic and rng.random() < 0.6)), lang))
        labels.append((i, toxic, 1 - toxic))
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    given = spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    model = toxicity.fit(table, given, rows=150)
    sample = toxicity.labelled_sample(table, given, "toxic", toxicity.FOLDS, toxicity.HELD, 150)
    used = set(sample["labelled_id"][np.arange(len(sample)) % toxicity.CALIBRATION != 0].tolist())
    rest = [(t, lang, labels[i][1]) for i, t, lang in docs if i not in used and zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD]
    # The sample alone has too few toxic rows of it for a threshold other than one half.
    assert set(model.thresholds) == {"en", "xx"} and model.thresholds["xx"] != 0.5

    def f1(logit, truth, cut):
        said = logit >= cut
        return 2 * (said & truth).sum() / max(1, said.sum() + truth.sum())

    for lang in ("en", "xx"):
        own = [(t, y) for t, x, y in rest if x == lang]
        logit, truth = model.logits([t.encode() for t, _ in own]), np.array([y > 0 for _, y in own])
        assert truth.sum() >= 10
        cut = math.log(model.thresholds[lang] / (1 - model.thresholds[lang]))
        assert f1(logit, truth, cut) > max(f1(logit, truth, c) for c in logit) - 0.03
    good = quality.fit(table, given, rows=150)
    sample = quality.labelled_sample(table, given, "quality", quality.FOLDS, quality.HELD, 150)
    used = set(sample["labelled_id"][np.arange(len(sample)) % quality.CALIBRATION != 0].tolist())
    own = [(t, labels[i][1]) for i, t, _ in docs if i not in used and zlib.crc32(str(i).encode()) % quality.FOLDS != quality.HELD]
    logit, truth = -good.logits([t.encode() for t, _ in own], quality.RangeHasher(9)), np.array([y > 0 for _, y in own])
    assert f1(logit, truth, 0.0) > max(f1(logit, truth, c) for c in logit) - 0.03
