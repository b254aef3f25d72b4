"""A small corpus with the awkward rows, and plain rules to compare with."""

from __future__ import annotations

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# Columns named like those the operators use inside.
CLASHES = "row block bucket fp word set mark place size bits at line term pos item count kept_id gone_id labelled_id".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Wind", "stone", "river", "été", "öl", "a", "moron", "x1", "日本", "!!"] + [f"w{i}" for i in range(200)]

    def line(n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    out: list[str | None] = [None, "", "   \n\t", "one", "one two", "one two", "\n\nThe end.\n", "same " * 80]
    passage = line(60)
    for _ in range(12):
        out.append("\n".join(line(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))))
    for _ in range(6):
        words = passage.split()
        words[rng.randrange(60)] = "changed"
        out.append(line(9) + "\n" + " ".join(words) + "  " + line(4))
    out += [passage, passage.upper(), "\n".join([passage, passage]), line(6000)]
    out += [out[-2], out[10], out[11] + " tail"]
    return out


def rows(seed: int = 1) -> list[tuple]:
    found = [(i, t, ("en", "fr", None)[i % 3], "src0", len(t or ""), *("x" for _ in CLASHES)) for i, t in enumerate(texts(seed))]
    return [*found, found[9], (None, "no name here", "en", None, None, *(None for _ in CLASHES))]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def same(got, expected) -> None:
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
