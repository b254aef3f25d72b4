"""Transcript parsing by a hidden Markov model, and canonical rendering of the turns.

A transcript comes in pieces (conversation, place, text).  Every line that is not
blank is seen as a code of its speaker marker, a blank line before it, its length
and whether it asks.  The states are the roles, each at the first line of a turn
or inside one.  Transitions and emissions are counted from transcripts whose
roles are known; Viterbi recovers the most likely states.

A conversation may be of any length: its pieces are numbered and cut into blocks, each block
is summed up by a matrix of best scores between its states, and matrices are
multiplied (in maximum and sum) level by level until one is left.  The way back
down fixes the states at the borders, and blocks are decoded on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import fold, shares, table
from edurank.plans.materialize import materialize
from edurank.plans.ordered import forward_fill
from edurank.plans.paging import with_row_number

ROLES = ("system", "user", "assistant")
# A role at the first line of a turn, then inside.
STATES = 2 * len(ROLES)
FOLDS, HELD_OUT = 5, 0
# Pieces in a block, blocks in a block of the next level, pieces in a task's group.
BLOCK, FAN, GROUP = 64, 64, 1_024
# Speaker names before a colon or in brackets, by the kind of marker.
MARKERS = {"system": 1, "instruction": 1, "user": 2, "human": 2, "q": 2, "assistant": 3, "bot": 3, "a": 3}
_MARKER = re.compile(r"\s*(?:\[(\w+)\]|<\|(\w+)\|>|#+\s*(\w+)\s*:|(\w+)\s*:)\s*", re.ASCII)
_LENGTHS = (20, 60, 160, 400)
CODES = 4 * 2 * (len(_LENGTHS) + 1) * 2


def read_line(line: str, blank: bool) -> tuple[int, str]:
    """(code of a line, the line without its speaker marker)."""
    kind = 0
    found = _MARKER.match(line)
    if found:
        kind = MARKERS.get(next(x for x in found.groups() if x).lower(), 0)
    said = line[found.end() :] if kind else line
    length = sum(len(said) > x for x in _LENGTHS)
    return ((kind * 2 + blank) * (len(_LENGTHS) + 1) + length) * 2 + said.rstrip().endswith("?"), said


@dataclass(frozen=True)
class Line:
    """A line that is not blank: its code, itself, what follows its marker, and the blank lines before it."""

    code: int
    whole: str
    said: str
    blanks: tuple[str, ...]

    def rendered(self, state: int) -> str:
        """The line as it begins a turn, or inside one.

        A marker goes where the turn of its own role begins; elsewhere it is text.
        Blank lines before a turn separate it, inside a turn they belong to it.
        """
        if state >= len(ROLES):
            return "\n".join((*self.blanks, self.whole))
        marked = self.code // (CODES // 4) == state + 1
        return f"<|{ROLES[state]}|>\n{self.said if marked else self.whole}"


def read_piece(text: str | None) -> list[Line]:
    """The lines of a piece that are not blank."""
    lines, blanks = [], []
    for line in (text or "").split("\n"):
        if not line.strip():
            blanks.append(line)
            continue
        code, said = read_line(line, bool(blanks))
        lines.append(Line(code, line, said, tuple(blanks)))
        blanks = []
    return lines


@dataclass(frozen=True)
class Markov:
    """Natural logarithms of the start, transition and emission probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def counted(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Markov:
        """Probabilities of counts, each raised by a half."""

        def logs(counts: np.ndarray) -> np.ndarray:
            raised = counts + 0.5
            return np.log(raised / raised.sum(axis=-1, keepdims=True))

        # Inside a turn only its own role goes on; elsewhere a turn begins.
        allowed = np.ones((STATES, STATES), bool)
        for state in range(STATES):
            for inside in range(len(ROLES), STATES):
                allowed[state, inside] = state % len(ROLES) == inside % len(ROLES)
        begin = np.where(np.arange(STATES) < len(ROLES), logs(start), -np.inf)
        return cls(begin, np.where(allowed, logs(step), -np.inf), logs(emit))

    def matrix(self, codes: list[int]) -> np.ndarray:
        """Best scores from the state before the codes (the last row: none) to the state of the last code."""
        best = np.vstack((self.step, self.start)) + self.emit[:, codes[0]]
        for code in codes[1:]:
            best = (best[:, :, None] + self.step[None, :, :]).max(axis=1) + self.emit[:, code]
        return best

    def decode(self, codes: list[int], before: int, last: int) -> list[int]:
        """Best states that follow ``before`` (``STATES``: none) and end in ``last``."""
        best = np.vstack((self.step, self.start))[before] + self.emit[:, codes[0]]
        back = []
        for code in codes[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + self.emit[:, code]
        states = [last]
        for ways in reversed(back):
            states.append(int(ways[states[-1]]))
        return states[::-1]


def _pieces(df: DataFrame, conv: str, place: str, text: str, role: Column | None = None) -> tuple[DataFrame, int]:
    """Numbered pieces with their transcript, block and bucket, and the number of buckets.

    ``conv`` names the transcript: a row without a conversation or a place is one
    of its own.  Rows are numbered through all transcripts and cut into blocks by
    their number, so neither places nor repeats make a block large.
    """
    named = F.col(conv).isNotNull() & F.col(place).isNotNull()
    kept = materialize(
        df.select(
            # As texts: pandas has no whole numbers beside nulls.
            F.col(conv).cast("string").alias("conv_id"),
            F.col(place).cast("bigint").cast("string").alias("turn"),
            F.col(place).cast("bigint").alias("place"),
            F.col(text).cast("string").alias("text"),
            (F.lit(None).cast("string") if role is None else role.cast("string")).alias("role"),
            named.alias("named"),
            F.monotonically_increasing_id().alias("id"),
        )
    )
    own = F.when(F.col("named"), F.concat(F.lit("c"), F.col("conv_id")))
    told = kept.withColumn("conv", F.coalesce(own, F.concat(F.lit("r"), F.col("id").cast("string")))).drop("named")
    numbered = with_row_number(told, [F.col(c) for c in ("conv", "place", "text", "id")], "n")
    groups = shares(kept.count(), GROUP)
    blocked = numbered.drop("id", "place").withColumn("block", F.floor(F.col("n") / BLOCK))
    return blocked.withColumn("bucket", _bucket(groups)), groups


def _bucket(groups: int) -> Column:
    return F.pmod(F.xxhash64("conv", "block"), F.lit(groups)).cast("int")


def _blocks(frame: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    return iter(frame.sort_values(["conv", "block", "n"], kind="stable").groupby(["conv", "block"], sort=False))


def fit(df: DataFrame, conv: str = "conv_id", place: str = "turn", text: str = "text", role: str = "role") -> Markov:
    """Model of all pieces with known roles, each taken as one turn.

    Steps are counted inside blocks; the one into a block comes from the last
    line before it, which is handed on over blocks without a line.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        step, emit, ends = np.zeros((STATES, STATES)), np.zeros((STATES, CODES)), []
        for (name, block), rows in _blocks(frame):
            first = before = None
            for text_, own in zip(rows["text"], rows["role"], strict=True):
                for n, line in enumerate(read_piece(text_)):
                    state = ROLES.index(own) + len(ROLES) * (n > 0)
                    emit[state, line.code] += 1
                    if before is None:
                        first = state
                    else:
                        step[before, state] += 1
                    before = state
            ends.append((name, block, first, before))
        flat = np.concatenate((np.zeros(STATES), step.ravel(), emit.ravel()))
        used = np.flatnonzero(flat)
        out = pd.DataFrame(ends, columns=["conv", "block", "first", "last"]).astype({"first": "Int64", "last": "Int64"})
        return pd.concat((out, pd.DataFrame({"cell": used, "n": flat[used]})))[["conv", "block", "first", "last", "cell", "n"]]

    known, _ = _pieces(df.where(F.col(role).isin(*ROLES)), conv, place, text, F.col(role))
    counted = materialize(known.groupBy("bucket").applyInPandas(run, "conv string, block bigint, first bigint, last bigint, cell bigint, n double"))
    ends = counted.where("conv is not null").select("conv", "block", "first", "last")
    handed = forward_fill(ends, ["conv"], "block", ["last"]).selectExpr("conv", "block + 1 as block", f"coalesce(last, {STATES}) as before")
    borders = ends.where("first is not null").join(handed, ["conv", "block"], "left")
    # Without a line before it, a block begins its transcript: the first cells are those of the start.
    crossed = borders.selectExpr(f"if(coalesce(before, {STATES}) = {STATES}, first, {STATES} + before * {STATES} + first) as cell", "1D as n")
    cells = counted.where("cell is not null").select("cell", "n").unionByName(crossed).groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(STATES + STATES**2 + STATES * CODES)
    for row in cells.collect():  # no more rows than the model has cells
        flat[row["cell"]] = row["n"]
    start, step, emit = np.split(flat, [STATES, STATES + STATES**2])
    return Markov.counted(start, step.reshape(STATES, STATES), emit.reshape(STATES, CODES))


def _best_path(matrices: list[np.ndarray], before: int, last: int) -> list[int]:
    """States after each matrix, given the state before the first and after the last."""
    best, back = matrices[0][before], []
    for matrix in matrices[1:]:
        ways = best[:, None] + matrix[:STATES]
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    states = [last]
    for ways in reversed(back):
        states.append(int(ways[states[-1]]))
    return states[::-1]


def _product(matrices: list[np.ndarray]) -> np.ndarray:
    best = matrices[0]
    for matrix in matrices[1:]:
        best = (best[:, :, None] + matrix[None, :STATES, :]).max(axis=1)
    return best


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x).reshape(STATES + 1, STATES) for x in frame["matrix"]]


def _borders(blocks: DataFrame, conv_type: str) -> DataFrame:
    """(conv, block, before, last): the states at the borders of every block on the best way."""
    level = materialize(blocks)
    lower_levels = []
    while level.groupBy("conv").count().where("count > 1").limit(1).count():

        def up(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("block")
            row = frame.iloc[0]
            return pd.DataFrame({"conv": [row["conv"]], "block": [row["parent"]], "matrix": [_product(_matrices(frame)).tobytes()]})

        placed = level.withColumn("parent", F.floor(F.col("block") / FAN))
        siblings = placed.groupBy("conv", "parent").agg(F.count("*").alias("n"))
        lower = materialize(placed.join(siblings, ["conv", "parent"]))
        lower_levels.append(lower)
        level = materialize(
            lower.where("n > 1")
            .groupBy("conv", "parent")
            .applyInPandas(up, f"conv {conv_type}, block bigint, matrix binary")
            .unionByName(lower.where("n = 1").select("conv", F.col("parent").alias("block"), "matrix"))
        )

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            last = [int(m[STATES].argmax()) for m in _matrices(frame)]
            yield pd.DataFrame({"conv": frame["conv"], "block": frame["block"], "before": STATES, "last": last})

    schema = f"conv {conv_type}, block bigint, before int, last int"
    known = level.mapInPandas(top, schema)
    for lower in reversed(lower_levels):

        def down(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("block")
            last = _best_path(_matrices(frame), int(frame["before"].iloc[0]), int(frame["last"].iloc[0]))
            before = [int(frame["before"].iloc[0]), *last[:-1]]
            return pd.DataFrame({"conv": frame["conv"], "block": frame["block"], "before": before, "last": last})

        children = lower.join(known.withColumnRenamed("block", "parent"), ["conv", "parent"])
        # a block without siblings has the borders of its parent
        alone = children.where("n = 1").select("conv", "block", "before", "last")
        known = children.where("n > 1").groupBy("conv", "parent").applyInPandas(down, schema).unionByName(alone)
    return known


def parse(df: DataFrame, model: Markov, conv: str = "conv_id", place: str = "turn", text: str = "text") -> DataFrame:
    """One row per row of ``df``: conv_id, turn, role, n_lines, n_begun, rendered.

    ``role`` is that of the piece's first line, ``n_begun`` the turns that begin
    in the piece.  In ``rendered`` each of them is headed by ``<|role|>``, and its
    first line loses a speaker marker of that role; blank lines before a turn and
    at the end of a piece go, all other text stays.  The pieces of a conversation
    put together are its canonical form.  Pieces without a line (null, empty,
    blank) are rendered empty with a null role.  A row without a conversation or
    a place is a transcript of its own; pieces at one place, repeated rows too, follow
    each other in order of text.  Places may be any numbers.
    """
    pieces, groups = _pieces(df, conv, place, text)
    conv_type = df.schema[conv].dataType.simpleString()

    def sum_up(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (name, block), rows in _blocks(frame):
            codes = [line.code for t in rows["text"] for line in read_piece(t)]
            if codes:
                out.append((name, block, model.matrix(codes).tobytes()))
        return pd.DataFrame(out, columns=["conv", "block", "matrix"])

    blocks = pieces.groupBy("bucket").applyInPandas(sum_up, "conv string, block bigint, matrix binary")
    borders = _borders(blocks, "string").withColumn("bucket", _bucket(groups))

    def render(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        border = {(c, b): (x, y) for c, b, x, y in zip(known["conv"], known["block"], known["before"], known["last"], strict=True)}
        ids, out = [], []
        for (name, block), rows in _blocks(frame):
            read = [read_piece(t) for t in rows["text"]]
            codes = [line.code for own in read for line in own]
            states = model.decode(codes, *border[name, block]) if codes else []
            at = 0
            ids.append(rows[["conv_id", "turn"]])
            for own in read:
                mine = states[at : at + len(own)]
                at += len(own)
                role = ROLES[mine[0] % len(ROLES)] if mine else None
                said = "\n".join(line.rendered(s) for line, s in zip(own, mine, strict=True))
                out.append((role, len(own), sum(s < len(ROLES) for s in mine), said))
        told = pd.DataFrame(out, columns=["role", "n_lines", "n_begun", "rendered"])
        kept = pd.concat(ids, ignore_index=True) if ids else pd.DataFrame({"conv_id": [], "turn": []}, dtype=object)
        return pd.concat((kept, told), axis=1)

    schema = "conv_id string, turn string, role string, n_lines bigint, n_begun bigint, rendered string"
    rendered = pieces.groupBy("bucket").cogroup(borders.groupBy("bucket")).applyInPandas(render, schema)
    return rendered.withColumns({"conv_id": F.col("conv_id").cast(conv_type), "turn": F.col("turn").cast("bigint")})


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """The conversations as raw transcripts: speaker names in three styles, one of ten turns without, most after a blank line."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    chance = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100))

    def named(names: tuple[str, str, str]) -> Column:
        out = F.lit("")
        for role, name in zip(ROLES, names, strict=True):
            out = F.when(F.col("role") == role, name).otherwise(out)
        return out

    styles = (("System: ", "User: ", "Assistant: "), ("[instruction] ", "[human] ", "[bot] "), ("System: ", "Q: ", "A: "))
    name = F.when(style == 0, named(styles[0])).when(style == 1, named(styles[1])).otherwise(named(styles[2]))
    head = F.concat(F.when(chance % 5 > 0, "\n").otherwise(""), F.when(chance >= 10, name).otherwise(""))
    return conversations.withColumn("text", F.concat(head, F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    transcripts = as_transcripts(table(spark, sf_dir, "conversations"))
    model = fit(transcripts.where(fold("conv_id", FOLDS) != HELD_OUT))
    parsed = parse(transcripts, model)
    return parsed.withColumn("held_out", fold("conv_id", FOLDS) == HELD_OUT)
