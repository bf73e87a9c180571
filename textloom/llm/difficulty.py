"""Problem 8: reading difficulty from 1 to 5, by harmonic propagation on the document-word graph.

Documents and words (single words and pairs, hashed to a fixed number of word nodes) are the two
sides of the graph; an edge weighs as often as the word stands in the document.  Graded documents are
clamped to their grades; a word counts less while few documents tell of it.  In each round every word takes the
mean of its documents and every document the mean of its words, both weighted; then the scale, which such
means shrink, is put back by a straight line fitted on the graded documents.  Rounds go on until the words'
values hardly change.  A round reads the stored graph once: tasks sum up the word side for their documents in
arrays of fixed size, which are added in two steps.  At the end a cubic fitted on the graded documents takes the
place of the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep
from .fold import fold, grams
from .overlap import slices

NODES, ROUNDS, SETTLED, MIN_WORDS, SEGMENTS, SPREAD, DOUBT, PRIOR, SCALES, FAR = 1 << 16, 30, 0.001, 50, 16, 512, 20.0, 2, 64, 0.75
#: A row of a table, and an entry of a list that ends in a figure.
_TABLE = re.compile(r"^[^\n|]*\|[^\n|]*\|[^\n]*$", re.M)
_ENTRY = re.compile(r"^[ \t]*(?:\(?\d+[.)]|[-–+•*])?[^\n]{0,160}?[:\t–-][ \t]*\d[\d., ]*[ \t]*$", re.M)
_FIGURE = re.compile(r"\d[ \t]*$", re.M)


def running_text(text: str | None) -> str:
    """``text`` without rows of tables and entries of lists."""
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    if "|" in text:
        text = _TABLE.sub(" ", text)
    if _FIGURE.search(text):
        text = _ENTRY.sub(" ", text)
    return text


def _edges(nodes: int, min_words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                run = [running_text(t) for t in texts[a:b]]
                shorter = [i for i, (t, r) in enumerate(zip(texts[a:b], run)) if t and len(r) < 0.9 * len(t)]
                w = fold(run)
                n = np.diff(w.first)
                enough = n >= min_words
                if shorter:
                    full = np.diff(fold([texts[a + i] for i in shorter]).first)
                    enough[shorter] &= n[shorter] * 2 >= full  # mostly tables or entries: no running text
                pairs = grams(w.hash, 2)
                inside = w.row[: pairs.size] == w.row[1:]
                row = np.concatenate([w.row, w.row[: pairs.size][inside]])
                node = np.concatenate([w.hash, pairs[inside]]) & np.uint64(nodes - 1)
                code = np.sort((row << np.int64(32)) | node.astype(np.int64))
                edge = np.flatnonzero(np.diff(code, prepend=-1))
                count, code = np.diff(np.append(edge, code.size)), code[edge]
                if count.size and count.max() > 65535:  # an edge of more is several edges
                    parts = -(-count // 65535)
                    last = np.cumsum(parts) - 1
                    rest, code = count - 65535 * (parts - 1), np.repeat(code, parts)
                    count = np.full(code.size, 65535)
                    count[last] = rest
                count = count.astype(np.uint16)
                cut = np.searchsorted(code, np.arange(b - a + 1, dtype=np.int64) << np.int64(32))
                words = (code & 0xFFFFFFFF).astype(np.uint32)
                picked = np.flatnonzero(enough)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(a + picked)), batch.column(2).take(pa.array(a + picked)),
                    pa.array(
                        [words[cut[i] : cut[i + 1]].tobytes() for i in picked], pa.binary()
                    ), pa.array([count[cut[i] : cut[i + 1]].tobytes() for i in picked], pa.binary()),
                ], ["id", "scale", "words", "counts"])

    return build


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = batch.column("words").to_pylist()
    sizes = np.fromiter((len(x) // 4 for x in words), np.int64, len(words))
    counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint16).astype(np.float64)
    return np.frombuffer(b"".join(words), np.uint32).astype(np.int64), counts, np.repeat(np.arange(len(words)), sizes)


def _scores(words, counts, row, grade: np.ndarray, s: "State") -> np.ndarray:
    """Weighted means of the documents' words; graded documents don't count in their own words' values."""
    total, mass = s.total[words], s.mass[words]
    if not np.isnan(grade).all():
        own = np.where(np.isnan(grade), 0.0, 1.0)[row] * counts
        total, mass = total - own * np.nan_to_num(grade)[row], mass - own
    mass = np.maximum(mass, 0)
    weight = counts * mass / (mass + s.doubt)
    value = np.where(mass > 1e-3, total / np.maximum(mass, 1e-3), s.mean)
    over, under = np.bincount(row, weight * value, grade.size), np.bincount(row, weight, grade.size)
    return np.where(under > 0, over / np.maximum(under, 1e-12), s.mean)


class State:
    """What is sent to the tasks of a round: the word side, and the line that maps means to grades."""

    def __init__(self, nodes: int, mean: float):
        self.total, self.mass, self.mean, self.doubt = np.zeros(nodes), np.zeros(nodes), mean, DOUBT
        self.lines = np.array([[0.0, 1.0]])  # one for each scale

    def change(self, last: "State") -> float:
        """Mean change of the words' values."""
        value = lambda s: s.total / np.maximum(s.mass, 1e-9)
        return float(np.average(np.abs(value(self) - value(last)), weights=self.mass))


def _moments(state):
    """Sums of powers of the graded documents' means, and of those by grades."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: State = state.value
        sums: dict[int, np.ndarray] = {}
        for batch in _small(batches):
            words, counts, row = _unpacked(batch)
            scale = batch.column("scale").to_numpy(zero_copy_only=False)
            y = batch.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
            z = _scores(words, counts, row, y, s) - s.mean
            for g in np.unique(scale):
                x, v = z[scale == g], y[scale == g]
                sums[int(g)] = sums.get(int(g), 0) + np.array([*(np.sum(x**k) for k in range(7)), *(np.sum(v * x**k) for k in range(4))])
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array(list(sums), pa.int32()), "task": pa.array([_task()] * len(sums), pa.int32()),
            "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())
        })

    return step


def _round(state, nodes: int, only_graded: bool):
    """The word side's sums over the documents of a task: their scores, or in the first round their grades."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: State = state.value
        total, mass = np.zeros(nodes), np.zeros(nodes)
        for batch in _small(batches):
            words, counts, row = _unpacked(batch)
            score = batch.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
            if not only_graded:
                raw = _scores(words, counts, row, np.full(score.size, np.nan), s)
                line = s.lines[batch.column("scale").to_numpy(zero_copy_only=False)]
                score = np.where(np.isnan(score), np.clip(line[:, 0] + line[:, 1] * raw, 0.5, 5.5), score)
            total += np.bincount(words, counts * score[row], nodes)
            mass += np.bincount(words, counts, nodes)
        if mass.any():
            t, m = total.reshape(SEGMENTS, -1), mass.reshape(SEGMENTS, -1)
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array(range(SEGMENTS), pa.int32()), "task": pa.array([_task()] * SEGMENTS, pa.int32()),
                "sums": pa.array([np.concatenate(x).tobytes() for x in zip(t, m)], pa.binary())
            })

    return step


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() % SPREAD if context else 0


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums"))
    return pa.table({"segment": table.column("segment")[:1], "task": table.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def added(parts: DataFrame) -> DataFrame:
    """Arrays of (segment, task, sums) added by segment, first those of some tasks each: no task gathers the arrays of all."""
    schema = "segment int, task int, sums binary"
    return parts.groupBy("segment", "task").applyInArrow(_add, schema).groupBy("segment").applyInArrow(_add, schema)


def _fit(moments: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients, lowest first, of the least-squares polynomial with the given sums of powers."""
    a = np.array([[moments[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    size = np.sqrt(np.maximum(np.diag(a), 1e-12))  # powers differ in size by far
    a = a / size[:, None] / size + 1e-9 * np.eye(degree + 1)
    return np.linalg.solve(a, moments[7 : 8 + degree] / size) / size


def reading_levels(
    documents: DataFrame, id_column: str, text_column: str, grades: DataFrame, grade_column: str, scale: Column | None = None, rounds: int = ROUNDS,
    nodes: int = NODES, min_words: int = MIN_WORDS
) -> DataFrame:
    """(id, score, reading_level): a level from 1 to 5 for each document with enough running text.

    ``grades`` (the same id column, ``grade_column``) may grade a document more than once: the mean
    counts; NULL grades and grades outside 1 to 5 don't.  A document whose text is under
    ``min_words`` words without tables and lists of figures, or mostly those, or NULL, gets no row.
    ``scale`` (a few values, such as languages) names groups of documents between which few words are
    shared: each gets its own line and cubic, drawn towards the common one as by ``PRIOR`` more graded documents.
    A graded document keeps its grade unless its score, from the other documents' words, is ``FAR`` levels away: such
    grades are taken for mistakes.  Rounds end when the words' values change by less than ``SETTLED`` in the mean, or
    after ``rounds``.  Without any grade there is no scale and no row.
    """
    spark = documents.sparkSession
    part = F.coalesce(scale.cast("string"), F.lit("")) if scale is not None else F.lit("")
    names = sorted(r[0] for r in documents.select(part.alias("part")).distinct().limit(SCALES + 1).collect())
    if len(names) > SCALES:
        raise ValueError(f"more than {SCALES} scales")
    number = F.coalesce(
        F.array_position(F.array(*[F.lit(n) for n in names]), F.col("part")) - 1, F.lit(0)
    ).cast("int") if names else F.lit(0).cast("int")
    marks = grades.where(F.col(grade_column).between(1, 5)).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.avg(grade_column).alias("grade"))
    rows = documents.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), part.alias("part")
    ).select("id", "text", number.alias("scale"))
    edges = rows.mapInArrow(_edges(nodes, min_words), "id long, scale int, words binary, counts binary")
    graph = keep(edges.join(marks, "id", "left").select("id", "words", "counts", "grade", "scale"), "reading-graph")
    mean = graph.agg(F.avg("grade")).first()[0]
    if mean is None:
        return spark.createDataFrame([], "id long, score double, reading_level int")
    graded = keep(graph.where(F.col("grade").isNotNull()), "reading-graded")
    state = State(nodes, float(mean))
    schema = "segment int, task int, sums binary"

    def summed(rows: DataFrame, step) -> dict[int, np.ndarray]:
        parts = rows.select("words", "counts", "grade", "scale").mapInArrow(step, schema)
        return {r["segment"]: np.frombuffer(r["sums"], np.float64) for r in added(parts).collect()}  # arrays of fixed size

    for k in range(rounds):
        sent = spark.sparkContext.broadcast(state)
        got = summed(graph if k else graded, _round(sent, nodes, not k))
        sent.unpersist()
        last, state, width = state, State(nodes, float(mean)), nodes // SEGMENTS
        for i, x in got.items():
            state.total[i * width : (i + 1) * width], state.mass[i * width : (i + 1) * width] = x[:width], x[width:]
        sent = spark.sparkContext.broadcast(state)
        moments = summed(graded, _moments(sent))
        sent.unpersist()
        every = sum(moments.values())
        own = [moments.get(g, 0) + every * (PRIOR / every[0]) for g in range(len(names) + 1)]
        fits = np.array([_fit(m, 1) for m in own])
        state.lines = np.column_stack([fits[:, 0] - fits[:, 1] * state.mean, fits[:, 1]])
        if k > 1 and state.change(last) < SETTLED:
            break
    cubic = np.array([_fit(m, 3) for m in own])
    final = spark.sparkContext.broadcast((state, cubic))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, cubics = final.value
        for batch in _small(batches):
            words, counts, row = _unpacked(batch)
            grade = batch.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
            z = _scores(words, counts, row, grade, s) - s.mean
            c = cubics[batch.column("scale").to_numpy(zero_copy_only=False)]
            level = np.clip(c[:, 0] + c[:, 1] * z + c[:, 2] * z**2 + c[:, 3] * z**3, 0.5, 5.5)
            stands = ~np.isnan(grade) & (np.abs(level - grade) < FAR)
            out = np.where(stands, (level + 2 * np.nan_to_num(grade)) / 3, level)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(level), pa.array(np.clip(np.rint(out), 1, 5).astype(np.int32))], ["id", "score", "reading_level"]
            )

    return graph.mapInArrow(score, "id long, score double, reading_level int")
