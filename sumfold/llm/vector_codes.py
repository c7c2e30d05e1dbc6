"""Codes for vectors by product quantisation in whole numbers, nearest entries found behind lower bounds.

Components become floor(256 x). A vector is cut into equal parts, and each part's position has a codebook, which starts as that part
of the vectors with the smallest ids and is moved to the floor of its members' mean in each round.

A part's nearest entry is found from coarse to fine. For parts x and c cut into blocks of w components, with block
sums X and C and norms r and s of what is left when a block's mean is taken away,

    |x - c|^2  >=  sum over blocks of (X - C)^2 / w + (r - s)^2

First the part is one block; the exact distance to the entry of the least bound is an upper bound of the nearest
one's, and entries whose bound is above it drop out. Blocks are halved as long as they have more than one component. Bounds are
floating point and get an allowance for its errors; what is left at the end is compared by exact integer distances, ties by
the lower index. Codebooks are the only thing that the driver holds: a row per part, entry and component.

Defined cases: rows whose vector is null, or has a component that is null or not finite, are dropped; ids that are null or repeat
are coded like others, and for the codebooks null ids come last and rows of one id go by their vectors; equal vectors have equal
codes; with fewer vectors than entries there are as many entries as vectors; labels that are null are one label; an empty table gives no
rows; further columns are not looked at. Vectors of different lengths, lengths that the number of parts does not divide, and components so
large that distances would not fit 64 bits are errors; a long vector is coded by one task, some 2 million components at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import written

#: Components that a task looks at together.
_AT_ONCE = 1 << 21


def is_finite(vector: Column) -> Column:
    """Whether a vector is there, and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(batch: pa.Array, scale: int = 256) -> np.ndarray:
    """Vectors as rows of floor(scale x)."""
    lengths = set(batch.value_lengths().to_pylist())
    if len(lengths) != 1:
        raise ValueError("vectors must have one length")
    (width,) = lengths
    x = np.floor(batch.flatten().to_numpy(zero_copy_only=False).astype("f8") * scale).reshape(len(batch), width)
    if width and x.size and 4.0 * width * np.abs(x).max() ** 2 >= 2.0**62:
        raise ValueError("components are too large for distances of 64 bits")
    return x.astype("i8")


class Book:
    """A part's entries with their block sums and residual norms, from one block to blocks of two components."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width, self.levels = entries.shape[1], []
        blocks = 1
        while blocks <= max(1, width // 2):
            self.levels.append(self.blocks(entries, blocks))
            blocks *= 2

    @staticmethod
    def blocks(x: np.ndarray, blocks: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Block widths, and for each row of ``x`` the blocks' sums and the norms of what differs from their means."""
        cuts = [x.shape[1] * i // blocks for i in range(blocks + 1)]
        pieces = [x[:, i:j] for i, j in zip(cuts, cuts[1:])]
        widths = [max(1, p.shape[1]) for p in pieces]
        sums = np.stack([p.sum(1) for p in pieces], 1)
        norms = np.stack([np.sqrt(((p - s[:, None] / w) ** 2).sum(1)) for p, s, w in zip(pieces, sums.T, widths)], 1)
        return widths, sums, norms

    @staticmethod
    def bound(own: tuple, theirs: tuple, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distance of rows to entries, pair by pair."""
        widths, sums, norms = own
        out = np.zeros(len(rows))
        for b, w in enumerate(widths):
            out += (sums[rows, b] - theirs[1][cols, b]).astype("f8") ** 2 / w + (norms[rows, b] - theirs[2][cols, b]) ** 2
        return out

    def exact(self, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        d = x[rows] - self.entries[cols]
        return (d * d).sum(1)

    def nearest(self, x: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row; ``seen`` counts pairs, and exact distances among them."""
        n, k = len(x), len(self.entries)
        rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        low = self.bound(self.blocks(x, 1), self.levels[0], rows, cols)
        guess = low.reshape(n, k).argmin(1)
        most = self.exact(x, np.arange(n), guess)
        largest = max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0))
        allowed = most + 1e-9 * (float(largest) ** 2 * max(1, x.shape[1]) + 1)
        left = low <= allowed[rows]
        rows, cols = rows[left], cols[left]
        for i, level in enumerate(self.levels[1:], 1):
            left = self.bound(self.blocks(x, 1 << i), level, rows, cols) <= allowed[rows]
            rows, cols = rows[left], cols[left]
        exact = self.exact(x, rows, cols)
        if seen is not None:
            seen[0] += n * k
            seen[1] += n + len(rows)
        first = np.searchsorted(rows, np.arange(n))
        best = np.minimum.reduceat(exact, first) if n else exact
        hit = np.flatnonzero(exact == best[rows])
        return cols[hit[np.searchsorted(rows[hit], np.arange(n))]], best


@dataclass(frozen=True)
class Codebooks:
    """Entries by part; a vector's code has two hexadecimal digits per part."""

    entries: np.ndarray  # part, entry, component

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def assigned(self, x: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """By row and part: the nearest entry, and the squared distance to it."""
        if x.shape[1] != self.width:
            raise ValueError(f"vectors have {self.width} components, not {x.shape[1]}")
        step = self.entries.shape[2]
        found = [Book(e).nearest(x[:, i * step : (i + 1) * step], seen) for i, e in enumerate(self.entries)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decoded(self, code: str) -> np.ndarray:
        """The entries that a code names, put together."""
        return np.concatenate([e[int(code[2 * i : 2 * i + 2], 16)] for i, e in enumerate(self.entries)])


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            step = max(1, _AT_ONCE // max(1, len(batch.column(at).flatten()) // len(batch)))
            yield from (batch.slice(i, step) for i in range(0, len(batch), step))


def first_books(vectors: DataFrame, parts: int = 16, entries: int = 64, scale: int = 256) -> Codebooks | None:
    """The parts of the vectors (vec_id, embedding) with the smallest ids; none without vectors."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()  # ``entries`` rows at most
    if not len(first):
        return None
    x = whole(first["embedding"].combine_chunks(), scale)
    if x.shape[1] % parts:
        raise ValueError(f"{parts} parts do not divide {x.shape[1]} components")
    return Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy())


def moved(vectors: DataFrame, books: Codebooks, scale: int = 256) -> Codebooks:
    """Codebooks whose entries are the floor of their members' means; entries without members stay."""
    parts, entries, step = books.entries.shape
    known = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, step), "i8"), np.zeros((parts, entries), "i8")
        largest = 0
        for batch in _slices(batches, 0):
            x = whole(batch.column(0), scale)
            nearest, _ = known.value.assigned(x)
            for i in range(parts):
                np.add.at(sums[i], nearest[:, i], x[:, i * step : (i + 1) * step])
                counts[i] += np.bincount(nearest[:, i], minlength=entries)
            largest += int(np.abs(x).max(initial=0)) * len(x)
            if largest >= 1 << 61:
                yield partial(sums, counts)
                sums[:], counts[:], largest = 0, 0, 0
        yield partial(sums, counts)

    def partial(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part, entry = counts.nonzero()
        values = sums[part, entry]
        spread = lambda a: pa.array(np.repeat(a, step), pa.int32())
        return pa.RecordBatch.from_arrays([spread(part), spread(entry), pa.array(np.tile(np.arange(step), len(part)), pa.int32()), pa.array(values.reshape(-1)), pa.array(np.repeat(counts[part, entry], step))], names=["part", "entry", "at", "s", "n"])

    members = vectors.select("embedding").mapInArrow(add, "part int, entry int, at int, s bigint, n bigint")
    # a row per part, entry and component
    found = members.groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.sum("n").alias("n")).collect()
    new = books.entries.copy()
    for r in found:
        new[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return Codebooks(new)


def fitted(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of all vectors (vec_id, embedding; finite ones only), after ``rounds`` rounds. Each round reads the table once."""
    if entries > 256:
        raise ValueError("two hexadecimal digits name 256 entries")
    books = first_books(vectors, parts, entries, scale)
    for _ in range(rounds if books is not None else 0):
        books = moved(vectors, books, scale)
    return books


def coded(vectors: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error) of vectors (vec_id, label, embedding)."""
    known = vectors.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            nearest, distances = known.value.assigned(whole(batch.column(2), scale))
            text = nearest.astype("u1").tobytes().hex()
            codes = [text[i : i + 2 * nearest.shape[1]] for i in range(0, len(text), 2 * nearest.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(distances.sum(1))], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256."""
    vectors = table.select("vec_id", "label", "embedding").where(is_finite(F.col("embedding")))
    books = fitted(vectors, parts, entries, rounds, scale)
    if books is None:
        books = Codebooks(np.zeros((parts, 0, 0), "i8"))
    rows = written(coded(vectors, books, scale), "codes")
    # a row per label, which may be many
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def compressed_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """``compressed`` of ``embeddings`` with every distance taken."""

    def nearest(i: int) -> str:
        distance = "CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        return f"a{i} AS (SELECT r, p.part, min({distance} * {entries} + e) AS best FROM p JOIN c{i} AS c ON p.part = c.part GROUP BY r, p.part)"

    def move(i: int) -> str:
        # floors of negative quotients go down
        return f"""s{i} AS (SELECT a.part, best % {entries} AS e, j, CAST(sum(p.x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} AS a JOIN p ON a.r = p.r AND a.part = p.part, unnest(generate_series(1, len(p.x))) AS u(j) GROUP BY 1, 2, 3),
m{i} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{i} GROUP BY part, e),
c{i + 1} AS (SELECT part, e, coalesce(m{i}.x, c.x) AS x FROM c{i} AS c LEFT JOIN m{i} USING (part, e))"""

    steps = ",\n".join(f"{nearest(i)},\n{move(i)}" for i in range(rounds))
    finite = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {finite}),
p AS (SELECT r, CAST(part AS BIGINT) AS part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) AS g(part)),
c0 AS (SELECT part, r - 1 AS e, x FROM p WHERE r <= {entries}),
{steps},
{nearest(rounds)},
b AS (SELECT r, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN b USING (r), h"""
