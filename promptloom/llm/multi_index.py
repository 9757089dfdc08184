"""Problem 2: the most similar vectors for every vector, by an inverted multi-index.

Both halves of a vector are quantised separately; the pair of nearest centroids is its cell. A query walks the
pairs of centroids by summed distance with a heap until the cells it has met hold enough entries, and all of
those are compared exactly. Cells lie in large blocks of even size, neighbours together; an entry asks for itself where
it is stored, so only queries that reach into other blocks travel, with the distance they reach and nothing else.
While there are fewer blocks than cores, several tasks share the queries of a block, each with all of its entries.
Only codebooks, the size of every cell and its block are broadcast, which are bounded by the number of centroids.
Cells that hold many entries, as they do once the codebooks have reached their bound, have an index of their own.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.runtime import key128, materialize, spread


@dataclass(frozen=True)
class IndexSettings:
    """How the index is built and read; every entry is indexed whatever the sample."""

    dim: int = 64
    k: int = 5
    #: Entries a cell holds on average; with it the number of centroids per half follows the data, up to the cap.
    per_cell: float = 1.5
    #: Centroids per half of the first level; beyond it cells grow and are indexed again, each by itself.
    max_centroids: int = 1024
    #: Vectors per centroid, and at most, on which the codebooks are fitted.
    sample_per_centroid: int = 48
    max_sample: int = 50_000
    iterations: int = 10
    #: A query stops after this many entries met, but not before this many cells.
    candidates: int = 96
    least_cells: int = 24
    #: Entries that one task holds at a time, and how few still make a block of their own on a large cluster.
    block_entries: int = 400_000
    least_block: int = 20_000
    #: Tasks that may share the queries of a block, each with its entries, while there are fewer blocks than cores.
    most_slices: int = 8
    #: A cell with more entries gets an index of its own, by the same method, on what is left after its mean.
    crowded_cell: int = 512
    #: Parts of a cell larger than a block that a query visits.
    probes: int = 3


def fit_codebook(points: np.ndarray, count: int, iterations: int, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's iterations from distinct random points; unused ones are moved to crowded places."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    if len(points) <= count:
        return points.astype(np.float32)
    centroids = points[rng.choice(len(points), count, replace=False)].astype(np.float32)
    for _ in range(iterations):
        nearest = nearest_centroids(points, centroids)
        sizes = np.bincount(nearest, minlength=count)
        order = nearest.argsort(kind="stable")
        used = sizes > 0
        sums = np.zeros((count, points.shape[1]), dtype=np.float64)
        sums[used] = np.add.reduceat(points[order].astype(np.float64), (np.cumsum(sizes) - sizes)[used], axis=0)
        centroids[used] = (sums[used] / sizes[used, None]).astype(np.float32)
        if not used.all():
            centroids[~used] = points[rng.choice(len(points), int((~used).sum()), replace=False)]
    return centroids


def half_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids * centroids).sum(axis=1)[None, :] - 2.0 * (points @ centroids.T)


def nearest_centroids(points: np.ndarray, centroids: np.ndarray, step: int = 8192) -> np.ndarray:
    return np.concatenate([half_distances(points[i : i + step], centroids).argmin(axis=1) for i in range(0, len(points), step)] or [np.empty(0, np.int64)])


def visit_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, candidates: int, least_cells: int) -> tuple[list[int], float]:
    """Non-empty cells in order of summed distance until they hold enough entries, and the distance reached.

    ``first`` and ``second`` are a query's distances to the centroids of each half, ``sizes[i, j]`` the entries per cell.
    """
    order1, order2 = first.argsort(), second.argsort()
    d1, d2 = first[order1].tolist(), second[order2].tolist()
    order1, order2 = order1.tolist(), order2.tolist()
    n1, n2, width = len(d1), len(d2), sizes.shape[1]
    heap = [(d1[0] + d2[0], 0, 0)]
    out: list[int] = []
    met = visited = 0
    reach = 0.0
    while heap:
        reach, a, b = heapq.heappop(heap)
        visited += 1
        i, j = order1[a], order2[b]
        size = sizes[i, j]
        if size:
            out.append(i * width + j)
            met += size
        if met >= candidates and visited >= least_cells:
            break
        if b + 1 < n2:
            heapq.heappush(heap, (d1[a] + d2[b + 1], a, b + 1))
        if b == 0 and a + 1 < n1:
            heapq.heappush(heap, (d1[a + 1] + d2[0], a + 1, 0))
    return out, reach


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, vec)`` of the rows whose vector has ``dim`` finite values that are not all zero; vec is float32 bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=-1)
            at = np.flatnonzero(lengths == dim)
            starts = vectors.offsets.to_numpy()[at]
            values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            matrix = values[starts[:, None] + np.arange(dim)] if len(at) else np.empty((0, dim), np.float32)
            good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
            matrix = np.ascontiguousarray(matrix[good]) + np.float32(0.0)  # minus zero becomes zero
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[good])), pa.array([r.tobytes() for r in matrix], pa.binary())], ["id", "vec"])

    base = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    return base.mapInArrow(packed, "id string, vec binary")


def _raw(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of float32 bytes, where they lie."""
    if not len(column):
        return np.empty((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.float32, offset=int(offsets[0]), count=len(column) * dim).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    wide = raw.astype(np.float64)
    if len(wide):
        wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


@dataclass
class Codebooks:
    """Broadcast part of the index: centroids, entries per cell and the block of every cell.

    A cell larger than a block is cut in parts around centroids of its own; ``block`` is -1 there and ``parts`` holds
    the number of its first part and these centroids.
    """

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray | None = None
    block: np.ndarray | None = None
    parts: dict[int, tuple[int, np.ndarray]] = field(default_factory=dict)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        points = unit.astype(np.float32)
        return nearest_centroids(points[:, :half], self.first) * len(self.second) + nearest_centroids(points[:, half:], self.second)

    def parts_near(self, cell: int, unit: np.ndarray, probes: int) -> np.ndarray:
        """Blocks of a divided cell around the centroids nearest to a vector, nearest first."""
        base, centroids = self.parts[cell]
        return base + half_distances(unit[None, :].astype(np.float32), centroids)[0].argsort(kind="stable")[:probes]


def fit_codebooks(vectors: DataFrame, total: int, settings: IndexSettings) -> tuple[Codebooks, np.ndarray]:
    """Codebooks from a bounded sample, and that sample; rows are chosen by the hash of their id, so runs repeat."""
    count = int(min(settings.max_centroids, max(2, math.sqrt(total / settings.per_cell))))
    share = min(1.0, min(settings.max_sample, settings.sample_per_centroid * count) / max(1, total))
    grid = 1_000_000_000
    few = vectors.where(F.pmod(F.xxhash64("id"), F.lit(grid)) < int(math.ceil(share * grid))).select("id", "vec").mapInArrow(_few_copies(1), "id string, vec binary")
    sample = _unit(_raw(few.select("vec").toArrow().column(0).combine_chunks(), settings.dim)).astype(np.float32)
    sample = sample[np.lexsort(sample.T[:3])]
    half = settings.dim // 2
    return Codebooks(fit_codebook(sample[:, :half], count, settings.iterations), fit_codebook(sample[:, half:], count, settings.iterations)), sample


def _few_copies(most: int):
    """Of equal vectors of a batch only those with the ``most`` smallest ids, so that a hot vector stays small everywhere."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(_kept(batch, most))

    return thin


def _kept(batch: pa.RecordBatch, most: int) -> pa.Array:
    ids, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    again = {v for v, n in Counter(vecs).items() if n > most}
    if not again:
        return pa.array(range(len(vecs)), pa.int64())
    held: dict[bytes, list[tuple[str, int]]] = {}
    for i, v in enumerate(vecs):
        if v in again:
            held.setdefault(v, []).append((ids[i] or "", i))
    gone = {i for rows in held.values() for _, i in sorted(rows)[most:]}
    return pa.array([i for i in range(len(vecs)) if i not in gone], pa.int64())


def _count_cells(books, settings: IndexSettings):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Counter()
        for batch in batches:
            if batch.num_rows:
                sizes.update(books.value.cells(_unit(_raw(batch.take(_kept(batch, settings.k + 1)).column(1), settings.dim))).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["cell", "n"])

    return count


def place_cells(books: Codebooks, sizes: np.ndarray, sample: np.ndarray, settings: IndexSettings, blocks: int) -> int:
    """Give every cell a block, in place, and return how many blocks there are.

    Non-empty cells are halved by their entries along the direction in which the centroids of one half differ most,
    again and again, so that blocks are even and hold neighbours. Cells larger than a block are divided instead.
    """
    width = len(books.second)
    books.sizes = sizes.reshape(len(books.first), width)
    books.block = np.full(len(sizes), -1, dtype=np.int32)
    large = np.flatnonzero(sizes > settings.block_entries)
    small = np.flatnonzero((sizes > 0) & (sizes <= settings.block_entries))
    used = 0
    todo = [(small, max(1, min(blocks, len(small))))] if len(small) else []
    while todo:
        cells, n = todo.pop()
        if n == 1 or len(cells) == 1:
            books.block[cells] = used
            used += 1
            continue
        weight = sizes[cells].astype(np.float64)
        sides = [_main_direction(book, at, weight) for book, at in ((books.first, cells // width), (books.second, cells % width))]
        order = max(sides, key=lambda side: side[0])[1].argsort(kind="stable")
        filled = np.cumsum(weight[order])
        cut = min(max(1, int(np.searchsorted(filled, filled[-1] * (n // 2) / n)) + 1), len(cells) - 1)
        todo += [(cells[order[:cut]], n // 2), (cells[order[cut:]], n - n // 2)]
    if len(large):
        home = books.cells(sample)
        for cell in large.tolist():
            inside = sample[home == cell]
            wanted = -(-2 * int(sizes[cell]) // settings.block_entries)
            centroids = fit_codebook(inside, wanted, settings.iterations) if len(inside) else np.concatenate([books.first[cell // width], books.second[cell % width]])[None, :]
            books.parts[cell] = (used, centroids)
            used += len(centroids)
    return used


def _main_direction(book: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Variance along the main direction of the centroids ``at``, and where each lies along it."""
    total = np.bincount(at, weights=weight, minlength=len(book))
    centred = book - np.average(book, axis=0, weights=total)
    values, vectors = np.linalg.eigh((centred * total[:, None]).T @ centred)
    return float(values[-1]), (centred @ vectors[:, -1])[at]


def _slice_of(vec: bytes, slices: int) -> int:
    return zlib.crc32(vec) % slices


def _visits(books, settings: IndexSettings, slices: int, stored: bool):
    """Rows for the slices of blocks: entries with the distance they reach for all of their own block, queries for one of any other."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        half, block = settings.dim // 2, b.block
        for batch in batches:
            batch = batch.take(_kept(batch, settings.k + 1 if stored else 1))
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                raw = _raw(part.column(1), settings.dim)
                wide = _unit(raw)
                unit = wide.astype(np.float32)
                home = b.cells(wide)
                vecs = part.column(1).to_pylist()
                d1, d2 = half_distances(unit[:, :half], b.first), half_distances(unit[:, half:], b.second)
                rows, where, kinds, reached = [], [], [], []
                for q in range(len(unit)):
                    met, reach = visit_cells(d1[q], d2[q], b.sizes, settings.candidates, settings.least_cells)
                    mine = int(block[home[q]])
                    if mine < 0 and stored:
                        mine = int(b.parts_near(int(home[q]), wide[q], 1)[0])
                    found = {mine} if stored else set()
                    for cell in met:
                        at = int(block[cell])
                        if at >= 0:
                            found.add(at)
                        else:
                            found.update(b.parts_near(cell, wide[q], settings.probes).tolist())
                    for at in found:
                        own = stored and at == mine
                        for piece in range(slices) if own else (_slice_of(vecs[q], slices),):
                            rows.append(q)
                            where.append(at * slices + piece)
                            kinds.append(0 if own else 1)
                            reached.append(reach)
                kind = np.array(kinds, dtype=np.int8)
                at = pa.array(rows, pa.int64())
                ids = part.column(0).take(at) if stored else pa.nulls(len(rows), pa.string())
                ids = pa.compute.if_else(pa.array(kind == 0), ids, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(kind), part.column(1).take(at), ids, pa.array(reached, pa.float32())], ["slot", "kind", "vec", "id", "reach"])

    return visit


class _Crowd:
    """Second level for a cell that holds many entries: a multi-index of their differences from the mean."""

    def __init__(self, unit: np.ndarray, start: int, settings: IndexSettings) -> None:
        self.settings, self.half = settings, settings.dim // 2
        self.mean = unit.mean(axis=0)
        self.scale = float(np.abs(unit - self.mean).max()) or 1.0
        rest = self._rest(unit)
        count = int(min(settings.max_centroids, max(2, math.sqrt(len(unit) / settings.per_cell))))
        sample = rest[:: max(1, len(rest) // (settings.sample_per_centroid * count))]
        self.books = [fit_codebook(sample[:, : self.half], count, settings.iterations), fit_codebook(sample[:, self.half :], count, settings.iterations)]
        width = len(self.books[1])
        cell = nearest_centroids(rest[:, : self.half], self.books[0]) * width + nearest_centroids(rest[:, self.half :], self.books[1])
        order = cell.argsort(kind="stable")
        self.at = order + start
        self.bounds = np.searchsorted(cell[order], np.arange(len(self.books[0]) * width + 1))
        self.sizes = np.diff(self.bounds).reshape(len(self.books[0]), width)

    def _rest(self, unit: np.ndarray) -> np.ndarray:
        return ((unit - self.mean) / self.scale).astype(np.float32)

    def near(self, unit: np.ndarray) -> np.ndarray:
        rest = self._rest(unit[None, :])
        d1, d2 = half_distances(rest[:, : self.half], self.books[0])[0], half_distances(rest[:, self.half :], self.books[1])[0]
        cells, _ = visit_cells(d1, d2, self.sizes, self.settings.candidates, self.settings.least_cells)
        return np.concatenate([self.at[self.bounds[c] : self.bounds[c + 1]] for c in cells])


class _Block:
    """Entries of one block by cell, ready for exact comparison."""

    #: Queries compared in one step, and the slack within which single precision may order two entries wrongly.
    STEP, SLACK = 512, 4e-6

    def __init__(self, rows: list[tuple[list[bytes], np.ndarray, np.ndarray]], books: Codebooks, settings: IndexSettings) -> None:
        ids = [i for part, _, _ in rows for i in part]
        raw = np.concatenate([part for _, part, _ in rows])
        reach = np.concatenate([part for _, _, part in rows])
        order = sorted(range(len(ids)), key=ids.__getitem__)
        seen: Counter = Counter()
        kept = []
        for n, i in enumerate(order):  # a repeated row is the same entry, and more copies of a vector are never needed
            key = raw[i].tobytes()
            if (n and ids[order[n - 1]] == ids[i]) or seen[key] > settings.k:
                continue
            seen[key] += 1
            kept.append(i)
        at = np.array(kept, dtype=np.int64)
        cell = np.concatenate([books.cells(_unit(raw[at[low : low + 8192]])) for low in range(0, len(at), 8192)])
        by_cell = cell.argsort(kind="stable")
        at, cell = at[by_cell], cell[by_cell]
        self.books, self.settings = books, settings
        self.rank = by_cell  # ids are in order before the cells are
        self.ids = [ids[i] for i in at]
        self.raw = raw[at]
        self.reach = reach[at]
        self.scale = np.concatenate([1.0 / np.linalg.norm(self.raw[low : low + 8192].astype(np.float64), axis=1) for low in range(0, len(at), 8192)]).astype(np.float32)
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.start, self.end = starts, np.append(starts[1:], len(cell))
        width = len(books.second)
        self.cell_row, self.cell_col = cell[starts] // width, cell[starts] % width
        self.row_values = np.unique(self.cell_row)
        self.row_start = np.searchsorted(self.cell_row, self.row_values)
        self.row_end = np.append(self.row_start[1:], len(starts))
        self.crowds = {int(c): _Crowd(_unit(self.raw[a:b]), a, settings) for c, (a, b) in enumerate(zip(starts, self.end)) if b - a > settings.crowded_cell}

    def own(self, slices: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries of a slice as queries, each vector once."""
        seen: set[bytes] = set()
        first = [i for i in range(len(self.raw)) if _slice_of(key := self.raw[i].tobytes(), slices) == piece and key not in seen and not seen.add(key)]
        for low in range(0, len(first), self.STEP):
            yield self.raw[first[low : low + self.STEP]], self.reach[first[low : low + self.STEP]]

    def best(self, raw: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        """``(query, records)`` of the nearest entries of the cells within reach of each query.

        A record is four bytes that order by falling similarity, and the id.
        """
        wide = _unit(raw)
        unit = wide.astype(np.float32)
        half, k = self.settings.dim // 2, self.settings.k + 1
        d1 = half_distances(unit[:, :half], self.books.first)
        d2 = half_distances(unit[:, half:], self.books.second)
        queries, nears = [], []
        for q in range(len(raw)):
            limit = reach[q] + np.float32(1e-5)
            rows = np.flatnonzero(d1[q, self.row_values] + d2[q].min() <= limit)
            spans = []
            for r in rows.tolist():
                low, high = self.row_start[r], self.row_end[r]
                inside = np.flatnonzero(d2[q, self.cell_col[low:high]] <= limit - d1[q, self.row_values[r]]) + low
                for c in inside.tolist():
                    spans.append(self.crowds[c].near(wide[q]) if c in self.crowds else np.arange(self.start[c], self.end[c]))
            if spans:
                near = np.concatenate(spans)
                queries.append(np.full(len(near), q))
                nears.append(near)
        if not nears:
            return
        query, near = np.concatenate(queries), np.concatenate(nears)
        rough = np.einsum("ij,ij->i", self.raw[near], unit[query]) * self.scale[near]
        order = np.lexsort((-rough, query))
        query, near, rough = query[order], near[order], rough[order]
        begins = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        lengths = np.diff(np.append(begins, len(query)))
        least = np.repeat(rough[begins + np.minimum(k, lengths) - 1], lengths)
        close = rough >= least - self.SLACK
        query, near = query[close], near[close]
        score = np.rint(np.einsum("ij,ij->i", _unit(self.raw[near]), wide[query]) * 1e6).astype(np.int64)
        order = np.lexsort((self.rank[near], -score, query))
        query, near, far = query[order].tolist(), near[order].tolist(), (1_000_000 - score[order]).tolist()
        low = 0
        while low < len(query):
            high = low
            while high < len(query) and query[high] == query[low]:
                high += 1
            yield query[low], [far[i].to_bytes(4, "big") + self.ids[near[i]] for i in range(low, min(low + k, high))]
            low = high


def _scan(books, settings: IndexSettings, slices: int):
    """Rows sorted by slot and kind: entries are gathered first, then they and every query are compared with them."""

    def answers(index: _Block, raw: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
        found = list(index.best(raw, reach))
        return pa.RecordBatch.from_arrays([pa.array([raw[q].tobytes() for q, _ in found], pa.binary()), pa.array([r for _, r in found], pa.list_(pa.binary()))], ["vec", "best"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = -1
        held: list[tuple[list[bytes], np.ndarray, np.ndarray]] = []
        index: _Block | None = None

        def opened() -> Iterator[pa.RecordBatch]:
            nonlocal index, held
            if held:
                index, held = _Block(held, books.value, settings), []
                for raw, reach in index.own(slices, here % slices):
                    yield answers(index, raw, reach)

        for batch in batches:
            slot, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((slot[1:] != slot[:-1]) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip(np.append(0, change).tolist(), np.append(change, len(slot)).tolist()):
                if low == high:
                    continue
                if int(slot[low]) != here:
                    yield from opened()
                    here, held, index = int(slot[low]), [], None
                part = batch.slice(low, high - low)
                raw, reach = _raw(part.column(2), settings.dim), part.column(4).to_numpy()
                if kind[low] == 0:
                    held.append((part.column(3).to_pylist(), raw.copy(), reach.copy()))
                    continue
                yield from opened()
                if index is not None:
                    for at in range(0, len(raw), _Block.STEP):
                        yield answers(index, raw[at : at + _Block.STEP], reach[at : at + _Block.STEP])
        yield from opened()

    return scan


def _merge(settings: IndexSettings):
    """Rows sorted by vector: what the blocks found is put together, then every id that asks with the vector gets its share."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        pool: list[bytes] = []
        top: list[bytes] | None = None
        before: tuple | None = None
        for batch in batches:
            out: list[tuple[str, bytes, bytes, int]] = []
            for k1, k2, side, asked, best in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (k1, k2) != here:
                    here, pool, top, before = (k1, k2), [], None, None
                if asked is None:
                    pool.extend(best)
                    continue
                if top is None:
                    top = sorted(set(pool))[: settings.k + 1]
                if (side, asked) == before:
                    continue
                before = (side, asked)
                others = top if side != "entry" else [t for t in top if t[4:] != asked]
                out.extend((side, asked, t[4:], 1_000_000 - int.from_bytes(t[:4], "big")) for t in others[: settings.k])
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary(), pa.int32()))], ["side", "query", "neighbour", "score"])

    return merge


_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _packed_id(name: Column, short: bool) -> Column:
    """An id as bytes in the same order; identifiers in the common form of 32 hexadecimal digits take 16 bytes."""
    return F.unhex(F.replace(name, F.lit("-"), F.lit(""))) if short else F.encode(name, "UTF-8")


def _plain_id(packed: Column, short: bool) -> Column:
    if not short:
        return F.decode(packed, "UTF-8")
    digits = F.lower(F.hex(packed))
    return F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _hot_vectors(counts: DataFrame, total: int, share: int = 200) -> list[tuple[int, int]]:
    """Vectors with more than 1/``share`` of the askers: at most ``share`` of them whatever the data."""
    return [(r.k1, r.k2) for r in counts.where(F.col("n") > max(1, total // share)).select("k1", "k2").collect()]


def nearest_entries(entries: DataFrame, others: DataFrame, settings: IndexSettings = IndexSettings()) -> DataFrame:
    """The ``k`` most similar entries of every entry and of every other query: ``(side, query_id, neighbour_id, similarity)``.

    ``entries`` is ``(id, vec)`` and ``others`` ``(side, query_id, vec)`` as :func:`usable_vectors` packs them. The entries
    themselves are queries of side ``entry`` and are not their own neighbours. Similarity is the cosine, rounded to six
    decimals; equal ones are taken by the smaller id. Of equal vectors those with the smallest ids are kept where they
    are read, so many copies of one cost little, and an entry given twice is one entry; a query delivered with
    several vectors is asked with one of them. With fewer than ``k`` others all of them come out; empty
    tables give no rows.
    """
    spark = entries.sparkSession
    cores = spark.sparkContext.defaultParallelism
    key = ["k1", "k2"]
    stored = materialize(spread(entries.select(F.col("id").cast("string").alias("id"), "vec", *key128(F.col("vec"))), "id"))
    outside = materialize(spread(others.select("side", F.col("query_id").cast("string").alias("query_id"), "vec", *key128(F.col("vec"))), "query_id"))
    total, short = stored.agg(F.count("*"), F.coalesce(F.bool_and(F.col("id").rlike(_UUID)), F.lit(True))).first()
    if not total:
        return spark.createDataFrame([], "side string, query_id string, neighbour_id string, similarity double")
    asking, other_short = outside.agg(F.count("*"), F.coalesce(F.bool_and(F.col("query_id").rlike(_UUID)), F.lit(True))).first()
    short = short and other_short
    books, sample = fit_codebooks(stored, total, settings)
    shared = spark.sparkContext.broadcast(books)
    filled = stored.select("id", "vec").mapInArrow(_count_cells(shared, settings), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sizes = np.zeros(len(books.first) * len(books.second), dtype=np.int64)
    sizes[filled.column("cell").to_numpy()] = filled.column("n").to_numpy()
    number = int(sizes.sum())
    wanted = max(-(-number // settings.block_entries), min(-(-cores // settings.most_slices), -(-number // settings.least_block)))
    blocks = place_cells(books, np.minimum(sizes, 2**31 - 1).astype(np.int32), sample, settings, wanted)
    slices = min(settings.most_slices, max(1, -(-cores // blocks)))
    placed = spark.sparkContext.broadcast(books)
    schema = "slot int, kind byte, vec binary, id string, reach float"
    visits = stored.select("id", "vec").mapInArrow(_visits(placed, settings, slices, True), schema).unionByName(outside.select(F.col("query_id").alias("id"), "vec").mapInArrow(_visits(placed, settings, slices, False), schema))
    dealt = visits.withColumn("id", _packed_id(F.col("id"), short)).repartitionById(blocks * slices, F.col("slot")).sortWithinPartitions("slot", "kind")
    found = dealt.mapInArrow(_scan(placed, settings, slices), "vec binary, best array<binary>").select(*key128(F.col("vec")), F.lit(None).cast("string").alias("side"), F.lit(None).cast("binary").alias("asked"), "best")
    once = outside.groupBy("side", "query_id").agg(F.min(F.struct(*key)).alias("k")).select("k.k1", "k.k2", "side", F.col("query_id").alias("id"))
    asked = stored.select(*key, F.lit("entry").alias("side"), "id").unionByName(once).select(*key, "side", _packed_id(F.col("id"), short).alias("asked"), F.lit(None).cast("array<binary>").alias("best"))
    hot = _hot_vectors(stored.select(*key).unionByName(outside.select(*key)).groupBy(*key).agg(F.count("*").alias("n")), total + asking)
    if hot:  # askers of a hot vector are dealt over all tasks, and what was found for it goes to each
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = F.broadcast(spark.createDataFrame(hot, "k1 long, k2 long").withColumn("_hot", F.lit(True)))
        is_hot = F.coalesce(F.col("_hot"), F.lit(False))
        asked = asked.join(table, key, "left").withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("asked"), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
        found = found.join(table, key, "left").withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    else:
        asked, found = asked.withColumn("salt", F.lit(0)), found.withColumn("salt", F.lit(0))
    together = found.unionByName(asked).repartition(*key, "salt").sortWithinPartitions(*key, "salt", F.asc_nulls_first("asked"), "side")
    listed = together.select(*key, "side", "asked", "best").mapInArrow(_merge(settings), "side string, query binary, neighbour binary, score int")
    return listed.select("side", _plain_id(F.col("query"), short).alias("query_id"), _plain_id(F.col("neighbour"), short).alias("neighbour_id"), (F.col("score") / 1_000_000.0).alias("similarity"))
