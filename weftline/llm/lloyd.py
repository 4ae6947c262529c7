"""Compression of vectors to codes of four bytes: one codebook for each part, improved by rounds that rescan only what may have changed."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, schema_of, small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, the unit that holds heaps: some 2 MB with 64 components, and 16 MB of distances while all are scanned.
BLOCK = 8192
#: Relative error that bounds allow for, far above that of the floating-point steps that make them.
SLACK = 1e-11
#: State of a block. vectors, entries, members and keys are arrays as bytes, the last three a row for each part; begins are the places
#: where the heap of each entry starts. A heap holds (key, member) of the parts that its entry has. The last row of a task has only what sums
#: and counts change by, for all of its blocks.
STATE = "ids array<{key}>, labels array<{label}>, width int, vectors binary, entries binary, members binary, keys binary, begins binary, delta binary"


class Codebooks:
    """Entries (part, entry, component) with, for each, how far bounds may have closed since the first round: the sum over rounds of its own
    drift and the largest one of the others."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.closed = np.zeros(entries.shape[:2])
        self.sums = np.zeros(entries.shape, np.int64)
        self.counts = np.zeros(entries.shape[:2], np.int64)

    def moved(self, delta: np.ndarray) -> Codebooks:
        """The codebooks after a round. delta: part, entry, then changes of the sums and of the count."""
        out = Codebooks(self.entries.copy())
        out.sums, out.counts = self.sums + delta[:, :, :-1], self.counts + delta[:, :, -1]
        used = out.counts > 0
        out.entries[used] = out.sums[used] // out.counts[used][:, None]
        step = out.entries - self.entries
        drift = np.sqrt((step * step).sum(2).astype(float)) * (1 + SLACK)
        others = np.zeros_like(drift)
        if drift.shape[1] > 1:
            two = np.sort(drift, 1)[:, -2:]
            others = np.where(np.arange(drift.shape[1]) == drift.argmax(1)[:, None], two[:, :1], two[:, 1:])
        out.closed = (self.closed + drift + others) * (1 + SLACK)
        return out


def digest(entries: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals with commas between."""
    return sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances: by products where floating point holds them exactly, else by differences of integers."""
    high = max(int(np.abs(vectors).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * high * high * entries.shape[1] < 1 << 53:
        v, c = vectors.astype(float), entries.astype(float)
        return (v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T)
    out = np.empty((len(vectors), len(entries)), np.int64)
    for k, c in enumerate(entries):
        step = vectors - c
        out[:, k] = (step * step).sum(1)
    return out


def scanned(vectors: np.ndarray, entries: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each vector, the lower one of equals, and its key: lower minus upper bound, plus what bounds have closed by until now.
    As long as the key exceeds what they have closed by later, no other entry is as near."""
    far = distances(vectors, entries)
    nearest = far.argmin(1)
    upper = np.sqrt(far[np.arange(len(far)), nearest].astype(float))
    lower = np.full(len(far), math.inf)
    if len(entries) > 1:
        lower = np.sqrt(np.partition(far, 1, axis=1)[:, 1].astype(float))
    begun = closed[nearest]
    return nearest, lower * (1 - SLACK) - upper * (1 + SLACK) + begun * (1 - SLACK)


class Part:
    """One part of a block's vectors: which entry each has, and a heap for each entry, whose least key is the part that is nearest to change."""

    def __init__(self, vectors: np.ndarray, entries: np.ndarray, members: np.ndarray, keys: np.ndarray, begins: np.ndarray):
        self.vectors, self.entries, self.members, self.keys, self.begins = vectors, entries, members, keys, begins

    @staticmethod
    def of(vectors: np.ndarray, book: np.ndarray, closed: np.ndarray) -> Part:
        nearest, keys = scanned(vectors, book, closed)
        order = np.lexsort((keys, nearest))  # what is sorted is a heap
        begins = np.searchsorted(nearest[order], np.arange(len(book) + 1))
        return Part(vectors, nearest, order, keys[order], begins)

    def again(self, book: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Pops what the drift since its scan has violated, scans that and pushes it to its entry's heap. Returns the members whose entry changed and the entries they had."""
        popped: list[int] = []
        heaps: dict[int, list[tuple[float, int]]] = {}

        def heap(e: int) -> list[tuple[float, int]]:
            if e not in heaps:
                a, b = self.begins[e], self.begins[e + 1]
                heaps[e] = list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist()))
            return heaps[e]

        filled = np.flatnonzero(self.begins[1:] > self.begins[:-1])
        for e in filled[self.keys[self.begins[filled]] <= closed[filled]].tolist():
            its, limit = heap(e), closed[e]
            while its and its[0][0] <= limit:
                popped.append(heapq.heappop(its)[1])
        if not popped:
            return np.empty((2, 0), np.int64)
        who = np.array(popped)
        had = self.entries[who]
        nearest, keys = scanned(self.vectors[who], book, closed)
        for e, key, member in zip(nearest.tolist(), keys.tolist(), popped):
            heapq.heappush(heap(e), (key, member))
        self.entries[who] = nearest
        sizes = np.diff(self.begins)
        members, ranks, at = [], [], 0
        for e in sorted(heaps):
            members += [self.members[at : self.begins[e]], np.array([m for _, m in heaps[e]], np.int64)]
            ranks += [self.keys[at : self.begins[e]], np.array([k for k, _ in heaps[e]])]
            sizes[e], at = len(heaps[e]), self.begins[e + 1]
        self.members, self.keys = np.concatenate([*members, self.members[at:]]), np.concatenate([*ranks, self.keys[at:]])
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        other = nearest != had
        return np.stack([who[other], had[other]])


def _changed(delta: np.ndarray, vectors: np.ndarray, entries: np.ndarray, sign: int) -> None:
    """Adds or takes off vectors at their entries in delta (entry; sums, then count)."""
    np.add.at(delta[:, :-1], entries, sign * vectors)
    np.add.at(delta[:, -1], entries, sign)


def _packed(vectors: np.ndarray) -> bytes:
    high = int(np.abs(vectors).max(initial=0))
    return vectors.astype("<i2" if high < 1 << 15 else "<i4" if high < 1 << 31 else "<i8").tobytes()


def _vectors(row: dict) -> np.ndarray:
    n = len(row["ids"])
    raw = row["vectors"]
    return np.frombuffer(raw, f"<i{len(raw) // (n * row['width'])}").reshape(n, row["width"]).astype(np.int64)


def _row(ids, labels, vectors, parts: list[Part]) -> dict:
    return {
        "ids": ids,
        "labels": labels,
        "width": vectors.shape[1],
        "vectors": _packed(vectors),
        "entries": np.stack([p.entries for p in parts]).astype("u1").tobytes(),
        "members": np.stack([p.members for p in parts]).astype("<i4").tobytes(),
        "keys": np.stack([p.keys for p in parts]).astype("<f8").tobytes(),
        "begins": np.stack([p.begins for p in parts]).astype("<i4").tobytes(),
        "delta": None,
    }


def _parts(row: dict, vectors: np.ndarray) -> list[Part]:
    n = len(vectors)
    entries, members, keys, begins = (np.frombuffer(row[c], t).reshape(PARTS, -1) for c, t in (("entries", "u1"), ("members", "<i4"), ("keys", "<f8"), ("begins", "<i4")))
    cut = vectors.reshape(n, PARTS, -1)
    return [Part(cut[:, p], entries[p].astype(np.int64), members[p].astype(np.int64), keys[p], begins[p].astype(np.int64)) for p in range(PARTS)]


def _ending(delta: np.ndarray) -> dict:
    return {"delta": delta.astype("<i8").tobytes()}


def _integers(embedding: pa.Array, high: int) -> np.ndarray:
    """Components times SCALE, rounded down; beyond `high`, up to which squared distances fit 64 bits, they are `high`."""
    flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    return np.clip(scaled, -high, high).astype(np.int64)


def _started(books: Codebooks, high: int, schema: pa.Schema):
    """Vectors to blocks with their first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = books.entries.shape[1], books.entries.shape[2] * PARTS
        delta = np.zeros((PARTS, k, width // PARTS + 1), np.int64)
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        seen = False

        def block(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            n = sum(len(h[0]) for h in held)
            if not n or n < BLOCK and not final:
                return
            ids, labels = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            vectors = np.concatenate([h[2] for h in held])
            for at in range(0, n if final else n - n % BLOCK, BLOCK):
                some = vectors[at : at + BLOCK]
                parts = [Part.of(some.reshape(len(some), PARTS, -1)[:, p], books.entries[p], books.closed[p]) for p in range(PARTS)]
                for p, part in enumerate(parts):
                    _changed(delta[p], part.vectors, part.entries, 1)
                yield pa.RecordBatch.from_pylist([_row(ids[at : at + BLOCK].to_pylist(), labels[at : at + BLOCK].to_pylist(), some, parts)], schema)
            left = 0 if final else n % BLOCK
            held = [(ids[n - left :], labels[n - left :], vectors[n - left :])]

        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            held.append((batch.column("id"), batch.column("label"), _integers(batch.column("vector"), high).reshape(batch.num_rows, width)))
            yield from block(False)
        yield from block(True)
        if seen:
            yield pa.RecordBatch.from_pylist([_ending(delta)], schema)

    return run


def _stepped(books: Codebooks, schema: pa.Schema):
    """Blocks assigned once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), np.int64)
        seen = False
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vectors, seen = _vectors(row), True
                parts = _parts(row, vectors)
                for p, part in enumerate(parts):
                    who, had = part.again(books.entries[p], books.closed[p])
                    _changed(delta[p], part.vectors[who], had, -1)
                    _changed(delta[p], part.vectors[who], part.entries[who], 1)
                yield pa.RecordBatch.from_pylist([_row(row["ids"], row["labels"], vectors, parts)], schema)
        if seen:
            yield pa.RecordBatch.from_pylist([_ending(delta)], schema)

    return run


def _coded(books: Codebooks, schema: pa.Schema):
    """Blocks assigned for the last time: a row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vectors = _vectors(row)
                parts = _parts(row, vectors)
                error = np.zeros(len(vectors), np.int64)
                for p, part in enumerate(parts):
                    part.again(books.entries[p], books.closed[p])
                    step = part.vectors - books.entries[p][part.entries]
                    error += (step * step).sum(1)
                code = np.stack([p.entries for p in parts], 1).astype("u1").tobytes().hex()
                wide = 2 * PARTS
                columns = [row["ids"], row["labels"], [code[j : j + wide] for j in range(0, len(code), wide)], error]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("delta"):
            delta = np.frombuffer(raw.as_py(), "<i8")
            total = delta.copy() if total is None else total + delta
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "by"])


def _delta(state: DataFrame, books: Codebooks) -> np.ndarray:
    """What the sums and counts of entries change by over all blocks: at most as many numbers as the codebooks have reach the driver."""
    out = np.zeros(books.entries.size + books.entries.shape[0] * books.entries.shape[1], np.int64)
    rows = state.filter("delta is not null").select("delta").mapInArrow(_summed, "at long, by long").groupBy("at").agg(F.sum("by").alias("by"))
    for r in rows.collect():
        out[r["at"]] = r["by"]
    return out.reshape(*books.entries.shape[:2], -1)


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks (part, entry, component) that the codes name.

    Components times 1,024, rounded down, are cut into four equal parts. A part's codebook starts as that part of the 256 smallest vec_ids
    (null comes last, equal ones by vector); each of `rounds` rounds assigns all parts to their nearest entries and replaces
    entries by the rounded means of what they got. Then parts are assigned once more: code has two hex digits a part, error is the sum of squared distances.

    Vectors that are null or hold null or non-finite components take no part, nor do those of another length than the kept one
    with the smallest vec_id, or of one that four does not divide. Components beyond 2 ** 30 / sqrt(length) count as that.
    Repeated rows count each; with fewer than 256 vectors each is an entry; without any the result is empty and so are the codebooks.

    Vectors stay in blocks, which no shuffle moves, with a heap for each entry of each part. Its keys are how much nearer the own entry
    is than any other; a round only pops the parts whose key the entries' drift since their scan has used up and rescans
    these exactly. Only the changes of sums, at most as many numbers as the codebooks, meet. Each round's blocks are written to the checkpoint
    folder in place of the last one's."""
    kept = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).alias("vector"))
    kept = kept.filter((F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    named = schema_of(kept.select("id", "label"))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    first = kept.select("id", F.size("vector").alias("width"), "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16(), "double": pa.float64()}
    out = pa.schema([("id", arrow[kinds["id"]]), ("label", arrow[kinds["label"]]), ("code", pa.string()), ("error", pa.int64())])
    listed = f"{named}, code string, error long"
    if not first:
        return vectors.sparkSession.createDataFrame([], listed), np.zeros((PARTS, 0, 0), np.int64)
    width = first[0]["width"]
    high = int(2**30 / math.sqrt(width))
    kept = kept.filter(F.size("vector") == width)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    start = _integers(pa.array([r["vector"] for r in seeds], pa.list_(pa.float64())), high)
    books = Codebooks(start.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy())
    table = STATE.format(key=kinds["id"], label=kinds["label"])
    schema = pa.schema([("ids", pa.list_(arrow[kinds["id"]])), ("labels", pa.list_(arrow[kinds["label"]])), ("width", pa.int32()), *[(c, pa.binary()) for c in ("vectors", "entries", "members", "keys", "begins", "delta")]])
    state = saved(kept.mapInArrow(_started(books, high, schema), table), "blocks")
    for k in range(rounds):
        books = books.moved(_delta(state, books))
        if k + 1 < rounds:
            before, blocks = state, state.filter("delta is null")
            state = saved(blocks.mapInArrow(_stepped(books, schema), table), "blocks")
            discard(before)
    codes = saved(state.filter("delta is null").mapInArrow(_coded(books, out), listed), "codes")
    discard(state)
    return codes, books.entries


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over rows of the same label, null ones together."""
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(small(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
