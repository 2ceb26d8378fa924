"""Packing of token sequences by cutting-stock column generation.

A document's ids (with its end id) are cut into full pieces of ``capacity`` and
one rest.  Piece lengths are counted by class (multiples of ``grain``, rounded
up).  A linear program over patterns (which classes share a sequence) holds all
pieces in the fewest sequences: its columns come from a knapsack dynamic
program, until no pattern pays or the bound is reached.  Rounded patterns are
assigned to pieces by rank: a piece's rank within its class gives it its pattern,
sequence and slot.  What rounding leaves is packed first-fit by falling class.

The driver sees the histogram (``capacity / grain`` rows) and the patterns (at
most one per class, and those of the remains); pieces stay distributed.  Ranks
are counted per class and task, so no class is gathered in one task; the counts
(classes times tasks, so they grow) are joined by a shuffle, never broadcast.

Defined cases: a null text is empty and yields its end id alone; a null or
repeated id is a document like any other; an empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depinfer.llm.common import materialize, ship, text_or_empty
from depinfer.llm.tokens import broadcast_tokenizer, default_tokenizer, encoder

PIECES = "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, part int, class int, seen bigint"
PLACED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def _pieces_of(tokenizer, end_id: int, capacity: int, grain: int, keep_ids: bool):
    def pieces(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(-(-capacity // grain) + 1, np.int64)
        for batch in enc.slices(batches):
            ends, ids = enc.encode(batch.column("text"), end_id)
            tokens = np.diff(ends)
            n = -(-tokens // capacity)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(tokens[row] - start, capacity)
            at = ends[:-1][row] + start
            ids = np.ascontiguousarray(ids, "<u4")
            crc = np.fromiter((zlib.crc32(ids[a : a + k]) for a, k in zip(at, length)), np.int64, len(at))
            kind = -(-length // grain)
            # The piece's rank among those of its class in this task.
            order = np.argsort(kind, kind="stable")
            count = np.bincount(kind, minlength=len(seen))
            rank = np.empty(len(kind), np.int64)
            rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(count) - count, count)
            rank += seen[kind]
            seen += count
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(crc), pa.array(tokens[row].astype(np.int64)), pa.array(np.full(len(row), part, np.int32)), pa.array(kind.astype(np.int32)), pa.array(rank)]
            names = [*PLACED, "part", "class", "seen"]
            if keep_ids:
                # The pieces lie one after another in ``ids``.
                edges = pa.py_buffer(np.concatenate([at, ends[-1:]]).astype(np.int64) * 4)
                columns.append(pa.Array.from_buffers(pa.large_binary(), len(row), [None, edges, pa.py_buffer(ids)]).cast(pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces


def _knapsack(sizes, values, capacity: int):
    """For each capacity up to ``capacity``, the value of the best multiset of ``sizes`` (falling) and the item that it took last, or -1."""
    import numpy as np

    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    first = np.searchsorted(-sizes, -np.arange(capacity + 1))
    for c in range(1, capacity + 1):
        best[c], fits = best[c - 1], slice(first[c], None)
        if first[c] < len(sizes):
            gain = best[c - sizes[fits]] + values[fits]
            k = int(np.argmax(gain))
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], first[c] + k
    return best, took


def _patterns(sizes, took, capacity: int):
    """For each item the best pattern that holds it, read off the knapsack's table."""
    import numpy as np

    out = np.zeros((len(sizes), len(sizes)))
    for k, size in enumerate(sizes):
        out[k, k], c = 1, capacity - size
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                out[k, took[c]] += 1
                c -= sizes[took[c]]
    return out


def _first_fit(sizes, left, capacity: int) -> list:
    """``(pattern, times)`` of first-fit by falling class; a pattern serves as often as it repeats."""
    import numpy as np

    left, plans = left.copy(), []
    while left.any():
        free, pattern = capacity, np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(left):
            if sizes[k] <= free:
                pattern[k] = min(left[k], free // sizes[k])
                free -= pattern[k] * sizes[k]
                if not free:
                    break
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plans.append((pattern, n))
        left -= n * pattern
    return plans


class PatternProgram:
    """The linear program: patterns, used as rarely as possible, that hold ``need`` pieces of each class.

    Starts with one pattern for each class alone.  Each pricing solves one
    knapsack at duals between the program's and the classes' shares of the
    capacity (which keeps them from swinging) and adds, for each class, the best
    pattern that holds it, if it pays at the program's own duals; the simplex
    method then goes on until none of the patterns priced so far pays.  When
    nothing pays, the weight moves to the program's own duals, and at these
    Farley's bound holds: no plan is below its value over the best pattern's.
    """

    def __init__(self, sizes, need, capacity: int):
        import numpy as np

        self.sizes, self.capacity = sizes, capacity
        self.columns = np.diag(capacity // sizes).astype(float)
        self.inverse = np.diag(1.0 / np.diag(self.columns))
        self.times = need / np.diag(self.columns)
        self.bound = float(need @ sizes) / capacity
        self.pricings = self.pivots = 0

    @property
    def value(self) -> float:
        return float(self.times.sum())

    def solve(self, gap: float, pricings: int, pivots: int) -> None:
        import numpy as np

        pool, share, weight = np.empty((0, len(self.sizes))), self.sizes / self.capacity, 0.9
        while self.value > self.bound * (1 + gap) and self.pricings < pricings and self.pivots < pivots:
            duals = self.inverse.sum(axis=0)
            values = weight * share + (1 - weight) * duals
            best, took = _knapsack(self.sizes, values, self.capacity)
            self.pricings += 1
            if not weight:
                self.bound = max(self.bound, self.value / max(best[-1], 1.0))
            found = _patterns(self.sizes, took, self.capacity)
            found = np.unique(found[found @ duals > 1 + 1e-6], axis=0)
            if len(found):
                pool = np.vstack([pool, found])
                self._improve(pool, gap, pivots)
            elif weight:
                weight = max(weight - 0.1, 0.0) if weight > 0.05 else 0.0
            else:
                break

    def _improve(self, pool, gap: float, pivots: int) -> None:
        """Simplex steps with the patterns of ``pool``; of the 32 with the best reduced costs the one that gains most."""
        import numpy as np

        while self.value > self.bound * (1 + gap) and self.pivots < pivots:
            gain = pool @ self.inverse.sum(axis=0) - 1
            some = np.argpartition(-gain, 31)[:32] if len(gain) > 32 else np.arange(len(gain))
            some = some[gain[some] > 1e-7]
            if not len(some):
                return
            steps = self.inverse @ pool[some].T
            ratio = np.where(steps > 1e-9, self.times[:, None] / np.where(steps > 1e-9, steps, 1), np.inf)
            out = ratio.argmin(axis=0)
            room = ratio[out, np.arange(len(some))]
            total = room * gain[some]
            c = int(np.argmax(total)) if total.max() > 1e-12 else int(np.argmax(gain[some]))
            step, k, t = steps[:, c], int(out[c]), max(float(room[c]), 0.0)
            self.times = np.maximum(self.times - t * step, 0)
            self.times[k] = t
            self.columns[:, k] = pool[some[c]]
            row = self.inverse[k] / step[k]
            self.inverse -= np.outer(step, row)
            self.inverse[k] = row
            self.pivots += 1


def solve_patterns(demand: dict[int, int], capacity: int, gap: float = 3e-4, pricings: int = 200, pivots: int = 20_000, report: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)``; a pattern maps a class to its pieces in one sequence.

    ``demand`` maps a class (its size in grains) to its number of pieces.  The
    program's patterns are used as often as it says, rounded down; then once more
    each, those with the largest remainders first, as far as there are pieces.
    What is left is packed first-fit by falling class.  ``report``, if given,
    takes the program's figures and how many pieces its patterns hold.
    """
    import numpy as np

    sizes = np.array(sorted((s for s, n in demand.items() if n > 0), reverse=True), np.int64)
    if not len(sizes):
        return []
    left = np.array([demand[int(s)] for s in sizes], np.int64)
    program = PatternProgram(sizes, left, capacity)
    program.solve(gap, pricings, pivots)
    patterns, times = program.columns.T.astype(np.int64), program.times
    uses = np.zeros(len(sizes), np.int64)
    order = np.argsort(np.floor(times + 1e-6) - times, kind="stable")
    for k, n in [*((k, int(times[k] + 1e-6)) for k in range(len(sizes))), *((k, 1) for k in order if times[k] % 1 > 1e-6)]:
        # Rounding never places more pieces than there are.
        held = patterns[k] > 0
        n = int(min(n, (left[held] // patterns[k][held]).min()))
        uses[k] += n
        left -= n * patterns[k]
    plans = [(patterns[k], int(uses[k])) for k in np.flatnonzero(uses)]
    if report is not None:
        report |= {"pricings": program.pricings, "pivots": program.pivots, "value": program.value, "bound": program.bound, "sequences": int(uses.sum()), "pieces": int(sum(n * p.sum() for p, n in plans)), "left": int(left.sum())}
    plans += _first_fit(sizes, left, capacity)
    return [({int(s): int(c) for s, c in zip(sizes, p) if c}, n) for p, n in plans]


def _slots(plans: list[tuple[dict[int, int], int]]) -> dict:
    """By class: first rank, pieces per sequence, first sequence and first slot of each plan that holds it."""
    import numpy as np

    table: dict[int, list] = {}
    sequence, ranks = 0, {}
    for pattern, times in plans:
        slot = 0
        for size, count in pattern.items():
            table.setdefault(size, []).append((ranks.get(size, 0), count, sequence, slot))
            ranks[size] = ranks.get(size, 0) + count * times
            slot += count
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in table.items()}


def _place_of(slots):
    def place(batches):
        import numpy as np
        import pyarrow as pa

        table = slots.value
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.empty(len(kind), np.int64), np.empty(len(kind), np.int32)
            for size in np.unique(kind):
                at = np.flatnonzero(kind == size)
                rows = table[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                within = rank[at] - row[:, 0]
                sequence[at], slot[at] = row[:, 2] + within // row[:, 1], row[:, 3] + within % row[:, 1]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(slot)], names=[*kept, "sequence_id", "slot"])

    return place


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, capacity: int = 2048, grain: int = 8, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    With ``keep_ids`` also ``ids``: the piece's ids as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    tokenizer = broadcast_tokenizer(spark, tokenizer_path or default_tokenizer())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces_of(tokenizer, end_id, capacity, grain, keep_ids), PIECES + ", ids binary" * keep_ids), "op7-pieces", "zstd" if keep_ids else None)
    counted = materialize(pieces.groupBy("class", "part").agg(F.count("*").alias("n")), "op7-counts")
    before = counted.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    demand = {r["class"]: r["n"] for r in counted.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(solve_patterns(demand, capacity // grain)))
    ranked = pieces.drop("ids").join(before.hint("shuffle_hash"), ["class", "part"])
    ranked = ranked.select(*PLACED, "part", "class", "seen", (F.col("before") + F.col("seen")).alias("rank"))
    placed = ranked.mapInArrow(_place_of(slots), PIECES + ", sequence_id bigint, slot int")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    key = ["part", "class", "seen"]
    out = placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", offset.cast("long").alias("offset"), *key)
    if keep_ids:
        # Placed without them, so that they move once.
        out = out.join(pieces.select(*key, "ids"), key)
    return out.drop(*key)


ship(__name__)
