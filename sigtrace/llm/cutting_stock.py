"""Packing as a cutting-stock problem, solved by column generation over the histogram of lengths.

1. Every document is encoded once; its ids go to a table in the shared folder. Of a
   document, whole sequences are cut off first; what is left is shorter than one.
2. The histogram of the left-overs, one number per length whatever the number of
   documents, is the right side of a linear program. Its columns are patterns
   (which lengths share a sequence) and cuts (one length becomes two). A knapsack
   over the row prices finds new patterns, a scan over sums of two prices new cuts,
   until none would lower the cost.
3. Rounded down, the solution tells how often to use each column; the few documents left by the
   rounding are packed by best fit and, where that leaves holes, cut.
4. Documents are ranked within their length, task by task with a running total per
   task, and the rank alone tells each its sequence and place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .blobs import stored
from .packing import encoder
from .textops import give_back

#: What a cut through a document and a further sequence cost, in tokens of padding.
CUT_COST, SEQUENCE_COST = 8.0, 1.0
#: At most so many columns enter the linear program; fewer mean more cuts, never lost tokens.
PIVOTS = 1500
#: Ranks per length and sequences of a task stay below this.
SPAN = 40
#: Totals per task and length are broadcast up to so many rows of three numbers; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def padded(fill: int, size: int) -> int:
    """Tokens a sequence of ``fill`` takes: a power of two stays as it is, all others are padded to ``size``."""
    return fill if fill & (fill - 1) == 0 else size


def holes(pattern: dict[int, int], size: int) -> bool:
    """Whether a pattern wastes more than a cut costs."""
    fill = sum(n * k for n, k in pattern.items())
    return padded(fill, size) - fill > CUT_COST


class Program:
    """The linear program: least padding, cuts and sequences for ``demand[l]`` pieces of each length l < size.

    Each column takes pieces: a pattern takes one of each length in it, a cut takes one and gives two. The basis
    starts with patterns of one length; ``inverse`` is that of the basis.
    """

    def __init__(self, demand: np.ndarray, size: int):
        self.size, self.m = size, size - 1
        # a little more than the demand, different for every length, keeps the pivots from going round
        noise = np.random.default_rng(0).uniform(1, 2, self.m)
        self.right = demand[1:size] + noise * max(1e-6 * demand.sum() / self.m, 1e-9)
        self.columns: list[tuple[dict[int, int], bool]] = []
        self.cost = np.zeros(self.m)
        for k, take in enumerate(self._start()):
            self.columns.append((take, True))
            self.cost[k] = padded(sum(n * many for n, many in take.items()), size) + SEQUENCE_COST
        self._renew()

    def _start(self):
        """Patterns filled with the longest pieces there are, each used until one of its lengths is spent: a triangular basis."""
        left = np.concatenate([[0.0], self.right])
        alive = [n for n in range(1, self.size)]
        while alive:
            room, own, used = self.size, {}, np.zeros(self.size)
            k = len(alive)
            while room and (k := bisect_right(alive, room, 0, k)):
                n = alive[k - 1]
                own[n] = 1 + own.get(n, 0)
                room -= n
            for n, many in own.items():
                used[n] = many
            spent = min(own, key=lambda n: left[n] / own[n])
            left -= used * (left[spent] / own[spent])
            alive.remove(spent)
            yield own

    def patterns(self) -> list[tuple[dict[int, int], float]]:
        """Patterns whose prices exceed their cost most: the best of every power of two and of the best padded fills."""
        size, y = self.size, np.concatenate([[0.0], self.price])
        usable = np.where(y > 1e-9, y, -np.inf)[1:]
        worth, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
        worth[0] = 0.0
        for c in range(1, size + 1):
            value = worth[c - 1::-1] + usable[:c] if c <= self.m else worth[c - 1:0:-1] + usable
            k = int(np.argmax(value))
            worth[c], last[c] = value[k], k + 1
        fills = np.arange(size + 1)
        cost = np.where(fills & (fills - 1) == 0, fills, size) + SEQUENCE_COST
        gain = worth - cost
        out = []
        for c in np.argsort(-gain)[:12].tolist():
            if gain[c] <= 1e-6 or c == 0:
                break
            own, at = {}, c
            while at:
                n = int(last[at])
                own[n] = own.get(n, 0) + 1
                at -= n
            out.append((own, float(cost[c])))
        return out

    def cuts(self) -> list[tuple[dict[int, int], float]]:
        """Lengths that cost more than two that make them up, and a cut."""
        y = np.maximum(np.concatenate([[0.0], self.price]), 0)
        best = [(0.0, 0, 0)]
        for n in range(2, self.size):
            value = y[1:n // 2 + 1] + y[n - 1:n - n // 2 - 1:-1]
            k = int(np.argmin(value))
            if (gain := y[n] - float(value[k]) - CUT_COST) > 1e-6:
                best.append((gain, n, k + 1))
        out = []
        for _, n, a in sorted(best, reverse=True)[:24]:
            if n:
                take = {n: 1}
                for part in (a, n - a):
                    take[part] = take.get(part, 0) - 1
                out.append((take, CUT_COST))
        return out

    def enter(self, take: dict[int, int], cost: float, pattern: bool) -> bool:
        """Bring a column into the basis if it lowers the cost."""
        rows, amounts = np.array(list(take)) - 1, np.array(list(take.values()), float)
        reduced = cost - (self.price[rows] * amounts).sum()
        if reduced > -1e-7:
            return False
        step = (self.inverse[:, rows] * amounts).sum(1)  # no product of matrices: many threads for a small one only get in each other's way
        limit = np.where(step > 1e-9, self.x / np.maximum(step, 1e-9), np.inf)
        r = int(np.argmin(limit))
        if not np.isfinite(limit[r]):
            return False
        row = self.inverse[r] / step[r]
        there, across = np.flatnonzero(step), np.flatnonzero(row)
        if len(there) * len(across) * 4 < self.m ** 2:
            self.inverse[np.ix_(there, across)] -= np.outer(step[there], row[across])
        else:
            self.inverse[there] -= np.outer(step[there], row)
        self.inverse[r] = row
        self.x = np.maximum(self.x - step * limit[r], 0)
        self.x[r] = limit[r]
        self.columns[r], self.cost[r] = (take, pattern), cost
        self.price += reduced * row
        return True

    def _renew(self) -> None:
        """The inverse anew from the columns, against rounding errors."""
        basis = np.zeros((self.m, self.m))
        for k, (take, _) in enumerate(self.columns):
            for n, many in take.items():
                basis[n - 1, k] = many
        self.inverse = np.linalg.inv(basis)
        self.x = np.maximum((self.inverse * self.right).sum(1), 0)
        self.price = (self.cost[:, None] * self.inverse).sum(0)

    def solve(self) -> list[tuple[dict[int, int], bool, float]]:
        """(column, whether a pattern, how often) of the best solution found: patterns first, cuts where they don't suffice."""
        pivots = renewed = seen = 0
        for cutting in (False, True):
            before = np.inf
            while pivots < PIVOTS:
                entered = 0
                for k in np.flatnonzero(self.price < -1e-9)[:24]:
                    entered += self.enter({int(k) + 1: -1}, 0.0, False)  # a place may stay empty
                for take, cost in self.cuts() if cutting else ():
                    entered += self.enter(take, cost, False)
                for take, cost in self.patterns():
                    entered += self.enter(take, cost, True)
                if not entered:
                    break
                pivots += entered
                if pivots - seen >= 100:
                    if pivots - renewed >= 500:
                        self._renew()
                        renewed = pivots
                    seen, now = pivots, float((self.cost * self.x).sum())
                    if before - now < 2e-4 * now:
                        break
                    before = now
        return [(take, pattern, float(x)) for (take, pattern), x in zip(self.columns, self.x, strict=True) if x > 1e-9]


LOG = False
class Plan:
    """Which ranks of which length go where: intervals of ranks, each placed or cut."""

    def __init__(self, supply: np.ndarray, size: int):
        self.size = size
        self.supply = supply.astype(np.int64).copy()  # pieces of each length, made ones included
        self.next = np.zeros(size + 1, np.int64)  # the first rank not yet used
        self.sequences = 0
        self.rows: list[tuple[int, ...]] = []

    def left(self, n: int) -> int:
        return int(self.supply[n] - self.next[n])

    def place(self, n: int, many: int, sequence: int, per: int, offset: int) -> None:
        """``per`` pieces of length n in each sequence from the given one on."""
        self.rows.append((n << SPAN | int(self.next[n]), 1, sequence, per, offset))
        self.next[n] += many

    def cut(self, n: int, many: int, first: int) -> None:
        """Pieces of length n become two; the ranks of the new ones follow those there are."""
        lo = int(self.next[n])
        self.next[n] += many
        ranks = []
        for part in (first, n - first):
            ranks.append(int(self.supply[part]))
            self.supply[part] += many
        self.rows.append((n << SPAN | lo, 0, first, *ranks))

    def use(self, pattern: dict[int, int], many: int) -> None:
        many = min([many, *(self.left(n) // k for n, k in pattern.items())])
        if many > 0:
            offset = 0
            for n, k in pattern.items():
                self.place(n, many * k, self.sequences, k, offset)
                offset += n * k
            self.sequences += many

    def fill(self, pieces: list[int], rooms: list[int], many: int = 1) -> None:
        """Pieces one after the other into sequences of the given fills, cut where one ends; ``many`` times over."""
        own, n = iter(pieces), 0
        for room in rooms:
            offset = 0
            while offset < room:
                n = n or next(own)
                part = min(n, room - offset)
                if part < n:
                    self.cut(n, many, part)
                self.place(part, many, self.sequences, 1, offset)
                offset, n = offset + part, n - part
            self.sequences += many

    def table(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 5)


def _best_fit(plan: Plan) -> list[dict[int, int]]:
    """Longest first, each into the fullest bin with room: the bins of all pieces left."""
    size, room, bins = plan.size, {}, []
    free: list[int] = []  # places left for which there is a bin, ascending
    for n in range(size - 1, 0, -1):
        for _ in range(plan.left(n)):
            k = bisect_left(free, n)
            if k < len(free):
                left = free[k]
                b = room[left].pop()
                if not room[left]:
                    free.pop(k)
            else:
                left, b = size, len(bins)
                bins.append({})
            bins[b][n] = bins[b].get(n, 0) + 1
            if left > n:
                if not room.get(left - n):
                    free.insert(bisect_left(free, left - n), left - n)
                room.setdefault(left - n, []).append(b)
    return bins


def make_plan(demand: np.ndarray, size: int) -> Plan:
    """Rounded columns of the program, then best fit for the rest; what would leave holes is cut to fill them."""
    plan = Plan(demand, size)
    if not demand.sum():
        return plan
    solution = Program(demand.astype(float), size).solve()
    for take, pattern, x in sorted(solution, key=lambda s: -max(s[0])):
        if not pattern and len(take) > 1 and x >= 1:
            n = max(take)
            plan.cut(n, min(int(x + 1e-6), plan.left(n)), min(take))
    tight = [(take, x) for take, pattern, x in solution if pattern and not holes(take, size)]
    for take, x in tight:
        plan.use(take, int(x + 1e-6))
    for take, _ in sorted(tight, key=lambda s: int(s[1]) - s[1]):
        plan.use(take, 1)
    for take, pattern, x in solution:  # patterns with holes: so many in a row as fill whole sequences
        if pattern and holes(take, size):
            pieces = [n for n, k in take.items() for _ in range(k)]
            again = size // gcd(sum(pieces), size)
            many = min([int(x + 1e-6) // again, *(plan.left(n) // (k * again) for n, k in take.items())])
            if many > 0:
                plan.fill(pieces * again, [size] * (sum(pieces) * again // size), many)
    loose: list[int] = []
    for own in _best_fit(plan):
        if holes(own, size):
            loose += [n for n, k in own.items() for _ in range(k)]
        else:
            plan.use(own, 1)
    rooms = [size] * (sum(loose) // size)
    tail = sum(loose) % size
    while tail:  # the last tokens fill powers of two, each without padding
        rooms.append(tail if size - tail <= CUT_COST else 1 << tail.bit_length() - 1)
        tail -= rooms[-1]
    plan.fill(sorted(loose, reverse=True), rooms)
    return plan


def places(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, sequence, offset) of the pieces that documents of a length and rank end up as."""
    row, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    out = []
    while len(row):
        at = table[np.searchsorted(table[:, 0], length << SPAN | rank, "right") - 1]
        nth = (length << SPAN | rank) - at[:, 0]
        put = at[:, 1] == 1
        per = np.maximum(at[put, 3], 1)
        out.append(np.stack([row[put], start[put], length[put], at[put, 2] + nth[put] // per, at[put, 4] + nth[put] % per * length[put]]))
        cut = ~put
        first, second = at[cut, 2], length[cut] - at[cut, 2]
        row, start = np.tile(row[cut], 2), np.concatenate([start[cut], start[cut] + first])
        rank = np.concatenate([at[cut, 3] + nth[cut], at[cut, 4] + nth[cut]])
        length = np.concatenate([first, second])
    return tuple(np.concatenate(out, axis=1)) if out else tuple(np.zeros((5, 0), np.int64))


def encoded(df: DataFrame, path: str, size: int, text_col: str, id_col: str, end_id: int) -> DataFrame:
    """A row per document, written to the shared folder: its ids and its rank among those of its task with the same rest.

    ``rest`` is what whole sequences leave of the document, ``whole`` how many whole
    sequences the documents before it in the task have.
    """
    names = ["id", "tokens", "rest", "part", "nth", "whole", "ids"]

    def run(batches):
        part = TaskContext.get().partitionId()
        seen, whole = np.zeros(size, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            library = encoder(path)
            short = len(library.blank) <= 1 << 16 and end_id < 1 << 16
            end = np.array([end_id], "<u2" if short else "<u4").tobytes()
            own = [(np.frombuffer(x, "<u4").astype("<u2").tobytes() if short else bytes(x)) + end
                   for x in library.many(batch.column(batch.schema.get_field_index(text_col)))]
            tokens = np.fromiter(map(len, own), np.int64, len(own)) // len(end)
            rest = tokens % size
            order = np.argsort(rest, kind="stable")
            first = np.searchsorted(rest[order], rest[order])
            nth = np.empty(len(own), np.int64)
            nth[order] = np.arange(len(own)) - first + seen[rest[order]]
            seen += np.bincount(rest, minlength=size)
            before = whole + np.concatenate([[0], np.cumsum(tokens // size)[:-1]])
            whole += int((tokens // size).sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(id_col)), pa.array(tokens), pa.array(rest.astype(np.int32)),
                 pa.array(np.full(len(own), part, np.int32)), pa.array(nth), pa.array(before), pa.array(own, pa.binary())], names=names)
        batch = None
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(run, f"id {kind}, tokens long, rest int, part int, nth long, whole long, ids binary")
    return stored(out, "encoded")


def cutting_stock_packing(df: DataFrame, path: str, size: int = 1024, text_col: str = "text", id_col: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` (a power of two) tokens with next to no padding and few cuts.

    Returns (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per
    piece. A sequence whose fill is a power of two needs no padding. Documents longer than
    a sequence are cut every ``size`` tokens, others only where the program finds a cut
    cheaper than the padding it saves (a cut counts as ``CUT_COST`` tokens).

    A null or empty text is one end id; repeated rows are packed one by one and may
    share a length with any number of others; null ids stay null; an empty table gives no rows; very
    long texts take memory in proportion to themselves; other columns are not read. The program is solved on the driver over
    ``size`` numbers; the rounding leaves at most one sequence per column to be packed there. Ids are kept in the shared folder.
    """
    table = encoded(df, path, size, text_col, id_col, end_id)
    counts = table.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("many"))
    demand = np.zeros(size + 1, np.int64)
    tasks = 0
    for rest, many, parts in counts.groupBy("rest").agg(F.sum("many"), F.count("*")).collect():  # less than ``size`` rows
        demand[rest], tasks = many, tasks + parts
    plan = make_plan(demand, size).table()
    by_task = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "rest", F.coalesce(F.sum("many").over(by_task), F.lit(0)).alias("before"))
    ranked = table.join(F.broadcast(before) if tasks <= BROADCAST_ROWS else before, ["part", "rest"], "left")

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: np.asarray(batch.column(batch.schema.get_field_index(name)).fill_null(0)).astype(np.int64)
            tokens, rest = get("tokens"), get("rest")
            some = np.flatnonzero(rest)
            row, start, length, sequence, offset = places(plan, rest[some], (get("before") + get("nth"))[some])
            row = some[row]
            full = tokens // size
            again = np.repeat(np.arange(len(full)), full)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(full) - full, full)
            row, start = np.concatenate([row, again]), np.concatenate([start + (tokens - rest)[row], nth * size])
            length = np.concatenate([length, np.full(len(again), size)])
            sequence = np.concatenate([sequence, (get("part")[again] + 1 << SPAN) + get("whole")[again] + nth])
            offset = np.concatenate([offset, np.zeros(len(again), np.int64)])
            order = np.lexsort([start, row])
            row, start, length, sequence, offset = (x[order] for x in (row, start, length, sequence, offset))
            ids, checks, data, current = batch.column(batch.schema.get_field_index("ids")), [], b"", -1
            for i, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if i != current:
                    data, current = ids[i].as_buffer(), i
                    width = f"<u{len(data) // int(tokens[i])}"
                    data = memoryview(np.frombuffer(data, width).astype("<u4").tobytes())
                checks.append(zlib.crc32(data[4 * a:4 * (a + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(checks, pa.int64()),
                 pa.array(tokens[row]), pa.array(sequence), pa.array(offset)],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        batch = None
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(work, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
