"""Supersteps in memory, for graphs that one task can hold: golden run, injected runs and strong components.

A task gets the whole graph as rows (part, src, dst, share, x, held, and the columns of a fault), sorts its edges, and so sums
in the same order as any other task. Its supersteps are those of `gas.run` and `campaign.Injected`; the trials are dealt over
the tasks and advance beside a golden run of their own.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..functions.compare import INF
from .closure import tables

DAMPING, REST, TOLERANCE = 0.85, 0.15, 0.01
#: What a vertex has gathered that nothing is sent to.
NONE = np.iinfo(np.int64).max
#: Values of the states that the trials of one round have together, and rows of a batch that leaves the task.
STATES, BATCH = 1 << 23, 1 << 17

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # an executor need not have this package


def flip_int(x: int, bit: int) -> int:
    y = (int(x) ^ (1 << bit)) & 0xFFFFFFFF
    return y - (1 << 32) if y > INF else y


def flip_float(x: float, bit: int) -> float:
    return float((np.array([x]).astype(np.float32).view(np.uint32) ^ np.uint32(1 << bit)).view(np.float32)[0])


@dataclass(frozen=True)
class Form:
    """A program over one column: what a sender sends (null for nothing), the new value from the old and the gathered one,
    and when it counts as changed; `least`: the least message counts, else their sum."""

    gathered: str
    send: Callable[[np.ndarray, np.ndarray], np.ndarray]
    new: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    changed: Callable[[np.ndarray, np.ndarray], np.ndarray]
    least: bool = True
    larger_only: bool = False

    def flip(self, x: object, bit: int) -> object:
        """A gathered value or a new one with a bit flipped; nothing gathered counts as not reached."""
        return flip_int(INF if x == NONE else x, bit) if self.least else flip_float(x, bit)


#: By the name of the program and its column.
FORMS = {
    ("SSSP", "d"): Form("g", lambda x, share: np.where(x < INF, x + 1, NONE), lambda x, g, held: np.where(held, x, np.minimum(x, np.minimum(g, INF))), lambda new, old: new != old),
    ("PageRank", "rank"): Form("phi", lambda x, share: x * share, lambda x, g, held: REST + DAMPING * g, lambda new, old: np.abs(new - old) >= TOLERANCE, False),
    ("SCC", "label"): Form("g", lambda x, share: x, lambda x, g, held: np.minimum(x, g), lambda new, old: new < old, larger_only=True),
}


class Steps:
    """The graph of a task and one superstep over it."""

    def __init__(self, key: tuple[str, str], rows: pa.Table) -> None:
        self.form, self.column = FORMS[key], key[1]
        column = {c: rows.column(c) for c in ("src", "dst", "share", "x", "held")}
        lone = column["x"].is_valid().to_numpy()
        src, dst = column["src"].to_numpy(), column["dst"].to_numpy()
        order = np.argsort(src[lone], kind="stable")
        self.ids, self.held = src[lone][order], column["held"].to_numpy()[lone][order].astype(bool)
        self.x = column["x"].filter(pa.array(lone)).to_numpy()[order]
        if self.form.least:
            self.x = self.x.astype(np.int64)
        s, d, share = (np.searchsorted(self.ids, src[~lone]), np.searchsorted(self.ids, dst[~lone]), column["share"].to_numpy()[~lone])
        order = np.lexsort((share, s, d))
        self.s, self.d, self.share = s[order], d[order], share[order]
        self.heads = np.flatnonzero(np.diff(self.d, prepend=-1))
        self.to = self.d[self.heads]

    def _least(self, sent: np.ndarray) -> np.ndarray:
        out = np.full(len(self.ids), NONE)
        if len(self.to):
            out[self.to] = np.minimum.reduceat(sent, self.heads)
        return out

    def __call__(self, x: np.ndarray, flag: np.ndarray, first: bool, faults: list[tuple] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """The new values and flags, who was active, and whether a fault (id, bit, kernel, register) met its vertex."""
        form, n, fired = self.form, len(self.ids), False
        sent, moving = form.send(x[self.s], self.share), flag[self.s]
        g = self._least(sent) if form.least else np.bincount(self.d, weights=sent, minlength=n)
        if first:
            active = np.ones(n, bool)
        elif form.larger_only:
            active = self._least(np.where(moving, sent, NONE)) < x
        else:
            active = np.zeros(n, bool)
            active[self.d[moving]] = True
        met = []
        for v, *fault in faults:
            at = int(np.searchsorted(self.ids, v))
            if at < n and self.ids[at] == v and active[at] and not self.held[at]:
                met.append((at, *fault))
        fired = any(kernel in ("gather", "apply") for _, _, kernel, _ in met)
        for at, bit, kernel, register in met:
            if (kernel, register) == ("gather", form.gathered):
                g[at] = form.flip(g[at], bit)
        new = np.where(active, form.new(x, g, self.held), x)
        for at, bit, kernel, register in met:
            if (kernel, register) == ("apply", self.column):
                new[at] = form.flip(new[at], bit)
        changed = form.changed(new, x)
        for at, _, kernel, register in met:
            if (kernel, register) == ("scatter", "changed") and changed[at]:
                changed[at], fired = False, True
        return new, changed, active, fired


def _batches(columns: dict[str, object], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns as batches; a single value fills its column."""
    n = max(len(c) for c in columns.values() if isinstance(c, np.ndarray))
    for lo in range(0, n, BATCH):
        size = min(BATCH, n - lo)
        own = [columns.get(f.name) for f in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + size]).cast(f.type) if isinstance(c, np.ndarray) else pa.array([c] * size, f.type) for c, f in zip(own, schema, strict=True)], schema=schema)


def golden_run(key: tuple[str, str], most: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From all rows of a graph: iter, v of every active vertex of each superstep, and of every vertex in the end, where
    `final`, with its value, flag and activity and the number of supersteps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables(batches):
            step, done = Steps(key, rows), 0
            x, flag, active = step.x, np.ones(len(step.ids), bool), np.zeros(len(step.ids), bool)
            with np.errstate(all="ignore"):
                while done < most:
                    after = step(x, flag, done == 0)
                    if not after[2].any():
                        break
                    x, flag, active, _ = after
                    done += 1
                    yield from _batches({"iter": done, "v": step.ids[active], "final": False}, schema)
                    if not flag.any():
                        break
            yield from _batches({"iter": done, "v": step.ids, "x": x, "changed": flag, "active": active, "final": True}, schema)

    return run


def injected_runs(key: tuple[str, str], steps: int, budget: int, cut: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the rows of a graph and the faults of some trials: trial, v, value and flag of each vertex that differs from the
    golden state in the end; and, where v is null, supersteps, fired and late of the trial (see campaign.Injected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables(batches):
            planned = rows.filter(rows.column("trial").is_valid())
            if not planned.num_rows:
                continue
            step = Steps(key, rows.filter(rows.column("trial").is_null()))
            faults = defaultdict(lambda: defaultdict(list))
            for r in planned.select(["trial", "iter", "src", "bit", "kernel", "register"]).to_pylist():
                own = faults[r["trial"]]
                if r["bit"] is not None and r["src"] is not None:
                    own[r["iter"]].append((r["src"], r["bit"], r["kernel"], r["register"]))
            trials = sorted(faults)
            size = max(1, STATES // max(1, len(step.ids)))
            for lo in range(0, len(trials), size):
                yield from _beside(step, {t: faults[t] for t in trials[lo : lo + size]}, steps, budget, cut, schema)

    return run


def _beside(step: Steps, faults: dict, steps: int, budget: int, cut: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    golden = step.x, np.ones(len(step.ids), bool)
    apart, alive, fired, late = {}, dict.fromkeys(faults, 0), dict.fromkeys(faults, False), dict.fromkeys(faults, False)
    due = max([0, *(k for f in faults.values() for k in f)])
    with np.errstate(all="ignore"):
        for k in range(1, budget + 1):
            if k <= steps:
                after = step(*golden, k == 1)[:2]
            elif k > due and not apart:
                break
            else:  # nobody moves any more
                after = golden[0], np.zeros(len(step.ids), bool)
            busy = False
            for t, own in faults.items():
                if t not in apart and k not in own:
                    alive[t] = max(alive[t], k if k <= steps else 0)
                    continue
                x, flag, active, met = step(*apart.get(t, golden), k == 1, own.get(k, ()))
                fired[t] |= met
                if active.any():
                    busy, alive[t] = True, k
                    late[t] = k == budget and bool(flag.any()) and not cut
                same = np.array_equal(x, after[0], equal_nan=not step.form.least) and np.array_equal(flag, after[1])
                if same:
                    apart.pop(t, None)
                else:
                    apart[t] = x, flag
            golden = after
            if k >= max(steps, due) and k > steps and not busy:
                break
    for t in faults:
        yield from _batches({"trial": np.array([t]), "supersteps": alive[t], "fired": fired[t], "late": late[t]}, schema)
        if t in apart:
            x, flag = apart[t]
            equal = (x == golden[0]) | ((x != x) & (golden[0] != golden[0]))
            other = np.flatnonzero(~equal | (flag != golden[1]))
            yield from _batches({"trial": t, "v": step.ids[other], "x": x[other], "changed": flag[other]}, schema)


def strong_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v and label, the least vertex of its strongly connected component, from all rows (part, src, dst) of a graph; a
    vertex stands with itself."""
    for rows in tables(batches):
        kind = rows.schema.field("src").type
        src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
        ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
        s, d = place[: len(src)], place[len(src) :]
        order = np.argsort(s, kind="stable")
        ends, d = np.searchsorted(s[order], np.arange(len(ids) + 1)).tolist(), d[order].tolist()
        label = _tarjan(len(ids), ends, d)
        yield from _batches({"v": ids, "label": ids[label]}, pa.schema([("v", kind), ("label", kind)]))


def _tarjan(n: int, ends: list[int], to: list[int]) -> np.ndarray:
    """For each vertex the least of its strong component; to[ends[v] : ends[v + 1]] are the vertices that v leads to."""
    label, seen, low, at = [-1] * n, [0] * n, [0] * n, ends[:n]
    count, stack = 0, []
    for root in range(n):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        stack.append(root)
        path = [root]
        while path:
            v = path[-1]
            if at[v] < ends[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    stack.append(w)
                    path.append(w)
                elif label[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                first = len(stack) - 1
                while stack[first] != v:
                    first -= 1
                least = min(stack[first:])
                for w in stack[first:]:
                    label[w] = least
                del stack[first:]
    return np.array(label, np.int64)
