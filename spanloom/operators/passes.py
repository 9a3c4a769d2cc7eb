"""Replay of captures by whole columns: each rule is a pass over numpy arrays of many captures at once.

A pass asks one question of all rows: what the clock of a core was, which interrupts were open, which task was
scheduled, what time a context was credited with, which return belongs to which call, what spoiled a call while it was
open. None of them keeps a state from row to row: running maxima, last-known values and pairs of brackets come from
sorted keys. ``nest`` pairs brackets of interrupts and of calls alike; only groups that do not nest are looked at one by
one, and only their brackets.

A capture longer than a chunk goes on in the next: ``State`` holds what is open, and each pass puts it before its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from spanloom.functions.scalar import QUALITY

KINDS = {k: i for i, k in enumerate(("", "FunctionEnter", "FunctionExit", "ContextSwitch", "InterruptEnter", "InterruptExit", "TraceGap", "SpanBegin", "SpanEnd", "AsyncBegin", "AsyncEnd"))}
CALL, RETURN, SWITCH, ENTER, EXIT, GAP, SPAN, SPAN_END, ASYNC, ASYNC_END, END = range(1, 12)
TEXTS = {"contexts": ("context_id", "prev_context_id", "next_context_id", "interrupt_id"), "functions": ("function_id",), "frames": ("frame_id",), "sources": ("source_id",), "activations": ("activation_id",), "spans": ("span_id",), "correlations": ("correlation_id",), "names": ("name",), "codes": ("told",)}
NUMBERS = ("ord", "ts_ns", "source_seq", "core_id", "duration_ns")
INFERRED = QUALITY.index("inferred")
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_NONE = np.zeros(0, np.int64)


# keys and running values


def combined(*parts: np.ndarray) -> np.ndarray:
    """One number for each distinct tuple."""
    key = parts[0]
    for part in parts[1:]:
        low = part.min(initial=0)
        key = np.unique(key, return_inverse=True)[1] * (part.max(initial=0) - low + 1) + part - low
    return key


def heads_of(key: np.ndarray) -> np.ndarray:
    """Whether each place of a sorted key starts a group."""
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


def highest(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Running maximum of each group."""
    if len(values) < 2 or ((values[1:] >= values[:-1]) | heads[1:]).all():
        return values
    distinct, place = np.unique(values, return_inverse=True)
    group = np.cumsum(heads) - 1
    return distinct[np.maximum.accumulate(group * len(distinct) + place) - group * len(distinct)]


def before(values: np.ndarray, heads: np.ndarray, none: int) -> np.ndarray:
    """The value of the row before in each group."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[heads] = none
    return out


class Last:
    """Values known from a place of a group on: ``at`` gives the last one before a place, or the last up to it."""

    def __init__(self, group: np.ndarray, place: np.ndarray, width: int) -> None:
        self.width = width + 2
        self.keys = group * self.width + place + 1
        self.group = group

    def at(self, group: np.ndarray, place: np.ndarray, itself: bool = False) -> np.ndarray:
        """Index of the entry, or -1."""
        if not len(self.keys):
            return np.full(len(group), -1)
        found = np.searchsorted(self.keys, group * self.width + place + 1, side="right" if itself else "left") - 1
        return np.where((found >= 0) & (self.group[found] == group), found, -1)


@dataclass
class Nested:
    """Brackets in pairs: ``match`` leads from an opening to what closes it and from a closing to its opening, or is -1."""

    match: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    forced: np.ndarray  # openings closed from below
    wrong: np.ndarray  # closings whose opening was not the innermost


def nest(group: np.ndarray, opens: np.ndarray, fits, keys: tuple[np.ndarray, np.ndarray] | None = None) -> Nested:
    """Pair the brackets of each group, which is sorted and in order; ``fits(closing, opening)`` is by index.

    ``keys``, a name and a detail of each bracket, say the same: a closing fits openings of its name and, if it has one, its detail.
    A closing takes the innermost opening that fits and closes what is open inside it. Where depths never fall below
    zero and all neighbours of one depth fit, pairs follow from depth alone.
    """
    n = len(group)
    at = np.arange(n)
    heads = heads_of(group)
    number = np.cumsum(heads) - 1
    run = np.cumsum(np.where(opens, 1, -1))
    depth = run - np.where(heads, run - np.where(opens, 1, -1), 0)[np.flatnonzero(heads)][number] if n else run
    level = np.where(opens, depth, depth + 1)
    match, parent = np.full(n, -1), np.full(n, -1)
    forced, wrong = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return Nested(match, parent, level, forced, wrong)
    bad = np.zeros(number[-1] + 1, bool)
    bad[number[level < 1]] = True
    width = max(int(level.max()), 1) + 1
    place = number * width + np.maximum(level, 0)
    order = np.argsort(place, kind="stable")
    prior, later = order[:-1], order[1:]
    pair = (place[prior] == place[later]) & opens[prior] & ~opens[later]
    prior, later = prior[pair], later[pair]
    bad[number[later[~fits(later, prior)]]] = True
    good = ~bad[number[later]]
    match[later[good]], match[prior[good]] = prior[good], later[good]
    inner = np.flatnonzero(opens & (level > 1) & ~bad[number])
    above = np.searchsorted(place[order] * n + order, (place[inner] - 1) * n + inner) - 1
    parent[inner] = order[above]
    starts = np.append(np.flatnonzero(heads), n)
    for k in np.flatnonzero(bad).tolist():
        a, b = int(starts[k]), int(starts[k + 1])
        if keys is not None:
            _stacked(slice(a, b), opens, *keys, match, parent, level, forced, wrong)
            continue
        stack: list[int] = []
        for i in range(a, b):
            if opens[i]:
                parent[i] = stack[-1] if stack else -1
                stack.append(i)
                level[i] = len(stack)
                continue
            inside = np.array(stack[::-1], np.int64)
            hit = np.flatnonzero(fits(np.full(len(inside), i), inside))
            if len(hit):
                own = inside[: hit[0] + 1]
                match[own], match[i] = i, own[-1]
                forced[own[:-1]] = True
                wrong[i] = hit[0] > 0
                del stack[-len(own) :]
    return Nested(match, parent, level, forced, wrong)


def _stacked(own: slice, opens: np.ndarray, name: np.ndarray, detail: np.ndarray, match: np.ndarray, parent: np.ndarray, level: np.ndarray, forced: np.ndarray, wrong: np.ndarray) -> None:
    """``nest`` for one group whose brackets do not nest; a step a bracket, however deep they are."""
    keys, details = name[own].tolist(), detail[own].tolist()
    first, m, p, d, f, w = own.start, match[own].tolist(), parent[own].tolist(), level[own].tolist(), forced[own].tolist(), wrong[own].tolist()
    stack: list[int] = []
    places: dict = {}  # where in the stack openings of a name, or of a name and detail, are
    for i, is_open in enumerate(opens[own].tolist()):
        key, more = keys[i], details[i]
        if is_open:
            p[i] = first + stack[-1] if stack else -1
            places.setdefault(key, []).append(len(stack))
            if more >= 0:
                places.setdefault((key, more), []).append(len(stack))
            stack.append(i)
            d[i] = len(stack)
            continue
        fitting = places.get(key if more < 0 else (key, more))
        if not fitting:
            continue
        depth = fitting[-1]
        w[i] = depth < len(stack) - 1
        while len(stack) > depth:
            j = stack.pop()
            places[keys[j]].pop()
            if details[j] >= 0:
                places[keys[j], details[j]].pop()
            m[j] = first + i
            f[j] = len(stack) > depth
        m[i] = first + j
    match[own], parent[own], level[own], forced[own], wrong[own] = m, p, d, f, w


# state between chunks of one capture


@dataclass
class State:
    """What is open of a capture, by name."""

    cores: dict = field(default_factory=dict)  # core -> (clock, scheduled, since)
    sources: dict = field(default_factory=dict)  # source -> (highest number, highest time)
    stacks: list = field(default_factory=list)  # (core, interrupt, activation, entered, ord, cpu, tainted), outermost first
    frames: list = field(default_factory=list)  # (place in stacks or task name, values of _FRAME)
    tasks: dict = field(default_factory=dict)  # task -> cpu
    tainted: set = field(default_factory=set)  # tasks
    retired: dict = field(default_factory=dict)  # interrupt -> cpu
    overlaps: set = field(default_factory=set)
    marks: list = field(default_factory=list)  # values of _MARK
    end: int = LOW
    last_ord: int = -1


_FRAME = ("ord", "source", "seq", "core", "public", "function", "frame", "start", "cpu", "rank", "spoiled", "below")
_MARK = ("kind", "source", "core", "context", "key", "name", "ts", "ord", "seq")


class Names:
    """Codes of texts; those of a state are added."""

    def __init__(self, columns: list[pa.ChunkedArray], more: list[str | None]) -> None:
        sizes = [len(c) for c in columns]
        whole = pa.concat_arrays([x.cast(pa.string()) for c in columns for x in c.chunks] + [pa.array(more, pa.string())])
        coded = whole.dictionary_encode()
        self.texts = coded.dictionary
        flat = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = np.split(flat, np.cumsum(sizes))[: len(sizes)]
        self._number: dict | None = None

    def number(self, text: str | None) -> int:
        if text is None:
            return -1
        if self._number is None:
            self._number = {t: k for k, t in enumerate(self.texts.to_pylist())}
        return self._number[text]

    def text(self, code: int) -> str | None:
        return None if code < 0 else self.texts[int(code)].as_py()

    def take(self, codes: np.ndarray) -> pa.Array:
        if not len(self.texts):
            return pa.nulls(len(codes), pa.string())
        return self.texts.take(pa.array(codes, mask=codes < 0))


class Replay:
    """One chunk: some captures that end in it, and at most one, the last, that goes on."""

    def __init__(self, table: pa.Table, switches: bool, state: State | None, ends: bool, end: int | None = None, name: str | None = None) -> None:
        """``table`` has session_id and any of the input columns, in order; ``ends``: whether the last capture is over.

        A state without further rows is of the capture ``name``.
        """
        self.switches, self.carried, self.ends = switches, state, ends
        carried = state or State()
        n = table.num_rows
        none = lambda kind: pa.chunked_array([pa.nulls(n, kind)])
        column = lambda c, kind: table[c] if c in table.column_names else none(kind)
        held = {
            "contexts": [*(x[1] for x in carried.stacks), *carried.tasks, *carried.retired, *(s[1] for s in carried.cores.values()), *(x[1][4] for x in carried.frames), *(x[3] for x in carried.marks)],
            "functions": [x[1][5] for x in carried.frames], "frames": [x[1][6] for x in carried.frames], "sources": [*carried.sources, *(x[1][1] for x in carried.frames), *(x[1] for x in carried.marks)], "activations": [x[2] for x in carried.stacks],
            "spans": [x[4] for x in carried.marks if x[0] == SPAN], "correlations": [x[4] for x in carried.marks if x[0] == ASYNC], "names": [x[5] for x in carried.marks], "codes": [],
        }
        for attr, columns in TEXTS.items():
            setattr(self, attr, Names([column(c, pa.string()) for c in columns], held[attr]))
        session = table["session_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = session.indices.to_numpy()
        heads = heads_of(code)
        number = np.cumsum(heads) - 1
        self.sessions = table["session_id"].combine_chunks().take(pa.array(np.flatnonzero(heads))) if n or not state else pa.array([name], pa.string())
        self.count = count = len(self.sessions)
        kinds = table["type"].combine_chunks().dictionary_encode()
        kind = np.array([KINDS.get(k, 0) for k in kinds.dictionary.to_pylist()] + [0])[kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False)]
        quality = column("quality", pa.string()).combine_chunks().dictionary_encode()
        rank = np.array([QUALITY.index(q) if q in QUALITY else 0 for q in quality.dictionary.to_pylist()] + [0])[quality.indices.fill_null(len(quality.dictionary)).to_numpy(zero_copy_only=False)]
        numbers = {}
        for c, low in zip(NUMBERS, (-1, 0, LOW, LOW, 0), strict=True):
            numbers[c] = column(c, pa.int64()).combine_chunks().cast(pa.int64()).fill_null(low).to_numpy(zero_copy_only=False)
        texts = {c: codes for attr, columns in TEXTS.items() for c, codes in zip(columns, getattr(self, attr).codes, strict=True)}
        # the end of each capture is a row after its last
        last = np.append(np.flatnonzero(heads)[1:], n) - 1 if count else _NONE
        self.over = np.ones(count, bool)
        self.over[-1:] = ends
        at = last[self.over] + 1
        put = lambda x, v: np.insert(x, at, v) if len(at) else np.array(x)
        self.ord = put(numbers["ord"], (numbers["ord"][last[self.over]] if n else np.full(len(at), carried.last_ord)) + 1)
        self.kind, self.rank, self.session = put(kind, END), put(rank, INFERRED), put(number, np.flatnonzero(self.over))
        self.seq, self.core, self.duration = put(numbers["source_seq"], LOW), put(numbers["core_id"], LOW), put(numbers["duration_ns"], 0)
        self.text = {c: put(codes, -1) for c, codes in texts.items()}
        self.ts = put(numbers["ts_ns"], LOW)
        self.n = len(self.kind)
        self.out: list[dict] = []
        self.spoils: list[tuple[np.ndarray, np.ndarray]] = []  # execution contexts and rows
        self.storms: list[tuple[np.ndarray, np.ndarray]] = []  # captures and rows
        self.taints: list[tuple[np.ndarray, np.ndarray]] = []
        gap = self.kind == GAP
        self.gap_end = np.where(gap, self.ts + self.duration, self.ts)
        ends_at = np.full(count, LOW)
        ends_at[:1] = carried.end
        np.maximum.at(ends_at, self.session, self.gap_end)
        self.end = ends_at
        rows = np.flatnonzero(self.kind == END)
        self.end_row = np.full(count, -1)
        self.end_row[self.session[rows]] = rows
        self.ts[rows] = self.gap_end[rows] = ends_at[self.session[rows]] if end is None else end
        self.state = carried
        if count:
            self._run()

    # rows out

    def count_rows(self) -> None:
        """A row for each capture: how many of its rows are in this chunk."""
        first = np.flatnonzero(heads_of(self.session))
        counts = np.bincount(self.session[self.kind != END], minlength=self.count)
        self._put("session", first, ord=pa.array(counts[self.session[first]].astype(np.int64)))

    def _put(self, kind: str, rows: np.ndarray, **values: np.ndarray | pa.Array) -> None:
        if len(rows):
            self.out.append({"kind": pa.array([kind]).take(pa.array(np.zeros(len(rows), np.int8))), "session_id": self.sessions.take(pa.array(self.session[rows]))} | values)

    def _fact(self, code: str | pa.Array, rows: np.ndarray, start: np.ndarray, end: np.ndarray, core: np.ndarray | None = None, context: np.ndarray | None = None, function: np.ndarray | None = None) -> None:
        more = {}
        if core is not None:
            more["core_id"] = _whole(core)
        if context is not None:
            more["context_id"] = self.contexts.take(context)
        if function is not None:
            more["function_id"] = self.functions.take(function)
        if isinstance(code, str):
            code = pa.array([code]).take(pa.array(np.zeros(len(rows), np.int8)))
        self._put("fact", rows, ord=pa.array(self.ord[rows]), source_id=self._source(rows), source_seq_start=_whole(self.seq[rows]), source_seq_end=_whole(self.seq[rows]), start_ns=pa.array(start), end_ns=pa.array(end), code=code, **more)

    def _source(self, rows: np.ndarray) -> pa.Array:
        own = self.sources.take(self.text["source_id"][rows])
        closed = self.kind[rows] == END
        return pa.compute.if_else(pa.array(closed), "analyzer", own) if closed.any() else own

    # the passes, in order of what each needs

    def _run(self) -> None:
        self._source_order()
        self._interrupt_pairs()
        self._clocks()
        self._schedules()
        self._credits()
        self._owners()
        self._calls()
        self._interrupt_rows()
        self._marks()
        self._told()
        self._totals()
        if not self.ends:
            self._keep()

    def _source_order(self) -> None:
        """A source's numbers rise by one and its time never falls; both are held against the highest so far."""
        rows = np.flatnonzero(self.kind != END)
        known = [(self.sources.number(s), q, t) for s, (q, t) in self.carried.sources.items()] if self.carried else []
        many = max(len(self.sources.texts), 1)
        key = np.concatenate([np.array([s for s, _, _ in known], np.int64), self.session[rows] * many + self.text["source_id"][rows]])
        row = np.concatenate([np.full(len(known), -1), rows])
        seq = np.concatenate([np.array([LOW if q is None else q for _, q, _ in known], np.int64), self.seq[rows]])
        out = np.concatenate([np.array([t for _, _, t in known], np.int64), self.gap_end[rows]])
        order = np.argsort(key, kind="stable")
        key, row, seq, out = key[order], row[order], seq[order], out[order]
        heads = heads_of(key)
        top_time, top_seq = highest(out, heads), highest(seq, heads)
        seen, seen_seq = before(top_time, heads, LOW), before(top_seq, heads, LOW)
        real = (row >= 0) & ~heads
        counted = real & (seq > LOW) & (seen_seq > LOW)
        for code, hit in (("out_of_order_sequence", counted & (seq <= seen_seq)), ("trace_gap", counted & (seq > seen_seq) & (seq - 1 > seen_seq)), ("out_of_order_timestamp", real & (self.ts[row] < seen))):
            where, was = row[hit], seen[hit]
            if not len(where):
                continue
            ts = self.ts[where]
            low, high = (ts, ts) if code == "out_of_order_sequence" else (np.minimum(was, ts), np.maximum(was, ts))
            self._fact(code, where, low, high)
            self.storms.append((self.session[where], where))
        gaps = np.flatnonzero(self.kind == GAP)
        self.storms.append((self.session[gaps], gaps))
        self._fact("trace_gap", gaps, self.ts[gaps], self.gap_end[gaps])
        tails = np.append(np.flatnonzero(heads)[1:], len(key)) - 1 if len(key) else _NONE
        self.source_tops = (key[tails], top_seq[tails], top_time[tails])

    def _interrupt_pairs(self) -> None:
        """Which interrupt was innermost on a core after each of its boundaries."""
        core = np.unique(np.concatenate([self.core, np.array([*(self.carried.cores if self.carried else ())], np.int64)]))
        self.core_names, self.width = core, len(core)
        self.core_of = np.searchsorted(core, self.core)
        rows = np.flatnonzero((self.kind == ENTER) | (self.kind == EXIT))
        old = self.carried.stacks if self.carried else []
        place = self.session * self.width + self.core_of
        group = np.concatenate([np.array([np.searchsorted(core, x[0]) for x in old], np.int64), place[rows]])
        row = np.concatenate([np.full(len(old), -1), rows])
        opens = np.concatenate([np.ones(len(old), bool), self.kind[rows] == ENTER])
        interrupt = np.concatenate([np.array([self.contexts.number(x[1]) for x in old], np.int64), self.text["interrupt_id"][rows]])
        activation = np.concatenate([np.array([self.activations.number(x[2]) for x in old], np.int64), self.text["activation_id"][rows]])
        order = np.argsort(group, kind="stable")
        self.i_row, self.i_group, self.i_opens, self.i_name, self.i_activation = row[order], group[order], opens[order], interrupt[order], activation[order]
        self.i_old = order  # below len(old): place in the state
        own = self.i_name * (len(self.activations.texts) + 1) + self.i_activation
        self.i_pairs = p = nest(self.i_group, self.i_opens, lambda a, b: own[a] == own[b], (own, np.full(len(own), -1)))
        top = np.where(self.i_opens, np.arange(len(row)), np.where(p.match >= 0, p.parent[p.match], -2))
        known = np.maximum.accumulate(np.where(top > -2, np.arange(len(row)), -1)) if len(row) else top
        start = np.flatnonzero(heads_of(self.i_group))[np.cumsum(heads_of(self.i_group)) - 1] if len(row) else known
        self.i_top = np.where(known >= start, top[known], -1) if len(row) else top
        self.i_last = Last(self.i_group, self.i_row, self.n)
        # contexts of execution: tasks by capture and name, then interrupt activations
        self.base = self.count * max(len(self.contexts.texts), 1)
        closed = np.where(p.match >= 0, self.i_row[p.match], self.end_row[self.i_group // self.width])
        self.i_close = np.where(self.i_opens, closed, -1)  # -1: still open

    def _tops(self, group: np.ndarray, row: np.ndarray) -> np.ndarray:
        found = self.i_last.at(group, row)
        return np.where(found >= 0, self.i_top[found], -1) if len(self.i_top) else found

    def _clocks(self) -> None:
        """Time of each core: it never goes back, and a gap moves all cores seen so far past its end."""
        kind = self.kind
        rows = np.flatnonzero((kind != GAP) & (kind != END) & ((self.core > LOW) | (kind >= CALL) & (kind <= EXIT)))
        group = self.session[rows] * self.width + self.core_of[rows]
        order = np.argsort(group, kind="stable")
        first = order[heads_of(group[order])] if len(group) else _NONE
        known, since = group[first], rows[first]
        clocks = {int(np.searchsorted(self.core_names, c)): x[0] for c, x in self.carried.cores.items()} if self.carried else {}
        if clocks:
            fresh = ~np.isin(known, list(clocks))
            known, since = np.concatenate([np.array([*clocks], np.int64), known[fresh]]), np.concatenate([np.full(len(clocks), -1), since[fresh]])
        sweep = np.flatnonzero((kind == GAP) | (kind == END))
        by = np.argsort(known, kind="stable")
        known, since = known[by], since[by]
        low, high = (np.searchsorted(known // self.width, self.session[sweep], side=s) for s in ("left", "right"))
        each = high - low
        at = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        swept, cores = np.repeat(sweep, each), known[at] if len(known) else _NONE
        seen = since[at] < swept if len(known) else np.zeros(0, bool)
        swept, cores = swept[seen], cores[seen]
        old = np.array([*clocks], np.int64)
        group = np.concatenate([old, group, cores])
        row = np.concatenate([np.full(len(old), -1), rows, swept])
        out = np.concatenate([np.array([*clocks.values()], np.int64), self.ts[rows], self.gap_end[swept]])
        order = np.lexsort((row, group))
        group, row, out = group[order], row[order], out[order]
        heads = heads_of(group)
        top = highest(out, heads)
        clock, ts = before(top, heads, LOW), self.ts[row]
        real = (row >= 0) & ~heads
        self.e_group, self.e_row, self.e_clock, self.e_ts = group, row, clock, ts
        self.e_back, self.e_gain = real & (ts < clock), real & (ts > clock)
        self.core_tops = (group, top, heads)
        self.time = self.ts.copy()
        single = (row >= 0) & (kind[row] != GAP) & (kind[row] != END)
        self.time[row[single]] = np.maximum(ts, clock)[single]
        ends = np.flatnonzero(kind == END)
        self.time[ends] = np.maximum(self.ts[ends], self.end[self.session[ends]])

    def _schedules(self) -> None:
        """The task of each core: the last switch to one; before any, or without switches, calls outside interrupts tell it."""
        kind, many = self.kind, max(len(self.contexts.texts), 1)
        place = self.session * self.width + self.core_of
        calls = np.flatnonzero((kind == CALL) | (kind == RETURN))
        self.c_rows, self.c_top = calls, self._tops(place[calls], calls)
        told = calls[self.c_top < 0]
        switch = np.flatnonzero(kind == SWITCH)
        old = [(int(np.searchsorted(self.core_names, c)), self.contexts.number(x[1]), x[2]) for c, x in self.carried.cores.items() if x[1] is not None] if self.carried else []
        if self.switches:
            group = np.concatenate([np.array([c for c, _, _ in old], np.int64), place[switch], place[told]])
            row = np.concatenate([np.full(len(old), -1), switch, told])
            order = np.lexsort((row, group))
            first = row[order[heads_of(group[order])]] if len(group) else _NONE
            told = told[np.isin(told, first)]
        group = np.concatenate([np.array([c for c, _, _ in old], np.int64), place[switch], place[told]])
        row = np.concatenate([np.full(len(old), -1), switch, told])
        task = np.concatenate([np.array([t for _, t, _ in old], np.int64), self.text["next_context_id"][switch], self.text["context_id"][told]])
        since = np.concatenate([np.array([s for _, _, s in old], np.int64), self.time[switch], self.time[told]])
        order = np.lexsort((row, group))
        self.s_group, self.s_row, self.s_task, since = group[order], row[order], task[order], since[order]
        heads = heads_of(self.s_group)
        new = heads | (self.s_task != before(self.s_task, heads, -1))
        self.s_since = since[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else since
        self.s_last = Last(self.s_group, self.s_row, self.n)
        self.implicit = np.zeros(self.n, bool)
        self.implicit[told] = True
        scheduled = self._scheduled(self.e_group, self.e_row)
        top = self._tops(self.e_group, self.e_row)
        self.e_top, self.e_task = top, scheduled
        self.e_ran = np.where(top >= 0, self.base + top, np.where(scheduled >= 0, self.e_group // self.width * many + scheduled, -1))
        held = self._scheduled(place[switch], switch)
        said = self.text["prev_context_id"][switch]
        hit = (said >= 0) & (held >= 0) & (held != said)
        rows, held, said = switch[hit], held[hit], said[hit]
        self._fact("context_switch_mismatch", rows, self.time[rows], self.time[rows], self.core[rows], said)
        for x in (held, said):
            self.spoils.append((self.session[rows] * many + x, rows))

    def _scheduled(self, group: np.ndarray, row: np.ndarray, itself: bool = False) -> np.ndarray:
        found = self.s_last.at(group, row, itself)
        return np.where(found >= 0, self.s_task[found], -1) if len(self.s_task) else found

    def _credits(self) -> None:
        """Time between two events of a core goes to what ran before the second."""
        back = np.flatnonzero(self.e_back)
        rows = self.e_row[back]
        self._fact("out_of_order_timestamp", rows, self.e_ts[back], self.e_clock[back], self.core_names[self.e_group[back] % self.width])
        ran = self.e_ran[back]
        self.spoils.append((ran[ran >= 0], rows[ran >= 0]))
        upto = self.e_ts.copy()
        self._overlaps(upto)
        gain = np.flatnonzero(self.e_gain)
        nobody = gain[self.e_ran[gain] < 0]
        self._fact("missing_scheduled_context", self.e_row[nobody], self.e_clock[nobody], self.e_ts[nobody], self.core_names[self.e_group[nobody] % self.width])
        gain = gain[self.e_ran[gain] >= 0]
        context, row = self.e_ran[gain], self.e_row[gain]
        amount = np.where(self.e_top[gain] >= 0, self.e_ts[gain], upto[gain]) - self.e_clock[gain]
        if self.carried:
            old = [(self.contexts.number(t), cpu) for t, cpu in self.carried.tasks.items()]
            place = np.empty(len(self.i_old), np.int64)
            place[self.i_old] = np.arange(len(self.i_old))
            self.i_of_state = place[: len(self.carried.stacks)]
            old += [(self.base + int(i), x[5]) for i, x in zip(self.i_of_state, self.carried.stacks, strict=True)]
            context = np.concatenate([np.array([c for c, _ in old], np.int64), context])
            amount = np.concatenate([np.array([a for _, a in old], np.int64), amount])
            row = np.concatenate([np.full(len(old), -1), row])
        order = np.lexsort((row, context))
        context, row, amount = context[order], row[order], amount[order]
        total = np.cumsum(amount)
        heads = heads_of(context)
        start = np.flatnonzero(heads)
        self.k_total = total - (total[start] - amount[start])[np.cumsum(heads) - 1] if len(total) else total
        self.k_last = Last(context, row, self.n)

    def _cpu(self, context: np.ndarray, row: np.ndarray) -> np.ndarray:
        """What a context was credited with up to a row, itself included."""
        found = self.k_last.at(context, row, itself=True)
        return np.where(found >= 0, self.k_total[found], 0) if len(self.k_total) else np.zeros(len(context), np.int64)

    def _overlaps(self, upto: np.ndarray) -> None:
        """A task that several cores have at once is credited on the lowest only, and nothing of it is sure from then on.

        Only tasks that more than one core of a capture has had are swept, over their times on each core.
        """
        many = max(len(self.contexts.texts), 1)
        task = self.s_group // self.width * many + self.s_task
        self.told = {(self.contexts.number(t), a, b) for t, a, b in self.state.overlaps}
        pairs = np.unique(np.stack([task, self.s_group], axis=1), axis=0) if len(task) else np.zeros((0, 2), np.int64)
        twice = pairs[1:, 0][pairs[1:, 0] == pairs[:-1, 0]]
        if not len(twice):
            return
        # a stay is the time from a schedule row of the task to the next one of the core, in rows
        following = np.append(self.s_row[1:], self.n)
        following[np.append(self.s_group[1:] != self.s_group[:-1], True)] = self.n
        names = np.unique(twice)
        pairs = pairs[np.isin(pairs[:, 0], names)]
        of = lambda task, group: np.searchsorted(pairs[:, 0] * width + pairs[:, 1], task * width + group)
        width = int(pairs[:, 1].max()) + 1
        stays = np.flatnonzero(np.isin(task, names))
        order = np.argsort(of(task[stays], self.s_group[stays]), kind="stable")
        stays = stays[order]
        known = Last(of(task[stays], self.s_group[stays]), self.s_row[stays], self.n)
        # credits of these tasks in order, each against every core that has had the task
        events = np.flatnonzero(self.e_gain & (self.e_task >= 0))
        owner = self.e_group[events] // self.width * many + self.e_task[events]
        events, owner = (x[np.isin(owner, names)] for x in (events, owner))
        order = np.lexsort((self.e_row[events], owner))
        events, owner = events[order], owner[order]
        low, high = np.searchsorted(pairs[:, 0], owner), np.searchsorted(pairs[:, 0], owner, side="right")
        many_cores = high - low
        which = np.repeat(np.arange(len(events)), many_cores)
        pair = np.arange(len(which)) - np.repeat(np.cumsum(many_cores) - many_cores, many_cores) + low[which]
        group, mine = pairs[pair, 1], self.e_group[events][which]
        row = self.e_row[events][which]
        stay = known.at(pair, row)
        now = (stay >= 0) & (following[stays[stay]] >= row)
        since = np.where(now, self.s_since[stays[stay]], LOW)
        own = np.full(len(events), LOW)
        at = group == mine
        own[which[at]] = since[at]
        begin = np.maximum(np.maximum(since, own[which]), self.e_clock[events][which])
        hit = now & ~at & (begin < self.e_ts[events][which])
        which, group, mine, begin, row = which[hit], group[hit], mine[hit], begin[hit], row[hit]
        if not len(which):
            return
        self.taints.append((owner[which], row))
        lower = group < mine
        np.minimum.at(upto, events[which[lower]], begin[lower])
        # a pair of cores is told once of a task, by the first credit that both had it in
        cores = np.sort(np.stack([self.core_names[mine % self.width], self.core_names[group % self.width]], axis=1), axis=1)
        keys, firsts = np.unique(np.column_stack([owner[which], cores]), axis=0, return_index=True)
        told = [tuple(k) in self.told for k in keys.tolist()]
        self.told.update(tuple(k) for k in keys.tolist())
        new = firsts[~np.array(told, bool)]
        if len(new):
            event, place = np.unique(which[new], return_inverse=True)
            start = np.full(len(event), HIGH)
            np.minimum.at(start, place, begin[new])
            credits = events[event]
            self._fact("concurrent_context", self.e_row[credits], start, self.e_ts[credits], self.core_names[self.e_group[credits] % self.width], owner[event] % many)

    def _owners(self) -> None:
        """The execution context of each call: the running one if the call names it, else the one that it names."""
        many = max(len(self.contexts.texts), 1)
        rows, top = self.c_rows, self.c_top
        group = self.session[rows] * self.width + self.core_of[rows]
        said = self.text["context_id"][rows]
        task = self._scheduled(group, rows, itself=True)
        ran = np.where(top >= 0, self.base + top, np.where(task >= 0, self.session[rows] * many + task, -1))
        public = np.where(top >= 0, self.i_name[top] if len(self.i_name) else -1, task)
        agrees = self.implicit[rows] | (public == said) | (ran < 0)
        # in an interrupt with no match, or one that no task is scheduled below
        own = np.where(agrees & (ran >= 0), ran, self.session[rows] * many + said)
        for k in np.flatnonzero(~agrees & (top >= 0)).tolist():
            i = self.i_pairs.parent[top[k]]
            while i >= 0 and self.i_name[i] != said[k]:
                i = self.i_pairs.parent[i]
            if i >= 0:
                own[k] = self.base + i
        off = ~agrees
        where = rows[off]
        self._fact("context_mismatch", where, self.time[where], self.time[where], self.core[where], said[off])
        self.spoils += [(ran[off], where), (own[off], where)]
        self.c_own, self.c_agrees = own, agrees
        # what counts as a task of a capture: scheduled, or named by a call
        named = np.concatenate([(self.s_group // self.width * many + self.s_task)[self.s_task >= 0], own[own < self.base]])
        if self.carried:
            named = np.concatenate([np.array([self.contexts.number(t) for t in self.carried.tasks], np.int64), named])
        self.tasks = np.unique(named)

    def _calls(self) -> None:
        """Calls with their returns, their own time and what spoiled them."""
        rows = self.c_rows
        old = self.carried.frames if self.carried else []
        f = {c: [x[1][k] for x in old] for k, c in enumerate(_FRAME)}
        joined = lambda a, b: np.concatenate([np.array(a, np.int64), b])
        context = joined([self.base + int(self.i_of_state[x[0]]) if isinstance(x[0], int) else self.contexts.number(x[0]) for x in old], self.c_own)
        row = joined([-1] * len(old), rows)
        opens = np.concatenate([np.ones(len(old), bool), self.kind[rows] == CALL])
        function = joined([self.functions.number(x) for x in f["function"]], self.text["function_id"][rows])
        frame = joined([self.frames.number(x) for x in f["frame"]], self.text["frame_id"][rows])
        source = joined([self.sources.number(x) for x in f["source"]], self.text["source_id"][rows])
        order = np.argsort(context, kind="stable")
        context, row, opens, function, frame, source = (x[order] for x in (context, row, opens, function, frame, source))
        agrees = np.concatenate([~np.array(f["spoiled"], bool), self.c_agrees])[order]
        p = nest(context, opens, lambda a, b: (function[a] == function[b]) & ((frame[a] < 0) | (frame[a] == frame[b])), (function, frame))
        # returns
        shut = np.flatnonzero(~opens)
        alone = shut[p.match[shut] < 0]
        paired = shut[p.match[shut] >= 0]
        odd = paired[p.wrong[paired] | (source[paired] != source[p.match[paired]])]
        for code, at in (("unmatched_function_exit", alone), ("mismatched_function_exit", odd)):
            where = row[at]
            self._fact(code, where, self.time[where], self.time[where], None, self.text["context_id"][where], function[at])
            self.spoils.append((context[at], where))
        is_odd = np.zeros(len(row), bool)
        is_odd[odd] = True
        # calls: where they end
        call = np.flatnonzero(opens)
        by = p.match[call]
        returned = by >= 0
        isr = context[call] >= self.base
        task_session = np.minimum(context[call] // max(len(self.contexts.texts), 1), self.count - 1)
        left = np.where(isr, self.i_close[np.where(isr, context[call] - self.base, 0)] if len(self.i_close) else -1, self.end_row[task_session])
        close = np.where(returned, row[by], left)
        forced = ~returned | p.forced[call] | is_odd[by] & returned & (p.match[by] == call)
        rank = np.where(returned, self.rank[row[by]], INFERRED)
        entry = row[call]
        values = {c: np.concatenate([np.array(v if c in ("ord", "start", "cpu", "rank", "below") else [0] * len(v), np.int64), w])[order][call] for c, v, w in (("ord", f["ord"], self.ord[rows]), ("start", f["start"], self.time[rows]), ("rank", f["rank"], self.rank[rows]), ("cpu", f["cpu"], self._cpu(self.c_own, rows)), ("below", f["below"], np.zeros(len(rows), np.int64)))}
        seq = np.concatenate([np.array([LOW if x is None else x for x in f["seq"]], np.int64), self.seq[rows]])[order][call]
        core = np.concatenate([np.array([LOW if x is None else x for x in f["core"]], np.int64), self.core[rows]])[order][call]
        public = joined([self.contexts.number(x) for x in f["public"]], self.text["context_id"][rows])[order][call]
        ended = close >= 0
        end = np.where(ended, self.time[close], 0)
        elapsed = np.maximum(end - values["start"], 0)
        ran = np.where(ended, self._cpu(context[call], np.maximum(close, 0)) - values["cpu"], 0)
        active = np.clip(ran, 0, elapsed)
        number = np.full(len(row) + 1, -1)
        number[call] = np.arange(len(call))
        parent = number[p.parent[call]]
        nested = ended & (parent >= 0)
        below = values["below"] + np.bincount(parent[nested], active[nested].astype(np.float64), len(call)).astype(np.int64) if active.sum(dtype=np.float64) < 2.0**53 else _sums(values["below"], parent[nested], active[nested])
        spoiled = ~agrees[call] | self._spoiled(context[call], entry, np.where(ended, close, self.n))
        marked = spoiled | ended & (forced | (ran > elapsed) | (below > active))
        wave = np.flatnonzero(marked & nested)
        while len(wave):
            up = np.unique(parent[wave])
            up = up[~marked[up]]
            marked[up] = True
            wave = up[nested[up]]
        open_ = np.flatnonzero(ended & ~returned)
        where = close[open_]
        self._fact("unclosed_function", where, end[open_], end[open_], core[open_], public[open_], function[call][open_])
        done = np.flatnonzero(ended)
        worst = np.maximum(np.maximum(values["rank"], rank), np.where(marked, INFERRED, 0))[done]
        above = parent[done]
        where = close[done]
        self._put(
            "span", where, ord=pa.array(values["ord"][done]), parent_ord=pa.array(values["ord"][above], mask=above < 0) if len(done) else None, source_id=self.sources.take(source[call][done]), source_seq_start=_whole(seq[done]), source_seq_end=_whole(self.seq[where]), core_id=_whole(core[done]), context_id=self.contexts.take(public[done]),
            ctx_kind=self._kinds(public[done], isr[done]), function_id=self.functions.take(function[call][done]), depth=pa.array(p.level[call][done]), start_ns=pa.array(values["start"][done]), end_ns=pa.array(np.maximum(end, values["start"])[done]), elapsed_ns=pa.array(elapsed[done]), active_ns=pa.array(active[done]),
            self_ns=pa.array(np.maximum(active - below, 0)[done]), preempted_ns=pa.array((elapsed - active)[done]), incomplete=pa.array(marked[done]), quality=pa.array(QUALITY).take(pa.array(worst)),
        )
        if not self.ends:
            kept = np.flatnonzero(~ended)
            self.f_kept = (context[call], kept, {"ord": values["ord"], "source": source[call], "seq": seq, "core": core, "public": public, "function": function[call], "frame": frame[call], "start": values["start"], "cpu": values["cpu"], "rank": values["rank"], "spoiled": marked, "below": below})

    def _spoiled(self, context: np.ndarray, entry: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Whether something spoiled an execution context, or all of its capture, while a call was open; or tainted it before."""
        many = max(len(self.contexts.texts), 1)
        out = np.zeros(len(context), bool)
        width = self.n + 2

        def hit(events: list, key: np.ndarray, low: np.ndarray) -> np.ndarray:
            keys = np.sort(np.concatenate([g * width + r + 1 for g, r in events]))
            return np.searchsorted(keys, key * width + close + 1, side="right") > np.searchsorted(keys, key * width + low + 1, side="right")

        if self.carried:  # taints of earlier chunks
            self.taints.append((np.array([self.contexts.number(t) for t in self.carried.tainted], np.int64), np.full(len(self.carried.tainted), -1)))
            old = np.array([i for i, x in zip(self.i_of_state, self.carried.stacks, strict=True) if x[6]], np.int64)
            self.taints.append((self.base + old, np.full(len(old), -1)))
        self._duplicates()
        if any(len(r) for _, r in self.spoils + self.taints):
            out |= hit(self.spoils + self.taints, context, entry)
        if any(len(r) for _, r in self.taints):
            out |= hit(self.taints, context, np.full(len(context), -2))
        if any(len(r) for _, r in self.storms):
            isr = context >= self.base
            session = np.where(isr, self.i_group[np.where(isr, context - self.base, 0)] // self.width if len(self.i_group) else 0, context // many)
            out |= hit(self.storms, session, entry)
        return out

    def _duplicates(self) -> None:
        """Activations of one id open at once on a core."""
        at = np.flatnonzero(self.i_opens & (self.i_activation >= 0))
        key = self.i_group[at] * (len(self.activations.texts) + 1) + self.i_activation[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        heads = heads_of(key)
        until = np.where(self.i_close[at] >= 0, self.i_close[at], self.n)
        twice = np.flatnonzero((self.i_row[at] >= 0) & (before(highest(until, heads), heads, LOW) > self.i_row[at]))
        found = at[twice]
        rows = self.i_row[found]
        self._fact("duplicate_interrupt_activation", rows, self.time[rows], self.time[rows], self.core[rows], self.i_name[found])
        for k in twice.tolist():
            first = int(np.searchsorted(key, key[k]))
            own = at[first:k][until[first:k] > self.i_row[at[k]]]
            who = np.append(own, at[k])
            self.taints.append((self.base + who, np.full(len(who), self.i_row[at[k]])))

    def _interrupt_rows(self) -> None:
        """Interrupt activations that end, and boundaries that do not pair."""
        p = self.i_pairs
        shut = np.flatnonzero(~self.i_opens)
        wrong = shut[p.wrong[shut]]
        for code, at in (("unmatched_interrupt_exit", shut[p.match[shut] < 0]), ("mismatched_interrupt_exit", wrong)):
            rows = self.i_row[at]
            self._fact(code, rows, self.time[rows], self.time[rows], self.core[rows], self.i_name[at])
        done = np.flatnonzero(self.i_opens & (self.i_close >= 0))
        close = self.i_close[done]
        old = self.carried.stacks if self.carried else []
        pick = lambda k, live: np.where(self.i_row >= 0, live[self.i_row], np.array([x[k] for x in old] + [0], np.int64)[np.minimum(self.i_old, len(old))])
        self.i_entered, self.i_ord = pick(3, self.time), pick(4, self.ord)
        entered, end, core = self.i_entered[done], self.time[close], self.core_names[self.i_group[done] % self.width]
        left = self.kind[close] == END
        self._fact("unclosed_interrupt", close[left], entered[left], end[left], core[left], self.i_name[done][left])
        by = p.match[done]
        broken = left | p.forced[done] | (by >= 0) & p.wrong[by]
        cpu = self._cpu(self.base + done, close)
        above = p.parent[done]
        self._put(
            "interrupt", close, ord=pa.array(self.i_ord[done]), parent_ord=pa.array(self.i_ord[above], mask=above < 0) if len(done) else None, source_id=self._source(close), source_seq_end=_whole(self.seq[close]), core_id=_whole(core), context_id=self.contexts.take(self.i_name[done]), ctx_kind=self._kinds(self.i_name[done], np.ones(len(done), bool)),
            function_id=self.contexts.take(self._scheduled(self.i_group[done], close)), depth=pa.array(p.level[done]), start_ns=pa.array(entered), end_ns=pa.array(end), elapsed_ns=pa.array(np.maximum(end - entered, 0)), active_ns=pa.array(cpu), incomplete=pa.array(broken),
        )
        many = max(len(self.contexts.texts), 1)
        self.r_key, self.r_cpu = self.i_group[done] // self.width * many + self.i_name[done], cpu

    def _marks(self) -> None:
        """Spans between marks. A begin counts if its key is not open, an end if it is."""
        rows = np.flatnonzero((self.kind >= SPAN) & (self.kind <= ASYNC_END))
        old = self.carried.marks if self.carried else []
        if not len(rows) and not old:
            self.m_kept = []
            return
        kind = np.concatenate([np.array([x[0] for x in old], np.int64), self.kind[rows]])
        sync = kind <= SPAN_END
        session = np.concatenate([np.zeros(len(old), np.int64), self.session[rows]])
        row = np.concatenate([np.full(len(old), -1), rows])
        names = {"source": self.sources.number, "context": self.contexts.number, "name": self.names.number}
        v = {c: np.concatenate([np.array([names[c](x[_MARK.index(c)]) for x in old], np.int64), self.text[t][rows]]) for c, t in (("source", "source_id"), ("context", "context_id"), ("name", "name"))}
        live = np.where(self.kind[rows] <= SPAN_END, self.text["span_id"][rows], self.text["correlation_id"][rows])
        v["key"] = np.concatenate([np.array([(self.spans if x[0] == SPAN else self.correlations).number(x[4]) for x in old], np.int64), live])
        for c, column in (("core", self.core), ("ts", self.time), ("ord", self.ord), ("seq", self.seq)):
            v[c] = np.concatenate([np.array([LOW if x[_MARK.index(c)] is None else x[_MARK.index(c)] for x in old], np.int64), column[rows]])
        core = np.unique(v["core"], return_inverse=True)[1]
        group = combined(session, sync.astype(np.int64), v["source"], v["key"], np.where(sync, core, 0), np.where(sync, v["context"], -1))
        order = np.argsort(group, kind="stable")
        group, row, sync, session = group[order], row[order], sync[order], session[order]
        begins = ((kind == SPAN) | (kind == ASYNC))[order]
        v = {c: x[order] for c, x in v.items()}
        heads = heads_of(group)
        inside = before(begins.astype(np.int64), heads, 0) == 1  # whether the key was open
        real = begins & ~inside
        opened = np.maximum.accumulate(np.where(real, np.arange(len(row)), 0))
        again = np.flatnonzero(begins & inside)
        alone = np.flatnonzero(~begins & ~inside)
        ended = np.flatnonzero(~begins & inside)
        for form, word in ((True, "span"), (False, "async")):
            a, b = again[sync[again] == form], alone[sync[alone] == form]
            self._fact(f"duplicate_{word}_begin", row[a], v["ts"][opened[a]], v["ts"][a], v["core"][a], v["context"][a])
            self._fact(f"unmatched_{word}_end", row[b], v["ts"][b], v["ts"][b], v["core"][b], v["context"][b])
        tails = np.append(heads[1:], True)
        left = np.flatnonzero(tails & begins)
        end_row = self.end_row[session[left]]
        over = end_row >= 0
        for at, close, spoiled in ((ended, row[ended], False), (left[over], end_row[over], True)):
            start = opened[at]
            for form, word in ((True, "sync"), (False, "async")):
                pick = sync[at] == form
                s, c = start[pick], close[pick]
                if spoiled:
                    self._fact("unclosed_span" if form else "unclosed_async", c, v["ts"][s], self.time[c], v["core"][s], v["context"][s])
                self._put(word, c, ord=pa.array(v["ord"][s]), source_id=self.sources.take(v["source"][s]), source_seq_start=_whole(v["seq"][s]), source_seq_end=_whole(self.seq[c]), core_id=_whole(v["core"][s]), context_id=self.contexts.take(v["context"][s]), function_id=self.names.take(v["name"][s]), start_ns=pa.array(v["ts"][s]), end_ns=pa.array(self.time[c]), elapsed_ns=pa.array(np.maximum(self.time[c] - v["ts"][s], 0)), incomplete=pa.array(np.full(len(s), spoiled)))
        self.m_kept = []
        for k in opened[left[~over]].tolist():
            texts = (self.sources.text(v["source"][k]), _none(v["core"][k]), self.contexts.text(v["context"][k]), (self.spans if sync[k] else self.correlations).text(v["key"][k]), self.names.text(v["name"][k]))
            self.m_kept.append((SPAN if sync[k] else ASYNC, *texts, int(v["ts"][k]), int(v["ord"][k]), _none(v["seq"][k])))

    def _told(self) -> None:
        """Codes that rows name themselves: a gap by its reason, metadata by key and value."""
        rows = np.flatnonzero(self.text["told"] >= 0)
        self._fact(self.codes.take(self.text["told"][rows]), rows, self.ts[rows], self.gap_end[rows])

    def _totals(self) -> None:
        """Time credited to each context of the captures that are over."""
        many = max(len(self.contexts.texts), 1)
        retired = self.carried.retired if self.carried else {}
        key = np.concatenate([np.array([self.contexts.number(x) for x in retired], np.int64), self.r_key])
        cpu = np.concatenate([np.array([*retired.values()], np.int64), self.r_cpu])
        self.task_cpu = self._cpu(self.tasks, np.full(len(self.tasks), self.n))
        names, which = np.unique(key, return_inverse=True)
        isr_cpu = _sums(np.zeros(len(names), np.int64), which, cpu)
        self.isr_totals = (names, isr_cpu)
        for at, cpu, isr in ((self.tasks, self.task_cpu, False), (names, isr_cpu, True)):
            done = self.over[at // many] if len(at) else np.zeros(0, bool)
            at, cpu = at[done], cpu[done]
            name = at % many
            self._put("cpu", self.end_row[at // many], context_id=self.contexts.take(name), ctx_kind=self._kinds(name, np.full(len(at), isr)), active_ns=pa.array(cpu))

    def _kinds(self, names: np.ndarray, isr: np.ndarray) -> pa.Array:
        idle = pa.compute.match_substring(pa.compute.utf8_lower(self.contexts.texts), "idle").to_numpy(zero_copy_only=False) if len(self.contexts.texts) else np.zeros(1, bool)
        return pa.array(["task", "idle", "isr"]).take(pa.array(np.where(isr, 2, idle[names].astype(np.int64)))) if len(names) else pa.array([], pa.string())

    def _keep(self) -> None:
        """What the next chunk of the last capture needs."""
        last, many = self.count - 1, max(len(self.contexts.texts), 1)
        s = State(end=int(self.end[last]), last_ord=int(self.ord[-1]) if self.n else self.state.last_ord)
        s.overlaps = {(self.contexts.text(k % many), a, b) for k, a, b in self.told if k // many == last}
        key, seq, time = self.source_tops
        n_sources = max(len(self.sources.texts), 1)
        for k in np.flatnonzero(key // n_sources == last).tolist():
            s.sources[self.sources.text(key[k] % n_sources)] = (_none(seq[k]), int(time[k]))
        group, top, heads = self.core_tops
        tails = np.append(np.flatnonzero(heads)[1:], len(group)) - 1 if len(group) else _NONE
        own = tails[group[tails] // self.width == last]
        found = self.s_last.at(group[own], np.full(len(own), self.n))
        for k, i in zip(own.tolist(), found.tolist(), strict=True):
            s.cores[int(self.core_names[group[k] % self.width])] = (int(top[k]), self.contexts.text(self.s_task[i]) if i >= 0 else None, int(self.s_since[i]) if i >= 0 else None)
        tainted = set(np.concatenate([g for g, _ in self.taints]).tolist()) if self.taints else set()
        still = np.flatnonzero(self.i_opens & (self.i_close < 0))
        cpu = self._cpu(self.base + still, np.full(len(still), self.n))
        place = {int(i): k for k, i in enumerate(still.tolist())}
        for i, used in zip(still.tolist(), cpu.tolist(), strict=True):
            s.stacks.append((int(self.core_names[self.i_group[i] % self.width]), self.contexts.text(self.i_name[i]), self.activations.text(self.i_activation[i]), int(self.i_entered[i]), int(self.i_ord[i]), used, self.base + i in tainted))
        context, kept, v = self.f_kept
        text = {"source": self.sources, "public": self.contexts, "function": self.functions, "frame": self.frames}
        for k in kept.tolist():
            where = place[int(context[k]) - self.base] if context[k] >= self.base else self.contexts.text(context[k] % many)
            s.frames.append((where, tuple(text[c].text(v[c][k]) if c in text else bool(v[c][k]) if c == "spoiled" else _none(v[c][k]) for c in _FRAME)))
        mine = self.tasks // many == last
        s.tasks = {self.contexts.text(t % many): c for t, c in zip(self.tasks[mine].tolist(), self.task_cpu[mine].tolist(), strict=True)}
        s.tainted = {self.contexts.text(t % many) for t in tainted if t < self.base and t // many == last}
        names, used = self.isr_totals
        s.retired = {self.contexts.text(x % many): c for x, c in zip(names.tolist(), used.tolist(), strict=True) if x // many == last}
        s.marks = self.m_kept
        self.state = s


def _none(x: int) -> int | None:
    return None if x == LOW else int(x)


def _whole(x: np.ndarray) -> pa.Array:
    """Numbers with nulls."""
    return pa.array(x, mask=x == LOW)


def _sums(start: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = start.copy()
    np.add.at(out, at, values)
    return out
