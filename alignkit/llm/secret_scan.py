"""Secret scan with one deterministic automaton for all rules.

The rules' regular expressions are parsed into automata over bytes; subset construction makes one
deterministic automaton of them all, partition refinement minimises it, and what remains are transition
arrays over classes of bytes. The automaton finds whole spans, leftmost, longest and without overlaps
for each rule: its states keep a rule's open attempts in order of their starts, and its transitions say
when an attempt's start is to be remembered and when a match ends. Bytes are read once, for all rules.

Texts are laid end to end and cut into lanes at bytes after which no attempt can be open (a line end, a
byte between texts, most punctuation), so that long and short texts are scanned side by side alike.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """``find`` is an expression of literals, classes, groups and ``|?*+``. A match counts if it has
    ``least`` bytes or more; with ``tail``, from the first byte on with which it could end."""

    kind: str
    find: str
    least: int
    tail: bool = False
    any_case: bool = False
    base: bool = False


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, True, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, base=True),
    Rule("hex", r"[0-9a-f]+", 16, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 20),
)
#: Bytes of an attempt from which on its start is remembered; up to there the state itself tells it.
YOUNG = 6


class _Nfa:
    """Thompson automaton built straight from an expression: literals, classes, groups, ``|?*+``."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[int, int] | None] = []  # (bitmask of 256 bytes, next state)

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def parse(self, source: str, any_case: bool) -> tuple[int, int]:
        self.source, self.at, self.any_case = source, 0, any_case
        return self._choice()

    def _peek(self) -> str:
        return self.source[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.source[self.at - 1]

    def _choice(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self._take()
            parts.append(self._sequence())
        start, end = self.state(), self.state()
        for a, b in parts:
            self.empty[start].append(a)
            self.empty[b].append(end)
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            a, b = self._atom()
            while self._peek() in ("?", "*", "+") and self._peek():
                sign, x, y = self._take(), self.state(), self.state()
                self.empty[x].append(a)
                self.empty[b].append(y)
                if sign in "?*":
                    self.empty[x].append(y)
                if sign in "*+":
                    self.empty[b].append(a)
                a, b = x, y
            self.empty[end].append(a)
            end = b
        return start, end

    def _byte(self) -> int:
        c = self._take()
        if c != "\\":
            return ord(c)
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.source[self.at - 2 : self.at], 16)
        return ord(c)

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self._take()
            out = self._choice()
            self._take()
            return out
        if self._peek() == "[":
            self._take()
            mask = 0
            while self._peek() != "]":
                low = high = self._byte()
                if self._peek() == "-" and self.source[self.at + 1] != "]":
                    self._take()
                    high = self._byte()
                mask |= sum(1 << b for b in range(low, high + 1))
            self._take()
        else:
            mask = 1 << self._byte()
        if self.any_case:
            for b in range(65, 91):
                if mask >> b & 1 or mask >> (b + 32) & 1:
                    mask |= 1 << b | 1 << (b + 32)
        start, end = self.state(), self.state()
        self.step[start] = mask, end
        return start, end


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + cls[byte]]`` is the next state times ``classes``, ``todo`` there the number
    of what is to be done: for action number n, ``moves[n]`` tells for each register which one it takes
    its value from (``len(owner)``: the position at which an attempt of ``YOUNG`` bytes began, one more:
    the position itself), and ``ends[n]`` has the bits of the rules whose match ends before this byte."""

    table: np.ndarray
    classes: int
    cls: np.ndarray
    todo: np.ndarray
    moves: np.ndarray
    ends: np.ndarray
    resets: np.ndarray
    first: np.ndarray
    began: np.ndarray


class _Attempts:
    """Subset construction for one rule. A state is (matched, attempts), an attempt (its states, its bytes
    up to ``YOUNG``), in order of their starts. Once the first attempt has matched, the others are inside
    its match and go; when it cannot go on, its match ends there and a new attempt may begin."""

    def __init__(self, rule: Rule):
        if rule.least < YOUNG:
            raise ValueError(f"rule {rule.kind}: least must be {YOUNG} or more")
        self.rule, self.nfa = rule, _Nfa()
        start, self.end = self.nfa.parse(rule.find, rule.any_case)
        self.fresh = self._closure([start])
        if self.end in self.fresh:
            raise ValueError(f"rule {rule.kind} matches nothing at all")

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.nfa.step[s] or s == self.end)

    def _step(self, states, byte: int) -> frozenset[int]:
        step = self.nfa.step
        return self._closure([step[s][1] for s in states if step[s] and step[s][0] >> byte & 1])

    def after(self, state, byte: int):
        """(next state, for each of its old attempts the number of the old one it was or None where it
        has just become old, whether a match begins, whether an old one ends)."""
        matched, attempts = state
        out, seen, ended = [], set(), False
        for i, (states, age) in enumerate(attempts):
            if new := self._step(states, byte) - seen:
                out.append((new, min(age + 1, YOUNG), i if age == YOUNG else None))
                seen |= new
        if matched and out and self.end not in out[0][0]:
            raise ValueError(f"rule {self.rule.kind}: a match must grow byte by byte")
        begins = False
        if not (matched and out):
            ended = matched and attempts[0][1] == YOUNG
            if new := self._step(self.fresh, byte) - seen:
                out.append((new, 1, None))
            if out and self.end in out[0][0]:
                out, begins = out[:1], True
            elif any(self.end in s for s, _, _ in out):
                raise ValueError(f"rule {self.rule.kind}: a later attempt may not match before an earlier one")
        still = begins or bool(matched and out and not ended and self.end in out[0][0])
        return (still, tuple((s, n) for s, n, _ in out)), [i for _, n, i in out if n == YOUNG], begins, ended


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """Subset construction over byte classes for all rules together, then Moore's minimisation; scanning
    starts in state 0, where no attempt is open."""
    parts = [_Attempts(r) for r in rules]
    masks = sorted({s[0] for p in parts for s in p.nfa.step if s})
    kinds, cls = {}, np.zeros(256, np.uint8)
    for b in range(256):
        cls[b] = kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds))
    sample = [int(np.flatnonzero(cls == c)[0]) for c in range(len(kinds))]
    # Every state of a rule alone, so that a step of all rules is a step in each rule's own table.
    tables, steps = [], []
    for p in parts:
        number, order, rows = {(False, ()): 0}, [(False, ())], []
        for state in order:
            row = []
            for b in sample:
                new, old, begins, ended = p.after(state, b)
                if new not in number:
                    number[new] = len(order)
                    order.append(new)
                row.append((number[new], tuple(old), begins, ended))
            rows.append(row)
        tables.append(order)
        steps.append(rows)
    width = [max(sum(n == YOUNG for _, n in state[1]) for state in order) for order in tables]
    began = np.cumsum([0, *[w + r.tail for w, r in zip(width, rules, strict=True)]])
    registers = int(began[-1])
    number, order, rows, actions = {(0,) * len(rules): 0}, [(0,) * len(rules)], [], {(tuple(range(registers)), 0): 0}
    for states in order:
        row = []
        for c in range(len(sample)):
            found = [steps[k][s][c] for k, s in enumerate(states)]
            new, moves, ends = tuple(f[0] for f in found), list(range(registers)), 0
            for k, (_, old, begins, ended) in enumerate(found):
                for j, i in enumerate(old):
                    moves[began[k] + j] = registers if i is None else int(began[k]) + i
                if begins and rules[k].tail:
                    moves[began[k] + width[k]] = registers + 1
                ends |= ended << k
            if new not in number:
                number[new] = len(order)
                order.append(new)
            row.append((number[new], actions.setdefault((tuple(moves), ends), len(actions))))
        rows.append(row)
    table, todo = np.array(rows).transpose(2, 0, 1)
    block = np.unique(todo, axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    firsts = np.unique(block, return_index=True)[1]
    names = np.argsort(np.argsort(np.where(block[firsts] == block[0], -1, firsts)))  # the start state becomes 0
    small, what = np.empty((len(firsts), len(sample)), np.int64), np.empty((len(firsts), len(sample)), np.int64)
    small[names], what[names] = names[block[table[firsts]]], todo[firsts]
    return Automaton(
        (small * len(sample)).astype(np.int32).ravel(), len(sample), cls, what.astype(np.int32).ravel(),
        np.array([m for m, _ in actions], np.intp), np.array([e for _, e in actions], np.int64),
        (small == 0).all(axis=0), began[:-1], np.array([b + w if r.tail else b for b, w, r in zip(began[:-1], width, rules, strict=True)]),
    )


def scan(found: Automaton, data: np.ndarray, lane_bytes: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, first possible end, end) of each match in ``data``, whose last byte is a reset."""
    cls = found.cls[data]
    open_ = np.flatnonzero(found.resets[cls]) + 1
    cuts = np.unique(np.r_[0, open_[np.searchsorted(open_, np.arange(lane_bytes, len(data), lane_bytes))], len(data)])
    sizes = np.diff(cuts)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = cuts[:-1][order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0])) if len(sizes) else []
    state, table, todo = np.zeros(len(begin), np.int32), found.table, found.todo
    registers = found.moves.shape[1]
    held = np.zeros((len(begin), registers + 2), np.int64)
    out = []
    for step, lanes in enumerate(alive):
        at = begin[:lanes] + step
        key = state[:lanes] + cls[at]
        state[:lanes] = table[key]
        acts = todo[key]
        busy = np.flatnonzero(acts)
        if not len(busy):
            continue
        what, now = acts[busy], at[busy]
        rows = held[busy]
        ends = found.ends[what]
        for k in range(len(found.first)) if ends.any() else ():
            hit = np.flatnonzero(ends >> k & 1)
            if len(hit):
                out.append((np.full(len(hit), k), rows[hit, found.first[k]], rows[hit, found.began[k]], now[hit]))
        rows[:, registers], rows[:, registers + 1] = now - YOUNG + 1, now
        rows[:, :registers] = np.take_along_axis(rows, found.moves[what], axis=1)
        held[busy] = rows
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.automaton = rules, compile_rules(rules)
        self.least = np.array([r.least for r in rules])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) in code points for each text, ascending."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not raw:
            return out
        # 0xFF stands in no UTF-8 text and in no rule.
        rule, start, first, end = scan(self.automaton, np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8))
        counts = end - first >= self.least[rule]
        rule, start, end = rule[counts], start[counts], end[counts]
        order = np.lexsort((rule, start))
        rule, start, end = rule[order], start[order], end[order]
        begins = np.r_[0, np.cumsum([len(b) + 1 for b in raw])]
        of = np.searchsorted(begins, start, side="right") - 1
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i = int(of[a])
            low, high = start[a:b] - begins[i], end[a:b] - begins[i]
            if len(raw[i]) != len(texts[i]):
                points = np.r_[0, np.cumsum((np.frombuffer(raw[i], np.uint8) & 0xC0) != 0x80)]  # code points before each byte
                low, high = points[low], points[high]
            out[i] = list(zip(low.tolist(), rule[a:b].tolist(), high.tolist(), strict=True))
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The compiled rules, built once in each worker process."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


#: Texts are scanned side by side up to so many bytes.
SCAN_BYTES = 4 << 20


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs``.

    Null and empty texts have no spans. Rows that repeat an id are each scanned; an empty table
    gives no rows; columns other than ``doc_id`` and ``text`` are not read.
    """

    def each(batches):
        found = scanner(rules)
        base = [k for k, r in enumerate(rules) if r.base]
        for batch in batches:
            texts, rows, at = batch.column(1).to_pylist(), [], 0
            while at < len(texts):
                n, size = at, 0
                while n < len(texts) and (n == at or size + len(texts[n]) <= SCAN_BYTES):
                    size += len(texts[n])
                    n += 1
                rows += found.spans(texts[at:n])
                at = n
            join = lambda spans: ",".join(f"{rules[k].kind}:{a}:{e}" for a, k, e in spans)
            shas = [hashlib.sha256(join([s for s in r if s[1] in base]).encode()).hexdigest() for r in rows]
            counts = [pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for k in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(shas, pa.string()), pa.array([join(r) for r in rows], pa.string())], names=["doc_id", *[f"n_{rules[k].kind}" for k in base], "base_sha256", "spans"])

    counts = ", ".join(f"n_{r.kind} long" for r in rules if r.base)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(each, f"doc_id long, {counts}, base_sha256 string, spans string")
