"""Operator 2: secret scans with one deterministic automaton for all rules.

Rule patterns over bytes are parsed to position automata, joined under a leading ``any byte*``,
made deterministic by subset construction and minimised by partition refinement.  A text's bytes
then pass once through the transition rows, for all rules together; only where a rule accepts, the
rule's own reversed and forward automata give the match's leftmost start and longest end.

A rule must be such that of two overlapping matches the one that can end first also starts first
(so for every rule here); its matches are leftmost, longest and non-overlapping.

Null and empty texts have no spans; repeated rows and null ids are reported row by row; other
columns are ignored.  Very long texts take time in proportion to their length.  Where kinds share a
place, spans are ordered by start and then by the rules' order.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .textkit import code_points, text_buffer


@dataclass(frozen=True)
class Rule:
    """``head`` + ``tail`` is the pattern; a match counts if its tail has ``least`` bytes, or, if
    there is no head, the match has."""

    kind: str
    tail: str
    least: int = 1
    head: str = ""
    base: bool = False


#: The three base rules, then those that the operator adds.
RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    # Every run is a match of its own, so the least length may stand in the pattern.
    Rule("hex", r"[0-9a-f]{24,}", 24, base=True),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)


# --- patterns to syntax trees: ("set", bytes) | ("cat", [..]) | ("alt", [..]) | ("rep", x, least, most)


def parse(pattern: str):
    at = 0

    def escape() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def member() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        return escape() if c == "\\" else ord(c)

    def one():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if c == "[":
            at += 1
            negated = pattern[at] == "^"
            at += negated
            got: set[int] = set()
            while pattern[at] != "]":
                low = high = member()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = member()
                got.update(range(low, high + 1))
            at += 1
            return "set", frozenset(range(256)) - got if negated else frozenset(got)
        return "set", frozenset([member()])

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            x = one()
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                if c == "{":
                    end = pattern.index("}", at)
                    low, _, high = pattern[at:end].partition(",")
                    bounds = int(low), int(high) if high else None if "," in pattern[at:end] else int(low)
                    at = end + 1
                else:
                    bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                x = ("rep", x, *bounds)
            parts.append(x)
        return "cat", parts

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return "alt", parts

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"unbalanced pattern: {pattern}")
    return tree


def reverse(tree):
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "rep":
        return "rep", reverse(rest[0]), rest[1], rest[2]
    parts = [reverse(x) for x in rest[0]]
    return kind, parts[::-1] if kind == "cat" else parts


# --- automata


class Nfa:
    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, tree, start: int) -> int:
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            self.steps[start].append((rest[0], end))
            return end
        if kind == "cat":
            for x in rest[0]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in rest[0]:
                self.free[self.add(x, start)].append(end)
            return end
        inner, least, most = rest
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        ends = [start]
        for _ in range(most - least):
            start = self.add(inner, start)
            ends.append(start)
        end = self.state()
        for x in ends:
            self.free[x].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def deterministic(trees: list, searching: bool) -> tuple[np.ndarray, list[tuple[int, ...]], int]:
    """(transitions[state, byte], rules accepted by each state, dead state or -1), state 0 first,
    minimised.  ``searching`` puts ``any byte*`` in front."""
    nfa = Nfa()
    root = nfa.state()
    if searching:
        nfa.steps[root].append((frozenset(range(256)), root))
    for rule, tree in enumerate(trees):
        start = nfa.state()
        nfa.free[root].append(start)
        nfa.accepts[nfa.add(tree, start)] = rule
    # Bytes that no rule tells apart share a class.
    kinds: dict[tuple, int] = {}
    sets = [s for steps in nfa.steps for s, _ in steps]
    of_byte = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    sample = [of_byte.index(k) for k in range(len(kinds))]

    first = nfa.closure([root])
    number, todo, table_, accepted = {first: 0}, [first], [], []
    while todo:
        states = todo.pop(0)
        accepted.append(tuple(sorted({nfa.accepts[x] for x in states if x in nfa.accepts})))
        row = []
        for b in sample:
            target = nfa.closure({to for x in states for s, to in nfa.steps[x] if b in s})
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        table_.append(row)
    # Partition refinement: states stay together while they accept alike and step to like states.
    moves = np.array(table_)
    labels: dict[tuple, int] = {}
    block = np.array([labels.setdefault(a, len(labels)) for a in accepted])
    while True:
        _, refined = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == block.max():
            break
        block = refined
    size = int(block.max()) + 1
    rank = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}
    small, accepts = np.zeros((size, len(sample)), np.int64), [()] * size
    for s, b in enumerate(block.tolist()):
        small[rank[b]] = [rank[x] for x in block[moves[s]].tolist()]
        accepts[rank[b]] = accepted[s]
    dead = next((s for s in range(size) if not accepts[s] and (small[s] == s).all()), -1)
    return small[:, of_byte], accepts, dead


class Anchored:
    """The automaton of one pattern, from a given place on."""

    def __init__(self, tree):
        moves, accepts, dead = deterministic([tree], False)
        self.rows, self.ok, self.dead = moves.tolist(), [bool(a) for a in accepts], dead

    def longest(self, data: bytes) -> int:
        """Length of the longest match at the start of ``data``, -1 if none."""
        state, best = 0, 0 if self.ok[0] else -1
        for i, b in enumerate(data, 1):
            state = self.rows[state][b]
            if state == self.dead:
                break
            if self.ok[state]:
                best = i
        return best


def _rows(trees: list) -> list[list]:
    """The searching automaton, state 0 first: a state is the list of its successors by byte; entry
    256 holds the rules it accepts."""
    moves, accepts, _ = deterministic(trees, True)
    rows: list[list] = [[] for _ in accepts]
    for row, targets, accepted in zip(rows, moves.tolist(), accepts):
        row += [rows[t] for t in targets]
        row.append(accepted)
    return rows


class Scanner:
    """All rules in one automaton; ``scan`` reads each byte once."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        trees = [parse(r.head + r.tail) for r in rules]
        self.rules, self.trees = rules, trees
        rows = _rows(trees)
        self.start, self.states = rows[0], len(rows)
        self.own_starts: dict[int, list] = {}
        self.forward = [Anchored(t) for t in trees]
        self.backward = [Anchored(reverse(t)) for t in trees]
        self.heads = [Anchored(parse(r.head)) if r.head else None for r in rules]

    def _match(self, data: bytes, k: int, low: int, stop: int) -> tuple[int, int, bool] | None:
        """(start, end, whether it counts) of rule k's match that ends at ``stop`` or later and starts
        at ``low`` or later."""
        back = self.backward[k].longest(_Backward(data, low, stop))
        if back < 1:
            return None
        start = stop - back
        end = start + self.forward[k].longest(_Forward(data, start))
        head = self.heads[k].longest(data[start:end]) if self.heads[k] else 0
        return start, end, end - start - max(head, 0) >= self.rules[k].least

    def _alone(self, data: bytes, k: int, low: int) -> Iterator[tuple[int, int, int]]:
        """Rule k's matches from ``low`` on, by its own automaton, which starts anew after each."""
        if k not in self.own_starts:
            self.own_starts[k] = _rows([self.trees[k]])[0]
        first = state = self.own_starts[k]
        i, size = low, len(data)
        while i < size:
            state = state[data[i]]
            i += 1
            if state[256]:
                start, end, counts = self._match(data, k, low, i)
                if counts:
                    yield start, end, k
                low = i = end
                state = first

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and rule; matches that are too short are dropped.

        Where the common automaton accepts a rule for the sake of bytes before that rule's last match,
        the rule goes on by itself from there; so each rule adds at most one more pass over the text.
        """
        found, done, state = [], [0] * len(self.rules), self.start
        for i, b in enumerate(data):
            state = state[b]
            if state[256]:
                for k in state[256]:
                    if i < done[k]:
                        continue
                    got = self._match(data, k, done[k], i + 1)
                    if got is None:
                        found += self._alone(data, k, done[k])
                        done[k] = len(data)
                        continue
                    done[k] = got[1]
                    if got[2]:
                        found.append((got[0], got[1], k))
        return sorted(found, key=lambda x: (x[0], x[2]))


class _Forward:
    def __init__(self, data: bytes, start: int):
        self.data, self.start = data, start

    def __iter__(self):
        for at in range(self.start, len(self.data), 4096):
            yield from self.data[at : at + 4096]


class _Backward:
    def __init__(self, data: bytes, low: int, end: int):
        self.data, self.low, self.end = data, low, end

    def __iter__(self):
        for at in range(self.end, self.low, -4096):
            yield from self.data[max(self.low, at - 4096) : at][::-1]


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans in code points of each text of (doc_id, text), by start and then rule."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                got = scan(data[a:b].tobytes())
                if got:
                    places = sorted({x for s, e, _ in got for x in (s, e)})
                    at = dict(zip(places, code_points(data[a:b], np.array(places)).tolist()))
                    got = [{"kind": rules[k].kind, "start": at[s], "end": at[e], "base": rules[k].base} for s, e, k in got]
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def digest(spans: DataFrame, kinds: tuple[str, ...], more: dict[str, Column] | None = None) -> DataFrame:
    """Counts by base kind, hash of the base spans, text of all spans, and ``more`` columns."""
    written = lambda which: F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda kind: F.filter(base, lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return spans.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *[c.alias(k) for k, c in (more or {}).items()])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def _spans_sql(number: int, rule: Rule) -> str:
    """The matches of one rule: marked in the text, which is then cut at the marks."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    tail = f"regexp_replace(found, {quoted('^' + rule.head)}, '')" if rule.head else "found"
    return rf"""
  SELECT rid, {number} AS rule, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, start, start + length(found) AS stop FROM (
    SELECT rid, split_part(part, chr(1114108), 1) AS found,
      (sum(length(part) - (nth > 1)::INT) OVER (PARTITION BY rid ORDER BY nth) - length(part) + 1)::BIGINT AS start, nth
    FROM (
      SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS nth FROM (
        SELECT rid, string_split(regexp_replace(text, {quoted(f"({rule.head}{rule.tail})")}, chr(1114109) || '\1' || chr(1114108), 'g'), chr(1114109)) AS parts
        FROM texts
      )
    )
  ) WHERE nth > 1 AND length({tail}) >= {rule.least}"""


_WRITTEN = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rule"

OP2_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), found AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))}
), written AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))},
    string_agg({_WRITTEN}) FILTER (base) AS base, string_agg({_WRITTEN}) AS spans
  FROM found GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex"))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN written USING (rid)
"""
