"""Scanning texts for secrets with one automaton for all rules (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .automaton import Automaton, compile_rules, states


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and longest, that do not overlap; those shorter than least bytes, or that keep does not match whole, are dropped."""

    kind: str
    pattern: str
    least: int = 1
    keep: str | None = None


# The rules of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", ASSIGN + r"[A-Za-z0-9+/_.=-]+", 12, ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}"),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
# Published shapes of keys and tokens, beyond the base kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 11),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE + MORE

#: Bytes of text that are scanned at once; a longer text is a slice of its own.
SLICE = 4 << 20


@lru_cache(maxsize=4)
def machines(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton], list[Automaton | None]]:
    """The automaton of all rules, and for each rule those that start a match at a given place: pattern and keep."""
    one = [compile_rules([r.pattern], anchored=True) for r in rules]
    keep = [compile_rules([r.keep], anchored=True) if r.keep else None for r in rules]
    return compile_rules([r.pattern for r in rules]), one, keep


def find(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, rules: tuple[Rule, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """Of every text with matches (its number): first byte, rule and end of each, by first byte and then rule.

    One pass gives the state after each byte. Where a match of a rule may end, the stretch around it in which the rule
    is under way is cut into matches by the rule's own automaton; outside such stretches it has none.
    """
    machine, one, keep = machines(rules)
    seen = states(machine, data, starts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r, rule in enumerate(rules):
        live, ends = (table >> r & 1 != 0 for table in (machine.live, machine.ends))
        under = np.zeros(len(data) + 2, dtype=bool)
        under[1:-1] = live[seen]
        begins, before, after = under[1:-1] & ~under[:-2], under[starts + 1], under[stops]
        begins[starts[before]] = True
        closes = under[1:-1] & ~under[2:]
        closes[stops[after] - 1] = True
        low, high = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        wide = high - low >= rule.least
        for begin, end in zip(low[wide].tolist(), high[wide].tolist()):
            if not ends[seen[begin:end]].any():
                continue
            raw, at = data[begin:end].tobytes(), 0
            while at < len(raw):
                stop = one[r].longest(raw, at, len(raw))
                if stop < 0:
                    at += 1
                    continue
                if stop - at >= rule.least and (keep[r] is None or keep[r].longest(raw, at, stop) == stop):
                    k = int(np.searchsorted(starts, begin, side="right")) - 1
                    found.setdefault(k, []).append((begin - int(starts[k]) + at, r, begin - int(starts[k]) + stop))
                at = stop
    return {k: sorted(rows) for k, rows in found.items()}


def _slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        yield low, high
        low = high


def _scan(texts: pa.Array, rules: tuple[Rule, ...], base: int) -> Iterator[tuple[list[int], str, str]]:
    """Counts of the base kinds, digest of the base spans and all spans of each text, in code points."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    none = ([0] * base, hashlib.sha256(b"").hexdigest(), "")
    for low, high in _slices(offsets, SLICE):
        some = data[offsets[low] : offsets[high]]
        starts, stops = offsets[low:high] - offsets[low], offsets[low + 1 : high + 1] - offsets[low]
        found = find(some, *_of_some(starts, stops), rules)
        full = np.flatnonzero(stops > starts)
        by_text = {int(full[k]): rows for k, rows in found.items()}
        for k in range(high - low):
            if k not in by_text:
                yield none
                continue
            # a code point begins at each byte that does not continue one
            point = np.concatenate([[0], np.cumsum(some[starts[k] : stops[k]] & 0xC0 != 0x80)])
            spans = [(r, f"{rules[r].kind}:{point[a]}:{point[b]}") for a, r, b in by_text[k]]
            plain = ",".join(s for r, s in spans if r < base)
            yield [sum(r == i for r, _ in spans) for i in range(base)], hashlib.sha256(plain.encode()).hexdigest(), ",".join(s for _, s in spans)


def _of_some(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = stops > starts
    return starts[full], stops[full]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<kind> of each of the first ``base`` rules, base_sha256 and spans for every row.

    spans lists kind:start:end of all matches by start and then by the order of the rules, in code points, end exclusive,
    joined by commas; base_sha256 is the SHA-256 of such a list of the base rules alone. A match is the leftmost and
    longest of its rule and overlaps no other one of that rule; matches of different rules may overlap.

    A null text counts as empty: no spans. Texts of any length are scanned whole, in time proportional to their bytes.
    Repeated rows and rows without a doc_id are rows like others, and further columns of docs change nothing. An empty
    table gives no rows.
    """
    counts = [f"n_{r.kind}" for r in rules[:base]]
    doc = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_scan(batch.column("text"), rules, base))
            columns = [pa.array([n[i] for n, _, _ in rows], type=pa.int64()) for i in range(base)]
            columns += [pa.array([r[i] for r in rows], type=pa.string()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *counts, "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
