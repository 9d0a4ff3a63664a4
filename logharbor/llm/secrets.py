"""Secret scan with one combined automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logharbor.llm.automata import Automaton, either_case, parse, reverse
from logharbor.llm.common import table


@dataclass(frozen=True)
class Rule:
    """``body`` is matched leftmost-longest; ``trigger`` is its shortest telling form, searched by all rules at once.

    A match is dropped if ``tail`` is given and the part of it that ``tail``
    matches from its end backwards is shorter than ``least`` bytes, or else if
    the whole is.
    """

    kind: str
    body: str
    trigger: str
    least: int = 0
    tail: str | None = None


_KEYWORD = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "apikey", "api_key"))) + ")"
_ASSIGN = _KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=\\-]"

#: The three base kinds in their fixed order, then the kinds this method adds.
RULES = (
    Rule("assign", _ASSIGN + _VALUE + "+", _ASSIGN + _VALUE, 8, _ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32}", 32),
    Rule("pem", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\-]+", "xox[abprs]-[A-Za-z0-9]", 20),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """All rules in transition arrays; built once by the driver and sent to the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.body) for r in rules]
        self.search = Automaton([parse(r.trigger) for r in rules], search=True)
        self.forward = [Automaton([t], search=False) for t in trees]
        self.backward = [Automaton([reverse(t)], search=False) for t in trees]
        self.heads = [Automaton([parse(r.tail)], search=False) if r.tail else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, kind number, end)`` in bytes, by start and kind."""
        found, done = [], [0] * len(self.rules)
        for at, mask in self.search.hits(data):
            k = 0
            while mask:
                if mask & 1 and at >= done[k]:
                    # longest match that ends at the trigger, back to what is used up
                    back = self.backward[k].longest(_Back(data, done[k], at + 1))
                    if back > 0:
                        start = at + 1 - back
                        end = start + self.forward[k].longest(memoryview(data)[start:])
                        done[k] = end
                        if self._long_enough(k, data, start, end):
                            found.append((start, k, end))
                mask >>= 1
                k += 1
        return sorted(found)

    def _long_enough(self, k: int, data: bytes, start: int, end: int) -> bool:
        rule, head = self.rules[k], self.heads[k]
        if head is not None:
            start += head.longest(data[start:end])
        return end - start >= rule.least


class _Back:
    """Bytes from ``high`` down to ``low``."""

    def __init__(self, data: bytes, low: int, high: int):
        self.data, self.low, self.high = data, low, high

    def __iter__(self):
        data = self.data
        for i in range(self.high - 1, self.low - 1, -1):
            yield data[i]


def _scan_task(scanner: Scanner):
    kinds = [r.kind for r in scanner.rules]
    base = len(BASE)

    def joined(spans) -> str:
        return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(base)]
            digests, texts = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                data = text.encode()
                spans = scanner.spans(data)
                if spans and len(data) != len(text):
                    # bytes to code points: count the bytes that begin a character
                    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
                    place = np.concatenate([[0], np.cumsum(begins)])
                    spans = [(int(place[a]), k, int(place[b])) for a, k, b in spans]
                for k in range(base):
                    counts[k].append(sum(x[1] == k for x in spans))
                digests.append(hashlib.sha256(joined(x for x in spans if x[1] < base).encode()).hexdigest())
                texts.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, counts per base kind, ``base_sha256`` and ``spans`` of every document.

    One pass over the bytes of a text runs the automaton of all rules' triggers;
    only around its hits single automata find start and end.  Matches of a kind
    are leftmost-longest and do not overlap; short ones are dropped after they
    have used up their text.  ``spans`` has ``kind:start:end`` in code points, by
    start and kind; ``base_sha256`` is the hash of the base kinds among them.

    Null and empty texts have no spans.  Repeated rows give repeated rows, a null
    id is kept, other columns are ignored.  No shuffle; memory is one Arrow batch.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scan_task(Scanner(rules)),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, "
        "base_sha256 string, spans string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
