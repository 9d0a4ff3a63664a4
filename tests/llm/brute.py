"""Plain versions of the contracts, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter

import xxhash

from logharbor.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(f"({_KEY}|[aA][pP][iI]_?[kK][eE][yY])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str | None) -> list[tuple[int, int, str]]:
    text, found = text or "", []
    for order, (kind, pattern, least) in enumerate((("assign", ASSIGN, 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32))):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(found)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x


def shingles(text: str | None) -> set:
    words = WORD.findall((text or "").translate(_LOW))
    return {tuple(words[k: k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(rows) -> dict:
    sets = {i: shingles(t) for i, t in rows}
    groups, holders = Groups(sets), {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for a, b in {(a, b) for v in holders.values() for a in v for b in v if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            groups.join(a, b)
    return {i: (len(s), groups.root(i)) for i, s in sets.items()}


def repeats(rows, window: int = 20) -> dict:
    seen, out = set(), {}
    for i, text in sorted(rows):
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - window + 1):
            run = tuple(words[k: k + window])
            if run in seen:
                gone.update(range(k, k + window))
            seen.add(run)
        out[i] = (len(words), len(gone), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def leaks(rows, items, stretch=20, agree=0.8, least=10) -> set:
    """``(doc_id, item_id, start, compared, agreeing)``: every item laid on every place of every document."""
    def words(text):
        return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    found = set()
    for doc, text in rows:
        have = words(text)
        for item, content in items:
            want = words(content)
            n = len(want)
            compared, best = min(stretch, n), None
            for start in range(-n + 1, len(have)) if n else ():
                same = [0 <= start + k < len(have) and have[start + k] == w for k, w in enumerate(want)]
                most = run = sum(same[:compared])
                for k in range(compared, n):
                    run += same[k] - same[k - compared]
                    most = max(most, run)
                if most >= (agree if n >= least else 1) * compared:
                    best = max(best or (0, 0), (most, -start))
            if best:
                found.add((doc, item, -best[1], compared, best[0]))
    return found


_ALL = 2**64 - 1


def _mixed(h: int) -> int:
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _ALL
    return h ^ (h >> 31)


def _power_sum(values, base: int) -> int:
    return sum(v * pow(base, i, 2**64) for i, v in enumerate(values)) & _ALL


def grams(text: str | None, buckets: int, longest: int) -> list[int]:
    """Buckets of all runs of up to ``longest`` words, by the public word hash of the package."""
    codes = [int(c) for c in common._CODES]
    words = [_mixed(_power_sum([codes[c] for c in w.encode()], common._BYTES.base)) for w in WORD.findall(text or "")]
    return [_mixed(_power_sum(words[k: k + n], common._WORDS.base) + n & _ALL) % buckets
            for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def resampled(rows, good: set, share: float, seed: int, buckets: int, longest: int) -> dict:
    """``doc_id: (log weight, key)`` of the kept rows, for fewer good documents than the target model's bound."""
    marks = {i: grams(t, buckets, longest) for i, t in rows}
    raw, target = Counter(), Counter()
    for i in marks:
        raw.update(marks[i])
        if i in good:
            target.update(marks[i])
    def model(counts, b):
        return math.log((counts[b] + 1) / (counts.total() + buckets))
    keyed = {}
    for i, text in rows:
        weight = math.fsum(model(target, b) - model(raw, b) for b in marks[i])
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), seed=42)), seed=h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=h)
        keyed[i] = (weight, weight - math.log(-math.log((h % 2**52 + 0.5) / 2**52)))
    first = sorted(keyed, key=lambda i: (-keyed[i][1], i))[:round(share * len(rows))]
    return {i: keyed[i] for i in first}
