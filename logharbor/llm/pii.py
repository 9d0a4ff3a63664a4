"""Personal data and the terms that give it away, by information content."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import Words, free_name, packed, save, signed, slices, table

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information content that a term must give away, and the
#: documents without the entity that are added to each term's count.
DISCLOSURE, SMOOTHING = 0.95, 0.25
#: Rows up to which terms of texts are broadcast.
BROADCAST_TERMS = 1_000_000

#: Punctuation and signs separate the words of a text, byte by byte.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its begin only: if that fails, the rest fails too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        # the run of local characters that ends at the sign
        low = at
        while low > done and _LOCAL.fullmatch(text, max(done, low - 64), low):
            low = max(done, low - 64)
        while low > done and _LOCAL.fullmatch(text, low - 1, low):
            low -= 1
        tail = _DOMAIN.match(text, at + 1)
        if low < at and tail:
            yield low, tail.end()
            done = tail.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((2 * int(d) - 9) if d > "4" else 2 * int(d) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` in code points, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def _entities(kind: int, value: str) -> list[int]:
    """Keys of the value and of the parts that it may share with others."""
    if kind == 0:
        local, _, domain = value.lower().rpartition("@")
        parts = [value.lower(), f"{local}@", f"@{domain}"]
    elif kind == 1:
        parts = [value, value.rpartition(".")[0]]
    else:
        digits = "".join(_DIGIT.findall(value))
        parts = [digits, f"{digits[:6]}-" if kind == 2 else f"{digits[:-4]}-"]
    return [int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{part}".encode(), digest_size=8).digest(), "little", signed=True)
            for part in parts]


def _words(data: np.ndarray, bounds: np.ndarray) -> Words:
    return Words(_PLAIN[data], bounds, lower=True)


def _entities_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each text, the entities they show, and the different words outside them."""
    def free(words: Words, row: int, raw: bytes, text: str, spans) -> np.ndarray:
        base = int(words.bounds[row])
        if len(raw) == len(text):
            place = None
        else:
            place = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        byte = lambda c: c if place is None else int(place[c]) if c < len(place) else len(raw)
        first, last = words.first[row], words.first[row + 1]
        start, end = words.start[first:last] - base, words.end[first:last] - base
        outside = np.ones(last - first, bool)
        for _, a, b in spans:
            outside[np.searchsorted(end, byte(a), "right"): np.searchsorted(start, byte(b), "left")] = False
        return signed(np.unique(words.hash[first:last][outside]))

    for batch in batches:
        spans_out, entities_out, terms_out = [], [], []
        for _, _, data, bounds in slices(batch.column("text")):
            words = None
            for row in range(len(bounds) - 1):
                raw = data[bounds[row]: bounds[row + 1]].tobytes()
                text = raw.decode()
                spans = base_spans(text)
                spans_out.append([{"kind": k, "a": a, "b": b} for k, a, b in spans])
                if spans and words is None:
                    words = _words(data, bounds)
                entities_out.append(sorted({e for k, a, b in spans for e in _entities(k, text[a:b])}))
                terms_out.append(free(words, row, raw, text, spans) if spans else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"),
             pa.array(spans_out, pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))),
             pa.array(entities_out, pa.list_(pa.int64())), pa.array(terms_out, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "base", "entities", "held"])


def _terms_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a slice, the number of its texts that hold it."""
    for batch in batches:
        for _, _, data, bounds in slices(batch.column("text")):
            words = _words(data, bounds)
            order = np.lexsort((words.row, words.hash))
            h, row = words.hash[order], words.row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            terms, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(n.astype(np.int64))], ["term", "n"])


def _places_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, in code points, of every occurrence of a text's ``told`` words outside its base spans."""
    for batch in batches:
        told, base = batch.column("told").to_pylist(), batch.column("base").to_pylist()
        out: list[list[dict]] = []
        for _, _, data, bounds in slices(batch.column("text")):
            words = _words(data, bounds)
            hashes = words.hash.view(np.int64)
            for row in range(len(bounds) - 1):
                first, last = words.first[row], words.first[row + 1]
                raw = data[bounds[row]: bounds[row + 1]]
                count = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                at = first + np.flatnonzero(np.isin(hashes[first:last], told[len(out)]))
                spans = zip(count[words.start[at] - bounds[row]].tolist(), count[words.end[at] - bounds[row]].tolist())
                covered = sorted((s["a"], s["b"]) for s in base[len(out)])
                kept, k, reach = [], 0, 0
                for a, b in spans:
                    while k < len(covered) and covered[k][0] < b:
                        reach = max(reach, covered[k][1])
                        k += 1
                    if a >= reach:
                        kept.append({"a": a, "b": b})
                out.append(kept)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"),
             pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["doc_id", "text_key", "terms"])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def told_terms(found: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """``doc_id``, ``text_key``, ``told``: the words of each text that give away an entity of the text.

    A word gives an entity away when its pointwise mutual information with the
    entity is at least ``disclosure`` of the entity's information content.  Counts
    are of whole documents, over the whole corpus, however few; ``smoothing``
    documents that lack the entity are added to those of each word.
    """
    total = float(max(1, docs.count()))
    texts = found.filter("size(entities) > 0").select("doc_id", "text_key", "entities", "held")
    held = texts.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("n_held"))
    held = save(held, "held")
    counts = docs.mapInArrow(_terms_task, "term bigint, n bigint").join(_few(held.select("term")), "term", "left_semi")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n_term"))
    # information given away: log(share of the word's documents / share of all documents).  No entity is
    # rarer than one document, so words that stand mostly in texts without entities drop out first
    needed = lambda n: F.pow(n / F.lit(total), F.lit(1 - disclosure))
    weight = F.col("n_term") + F.lit(smoothing)
    able = save(held.join(counts, "term").filter(F.col("n_held") >= needed(F.lit(1.0)) * weight).select("term", "n_term"), "able")
    holders = save(texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
                   .filter(F.col("n_entity") < total), "holders")
    beside = (texts.select("doc_id", "text_key", "entities", F.explode("held").alias("term")).join(_few(able), "term")
              .select("doc_id", "text_key", "term", "n_term", F.explode("entities").alias("entity")).join(_few(holders), "entity"))
    beside = save(beside.filter(F.col("n_entity") >= needed(F.col("n_entity")) * weight), "beside")
    both = beside.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("both"))
    told = save(both.filter(F.col("both") >= needed(F.col("n_entity")) * weight).select("entity", "term"), "told")
    return beside.join(_few(told), ["entity", "term"], "left_semi").groupBy("doc_id", "text_key").agg(
        F.collect_set("term").alias("told"))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """``doc_id``, ``text_key``, ``base`` and ``terms`` (spans) of every document.

    Base spans are emails, addresses, card and phone numbers by their patterns.  A
    protected entity is the value of a span, or a part that values share: both
    sides of an email, the network of an address, the first digits of a number.  A
    word that gives the entity away, judged over whole documents of the corpus, is
    a term span wherever it stands in the documents that hold the entity.  Words
    are runs of letters, digits and signs beyond ASCII, compared in lower case by
    64-bit hash.  Documents without base spans have no term spans.

    Null and empty texts have no spans; repeated rows give repeated rows and count
    as documents of their own; a null id is kept; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = save(texts.mapInArrow(
        _entities_task,
        "doc_id bigint, text_key bigint, base array<struct<kind:int,a:int,b:int>>, entities array<bigint>, held array<bigint>"), "entities")
    told = told_terms(found, texts, disclosure, smoothing)
    base = found.filter("size(base) > 0").select("doc_id", "text_key", "base").dropDuplicates(["doc_id", "text_key"])
    on = told.doc_id.eqNullSafe(base.doc_id) & (told.text_key == base.text_key)
    told = save(told.join(base, on).select(told.doc_id.alias("hit_id"), told.text_key.alias("hit_key"), "told", "base"), "told_texts")
    few = (told.agg(F.sum(F.size("told") + F.size("base"))).first()[0] or 0) <= BROADCAST_TERMS
    on = texts.doc_id.eqNullSafe(told.hit_id) & (texts.text_key == told.hit_key)
    hits = texts.join(F.broadcast(told) if few else told, on).select("doc_id", "text_key", "text", "told", "base").mapInArrow(
        _places_task, "doc_id bigint, text_key bigint, terms array<struct<a:int,b:int>>")
    hits = hits.dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "terms")
    on = found.doc_id.eqNullSafe(hits.hit_id) & (found.text_key == hits.hit_key)
    return found.join(hits, on, "left").select(
        "doc_id", "text_key", "base",
        F.coalesce("terms", F.array().cast("array<struct<a:int,b:int>>")).alias("terms"))


def _joined(spans: str, kind: str) -> str:
    return f"array_join(transform({spans}, s -> concat({kind}, ':', s.a, ':', s.b)), ',')"


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"
    counts = [f"cast(size(filter(base, s -> s.kind = {i})) AS bigint) AS n_{k}" for i, k in enumerate(KINDS)]
    text = found.selectExpr("doc_id", *counts, f"{_joined('base', names)} AS base_text", f"{_joined('terms', chr(39) + 'term' + chr(39))} AS term_text")
    return text.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_text", 256).alias("base_sha256"),
                       F.expr("array_join(filter(array(base_text, term_text), x -> x <> ''), ',')").alias("spans"))


def _mask_task(names: list[str], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            base, terms = (batch.column(len(names) + k).to_pylist() for k in range(2))
            for i, text in enumerate(texts):
                cuts = [(s["a"], s["b"], f"[{KINDS[s['kind']].upper()}]") for s in base[i] or ()]
                cuts += [(s["a"], s["b"], "[TERM]") for s in terms[i] or ()]
                if cuts:
                    out, done = [], 0
                    for a, b, name in sorted(cuts, key=lambda c: (c[0], -c[1])):
                        if a >= done:
                            out += [text[done:a], name]
                        done = max(done, b)
                    texts[i] = "".join([*out, text[done:]])
            columns = [batch.column(k) for k in range(len(names))]
            columns[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def sanitise(docs: DataFrame) -> DataFrame:
    """The same rows and columns; every span in ``text`` replaced by the name of its kind.

    Overlapping spans become one, named by the first.  A null text stays null.
    """
    found = find_personal_data(docs).filter("size(base) > 0").dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "base", "terms")
    rows = packed(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64("text"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("key") == F.col("span_key")), "left")
    spans = [F.col(n).alias(free_name(docs.columns, f"spans_{n}")) for n in ("base", "terms")]
    return joined.select("row.*", *spans).mapInArrow(_mask_task(docs.columns, docs.columns.index("text")), docs.schema)
