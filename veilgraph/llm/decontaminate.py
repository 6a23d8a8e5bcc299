"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm._repeats import identity
from veilgraph.llm._text import buffer_of, byte_table, pieces, word_spans
from veilgraph.store import Scratch

#: Words are runs of digits, ASCII letters and bytes from 0x80 on; A-Z are lower-cased first.
_IN_WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SEPARATE = bytes(b if _IN_WORD[b] else 32 for b in _LOWER)
#: Items of one automaton; a megabyte of them took a worker 0.6 s and about 100 MB.
BLOCK_BYTES = 2 << 20


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of one text.

    >>> words_of("Ab-c, D2!")
    [b'ab', b'c', b'd2']
    """
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


class ItemAutomaton:
    """A suffix automaton of all items' word sequences.

    A state stands for word strings with the same ends; ``items[s]`` are the items whose window is the string of
    window length in s, ``whole[s]`` the short items that are a string of s, as (length, item).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.shortest = min((min(window, len(code)) for _, code in coded), default=0)
        for item, code in coded:
            s = n = 0
            for i, c in enumerate(code):
                s, n = self.next[s][c], i + 1
                if n >= window:
                    self.items.setdefault(self._of_length(s, window), set()).add(item)
            if n < window:
                self.whole.setdefault(self._of_length(s, n), []).append((n, item))
        #: the nearest state on the suffix path, itself included, that has whole short items
        self.near = [-1] * len(self.link)
        if self.whole:
            for s in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.near[s] = s if s in self.whole else self.near[self.link[s]] if s else -1
        pairs = np.array(sorted({(a, b) for _, code in coded for a, b in zip(code, code[1:], strict=False)}), np.int64).reshape(-1, 2)
        self.pairs = pairs[:, 0] * max(1, len(self.ids)) + pairs[:, 1]

    def _of_length(self, s: int, n: int) -> int:
        while self.length[self.link[s]] >= n:
            s = self.link[s]
        return s

    def _copy(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that p's strings and c make, taken out of q."""
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the items share this string already
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def scan(self, code: list[int], at: int, hits: list[tuple[int, int]], found: set[str]) -> None:
        """Streams words, keeping the longest match that ends at each; adds windows' spans and items."""
        s = n = 0
        following, link, length, window = self.next, self.link, self.length, self.window
        for i, c in enumerate(code, at):
            while s and c not in following[s]:
                s = link[s]
                n = length[s]
            t = following[s].get(c)
            s, n = (t, n + 1) if t is not None else (0, 0)
            if n >= window:
                found |= self.items.get(self._of_length(s, window), ())
                hits.append((i + 1 - window, i + 1))
            near = self.near[s]
            while near >= 0:
                for m, item in self.whole[near]:
                    if m <= n:
                        found.add(item)
                        hits.append((i + 1 - m, i + 1))
                near = self.near[link[near]] if near else -1


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_built: dict[str, ItemAutomaton] = {}


def _automaton(name: str, items: list[tuple[str, str]], window: int) -> ItemAutomaton:
    """Built once in each Python worker, which keeps the last one alone."""
    if name not in _built:
        _built.clear()
        _built[name] = ItemAutomaton([(i, words_of(t)) for i, t in items], window)
    return _built[name]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _as_spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Finds and removes what documents share with test items.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``window`` consecutive words
    of an item; an item of fewer (not none) is one window. Returns a row for each document row: the id, n_words,
    n_hit (words in some occurrence of a window), items (sorted ids, as strings, of items with occurring windows),
    spans (array of start, end in words) and text without the words of those spans (the bytes from a span's first
    word to its last go; what is left stays as it was), called clean; after them ``carried``, a struct of the columns
    named in ``carry``, if any. Null texts have no words and stay null; items with null
    text or no word match nothing, and items with a null id are named "". Repeated rows give repeated rows.

    Items of up to ``block_bytes`` make one automaton, which every Python worker builds once, and documents are read once. More items
    are dealt into blocks by their hashes: documents are streamed past one block's automaton after another, and
    what each found is written and joined back, so a worker never holds more than a block and an item larger than one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).filter("t is not null")
    blocks = -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes)

    def automaton_of(block: int):
        own = items if blocks <= 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        shared, name = spark.sparkContext.broadcast(sorted((r.i, r.t) for r in own.collect())), uuid.uuid4().hex
        return lambda: _automaton(name, shared.value, window)

    carried = [F.struct(*[f"`{c}`" for c in carry]).alias("carried")] if carry else []
    lead = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    out = T.StructType([docs.select(*lead).schema["id"]]).add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", _SPAN_TYPE).add("clean", "string")
    for field in docs.select(*carried).schema.fields if carry else []:
        out.add(field)

    if blocks <= 1:
        get = automaton_of(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    words = _words(part.column(1))
                    spans, found = _search(get(), words)
                    yield _assembled(part, words, spans, found, part.columns[2:], out.names)

        return docs.select(*lead, *carried).mapInArrow(run, out)

    scratch = Scratch(spark)
    texts = docs.select(*identity(docs, id_col, text_col), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    hits = None
    for block in range(blocks):

        def past(batches: Iterator[pa.RecordBatch], get=automaton_of(block)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    spans, found = _search(get(), _words(part.column(2)))
                    at = sorted(spans)
                    columns = [c.take(pa.array(at, pa.int64())) for c in part.columns[:2]]
                    columns += [pa.array([sorted(found[i]) for i in at], pa.list_(pa.string())), pa.array([_as_spans(spans[i]) for i in at], _SPANS)]
                    yield pa.RecordBatch.from_arrays(columns, names=["d", "t", "items", "spans"])

        schema = T.StructType().add("d", "long").add("t", "long").add("items", T.ArrayType(T.StringType())).add("spans", _SPAN_TYPE)
        own = scratch.put(texts.mapInArrow(past, schema), f"block{block}")
        hits = own if hits is None else hits.union(own)
    once = hits.distinct().groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))  # as many as the document has
    rows = docs.select(*lead, *carried, *identity(docs, id_col, text_col)).join(once, ["d", "t"], "left").drop("d", "t")
    n = 2 + len(carried)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                listed = {i: x for i, x in enumerate(part.column(n + 1).to_pylist()) if x}
                spans = {i: _merged([(x["start"], x["end"]) for x in own]) for i, own in listed.items()}
                found = {i: set(x) for i, x in enumerate(part.column(n).to_pylist()) if x}
                yield _assembled(part, _words(part.column(1)), spans, found, part.columns[2:n], out.names)

    return rows.mapInArrow(joined, out)


def _assembled(part: pa.RecordBatch, words, spans: dict[int, list[tuple[int, int]]], found: dict[int, set[str]], carried: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The result of a batch from its texts' hit spans, in words, and items."""
    _, offsets, starts, ends, firsts = words
    n, clean = part.num_rows, part.column(1)
    if spans:
        texts = clean.to_pylist()
        for i, own in spans.items():
            first, at = int(firsts[i]), int(offsets[i])
            texts[i] = _without(texts[i], [(int(starts[first + a]) - at, int(ends[first + b - 1]) - at) for a, b in own])
        clean = pa.array(texts, pa.string())
    columns = [
        part.column(0), pa.array(np.diff(firsts)), pa.array([sum(b - a for a, b in spans.get(i, ())) for i in range(n)], pa.int64()),
        pa.array([sorted(found.get(i, ())) for i in range(n)], pa.list_(pa.string())), pa.array([_as_spans(spans.get(i, [])) for i in range(n)], _SPANS), clean,
    ]
    return pa.RecordBatch.from_arrays([*columns, *carried], names=names)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


def _words(texts: pa.Array):
    """Lower-cased bytes and the texts' offsets; where words start and end, and each text's first word."""
    buf, offsets = buffer_of(texts)
    low = np.frombuffer(buf.tobytes().translate(_LOWER), np.uint8)
    return low, offsets, *word_spans(low, offsets, _IN_WORD)


def _search(automaton: ItemAutomaton, words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Merged spans, in words, and items of the texts that hold a window."""
    low, offsets, starts, _, firsts = words
    spans: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[str]] = {}
    least = automaton.shortest
    if not least or not len(starts):
        return spans, found
    raw = low.tobytes()
    get = automaton.ids.get
    # words never hold a separator, so splitting at separators and at the texts' ends gives the same words in order
    code = np.fromiter((get(w, -1) for i in range(len(offsets) - 1) for w in raw[offsets[i] : offsets[i + 1]].translate(_SEPARATE).split()), np.int64, len(starts))
    known = code >= 0
    # a window lies in a run of known words of one text whose neighbours are neighbours in some item
    tied = known[:-1] & known[1:]
    at = np.flatnonzero(tied)
    pair = code[at] * max(1, len(automaton.ids)) + code[at + 1]
    if len(automaton.pairs):
        place = np.minimum(np.searchsorted(automaton.pairs, pair), len(automaton.pairs) - 1)
        tied[at] = automaton.pairs[place] == pair
    else:
        tied[:] = False
    cut_at = firsts[(firsts > 0) & (firsts < len(code))]
    tied[cut_at - 1] = False
    breaks = np.flatnonzero(~tied) + 1
    begin = np.concatenate(([0], breaks))
    end = np.concatenate((breaks, [len(code)]))
    take = (end - begin >= least) & known[begin]
    hits: dict[int, list[tuple[int, int]]] = {}
    owner = np.searchsorted(firsts, begin[take], "right") - 1
    for d, a, b in zip(owner.tolist(), begin[take].tolist(), end[take].tolist(), strict=True):
        new: list[tuple[int, int]] = []
        names: set[str] = set()
        automaton.scan(code[a:b].tolist(), a, new, names)
        if new:
            hits.setdefault(d, []).extend(new)
            found.setdefault(d, set()).update(names)
    for d, h in hits.items():
        spans[d] = [(a - int(firsts[d]), b - int(firsts[d])) for a, b in _merged(h)]
    return spans, found
