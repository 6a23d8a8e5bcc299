"""Finds every fixed-length window of the corpus that occurs more than once, without a row for each window.

Units are bytes or words. A window of W units belongs to its anchor: the leftmost G-gram in it with the least hash.
Equal windows have equal anchors at the same place, and the windows of one anchor form a run of neighbours. So:

1. One row for each distinct run of a document: the anchor's hash, a hash of all that its windows cover, and its places, so
   that a line repeated a thousand times in a text moves as one row. Only anchors whose hash occurs twice go on (``groupBy`` with partial sums, then a join whose hot keys AQE can split).
2. Runs with equal hashes form a class. Two members of each class meet and are compared unit by unit by the caller's
   method; if it finds them equal, all windows of the class's members are repeats. A thousand copies cost as much as two.
3. Classes with the same anchor can share some of their windows. A context (the text around the anchor) of each meets the
   others by anchor, and the caller's method finds the windows that they share.
4. Groups above ``group_limit`` contexts are split by depth first: the windows of a context are halved by their place
   around the anchor, the windows of a half have more text in common, and contexts meet by that text. Equal halves form
   classes again, lone ones go, and what is still too large is halved anew, until a half is a single window.
5. The repeated windows of each document come back to its text.

Rows are told apart by (id, hash of the text). Rows that agree in both repeat each other, as they should: however many there are, two
of them go through these steps, so a text that is a third of all rows under one id costs what one text costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.store import Scratch
from veilgraph.llm._text import mix, pieces

_PIECE = 1 << 20
#: Keys of repeated rows (16 bytes each) that are sent to every task at most; more are joined by key.
_MOST_SENT = 1_000_000
_SEEDS = np.random.Generator(np.random.Philox(77)).integers(1, 2**64, 512, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)

#: A comparison gets (group, anchor's place, contexts as bytes) of each context, rows of a group together, and windows as
#: (context, place of the window in it), and tells for each window whether another context of the group has it at the same anchor.
Compare = Callable[[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Plan:
    """Which windows are looked for. ``units`` turns an array of texts into units to hash and each text's offsets; ``reader`` into
    a function that gives the content of units a to b as bytes; ``cut`` takes units a to b of such a content."""

    units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    reader: Callable[[pa.Array], tuple[np.ndarray, Callable[[int, int], bytes]]]
    cut: Callable[[bytes, int, int], bytes]
    window: int
    gram: int
    compare: Compare
    group_limit: int

    @property
    def width(self) -> int:
        return self.window - self.gram + 1


def _gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that starts at each unit."""
    n = len(units) - gram + 1
    if units.dtype == np.uint8:
        words = np.ndarray((len(units) - 7,), "<u8", units.tobytes(), strides=(1,)).copy()
        words ^= words >> np.uint64(29)
        words *= np.uint64(0xBF58476D1CE4E5B9)
        words ^= words >> np.uint64(32)
        places = [*range(0, gram - 8, 8), gram - 8]
    else:
        words, places = units, range(gram)
    total = np.zeros(n, np.uint64)
    for i, at in enumerate(places):
        total += words[at : at + n] * _SEEDS[i]
    return mix(total)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from minima over blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def runs_of(units: np.ndarray, offsets: np.ndarray, plan: Plan, most: int = 2 * _PIECE) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor's place after the first window, anchor's hash) of each run; windows count from the chunk's start.

    A long array is worked off in overlapping parts. That may cut a run in two, which costs a class but loses no window.
    """
    if len(units) > most + plan.window:
        parts = []
        for at in range(0, len(units) - plan.window + 1, most):
            text, start, count, place, anchor = _runs(units[at : at + most + plan.window - 1], np.clip(offsets - at, 0, most + plan.window - 1), plan)
            parts.append((text, start + at, count, place, anchor))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))
    return _runs(units, offsets, plan)


def _runs(units: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    n = len(units) - plan.window + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    grams = _gram_hashes(units, plan.gram)
    places = np.arange(len(grams), dtype=np.uint64)
    owner = (_sliding_min((grams & ~_LOW) | places, plan.width) & _LOW).astype(np.int64)[:n]
    step = np.zeros(len(units) + 1, np.int32)
    fits = np.flatnonzero(np.diff(offsets) >= plan.window)
    step[offsets[fits]] += 1
    step[offsets[fits + 1] - plan.window + 1] -= 1
    at = np.flatnonzero(np.cumsum(step[:n]) > 0)
    if not len(at):
        return _runs(units[:0], offsets, plan)
    own = owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, anchor = at[first], own[first]
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start, count, anchor - start, grams[anchor]


def _pack(start: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (start << 24) | (count << 12) | place


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 12) & 4095, at & 4095


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def identity(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two numbers that tell rows apart, as far as that matters: one of the id, one of the text."""
    integral = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) if integral else F.xxhash64(id_col)
    return [number.alias("d"), F.xxhash64(text_col).alias("t")]


def repeated_rows(rows: DataFrame) -> DataFrame:
    """(d, t) that more than one row has; only these two numbers are counted and moved."""
    return rows.groupBy("d", "t").count().filter("count > 1").select("d", "t")


def at_most(copies: int, rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` (d, t, ...), of which those whose (d, t) is in ``again`` (written, distinct) come ``copies`` times each."""
    n = again.count()
    if not n:
        return rows
    sent = F.broadcast(again) if n <= _MOST_SENT else again
    alone = rows.join(sent, ["d", "t"], "left_anti")
    firsts = rows.join(sent, ["d", "t"]).groupBy("d", "t").agg(*[F.first(c).alias(c) for c in rows.columns if c not in ("d", "t")])
    for _ in range(copies):
        alone = alone.unionByName(firsts)
    return alone


def _anchors(texts: DataFrame, plan: Plan, only_hash: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                units, offsets = plan.units(part.column(part.schema.get_field_index("text")))
                text, start, count, place, anchor = runs_of(units, offsets, plan)
                if only_hash:
                    kg, n = np.unique(_signed(anchor), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kg), pa.array(n.astype(np.int64))], names=["kg", "n"])
                    continue
                raw, size = memoryview(units.view(np.uint8)), units.itemsize
                ends = start + count - 1 + plan.window
                digest = xxhash.xxh3_64_intdigest
                cover = np.fromiter((digest(raw[a * size : b * size], s) for a, b, s in zip(start.tolist(), ends.tolist(), place.tolist(), strict=True)), np.uint64, len(start))
                # runs of one text that agree make one row
                order = np.argsort(mix(anchor ^ mix(cover + text.astype(np.uint64))), kind="stable")
                same = np.ones(max(0, len(order) - 1), bool)
                for key in (text, anchor, cover):
                    same &= key[order[1:]] == key[order[:-1]]
                first = np.flatnonzero(np.append(np.ones(min(1, len(order)), bool), ~same))
                lead = order[first]
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(_pack(start - offsets[text], count, place)[order]))
                row = pa.array(text[lead], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(_signed(anchor[lead])), pa.array(_signed(cover[lead])), part.column(0).take(row), part.column(1).take(row), places], names=["kg", "sh", "d", "t", "at"])

    return texts.mapInArrow(run, "kg long, n long" if only_hash else "kg long, sh long, d long, t long, at array<long>")


#: g: whom to meet; twin: two members of the class (kg, sh), else a context that looks for others' windows.
CONTEXT = "g long, kg long, sh long, twin boolean, d long, t long, at long, ctx binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["g", "kg", "sh", "twin", "d", "t", "at", "ctx"]
_MARK = ["at", "g", "kg", "sh", "twin"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def _signed_hash(content: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(content, seed) - (1 << 63)


def _halves(plan: Plan, level: int, at: int, ctx: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(g, sh, at, content) of a context's parts at a level: its windows with x units before the anchor, for each of 2**level ranges of x.

    All windows of a range share the text from its least x before the anchor on, up to where the window of its largest
    x ends: that text is the new group's key.
    """
    start, count, place = at >> 24, (at >> 12) & 4095, at & 4095
    least = place - count + 1
    for i in range((least << level) // plan.width, ((place + 1) << level) // plan.width + 1):
        low, high = -(-i * plan.width >> level), -(-(i + 1) * plan.width >> level) - 1
        a, b = max(low, least), min(high, place)
        if a > b:
            continue
        shift = place - b
        own = plan.cut(ctx, shift, shift + b - a + plan.window)
        common = plan.cut(own, b - low, b - high + plan.window)
        yield _signed_hash(common, level << 16 | i), _signed_hash(own, b), (start + shift) << 24 | (b - a + 1) << 12 | b, own


def _contexts(texts: DataFrame, wanted: DataFrame, plan: Plan, split: bool) -> DataFrame:
    """The contexts of the wanted runs; with ``split`` their first halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                offsets, content = plan.reader(part.column(2))
                d, t = part.column(0).to_pylist(), part.column(1).to_pylist()
                out: list[tuple] = []
                for i, marks in enumerate(part.column(3)):
                    base = int(offsets[i])
                    for at, g, kg, sh, twin in zip(*(marks.values.field(k).to_pylist() for k in _MARK), strict=True):
                        start = base + (at >> 24)
                        ctx = content(start, start + ((at >> 12) & 4095) - 1 + plan.window)
                        if split:
                            out += [(x, x, y, False, d[i], t[i], z, own) for x, y, z, own in _halves(plan, 1, at, ctx)]
                        else:
                            out.append((g, kg, sh, twin, d[i], t[i], at, ctx))
                    if len(out) > 20_000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    gathered = wanted.groupBy("d", "t").agg(F.collect_set(F.struct(*_MARK)).alias("marks"))  # as many as the document has runs
    return texts.join(gathered, ["d", "t"]).select("d", "t", "text", "marks").mapInArrow(run, CONTEXT)


def _compared(contexts: DataFrame, plan: Plan) -> DataFrame:
    """(d, t, start, n, kg, sh): windows that repeat among contexts of a group, and (kg, sh) alone of classes whose twins are equal.

    Twins are equal if their first and their last window are, as these cover all of them. A task streams its groups and
    holds a few at a time.
    """

    def flush(table: pa.Table) -> pa.RecordBatch:
        g = table.column("g").to_numpy()
        group = np.concatenate(([0], np.cumsum(g[1:] != g[:-1])))
        start, count, place = _unpack(table.column("at").to_numpy())
        twin = table.column("twin").to_numpy(zero_copy_only=False)
        n = np.where(twin, 2, count)
        which = np.repeat(np.arange(len(g)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        step = np.where(twin[which], step * (count[which] - 1), step)
        repeated = plan.compare(group, place, table.column("ctx").to_pylist(), which, step)
        both = np.bincount(which[repeated], minlength=len(g)) == 2
        equal = np.flatnonzero(twin & both & np.append(True, group[1:] != group[:-1]))
        i, a, k = runs_of_steps(repeated & ~twin[which], which, step)
        none = pa.nulls(len(equal), pa.int64())
        columns = [table.column(c).combine_chunks().take(pa.array(i)) for c in ("d", "t")] + [pa.array(start[i] + a), pa.array(k)]
        keys = [table.column(c).combine_chunks().take(pa.array(equal)) for c in ("kg", "sh")]
        columns = [pa.concat_arrays([c, none]) for c in columns] + [pa.concat_arrays([pa.nulls(len(i), pa.int64()), c]) for c in keys]
        return pa.RecordBatch.from_arrays(columns, names=["d", "t", "start", "n", "kg", "sh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                held.append(batch.slice(at, 2048))
                rows += held[-1].num_rows
                if rows < 2048:
                    continue
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                whole = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if whole:
                    yield flush(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows = table.num_rows - whole
        if rows:
            yield flush(pa.Table.from_batches(held))

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(run, "d long, t long, start long, n long, kg long, sh long")


def _classes(runs: DataFrame) -> DataFrame:
    """(kg, sh, c, first, last): runs with equal content, their number and two of them, not the same if there are two."""
    low, high = (F.struct("d", "t", F.element_at("at", k).alias("at")) for k in (1, -1))
    return runs.groupBy("kg", "sh").agg(F.sum(F.size("at")).alias("c"), F.min(low).alias("first"), F.max(high).alias("last"))


def _half_classes(halves: DataFrame) -> DataFrame:
    """The same of halves, with their content."""
    member = F.struct("d", "t", "at", "ctx")
    return halves.groupBy("kg", "sh").agg(F.count(F.lit(1)).alias("c"), F.min(member).alias("first"), F.max(member).alias("last"))


def _twins(classes: DataFrame) -> DataFrame:
    """Both members of each class of several, in a group of their own."""
    return classes.filter("c > 1").select(F.xxhash64("kg", "sh").alias("g"), "kg", "sh", F.lit(True).alias("twin"), F.explode(F.array("first", "last")).alias("m")).select("g", "kg", "sh", "twin", "m.*")


def _firsts(classes: DataFrame) -> DataFrame:
    """One member of each class, to meet by anchor."""
    return classes.select(F.col("kg").alias("g"), "kg", "sh", F.lit(False).alias("twin"), "first.*")


def _lent(members: DataFrame, found: DataFrame, scratch: Scratch, name: str | None) -> DataFrame:
    """(d, t, spans): all windows of the members (their places in the array at) of classes whose twins are equal. The keys are written, so that AQE can split a class of very many members."""
    equal = found.filter("kg is not null").select("kg", "sh")
    equal = scratch.put(equal, name) if name else equal
    whole = F.transform("at", lambda a: F.struct(F.shiftright(a, 24).alias("start"), F.shiftright(a, 12).bitwiseAND(F.lit(4095).cast("long")).alias("n")))
    return members.join(equal, ["kg", "sh"]).select("d", "t", whole.alias("spans"))


def _halved(rows: DataFrame, plan: Plan, level: int) -> DataFrame:
    """The halves, at a level, of contexts that are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            out = [(g, g, sh, False, d, t, at, own) for d, t, a, ctx in zip(columns["d"], columns["t"], columns["at"], columns["ctx"], strict=True) for g, sh, at, own in _halves(plan, level, a, ctx)]
            if out:
                yield _batch(out)

    return rows.select("d", "t", "at", "ctx").mapInArrow(run, CONTEXT)


def repeated_windows(docs: DataFrame, plan: Plan, scratch: Scratch, *, id_col: str, text_col: str) -> DataFrame:
    """(d, t, spans): for each document with repeats, arrays of (first window, number of windows), in units."""
    if plan.group_limit < 2:
        raise ValueError("group_limit must be at least 2")
    texts = docs.select(*identity(docs, id_col, text_col), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") >= plan.window)
    texts = at_most(2, texts, scratch.put(repeated_rows(texts), "again"))
    repeated = scratch.put(_anchors(texts, plan, True).groupBy("kg").agg(F.sum("n").alias("n")).filter("n > 1").select("kg"), "anchors")
    rows = scratch.put(_anchors(texts, plan, False).join(repeated, "kg"), "rows0")
    scratch.drop("anchors")
    level, spans = 0, None
    while True:
        # a group's number of classes decides: one has nothing to share, and many are split
        # halves are few (hot groups' alone), so their classes are worked out where they are needed and not written
        classes = _half_classes(rows) if level else scratch.put(_classes(rows), "classes0")
        sized = classes.groupBy("kg").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        sized = sized if level else scratch.put(sized, "sized0")
        several = classes.join(sized.filter(F.col("k") <= plan.group_limit).select("kg"), "kg")
        meeting = _twins(classes).unionByName(_firsts(several))
        found = scratch.put(_compared(meeting if level else _contexts(texts, meeting, plan, False), plan), f"found{level}")
        members = rows.withColumn("at", F.array("at")) if level else rows
        new = found.filter("d is not null").select("d", "t", F.array(F.struct("start", "n")).alias("spans")).unionByName(_lent(members, found, scratch, None if level else "equal0"))
        spans = new if spans is None else spans.unionByName(new)
        hot = sized.filter(F.col("k") > plan.group_limit).select("kg")
        if hot.isEmpty():
            break
        large = _firsts(classes.join(hot, "kg"))
        level += 1
        rows = scratch.put(_halved(large, plan, level) if level > 1 else _contexts(texts, large, plan, True), f"rows{level}")
    gathered = scratch.put(spans.groupBy("d", "t").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")  # as many as the document has runs
    scratch.drop("again", "classes0", "sized0", "equal0", *[f"{n}{k}" for k in range(level + 1) for n in ("rows", "found")])
    return gathered


def runs_of_steps(repeated: np.ndarray, which: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows) of each run of repeated windows; a context's windows are listed in order."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at, at
    new = np.append(True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]]))
    begin = np.flatnonzero(new)
    return which[at[begin]], step[at[begin]], np.diff(np.append(begin, len(at)))


def covered(spans: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Merged (start, end) of the units that windows cover; touching ones become one. ``spans``: rows (first window, windows)."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 0] + spans[:, 1] - 1 + window)
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > ends[:-1]
    first = np.flatnonzero(new)
    return list(zip(spans[first, 0].tolist(), ends[np.append(first[1:], len(spans)) - 1].tolist(), strict=True))


def with_spans(docs: DataFrame, spans: DataFrame, *, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """carried (a struct of the columns to carry, if any), __id, __text and spans (null: no repeats) for every row."""
    carried = [F.struct(*[f"`{c}`" for c in carry]).alias("carried")] if carry else []
    own = docs.select(*carried, F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *identity(docs, id_col, text_col))
    return own.join(spans, ["d", "t"], "left").drop("d", "t")


def span_array(cell: pa.Scalar) -> np.ndarray:
    if not cell.is_valid:
        return np.empty((0, 2), np.int64)
    return np.stack([cell.values.field("start").to_numpy(zero_copy_only=False), cell.values.field("n").to_numpy(zero_copy_only=False)], 1)
