"""Exact substring dedup: suffixes at the candidate windows are sorted, shallowly by multikey steps, then by blind tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilgraph.llm._repeats import Plan, covered, repeated_windows, span_array, with_spans
from veilgraph.store import Scratch
from veilgraph.llm._text import buffer_of, pieces

#: So many 8-byte steps are sorted before blind tries take over.
SHALLOW = 4


def _multikey(words: np.ndarray, starts: np.ndarray, left: np.ndarray, group: np.ndarray, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes within groups down to the last of ``depths``; returns those that still agree with another, and their groups.

    Every group of a round is parted in three by a pivot, the 8 bytes of its middle suffix at the group's depth: less,
    equal and greater. The equal ones go one step deeper. Groups of one are in order and drop out. All groups take a
    round at once, and the three parts are placed by running counts.
    """
    depths_ = np.array(depths, np.int64)
    at = np.zeros(len(left), np.int64)  # how many steps a suffix agrees with its group
    done_left, done_group, offset = [], [], 0
    while len(left):
        new = np.append(True, group[1:] != group[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(left)))
        number = np.cumsum(new) - 1
        own = words[starts[left] + depths_[at]]
        pivot = own[first + size // 2][number]
        parts = [own < pivot, own == pivot, own > pivot]
        target, base = np.empty(len(left), np.int64), first[number].copy()
        for part in parts:
            run = np.cumsum(part)
            before = (run - part)[first]
            target[part] = (base + run - 1 - before[number])[part]
            base += np.append(run[first[1:] - 1], run[-1])[number] - before[number]
        side = parts[1] + 2 * parts[2].astype(np.int64)
        order = np.empty(len(left), np.int64)
        order[target] = np.arange(len(left))
        left, side, number, at = left[order], side[order], number[order], at[order]
        at += side == 1
        key = number * 3 + side
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        deep = many & (at == len(depths))
        done_left.append(left[deep])
        done_group.append(group[deep] + offset)
        offset += int(group[-1]) + 1
        go = many & ~deep
        left, group, at = left[go], group[go], at[go]
    return (np.concatenate(done_left), np.concatenate(done_group)) if done_left else (left, group)


def repeated_suffixes(raw: bytes, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes, cut to ``length`` bytes, equal another one of the same bucket.

    Shallow phase: multikey quicksort, 8 bytes a step, within buckets; a suffix alone in its group
    is done. Deep phase, for groups that agree over SHALLOW steps: a blind trie whose leading path is the group's first
    suffix. Every other suffix is compared with that path once; those that leave it hang below it at a node known only
    by depth and branching bytes, and each such child is ordered by the same step. All groups take a step at once.
    """
    n = len(starts)
    repeated = np.zeros(n, bool)
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)).astype(np.uint64)
    depths = [*range(0, length - 8, 8), length - 8]
    order = np.argsort(bucket, kind="stable")
    keys = bucket[order]
    group = np.cumsum(np.append(True, keys[1:] != keys[:-1])) - 1 if n else keys
    some = np.bincount(group)[group] > 1 if n else np.zeros(0, bool)
    left, group = _multikey(words, starts, order[some], group[some], depths[:SHALLOW])

    def grouped(left, group, *keys):
        """Suffixes ordered by group and keys, with new group numbers, without groups of one."""
        order = np.lexsort((*keys[::-1], group))
        left, group, keys = left[order], group[order], [k[order] for k in keys]
        new = np.ones(len(left), bool)
        if len(left):
            new[1:] = group[1:] != group[:-1]
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1 if len(left) else np.empty(0, bool)
        return left[many], number[many]

    left, group = grouped(left, group)
    deep = np.array(depths[SHALLOW:], np.int64)
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(new)
        leader = left[first][np.cumsum(new) - 1]
        branch = np.full(len(left), -1, np.int64)
        value = np.zeros(len(left), np.uint64)
        same = np.arange(len(left))
        for depth in deep:
            own = words[starts[left[same]] + depth]
            differs = own != words[starts[leader[same]] + depth]
            out = same[differs]
            branch[out], value[out] = depth, own[differs]
            same = same[~differs]
        equal = branch < 0
        followers = equal & ~new
        repeated[left[followers]] = True
        repeated[leader[followers]] = True
        left, group = grouped(left[~equal], group[~equal], branch[~equal], value[~equal])
    return repeated


def _compare(window: int):
    def compare(group: np.ndarray, place: np.ndarray, contexts: list[bytes], which: np.ndarray, step: np.ndarray) -> np.ndarray:
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        base = np.cumsum(sizes) - sizes
        # equal windows have the anchor at the same place
        return repeated_suffixes(b"".join(contexts), base[which] + step, group[which] * 4096 + place[which] - step, window)

    return compare


def _reader(texts: pa.Array):
    buf, offsets = buffer_of(texts)
    raw = buf.tobytes()
    return offsets, lambda a, b: raw[a:b]


def _cut(ctx: bytes, a: int, b: int) -> bytes:
    return ctx[a:b]


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 200, group_limit: int = 512, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``min_length`` bytes that also starts anywhere else in the corpus.

    Texts are UTF-8 bytes (null: empty). A string may repeat within its own document, and overlapping occurrences count.
    All occurrences go, judged on the input. Returns ``carried`` (a struct of the columns named in ``carry``, if any), id, n_bytes, spans (array of start, end of
    the maximal removed runs) and kept (binary: what is left, which may begin or end
    inside a character; ``as_text``: a string without the bytes of characters that were cut). Repeated rows
    repeat each other; an empty text, or one shorter than ``min_length``, loses nothing.
    """
    if not 40 <= min_length <= 3000:
        raise ValueError("min_length must be from 40 to 3000")
    scratch = Scratch(docs.sparkSession)
    plan = Plan(buffer_of, _reader, _cut, min_length, 32, _compare(min_length), group_limit)
    spans = repeated_windows(docs, plan, scratch, id_col=id_col, text_col=text_col)
    rows = with_spans(docs, spans, id_col=id_col, text_col=text_col, carry=carry)
    lead = rows.drop("__text", "spans")
    lead_names = lead.columns
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, "__text"):
                n = part.num_columns - 2
                texts = part.column(n)
                buf, offsets = buffer_of(texts)
                raw, kept, gone = buf.tobytes(), [], []
                for i, cell in enumerate(part.column(n + 1)):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    cut = covered(span_array(cell), min_length)
                    gone.append([{"start": x, "end": y} for x, y in cut])
                    edges = [0, *(e for pair in cut for e in pair), b - a]
                    kept.append(raw[a:b] if not cut else b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array(np.diff(offsets)), pa.array(gone, arrow_spans), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=[*lead_names, "n_bytes", "spans", "kept"]
                )

    ordered = rows.select(*[f"`{c}`" for c in lead.columns], "__text", "spans")
    schema = lead.schema.add("n_bytes", "long").add("spans", span_type).add("kept", "string" if as_text else "binary")
    return ordered.mapInArrow(run, schema).withColumnRenamed("__id", "id")

