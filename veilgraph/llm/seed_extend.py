"""Substring dedup over words by seed and extend: documents join on winnowed anchors, matches grow both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilgraph.llm._repeats import Plan, covered, repeated_windows, span_array, with_spans
from veilgraph.store import Scratch
from veilgraph.llm._text import buffer_of, byte_table, pieces, word_hashes, word_spans

#: Words are runs of anything but space and the control characters 09 to 0D.
_IN_WORD = byte_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))


def _word_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = buffer_of(texts)
    starts, ends, firsts = word_spans(buf, offsets, _IN_WORD)
    return word_hashes(buf, starts, ends), firsts


def _reader(texts: pa.Array):
    """Words a to b as bytes, joined by single spaces (no word holds one)."""
    buf, offsets = buffer_of(texts)
    starts, ends, firsts = word_spans(buf, offsets, _IN_WORD)
    raw = buf.tobytes()
    return firsts, lambda a, b: b" ".join(raw[starts[a] : ends[b - 1]].split())


def _cut(ctx: bytes, a: int, b: int) -> bytes:
    return b" ".join(ctx.split(b" ")[a:b])


def _step(reached: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """Contexts that agreed so far and go on with the same word agree further: numbers of the classes after the step."""
    return np.unique(reached * words + word, return_inverse=True)[1]


def _extend(window: int):
    def compare(group: np.ndarray, place: np.ndarray, contexts: list[bytes], which: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Grows all contexts of a group from their common anchor, both ways at once; matches of at least ``window`` words count.

        Word by word, before the anchors and from them on, contexts that match so far and have the same next word go on
        together, so two contexts match x words back and y words on if they are in one class after x and y steps. The
        words themselves are compared, by numbers given to the distinct ones. A window that starts x words before the
        anchor repeats if some other context agrees x back and window - x on; neighbours among such windows make up the
        maximal repeats.
        """
        n = len(contexts)
        number: dict[bytes, int] = {}
        table = np.zeros((n, 2 * window), np.int64)  # contexts side by side, their anchors in the same column; 0: no word
        for i, ctx in enumerate(contexts):
            own = [number.setdefault(w, len(number) + 1) for w in ctx.split(b" ")]
            table[i, window - place[i] : window - place[i] + len(own)] = own
        back, ahead = np.empty((n, window + 1), np.int64), np.empty((n, window + 1), np.int64)
        back[:, 0] = ahead[:, 0] = group
        for x in range(window):
            back[:, x + 1] = _step(back[:, x], table[:, window - 1 - x], len(number) + 1)
            ahead[:, x + 1] = _step(ahead[:, x], table[:, window + x], len(number) + 1)
        before = place[which] - step
        keys = (ahead[which, window - before], back[which, before], group[which] * 4096 + before)
        order = np.lexsort(keys)
        same = np.ones(max(0, len(order) - 1), bool)
        for k in keys:
            same &= k[order[1:]] == k[order[:-1]]
        repeated = np.zeros(len(order), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        return repeated

    return compare


def seed_extend_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, group_limit: int = 512, carry: list[str] | None = None) -> DataFrame:
    """Removes every word covered by a window of ``min_words`` words whose word sequence also starts anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged (null: none); windows lie in one document, may repeat in the same one,
    and are judged on the input. Returns ``carried`` (a struct of the columns named in ``carry``, if any), id, n_words, spans (array of start, end in words) and
    kept (the words left, joined by one space). Repeated rows repeat each other; texts of fewer words lose nothing.
    """
    if not 10 <= min_words <= 500:
        raise ValueError("min_words must be from 10 to 500")
    scratch = Scratch(docs.sparkSession)
    plan = Plan(_word_units, _reader, _cut, min_words, 8, _extend(min_words), group_limit)
    spans = repeated_windows(docs, plan, scratch, id_col=id_col, text_col=text_col)
    rows = with_spans(docs, spans, id_col=id_col, text_col=text_col, carry=carry)
    lead = rows.drop("__text", "spans")
    lead_names = lead.columns
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        blank = bytes(b if _IN_WORD[b] else 32 for b in range(256))
        for batch in batches:
            for part in pieces(batch, "__text"):
                n = part.num_columns - 2
                buf, offsets = buffer_of(part.column(n))
                raw, kept, gone, sizes = buf.tobytes().translate(blank), [], [], []
                for i, cell in enumerate(part.column(n + 1)):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    sizes.append(len(words))
                    cut = covered(span_array(cell), min_words)
                    gone.append([{"start": x, "end": y} for x, y in cut])
                    for x, y in reversed(cut):
                        del words[x:y]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(sizes, pa.int64()), pa.array(gone, arrow_spans), pa.array(kept, pa.string())], names=[*lead_names, "n_words", "spans", "kept"])

    ordered = rows.select(*[f"`{c}`" for c in lead.columns], "__text", "spans")
    schema = lead.schema.add("n_words", "long").add("spans", span_type).add("kept", "string")
    return ordered.mapInArrow(run, schema).withColumnRenamed("__id", "id")
