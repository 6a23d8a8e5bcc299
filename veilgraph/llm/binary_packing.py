"""Packing by powers of two: documents are cut into binary-length pieces, and equal lengths share a bucket."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._text import pieces

#: Beyond these code points the two libraries' Unicode tables may differ, so the tokenizer file's own library is used.
_COMMON = re.compile("[^\x00-ɏ‐-‧]")
_LONG_BLANK = re.compile(r"\s{2000}")


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole sequences first, then falling powers of two.

    >>> binary_lengths(21, 8)
    [8, 8, 4, 1]
    """
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


@lru_cache(maxsize=4)
def _encoders(path: str):
    """The tokenizer, and a faster encoder with the same ids built from the same file (None if it can't be)."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if not plain:
        return exact, None, None
    import tiktoken

    # byte-level files write each byte as one printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    # the faster encoder merges by id, so ids must follow the order of the file's merges, and every single byte have one
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    order = [model["vocab"].get(token, -1) for token in merged]
    if order != sorted(set(order)) or (order and order[0] < 0) or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != len(order) + 256:
        return exact, None, None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("of_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return exact, fast, re.compile("|".join(map(re.escape, special))) if special else None


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizer file gives for a text, without special tokens added."""
    exact, fast, special = _encoders(path)
    if fast is None or (special and special.search(text)) or _COMMON.search(text) or _LONG_BLANK.search(text):
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_ordinary(text), np.uint32)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece; a piece of a power of two is a whole sequence, so nothing is padded.

    A document's ids are its text's, then ``end_id``; a null text has ``end_id`` alone. Pieces of the same
    ``bucket`` (their length) can be batched together. ``sequence_id`` holds the input partition and a count
    within it, so that no shuffle numbers the sequences. Repeated rows are packed as often as they come; a null
    id stays null. ``with_ids`` adds the ids themselves (``ids``, array of int).
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            for part in pieces(batch):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    doc = np.append(token_ids(text or "", tokenizer_path), np.uint32(end_id)).astype("<u4")
                    raw, at = memoryview(doc.tobytes()), 0
                    for n in binary_lengths(len(doc), longest):
                        row.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                        total.append(len(doc))
                        if with_ids:
                            ids.append(doc[at : at + n].astype(np.int32))
                        at += n
                n = len(row)
                columns = [part.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.arange(count, count + n)), pa.array(np.zeros(n, np.int64)), pa.array(length, pa.int32())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                count += n
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
