"""Spelling variant grouping: words one edit apart, found by automata that hold every word's two halves.

One edit falls into one half of a word, so the other half stands unchanged at the same end of the other word. A word's cell is a range of
its places and the text around it: its first cells are its halves. Words meet by that text; a shard of meeting cells is one
Aho-Corasick automaton over the text around them, which scans all words of the shard once. A hit must stand at its end of the
scanned word, lengths may differ by one at most, and then the distance is verified.

A text around that more words share than ``cell_limit`` is lengthened: its cells are halved, and words meet by more text, again and again if need
be. A cell of one place is not halved: all its words are one edit apart, so there are no more of them than the alphabet allows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm._text import buffer_of
from veilgraph.store import Scratch

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z were lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct words that a task holds before it sends their counts on, and pairs of letters that are compared at once.
_HELD, _AT_ONCE = 200_000, 1 << 22


def _garbled(word: bytes, check: int) -> bytes:
    text = word.decode()
    at = check % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int | None = 199, least: int = 6) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z lower-cased, of at least ``least`` letters, and how often they occur.

    With ``every``, a run whose crc32 (of ``<id>:<run>``) is divisible by it loses the letter at that crc32 modulo its length: planted
    misspellings. A null id plants none. Null texts have no words. Words are counted in each task before they are shuffled.
    """
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)

    def batch_of(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            buf, offsets = buffer_of(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                runs = _RUN.findall(buf[offsets[i] : offsets[i + 1]].tobytes().translate(_LOWER))
                base = None if name is None or not every else zlib.crc32(f"{name}:".encode())
                mine: dict[bytes, int] = {}
                for w in runs:
                    mine[w] = mine.get(w, 0) + 1
                for w, n in mine.items():
                    if base is not None:
                        check = zlib.crc32(w, base)
                        if check % every == 0:
                            w = _garbled(w, check)
                    if len(w) >= least:
                        counts[w] = counts.get(w, 0) + n
                if len(counts) > _HELD:
                    yield batch_of(counts)
                    counts = {}
        if counts:
            yield batch_of(counts)

    return own.mapInArrow(run, "word string, n long").filter(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


def _cells(words: DataFrame) -> DataFrame:
    """The cells of level 1: for each word, both halves of a word of its own length and of one that is a letter shorter."""
    size = F.length("word")
    lengths = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length"))
    return _keyed(lengths.filter("length > 0").select("word", "n", "length", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")), 1)


def _finer(cells: DataFrame, level: int) -> DataFrame:
    """The halves of cells."""
    return _keyed(cells.select("word", "n", "length", F.explode(F.array(2 * F.col("i"), 2 * F.col("i") + 1)).alias("i")), level)


def _keyed(cells: DataFrame, level: int) -> DataFrame:
    """word, n, length (of the words to be met), a and b (the cell's places), key (of the text around them), own (whether the word has that length).

    A scanned word that is a letter longer has the same text around a cell that is one place longer.
    """
    wide = cells.select("word", "n", "length", "i", (F.col("i") * F.col("length") / 2**level).cast("int").alias("a"), ((F.col("i") + 1) * F.col("length") / 2**level).cast("int").alias("b"))
    before = F.substring("word", F.lit(1), F.col("a"))
    after = F.substring("word", F.length("word") - F.col("length") + F.col("b") + 1, F.col("length") - F.col("b"))
    return wide.select("*", F.xxhash64("length", "a", "b", before, after).alias("key"), (F.length("word") == F.col("length")).alias("own"))


def _meeting(words: DataFrame, scratch: Scratch, cell_limit: int) -> DataFrame:
    """The cells whose text around is shared, each group within the limit or of one place."""
    level, done = 1, None
    cells = _cells(words)
    while True:
        sizes = scratch.put(cells.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("b") - F.col("a")).alias("wide"), F.max("own").alias("held")).filter("k > 1 and held"), f"sizes{level}")
        hot = (F.col("k") > cell_limit) & (F.col("wide") > 1)
        here = cells.join(sizes.filter(~hot).select("key"), "key").drop("i")
        done = here if done is None else done.unionByName(here)
        large = sizes.filter(hot).select("key")
        if large.isEmpty():
            return done
        level += 1
        cells = scratch.put(_finer(cells.join(large, "key"), level), f"cells{level}")


def _gathered(letters: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    return letters[start[:, None] + np.arange(length)]


def _first(differs: np.ndarray) -> np.ndarray:
    """Where each row differs first; its length if nowhere."""
    return np.where(differs.any(axis=1), differs.argmax(axis=1), differs.shape[1])


def one_edit(letters: np.ndarray, start: np.ndarray, length: np.ndarray, scanned: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For pairs of words (their numbers), whose second is as long as the first or a letter shorter: the place of their one edit, or -1.

    A letter that is more is put at the last place that it can have.
    """
    place = np.full(len(scanned), -1, np.int64)
    size, more = length[held], length[scanned] - length[held]
    for n, extra in np.unique(np.stack((size, more), 1), axis=0) if len(size) else ():
        mine = np.flatnonzero((size == n) & (more == extra))
        for at in range(0, len(mine), max(1, _AT_ONCE // int(n))):
            own = mine[at : at + max(1, _AT_ONCE // int(n))]
            u, w = _gathered(letters, start[scanned[own]], int(n + extra)), _gathered(letters, start[held[own]], int(n))
            if extra:
                first = _first(u[:, :n] != w)
                back = _first((u[:, 1:] != w)[:, ::-1])
                place[own] = np.where(first + back >= n, first, -1)
            else:
                differs = u != w
                place[own] = np.where(differs.sum(axis=1) == 1, differs.argmax(axis=1), -1)
    return place


def _shard(table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near word) of a shard's cells, as numbers of its distinct words, and those words.

    Every cell of a word's own length puts the longer part of the text around it into the automaton, which scans each distinct word once.
    """
    words, number = np.unique(table["word"], return_inverse=True)
    texts = words.tolist()
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.flatnonzero(table["own"])
    owner, a, b = number[own], table["a"][own].astype(np.int64), table["b"][own].astype(np.int64)
    at_start = a >= length[owner] - b
    segments: dict[str, int] = {}
    at: list[int] = []
    for w, x, y, front in zip(owner.tolist(), a.tolist(), b.tolist(), at_start.tolist(), strict=True):
        at.append(segments.setdefault(texts[w][:x] if front else texts[w][y:], len(segments)))
    automaton = ahocorasick.Automaton()
    for segment, k in segments.items():
        automaton.add_word(segment, (k, len(segment)))
    automaton.make_automaton()
    # all words in one scan, each after a blank
    line = " " + " ".join(texts)
    begins = np.cumsum(np.append(1, length[:-1] + 1))
    hits = [(end, k, n) for end, (k, n) in automaton.iter(line)] if segments else []
    end, segment, size = np.array(hits, np.int64).reshape(-1, 3).T
    scanned = np.searchsorted(begins, end, "right") - 1
    front, back = end - size + 1 == begins[scanned], end + 1 == begins[scanned] + length[scanned]
    # cells by segment, end of the word and length; a hit asks for cells of the scanned word's length and of one letter less
    key = lambda s, f, n: (s * 2 + f) * (int(length.max()) + 2) + n
    cell_key = key(np.array(at, np.int64), at_start, length[owner])
    order = np.argsort(cell_key, kind="stable")
    cell_key, owner, a, b = cell_key[order], owner[order], a[order], b[order]
    letters = np.frombuffer(line.encode("latin-1"), np.uint8)
    found_w, found_u = [], []
    for f, stands in ((1, front), (0, back)):
        for less in (0, 1):
            wanted = key(segment[stands], f, length[scanned[stands]] - less)
            low, high = np.searchsorted(cell_key, wanted, "left"), np.searchsorted(cell_key, wanted, "right")
            some = np.flatnonzero(high > low)
            low, count, who = low[some], (high - low)[some], scanned[stands][some]
            for x, y in _parts(count):
                n = count[x:y]
                cell = np.repeat(low[x:y] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                u = np.repeat(who[x:y], n)
                place = one_edit(letters, begins, length, u, owner[cell])
                # an edit lies in one cell of the held word; what is behind its last letter lies in the last
                mine = (place >= a[cell]) & ((place < b[cell]) | (b[cell] == length[owner[cell]]))
                found_w.append(owner[cell][mine])
                found_u.append(u[mine])
                if less:  # found once; words of one length find each other
                    found_w.append(found_u[-1])
                    found_u.append(found_w[-2])
    return words, np.concatenate(found_w or [np.empty(0, np.int64)]), np.concatenate(found_u or [np.empty(0, np.int64)])


def _parts(count: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about so many pairs."""
    edges = np.unique(np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + most, most), "left")) if len(count) else np.empty(0, np.int64)
    edges = np.unique(np.append(np.append(0, edges), len(count)))
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def near_words(words: DataFrame, scratch: Scratch, *, cell_limit: int = 1024, shard_cells: int = 50_000) -> DataFrame:
    """(word, n_near, best): how many of the ``words`` (word, n) are one insertion, deletion or replacement away, and struct(-n, word) of the most
    frequent of them (ties: least in code-point order). Words without any are left out.

    A task works off its cells in shards of about ``shard_cells``, in the order of their keys; cells of one key are never parted.
    """
    meeting = _meeting(words, scratch, cell_limit).select("key", "word", "n", "a", "b", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: pa.Table) -> pa.RecordBatch:
            table = {c: np.array(rows.column(c).to_pylist(), object) if c == "word" else rows.column(c).to_numpy() for c in ("word", "a", "b", "own", "n")}
            names, word, near = _shard(table)
            times = np.zeros(len(names), np.int64)
            times[np.searchsorted(names, table["word"])] = table["n"]
            order = np.lexsort((near, -times[near], word))  # numbers of words are in code-point order
            word, near = word[order], near[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(word)))
            best = pa.StructArray.from_arrays([pa.array(-times[near[first]]), pa.array(names[near[first]], pa.string())], ["n", "word"])
            return pa.RecordBatch.from_arrays([pa.array(names[word[first]], pa.string()), pa.array(n), best], names=["word", "n_near", "best"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < shard_cells:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if whole:
                yield work(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            rows = table.num_rows - whole
        if rows:
            yield work(pa.Table.from_batches(held))

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("best", T.StructType([T.StructField("n", T.LongType()), T.StructField("word", T.StringType())]))])
    found = meeting.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): each word's last form. A pointer jumps to its own word's pointer, so chains halve with every round."""
    up = scratch.put(forms.select("word", F.col("form").alias("root")), "up0")
    step = 0
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        step += 1
        further = scratch.put(up.join(on, "root", "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("moved")), f"up{step}")
        up = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return up


def spelling_variants(words: DataFrame, *, least: int = 5, times: int = 5, cell_limit: int = 1024, shard_cells: int = 50_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word (word, n) with at least ``least`` occurrences.

    Two words are near if exactly one letter is inserted, deleted or replaced. A word's form is its most frequent near word (ties: the
    least in code-point order) if that is ``times`` as frequent; else null, with form_n. root follows forms to the last word, and is the word
    itself if it has none. Words are of U+0020 to U+00FF (without blanks), each given once; null words are left out.
    """
    if cell_limit < 2 or shard_cells < 1:
        raise ValueError("cell_limit must be at least 2 and shard_cells positive")
    scratch = Scratch(words.sparkSession)
    words = scratch.put(words.filter(f"word is not null and n >= {int(least)}").select("word", "n"), "words")
    near = near_words(words, scratch, cell_limit=cell_limit, shard_cells=shard_cells)
    has_form = -F.col("best.n") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.word")).alias("form"), F.when(has_form, -F.col("best.n")).alias("form_n")
    )
    found = scratch.put(found, "found")
    roots = _roots(found.filter("form is not null"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
