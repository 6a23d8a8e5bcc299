"""Language identification by cross-parsing: how few phrases of a language's sample does a text need?"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm._text import pieces

#: A text is parsed in blocks of so many symbols, all blocks of a batch in step; phrases end with their block.
BLOCK = 1024
#: Transitions of so many letters, the commonest, are kept in a dense table; those of all others in a sorted list.
DENSE = 62
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 2 a letter, 1 a mark, 0 else; and its lower-case form."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    low = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = 2
            if len(lower := chr(c).lower()) == 1:
                low[c] = ord(lower)
        elif k == "M":
            kind[c] = 1
    return kind, low


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(lengths)))


class SuffixAutomaton:
    """Of one symbol sequence: ``following[s]`` are a state's transitions."""

    def __init__(self, symbols: list[int]):
        self.following: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new, p = len(link), last
            self.following.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in self.following[p]:
                self.following[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.following[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(link)
                    self.following.append(dict(self.following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and self.following[p].get(c) == q:
                        self.following[p][c] = twin
                        p = link[p]
            last = new


class Parser:
    """Parses texts against every language's automaton at once."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        kind, low = _code_points()
        self.languages = [lang for lang, _ in samples]
        points = [low[_points([sample])[0]] for _, sample in samples]
        letters = np.concatenate(points) if points else np.empty(0, np.uint32)
        values, counts = np.unique(letters[kind[letters] > 0], return_counts=True)
        alphabet = values[np.lexsort((values, -counts))]
        # 0 is what stands between words, 1 any letter that no sample has, 2 a break between samples, then the letters
        self.symbols = len(alphabet) + 3
        self.dense = min(len(alphabet), DENSE) + 3
        known = np.ones(len(kind), np.int32)
        known[alphabet] = np.arange(3, len(alphabet) + 3, dtype=np.int32)
        self.symbol_of = np.where(kind > 0, known[low], 0).astype(np.int32)
        self.is_letter = kind == 2
        tables, self.roots, self.cost, base = [], [], [], 0
        keys, targets, self.first = [], [], np.empty((len(points), self.symbols - self.dense), np.int64)
        for lang, own in enumerate(points):
            sequence = self._squeezed(np.where(own == 10, 2, self.symbol_of[own]))
            automaton = SuffixAutomaton(sequence.tolist())
            tables.append(self._table(automaton, base))
            self.first[lang] = base * 2 + 1
            for state, go in enumerate(automaton.following):
                for c, t in go.items():
                    if c >= self.dense and state == 0:
                        self.first[lang, c - self.dense] = (t * self.dense + base) * 2 + 1
                    elif c >= self.dense:
                        keys.append((state * self.dense + base) * self.symbols + c)
                        targets.append((t * self.dense + base) * 2)
            self.roots.append(base)
            # a letter out of the alphabet is the least that a phrase tells: a tiny sample makes no phrase cheaper
            self.cost.append(math.log2(max(len(sequence) + 2, self.symbols)))
            base += len(automaton.following) * self.dense
            if base >= 1 << 30:
                raise ValueError("the samples are too large for one table; take fewer languages or characters")
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array([*keys, -1], np.int64)[[*order, -1]], np.array([*targets, -1], np.int64)[[*order, -1]]

    @staticmethod
    def _squeezed(symbols: np.ndarray) -> np.ndarray:
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        return symbols[keep]

    def _table(self, automaton: SuffixAutomaton, base: int) -> np.ndarray:
        """Twice the place of the state to go to, plus 1 if a phrase begins with this symbol."""
        states, width = len(automaton.following), self.dense
        table = np.full((states, width), -1, np.int64)
        for s, go in enumerate(automaton.following):
            for c, t in go.items():
                if c < width:
                    table[s, c] = t
        fresh = np.where(table[0] < 0, 0, table[0])
        begins = table < 0
        begins[0] = True
        table = np.where(begins, fresh, table)
        return ((table * width + base) * 2 + begins).astype(np.int32).ravel()

    def _rare(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """What the table would hold for letters that it has no column for."""
        wanted = states.astype(np.int64) * self.symbols + symbols
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, self.targets[at], self.first[:, symbols - self.dense])

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol that each text needs under each language (rows: languages), and which texts have a letter."""
        points, offsets = _points(texts)
        n = len(texts)
        letters = np.concatenate(([0], np.cumsum(self.is_letter[points])))
        has_letter = letters[offsets[1:]] > letters[offsets[:-1]]
        symbols = self.symbol_of[points]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        keep[offsets[offsets < len(symbols)]] = True
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        symbols = symbols[keep]
        lengths = np.diff(offsets)
        per_text = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(n), per_text)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        begin = offsets[owner] + place * BLOCK
        size = np.minimum(BLOCK, offsets[owner + 1] - begin) if len(owner) else np.empty(0, np.int64)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), "left")
        states = np.repeat(np.array(self.roots, np.int32)[:, None], len(size), 1)
        phrases = np.zeros(states.shape, np.int32)
        for t in range(steps):
            m = active[t]
            now = symbols[begin[:m] + t]
            late = np.flatnonzero(now >= self.dense)
            go = self.table[states[:, :m] + np.where(now < self.dense, now, 1)]
            if len(late):
                go[:, late] = self._rare(states[:, late], now[late])
            phrases[:, :m] += go & 1
            states[:, :m] = go >> 1
        total = np.stack([np.bincount(owner, weights=row, minlength=n) for row in phrases]) if len(self.languages) else np.zeros((0, n))
        return total * np.array(self.cost)[:, None] / np.maximum(lengths, 1), has_letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score: the runner-up's share of the two best languages' bits."""
        bits, has_letter = self.bits([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = np.argmin(bits, 0)
        ranked = np.sort(bits, 0)
        share = ranked[1] / np.maximum(ranked[0] + ranked[1], 1e-12) if len(bits) > 1 else np.ones(len(texts))
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)], np.where(has_letter, np.clip(share, 0.0, 1.0), 0.0)


@lru_cache(maxsize=2)
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    """Built once in each Python worker, from the samples alone."""
    return Parser(samples)


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, *, pieces_each: int = 512, piece_chars: int = 64, most_pieces: int = 65_536) -> tuple[tuple[str, str], ...]:
    """For each language a sample of its labelled texts: of all pieces of ``piece_chars`` characters (a text's last one is shorter) the
    ``pieces_each`` with the least hashes.

    A long text has many pieces and a short one is a piece, so each is learned from by its share, whatever its length. The rows
    that are learned from are bounded by ``pieces_each`` for a language and by ``most_pieces`` for all (where there are many languages each gets
    its part, but 8 pieces at least). Equal sizes keep the languages' phrase counts comparable, and the cost of a phrase is the logarithm of the
    sample's size. Pieces are chosen by their places alone; texts are read again for the chosen ones only. A piece of
    many equal rows counts as often as it comes.
    """
    text = F.col("text").cast("string")
    own = docs.filter(F.col("lang").isNotNull() & (F.length(text) > 0) & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("x"), F.ceil(F.length(text) / piece_chars).alias("n"))
    counts = own.groupBy("lang").agg(F.sum("n").alias("all")).collect()  # a row for each language
    if not counts:
        return ()
    each = max(8, min(pieces_each, most_pieces // len(counts)))
    # the smallest hashes lie below a bound that about eight times as many pieces as wanted pass, so few meet in a language's task
    bounds = []
    for r in counts:
        share = 8 * each / r["all"]
        bounds.append((r.lang, -(1 << 63) + int(share * (1 << 64)) if share < 1 else (1 << 63) - 1))

    def pick(bounds: list[tuple[str, int]]) -> list:
        limits = docs.sparkSession.createDataFrame(bounds, "own_lang string, most long")
        cut = own.join(F.broadcast(limits), F.col("lang") == F.col("own_lang")).select("lang", "id", "x", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        some = cut.withColumn("h", F.xxhash64("id", "x", "k")).filter("h <= most").groupBy("lang", "h", "id", "x", "k").count()
        first = Window.partitionBy("lang").orderBy("h", "id", "x", "k")
        before = F.coalesce(F.sum("count").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        best = some.withColumn("before", before).filter(F.col("before") < each)
        return best.select("lang", "id", "x", "k", "before", F.least("count", each - F.col("before")).alias("times")).collect()  # most_pieces rows, or 8 for each language

    chosen = pick(bounds)
    # pieces that are all alike have one hash, which may lie beyond the bound
    if missing := {lang for lang, _ in bounds} - {r.lang for r in chosen}:
        chosen += pick([(lang, (1 << 63) - 1) for lang in sorted(missing)])
    places: dict[tuple, set[int]] = {}
    for r in chosen:
        places.setdefault((r.lang, r.id, r.x), set()).add(r.k)
    kinds = T.StructType([T.StructField("own_lang", T.StringType()), T.StructField("own_id", docs.schema["doc_id"].dataType), T.StructField("own_x", T.LongType()), T.StructField("ks", T.ArrayType(T.LongType()))])
    wanted = docs.sparkSession.createDataFrame([(*key, sorted(ks)) for key, ks in places.items()], kinds)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("id"), text.alias("t"), F.xxhash64(text).alias("x"))
    same = (F.col("lang") == F.col("own_lang")) & F.col("id").eqNullSafe(F.col("own_id")) & (F.col("x") == F.col("own_x"))
    rows = texts.join(F.broadcast(wanted), same).select("lang", "id", "x", F.transform("ks", lambda k: F.struct(k.alias("k"), F.col("t").substr((k * piece_chars + 1).cast("int"), F.lit(piece_chars)).alias("t"))).alias("pieces"))
    text_of = {(r.lang, r.id, r.x, p.k): p.t.replace("\n", " ") for r in rows.dropDuplicates(["lang", "id", "x"]).collect() for p in r.pieces}
    found: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r.lang, r.before)):
        found.setdefault(r.lang, []).extend([text_of[r.lang, r.id, r.x, r.k]] * r.times)
    return tuple((lang, "\n".join(texts)) for lang, texts in found.items())


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row, from its whole text.

    Letters are lower-cased and every run of other characters counts as one space. The text is parsed greedily into the
    longest strings that occur in a language's sample; phrases times the logarithm of the sample's size, over the text's
    length, estimate its cross-entropy, and the lowest wins (ties: the first language by name). A null text, or one
    without a letter, is ``und`` with score 0. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parser = parser_of(shared.value)
            for part in pieces(batch):
                lang, score = parser.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
