"""Substring dedup by bytes and by words, against all windows counted one by one."""

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from veilgraph.llm._repeats import covered
from veilgraph.llm.seed_extend import seed_extend_dedup
from veilgraph.llm.suffix_dedup import repeated_suffixes, suffix_dedup

SCHEMA = "doc_id long, text string, d string, t int, spans string, kept int, carried int"


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "né", "ti", "schö", "x1", "ou"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(150)
    docs = [text(rng.randint(1, 200)) for _ in range(25)]
    docs += [f"{text(rng.randint(0, 9))} {passage} {text(rng.randint(0, 50))}" for _ in range(12)]
    for _ in range(8):  # near copies
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        docs.append(" ".join(words))
    docs += [base, base, "", None, None, "a" * 900, "ab " * 300, "\t\n ", text(4000) + " " + passage]
    docs.append(passage + "\n" + passage)
    rows = [(i, x, "clash", 1, "clash", 2, 3) for i, x in enumerate(docs)]
    rows += [rows[0], (None, docs[3], None, None, None, None, None), (1, "other text under the same id " + passage, "", 0, "", 0, 0)]
    return rows


def cover(sequences, window):
    seen = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        hit = bytearray(len(s))
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                hit[i : i + window] = b"\1" * window
        out.append(hit)
    return out


@pytest.mark.parametrize("limit", [2, 6, 512])
def test_bytes_match_brute_force(spark, limit):
    rows = corpus()
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, s, hit in zip(rows, texts, cover(texts, 200), strict=True):
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(hit))]
        want[(r[0], len(s), tuple(runs), bytes(b for b, x in zip(s, hit, strict=True) if not x))] += 1
    found = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), group_limit=limit, carry=["d", "t", "spans"])
    got = Counter((r["id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in found.collect())
    assert got == want


@pytest.mark.parametrize("limit", [2, 6, 512])
def test_words_match_brute_force(spark, limit):
    rows = corpus(4)
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    want = Counter((r[0], len(w), sum(h), b" ".join(x for x, y in zip(w, h, strict=True) if not y).decode()) for r, w, h in zip(rows, words, cover(words, 35), strict=True))
    found = seed_extend_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), group_limit=limit)
    got = Counter((r["id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in found.collect())
    assert got == want


def many_equal_rows(copies=300):
    """A text of many rows with one id, one with no id, and others that share parts of them."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    hot, bare, short = text(120), text(90), "tiny"
    rows = [(5, hot)] * copies + [(None, bare)] * copies + [(6, short)] * copies + [(9, hot.upper())] * 2
    rows += [(1, text(20) + " " + hot[100:500] + " " + text(30)), (2, bare[:150]), (3, hot + bare), (4, text(100)), (5, text(80)), (None, None), (None, text(70))]
    return rows


def test_hundreds_of_equal_rows_match_brute_force(spark):
    rows = many_equal_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    distinct = Counter(rows)
    order = list(distinct)
    # two of each are as good as all
    twice = [r for r in order for _ in range(min(2, distinct[r]))]
    texts = [(t or "").encode() for _, t in twice]
    bytes_left = {r: bytes(b for b, x in zip(s, hit, strict=True) if not x) for r, s, hit in zip(twice, texts, cover(texts, 200), strict=True)}
    got = Counter((r.id, bytes(r.kept)) for r in suffix_dedup(docs).collect())
    assert got == sum((Counter({(r[0], bytes_left[r]): n}) for r, n in distinct.items()), Counter())
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in twice]
    words_left = {r: " ".join(w for w, x in zip(s, hit, strict=True) if not x) for r, s, hit in zip(twice, words, cover(words, 35), strict=True)}
    got = Counter((r.id, r.kept) for r in seed_extend_dedup(docs).collect())
    assert got == sum((Counter({(r[0], words_left[r]): n}) for r, n in distinct.items()), Counter())


def test_a_text_of_many_rows_moves_twice(spark):
    from veilgraph.llm._repeats import at_most, repeated_rows

    rows = spark.createDataFrame([(1, 1, "x")] * 500 + [(2, 2, "y"), (1, 2, "z"), (3, 3, "w"), (3, 3, "w")], "d long, t long, text string").repartition(5)
    again = repeated_rows(rows)
    assert sorted(again.collect()) == [(1, 1), (3, 3)]
    assert sorted(at_most(2, rows, again).collect()) == [(1, 1, "x")] * 2 + [(1, 2, "z"), (2, 2, "y")] + [(3, 3, "w")] * 2
    assert sorted(at_most(1, rows, again).collect()) == [(1, 1, "x"), (1, 2, "z"), (2, 2, "y"), (3, 3, "w")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup(empty).count() == 0
    assert seed_extend_dedup(empty).count() == 0


def test_text_ids_and_other_types(spark):
    rows = [("a", "word " * 100), ("b", "word " * 100), (None, None)]
    got = {r["id"]: r["kept"] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id string, text string"), as_text=True).collect()}
    assert got == {"a": "", "b": "", None: ""}


def test_cut_characters_drop_out(spark):
    shared = "ö" * 150
    rows = [(1, "é" + shared + "x"), (2, "ü" + shared + "y")]
    for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect():
        assert r["kept"] in ("éx", "üy", "éx"[:1] + "x", "üy")


def test_suffix_order_finds_equal_suffixes():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 2, 4000, dtype=np.uint8).tobytes() * 2
    starts = rng.integers(0, len(raw) - 100, 3000)
    bucket = rng.integers(0, 3, 3000)
    got = repeated_suffixes(raw, starts, bucket, 97)
    count = Counter((b, raw[s : s + 97]) for s, b in zip(starts, bucket, strict=True))
    assert got.tolist() == [count[b, raw[s : s + 97]] > 1 for s, b in zip(starts, bucket, strict=True)]


def test_touching_spans_become_one():
    assert covered(np.array([[0, 2], [4, 1], [20, 1]]), 3) == [(0, 7), (20, 23)]




def test_parts_of_a_long_array_lose_no_window():
    from veilgraph.llm._repeats import Plan, runs_of

    rng = np.random.default_rng(5)
    units = rng.integers(97, 101, 5000, dtype=np.uint8)
    offsets = np.array([0, 0, 30, 1700, 1700, 4900, 5000])
    plan = Plan(None, None, None, 40, 16, None, 1)
    for most in (300, 1 << 20):
        text, start, count, place, _ = runs_of(units, offsets, plan, most)
        windows = {w for s, n in zip(start.tolist(), count.tolist(), strict=True) for w in range(s, s + n)}
        assert windows == {w for a, b in zip(offsets[:-1], offsets[1:], strict=True) for w in range(a, b - 39)} and count.sum() == len(windows)
        assert ((offsets[text] <= start) & (start + count + 39 <= offsets[text + 1]) & (place < 4096)).all()


def test_word_hashes_of_a_long_buffer(monkeypatch):
    from veilgraph.llm import _text

    buf = np.frombuffer(b" ".join(b"w%d" % (i % 97) for i in range(4000)), np.uint8)
    starts, ends, _ = _text.word_spans(buf, np.array([0, len(buf)]), _text.byte_table(bytes(range(33, 127))))
    whole = _text.word_hashes(buf, starts, ends)
    monkeypatch.setattr(_text, "PIECE_BYTES", 1000)
    assert (_text.word_hashes(buf, starts, ends) == whole).all() and len(set(whole.tolist())) == 97


@pytest.mark.parametrize("module", ["suffix_dedup", "seed_extend"])
def test_nothing_is_found_without_the_comparison(spark, monkeypatch, module):
    """Equal hashes alone settle nothing: where the sort or the extension finds no match, nothing goes."""
    import importlib

    from veilgraph.llm import _repeats

    owner = importlib.import_module(f"veilgraph.llm.{module}")
    real = _repeats.repeated_windows
    blind = lambda docs, plan, scratch, **k: real(docs, replace(plan, compare=lambda group, place, contexts, which, step: np.zeros(len(which), bool)), scratch, **k)
    monkeypatch.setattr(owner, "repeated_windows", blind)
    df = spark.createDataFrame(corpus(), SCHEMA)
    for limit in (2, 512):
        found = owner.suffix_dedup(df, group_limit=limit) if module == "suffix_dedup" else owner.seed_extend_dedup(df, group_limit=limit)
        assert all(not r.spans for r in found.select("spans").collect())


def test_halves_hold_every_window_once():
    from veilgraph.llm._repeats import Plan, _halves

    plan = Plan(None, None, lambda c, a, b: c[a:b], 40, 16, None, 1)
    rng = np.random.default_rng(1)
    for _ in range(50):
        place = int(rng.integers(0, plan.width))
        count = int(rng.integers(1, place + 2))
        ctx = rng.integers(0, 256, count - 1 + plan.window, dtype=np.uint8).tobytes()
        for level in range(1, 7):
            seen = []
            for _, _, at, own in _halves(plan, level, 5 << 24 | count << 12 | place, ctx):
                start, n = at >> 24, (at >> 12) & 4095
                assert own == ctx[start - 5 : start - 5 + n - 1 + plan.window] and (at & 4095) == place - (start - 5)
                seen += range(start - 5, start - 5 + n)
            assert sorted(seen) == list(range(count))


def test_halves_meet_by_what_all_their_windows_share():
    """Contexts with a common window meet in the half of that window, whatever surrounds it."""
    from veilgraph.llm._repeats import Plan, _halves

    plan = Plan(None, None, lambda c, a, b: c[a:b], 40, 16, None, 1)
    rng = np.random.default_rng(2)
    window = rng.integers(0, 256, 40, dtype=np.uint8).tobytes()
    noise = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    for x in range(plan.width):  # the anchor lies x after the window's start
        for level in range(1, 7):
            groups = []
            for _ in range(5):
                left, right = int(rng.integers(0, plan.width - x)), int(rng.integers(0, x + 1))
                ctx, place = noise(left) + window + noise(right), left + x
                count = left + right + 1
                groups.append({g for g, _, at, own in _halves(plan, level, count << 12 | place, ctx) if window in own})
            assert set.intersection(*groups)


def test_multikey_quicksort_keeps_what_agrees():
    from veilgraph.llm.suffix_dedup import _multikey

    rng = np.random.default_rng(3)
    raw = rng.integers(0, 3, 3000, dtype=np.uint8).tobytes()
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)).astype(np.uint64)
    starts = rng.integers(0, 2900, 4000)
    bucket = np.sort(rng.integers(0, 5, 4000))
    left, group = _multikey(words, starts, np.arange(4000), bucket, [0, 8])
    key = lambda i: (bucket[i], raw[starts[i] : starts[i] + 16])
    count = Counter(map(key, range(4000)))
    assert sorted(left.tolist()) == [i for i in range(4000) if count[key(i)] > 1]
    assert len({(int(g), key(i)) for i, g in zip(left, group, strict=True)}) == len(set(group.tolist())) == sum(n > 1 for n in count.values())
