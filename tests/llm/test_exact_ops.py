"""Packing, decontamination, chats and URL rules against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.llm.binary_packing import binary_lengths, pack
from veilgraph.llm.chat_snapshots import collapse
from veilgraph.llm.decontaminate import decontaminate
from veilgraph.llm.queries import URL_RULES, tokenizer_path
from veilgraph.llm.url_trust import host_edges, judge, propagate
from veilgraph.store import Scratch


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "éa", "x1", "\n\n", "  ", "don't", "<|endoftext|>", "日本", "🙂"]) for _ in range(rng.randint(0, 900))) for _ in range(40)]
    rows = [(i, t, "clash", 5) for i, t in enumerate([*texts, "", None, "word " * 9000, " " * 5000])]
    rows += [rows[0], (None, "null id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, start int").repartition(3)
    exact = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = pack(df, tokenizer_path(), with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    docs, at = [], []
    for r in sorted(got, key=lambda r: r.sequence_id):
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.bucket == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        if r.start == 0:
            docs.append((r.doc_id, r.doc_tokens))
            at.append([])
        assert sum(map(len, at[-1])) == r.start
        at[-1].append(r.ids)
    assert Counter((d, n, zlib.crc32(np.array(sum(ids, []), "<u4").tobytes())) for (d, n), ids in zip(docs, at, strict=True)) == want
    assert pack(df.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 10_000])
def test_binary_lengths(n):
    got = binary_lengths(n, 2048)
    assert sum(got) == n and all(x & (x - 1) == 0 for x in got) and got == sorted(got, reverse=True)


def words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_matches_all_windows(spark, seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("aé b cc Dd e1".split()) for _ in range(n))
    items = [(i, some(rng.choice([3, 9, 10, 14, 40]))) for i in range(8)] + [(100, "Uncommon"), (101, ""), (102, None), (103, "..."), (7, some(12)), (None, "zz yy"), (104, "zz yy")]
    docs = [some(rng.randint(0, 120)) for _ in range(40)] + [f"{some(5)}, {t}! {some(5)}" for _, t in items] + ["", None, "x. uncommon; zz-yy", "word " * 20_000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(docs)]
    rows += [rows[0], (None, docs[1], "", 0)]
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i) if i is not None else "")
    want = Counter()
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[i, len(w), len(hit), ",".join(sorted(found)), " ".join(x.decode() for k, x in enumerate(w) if k not in hit)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, items string, id int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["id"], r.n_words, r.n_hit, ",".join(r["items"]), " ".join(x.decode() for x in words(r.clean))) for r in decontaminate(df, bench, carry=["items", "id"]).collect())
    assert got == want
    assert decontaminate(df.limit(0), bench).count() == 0
    assert decontaminate(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    again = Counter((r["id"], r.n_words, r.n_hit, ",".join(r["items"]), " ".join(x.decode() for x in words(r.clean))) for r in decontaminate(df, bench, block_bytes=sum(len((t or "").encode()) for _, t in items) // 3).collect())
    assert again == want


def test_maximal_conversations(spark):
    rng = random.Random(3)
    chats = {}
    for i in range(60):
        if chats and rng.random() < 0.6:
            other = chats[rng.choice(list(chats))]
            turns = other[: rng.randint(1, len(other))] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "", None, "b"])) for _ in range(rng.choice([0, 0, 1, 2]))]
        else:
            turns = [(rng.choice(["user", None]), rng.choice("abcd")) for _ in range(rng.randint(1, 5))]
        chats[i] = turns
    rows = [(i, k, r, t) for i, turns in chats.items() for k, (r, t) in enumerate(turns)]
    key = {i: tuple(t) for i, t in chats.items()}
    want = {}
    for i, t in key.items():
        longer = any(len(u) > len(t) and u[: len(t)] == t for u in key.values())
        if not longer and i == min(j for j, u in key.items() if u == t):
            body = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t)
            want[i] = (len(t), sum(u == t for u in key.values()), body)
    shuffled = rows + rows[:5]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).repartition(3)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in collapse(df).collect()}
    assert got == want
    assert collapse(df.limit(0)).count() == 0


def test_a_null_conversation_is_one(spark):
    df = spark.createDataFrame([(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (4, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in collapse(df).collect()] == [(None, 2)]


def test_a_very_long_conversation_and_its_snapshot(spark):
    turn = lambda conv, n: spark.range(n).selectExpr(f"{conv}L as conv_id", "id as turn", "'user' as role", "concat('t', id) as text")
    got = collapse(turn(1, 20_000).union(turn(2, 19_999))).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies, r.rendered.count("<|im_end|>")) for r in got] == [(1, 20_000, 1, 20_000)]


URLS = [
    "http://A.Example.NET/en/x?y", "https://example.net/de/", "http://net/a", "http://net", "https://b.example.com/de/7#f", "http://example.com/de", "https://c.org/fr/", "x://org/fr/1", "http://xorg/fr/", "no scheme", None, "http://", "://h/p", "http://ÄB.net?x", "a://b://c/d", "http://u.net#/x",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    rows = [(i, u, None, "clash") for i, u in enumerate(URLS * 2)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    assert got[3].verdict == "block"  # most pages of that host are blocked by rule
    assert judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_ranks_match_power_iteration(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.org" for i in range(12)]
    pages = [(i, f"http://{rng.choice(hosts)}/p", "".join(f'<a HREF="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/x">' for _ in range(rng.randint(0, 4))) + '<a href="/local">') for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = Counter()
    for _, u, h in pages:
        src = u.split("/")[2]
        for t in re.findall(r'HREF="[a-z:]*//([^/"]*)', h):
            if t != src:
                edges[src, t] += 1
    found = host_edges(df)
    assert {(r.src, r.dst): r.weight for r in found.collect()} == dict(edges)
    seeds = spark.createDataFrame([(h, 0.5 * (i < 2), 1.0 * (i == 5)) for i, h in enumerate(hosts)], "host string, trust0 double, distrust0 double")
    got = {r.host: (r.trust, r.distrust) for r in propagate(seeds, found, Scratch(spark), tolerance=1e-5).collect()}
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((12, 12))
    for (a, b), w in edges.items():
        m[at[a], at[b]] = w
    for side, (start, links) in enumerate(((np.array([0.5, 0.5] + [0] * 10), m), (np.eye(12)[5], m.T))):
        share = links / np.maximum(links.sum(1, keepdims=True), 1)
        x = start
        for _ in range(400):
            moved = x @ share
            x = 0.85 * moved + (1 - 0.85 * moved.sum()) * start
        assert np.allclose([got[h][side] for h in hosts], x, atol=1e-4)




def chain(n):
    """Pages of hosts that each link to the next; the first is trusted, the last blocked by rule."""
    hosts = ["seed.example.net"] + [f"h{i:02d}.io" for i in range(n)] + ["bad.net"]
    pages = [(i, f"http://{h}/en/p", f'<a href="http://{to}/">') for i, (h, to) in enumerate(zip(hosts, hosts[1:], strict=False))]
    return hosts, [*pages, (len(hosts), "http://bad.net/x", None)]


def test_ranks_reach_the_end_of_a_long_chain(spark):
    hosts, pages = chain(42)
    got = {r.host: (r.trust, r.distrust) for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES, tolerance=1e-4).select("host", "trust", "distrust").collect()}
    # along a chain with one way on, each host has 0.85 times the rank of the one before, and all sum to 1
    share = 0.15 / (1 - 0.85 ** len(hosts))
    for k, h in enumerate(hosts):
        assert abs(got[h][0] - share * 0.85**k) < 1e-3 and abs(got[h][1] - share * 0.85 ** (len(hosts) - 1 - k)) < 1e-3 and min(got[h]) > 0
    import pytest

    with pytest.raises(RuntimeError):
        judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES, steps=3)


def test_verdicts_of_links(spark):
    """Hosts without a rule are judged by where they link to and who links to them; repeated pages count as often as they come."""
    pages = [
        (1, "http://bad.net/", '<a href="//farm.io/">'), (2, "http://farm.io/a", '<a href="http://bad.net/x"> <a href="http://bad.net/y">'), (3, "http://good.example.net/en/", '<a href="https://friend.io/">'),
        (4, "http://friend.io/", '<a href="http://other.io/">'), (5, "http://lone.io/", None), (2, "http://farm.io/a", '<a href="http://bad.net/x"> <a href="http://bad.net/y">'),
    ]
    got = {(r.page_id, r.host): (r.rule, r.verdict) for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES, margin=0.3, tolerance=1e-3).collect()}
    assert got == {(1, "bad.net"): ("net/", "block"), (2, "farm.io"): (None, "block"), (3, "good.example.net"): ("example.net/en/", "allow"), (4, "friend.io"): (None, "allow"), (5, "lone.io"): (None, "allow")}


def test_items_in_blocks_give_the_same(spark):
    from veilgraph.llm.decontaminate import decontaminate

    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", text(rng.randint(1, 25))) for k in range(40)] + [(None, text(12)), ("x", None), ("i1", text(14)), ("dots", "...")]
    docs = [(k, text(rng.randint(0, 60)), "c") for k in range(60)]
    docs += [(100 + k, f"{text(9)}, {items[k][1]}! {text(5)}", "c") for k in range(20)] + [(200, None, "c"), (200, "", None), docs[3]]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, n_hit string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(map(str, decontaminate(df, bench, carry=["n_hit"], block_bytes=size).collect())) for size in (1 << 20, 200))
    assert one == many and any("Row(start=" in r for r in one)
