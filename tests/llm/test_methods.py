"""How the corpus operators get their results: forests, walks, suffix arrays, state machines, held against brute force."""

from __future__ import annotations

import itertools
import math
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewatch.llm import decontaminate, html, media, neardup, queries
from framewatch.llm.common import texts

from .test_llm import SPLIT, docs, prose

SF = "/root/testdata/sf0.001"


# --- 2 ----------------------------------------------------------------------------


def test_the_state_machine_judges_every_conversation(spark, tmp_path):
    legal = {"U A": True, "S U A": True, "U A U A": True, "S U A U": False, "A U": False, "U U A": False, "S S U A": False, "T U A": False, "U A A": False}
    name = {"S": "system", "U": "user", "A": "assistant", "T": "tool"}
    rows = [(i, turn, name[r], "x") for i, roles in enumerate(legal) for turn, r in enumerate(roles.split())]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op2(spark, str(tmp_path))
    assert {r.conv_id: r.valid for r in got.collect()} == dict(enumerate(legal.values())) | {-7: True}
    assert "bad" in got._jdf.queryExecution().optimizedPlan().toString()  # the machine's sink is part of the plan


# --- 4 ----------------------------------------------------------------------------


def test_shared_runs_are_those_of_brute_force():
    rng = random.Random(3)
    pages = [[" ".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(3)] for _ in range(9)]
    want = defaultdict(set)
    for i, page in enumerate(pages):
        tokens = " ".join(page).split()
        for k in range(len(tokens) - 3):
            want[tuple(tokens[k : k + 4])].add(i)
    runs, times = html.shared_runs(pages, 4)
    assert len(set(runs.tolist())) == len(runs) and sorted(times.tolist()) == sorted(len(v) for v in want.values())


def test_items_in_doubt_inside_an_article_go_by_the_host(spark):
    rng = random.Random(5)
    share = "share this story with all your friends today"
    quote = prose(rng, 12)
    rows = []
    for i in range(4):
        body = f"<h1>{prose(rng, 4)}</h1><p>{prose(rng, 40)}</p><p>{quote}</p><ul><li>{share}</li><li>{prose(rng, 8)}</li></ul>"
        rows.append((i, f"http://h.example/{i}", f"<body><nav>menu</nav><article>{body}</article></body>"))
    rows.append((9, "http://other.example/9", rows[0][2]))  # alone on its host
    rows += [(20 + i, "http://list.example/", f"<article><h1>t{i}</h1><ul><li>{share}</li><li>{share} again</li></ul></article>") for i in range(3)]
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert share not in got[i] and quote in got[i] and len(got[i]) == 4  # the quoted paragraph and the item of its own stay
    assert share in got[9] and len(got[9]) == 5
    assert all(len(got[20 + i]) == 3 for i in range(3))  # an article is never halved


def test_pages_repeated_long_and_with_clashing_columns(spark):
    page = "<body><div>one menu of the whole site here</div><p>" + "long text " * 60_000 + "</p></body>"
    rows = [(1, "http://h/", page, "x"), (1, "http://h/", page, "y"), (None, None, "<p>a", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string").withColumn("text", F.lit("t")).withColumn("_same", F.lit(1))
    got = sorted((r.page_id or 0, r.n_chars) for r in html.extract(df).collect())
    assert got[0] == (0, 1) and got[1] == got[2] and got[1][1] > 500_000


# --- 6 ----------------------------------------------------------------------------


def test_labels_meet_as_often_as_they_should():
    rng = np.random.default_rng(4)
    for similarity in (0.8, 0.9):
        met = np.zeros(neardup.DEPTH + 1)
        for _ in range(60):
            n = 90
            common = round(2 * n * similarity / (1 + similarity))
            base = rng.integers(1 << 62, size=2 * n - common, dtype=np.uint64)
            value = np.concatenate([np.sort(base[:n]), np.sort(base[n - common :])])
            one, two = neardup.labels(value, np.array([0, n, 2 * n]))
            for length in range(1, neardup.DEPTH + 1):
                shift = np.uint64(neardup.BITS * (neardup.DEPTH - length))
                met[length] += (one >> shift == two >> shift).any()
        for length in range(1, neardup.DEPTH + 1):
            assert met[length] / 60 >= neardup.meeting(similarity, length) - 0.06


def test_prefixes_are_shortened_until_the_recall_is_met(spark, monkeypatch):
    """With few trees whole labels miss links, the estimate says so, and shorter prefixes find them."""
    rng = random.Random(6)
    rows = []
    for _ in range(25):
        w = prose(rng, 85).split()
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[:-8], *prose(rng, 8).split()]))]
    lengths = []
    real = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda *a: lengths.append(a[4]) or real(*a))
    got = {r.doc_id: r.class_id for r in neardup.classes(docs(spark, rows), trees=4).collect()}
    assert len(lengths) > 1 and lengths == list(range(neardup.DEPTH, lengths[-1] - 1, -1))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    linked = [i for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(linked) > 10 and sum(got[i + 1] == i for i in linked) >= 0.9 * len(linked)


def test_nodes_are_joined_across_batches_and_partitions(spark):
    """Every order of cutting the sorted leaves gives the same components."""
    rng = random.Random(12)
    leaves = sorted((t, rng.choice([5, 5, 9, 77]) << 56 | rng.randrange(4), rng.randrange(10_000)) for t in (0, 1) for _ in range(60))
    want = defaultdict(set)
    for t, label, rep in leaves:
        want[t, label >> 56].add(rep)
    merged = []
    for group in want.values():
        touching = [m for m in merged if m & group]
        merged = [m for m in merged if not m & group] + [set().union(group, *touching)]
    for size in (1, 7, 1000):
        parts = [(*row, i // size) for i, row in enumerate(leaves)]
        forest = spark.createDataFrame(parts, "tree int, label long, rep long, part int").coalesce(1)
        links = neardup.candidate_links(forest, 1).collect()
        root = {x: min(m) for m in merged for x in m}
        assert all(root[r.a] == root[r.b] for r in links)
        seen = {}
        for r in links:
            a, b = (min(seen.get(x, x) for x in (r.a,)), min(seen.get(x, x) for x in (r.b,)))
            low = min(a, b)
            seen |= {r.a: low, r.b: low} | {k: low for k, v in seen.items() if v in (a, b)}
        assert all(len({seen.get(x, x) for x in m}) == 1 for m in merged)


@pytest.mark.parametrize("items", [0, 1 << 23])
def test_near_duplicates_with_and_without_the_filter(spark, monkeypatch, items):
    monkeypatch.setattr(neardup.Marks, "ITEMS", items)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = [(i, " ".join([*base[: 120 - 2 * i], f"end{i}"])) for i in range(12)] + [(None, " ".join(base)), (50, None), (51, "x" * 200_000)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows[:12] for w in [t.split()]}
    links = {i: sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets}
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(docs(spark, rows)).collect()}
    assert {i: got[i][1] for i in sets} == links and {got[i][0] for i in sets} == {0}
    assert got[None] == (None, 0) and got[50] == (50, 0) and got[51] == (51, 0)


# --- 8 ----------------------------------------------------------------------------


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        w[at : at + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(10**9)}"]
    return w


def test_agreement_of_repetitions_is_a_lower_line():
    """The share of repetitions that agree for random edits is above the line that their number is taken from, in nine of ten pairs."""
    rng = random.Random(17)
    for n in (5, 15, 30, 59):
        k = int(n * decontaminate.EDITS)
        met = []
        for _ in range(60):
            item = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            text = edited(rng, item, k) + [f"x{rng.randrange(10**9)}" for _ in range(2 * n)]
            both = decontaminate.words(texts(pa.array([" ".join(item), " ".join(text)]))).hashes
            reps = 256
            places = np.stack([decontaminate.sampled(n, r) for r in range(reps)])
            keys = decontaminate.walked_keys(both, np.array([0, n]), np.array([n, len(both)]), places)
            met.append((keys[:, 0] == keys[:, 1]).mean())
        assert np.quantile(met, 0.1) >= decontaminate.agreement(k) * 0.8 and np.mean(met) >= decontaminate.agreement(k)


def test_very_long_items(spark):
    """Thousands of words and repetitions: keys are as those of one walk at a time, and memory stays within a few arrays of walks."""
    rng = random.Random(23)
    symbols = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
    places = np.stack([decontaminate.sampled(30, r) for r in range(3000)])
    keys = decontaminate.walked_keys(symbols, np.array([0, 25]), np.array([30, 60]), places)
    assert keys.shape == (3000, 2) and len(np.unique(keys)) == 6000
    for r in (0, 1, 2999):
        assert (decontaminate.walked_keys(symbols, np.array([25]), np.array([60]), places[: r + 1])[r] == keys[r, 1]).all()
    item = [f"w{i}" for i in range(1600)]
    text = edited(rng, item, 250)
    docs = spark.createDataFrame([(1, " ".join(["x"] * 50 + text + ["y"] * 1000)), (2, " ".join(f"v{i}" for i in range(3000)))], "doc_id long, text string")
    tracemalloc.start()
    held = decontaminate.Items.of(pa.array([7]), texts(pa.array([" ".join(item)])))
    got = decontaminate.find(held, texts(pa.array([r.text for r in docs.collect()])))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert [(r[0], r[1]) for r in got] == [(0, 0)] and got[0][2] <= 250


def test_windows_skipped_hold_no_match():
    rng = random.Random(18)
    items = [prose(rng, n) for n in (6, 12, 20, 45) for _ in range(5)]
    held = decontaminate.Items.of(pa.array(range(len(items))), texts(pa.array(items)))
    for item in items:
        w = item.split()
        text = f"{prose(rng, 40)} {' '.join(edited(rng, w, int(len(w) * 0.2)))} {prose(rng, 40)}"
        found = decontaminate.words(texts(pa.array([text])), lower=True)
        symbols = decontaminate.words(texts(pa.array([item])), lower=True).hashes
        edits, end = decontaminate.best_match(symbols, found.hashes)
        if edits > len(w) * 0.2:
            continue
        start = end - decontaminate.best_match(symbols[::-1], found.hashes[:end][::-1])[1]
        length = next(x for x in held.lengths if x.size == len(w))
        (values, bitmap, cuts, which), of = held.grams[length.gram], held.lengths.index(length)
        own = decontaminate.grams(found.hashes, length.gram)
        at = decontaminate._known(own, values, bitmap)
        at = np.array([a for a in at if of in which[cuts[g := np.searchsorted(values, own[a])] : cuts[g + 1]]], int)
        assert start in decontaminate.windows(length, at, np.zeros(len(found.hashes), int), np.array([0]))


def test_null_and_repeated_items_and_clashing_columns(spark):
    rng = random.Random(19)
    one, two, three = (prose(rng, 20) for _ in range(3))
    items = spark.createDataFrame([(None, one), (5, two), (5, three), (5, two), (6, None)], "item_id long, text string").withColumn("edits", F.lit("e"))
    rows = [(1, f"a b {one} c"), (1, f"a b {one} c"), (2, f"{two} {three}"), (None, three), (3, prose(rng, 50_000) + " " + two)]
    df = docs(spark, rows).withColumn("item_id", F.lit("clash"))
    got = sorted((str(r.doc_id), str(r.item_id), r.edits, r.first_word) for r in decontaminate.contaminated(df, items).collect())
    assert got == [("1", "None", 0, 2), ("1", "None", 0, 2), ("2", "5", 0, 0), ("3", "5", 0, 50_000), ("None", "5", 0, 0)]


def test_all_pairs_of_texts_and_items_of_the_given_tables(spark):
    """The least edit distance of every item to every text, by brute force, says what is found."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for (d, t), (i, x) in itertools.product(rows, items):
        a, b = (decontaminate.words(texts(pa.array([s])), lower=True).hashes for s in (t, x))
        if len(a) and np.isin(b, a).mean() >= 0.8:  # each edit loses one word of the item at most
            edits = decontaminate.best_match(b, a)[0]
            if edits <= len(SPLIT.findall(x)) * decontaminate.EDITS + 1e-9:
                want[d, i] = edits
    assert got == want and want


PROSE = "It rained on the coast for nine days and then the wind turned"


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<article class="post has-sidebar"><p>{PROSE}</p></article>', PROSE),
        (f'<article class="news search-indexed"><p>{PROSE}</p></article>', PROSE),
        (f'<article class="widget"><p>{PROSE}</p></article>', PROSE),
        (f'<div class="with-sidebar"><article><p>{PROSE}</p></article></div>', PROSE),
        (f'<div class="with-sidebar"><p>{PROSE}</p></div>', PROSE),
        (f'<body class="no-js"><div class="widget-area"><article><p>{PROSE}</p></article></div></body>', PROSE),
        (f'<article><p>{PROSE}</p><p class="share-price">Shares rose to 12 crowns in two days</p></article>', PROSE + "\nShares rose to 12 crowns in two days"),
        (f'<article><p>{PROSE}</p><div class="social-share">Share this</div><div class="ad">Buy now</div><p>End</p></article>', PROSE + "\nEnd"),
        (f'<article><p>{PROSE}</p><div class="siteFooter">Contact us</div></article>', PROSE),
        (f'<article><p>{PROSE}</p></article><div class="post-comments"><article><p>First!</p></article></div>', PROSE),
    ],
)
def test_names_of_elements(page, want):
    """What a class says for sure goes; what it may say is left to the host (here one page: it stays)."""
    found = html.parsed(page)
    text = found.text if found.text is not None else "\n".join(b for b, gone in zip(found.blocks, found.dropped) if not gone)
    assert text == want


def test_pages_that_structure_settles_go_through_the_array():
    """The array judges the menus of such pages and structure has the last word; with its verdict alone a menu of one page would stay."""
    pages = [html.parsed(f"<nav>{menu}</nav><article><h1>T</h1><p>{PROSE}</p></article>") for menu in ["Home News Sport Weather Travel Contact"] * 3 + ["a menu of this one page alone"]]
    assert all(len(p.blocks) == 3 and p.sure == [False, True, True] and p.prose == 1 + len(PROSE.split()) for p in pages)
    streams = [[html.PROSE if s else b for b, s in zip(p.blocks, p.sure)] for p in pages]
    runs, times = html.shared_runs([[b for b, s in zip(p.blocks, p.sure) if not s] for p in pages])
    shares = html.covered(streams, runs[times >= html.PAGES], times[times >= html.PAGES])
    assert [share.tolist() for _, share, _ in shares] == [[1, 0, 0]] * 3 + [[0, 0, 0]]
    assert all(html.left(p.dropped, p.sure, *s).tolist() == [False, True, True] for p, s in zip(pages, shares))
    assert html.left([False] * 3, pages[3].sure, *shares[3]).tolist() == [True] * 3


def test_a_name_in_doubt_is_decided_by_the_host(spark):
    """Blocks of an element that may be clutter go where three pages of the host share them, and stay where they are a page's own."""
    rng = random.Random(31)
    rows = []
    for i in range(4):
        own = " ".join(f"p{rng.randrange(10**6)}" for _ in range(12))
        rows.append((i, f"https://a.example/{i}", f'<article><p>{PROSE} {i} {own}</p><p class="share-buttons">Send this page to all of your friends and family today</p><p class="share-price">own {own} value</p></article>'))
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for lines in got.values():
        assert len(lines) == 2 and lines[0].startswith(PROSE) and lines[1].startswith("own ")


@pytest.mark.parametrize("height,width", [(24, 24), (7, 24), (131, 24), (32, 32), (50, 3)])
def test_cosine_hash_is_that_of_plain_loops(height, width):
    """Area means by overlaps of each sample with each of 32 x 32 cells, then cosine sums, all by loops."""
    samples = np.random.default_rng(height * 100 + width).integers(0, 256, (height, width)).astype(np.uint8)

    def overlaps(n):  # cell -> [(sample, share of the sample in the cell)]
        return [[(i, share) for i in range(n) if (share := min(i + 1, (c + 1) * n / 32) - max(i, c * n / 32)) > 0] for c in range(32)]

    ys, xs = overlaps(height), overlaps(width)
    small = [[sum(a * b * float(samples[i, j]) for i, a in ys[y] for j, b in xs[x]) / (height * width / 1024) for x in range(32)] for y in range(32)]
    wave = [[math.cos(math.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    want = int("".join("1" if v > middle else "0" for v in low), 2)
    assert media.cosine_hash(samples) == f"{want:016x}"
