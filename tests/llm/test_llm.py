"""The corpus operators against brute force, round trips and held-out accuracy, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewatch.llm import chat, components, decontaminate, fmindex, html, langid, lm, media, mixing, neardup, queries, substring_dedup, toxicity
from framewatch.llm.common import texts
from framewatch.llm.words import words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOCS_COLUMNS = [c.split()[0] for c in DOCS.split(", ")]
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], schema)


def prose(rng, n, kind="abcdefgh"):
    return " ".join("".join(rng.choices(kind, k=rng.randint(2, 6))) for _ in range(n))


ODD = [None, "", " \t\n", "a", "é ü x", "word " * 40, "x" * 3000, "same text here for you and me", "same text here for you and me"]


# --- words, FM-index --------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    column = ["a b", "", "b", "  c d\té ", "a" * 5000 + " a"]
    w = words(texts(pa.array(column)))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in itertools.pairwise(w.offsets)]
    assert got == [SPLIT.findall(t) for t in column]
    by = {}
    for text, h in zip(itertools.chain(*got), w.hashes.tolist()):
        assert by.setdefault(text, h) == h
    assert len(set(by.values())) == len(by)


def test_fm_index_counts_and_matching_statistics():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 5, 9), 0) for _ in range(60)])
    index = fmindex.FMIndex(text, 5, 6)
    ends = np.arange(1, len(text) + 1)
    length, low, high = index.statistics(text, ends, 6)
    flat = text.tolist()
    for e in range(1, len(flat) + 1):
        n = 0
        while n < 6 and e - n > 0 and flat[e - 1 - n] != 0:
            n += 1
        assert length[e - 1] == n  # all of it is in the index
        if n:
            pattern = flat[e - n : e]
            assert high[e - 1] - low[e - 1] == sum(flat[i : i + n] == pattern for i in range(len(flat) - n + 1))


# --- 3: substring dedup -----------------------------------------------------------


def removed(rows, window):
    first = {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substring_dedup_is_brute_force(spark):
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (13, 20, 60)]
    rows = [(i, " ".join(rng.sample([prose(rng, rng.randint(0, 30), "ab"), rng.choice(shared), prose(rng, 12), rng.choice(shared)], 4))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, rows[3][1]), (201, rows[3][1])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(docs(spark, rows)).collect()}
    assert got == removed(rows, 13)


def test_substring_dedup_without_the_filter_gives_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 50)
    rows = [(i, f"{prose(rng, 5)} {base} {prose(rng, 5)}") for i in range(8)]
    monkeypatch.setattr(substring_dedup.Marks, "ITEMS", 0)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(docs(spark, rows)).collect()}
    assert got == removed(rows, 13)


def test_small_shards_and_null_ids(spark, monkeypatch):
    base = prose(random.Random(6), 40)
    df = spark.createDataFrame([(None, base), (5, base), (3, base), (3, base)], "doc_id long, text string")
    rows = substring_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or -1, r.text == base, r.text == "") for r in rows) == [(-1, True, False), (3, True, False), (3, True, False), (5, False, True)]


# --- 6: near duplicates -----------------------------------------------------------


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for g in range(6):
        base = prose(rng, 80).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := SPLIT.findall(t or "")) else frozenset() for i, t in rows}
    links, root = Counter(), {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and n >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(docs(spark, rows)).collect()}
    assert got == {i: (root[i], links[i]) for i in sets}


def test_blocks_of_a_large_class_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(30)]
    got = neardup.classes(docs(spark, rows))
    assert {(r.class_id, r.n_links) for r in got.collect()} == {(0, 29)}
    left = [np.array([1, 2, 3, 9], np.uint64)]
    right = [np.array([2, 3, 4], np.uint64), np.array([7], np.uint64)]
    assert neardup.common(left, right).tolist() == [[2.0, 0.0]]


def test_pairs_at_exactly_the_threshold_are_linked(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for shared, a, b, linked in ((12, 13, 14, 1), (32, 36, 36, 1), (64, 72, 72, 1), (12, 14, 14, 0), (64, 72, 73, 0)):
        base = [f"w{rng.randrange(10**9)}" for _ in range(shared + 4)]
        i = len(rows)
        rows += [(i + k, " ".join([*base, *(f"v{rng.randrange(10**9)}" for _ in range(n - shared))])) for k, n in enumerate((a, b))]
        want |= {i: (i, linked), i + 1: (i if linked else i + 1, linked)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(docs(spark, rows)).collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (20, 4), (5, 5)], "a long, b long")
    assert {(r.id, r.root) for r in components.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (20, 1), (8, 8), (9, 8)}
    assert components.components(edges.limit(0)).count() == 0


# --- 8: decontamination -----------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((5, 12, 20, 35, 60))] + [(90, None), (91, "")]
    rows, want = [], set()
    for i in range(80):
        k, text = rng.choice(items[:5])
        w = text.split()
        for _ in range(rng.randint(0, int(len(w) * 0.2))):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [prose(rng, 1)] * rng.randint(0, 1)
        if distance(text.lower().split(), w) <= len(text.split()) * 0.2:
            want.add((i, k))
        rows.append((i, f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}"))
    rows += [(1000 + i, prose(rng, 200)) for i in range(20)] + [(2000 + i, t) for i, t in enumerate(ODD)]
    out = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert len(want - got) <= 0.02 * len(want) and all(d < 1000 for d, _ in got)
    by = dict(rows)
    for r in out:  # what is reported is exact
        span = SPLIT.findall(by[r.doc_id].lower())[r.first_word : r.past_word]
        assert distance(dict(items)[r.item_id].lower().split(), span) == r.edits


def test_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", 50)
    rng = random.Random(10)
    items = [(i, prose(rng, 12)) for i in range(6)]
    rows = [(i, f"{prose(rng, 9)} {t}") for i, t in items]
    out = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.edits) for r in out.collect()} == {(i, i, 0) for i in range(6)}


# --- 2: chat ----------------------------------------------------------------------


def test_chat_round_trip_and_validity(spark):
    evil = ["\\", "\\\\", "[INST]", "[\\INST]", "<s>\\</s>", "<<SYS>>x<</SYS>>", "", None, "a\\[INST]\\\\", "<<TURN>>tool<<IS>>", "é\n</s>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(itertools.cycle(["user", "assistant"]), evil))]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "tool<<IS>>", "x"), (3, 1, None, "y"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (5, None, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    for c in (1, 2, 3, 4, 5):
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == c]
        assert [(t.role, t.text) for t in got[c].back] == own
        assert list(got[c].loss) == [t for r, t in own if r == "assistant"]
    assert [got[c].valid for c in (1, 2, 3, 4, 5)] == [False, True, False, False, False]
    assert chat.format_turns(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("<a>", "<a>b")}).controls()


# --- 9: media ---------------------------------------------------------------------


def test_png_round_trip_all_filters_and_damage():
    rng = np.random.default_rng(3)
    for shape in ((1, 24), (24, 24), (70, 24), (5, 1)):
        samples = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode(samples)) == samples).all()
    rows = rng.integers(0, 256, (10, 7), dtype=np.uint8)
    kinds = np.array([0, 3, 4, 4, 1, 2, 2, 3, 0, 4], np.uint8)
    out = media.unfilter(kinds, rows).astype(int)
    for y in range(10):
        for x in range(7):
            a, b = out[y, x - 1] if x else 0, out[y - 1, x] if y else 0
            c = out[y - 1, x - 1] if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            assert out[y, x] == (int(rows[y, x]) + [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
    png = media.encode(np.zeros((24, 24), np.uint8))
    for bad in (png[:40] + b"\x01" + png[41:], png[:-13], b"x" + png[1:]):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_columns(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in media.features(media.store(docs(spark, rows).select("doc_id", "text", F.lit(1).alias("media")))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].feature == got[8].feature


# --- 1, 5, 7, 10: learned -----------------------------------------------------------


def test_forward_sums_all_segmentations(monkeypatch):
    """Against every piece at every place of whole words, long ones, unspaced and uncuttable ones included."""
    v = langid.Vocabulary(langid.VOCABULARY)
    ids = {p: i for i, p in enumerate(langid.pieces(langid.VOCABULARY))}
    chinese = "".join(chr(0x4E00 + i * 37 % 9000) for i in range(150))
    w = words(texts(pa.array(["the naïve " + "z" * 700 + f" a {chinese} " + "ab" * 300, "internationalization" * 9, "=" * 64])), lower=True)
    p = np.append(np.random.default_rng(1).random(v.size), 0.0)[:, None] * [1e-2, 1e-4]
    lattice = langid.Lattice(v, w.data, w.starts, w.ends)
    assert len(lattice.length) > len(w.hashes)  # the unspaced word is cut
    got = lattice.totals(p)
    monkeypatch.setattr(langid, "CELLS", 40)
    assert np.allclose(got, langid.Lattice(v, w.data, w.starts, w.ends).totals(p))
    longest = max(map(len, ids))
    for i, (s, e) in enumerate(zip(w.starts, w.ends)):
        raw = b" " + bytes(w.data[s:e])
        for lang in range(2):
            a = [0.0] + [-math.inf] * len(raw)  # logarithms, so that nothing underflows
            for end in range(1, len(raw) + 1):
                terms = [a[end - n] + math.log(p[j, lang]) for n in range(1, min(longest, end) + 1) if (j := ids.get(raw[end - n : end])) is not None]
                top = max(terms)
                a[end] = top + math.log(sum(math.exp(t - top) for t in terms))
            assert got[i, lang] == pytest.approx(a[-1], abs=1e-6)


def test_expected_counts_are_those_of_all_segmentations():
    v = langid.Vocabulary(langid.VOCABULARY)
    ids = {p: i for i, p in enumerate(langid.pieces(langid.VOCABULARY))}
    w = words(texts(pa.array(["there banana"])), lower=True)
    p = np.append(np.random.default_rng(3).random(v.size), 0.0)[:, None] * 1e-2
    got = langid.Lattice(v, w.data, w.starts, w.ends).expected(p, np.array([2.0, 1.0]))
    want = Counter()
    for raw, weight in ((b" there", 2), (b" banana", 1)):
        ways = [[i for i in range(1, len(raw)) if bits >> i & 1] for bits in range(0, 1 << len(raw), 2)]
        cut = [[raw[a:b] for a, b in itertools.pairwise([0, *way, len(raw)])] for way in ways]
        cut = [(c, math.prod(p[ids[x], 0] for x in c)) for c in cut if all(x in ids for x in c)]
        total = sum(q for _, q in cut)
        for c, q in cut:
            for x in c:
                want[ids[x]] += weight * q / total
    assert {i: got[i] for i in np.flatnonzero(got > 1e-9)} == pytest.approx({i: n for i, n in want.items() if n > 1e-9})


def test_expected_counts_with_words_of_any_length():
    """Against sums in logarithms, for words of 3 to 900 bytes in one group; a long word takes nothing from others."""
    v = langid.Vocabulary(langid.VOCABULARY)
    ids = {p: i for i, p in enumerate(langid.pieces(langid.VOCABULARY))}
    column = texts(pa.array(["=" * 700 + " the zebra " + "ab" * 450 + " " + "z" * 129]))
    w = words(column, lower=True)
    p = np.append(np.random.default_rng(4).random(v.size), 0.0)[:, None] * 1e-3
    weight = np.array([1.0, 2.0, 3.0, 1.0, 2.0])
    got = langid.Lattice(v, w.data, w.starts, w.ends).expected(p, weight)
    longest, want = max(map(len, ids)), Counter()
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs)) if xs else -math.inf
    for s, e, times in zip(w.starts, w.ends, weight):
        raw = b" " + bytes(w.data[s:e])
        size = len(raw)
        edges = [(i, i + n, ids[raw[i : i + n]]) for i in range(size) for n in range(1, min(longest, size - i) + 1) if raw[i : i + n] in ids]
        into, out = {}, {}
        for i, j, k in edges:
            into.setdefault(j, []).append((i, k))
            out.setdefault(i, []).append((j, k))
        a, b = [0.0] + [0.0] * size, [0.0] * size + [0.0]
        for j in range(1, size + 1):
            a[j] = add([a[i] + math.log(p[k, 0]) for i, k in into.get(j, [])])
        for i in range(size - 1, -1, -1):
            b[i] = add([b[j] + math.log(p[k, 0]) for j, k in out.get(i, [])])
        for i, j, k in edges:
            want[k] += times * math.exp(a[i] + math.log(p[k, 0]) + b[j] - a[size])
    some = {k: n for k, n in want.items() if n > 1e-6}
    assert {k: got[k] for k in some} == pytest.approx(some, rel=1e-6)
    assert got.sum() == pytest.approx(sum(want.values()), rel=1e-6)


def test_a_ruled_line_does_not_hide_a_language():
    """Piece probabilities of texts with one long ruled line stay near those without."""
    v = langid.Vocabulary(langid.VOCABULARY)
    plain = ["the river and the harbour were quiet that morning"] * 40
    p, q = langid.fit_pieces(texts(pa.array(plain)), v), langid.fit_pieces(texts(pa.array([*plain, "=" * 700])), v)
    common = np.argsort(-p)[:9]
    assert p[common].min() > 100 / v.size and np.abs(q[common] / p[common] - 1).max() < 0.25  # the line's own pieces are a fifth of all


def test_language_id_held_out(spark):
    got = queries.QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    odd = docs(spark, [(0, None), (1, "12 34 ² ½ Ⅷ _"), (2, "é"), (2, "é"), (3, "字" * 20_000)]).withColumn("score", F.lit("clash"))
    p = np.full((langid.Vocabulary(langid.VOCABULARY).size + 1, 2), 1e-4)
    p[-1] = 0
    out = langid.predict(odd, ["x", "y"], p)
    assert [(r.lang_pred, r.score) for r in out.orderBy("doc_id").collect()] == [("und", 0.0), ("und", 0.0), ("x", 0.5), ("x", 0.5), ("x", 0.5)]
    assert langid.predict(odd.limit(0), ["x", "y"], p).count() == 0
    # the posterior is that of the words' probabilities
    langs, p = langid.fit(docs(spark, [(i, prose(random.Random(i), 50, "abc" if i % 2 else "xyz")) for i in range(20)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "l1").otherwise("l2")))
    w = words(texts(pa.array(["abba xy"])), lower=True)
    log = langid.Lattice(langid.Vocabulary(langid.VOCABULARY), w.data, w.starts, w.ends).totals(p).sum(axis=0)
    r = langid.predict(docs(spark, [(0, "Abba xy")]), langs, p).first()
    assert langs == ["l1", "l2"] and r.lang_pred == langs[log.argmax()] and r.score == pytest.approx(1 / (1 + math.exp(-abs(log[0] - log[1]))), abs=1e-4)
    assert langid.fit(docs(spark, [(0, "a")]))[0] == []
    assert [r.lang_pred for r in langid.predict(docs(spark, [(0, "a")]), [], np.zeros((0, 0))).collect()] == ["und"]


def test_toxicity_folds_and_excepts(spark):
    assert toxicity.fold("C1OWN") == toxicity.fold("clown") == toxicity.fold("с​l0wn") == toxicity.fold("ｃｌｏｗｎ")
    rng = random.Random(11)
    rows = [(prose(rng, 40) + " clown fish swim", 0) for _ in range(3)] + [(f"{prose(rng, 30)} you clown {prose(rng, 3)}", 1) for _ in range(40)] + [(prose(rng, 40), 0) for _ in range(60)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert any(e.startswith(" cio") for e in lexicon.entries) and "ciown fish" in lexicon.exceptions
    texts_ = [None, "", "you c1own", "a clown fish swims", "x" * 5000]
    got = [r.score for r in toxicity.score(docs(spark, list(enumerate(texts_))), lexicon).orderBy("doc_id").collect()]
    assert got[2] > 0.7 > max(got[0], got[1], got[3], got[4]) and all(0 <= s <= 1 for s in got)
    empty = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert toxicity.score(docs(spark, [(0, "a")]).withColumn("score", F.lit("clash")), empty).first().score < 0.7


def test_gradients_of_the_network():
    """Backpropagation against differences of the loss, for every kind of weight."""
    rng = np.random.default_rng(4)
    cls, slot, offsets = rng.integers(0, lm._CLASSES, 40), rng.integers(0, lm.IN_CLASS, 40), np.array([0, 17, 40])
    w = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in lm.initial().items()}
    inside = cls >= lm.SINGLE

    def loss(w):
        return -lm.log_probabilities(w, cls, slot, offsets).astype(float).mean()

    trainer = lm.Trainer(w)
    trainer.learn(cls, slot, offsets, lambda done: 0.0, window=64)  # the first moments hold a tenth of the gradient
    flat = np.concatenate([v.ravel() for v in trainer.m1.values()]) * 10
    scale = 1.0 if np.linalg.norm(flat) < 0.999 else None
    assert scale, "the gradient was cut"
    for k, v in w.items():
        places = np.argsort(-np.abs(trainer.m1[k]).ravel())[:4]
        for at in places:
            up, down = ({**w, k: v.copy()} for _ in range(2))
            up[k].ravel()[at] += 0.02
            down[k].ravel()[at] -= 0.02
            assert (loss(up) - loss(down)) / 0.04 == pytest.approx(trainer.m1[k].ravel()[at] * 10, rel=0.05, abs=5e-4), k
    assert inside.any()


def test_network_is_that_of_plain_loops(monkeypatch):
    """Log probabilities against one token after the other in double precision; several texts share a lane, in windows of which the last is short."""
    rng = np.random.default_rng(6)
    cls, slot, offsets = rng.integers(0, lm._CLASSES, 90), rng.integers(0, lm.IN_CLASS, 90), np.array([0, 0, 1, 30, 37, 80, 90])
    w = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in lm.initial().items()}
    d = {k: v.astype(float) for k, v in w.items()}
    want = []
    for low, high in zip(offsets, offsets[1:]):
        h, came = np.zeros(lm.HIDDEN), lm._CLASSES
        for c, s in zip(cls[low:high], slot[low:high]):
            g, gates = d["x"][came], h @ d["u"]
            r, z = (1 / (1 + np.exp(-g[i : i + lm.HIDDEN] - gates[i : i + lm.HIDDEN])) for i in (0, lm.HIDDEN))
            n = np.tanh(g[2 * lm.HIDDEN :] + r * (h @ d["un"] + d["bn"]))
            h, came = n + z * (h - n), c
            out = h @ d["v"] + d["c"]
            want.append(out[c] - np.log(np.exp(out).sum()))
            if c >= lm.SINGLE:
                own = h @ d["s"][c - lm.SINGLE] + d["d"][c - lm.SINGLE]
                want[-1] += own[s] - np.log(np.exp(own).sum())
    monkeypatch.setattr(lm, "WINDOW", 7)
    monkeypatch.setattr(lm, "LANES", 2)
    assert np.allclose(lm.log_probabilities(w, cls, slot, offsets), want, atol=1e-4)


def test_places_of_hashes_that_begin_alike():
    rng = np.random.default_rng(7)
    every = rng.integers(0, 1 << 20, 600, dtype=np.uint64) + (rng.integers(0, 40, 600, dtype=np.uint64) << np.uint64(48))
    known = np.unique(np.concatenate([every[:300], rng.integers(0, 1 << 63, 900, dtype=np.uint64)]))
    for some in (known, known[:1], every[:0]):
        if len(some):
            assert np.array_equal(some[lm._place(some, every)] == every, np.isin(every, some))
            assert np.array_equal(lm._place(some, some), np.arange(len(some)))


def test_the_network_learns_order_and_its_softmaxes_sum_to_one():
    other = lm.IN_CLASS - 1
    cls, slot, offsets = np.tile([3, 7, 50], 400), np.tile([other, other, 5], 400), np.array([0, 600, 1200])
    trained = lm.train(cls, slot, offsets, epochs=30)
    assert lm.log_probabilities(trained, cls, slot, offsets).mean() > -0.5
    every = [(c, s) for c in range(lm._CLASSES) for s in (range(lm.IN_CLASS) if c >= lm.SINGLE else [lm.IN_CLASS - 1])]
    one = [lm.log_probabilities(trained, np.array([3, 7, c]), np.array([other, other, s]), np.array([0, 3]))[2] for c, s in every[:: len(every) // 50]]
    last = np.array([[3, 7, c] for c, _ in every]).ravel(), np.array([[other, other, s] for _, s in every]).ravel(), np.arange(len(every) + 1) * 3
    p = np.exp(lm.log_probabilities(trained, *last)[2::3].astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-4) and np.allclose(np.log(p[:: len(every) // 50]), one, atol=1e-4)


def test_state_is_carried_across_windows(monkeypatch):
    rng = np.random.default_rng(5)
    cls, slot, offsets = rng.integers(0, lm._CLASSES, 300), rng.integers(0, lm.IN_CLASS, 300), np.array([0, 0, 1, 230, 300])
    w = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in lm.initial().items()}
    whole = lm.log_probabilities(w, cls, slot, offsets)
    monkeypatch.setattr(lm, "WINDOW", 7)
    monkeypatch.setattr(lm, "LANES", 2)
    assert np.allclose(whole, lm.log_probabilities(w, cls, slot, offsets), atol=1e-4)


@pytest.mark.parametrize("head", [1 << 19, 20])
def test_lm_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, prose(random.Random(i), 60, "abc")) for i in range(30)]
    df = docs(spark, rows).withColumn("held_out", F.col("doc_id") % 5 == 1)
    model, table = lm.fit(df.filter("not held_out"))
    got = {r.doc_id: r for r in lm.score(df, model, table).collect()}
    tok = {i: [*(m.lower() for m in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())), None] for i, t in rows}
    c = Counter(x for i in tok if i % 5 != 1 for x in tok[i])
    n, v = sum(c.values()), len(c)
    for i, t in tok.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert got[i].score < 0
    # The score is the network's, plus the share of each unlisted word in its class, whether the counts are carried or joined.
    for i, t in itertools.islice(rows, 12):
        h, e, offsets = lm.tokens_of(words(texts(pa.array([t], pa.string())), lower=True))
        cls, slot = model.classes(h, e)
        count = np.array([c[x] for x in tok[i]])
        assert got[i].score == pytest.approx(lm.log_probabilities(model.weights, cls, slot, offsets).sum() / math.log(10) + model.unlisted(cls, slot, count).sum(), rel=1e-4)
    twice = docs(spark, [rows[-1], rows[-1]]).withColumn("known", F.lit(1)).withColumn("_row", F.lit("r"))
    same = lm.score(twice, model, table, keys=("doc_id", "known", "_row")).collect()
    assert len(same) == 2 and {(r.known, r._row, round(r.score, 3)) for r in same} == {(1, "r", round(got[rows[-1][0]].score, 3))}


def test_the_score_beats_counts_on_held_out_texts(spark):
    rows = queries.op7(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_all_training_texts_shape_the_network(spark):
    """Order that only texts have which a sample of 2 000 by the hash of doc_id would leave out."""
    rng = random.Random(33)
    ids = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * 4000 < 2000 << 20).alias("sampled")).collect()
    mixed = lambda: " ".join(rng.choices(["red", "green", "blue", "one", "two"], k=60))
    df = docs(spark, [(r.id, mixed() if r.sampled else "red green blue one two " * 12) for r in ids]).repartition(3)
    model, table = lm.fit(df)
    probe = docs(spark, [(1, "red green blue one two " * 12), (2, mixed())]).withColumn("held_out", F.lit(True))
    got = {r.doc_id: r.score for r in lm.score(probe, model, table).collect()}
    assert got[1] > got[2] + 10


def test_mixing_meets_targets(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 60, "abcd" if i % 4 else "wxyz"), "en", "s", 0) for i in range(120)] + [(500, None, "en", "s", 0), (501, "", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    labelled = df.filter("doc_id < 60").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "rare").otherwise("common").alias("domain"))
    model = mixing.fit(labelled)
    out = mixing.mix_to_targets(df.withColumn("rate", F.lit("clash")), model, {"rare": 0.5, "common": 0.5}).collect()
    assert len(out) == 122 and all(r.rate >= 0 for r in out)
    total = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in out], axis=0)
    assert np.allclose(total / sum(r.n_tokens for r in out), 0.5, atol=2e-3)
    assert all((r.domain == "rare") == (r.doc_id % 4 == 0) for r in out if r.doc_id < 120)
    none = mixing.mix_to_targets(df, mixing.fit(labelled.limit(0)), {})
    assert {r.rate for r in none.collect()} == {1.0}


# --- 4: pages ---------------------------------------------------------------------


def test_pages(spark):
    page = '<html><head><title>T</title></head><body><header>Site</header><div class="cookie-banner"><p>We use cookies</p></div><main><article><h1>A &amp; B</h1><p>One&nbsp; two<br>three</p><aside>see also</aside><p>Four<script>var a="<p>"</script> five</p><div class="ad">Buy</div><form><p>mail</p></form></article><section id="comments"><article><p>first!</p></article></section></main><footer>(c)</footer>'
    menu = "<div><p>Home News Sport Weather Travel Contact</p></div>"
    plain = [(10 + i, "http://h.example/x", f"<body>{menu}<p>unique words number {i} of this page are here</p>") for i in range(5)]
    rows = [(1, "http://h.example/a", page), (2, None, None), (3, "http://h.example/b", ""), (4, "not a url", "text <b>alone"), (5, "x", "<p>open <!-- never closed")] + plain
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\nOne two three\nFour five" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "text alone", "open")
    assert [got[10 + i].text for i in range(5)] == [f"unique words number {i} of this page are here" for i in range(5)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copied_pages_keep_their_text(spark):
    menu = "<div><p>Home News Sport Weather Travel Contact</p></div>"
    rng = random.Random(31)
    body = [prose(rng, 30) for _ in range(2)]
    near = [prose(rng, 30) for _ in range(2)]
    pages = {i: (f"{menu}<p>{body[0]}</p><p>{body[1]}</p>", body) for i in range(3)}
    for i in range(3, 6):  # views that differ in a word, and in a short line
        own = [f"{near[0]} view{i}", near[1]]
        pages[i] = (f"{menu}<p>{own[0]}</p><p>{own[1]}</p><p>printed {i}</p>", [*own, f"printed {i}"])
    rows = [(i, f"http://h.example/{i}", p) for i, (p, _) in pages.items()]
    rows += [(10 + i, f"http://alone.example/{i}", f"<p>{body[0]}</p><p>{body[1]}</p>") for i in range(3)]
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want for i, (_, want) in pages.items()} | {10 + i: body for i in range(3)}


def test_groups_of_a_large_host_change_nothing(spark):
    rng = random.Random(32)
    notice = [f"<p>{prose(rng, 9)}</p>" for _ in range(10)]  # each on three pages of 30
    rows = [(i, f"http://h.example/{i}", f"<div>{notice[i % 10]}</div><p>{prose(rng, 30)}</p>") for i in range(30)]
    df = spark.createDataFrame(rows + [(99, "http://h.example/x", rows[0][2])], "page_id long, url string, html string")
    one, many = ({r.page_id: r.text for r in html.extract(df, group).collect()} for group in (512, 4))
    assert one == many == {i: re.findall("<p>(.*?)</p>", page)[1] for i, _, page in [*rows, (99, None, rows[0][2])]}


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(random.Random(i), 40)) for i in range(20)] + [(30, None), (31, "")]
    extra = {c: F.lit(c) for c in ("doc", "tag", "places", "score", "m", "_id", "class_id", "item_id", "_q", "_h")}
    now = docs(spark, rows).withColumns(extra)
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "not there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        got = now.collect()
        assert now.columns[: 5 + len(extra)] == [*DOCS_COLUMNS, *extra], name
        assert len(got) == 22 and all(r.doc == "doc" and r.score == "score" for r in got), name
        now = spark.createDataFrame(got, now.schema)


# --- all together -----------------------------------------------------------------


def test_empty_tables(spark):
    none = docs(spark, [])
    assert substring_dedup.digest(none).count() == 0
    assert neardup.classes(none).count() == 0
    assert media.features(media.store(none)).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    model, table = lm.fit(none.withColumn("held_out", F.lit(False)))
    assert lm.score(none.withColumn("held_out", F.lit(False)), model, table).count() == 0


def test_a_small_corpus_is_trained_as_a_large_one(spark, monkeypatch):
    """Each text is seen once, whatever the corpus's size."""
    from framewatch.llm import lm

    seen, add_up = [], lm.add_up
    monkeypatch.setattr(lm, "add_up", lambda rows: seen.append(sum(r.tokens for r in rows)) or add_up(rows))
    lm.fit(spark.createDataFrame([(i, "a b c") for i in range(40)], "doc_id long, text string"))
    assert len(seen) == lm.ROUNDS and sum(seen) == 160
