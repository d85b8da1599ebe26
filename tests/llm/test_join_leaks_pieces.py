"""Operators 1, 4 and 5 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tabsignal.llm import decontaminate, ngram_join, piece_counts
from tabsignal.llm.graph import components


def frame(spark, rows):
    return spark.createDataFrame([(t, i, "z", 0) for i, t in rows], "text string, doc_id long, other string, cls int").toDF("text", "doc_id", "Text", "cls")


def sets(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, similarity=0.8):
    """n_links, group and class by doc_id; ids are unique."""
    s = {i: sets(t) for i, t in rows}
    link, parent = Counter(), {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = s[ids[a]], s[ids[b]]
            if x and y and len(x & y) >= similarity * len(x | y):
                link[ids[a]] += 1
                link[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (min((j for j in ids if s[i] and s[j] == s[i]), default=i), find(i), link[i]) for i in ids}


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, passage = [], " ".join(r.choice(words) for _ in range(60))
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.45:
            w = (r.choice(rows)[1] or "x").split()
            for _ in range(r.randint(0, 6)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        elif kind < 0.6:
            text = passage + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        else:
            text = " ".join(r.choice(words) for _ in range(r.randint(1, 150)))
        rows.append((i, text))
    return rows + [(n, ""), (n + 1, None), (n + 2, "!!! ..."), (n + 3, "one two"), (n + 4, "One, two!"), (n + 5, "long " * 20_000), (n + 6, "long " * 19_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # many blocks
    rows = corpus(seed)
    got = {r["doc_id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in ngram_join.links(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_large_group_and_copies(spark):
    r = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "copy of the very same text here") for i in range(300)]
    got = {x["doc_id"]: (x["class_id"], x["group_id"], x["n_links"]) for x in ngram_join.links(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_keep_one(spark):
    rows = corpus(3) + [(5, "unique text of a repeated row " * 3)] * 2
    rows = [r for r in rows if r[0] != 5] + [(5, "unique text of a repeated row " * 3)] * 2 + [(9000, "unique text of a repeated row " * 3)]
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == ["text", "doc_id", "Text", "cls"]
    groups = brute([r for r in dict(rows).items()])
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, (_, g, _) in groups.items() if g == i)
    assert ngram_join.keep_one(frame(spark, [])).count() == 0 and ngram_join.links(frame(spark, [])).count() == 0


def test_prefixes_shorten_to_the_recall():
    r = np.random.default_rng(4)
    miss, least = ngram_join.misses(0.8), ngram_join.shortest_prefix(0.8, 0.99999)
    assert 1 <= least < ngram_join.DEPTH
    sizes = np.sort(r.integers(1, 9, (50, ngram_join.TREES, ngram_join.DEPTH + 1 - least)), axis=2)[:, :, ::-1].copy()
    sizes[0] = 1  # alone everywhere
    sizes[1] = 1
    sizes[1, :4] = 1000 // 4 ** np.arange(sizes.shape[2])  # shorter prefixes of four trees bring in many
    sizes[2] = 500  # crowded everywhere
    depth = ngram_join.shorten(sizes, 0.8, 0.99999)
    assert (miss[depth].sum(1) <= np.log(1e-5) + 1e-9).all() and depth.min() >= least
    assert (depth[1, :4] == ngram_join.DEPTH).all() and (depth[1, 4:] < ngram_join.DEPTH).any()
    one_less = ngram_join.shorten(sizes, 0.8, 0.9)
    assert (one_less >= depth).all() and (one_less > depth).any()
    with pytest.raises(ValueError):
        ngram_join.shortest_prefix(0.2, 0.99999)


def test_forest_nodes_over_partition_borders(spark):
    r = np.random.default_rng(3)
    few = r.integers(0, 3, (400, ngram_join.TREES, ngram_join.DEPTH)).astype(np.int64)
    few[:150, :, :] = few[0]  # a third of all has the same paths
    path = sum(few[:, :, j] << (ngram_join.BITS * (ngram_join.DEPTH - 1 - j)) for j in range(ngram_join.DEPTH))
    rows = [(i.to_bytes(2, "big"), p.tolist()) for i, p in enumerate(path)]
    frame = spark.createDataFrame(rows, "cls binary, paths array<long>").selectExpr("posexplode(paths) as (tree, path)", "cls")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        forest = ngram_join._sorted(frame, "test-forest")
        near = ngram_join.company(forest, 2).collect()
        depths = ngram_join.matched(ngram_join.company(forest, 2), 2, 0.8, 0.99999)
        seats = ngram_join.buckets(ngram_join._sorted(depths, "test-matched"), 2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for t in range(ngram_join.TREES):
        for d in range(2, ngram_join.DEPTH + 1):
            for i, p in enumerate(path[:, t] >> (ngram_join.BITS * (ngram_join.DEPTH - d))):
                want.setdefault((t, d, int(p)), []).append(i)
    assert len(near) > 0
    for x in near:
        assert x["sizes"] == [len(want[(x["tree"], d, x["path"] >> (ngram_join.BITS * (ngram_join.DEPTH - d)))]) for d in range(2, ngram_join.DEPTH + 1)]
    members = Counter(x["bucket"] for x in seats)
    assert members and all(members[x["bucket"]] == x["n"] for x in seats)


def test_different_texts_under_one_id_stay(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta " * 4, "one two three four five six seven " * 4, "red green blue black white grey " * 4)
    rows = [(1, a), (5, a), (5, b), (7, c)]
    assert sorted((x["doc_id"], x["text"]) for x in ngram_join.keep_one(frame(spark, rows)).collect()) == [(1, a), (5, b), (7, c)]
    assert sorted((x["doc_id"], x["text"]) for x in ngram_join.keep_one(frame(spark, [(7, a), (7, b), (7, b)])).collect()) == sorted([(7, a), (7, b)])
    copies = frame(spark, [(3, a)] * 5 + [(None, b)] * 3)
    assert [(x["doc_id"], x["text"]) for x in ngram_join.keep_one(copies).orderBy("doc_id").collect()] == [(None, b), (3, a)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(200, 300), (300, 250), (7, 7), (1, 2)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: i - i % 20 for i in range(60)} | {200: 200, 300: 200, 250: 200} | ({60: 40} if 60 in got else {})
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_automaton_against_brute_force():
    def greedy(word, initial, inner):
        n = i = 0
        while i < len(word):
            vocab = initial if i == 0 else inner
            j = len(word)
            while j > i and word[i:j] not in vocab:
                j -= 1
            if j == i:
                return 1, True
            n, i = n + 1, j
        return n, False

    r = random.Random(3)
    draw = lambda: sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))})
    for _ in range(150):
        a, b = draw(), draw()
        words = ["".join(r.choice("abcd" if r.random() < 0.05 else "abc") for _ in range(r.randint(1, 14))) for _ in range(50)]
        pieces, unknown = piece_counts.Automaton(a, b).count(words)
        assert list(zip(pieces.tolist(), unknown.tolist())) == [greedy(w, set(a), set(b)) for w in words]


def test_token_counts_frame(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(0, "Hello, world!"), (1, None), (2, ""), (3, "ab " * 60_000), (None, "x"), (0, "Hello, world!"), (4, "\U0001f600 漢")]
    got = sorted(map(tuple, piece_counts.count_tokens(frame(spark, rows), path).collect()), key=str)
    initial, inner = (set(x) for x in piece_counts.piece_vocabulary(path))
    automaton = piece_counts.Automaton(sorted(initial), sorted(inner))
    want = []
    for i, t in rows:
        words = piece_counts.WORDS.findall((t or "").lower())
        pieces, unknown = automaton.count(words)
        want.append((i, len(words), int(pieces.sum()), int(unknown.sum())))
    assert got == sorted(want, key=str)
    assert piece_counts.count_tokens(frame(spark, []), path).count() == 0


def edits(pattern, text):
    """Least edits of the whole pattern against any part of the text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != x), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_leaks_against_brute_force():
    r = random.Random(5)
    letters = "abcde fghij"
    for _ in range(120):
        items = decontaminate.Items.of([(i, "".join(r.choice(letters) for _ in range(r.choice([30, 60, 100, 150])))) for i in range(4)])
        docs = []
        for _ in range(3):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 150)))
            if r.random() < 0.8:
                passage = [chr(c) for c in r.choice(items.codes)]
                for _ in range(r.randint(0, 12)):
                    k = r.randrange(len(passage))
                    passage[k : k + r.choice([0, 1, 1])] = r.choice(["", "", r.choice(letters)])
                text += "".join(passage) + "".join(r.choice(letters) for _ in range(r.randint(0, 100)))
            docs.append(text)
        for text, found in zip(docs, decontaminate._search(items, docs, decontaminate.Q)):
            compared = "".join(map(chr, decontaminate.normal(text)[0]))
            for item, codes, budget in zip(items.ids, items.codes, items.budget):
                best = edits("".join(map(chr, codes)), compared)
                mine = [f for f in found if f[0] == item]
                assert bool(mine) == (best <= budget)
                assert not mine or min(f[3] for f in mine) == best


def test_leaks_frame(spark):
    item = "The quick brown fox jumps over the lazy dog while nobody in the village looks at it."
    other = "Entirely different benchmark question about rivers, mountains and the sea, is it not?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, other), (5, "zyx")], "item_id int, text string")
    rows = [(0, f"Before. {item.upper().replace(' ', '  ')} After."), (1, "clean text " * 30), (2, None), (3, ""), (4, item.replace("brown", "brwn") + " and " + item), (5, "pad " * 50_000 + item), (None, other), (1, "has zyx inside"), (6, "zyxw is another word")]
    found = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(frame(spark, rows), bench).collect()), key=str)
    assert found == sorted([(0, 1, 0), (4, 1, 1), (4, 1, 0), (5, 1, 0), (None, 4, 0), (1, 5, 0)], key=str)
    spans = {r["doc_id"]: (r["start"], r["length"]) for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert rows[5][1][spans[5][0] : sum(spans[5])] == item.rstrip(".")
    left = decontaminate.remove_leaks(frame(spark, rows), bench)
    assert left.columns == ["text", "doc_id", "Text", "cls"]
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 6]
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.remove_leaks(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    words = np.random.default_rng(1).integers(0, 10**6, (6, 20))
    bench = spark.createDataFrame([(i, " ".join(f"q{x}" for x in w)) for i, w in enumerate(words)], "item_id int, text string")
    docs = frame(spark, [(i, "start " + " ".join(f"q{x}" for x in w) + " stop") for i, w in enumerate(words)] + [(99, "nothing here")])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == [(i, i) for i in range(6)]
    assert [r["doc_id"] for r in decontaminate.remove_leaks(docs, bench).collect()] == [99]


@pytest.mark.parametrize("seed", range(6))
def test_long_alignment_is_the_banded_one(seed):
    r = np.random.default_rng(seed)
    for _ in range(40):
        m = int(r.integers(8, 60))
        item = r.integers(97, 97 + int(r.integers(2, 5)), m).astype(np.uint32)
        text = np.concatenate([r.integers(97, 101, int(r.integers(0, 12))), item, r.integers(97, 101, int(r.integers(0, 12)))]).astype(np.uint32)
        for _ in range(int(r.integers(0, 8))):
            at = int(r.integers(0, len(text)))
            text = [np.delete(text, at), np.insert(text, at, 99), np.concatenate([text[:at], [98], text[at + 1 :]])][int(r.integers(0, 3))].astype(np.uint32)
        first, width, k = int(r.integers(-6, 6)), int(r.integers(4, 24)), int(r.integers(0, 9))
        want = decontaminate.align([item], text, np.array([first]), np.array([width]), np.array([0]), np.array([len(text)]))
        edits, start, end = decontaminate.align_long(item, text, first, width, k)
        if want[0][0] <= k:
            assert (edits, end) == (want[0][0], want[2][0])
            assert edits_between(item, text[start:end]) <= edits  # outside the band there may be better ones
        else:
            assert edits > k


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_long_items_are_found(spark):
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    long, longer = say(10_000), say(185_000)  # some 60,000 and 1.1 million characters
    assert len(long) > 58_000 and len(longer) > 1_050_000
    near = long[:20_000] + "zz" + long[20_003:40_000] + long[40_030:]
    rows = [(1, "before " + long + " after"), (2, longer), (3, near), (4, say(2000)), (5, long[: len(long) // 2])]
    items = spark.createDataFrame([(0, long), (1, longer)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.leaks(frame(spark, rows), items).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 0)}
    assert (got[1, 0]["start"], got[1, 0]["length"], got[1, 0]["edits"]) == (7, len(long), 0)
    assert got[2, 1]["edits"] == 0 and 25 <= got[3, 0]["edits"] <= 33


def test_repetitive_texts_do_not_multiply():
    r = random.Random(2)
    items = decontaminate.Items.of([(0, "a" * 3000), (1, "ab" * 1500), (2, "x " * 2000), (3, "a" * 30 + " this is an ordinary item of some words")])
    text = ["a" * 200_000, "ab" * 50_000 + "c", " ".join(r.choice("xyz") for _ in range(2000)) + " " + "x " * 2100, "-" * 9000, "a" * 30 + " this is an ordinary item of some words"]
    got = [{h[0] for h in spans} for spans in decontaminate._search(items, text, decontaminate.Q)]
    assert got == [{0}, {1}, {2}, set(), {3}]
