"""SimHash groups, line dedup and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from arbora.llm import line_dedup, simhash
from arbora.llm.components import connected_components

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 700)] + [(900, 900), (7, 7)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    nodes = {x for e in edges for x in e}
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == roots(nodes, edges)
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", None, "  \n", "one", "One two", "a b c d", "a b c d e", "É é A\x0bB\x0cC", "x " * 3000, "word " + "long" * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_block_masks_meet_all_pairs():
    rng = np.random.default_rng(0)
    for distinct in (10, 10**6, 10**9):
        masks = simhash.block_masks(distinct)
        for _ in range(200):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, 4, replace=False):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("size", [1, 2, 50, 96, 97, 400])
def test_cell_links(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, 5).astype(np.uint64)
    fp = np.unique(np.array([base[rng.integers(5)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(size)], np.uint64))
    near = np.bitwise_count(fp[:, None] ^ simhash.pivots(24)).astype(np.uint8)
    all_pairs = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4]
    found = simhash.cell_links(fp, near)
    assert all(int(fp[i] ^ fp[j]).bit_count() <= 4 for i, j in found) and len(found) < max(len(fp), 1)
    assert roots(range(len(fp)), found) == roots(range(len(fp)), all_pairs)


def near_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for g in range(12):
        base = [word() for _ in range(300)]
        for k in range(g + 1):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += ["same text here for all"] * 30 + ["", None, " ", "x"]
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("tile", [4096, 3])
def test_near_duplicates(spark, tile):
    rows = near_docs() + [(None, "same text here for all"), (5, dict(near_docs())[5])]
    got = sorted((r["id"] or 0, r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), tile=tile).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 4]
    root = roots(set(fps), links)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == sorted((i or 0, f, least[root[f]]) for (i, _), f in zip(rows, fps, strict=True))


def test_near_duplicates_empty_and_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "y"), (3, "other words entirely different now", "z"), (None, "lone and null id here", "n")], DOCS + ", root string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["root"]) for r in kept.collect()) == [(0, "n"), (1, "x"), (3, "z")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def jaccard(a, b, width=5):
    x, y = (set(simhash.shingles(t.encode(), width)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("tile", [4096, 8])
def test_similar_documents(spark, tile):
    """Against all pairs: groups are made of links of 0.8 or more, and hardly any such link is missed."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for edits in (0, 1, 1, 2, 3, 4):
        for _ in range(12):
            base = [word() for _ in range(rng.randint(80, 300))]
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = word()
            rows += [" ".join(base), " ".join(other)]
    rows += ["", None, "one two"] + ["half " * 3 + " ".join(word() for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), DOCS).repartition(3)
    root = {r["id"]: r["root"] for r in simhash.similar_documents(df, tile=tile).collect()}
    want, links = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i] or "", rows[j] or "") >= 0.8:
                links.append((i, j))
                want = [want[j] if x == want[i] else x for x in want]
    assert all(want[i] == want[j] for i in root for j in root if root[i] == root[j])
    assert len(links) > 50 and sum(root[i] == root[j] for i, j in links) >= 0.97 * len(links)
    kept = simhash.keep_one(df, simhash.similar_documents(df))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root[i]: i for i in reversed(range(len(rows)))}.values())


def brute_groups(texts):
    """Group number per text by links of 0.8 or more between five-word shingle sets, all pairs."""
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and jaccard(texts[i], texts[j]) >= 0.8:
                want = [want[j] if x == want[i] else x for x in want]
    return want


@pytest.mark.parametrize("tile", [4096, 7])
def test_similar_documents_in_a_hot_group(spark, tile):
    """Many different copies of one text about 0.8: links that the star of a cell does not hold are found between parts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, texts = [word() for _ in range(100)], []
    for k in range(120):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(5, 95)] = word()
        texts.append(" ".join(copy))
    texts += ["a a a a a a", "a a a a a a a", "loose words", " ".join(base) + "\n", "long " + "tail " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    root = {r["id"]: r["root"] for r in simhash.similar_documents(df, tile=tile).collect()}
    want = brute_groups(texts)
    got = {}
    for i, r in root.items():
        got.setdefault(r, set()).add(want[i])
    assert all(len(x) == 1 for x in got.values())  # no group joins unlike texts
    assert len(got) == len(set(want))  # and none is split
    assert root[120] == root[121] and root[123] == root[0]


def test_part_links_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = [np.unique(rng.choice(14, rng.integers(1, 14), replace=False)).astype(np.uint64) for _ in range(25)]
        part, bits = rng.integers(0, 6, 25), np.zeros((25, 4), np.uint64)
        want = {(i, j) for i in range(25) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8}
        found = {(max(p), min(p)) for p in simhash.part_links(part, bits, sets, 50, 0.8)}
        assert found <= want and all(part[i] != part[j] for i, j in found)

        def merged(links):
            name = part.copy()
            for i, j in links:
                name[name == name[i]] = name[j]
            return [[bool(x == y) for x in name] for y in name]

        assert merged(found) == merged(want)
    assert simhash.alike(np.array([], np.uint64), [np.array([], np.uint64)], 0.8).tolist() == [False]


def brute_lines(rows, min_words):
    """Lines deleted per (id, text), by definition: any run of min_words words whose lines stand anywhere earlier."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda d: (d[0], d[1], xxhash.xxh64_intdigest(d[2].encode())))
    seen, gone = set(), defaultdict(set)
    for d in docs:
        lines = [(k, x.strip(" \t\n\r\x0b\x0c"), len(x.split())) for k, x in enumerate(d[2].split("\n")) if x.split()]
        for i in range(len(lines)):
            fresh = set()
            for e in range(i + 1, len(lines) + 1):
                if sum(x[2] for x in lines[i:e]) >= min_words:
                    run = tuple(x[1] for x in lines[i:e])
                    if run in seen:
                        gone[d] |= {x[0] for x in lines[i:e]}
                    fresh.add(run)
            seen |= fresh
    return gone


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    rows = []
    for i in range(60):
        made = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            made[1:1] = pool[3:9]
        rows.append((i + 1, "\n".join(made)))
    rows += [(61, None), (62, ""), (63, "\n\n"), (64, "long " * 4000 + "\n" + "long " * 4000)]
    want = brute_lines(rows, 20)
    got = {r["id"]: r for r in line_dedup.repeated_lines(spark.createDataFrame(rows, DOCS).repartition(4), 20).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["removed"] == sorted(want.get((False, i, t or ""), set())), i
        assert got[i]["n_lines"] == (t or "").count("\n") + 1


def test_line_windows_select_few_positions():
    """Every window's minimum is selected, and neighbouring windows share theirs."""
    rng = np.random.default_rng(1)
    code, words = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(1, 12, 400).astype(np.int32)
    found = line_dedup.selected(code, words, 50)
    spans = line_dedup.windows(words, 50)
    assert sorted((a, a + n) for around in found.values() for _, a, n in around) == spans and len(found) < len(spans) / 3
    for a, b in spans:
        assert words[a:b].sum() >= 50 and (words[a + 1 : b].sum() < 50 or words[a : b - 1].sum() < 50)
    for at, around in found.items():
        assert all(code[at] == code[a : a + n].min() and a <= at < a + n for _, a, n in around)


def test_later_run_goes_whole(spark):
    """Only a later document holds the longer version of a run, and a tail beyond the shared windows."""
    line = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    x, y, z = line("x", 60), line("y", 10), line("z", 5)
    l1, l2, m = line("p", 30), line("q", 30), line("m", 10)
    rows = [(1, x), (2, f"{x}\n{y}\n{z}"), (3, f"own\n{x}\n\n{y}\n{z}"), (11, f"{l1}\n{l2}"), (12, f"{l1}\n{l2}\n{m}\nx"), (13, f"{l1}\n{l2}\n{m}\ny")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["id"]: r["removed"] for r in line_dedup.repeated_lines(df).collect()}
    assert got == {1: [], 2: [0], 3: [1, 3, 4], 11: [], 12: [0, 1], 13: [0, 1, 2]}
    runs = {tuple(r) for r in line_dedup.repeated_runs(df).collect()}
    assert {(2, 0, 0, 1, 0), (12, 0, 1, 11, 0)} <= runs and any(r[0] == 3 and r[2] == 4 and r[3] == 2 for r in runs)


def test_line_dedup_texts(spark):
    run = "\n".join(f"line {k} with several words in it" for k in range(9))
    rows = [(1, f"own one\n{run}\nend"), (2, f"{run}\nown two"), (None, run), (3, "short line"), (4, "short line"), (4, "short line")]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], DOCS + ", removed string")
    got = line_dedup.without_repeats(df)
    assert got.columns == df.columns and got.count() == len(rows)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, rows[0][1]), (2, "own two"), (None, ""), (3, "short line"), (4, "short line")}
    assert line_dedup.without_repeats(df.limit(0)).count() == 0


def test_tiles_of_a_hot_cell_are_pruned_by_pivot_distance(spark):
    """200 rows at distance 10, 200 at 40, 5 between: tiles of the two heaps never meet, and every pair within the radius does."""
    distance = [10] * 200 + [40] * 200 + [14, 18, 36, 37, 60]
    rows = [(0, 7, fp, bytes([c, 1])) for fp, c in enumerate(distance)]
    hot = spark.createDataFrame(rows, "t int, key long, fp long, near binary").repartition(3)
    groups = defaultdict(set)
    for r in simhash.tile_pairs(hot, 4, 20).collect():
        groups[r["i"], r["j"]].add(r["fp"])
    tiles = 1 + max(j for _, j in groups)
    assert len(groups) < 0.6 * tiles * (tiles + 1) / 2
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert all((a, b) in met for a in range(len(distance)) for b in range(a + 1, len(distance)) if abs(distance[a] - distance[b]) <= 4)
    assert not any(x < 200 <= y < 400 for x, y in met)
