"""Token store, decontamination and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import decontaminate, queries, token_store

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 256, 50_257, 2**32])
def test_levels(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    lengths = [n // 3, 0, n - n // 3]
    image = token_store.from_image(token_store.to_image([5, None, 9], lengths, ids))
    assert image.doc_ids == [5, None, 9] and len(image) == n and (image.all() == ids).all()
    for i in range(0, n, max(1, n // 50)):
        assert image.token(i) == ids[i]
    for lo, hi in ((0, n), (n // 2, n), (n // 3, n // 2), (n, n)):
        assert (image.slice(lo, hi) == ids[lo:hi]).all()


def test_broken_image_is_refused():
    image = bytearray(token_store.to_image([1], [3], np.array([1, 2, 70000], np.uint32)))
    image[40] ^= 1
    with pytest.raises(ValueError):
        token_store.from_image(bytes(image))


TEXTS = [
    "", " ", "\n\n", "plain words here", "Don't we'll I'm", "a  b   c\n\nd \n e", "tabs\there and\r\nthere", " nbsp　wide space", "ünï cödé ßtraße Çağ", "日本語 текст عربى", "123 4567 x1y2", "!!! ... ,,, --", "a.b,c;d", "<|endoftext|> in text <|endoftext|>",
    "emoji 😀😀 é zero​width", "trailing space ", " leading", "x" * 5000, "word. " * 3000, "end.)", "(.x", "ǅ ʰ ªº", "Ⅷ ½ ²", "\x1c odd \x85 space",
]


def test_pieces_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    pieces = token_store.Pieces(queries.tokenizer_file())
    rng = random.Random(2)
    signs = "ab Z.,'\n-é1  ñ!?\t"
    texts = [*TEXTS, *("".join(rng.choice(signs) for _ in range(80)) for _ in range(500)), *(" ".join(rng.choice(["a", "b.", "x\ny", "\nz", "é,&&", "it's", "_u_"]) for _ in range(30)) for _ in range(200))]
    for remembered in (400_000, 50):
        monkeypatch.setattr(token_store, "REMEMBERED", remembered)
        for at in (0, 0, 1):
            for t in texts[at:]:
                assert np.frombuffer(pieces.ids(t), pieces.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_pieces_are_not_remembered(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    pieces = token_store.Pieces(queries.tokenizer_file())
    monkeypatch.setattr(token_store, "REMEMBERED", 20)
    texts = [" ".join([f"w{k}", chr(97 + k % 26) * 30, "x" * 5000 + str(k), "é" * 2000 + ",", "#" * 300, "word" * 20 + "." * (k + 1)]) for k in range(60)]
    for t in texts:
        assert np.frombuffer(pieces.ids(t), pieces.kind).tolist() == whole.encode(t, add_special_tokens=False).ids
    for known in (pieces, pieces.words):
        assert len(known) <= 20 and max(map(len, known)) <= token_store.REMEMBERED_LENGTH + 1


def expected(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(spark, tmp_path):
    rows = [(i * 3 % 101, t) for i, t in enumerate(TEXTS)] + [(200, None), (None, "null id")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    path = f"file://{tmp_path}/s"
    token_store.write_store(df, path, queries.tokenizer_file(), image_tokens=700)
    store = spark.read.parquet(path)
    assert sorted(map(tuple, token_store.read_store(store).collect()), key=repr) == sorted(expected(rows), key=repr)
    total = sum(r[2] for r in expected(rows))
    wanted = spark.createDataFrame([(p,) for p in [*range(0, total, 97), total - 1, total, -1, None]], "position long")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    flat = [x for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for x in [*whole.encode(t or "", add_special_tokens=False).ids, 0]]
    got = {r["position"]: r["token"] for r in token_store.tokens_at(store, wanted).collect()}
    assert got == {p: flat[p] for p in [*range(0, total, 97), total - 1]}


def test_lookup_reads_few_images(spark, tmp_path, monkeypatch):
    """k positions read k images at most, of k files at most; the others stay unread."""
    monkeypatch.setattr(token_store, "FILE_IMAGES", 2)
    monkeypatch.setattr(token_store, "GROUP_BYTES", 256)
    df = spark.createDataFrame([(i, f"word{i} " * 200) for i in range(60)], DOCS).coalesce(1)
    path = f"file://{tmp_path}/s"
    token_store.write_store(df, path, queries.tokenizer_file(), image_tokens=900)
    store = spark.read.parquet(path)
    images = store.count()
    assert images >= 30 and len(store.inputFiles()) >= images / 2
    for k in (1, 3):
        wanted = spark.createDataFrame([(p * 5000 + 17,) for p in range(k)], "position long")
        assert token_store.images_wanted(store, wanted).count() == k
        found = token_store.tokens_at(store, wanted)
        assert found.count() == k
        assert "file_path" in found._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["total_compressed_size"] for f in store.inputFiles() for r in row_groups(f)]
    assert len(sizes) == images


def row_groups(file):
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    return [{"total_compressed_size": meta.row_group(k).total_byte_size} for k in range(meta.num_row_groups)]


def test_store_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, "b c", 7), (0, "z", 8)], DOCS + ", part int").withColumn("seq", F.lit(1)).withColumn("image", F.lit("x"))
    with pytest.raises(Exception, match="no whole number"):
        token_store.stored(spark.createDataFrame([("x1", "a")], "doc_id string, text string"), queries.tokenizer_file())
    got = sorted(map(tuple, token_store.stored(df, queries.tokenizer_file()).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [0, 1, 1, 1] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert token_store.stored(df.limit(0), queries.tokenizer_file()).count() == 0


# ---------------------------------------------------------------- decontamination


def plain_score(item, passage):
    best = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            best[i, j] = max(0, best[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
    return int(best.max())


@pytest.mark.parametrize("seed", range(8))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 30))
        score, lo, hi = decontaminate.align(a, b)
        assert score == plain_score(a, b)
        assert score == 0 or score == plain_score(a, b[lo:hi])


def leak_tables():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "sa", "vo", "ne"]) for _ in range(rng.randint(2, 4)))
    common = [word() for _ in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [(k, prose(rng.randint(15, 50))) for k in range(12)]
    docs, leaked = [], set()
    for i in range(240):
        body = prose(rng.randint(40, 200))
        if i % 3 == 0:
            k, w = rng.choice(items)
            w = list(w)
            if i % 2:
                for _ in range(len(w) // 6):
                    w[rng.randrange(len(w))] = word()
                del w[rng.randrange(len(w))]
            at = rng.randrange(len(body))
            body[at:at] = w if i % 4 else [x.upper() + "," for x in w]
            leaked.add((i, k))
        docs.append((i, " ".join(body)))
    return docs, [(k, " ".join(w)) for k, w in items], leaked


def test_leaks_planted(spark):
    docs, items, leaked = leak_tables()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS + ", item_id int").repartition(4)
    b = spark.createDataFrame([*items, (90, None), (None, "x y"), (91, "too short")], "item_id long, text string")
    got = decontaminate.leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaked
    words = dict(docs)
    item = dict(items)
    for r in got[:20]:
        raw = decontaminate.words_of(words[r["doc_id"]].encode())
        assert r["score"] == pytest.approx(plain_score(decontaminate.words_of(item[r["item_id"]].encode()), raw) / (2 * len(item[r["item_id"]].split())))
    kept = decontaminate.without_leaks(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in leaked}


def test_leaks_blocks_and_edges(spark, monkeypatch):
    docs, items, leaked = leak_tables()
    odd = [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1]), (902, items[1][1])]
    d = spark.createDataFrame([*docs, *odd], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    blocks = decontaminate.item_blocks
    monkeypatch.setattr(decontaminate, "item_blocks", lambda x: blocks(x, size=5))
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()]
    assert set(got) == leaked | {(None, 0), (902, 1)} and got.count((902, 1)) == 2
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0
    assert decontaminate.without_leaks(d, b.limit(0)).count() == d.count()


def test_short_items_are_found_whole(spark):
    """Items under MIN_WORDS words, and items without spaces."""
    items = [(1, "Only seven words stand here, no more"), (2, "lone"), (3, "these are not"), (4, "東京都に住んでいる人は多い"), (5, "..."), (6, "these are missing")]
    docs = [(1, "x only seven words stand here no MORE."), (2, "only seven words stand here no"), (3, "a lone these are not"), (4, "昨日、東京都に住んでいる人は多いと聞いた"), (5, "昨日は雨"), (6, "these are")]
    d, b = spark.createDataFrame([(i, t, True) for i, t in docs], DOCS + ", _leaks boolean"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"], r["first_word"], r["last_word"]) for r in decontaminate.leaks(d, b).collect()}
    assert got == {(1, 1, 1.0, 1, 7), (3, 2, 1.0, 1, 1), (3, 3, 1.0, 2, 4), (4, 4, 1.0, 3, 15)}
    kept = decontaminate.without_leaks(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {2, 5, 6}


def test_a_common_item_is_still_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = spark.createDataFrame([(i, f"own{i} {item} tail{i}") for i in range(300)] + [(999, "nothing of it in here at all")], DOCS)
    got = decontaminate.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.count() == 300 and got.where("score < 1").count() == 0


@pytest.mark.parametrize("edit", ["replace every 4th", "drop every 4th", "replace every 3rd", "add after every 2nd", "add after every word"])
def test_edited_copies_are_found(spark, edit):
    """Copies that are an item's only occurrence, with a score over 0.5, among texts of the same words."""
    rng = random.Random(6)
    items = [(k, [f"w{rng.randrange(400)}" for _ in range(rng.randint(16, 40))]) for k in range(30)]
    docs, want = [], set()
    for k, w in items:
        if edit == "replace every 4th":
            w = [x if j % 4 != 3 else f"new{j}" for j, x in enumerate(w)]
        elif edit == "drop every 4th":
            w = [x for j, x in enumerate(w) if j % 4 != 3]
        elif edit == "replace every 3rd":
            w = [x if j % 3 != 2 else f"new{j}" for j, x in enumerate(w)]
        else:
            every = 2 if edit == "add after every 2nd" else 1
            w = [y for j, x in enumerate(w) for y in ([x] if j % every != every - 1 else [x, f"new{j}"])]
        body = [f"w{rng.randrange(400)}" for _ in range(60)]
        docs.append((k, " ".join(body[:30] + w + body[30:])))
    for k, text in docs:
        for i, w in items:
            codes = {x: j for j, x in enumerate(dict.fromkeys(text.split()))}
            goal, passage = np.array([codes.get(x, -1) for x in w]), np.array([codes[x] for x in text.split()])
            if decontaminate.align(goal, passage)[0] >= len(goal):
                want.add((k, i))
    assert len(want) >= 25
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as cp
    from arbora.llm import mixing, simhash, toxicity
    from arbora.llm.common import table

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "tokens"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        made = stage(spark, kept, sf).cache()
        assert made.columns == columns, name
        before, now = {r["doc_id"] for r in kept.collect()}, {r["doc_id"] for r in made.collect()}
        assert now <= before
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, sf, "labels"))
            assert now == {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
        elif name == "near_dedup":
            groups = {}
            for r in simhash.similar_documents(kept, 5, 0.8).collect():
                groups.setdefault(r["root"], []).append(r["id"])
            assert now == {min(g) for g in groups.values()}
        elif name == "decontaminate":
            assert now == before - {r["doc_id"] for r in decontaminate.leaks(kept, table(spark, sf, "benchmark")).collect()}
        else:
            words = sum(len(r["text"].split()) for r in made.collect())
            assert words == sum(r["taken"] for r in mixing.mix(kept).collect())
        kept = made
    want = expected([(r["doc_id"], r["text"]) for r in kept.collect()])
    got = sorted(map(tuple, cp.run(spark, sf).collect()), key=lambda r: r[1])
    assert sorted(r[:1] + r[2:] for r in got) == sorted(r[:1] + r[2:] for r in want) and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()


def test_queries_are_whole(spark, sf):
    for name, want in (("op1_simhash_pivots", "documents"), ("op8_dac_tokens", "documents"), ("op7_redirect_rules", "pages"), ("op10_line_winnow", "documents")):
        got = queries.queries()[name](spark, sf)
        assert got.count() == spark.read.parquet(f"{sf}/{want}.parquet").count()
