"""Mixing, WARC and URL rules against brute force."""

import hashlib
import re
from base64 import b32encode
from collections import Counter
from fractions import Fraction

import pytest

from arbora.llm import mixing, url_filters, warc

PAGES = "page_id long, url string, html string"


def fair_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: Fraction(3 * sizes[s]) for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("parts", [1, 4])
def test_mix(spark, parts):
    rows = [(i, " ".join(["w"] * ((i * 7) % 90)), ["a", "b", "a", "a", None, "c"][i % 6] if i < 900 else "tiny") for i in range(912)]
    rows += [(5, None, "b"), (None, "one two", "b"), (7, "x y", "b"), (7, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fair_targets(sizes)
    taken, target = Counter(), {}
    by_size = {v: k for k, v in sizes.items()}
    for r in got:
        s = by_size[r["source_size"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
    for s in sizes:
        assert target[s] == pytest.approx(float(want[s])) and abs(taken[s] - target[s]) <= max(120, 0.03 * target[s])
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_documents_agree_with_mix(spark):
    rows = [(i, f"t{i} " * (i % 40), "ab"[i % 2], "q") for i in range(300)] + [(3, None, "a", "q"), (9, "s s", "a", "q"), (9, "s s", "a", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    made = mixing.mixed_documents(df)
    assert made.columns == df.columns
    words = sum(len((r["text"] or "").split()) for r in made.collect())
    assert words == sum(r["taken"] for r in mixing.mix(df).collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_offsets_are_exact_at_the_limit(spark):
    df = spark.createDataFrame([(i, "w", "big" if i else "s") for i in range(2000)], "doc_id long, text string, source string")
    assert max(r["taken"] for r in mixing.mix(df).collect()) <= 3


def page_rows():
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(40)]
    rows += [(100, "http://x/y z\n", inner * 3), (101, None, "tail\r\n\r\n"), (102, "u", None), (103, "u", ""), (104, "u", "é" * 50_000), (105, "u", inner + "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (None, "n", "only null"), (None, "n", "<p>1</p>")]
    return rows


def brute_pages(rows, at_least):
    by = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= at_least:
            by[b] = min(i, by.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = by.get(b) if len(b) >= at_least else None
        again = first is not None and first != i
        out.append((i, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("block", "file_bytes", "at_least"), [(1 << 20, 1 << 20, 0), (2500, 1 << 20, 20)])
def test_warc_round_trip(spark, tmp_path, block, file_bytes, at_least):
    rows = page_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES + ", off long, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, at_least, file_bytes)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        blocks = warc.candidates(spark, path).where("off is null").groupBy("file").count().collect()
        got = spark.createDataFrame(warc.read_archives(spark, path).collect(), "file string, off long, succ long, page_id long, url string, payload_bytes long, payload_digest string, stated_digest string, record_type string, refers_to long")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # small blocks cut each file into many tasks' parts
    assert block > 1 << 19 or max(r["count"] for r in blocks) > 3
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == brute_pages(rows, at_least)
    assert got.where("record_type = 'response' and payload_digest <> stated_digest").count() == 0
    # the candidates hold the false records that the chain rejects
    assert warc.candidates(spark, path).where("page_id = 777").count() > 0


def test_warc_long_urls_and_whole_chains(spark, tmp_path):
    urls = {1: "http://a.org/x", 2: "http://a.org/" + " " * 500_000, 3: "http://a.org/" + "y" * 1_500_000, 4: "http://a.org/z", 5: None}
    df = spark.createDataFrame([(k, u, f"<p>{k}</p>") for k, u in urls.items()], PAGES).coalesce(1)
    got = {r["page_id"]: r["url"] for r in warc.archived(df).collect()}
    assert got == {k: u and u.replace(" ", "%20") for k, u in urls.items()}
    good = warc.record(1, "u", b"abc", 3, "X", None, False) + warc.BREAK
    for name, content in (("middle", good + b"garbage" + good), ("start", b"garbage" + good), ("end", good + good[:-9])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(content)
        with pytest.raises(ValueError, match="breaks off"):
            warc.read_archives(spark, f"file://{tmp_path}/{name}", whole=True)


def test_warc_broken_chain_and_empty(spark, tmp_path):
    good = warc.record(1, "u", b"abc", 3, "X", None, False) + warc.BREAK
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(good + b"garbage" + good)
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 1
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_base32(spark):
    df = spark.createDataFrame([(b,) for b in (b"", b"a", b"\x00\xff" * 99)], "b binary").select("b", warc.base32_sha1("b").alias("d"))
    assert all(r["d"] == b32encode(hashlib.sha1(bytes(r["b"])).digest()).decode() for r in df.collect())


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    "http://a.example.org/es/x", "http://EXAMPLE.org/en/12?q#f", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/en/1", "http://notexample.org/es/", "ftp://com/de/", "http://net", "http://org", "http://x.com?/de/",
    "no scheme", None, "", "://org/", "http://h/://com/de/", "http://Ünï.org/p", "http://x.com/en/alias", "http://x.com/fr/alias", "http://x.com/lone", "https://x.com/en/alias#frag", "http://b.net/r?a=1",
]
EDGES = [("http://x.com/en/alias", "http://x.com/de/9"), ("http://x.com/fr/alias", "http://x.com/de/9"), ("http://b.net/r?a=1", "http://x.com/en/alias"), (None, "http://x.com/de/1"), ("bad", "http://x.com/de/1")]


def split_url(u):
    if u is None or "://" not in u:
        return "", "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    q = re.match(r"[^?#]*(\?[^#]*)?", rest)[1] or ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, path, host + path + q


def judge(urls, edges, rules):
    def rule(host, path):
        fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    groups = []
    for a, b in edges:
        k = {split_url(a)[2], split_url(b)[2]} if a and b else set()
        if len(k) == 2 and "" not in k:
            for g in [g for g in groups if g & k]:
                k |= g
                groups.remove(g)
            groups.append(k)
    bad = {k for g in groups for k in g if any(rule(*re.match(r"([^/?#]*)([^?#]*)", x).groups())[1] == "block" for x in g)}
    out = []
    for u in urls:
        host, path, key = split_url(u)
        name, act = rule(host, path)
        out.append((host, path, name, act or ("block" if key in bad else "allow")))
    return sorted(map(repr, out))


@pytest.mark.parametrize("many", [False, True])
def test_urls(spark, many):
    rules = RULES + ([("block", f"h{k}.test", "/") for k in range(url_filters.IN_PLACE)] if many else [])
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, key string")
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = url_filters.judged(df, edges, rules).collect()
    assert sorted(repr(tuple(r)[1:]) for r in got) == judge(URLS + URLS[:3], EDGES, rules)
    bare = url_filters.judged(df, edges.limit(0), rules).collect()
    assert sorted(repr(tuple(r)[1:]) for r in bare) == judge(URLS + URLS[:3], [], rules)
    assert url_filters.judged(df.limit(0), edges, rules).count() == 0


def test_links_in_pages(spark):
    html = [
        '<link rel="canonical" href="http://x.com/de/1">', "<LINK href='/root?a=1&amp;b=2' rel=canonical>", '<meta http-equiv="refresh" content="0; url=next.html">', '<link rel="stylesheet" href="/a.css">', None, '<link rel=canonical href="//other.net/z">',
    ]
    df = spark.createDataFrame([(i, "https://h.org/dir/page?q=1", h) for i, h in enumerate(html)], PAGES)
    assert {r["dst"] for r in url_filters.links_in(df).collect()} == {"http://x.com/de/1", "https://h.org/root?a=1&b=2", "https://h.org/dir/next.html", "https://other.net/z"}
    assert url_filters.links_in(df.limit(0)).count() == 0
