"""Page text, archives and vectors against plain Python."""

import time
import math
import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import archives, html_text, itq
from ladderline.llm.common import components

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><!-- <p>no</p> --><header><h2>Site</h2></header>
<div class="cookie-notice">We use cookies on this site to improve what you see here today.</div>
<article><header><h1>A &amp; B&nbsp;title</h1></header><p>First   para<b>graph</b>
of text&#33; It has a <a href="x">link</a>.<p>Short.<br>Line<div class="ad">Buy</div><ul><li>item one<li>item two</ul>
<form><label>Name</label><input></form><section id="comments"><p>A reader says something long enough to look like text.</p></section>
<p>Last &lt;b&gt; &am</article><aside>Side</aside><footer>&copy; foot</footer></body></html>"""
PAGE_TEXT = "A & B title\nFirst paragraph of text! It has a link.\nShort. Line\nitem one\nitem two\nLast <b> &am"


def test_main_text():
    assert html_text.main_text(PAGE) == PAGE_TEXT
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>  </p>") == ""
    assert html_text.main_text("<![foo[ <article><p>x y</p></article>").endswith("x y")
    assert html_text.main_text("<article><p>open text & more &lt") == "open text & more <"


def test_unmarked_page_by_ratio():
    links = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(12))
    body = "".join(f"<p>{'words of a long paragraph ' * 8}{i}</p>" for i in range(5))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Head</h1>{body}</div><div><ul>{links}</ul></div></body>"
    found = html_text.main_text(page).split("\n")
    assert found[0] == "Head" and len(found) == 6


def test_teaser_articles_beside_a_body_in_plain_elements():
    body = "".join(f"<p>{'words of a long paragraph ' * 12}{i}</p>" for i in range(6))
    teasers = "".join(f'<article><h3><a href="/{i}">Teaser {i}</a></h3><p>Short text {i}.</p></article>' for i in range(4))
    for page in (f"<body><div><h1>Head</h1>{body}</div><div>{teasers}</div></body>", f"<body><div>{teasers}</div><div><h1>Head</h1>{body}</div></body>"):
        found = html_text.main_text(page).split("\n")
        assert [x for x in found if "Teaser" not in x and "Short text" not in x][0] == "Head"
        assert sum("long paragraph" in x for x in found) == 6 and not any("Teaser" in x for x in found)
    links = "".join(f'<li><a href="/{i}">Topic number {i}</a></li>' for i in range(12))
    page = f"<body><article><h1>Head</h1>{body}<div><ul>{links}</ul></div></article></body>"
    found = html_text.main_text(page).split("\n")
    assert found[0] == "Head" and len(found) == 7


def test_deep_and_long_pages_are_linear():
    assert html_text.main_text("<div>" * 50_000 + "text" + "</p>" * 50_000) == "text"
    assert len(html_text.main_text("<article>" + "<p>a</p>" * 100_000)) == 199_999


def pages(spark):
    long = "<p>" + "x" * 1200 + "</p>"
    found = [(1, "http://a b/é", PAGE), (2, None, None), (3, "", ""), (4, "u", long), (9, "u", long), (7, "v", long), (5, "s", "short"), (6, "s", "short"),
             (None, "n", long), (8, "w", "line\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n\x00" + "y\n" * 900), (9, "u", long)]
    return found, spark.createDataFrame([(*r, 1, "t") for r in found], "page_id long, url string, html string, payload_bytes int, text string").repartition(4)


def test_extraction_of_a_table(spark):
    found, table = pages(spark)
    got = html_text.extracted(table).collect()
    assert len(got) == len(found) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 1} == {PAGE_TEXT}
    assert html_text.extracted(table.where("false")).count() == 0


def test_archives_round_trip(spark, tmp_path):
    found, table = pages(spark)
    got = archives.archived(table)
    want = Counter()
    for page_id, url, html in found:
        data = (html or "").encode()
        same = [p for p, _, h in found if p is not None and (h or "") == (html or "")]
        again = len(data) >= 1000 and page_id is not None and page_id != max(same)
        want[(page_id, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None)] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    assert archives.archived(table.where("false")).count() == 0
    # on disk: WARC files by the book, revisits without payload
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    archives.write_arc(table, arc)
    archives.convert(spark, arc, warc)
    kinds, names = Counter(), set()
    for file in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        for headers, block in archives.parse_warc(data):
            kinds[headers["warc-type"]] += 1
            if headers["warc-type"] == "response":
                assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", headers["warc-record-id"]) and headers["warc-date"] == "2020-01-01T00:00:00Z"
                assert headers["warc-block-digest"] == archives._base32(hashlib.sha1(block).hexdigest())
            if headers["warc-type"] == "revisit":
                names.add(headers["warc-refers-to"])
                assert block.endswith(b"\r\n\r\n")
    assert kinds["revisit"] == 2 and len(names) == 1 and kinds["response"] == 9


@pytest.mark.parametrize("version", [1, 2])
def test_arc_header_lines(version):
    data = archives.version_block(version, "a.arc") + b"\n" + archives.arc_record(version, "http://x/a b", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nhi\n", "a.arc") + b"\n"
    for form in (data, gzip.compress(data), gzip.compress(data[:40]) + gzip.compress(data[40:])):
        (record,) = archives.parse_arc(form)
        assert record["url"] == "http://x/a%20b" and record["archive-date"] == "20010203040506" and record["block"].endswith(b"hi\n")
        assert ("result-code" in record) == (version == 2)
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-8]))
    with pytest.raises(ValueError):
        list(archives.parse_arc(b"http://x 1 2 3 4\nabcd"))


def plain(found, cosine=0.98):
    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])

    parent = {r[0]: r[0] for r in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(found)
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            if i < j and usable(a) and usable(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], np.float32).astype(float), np.array(b[2], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(a[0]), find(b[0])
                    parent[max(p, q)] = min(p, q)
    return Counter((r[0], n, find(r[0]) if r[0] is not None else None, r[0] is not None and find(r[0]) == r[0]) for r, n in zip(found, links))


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    found = [(i, i % 3, rng.normal(size=32).tolist()) for i in range(90)]
    hub = rng.normal(size=32)
    found += [(100 + i, 1, (hub + rng.normal(size=32) * 0.1).tolist()) for i in range(60)]
    found += [(200 + i, 2, hub.tolist()) for i in range(5)] + [(210, 2, (2 * hub).tolist()), (211, 2, (-hub).tolist())]
    found += [(300, None, hub.tolist()), (301, 2, None), (302, 2, [0.0] * 32), (303, 2, [float("nan")] * 32), (304, 2, [None] * 32), (305, 2, hub[:8].tolist()),
              (306, 2, [float("inf")] + [1.0] * 31), (307, 2, []), (None, 2, hub.tolist()), (200, 2, hub.tolist())]
    table = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in found], "vec_id long, label int, embedding array<float>, code int, n int").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(table).collect())
    assert got == plain(found)
    assert itq.near_duplicates(table.where("false")).count() == 0


def test_blocks_of_one_code(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 4)
    rng = np.random.default_rng(4)
    hub = rng.normal(size=16)
    found = [(i, 0, (hub + rng.normal(size=16) * 0.004).tolist()) for i in range(60)] + [(100 + i, 0, rng.normal(size=16).tolist()) for i in range(40)]
    table = spark.createDataFrame(found, "vec_id long, label int, embedding array<float>")
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(table).collect()) == plain(found)


def test_recall_on_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(rows).collect()}
    data = rows.toPandas()
    x = np.stack(data.embedding.values).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & (data.label.values[:, None] == data.label.values[None])
    np.fill_diagonal(linked, False)
    assert sum(got.values()) >= 0.9 * linked.sum() and all(got[v] <= n for v, n in zip(data.vec_id, linked.sum(axis=1)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (202, 201), (202, 203), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200, 202: 200, 203: 200}
    assert components(spark.createDataFrame([], "u long, v long"), "t").select(F.count("*")).first()[0] == 0


BODY = "".join(f"<p>{'word ' * 40}number {i}.</p>" for i in range(6))
BODY_TEXT = "\n".join(f"{'word ' * 40}number {i}." for i in range(6))


@pytest.mark.parametrize("wrapper", [
    '<div class="has-sidebar">%s</div>', '<div class="no-banner">%s</div>', '<div class="social-science">%s</div>',
    '<div class="content share">%s</div>', '<div class="post-comments-wrapper">%s</div>', '<div id="related-work">%s</div>',
    '<article class="post comments-open">%s</article>'])
def test_a_name_does_not_empty_a_page(wrapper):
    assert html_text.main_text("<html><body>" + wrapper % BODY + "</body></html>") == BODY_TEXT


def test_named_parts_go_even_where_they_are_long():
    reply = "<article class='comment-body'><p>" + "reply text " * 300 + "</p></article>"
    page = f"<body><div class='cookie-banner'><p>{'we use them ' * 9}</p></div><article>{BODY}<div class='share'>tell all your friends</div></article>"
    page += f"<div class='comments'>{reply * 3}</div><div class='site-footer'><p>Copyright by all of us</p></div></body>"
    assert html_text.main_text(page) == BODY_TEXT


@pytest.mark.parametrize("head", ["", "<table><tr><td><div>"])
def test_unclosed_items_take_linear_time(head):
    def seconds(n):
        start = time.process_time()
        html_text.main_text(head + "<b>" * n + "<td>x" * n)
        return time.process_time() - start

    assert seconds(8_000) < 2 and seconds(32_000) < 12 * max(seconds(8_000), 0.02)


def test_ratios_and_clusters_by_loops():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        x = rng.gamma(1.0, 30.0, n)
        reach, wanted = int(3 * html_text.SIGMA + 0.5), []
        for i in range(n):
            near = [(math.exp(-0.5 * ((j - i) / html_text.SIGMA) ** 2), x[j]) for j in range(n) if abs(j - i) <= reach]
            wanted.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        assert np.allclose(html_text.smoothed(x), wanted)
        cut = sum(x) / n
        for _ in range(32):
            high, low = [v for v in x if v > cut], [v for v in x if v <= cut]
            if not high or not low:
                break
            cut = (sum(high) / len(high) + sum(low) / len(low)) / 2
        assert html_text.threshold(x) == pytest.approx(cut)


@pytest.mark.parametrize("dim", [16, 32, 64, 128])
def test_codes_of_few_dimensions_use_all_bits(dim):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, dim))
    unit = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True)
    noise = rng.normal(size=unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    cosine = rng.uniform(0.98, 1, size=(300, 1))
    near = cosine * unit + np.sqrt(1 - cosine ** 2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    mean, projection = itq.learn(x)
    a, b = (itq.codes(v, mean, projection).view(np.uint64) for v in (x, near))

    def meet(one, other):
        both = one ^ other
        parts = [(both >> np.uint64(itq.PART * t)) & np.uint64((1 << itq.PART) - 1) for t in range(itq.TABLES)]
        return np.any([np.bitwise_count(p) <= 1 for p in parts], axis=0) & (np.bitwise_count(both) <= itq.MAX_DISTANCE)

    assert meet(a[:300], b).mean() >= 0.95
    assert sum(meet(a[i], a[i + 1:]).sum() for i in range(len(a) - 1)) < 5_000  # of 1,124,250 pairs
