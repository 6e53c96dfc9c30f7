"""op3 and op9: extraction against known articles, archives against a round trip."""

import base64
import hashlib
import random

import pytest

from compare import spark_rows, sql_rows
from foliant.llm import html, registry, warc


def text_of(page):
    lines = html.page_lines(page)
    return html.main_text([p for p, _ in lines], [t for _, t in lines], [], [])


def test_article_with_everything_around():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="nav-open"><header>Site</header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-banner">We use cookies</div><div class=ad>Buy</div><aside>More</aside>
    <article><h1>A &amp; B</h1><p>One <b>bold</b>\n word&nbsp;here.<br>Next<p>Unclosed &lt;tag&gt; <!-- no --><form><input>Mail</form><div class="related">Also</div><p hidden>gone</p><section id="comments"><p>nice</p></section></article>
    <footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "A & B One bold word here. Next Unclosed <tag>"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</div></p>"])
def test_broken_pages(page):
    assert text_of(page) == ""


def test_plain_text_and_cut_tags():
    assert text_of("just text") == "just text"
    assert text_of("<p>a</p><p cla") == "a"
    assert text_of("<nav>menu<article><p>body</p>") == "body"


def test_neighbours_delete_shared_lines(spark):
    page = lambda body: f"<html><body><div>Site name</div>{body}<div>All about us</div></body></html>"
    rows = [(i, f"http://www.h.com/a/{i}", page(f"<p>own {i}</p>"), "x") for i in range(30)] + [(90, "http://other.org/", page("<p>alone</p>"), "x"), (91, None, None, "x"), (92, "::", "<p>odd</p>", "x"), (5, "http://h.com/a/5", page("<p>own 5</p>"), "again")]
    got = {(r.page_id, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    want = {(i, f"own {i}") for i in range(30)} | {(90, "Site name alone All about us"), (91, ""), (92, "odd")}
    assert {(i, t) for i, t, _ in got} >= want - {(5, "own 5")}
    assert all(n == len(t) for _, t, n in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        got = html.common_lines(a, b)
        assert got == sorted(set(got)) and len(got) == brute_lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_archives(spark, tmp_path):
    long = "".join(chr(0x20 + i % 900) for i in range(200_000)) + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "http://c", None), (4, "u", ""), (5, "u", long), (6, "u", long), (6, "u", long), (None, "n", "x"), (7, "é", "é\U0001f600")]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload).decode(), r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    one = lambda i, t, to=None: (i, "revisit" if to else "response", to, None if to else t, len(t.encode()), digest(t))
    assert got == sorted([one(1, "x", 2), one(2, "x"), one(3, "", 4), one(4, ""), one(5, long, 6), one(6, long), one(6, long), one(-1, "x"), one(7, "é\U0001f600")])


def test_chunks():
    payload = "é" * 20_000
    body = "".join(warc.chunked(payload)).encode()
    assert warc.decode_chunked(body) == payload.encode()
    with pytest.raises(ValueError):
        warc.decode_chunked(body[:-20])


@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns, want = sql_rows(registry.SQL[name], sf_dir)
    assert sorted(df.columns) == columns and spark_rows(df) == want


def test_archives_name_records_and_are_checked(spark, tmp_path):
    path = "file://" + str(tmp_path / "warc")
    long = "long text " * 40_000
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, "v", long), (3, "v", long), (4, "w", long), (None, "n", long), (None, "n", long), (None, None, None), (None, None, None)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    records = [r for f in (tmp_path / "warc").glob("*.gz") for r in warc.split_records(warc.unpacked(f.read_bytes()))]
    ids = {h["WARC-Record-ID"] for h, _ in records}
    named = [h["WARC-Record-ID"] for h, _ in records if "none-" in h["WARC-Record-ID"]]
    assert len(named) == len(set(named)) and all(h["WARC-Refers-To"] in ids for h, _ in records if "WARC-Refers-To" in h)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got) == 3
    assert all(bytes(r.payload).decode() in ("same", long, "") for r in got if r.record_type == "response")
    data = b"".join(x.read_bytes() for x in (tmp_path / "warc").glob("*.gz"))
    assert len(list(warc.split_records(warc.unpacked(data)))) == len(records)
    with pytest.raises(ValueError):
        list(warc.split_records(warc.unpacked(data[:-9])))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"])))
