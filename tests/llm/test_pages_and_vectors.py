import base64
import hashlib
import io
import random

import numpy as np
import pytest

from tessera.llm import page_diff, sorted_passes, warc_dict


def brute_links(rows, least=0.93):
    good = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / max(map(abs, v))
            good[n] = v / np.linalg.norm(v)
    links = {n: {m for m in good if m != n and rows[m][2] == rows[n][2] and len(good[m]) == len(good[n]) and good[n] @ good[m] >= least} for n in good}
    return good, links


def _vectors(n=1500, groups=60, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dim))
    rows = []
    for i in range(n):
        g = int(rng.integers(groups)) if i % 2 else None
        v = rng.standard_normal(dim) if g is None else centre[g] + 0.15 * rng.standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(g % 3 if g is not None else rng.integers(3))))
    rows += [(2000 + i, rows[1][1], rows[1][2]) for i in range(40)]  # equal vectors
    rows += [(3000, None, 1), (3001, [0.0] * dim, 1), (3002, [float("nan")] + [1.0] * (dim - 1), 1), (3003, [None] + [1.0] * (dim - 1), 1),
             (3004, rows[1][1], None), (3005, [1.0, 0.0], 1), (3006, [2.0, 0.0], 1), (None, rows[1][1], rows[1][2]), (3007, [], 1),
             (3008, [float("inf")] * dim, 2), (3009, [1e-200] * dim, 2), (3010, [1e200] * dim, 2)]
    return rows


def test_links_and_components_against_brute_force(spark):
    rows = _vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, node string, size int").repartition(4)
    got = {r["vec_id"]: r for r in sorted_passes.near_duplicates(df, block=64).collect()}
    good, links = brute_links(rows)
    root = {n: n for n in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n in links:
        for m in links[n]:
            x, y = sorted((find(n), find(m)), key=lambda k: rows[k][0])
            root[y] = x
    found = sum(min(got[rows[n][0]]["n_links"], len(links[n])) for n in good)
    assert found >= 0.97 * sum(map(len, links.values())) and all(got[rows[n][0]]["n_links"] <= len(links[n]) for n in good)
    same = np.mean([got[rows[n][0]]["component_id"] == rows[find(n)][0] for n in good])
    assert same > 0.99
    for n, r in enumerate(rows):
        if n not in good:
            assert (got[r[0]]["n_links"], got[r[0]]["component_id"]) == (0, r[0])
    assert all(r["kept"] == (i is not None and i == r["component_id"]) for i, r in got.items())


def test_passes_follow_the_size_of_a_label(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 800, 2):  # pairs at cosine 0.935, all of one label
        y = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.935 * x[i] + np.sqrt(1 - 0.935 ** 2) * y / np.linalg.norm(y)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r for r in sorted_passes.near_duplicates(df, passes=4, window=2).collect()}
    links = int((x @ x.T >= 0.93).sum()) - len(x)
    assert links == 800
    found, dropped = sum(r["n_links"] for r in got.values()), sum(not r["kept"] for r in got.values())
    assert 0.95 * links <= found <= links and 0.95 * 400 <= dropped, (found, dropped)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert sorted_passes.near_duplicates(df).count() == 0


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, sha int, winner string").repartition(3)


def test_archives_round_trip(spark):
    r = random.Random(2)
    rows = [(i, f"http://h/{i % 7}", "<p>" + " ".join(r.choice(["alpha", "béta", "gamma", "δ"]) for _ in range(r.randint(0, 200)))) for i in range(120)]
    rows += [(200 + i, f"http://x/{i}", rows[3][2]) for i in range(5)] + [(300, None, None), (301, "a\r\nWARC-Type: x", ""), (302, "", None), (None, "u", rows[3][2]),
             (3, "again", rows[3][2]), (4, "other text", "zz"), (303, "u", "\x00\x01" * 100_000)]
    got = warc_dict.archive(_pages(spark, rows)).collect()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        again = i is not None and i > first[t or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[t or ""] if again else None))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(want, key=key)


def test_small_payloads_are_responses_from_a_bound_on(spark):
    got = warc_dict.archive(_pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), min_revisit=3)
    assert {r["page_id"]: r["record_type"] for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark):
    none = _pages(spark, [(1, "u", "x")]).limit(0)
    assert warc_dict.archive(none).count() == 0 and page_diff.extract(none).count() == 0


def test_dictionary_leads_the_archive_and_is_needed():
    import zstandard
    records = [warc_dict.record(i, "http://host/some/path", b"<html><body>the same template " * 3 + str(i).encode(), "S", None, False) for i in range(200)]
    dictionary = warc_dict.train(records)
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    raw = warc_dict.leading_frame(dictionary) + b"".join(pack.compress(x) for x in records)
    out = list(warc_dict.read_records(io.BytesIO(raw)))
    assert len(dictionary) > 0 and len(out) == 200 and out[7][1].endswith(b"7") and out[7][0]["WARC-Record-ID"] == "<urn:x-page:7>"
    plain = sum(len(zstandard.ZstdCompressor().compress(x)) for x in records)
    assert len(raw) - len(dictionary) < plain / 2
    with pytest.raises(ValueError):
        list(warc_dict.read_records(io.BytesIO(raw[:-5])))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">menu {0}</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad-box">buy</div>
<article><header><h1>Head &amp; {0}</h1></header><p><b>One   two<br>three&nbsp;four &lt;x&gt;<p>Second {0}</p><aside>more</aside><ul><li>item</ul>
<div id="comments"><p>first!</p><div>x</div></div><form><input name=q> go</form><pre>a
  b</pre></article><footer>&copy; foot</footer>"""


def test_article_text():
    lines, inside = page_diff.blocks(PAGE.format(7))
    assert [x for x, i in zip(lines, inside, strict=True) if i] == ["Head & 7", "One two three four <x>", "Second 7", "item", "a b"]


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p class="share-price">Shares rose</p><div id="comments-on-war">War</div><div class="comment-list">c</div><div id="disqus_thread">d</div></article>',
     ["Shares rose", "War"]),
    ("<article><p>One</p><aside>note<p>Two</p></article><article><p>Three</p></article>", ["One", "Three"]),
    ("<article><p>One</p><div><form>ask<div>x</div><input></div><p>Two</p></article><footer>f</footer>", ["One", "Two"]),
    ('<article><section><div class="ad"><div>x</div>y</section><p>Two</p></article>', ["Two"]),
    ("<article><ul><li>a<aside>n<li>b</li></aside></li><li>c</ul></article>", ["a", "c"]),
    ("<nav><div>open<article><p>One</p></article>", ["One"]),
])
def test_boilerplate_ends_with_what_is_around_it(page, text):
    lines, inside = page_diff.blocks(page)
    assert [x for x, i in zip(lines, inside, strict=True) if i] == text


def test_near_copies_on_a_host_keep_their_text(spark):
    body = "".join(f"<p>Paragraph {i} of a long text that both pages hold.</p>" for i in range(6))
    rows = [(1, "http://a.org/x/1", f"<div>Menu</div>{body}<p>Left end</p>"), (2, "http://a.org/x/2", f"<div>Menu</div>{body}<p>Right end</p>"),
            (3, "http://b.org/x/1", f"<div>Menu</div>{body}<p>Left end</p>"), (4, "http://b.org/x/2", f"<div>Menu</div>{body}<p>Right end</p>"),
            (5, "http://b.org/x/3", "<div>Menu</div><p>Another text altogether.</p>")]
    got = {r["page_id"]: r["text"].split("\n") for r in page_diff.extract(_pages(spark, rows)).collect()}
    assert len(got[1]) == len(got[2]) == 8 and got[1][0] == "Menu" and got[5] == ["Another text altogether."]
    assert len(got[4]) == 7 and got[4][0].startswith("Paragraph 0") and len(got[3]) == 8  # 3 has the copy for its only neighbour


def test_alignment_of_long_pages_is_bounded():
    a, b = list(range(3_000)), [x for x in range(3_000) if x % 3] + [5] * 2_000
    on = page_diff.shared(a, b)
    assert sum(on) == 2_000 and not any(on[::3])


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p <b>x", "<!-- open", "<script>never closed", "<article><nav>open<p>x", "a &#xD800; &bogus; b" * 3, "<nav>x<article>y",
                                  "<p>" * 5000 + "x", "'\"" * 4000 + "<a '" * 2000])
def test_malformed_pages(page):
    lines, inside = page_diff.blocks(page)
    assert len(lines) == len(inside) and all(x == " ".join(x.split()) and x for x in lines)


def test_shared_blocks_of_near_urls_are_deleted(spark):
    page = lambda i: f"<body><div>Top banner line</div><div>Text {i} a</div><p>Text {i} b</p><div>All rights</div></body>"
    rows = [(i, f"http://www.Host.org/sec{i % 3}/{i}.html?x={i}#f", page(i)) for i in range(30)]
    rows += [(50, "http://alone.org/", page(50)), (51, None, page(51)), (52, "http://[bad", page(52)), (None, "http://host.org/sec1/zz", page(53)),
             (60, "http://copies.org/a", page(60)), (61, "http://copies.org/b", page(60)), (62, "http://h2.org/a", PAGE.format(1)), (63, "http://h2.org/b", PAGE.format(1)),
             (64, "http://h3.org/", None)]
    got = {r["page_id"]: r for r in page_diff.extract(_pages(spark, rows)).collect()}
    assert all(got[i]["text"] == f"Text {i} a\nText {i} b" for i in range(30)) and got[None]["text"] == "Text 53 a\nText 53 b"
    assert all(got[i]["text"].startswith("Top banner line") for i in (50, 51, 52, 60, 61))
    assert got[62]["text"] == got[63]["text"] != "" and got[64]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_pages_with_an_article_are_aligned_too(spark):
    page = lambda i: f"<div>Top</div><article><h1>Head {i}</h1><p>Quote.</p><p>Text {i}</p></article>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in (1, 2, 2)] + [(9, "http://b.org/", page(9))]
    got = sorted((r["page_id"], r["text"], r["n_shared"]) for r in page_diff.extract(_pages(spark, rows)).collect())
    text = lambda i: f"Head {i}\nQuote.\nText {i}"
    assert got == [(1, text(1), 2), (2, text(2), 2), (2, text(2), 2), (9, text(9), 0)]


def test_blocks_beside_an_article_are_judged_by_the_neighbour(spark):
    nav = "<nav><ul><li>Home<li>News</ul></nav>"
    page = lambda i: f"{nav}<div>All stories</div><h1>Head {i}</h1><article><p>Quote.</p><p>Text {i}</p></article><p>Coda {i}</p><div>Since 1901</div>"
    rows = [(i, f"http://a.org/x/{i}", page(i)) for i in range(6)]
    rows += [(20, "http://alone.org/", page(20)), (21, None, page(21))]  # no neighbour
    rows += [(30 + i, f"http://other.org/{i}", f"<div>Line {i}</div><article><p>Text {i}</p></article>") for i in range(2)]  # nothing in common
    rows += [(40 + i, f"http://copies.org/{i}", page(40) + "<i>x</i>" * i) for i in range(2)]
    rows += [(50, "http://near.org/a/1", page(50)), (51, "http://near.org/a/2", page(50)), (52, "http://near.org/b", page(52))]
    got = {r["page_id"]: (r["text"].split("\n"), r["n_shared"]) for r in page_diff.extract(_pages(spark, rows)).collect()}
    text = lambda i: [f"Head {i}", "Quote.", f"Text {i}", f"Coda {i}"]
    assert all(got[i] == (text(i), 3) for i in range(6))
    assert got[20] == (["Quote.", "Text 20"], 0) and got[21] == (["Quote.", "Text 21"], 0)
    assert got[30] == (["Text 0"], 0) and got[31] == (["Text 1"], 0)
    assert got[40] == (["Quote.", "Text 40"], 6) and got[41][0][:2] == ["Quote.", "Text 40"]
    assert got[50] == (["Quote.", "Text 50"], 6) and got[51] == (text(50), 6) and got[52] == (text(52), 3)  # 51 is judged by 52, which is no copy


def test_containers_in_doubt_are_judged_by_the_neighbour(spark):
    page = lambda i, j: (f'<article><p>Quote.</p><div class="newsletter-signup-a"><p>Join us</p><p>It is free</p></div><p>Text {i}</p>'  # noqa: E731
                         f'<section id="comments-on-war"><h2>War</h2><p>Own {j}</p></section><p>Join us</p><p class="share-price">Shares rose</p></article>')
    got = {r["page_id"]: r["text"].split("\n") for r in page_diff.extract(_pages(spark, [
        (1, "http://a.org/1", page(1, 1)), (2, "http://a.org/2", page(2, 2)), (3, "http://b.org/1", page(3, 3))])).collect()}
    text = lambda i: ["Quote.", f"Text {i}", "War", f"Own {i}", "Join us", "Shares rose"]
    assert got[1] == text(1) and got[2] == text(2) and got[3] == ["Quote.", "Join us", "It is free", *text(3)[1:]]


def test_regions_of_all_blocks():
    page = ('<nav><ul><li>Home<li>News</ul></nav>Top<article>One<div class="ad">buy<br>now</div><div class="promo-x">a<div>b</div></div>Two'
            '<section id="share-y"><p>c</section>Three</article><p>End <span class="ad">x</span> of it<footer>f')
    n, o, a, d = page_diff.NAMED, page_diff.OPEN, page_diff.ARTICLE, page_diff.DOUBT
    assert [*zip(*page_diff.regions(page), strict=True)] == [
        ("Home", n), ("News", n), ("Top", o), ("One", a), ("buy now", n), ("a", d), ("b", d), ("Two", a), ("c", d + 1), ("Three", a),
        ("End", o), ("x", n), ("of it", o), ("f", n)]


def test_shared_is_a_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 10))] for _ in range(2))
        on = page_diff.shared(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        picked, j = [x for x, s in zip(a, on, strict=True) if s], 0
        for x in picked:
            j = b.index(x, j) + 1
        assert len(picked) == best[-1][-1]
