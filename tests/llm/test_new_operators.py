"""Fill-in-the-middle, main text of pages and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from convmatch.llm import fill_middle, html_extract, merkle, queries
from convmatch.llm.common import row_key, table, written
from convmatch.llm.html_dom import blocks, parse
from tests.compare import differs, duck

from .test_operators import SCHEMA, edge_rows, prose


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_merkle_manifest"])
def test_query_matches_sql(spark, sf, name):
    assert differs(spark, duck(sf), queries.QUERIES[name], queries.ORACLE_SQL[name], sf) is None


# -- fill in the middle


def fim(doc_id, text, seed=1):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:z]), "".join(u[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(u), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), sha(out), sha(text)


def test_fill_in_middle_on_odd_texts(spark):
    r = random.Random(3)
    odd = ["a", "Zq", " ", "\n", "é", "中文", "🙂", "<", "P", ">", "<S", "0", "\x00", "­", "e\u0301"]
    rows = [(i, "".join(r.choice(odd) for _ in range(r.randrange(40)))) for i in range(600)]
    rows += [(None, "null id"), (None, None), (5, None), (6, ""), (7, "has <M> in it"), (8, "same"), (8, "same"), (-9, "x " * 300_000), (10, "y" * 500_000)]
    df = spark.createDataFrame([(i, t, "other", 1.0) for i, t in rows], "doc_id long, text string, form string, n double")
    got = [tuple(x) for x in fill_middle.fill_in_middle(df).collect()]
    assert Counter(got) == Counter(fim(i, t) for i, t in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_gives_texts_and_other_shares(spark):
    df = spark.createDataFrame([(i, prose(i, 30)) for i in range(200)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(df, seed=7, plain_percent=0, spm_percent=100, with_text=True).join(df, "doc_id").collect():
        s, rest = r["output"][3:].split("<P>")
        p, m = rest.split("<M>")
        assert r["form"] == "spm" and p + m + s == r["text"] and len(p) == r["prefix_chars"] and len(m) == r["middle_chars"]


# -- main text of pages


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html,want",
    [
        ("", []),
        ("just &lt;text&gt; &amp; more", ["just <text> & more"]),
        ("<p>a<p>b<div>c<br>d</div>", ["a", "b", "c d"]),
        ("<article><h1>T</h1><p><b>one.<br><p>two</p></article><footer>f</footer>", ["T", "one.", "two"]),
        ("<p>x<script>var a='</p>';</script>y</p><style>p{}</style><!-- <p>no</p> -->", ["xy"]),
        ("<nav>menu</nav><main><p>kept</p><aside>side</aside><form>mail</form></main><div>out</div>", ["kept"]),
        ("<article><header><h1>T</h1><span>by</span></header><p>x</p><div class='share-bar'>share</div></article>", ["T", "x"]),
        ("<article><p>x</p></article><section id='comments'><article><p>reader</p></article></section>", ["x"]),
        ("<form><main><p>inside a form</p><input></main></form>", ["inside a form"]),
        ("<p title='a > b'>q</p><p title=\"x>y\" class=ad>advert</p>", ["q"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]),
        ("<ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>text with <a href=z>one link</a> in it</p>", ["text with one link in it"]),
        ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("<div hidden>h</div><div style='display: none'>h</div><div class='cookieConsent'>c</div>d", ["d"]),
        ("a < b and <3 </ > c", ["a < b and <3 c"]),
        ("<p>unfinished <a href='", ["unfinished"]),
        ("<p>&eacute;&#x4e2d;&nbsp;&nbsp;z &amp &unknown;</p>", ["é中 z & &unknown;"]),
        ("<div>" * 3000 + "deep<p>er</p>" + "</div>" * 3000 + "<p>after</p>", ["deep", "er", "after"]),
        ("<div class=post-content><p>named</p></div><div>other</div>", ["named"]),
    ],
)
def test_blocks_of_a_page(html, want):
    assert blocks(parse(html)) == want


def plain_tree(pages):
    """Composite importances by recursion over one host's different pages."""
    seen = defaultdict(dict)
    for url, html in pages:
        for _, p, path, share, form, _ in html_extract.page_nodes(url, html):
            old = seen[path].get(p, (form, share))
            seen[path][p] = (min(old[0], form), min(old[1], share))

    def own(path):
        n = Counter(f for f, _ in seen[path].values())
        m = len(seen[path])
        if m == 1:
            return 1.0
        if path.endswith("#text"):
            return 1 - sum(math.log(c) for c in n.values()) / len(n) / math.log(m)
        return -sum(c / m * math.log(c / m) for c in n.values()) / math.log(m)

    def composite(path):
        if path.endswith("#text"):
            return own(path)
        damp = 0.9 ** min(100, len({f for f, _ in seen[path].values()}))
        kids = [k for k in seen if k.rpartition("/")[0] == path]
        return (1 - damp) * own(path) + damp * sum(sum(s for _, s in seen[k].values()) / len(seen[path]) * composite(k) for k in kids)

    return {p: (len(seen[p]), composite(p)) for p in seen}


def site(n=12):
    """Pages without a declared main part: a notice and a legal text on all of them."""
    out = []
    for i in range(n):
        text = "".join(f"<p>{prose(100 * i + j, 40)}</p>" for j in range(1 + i % 3))
        out.append(page(f"<div class='top'><p>All prices include tax.</p></div><div class='text'><h2>{prose(i, 4)}</h2>{text}</div><div class='legal'><p>Terms apply.</p></div>"))
    return out


def test_importance_equals_plain_recursion(spark):
    pages = [("http://a.example/1", h) for h in site()] + [("http://b.example/", h) for h in site(2)] + [(None, "<p>x</p>"), ("http://[", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    nodes = written(html_extract.nodes_of(df.select(*row_key("page_id", "html"), "url", "html")))
    tree = html_extract.style_tree(nodes).collect()
    for host in ("a.example", "b.example", ""):
        want = plain_tree([p for p in pages if html_extract.host_of(p[0]) == host])
        got = {r["path"]: (r["pages"], r["importance"], r["best"]) for r in tree if r["host"] == host}
        assert got.keys() == want.keys()
        for path, (m, x) in want.items():
            assert got[path][0] == m and abs(got[path][1] - x) < 1e-8
            assert abs(got[path][2] - max(y for q, (_, y) in want.items() if q == path or q.startswith(path + "/"))) < 1e-8


def test_template_is_removed_and_copies_are_not(spark):
    rows = [(i, f"http://a.example/{i}", h) for i, h in enumerate(site())]
    rows += [(100 + i, "http://a.example/copy", rows[0][2]) for i in range(40)]  # copies of a page
    rows += [(None, "http://a.example/copy", rows[1][2])] * 3 + [(300, None, None), (301, "http://b.example/", site()[5])]
    one = "<article><p>The same passage.</p><p>{}</p></article>"
    rows += [(400 + i, f"http://c.example/{i}", page(one.format(prose(i, 9)))) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = html_extract.extract_main_text(df).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter(r[:2] for r in rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in list(range(12)) + list(range(100, 140)):
        j = i if i < 100 else 0
        assert text[i] == "\n".join([prose(j, 4), *(prose(100 * j + k, 40) for k in range(1 + j % 3))])
    assert text[300] == "" and text[301].startswith("All prices") and text[301].endswith("Terms apply.")
    assert all(text[400 + i] == "The same passage.\n" + prose(i, 9) for i in range(30))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_articles_of_the_table(spark, sf):
    """The table's pages declare an article of one heading and paragraphs."""
    from html import unescape

    want = {}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    assert {r["page_id"]: r["text"] for r in queries.op12_html_extraction(spark, sf).collect()} == want


def test_very_long_pages(spark):
    rows = [(1, "http://a/", "<p>" + "word " * 400_000), (2, "http://a/", "<p x='" * 50_000), (3, "http://a/", "<div class=c1>" * 50_000 + "x"), (4, "http://a/", "<a>" * 100_000 + "</b>" * 100_000)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["n_chars"] for r in got} == {1: 1_999_999, 2: 0, 3: 1, 4: 0}


# -- Merkle manifest


def plain_manifest(rows, fan_out=8, every=3):
    def enc(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, low=False):
        i, text, lang, source, n = r
        if low and text is not None:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return sha("".join(map(enc, (i, source, lang, n, text))))

    def climb(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)]
            levels.append(nodes)
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            first = i - i % fan_out
            out.append((nodes[first:i], nodes[i + 1 : first + fan_out]))
            i //= fan_out
        return out

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = climb([leaf(r) for r in langs[x]])
    over = climb([trees[x][-1][0] for x in order])
    out = []
    for j, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            proof = path(trees[x], i) + path(over, j)
            f = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0)
            for left, right in proof:
                f = sha("".join([*left, f, *right]))
            flat = "".join(d for left, right in proof for d in (*left, *right))
            out.append((r[0], leaf(r), trees[x][-1][0], over[-1][0], sha(flat), f, f == over[-1][0]))
    return Counter(out)


def test_places_in_the_log():
    for fan_out in (2, 3, 8):
        for n in [*range(1, 70), 511, 512, 513]:
            height = merkle.height_of(n, fan_out)
            log = merkle.append_log([sha(str(i)) for i in range(n)], fan_out, height)
            nodes, level = [sha(str(i)) for i in range(n)], 0
            while True:
                assert [log[merkle.node_place(level, j, n, fan_out)] for j in range(len(nodes))] == nodes
                if len(nodes) == 1:
                    break
                nodes, level = [sha("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)], level + 1
            assert level == height


@pytest.mark.parametrize("fan_out,levels", [(8, 4), (2, 1), (3, 2)])
def test_manifest_against_plain_trees(spark, fan_out, levels):
    rows = [(i * 7 % 501, prose(i, 6) if i % 5 else prose(i, 6).lower(), ["en", "de", None, "", "é", "z" * 40][i % 11 % 6], "s", i) for i in range(500)]
    rows += [(3, "Same", "en", None, None)] * 70 + [(None, None, "one", None, 1), (None, "A", None, "x", 2), (9001, "", "de", "", 0), (-5, "Neg", "de", "s", 3)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string")
    got = Counter(tuple(r) for r in merkle.manifest(df, fan_out, levels).collect())
    assert got == plain_manifest(rows, fan_out)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_manifest_of_one_row_and_of_a_language_for_each(spark):
    for rows in ([(1, "A b", "en", "s", 3)], [(i, f"Text {i}", f"l{i}", "s", 6) for i in range(150)], [(i, "T", "en", "s", 1) for i in range(5000)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert Counter(tuple(r) for r in merkle.manifest(df).collect()) == plain_manifest(rows)


def test_odd_rows_of_documents(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA).withColumn("n_chars", F.length("text"))
    for f in (fill_middle.fill_in_middle, merkle.manifest):
        assert f(docs).count() == docs.count()
        assert f(docs.withColumn("leaf", F.lit(1)).withColumn("_i", F.lit(1))).count() == docs.count()
