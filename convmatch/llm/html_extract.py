"""Main text of web pages by site style trees.

The pages of one host share a template.  Their trees are merged by the path of tags and names;
of every element of the merged tree we count how many pages have it and in which forms (the
sequence of its children), and of every content node how many pages have the same text.  The
importance of an element is the entropy of its forms, that of content falls with the share of
pages that repeat it, and both are added up from the leaves.  A branch without an important
node is template: it is removed from the pages.

Roles come before: what tags or names declare as menu, header, footer, sidebar, notice, advert,
form or reader comment goes, and where a page declares its article, that is where its main text
is and no paragraph in it is judged by repetition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, key_doc_id, row_key, written
from .html_dom import blocks, branches, parse

#: Weight of a child's importance for each form of its parent (fixed value of the method).
_DAMPING = 0.9
#: Parts that a host's verdict is copied to, so that a large host's pages meet it in as many tasks.
_SALTS = 16


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_nodes(url: str | None, html: str | None) -> list[tuple[str, int, str, float, int, bool]]:
    """(host, page, path, share, form, open) for each node of a page's tree.

    ``page`` is a hash of the main text without any verdict, so that copies are one page of their
    host; ``share`` is one part in the number of different children of the node's parent;
    ``form`` hashes the children, or a content node's text; ``open`` branches wait for a verdict.
    """
    root = parse(html or "")
    visited: dict = {}
    page = _digest("\n".join(blocks(root, visited=visited)))
    host = host_of(url)
    rows = [(host, page, root.label, 1.0, 0, False)]
    for path, styles, texts in branches(root):
        rows.append((host, page, path, 1.0, _digest("|".join(",".join(s) for s in styles)), path in visited))
        if texts:
            rows.append((host, page, f"{path}/#text", 1.0, _digest("\n".join(texts)), False))
    rows = rows[1:]
    kids: dict[str, int] = {}
    for r in rows:
        up = r[2].rpartition("/")[0]
        kids[up] = kids.get(up, 0) + 1
    return [(h, p, path, 1.0 / kids[path.rpartition("/")[0]], form, open_) for h, p, path, _, form, open_ in rows]


def nodes_of(pages: DataFrame) -> DataFrame:
    """:func:`page_nodes` of ``pages`` (_id, _th, url, html), with the row keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_th", "host", "page", "path", "share", "form", "open"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.bool_()]
        for b in batches:
            out: list[tuple] = []
            for i, th, url, html in zip(*(c.to_pylist() for c in b.columns)):
                out += [(i, th, *r) for r in page_nodes(url, html)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "_id long, _th long, host string, page long, path string, share double, form long, open boolean"
    return pages.select("_id", "_th", "url", "html").mapInArrow(run, schema)


def _ancestors(path: Column) -> Column:
    """A path's prefixes, itself the last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, importance, best): the merged tree of every host.

    ``importance`` is the composite importance of a node, ``best`` the largest in its branch.
    ``nodes`` is a written table of :func:`nodes_of`.

    An element's own importance is the entropy of its forms over the pages that have it, to the
    base of their number; a content node's is one less the mean entropy of its texts.  A node
    of one page has importance 1.  An element keeps ``1 - 0.9 ** forms`` of its own importance
    and takes the rest from its children, each by its share of the pages' children.  That sum
    runs over all descendants with the product of the weights between, so a fixed number of
    joins does for trees of any depth.
    """
    pages = nodes.groupBy("host", "page", "path").agg(F.min("form").alias("form"), F.min("share").alias("share"))
    forms = pages.groupBy("host", "path", "form").agg(F.count(F.lit(1)).alias("c"), F.sum("share").alias("share"))
    log_c = F.log(F.col("c").cast("double"))
    stats = forms.groupBy("host", "path").agg(
        F.sum("c").alias("pages"), F.count(F.lit(1)).alias("forms"), F.sum("share").alias("share"),
        F.sum(F.col("c") * log_c).alias("clc"), F.avg(log_c).alias("alc"),
    )
    log_m = F.log(F.col("pages").cast("double"))
    leaf = F.col("path").endswith("/#text")
    damp = F.pow(F.lit(_DAMPING), F.least("forms", F.lit(100)))
    own = F.when(F.col("pages") == 1, 1.0).when(leaf, 1 - F.col("alc") / log_m).otherwise(1 - F.col("clc") / F.col("pages") / log_m)
    tree = written(
        stats.select("host", "path", "pages", "share", damp.alias("damp"), F.when(leaf, own).otherwise((1 - damp) * own).alias("own"))
    )
    up = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    parents = tree.select("host", F.col("path").alias("up"), F.log(F.col("damp") / F.col("pages")).alias("_of"))
    step = tree.withColumn("up", up).join(parents, ["host", "up"], "left").select(
        "host", F.col("path").alias("anc"), F.coalesce(F.col("_of") + F.log("share"), F.lit(0.0)).alias("step")
    )
    below = tree.select("host", "path", "own", F.explode(_ancestors(F.col("path"))).alias("anc"))
    weight = below.join(step, ["host", "anc"]).groupBy("host", "path").agg(F.sum("step").alias("w"), F.first("own").alias("own"))
    weight = written(weight)
    pairs = weight.select("host", "path", "w", "own", F.explode(_ancestors(F.col("path"))).alias("anc"))
    above = weight.select("host", F.col("path").alias("anc"), F.col("w").alias("w_anc"))
    importance = pairs.join(above, ["host", "anc"]).groupBy("host", "anc").agg(F.sum(F.exp(F.col("w") - F.col("w_anc")) * F.col("own")).alias("importance"))
    importance = importance.select("host", F.col("anc").alias("path"), F.round("importance", 9).alias("importance"))
    best = importance.select("host", "importance", F.explode(_ancestors(F.col("path"))).alias("path")).groupBy("host", "path").agg(F.max("importance").alias("best"))
    return tree.select("host", "path", "pages").join(importance, ["host", "path"]).join(best, ["host", "path"])


def extract_main_text(pages: DataFrame, threshold: float = 0.2, least_pages: int = 4) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Blocks of the main text come in page order, joined by newlines, with character references
    decoded and white space made one space.  A branch of which no node reaches ``threshold`` in
    importance, seen on ``least_pages`` different pages of its host or more, is removed,
    unless it holds more than half of the page's main text.

    Null html is empty; a page without main text has an empty text; null or broken urls are one
    host.  Repeated rows and pages with equal main text count as one page of their host, and each
    row gets its result; null page_ids are kept.  Very long pages are read whole; elements nested
    deeper than 64 keep their text without being nodes.  Other columns are not read; an empty
    table gives no rows.
    """
    rows = columns(pages, "page_id", "url", "html").select(*row_key("page_id", "html"), "url", "html")
    nodes = written(nodes_of(rows))
    tree = style_tree(nodes).where((F.col("best") < threshold) & (F.col("pages") >= least_pages))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    noise = tree.select("host", "path", salts)
    waiting = nodes.where("open").select("_id", "_th", "host", "path", F.pmod(F.xxhash64("_id", "_th"), F.lit(_SALTS)).cast("int").alias("salt"))
    # a table of its own, so that its size is known when the pages meet it
    drops = written(waiting.join(noise, ["host", "path", "salt"]).groupBy("_id", "_th").agg(F.collect_set("path").alias("_drop")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(blocks(parse(h or ""), set(d or ()))) for h, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # no lone surrogates
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    met = rows.join(drops, ["_id", "_th"], "left").select(key_doc_id().alias("page_id"), "url", "html", "_drop")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
