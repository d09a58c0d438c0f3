"""Main text of web pages by wrapper induction.

Pages of a host share a template. Their trees, folded to skeletons, are merged into one wrapper for each host by
simple tree matching, and every skeleton is aligned with it. A text that stands at the same node of the wrapper
in most pages that differ elsewhere is template; what varies is a slot. The slots that hold most of a host's
varying text, or its article elements, are the content. Only distinct skeletons are matched; texts are compared by
counting, so no task sees all pages of a host.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.functions.bounds import broadcast_if_small
from patchlake.llm import dom, urls
from patchlake.llm.storage import new_folder, staged

FAN = 64  # trees that one task merges at a time
WRAPPER_NODES = 1024  # nodes of a wrapper; those of the fewest pages go, and their text counts as varying
# A text is template if it stands at its node in this share of the pages that have the node, and in this many
# at least; pages with the same longest block count as one. Inside an article the bar is higher.
SHARE, PAGES = 0.5, 3
MAIN_SHARE, MAIN_PAGES = 0.8, 8
DOMINANT = 0.8  # a child with this share of a node's varying text leads on to the content
ARTICLES = 0.3  # article elements with this share of a page's varying text are the content
LINKS = 0.5  # a slot with this share of link text leads elsewhere

PARSED = "page_id long, url string, host string, skeleton string, longest binary, blocks array<struct<node:int,links:int,main:boolean,text:string>>"


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def parsed(pages: DataFrame) -> DataFrame:
    """Skeleton and text blocks of every page, and a digest of its longest block without links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("node", pa.int32()), ("links", pa.int32()), ("main", pa.bool_()), ("text", pa.string())])
        names = ["page_id", "url", "host", "skeleton", "longest", "blocks"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(struct)]
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                out: list[list] = [[] for _ in names]
                for page_id, url, host, html in zip(*(c.to_pylist() for c in batch.slice(begin, 128).columns), strict=True):
                    root, blocks = dom.parse(html or "")
                    if not blocks and html:
                        root, blocks = dom.parse(html, by_class=False)
                    shape = dom.skeleton(root)
                    plain = [b for b in blocks if 2 * b.links <= len(b.text)]
                    longest = max(plain, key=lambda b: len(b.text)).text if plain else ""
                    rows = [{"node": b.node.place, "links": b.links, "main": b.main, "text": b.text} for b in blocks]
                    for column, value in zip(out, (page_id, url, host, shape, _digest(longest), rows), strict=True):
                        column.append(value)
                yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    columns = (F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(urls.host_of(F.col("url")), F.lit("")), F.col("html").cast("string"))
    return pages.select(*columns).mapInArrow(run, PARSED)


# ---- wrappers ----------------------------------------------------------------------


def _merged(trees: DataFrame) -> DataFrame:
    """(host, tree): one tree for each group (host, bucket) of (host, bucket, tree, n)."""
    grouped = trees.groupBy("host", "bucket").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "tree"))).alias("trees"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = group.as_py()
                wrapper = dom.read(rows[0]["tree"], -rows[0]["order"])
                for row in rows[1:]:
                    dom.merge(wrapper, dom.read(row["tree"], -row["order"]))
                dom.prune(wrapper, WRAPPER_NODES)
                yield pa.record_batch([pa.array([host], pa.string()), pa.array([dom.write(wrapper)], pa.string()), pa.array([wrapper.support], pa.int64())], names=["host", "tree", "n"])

    return grouped.select("host", "trees").mapInArrow(run, "host string, tree string, n long")


def wrappers(skeletons: DataFrame) -> DataFrame:
    """(host, tree): the merged tree of each host, from (host, tree, n) with the number of pages of a skeleton.

    Trees of a host are dealt into groups of about FAN by their hash and merged, until one is left.
    """
    trees = skeletons
    while True:
        sizes = trees.groupBy("host").agg(F.count("*").alias("trees"))
        buckets = F.greatest(F.lit(1), F.ceil(F.col("trees") / FAN).cast("long"))
        dealt = trees.join(broadcast_if_small(sizes), "host").withColumn("bucket", F.pmod(F.xxhash64("tree"), buckets))
        trees = staged(_merged(dealt), "wrappers")
        if not trees.groupBy("host").count().where("count > 1").head(1):
            return trees.select("host", "tree")


ALIGNED = "host string, skeleton string, nodes array<long>"


def alignments(skeletons: DataFrame, made: DataFrame) -> DataFrame:
    """(host, skeleton, nodes): for each node of a skeleton its number in the wrapper of the host, or a negative
    number of its own where the wrapper has no such node."""
    joined = skeletons.select("host", F.col("tree").alias("skeleton")).join(broadcast_if_small(made, 2_000), "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, wrapper = None, None
            for begin in range(0, batch.num_rows, 64):
                hosts, shapes, trees = (c.to_pylist() for c in batch.slice(begin, 64).columns)
                out = []
                for shape, tree in zip(shapes, trees, strict=True):
                    if tree != last:
                        last, wrapper = tree, dom.read(tree)
                    root = dom.read(shape)
                    at = dom.aligned(wrapper, root)
                    own = int.from_bytes(_digest(shape)[:6], "little") << 10
                    out.append([at.get(k, -1 - own - k) for k in range(len(dom.nodes_of(root)))])
                yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(out, pa.list_(pa.int64()))], names=["host", "skeleton", "nodes"])

    return joined.select("host", "skeleton", "tree").mapInArrow(run, ALIGNED)


# ---- content -------------------------------------------------------------------------


def content_nodes(shape: str, weights: list[int], linked: list[bool]) -> list[bool]:
    """Which nodes of a skeleton are content, from the characters of varying text of each node on its host.

    Article elements, if they hold enough of it. Else the way goes down from the root to the child that holds
    most of the varying text, and back up to the node that also holds its heading. Slots of links don't count.
    """
    nodes = dom.nodes_of(dom.read(shape))
    place = {id(n): k for k, n in enumerate(nodes)}
    own = [0 if link else w for w, link in zip(weights, linked, strict=True)]
    total = list(own)
    parent = [-1] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        for child in nodes[k].children:
            parent[place[id(child)]] = k
            total[k] += total[place[id(child)]]
    end = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        end[k] = max([k + 1, *(end[place[id(c)]] for c in nodes[k].children)])
    name = [n.label.split(".")[0] for n in nodes]
    keep = [False] * len(nodes)
    tops = []
    k = 0
    while k < len(nodes):
        if name[k] in dom.MAIN:
            tops.append(k)
            k = end[k]
        else:
            k += 1
    if tops and sum(total[k] for k in tops) >= ARTICLES * total[0]:
        for k in tops:
            keep[k : end[k]] = [True] * (end[k] - k)
        return keep
    top = 0
    while True:
        below = [place[id(c)] for c in nodes[top].children if c.children]
        heavy = [k for k in below if total[k] and total[k] >= DOMINANT * total[top]]
        if not heavy:
            break
        top = heavy[0]
    above = parent[top]
    while above >= 0 and DOMINANT * total[above] <= total[top]:
        if any(name[place[id(c)]] in ("h1", "h2") and own[place[id(c)]] for c in nodes[above].children):
            top = above
        above = parent[above]
    for k in range(top, end[top]):
        keep[k] = not linked[k] or name[k] in dom.HEADINGS
    return keep


DECIDED = "host string, skeleton string, keep array<boolean>"


def _decided(aligned: DataFrame, weights: DataFrame) -> DataFrame:
    """(host, skeleton, keep) from the weights (host, at, chars, links) of the wrappers' nodes."""
    exploded = aligned.select("host", "skeleton", F.posexplode("nodes").alias("k", "at"))
    joined = exploded.join(weights, ["host", "at"], "left")
    entry = F.struct("k", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("links", F.lit(0)).alias("links"))
    grouped = joined.groupBy("host", "skeleton").agg(F.sort_array(F.collect_list(entry)).alias("nodes"))  # at most MAX_NODES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                hosts, shapes, nodes = (c.to_pylist() for c in batch.slice(begin, 256).columns)
                keep = [content_nodes(s, [n["chars"] for n in of], [n["links"] > LINKS * n["chars"] for n in of]) for s, of in zip(shapes, nodes, strict=True)]
                yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(keep, pa.list_(pa.bool_()))], names=["host", "skeleton", "keep"])

    return grouped.mapInArrow(run, DECIDED)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html): the main text.

    Blocks are joined in page order by one line feed; white space inside a block is one blank, character
    references are decoded. A null or empty html, and one without an article, has an empty text. Pages without a
    host (null url, no `://`) are one host. Repeated rows and repeated ids are pages of their own, but texts
    that repeat with the same longest block count once for the template, so copies of a page don't turn its text
    into template. Other columns have no part in it; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "pages-parsed")
    parsed(pages).write.parquet(folder)
    laid = spark.read.schema(PARSED).parquet(folder)
    skeletons = staged(laid.groupBy("host", F.col("skeleton").alias("tree")).agg(F.count("*").alias("n")), "skeletons")
    aligned = staged(alignments(skeletons, wrappers(skeletons)), "alignments")
    few = broadcast_if_small(aligned, 10_000)

    exploded = laid.select("host", "skeleton", "longest", F.explode("blocks").alias("b")).join(few, ["host", "skeleton"])
    at = F.get("nodes", F.col("b.node")).alias("at")
    texts = exploded.select("host", at, F.xxhash64("longest").alias("page"), "b.main", "b.links", "b.text")
    texts = texts.select("host", "at", "page", "main", "links", F.unhex(F.md5("text")).alias("digest"), F.length("text").alias("chars"))
    # Copies of a page count once: first one row per text at a node and page that differs, then the pages of each text.
    seen = texts.groupBy("host", "at", "digest", "main", "page").agg(F.count("*").alias("rows"), F.first("chars").alias("chars"), F.sum("links").alias("links"))
    per_text = seen.groupBy("host", "at", "digest", "main")
    counts = per_text.agg(F.count("*").alias("n"), F.sum(F.col("chars") * F.col("rows")).alias("chars"), F.sum("links").alias("links"))
    frequent = staged(counts.where(F.col("n") >= PAGES), "frequent-texts")
    holders = texts.groupBy("host", "at", "page").agg(F.lit(1).alias("one")).groupBy("host", "at").agg(F.sum("one").alias("pages"))
    often = F.when(F.col("main"), (F.col("n") >= MAIN_PAGES) & (F.col("n") >= MAIN_SHARE * F.col("pages")))
    often = often.otherwise(F.col("n") >= SHARE * F.col("pages"))
    template = staged(frequent.join(holders, ["host", "at"]).where(often), "template-texts")
    # Varying text is all text without the template.
    less = template.select("host", "at", (-F.col("chars")).alias("chars"), (-F.col("links")).alias("links"))
    varying = texts.select("host", "at", F.col("chars").cast("long"), F.col("links").cast("long")).unionByName(less)
    weights = varying.groupBy("host", "at").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    decided = staged(_decided(aligned, weights), "content-nodes")
    template = template.select("host", "at", "digest").distinct()
    placed = aligned.select("host", "skeleton", F.posexplode("nodes").alias("node", "at")).join(broadcast_if_small(template), ["host", "at"])
    # A page has few texts that stand in most pages, and so has a skeleton.
    dropped = placed.groupBy("host", "skeleton").agg(F.collect_set(F.struct("node", F.lower(F.hex("digest")).alias("digest"))).alias("dropped"))
    rules = staged(decided.join(dropped, ["host", "skeleton"], "left"), "content-rules")

    joined = laid.select("page_id", "url", "host", "skeleton", "blocks").join(broadcast_if_small(rules, 10_000), ["host", "skeleton"])

    def content(block):
        same = F.exists("dropped", lambda d: (d["node"] == block["node"]) & (d["digest"] == F.md5(block["text"])))
        return F.get("keep", block["node"]) & ~F.coalesce(same, F.lit(False))

    text = F.array_join(F.transform(F.filter("blocks", content), lambda b: b["text"]), "\n")
    out = joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    return out
