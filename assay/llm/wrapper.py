"""Main text of pages by wrapper induction.

Pages of a host are aligned with its most common tree by simple tree matching. A block whose text is the
same in its place on most pages that have the place is template; what varies is content. Copies, also with other
headings, are one page there, and pages without text none. An article only raises the evidence needed. Elements that say what they are
(navigation, forms, adverts, comments and so on) are never main text. All that varies otherwise is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assay.llm.html_pages import FOLDED, Page, aligned, children_of
from assay.llm.text import annotate, bound_batches, fresh_name, slices
from assay.session import staged

#: With fewer pages nothing can be told to be constant.
LEAST_PAGES = 3
#: Entries that a task adds up before it passes them on.
HELD = 200_000
#: What has more of its text in links is a menu, outside of articles.
LINKED = 0.5

#: Share of the pages with a place that say the same there when it is template.
CONSTANT = 0.8
#: Pages that must say the same before text inside an article counts as template.
LEAST_IN_ARTICLE = 10
#: Elements that are a part of the text around them.
LINES = FOLDED | {"h1"}
HEADING = re.compile(r"(?:h[1-6]|hgroup)(?:\.|$)")

BODIES = "host string, tree_id long, body long, skeleton string, nodes array<int>, texts array<long>"
SUMS = "host string, place long, position int, text long, n long"


def host_of(url):
    """Host part of an address, lower case; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _names(reference: str) -> list[int]:
    """A name for each node of a tree: a hash of its parent's name and its label, numbered among equal siblings."""
    labels, children = children_of(reference)
    names = [0] * len(labels)
    for i, own in enumerate(children):
        seen: Counter = Counter()
        for c in own:
            names[c] = _hash(f"{names[i]}/{labels[c]}[{seen[labels[c]]}]")
            seen[labels[c]] += 1
    return names


def place_names(skeleton: str, tree: str) -> list[int]:
    """Names of the nodes of a page in the tree of its host."""
    match, names = aligned(skeleton, tree), _names(tree)
    out: list[int] = []
    seen: Counter = Counter()
    for i, line in enumerate(["", *(skeleton.split("\n") if skeleton else [])]):
        if i in match:
            out.append(names[match[i]])
        else:  # not in the common tree: named after its parent, apart from the names there
            parent, label = line.split("\t", 1)
            key = (out[int(parent)], label)
            out.append(_hash(f"{key[0]}+{label}[{seen[key]}]"))
            seen[key] += 1
    return out


class Places:
    """place_names of the trees seen last."""

    def __init__(self):
        self.known: dict[tuple[str, str], list[int]] = {}

    def of(self, page: Page, tree: str) -> list[int]:
        key = (page.skeleton(), tree)
        if key not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            self.known[key] = place_names(*key)
        return self.known[key]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def usable(page: Page) -> list[tuple[int, str, bool]]:
    """(node, text, in article) of the blocks that may be main text by themselves."""
    menus: set[int] = set()
    if any(linked > LINKED * len(text) and not aside and not article for _, text, linked, aside, article in page.blocks):
        menus = _menus(page)
    return [(n, text, article) for n, text, linked, aside, article in page.blocks if not aside and (article or n not in menus or linked <= LINKED * len(text))]


def _menus(page: Page) -> set[int]:
    """Nodes whose text is mostly links. Of a paragraph, heading or item that holds for what stands around it."""
    size, links = [0] * len(page.nodes), [0] * len(page.nodes)
    for n, text, linked, aside, _ in page.blocks:
        if not aside:
            size[n] += len(text)
            links[n] += linked
    for n in range(len(page.nodes) - 1, 0, -1):  # children have larger numbers than their parents
        size[page.nodes[n][0]] += size[n]
        links[page.nodes[n][0]] += links[n]
    full = [k > LINKED * s for k, s in zip(links, size)]
    around = [p if label.split(".", 1)[0] in LINES else n for n, (p, label) in enumerate(page.nodes)]
    return {n for n, at in enumerate(around) if full[at]}


def positions(nodes: list[int]) -> list[tuple[int, int]]:
    """Per block its positions among the blocks of its node: 1, 2, .. from the first and -1, -2, .. from the last."""
    left, seen, out = Counter(nodes), Counter(), []
    for n in nodes:
        seen[n] += 1
        out.append((seen[n], -left[n]))
        left[n] -= 1
    return out


def bodies(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Distinct page bodies: per host, tree and texts other than headings, the nodes and text hashes of their blocks.

    Copies, also those with another title, are one body. Pages without a usable block have none.
    """

    def parse(batches):
        sent: set = set()  # each tree is sent once, its other pages name it
        for batch in slices(batches, html):
            rows = []
            for h, text in zip(batch.column(host).to_pylist(), batch.column(html).to_pylist()):
                page = Page(text or "")
                blocks = usable(page)
                if not blocks:
                    continue
                tree = page.skeleton()
                tree_id = _hash(tree)
                texts = [_hash(said) for _, said, _ in blocks]
                plain = [t for (n, _, _), t in zip(blocks, texts) if not HEADING.match(page.nodes[n][1])]
                body = _hash(",".join(map(str, plain or texts)))
                rows.append((h, tree_id, body, None if (h, tree_id) in sent else tree, [n for n, _, _ in blocks], texts))
                if len(sent) > HELD:
                    sent.clear()
                sent.add((h, tree_id))
            yield _rows(BODIES, rows)

    found = pages.select(host, html).mapInArrow(parse, BODIES)
    # of the copies the smallest stands for all, so that headings do not depend on the order of rows
    one = found.groupBy("host", "tree_id", "body").agg(F.max("skeleton").alias("skeleton"), F.min(F.struct("nodes", "texts")).alias("blocks"))
    return staged(one.select("host", "tree_id", "body", "skeleton", "blocks.*"), "bodies")


def wrappers(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Per host: its common tree and its constant places as (place, position, text, pages that say so).

    A place is a node of the aligned trees and a position among its blocks. It is constant if at least
    LEAST_PAGES distinct bodies, and the share CONSTANT of those whose tree has the node, say the same there.
    Trees of a host are aligned once each. Tasks add up what they pass on, so that template texts of a host
    with a third of all pages arrive as sums.
    """
    found = bodies(pages, host, html)
    trees = staged(found.groupBy("host", "tree_id").agg(F.max("skeleton").alias("skeleton"), F.count(F.lit(1)).alias("n")), "trees")
    common = trees.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("tree"))

    def align(batches):
        for batch in batches:
            rows = [(h, i, place_names(own, tree)) for h, i, own, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "tree_id", "skeleton", "tree")))]
            yield _rows("host string, tree_id long, names array<long>", rows)

    # few bytes and much work: the trees of one host are dealt over all tasks
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = trees.join(common, "host").select("host", "tree_id", "skeleton", "tree").repartition(parts, "host", "tree_id")
    named = staged(both.mapInArrow(align, "host string, tree_id long, names array<long>"), "names")

    def sums(batches):
        total: Counter = Counter()
        for batch in batches:
            for h, nodes, texts, names in zip(*(batch.column(c).to_pylist() for c in ("host", "nodes", "texts", "names"))):
                total.update((h, names[n], 0, 0) for n in set(nodes))
                for n, text, (first, last) in zip(nodes, texts, positions(nodes)):
                    total[h, names[n], first, text] += 1
                    total[h, names[n], last, text] += 1
                if len(total) > HELD:
                    yield _rows(SUMS, [(*k, n) for k, n in total.items()])
                    total.clear()
        yield _rows(SUMS, [(*k, n) for k, n in total.items()])

    bound_batches(pages.sparkSession)
    placed = found.select("host", "tree_id", "nodes", "texts").join(named, ["host", "tree_id"]).select("host", "nodes", "texts", "names").mapInArrow(sums, SUMS)
    # what fewer pages say than can be constant takes no part any more
    entries = staged(placed.groupBy("host", "place", "position", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES), "places")
    having = entries.where("position = 0").select("host", "place", F.col("n").alias("pages"))
    same = entries.where("position <> 0").join(having, ["host", "place"]).where(F.col("n") >= CONSTANT * F.col("pages"))
    # at most one text of a position is constant, so a host has no more than its layouts have blocks
    fixed = same.groupBy("host").agg(F.collect_list(F.struct("place", "position", "text", "n")).alias("fixed"))
    return staged(common.join(fixed, "host", "left"), "wrappers")


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[name for name, _ in fields])


def main_text(source: str, tree: str, fixed: dict, places: Places) -> str:
    """Blocks of the main text of one page, two line feeds between them."""
    page = Page(source)
    blocks = usable(page)
    if fixed:
        names = places.of(page, tree)
        kept = []
        for (n, text, article), at in zip(blocks, positions([n for n, _, _ in blocks])):
            pages = max(fixed.get((names[n], p, _hash(text)), 0) for p in at)
            if pages < (LEAST_IN_ARTICLE if article else LEAST_PAGES):
                kept.append((n, text, article))
        blocks = kept
    return "\n\n".join(text for _, text, _ in blocks)


def extracted(pages: DataFrame, url: str = "url", html: str = "html", name: str = "main") -> tuple[DataFrame, str]:
    """pages with a struct column holding the main ``text``; and its name.

    Null and empty html give the empty text; pages without a host count as one host ''. Hosts with fewer
    than LEAST_PAGES distinct bodies have no constant places. Rows that repeat are extracted alike. An empty table
    gives no rows. Wrappers meet the pages of their host in an ordinary join: Spark broadcasts them only
    below its size limit.
    """
    name = fresh_name(pages, name)
    host = fresh_name(pages, "host")
    ready = pages.withColumn(host, host_of(F.col(url)))
    rules = fresh_name(ready, "rules")
    found = wrappers(ready, host, html)
    met = ready.join(found.select(F.col("host").alias(host), F.struct("tree", "fixed").alias(rules)), host, "left")

    def make():
        places = Places()
        fixed: dict[str, dict] = {}

        def work(batch: pa.RecordBatch):
            out = []
            for h, text, rule in zip(*(batch.column(c).to_pylist() for c in (host, html, rules))):
                if h not in fixed:
                    if len(fixed) > 5000:
                        fixed.clear()
                    # a host without a usable page has no rule
                    fixed[h] = {(f["place"], f["position"], f["text"]): f["n"] for f in (rule and rule["fixed"]) or ()}
                out.append(main_text(text or "", rule["tree"] if rule else "", fixed[h], places))
            return [out]
        return work

    made = annotate(met, name, StructType([StructField("text", StringType(), False)]), make, html)
    return made.drop(host, rules), name
