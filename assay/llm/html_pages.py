"""HTML into blocks of text with their place in the page; the small parser behind wrapper induction."""

from __future__ import annotations

import html
import re

import xxhash

RAW = "script|style|title|textarea|xmp|iframe|noembed|noframes"
QUOTED = r"""[^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*>"""
#: Comments, and elements whose content is not markup.
DROPPED = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){QUOTED}.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(rf"(<[a-zA-Z/!?]{QUOTED}|<[a-zA-Z/!?][^<>]*>)")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that end a block of text where they begin and end.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Siblings of these kinds count as one place of a page, however many there are.
FOLDED = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 option blockquote pre".split())
#: Elements that never hold the main text.
ASIDE = frozenset("nav footer aside form menu button select option noscript template dialog svg object head search".split())
#: Names in class, id or role that say so, alone or as the first or last word of a longer one (cookie-notice, post-comments).
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo comment comments commentlist disqus cookie cookies consent gdpr "
    "sidebar nav navbar navigation breadcrumb breadcrumbs pager pagination menu newsletter subscribe signup popup modal footer respond".split()
)
#: Names that say so alone, or as the last word of a longer one, outside articles: a share price is text, a site notice is not.
ASIDE_LAST = frozenset("notice notices notification banner toolbar widget widgets alert dialog".split())
#: Names that say so only alone, outside articles: search results, related content and post headers are text.
ASIDE_ALONE = frozenset(
    "contentinfo complementary discussion header page-header site-header masthead promoted promotion recommended related "
    "replies reply search share sharing social sponsor".split()
)
#: The same inside articles.
ASIDE_IN_ARTICLE = frozenset("form search search-form related-posts related-articles".split())
#: First words with which a name speaks of something else around it (no-sidebar, has-comments).
ABOUT = frozenset("no not non has have with without is show hide".split())
#: An element that begins one of these ends an open element of its group inside the nearest of its parents.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NEITHER: tuple = ((), ())
SPLIT = re.compile(r"[^a-z0-9]+")


def _named(name: str) -> tuple[bool, bool]:
    """Whether a name tells that an element is not main text, outside and inside an article."""
    words = [w for w in SPLIT.split(name) if w]
    if not words or (len(words) > 1 and words[0] in ABOUT):
        return False, False
    sure = words[0] in ASIDE_NAMES or words[-1] in ASIDE_NAMES
    return sure or words[-1] in ASIDE_LAST or name in ASIDE_ALONE, sure or name in ASIDE_IN_ARTICLE


def _marks(tag: str) -> tuple[str, bool, bool]:
    """Names in class, id and role, and whether one tells that the element is not main text, outside and inside an article."""
    names = " ".join("".join(m) for m in MARKS.findall(tag)).lower().split()
    told = [_named(n) for n in names]
    return ".".join(sorted(names)), any(o for o, _ in told), any(i for _, i in told)


def decoded(text: str) -> str:
    """Character references to characters, white space to one space, trimmed."""
    if "&" in text:
        text = "&".join([html.unescape(p) if "&" in p else p for p in text.split("&amp;")])
    return " ".join(text.split())


#: What is known of tags seen before: (kind, name, is a block, label, set aside).
TAGS: dict[str, tuple] = {}
OPEN, CLOSE, BREAK, SKIP = range(4)


def _tag(text: str) -> tuple:
    """kind, name, whether it is a block, label of its node, whether it is set aside outside and inside an article."""
    name = NAME.match(text)
    tag = name.group(1).lower() if name else ""
    block = tag in BLOCK
    if not tag:
        known = (SKIP, tag, False, "", False, False)
    elif text[1] == "/":
        known = (CLOSE, tag, block, "", False, False)
    elif tag in VOID or text.endswith("/>"):
        known = (BREAK if block or tag == "br" else SKIP, tag, block, "", False, False)
    else:
        marks, *named = _marks(text) if "=" in text else ("", False, False)
        aside = [tag in ASIDE or (n and tag not in ("html", "body", "article", "main")) for n in named]
        known = (OPEN, tag, block, f"{tag}.{marks}" if marks else tag, *aside)
    if len(TAGS) > 20_000:
        TAGS.clear()
    TAGS[text] = known
    return known


#: What an element stands in: no part that says so, the main part, an article.
PLAIN, MAIN, ARTICLE = range(3)
#: Siblings of one label beyond this many share the last one's place, so that no place has more equal children.
MANY = 32


class Page:
    """Blocks (node, text, link characters, set aside, in article) in page order, and the tree of their elements.

    nodes[i] is (parent, label); node 0 is the root. Folded siblings share a node. The main part of a page is a
    container like any other, except that headers in it are text.
    """

    def __init__(self, source: str):
        nodes = self.nodes = [(-1, "")]
        self.blocks: list[tuple[int, str, int, bool, bool]] = []
        folded: dict[tuple[int, str], list[int]] = {}
        # open elements: (tag, node, aside, part); inline ones keep the node of their block
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, PLAIN)]
        parts: list[str] = []
        linked = links = 0
        pieces = TAG.split(DROPPED.sub("", source))
        if pieces[0]:
            parts.append(pieces[0])
        for at in range(1, len(pieces), 2):
            text = pieces[at]
            kind, tag, block, label, named, inside = TAGS.get(text) or _tag(text)
            if block:
                if parts:
                    said = decoded("".join(parts))
                    parts.clear()
                    if said:
                        _, node, aside, part = stack[-1]
                        self.blocks.append((node, said, linked, aside, part == ARTICLE))
                linked = 0
            if kind == OPEN:
                if block:
                    # a block ends an open paragraph; list items, cells and the like end their neighbours
                    ends, within = CLOSES.get(tag, NEITHER)
                    for i in range(len(stack) - 1, 0, -1):
                        over = stack[i][0]
                        if over == "p" or over in ends:
                            del stack[i:]
                        elif over in within or (not ends and over in BLOCK):
                            break
                _, node, aside, part = stack[-1]
                if block:
                    key = (node, label)
                    same = folded.get(key)
                    if same and (tag in FOLDED or same[1] == MANY):
                        node = same[0]
                    else:
                        nodes.append(key)
                        node = len(nodes) - 1
                        folded[key] = [node, same[1] + 1 if same else 1]
                aside = aside or (inside if part == ARTICLE else named) or (tag == "header" and part == PLAIN)
                stack.append((tag, node, aside, ARTICLE if tag == "article" else max(part, MAIN) if tag == "main" else part))
                links += tag == "a"
            elif kind == CLOSE:
                for i in range(len(stack) - 1, 0, -1):
                    over = stack[i][0]
                    if over == tag:
                        del stack[i:]
                        break
                    # an inline end tag does not reach beyond its block
                    if not block and over in BLOCK:
                        break
                if tag == "a" and links:
                    links -= 1
            elif kind == BREAK and not block:
                parts.append(" ")
            # what is set aside is no text of the block around it either
            if (after := pieces[at + 1]) and not stack[-1][2]:
                parts.append(after)
                if links:
                    linked += len(after.strip())
        if parts and (said := decoded("".join(parts))):
            _, node, aside, part = stack[-1]
            self.blocks.append((node, said, linked, aside, part == ARTICLE))

    def skeleton(self) -> str:
        """The tree as text: parent and label of each node, in order."""
        return "\n".join(f"{p}\t{label}" for p, label in self.nodes[1:])


def children_of(skeleton: str) -> tuple[list[str], list[list[int]]]:
    labels, children = [""], [[]]
    for line in skeleton.split("\n") if skeleton else []:
        parent, label = line.split("\t", 1)
        labels.append(label)
        children.append([])
        children[int(parent)].append(len(labels) - 1)
    return labels, children


def _shapes(labels: list[str], children: list[list[int]]) -> list[int]:
    """Equal numbers for equal subtrees, by hash."""
    out = [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):  # children have larger numbers than their parents
        out[i] = xxhash.xxh64_intdigest(f"{labels[i]} {[out[c] for c in children[i]]}")
    return out


def aligned(skeleton: str, reference: str) -> dict[int, int]:
    """Simple tree matching: nodes of skeleton to nodes of reference, roots matched, order and labels kept.

    The largest matching of two trees is, for equal roots, one plus the best ordered matching of their
    children, found by dynamic programming over the pairs with equal labels. Equal subtrees match whole, and
    equal ones at the ends of both lists match each other, which no other matching can better; only the lists
    between them are compared.
    """
    if skeleton == reference:
        return {i: i for i in range(skeleton.count("\n") + 2 if skeleton else 1)}
    a_labels, a_children = children_of(skeleton)
    b_labels, b_children = children_of(reference)
    a_shape, b_shape = _shapes(a_labels, a_children), _shapes(b_labels, b_children)
    nodes = [1] * len(a_labels)
    for i in range(len(a_labels) - 1, -1, -1):
        nodes[i] += sum(nodes[c] for c in a_children[i])
    size: dict[tuple[int, int], int] = {}

    def middle(i, j):
        """Children that are left when equal ones at both ends are paired, and those pairs."""
        xs, ys = a_children[i], b_children[j]
        low, n = 0, min(len(xs), len(ys))
        while low < n and a_shape[xs[low]] == b_shape[ys[low]]:
            low += 1
        high = 0
        while high < n - low and a_shape[xs[-1 - high]] == b_shape[ys[-1 - high]]:
            high += 1
        ends = [*zip(xs[:low], ys[:low]), *zip(xs[len(xs) - high :], ys[len(ys) - high :])]
        return xs[low : len(xs) - high], ys[low : len(ys) - high], ends

    def pair(x, y):
        return nodes[x] if a_shape[x] == b_shape[y] else size[x, y]

    def chain(xs, ys):
        """The best ordered matching of two lists: its size, and its pairs. Only pairs with equal labels are looked at."""
        places: dict[str, list[int]] = {}
        for k, y in enumerate(ys):
            places.setdefault(b_labels[y], []).append(k)
        best, at = [0] * (len(ys) + 1), [-1] * (len(ys) + 1)  # a tree of prefix maxima over the places in ys
        pairs: list[tuple[int, int, int]] = []

        def before(k):
            value, pair_at = 0, -1
            while k:
                if best[k] > value:
                    value, pair_at = best[k], at[k]
                k &= k - 1
            return value, pair_at

        for x in xs:
            new = []
            for k in places.get(a_labels[x], ()):
                value, earlier = before(k)
                new.append((k + 1, value + pair(x, ys[k]), len(pairs)))
                pairs.append((x, ys[k], earlier))
            for k, value, pair_at in new:
                while k <= len(ys):
                    if value > best[k]:
                        best[k], at[k] = value, pair_at
                    k += k & -k
        total, last = before(len(ys))
        found = []
        while last >= 0:
            x, y, last = pairs[last]
            found.append((x, y))
        return total, found

    # sizes of the pairs that a comparison from the roots can ask for, children first
    asked, todo = [], [(0, 0)]
    seen = {(0, 0)}
    while todo:
        i, j = todo.pop()
        asked.append((i, j))
        xs, ys, _ = middle(i, j)
        by: dict[str, list[int]] = {}
        for y in ys:
            by.setdefault(b_labels[y], []).append(y)
        for x in xs:
            for y in by.get(a_labels[x], ()):
                if a_shape[x] != b_shape[y] and (x, y) not in seen:
                    seen.add((x, y))
                    todo.append((x, y))
    for i, j in sorted(asked, reverse=True):
        xs, ys, ends = middle(i, j)
        size[i, j] = 1 + chain(xs, ys)[0] + sum(nodes[x] for x, _ in ends)
    out, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        if a_shape[i] == b_shape[j]:
            todo += zip(a_children[i], b_children[j])
            continue
        xs, ys, ends = middle(i, j)
        todo += ends
        todo += chain(xs, ys)[1]
    return out
