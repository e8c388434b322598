"""Pages as trees of blocks, and simple tree matching between such trees.

A page is read the way browsers read broken markup: missing end tags are implied, stray
ones are passed over. Inline elements are part of their block's text. What its tag,
role, class or id names as no part of an article never enters the tree.
"""

from __future__ import annotations

import html
import re

import xxhash

# fixed values: how HTML elements behave, and names that pages give to what is no article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("noscript svg canvas template".split())  # as RAW, if their end tag is there
INLINE = frozenset("button select object audio video map".split())  # no article, yet inside a line of text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
# an opening tag ends these, up to the nearest of the elements after the bar
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot tr td th", "table"),
    "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"),
    "body": ("head", ""),
}
IMPLIED = {tag: (frozenset(ended.split()), frozenset(bar.split())) for tag, (ended, bar) in IMPLIED.items()}
OUTSIDE_TAGS = frozenset(
    "head nav footer aside form dialog menu fieldset search".split())
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion "
    "banner nav navbar navigation menu menus menubar breadcrumb breadcrumbs pager pagination sidebar sidebars widget "
    "widgets footer topbar toolbar cookie cookies consent gdpr notice notices newsletter subscribe signup login popup "
    "modal overlay share sharing social related recommended comment comments disqus reply replies".split())
REGIONS = ("article", "main")
# siblings of these make lists even when other elements stand between them
LISTED = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote pre ul ol dl table figure #".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)|([^<]++|<)""", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DEEPEST = 256  # elements below are taken as children of the one at this depth, as browsers do
ALIKE = 0.6  # siblings are one list's items if twice their matching is this share of their sizes


class Node:
    """An element: label, children, and what a text leaf (label ``#``) stands for."""

    __slots__ = ("label", "kids", "held", "sig")

    def __init__(self, label: str, kids=None, held=None) -> None:
        self.label, self.kids, self.held, self.sig = label, kids or [], held, None


def _names(attributes: str) -> tuple[list[str], str]:
    words, role = [], ""
    for name, *values in NAMED.findall(attributes):
        value = values[0] or values[1] or values[2]
        if name.lower() == "role":
            role = value.strip().lower()
        else:
            words += [w.lower() for w in PART.findall(value)]
    return words, role


def tree(page: str) -> tuple[Node, list[str]]:
    """The page's tree without what is marked as no article, and its block texts in page order.

    A text leaf holds the number of its text. Where the page marks an article, or else a
    main part, the root is labelled so and holds only those; else it is ``body``.
    """
    root = Node("body")
    stack: list[tuple[str, Node, bool]] = [("", root, False)]  # tag, node, outside the article
    texts: list[str] = []
    piece: list[str] = []
    regions: dict[str, list[Node]] = {name: [] for name in REGIONS}
    position = 0

    def close_text() -> None:
        if piece:
            text = "".join(piece)
            piece.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                stack[-1][1].kids.append(Node("#", held=[len(texts)]))
                texts.append(text)

    def ended(at: int) -> None:
        close_text()
        del stack[at:]

    while position < len(page):
        found = TOKEN.match(page, position)
        position = found.end()
        slash, tag, attributes, text = found.groups()
        if text is not None:
            if not stack[-1][2]:
                piece.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag in BLOCKS or tag in INLINE:
                at = next((n for n in range(len(stack) - 1, 0, -1) if stack[n][0] == tag), None)
                if at is not None and tag in INLINE and at == len(stack) - 1:
                    stack.pop()
                elif at is not None:
                    ended(at)
                elif tag == "p":
                    close_text()
            continue
        if tag in RAW or tag in SKIPPED:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, position)
            if end or tag in RAW:
                position = end.end() if end else len(page)
        elif tag == "br":
            if not stack[-1][2]:
                piece.append("\n")
        elif tag in INLINE:
            stack.append((tag, stack[-1][1], True))
        if tag not in BLOCKS:
            continue
        if stack[-1][0] == "p":
            ended(len(stack) - 1)
        if tag in IMPLIED:
            gone, bar = IMPLIED[tag]
            first = None
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] in bar:
                    break
                if stack[n][0] in gone:
                    first = n
            if first is not None:
                ended(first)
        close_text()
        if tag in VOID:
            continue
        words, role = _names(attributes) if attributes else ([], "")
        inside = any(s[0] in REGIONS for s in stack)
        outside = stack[-1][2] or tag in OUTSIDE_TAGS or role in OUTSIDE_ROLES or (tag == "header" and not inside) or (
            tag not in ("html", "body", "main") and not OUTSIDE_WORDS.isdisjoint(words))
        if outside:
            stack.append((tag, stack[-1][1], True))
            continue
        if len(stack) > DEEPEST:
            stack.append((tag, stack[-1][1], False))
            continue
        node = Node(".".join([tag, *words[:2]]))
        region = tag if tag in REGIONS else role if role in REGIONS else "article" if "articlebody" in "".join(words) else None
        if region and not any(s[1] in regions[region] for s in stack):
            regions[region].append(node)
        stack[-1][1].kids.append(node)
        stack.append((tag, node, False))
    ended(1)
    for name in REGIONS:
        if regions[name] and any(_leaves(n) for n in regions[name]):
            return Node(name, [k for n in regions[name] for k in n.kids]), texts
    return root, texts


def _leaves(node: Node) -> list[Node]:
    """The text leaves below a node, in order."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if at.label == "#":
            out.append(at)
        todo.extend(reversed(at.kids))
    return out


def signature(node: Node) -> str:
    if node.sig is None:
        node.sig = node.label if node.label == "#" else f"{node.label}({' '.join(map(signature, node.kids))})"
    return node.sig


def read_signature(text: str, key) -> Node:
    """The tree of a signature; its leaves hold [(key, number of the leaf)]."""
    root, leaf = Node(""), 0
    open_nodes = [root]
    for token in re.findall(r"#|[^\s()#]+\(|\)", text):
        if token == ")":
            open_nodes.pop()
        elif token == "#":
            open_nodes[-1].kids.append(Node("#", held=[(key, leaf)]))
            leaf += 1
        else:
            open_nodes[-1].kids.append(Node(token[:-1]))
            open_nodes.append(open_nodes[-1].kids[-1])
    return root.kids[0]


def size(node: Node) -> int:
    return 1 + sum(map(size, node.kids))


def matching(a: Node, b: Node) -> int:
    """Simple tree matching: the most nodes that two trees share, in order, parents with parents."""
    if a.label != b.label:
        return 0
    if signature(a) == signature(b):
        return size(a)
    return 1 + _table(a.kids, b.kids)[-1][-1]


def _table(left: list[Node], right: list[Node]) -> list[list[int]]:
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for n, y in enumerate(right):
            row.append(max(above[n + 1], row[n], above[n] + matching(x, y)))
        rows.append(row)
    return rows


def merge(a: Node, b: Node) -> Node:
    """Both trees, laid over each other along their matching; ``a`` is changed and returned."""
    if a.held is not None:
        a.held.extend(b.held)
    if signature(a) == signature(b):
        for x, y in zip(a.kids, b.kids):
            merge(x, y)
        return a
    table, kids = _table(a.kids, b.kids), []
    n, m = len(a.kids), len(b.kids)
    while n or m:
        if n and m and a.kids[n - 1].label == b.kids[m - 1].label and (
                table[n][m] == table[n - 1][m - 1] + matching(a.kids[n - 1], b.kids[m - 1])):
            n, m = n - 1, m - 1
            kids.append(merge(a.kids[n], b.kids[m]))
        elif n and (not m or table[n][m] == table[n - 1][m]):
            n -= 1
            kids.append(a.kids[n])
        else:
            m -= 1
            kids.append(b.kids[m])
    a.kids, a.sig = kids[::-1], None
    return a


def folded(node: Node) -> Node:
    """The tree with the items of every list laid over each other, so that its size is that of the layout."""
    kids: list[Node] = []
    for kid in map(folded, node.kids):
        earlier = kids[-1:] if kid.label.split(".")[0] not in LISTED else [k for k in kids if k.label == kid.label]
        for like in earlier:
            if like.label == kid.label and (signature(like) == signature(kid) or (
                    2 * matching(like, kid) >= ALIKE * (size(like) + size(kid)))):
                merge(like, kid)
                break
        else:
            if kid.kids or kid.held is not None:  # elements without text say nothing
                kids.append(kid)
    node.kids, node.sig = kids, None
    return node


def layout(page: str | None) -> tuple[str, list[int], list[str]]:
    """A page's layout (a signature), and for each block text, in page order, its leaf there and the text."""
    root, texts = tree(page or "")
    root = folded(root)
    leaf_of = {}
    for n, leaf in enumerate(_leaves(root)):
        leaf_of.update(dict.fromkeys(leaf.held, n))
    order = sorted(leaf_of)
    return signature(root), [leaf_of[n] for n in order], [texts[n] for n in order]


def aligned(forms: list[tuple[int, str]]) -> tuple[str, dict[int, list[int]]]:
    """One template of several layouts, and for each layout's key the template's leaf of each of its leaves."""
    forms = sorted(forms, key=lambda f: (-len(f[1]), f[1], f[0]))
    template = Node("pages")
    for key, text in forms:
        other = read_signature(text, key)
        # pages that mark their article and pages that do not stand side by side
        merge(template, other if other.label == "pages" else Node("pages", [other]))
    slots: dict[int, dict[int, int]] = {}
    for n, leaf in enumerate(_leaves(template)):
        for key, at in leaf.held:
            slots.setdefault(key, {})[at] = n
    return signature(template), {key: [found[n] for n in range(len(found))] for key, found in slots.items()}


def mark(text: str) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value
