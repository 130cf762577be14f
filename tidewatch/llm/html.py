"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, which lose them by their
share of link text. The best container is kept, and of its siblings the paragraphs, headings and
containers of paragraphs or headings that are not mostly links, without menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments. While the container
has most of the text of what it is in, below the body, all that stands beside it is kept, bare
text too, if it is not mostly links, and so on one level up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_texts

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>=]|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+>""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
DROPPED = frozenset(
    "head nav footer aside form button select option input fieldset dialog menu object applet audio video canvas"
   .split()
)
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: What may stand in a head; anything else ends it, as does text.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FENCES = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Share of link text up to which what stands beside the best container is kept.
LINKED = 0.5
ARTICLES = frozenset(["article", "main"])
#: Words of a class or id that mark what is no article; the first group as a whole word, the second as its beginning.
WORDS = frozenset(
    "ad ads adv nav menu share social promo related recommended breadcrumb breadcrumbs toolbar pager pagination tags "
    "login signup search masthead skip hidden modal popup overlay notice alert banner toc rss widget meta byline".split()
)
STEMS = ("advert", "sponsor", "sidebar", "footer", "comment", "disqus", "cookie", "consent", "gdpr", "newsletter",
         "subscri", "navig", "paywall", "reply", "replies", "respond")
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())


class Tree:
    """Elements in page order, as parallel lists; events are texts and the breaks between blocks."""

    def __init__(self) -> None:
        self.tag, self.parent, self.marks = ["#root"], [-1], [""]
        self.events: list[tuple[int, str | None]] = []

    def add(self, tag: str, parent: int, marks: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.marks.append(marks)
        return len(self.tag) - 1


def build(html: str) -> Tree:
    """A forgiving parse: unclosed and misnested elements, stray ends, comments, raw text."""
    tree, stack, pos, n = Tree(), [0], 0, len(html)
    tags, events = tree.tag, tree.events
    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            if tags[stack[-1]] == "head" and not html[pos:at].isspace():
                stack.pop()
            events.append((stack[-1], html[pos:at]))
        if at == n:
            break
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        name = NAME.match(html, at + 1)
        if not name:
            if html[at + 1:at + 2] in ("!", "?", "/"):
                end = html.find(">", at)
                pos = n if end < 0 else end + 1
            else:
                events.append((stack[-1], "<"))
                pos = at + 1
            continue
        rest = REST.match(html, name.end())
        if not rest:
            break  # the page ends inside a tag
        pos, tag = rest.end(), name[1].lower()
        if html[at + 1] == "/":
            close(tag, tags, stack, events)
            continue
        if tags[stack[-1]] == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in RAW:
            if rest[0][-2:-1] != "/" or tag not in ("svg", "math"):
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, pos)
                end = html.find(">", found.end()) if found else -1
                pos = n if end < 0 else end + 1
            continue
        if tag == "br":
            events.append((stack[-1], " "))
        if tag not in INLINE:
            open_block(tag, tags, stack)
            events.append((stack[-1], None))
        if tag in VOID:
            continue
        stack.append(tree.add(tag, stack[-1], marks_of(rest[0]) if "=" in rest[0] or "hidden" in rest[0] else ""))
    return tree


def open_block(tag: str, tags: list[str], stack: list[int]) -> None:
    """Ends the paragraph, list item or cell that a block element can't be inside of."""
    ends = CLOSES.get(tag, ())
    for k in range(len(stack) - 1, 0, -1):
        open_tag = tags[stack[k]]
        if open_tag == "p" or open_tag in ends:
            del stack[k:]
            if open_tag != "p":
                return
        elif open_tag in FENCES and not (ends and open_tag not in ("table", "ul", "ol", "dl")):
            return


def close(tag: str, tags: list[str], stack: list[int], events: list) -> None:
    inline = tag in INLINE
    for k in range(len(stack) - 1, 0, -1):
        open_tag = tags[stack[k]]
        if open_tag == tag:
            if not inline:
                events.append((stack[k], None))
            del stack[k:]
            return
        if inline and open_tag not in INLINE:
            return  # a block has begun since: the end is stray
    if not inline:
        events.append((stack[-1], None))


def marks_of(attributes: str) -> str:
    """What attributes say against an element: words of class and id, its role, or 'hidden'."""
    said = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            said += SPLIT.split(value)
        elif name == "role":
            said.append("role=" + value)
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            said.append("=hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            said.append("=hidden")
    return " ".join(said)


def unwanted(tree: Tree, by_class: bool) -> list[bool]:
    """For each element whether it, or something it is in, is no part of an article."""
    out, inside = [False], [False]
    for k in range(1, len(tree.tag)):
        tag, up = tree.tag[k], tree.parent[k]
        words = tree.marks[k].split()
        bad = tag in DROPPED or tag == "header" and not inside[up] or "=hidden" in words
        if words and not bad:
            roles = any(w.startswith("role=") and w[5:] in ROLES for w in words)
            stems = any(w.startswith(STEMS) for w in words)
            if tag in ("html", "body", "main"):
                bad = False
            elif tag == "article":
                bad = by_class and any(w.startswith(("comment", "reply", "advert", "sponsor")) for w in words)
            else:
                bad = roles or by_class and (stems or not WORDS.isdisjoint(words))
        out.append(out[up] or bad)
        inside.append(inside[up] or tag in ARTICLES)
    return out


def containers(tree: Tree, bad: list[bool]) -> tuple[list[int], list[int]]:
    """The best container and what stands beside it, by points, and the elements whose own bare text
    stands beside it; none if no text has points."""
    n = len(tree.tag)
    size, commas, linked, own = [0] * n, [0] * n, [0] * n, [0] * n
    link = [False] * n
    for k in range(1, n):
        link[k] = tree.tag[k] == "a" or link[tree.parent[k]]
    block = list(range(n))
    for k in range(1, n):
        if tree.tag[k] in INLINE:
            block[k] = block[tree.parent[k]]
    for k, text in tree.events:
        if text and not bad[k] and (chars := len(text.strip())):
            own[block[k]] += chars
            size[k] += chars
            commas[block[k]] += text.count(",")
            linked[k] += chars if link[k] else 0
    score, says = [0.0] * n, [False] * n
    for k in range(1, n):
        if own[k] and block[k] == k and (tree.tag[k] in PARAGRAPHS or own[k] >= 25 and tree.tag[k][0] != "h"):
            says[k] = True
            points, up, share = 1 + commas[k] + min(own[k] / 100, 3), tree.parent[k], 1.0
            while up >= 0 and share > 0.1:
                score[up] += points * share
                up, share = tree.parent[up], share / 2
    for k in range(n - 1, 0, -1):
        size[tree.parent[k]] += size[k]
        linked[tree.parent[k]] += linked[k]
    for k in range(n):
        score[k] *= 1 - linked[k] / size[k] if size[k] else 0
    sparse = [linked[k] <= LINKED * size[k] for k in range(n)]
    able = [k for k in range(n) if score[k] > 0 and not bad[k] and tree.tag[k] not in INLINE and tree.tag[k] != "html"]
    if not able:
        return [], []
    best = max(able, key=lambda k: (score[k], -k))
    up = best
    while up > 0:
        if tree.tag[up] in ARTICLES:
            best = up
        up = tree.parent[up]
    if not best or tree.tag[best] == "body":
        return [best], []
    headed = [tree.tag[k] in HEADINGS and size[k] > 0 for k in range(n)]
    for k in range(n - 1, 0, -1):
        headed[tree.parent[k]] |= headed[k] and not bad[k]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[tree.parent[k]].append(k)
    chosen, bare, at = [best], [], best
    while at:
        up = tree.parent[at]
        whole = (tree.tag[at] not in ARTICLES and tree.tag[up] not in ("#root", "html", "body")
                 and 2 * size[at] > size[up])
        if at != best and not whole:
            break
        chosen += [k for k in children[up] if k != at and size[k] and not bad[k] and sparse[k]
                   and (whole or score[k] > 0 or says[k] or headed[k])]
        if not whole:
            break
        bare.append(up)
        at = up
    return chosen, bare


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one to a line, with single spaces."""
    if not html:
        return ""
    tree = build(html)
    for by_class in (True, False):
        bad = unwanted(tree, by_class)
        found, bare = containers(tree, bad)
        if found:
            break
    keep = [False] * len(tree.tag)
    chosen, bare = set(found or [0]), set(bare)
    keep[0] = 0 in chosen
    for k in range(1, len(keep)):
        keep[k] = (keep[tree.parent[k]] or k in chosen) and not bad[k]
    blocks, parts = [], []
    for k, text in [*tree.events, (0, None)]:
        if text is None:
            if parts and (line := " ".join("".join(parts).split())):
                blocks.append(line)
            parts = []
        elif keep[k] or k in bare:
            parts.append(unescape(text))
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    The whole html is read; null and empty pages, and pages without any text, give an empty
    text. Null ids and urls stay null, repeated rows stay. No rows give no rows. Other columns are not
    looked at. Nothing is shuffled.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield batch(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return map_texts(rows, run, "page_id long, url string, text string, n_chars long")
