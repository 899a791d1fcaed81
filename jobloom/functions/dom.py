"""What needs the nesting of tags, which patterns cannot follow: the content of a page, and its links with the cards around them.

One pass over a page's tags keeps a stack of open elements and gives each element the interval of its text; everything else is
looked up by interval. Pages go through in Arrow batches, a page at a time. The scanner is made by a function so that it travels to the Python
workers by value: they need no copy of this package. Nulls count as empty pages; tags left open end where an element around them ends,
or the page; end tags without an open element are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are no content, and names of classes and ids of banners and language pickers.
NO_CONTENT = ("script", "style", "noscript", "header", "footer", "nav", "form", "svg")
BANNER = r"cookie|consent|gdpr|lang(?:uage)?[-_ ]?(?:select|switch|picker|menu|chooser)"
#: Elements that count as the card of a link; how many of them are looked at; the longest text and most links of a card.
CARDS, LEVELS, CONTEXT, LINKS = ("article", "li", "div", "section", "tr"), 4, 400, 3
#: Classes of elements that hold a title.
TITLE_CLASS = r"title|position|stanowisk|nazwa|job-?name|offer-?name"


def scanner():
    """Two functions of a page: its content, and its links."""
    import html as entities
    import re
    from bisect import bisect_left
    from itertools import accumulate

    tag = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
    raw_end = {n: re.compile(rf"</{n}\b", re.I) for n in ("script", "style")}
    void = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
    # an element of this kind ends an open one of its kind, unless one of these is open in between
    limits = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
    named = lambda words: re.compile(rf"""\b(?:class|id)\s*=\s*(?:"[^"]*(?:{words})|'[^']*(?:{words})|[^\s"'>]*(?:{words}))""", re.I)
    banner, titled = named(BANNER), re.compile(rf"""\bclass\s*=\s*(?:"[^"]*(?:{TITLE_CLASS})|'[^']*(?:{TITLE_CLASS})|[^\s"'>]*(?:{TITLE_CLASS}))""", re.I)
    has_href = re.compile(r"""(?:^|\s)href\s*=""", re.I)

    class Element:
        __slots__ = ("attrs", "end", "inner", "inner_end", "name", "start", "up")

        def __init__(self, name, attrs, start, inner, up):
            self.name, self.attrs, self.start, self.inner, self.up = name, attrs, start, inner, up
            self.inner_end = self.end = inner

    def scan(page):
        """Elements in order of their start; texts and comments as (start, end)."""
        elements, texts, comments, stack, open_ = [], [], [], [], {}
        at, last = 0, page.rfind(">") + 1

        def close(n, inner_end, end):
            while len(stack) > n:
                e = stack.pop()
                open_[e.name] -= 1
                e.inner_end, e.end = inner_end, end if len(stack) == n else inner_end

        def innermost(name):
            if open_.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        return k
                    if stack[k].name in limits.get(name, ()):
                        break
            return None

        while (m := tag.search(page, at, last)) is not None:
            if m.start() > at:
                texts.append((at, m.start()))
            at = m.end()
            if m[2] is None:
                comments.append((m.start(), at))
                continue
            name = m[2].lower()
            if m[1]:
                k = innermost(name)
                if k is not None:
                    close(k, m.start(), at)
                continue
            if name in limits and (k := innermost(name)) is not None:
                close(k, m.start(), m.start())
            e = Element(name, m[3], m.start(), at, stack[-1] if stack else None)
            elements.append(e)
            if name in void or m[3].endswith("/"):
                e.inner_end = e.end = at
            elif name in raw_end:
                stop = raw_end[name].search(page, at)
                e.inner_end = stop.start() if stop else len(page)
                gt = page.find(">", e.inner_end)
                at = e.end = gt + 1 if stop and gt >= 0 else len(page)
            else:
                stack.append(e)
                open_[name] = open_.get(name, 0) + 1
        if at < len(page):
            texts.append((at, len(page)))
        close(0, len(page), len(page))
        return elements, texts, comments

    def content(page):
        elements, _, comments = scan(page)
        out, spans = 0, []
        picks = {}
        for e in elements:
            if e.start < out:  # inside one that goes
                continue
            if e.name in NO_CONTENT or banner.search(e.attrs):
                spans.append((e.start, e.end))
                out = e.end
            elif e.name in ("main", "article", "body"):
                picks.setdefault(e.name, e)
        chosen = next((picks[n] for n in ("main", "article", "body") if n in picks), None)
        low, high = (chosen.inner, chosen.inner_end) if chosen else (0, len(page))
        parts = []
        for a, b in sorted(spans + comments):
            if a >= low and a < high:
                parts.append(page[low:a])
                low = max(low, b)
        parts.append(page[low:high] if low < high else "")
        return " ".join(parts)

    def links(page):
        elements, texts, _ = scan(page)
        said = [(a, s) for a, b in texts if (s := entities.unescape(page[a:b]).strip())]
        places, sizes = [a for a, _ in said], list(accumulate((len(s) + 1 for _, s in said), initial=0))
        found = [e for e in elements if e.name == "a" and has_href.search(e.attrs)]
        heads = [e for e in elements if e.name in ("h2", "h3", "h4", "h5")]
        link_at, head_at = [e.start for e in found], [e.start for e in heads]
        starts = [e.start for e in elements]
        out = []
        for a in found:
            own = ""
            inside = elements[bisect_left(starts, a.inner) : bisect_left(starts, a.end)]
            best = next((e for e in inside if len(e.name) == 2 and e.name[0] == "h" and e.name[1] in "123456"), None) or next((e for e in inside if titled.search(e.attrs)), None)
            if best is not None:
                own = page[best.inner : best.inner_end]
            bare, at = [], a.inner
            for e in inside:
                if e.name in raw_end and e.start >= at:
                    bare.append(page[at : e.start])
                    at = e.end
            bare.append(page[at : a.inner_end])
            card, context, growing, e, level = None, None, True, a.up, 0
            while e is not None and level < LEVELS and (card is None or growing):
                if e.name in CARDS:
                    level += 1
                    k = bisect_left(head_at, e.start)
                    if card is None and k < len(heads) and head_at[k] < e.end:
                        card = page[heads[k].inner : heads[k].inner_end]
                    i, j = bisect_left(places, e.start), bisect_left(places, e.end)
                    n = bisect_left(link_at, e.end) - bisect_left(link_at, e.start)
                    growing = growing and sizes[j] - sizes[i] - 1 <= CONTEXT and n <= LINKS
                    if growing:
                        context = (i, j)
                e = e.up
            i, j = context or (bisect_left(places, a.start), bisect_left(places, a.end))
            out.append({"open": page[a.start : a.inner], "own": own, "bare": " ".join(bare), "card": card or "", "context": " ".join(s for _, s in said[i:j])})
        return out

    return content, links


#: Bytes of a batch that are Python objects at one time.
PART = 1 << 20


def in_parts(function, kind: pa.DataType):
    """A function of one value made one of an Arrow array, of which about PART bytes at a time are read and their results written back: what a Python
    worker holds as objects does not grow with the batch. Travels by value, as the scanner does."""
    size = PART

    def run(column):
        step = max(1, len(column) * size // max(1, column.nbytes))
        done = [pa.array([function(v) for v in column.slice(low, step).to_pylist()], kind) for low in range(0, len(column), step)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def content_html(html: Column) -> Column:
    """The inner HTML of main, else article, else body, else of all, without scripts, navigation, headers, footers, forms, banners, language pickers and comments."""
    content, _ = scanner()
    read = in_parts(lambda page: content(page or ""), pa.string())

    @F.arrow_udf("string")
    def pages(column: pa.Array) -> pa.Array:
        return read(column)

    return pages(html)


def link_parts(html: Column) -> Column:
    """An array, in order, of the links with a target: the open tag; the HTML of the heading or title inside; the HTML inside without scripts and styles;
    the HTML of the heading of the nearest card that has one; the text of the largest card that is short and has few links, else of the link."""
    _, links = scanner()
    read = in_parts(lambda page: links(page or ""), pa.list_(pa.struct([(name, pa.string()) for name in ("open", "own", "bare", "card", "context")])))

    @F.arrow_udf("array<struct<open:string,own:string,bare:string,card:string,context:string>>")
    def pages(column: pa.Array) -> pa.Array:
        return read(column)

    return pages(html)
