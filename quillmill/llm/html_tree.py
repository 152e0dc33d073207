"""Pages as trees of elements with the text they hold."""

from __future__ import annotations

import html
import re

#: Kinds of parts by words of tag names, classes, ids and roles.
GROUPS = {
    "main": "article main content post entry story articlebody maincontent",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead topbar logo branding banner",
    "foot": "footer foot copyright colophon contentinfo legal",
    "side": "aside sidebar side rail related recommended widget complementary trending",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsbygoogle",
    "note": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer newsletter subscribe subscription paywall dialog",
    "form": "form login search signup register input button select label option fieldset textarea",
    "comment": "comment comments reply replies discussion disqus respond feedback reviews",
    "share": "share social sharing tweet follow",
    "hidden": "hidden",
}
BIT = {g: 1 << k for k, g in enumerate(GROUPS)}
_WORD = {w: BIT[g] for g, words in GROUPS.items() for w in words.split()}
#: Elements by their display and their end.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas audio video".split())
FOREIGN, TO_THE_END = {"svg", "math"}, {"script", "style", "textarea", "title", "iframe"}
CLOSES = {  # a start of the key ends an open element of these
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
TAGS = ["html", "body", "div", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "tr", "td", "th", "article", "main", "nav", "header",
        "footer", "aside", "form", "button", "select", "option", "label", "figure", "figcaption", "blockquote", "pre", "dl", "dt", "dd", "span", "a", "head", "other"]
TAG = {t: k for k, t in enumerate(TAGS)}

_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
#: A comment, a declaration, or a tag: to the first ``>`` outside of quotes, or to the first at all where quotes do not close.
_MARK = re.compile(rf"""{_OTHER}|{_NAME}(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<open>[^>]*+)>)""", re.S)
_DECLARED = re.compile(r"<[!?]")
_LOOSE = re.compile(rf"{_OTHER}|{_NAME}(?P<open>[^>]*+)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_masks: dict[tuple[str, str], int] = {}


def own_mask(tag: str, attributes: str) -> int:
    """The kinds that an element names itself as."""
    key = (tag, attributes)
    mask = _masks.get(key)
    if mask is None:
        mask = 0 if tag in ("body", "html") else _WORD.get(tag, 0)
        for name, value in _ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("hidden", "aria-hidden"):
                mask |= BIT["hidden"] if value.lower() != "false" else 0
            elif name == "style":
                mask |= BIT["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else 0
            else:
                for w in _SPLIT.findall(value):
                    mask |= _WORD.get(w.lower(), 0)
        if len(_masks) > 50_000:
            _masks.clear()
        _masks[key] = mask
    return mask


class Page:
    """Per node: parent, depth, tag, own kinds, kinds above, characters of text, of them in links; runs of (node, text) pieces."""

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.own, self.above = [-1], [0], [TAG["html"]], [0], [0]
        self.length, self.linked = [0], [0]
        self.runs: list[list[tuple[int, str]]] = [[]]
        self._read(source)

    def _read(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("html", 0)]  # elements with the node that holds their text
        links = 0
        at, find, n = 0, _MARK.search, len(source)
        last = source.rfind(">") + 1  # no tag ends beyond
        unclosed: set[str] = set()
        runs = self.runs
        while at < n:
            m = find(source, at, last)
            if not m and (rest := _DECLARED.search(source, max(at, last))):
                n = rest.start()
            stop = m.start() if m else n
            if stop > at:
                text = html.unescape(source[at:stop])
                node = open_[-1][1]
                runs[-1].append((node, text))
                size = len(text.strip())
                self.length[node] += size
                if links:
                    self.linked[node] += size
            if not m:
                break
            at = m.end()
            end, tag, attributes = m.group(1), m.group(2), m.group("open")
            if not tag:
                if m.group().startswith("<!--") and not m.group().endswith("-->"):
                    break
                continue
            if attributes is None:
                attributes = m.group(3)
            else:  # from here on, quotes do not hide the end of a tag
                find = _LOOSE.search
            tag = tag.lower()
            if end:
                links = self._close(tag, open_, links)
                continue
            if tag in RAW:
                # a slash before the end closes elements of drawings and formulas only
                if not (tag in FOREIGN and attributes.endswith("/")):
                    close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    if not close:
                        unclosed.add(tag)
                    at = close.end() if close else n if tag in TO_THE_END else at
                continue
            if tag == "br":
                runs[-1].append((open_[-1][1], " "))
                continue
            if tag in VOID:
                if tag not in INLINE:
                    runs.append([])
                continue
            mask = own_mask(tag, attributes)
            inline = tag in INLINE
            if not inline:
                self._implied(tag, open_)
                links = sum(t == "a" for t, _ in open_) if links else 0
                runs.append([])
            if inline and not mask:
                node = open_[-1][1]
            else:
                up = open_[-1][1]
                node = len(self.parent)
                self.parent.append(up)
                self.depth.append(self.depth[up] + 1)
                self.tag.append(TAG.get(tag, TAG["other"]))
                self.own.append(mask)
                self.above.append(self.above[up] | self.own[up])
                self.length.append(0)
                self.linked.append(0)
            open_.append((tag, node))
            links += tag == "a"

    def _implied(self, tag: str, open_: list[tuple[str, int]]) -> None:
        """Ends of elements that the start of a block implies."""
        for k in range(len(open_) - 1, 0, -1):
            t = open_[k][0]
            if t == "p":
                del open_[k:]
                break
            if t not in INLINE:
                break
        closes = CLOSES.get(tag)
        if closes:
            for k in range(len(open_) - 1, 0, -1):
                t = open_[k][0]
                if t in SCOPE[tag]:
                    break
                if t in closes:
                    del open_[k:]

    def _close(self, tag: str, open_: list[tuple[str, int]], links: int) -> int:
        for k in range(len(open_) - 1, 0, -1):
            t = open_[k][0]
            if t == tag:
                if any(x not in INLINE for x, _ in open_[k:]):
                    self.runs.append([])
                del open_[k:]
                return sum(t == "a" for t, _ in open_) if links else 0
            if tag in INLINE and t not in INLINE:
                break  # an inline end does not reach out of its block
        else:
            if tag not in INLINE:
                self.runs.append([])
        return links

    def text(self, keep) -> str:
        """The blocks whose nodes are kept, in page order, each with single spaces."""
        out = []
        for run in self.runs:
            if run:
                words = "".join([t for node, t in run if keep[node]]).split()
                if words:
                    out += words
        return " ".join(out)
