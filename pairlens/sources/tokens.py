"""One linear pass over a page: the elements that rules look at, and the page's texts.

``page_tokens`` turns HTML into two arrays. ``texts`` are the page's text nodes, entities
decoded, stripped, blank ones left out. ``tags`` are the elements that have a tag or a
mark of the rule tables, in document order, each with

* ``marks`` and ``within``: bits of the selectors that the element, or an element around it, matches;
* ``up`` and ``up_marks``: place in ``tags`` of the direct parent (-1 if not kept) and its marks;
* ``attrs``: the attributes that rules read;
* ``t0``, ``t1``, ``chars``: its texts are ``texts[t0:t1]``, with so many characters;
* ``lists``: how many tables and lists it holds.

So a field rule is a filter over ``tags``, and the text of an element a slice of
``texts``; no rule walks a tree or runs a pattern over HTML. Every character is read a
bounded number of times, whatever is unclosed: a tag is taken as far as it goes, an
element ends with its end tag, with the element around it, or where HTML says that the
next one ends it, and end tags without an open element are skipped by a count. An
element of ``boilerplate`` is undone when its own end tag comes, so an unclosed one keeps its content.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
_TAG_FIELDS = [("tag", _S), ("up", _I), ("up_marks", _L), ("marks", _L), ("within", _L), ("attrs", T.MapType(_S, _S)), ("t0", _I), ("t1", _I),
               ("chars", _I), ("lists", _I)]
TOKENS_T = T.StructType([T.StructField("tags", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _TAG_FIELDS]))),
                         T.StructField("texts", T.ArrayType(_S)), T.StructField("scripts", T.ArrayType(_S))])

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>?""")
_ATTR = re.compile(r"""(?<![^\s"'/])([^\s=<>"'/]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++))""")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in ("script", "style")}
_HINT = re.compile("|".join(rules.SPEC_CLASS_HINTS), re.I)

# Fixed values of HTML: elements without content, and which open elements the start of another one ends (and what shields them).
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = ("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul").split()
_CELL = ("td", "th", "table")
_ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
         "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
         **{b: (("p",), ("div", "li", *_CELL)) for b in _BLOCKS}}
_LISTS = frozenset(("table", "ul", "ol"))
_TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())


def _by_kind() -> dict[str, dict]:
    """The marks of ``rules.PAGE_MARKS`` as lookups: by id, by class, by attribute and value."""
    kinds: dict[str, dict] = {"#": {}, ".": {}, "=": {}}
    for selector in rules.PAGE_MARKS:
        bit = rules.page_mark(selector)
        if selector[0] in "#.":
            kinds[selector[0]][selector[1:]] = bit
        elif "=" in selector:
            kinds["="][tuple(selector.split("=", 1))] = bit
    return kinds


_KINDS = _by_kind()
_MARKED_ATTRS = {a for a, _ in _KINDS["="]}


def _marks(tag: str, attrs: dict[str, str]) -> int:
    bits = _KINDS["#"].get(attrs.get("id", ""), 0)
    for a in _MARKED_ATTRS & attrs.keys():
        bits |= _KINDS["="].get((a, attrs[a]), 0)
    classes = attrs.get("class")
    if classes:
        for c in classes.split():
            bits |= _KINDS["."].get(c, 0)
        if tag in ("div", "li") and _HINT.search(classes):
            bits |= rules.page_mark("~hint")
    return bits


class Scan:
    """One page: ``tags`` (lists in the order of the fields), ``texts`` and, if asked for, ``scripts``."""

    def __init__(self, html: str, boilerplate: frozenset[str] = frozenset(), keep_scripts: bool = False):
        self.tags: list[list] = []
        self.texts: list[str] = []
        self.scripts: list[str] = []
        self.stack: list[tuple] = []  # tag, place in tags or -1, marks and those around, state at the start
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.chars = self.lists = 0
        self.boilerplate, self.keep_scripts = boilerplate, keep_scripts
        self._run(html)

    def _run(self, html: str) -> None:
        at, pending = 0, ""
        while True:
            lt = html.find("<", at)
            if lt < 0:
                self._text(pending + html[at:])
                break
            if html.startswith("<!", lt) or html.startswith("<?", lt):
                self._text(pending + html[at:lt])
                mark = "-->" if html.startswith("<!--", lt) else ">"
                end = html.find(mark, lt + 2)
                at, pending = len(html) if end < 0 else end + len(mark), ""
                continue
            m = _TAG.match(html, lt)
            if not m:
                pending += html[at:lt + 1]
                at = lt + 1
                continue
            self._text(pending + html[at:lt])
            at, pending, tag = m.end(), "", m.group(2).lower()
            if m.group(1):
                self._end(tag)
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                if self.keep_scripts and tag == "script":
                    self.scripts.append(html[at:end.start() if end else len(html)])
                at = end.end() if end else len(html)
            else:
                self._start(tag, m.group(3))
        self._close(0)

    def _text(self, raw: str) -> None:
        t = (entities.unescape(raw) if "&" in raw else raw).strip()
        if t:
            self.texts.append(t)
            self.chars += len(t)

    def _last(self, tags) -> int:
        """Place in the stack of the innermost open element of ``tags``, -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=-1)

    def _start(self, tag: str, attr_text: str) -> None:
        if tag in _ENDS:
            ended, shields = _ENDS[tag]
            place = self._last(ended)
            if place > self._last(shields):
                self._close(place)
        attrs = {}
        if "=" in attr_text:
            for name, *values in _ATTR.findall(attr_text):
                value = next(filter(None, values), "")
                attrs.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
        marks = _marks(tag, attrs) if attrs else 0
        _, up, around = self.stack[-1][:3] if self.stack else ("", -1, 0)
        state = len(self.tags), len(self.texts), self.chars, self.lists
        place = -1
        if marks or tag in rules.PAGE_TAGS:
            place = len(self.tags)
            read = {a: v for a, v in attrs.items() if a in rules.PAGE_ATTRS} if attrs else attrs
            self.tags.append([tag, up, self.tags[up][3] if up >= 0 else 0, marks, around, read, state[1], state[1], 0, 0])
        self.lists += tag in _LISTS
        if tag not in _VOID:
            self.open[tag].append(len(self.stack))
            self.stack.append((tag, place, around | marks, state))

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            place = self.open[tag][-1]
            if tag in _TABLE_PARTS or place > self._last(_CELL):
                n_tags, n_texts, chars, lists = self.stack[place][3]
                self._close(place)
                if tag in self.boilerplate:
                    del self.tags[n_tags:], self.texts[n_texts:]
                    self.chars, self.lists = chars, lists

    def _close(self, place: int) -> None:
        """Close all open elements from ``place`` of the stack on."""
        while len(self.stack) > place:
            tag, at, _, (_, _, chars, lists) = self.stack.pop()
            self.open[tag].pop()
            if at >= 0:
                t = self.tags[at]
                t[7], t[8], t[9] = len(self.texts), self.chars - chars, self.lists - lists - (tag in _LISTS)


def _list(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


@F.arrow_udf(TOKENS_T)
def page_tokens(html: pa.Array, drop: pa.Array, scripts: pa.Array) -> pa.Array:
    """The tokens of every page; without boilerplate where ``drop``, with its scripts where ``scripts``."""
    cols: list[list] = [[] for _ in _TAG_FIELDS]
    texts, kept = [], []
    keys, values = [], []
    tag_ends, text_ends, script_ends, attr_ends = [0], [0], [0], [0]
    for h, d, s in zip(html, drop, scripts):
        page = Scan(h.as_py() or "", frozenset(rules.BOILERPLATE) if d.as_py() else frozenset(), bool(s.as_py()))
        for t in page.tags:
            for col, v in zip(cols, t):
                col.append(v)
            for k, v in t[5].items():
                keys.append(k)
                values.append(v)
            attr_ends.append(len(keys))
        texts += page.texts
        kept += page.scripts
        tag_ends.append(len(cols[0]))
        text_ends.append(len(texts))
        script_ends.append(len(kept))
    kinds = {_S: pa.string(), _I: pa.int32(), _L: pa.int64()}
    arrays = [pa.MapArray.from_arrays(pa.array(attr_ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())) if n == "attrs"
              else pa.array(c, kinds[t]) for (n, t), c in zip(_TAG_FIELDS, cols)]
    tags = pa.StructArray.from_arrays(arrays, [n for n, _ in _TAG_FIELDS])
    return pa.StructArray.from_arrays([_list(tag_ends, tags), _list(text_ends, pa.array(texts, pa.string())),
                                       _list(script_ends, pa.array(kept, pa.string()))], ["tags", "texts", "scripts"])


def nested_product(text: str | None) -> str | None:
    """The first product object that has an item, within the dehydrated queries of an island, as JSON text (PX3).

    An object's own product comes before those of its members; members and elements go in their order.
    """
    try:
        found = json.loads(text or "")["props"]["dehydratedState"]["queries"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None
    todo = [found]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            own = node.get("product")
            if isinstance(own, dict) and "item" in own:
                return json.dumps(own, ensure_ascii=False)
            node = list(node.values())
        if isinstance(node, list):
            todo.extend(x for x in reversed(node) if isinstance(x, (dict, list)))
    return None


@F.arrow_udf(T.StringType())
def island_product(island: pa.Array) -> pa.Array:
    return pa.array([nested_product(x.as_py()) for x in island], pa.string())
