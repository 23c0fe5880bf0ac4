"""The tree of a page with the looks that its style sheets give each element.

Rules of ``<style>`` elements and style attributes are cascaded: important ones first, then by specificity, then by order. Looked at are the properties in LOOKS. Rules inside ``@media`` for screens and
without conditions count, other at-rules do not; linked sheets are not fetched. A rule whose selector is not understood is left out, as browsers do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import VOID

#: Properties that are looked at, with what they are without a rule; visibility alone is inherited.
LOOKS = {"display": "", "visibility": "visible", "opacity": "1", "position": "static", "border-radius": "", "background-image": ""}
#: Elements that have no box of their own.
UNSEEN = frozenset("head script style title meta link base template noscript".split())
CLOSES = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav form pre blockquote hr main".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
TREE = "page_id long, elem_idx int, tag string, parent_idx int, last_idx int, nth int, attrs map<string,string>, text string, display string, visibility string, opacity double, position string, radius string, background string, hidden boolean"

PART = re.compile(r"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<ci>[iI])?\s*)?\]|:(?P<pseudo>first-child|nth-child\(\s*(?P<nth>[^)]*)\))""")
NTH = re.compile(r"(?:(?P<odd>odd|even)|(?:(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?)|(?P<only>[+-]?\d+))\Z")
TAG = re.compile(r"[A-Za-z][\w-]*|\*")
JOIN = re.compile(r"\s*([>+~])\s*|\s+")


@dataclass
class Step:
    """One compound of a selector, and what joins it to the one before: a blank (any ancestor), > (parent), + (sibling right before), ~ (earlier sibling)."""

    join: str
    tag: str | None = None
    id: str | None = None
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str, str, bool]] = field(default_factory=list)
    nth: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    before: Node | None  # the sibling right before
    nth: int
    classes: frozenset[str]
    at: int
    last: int = 0
    children: int = 0
    youngest: Node | None = None
    text: list[str] = field(default_factory=list)


def parse_selector(text: str) -> list[Step] | None:
    """The steps of a selector without commas, or None."""
    steps, at, join, text = [], 0, " ", text.strip()
    while at < len(text):
        step, start = Step(join), at
        if m := TAG.match(text, at):
            step.tag, at = None if m[0] == "*" else m[0].lower(), m.end()
        while m := PART.match(text, at):
            at = m.end()
            if m["id"] is not None:
                if step.id not in (None, m["id"]):
                    return None
                step.id = m["id"]
            elif m["cls"] is not None:
                step.classes.append(m["cls"])
            elif m["attr"] is not None:
                value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
                step.attrs.append((m["attr"].lower(), m["op"] or "", value, bool(m["ci"])))
            elif m["pseudo"] == "first-child":
                step.nth.append((0, 1))
            else:
                n = NTH.match(m["nth"].strip().lower())
                if not n:
                    return None
                if n["odd"]:
                    step.nth.append((2, 1 if n["odd"] == "odd" else 0))
                elif n["only"]:
                    step.nth.append((0, int(n["only"])))
                else:
                    step.nth.append((int(n["a"] + "1") if n["a"] in ("", "+", "-") else int(n["a"]), int((n["sign"] or "+") + (n["b"] or "0"))))
        if at == start:
            return None
        steps.append(step)
        if at < len(text):
            m = JOIN.match(text, at)
            if not m:
                return None
            join, at = m[1] or " ", m.end()
            if at >= len(text):
                return None
    return steps or None


def selectors(text: str) -> list[list[Step]]:
    """The selectors of a list; commas inside brackets and quotes do not part them. Empty if one is not understood."""
    parts, depth, quote, own = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        depth += (c in "[(") - (c in ")]") if not quote else 0
        if c == "," and not depth and not quote:
            parts.append(own)
            own = ""
        else:
            own += c
    found = [parse_selector(p) for p in [*parts, own]]
    return [] if any(f is None for f in found) else found


def fits(node: Node, step: Step) -> bool:
    """Whether an element is one that a step means by itself."""
    if (step.tag and step.tag != node.tag) or (step.id is not None and node.attrs.get("id") != step.id) or not node.classes.issuperset(step.classes):
        return False
    for name, op, value, fold in step.attrs:
        own = node.attrs.get(name)
        if own is None:
            return False
        if fold:
            own, value = own.lower(), value.lower()
        if op and not {"=": own == value, "~=": value in own.split(), "|=": own == value or own.startswith(value + "-"), "^=": value != "" and own.startswith(value), "$=": value != "" and own.endswith(value), "*=": value != "" and value in own}[op]:
            return False
    return all(node.nth == b if a == 0 else (node.nth - b) % a == 0 and (node.nth - b) // a >= 0 for a, b in step.nth)


def matches(node: Node, steps: list[Step]) -> bool:
    """Whether an element is one that a selector means; from its last step to its first."""
    if not fits(node, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    join, rest = steps[-1].join, steps[:-1]
    if join == ">":
        return node.parent is not None and matches(node.parent, rest)
    if join == "+":
        return node.before is not None and matches(node.before, rest)
    other = node.parent if join == " " else node.before
    while other is not None:
        if matches(other, rest):
            return True
        other = other.parent if join == " " else other.before
    return False


def weight(steps: list[Step]) -> tuple[int, int, int]:
    return sum(s.id is not None for s in steps), sum(len(s.classes) + len(s.attrs) + len(s.nth) for s in steps), sum(bool(s.tag) for s in steps)


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """property -> (important, value) of those in LOOKS."""
    found: dict[str, tuple[bool, str]] = {}
    for part in re.sub(r"/\*.*?(?:\*/|\Z)", "", text, flags=re.S).split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "background":
            name, value = "background-image", value if "url(" in value else "none"
        if colon and name in LOOKS and value:
            strong = bool(re.search(r"!\s*important\s*\Z", value, re.I))
            value = re.sub(r"\s*!\s*important\s*\Z", "", value, flags=re.I)
            if strong or not found.get(name, (False, ""))[0]:
                found[name] = (strong, value if name == "background-image" else value.lower())
    return found


def rules(sheet: str) -> list[tuple[list[Step], dict[str, tuple[bool, str]]]]:
    """(selector, declarations) of a sheet, in order."""
    text, out, at = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S), [], 0
    while (brace := text.find("{", at)) >= 0:
        head = text[at:brace].rpartition(";")[2].strip().lstrip("}").strip()
        end, depth = brace + 1, 1
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        body = text[brace + 1 : end - (0 if depth else 1)]
        if head.startswith("@"):
            if re.fullmatch(r"@media\s+(?:only\s+)?(?:all|screen)", head, re.I):
                out += rules(body)
        elif own := declarations(body):
            out += [(steps, own) for steps in selectors(head)]
        at = end
    return out


class Tree(HTMLParser):
    """All elements of a page in order, and the text of its style elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[Node] = []
        self.roots = Node("", {}, None, None, 0, frozenset(), -1)
        self.sheets: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open and tag in CLOSES.get(self.open[-1].tag, ()):
            self.shut()
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        above = self.open[-1] if self.open else self.roots
        above.children += 1
        node = Node(tag, own, self.open[-1] if self.open else None, above.youngest, above.children, frozenset(own.get("class", "").split()), len(self.nodes))
        above.youngest = node
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)
        else:
            node.last = node.at

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut()

    def shut(self) -> None:
        self.open.pop().last = len(self.nodes) - 1

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in reversed(self.open)):
            while self.open[-1].tag != tag:
                self.shut()
            self.shut()

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1].text.append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self.shut()
        self.sheets = ["".join(n.text) for n in self.nodes if n.tag == "style"]


def tree_of(html: str | None) -> Tree:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree


class Cascade:
    """The rules of a page, found by what their last step asks for."""

    def __init__(self, sheets: list[str]) -> None:
        self.by: dict[tuple[str, str], list] = {}
        for order, (steps, own) in enumerate(r for sheet in sheets for r in rules(sheet)):
            last = steps[-1]
            key = ("#", last.id) if last.id is not None else (".", last.classes[0]) if last.classes else ("t", last.tag) if last.tag else ("*", "")
            self.by.setdefault(key, []).append((weight(steps), order, steps, own))

    def of(self, node: Node) -> dict[str, str]:
        """What the rules and the element's own style make of it."""
        best: dict[str, tuple] = {}
        keys = [("#", node.attrs.get("id", "")), *[(".", c) for c in node.classes], ("t", node.tag), ("*", "")]
        for key in keys:
            for heavy, order, steps, own in self.by.get(key, ()):
                if matches(node, steps):
                    for name, (strong, value) in own.items():
                        best[name] = max(best.get(name, ((False,), "")), ((strong, False, heavy, order), value))
        for name, (strong, value) in declarations(node.attrs.get("style", "")).items():
            best[name] = max(best.get(name, ((False,), "")), ((strong, True, (0, 0, 0), 0), value))
        return {name: value for name, (_, value) in best.items()}


def share(text: str) -> float:
    """An opacity as a number; what is none counts as 1."""
    m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))(%?)", text.strip())
    return min(1.0, max(0.0, float(m[1]) / (100 if m[2] else 1))) if m else 1.0


def looks(tree: Tree) -> list[dict]:
    """The rows of a page: see page_tree()."""
    cascade, seen, out = Cascade(tree.sheets), {}, []
    for n in tree.nodes:
        own = cascade.of(n)
        above = seen.get(n.parent.at) if n.parent else {"visibility": "visible", "gone": False, "closed": False}
        visibility = own.get("visibility", "inherit")
        if visibility not in ("visible", "hidden", "collapse"):
            visibility = above["visibility"]
        attrs = n.attrs
        display = own.get("display", "none" if n.tag in UNSEEN or "hidden" in attrs else "")
        closed = above["closed"] or "hidden" in attrs or "inert" in attrs or attrs.get("aria-hidden") == "true"
        opacity, position = share(own.get("opacity", "1")), own.get("position", "static")
        gone = above["gone"] and position not in ("fixed", "sticky")
        hidden = closed or display == "none" or gone or visibility == "hidden" or opacity < 0.05
        seen[n.at] = {"visibility": visibility, "gone": gone or display == "none", "closed": closed}
        out.append({
            "elem_idx": n.at, "tag": n.tag, "parent_idx": n.parent.at if n.parent else None, "last_idx": n.last, "nth": n.nth, "attrs": list(attrs.items()), "text": " ".join("".join(n.text).split()), "display": display,
            "visibility": visibility, "opacity": opacity, "position": position, "radius": own.get("border-radius", ""), "background": own.get("background-image", ""), "hidden": hidden,
        })
    return out


def page_tree(pages: DataFrame) -> DataFrame:
    """A row for each element of pages(page_id, html), in page order, with its looks: TREE.

    last_idx: the last element inside it, itself if there is none; nth: its number among its siblings, from 1. hidden: hidden itself or by what is around it, through attributes, display or visibility, or all but transparent itself; one
    that is fixed or sticky stays visible inside an element without display. A null page gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {
            "page_id": pa.int64(), "elem_idx": pa.int32(), "tag": pa.string(), "parent_idx": pa.int32(), "last_idx": pa.int32(), "nth": pa.int32(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "display": pa.string(),
            "visibility": pa.string(), "opacity": pa.float64(), "position": pa.string(), "radius": pa.string(), "background": pa.string(), "hidden": pa.bool_(),
        }
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rows := [r | {"page_id": page} for r in looks(tree_of(html))]:
                    yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in kinds.items()], list(kinds))

    return pages.select("page_id", "html").mapInArrow(run, TREE)
