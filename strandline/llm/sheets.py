"""What style sheets and style attributes hide: display:none and visibility, by the cascade.

Selectors of tags, ``*``, classes, ids and attributes, joined by descent, child and sibling combinators, are matched
top down: a node carries the set of selector prefixes that it, its ancestors and its earlier siblings fulfil, so a page costs
its nodes times the prefixes that name their tag, class or id, however deep it is. A selector with a pseudo-class or
pseudo-element matches nothing (no element is hovered over, and no content is generated). Of all declarations of a property
the winner is by importance, style attribute, specificity and order. Rules count where their media query fits a screen of SCREEN
px and inside @supports and @layer (whose layers are not ranked). Class and id names ignore case only in pages without a
doctype. Malformed rules and values are passed over.
"""

from __future__ import annotations

import re

SCREEN = {"width": 1280, "height": 800}
#: Values of display that show an element, and those of visibility.
SHOWN = frozenset("block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption list-item flow-root contents run-in initial inherit unset revert".split())
SIGHT = {"visible": False, "initial": False, "hidden": True, "collapse": True, "inherit": None, "unset": None, "revert": None}
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.IGNORECASE)
_EDGE = re.compile(r"([^{}]*)([{}])")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
_STRING = re.compile(r""""[^"\n]*"|'[^'\n]*'""")
_INNER = re.compile(r"\([^()]*\)")
_SIZE = re.compile(r"(min|max)-(width|height)\s*:\s*([\d.]+)(px|em|rem)?")
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n])+"
_SIMPLE = re.compile(rf"""([#.]?)({_NAME}|\*)|\[\s*({_NAME})\s*(?:([~|^$*]?)=\s*("[^"]*"|'[^']*'|{_NAME})\s*([iIsS])?\s*)?\]""")
_JOINT = re.compile(r"\s*([>+~])\s*|\s+")
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))")


def on_screen(queries: str) -> bool:
    """Whether a media query list applies to a screen; a feature that is not known does not."""

    def feature(x: str) -> bool:
        m = _SIZE.fullmatch(x.strip(" ()"))
        if not m:
            return x.strip(" ()") in ("color", "hover", "orientation: landscape", "orientation:landscape")
        size = float(m[3] if m[3].count(".") < 2 and m[3] != "." else 0) * (1 if m[4] in (None, "px") else 16)
        return SCREEN[m[2]] >= size if m[1] == "min" else SCREEN[m[2]] <= size

    for q in queries.lower().split(","):
        first, *rest = re.split(r"\s+and\s+|\s+and(?=\()", q.strip())
        kind = first.split()
        no = kind[:1] == ["not"]
        if kind[:1] in (["not"], ["only"]):
            kind = kind[1:]
        head = " ".join(kind)
        yes = (feature(head) if head.startswith("(") else head in ("screen", "all", "")) and all(map(feature, rest))
        if yes != no:
            return True
    return False


def declared(css: str) -> list[tuple[str, bool | None, bool]]:
    """(property, whether it hides, importance) of the declarations that matter here; a hiding of None is the parent's."""
    out = []
    for name, value, weight in _DECLARED.findall(_COMMENT.sub(" ", css)):
        name, value = name.lower(), value.lower()
        if name == "visibility" and value in SIGHT:
            out.append((name, SIGHT[value], bool(weight)))
        elif name == "display" and (value == "none" or value in SHOWN):
            out.append((name, value == "none", bool(weight)))
    return out


def _plain(name: str) -> str:
    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else 0
        return m[2] or (chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")

    return _ESCAPE.sub(one, name) if "\\" in name else name


def selector(text: str) -> list[tuple[str, list[tuple]]] | None:
    """[(combinator before it, [(kind, name, operator, value)])]; None if it is not understood."""
    parts: list[tuple[str, list[tuple]]] = []
    at, joint, text = 0, "", text.strip()
    while at < len(text):
        tests = []
        while m := _SIMPLE.match(text, at):
            if m[2] is not None and not m[1] and tests:
                return None
            at = m.end()
            if m[3] is None:
                tests.append((m[1] or "tag", _plain(m[2]) if m[1] else _plain(m[2]).lower(), "", ""))
            else:
                value = m[5]
                tests.append(("[", _plain(m[3]).lower(), None if value is None else m[4] + "=", "" if value is None else value[1:-1] if value[0] in "\"'" else _plain(value)))
                if m[6] in ("i", "I"):
                    return None
        if not tests:
            return None
        parts.append((joint, tests))
        if at == len(text):
            break
        m = _JOINT.match(text, at)
        if not m or m.end() == len(text):
            return None
        joint, at = m[1] or " ", m.end()
    return parts or None


def _holds(have: str | None, op: str | None, want: str) -> bool:
    if have is None or op is None:
        return have is not None
    if op == "=":
        return have == want
    if not want:
        return False
    if op == "~=":
        return want in have.split()
    if op == "|=":
        return have == want or have.startswith(want + "-")
    return have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have


class Sheet:
    """The rules of a page that touch display or visibility, indexed by the id, class or tag that a prefix ends with."""

    def __init__(self):
        self.rules: list[tuple[str, list]] = []
        self.prefixes: list[tuple[str, list[tuple], list]] = []
        self.index: dict[tuple[str, str], list[int]] = {}
        self.quirks = True

    def add(self, css: str) -> None:
        css = _STRING.sub(lambda m: re.sub(r"[{};]", "", m[0]), _COMMENT.sub(" ", css))
        open_: list[tuple[str, bool]] = []
        for m in _EDGE.finditer(css):
            if m[2] == "{":
                head, on = m[1].rsplit(";", 1)[-1].strip(), not open_ or open_[-1][1]
                if head.startswith("@"):
                    kind, _, rest = head[1:].partition(" ") if " " in head else (head[1:].partition("(")[0], "", head[head.find("(") :] if "(" in head else "")
                    on = on and (on_screen(rest) if kind.lower() == "media" else kind.lower() in ("supports", "layer"))
                open_.append((head, on))
            elif open_:
                head, on = open_.pop()
                if on and not head.startswith("@") and (what := declared(m[1])):
                    self.rules.append((head, what))

    def ready(self) -> None:
        """Index the rules; once all of the page's sheets are read and its mode is known."""
        fold = str.lower if self.quirks else str
        for order, (head, what) in enumerate(self.rules):
            while _INNER.search(head):
                head = _INNER.sub(":", head)
            for text in re.split(r",(?![^\[]*\])", head):
                parts = selector(text)
                if not parts:
                    continue
                kinds = [k for _, tests in parts for k, name, _, _ in tests if name != "*"]
                rank = (kinds.count("#"), kinds.count(".") + kinds.count("["), kinds.count("tag"), order)
                for k, (joint, tests) in enumerate(parts):
                    tests = [(kind, fold(name) if kind in "#." else name, op, value) for kind, name, op, value in tests]
                    key = min(((kind, name) for kind, name, _, _ in tests if kind != "[" and name != "*"), key=lambda x: ("#", ".", "tag").index(x[0]), default=("tag", "*"))
                    self.index.setdefault(key, []).append(len(self.prefixes))
                    self.prefixes.append((joint, tests, [(name, hide, (heavy, False, *rank)) for name, hide, heavy in what] if k == len(parts) - 1 else []))

    def match(self, tag: str, attrs: dict, over: int, parent: int, before: int, last: int) -> tuple[int, list]:
        """The prefixes that a node fulfils, as bits, and the declarations that apply, from those of its ancestors, parent, earlier siblings and the last."""
        fold = str.lower if self.quirks else str
        near = {"": -1, " ": over, ">": parent, "~": before, "+": last}
        id_, classes = fold(attrs.get("id", "")), set(fold(attrs.get("class", "")).split())
        own, found = 0, []
        for key in (("tag", "*"), ("tag", tag), ("#", id_), *((".", c) for c in classes)):
            for p in self.index.get(key, ()):
                joint, tests, what = self.prefixes[p]
                if joint and not near[joint] >> (p - 1) & 1:
                    continue
                for kind, name, op, value in tests:
                    if not (name in ("*", tag) if kind == "tag" else name == id_ if kind == "#" else name in classes if kind == "." else _holds(attrs.get(name), op, value)):
                        break
                else:
                    own |= 1 << p
                    found += what
        return own, found


def apply(root, sheet: Sheet) -> None:
    """Set ``none`` (it and all below are gone) and ``dim`` (its own text is not seen) of all nodes below the root.

    The root stands for html and body. What is hidden by an attribute (hidden, a dialog not open) a rule of the page can show.
    """
    sheet.ready()
    own, outer = sheet.match("html", root.attrs, 0, 0, 0, 0)
    body, inner = sheet.match("body", root.attrs, own, own, 0, 0)
    _settle(root, outer + inner, False)
    stack = [(root, own, body)]
    plain = not sheet.prefixes
    while stack:
        node, over, own = stack.pop()
        over |= own
        before = last = 0
        for x in node.kids:
            if isinstance(x, str):
                continue
            match, found = (0, []) if plain else sheet.match(x.tag, x.attrs, over, own, before, last)
            before, last = before | match, match
            _settle(x, found, node.dim)
            if x.kids and not x.none:
                stack.append((x, over, match))


def _settle(node, found: list, dim: bool) -> None:
    a = node.attrs
    node.none, node.dim = "hidden" in a or node.tag == "dialog" and "open" not in a, dim
    if "style" in a:
        found = found + [(name, hide, (heavy, True, 0, 0, 0, k)) for k, (name, hide, heavy) in enumerate(declared(a["style"]))]
    for name, hide, _ in sorted(found, key=lambda x: x[2]):
        if name == "display":
            node.none = hide
        else:
            node.dim = dim if hide is None else hide
