"""What style sheets say about display and visibility, for operator 4.

Sheets are cut by brace depth; selectors are matched with their combinators; declarations are ordered by
!important, inline before sheet, specificity and position.  A rule holds for an element surely, not at all
or perhaps (media that depend on the screen, @supports, @layer, pseudo-classes that are not read here).
An element is hidden only where the sure declaration that wins hides it and none above it that perhaps
holds shows it: what cannot be evaluated never takes text away.  Linked sheets are not at hand.
"""

from __future__ import annotations

import re

NO, PERHAPS, YES = 0, 1, 2
# Fixed values of CSS.
DISPLAYS = frozenset("inline block inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group "
                     "table-header-group table-footer-group table-column table-column-group table-caption list-item contents "
                     "flow-root inherit initial unset".split())
NOT_SCREEN = frozenset("print speech aural braille embossed handheld projection tty tv".split())
FOLLOWED = frozenset("supports container scope document -moz-document layer".split())
ELEMENT_PARTS = frozenset("before after first-line first-letter".split())
# Pseudo-classes that hold for nothing on a page that was just opened.
AT_REST_NO = frozenset("hover active focus focus-within focus-visible target target-within visited fullscreen modal popover-open".split())
# Sheets nested deeper, and longer selectors, are not read: such a page hides nothing by sheet.
DEEPEST, LONGEST, MEMO = 30, 100, 100_000

_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_IDENT = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\[^\n]|[\w-]|[^\x00-\x7f])+"
COMMENT = re.compile(rf"({_STRING})|/\*.*?(?:\*/|\Z)", re.S)
PART = re.compile(rf"{_STRING}|url\(\s*[^\"'\s)][^)]*\)|\\.|[{{}};,()\[\]]", re.S | re.I)
SELECTOR = re.compile(
    rf"\s*(?P<comb>[>+~])\s*|(?P<blank>\s+)|(?P<any>\*)|(?P<nest>&)|\.(?P<cls>{_IDENT})|#(?P<id>{_IDENT})"
    rf"|\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>{_STRING}|{_IDENT})\s*(?P<flag>[iIsS])?\s*)?\]"
    rf"|(?P<colons>::?)(?P<pseudo>{_IDENT})(?P<open>\()?|(?P<tag>{_IDENT})", re.S)
MEDIA = re.compile(r"(?:(not|only)\b\s*)?([a-z][a-z-]*)?\s*(.*)", re.S)
RELEVANT = re.compile(r"display|visibility|\ball\s*:", re.I)
ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)


class Unreadable(Exception):
    """A selector that is not valid: browsers drop its rule."""


class TooDeep(Exception):
    pass


def _plain(name: str) -> str:
    if "\\" not in name:
        return name
    return ESCAPE.sub(lambda m: m[2] or chr(min(int(m[1], 16), 0x10FFFF)), name)


def _split(source: str) -> list[str]:
    """Cut at the commas outside brackets and strings."""
    out, start, depth = [], 0, 0
    for m in PART.finditer(source):
        if m[0] in ("(", "["):
            depth += 1
        elif m[0] in (")", "]"):
            depth -= 1
        elif m[0] == "," and depth <= 0:
            out.append(source[start:m.start()])
            start = m.end()
    return [*out, source[start:]]


def _items(source: str, nested: bool):
    """(prelude, body) of every block and (text, None) of every statement or declaration."""
    start = depth = body = 0
    for m in PART.finditer(source):
        if m[0] == "{":
            if not depth:
                prelude, body = source[start:m.start()], m.end()
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                yield prelude, source[body:m.start()]
                start = m.end()
        elif m[0] == ";" and not depth and (nested or source[start:m.start()].lstrip().startswith("@")):
            yield source[start:m.start()], None
            start = m.end()
    if depth:  # the end closes what is open
        yield prelude, source[body:]
    elif source[start:].strip():
        yield source[start:], None


def media(query: str) -> int:
    """Whether a media query list holds on a screen; perhaps, where it asks for a feature."""
    if not query.strip():
        return YES
    found = NO
    for part in _split(query.lower()):
        turn, kind, rest = MEDIA.fullmatch(part.strip()).groups()
        value = YES if kind in ("all", "screen") else NO if kind in NOT_SCREEN or kind and not rest else PERHAPS
        if rest:
            value = min(value, PERHAPS)
        found = max(found, YES - value if turn == "not" else value)
    return found


def declarations(source: str):
    """(property, True shows | False hides | None inherits, sure, important) of display and visibility."""
    if not RELEVANT.search(source):
        return
    if "/*" in source:
        source = COMMENT.sub(lambda m: m[1] or "", source)
    for part, body in _items(source, True):
        if body is None:
            yield from _declaration(part)


def _declaration(part: str):
    name, _, value = part.partition(":")
    name = name.strip().lower()
    if name not in ("display", "visibility", "all"):
        return
    value = value.strip().lower()
    important = re.search(r"!\s*important$", value)
    if important:
        value = value[:important.start()].strip()
    if not value:
        return
    if name == "all":
        yield "display", True, False, bool(important)
        yield "visibility", None if value in ("inherit", "unset") else True, False, bool(important)
    elif name == "display":
        yield name, value != "none", value == "none" or value in DISPLAYS, bool(important)
    elif value in ("hidden", "collapse"):
        yield name, False, True, bool(important)
    elif value in ("inherit", "unset", "revert", "revert-layer"):
        yield name, None, not value.startswith("revert"), bool(important)
    else:
        yield name, True, value in ("visible", "initial"), bool(important)


class Compound:
    """The simple selectors for one element, and how it hangs on the one before."""
    __slots__ = ("comb", "tag", "id", "classes", "attributes", "pseudos")

    def __init__(self, comb: str):
        self.comb, self.tag, self.id, self.classes, self.attributes, self.pseudos = comb, "", None, [], [], []


class Selector:
    __slots__ = ("parts", "weight", "vendor")

    def __init__(self, source: str, parent: list[Selector] | None, depth: int):
        if depth > DEEPEST:
            raise TooDeep
        source = source.strip().replace("*|", "")
        weight, self.vendor, nests = [0, 0, 0], False, False
        self.parts = [Compound("")]
        fresh, at = True, 0  # fresh: nothing of the last compound has been read
        while at < len(source):
            m = SELECTOR.match(source, at)
            if not m:
                raise Unreadable
            at, part = m.end(), self.parts[-1]
            if m["comb"] or m["blank"]:
                if fresh and not (parent and len(self.parts) == 1 and m["comb"]):
                    raise Unreadable
                if fresh:  # "> x" inside a rule
                    part.pseudos.append(("is", parent))
                    nests = True
                    weight = [a + b for a, b in zip(weight, max(p.weight for p in parent))]
                self.parts.append(Compound(m["comb"] or " "))
                fresh = True
                continue
            if m["tag"]:
                if not fresh:
                    raise Unreadable
                part.tag = _plain(m["tag"]).lower()
                weight[2] += 1
            elif m["cls"]:
                part.classes.append(_plain(m["cls"]))
                weight[1] += 1
            elif m["id"]:
                if part.id is None:
                    part.id = _plain(m["id"])
                else:
                    part.attributes.append(("id", "=", _plain(m["id"]), False))
                weight[0] += 1
            elif m["attr"]:
                value = m["value"]
                if value is not None:
                    value = _plain(value[1:-1] if value[0] in "\"'" else value)
                part.attributes.append((m["attr"].lower(), m["op"], value, (m["flag"] or "").lower() == "i"))
                weight[1] += 1
            elif m["nest"] and parent:
                nests = True
                part.pseudos.append(("is", parent))
                weight = [a + b for a, b in zip(weight, max(p.weight for p in parent))]
            elif m["pseudo"]:
                name, inner = m["pseudo"].lower(), None
                if m["open"]:
                    level, start = 1, at
                    for x in PART.finditer(source, at):
                        level += (x[0] == "(") - (x[0] == ")")
                        if not level:
                            inner, at = source[start:x.start()], x.end()
                            break
                    if inner is None:
                        raise Unreadable
                if m["colons"] == "::" or name in ELEMENT_PARTS:
                    part.pseudos.append(("part", None))
                    weight[2] += 1
                elif name in ("is", "not", "where", "matches") and inner is not None:
                    nests = nests or "&" in inner
                    try:
                        given = [Selector(x, parent, depth + 1) for x in _split(inner)]
                    except Unreadable:
                        if name == "not":
                            raise
                        part.pseudos.append(("?", None))
                        fresh = False
                        continue
                    part.pseudos.append(("not" if name == "not" else "is", given))
                    self.vendor = self.vendor or any(g.vendor for g in given)
                    if name != "where":
                        weight = [a + b for a, b in zip(weight, max(g.weight for g in given))]
                else:
                    self.vendor = self.vendor or name.startswith("-")
                    part.pseudos.append((name if inner is None else "?", None))
                    weight[1] += 1
            elif not m["any"]:
                raise Unreadable
            fresh = False
        if fresh:
            raise Unreadable
        if parent and not nests and depth == 0:
            weight = [a + b for a, b in zip(weight, max(p.weight for p in parent))]
            self.parts[0].comb = " "
            above = Compound("")
            above.pseudos.append(("is", parent))
            self.parts.insert(0, above)
        if len(self.parts) > LONGEST:
            raise TooDeep
        self.weight = tuple(weight)


class Styles:
    """The rules of one page, found by the last compound of their selectors."""

    def __init__(self, sheets: list[tuple[int, str]]):
        self.rules: dict[tuple[str, str], list] = {}
        self.position, self.known = 0, {}
        try:
            for holds, sheet in sheets:
                if RELEVANT.search(sheet):
                    source = COMMENT.sub(lambda m: m[1] or "", sheet)
                    self._read(source.replace("<!--", " ").replace("-->", " "), None, holds, False, 0)
        except TooDeep:
            self.rules = {}

    def _read(self, source: str, selectors: list[Selector] | None, sure: int, layered: bool, depth: int) -> None:
        if depth > DEEPEST:
            raise TooDeep
        for prelude, body in _items(source, selectors is not None):
            prelude = prelude.strip()
            if body is None:
                if selectors:
                    for d in _declaration(prelude):
                        self._add(selectors, d, sure, layered)
            elif prelude.startswith("@"):
                name = re.match(r"@([\w-]*)", prelude)[0][1:].lower()
                if name == "media":
                    holds = media(prelude[len("@media"):])
                    if holds:
                        self._read(body, selectors, min(sure, holds), layered, depth + 1)
                elif name in FOLLOWED:
                    self._read(body, selectors, PERHAPS, layered or name == "layer", depth + 1)
            else:
                try:
                    given = [Selector(s, selectors, 0) for s in _split(prelude)]
                except Unreadable:
                    continue
                vendor = any(g.vendor for g in given)  # browsers that do not know one drop the rule
                self._read(body, given, PERHAPS if vendor else sure, layered, depth + 1)

    def _add(self, selectors, declaration, sure, layered) -> None:
        prop, shows, certain, important = declaration
        if not certain:
            sure = PERHAPS
        if sure == PERHAPS and shows is False:
            return
        self.position += 1
        for s in selectors:
            last = s.parts[-1]
            key = (("#", last.id) if last.id is not None else (".", last.classes[0]) if last.classes else
                   ("", last.tag) if last.tag else ("*", ""))
            order = (2,) if layered else (int(important), 0, s.weight, self.position)
            self.rules.setdefault(key, []).append((s, order, prop, shows, sure))

    def of(self, node) -> dict[str, str]:
        """display 'none' and visibility 'hidden' or 'visible' of an element, where they are set."""
        attributes = node.attributes
        off = "hidden" in attributes or node.tag == "dialog" and "open" not in attributes
        if not (off or self.rules or "style" in attributes):
            return {}
        best = {"display": ((-1,), False)} if off else {}
        doubts = []
        for s, order, prop, shows, sure in self._candidates(node) if self.rules else ():
            if prop in best and best[prop][0] > order:
                continue
            sure = min(sure, self._match(s, len(s.parts) - 1, node))
            if sure == YES:
                best[prop] = order, shows
            elif sure == PERHAPS and shows is not False:
                doubts.append((order, prop, shows))
        for i, (prop, shows, sure, important) in enumerate(declarations(attributes["style"]) if "style" in attributes else ()):
            order = (int(important), 1, (), i)
            if not sure:
                doubts.append((order, prop, shows))
            elif prop not in best or best[prop][0] < order:
                best[prop] = order, shows
        out = {}
        for prop, (order, shows) in best.items():
            if shows is not None:
                out[prop] = ("visible" if prop == "visibility" else "") if shows else ("hidden" if prop == "visibility" else "none")
        for order, prop, shows in sorted(doubts, key=lambda d: (d[2] is True)):
            if (prop not in best or order > best[prop][0]) and out.get(prop) != "visible":
                if shows is None:
                    out.pop(prop, None)
                else:
                    out[prop] = "visible" if prop == "visibility" else ""
        return out

    def _candidates(self, node):
        rules, attributes = self.rules, node.attributes
        yield from rules.get(("", node.tag), ())
        yield from rules.get(("*", ""), ())
        if "id" in attributes:
            yield from rules.get(("#", attributes["id"]), ())
        for name in set(attributes["class"].split()) if "class" in attributes else ():
            yield from rules.get((".", name), ())

    def _match(self, s: Selector, i: int, node) -> int:
        part = s.parts[i]
        value = self._compound(part, node)
        if not value or not i:
            return value
        if part.comb == " ":
            return min(value, self._any(s, i - 1, node, "parent"))
        if part.comb == "~":
            return min(value, self._any(s, i - 1, node, "before"))
        other = node.parent if part.comb == ">" else node.before
        return min(value, self._match(s, i - 1, other)) if other is not None else NO

    def _any(self, s: Selector, i: int, node, step: str) -> int:
        """The best match among the elements above or before."""
        value, trail, n = NO, [], getattr(node, step)
        if len(self.known) > MEMO:
            self.known.clear()
        while n is not None:
            seen = self.known.get((s, i, step, n))
            if seen is not None:
                value = seen
                break
            trail.append(n)
            n = getattr(n, step)
        for n in reversed(trail):
            value = value if value == YES else max(value, self._match(s, i, n))
            self.known[s, i, step, n] = value
        return value

    def _compound(self, part: Compound, node) -> int:
        attributes = node.attributes
        if part.tag and part.tag != node.tag or part.id is not None and attributes.get("id") != part.id:
            return NO
        if part.classes:
            names = attributes.get("class", "").split()
            if any(c not in names for c in part.classes):
                return NO
        for name, op, wanted, folded in part.attributes:
            if name not in attributes:
                return NO
            if op and not _attribute(attributes[name], op, wanted, folded):
                return NO
        value = YES
        for name, given in part.pseudos:
            value = min(value, self._pseudo(name, given, node))
            if not value:
                break
        return value

    def _pseudo(self, name: str, given, node) -> int:
        if name in ("is", "not"):
            value = max(self._match(g, len(g.parts) - 1, node) for g in given)
            return YES - value if name == "not" else value
        if name == "part" or name in AT_REST_NO:
            return NO
        if name == "root":
            return YES if node.parent is None else NO
        if name in ("link", "any-link"):
            return YES if node.tag in ("a", "area") and "href" in node.attributes else NO
        if name == "checked":
            return YES if ("selected" if node.tag == "option" else "checked") in node.attributes else NO
        if name == "first-child":
            return YES if node.before is None else NO
        if name == "last-child":
            return YES if node.parent is None or node.parent.last is node else NO
        return PERHAPS


def _attribute(value: str, op: str, wanted: str, folded: bool) -> bool:
    if folded:
        value, wanted = value.lower(), wanted.lower()
    if op == "=":
        return value == wanted
    if op == "|=":
        return value == wanted or value.startswith(wanted + "-")
    if not wanted:
        return False
    if op == "~=":
        return wanted in value.split()
    return value.startswith(wanted) if op == "^=" else value.endswith(wanted) if op == "$=" else wanted in value
