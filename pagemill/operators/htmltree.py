"""HTML documents as trees: tokens, tree construction after the public HTML standard, CSS selection, serialising.

A parsed document is a flat list of nodes in document order; every node knows its parent and the last node of its subtree, so
subtrees are index ranges and removing one is marking a range.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset(("title", "textarea"))
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt listing xmp plaintext".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE_END = frozenset("applet caption html table td th marquee object template".split())
SPECIAL = CLOSES_P | IN_HEAD | SCOPE_END | frozenset("body head html tbody tfoot thead tr col colgroup iframe select textarea button input img br embed param source track wbr area".split())
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
SPACE = " \t\n\f\r"

_NAME = re.compile(r"[^\s/>\x00]+")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


class Node:
    """kind: doc, el, text, comment or doctype. index, end: set once the tree is complete."""

    __slots__ = ("kind", "tag", "attrs", "text", "children", "parent", "index", "end")

    def __init__(self, kind: str, tag: str = "", attrs: dict | None = None, text: str = ""):
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs if attrs is not None else {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.index = self.end = -1


def _attribute_text(value: str) -> str:
    if "&" not in value:
        return value

    def put(m: re.Match) -> str:
        after = value[m.end() : m.end() + 1]
        if not m[0].endswith(";") and not m[1].startswith("#") and (after == "=" or after.isalnum()):
            return m[0]
        return html.unescape(m[0])

    return _REFERENCE.sub(put, value)


def tokens(text: str):
    """('text', s), ('start', name, attrs, closed), ('end', name), ('comment', s) and ('doctype', s)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    i, n = 0, len(text)
    while i < n:
        j = text.find("<", i)
        if j < 0:
            yield "text", html.unescape(text[i:])
            return
        c = text[j + 1 : j + 2]
        if not (c.isascii() and c.isalpha() or c in ("/", "!", "?")) or c == "/" and not (text[j + 2 : j + 3].isascii() and text[j + 2 : j + 3].isalpha() or text[j + 2 : j + 3] == ">" or j + 2 < n):
            k = text.find("<", j + 1)
            k = n if k < 0 else k
            yield "text", html.unescape(text[i:k])
            i = k
            continue
        if j > i:
            yield "text", html.unescape(text[i:j])
        if c == "!":
            if text.startswith("<!--", j):
                k = text.find("-->", j + 4) if not text.startswith(("<!-->", "<!--->"), j) else j + (2 if text.startswith("<!-->", j) else 3)
                yield "comment", text[j + 4 : max(j + 4, k)] if k >= 0 else text[j + 4 :]
                i = n if k < 0 else k + 3
            else:
                k = text.find(">", j)
                body = text[j + 2 : k if k >= 0 else n]
                yield ("doctype", body[7:].strip()) if body[:7].lower() == "doctype" else ("comment", body)
                i = n if k < 0 else k + 1
            continue
        if c == "?" or (c == "/" and not text[j + 2 : j + 3].isalpha()):
            k = text.find(">", j)
            if c == "?" or text[j + 2 : j + 3] != ">":
                yield "comment", text[j + 1 if c == "?" else j + 2 : k if k >= 0 else n]
            i = n if k < 0 else k + 1
            continue
        m = _NAME.match(text, j + 2 if c == "/" else j + 1)
        name, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        while True:
            while at < n and (text[at] in SPACE or text[at] == "/" and text[at + 1 : at + 2] != ">"):
                at += 1
            if at >= n or text[at] == ">" or text[at] == "/":
                break
            m = _ATTR.match(text, at)
            if not m or m.end() == at:
                at += 1
                continue
            key = m[1].lower()
            if key not in attrs:
                attrs[key] = _attribute_text(next((v for v in m.groups()[1:] if v is not None), ""))
            at = m.end()
        if at >= n:
            return  # the text ends inside a tag
        closed = text[at] == "/"
        i = at + (2 if closed else 1)
        if c == "/":
            yield "end", name
            continue
        yield "start", name, attrs, closed
        if name in RAW or name in ESCAPABLE:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, i)
            stop = m.start() if m else n
            if stop > i:
                inner = text[i:stop]
                if name == "textarea" and inner.startswith("\n"):
                    inner = inner[1:]
                yield "raw", html.unescape(inner) if name in ESCAPABLE else inner
            i = stop
        elif name == "plaintext":
            yield "raw", text[i:]
            return


class Builder:
    """Tree construction: implied elements, closing rules, open formatting and misnested tables."""

    def __init__(self):
        self.root = Node("doc")
        self.open: list[Node] = []
        self.active: list[Node | None] = []
        self.html = self.head = self.body = None
        self.skip_newline = False

    def place(self) -> tuple[Node, int]:
        """Where the next node goes: the current node, or before a table that may not hold it."""
        top = self.open[-1]
        return top, len(top.children)

    def foster(self) -> tuple[Node, int]:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == "table":
                table = self.open[k]
                if table.parent:
                    return table.parent, table.parent.children.index(table)
                return self.open[k - 1], len(self.open[k - 1].children)
        return self.place()

    def put(self, node: Node, at: tuple[Node, int] | None = None) -> Node:
        parent, k = at or self.place()
        node.parent = parent
        parent.children.insert(k, node)
        return node

    def in_table(self) -> bool:
        return self.open[-1].tag in TABLE_PARTS

    def text(self, s: str) -> None:
        if not s:
            return
        outside = self.in_table() and s.strip(SPACE)
        parent, k = self.foster() if outside else self.place()
        if k and parent.children[k - 1].kind == "text":
            parent.children[k - 1].text += s
        else:
            self.put(Node("text", text=s), (parent, k))

    def element(self, name: str, attrs: dict, outside: bool = False) -> Node:
        node = self.put(Node("el", name, attrs), self.foster() if outside else None)
        self.open.append(node)
        return node

    def need(self, body: bool) -> None:
        """html, head and, if asked, body exist."""
        if not self.html:
            self.html = Node("el", "html")
            self.root.children.append(self.html)
            self.html.parent = self.root
            self.open = [self.html]
        if not self.head:
            self.head = self.element("head", {})
        if body and not self.body:
            while self.open[-1] is not self.html:
                self.open.pop()
            self.body = self.element("body", {})

    def in_scope(self, name: str, ends: frozenset = SCOPE_END) -> bool:
        for node in reversed(self.open):
            if node.tag == name:
                return True
            if node.tag in ends:
                return False
        return False

    def imply(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self.open.pop()

    def pop_to(self, name: str) -> None:
        while self.open.pop().tag != name:
            pass

    def close_p(self) -> None:
        if self.in_scope("p", SCOPE_END | {"button"}):
            self.imply("p")
            self.pop_to("p")

    def reopen(self) -> None:
        """Open formatting elements again that a closed block took with it."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.open:
            k -= 1
        for i in range(k, len(self.active)):
            old = self.active[i]
            self.active[i] = self.element(old.tag, dict(old.attrs), self.in_table())

    def adopt(self, name: str) -> None:
        """The end tag of a formatting element, also if blocks overlap it."""
        if self.open[-1].tag == name and self.open[-1] not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            made = None
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == name:
                    made = node
                    break
            if made is None:
                self.other_end(name)
                return
            if made not in self.open:
                self.active.remove(made)
                return
            if not self.in_scope(name):
                return
            at = self.open.index(made)
            block = next((x for x in self.open[at + 1 :] if x.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.active.remove(made)
                return
            above, mark, last = self.open[at - 1], self.active.index(made), block
            k = self.open.index(block)
            for count in range(1, k - at + 1):
                node = self.open[k - count]
                if node is made:
                    break
                if count > 3 and node in self.active:
                    gone = self.active.index(node)
                    del self.active[gone]
                    mark -= gone < mark
                if node not in self.active:
                    self.open.remove(node)
                    continue
                copy = Node("el", node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = copy
                self.open[self.open.index(node)] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                self._move(last, copy)
                last = copy
            if above.tag in TABLE_PARTS:
                last.parent.children.remove(last)
                self.put(last, self.foster())
            else:
                self._move(last, above)
            copy = Node("el", made.tag, dict(made.attrs))
            for child in list(block.children):
                self._move(child, copy)
            self._move(copy, block)
            where = self.active.index(made)
            del self.active[where]
            self.active.insert(mark - (where < mark), copy)
            self.open.remove(made)
            self.open.insert(self.open.index(block) + 1, copy)

    @staticmethod
    def _move(node: Node, to: Node) -> None:
        if node.parent:
            node.parent.children.remove(node)
        node.parent = to
        to.children.append(node)

    def other_end(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == name:
                self.imply(name)
                del self.open[k:]
                return
            if self.open[k].tag in SPECIAL:
                return

    def start(self, name: str, attrs: dict, closed: bool) -> None:
        if name == "html":
            if not self.html:
                self.html = Node("el", "html", attrs)
                self.root.children.append(self.html)
                self.html.parent = self.root
                self.open = [self.html]
            else:
                for k, v in attrs.items():
                    self.html.attrs.setdefault(k, v)
            return
        if name == "head":
            if not self.head:
                self.need(False)
                self.head.attrs.update(attrs)
            return
        if not self.body and (name in IN_HEAD):
            self.need(False)
            if self.head not in self.open:
                self.open.append(self.head)
                self.element(name, attrs)
                if name in VOID:
                    self.open.pop()
                if name not in RAW | ESCAPABLE | {"template"}:
                    self.open.remove(self.head)
                return
            self.element(name, attrs)
            if name in VOID or name in ("basefont", "bgsound"):
                self.open.pop()
            return
        if name in ("body", "frameset"):
            if self.body:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            else:
                self.need(True)
                self.body.attrs.update(attrs)
            return
        self.need(True)
        self.body_start(name, attrs, closed)

    def body_start(self, name: str, attrs: dict, closed: bool) -> None:
        top = self.open[-1].tag
        if name in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "col", "colgroup"):
            if not self.in_scope("table", frozenset(("html", "template"))):
                return
            self.table_start(name, attrs)
            return
        outside = self.in_table() and name not in ("script", "style", "template") and not (name == "input" and attrs.get("type", "").lower() == "hidden")
        if name in CLOSES_P:
            self.close_p()
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and top in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        elif name == "li":
            self.close_item(("li",))
        elif name in ("dd", "dt"):
            self.close_item(("dd", "dt"))
        elif name in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.open.pop()
            if name == "optgroup" and self.open[-1].tag == "optgroup":
                self.open.pop()
        elif name == "button" and self.in_scope("button"):
            self.imply()
            self.pop_to("button")
        elif name in ("rp", "rt", "rb", "rtc"):
            self.imply()
        elif name == "a":
            old = next((x for x in reversed(self.active) if x is None or x.tag == "a"), None)
            if old is not None:
                self.adopt("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.open:
                    self.open.remove(old)
        elif name == "nobr" and self.in_scope("nobr"):
            self.reopen()
            self.adopt("nobr")
        if name in CLOSES_P and name not in ("xmp",) or name in ("script", "style", "template", "param", "source", "track"):
            pass
        else:
            self.reopen()
        if name == "image":
            name = "img"
        node = self.element(name, attrs, outside)
        if name in FORMATTING:
            self.active.append(node)
        elif name in ("applet", "marquee", "object"):
            self.active.append(None)
        if name in VOID or name == "param" or (closed and name in ("svg", "math", "path", "rect", "circle", "use", "g", "line", "polygon")):
            self.open.pop()
        if name in ("pre", "listing"):
            self.skip_newline = True

    def close_item(self, names: tuple) -> None:
        for node in reversed(self.open):
            if node.tag in names:
                self.imply(node.tag)
                self.pop_to(node.tag)
                break
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                break
        self.close_p()

    def table_start(self, name: str, attrs: dict) -> None:
        def back(*to: str) -> None:
            while self.open[-1].tag not in (*to, "html", "template"):
                self.open.pop()

        while self.active and self.active[-1] is not None and self.active[-1] in self.open and self.open.index(self.active[-1]) > max(k for k, x in enumerate(self.open) if x.tag == "table"):
            self.active.pop()
        if name in ("td", "th"):
            back("tr", "tbody", "thead", "tfoot", "table")
            if self.open[-1].tag == "table":
                self.element("tbody", {})
            if self.open[-1].tag != "tr":
                self.element("tr", {})
            self.element(name, attrs)
            self.active.append(None)
            return
        if name == "tr":
            back("tbody", "thead", "tfoot", "table")
            if self.open[-1].tag == "table":
                self.element("tbody", {})
        elif name == "col":
            back("colgroup", "table")
            if self.open[-1].tag == "table":
                self.element("colgroup", {})
        else:
            back("table")
        self.element(name, attrs)
        if name == "col":
            self.open.pop()

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            self.need(True)
            return  # what follows still belongs to the body
        if name == "head":
            if not self.body:
                self.need(False)
                while self.open[-1] is not self.html:
                    self.open.pop()
            return
        if not self.body and self.open and self.open[-1].tag == name and self.open[-1] not in (self.html, self.head):
            self.open.pop()
            if self.head in self.open and self.open[-1] is self.head and getattr(self, "left_head", False):
                self.open.remove(self.head)
            return
        if not self.body and name != "br":
            if not self.html or name not in ("p",):
                return
        self.need(True)
        if name == "br":
            self.body_start("br", {}, False)
        elif name == "p":
            if not self.in_scope("p", SCOPE_END | {"button"}):
                self.element("p", {})
            self.close_p()
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if any(self.in_scope(x) for x in ("h1", "h2", "h3", "h4", "h5", "h6")):
                self.imply()
                while self.open.pop().tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    pass
        elif name in ("td", "th", "caption", "tr", "tbody", "thead", "tfoot", "table", "applet", "marquee", "object"):
            if self.in_scope(name, frozenset(("html", "template", "table")) - {name}):
                self.pop_to(name)
                if name in ("td", "th", "caption", "applet", "marquee", "object"):
                    while self.active and self.active.pop() is not None:
                        pass
        elif name == "li":
            if self.in_scope("li", SCOPE_END | {"ol", "ul"}):
                self.imply("li")
                self.pop_to("li")
        elif name in CLOSES_P or name in ("button", "select", "form"):
            if self.in_scope(name):
                self.imply()
                self.pop_to(name)
        else:
            self.other_end(name)

    def feed(self, text: str) -> None:
        for token in tokens(text):
            kind = token[0]
            if kind in ("text", "raw"):
                s = token[1]
                if self.skip_newline:
                    s = s[1:] if s.startswith("\n") else s
                    self.skip_newline = False
                if kind == "raw":
                    self.text(s)
                    continue
                s = s.replace("\x00", "")
                if not self.body:
                    inner = self.open and self.open[-1] not in (self.html, self.head)
                    if inner:
                        self.text(s)
                        continue
                    rest = s.lstrip(SPACE)
                    blank = s[: len(s) - len(rest)]
                    if self.head:  # in the head, or after it, white space stays where it stands
                        self.text(blank)
                    s = rest
                    if not s:
                        continue
                    self.need(True)
                if s.strip(SPACE):
                    self.reopen()
                self.text(s)
            elif kind == "start":
                self.skip_newline = False
                self.start(*token[1:])
            elif kind == "end":
                self.end(token[1])
            elif kind == "comment":
                if not self.html:
                    node = Node("comment", text=token[1])
                    node.parent = self.root
                    self.root.children.append(node)
                else:
                    self.put(Node("comment", text=token[1]))
            elif kind == "doctype" and not self.html:
                node = Node("doctype", text=token[1])
                node.parent = self.root
                self.root.children.append(node)
        self.need(True)


def parse(text: str) -> list[Node]:
    """All nodes in document order, the document first."""
    builder = Builder()
    builder.feed(text)
    out: list[Node] = []
    stack: list[tuple[Node, bool]] = [(builder.root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            node.end = len(out) - 1
            continue
        node.index = len(out)
        out.append(node)
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    return out


# --- selection -----------------------------------------------------------------------------------------------------------

_PART = re.compile(r"""(?P<any>\*)|(?P<id>\#(?:[\w-]|[^\x00-\x7f]|\\.)+)|(?P<cls>\.-?(?:[A-Za-z_]|[^\x00-\x7f]|\\.)(?:[\w-]|[^\x00-\x7f]|\\.)*)|(?P<attr>\[\s*(?P<key>[\w-]+(?:\\?:[\w-]+)?)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[\w-]+)\s*(?P<ci>[iI])?\s*)?\])|(?P<not>:not\()|(?P<pseudo>:(?:first-child|last-child|only-child|empty|root|first-of-type|last-of-type))|(?P<tag>[A-Za-z][\w-]*)""")


def _undo(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _compound(s: str, i: int) -> tuple[list, int]:
    """The simple selectors that stand at i as (kind, …), and where they end."""
    out: list = []
    while i < len(s):
        m = _PART.match(s, i)
        if not m or (m["tag"] or m["any"]) and out:
            break
        i = m.end()
        if m["not"]:
            inner, i = _compound(s, i + len(s[i:]) - len(s[i:].lstrip()))
            i += len(s[i:]) - len(s[i:].lstrip())
            if not inner or s[i : i + 1] != ")":
                raise ValueError(f"no such selector: {s}")
            out.append(("not", inner))
            i += 1
        elif m["attr"]:
            value = m["val"]
            out.append(("attr", m["key"].lower().replace("\\", ""), m["op"], value[1:-1] if value and value[0] in "\"'" else value, bool(m["ci"])))
        elif m["any"]:
            out.append(("any",))
        else:
            out.append((m.lastgroup, _undo(m[m.lastgroup]).lstrip("#.:") if m.lastgroup != "tag" else m["tag"].lower()))
    return out, i


def compile_selector(text: str) -> list[list[tuple[str, list]]]:
    """A selector list as chains of (combinator before, compound); ValueError if it can't be read."""
    chains = []
    for part in _commas(text):
        s, i, chain, joint = part.strip(), 0, [], ""
        if not s:
            raise ValueError(f"no such selector: {text!r}")
        while i < len(s):
            compound, j = _compound(s, i)
            if not compound:
                raise ValueError(f"no such selector: {text!r}")
            chain.append((joint, compound))
            m = re.compile(r"\s*([>+~])\s*|\s+").match(s, j)
            if j < len(s) and (not m or m.end() == len(s)):
                raise ValueError(f"no such selector: {text!r}")
            joint, i = (m[1] or " ", m.end()) if m and j < len(s) else ("", len(s))
        chains.append(chain)
    return chains


def _commas(s: str) -> list[str]:
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(s[at:i])
            at = i + 1
    return [*out, s[at:]]


def _fits(node: Node, compound: list) -> bool:
    for kind, *x in compound:
        if kind == "tag":
            ok = node.tag == x[0]
        elif kind == "any":
            ok = True
        elif kind == "id":
            ok = node.attrs.get("id") == x[0]
        elif kind == "cls":
            ok = x[0] in node.attrs.get("class", "").split()
        elif kind == "not":
            ok = not _fits(node, x[0])
        elif kind == "attr":
            key, op, want, ci = x
            have = node.attrs.get(key)
            if have is None:
                return False
            if op and ci:
                have, want = have.lower(), want.lower()
            ok = not op or {"=": have == want, "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have, "~=": want in have.split(), "|=": have == want or have.startswith(f"{want}-")}[op]
        else:
            own = [c for c in node.parent.children if c.kind == "el"] if node.parent else [node]
            like = [c for c in own if c.tag == node.tag]
            ok = {"first-child": own[0] is node, "last-child": own[-1] is node, "only-child": len(own) == 1, "empty": not any(c.kind == "el" or c.kind == "text" and c.text for c in node.children), "root": bool(node.parent) and node.parent.kind == "doc", "first-of-type": like[0] is node, "last-of-type": like[-1] is node}[x[0]]
        if not ok:
            return False
    return True


def _matches(node: Node, chain: list, k: int) -> bool:
    if not _fits(node, chain[k][1]):
        return False
    if not k:
        return True
    joint = chain[k][0]
    if joint in (" ", ">"):
        up = node.parent
        while up is not None and up.kind == "el":
            if _matches(up, chain, k - 1):
                return True
            if joint == ">":
                return False
            up = up.parent
        return False
    before = [c for c in node.parent.children if c.kind == "el"] if node.parent else []
    at = next(i for i, c in enumerate(before) if c is node) if before else 0
    return any(_matches(c, chain, k - 1) for c in (before[at - 1 : at] if joint == "+" else before[:at]))


def matches(node: Node, selector: list) -> bool:
    return any(_matches(node, chain, len(chain) - 1) for chain in selector)


def select(nodes: list[Node], selector: list) -> list[Node]:
    """The elements that a compiled selector matches, in document order."""
    return [n for n in nodes if n.kind == "el" and matches(n, selector)]


# --- serialising ---------------------------------------------------------------------------------------------------------


def serialise(node: Node, gone: set[int] = frozenset()) -> str:
    """Markup of a node, leaving out the subtrees whose index is in gone."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.index in gone:
            continue
        if x.kind == "text":
            raw = x.parent is not None and x.parent.tag in RAW | {"plaintext"}
            out.append(x.text if raw else x.text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif x.kind == "comment":
            out.append(f"<!--{x.text}-->")
        elif x.kind == "doctype":
            out.append(f"<!DOCTYPE {(x.text.split() or [''])[0].lower()}>")
        else:
            if x.kind == "el":
                attrs = "".join(' {}="{}"'.format(k, v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")) for k, v in x.attrs.items())
                out.append(f"<{x.tag}{attrs}>")
                if x.tag in VOID:
                    continue
                stack.append(f"</{x.tag}>")
            stack.extend(reversed(x.children))
    return "".join(out)
