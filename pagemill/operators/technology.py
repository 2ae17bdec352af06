"""Web technologies by a rule base: text patterns over markup and scripts, key rules over header, cookie and meta maps, implications.

Rules are compiled and checked once on the driver and broadcast. A text rule is tried only on parts that hold its longest
literal. Results are distinct names in order.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagemill.packing import once

TEXT_KEYS, DICT_KEYS = ("html", "script", "dom", "js"), ("headers", "cookies", "meta")

# Expressions that match anything, the least length of a script rule and a name that is none, tags and attributes of
# selectors, words that rule a selector out.
ANYTHING = (".*", "(.*)", "^(.*)$", "^(.+)$", r"([\d\.]+)?", "(^.+$)")
LEAST_JS, NO_JS = 5, "analytics"
TAGS = "a amp-img body button clipPath div embed form html iframe img input link meta noscript object param script style section source title track video".split()
ATTRIBUTES = "action class data-abuse-proto data-animation-type data-bg data-function data-hid data-lazy-src data-meta data-name data-quadpay-src data-page data-src data-srcset data-requiremodule data-testid data-video-provider href id imagesrcset name poster scr src srcset style title type value".split()
NO_SELECTOR = ("browser", "footer", "print-only", ">")
_VALUED = re.compile(rf"({'|'.join(TAGS)})\[({'|'.join(ATTRIBUTES)})[*^]?='?(.*?)'?\]")
_NAMED = re.compile(rf"({'|'.join(TAGS)})\[([a-zA-Z-]+)\]")


def without_version(pattern: str) -> str | None:
    """The pattern without its version or confidence suffix; None if it says nothing."""
    main, cut, suffix = pattern.partition("\\;")
    if cut and ("confidence:0" in suffix or main in ANYTHING and "version:" in suffix):
        return None
    return main


def unsupported(pattern: str) -> bool:
    return any(x in pattern for x in ("(?!", "(?=", "(?<!", "(?<=")) or bool(re.search(r"\\[1-9]", pattern))


def _any_sign(pattern: str) -> str:
    return pattern.replace("[^]", r"[\s\S]")


def list_pattern(pattern: str) -> str | None:
    """A pattern of html, script or dom as it is searched; None if it is dropped."""
    main = without_version(pattern)
    if main is None or unsupported(main):
        return None
    return _any_sign(main.removeprefix("^"))


def js_pattern(variable: str, value: str) -> str | None:
    """A script variable with its value pattern; None if it is dropped."""
    main = without_version(value)
    if not variable or main is None:
        return None
    whole = _any_sign(re.sub(r"([\\.+*?()|\[\]{}^$#&~-])", r"\\\1", variable) + main.removeprefix("^"))
    return None if len(whole.encode()) < LEAST_JS or whole == NO_JS or unsupported(whole) else whole


def value_pattern(value: str) -> str | None:
    """A value pattern of a key rule; None if the key's presence is enough (also for dropped and unsupported patterns)."""
    main = None if not value or value in ANYTHING else without_version(value)
    return _any_sign(main) if main and not unsupported(main) else None


def _within(tag: str) -> str:
    return f"<(?:[^>]*?){tag}"


def _pair(tag: str, part: str) -> str:
    return f"<(?:[^>]*?){tag}(.*?){part}"


def _with_value(tag: str, attribute: str, value: str) -> str:
    dotted = value.replace(".", "\\.")
    return rf"<{tag}\s+(?:[^>]*?\s+)?{attribute}=([\"'])(.*?){dotted}(.*?)"


def _selector_patterns(selector: str) -> list[str]:
    """The patterns of one selector; its shape adds to those of its attributes."""
    out = [_with_value(t, a, v) for t, a, v in _VALUED.findall(selector) if "hidden" not in (a, v)]
    out += [_pair(t, a) for t, a in _NAMED.findall(selector)]
    if selector.startswith("."):
        out.append(_within(selector[1:]))
    elif selector.startswith("div."):
        out.append(_pair("div", selector[4:]))
    elif "#" in selector:
        tag, _, name = selector.partition("#")
        out.append(_pair(tag, name.replace("'", "\\'")) if tag else _within(name))
    elif selector.startswith("[") and selector.endswith("]"):
        inner = selector[1:-1]
        if "=" in selector:
            key, equals, value = inner.replace("^=", "=").replace("*=", "=").partition("=")
            if equals:
                out.append(_pair(key, value))
        else:
            out.append(_within(inner))
    return out


def dom_patterns(dom) -> list[str]:
    """The patterns of a dom field: a selector list, several of them, or an object by selector."""
    if isinstance(dom, str):
        return [p for s in dom.split(", ") for p in _selector_patterns(s.strip())]
    if isinstance(dom, list):
        return [p for s in dom if isinstance(s, str) for p in dom_patterns(s)]
    if not isinstance(dom, dict):
        return []
    out, selectors = [], []
    for keys, item in dom.items():
        if keys.endswith("*") or any(w in keys for w in NO_SELECTOR):
            continue
        for key in map(str.strip, keys.split(",")):
            if key not in TAGS:
                selectors.append(key)
            elif isinstance(item, dict) and isinstance(item.get("attributes"), dict):
                out += [_with_value(key, a, v if isinstance(v, str) else "") for a, v in item["attributes"].items()]
            elif isinstance(item, dict) and isinstance(item.get("text"), str):
                out.append(_with_value(key, "text", item["text"]))
    return out + dom_patterns(selectors)


def _strings(value) -> list[str]:
    return [value] if isinstance(value, str) else [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def _python(pattern: str) -> str:
    """The pattern in this library's syntax: a dollar is the text's very end."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append({r"\z": r"\Z"}.get(pattern[i : i + 2], pattern[i : i + 2]))
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(r"\Z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def longest_literal(pattern: str) -> str:
    """The longest run of characters that every match must hold, '' if there is none."""
    try:
        from re import _parser as parser

        tree = parser.parse(pattern)
    except Exception:  # noqa: BLE001 - another dialect: no prefilter
        return ""
    best = run = ""
    for op, arg in tree:
        if str(op) == "LITERAL":
            run += chr(arg)
            best = max(best, run, key=len)
        else:
            run = ""
    return best


#: A word boundary, not behind an escaped backslash.
_BOUNDARY = re.compile(r"(?<!\\)(?:\\\\)*\\[bB]")


class Rules:
    """A compiled rule base.

    text: by key (name, pattern); dicts: by key and lower-cased name (technology, value pattern or None); implies: the closure;
    skipped: rules whose pattern can't be compiled. strict skips text rules with word boundaries too, which a lazy automaton can't hold.
    """

    def __init__(self, data: str | bytes, chunk_size: int = 28, strict: bool = True):
        try:
            root = json.loads(data)
        except ValueError as e:
            raise ValueError(f"the rules are no JSON: {e}") from e
        if not isinstance(root, dict):
            raise ValueError("the rules are no JSON object")
        apps = root.get("apps", root)
        if not isinstance(apps, dict):
            raise ValueError("apps is no JSON object")
        self.chunk_size, self.strict, self.skipped = max(1, chunk_size), strict, []
        self.text: dict[str, list[tuple[str, str]]] = {k: [] for k in TEXT_KEYS}
        self.dicts: dict[str, dict[str, list[tuple[str, str | None]]]] = {k: defaultdict(list) for k in DICT_KEYS}
        self.implies: dict[str, list[str]] = {}
        for name, app in apps.items():
            if isinstance(app, dict):
                self._read(name, app)
        self.closure = {name: self._closure(name) for name in self.implies}

    def _read(self, name: str, app: dict) -> None:
        found = [(k, list_pattern(p)) for k in ("html", "script") for p in _strings(app.get(k))]
        found += [("dom", list_pattern(p)) for p in dom_patterns(app.get("dom"))]
        if isinstance(app.get("js"), dict):
            found += [("js", js_pattern(k, v if isinstance(v, str) else "")) for k, v in app["js"].items()]
        for key, pattern in found:
            if pattern is None:
                continue
            if self.strict and _BOUNDARY.search(pattern):
                self.skipped.append(f"{name}: {pattern}")
            elif self._compiles(name, pattern, key != "js"):
                self.text[key].append((name, pattern))
        for key in DICT_KEYS:
            for field, value in (app[key].items() if isinstance(app.get(key), dict) else ()):
                pattern = value_pattern(next(iter(_strings(value)), ""))
                if pattern is None or self._compiles(name, pattern, True):
                    self.dicts[key][field.lower()].append((name, pattern))
        implied = [x.partition("\\;")[0] for x in _strings(app.get("implies"))]
        if any(implied):
            self.implies[name] = [x for x in implied if x]

    def _compiles(self, name: str, pattern: str, fold: bool) -> bool:
        try:
            regex.compile(_python(pattern), regex.I if fold else 0)
            return True
        except regex.error:
            self.skipped.append(f"{name}: {pattern}")
            return False

    def _closure(self, name: str) -> list[str]:
        seen, todo = {name}, [name]
        while todo:
            new = [x for x in self.implies.get(todo.pop(), ()) if x not in seen]
            seen.update(new)
            todo += new
        return sorted(seen)

    def counts(self) -> dict[str, int]:
        return {k: len(v) for k, v in self.text.items()} | {k: sum(map(len, v.values())) for k, v in self.dicts.items()} | {"implies": len(self.implies)}

    def resolve(self, names) -> list[str]:
        return sorted({x for n in names for x in self.closure.get(n, [n])})


def _automaton(literals: list[str]):
    """Finds the places of all literals in one pass over a text; None where the library is missing."""
    try:
        import ahocorasick
    except ImportError:
        return None
    places: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(literals):
        if x:
            places[x].append(i)
    out = ahocorasick.Automaton()
    for x, own in places.items():
        out.add_word(x, own)
    if places:
        out.make_automaton()
    return out


class Matcher:
    """The rules made ready in a worker. One pass of an automaton tells which rules' literals a part holds; only these are searched."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.text = {k: [(n, longest_literal(_python(p)).lower() if k != "js" else longest_literal(_python(p)), regex.compile(_python(p), regex.I if k != "js" else 0)) for n, p in v] for k, v in rules.text.items()}
        self.automata = {k: _automaton([x for _, x, _ in v]) for k, v in self.text.items()}
        self.free = {k: [i for i, (_, x, _) in enumerate(v) if not x] for k, v in self.text.items()}
        self.dicts = {k: {f: [(n, p and regex.compile(_python(p), regex.I)) for n, p in v] for f, v in by.items()} for k, by in rules.dicts.items()}

    def _likely(self, key: str, part: str) -> list[int]:
        """The rules that may match a part: those whose literal it holds and those without one."""
        held = part.lower() if key != "js" else part
        if len(held) != len(part):
            return list(range(len(self.text[key])))
        automaton = self.automata[key]
        if automaton is None:
            return [i for i, (_, x, _) in enumerate(self.text[key]) if x in held]
        hits = {i for _, own in automaton.iter(held) for i in own} if len(automaton) else set()
        return sorted(hits.union(self.free[key]))

    def texts(self, key: str, parts) -> set[str]:
        found: set[str] = set()
        for part in parts or ():
            if isinstance(part, bytes):
                try:
                    part = part.decode()
                except UnicodeDecodeError:
                    continue
            if part is None:
                continue
            for i in self._likely(key, part):
                name, _, pattern = self.text[key][i]
                if name not in found:
                    try:
                        if pattern.search(part, timeout=5):
                            found.add(name)
                    except TimeoutError:
                        break  # the rest of the part is given up, what it gave stays
        return found

    def fields(self, key: str, entries) -> list[str]:
        out = []
        for k, v in dict(entries or {}).items():
            if isinstance(k, str) and isinstance(v, str):
                out += [n for n, p in self.dicts[key].get(k.lower(), ()) if p is None or _found(p, v)]
        return out


def _found(pattern, text: str) -> bool:
    """Whether a pattern matches; one that takes too long doesn't."""
    try:
        return bool(pattern.search(text, timeout=5))
    except TimeoutError:
        return False


def _key(key: str, known: tuple[str, ...]) -> None:
    if key not in known:
        raise ValueError(f"no such key: {key}; known are {', '.join(known)}")


def _matcher(spark: SparkSession, rules: Rules):
    shared, made = spark.sparkContext.broadcast(rules), []

    def get() -> Matcher:
        if not made:
            made.append(Matcher(shared.value))
        return made[0]

    return get


def _names(f, *types):
    kind = pa.list_(pa.string())
    if len(types) == 1:

        def run(a: pa.Array) -> pa.Array:
            return pa.array([None if x is None else f(x) for x in a.to_pylist()], kind)
    else:

        def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array) -> pa.Array:
            return pa.array([f(*x) for x in zip(*(y.to_pylist() for y in (a, b, c, d, e)))], kind)

    run.__annotations__ = {k: pa.Array for k in run.__annotations__}
    return once(run, "array<string>")


def detect_text(spark: SparkSession, rules: Rules, key: str, parts: Column) -> Column:
    """Technologies whose rules of one text key match anywhere in some part; null parts give null, none an empty list."""
    _key(key, TEXT_KEYS)
    get = _matcher(spark, rules)
    return _names(lambda x: sorted(get().texts(key, x)), 1)(parts)


def detect_dict(spark: SparkSession, rules: Rules, key: str, entries: Column) -> Column:
    """Technologies whose rules of one map key match; a name may repeat, as often as rules hit."""
    _key(key, DICT_KEYS)
    get = _matcher(spark, rules)
    return _names(lambda x: sorted(get().fields(key, x)), 1)(entries)


def detect(spark: SparkSession, rules: Rules, html: Column, scripts: Column, headers: Column, cookies: Column, meta: Column, implied: bool = True) -> Column:
    """All technologies of a page: array<string> of markup parts and of scripts, array<map<string,string>> for the rest; nulls count as none."""
    get = _matcher(spark, rules)

    def f(h, s, *maps) -> list[str]:
        m = get()
        found = m.texts("html", h) | m.texts("dom", h) | m.texts("script", s) | m.texts("js", s)
        for key, entries in zip(DICT_KEYS, maps):
            for e in entries or ():
                found.update(m.fields(key, e))
        return rules.resolve(found) if implied else sorted(found)

    return _names(f, 1, 2, 3, 4, 5)(html, scripts, headers, cookies, meta)


def resolve(rules: Rules, names: Column) -> Column:
    """Names with all they imply, native: a map of closures looked up."""
    if not rules.closure:
        return F.array_sort(F.array_distinct(names))
    closure = F.create_map(*[x for k, v in rules.closure.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(closure, n), F.array(n))))))


def html_parts(html: Column) -> Column:
    """A body cut after its divisions, as rules expect it."""
    return F.split(html, "(?i)(?<=</div>)")
