"""Template expansion: calls, parser functions, variables, arguments.

``Expander.expand`` replaces every ``{{...}}`` outside raw areas. A call that comes up
inside itself expands to nothing, as does one nested deeper than the context allows.
"""

from __future__ import annotations

import re

from ..functions.dates import DAYS, MONTHS
from . import strings as S
from .context import VERSION, Context

# Fixed values.
TABLE_ESCAPES = {
    "!": "|", "!-": "|-", "!!": "||", "!-!": "|-\n|", "!+": "|+", "!~": "|-\n!", "(!": "{|", "!)": "|}", "((": "{{", "))": "}}",
}
NAMESPACES = {
    1: "Talk", 2: "User", 3: "User_talk", 4: "Wikipedia", 5: "Wikipedia_talk", 6: "Image", 7: "Image_talk", 8: "MediaWiki",
    9: "MediaWiki_talk", 10: "Template", 11: "Template_talk", 12: "Help", 13: "Help_talk", 14: "Category", 15: "Category_talk",
}
CONSTANTS = {
    "REVISIONID": "0", "REVISIONDAY": "1", "REVISIONDAY2": "01", "REVISIONMONTH": "01", "REVISIONYEAR": "2007",
    "REVISIONTIMESTAMP": "20070101000000", "SITENAME": "Offline-Wikipedia", "SERVER": "http://127.0.0.1",
    "SERVERNAME": "127.0.0.1", "SCRIPTPATH": "", "/scripts": "", "CURRENTVERSION": VERSION, "NUMBEROFEDITS": "1",
    "NUMBEROFPAGES": "1", "NUMBEROFFILES": "1", "NUMBEROFUSERS": "1", "NUMBEROFADMINS": "1", "PAGESINNAMESPACE": "1",
    "DIRMARK": "", "DIRECTIONMARK": "", "reflist": "<references />",
}
IGNORED_TEMPLATES = {"commons"}
BUILT_IN = {"tl": "{{[[Template:{{{1}}}|{{{1}}}]]}}"}
RAW_AREAS = {"nowiki", "pre", "source"}

_OPEN = re.compile(r"\{\{|<(/?)([^\s<>/]*)[^>]*>?")
_TALK = re.compile(r"(?:TALK|SUBJECT|ARTICLE)(?:SPACE|PAGENAME)E?")


def template_text(body: str) -> str:
    """What a template contributes to a page: its onlyinclude part, or the body without noinclude parts."""
    begin = body.find("<onlyinclude>")
    if begin >= 0:
        part, closed, _ = body[begin + 13 :].partition("</onlyinclude>")
        return part if closed else ""
    out, hidden, at = [], 0, 0
    for m in re.finditer(r"<(/?)([^>]*)>", body):
        if not hidden:
            out.append(body[at : m.start()])
        at = m.end()
        if m[2] == "noinclude":
            hidden += -1 if m[1] else 1
        elif m[2] != "includeonly" and not hidden:
            out.append(m[0])
    if not hidden:
        rest, tag, _ = body[at:].partition("<")  # a tag that never ends takes the rest
        out.append(rest)
    return "".join(out)


def bind(arguments: str) -> list[tuple[str, str, str]]:
    """(position, name, value) of a call's arguments: all named if the first has an equals sign, else all positional."""
    parts = S.split_top(arguments) if arguments else []
    if parts and not parts[-1]:
        parts.pop()
    if not parts:
        return []
    if "=" not in S.trim(parts[0]):
        return [(str(i), "", S.trim(p)) for i, p in enumerate(parts, 1)]
    found: list[tuple[str, str, str]] = []
    for part in map(S.trim, parts):
        name, equals, value = part.partition("=")
        if equals:
            if S.trim(name):
                found.append((str(len(found) + 1), S.trim(name), S.trim_right(value)))
        elif found and part:
            position, name, value = found[-1]
            found[-1] = (position, name, f"{value}| {part}")
    return found


def substitute(body: str, arguments: list[tuple[str, str, str]], most: int = 10_000) -> str:
    """Replaces ``{{{name|default}}}``; what was put in is looked through again.

    A value that holds arguments itself may put itself in without end; so ``most`` such values are looked through.
    """
    at = 0
    while most and (at := body.find("{{{", at)) >= 0:
        begin = at + 3
        while body[begin : begin + 1] == "{":
            begin += 1
        depth = 3
        end = begin
        while depth and end < len(body):
            c = body[end]
            depth += (c == "{") - (c == "}")
            if depth < 3 and c != "}":
                break
            end += 1
        if depth:
            at = end
            continue
        name, _, default = S.trim(body[begin : end - 3]).partition("|")
        name = S.trim(name)
        value = next((v for position, n, v in arguments if name in (n, position)), "") or default
        most -= "{{{" in value
        at = begin - 3
        body = body[:at] + value + body[end:]
    return body


def call_arguments(text: str) -> list[tuple[int, str, int, str, str]]:
    """(call, template, position, name, value) of the arguments of a text's outermost calls."""
    out, at, call = [], 0, 0
    text = S.COMMENT.sub("", text)
    while (begin := text.find("{{", at)) >= 0:
        end = Expander.closing(text, begin + 2)
        if end is None:
            break
        call += 1
        name, *rest = S.split_top(text[begin + 2 : end - 2], 1)
        out += [(call, S.trim(name), int(position), key, value) for position, key, value in bind(rest[0] if rest else "")]
        at = end
    return out


class Expander:
    def __init__(self, context: Context):
        self.c = context
        self.open: list[str] = []

    # -- scanning

    def expand(self, text: str) -> str:
        """The text without comments and with its calls expanded (or deleted, if expansion is off)."""
        text = S.COMMENT.sub("", text)
        if "{{" not in text:
            return text
        out, at, raw = [], 0, None
        while m := _OPEN.search(text, at if at < len(text) else len(text)):
            if m[0] != "{{":
                name = m[2]
                if raw is None and not m[1] and name in RAW_AREAS:
                    raw = name
                elif m[1] and name == raw:
                    raw = None
                # Braces in a tag's attributes are calls too.
                stop = m.end() if raw is not None or "{{" not in m[0] else m.start() + m[0].index("{{")
                out.append(text[at:stop])
                at = stop
                continue
            if raw is not None:
                out.append(text[at : m.end()])
                at = m.end()
                continue
            end = self.closing(text, m.end())
            if end is None:
                if not any(isinstance(x, tuple) for x in out):
                    return text
                out += [text[at : m.start()], text[m.end() : -1]]
                return "".join(x if isinstance(x, str) else x[0] for x in out)
            out.append(text[at : m.start()])
            inner = text[m.end() : end - 2]
            out.append((self.call_fully(inner) if self.c.expand and inner else "",))
            at = end
        out.append(text[at:])
        return "".join(x if isinstance(x, str) else x[0] for x in out)

    @staticmethod
    def closing(text: str, at: int) -> int | None:
        depth = 2
        for m in re.compile(r"[{}]").finditer(text, at):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.end()
        return None

    def call_fully(self, inner: str) -> str:
        """A call's text, expanded again until it no longer changes; a call inside itself, or too deep, gives nothing."""
        if inner in self.open or len(self.open) >= self.c.depth:
            return ""
        self.open.append(inner)
        try:
            got, seen = self.call(inner) or "", set()
            while len(got) > 4 and got not in seen and len(seen) < self.c.depth:
                seen.add(got)
                got = self.expand(got)
            return got
        finally:
            self.open.pop()

    def inside(self, text: str) -> str:
        """An argument with its own calls expanded and then trimmed; one without calls stays as it is."""
        return S.trim(self.expand(text)) if "{{" in text else text

    # -- calls

    def call(self, inner: str) -> str | None:
        known = self.variable(inner)
        if known is not None:
            return known
        name, *rest = S.split_top(inner, 1)
        tail = rest[0] if rest else None
        name = S.trim(name)
        if not name.startswith("#") and "{{" in name:
            name = S.trim(self.expand(name))
        if name.startswith("#"):
            for prefix, function in self.FUNCTIONS.items():
                if name.startswith(prefix):
                    return function(self, name[len(prefix) :], tail)
            return f"USP:{name}"
        return self.template(name, tail or "")

    @staticmethod
    def choose(taken: bool, branches: str) -> str | None:
        first, *rest = S.split_top(branches, 1)
        if taken:
            return S.trim_right(first) if branches else None
        return rest[0] if rest and rest[0] is not None else None

    def f_if(self, condition: str, tail: str | None) -> str | None:
        return None if tail is None else self.choose(bool(self.inside(condition)), tail)

    def f_ifexist(self, title: str, tail: str | None) -> str | None:
        if tail is None:
            return None
        found = S.lower(self.inside(title)) in self.c.titles
        return self.choose(bool(title) and (not found if self.c.compat else found), tail)

    def f_ifexpr(self, expression: str, tail: str | None) -> str | None:
        if tail is None:
            return None
        return self.choose(not self.c.compat and bool(evaluate(self.inside(expression))), tail)

    def f_expr(self, expression: str, tail: str | None) -> str | None:
        if self.c.compat:
            return "0" if tail is not None and expression else None
        return f"{evaluate(self.inside(expression)):g}" if expression else None

    def compare(self, negate: bool, left: str, tail: str | None) -> str | None:
        parts = S.split_top(tail, 2) if tail is not None else []
        if len(parts) < 2:
            return None
        left, right = self.inside(S.trim(left)), self.inside(S.trim(parts[0]))
        equal = left == right
        if negate:
            equal = False if self.c.compat else not equal
        if equal:
            return S.trim(parts[1])
        return S.trim(parts[2]) if len(parts) > 2 else None

    def f_switch(self, phrase: str, tail: str | None) -> str | None:
        if tail is None:
            return None
        phrase = self.inside(S.trim(phrase))
        default, falls, falls_default = None, False, False
        for part in S.split_top(tail):
            name, equals, value = part.partition("=")
            if not equals:
                falls |= part == phrase
                falls_default |= part == "#default"
            elif S.trim(name) == phrase or falls:
                return value
            elif S.trim(name) == "#default" or falls_default:
                default, falls_default = value, False
        return default

    FUNCTIONS = {
        "#if:": f_if, "#ifexist:": f_ifexist, "#ifexpr:": f_ifexpr, "#expr:": f_expr,
        "#ifeq:": lambda self, left, tail: self.compare(False, left, tail),
        "#ifneq:": lambda self, left, tail: self.compare(True, left, tail), "#switch:": f_switch,
    }

    def unknown(self, name: str) -> str:
        return f'<span class="wkUnknownTemplate">{self.c.template_prefix()}{name}</span>'

    def full_name(self, name: str) -> str:
        name = name.replace("_", " ")
        if name.startswith(":"):
            return name[1:]
        return name if ":" in name else self.c.template_prefix() + name

    def template(self, name: str, arguments: str) -> str | None:
        if S.lower(name) in IGNORED_TEMPLATES:
            return None
        body = BUILT_IN.get(name) or self.c.templates.get(S.lower(self.full_name(name)))
        if body is None or body == "-":
            return self.unknown(name)
        if body == "{{" + name + "}}":
            return None
        if "{{" in arguments:
            arguments = self.expand(arguments)
        text = substitute(body, bind(arguments))
        return "\n" + text if text.startswith("{|") else text

    # -- variables and simple functions

    def variable(self, text: str) -> str | None:
        c = self.c
        if text in TABLE_ESCAPES:
            return TABLE_ESCAPES[text]
        if text in CONSTANTS:
            return CONSTANTS[text]
        if text.startswith("PAGESINNS:"):
            return "1"
        if text.startswith(("DISPLAYTITLE:", "DEFAULTSORT")):
            return ""
        if text == "CONTENTLANGUAGE":
            return c.lang
        if text == "NUMBEROFARTICLES":
            return str(c.n_articles)
        if _TALK.fullmatch(text):
            return ""
        for clock in ("CURRENT", "LOCAL"):
            if text.startswith(clock):
                value = self.clock(text[len(clock) :])
                if value is not None:
                    return value
        page = self.page_name(text[:-1] if text.endswith("EE") else text)  # the escaped forms give the same
        return page if page is not None else self.simple(text)

    def page_name(self, text: str) -> str | None:
        c = self.c
        if text == "PAGENAME":
            return c.page
        if text == "SUBPAGENAME":
            return c.page.rpartition("/")[2] if "/" in c.page else ""
        if text == "BASEPAGENAME":
            return c.page.partition("/")[0] if "/" in c.page else ""
        return {"NAMESPACE": c.lang, "FULLPAGENAME": f"{c.lang}/{c.page}"}.get(text)

    def clock(self, name: str) -> str | None:
        now, translate = self.c.now, self.c.config.get
        day, month = DAYS[(now.weekday() + 1) % 7], MONTHS[now.month - 1]
        values = {
            "DAY": str(now.day), "DAY2": f"{now.day:02d}", "DAYNAME": translate(day, day), "DOW": str((now.weekday() + 1) % 7),
            "MONTH": f"{now.month:02d}", "MONTHABBREV": translate(month[:3], month[:3]), "MONTHNAME": translate(month, month),
            "MONTHNAMEGEN": translate(month, month), "TIME": f"{now:%H:%M}", "HOUR": f"{now:%H}", "MINUTE": f"{now:%M}",
            "WEEK": str((now.timetuple().tm_yday - 1) // 7 + 1), "YEAR": f"{now.year:04d}",
            "TIMESTAMP": f"{now.year:04d}{now.month - self.c.compat:02d}{now:%d%H%M%S}",
        }
        return values.get(name)

    def simple(self, text: str) -> str | None:
        head, colon, value = text.partition(":")
        if text.startswith("convert|"):
            return text[8:]
        if text.startswith("Dmoz|"):
            return ""
        if not colon:
            return None
        if head == "ns":
            name = NAMESPACES.get(int(value)) if value.isdigit() else None
            return name or self.unknown(text)
        if head in ("urlencode", "anchorencode"):
            return S.anchor_encode(value) if len(value) > 1 else self.unknown(text)
        if head == "formatnum":
            separator = (self.c.config.get("decimalSeperator") or ",")[0]
            return S.format_number(S.trim(value), separator, self.c.compat) if value else self.unknown(text)
        plain = {
            "localurl": lambda v: f"{self.c.lang}/{v}", "fullurl": lambda v: f"http://127.0.0.1/wiki/{self.c.lang}/{v}",
            "#language": str, "lc": S.lower, "uc": S.upper, "lcfirst": lambda v: S.lower(v[:1]) + v[1:],
            "ucfirst": lambda v: S.upper(v[:1]) + v[1:], "padleft": str, "padright": str,
        }
        return plain[head](value) if head in plain else None


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(and|or|not|mod|div|<>|!=|<=|>=|[-+*/^%()=<>]))", re.I)


def evaluate(expression: str) -> float:
    """Arithmetic and comparisons of an expression; anything malformed is 0."""
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            return 0.0
        tokens.append(float(m[1]) if m[1] else m[2].lower())
        at = m.end()
    levels = (("or",), ("and",), ("=", "<>", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/", "div", "mod", "%"), ("^",))
    apply = {
        "or": lambda a, b: float(bool(a or b)), "and": lambda a, b: float(bool(a and b)), "=": lambda a, b: float(a == b),
        "<>": lambda a, b: float(a != b), "!=": lambda a, b: float(a != b), "<": lambda a, b: float(a < b),
        ">": lambda a, b: float(a > b), "<=": lambda a, b: float(a <= b), ">=": lambda a, b: float(a >= b),
        "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b,
        "div": lambda a, b: a / b, "mod": lambda a, b: float(int(a) % int(b)), "%": lambda a, b: float(int(a) % int(b)),
        "^": lambda a, b: a**b,
    }

    def parse(level: int) -> float:
        if level == len(levels):
            token = tokens.pop(0)
            if token == "(":
                value = parse(0)
                if tokens.pop(0) != ")":
                    raise ValueError
                return value
            if token in ("-", "+", "not"):
                value = parse(level)
                return -value if token == "-" else value if token == "+" else float(not value)
            if isinstance(token, str):
                raise ValueError
            return token
        value = parse(level + 1)
        while tokens and tokens[0] in levels[level]:
            value = apply[tokens.pop(0)](value, parse(level + 1))
        return value

    try:
        value = parse(0)
        return 0.0 if tokens else value
    except (ValueError, IndexError, ZeroDivisionError, OverflowError, TypeError):
        return 0.0
