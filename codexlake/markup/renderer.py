"""Wikitext to HTML.

A page is a stream of lines. What a line begins with decides on blocks (lists,
tables, headings, paragraphs); within a line a dispatch on single characters
handles inline markup. Output is a list of pieces.

Fixed values: the tags and class names in the strings of this module, misspelt ones too, are those that pages must have.
"""

from __future__ import annotations

import re
from dataclasses import replace

from . import strings as S
from .context import Context
from .templates import Expander

CRLF = "\r\n"
SCHEMES = ("http://", "https://", "gopher://", "mailto:", "news://", "ftp://", "irc://")
#: Parameters of an image link and their meaning.
IMAGE_STYLES = {"thumb": "thumb", "thumbnail": "thumb", "frame": "frame", "border": "border"}
IMAGE_POSITIONS = ("none", "left", "center", "right")

_PLAIN = re.compile(r"[^\n'<\[_|!:]+")
_TAG = re.compile(r"(/?)([A-Za-z0-9]*)([^>]*)>")
_STOP_TAG = re.compile(r"<(?=[/A-Za-z])")
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([^> ]*)[^>]*(?:>|\Z)", re.S)
_MAGIC = re.compile(r"_([A-Z]*_[A-Z]*_)")
_TRAIL = re.compile(r"[A-Za-zÀ-ÿ]*")
_PIXELS = re.compile(r" *([0-9]*)(?:[xX]([0-9]+))?[pP][xX] *")


class Renderer:
    def __init__(self, context: Context):
        self.c = context

    def sub(self, text: str) -> str:
        """A fragment rendered by itself, without expansion."""
        inner = Renderer(replace(self.c, expand=False))
        return inner.run(text)

    def render(self, text: str) -> str:
        """A page: templates first, then markup."""
        return self.run(Expander(self.c).expand(normalize(text)))

    # -- state and cursor

    def run(self, text: str) -> str:
        self.text, self.at = normalize(text), 0
        self.out: list[str] = []
        self.lines = 1  # line ends just passed
        self.styles: list[str] = []  # open italics and bold, in order
        self.bullets = self.numbers = 0
        self.definition = ""  # the open part of a definition list
        self.tags: list[str] = []
        self.toc: list[tuple[str, int]] = []
        self.toc_at: int | None = None
        self.toc_off = self.toc_forced = False
        self.references: list[str] = []
        self.categories: list[str] = []
        self.externals = 0
        while self.at < len(self.text):
            if not self.lines and (m := _PLAIN.match(self.text, self.at)):
                self.out.append(m[0])
                self.at = m.end()
                continue
            c = self.text[self.at]
            self.at += 1
            if self.lines:
                while c == " ":
                    c = self.peek()
                    self.at += 1
                if self.line(c):
                    continue
            self.inline(c)
        self.close_styles()
        if self.categories:
            name = self.c.config.get("categoriesName", "Categories: ")
            self.put(f'<p class="wkCategories"> {name}{" | ".join(self.categories)}</p>')
        self.put(CRLF)
        self.insert_contents()
        return "".join(self.out)

    def put(self, text: str) -> None:
        self.out.append(text)

    def peek(self, ahead: int = 0) -> str:
        return self.text[self.at + ahead : self.at + ahead + 1]

    def rest_of_line(self) -> str:
        end = self.text.find("\n", self.at)
        end = len(self.text) if end < 0 else end
        line, self.at = self.text[self.at : end], end + 1
        self.lines += 1
        return line

    # -- blocks

    def line(self, c: str) -> bool:
        """Handles what a line begins with; True if the character is used up."""
        if c != "*" and self.bullets:
            self.put("</li></ul>" * self.bullets)
            self.bullets = 0
        if c != "#" and self.numbers:
            self.put("</li></ol>" * self.numbers)
            self.numbers = 0
        if self.definition and c not in (";", ":"):
            self.put(f"</{self.definition}>{CRLF}</dl" + ("" if self.c.compat else ">") + CRLF)
            self.definition = ""
        if c == "\n":
            if self.lines == 1:
                self.close_styles()
                self.put("<p />")
            return False
        self.lines = 0
        block = self.BLOCKS.get(c)
        return block(self) if block else not c

    def heading(self) -> bool:
        if self.peek() != "=":
            return False
        marks = 2
        while self.peek(marks - 1) == "=":
            marks += 1
        self.at += marks - 1
        text = S.trim(self.rest_of_line().split("=" * marks, 1)[0])
        self.close_styles()
        if self.toc_at is None:
            self.toc_at = len(self.out)
        self.toc.append((text, marks - 1))
        body = self.sub(text)
        self.put(f'<a name="{S.anchor(text)}"></a><H{marks} class="wkHeadline wkHeadline{marks}">{body}</H{marks}>')
        self.lines = 2  # a heading ends its own paragraph
        return True

    def item(self, mark: str, tag: str, name: str, list_name: str, depth: int) -> int:
        """One list item; returns the new depth."""
        run = re.compile(f"[ {re.escape(mark)}]*").match(self.text, self.at)
        count = 1 + run[0].count(mark)
        start = f'<li class="wk{name}ListItem wk{name}ListItem%d">'
        if count > depth:
            while depth < count:
                depth += 1
                self.put(f'<{tag} class="wk{list_name}List">' + (start % depth if depth < count else ""))
        elif count < depth:
            self.put(f"</li></{tag}>" * (depth - count))
            depth = count
        else:
            self.put("</li>")
        self.put(start % depth)
        self.at = run.end()
        return depth

    def bullet(self) -> bool:
        self.bullets = self.item("*", "ul", "Unordered", "Unordered", self.bullets)
        return True

    def number(self) -> bool:
        name = "Orrdered" if self.c.compat else "Ordered"
        self.numbers = self.item("#", "ol", "Ordered", name, self.numbers)
        return True

    def define(self, part: str) -> bool:
        self.put(f"</{self.definition}>{CRLF}" if self.definition else f'<dl class="wkDefintionList">{CRLF}')
        self.put(f'<{part} class="{"wkDefinitionListTitle" if part == "dt" else "wkDefinitionListEntry"}">')
        self.definition = part
        return True

    def close(self, tag: str, end: str = "\n") -> None:
        if self.tags and self.tags[-1] == tag:
            self.put(f"</{tag}>{end}")
            self.tags.pop()

    def table(self) -> bool:
        if self.peek() != "|":
            return False
        self.at += 1
        attributes = S.trim(self.rest_of_line())
        self.put(f"<table {attributes.partition('|')[0]}>\n" if attributes else "<table>\n")
        self.tags.append("table")
        return True

    def table_line(self) -> bool:
        c = self.peek()
        if c == "}":
            self.at += 1
            for tag in ("td", "tr", "table"):
                self.close(tag)
        elif c == "+":
            self.rest_of_line()  # captions are not shown
        elif c == "-":
            self.at += 1
            attributes = self.rest_of_line()
            self.close("td")
            self.close("tr")
            attributes = S.trim(attributes)
            self.put(f"<tr {attributes}>\n" if attributes else "<tr>\n")
            self.tags.append("tr")
        else:
            self.cell(end="")
        return True

    def header_line(self) -> bool:
        self.cell(exclamation=True)
        return True

    def cell(self, exclamation: bool = False, end: str = "\n") -> None:
        self.close("td", end)
        if not self.tags or self.tags[-1] != "tr":
            self.tags.append("tr")
            self.put("<tr>\n")
        attributes = self.cell_attributes(exclamation)
        self.put("<td>" if attributes is None else f"<td {attributes}>")
        self.tags.append("td")

    def cell_attributes(self, exclamation: bool) -> str | None:
        """Text before a single pipe on this line, if nothing else ends the cell first."""
        braces = 0
        for m in re.compile(r"[\n\[|!{}]").finditer(self.text, self.at):
            c = m[0]
            double = self.text[m.end() : m.end() + 1] == c
            if c in "{}":
                braces += 1 if c == "{" else -1
            elif braces:
                continue
            elif c in "\n[" or double and (c == "|" or exclamation and c == "!"):
                return None
            elif c == "|":
                found, self.at = self.text[self.at : m.start()], m.end()
                return found
        found, self.at = self.text[self.at :], len(self.text)
        return found

    BLOCKS = {
        "=": heading, "*": bullet, "#": number, ";": lambda self: self.define("dt"), ":": lambda self: self.define("dd"),
        "{": table, "|": table_line, "!": header_line,
    }

    # -- inline markup

    def inline(self, c: str) -> None:
        handler = self.INLINE.get(c)
        if handler:
            handler(self)
        else:
            self.put(c)

    def newline(self) -> None:
        self.lines += 1  # lines are put together without a blank

    def quotes(self) -> None:
        if self.peek() != "'":
            self.put("'")
            return
        tag, n = ("b", 2) if self.peek(1) == "'" else ("i", 1)
        self.at += n
        if tag not in self.styles:
            self.styles.append(tag)
            self.put(f"<{tag}>")
        elif self.styles[-1] == tag:
            self.styles.pop()
            self.put(f"</{tag}>")
        else:  # the other style began inside: close both, go on with it
            other = self.styles[-1]
            self.styles = [other]
            self.put(f"</{other}></{tag}><{other}>")

    def close_styles(self) -> None:
        if self.styles and self.styles[-1] == "i":
            self.put("</i>")
            self.styles.pop()
        for tag in ("b", "i"):
            if tag in self.styles:
                self.put(f"</{tag}>")
        if not self.c.compat:
            self.styles = []

    def angle(self) -> None:
        c = self.peek()
        m = _TAG.match(self.text, self.at) if c == "/" or c.isascii() and c.isalpha() else None
        if not m:
            self.put("<")
            return
        handler = self.WIKI_TAGS.get(m[2])
        self.at = m.end()
        if handler:
            handler(self, bool(m[1]), m[0].endswith("/>"))
        else:
            self.put("<" + m[0])

    def raw(self, name: str) -> None:
        """Text up to the end tag; other tags are shown by their names, comments are left out."""
        while self.at < len(self.text):
            m = _RAW.search(self.text, self.at)
            part = self.text[self.at : m.start() if m else len(self.text)]
            self.put(part.replace(" ", "&nbsp;").replace("\n", "<br />") if name == "source" else part)
            self.at = m.end() if m else len(self.text)
            if m and m[2] and m[0].endswith(">"):
                if m[1] and m[2] == name:
                    return
                self.put(f"&lt;{m[1]}{m[2]}&gt;")

    def tag_raw(self, name: str, end: bool, empty: bool) -> None:
        if end or empty:
            return
        if name == "source" and self.peek() == "\n":
            self.at += 1
        self.raw(name)
        if name == "source":
            self.lines = 1

    def until_tag(self) -> str | None:
        m = _STOP_TAG.search(self.text, self.at)
        found = self.text[self.at : m.start()] if m else None
        self.at = m.start() if m else len(self.text)
        return found

    def tag_imagemap(self, end: bool, empty: bool) -> None:
        if not end and not empty:
            self.until_tag()

    def tag_code(self, end: bool, empty: bool) -> None:
        if not empty:
            self.put("</tt>" if end else "<tt>")

    def tag_ref(self, end: bool, empty: bool) -> None:
        text = None if end or empty else self.until_tag()
        if text:
            self.references.append(text)
            n = len(self.references)
            self.put(f'<sup><a href="#_note-{n}" class="wbReference" name="_ref-{n}">[{n}]</a></sup>')

    def tag_references(self, end: bool, empty: bool) -> None:
        if (end and not empty) or not self.references:
            return
        self.put('<ol class="wkReferenceList"' + ("" if self.c.compat else ">") + CRLF)
        for n, text in enumerate(self.references, 1):
            anchor = f'<a href="#_ref-{n}" class="wkReferenceListAnchor" name="_note-{n}">&uarr;</a>'
            self.put(f'<li class="wkReferenceListItem">{anchor}&nbsp;{self.sub(text)}</li>')
        self.put(f"</ol>{CRLF}")

    WIKI_TAGS = {
        "nowiki": lambda self, e, s: self.tag_raw("nowiki", e, s), "pre": lambda self, e, s: self.tag_raw("pre", e, s),
        "source": lambda self, e, s: self.tag_raw("source", e, s), "imagemap": tag_imagemap, "code": tag_code,
        "ref": tag_ref, "references": tag_references,
    }

    def bracket(self) -> None:
        if self.peek() == "[":
            self.internal(self.double_brackets())
        elif S.lower(self.text[self.at : self.at + 9]).startswith(SCHEMES):
            self.external(self.single_brackets())
        else:
            self.put("[")

    def single_brackets(self) -> str:
        depth = 1
        for m in re.compile(r"[\[\]]").finditer(self.text, self.at):
            depth += 1 if m[0] == "[" else -1
            if not depth:
                found, self.at = self.text[self.at : m.start()], m.end()
                return found
        found, self.at = self.text[self.at :], len(self.text)
        return found

    def double_brackets(self) -> str:
        self.at += 1
        depth = 2
        for m in re.compile(r"[\[\]]").finditer(self.text, self.at):
            depth += 1 if m[0] == "[" else -1
            if m[0] == "]" and depth == 1 and self.text[m.end() : m.end() + 1] == "]":
                found, self.at = self.text[self.at : m.start()], m.end() + 1
                return found
        found, self.at = self.text[self.at :], len(self.text)
        return found

    def internal(self, text: str) -> None:
        target, pipe, label = text.partition("|")
        prefix, colon, rest = target.partition(":")
        prefixed = bool(colon and prefix)
        if prefixed:
            kind = "".join(c.lower() if c.isascii() else c for c in prefix)
            if kind in ("category", "kategorie"):
                self.categories.append(rest)
                return
            if kind in (self.c.image_namespace, "image"):
                self.image(S.trim(rest), label if pipe else target)
                return
            if kind in ("wikipedia", "media"):
                self.put(label if pipe else target)
                return
            if not self.c.installed(kind):
                return
        shown = self.sub(label) if pipe else target
        href = ("../" if prefixed else "") + target.replace("&", "&amp;amp;")
        trail = _TRAIL.match(self.text, self.at)
        self.at = trail.end()
        self.put(f'<a href="{href}" class="wkInternalLink">{shown}{trail[0]}</a>')

    def external(self, text: str) -> None:
        url, blank, label = text.partition(" ")
        gap = " "
        if not blank:
            self.externals += 1
            label, gap = f"[{self.externals}]", "  "
        self.put(f'<a href="{url}" class="wkExternalLink external"{gap}target="_blank">{label}</a>')

    def image(self, name: str, parameters: str) -> None:
        styles, position, width, height, caption = set(), None, 0, 0, ""
        for p in filter(None, parameters.split("|")):
            if p in IMAGE_STYLES:
                styles.add(IMAGE_STYLES[p])
            elif p in IMAGE_POSITIONS:
                position = p
            elif m := _PIXELS.fullmatch(p):
                width, height = int(m[1] or 0), int(m[2]) if m[2] else height
            else:
                caption = p
        caption = S.trim(caption)
        if not self.c.images:
            if "thumb" not in styles or not caption:
                return
            width = min(width, 180)
        frame, thumb = "frame" in styles, "thumb" in styles
        css = "thumbImage" if frame else "thumbborder" if styles else ""
        if thumb and not frame and position is None:
            position = "right"
        tag = f'<img alt="{caption}" src="./Image:{name}"'
        if not frame:
            width = width or 180
            tag += f' width="{width}px"' + (f' height="{width if self.c.compat else height}px"' if height else "")
        tag += (f' class="{css}"' if css else "") + ' border="0" />'
        if frame or thumb:
            side = {"left": "thumb tleft", "right": "thumb tright", None: css}.get(position, "thumb tnone")
            body = self.sub(caption) if caption else ""
            box = (
                f'<div class="{side}">{CRLF}<div class="thumbinner" style="padding: 2px;">{tag}'
                f'<div class="thumbcaption" style="max-width:{max(120, width)}px;">{body}</div>{CRLF}</div>{CRLF}</div>{CRLF}'
            )
            self.put(f"<center>{CRLF}{box}</center>{CRLF}" if position == "center" else box)
        elif position is None:
            self.put(tag)
        else:
            side = {"left": "floatleft", "right": "floatright"}.get(position, "floatnone")
            box = f'<div class="{side}"><span>{tag}</span></div>'
            self.put(f'<div class="center">{CRLF}{box}</div>{CRLF}' if position == "center" else box)

    def underscore(self) -> None:
        if self.peek() != "_":
            self.put("_")
            return
        m = _MAGIC.match(self.text, self.at)
        if not m or len(m[1]) <= 2:
            return  # one underscore is lost
        self.at = m.end()
        word = m[1][:-2]
        if word == "NOTOC":
            self.toc_off = not self.toc_forced
        elif word in ("FORCETOC", "TOC"):
            self.toc_forced, self.toc_off = True, False
            if word == "TOC":
                self.toc_at = len(self.out)

    def pipe(self) -> None:
        if self.peek() != "|":
            self.put("|")
            return
        self.at += 1
        if self.peek() != "\n":
            self.cell()

    def exclamation(self) -> None:
        if self.peek() != "!" or not self.tags or self.tags[-1] != "td":
            self.put("|" if self.c.compat else "!")
            return
        self.at += 1
        self.cell(exclamation=True)

    def colon(self) -> None:
        if self.definition == "dt":
            self.put(f'</dt>{CRLF}<dd class="wkDefinitionListEntry">')
            self.definition = "dd"
        else:
            self.put(":")

    INLINE = {
        "\n": newline, "'": quotes, "<": angle, "[": bracket, "_": underscore, "|": pipe, "!": exclamation, ":": colon,
    }

    # -- table of contents

    def insert_contents(self) -> None:
        if self.toc_at is None or self.toc_off or not self.toc or (len(self.toc) <= 3 and not self.toc_forced):
            return
        title = self.c.config.get("tocTitle", "Contents")
        parts = [
            f'<p><table id="toc" class="toc" summary="{title}">{CRLF}<tr><td><div id="toctitle"><h2>{title}</h2></div>{CRLF}'
        ]
        level = 0
        for text, own in self.toc:
            parts.append(f"<ul>{CRLF}" * max(0, own - level) + f"</ul>{CRLF}" * max(0, level - own))
            level = own
            entry = f'<li class="toclevel-{level}">{text}'
            parts.append(f'<a href="#{S.anchor(text)}"><span class="toctext">{entry}</span></a></li>{CRLF}')
        parts.append(f"</ul>{CRLF}" * max(0, level - 1) + "</td></tr></table></p>")
        self.out.insert(self.toc_at, "".join(parts))


def normalize(text: str) -> str:
    """A carriage return alone becomes a line feed."""
    return re.sub(r"\r(?!\n)", "\n", text)


def render(text: str, context: Context) -> str:
    return Renderer(context).render(text or "")
