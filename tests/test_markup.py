"""Golden cases of rendering and template expansion."""

from datetime import datetime

import pytest

from codexlake.markup.context import Context
from codexlake.markup.renderer import render
from codexlake.markup.templates import Expander, template_text

END = "\r\n"
LI = '<li class="wkUnorderedListItem wkUnorderedListItem1">'
UL = '<ul class="wkUnorderedList">'

RENDERED = [
    ("a\nb", "ab"),
    ("a\n\nb", "a<p />b"),
    ("''a''", "<i>a</i>"),
    ("'''a'''", "<b>a</b>"),
    ("'''''a'''''", "<b><i>a</i></b><i></i>"),
    ("== A b ==", '<a name="A_b"></a><H2 class="wkHeadline wkHeadline2">A b\r\n</H2>'),
    ("* a\n* b", f"{UL}{LI}a</li>{LI}b"),
    ("* a\n\nb", f"{UL}{LI}a</li></ul><p />b"),
    (
        "; t : d\n\n",
        '<dl class="wkDefintionList">\r\n<dt class="wkDefinitionListTitle"> t </dt>\r\n'
        '<dd class="wkDefinitionListEntry"> d</dd>\r\n</dl\r\n<p />',
    ),
    ("{|\n|-\n| a || b\n|}", "<table>\n<tr>\n<td> a </td>\n<td> b</td>\n</tr>\n</table>\n"),
    ("Hello!", "Hello|"),
    ("<nowiki>'''a'''</nowiki>", "'''a'''"),
    ("[[Foo]]", '<a href="Foo" class="wkInternalLink">Foo</a>'),
    ("[[Foo|bar]]s", '<a href="Foo" class="wkInternalLink">bar\r\ns</a>'),
    ("[[A & B]]", '<a href="A &amp;amp; B" class="wkInternalLink">A & B</a>'),
    ("[[Category:Foo]]", '<p class="wkCategories"> Categories: Foo</p>'),
    ("[[Foo: bar]]", ""),
    ("[http://x y z]", '<a href="http://x" class="wkExternalLink external" target="_blank">y z</a>'),
    ("[http://x]", '<a href="http://x" class="wkExternalLink external"  target="_blank">[1]</a>'),
    ("__NOTOC__x", "x"),
    (
        "x<ref>t</ref>y<references />",
        'x<sup><a href="#_note-1" class="wbReference" name="_ref-1">[1]</a></sup>y<ol class="wkReferenceList"\r\n'
        '<li class="wkReferenceListItem"><a href="#_ref-1" class="wkReferenceListAnchor" name="_note-1">&uarr;</a>&nbsp;t\r\n</li></ol>\r\n',
    ),
    ("<source>a b\nc</source>", "a&nbsp;b<br />c"),
    ("<pre>a <b>c</b></pre>", "a &lt;b&gt;c&lt;/b&gt;"),
    ("<code>x</code>", "<tt>x</tt>"),
    ("a < b <br /> c", "a < b <br /> c"),
    ("[[en:Foo]]", '<a href="../en:Foo" class="wkInternalLink">en:Foo</a>'),
    ("[[wikipedia:X|y]]", "y"),
    ("[[Image:a.png]]", ""),
    ("", ""),
]


@pytest.mark.parametrize(("text", "html"), RENDERED)
def test_rendering(text, html):
    assert render(text, Context()) == html + END


def test_contents_from_four_headings():
    assert 'id="toc"' in render("".join(f"== h{i} ==\n" for i in range(4)), Context())
    assert 'id="toc"' not in render("".join(f"== h{i} ==\n" for i in range(3)), Context())
    assert 'id="toc"' in render("__FORCETOC__\n== h ==\n", Context())


def test_intended_output():
    plain = Context(compat=False)
    assert render("Hello!", plain) == "Hello!" + END
    assert '<ol class="wkOrderedList">' in render("# a", plain)
    assert '<ol class="wkOrrderedList">' in render("# a", Context())


def test_images():
    html = render("[[Image:a.png|thumb|left|200px|Cap]]", Context(images=True))
    assert 'class="thumb tleft"' in html and 'width="200px"' in html and "Cap\r\n</div>" in html
    assert 'width="180px"' in render("[[Image:a.png|thumb|500px|Cap]]", Context())
    assert render("[[Image:a.png|center]]", Context(images=True)).startswith('<div class="center">\r\n<div class="floatnone">')


TEMPLATES = {
    "template:tpl": "Hi {{{1}}} {{{2|def}}}", "template:named": "{{{a}}}", "template:loop": "{{loop}}x", "template:tab": "{|\n|}",
    "template:outer": "[{{tpl|{{{1}}}}}]",
}
EXPANDED = [
    ("{{#if:|y|n}}", "n"), ("{{#if: x | y | n }}", " y"), ("{{#ifexist:Known|y|n}}", "n"), ("{{#ifexist:Nope|y|n}}", "y"),
    ("{{#ifexpr:1|y|n}}", "n"), ("{{#expr:1+1}}", ""), ("{{#expr:1+1|}}", "0"), ("{{#ifeq:a|a|Y|N}}", "Y"), ("{{#ifeq:a|b|Y|N}}", "N"),
    ("{{#ifneq:a|b|Y|N}}", "N"), ("{{#switch:b|a=1|b=2|#default=3}}", "2"), ("{{#switch:q|a=1|b=2|#default=3}}", "3"),
    ("{{#switch:a|a|b=2}}", "2"), ("{{#time:Y}}", "USP:#time:Y"), ("{{Nope}}", '<span class="wkUnknownTemplate">Template:Nope</span>'),
    ("{{Tpl|x}}", "Hi x def"), ("{{Named|a=1|b}}", "1| b"), ("{{lc:ABC}}", "abc"), ("{{ucfirst:abc}}", "Abc"), ("{{padleft:7|3|0}}", "7|3|0"),
    ("a{{commons|x}}b", "ab"), ("{{BASEPAGENAME}}", "A"), ("{{SUBPAGENAME}}", "C"), ("{{formatnum:1234567.89}}", "1,234,567.89"),
    ("{{formatnum:-123}}", "-,123"), ("{{!}}", "|"), ("{{tab}}", "\n{|\n|}"), ("{{outer|z}}", "[Hi z def]"), ("{{ns:10}}", "Template"),
    ("a<!--b-->c", "ac"), ("a<!--b", "a"), ("a{{x", "a{{x"), ("{{lc:A}}{{xyz", "axy"), ("<nowiki>{{lc:A}}</nowiki>", "<nowiki>{{lc:A}}</nowiki>"),
    ("{{NUMBEROFARTICLES}}/{{NUMBEROFPAGES}}", "7/1"), ("{{NAMESPACE}}", "en"), ("{{TALKPAGENAMEE}}", ""), ("{{urlencode:a b#é}}", "a b%23%E9"),
]
NOW = datetime(2024, 3, 5, 7, 8, 9)


def context(**more):
    return Context(page="A/B/C", templates=TEMPLATES, titles=frozenset({"known"}), expand=True, n_articles=7, now=NOW, **more)


@pytest.mark.parametrize(("text", "expected"), EXPANDED)
def test_expansion(text, expected):
    assert Expander(context()).expand(text) == expected


def test_expansion_off_and_intended():
    assert Expander(Context()).expand("a{{x}}b") == "ab"
    assert Expander(context(compat=False)).expand("{{#ifexist:Known|y|n}}{{#expr:(1+2)*3 mod 5}}{{#ifneq:a|b|Y|N}}") == "y4Y"


def test_recursion_ends():
    assert len(Expander(context()).expand("{{Loop}}")) < 5000


def test_template_text():
    assert template_text("A<noinclude>B</noinclude>C<includeonly>D</includeonly>") == "ACD"
    assert template_text("x<onlyinclude>y</onlyinclude>z") == "y"
    assert template_text("x<onlyinclude>y") == ""


@pytest.mark.parametrize(
    ("name", "value"),
    [("DAY", "5"), ("DAY2", "05"), ("DAYNAME", "Tuesday"), ("DOW", "2"), ("MONTH", "03"), ("MONTHABBREV", "Mar"), ("MONTHNAME", "March"),
     ("TIME", "07:08"), ("HOUR", "07"), ("MINUTE", "08"), ("WEEK", "10"), ("YEAR", "2024"), ("TIMESTAMP", "20240205070809")],
)
def test_dates(name, value):
    assert Expander(context()).expand("{{CURRENT" + name + "}}") == value == Expander(context()).expand("{{LOCAL" + name + "}}")
