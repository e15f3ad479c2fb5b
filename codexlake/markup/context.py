"""What rendering a page needs besides its text."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

VERSION = "0.60"


@dataclass
class Context:
    """Page, language, settings and lookups; everything is plain data and can be broadcast.

    ``templates`` maps a template's folded full name to its ready text;
    ``titles`` holds folded titles. ``compat`` keeps observable oddities of
    existing archives' output; without it the evident intent is followed.
    """

    lang: str = "en"
    page: str = ""
    config: Mapping[str, str] = field(default_factory=dict)
    templates: Mapping[str, str] = field(default_factory=dict)
    titles: frozenset[str] = frozenset()
    languages: tuple[str, ...] = ("en", "xx")
    image_namespace: str = "image"
    template_namespace: str = ""
    images: bool = False
    expand: bool = False
    n_articles: int = 0
    now: datetime = datetime(2000, 1, 1)
    compat: bool = True
    depth: int = 100

    def template_prefix(self) -> str:
        return f"{self.template_namespace}:" if self.template_namespace else self.config.get("templatePrefix", "Template:")

    def installed(self, code: str) -> bool:
        return code in ",".join(self.languages) if self.compat else code in self.languages
