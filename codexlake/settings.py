"""An installation's settings: defaults, command-line arguments, and which languages are there."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from .markup.context import VERSION


@dataclass(frozen=True)
class Settings:
    """Defaults as an installation starts with them; ``languages`` is filled in by ``sources.catalogue.discover``."""

    path: str = "~/Media/Wikipedia"
    web_content: str = ""
    address: str = "0.0.0.0"
    port: int = 8082
    language: str = "en"
    languages: tuple[str, ...] = ()
    expand_templates: bool = False
    verbose: bool = False
    debug: bool = False
    version: str = VERSION

    @classmethod
    def from_args(cls, arguments: Sequence[str]) -> "Settings":
        """``-b path -p port -a address -l language -t[+|-] -v[+|-] -d``; anything else is ignored, as is a value that is missing.

        Raises ValueError for a port that is none.
        """
        found, rest = cls(), list(arguments)
        valued = {"-b": "path", "-p": "port", "-a": "address", "-l": "language"}
        flags = {
            "-t": ("expand_templates", True), "-t+": ("expand_templates", True), "-t-": ("expand_templates", False),
            "-v": ("verbose", True), "-v+": ("verbose", True), "-v-": ("verbose", False), "-d": ("debug", True),
        }
        while rest:
            word = rest.pop(0)
            if word in flags:
                found = replace(found, **dict([flags[word]]))
            elif word in valued and rest:
                value = rest.pop(0)
                if word == "-p":
                    digits = value[: len(value) - len(value.lstrip("0123456789"))]
                    port = int(digits or 0)
                    if not 0 < port <= 0xFFFF:
                        raise ValueError(f"illegal port: {value}")
                    found = replace(found, port=port)
                else:
                    found = replace(found, **{valued[word]: value})
        return found

    def installed(self, code: str, compat: bool = True) -> bool:
        """With ``compat`` a code counts if it occurs anywhere in the list joined by commas."""
        return code in ",".join(self.languages) if compat else code in self.languages

    def with_languages(self, codes: Sequence[str]) -> "Settings":
        """With the languages that were found; the default gives way to the first of them if it is not among them."""
        found = replace(self, languages=tuple(codes))
        return found if found.installed(found.language) else replace(found, language=codes[0] if codes else "")
