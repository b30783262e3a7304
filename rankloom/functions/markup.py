"""An HTML tokenizer that survives malformed declarations."""

from __future__ import annotations

from html.parser import HTMLParser


class TolerantParser(HTMLParser):
    """The standard tokenizer, but a marked section it does not know (``<![foo[x]]>``) is a comment up to the next ``>``.

    So the HTML standard has it; the base class raises and would end the page,
    and with it the job.
    """

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)
