"""Text of one file: HTML, XML, JSON and CSV helpers run inside Arrow batches."""

from __future__ import annotations

import csv
import io
import json
from html.parser import HTMLParser
from xml.etree import ElementTree

from graphloom.functions.pieces import ChunkSettings, count_words, pack_rows


class _TextNodes(HTMLParser):
    """Collects text between tags, leaving out scripts and styles."""

    HIDDEN = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.current: list[str] = []
        self.hidden = 0

    def _close_node(self):
        text = "".join(self.current).strip()
        if text:
            self.nodes.append(text)
        self.current = []

    def handle_starttag(self, tag, attrs):
        self._close_node()
        self.hidden += tag in self.HIDDEN

    def handle_startendtag(self, tag, attrs):
        self._close_node()

    def handle_endtag(self, tag):
        self._close_node()
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_comment(self, data):
        self._close_node()

    def handle_decl(self, decl):
        self._close_node()

    def handle_data(self, data):
        if not self.hidden:
            self.current.append(data)


def html_text(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    parser._close_node()
    return "\n".join(parser.nodes)


def xml_text(xml: str) -> str:
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return ""
    return "\n".join(t.strip() for t in root.itertext() if t.strip())


def json_text(text: str) -> str:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return ""


def csv_text(text: str, settings: ChunkSettings = ChunkSettings()) -> str:
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if len(rows) < 2:
        return ""
    lines = [" | ".join(r) for r in rows]
    return "\n\n".join(pack_rows(lines[0], lines[1:], "", settings, count_words))


PARSERS = {"html": html_text, "htm": html_text, "xml": xml_text, "json": json_text, "csv": csv_text}
