"""Converters of office and HTML files to Markdown."""

from __future__ import annotations

import base64
import importlib.util
import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Converter(Protocol):
    """Makes Markdown of a file's bytes, or of a url; None if it can't."""

    def convert(self, name: str, content: bytes) -> str | None: ...

    def convert_url(self, url: str) -> str | None: ...


class HttpConverter:
    """A conversion service: sources are posted to /v1/convert/source, /health says whether it is up."""

    def __init__(self, base_url: str, timeout: float = 300):
        self.base_url, self.timeout = base_url.rstrip("/"), timeout

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.base_url}/health", timeout=10) as reply:
                return reply.status == 200
        except Exception:
            return False

    def _post(self, source: dict) -> str | None:
        body = json.dumps({"sources": [source]}).encode()
        request = urllib.request.Request(f"{self.base_url}/v1/convert/source", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                got = json.load(reply)
        except Exception:
            return None
        if isinstance(got, list):
            got = got[0] if got else {}
        return (got.get("document") or {}).get("md_content") if isinstance(got, dict) else None

    def convert(self, name: str, content: bytes) -> str | None:
        return self._post({"kind": "file", "base64_string": base64.b64encode(content).decode(), "filename": name})

    def convert_url(self, url: str) -> str | None:
        return self._post({"kind": "http", "url": url})


class LocalConverter:
    """Conversion in the executors' own processes by docling, where that is installed."""

    def convert(self, name: str, content: bytes) -> str | None:
        from io import BytesIO

        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter

        return DocumentConverter().convert(DocumentStream(name=name, stream=BytesIO(content))).document.export_to_markdown()

    def convert_url(self, url: str) -> str | None:
        from docling.document_converter import DocumentConverter

        return DocumentConverter().convert(url).document.export_to_markdown()


def local_converter_there(module: str = "docling") -> bool:
    return importlib.util.find_spec(module) is not None


def _tried(rows: DataFrame, key: str, make) -> DataFrame:
    """``key``, text, error of what ``make`` returns for each row's values; a failure is an error and no text."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for values in zip(*[batch[c] for c in batch.columns], strict=True):
                try:
                    text = make(*values)
                    out.append((values[0], text or None, None if text else "no Markdown came back"))
                except Exception as why:
                    out.append((values[0], None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(out, columns=[key, "text", "error"])

    return rows.mapInPandas(run, f"{key} string, text string, error string")


def converted(files: DataFrame, converter: Converter) -> DataFrame:
    """path, text, error of ``files`` (path, content); a file that can't be converted has an error and no text."""
    return _tried(files.select("path", "content"), "path", lambda path, content: converter.convert(path.rsplit("/", 1)[-1], content))


def converted_urls(urls: DataFrame, converter: Converter) -> DataFrame:
    """url, text, error of ``urls`` (url); a page that can't be fetched or converted has an error and no text."""
    return _tried(urls.select("url"), "url", converter.convert_url)


def html_to_markdown(html: Column) -> Column:
    """Markdown of simple HTML in built-in expressions: headings, paragraphs, list items; the rest loses its tags."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    text = F.regexp_replace(text, r"\s+", " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{level}\b[^>]*>\s*", "\n\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"(?i)\s*</h[1-6]\s*>|\s*</?(p|div|article|section|ul|ol|table|tr|body|html)\b[^>]*>\s*", "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*<br\s*/?>\s*", "\n"), r"(?i)\s*<li\b[^>]*>\s*", "\n- ")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")

