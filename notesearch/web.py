"""A search page on this machine: python -m notesearch.web SAVED_INDEX [PORT]."""

from __future__ import annotations

import html
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote_plus, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.expand import ALWAYS, FALLBACK, NEVER
from .operators.index import Index
from .operators.search import BM25, NO_SCORE, TFIDF, search_ranked
from .plans.corpora import query_table

SHOWN, PORT = 50, 8080
MODES = {NEVER: "exact words", FALLBACK: "similar spellings of absent words", ALWAYS: "similar spellings always"}
ORDERS = {NO_SCORE: "document order", TFIDF: "TF-IDF", BM25: "BM25"}


def escape(text: str) -> str:
    return html.escape(text, quote=False).replace('"', "&quot;")


def parameters(query: str | None) -> dict[str, str]:
    """name -> value, decoded; items without a name are left out."""
    pairs = (item.partition("=") for item in (query or "").split("&"))
    return {unquote_plus(name): unquote_plus(value) for name, mark, value in pairs if name and mark}


def _options(name: str, choices: dict[str, str], chosen: str) -> str:
    marks = "".join(f'<option value="{k}"{" selected" if k == chosen else ""}>{v}</option>' for k, v in choices.items())
    return f'<select name="{name}">{marks}</select>'


class Pages:
    """Answers queries over a base index and its corrected form, both kept in memory."""

    def __init__(self, spark: SparkSession, base: Index, corrected: Index):
        self.spark, self.indexes = spark, {False: base.cache(), True: corrected.cache()}

    def page(self, given: dict[str, str]) -> str:
        query = given.get("q", "")
        mode = given.get("fuzzy", FALLBACK) if given.get("fuzzy") in MODES else FALLBACK
        order = given.get("order", NO_SCORE) if given.get("order") in ORDERS else NO_SCORE
        ocr, some = given.get("ocr") == "1", given.get("or") == "1"
        box = lambda name, on, label: f'<label><input type="checkbox" name="{name}" value="1"{" checked" if on else ""}> {label}</label>'
        form = f'<form><input name="q" value="{escape(query)}">{_options("fuzzy", MODES, mode)}{_options("order", ORDERS, order)}{box("ocr", ocr, "corrected terms")}{box("or", some, "any word")}<button>Search</button></form>'
        return f'<!DOCTYPE html><html lang="en"><meta charset="utf-8"><title>Notes</title><body>{form}{self._results(query, mode, order, ocr, some)}</body></html>'

    def _results(self, query: str, mode: str, order: str, ocr: bool, some: bool) -> str:
        if not query.strip():
            return ""
        index = self.indexes[ocr]
        found = search_ranked(index, query_table(self.spark, [(1, query)]), order, not some, mode).cache()
        n = found.count()
        rows = found.filter(F.col("rank") <= SHOWN).join(index.docs, "doc").orderBy("rank").select("text").collect()
        found.unpersist()
        return f"<section><p>{n} results</p><ol>{''.join(f'<li>{escape(r.text)}</li>' for r in rows)}</ol></section>"


def serve(pages: Pages, port: int = PORT) -> ThreadingHTTPServer:
    """A server on the loopback address; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            body = pages.page(parameters(urlsplit(self.path).query)).encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


if __name__ == "__main__":
    from .session import session
    from .sources.persist import open_index

    spark = session()
    both = (open_index(spark, saved=sys.argv[1], corrected=c) for c in (False, True))
    serve(Pages(spark, *both), int(sys.argv[2]) if len(sys.argv) > 2 else PORT).serve_forever()
