"""File sources (O01, O03) and the tables-off option."""

import os
import uuid

from conftest import pages_df
from turnstile.operators.extract import Options, extract
from turnstile.session import ensure_checkpoint_dir
from turnstile.sources.tables import read_html_files, read_html_lenient


def test_html_file_sources(spark):
    base = os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), f"src-{uuid.uuid4().hex}")
    os.makedirs(base)
    with open(os.path.join(base, "a.html"), "w", encoding="utf-8") as f:
        f.write("<html><body><p>héllo wörld</p></body></html>")
    with open(os.path.join(base, "b.html"), "wb") as f:
        f.write(b"<html><body><p>bad \xff\xfe bytes</p></body></html>")
    whole = {os.path.basename(r.url): r.html for r in read_html_files(spark, base).collect()}
    assert whole["a.html"] == "<html><body><p>héllo wörld</p></body></html>"
    lenient = {os.path.basename(r.url): (r.html, r.valid_utf8) for r in read_html_lenient(spark, base).collect()}
    assert lenient["b.html"] == ("<html><body><p>bad  bytes</p></body></html>", False)
    assert lenient["a.html"][1] is True


def test_tables_off(spark):
    page = "<html><body><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    ex = extract(pages_df(spark, [(1, page)]), Options(detector="heuristic", tables=False))
    assert ex.turns.first().content == "\nab\n"
