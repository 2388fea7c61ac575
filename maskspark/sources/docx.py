"""Word documents: text nodes as rows, and masked documents as bytes. An XML parser does the reading and writing."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from maskspark.config import MaskConfig
from maskspark.functions.masking import Session, counts
from maskspark.operators.documents import masker

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PART = re.compile(r"word/(?:document|header[0-9]*|footer[0-9]*|footnotes|endnotes|comments)\.xml")
#: All parts of a package are written with this time, so that equal input gives equal bytes.
_TIME = (1980, 1, 1, 0, 0, 0)


def parts(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and contents of a package; encrypted and unknown packings raise."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{info.filename} is encrypted or packed in an unknown way")
            yield info.filename, z.read(info)


def nodes(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(part, paragraph, node, text) of each text node, in order."""
    for name, content in parts(data):
        if _PART.fullmatch(name):
            for p, paragraph in enumerate(ElementTree.fromstring(content).iter(f"{_W}p")):
                for n, node in enumerate(paragraph.iter(f"{_W}t")):
                    yield name, p, n, node.text or ""


def masked(data: bytes, cfg: MaskConfig, whole_paragraphs: bool = False) -> tuple[bytes, dict[str, int]]:
    """The document with its texts masked, and occurrences by category; other parts as they are.

    Each node is a cell, or with whole_paragraphs each paragraph: its masked text then goes into the first node.
    """
    own, session, hits = masker(cfg), Session(), []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts(data):
            if _PART.fullmatch(name):
                for prefix, uri in {p: u for _, (p, u) in ElementTree.iterparse(io.BytesIO(content), events=["start-ns"])}.items():
                    ElementTree.register_namespace(prefix, uri) if not re.fullmatch(r"ns[0-9]+", prefix) else None
                tree, changed = ElementTree.fromstring(content), False
                for paragraph in tree.iter(f"{_W}p"):
                    texts = list(paragraph.iter(f"{_W}t"))
                    for group in [texts] if whole_paragraphs and texts else [[t] for t in texts]:
                        before = "".join(t.text or "" for t in group)
                        after = own.mask(before, session, hits)
                        if after != before:
                            changed = True
                            group[0].text, group[0].attrib["{http://www.w3.org/XML/1998/namespace}space"] = after, "preserve"
                            for t in group[1:]:
                                t.text = ""
                if changed:
                    content = ElementTree.tostring(tree, encoding="UTF-8", xml_declaration=True)
            info = zipfile.ZipInfo(name, _TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue(), counts(hits)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of Word files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")


def text_nodes(files: DataFrame) -> DataFrame:
    """(path, part, paragraph, node, text, error): one row a text node; one with an error for a file that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, *node, None) for node in nodes(content)]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, TypeError) as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "part", "paragraph", "node", "text", "error"]).astype({"paragraph": "Int32", "node": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, part string, paragraph int, node int, text string, error string")


def mask_files(files: DataFrame, cfg: MaskConfig = MaskConfig(), whole_paragraphs: bool = False) -> DataFrame:
    """(path, content, mask_counts, error): each document masked, numbers by document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, *masked(content, cfg, whole_paragraphs), None))
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, TypeError) as e:
                    rows.append((path, None, {}, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "mask_counts", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, mask_counts map<string,int>, error string")
