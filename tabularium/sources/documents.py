"""Binary documents: files from a store, their positioned words, and their text as laid out.

The parsers are other software: words come from ``pdfplumber``, layout text from the program ``pdftotext``, where these
are installed on the executors. Any other reader may be given in their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabularium.schema import WORDS

#: ``bytes`` to pages of words ``{"text", "x0", "x1", "top"}``; ``bytes`` to text.
WordReader = Callable[[bytes], list[list[dict]]]
TextReader = Callable[[bytes], str]


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``doc_id, content`` of the files under a folder; the id is the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path as doc_id", "content")


def read_words(content: bytes) -> list[list[dict]]:
    """Words of each page in the order of the text flow."""
    import io

    try:
        import pdfplumber
    except ModuleNotFoundError as e:
        raise RuntimeError("pdfplumber is not installed; give another reader of words") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_words(use_text_flow=True, keep_blank_chars=False) for page in pdf.pages]


def read_layout(content: bytes) -> str:
    """Text with blanks where the page has room; bytes that are no UTF-8 are replaced."""
    import subprocess

    try:
        done = subprocess.run(["pdftotext", "-layout", "-", "-"], input=content, capture_output=True, check=True)
    except FileNotFoundError as e:
        raise RuntimeError("pdftotext is not installed; give another reader of text") from e
    return done.stdout.decode("utf-8", "replace")


def words_of(docs: DataFrame, reader: WordReader = read_words) -> DataFrame:
    """The columns of ``WORDS`` and ``error`` from ``doc_id, content``; a document that cannot be read is one row with its error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, error = [], None
                try:
                    for page, words in enumerate(reader(content.as_py() or b"")):
                        rows += [(page, seq, w["text"], float(w["x0"]), float(w["x1"]), float(w["top"])) for seq, w in enumerate(words)]
                except Exception as e:  # noqa: BLE001, parsers raise what they like; one bad document costs only itself
                    rows, error = [(None,) * 6], str(e) or type(e).__name__
                cols = zip(*rows) if rows else [[]] * 6
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([error] * len(rows), pa.string())], names=["doc_id", "page", "seq", "text", "x0", "x1", "top", "error"])

    return docs.select("doc_id", "content").mapInArrow(read, WORDS + ", error string")


def texts_of(docs: DataFrame, reader: TextReader = read_layout) -> DataFrame:
    """``doc_id, value, error`` from ``doc_id, content``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1)):
                value, error = None, None
                try:
                    value = reader(content.as_py() or b"")
                except Exception as e:  # noqa: BLE001, as above
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (doc, value, error)], names=["doc_id", "value", "error"])

    return docs.select("doc_id", "content").mapInArrow(read, "doc_id string, value string, error string")
