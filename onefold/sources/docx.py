"""Text and links of DOCX files: zip archives of XML, which the standard library reads."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The namespace of a document's elements, and what stands for signs within a run.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SIGNS = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
#: Bytes of an unpacked part; a file with more is as unreadable as a broken one.
MOST = 64 << 20


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    with archive.open(name) as file:
        data = file.read(MOST + 1)
    if len(data) > MOST or b"<!DOCTYPE" in data:
        raise ValueError(f"{name} is too large or has a document type")
    return ElementTree.fromstring(data)


def _paragraph(p: ElementTree.Element) -> str:
    runs = [r for x in p for r in ([x] if x.tag == f"{WORD}r" else x.findall(f"{WORD}r") if x.tag == f"{WORD}hyperlink" else [])]
    return "".join(x.text or "" if x.tag == f"{WORD}t" else SIGNS.get(x.tag, "") for r in runs for x in r)


def content(data: bytes | None) -> tuple[str, list[str]]:
    """A document's text, a line for each paragraph of its body, and where its links lead, each once.

    Null, empty and broken files, and those that aren't DOCX, have neither.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as archive:
            main = next(x.get("Target", "") for x in _part(archive, "_rels/.rels") if x.get("Type", "").endswith("/officeDocument")).lstrip("/")
            text = "\n".join(_paragraph(p) for p in _part(archive, main).find(f"{WORD}body").findall(f"{WORD}p"))
            folder, name = posixpath.split(main)
            place = posixpath.join(folder, "_rels", f"{name}.rels")
            links = [x.get("Target", "").strip() for x in _part(archive, place) if "hyperlink" in x.get("Type", "").lower()] if place in archive.namelist() else []
    except Exception:  # whatever is wrong with one file spoils no other
        return "", []
    return text, list(dict.fromkeys(filter(None, links)))


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text, urls) of DOCX files. Files are handed to Python in small batches, as each may be large."""
    read = F.udf(content, "struct<text:string,urls:array<string>>", useArrow=False)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), read("content").alias("found")).select("path", "found.*")
