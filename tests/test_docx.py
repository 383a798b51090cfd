"""DOCX files."""

import io
import zipfile
from xml.sax.saxutils import escape

import pytest

from onefold.plans import batch
from onefold.sources import docx

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def packed(paragraphs, links=()):
    """A DOCX file; a paragraph is XML within w:p."""
    rels = lambda rows: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{OFFICE}/{kind}" Target="{escape(to)}"/>' for i, (kind, to) in enumerate(rows)) + "</Relationships>"
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("_rels/.rels", rels([("officeDocument", "word/document.xml")]))
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{docx.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
        archive.writestr("word/_rels/document.xml.rels", rels([("styles", "styles.xml"), *(("hyperlink", to) for to in links)]))
    return out.getvalue()


def run(text):
    return f"<w:r><w:t>{escape(text)}</w:t></w:r>"


LINES = [run("Ann Poe"), run("ann@x.com") + "<w:r><w:tab/></w:r>" + f"<w:hyperlink>{run('GitHub')}</w:hyperlink>", run("SKILLS"), run("Go, Weaving"), run("EXPERIENCE"), run("Engineer at Acme (2015-01 – present)")]


def test_docx_content():
    text, links = docx.content(packed([*LINES, run("a") + "<w:r><w:br/><w:delText>gone</w:delText></w:r>" + run("b"), ""], [" https://github.com/annpoe ", "https://x.com/?a=1&b=2", "https://github.com/annpoe"]))
    assert text.split("\n") == ["Ann Poe", "ann@x.com\tGitHub", "SKILLS", "Go, Weaving", "EXPERIENCE", "Engineer at Acme (2015-01 – present)", "a", "b", ""]
    assert links == ["https://github.com/annpoe", "https://x.com/?a=1&b=2"]


@pytest.mark.parametrize("data", [None, b"", b"no zip", packed(LINES)[:200], packed(["<w:open>"])])
def test_broken_docx_has_nothing(data):
    assert docx.content(data) == ("", [])


def test_docx_resumes(spark, tmp_path):
    (tmp_path / "resumes").mkdir()
    (tmp_path / "resumes" / "a.docx").write_bytes(packed(LINES, ["https://github.com/annpoe"]))
    (tmp_path / "resumes" / "b.docx").write_bytes(b"no zip")
    (tmp_path / "resumes" / "c.txt").write_text("Bob Roe\nbob@x.com\n")
    ann, bob = sorted(batch.read(spark, str(tmp_path)).collect(), key=lambda r: r.ord)
    assert (ann.full_name, ann.emails, ann.links.github, ann.skills) == ("Ann Poe", ["ann@x.com"], "annpoe", ["Go", "Weaving"])
    assert [(e.title, e.company) for e in ann.experience] == [("Engineer", "Acme")] and bob.emails == ["bob@x.com"]
