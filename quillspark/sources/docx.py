"""Word files: a reader of raw paragraph rows, a writer of files from such rows, and one of annotated copies.

The reader unpacks each file in one Arrow batch function with the standard library alone; everything that
classifies paragraphs is done on its rows by operators.structure.classified.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROWS = "doc_id string, idx int, style string, text string, in_table boolean, page_break boolean, numbered boolean, left_indent int, indent int, centered boolean, all_bold boolean, all_italic boolean, italic_ok boolean, italic_excerpt string, error string"
PERIODICAL = re.compile(r"\(\d{4}[^)]*\)\.\s+.+?\.\s+(?P<periodical>[^.]+?,\s*\d+)")
ITALIC_SHARE = 0.8
#: Arrow batches of rows or files are sent on once they hold so many rows or bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Style sheets up to this size are kept once they are parsed.
SHEET_BYTES = 64 << 10
MOST_ZIPPED = (2 << 30) - (1 << 20)
_P, _R, _T, _BR, _BODY, _PPR, _RPR, _IND, _B, _I, _VAL, _TYPE = (W + x for x in ("p", "r", "t", "br", "body", "pPr", "rPr", "ind", "b", "i", "val", "type"))
_STYLE, _NUMBER, _ALIGN, _LEFT, _BREAK_SEEN = (W + x for x in ("pStyle", "numPr", "jc", "left", "lastRenderedPageBreak"))
_MARKS = {f"{W}tab": "\t", _BR: "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}


def _number(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def _on(element, tag: str) -> bool | None:
    """A toggle of run properties: None if it isn't set."""
    x = element.find(tag) if element is not None else None
    return None if x is None else x.get(_VAL, "1") not in ("0", "false", "off", "none")


def _first_line(properties) -> int | None:
    ind = properties.find(_IND) if properties is not None else None
    if ind is None:
        return None
    hanging, first = (_number(ind.get(f"{W}{k}")) for k in ("hanging", "firstLine"))
    return -abs(hanging) if hanging is not None else first


def _run_text(run) -> str:
    out = []
    for x in run:
        if x.tag == _T:
            out.append(x.text or "")
        elif x.tag in _MARKS and x.get(_TYPE) not in ("page", "column"):
            out.append(_MARKS[x.tag])
    return "".join(out)


def _italics(text: str, runs: list[tuple[str, bool]]) -> tuple[bool | None, str]:
    """Whether a periodical and its volume are in italics; None if the text names none."""
    m = PERIODICAL.search(text.strip()) if "(" in text else None
    if not m:
        return None, ""
    start, end = m.span("periodical")
    at = slanted = size = 0
    for piece, italic in runs:
        overlap = max(0, min(end, at + len(piece)) - max(start, at))
        size += overlap
        slanted += overlap * italic
        at += len(piece)
    return (slanted >= max(1, int(size * ITALIC_SHARE)) if size else None), m["periodical"]


@lru_cache(maxsize=64)
def _styles(sheet: bytes) -> tuple[dict, str]:
    """(name, paragraph properties) of each style by its id, and the name of the default one; files share few sheets."""
    styles, default = {}, "Normal"
    for s in ET.fromstring(sheet).iter(f"{W}style") if sheet else ():
        name = s.find(f"{W}name")
        label = name.get(_VAL, "") if name is not None else s.get(f"{W}styleId", "")
        label = re.sub(r"^heading (\d)$", r"Heading \1", label)
        styles[s.get(f"{W}styleId")] = (label, s.find(_PPR))
        if s.get(_TYPE) == "paragraph" and s.get(f"{W}default") == "1":
            default = label
    return styles, default


def read_paragraphs(data: bytes) -> list[tuple]:
    """Rows of ROWS without doc_id, in document order; table cells are left out as the body doesn't hold them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        sheet = z.read("word/styles.xml") if "word/styles.xml" in z.NameToInfo else b""
    styles, default = (_styles if len(sheet) <= SHEET_BYTES else _styles.__wrapped__)(sheet)
    rows = []
    for n, p in enumerate(x for x in body if x.tag == _P):
        properties = p.find(_PPR)
        have = {x.tag: x for x in reversed(properties)} if properties is not None else {}  # of equals the first
        get = lambda tag, key, of=have: of[tag].get(key) if tag in of else None
        style, style_properties = styles.get(get(_STYLE, _VAL), (default, None))
        runs, page = [], False
        for x in p.iter():
            if x.tag == _R:
                pr = x.find(_RPR)
                runs.append((_run_text(x), _on(pr, _B), _on(pr, _I)))
            elif x.tag == _BREAK_SEEN or x.tag == _BR and x.get(_TYPE) == "page":
                page = True
        text = "".join([t for t, _, _ in runs])
        seen = [(b, i) for t, b, i in runs if t.strip()]
        ok, excerpt = _italics(text, [(t, bool(i)) for t, _, i in runs])
        first = _first_line(properties) if _IND in have else None
        rows.append((n, style, text, False, page, _NUMBER in have, _number(get(_IND, _LEFT)), first if first is not None else _first_line(style_properties), get(_ALIGN, _VAL) == "center", bool(seen) and all(b for b, _ in seen), bool(seen) and all(i for _, i in seen), ok, excerpt))
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """Raw paragraph rows of all .docx files under a path; doc_id is the file's path."""
    return read_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path))


def read_files(files: DataFrame) -> DataFrame:
    """Raw paragraph rows of files (path, content).

    A file that can't be read gives one row: idx -1, an empty text, and what is wrong as its error (null elsewhere).
    """
    return files.select("path", "content").mapInArrow(_read_batches, ROWS)


def _read_batches(batches):
    """Arrow batches of ROWS from those of files; many small files share a batch, as each batch has its own cost."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [c.split(" ")[0] for c in ROWS.split(", ")]
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in ROWS.split(", ")])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)
    rows, size = [], 0
    for f in batches:
        for name, data in zip(f.column("path").to_pylist(), f.column("content"), strict=True):
            try:
                found = [(name, *r, None) for r in read_paragraphs(bytes(data.as_py()))]
            except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError, AttributeError, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                blank = {"doc_id": name, "idx": -1, "style": "Normal", "text": "", "italic_excerpt": "", "error": f"{type(e).__name__}: {e}"[:200]}
                found = [tuple(blank.get(c, None if c in ("left_indent", "indent", "italic_ok") else False) for c in names)]
            for r in found:
                rows.append(r)
                size += len(r[3])
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES // 4:
                    yield made(rows)
                    rows, size = [], 0
    if rows:
        yield made(rows)


def broken(raw: DataFrame) -> DataFrame:
    """doc_id, error: the files that couldn't be read."""
    return raw.filter("error IS NOT NULL").select("doc_id", "error")


def suffix_allowed(name: str) -> str:
    """SQL: whether an upload's name is one of a Word file."""
    return f"lower({name}) LIKE '%.docx'"


def download_name(name: str) -> str:
    """SQL: the name under which a reviewed copy of a file is offered."""
    last = f"regexp_extract({name}, '[^/]*$', 0)"
    stem = f"IF({last} RLIKE '^.+[.][^.]+$', regexp_replace({last}, '[.][^.]*$', ''), {last})"
    safe = f"regexp_replace(regexp_replace(IF({stem} = '', 'document', {stem}), '[^A-Za-z0-9_.-]+', '_'), '^[._]+|[._]+$', '')"
    return f"concat(IF({safe} = '', 'document', {safe}), '_reviewed.docx')"


def styles_of(raw: DataFrame) -> DataFrame:
    """doc_id, idx, style, start: the style of every paragraph and its first 80 characters, to see why a row is what it is."""
    return raw.filter("idx >= 0").selectExpr("doc_id", "idx", "style", "substring(text, 1, 80) AS start")


def _element(row: dict) -> str:
    """A paragraph of a Word file's body."""
    toggles = "".join(f"<w:{k}/>" for k, on in (("b", row["all_bold"]), ("i", row["all_italic"])) if on)
    marks = f'<w:pStyle w:val="{escape(row["style"].replace(" ", ""))}"/>'
    marks += '<w:numPr><w:numId w:val="1"/></w:numPr>' if row["numbered"] else ""
    sizes = [f'w:{k}="{int(n)}"' for k, n in (("left", row["left_indent"]), ("firstLine", row.get("indent"))) if n is not None and n == n]
    marks += f"<w:ind {' '.join(sizes)}/>" if sizes else ""
    marks += '<w:jc w:val="center"/>' if row["centered"] else ""
    part = row.get("italic") or ""
    before, slanted, after = row["text"].partition(part) if part else ("", row["text"], "")
    pieces = ((before, toggles), (slanted, "<w:i/>" if part else toggles), (after, toggles))
    text = "".join(f'<w:r><w:rPr>{on}</w:rPr><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t, on in pieces if t)
    p = f'<w:p><w:pPr>{marks}</w:pPr>{text}{"<w:r><w:br w:type=\"page\"/></w:r>" if row["page_break"] else ""}</w:p>'
    return f"<w:tbl><w:tr><w:tc>{p}</w:tc></w:tr></w:tbl>" if row["in_table"] else p


def write_paragraphs(rows: list[dict]) -> bytes:
    """A Word file of paragraphs: style, text, all_bold, all_italic, centered, page_break, numbered, left_indent, in_table.

    They may have an indent (of the first line) and a part of the text that is in italics.
    """
    space = f'xmlns:w="{W[1:-1]}"'
    text = f"<w:document {space}><w:body>{''.join(map(_element, rows))}</w:body></w:document>"
    return _zipped([*_fixed_parts(tuple(sorted({r["style"] for r in rows}))), _part("word/document.xml", text)])


@lru_cache(maxsize=64)
def _fixed_parts(styles: tuple[str, ...]) -> tuple:
    """The parts that files with the same styles share."""
    sheet = "".join(f'<w:style w:type="paragraph" w:styleId="{escape(n.replace(" ", ""))}"><w:name w:val="{escape(n)}"/></w:style>' for n in styles)
    kinds = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
    return _part("[Content_Types].xml", kinds), _part("word/styles.xml", f'<w:styles xmlns:w="{W[1:-1]}">{sheet}</w:styles>')


def _part(name: str, text: str) -> tuple[bytes, bytes, bytes]:
    """Name, header fields and deflated data of a part of a zip file."""
    data = text.encode()
    z = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    # Version 2.0, deflated, 1 January 1980.
    return name.encode(), struct.pack("<5H3L2H", 20, 0, 8, 0, 33, zlib.crc32(data), len(packed), len(data), len(name), 0), packed


def _zipped(parts: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A zip file of parts; zipfile does the same, but with more work for each than small files are worth."""
    if sum(len(data) for _, _, data in parts) > MOST_ZIPPED:
        raise ValueError("a Word file of more than 2 GB can't be written")
    out, listed, at = [], [], 0
    for name, header, data in parts:
        out += (b"PK\3\4", header, name, data)
        listed += (b"PK\1\2", struct.pack("<H", 20), header, struct.pack("<2H2L", 0, 0, 0, at).join((b"\0\0", b"")), name)
        at += 30 + len(name) + len(data)
    listed = b"".join(listed)
    return b"".join((*out, listed, b"PK\5\6", struct.pack("<4H2LH", 0, 0, len(parts), len(parts), len(listed), at, 0)))


def packed(rows: DataFrame) -> DataFrame:
    """path, content: a Word file of each doc_id's rows, in the order of idx; path is the doc_id as text."""
    columns = ("idx", "style", "text", "all_bold", "all_italic", "centered", "page_break", "numbered", "left_indent", "in_table")
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))

    return listed.select(F.col("doc_id").cast("string").alias("path"), "rows").mapInArrow(_write_batches, "path string, content binary")


def _write_batches(batches):
    """Arrow batches of files from those of lists of rows."""
    made = lambda files: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*files), (pa.string(), pa.binary()), strict=True)], names=["path", "content"])
    files, size = [], 0
    for f in batches:
        lists = f.column("rows")
        rows = lists.flatten()
        names = [x.name for x in rows.type]
        values = zip(*[x.to_pylist() for x in rows.flatten()])
        for path, n in zip(f.column("path").to_pylist(), lists.value_lengths().to_pylist(), strict=True):
            files.append((path, write_paragraphs([dict(zip(names, next(values))) for _ in range(n)])))
            size += len(files[-1][1])
            if len(files) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield made(files)
                files, size = [], 0
    if files:
        yield made(files)


COLOURS = {"ERROR": "red", "WARNING": "yellow", "SUGGESTION": "cyan", "INFO": "green"}


def annotate(data: bytes, notes: list[tuple[int, int, int, str, str]]) -> bytes:
    """A copy of a file with the text [s, e) of paragraph idx highlighted and a comment on it, for each note.

    notes: idx, s, e, severity, comment.
    """
    for prefix, uri in (("w", W[1:-1]), ("r", "http://schemas.openxmlformats.org/officeDocument/2006/relationships")):
        ET.register_namespace(prefix, uri)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    root = ET.fromstring(parts["word/document.xml"])
    body = root.find(f"{W}body")
    paragraphs = [x for x in body if x.tag == f"{W}p"]
    comments = ET.Element(f"{W}comments")
    for number, (idx, s, e, severity, said) in enumerate(notes):
        if not 0 <= idx < len(paragraphs):
            continue
        p, at, marked = paragraphs[idx], 0, []
        for run in [r for r in p if r.tag == f"{W}r"]:
            text = _run_text(run)
            low, high = max(0, s - at), min(len(text), e - at)
            at += len(text)
            if low >= high:
                continue
            place, new = list(p).index(run), []
            for piece, hit in ((text[:low], False), (text[low:high], True), (text[high:], False)):
                if piece:
                    r = ET.Element(f"{W}r")
                    old = run.find(f"{W}rPr")
                    pr = ET.SubElement(r, f"{W}rPr")
                    for x in old if old is not None else ():
                        if not (hit and x.tag in (f"{W}highlight", f"{W}b")):
                            pr.append(x)
                    if hit:
                        ET.SubElement(pr, f"{W}b")
                        ET.SubElement(pr, f"{W}highlight", {f"{W}val": COLOURS.get(severity.upper(), "yellow")})
                        marked.append(r)
                    t = ET.SubElement(r, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                    t.text = piece
                    new.append(r)
            p.remove(run)
            for k, r in enumerate(new):
                p.insert(place + k, r)
        if marked:
            where = {f"{W}id": str(number)}
            p.insert(list(p).index(marked[0]), ET.Element(f"{W}commentRangeStart", where))
            after = list(p).index(marked[-1]) + 1
            p.insert(after, ET.Element(f"{W}commentRangeEnd", where))
            r = ET.Element(f"{W}r")
            ET.SubElement(r, f"{W}commentReference", where)
            p.insert(after + 1, r)
            c = ET.SubElement(comments, f"{W}comment", where | {f"{W}author": "Style check"})
            for line in said.split("\n"):
                t = ET.SubElement(ET.SubElement(ET.SubElement(c, f"{W}p"), f"{W}r"), f"{W}t")
                t.text = line
    parts["word/document.xml"] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    parts["word/comments.xml"] = ET.tostring(comments, encoding="utf-8", xml_declaration=True)
    kinds = parts.get("[Content_Types].xml", b"").decode()
    if "comments+xml" not in kinds:
        kinds = kinds.replace("</Types>", '<Override PartName="/word/comments.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"/></Types>')
    parts["[Content_Types].xml"] = kinds.encode()
    rels = parts.get("word/_rels/document.xml.rels", b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>').decode()
    if "/comments" not in rels:
        rels = rels.replace("</Relationships>", '<Relationship Id="rIdComments" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments" Target="comments.xml"/></Relationships>')
    parts["word/_rels/document.xml.rels"] = rels.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in parts.items():
            z.writestr(n, d)
    return out.getvalue()


def annotated(files: DataFrame, notes: DataFrame) -> DataFrame:
    """path, content: annotated copies. files: path, content; notes: path, idx, s, e, severity, comment."""
    listed = notes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "s", "e", "severity", "comment"))).alias("notes"))

    def write(frames):
        for f in frames:
            out = [annotate(bytes(c), [tuple(n.values()) if isinstance(n, dict) else tuple(n) for n in (rows if rows is not None else ())]) for c, rows in zip(f["content"], f["notes"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "content": out})

    return files.select("path", "content").join(listed, "path", "left").mapInPandas(write, "path string, content binary")
