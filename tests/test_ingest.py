import hashlib
import json
import random
import zipfile

import numpy as np
import pytest
from helpers import chunk
from pyspark.sql import functions as F

from clauseweave.operators import ingest as I
from clauseweave.schema import BLOCK
from clauseweave.sources.chunks import read_chunks, write_chunks
from clauseweave.sources.docx import parse_docx, read_docx
from clauseweave.sources.records import file_checksums, read_manifest, read_npy, read_questions

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def p(text, style=None):
    runs = "<w:tab/>".join(f'<w:t xml:space="preserve">{part}</w:t>' for part in text.split("\t"))
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r>{runs}</w:r></w:p>"


def tbl(*rows):
    cell = lambda c: c if c.startswith("<w:tc>") else f"<w:tc>{p(c)}</w:tc>"
    return "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(path, *body):
    styles = "".join(
        f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>'
        for i, n in (("H1", "heading 1"), ("H2", "heading 2"), ("H3", "heading 3"), ("T1", "toc 1"))
    )
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>')
        archive.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
    return str(path)


def test_docx_to_chunks(spark, tmp_path):
    wide = f'<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("both")}</w:tc>'
    path = docx(
        tmp_path / "spec.docx",
        p("1\tHeating\t7", "T1"),
        p("1.1\tPipe runs\t9", "T1"),
        p("cover text"),
        p("1\tHeating", "H1"),
        p("First   paragraph."),
        tbl(["a", "b"], ["", ""], [wide]),
        p("1.1\tPipe runs", "H2"),
        p("Second paragraph."),
        p("Annex without number", "H1"),
    )
    documents = read_docx(spark, path)
    chunks = I.chunk_documents(documents, max_chars=500)
    rows = chunks.orderBy("chunk_no").collect()
    assert [(r["section"], r["content_type"], r["text"], r["page_start"]) for r in rows] == [
        ("1", "paragraph", "First paragraph.", 7),
        ("1", "table", "a | b\nboth | both", 7),
        ("1.1", "paragraph", "Second paragraph.\n\nAnnex without number", 9),
    ]
    assert rows[2]["heading_path"] == ["1", "1.1"]
    digest = hashlib.sha1(b"First paragraph.").hexdigest()[:10]
    assert rows[0]["chunk_id"] == f"ts24501-v19.2.0-1-001-{digest}"
    summary = I.ingestion_summary(documents, chunks).first().asDict()
    assert summary == {"paragraphs": 3, "tables": 1, "sections": 2, "chunks": 3, "chunks_with_page": 3}
    with pytest.raises(ValueError):
        I.chunk_documents(documents, max_chars=499)
    out = str(tmp_path / "chunks")
    write_chunks(chunks, out, ["doc", "chunk_no"])
    back = read_chunks(spark, out)
    assert [r["chunk_id"] for r in back.orderBy("chunk_seq").collect()] == [r["chunk_id"] for r in rows]
    checksum = file_checksums(spark, path).first()["sha256"]
    assert checksum == documents.first()["sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest()


def test_merged_cells_and_special_runs(tmp_path):
    top = f'<w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{p("x")}</w:tc>'
    low = f"<w:tc><w:tcPr><w:vMerge/></w:tcPr>{p('')}</w:tc>"
    path = docx(tmp_path / "t.docx", tbl([top, "1"], [low, "2"]), "<w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t><w:noBreakHyphen/></w:r></w:p>")
    blocks = parse_docx(open(path, "rb").read())
    assert [b["text"] for b in blocks] == ["x | 1\nx | 2", "a b-"]


def documents(spark, *blocks):
    rows = [(1, "f.docx", [(k, t, s, t) for k, t, s in blocks])]
    return spark.createDataFrame(rows, f"doc int, source_file string, blocks array<{BLOCK.simpleString()}>")


def pack_by_hand(blocks, limit):
    """Stack, carry-forward and packing written as a plain loop."""
    stack, section, out, open_text, size = [], None, [], [], 0
    path = []

    def close():
        nonlocal open_text, size
        if open_text:
            out.append((section, "paragraph", "\n\n".join(open_text), list(path)))
        open_text, size = [], 0

    for kind, text, style in blocks:
        if style.startswith("Heading "):
            close()
            level = int(style.split()[1])
            stack = [s for s in stack if s[0] < level] + [(level, text.split()[0])]
            section, path = text.split()[0], [s[1] for s in stack]
        elif section is None:
            continue
        elif kind == "table":
            close()
            out.append((section, "table", text, list(path)))
        else:
            if open_text and size + len(text) + 2 > limit:
                close()
            open_text.append(text)
            size += len(text) + 2
    close()
    return out


def test_packing_boundaries(spark):
    # 248 + 2 twice is exactly 500; one more character opens a second chunk.
    body = lambda *sizes: [("paragraph", "x" * n, "Normal") for n in sizes]
    head = [("paragraph", "1 T", "Heading 1")]
    sizes = lambda *b: [len(r["text"]) for r in I.chunk_documents(documents(spark, *head, *b), max_chars=500).orderBy("chunk_no").collect()]
    assert sizes(*body(248, 248)) == [498]
    assert sizes(*body(248, 249)) == [248, 249]
    assert sizes(*body(10, 900, 10)) == [10, 900, 10]
    assert sizes(*body(5), ("table", "t", "Table"), *body(6, 7)) == [5, 1, 15]


def test_folding_matches_a_plain_loop(spark):
    rng = random.Random(9)
    blocks = []
    for i in range(300):
        roll = rng.random()
        if roll < 0.15:
            blocks.append(("paragraph", f"{i}.1 Title {i}", f"Heading {rng.choice([1, 2, 3, 5])}"))
        elif roll < 0.25:
            blocks.append(("table", f"table {i}", "Table"))
        else:
            blocks.append(("paragraph", "w" * rng.randint(1, 400), "Normal"))
    rows = I.chunk_documents(documents(spark, *blocks), max_chars=700).orderBy("chunk_no").collect()
    got = [(r["section"], r["content_type"], r["text"], r["heading_path"]) for r in rows]
    assert got == pack_by_hand(blocks, 700)


def test_headings_and_contents_lines(spark):
    cases = [
        ("paragraph", "4.2A.1 General", "Heading 3"),
        ("paragraph", "FOREWORD", "heading 4"),
        ("paragraph", "Annex", "Heading 1"),
        ("paragraph", "4.2A.1 General", "Normal"),
        ("paragraph", "5 Title", "Heading 1 Char"),
    ]
    marked = I.mark_blocks(documents(spark, *cases)).select(F.inline("marked")).orderBy("at").collect()
    assert [tuple(r["heading"]) if r["heading"] else None for r in marked] == [
        (3, "4.2A.1", "General"),
        (1, "Foreword", "Foreword"),
        None,
        None,
        None,
    ]
    lines = spark.createDataFrame([("4.2A.1\tGeneral\t53",), ("4\t53",), ("x\ty\t1",), ("4\ty\tz",)], "t string")
    parsed = [r[0] for r in lines.select(I.parse_toc_line(F.col("t"))).collect()]
    assert [tuple(v) if v else None for v in parsed] == [("4.2A.1", 53), None, None, None]


def test_corpus_validation(spark, tmp_path):
    def write(name, *lines):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(path)

    row = {k: v for k, v in chunk("a", "1", "T", "é text").items() if k != "chunk_seq"}
    lines = [json.dumps({**row, "chunk_id": f"c{i}", "extra": 1}) for i in range(50)]
    blank = json.dumps({**row, "chunk_id": "c3", "text": "  "})
    good = write("good.jsonl", blank, "", *lines)
    got = read_chunks(spark, good).orderBy("chunk_seq").collect()
    assert [r["chunk_id"] for r in got] == [f"c{i}" for i in range(50)]
    assert got[0]["chunk_seq"] == 3 and got[0]["text"] == "é text"

    with pytest.raises(ValueError, match=r"dup.jsonl:3"):
        read_chunks(spark, write("dup.jsonl", lines[0], lines[1], lines[0]))
    no_key = {k: v for k, v in row.items() if k != "section"}
    for broken in ("{not json", json.dumps(no_key), "[1]", json.dumps({**row, "text": None})):
        with pytest.raises(Exception, match=r"bad\S*.jsonl:2"):
            read_chunks(spark, write(f"bad{abs(hash(broken))}.jsonl", lines[0], broken)).collect()
    rows = read_chunks(spark, write("mixed.jsonl", lines[0], "{not json", lines[2]), validate=False)
    assert [bool(r["problem"]) for r in rows.orderBy("chunk_seq").collect()] == [False, True, False]
    optional = {k: v for k, v in row.items() if not k.startswith("page")}
    assert read_chunks(spark, write("opt.jsonl", json.dumps(optional))).first()["page_start"] is None


def test_record_sources(spark, tmp_path):
    questions = tmp_path / "q.json"
    questions.write_text(json.dumps([{"id": "q", "question": "why?", "required_sections": ["4", "5"]}]))
    assert read_questions(spark, str(questions)).first()["required_sections"] == ["4", "5"]
    questions.write_text("[]")
    with pytest.raises(ValueError):
        read_questions(spark, str(questions))
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"artifacts": [{"artifact_id": "a", "kind": "graph", "release": None}]}))
    assert read_manifest(spark, str(manifest)).first()["artifact_id"] == "a"
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    rows = read_npy(spark, str(tmp_path / "v.npy")).orderBy("chunk_seq").collect()
    assert [r["embedding"] for r in rows] == [[0, 1], [2, 3], [4, 5]]


def test_long_documents_and_several_at_once(spark):
    """Windows stay inside a document, and thousands of blocks give what a plain loop gives."""
    rng = random.Random(12)

    def long(n):
        out = []
        for i in range(n):
            roll = rng.random()
            if roll < 0.1:
                out.append(("paragraph", f"{i}.2 Title {i}", f"Heading {rng.choice([1, 2, 3, 4, 12])}"))
            elif roll < 0.15:
                out.append(("table", f"table {i}", "Table"))
            else:
                out.append(("paragraph", "w" * rng.randint(1, 300), "Normal"))
        return out

    sets = {f"d{k}": long(n) for k, n in enumerate((4000, 1, 0, 700))}
    one = None
    for name, blocks in sets.items():
        rows = documents(spark, *blocks).withColumn("doc", F.lit(name))
        one = rows if one is None else one.unionByName(rows)
    got = {}
    for r in I.chunk_documents(one, max_chars=600).orderBy("doc", "chunk_no").collect():
        got.setdefault(r["doc"], []).append((r["chunk_no"], r["section"], r["content_type"], r["text"], r["heading_path"]))
    for name, blocks in sets.items():
        want = pack_by_hand(blocks, 600)
        assert [g[1:] for g in got.get(name, [])] == want and [g[0] for g in got.get(name, [])] == list(range(len(want)))
