import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.parsers import code, latex, myst, notebook, tables, typst

TEX = "% head\n\\documentclass{a}\n\\begin{document}\n\\section*{One $x$}\nText \\ref{r} and \\textbf{bold} \\verb|a b|.\n\\begin{align}\na &= b \\text{ where } c\n\\end{align}\n\\begin{verbatim}\nno text\n\\end{verbatim}\nEnd.\n\\end{document}\n"
MD = "---\ntitle: t\n---\n(lab)=\n# Head `c`\n\nPara with $m$ and [link](http://x.y) {ref}`z`.\n\n::: {note} Title\nBody *strong*.\n:::\n\n```python\ncode()\n```\n\n- item one\n- item **two**\n\n| a | b |\n|---|---|\n| c | $d$ |\n\n> quote\n"
TYP = '#set page(width: 1cm)\n= Head\n\nText *bold* and $x + "where"$ // note\n\n#figure(image("a.png"), caption: [A caption.])\n#link("u", title: "T")[body]\n/* c */ @ref <lab>\n'


def texts(segments):
    return [c.strip() for k, c in segments if k == "text"]


def test_latex():
    found = latex.segments(TEX)
    assert "".join(c for _, c in found) == TEX
    said = " ".join(texts(found))
    assert all(w in said for w in ("One", "Text", "bold", "where", "End.")) and not any(w in said for w in ("no text", "documentclass", "head"))
    assert ("placeholder", "\\ref{r}") in found and ("placeholder", "\\verb|a b|") in found
    assert latex.segments("a\\end{document}") == [("placeholder", "a\\end{document}")]


def test_latex_settings():
    own = latex.Settings(frozenset({"code"}), frozenset(), frozenset({"key"}), {"box": {"mandatory": [2]}}, {"box": {"mandatory": 2}})
    found = latex.segments("\\begin{code}x\\end{code}\\key{k}\\box{a}{b}{c}", own)
    assert texts(found) == ["b", "c"]


def test_latex_chunks():
    chunks = latex.chunks(TEX)
    assert chunks[0].startswith("% head") and chunks[1] == "\\begin{document}" and chunks[-1] == "\\end{document}"
    assert "\\section*{One $x$}" in chunks and any(c.startswith("\\begin{align}") for c in chunks)
    assert max(len(c) for c in latex.chunks("word " * 400)) >= 600


def test_myst():
    found = myst.segments(MD)
    assert "".join(c for _, c in found) == MD
    said = " ".join(texts(found))
    assert all(w in said for w in ("Head", "Para with", "link", "Title", "Body", "strong", "item one", "two", "quote"))
    assert not any(w in said for w in ("code()", "title: t", "http", "(lab)"))


def test_myst_chunks_take_labels_along():
    chunks = myst.chunks("(a)=\n# One\n\ntext\n\n(b)=\n## Two\n\nmore\n(c)=\n")
    assert [c[3].splitlines()[0] for c in chunks] == ["(a)=", "(b)="] and chunks[1][3].endswith("(c)=\n")
    long = "# H\n\n" + "\n\n".join("p" * 900 for _ in range(4))
    assert [c[0] for c in myst.chunks(long)] == ["heading"] + ["paragraph"] * 4 and myst.chunks("") == []


def test_typst():
    found = typst.segments(TYP)
    assert "".join(c for _, c in found) == TYP
    said = " ".join(texts(found))
    assert all(w in said for w in ("Head", "Text", "bold", "where", "note", "A caption.", "T", "body", "c"))
    assert "a.png" not in said and "page" not in said
    assert texts(typst.segments('#link("u", title: "T", info: "I")[b]', {"link": ["info"]})) == ["I", "b"]


def test_typst_chunks_and_subchunks():
    text = "= A\n\n" + "word " * 300 + "\n\n= B\n\nshort\n"
    chunks = typst.chunks(text)
    assert "".join(c for _, c in chunks) == text and chunks[0][0] == "auto_chunk_1" and len(chunks) == 2
    long = "word. " * 800 + "$x$ " + "y " * 500
    parts = typst.subchunks(long)
    assert "".join(parts) == long and max(map(len, parts)) <= 2000


def test_code():
    source = 'x = "text"  # note\ny = f(1)\n'
    found = code.segments(source)
    assert "".join(c for _, c in found) == source and texts(found) == ["text", "note"]
    assert texts(code.segments('int a = 1; // note\nString s = "hi"; /* b */', "java")) == ["note", "hi", "b"]
    assert texts(code.segments('let s = r#"raw"#; // n', "rust"))[-1] == "n" and code.segments("(", "python") == [("placeholder", "(")]
    assert code.segments("é = 'ü'\n")[2] == ("text", "ü") and code.segments("x", "cobol") == [("placeholder", "x")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\\{}[]$%`*_#|:-=<>()\"/@&.1", max_size=80))
def test_segments_are_lossless(source):
    for kind in ("latex", "myst", "typst", "code", "other"):
        assert "".join(c for _, c in tables.segments_of(kind, source)) == source
    tables.chunks_of("latex", source), tables.chunks_of("markdown", source), tables.chunks_of("typst", source)


def test_notebook(spark):
    raw = json.dumps({"cells": [{"cell_type": "markdown", "source": ["a\n", "b"], "metadata": {"tags": ["needs_review"]}}, {"cell_type": "code", "source": "x=1", "metadata": {"src_checksum": "s"}}]})
    rows = notebook.explode_cells(spark.createDataFrame([(1, raw), (2, "not json"), (3, None)], "id int, t string"), "t", "id").orderBy("cell_index").collect()
    assert [(r.cell_index, r.cell_type, r.source, r.src_checksum, r.tags) for r in rows] == [(1, "markdown", "a\nb", None, ["needs_review"]), (2, "code", "x=1", "s", None)]
    assert json.loads(notebook.written([{"cell_type": "code", "source": "x"}]))["nbformat"] == 4


@pytest.mark.parametrize("header, expected", [("---\njupytext:\n  text_representation:\n    extension: .md\n    format_name: myst\n---\nx", True), ("---\ntitle: a\n---\n", False), ("x", False), ("---\nopen", False), ("---\n: [\n---\n", False)])
def test_jupytext_header(header, expected):
    assert notebook.has_jupytext_header(header) is expected


def test_table_functions(spark):
    df = spark.createDataFrame([(1, "latex", "a $x$"), (2, "myst", None), (3, "other", ""), (4, None, "t")], "id bigint, kind string, content string").withColumn("seg_index", F.lit("clash"))
    rows = {(r.id, r.seg_index, r.kind, r.content) for r in tables.segments(df, "id", "kind", "content").collect()}
    assert rows == {(1, 1, "text", "a "), (1, 2, "placeholder", "$x$"), (4, 1, "text", "t")}
    assert tables.segments(df.limit(0), "id", "kind", "content").count() == 0
