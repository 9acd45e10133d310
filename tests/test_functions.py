import hashlib

import pytest
from pyspark.sql import functions as F

from quirelake.functions import languages, tagging, text
from quirelake.operators import ordered
from quirelake.operators.translate import extract, tag, verify


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("path, normal", [("a//b/./c/", "a/b/c"), ("./a", "a"), ("a/../b", "a/../b"), ("a/.", "a"), ("/", "/")])
def test_normal_path(spark, path, normal):
    assert one(spark, path, text.normal_path) == normal
    assert one(spark, path, text.path_checksum) == hashlib.sha256(normal.encode()).hexdigest()


@pytest.mark.parametrize("path, kind", [("a/b.tex", "latex"), ("a.TEX", "other"), ("x.tar.md", "markdown"), ("n.ipynb", "jupyter"), ("t.typ", "typst"), ("typ", "other")])
def test_document_type(spark, path, kind):
    assert one(spark, path, text.document_type) == kind


@pytest.mark.parametrize("value", ["", " ", "\t\n", "\x0b\x1c\x85 \xa0", "a", " a ", "​"])
def test_blank_is_python_strip(spark, value):
    assert one(spark, value, text.is_blank) == (not value.strip())
    assert one(spark, value, text.strip) == value.strip()


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\nb", "\n\n\n", "a\x0bb\x85c d\n", "x\n" * 7])
@pytest.mark.parametrize("n", [0, 1, 3, 50])
def test_line_chunks_tile_the_text(spark, value, n):
    lines = value.splitlines(keepends=True)
    expected = (["".join(lines[i : i + n]) for i in range(0, len(lines), n)] if n > 0 else [value]) if value else []
    assert one(spark, value, lambda x: text.line_chunks(x, n)) == expected


@pytest.mark.parametrize(
    "reply", ["", "x", "<output>a</output>", "a<output>\n\nb</output>c<output>d", "<document><TEXT>t</TEXT></document>z", "<document>open", "<output></output><document>d</document>"]
)
def test_translated_part(spark, reply):
    assert one(spark, reply, text.translated_part) == extract(reply)


def test_between(spark):
    assert [one(spark, x, lambda c: text.between(c, "<a>", "</a>")) for x in ("q", "<a> b </a> c", "<a> rest ")] == ["", "b", " rest "]


@pytest.mark.parametrize("kind", ["latex", "typst", "myst"])
def test_metadata_round_trip(spark, kind):
    entries = F.array(F.struct(F.lit("key").alias("key"), F.lit("a: b").alias("value")), F.struct(F.lit("flag").alias("key"), F.lit("True").alias("value")))
    block = F.concat(text.metadata_block(entries, kind), F.col("x"))
    row = spark.createDataFrame([("body\n",)], "x string").select(block.alias("b")).select(
        F.regexp_extract("b", text.block_pattern(kind), 1).alias("inside"), F.regexp_replace("b", text.block_pattern(kind), "").alias("rest")
    ).select(text.parse_metadata(F.col("inside")).alias("m"), "rest").first()
    assert [(m.key, m.value) for m in row.m] == [("key", "a: b"), ("flag", "True")] and row.rest.strip() == "body"


def test_comment_and_literal_parts(spark):
    assert one(spark, '"a b"', text.string_literal_parts) == ['"', "a b", '"']
    assert one(spark, "// note", text.line_comment_parts) == ["// ", "note"]
    assert one(spark, "/* a */", text.block_comment_parts) == ["/* ", "a", " */"]


def test_failure_lines(spark):
    row = spark.createDataFrame([(3, "E", "m" * 300, "a.md", 7, None, None)], "i int, t string, m string, s string, sl int, g string, gl int")
    report = row.select(text.failure_lines(*(F.col(c) for c in ("i", "t", "m", "s", "sl", "g", "gl"))).alias("r")).first()["r"]
    assert report == "Translation failure on chunk #3 (E): " + "m" * 200 + "\n  source: a.md:7"


def test_language_resolution(spark):
    names = [one(spark, x, lambda c: languages.resolve(c, {"Klingon": "_kl"}, {"kl": "Klingon"})) for x in ("FRENCH", "Klingon", "klingon", "KL", "none")]
    assert names == ["French", "Klingon", None, "Klingon", None]
    assert one(spark, "ukrainian", languages.directory_suffix) == "_ua"


SEGMENTS = [("text", "a & <b> "), ("math", "$x$"), ("placeholder", "`c`"), ("placeholder", "\n"), ("placeholder", "\\d"), ("text", "e"), ("placeholder", "")]


def test_tagging_round_trip(spark):
    df = spark.createDataFrame([(SEGMENTS,)], "s array<struct<kind:string,content:string>>")
    numbered = tagging.number_placeholders(tagging.coalesce_segments(F.col("s")))
    row = df.select(tagging.build_xml(numbered).alias("xml"), tagging.placeholder_map(numbered).alias("map"), tagging.only_placeholders(numbered).alias("only"))
    got = row.first()
    xml, placeholders, only = tag(SEGMENTS)
    assert got.xml == xml and got["map"] == placeholders and got["only"] == only is False
    assert placeholders == {"1": "$x$`c`", "2": "\n", "3": "\\d"}
    assert tagging.rebuild(xml, placeholders) == "".join(c for _, c in SEGMENTS)
    assert row.select(tagging.restore(F.col("xml"), F.col("map")).alias("t")).first()["t"] == "".join(c for _, c in SEGMENTS)
    assert verify(xml, placeholders) == ([], [])
    missing, extra = tagging.missing_and_extra(F.lit('<PH id="3">x</PH><PH id="12"/>'), F.col("map"))
    ids = row.select(missing.alias("m"), extra.alias("e")).first()
    assert (ids.m, ids.e) == (["1"], ["12"]) == verify('<PH id="3">x</PH><PH id="12"/>', placeholders)


def test_rebuild_of_odd_xml():
    assert tagging.rebuild('<document><TEXT>a<PH id="9">k</PH>b<i>no</i>c</TEXT></document>', {}) == "akbc"
    assert tagging.rebuild("<document></document>") == ""
    with pytest.raises(SyntaxError):
        tagging.rebuild("<document>")


def test_packing(spark):
    df = spark.createDataFrame([([900, 900, 700, 2500, 100, 100], [False] * 6), ([500, 200, 10, 5, 700], [False, False, True, False, False]), ([], [])], "n array<int>, alone array<boolean>")
    rows = df.select(ordered.greedy_bins(F.col("n"), 2000).alias("g"), ordered.flush_bins(F.col("n"), F.col("alone"), 600).alias("f")).collect()
    assert rows[0].g == [0, 0, 1, 2, 3, 3] and rows[1].f == [0, 0, 1, 2, 2] and rows[2].g == []


def test_located_lines(spark):
    df = spark.createDataFrame([("a\nb\na\nc", ["a\n", "a\n", "zz", "", "b"])], "t string, c array<string>")
    assert df.select(ordered.located_lines(F.col("t"), F.col("c")).alias("l")).first()["l"] == [1, 3, None, None, 2]


def test_running_total_is_split(spark):
    rows = [("g", i, i % 7) for i in range(2500)] + [("h", 3, 1)]
    out = ordered.running_total(spark.createDataFrame(rows, "g string, i bigint, v bigint"), ["g"], ["i"], "v", "s", block=100)
    got = {(r.g, r.i): r.s for r in out.collect()}
    assert all(got["g", i] == sum(k % 7 for k in range(i)) for i in (0, 1, 99, 100, 101, 2499)) and got["h", 3] == 0


def test_spans(spark):
    spans = spark.createDataFrame([("d", 0, 5), ("d", 1, 3), ("d", 6, 8)], "d string, s int, e int")
    kept = ordered.reaching_to_next(ordered.nested_away(spans, "d", "s", "e"), "d", "s", "e")
    assert sorted((r.s, r.e) for r in kept.collect()) == [(0, 6), (6, 8)]


def test_split_at_boundary():
    pieces = ordered.split_at_boundary("word " * 1000, 300)
    assert "".join(pieces) == "word " * 1000 and all(len(p) <= 300 and p.endswith(" ") for p in pieces)
    assert ordered.split_at_boundary("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and ordered.split_at_boundary("", 5) == []
