"""Scalar functions on texts, paths and messages, as Column expressions (inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line boundary of Python's str.splitlines but \r, which a scan turns into \n (fixed values).
BREAKS = r"\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
#: White space as Python's str.strip takes it (fixed values).
WHITE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
#: Suffix of a path and the type of its document (fixed values).
DOC_TYPES = {"tex": "latex", "ipynb": "jupyter", "md": "markdown", "typ": "typst"}


def universal_newlines(text: Column) -> Column:
    """\\r\\n and \\r become \\n, as in a text-mode read; to be applied before chunking and hashing."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def checksum(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text, without any normalisation."""
    return F.sha2(text, 256)


def normal_path(path: Column) -> Column:
    """A POSIX path without doubled slashes, `.` parts and a trailing slash; `..` stays."""
    p = F.regexp_replace(path, "/+", "/")
    p = F.regexp_replace(p, r"(?:^|(?<=/))(?:\./)+", "")
    p = F.regexp_replace(p, r"/\.$", "")
    return F.regexp_replace(p, "(?<=.)/$", "")


def path_checksum(path: Column) -> Column:
    return checksum(normal_path(path))


def document_type(path: Column) -> Column:
    """Type by the case-sensitive suffix; anything else is `other`."""
    suffix = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for end, kind in DOC_TYPES.items():
        out = out.when(suffix == end, kind)
    return out.otherwise("other")


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is in the text."""
    return text.rlike(f"^[{WHITE}]*$")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def lines_with_ends(text: Column) -> Column:
    """The lines of a text, each with its line end; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(f"[^{BREAKS}]*[{BREAKS}]|[^{BREAKS}]+"), F.lit(0))


def line_chunks(text: Column, n: int) -> Column:
    """The text in chunks of n lines; n <= 0 gives the whole text, an empty text no chunk."""
    if n <= 0:
        return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    pattern = f"(?:[^{BREAKS}]*[{BREAKS}]|[^{BREAKS}]+){{1,{n}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def between(text: Column, start: str, end: str) -> Column:
    """From the first start tag to the next end tag, stripped; '' without a start; the rest, as it is, without an end."""
    at = F.instr(text, start)
    rest = F.substr(text, at + F.lit(len(start)))
    stop = F.instr(rest, end)
    return F.when(at == 0, "").when(stop == 0, rest).otherwise(strip(F.substr(rest, F.lit(1), stop - F.lit(1))))


def translated_part(message: Column) -> Column:
    """What a model's reply gives as its result.

    All bodies of `<output>` (one leading line break less each, an unterminated one to the end), else all `<document>`
    elements with their tags, else ''."""
    outputs = F.regexp_extract_all(message, F.lit(r"(?s)<output>(.*?)(?:</output>|\z)"), F.lit(1))
    documents = F.regexp_extract_all(message, F.lit(r"(?s)<document>.*?(?:</document>|\z)"), F.lit(0))
    bodies = F.transform(outputs, lambda body: F.regexp_replace(body, r"^\n", ""))
    return F.when(message.contains("<output>"), F.array_join(bodies, "")).otherwise(F.array_join(documents, ""))


def display_path(path: Column, root: Column) -> Column:
    """The path relative to root if it is under it, else as given."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + F.lit(2))).otherwise(path)


def is_under(path: Column, directory: Column) -> Column:
    return (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


#: comment leader, and what stands before and after the metadata block of a format (fixed values)
BLOCKS = {"latex": ("% ", "", ""), "myst": ("% ", "\n<!--\n", "-->\n"), "typst": ("// ", "", "")}
START, END = "CHUNK_METADATA_START", "CHUNK_METADATA_END"


def metadata_block(entries: Column, kind: str) -> Column:
    """The block that carries `key: value` entries (an array of structs, in order) in front of a chunk."""
    leader, before, after = BLOCKS[kind]
    rows = F.transform(entries, lambda e: F.concat(F.lit(leader), e["key"], F.lit(": "), e["value"], F.lit("\n")))
    return F.concat(
        F.lit(f"{before}{leader}{START}\n"), F.array_join(rows, ""), F.lit(f"{leader}{END}\n{after}")
    )


def block_pattern(kind: str) -> str:
    """Pattern of a metadata block; group 1 is what is inside."""
    leader, before, after = BLOCKS[kind]
    escaped = {"% ": "% ?", "// ": "// ?"}[leader]
    return f"(?s){before.lstrip() and '<!--' + chr(10)}{escaped}{START}\n(.*?){escaped}{END}\n{after}"


def block_start(kind: str) -> str:
    """Pattern of the beginning of a metadata block."""
    leader, before, _ = BLOCKS[kind]
    escaped = {"% ": "% ?", "// ": "// ?"}[leader]
    return f"{before.lstrip() and '<!--' + chr(10)}{escaped}{START}\n"


def parse_metadata(block: Column) -> Column:
    """key, value pairs of the inside of a block: leader taken off, split at the first colon, trimmed."""
    rows = F.filter(F.split(block, "\n"), lambda row: row.rlike(r"^(?:%|//) ?[^:]+:"))
    return F.transform(
        rows,
        lambda row: F.struct(
            strip(F.regexp_extract(row, r"^(?:%|//) ?([^:]+):", 1)).alias("key"),
            strip(F.regexp_extract(row, r"^(?:%|//) ?[^:]+:(.*)$", 1)).alias("value"),
        ),
    )


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Literal replacement of the tokens, one after the other in the given order."""
    for token, value in values.items():
        template = F.replace(template, F.lit(token), value)
    return template


def fatal_message(error_type: Column, service: Column, model: Column) -> Column:
    """What to tell of a failure that ended a run."""
    name = F.lower(F.regexp_extract(error_type, r"([^.]*)$", 1))
    return (
        F.when(name == "authenticationfailed", F.concat(F.lit("The key for "), service, F.lit(" was not accepted.")))
        .when(name == "modelnotfound", F.concat(service, F.lit(" has no model "), model, F.lit(".")))
        .when(name.isin("ratelimited", "serviceunavailable", "readtimeout", "retriesexhausted"), F.concat(service, F.lit(" did not answer, however often it was asked.")))
        .otherwise(F.concat(F.lit("A call of "), model, F.lit(" failed: "), F.coalesce(error_type, F.lit("unknown")), F.lit(".")))
    )


def summary(from_cache: Column, translated: Column, reasoning: Column, failed: Column) -> Column:
    """The lines that sum up a run; the last two only if they tell something."""
    line = lambda name, n: F.concat(F.lit(f"{name}: "), n.cast("string"))
    return F.concat_ws(
        "\n", line("from the memory", from_cache), line("translated", translated),
        F.when(reasoning > 0, line("by the reasoning model", reasoning)), F.when(failed > 0, line("failed", failed)),
    )


#: the wording of reports (fixed values)
_HEADLINE, _UNKNOWN = "Translation failure on chunk #", "unknown"


def failure_lines(index: Column, error_type: Column, message: Column, source: Column, source_line: Column, target: Column, target_line: Column, limit: int = 200) -> Column:
    """The report of one failed chunk: a headline and where it is in both files."""
    head = F.concat(F.lit(_HEADLINE), index.cast("string"), F.lit(" ("), F.coalesce(error_type, F.lit(_UNKNOWN)), F.lit(")"))
    head = F.concat(head, F.when(F.coalesce(message, F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), F.substring(message, 1, limit))))

    def place(name: str, path: Column, line: Column) -> Column:
        return F.when(path.isNotNull(), F.concat(F.lit(f"  {name}: "), path, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit(""))))

    return F.concat_ws("\n", head, place("source", source, source_line), place("target", target, target_line))


def string_literal_parts(text: Column) -> Column:
    """opening quote, inside, closing quote of a string literal."""
    return F.array(*(F.regexp_extract(text, '(?s)^(")(.*)(")$', i) for i in (1, 2, 3)))


def line_comment_parts(text: Column) -> Column:
    """delimiter with one adjoining blank, and the rest, of a `//` comment."""
    return F.array(*(F.regexp_extract(text, "(?s)^(// ?)(.*)$", i) for i in (1, 2)))


def block_comment_parts(text: Column) -> Column:
    """delimiters with one adjoining blank each, and the inside, of a /* */ comment."""
    return F.array(*(F.regexp_extract(text, r"(?s)^(/\* ?)(.*?)( ?\*/)$", i) for i in (1, 2, 3)))


def notebook_source(source: Column) -> Column:
    """A cell's source from its list of lines."""
    return F.array_join(source, "")
