"""Languages of a project: names, suffixes, and their resolution in one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: predefined languages and the suffix of their directories (fixed values)
SUFFIXES = {"French": "_fr", "English": "_en", "German": "_de", "Spanish": "_es", "Ukrainian": "_ua", "Armenian": "_hy"}
#: columns of the correspondence table, and spellings of their languages in directory labels (fixed values)
COLUMNS = ("english", "french", "german", "spanish", "italian", "ukrainian")
SPELLINGS = {
    "english": ("english", "en"),
    "french": ("french", "français", "fr"),
    "german": ("german", "deutsch", "de"),
    "spanish": ("spanish", "español", "es"),
    "italian": ("italian", "italiano", "it"),
    "ukrainian": ("ukrainian", "українська", "uk", "ua"),
}


def column_of(label: Column) -> Column:
    """The correspondence column that a directory's label names, null if none."""
    name = F.lower(F.trim(label))
    out = F.when(F.lit(False), F.lit(""))
    for column, spellings in SPELLINGS.items():
        out = out.when(name.isin(*spellings), column)
    return out


def sql_column_of(label: str) -> str:
    """The same in SQL."""
    cases = " ".join(
        f"when lower(trim({label})) in ({', '.join(repr(s) for s in names)}) then '{column}'" for column, names in SPELLINGS.items()
    )
    return f"case {cases} end"


def resolve(name: Column, custom: dict[str, str], shorts: dict[str, str]) -> Column:
    """A language by name: predefined without regard to case, then custom exactly, then short without regard to case.

    custom: name -> suffix; shorts: short -> name. Null if nothing matches."""
    out = F.when(F.lit(False), F.lit(""))
    for known in SUFFIXES:
        out = out.when(F.lower(name) == known.lower(), known)
    for known in custom:
        out = out.when(name == known, known)
    for short, known in shorts.items():
        out = out.when(F.lower(name) == short.lower(), known)
    return out


def directory_suffix(language: Column, custom: dict[str, str] | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for known, suffix in {**SUFFIXES, **(custom or {})}.items():
        out = out.when(F.lower(language) == known.lower(), suffix)
    return out
