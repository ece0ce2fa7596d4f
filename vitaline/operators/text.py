"""Extraction from analysis plans and protocols (doc_id, text) with built-in regular expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline import registry as R

_SIGNS = r"[^\p{L}\p{N}]"


def classify(c: Column, phrases: Mapping[str, Sequence[str]], default: str) -> Column:
    """Name of the phrase a text mentions first, as whole words and without regard to case; the longer of two that begin together.

    All phrases are one alternation, so a text is scanned once; what was found is looked up by its letters and digits.
    """
    names = {p: name for name, ps in phrases.items() for p in ps}
    longest_first = sorted(names, key=lambda p: (-len(p), p))
    any_phrase = "|".join(p.replace(" ", f"{_SIGNS}+") for p in longest_first)
    found = F.regexp_extract(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{any_phrase})(?![\p{{L}}\p{{N}}])", 0)
    key = F.regexp_replace(F.lower(found), f"{_SIGNS}+", " ")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], F.lit(default))


def method(c: Column) -> Column:
    return classify(c, R.METHOD_PHRASES, "Descriptive")


def population(c: Column) -> Column:
    """The analysis set, ITT where none is named."""
    return classify(c, R.POPULATION_PHRASES, "ITT")


def shells(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, number, title) of the tables, figures and listings a text announces as `Table 14.1: title`.

    A title runs to the end of its line or to the next announcement in it.
    """
    parts = []
    for kind in ("table", "figure", "listing"):
        p = rf"(?i)\b{kind}\s+(\d+(?:\.\d+)*)\s*[:\-–]\s*([^\n]+?)(?=\s*\b(?:table|figure|listing)\s+\d+(?:\.\d+)*\s*[:\-–]|\n|\z)"
        text = F.col("text")
        z = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("number"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("title"))
        parts.append(docs.select("doc_id", F.lit(kind).alias("kind"), F.inline(z)).select("doc_id", "kind", "number", F.trim("title").alias("title")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: what stands before an item of a list: a number, a letter or a bullet
_MARK = r"\s*(?:\d{1,3}(?:\.\d+)*[.)]?|[A-Za-z][.)]|[-*•–])\s+"


def endpoints(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, id, name, method, population) of listed primary and secondary endpoints.

    A section runs from its heading to the next heading of the plan, and a text may have several of a kind; items are
    numbered or bulleted lines of at least 10 characters; numbers restart in every section.
    """
    parts = []
    for kind, prefix, width in (("primary", "EP", 3), ("secondary", "EP_S", 2)):
        sections = F.regexp_extract_all(F.col("text"), F.lit(rf"(?is){kind} endpoints?\s*:?(.*?)(?=(?:primary|secondary|exploratory) endpoint|analysis population|statistical method|\z)"), F.lit(1))
        items = F.filter(F.transform(F.split("section", rf"\n(?={_MARK})"), lambda x: F.trim(F.regexp_replace(x, rf"^{_MARK}", ""))), lambda x: F.length(x) >= 10)
        rows = docs.select("doc_id", F.explode(sections).alias("section")).select("doc_id", F.lit(kind).alias("kind"), F.posexplode(items).alias("pos", "item"))
        line = F.substring_index("item", "\n", 1)
        name = F.when(line.contains("."), F.trim(F.substring_index(line, ".", 1))).otherwise(F.substring(line, 1, 100))
        parts.append(rows.select("doc_id", "kind", F.concat(F.lit(prefix), F.lpad((F.col("pos") + 1).cast("string"), width, "0")).alias("id"), name.alias("name"), method(F.col("item")).alias("method"), population(F.col("item")).alias("population")))
    return parts[0].unionByName(parts[1])


def study(docs: DataFrame) -> DataFrame:
    """(doc_id, study_id, phase): the code after "study number" or the like, else the first code of letters and digits;
    the phase in Arabic digits, with its letter. UNKNOWN and Unknown where a text names none."""
    text = F.col("text")
    labelled = F.regexp_extract(text, r"\b(?i:(?:study|trial|protocol)\s+(?:identifier|number|code|id|no\.))[:#\s]+([A-Z0-9][A-Z0-9-]*\d[A-Z0-9-]*)", 1)
    bare = F.regexp_extract(text, r"(?<![\w-])([A-Z]{2,6}\d{4,9})(?!\d)", 1)
    phase = F.regexp_extract(text, r"\b(?i:phase)[\s-]+((?:[1-4]|I{1,3}|IV)[ab]?)\b", 1)
    arabic = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(phase, "^IV", "4"), "^III", "3"), "^II", "2"), "^I", "1")
    sid = F.when(labelled != "", labelled).when(bare != "", bare).otherwise("UNKNOWN")
    return docs.select("doc_id", sid.alias("study_id"), F.when(phase != "", arabic).otherwise("Unknown").alias("phase"))


def arms(docs: DataFrame) -> DataFrame:
    """(doc_id, arm, name, armcd): `Arm A: name` lines, the first per letter; texts without any get Placebo and Active."""
    p = r"(?im)^\s*(?:treatment\s+)?arm\s+([A-Z0-9])\s*[:\-]\s*([^\n]+)"
    z = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("arm"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("name"))
    first = F.filter(z, lambda x, i: F.array_position(F.transform(z, lambda y: F.upper(y["arm"])), F.upper(x["arm"])) == i + 1)
    default = F.array(F.struct(F.lit("A").alias("arm"), F.lit("Placebo").alias("name")), F.struct(F.lit("B").alias("arm"), F.lit("Active").alias("name")))
    return docs.select("doc_id", F.posexplode(F.when(F.size(first) > 0, first).otherwise(default)).alias("pos", "a")).select(
        "doc_id", F.upper("a.arm").alias("arm"), F.trim("a.name").alias("name"), F.concat(F.lit("ARM"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("armcd")
    )


def token_estimate(c: Column) -> Column:
    """Rough size of a text: a quarter of its characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


def cut_text(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def display_date(d: Column) -> Column:
    """DDMONYYYY, NK for missing."""
    return F.coalesce(F.upper(F.date_format(d, "ddMMMyyyy")), F.lit("NK"))
