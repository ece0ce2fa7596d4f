"""Problem 4: freely typed values mapped to a canonical list by token-level repair and soft TF-IDF.

Every distinct value is split into tokens and into joined runs of neighbours, of any number of tokens as long as the
run isn't longer than the longest joined entry (typing errors that move or add a space; a run of one token is two words
written as one). Every distinct token is joined to the reference vocabulary by edit distance: the vocabulary's deletion
neighbourhood is an index, so a token meets only words that share a deletion with it and each of those is verified.
The corrected tokens are then combined per value: an entry (term or alias) is complete when all its words are
present, and complete entries are ranked by the soft TF-IDF product of value and entry. A value with no complete
entry is unmatched (-1).

Only distinct values and distinct tokens are shuffled; rows join their value's result once. Values with more than a
share of all rows are heavy, at most 1 / share of them: their results are broadcast, so their rows never move, and the
other rows meet theirs in a shuffle join. The vocabulary is a
reference list held by the driver up to a documented size, beyond which the operator raises.

Defined results: null and blank values have no row; values without letters or digits are unmatched; ties go to the
smaller code; word order, case and punctuation do not matter; repeated rows each get a row; an empty list leaves
everything unmatched.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 100_000
#: Values with more than this share of all rows are heavy, so there are at most 1 / SHARE of them.
SHARE = 0.001


def normal(c: Column) -> Column:
    """Lower case, anything but letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{Nd}]+", " "))


def normal_text(s: str) -> str:
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


#: Edits at most for a word, for a whole value written together, and for a run inside a longer value.
CAPS = {"w": 2, "j": 2, "i": 1}


def allowed_edits(size: int, cap: int = 2) -> int:
    """Edits within which a word of the vocabulary of that length is recognised."""
    return min(cap, 0 if size <= 3 else 1 if size <= 5 else 2)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of letters, also around another edit) between a and b, most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = len(a) + len(b)
    last_row: dict[str, int] = {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        d[i + 1][1] = i
        last_col = 0
        for j, y in enumerate(b, 1):
            k, m = last_row.get(y, 0), last_col
            if x == y:
                last_col = j
            d[i + 1][j + 1] = min(
                d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        last_row[x] = i
        if min(d[i + 1]) > most and min(d[i]) > most:
            return most + 1
    return min(d[-1][-1], most + 1)


def deletions(word: str, edits: int) -> set[str]:
    out = {word}
    level = {word}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


class Vocabulary:
    """Words of one codelist and the joined forms of its entries, indexed by their deletions."""

    def __init__(self, words: set[str], cap: int = 2):
        self.words, self.cap = words, cap
        self.index: dict[str, list[str]] = defaultdict(list)
        self.most = max((allowed_edits(len(w), cap) for w in words), default=0)
        for w in words:
            for d in deletions(w, allowed_edits(len(w), cap)):
                self.index[d].append(w)

    def nearest(self, token: str) -> list[tuple[str, float]]:
        """(word, similarity) of every word within its allowed edits; an exact word stands alone."""
        if token in self.words:
            return [(token, 1.0)]
        if len(token) > max(map(len, self.words), default=0) + self.most:
            return []
        seen = {w for d in deletions(token, self.most) for w in self.index.get(d, ())}
        out = []
        for w in seen:
            most = allowed_edits(len(w), self.cap)
            if (k := edit_distance(token, w, most)) <= most:
                out.append((w, 1.0 - k / max(len(w), len(token))))
        return out


def reference_entries(terms: DataFrame, limit: int = MAX_ENTRIES) -> list[tuple[str, int, str]]:
    """(codelist, code, entry as normal text) of all terms and aliases; more than `limit` terms raise."""
    rows = terms.select("codelist", "code", "term", "aliases").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} reference terms")
    out = set()
    for codelist, code, term, aliases in rows:
        for e in [term or "", *(aliases or "").split("|")]:
            if codelist is not None and code is not None and (n := normal_text(e)):
                out.add((codelist, code, n))
    return sorted(out)


def match_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """values has (field, norm), distinct, not null: append code, -1 where no entry is complete."""
    spark = values.sparkSession
    entries = reference_entries(terms)
    by_field: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for field, code, entry in entries:
        by_field[field].append((code, entry))
    weighted, words, joined = [], {}, {}
    for field, es in by_field.items():
        df: dict[str, int] = defaultdict(int)
        for _, e in es:
            for w in set(e.split()):
                df[w] += 1
        idf = {w: 1.0 + math.log(len(es) / n) for w, n in df.items()}
        for k, (code, e) in enumerate(es):
            own = sorted(set(e.split()))
            norm = math.sqrt(sum(idf[w] ** 2 for w in own))
            weighted += [(field, "w", w, k, code, idf[w] ** 2 / norm, 1, len(own)) for w in own]
            weighted += [(field, kind, e.replace(" ", ""), k, code, norm, len(own), len(own)) for kind in ("j", "i")]
        words[field], joined[field] = set(idf), {e.replace(" ", "") for _, e in es}
    wide = "field string, kind string, word string, entry int, code int, weight double, covers int, needs int"
    entry_words = spark.createDataFrame(weighted, wide)

    tokens = F.split("norm", " ")
    n = F.size("t")
    longest = max((len(w) for ws in joined.values() for w in ws), default=0)
    # a token has at least one letter, so a run that can match has at most this many
    runs = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(longest + CAPS["i"]))), lambda k: F.when(k < n, F.array_join(F.slice("t", i, k), ""))))),
        lambda s: F.length(s) <= longest + CAPS["i"],
    )
    whole = F.array_join("t", "")
    grams = values.withColumn("t", tokens).select(
        "field", "norm",
        F.explode(F.concat(
            F.transform(F.array_distinct("t"), lambda w: F.struct(F.lit("w").alias("kind"), w.alias("gram"))),
            F.transform(F.array_distinct(runs), lambda w: F.struct(F.lit("i").alias("kind"), w.alias("gram"))),
            F.when(F.length(whole) <= longest + CAPS["j"], F.array(F.struct(F.lit("j").alias("kind"), whole.alias("gram")))).otherwise(F.array().cast("array<struct<kind:string,gram:string>>")),
        )).alias("g"),
    ).select("field", "norm", "g.kind", "g.gram")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[tuple[str, str], Vocabulary] = {}  # only those a task meets
        for b in batches:
            out = []
            for field, kind, gram in zip(b["field"], b["kind"], b["gram"], strict=True):
                if field not in words:
                    continue
                if (v := built.get((kind, field))) is None:
                    v = built[kind, field] = Vocabulary((words if kind == "w" else joined)[field], CAPS[kind])
                out += [(field, kind, gram, w, s) for w, s in v.nearest(gram)]
            yield pd.DataFrame(out, columns=["field", "kind", "gram", "word", "sim"])

    # tokens are few bytes but much work each, so the number of tasks must not follow the bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    repaired = grams.select("field", "kind", "gram").distinct().repartition(parts, "gram").mapInPandas(repair, "field string, kind string, gram string, word string, sim double")
    hits = grams.join(repaired, ["field", "kind", "gram"]).groupBy("field", "norm", "kind", "word").agg(F.max("sim").alias("sim"))
    scored = (
        hits.join(entry_words, ["field", "kind", "word"])
        .groupBy("field", "norm", "kind", "entry", "code", "needs")
        .agg(F.sum("covers").alias("covered"), F.sum(F.col("weight") * F.col("sim")).alias("score"))
        .where(F.col("covered") >= F.col("needs"))
    )
    best = scored.groupBy("field", "norm").agg(F.max_by("code", F.struct(F.round("score", 9), -F.col("code"))).alias("code"))
    return values.join(best, ["field", "norm"], "left").select("field", "norm", F.coalesce("code", F.lit(-1)).alias("code"))


def match_terms(rows: DataFrame, terms: DataFrame, share: float = SHARE) -> DataFrame:
    """rows has (field, rec_id, value): (field, rec_id, code) of every filled value that is not a term of its codelist
    letter for letter."""
    exact = terms.select(F.col("codelist").alias("field"), F.col("term").alias("value")).where(F.col("value").isNotNull()).distinct()
    cases = rows.where(F.trim("value") != "").join(exact, ["field", "value"], "left_anti").select("field", "rec_id", normal(F.col("value")).alias("norm"))
    counts = cases.groupBy("field", "norm").agg(F.count(F.lit(1)).alias("n"))
    mapped = match_values(counts.select("field", "norm"), terms)
    heavy = F.broadcast(counts.where(F.col("n") > counts.agg(F.sum("n").alias("t")).scalar() * share).select("field", "norm"))
    hot = cases.join(F.broadcast(mapped.join(heavy, ["field", "norm"])), ["field", "norm"])
    cold = cases.join(heavy, ["field", "norm"], "left_anti").join(mapped, ["field", "norm"])
    return hot.unionByName(cold).select("field", "rec_id", "code")
