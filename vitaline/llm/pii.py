"""Problem 9: personal information in free text, found by a skip-chain conditional random field.

Texts are cut into words, digit runs and signs. A token's node score sums weights of its form (word, shape, last
letters), of its neighbours within three tokens, and of generic candidate patterns it lies in. The model
file is trained by pii_train and read by the driver; executors get it by broadcast (about a megabyte, fixed). One
narrow stage tags whole texts in Arrow batches; nothing is shuffled, and a text's result depends on that text alone.
An exact check follows the tagger: passages must have the minimum of their kind (digits of a phone number, an at
sign in an address), and signs at their edges are cut off.

Defined results: null and empty texts have no passages and stay as they are; passages never overlap; positions
count characters of the text as given; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.llm import crf

MODEL = Path(__file__).with_name("pii_model.json")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: tokens with the white space before them: they cover a whole text, so their lengths give their places
COVER = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)")
OFFSETS = (-3, -2, -1, 1, 2, 3)
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_no": "[ID_NO]", "address": "[ADDRESS]", "name": "[NAME]"}
MEMO = 300_000
CHUNK = 1_500_000
EDGE = "\x00"

_STREETS = r"(?:Street|St|Road|Lane|Close|Drive|Gardens|Court|Avenue|Ave|Rd|Blvd|Boulevard|Way|Terrace|Crescent|Place|Square|Row|Hill)"
_UNIT = r"(?:,? (?:Suite|Apt|Flat|Unit|Floor)\.? \w+)?"
_TAIL = r"(?:(?:, |\n)(?:\d{5} )?[A-ZÄÖÜÉ][\w'-]+(?: [A-Z][\w'-]+)?,? ?(?:[A-Z]{2} ?\d{5}|[A-Z]{1,2}\d[\dA-Z]? \d[A-Z]{2,3})?)?"
#: Generic candidate patterns, as features only: what they cover is decided by the model. Each begins with a set of
#: characters and looks back from there, so a scan skips everything else.
CANDIDATES = {
    "E": (),
    "A": (
        re.compile(
            rf"\d(?<![\w.@-].)(?:\d{{0,4}}[a-z]? (?:[NSEW]\. )?(?:[A-Z][\w'-]+ ){{1,3}}{_STREETS}\b{_UNIT}"
            rf"|\d{{0,3}}(?: bis| ter)?,? (?:avenue|rue|quai|impasse|chemin|allée|place|boulevard|cours|square) (?:[dD][eu]s? (?:la )?|l'|d')?[\w'-]+(?: [A-Z][\w'-]+)*){_TAIL}"
        ),
        re.compile(rf"[CAPR](?<![\w.@-].)(?:(?<=C)(?:/|alle|amino)|(?<=A)(?:venida|vda\.)|(?<=P)(?:laza|aseo)|(?<=R)onda) ?(?:de (?:la |los |las )?|del )?[A-ZÁÉÍÓÚÑ]\w+(?: [A-ZÁÉÍÓÚÑ]\w+)*,?(?: n\.º)? \d{{1,4}}{_TAIL}"),
        re.compile(
            r"[A-ZÄÖÜ](?<![\w.@-].)(?:(?:(?<=A)[mn]|(?<=I)m|(?<=Z)u[mr]) (?:[A-ZÄÖÜ]\w+ )*[A-ZÄÖÜ]\w+|\w+er (?:Weg|Straße|Platz|Allee|Gasse|Ring)"
            rf"|[a-zäöüß]+(?:straße|str\.|gasse|allee|weg|platz|ring)) \d{{1,4}} ?[a-z]?\b{_TAIL}"
        ),
    ),
    "P": (
        re.compile(
            r"[+(\d](?<![\w.+:/-].)(?:(?:(?<=\+)|(?<=0)0)\d{1,3}[ .-]?(?:\(\d\) ?)?\d(?:[ ./-]?\d){5,12}|(?<=\()\d{2,5}\)[ .-]?\d(?:[ .-]?\d){5,10}"
            r"|(?<=0)\d{1,4}[ ./-]\d(?:[ .-]?\d){4,10}|(?:(?<=1)[ .-]\d{3}|(?<=\d)\d\d)[ .-]\d{3}[ .-]\d{3,4})(?![\w-]|[.:]\d)"
        ),
    ),
}
FLAGS = ["", *(f"{k}{p}" for k in CANDIDATES for p in "BI")]
_AT = re.compile(r"[@(\[{](?:(?<=@)| ?(?:at|AT|@) ?[)\]}] ?)")
_HOST = re.compile(r"[\w-]+(?:(?:\.| ?[\(\[\{] ?(?:dot|DOT) ?[\)\]\}] ?)[\w-]+)+")


def mail_spans(text: str) -> list[tuple[int, int]]:
    """Candidate mail addresses, grown to both sides of an at sign or its written form."""
    out = []
    for m in _AT.finditer(text):
        a = low = m.start()
        if text[a] != "@" and text[a - 1 : a] == " ":
            a = low = a - 1
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        if a < low and (host := _HOST.match(text, m.end())):
            out.append((a, host.end()))
    return out




def token_type(t: str) -> str:
    """What the model sees of a token: a word as it stands, a digit run as its length."""
    return f"9{min(len(t), 12)}" if t.isdigit() else t


def own_features(t: str) -> list[str]:
    if t[0] == "9" and t[1:].isdigit():
        return ["b", f"w={t}", "s=9"]
    if not t[0].isalpha():
        return ["b", f"w={t}", "s=."]
    low = t.lower()
    shape = "x" if t == low else ("X" if len(t) == 1 else "XX") if t == t.upper() else "Xx" if t[0].isupper() else "xX"
    out = ["b", f"w={low}", f"s={shape}"]
    if len(t) >= 4:
        out += [f"e3={low[-3:]}", f"c={shape}|{low[-3:]}"]
    return out


def context_features(t: str, offset: int) -> list[str]:
    own = own_features(t)
    out = [f"{offset}{own[1]}"]
    if abs(offset) <= 2:
        out += [f"{offset}{f}" for f in own[2:4]]
    return out


def flag_features(flag: str, before: str, after: str, fresh: bool) -> list[str]:
    out = [f"f={flag}", f"f-={before}", f"f+={after}"]
    return [*out, "nl"] if fresh else out


def link_key(t: str) -> str | None:
    """What equal and similar words share: letters without case, accents and a final s; None where a word takes no links."""
    if len(t) < 3 or not t.isalpha() or not t[0].isupper():
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
    return plain[:-1] if len(plain) > 4 and plain[-1] == "s" else plain


def candidate_flags(text: str, starts: np.ndarray) -> np.ndarray:
    """Index into FLAGS for every token."""
    flags = np.zeros(len(starts), dtype=np.int64)
    for k, (kind, patterns) in enumerate(CANDIDATES.items()):
        found = mail_spans(text) if kind == "E" else [m.span() for p in patterns for m in p.finditer(text)]
        if not found:
            continue
        for a, b in np.searchsorted(starts, np.array(found)).tolist():
            if a < b and not flags[a:b].any():
                flags[a:b] = 2 + 2 * k
                flags[a] = 1 + 2 * k
    return flags


class _Ids(dict):
    """Numbers of keys; a new key is handed to `add`, which returns its number."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, key):
        k = self[key] = self.add(key)
        return k


class Tagger:
    """The model with its score tables per token type, grown as types are met and bounded by MEMO.

    A block of texts is cut into tokens by one pass of the regular expression; everything after that is arithmetic on
    arrays, so the cost per token stays small.
    """

    def __init__(self, model: dict):
        self.weights = {k: np.asarray(v, dtype=np.float32) / 100 for k, v in model["weights"].items()}
        self.trans = np.asarray(model["transitions"], dtype=np.float64) / 100 + crf.allowed_transitions()
        self.skip = np.zeros(len(crf.KINDS) + 1)
        for kind, w in model["skip"].items():
            self.skip[0 if kind == "O" else 1 + crf.KINDS.index(kind)] = w
        self.zero = np.zeros(crf.N_LABELS, dtype=np.float32)
        self.flag_own = self._rows([[f"f={f}"] for f in FLAGS])
        self.flag_before = self._rows([[f"f-={f}"] for f in FLAGS])
        self.flag_after = self._rows([[f"f+={f}"] for f in FLAGS])
        self.fresh = self._rows([[], ["nl"]])
        self._reset()

    def _sum(self, features: list[str]) -> np.ndarray:
        out = self.zero
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                out = out + w
        return out

    def _rows(self, features: list[list[str]]) -> np.ndarray:
        return np.stack([self._sum(f) for f in features])

    def _reset(self) -> None:
        self.types: list[str] = []
        self.ids = _Ids(self._new_type)
        self.tables = [np.zeros((0, crf.N_LABELS), dtype=np.float32) for _ in range(1 + len(OFFSETS))]
        self.links = np.zeros(0, dtype=np.int64)
        self.keys: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.raw = _Ids(self._new_raw)
        self.new: list[tuple[int, int, bool]] = []
        self.known = np.zeros((0, 3), dtype=np.int64)

    def _new_type(self, t: str) -> int:
        self.types.append(t)
        return len(self.types) - 1

    def _new_raw(self, t: str) -> int:
        word = t.lstrip()
        lead = t[: len(t) - len(word)]
        self.new.append((self.ids["\n" if word == EDGE else token_type(word)], len(lead), "\n" in lead))
        return len(self.raw)

    def _grow(self) -> None:
        if self.new:
            self.known = np.concatenate([self.known, np.array(self.new, dtype=np.int64)])
            self.new = []
        fresh = self.types[len(self.links) :]
        if not fresh:
            return
        rows = [self._rows([own_features(t) for t in fresh]), *[self._rows([context_features(t, o) for t in fresh]) for o in OFFSETS]]
        self.tables = [np.concatenate([a, b]) for a, b in zip(self.tables, rows, strict=True)]
        keys = [link_key(t) for t in fresh]
        self.links = np.concatenate([self.links, [-1 if k is None else self.keys.setdefault(k, len(self.keys)) for k in keys]])

    def tag(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of the passages of each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        block, size = [], 0
        for n, text in enumerate(texts):
            if text:
                block.append(n)
                size += len(text)
            if size >= CHUNK:
                self._tag_block(block, texts, out)
                block, size = [], 0
        if block:
            self._tag_block(block, texts, out)
        return out

    def scores(self, types: np.ndarray, flags: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Node scores; documents are separated by three edge tokens."""
        e = self.tables[0][types]
        e += self.flag_own[flags]
        e += self.fresh[fresh]
        for o, table in zip(OFFSETS, self.tables[1:], strict=True):
            if o < 0:
                e[-o:] += table[types[:o]]
            else:
                e[:-o] += table[types[o:]]
        e[1:] += self.flag_before[flags[:-1]]
        e[:-1] += self.flag_after[flags[1:]]
        return e

    def nodes(self, texts: list[str]) -> tuple:
        """(whole text, its documents' offsets, and per token: start, end, document, node scores, link, flag) of not empty texts."""
        gap = EDGE * 3
        whole = gap + gap.join(texts) + gap
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes + 3) - sizes
        if len(self.raw) > MEMO:
            self._forget()
        if len(self.types) > MEMO:
            self._reset()
        tokens = COVER.findall(whole)
        raw = np.fromiter(map(self.raw.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
        self._grow()
        types, lead, line = self.known[raw].T
        starts = np.concatenate([[0], ends[:-1]]) + lead
        doc = np.searchsorted(begin, starts, side="right") - 1
        real = (doc >= 0) & (starts < begin[doc] + sizes[doc])
        fresh = (line > 0) & real
        fresh[1:] |= real[1:] & (doc[1:] != doc[:-1])
        flags = candidate_flags(whole, starts)
        node = self.scores(types, flags, fresh.astype(np.int64))
        links = np.where((flags == 1) | (flags == 2), -1, self.links[types])
        return whole, begin, starts[real], ends[real], doc[real], node[real], links[real], flags[real]

    def _tag_block(self, block: list[int], texts: list[str], out: list[list[tuple[str, int, int]]]) -> None:
        whole, begin, starts, ends, doc, node, links, flags = self.nodes([texts[n] for n in block])
        labels = crf.decode(node, self.trans, doc, links, self.skip, must=flags > 0)
        for kind, a, b in crf.spans(labels):
            if (s := checked(whole, crf.KINDS[kind - 1], int(starts[a]), int(ends[b - 1]))) is not None:
                k, at = doc[a], int(begin[doc[a]])
                out[block[k]].append((s[0], s[1] - at, s[2] - at))


_AFTER = re.compile(r"-[A-ZÀ-Þ][^\W\d_]+")
_BEFORE = re.compile(r"(?<![\w-])(?:[A-ZÀ-Þ][^\W\d_]+-)+$")


def checked(text: str, kind: str, a: int, b: int) -> tuple[str, int, int] | None:
    """The passage with signs at its edges cut off, or None if it can't be of its kind."""
    opening, closing = "\"'“”„«»,;:.-_ \n", "\"'“”„«»,;:-_ \n" + ("" if kind == "name" else ".")
    if kind == "name":
        opening += "()[]"
        closing += "()[]"
    while a < b and text[a] in opening:
        a += 1
    while b > a and text[b - 1] in closing:
        b -= 1
    if kind == "name" and b - a > 1 and text[b - 1] == "." and not re.search(r"(?:^|[\W_])[^\W\d_]\.$", text[a:b]):
        b -= 1
    if kind == "name" and a < b:  # a double name is never cut at its hyphen
        while (m := _AFTER.match(text, b)) is not None:
            b = m.end()
        while (m := _BEFORE.search(text[max(0, a - 40) : a])) is not None:
            a -= len(m[0])
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    fine = {
        "email": ("@" in s or re.search(r"[\(\[\{] ?(?:at|@) ?[\)\]\}]", s, re.I) is not None) and " " != s[:1],
        "phone": digits >= 6,
        "id_no": digits >= 4,
        "address": digits >= 1 and any(c.isalpha() for c in s),
        "name": digits == 0 and any(c.isupper() for c in s) and len(s) >= 3,
    }[kind]
    return (kind, a, b) if fine else None


def load_model(path: str | Path = MODEL) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def mask(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with every passage replaced by its placeholder."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda x: x[1]):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _tagged(docs: DataFrame, schema: str, rows, path: str | Path) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            yield rows(b["doc_id"].tolist(), texts, tagger.tag(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def find(docs: DataFrame, path: str | Path = MODEL) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of every passage of docs (doc_id, text)."""

    def rows(ids, texts, found):
        return pd.DataFrame([(i, *s) for i, fs in zip(ids, found, strict=True) for s in fs], columns=["doc_id", "kind", "start_pos", "end_pos"])

    return _tagged(docs, "doc_id long, kind string, start_pos int, end_pos int", rows, path)


def redact(docs: DataFrame, path: str | Path = MODEL) -> DataFrame:
    """(doc_id, text, n_found): texts with typed placeholders, the rest unchanged."""

    def rows(ids, texts, found):
        return pd.DataFrame({"doc_id": ids, "text": [mask(t, f) for t, f in zip(texts, found, strict=True)], "n_found": [len(f) for f in found]})

    return _tagged(docs, "doc_id long, text string, n_found int", rows, path)
