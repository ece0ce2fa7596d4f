"""Training of the tagger of personal information on a bounded sample of rows that rules label, and its check.

    python -m vitaline.llm.pii_train TRAIN_DOCUMENTS             fits and writes the model
    python -m vitaline.llm.pii_train TRAIN_DOCUMENTS HELD_OUT    agreement of the model with the rules on other documents

The rules know no names: they harvest them from the training sample (pii_labels). In every training document the
words of names are replaced by invented ones, so no name of the sample gets a weight of its own, and the weights are
those of context and form. In some documents "the monitor" and the like becomes a family name the document holds
elsewhere, in others a full name or an invented organisation; a single word in such a place is told apart by its other
mention only, which is what the skip potential is for. Weights are fitted by maximum likelihood of the linear chain (stochastic gradient
with adaptive steps and a quadratic penalty) on most of the sample, the skip weights by maximum pseudo-likelihood of
the mentions given their neighbours on the rest.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter

import numpy as np

from vitaline.llm import crf, pii, pii_labels

#: documents of the sample at most, and how many of them fit the skip weights
SAMPLE, FOR_SKIP = 9000, 1500
EPOCHS, BATCH = 10, 16
RATE, PENALTY = 0.15, 1e-6
MIN_COUNT = 3
#: shares of documents that get a second mention, a full name or a stranger in place of a role, of numbers with a word
#: between, and of second mentions that are eponyms in the documents that fit the skip weights
SECOND, FULL, STRANGER, BETWEEN, EPONYM = 0.4, 0.25, 0.25, 0.15, 0.3
ROLE = re.compile(r"\b[Tt]he (?:sub-)?(?:investigator|monitor|pharmacist|reporter|sponsor|coordinator|data manager|study nurse|medical reviewer)\b")
ORGANISATIONS = (" Pharma", " Institute", " Group", " Ltd", " Labs", " Hospital", " University")
NOUNS = ("score", "index", "scale", "test", "criteria", "syndrome")
FORMS = ("Dr", "Dr.", "Mr", "Mr.", "Ms", "Ms.", "Mrs", "Mrs.", "Prof.", "Professor")
SOFT, HARD = "aeiouy", "bcdfghjklmnprstvwz"

Found = list[tuple[str, int, int]]


def invented(rng: random.Random) -> str:
    return "".join(rng.choice(HARD) + rng.choice(SOFT) + (rng.choice(HARD) if rng.random() < 0.4 else "") for _ in range(rng.choice((2, 2, 3)))).capitalize()


def replaced(text: str, found: Found, cuts: list[tuple[int, int, str, bool]]) -> tuple[str, Found]:
    """The text with (start, end, new text, whether it is a name) put in, and all passages at their new places."""
    out, at, size, moves = [], 0, 0, []
    added: Found = []
    for a, b, new, is_name in sorted(cuts):
        out += [text[at:a], new]
        size += a - at
        if is_name:
            added.append(("name", size, size + len(new)))
        size += len(new)
        at = b
        moves.append((a, b, len(new) - (b - a)))
    moved = [(k, a + sum(d for _, y, d in moves if y <= a), b + sum(d for _, y, d in moves if y <= b)) for k, a, b in found]
    return "".join([*out, text[at:]]), sorted(moved + added, key=lambda x: x[1])


def renamed(text: str, found: Found, lex: pii_labels.Lexicon, rng: random.Random) -> tuple[str, Found]:
    """Invented words in place of every harvested name word, the same for the same word."""
    made: dict[str, str] = {}
    cuts = []
    for m in re.finditer(r"[^\W\d_]{3,}", text):
        w = m[0].capitalize()
        if m[0][0].isupper() and (w in lex.given or w in lex.family) and not any(k != "name" and a <= m.start() < b for k, a, b in found):
            new = made.setdefault(w, invented(rng))
            cuts.append((*m.span(), new.upper() if m[0].isupper() else new, False))
    return replaced(text, found, cuts)


def full_name(span: tuple[int, int], rng: random.Random) -> list[tuple[int, int, str, bool]]:
    """Cuts that put an invented name there, sometimes after a title."""
    given, family, initial = invented(rng), invented(rng), rng.choice(HARD).upper()
    title = rng.choice(("", "", *FORMS))
    forms = (f"{given} {family}", f"{given} {family}", f"{given} {initial}. {family}", f"{given} {family}-{invented(rng)}", f"{initial}. {family}", f"{family}, {given}", f"{family.upper()} {given}")
    name = family if title and rng.random() < 0.3 else rng.choice(forms)
    return [(span[0], span[0], title + " ", False), (*span, name, True)] if title else [(*span, name, True)]


def with_mentions(text: str, found: Found, rng: random.Random, eponyms: bool = False) -> tuple[str, Found]:
    """A role of the text replaced by a family name the text holds elsewhere (or by a thing named after it), by a full
    name, or by a stranger that is no person; and words between the name of an official number and the number."""
    roles = [m.span() for m in ROLE.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in found)]
    families = [m[0] for k, a, b in found if k == "name" for m in [re.search(r"(?<![\w.])[^\W\d_]{3,}(?=,)|[^\W\d_]{3,}$", text[a:b])] if m and not m[0].isupper()]
    cuts = [(a - 1, a, rng.choice((": ", " is ", " no. ", " was ", " = ")), False) for k, a, b in found if k == "id_no" and text[a - 1] == " " and rng.random() < BETWEEN]
    x = rng.random()
    spans = rng.sample(roles, min(len(roles), rng.choice((1, 1, 2))))
    if families and x < SECOND:
        thing = eponyms and rng.random() < EPONYM
        cuts += [(*span, f"the {rng.choice(families)} {rng.choice(NOUNS)}" if thing else rng.choice(families), not thing) for span in spans]
    elif x < SECOND + FULL:
        cuts += [c for span in spans for c in full_name(span, rng)]
    elif x > 1 - STRANGER:
        name = invented(rng) + rng.choice(("", "", *ORGANISATIONS))
        cuts += [(*span, name, False) for span in spans]
    return replaced(text, found, cuts)


def units_of(text: str) -> list[tuple[int, object]] | None:
    """Per token the parts its score is summed from: (place, token type or flag), eleven of each token."""
    tokens = [(m[0], m.start(), m.end()) for m in pii.TOKEN.finditer(text)]
    if not tokens:
        return None
    types = ["\n"] * 3 + [pii.token_type(t) for t, _, _ in tokens] + ["\n"] * 3
    flags = ["", *[pii.FLAGS[i] for i in pii.candidate_flags(text, np.array([a for _, a, _ in tokens]))], ""]
    out = []
    for i in range(len(tokens)):
        fresh = i == 0 or "\n" in text[tokens[i - 1][2] : tokens[i][1]]
        out += [(o, types[i + 3 + o]) for o in (0, *pii.OFFSETS)] + [("f=", flags[i + 1]), ("f-=", flags[i]), ("f+=", flags[i + 2]), ("nl", fresh)]
    return out


def features_of(unit: tuple) -> list[str]:
    place, x = unit
    if place == 0:
        return pii.own_features(x)
    if place == "nl":
        return ["nl"] if x else []
    return [f"{place}{x}"] if isinstance(place, str) else pii.context_features(x, place)


def token_labels(starts, ends, found: Found) -> np.ndarray:
    labels = np.zeros(len(starts), dtype=np.int64)
    for kind, a, b in found:
        first, last = np.searchsorted(starts, a), np.searchsorted(ends, b, side="right")
        labels[first:last] = 2 + 2 * crf.KINDS.index(kind)
        labels[first : first + 1] -= first < last
    return labels


def fit(rows: list[tuple[str, Found]], epochs: int = EPOCHS, seed: int = 5) -> dict:
    """Weights and transitions of the linear chain."""
    numbers: dict[tuple, int] = {}
    data = []
    for text, found in rows:
        if (units := units_of(text)) is None:
            continue
        places = [m.span() for m in pii.TOKEN.finditer(text)]
        y = token_labels(np.array([a for a, _ in places]), np.array([b for _, b in places]), found)
        data.append((np.array([numbers.setdefault(u, len(numbers)) for u in units], dtype=np.int64).reshape(len(y), -1), y))
    named = [features_of(u) for u in numbers]
    often = np.bincount(np.concatenate([u.ravel() for u, _ in data]), minlength=len(named))
    counts: Counter = Counter()
    for fs, n in zip(named, often.tolist(), strict=True):
        for f in fs:
            counts[f] += n
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= MIN_COUNT))}
    void = len(index)
    width = max(map(len, named))
    of = np.full((len(named), width), void, dtype=np.int64)
    for i, fs in enumerate(named):
        known = [index[f] for f in fs if f in index]
        of[i, : len(known)] = known
    data.sort(key=lambda r: len(r[1]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    labels = crf.N_LABELS
    w, t = np.zeros((void + 1, labels)), np.zeros((labels, labels))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    barred = crf.allowed_transitions()
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        loss = 0.0
        for k in rng.permutation(len(batches)):
            part = batches[k]
            size = np.array([len(y) for _, y in part])
            real = np.arange(size.max())[None] < size[:, None]
            y = np.concatenate([r[1] for r in part])
            uniq, inv = np.unique(np.concatenate([r[0] for r in part]), return_inverse=True)
            inv = inv.reshape(len(y), -1)
            flat = w[of[uniq]].sum(1)[inv].sum(1)
            node = np.zeros((*real.shape, labels))
            node[real] = flat
            trans = t + barred
            f, b, z = crf.marginals(node, trans, size)
            post = np.exp((f + b - z[:, None, None])[real])
            head = np.cumsum(size) - size
            inner = np.ones(len(y), dtype=bool)
            inner[head] = False
            into = np.flatnonzero(inner)
            loss += z.sum() - flat[np.arange(len(y)), y].sum() - trans[y[into - 1], y[into]].sum() - crf.STARTS[y[head]].sum()
            post[np.arange(len(y)), y] -= 1.0
            pairs = (f[:, :-1, :, None] + trans[None, None] + (node + b)[:, 1:, None, :] - z[:, None, None, None])[real[:, 1:]]
            gt_now = np.exp(pairs).sum(0)
            np.add.at(gt_now, (y[into - 1], y[into]), -1.0)
            hot = np.flatnonzero(np.abs(post).max(1) > 1e-3)
            if len(hot):
                per_unit = np.zeros((len(uniq), labels))
                np.add.at(per_unit, inv[hot].ravel(), np.repeat(post[hot], inv.shape[1], axis=0))
                moved = np.flatnonzero(np.abs(per_unit).max(1) > 0)
                touched, place = np.unique(of[uniq[moved]].ravel(), return_inverse=True)
                g = np.zeros((len(touched), labels))
                np.add.at(g, place.ravel(), np.repeat(per_unit[moved], width, axis=0))
                g += PENALTY * w[touched]
                gw[touched] += g * g
                w[touched] -= RATE * g / np.sqrt(gw[touched])
                w[void] = 0
            gt += gt_now * gt_now
            t -= RATE * gt_now / np.sqrt(gt)
        print(f"epoch {epoch}: loss {loss:.1f}", flush=True)
    weights = {f: np.rint(w[i] * 100).astype(int) for f, i in index.items()}
    return {
        "skip": {"O": 0.0, "name": 0.0},
        "transitions": np.rint(t * 100).astype(int).tolist(),
        "weights": {f: v.tolist() for f, v in sorted(weights.items()) if np.abs(v).max() >= 8},
    }


def fit_skip(model: dict, rows: list[tuple[str, Found]]) -> dict[str, float]:
    """Skip weights of "outside" and "name": maximum pseudo-likelihood of each mention given those it is linked to."""
    tagger = pii.Tagger(model)
    _, begin, starts, ends, doc, node, links, flags = tagger.nodes([t for t, _ in rows])
    gold = np.concatenate([token_labels(starts[doc == k] - begin[k], ends[doc == k] - begin[k], found) for k, (_, found) in enumerate(rows)])
    at, linked, left, right = crf.active(node, tagger.trans, doc, links, flags > 0, crf.MARGIN, True)
    chains = crf.Chains(at, doc, tagger.trans)
    belief = chains.beliefs(node[at].astype(np.float64), chains.of(linked))
    own = np.logaddexp(belief[:, crf.NAME[0]], belief[:, crf.NAME[1]]) - belief[:, 0]
    name, outside = (np.isin(gold[at], crf.NAME).astype(float), (gold[at] == 0).astype(float))
    x = np.zeros((len(at), 2))
    for a, b in ((left, right), (right, left)):
        np.add.at(x, a, np.stack([-outside[b], name[b]], 1))
    keep = linked[(name + outside)[linked] > 0]
    x, y, offset = x[keep], name[keep], own[keep]
    w = np.zeros(2)
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        w = np.maximum(0.0, w - 0.5 * np.linalg.solve(h, x.T @ (p - y) + 0.01 * w))
    print(f"{len(keep)} mentions, {int(y.sum())} of them names; skip weights {w.round(2).tolist()}", flush=True)
    return {"O": round(float(w[0]), 2), "name": round(float(w[1]), 2)}


def _texts(path: str) -> list[str]:
    import pyarrow.parquet as pq

    return [t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t]


def sample(path: str, seed: int = 11) -> list[str]:
    docs = _texts(path)
    return random.Random(seed).sample(docs, min(SAMPLE, len(docs)))


def train(texts: list[str], seed: int = 12) -> dict:
    rng = random.Random(seed)
    lex = pii_labels.harvest(texts)
    last = min(FOR_SKIP, len(texts) // 5)
    rows = []
    for k, text in enumerate(texts):
        text, found = renamed(text, pii_labels.label(text, lex), lex, rng)
        rows.append(with_mentions(text, found, rng, eponyms=k < last))
    model = fit(rows[last:])
    model["skip"] = fit_skip(model, rows[:last])
    return model


def save(model: dict) -> None:
    lines = ",\n".join(f"{json.dumps(f, ensure_ascii=False)}: {json.dumps(v, separators=(',', ':'))}" for f, v in model["weights"].items())
    pii.MODEL.write_text(f'{{\n"skip": {json.dumps(model["skip"])},\n"transitions": {json.dumps(model["transitions"])},\n"weights": {{\n{lines}\n}}}}\n', encoding="utf-8")


def agreement(tagger: pii.Tagger, rows: list[tuple[str, Found]]) -> dict[str, tuple[int, int, int]]:
    """Per kind: passages of the rules, of the tagger, and of both."""
    out = {k: [0, 0, 0] for k in crf.KINDS}
    for (_, want), have in zip(rows, tagger.tag([t for t, _ in rows]), strict=True):
        for i, passages in enumerate((set(want), set(have), set(want) & set(have))):
            for k, _, _ in passages:
                out[k][i] += 1
    return {k: tuple(v) for k, v in out.items()}


def evaluate(train_texts: list[str], held: list[str], model: dict, seed: int = 13) -> None:
    """Prints agreement on held-out documents as they are, and with invented names and second mentions, with and without skip edges."""
    lex, rng = pii_labels.harvest(train_texts), random.Random(seed)
    plain = [(t, pii_labels.label(t, lex)) for t in held]
    altered = [with_mentions(*renamed(t, found, lex, rng), rng, eponyms=True) for t, found in plain]
    for title, rows in (("as they are", plain), ("invented names, second mentions, eponyms", altered)):
        for skip in (model["skip"], {"O": 0.0, "name": 0.0}):
            print(f"{len(rows)} documents {title}, skip {skip}: (rules, tagger, both)", agreement(pii.Tagger(model | {"skip": skip}), rows), flush=True)


def main(train_path: str, held_path: str | None = None) -> None:
    texts = sample(train_path)
    if held_path is None:
        save(train(texts))
    else:
        evaluate(texts, _texts(held_path), pii.load_model())


if __name__ == "__main__":
    main(*sys.argv[1:])
