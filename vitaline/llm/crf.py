"""Skip-chain conditional random field over tokens, batched in numpy.

Node scores are sums of feature weights; neighbours share a transition matrix. Mentions of one word in a document
(equal or similar: whatever their case, accents and genitive s, and however far apart) share potentials that reward
labels of one kind, with a learned weight per kind. A skip edge exists where the own score of one of the mentions
favours a name; every mention is linked to the one before it and to the best-scored one, so evidence reaches each of
them in one step. Inference is loopy: chains are solved by forward-backward, the skip edges pass messages between
them until these settle, and the best labelling of every chain is taken with the messages as node scores. Tokens whose
node score favours "outside" by more than a margin split the chains, so the work follows the candidates, not the
text; mentions of a linked word are never split off, whatever their score.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "phone", "id_no", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_LABELS = len(LABELS)
#: kind of each label; 0 is outside
KIND_OF = np.array([0, *(i + 1 for i in range(len(KINDS)) for _ in "BI")])
FORBIDDEN = -1e4
MARGIN = 5.0
ROUNDS = 10
SETTLED = 1e-3
#: labels of a name
NAME = [1 + 2 * KINDS.index("name"), 2 + 2 * KINDS.index("name")]


def allowed_transitions() -> np.ndarray:
    """0 where a label may follow another, FORBIDDEN where not: I-x only after B-x or I-x."""
    m = np.zeros((N_LABELS, N_LABELS), dtype=np.float32)
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:] or before == "O":
                    m[i, j] = FORBIDDEN
    return m


STARTS = np.array([FORBIDDEN if x.startswith("I-") else 0.0 for x in LABELS], dtype=np.float32)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(node: np.ndarray, trans: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward, log backward and log partition of chains node[n, t, label] of lengths size."""
    n, t, _ = node.shape
    f, b = np.empty_like(node), np.zeros_like(node)
    f[:, 0] = node[:, 0] + STARTS
    for i in range(1, t):
        f[:, i] = _lse(f[:, i - 1, :, None] + trans[None], 1) + node[:, i]
    for i in range(t - 2, -1, -1):
        step = _lse(trans[None] + (b[:, i + 1] + node[:, i + 1])[:, None, :], 2)
        b[:, i] = np.where((i + 1 < size)[:, None], step, 0.0)
    z = _lse(f[np.arange(n), size - 1], 1)
    return f, b, z


def best(node: np.ndarray, trans: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best labelling of each chain."""
    n, t, _ = node.shape
    back = np.zeros((n, t, N_LABELS), dtype=np.int8)
    score = node[:, 0] + STARTS
    out = np.zeros((n, t), dtype=np.int8)
    ends = np.where((size == 1)[:, None], score, FORBIDDEN * 10)
    for i in range(1, t):
        x = score[:, :, None] + trans[None]
        back[:, i] = x.argmax(1)
        score = x.max(1) + node[:, i]
        ends = np.where((size == i + 1)[:, None], score, ends)
    y = ends.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, -1, -1):
        y = np.where(i == size - 1, ends.argmax(1), y)
        out[:, i] = np.where(i < size, y, 0)
        y = np.where(i < size, back[rows, i, y], y)
    return out


def _groups(lengths: np.ndarray, cells: int = 400_000):
    """Indices of chains in groups of similar length."""
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        b, low = a + 1, lengths[order[a]]
        while b < len(order) and lengths[order[b]] <= max(low * 1.25, low + 1) and (b - a + 1) * lengths[order[b]] * N_LABELS <= cells:
            b += 1
        yield order[a:b]
        a = b


def candidates(node: np.ndarray, trans: np.ndarray, chain: np.ndarray, margin: float, must: np.ndarray | None = None) -> np.ndarray:
    """Tokens of runs in which a passage may begin, with one neighbour on either side.

    A passage may begin where a B label comes within the margin of "outside", the step from outside included; it may
    go on where an I label does.
    """
    begin = (node[:, 1::2] + (trans[0, 1::2] - trans[0, 0])).max(1) > node[:, 0] - margin
    if must is not None:
        begin |= must
    maybe = begin | (node[:, 2::2].max(1) > node[:, 0] - margin)
    edge = np.ones(len(node), dtype=bool)
    edge[1:] = (maybe[1:] != maybe[:-1]) | (chain[1:] != chain[:-1])
    run = np.cumsum(edge) - 1
    holds = np.zeros(run[-1] + 1, dtype=bool)
    holds[run[begin]] = True
    return _with_neighbours(maybe & holds[run], chain)


def _with_neighbours(inside: np.ndarray, chain: np.ndarray) -> np.ndarray:
    near = inside.copy()
    near[1:] |= inside[:-1] & (chain[1:] == chain[:-1])
    near[:-1] |= inside[1:] & (chain[1:] == chain[:-1])
    return near


def mentions(node: np.ndarray, chain: np.ndarray, word: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Tokens whose word occurs in their document at least twice, once of them where the own score favours a name."""
    able = np.flatnonzero(word >= 0)
    if not len(able):
        return able
    key = chain[able].astype(np.int64) * (int(word.max()) + 1) + word[able]
    own = near[able] & (node[able][:, NAME].max(1) > node[able, 0])
    if not own.any():
        return able[:0]
    values, counts = np.unique(key, return_counts=True)
    return able[np.isin(key, np.intersect1d(key[own], values[counts > 1]))]


def skip_edges(gain: np.ndarray, chain: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the skip edges between mentions (their gain, document and word): each to the one before it and to the best one."""
    order = np.lexsort((np.arange(len(word)), word, chain))
    same = (word[order[1:]] == word[order[:-1]]) & (chain[order[1:]] == chain[order[:-1]])
    group = np.concatenate([[0], np.cumsum(~same)])
    rank = np.lexsort((-gain[order], group))  # per group the best first
    first = np.concatenate([[True], group[rank][1:] != group[rank][:-1]])
    best_at = rank[first]
    hub = best_at[group]
    at = np.arange(len(order))
    far = np.abs(at - hub) > 1
    return np.concatenate([order[:-1][same], order[hub[far]]]), np.concatenate([order[1:][same], order[far]])


class Chains:
    """Runs of active tokens, solved in groups of similar length."""

    def __init__(self, at: np.ndarray, chain: np.ndarray, trans: np.ndarray):
        first = np.ones(len(at), dtype=bool)
        first[1:] = (np.diff(at) > 1) | (chain[at[1:]] != chain[at[:-1]])
        self.trans, self.starts = trans, np.flatnonzero(first)
        self.lengths = np.diff(np.append(self.starts, len(at)))
        self.groups = list(_groups(self.lengths))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Which chains hold some of these tokens."""
        out = np.zeros(len(self.starts), dtype=bool)
        out[np.searchsorted(self.starts, tokens, side="right") - 1] = True
        return out

    def _padded(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.lengths[group]
        steps = np.arange(size.max())[None]
        return self.starts[group][:, None] + np.minimum(steps, size[:, None] - 1), size, steps < size[:, None]

    def beliefs(self, scores: np.ndarray, only: np.ndarray) -> np.ndarray:
        """Log marginals of the labels of every token; 0 in chains that aren't asked for."""
        out = np.zeros_like(scores)
        for g in self.groups:
            g = g[only[g]]
            if len(g):
                where, size, real = self._padded(g)
                f, b, z = marginals(scores[where], self.trans, size)
                out[where[real]] = (f + b - z[:, None, None])[real]
        return out

    def best(self, scores: np.ndarray) -> np.ndarray:
        out = np.zeros(len(scores), dtype=np.int8)
        for g in self.groups:
            where, size, real = self._padded(g)
            out[where[real]] = best(scores[where], self.trans, size)[real]
        return out


def active(node: np.ndarray, trans: np.ndarray, chain: np.ndarray, word: np.ndarray, must: np.ndarray | None, margin: float, linking: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(active tokens, linked mentions, left and right ends of the skip edges); all but the first as places among the active."""
    near = candidates(node, trans, chain, margin, must)
    none = np.zeros(0, dtype=np.int64)
    linked = mentions(node, chain, word, near) if linking else none
    if len(linked):
        more = np.zeros(len(node), dtype=bool)
        more[linked] = True
        near |= _with_neighbours(more, chain)
    at = np.flatnonzero(near)
    if not len(linked):
        return at, none, none, none
    left, right = skip_edges(node[linked][:, NAME].max(1) - node[linked, 0], chain[linked], word[linked])
    place = np.searchsorted(at, linked)
    return at, place, place[left], place[right]


def decode(node: np.ndarray, trans: np.ndarray, chain: np.ndarray, word: np.ndarray, skip: np.ndarray, must: np.ndarray | None = None, margin: float = MARGIN, rounds: int = ROUNDS) -> np.ndarray:
    """Labels of tokens with node scores node[token, label].

    chain: document number of each token (ascending); word: number of a linkable word, -1 where a token takes no
    skip edge; skip: weight of equal kinds at both ends of a skip edge, per kind from 0 for outside; must: tokens that
    are looked at whatever their score.
    """
    labels = np.zeros(len(node), dtype=np.int8)
    if not len(node):
        return labels
    at, _, left, right = active(node, trans, chain, word, must, margin, bool(np.any(skip)))
    if not len(at):
        return labels
    chains = Chains(at, chain, trans)
    scores = node[at].astype(np.float64)
    total = np.zeros_like(scores)
    if len(left):
        src, dst = np.concatenate([left, right]), np.concatenate([right, left])
        half = len(left)
        reverse = np.concatenate([np.arange(half) + half, np.arange(half)])
        message = np.zeros((len(src), N_LABELS))
        agree = np.where(KIND_OF[:, None] == KIND_OF[None, :], np.asarray(skip, dtype=float)[KIND_OF][:, None], 0.0)
        linked = chains.of(src)
        for _ in range(rounds):
            cavity = chains.beliefs(scores + total, linked)[src] - message[reverse]
            new = _lse(cavity[:, :, None] + agree[None], 1)
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - message).max()
            message = new
            total = np.zeros_like(scores)
            np.add.at(total, dst, message)
            if moved < SETTLED:
                break
    labels[at] = chains.best(scores + total)
    return labels


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind number from 1, first token, token after the last) of the labelled runs."""
    out, open_kind, start = [], 0, 0
    for i in np.flatnonzero(labels):
        y = int(labels[i])
        kind = int(KIND_OF[y])
        if open_kind and kind == open_kind and LABELS[y][0] == "I" and i == end:
            end = i + 1
            continue
        if open_kind:
            out.append((open_kind, start, end))
        open_kind, start, end = kind, int(i), int(i) + 1
    if open_kind:
        out.append((open_kind, start, end))
    return out
