"""Context-tree weighting over bytes in binary decisions, on sorted arrays.

A byte is eight decisions, each under the bits decided before it and the bytes
before the byte. The tree of a decision has a node for each context of 0 to
``DEPTH`` bytes, nearest byte first. A node's estimate is that of Krichevsky and
Trofimov on its two counts; its weighted probability is half the estimate plus
half the product of its children's. Counts do not depend on the order in which
texts came, so a tree is its table of grams, and the probability of the next bit
mixes the estimates of all depths on its path by their posterior weights.

A gram is 64 bits: the nearest context byte first, the seventh last, then the
byte itself. Sorted grams put a context's subtree side by side, so the part of
the tree below ``TOP`` bytes is worked out per subtree, and Spark joins the rest.

Contexts never met have no counts: estimate and weight are one half.
"""

from dataclasses import dataclass

import numpy as np

#: Context bytes, and those of them whose nodes are worked out in Spark.
DEPTH = 7
TOP = 3
START, END = b" ", b"\n"
#: What stands before a text.
PAST = b"\0" * (DEPTH - 1) + START
#: Grams whose trees are worked out at once, if no context of ``TOP`` bytes has more.
PIECE = 1 << 17
#: By k: a gram's byte and the nearest k bytes of its context.
_NEAREST = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) | 255 for k in range(DEPTH + 1)], np.uint64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: the series eight places up, brought back by the recurrence."""
    x = np.asarray(x, float)
    low = np.minimum(x, 8.0)
    steps = np.ones_like(low)
    for k in range(8):
        steps *= low + k
    z = np.where(x < 8, x + 8, x)
    u = 1 / (z * z)
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - u / 1680) * u) * u) / z
    return np.where(x < 8, series - np.log(steps), series)


#: ``log_gamma`` of small counts, and one half or one more.
_HALVES, _WHOLES = log_gamma(np.arange(1 << 12) + 0.5), log_gamma(np.arange(1 << 12) + 1.0)


def _log_gamma_of(counts: np.ndarray, small: np.ndarray, more: float) -> np.ndarray:
    at = counts.astype(np.int64)
    out = small[np.minimum(at, len(small) - 1)]
    if (large := np.flatnonzero(at >= len(small))).size:
        out[large] = log_gamma(counts[large] + more)
    return out


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the estimate of a sequence with these (whole) counts."""
    n = n0 + n1
    own = _log_gamma_of(n0, _HALVES, 0.5) + _log_gamma_of(n1, _HALVES, 0.5) - _log_gamma_of(n, _WHOLES, 1.0) - np.log(np.pi)
    return np.where(n > 0, own, 0.0)


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(log weighted probability, weight of the node's own estimate)``; ``below``: sum over children."""
    own = log_estimate(n0, n1)
    less = np.exp(-np.abs(own - below))
    return np.maximum(own, below) + np.log1p(less) - np.log(2), np.where(own < below, less, 1.0) / (1 + less)


def next_bit(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The estimate of a 1."""
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all bytes of ``words`` and of the blank that closes each, and each word's number of them.

    Contexts run back to the blank before the word. ``END`` alone closes a text.
    """
    closed = [w if w == END else w + START for w in words]
    sizes = np.array([len(w) for w in closed], np.int64)
    return text_grams(b"".join([PAST + w for w in closed]), sizes), sizes


def text_grams(data: bytes, sizes: np.ndarray, across: bool = True) -> np.ndarray:
    """Grams of runs of ``sizes`` bytes, each of which follows the ``DEPTH`` bytes before it (``PAST`` at first).

    Unless contexts run ``across`` words, they stop at the blank before the word.
    """
    raw = np.frombuffer(data, np.uint8)
    # The eight bytes that end at each place, nearest last: turned by one byte they are the gram.
    wide = np.ndarray((max(len(raw) - DEPTH, 0),), "<u8", raw, strides=(1,)) if len(raw) else raw.astype(np.uint64)
    keys = wide << np.uint64(8)
    keys |= wide >> np.uint64(56)
    if not across:
        at = np.arange(len(raw))
        blank = np.concatenate([[-1], np.maximum.accumulate(np.where(raw == START[0], at, -1))[:-1]]) if len(raw) else at
        keys &= _NEAREST[np.minimum(at - blank, DEPTH)[DEPTH:]]
    inside = np.ones(len(raw), bool)
    inside[((np.cumsum(sizes + DEPTH) - sizes - DEPTH)[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[inside[DEPTH:]]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    return runs(np.sort(keys))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted ones, and how often each occurs."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


@dataclass
class _Level:
    """Nodes of one depth and one bit, in order, and the node of each gram of that depth."""

    first: np.ndarray  # a node's first gram
    node: np.ndarray
    name: np.ndarray  # 1 to 255: a one, then the bits decided before
    n0: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray
    weight: np.ndarray


def pieces(keys: np.ndarray) -> list[slice]:
    """Sorted grams in runs of whole contexts of ``TOP`` bytes, which share no node."""
    context = keys >> np.uint64(64 - 8 * TOP)
    opens = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(keys)) if len(keys) else np.zeros(1, np.int64)
    cuts = np.unique(np.concatenate([[0], opens[np.searchsorted(opens, np.arange(PIECE, len(keys), PIECE))], [len(keys)]])).astype(int)
    return [slice(p, q) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]


class Subtree:
    """The nodes from ``TOP`` to ``DEPTH`` bytes of the contexts that ``keys`` (sorted, distinct) hold.

    The trees of the eight bits share no node; they are worked out one after the other.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = [keys]  # by depth, deepest first: context, then byte
        self.counts = [counts.astype(float)]
        self.parent: list[np.ndarray] = []
        for _ in range(DEPTH - TOP):
            short = (self.keys[-1] >> np.uint64(16)) << np.uint64(8) | self.keys[-1] & np.uint64(255)
            own, inverse = np.unique(short, return_inverse=True)
            self.counts.append(np.bincount(inverse, self.counts[-1], len(own)))
            self.keys.append(own)
            self.parent.append(inverse)

    def _levels(self, b: int) -> list[_Level]:
        levels: list[_Level] = []
        for i in range(len(self.keys)):
            levels.append(self._level(i, b, levels[-1] if levels else None))
        return levels

    def _level(self, i: int, b: int, below: _Level | None) -> _Level:
        keys, counts = self.keys[i], self.counts[i]
        prefix = keys >> np.uint64(8 - b)
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(keys) else np.zeros(0, np.int64)
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        bit = ((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(float)
        n1 = np.bincount(node, counts * bit, len(first))
        n0 = np.bincount(node, counts * (1 - bit), len(first))
        name = (prefix[first] & np.uint64((1 << b) - 1) | np.uint64(1 << b)).astype(np.int64)
        if below is None:  # the deepest nodes are leaves
            weighted, weight = log_estimate(n0, n1), np.ones(len(first))
        else:
            under = np.bincount(node[self.parent[i - 1][below.first]], below.weighted, len(first))
            weighted, weight = weigh(n0, n1, under)
        return _Level(first, node, name, n0, n1, weighted, weight)

    def top(self) -> dict[str, np.ndarray]:
        """What the nodes of ``TOP`` bytes hand up: context, name, counts, weighted probability."""
        found = [self._levels(b)[-1] for b in range(8)]
        context = (self.keys[-1] >> np.uint64(8)).astype(np.int64)
        return {"ctx": np.concatenate([context[x.first] for x in found]), "node": np.concatenate([x.name for x in found]),
                "n0": np.concatenate([x.n0 for x in found]), "n1": np.concatenate([x.n1 for x in found]),
                "weighted": np.concatenate([x.weighted for x in found])}

    def log10(self, names: np.ndarray, fixed: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Log probability of each gram's byte in its context.

        What lies above is handed down for each node of ``TOP`` bytes (``names``: context,
        then node, sorted): the probability of a 1 is ``fixed`` plus ``share`` times what the node says.
        """
        out = np.ones(len(self.keys[0]))
        for b in range(8):
            levels = self._levels(b)
            level = levels[-1]
            at = np.searchsorted(names, (self.keys[-1][level.first] >> np.uint64(8)).astype(np.int64) << 8 | level.name)
            a, s = fixed[at], share[at]
            for i in range(len(levels) - 2, -1, -1):
                child = levels[i]
                up = level.node[self.parent[i][child.first]]
                a, s = (a + s * level.weight * next_bit(level.n0, level.n1))[up], (s * (1 - level.weight))[up]
                level = child
            one = (a + s * next_bit(level.n0, level.n1))[level.node]
            bit = (self.keys[0] >> np.uint64(7 - b)) & np.uint64(1)
            out *= np.where(bit == 1, one, 1 - one)
        return np.log10(out)
