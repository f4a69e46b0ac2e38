"""A bidirectional FM-index over a delimited vocabulary, many searches at a time in numpy.

The words stand sorted, each before a delimiter, in a circle: ``one$three$two$``.  The
k-th suffix that starts with a delimiter is the one before the k-th word.  A search state is a pair of suffix-rank
intervals of equal size, one over this text and one over the text of the reversed
words: a step to the left narrows the first by the Burrows-Wheeler transform of the
text and moves the second by the number of smaller symbols met, a step to the right
does the same the other way round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DELIMITER = 0
BLOCK = 32
# States whose symbols are counted, and interval members that are looked at, in one go.
AT_ONCE = 1 << 18


def _text(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix starts in order, compared up to their next delimiter and then by the word behind it.

    Prefixes of doubling length are ranked until all suffixes have met their delimiter.
    """
    n = len(text)
    ends = np.flatnonzero(text == DELIMITER)
    # Words are sorted, and behind the last one the first one follows.
    places = np.roll(np.arange(n), n - 1 - ends[-2] if len(ends) > 1 else 0)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    rank = text.astype(np.int64)
    width = 1
    while True:
        # Past the delimiter nothing counts; there the second half is empty.
        second = np.zeros(n, np.int64)
        more = np.flatnonzero(to_end >= width)
        second[more] = rank[more + width] + 1
        key = rank * (n + 257) + second
        order = places[np.argsort(key[places], kind="stable")]
        width *= 2
        if width > to_end.max(initial=0):
            return order
        fresh = np.zeros(n, np.int64)
        fresh[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)


class Transform:
    """Counts over the Burrows-Wheeler transform of one text; symbols are places in the index's alphabet."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        bwt = text[suffix_order(text) - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
        padded = np.full(-(-n // BLOCK) * BLOCK + BLOCK, 255, np.uint8)
        padded[:n] = bwt
        self.blocks = padded.reshape(-1, BLOCK)
        # smaller[b, c]: symbols below c in the blocks before b.
        counts = np.zeros((len(self.blocks) + 1, symbols + 1), np.int32)
        np.add.at(counts, (np.arange(n) // BLOCK + 1, bwt.astype(np.int64) + 1), 1)
        self.smaller = np.cumsum(np.cumsum(counts, 0, dtype=np.int32), 1, dtype=np.int32)
        self.bwt = bwt

    def below(self, symbol: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first ``end`` symbols are below each ``symbol``, and how many equal it."""
        block, inside = np.divmod(end, BLOCK)
        less, same = self.smaller[block, symbol], self.smaller[block, symbol + 1]
        same = same - less
        for k in range(0, len(end), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            met = self.blocks[block[part]]
            here = np.arange(BLOCK, dtype=np.uint8) < inside[part, None].astype(np.uint8)
            one = symbol[part, None].astype(np.uint8)
            less[part] += ((met < one) & here).sum(1, dtype=np.int32)
            same[part] += ((met == one) & here).sum(1, dtype=np.int32)
        return less.astype(np.int64), same.astype(np.int64)


@dataclass
class States:
    """Intervals of equal size: ``near`` in the text that a search extends, ``far`` in the other one."""

    near: np.ndarray
    far: np.ndarray
    size: np.ndarray

    def __getitem__(self, at) -> States:
        return States(self.near[at], self.far[at], self.size[at])

    @staticmethod
    def join(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("near", "far", "size")))


class BidirectionalIndex:
    """``words`` are different, sorted byte strings without byte 0."""

    def __init__(self, words: list[bytes]):
        joined = _text(words)
        alphabet = np.unique(joined)
        self.code = np.full(256, 255, np.uint8)
        self.code[alphabet] = np.arange(len(alphabet))
        self.symbols = len(alphabet)
        self.words = len(words)
        self.left = Transform(self.code[joined], self.symbols)
        self.right = Transform(self.code[_text(sorted(w[::-1] for w in words))], self.symbols)

    def start(self, n: int) -> States:
        """The delimiter in both texts, as the start of ``n`` searches."""
        zero = np.zeros(n, np.int64)
        return States(zero, zero.copy(), np.full(n, self.words, np.int64))

    def step(self, side: Transform, states: States, symbol: np.ndarray) -> States:
        """Each state extended by its symbol; unknown symbols (255) leave nothing."""
        known = symbol < self.symbols
        c = np.where(known, symbol, 0).astype(np.int64)
        less, before = side.below(c, states.near)
        less_end, before_end = side.below(c, states.near + states.size)
        size = np.where(known, before_end - before, 0)
        return States(side.first[c] + before, states.far + less_end - less, size)

    def branches(self, side: Transform, states: States) -> tuple[np.ndarray, np.ndarray, States]:
        """``(state, symbol, extended)`` for every symbol but the delimiter that can follow a state."""
        found = []
        wide = states.size > 2 * self.symbols
        few, many = np.flatnonzero(~wide & (states.size > 0)), np.flatnonzero(wide)
        # Small intervals are read member by member, in portions of bounded size.
        cuts = np.searchsorted(np.cumsum(states.size[few]), np.arange(0, states.size[few].sum() + 1, AT_ONCE))
        for a, b in zip(cuts, [*cuts[1:], len(few)]):
            mine = few[a:b]
            size = states.size[mine]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            met = side.bwt[np.repeat(states.near[mine], size) + inside].astype(np.int64)
            key = np.unique(np.repeat(mine, size) * 256 + met)
            found.append((key[key % 256 != DELIMITER] // 256, key[key % 256 != DELIMITER] % 256))
        portion = max(1, AT_ONCE // self.symbols)
        for k in range(0, len(many), portion):
            mine = many[k:k + portion]
            found.append((np.repeat(mine, self.symbols - 1), np.tile(np.arange(1, self.symbols), len(mine))))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, States(none, none, none)
        at = np.concatenate([f[0] for f in found])
        symbol = np.concatenate([f[1] for f in found])
        after = self.step(side, states[at], symbol)
        real = after.size > 0
        return at[real], symbol[real], after[real]

    def one_error(self, queries: list[bytes], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)``: words at edit distance one whose error lies in a query's second half.

        The first half, floor(length / 2) symbols, is matched exactly from the word's
        start, then the interval is extended to the right across the other half with one
        symbol inserted, deleted or replaced.  ``backwards`` does the mirror image: the
        last ceil(length / 2) symbols from the word's end, then to the left.
        """
        side = self.left if backwards else self.right
        lengths = np.array([len(q) for q in queries], np.int64)
        if not len(lengths) or not self.words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whole = self.code[np.frombuffer(b"".join(queries), np.uint8)]
        start = np.cumsum(lengths) - lengths

        def symbol(query: np.ndarray, place: np.ndarray) -> np.ndarray:
            """The symbol at a place of a query as it is read, the delimiter at its end."""
            inside = place < lengths[query]
            at = np.where(inside, place, 0)
            at = lengths[query] - 1 - at if backwards else at
            return np.where(inside, whole[np.minimum(start[query] + at, len(whole) - 1)], DELIMITER)

        half = -(-lengths // 2) if backwards else lengths // 2
        query = np.arange(len(queries))
        states = self.start(len(queries))
        for place in range(int(half.max())):
            going = place < half[query]
            moved = self.step(side, states[going], symbol(query[going], np.full(going.sum(), place)))
            states = States.join([states[~going], moved])
            query = np.concatenate([query[~going], query[going]])
            query, states = query[states.size > 0], states[states.size > 0]
        place = half[query]
        found = []
        while len(query):
            born = self._errors(side, query, place, states, symbol, lengths)
            found.append(self._rest(side, *born, symbol, lengths))
            going = place < lengths[query]
            query, place, states = query[going], place[going], states[going]
            states = self.step(side, states, symbol(query, place))
            alive = states.size > 0
            query, place, states = query[alive], place[alive] + 1, states[alive]
        asked = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        word = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        pairs = np.unique(asked * self.words + word) if len(asked) else asked
        return pairs // self.words, pairs % self.words

    def _errors(self, side: Transform, query, place, states: States, symbol, lengths):
        """Searches that spend their error at ``place``."""
        open_ = place < lengths[query]
        due = symbol(query, place)
        at, met, after = self.branches(side, states)
        other = met != due[at]
        at, after = at[other], after[other]
        replaced = open_[at]
        return (
            np.concatenate([query[open_], query[at], query[at[replaced]]]),
            np.concatenate([place[open_] + 1, place[at], place[at[replaced]] + 1]),
            States.join([states[open_], after, after[replaced]]),
        )

    def _rest(self, side: Transform, query, place, states: States, symbol, lengths):
        """Exact steps to the delimiter; ``(query, word)`` of what gets there."""
        asked, words = [], []
        while len(query):
            last = place == lengths[query]
            states = self.step(side, states, symbol(query, place))
            alive = states.size > 0
            done = alive & last
            # The delimiter before the word is in the far text of a search to the right, else in the near one.
            asked.append(query[done])
            words.append((states.near if side is self.left else states.far)[done])
            going = alive & ~last
            query, place, states = query[going], place[going] + 1, states[going]
        empty = np.empty(0, np.int64)
        return (np.concatenate(asked) if asked else empty), (np.concatenate(words) if words else empty)
