"""Edit distance by bit-parallel rows: held in one integer for a pair, in blocks of 64 for many pairs at once."""

from __future__ import annotations

import numpy as np

#: Pairs taken together, and bytes of their masks at most.
LANES, MASK_BYTES = 2048, 32_000_000
#: Pairs taken together by unlike(), those that share steps with longer ones, least of them, and kinds of letters that it tells apart; the last is none.
WIDE, SHARED, FEW, KINDS = 16_384, 2048, 8, 33
U64 = np.uint64


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _alike(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _differing(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning and end."""
    head = _alike(a, b)
    a, b = a[head:], b[head:]
    tail = _alike(a[::-1], b[::-1])
    return a[: len(a) - tail], b[: len(b) - tail]


def distance(a: str, b: str) -> int:
    """Least number of insertions, deletions and substitutions that turn a into b."""
    a, b = _differing(a, b)
    if not a or not b:
        return len(a) + len(b)
    return _scan(a, b, 1)[-1]


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """distance() of each pair; pairs of like sizes share the steps of the columns."""
    cut = [_differing(a, b) for a, b in zip(left, right)]
    return _taken_together([a for a, _ in cut], [b for _, b in cut])


def within(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's distance is at most its number.

    No beginning of a string is further from the nearest beginning of the other than the whole strings are; for beginnings a few times
    as long as the number, that tells most unlike pairs without a look at the rest.
    """
    cut = [_differing(a, b) for a, b in zip(left, right)]
    left, right = [a for a, _ in cut], [b for _, b in cut]
    head = 2 * most
    out = np.array([abs(len(a) - len(b)) for a, b in cut], np.int64) <= most
    some = np.flatnonzero(out & (head >= 32) & (head * 3 <= 2 * np.array([max(len(a), len(b)) for a, b in cut], np.int64)))
    # beyond head + most, a beginning is further away by its length alone
    out[some] = _taken_together([left[i][: head[i]] for i in some], [right[i][: head[i] + most[i]] for i in some], True) <= most[some]
    some = np.flatnonzero(out)
    out[some] = _taken_together([left[i] for i in some], [right[i] for i in some]) <= most[some]
    return out


def packed(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts, sizes) for unlike(): the strings' letters folded to KINDS - 1 kinds, each string ended by the last kind."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    letters = [np.zeros(0, np.uint8)]
    for some in (strings[at : at + 1000] for at in range(0, len(strings), 1000)):
        letters.append((_codes([s + "\0" for s in some]) % (KINDS - 1)).astype(np.uint8))
    letters = np.concatenate(letters)
    letters[ends] = KINDS - 1
    return letters, ends - sizes, sizes


def _counts_apart(lines: tuple[np.ndarray, np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Letters that one string of a pair has more often than the other, at most: each takes an edit."""
    letters, starts, sizes = lines
    counts, out = np.zeros((len(sizes), KINDS), np.int32), np.zeros(len(left), np.int64)
    for lo in range(0, len(sizes), 1000):
        hi = min(len(sizes), lo + 1000)
        part = letters[starts[lo] : starts[hi - 1] + sizes[hi - 1] + 1]
        counts[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo) * KINDS, sizes[lo:hi] + 1) + part, minlength=(hi - lo) * KINDS).reshape(-1, KINDS)
    for at in range(0, len(left), WIDE):
        more = counts[left[at : at + WIDE]] - counts[right[at : at + WIDE]]
        over = np.maximum(more, 0).sum(axis=1)
        out[at : at + WIDE] = np.maximum(over, over - more.sum(axis=1))
    return out


def unlike(lines: tuple[np.ndarray, np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether pairs of packed() strings are surely further apart than their numbers; others may be too.

    Folded letters are no further apart than the letters, and a beginning of the left string is no further from the nearest
    beginning of the right one than the whole strings are.
    """
    _, _, sizes = lines
    out = _counts_apart(lines, left, right) > most
    for share in (2, 4):  # beginnings of so many times the number: unlike text is further apart than half its length
        todo = np.flatnonzero(~out)
        if share > 2 and 2 * len(todo) > len(out):  # most are alike
            break
        todo = todo[np.lexsort((left[todo], -most[todo]))]
        at = 0
        while at < len(todo):
            # as many as keep the band; few share one of up to twice their own
            size = -most[todo[at:]]
            end = at + max(np.searchsorted(size, size[0] * 0.85, "right"), min(SHARED, np.searchsorted(size, size[0] * 0.5, "right")), 1)
            words = max(1, min(-(-share * int(most[todo[at]]) // 64), -(-int(sizes[left[todo[at:end]]].max()) // 64)))
            part = todo[at : min(end, at + max(1, min(WIDE, MASK_BYTES // (8 * KINDS * words))))]
            if len(part) >= FEW:
                out[part] = _banded(lines, left[part], right[part], most[part], words) > most[part]
            at += len(part)
    return out


def _banded(lines: tuple[np.ndarray, np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
    """Distance of the first 64 * words letters on the left to the nearest beginning on the right; where it is more than most, it may be given as more."""
    letters, starts, sizes = lines
    own, at = np.unique(left, return_inverse=True)
    size = np.minimum(sizes[own], 64 * words)
    masks = np.zeros(words * len(own) * KINDS, U64)
    for lo in range(0, len(own), 1000):
        n = size[lo : lo + 1000]
        row, place = np.repeat(np.arange(lo, lo + len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(masks, (place // 64 * len(own) + row) * KINDS + letters[starts[own[row]] + place], U64(1) << (place % 64).astype(U64))
    masks = masks.reshape(words, len(own), KINDS)
    for w in range(words):  # beyond a string's end stand letters that are like any other
        free = np.flatnonzero(size < 64 * w + 64)
        masks[w, free] |= (~U64(0) << np.maximum(size[free] - 64 * w, 0).astype(U64))[:, None]
    masks = masks.reshape(-1)

    # a cell further than the band from the diagonal is further away than most: word w takes columns first[w] to last[w], column c at step c + w
    lanes, band, one = len(left), int(most.max()), U64(1)
    first, last = [max(0, 64 * w - band) for w in range(words)], [64 * w + 64 + band for w in range(words)]
    base, begin, end, stride = at * KINDS, starts[right], sizes[right], len(own) * KINDS
    up, down = np.full((words, lanes), ~U64(0)), np.zeros((words, lanes), U64)
    rises, falls = np.ones((words + 1, lanes), U64), np.zeros((words + 1, lanes), U64)
    buffers, spots = np.empty((5, words, lanes), U64), np.zeros((words, lanes), np.int64)
    score = np.repeat(64 * np.arange(1, words + 1)[:, None], lanes, axis=1)
    spot, kind, least = np.empty(lanes, np.int64), np.empty(lanes, np.uint8), np.full(lanes, 64 * words + band + 1)
    low = high = 0
    for step in range(last[-1] + words - 1):
        while low < words and step - low >= last[low]:  # a word that has stopped rises with each column, as far as the next one sees
            low += 1
            rises[low], falls[low] = 1, 0
        while high < words and step - high >= first[high]:
            high += 1
        spots[1:] = spots[:-1]
        spots[1:] += stride
        np.minimum(end, step, out=spot)
        spot += begin
        np.take(letters, spot, out=kind, mode="clip")
        np.add(base, kind, out=spots[0])
        p, m, rise, fall = up[low:high], down[low:high], rises[low:high], falls[low:high]
        eq, vertical, same, higher, lower = buffers[:, : high - low]
        np.take(masks, spots[low:high], out=eq, mode="clip")
        np.bitwise_or(eq, m, out=vertical)
        eq |= fall
        np.bitwise_and(eq, p, out=same)
        same += p
        same ^= p
        same |= eq
        np.bitwise_or(same, p, out=higher)
        np.invert(higher, out=higher)
        higher |= m
        np.bitwise_and(p, same, out=lower)
        np.left_shift(higher, one, out=same)
        same |= rise
        np.left_shift(lower, one, out=eq)
        eq |= fall
        np.bitwise_or(vertical, same, out=p)
        np.invert(p, out=p)
        p |= eq
        np.bitwise_and(same, vertical, out=m)
        higher >>= U64(63)
        lower >>= U64(63)
        rises[low + 1 : high + 1], falls[low + 1 : high + 1] = higher, lower
        score[low:high] += higher.view(np.int64)
        score[low:high] -= lower.view(np.int64)
        for w in range(high, min(words, high + 1)):
            if first[w] and step == first[w] + w - 2:  # the word above has come to the column at which this one begins
                score[w] = score[w - 1] + 64
        if high == words:
            np.minimum(least, score[-1], out=least)
    return least


def _taken_together(left: list[str], right: list[str], begins: bool = False) -> np.ndarray:
    """Distances of pairs, or if `begins`, of the left ones to the nearest beginning of the right ones."""
    if not begins:
        left, right = [a if len(a) <= len(b) else b for a, b in zip(left, right)], [b if len(a) <= len(b) else a for a, b in zip(left, right)]
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right)], np.int64).reshape(-1, 2)
    out = sizes[:, 0].copy() if begins else sizes.max(axis=1, initial=0)
    todo = np.flatnonzero(sizes.min(axis=1, initial=1 << 40) > 0)
    like = (4 * np.log2(sizes[todo].max(axis=1, initial=1))).astype(np.int64)
    for k in np.unique(like):
        group = todo[like == k]
        blocks = int(sizes[group, 0].max() + 63) // 64
        lanes = max(1, min(LANES, MASK_BYTES // (blocks * 8 * 64)))
        for part in (group[at : at + lanes] for at in range(0, len(group), lanes)):
            if len(part) < 8 or lanes < 8:  # too few for steps of whole arrays
                each = (_scan(left[i], right[i], 1) for i in part)
                out[part] = [min(len(left[i]), *scores) if begins else scores[-1] for i, scores in zip(part, each)]
            else:
                out[part] = _lanes_at_once([left[i] for i in part], [right[i] for i in part], sizes[part], begins)
    return out


def _codes(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def _lanes_at_once(patterns: list[str], texts: list[str], sizes: np.ndarray, begins: bool) -> np.ndarray:
    lanes, (height, width), each = len(patterns), sizes.max(axis=0), np.arange(len(patterns))
    codes = np.concatenate([_codes(patterns), _codes(texts)])
    held = np.zeros(int(codes.max()) + 1, bool)
    held[codes] = True
    places = (np.cumsum(held) - 1)[codes]
    blocks, kinds = int(height + 63) // 64, int(held.sum()) + 1
    m, n = sizes[:, 0], sizes[:, 1]
    row, at = np.repeat(each, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    masks = np.zeros((blocks, lanes * kinds), U64)
    np.bitwise_or.at(masks, (at // 64, row * kinds + places[: m.sum()]), U64(1) << (at % 64).astype(U64))
    # block w meets column s - w at step s: all blocks take a step together; beyond a text's ends stands a letter that no pattern has
    columns = np.full((width + 2 * blocks, lanes), kinds - 1)
    columns[blocks + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(each, n)] = places[m.sum() :]
    columns += each * kinds
    masks, own = masks.reshape(-1), (np.arange(blocks) * (lanes * kinds))[:, None]

    up, down = np.full((blocks, lanes), ~U64(0)), np.zeros((blocks, lanes), U64)
    rise, fall = np.zeros((blocks, lanes), U64), np.zeros((blocks, lanes), U64)
    rise[0] = 1
    score, least, top, end = m.copy(), m.copy(), ((m - 1) % 64).astype(U64), (m - 1) // 64
    one, last, at = U64(1), U64(63), end * lanes + each
    for step in range(width + blocks - 1):
        eq = masks.take(columns[step + 1 : step + 1 + blocks][::-1] + own)
        vertical = eq | down
        eq |= fall
        same = (((eq & up) + up) ^ up) | eq
        higher, lower = down | ~(same | up), up & same
        live = step - end < n
        score += ((higher.take(at) >> top) & one).astype(np.int64) * live
        score -= ((lower.take(at) >> top) & one).astype(np.int64) * live
        if begins:
            np.minimum(least, score, out=least)
        over, under = higher >> last, lower >> last
        higher, lower = (higher << one) | rise, (lower << one) | fall
        up, down = lower | ~(vertical | higher), higher & vertical
        rise[1:], fall[1:] = over[:-1], under[:-1]
    return least if begins else score


def best_within(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any part of the text, the end of the first such part)."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at + len(pattern)
    scores = _scan(pattern, text, 0)
    least = min(scores)
    return least, scores.index(least)


def _scan(pattern: str, text: str, first: int) -> list[int]:
    """Distances of the pattern to what ends at each place of the text; `first` is 1 if parts must begin at its start."""
    masks, full = _masks(pattern), (1 << len(pattern)) - 1
    top = 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    out = [score]
    for c in text:
        eq = masks.get(c, 0)
        same = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = down | ~(same | up) & full, up & same
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1 | first) & full, fall << 1 & full
        up, down = fall | ~(same | rise) & full, rise & same
        out.append(score)
    return out
