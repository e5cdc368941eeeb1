"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks, each coded on its own from a fresh model, so that a block can
be read without its neighbours.  At every id the model mixes three predictions: the id
that last followed the two ids before (order 2), the id that last followed the one
before (order 1), and the ids of the block so far, by classes of their size (order
0).  The weights of the mixture depend on how often the two contexts have been right.
Contexts move with each id; weights and classes move toward what came after 8, 16, 32,
64, 128, 256 and then every 512 ids.  Callers should number ids by falling frequency.  The
mixture gives a hit of a context or a class one interval, by which a range coder
narrows its range; an id's place in its class is stored as plain bits.

All blocks of a segment take each step together, one lane a block, so that a step is a
handful of numpy operations.  Between two moves of the weights the coder knows all ids,
so it takes their intervals at once.  The range is held in doubles, which are exact for
whole numbers below 2**53.  Tables are bounded by lanes times ``_CELLS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

BLOCK_IDS = 4096
MOST_IDS = 1 << 20                     # ids must be below
_CELLS1, _CELLS2 = 1 << 11, 1 << 12    # remembered contexts of a block
_SURE = 2                              # bits of a confidence
_RIGHT = (1 << _SURE) - 1              # most hits running that are told apart
_MIXES = 1 << (2 * _SURE)              # contexts of the weights: two confidences
_MIX, _SHARE = 1 << 12, 1 << 10        # units of the weights, of the classes
_LEAST0, _LEAST = 64, 4                # least weight of order 0, of the others
_SPREAD = 0x9E3779B1
_FADE = 2                              # a move takes 2**-_FADE of the classes' old counts
_FIRST, _MOVE = 8, 512                 # ids before the first move, most ids between two
_STEPS = 64                            # most steps that are worked on at once
_TOP, _LOW, _DIGIT = 2.0 ** 48, 2.0 ** 32, 2.0 ** 16   # a range below _LOW gives out a digit
_TAIL = 3                              # digits that end a block
_UNITS = float(_MIX * _SHARE)


def _size_classes(n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id, first id and width in bits of each class: two classes to a power of two."""
    shifted = np.arange(n_ids, dtype="int64") + 2
    power = np.frexp(shifted)[1].astype("int64") - 1
    of = (power - 1) * 2 + ((shifted >> (power - 1)) & 1)
    number = np.arange(int(of[-1]) + 1)
    bits = number // 2
    return of, ((number % 2 + 2) << bits) - 2, bits


class Model:
    """What predicts the next id of each lane."""

    def __init__(self, lanes: int, n_ids: int):
        if not 0 < n_ids <= MOST_IDS:
            raise ValueError(f"ids must be below {MOST_IDS}")
        self.of, self.first, self.bits = _size_classes(n_ids)
        self.lanes, self.n = lanes, len(self.bits)
        self.cell = np.dtype("uint16" if n_ids << _SURE <= 1 << 16 else "uint32")   # id and confidence
        self.last1 = np.zeros(lanes * _CELLS1, self.cell)
        self.last2 = np.zeros(lanes * _CELLS2, self.cell)
        lane = np.arange(lanes, dtype="int64")
        self.base1, self.base2, self.base, self.base0 = lane * _CELLS1, lane * _CELLS2, lane * _MIXES, lane * self.n
        # a context that has been right s times running starts as one that was right s + 1/2 of s + 2 times
        self.seen = np.full(lanes * _MIXES, 2.0)
        self.won1, self.won2 = np.full(lanes * _MIXES, 0.5), np.full(lanes * _MIXES, 0.5)
        mix = np.tile(np.arange(_MIXES), lanes)
        self.seen += mix >> _SURE
        self.won2 += mix >> _SURE
        self.seen1 = 2.0 + (mix & _RIGHT)
        self.won1 += mix & _RIGHT
        self.counts, self.came = np.full((lanes, self.n), 8, "int64"), np.zeros((lanes, self.n), "int64")
        self._weigh()

    def _weigh(self) -> None:
        """Bounds of both contexts' intervals, weight of order 0, starts and widths of the classes."""
        two = np.floor(self.won2 * _MIX / self.seen)
        two = np.minimum(np.maximum(two, _LEAST), _MIX - 2 * _LEAST0)
        rest = _MIX - two
        one = np.floor(self.won1 * rest / self.seen1)
        one = np.minimum(np.maximum(one, _LEAST), rest - _LEAST0)
        self.part0 = rest - one
        self.bound2, self.bound1 = two * _SHARE, (two + one) * _SHARE
        starts = np.zeros((self.lanes, self.n + 1), "int64")
        np.cumsum(self.counts, axis=1, out=starts[:, 1:])
        starts = starts * (_SHARE - self.n) // starts[:, -1:] + np.arange(self.n + 1)
        widths = np.diff(starts, axis=1)
        self.starts, self.widths = starts[:, :-1].ravel().astype("float64"), widths.ravel().astype("float64")
        self.whole_starts = starts

    def learn(self, ids: np.ndarray, context: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Counts what came in some steps (rows) of all lanes."""
        size = self.lanes * _MIXES
        won2 = np.bincount(context[hit2], minlength=size)
        self.won2 += won2
        self.won1 += np.bincount(context[hit1], minlength=size)
        seen = np.bincount(context.ravel(), minlength=size)
        self.seen += seen
        self.seen1 += seen - won2
        came = self.of.take(ids, mode="clip") + self.base0
        self.came += np.bincount(came.ravel(), minlength=self.lanes * self.n).reshape(self.lanes, self.n)

    def move(self) -> None:
        """Moves weights and classes toward what came."""
        self.counts -= self.counts >> _FADE
        self.counts += self.came << 4
        self.came[:] = 0
        self._weigh()

    def class_of_share(self) -> np.ndarray:
        """Class of each unit of each lane's shares."""
        steps = np.zeros((self.lanes, _SHARE), "uint8")
        steps[np.arange(self.lanes)[:, None], self.whole_starts[:, 1:-1]] = 1
        return np.cumsum(steps, axis=1, dtype="uint8").ravel()


def _spread(ids: np.ndarray) -> np.ndarray:
    return ((ids * _SPREAD) & 0xFFFFFFFF) >> 12


def _moves(top: int) -> Iterator[tuple[int, int, bool]]:
    """Steps that are worked on at once, and whether the weights move after them."""
    at, size = 0, _FIRST
    while at < top:
        end = min(top, at + size)
        for start in range(at, end, _STEPS):
            yield start, min(end, start + _STEPS), start + _STEPS >= end
        at, size = end, min(_MOVE, end)


def _lanes(n: int, block: int) -> np.ndarray:
    """Lengths of the blocks of ``n`` ids; only the last may be shorter."""
    return np.minimum(block, n - np.arange(0, n, block))


def _move_cells(seen: np.ndarray, mark: np.ndarray, nearly: np.ndarray, wrong: np.ndarray, new: np.ndarray) -> None:
    """``new`` becomes the id that came: one surer than ``seen`` where that was right, not sure at all where it was wrong."""
    np.minimum(seen, nearly, out=new)
    np.add(new, 1, out=new)
    np.copyto(new, mark, where=wrong)


def _met(model: Model, now: np.ndarray, at1: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What both contexts hold before each of some steps; they move along."""
    seen1, seen2 = np.empty(now.shape, model.cell), np.empty(now.shape, model.cell)
    marks = now.astype(model.cell) << _SURE
    guess, new, nearly = (np.empty(model.lanes, model.cell) for _ in range(3))
    wrong = np.empty(model.lanes, bool)
    for t, mark in enumerate(marks):
        np.bitwise_or(mark, _RIGHT - 1, out=nearly)
        for last, at, seen in ((model.last1, at1[t], seen1[t]), (model.last2, at2[t], seen2[t])):
            last.take(at, out=seen, mode="clip")
            np.bitwise_xor(seen, mark, out=guess)
            np.greater(guess, _RIGHT, out=wrong)
            _move_cells(seen, mark, nearly, wrong, new)
            last[at] = new
    return seen1, seen2


class _Digits:
    """The range of each lane, and the digits it gave out."""

    def __init__(self, lanes: int, top: int):
        self.low, self.width = np.zeros(lanes), np.full(lanes, _TOP)
        self.room = top + _TAIL + 1
        self.out = np.zeros(lanes * self.room, "int32")
        self.base = np.arange(lanes, dtype="int64") * self.room
        self.at = self.base + 1   # one before takes a carry

    def narrow(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Takes some steps of all lanes."""
        low, width, at, out = self.low, self.width, self.at, self.out
        unit, rest, small = np.empty_like(low), np.empty_like(low), np.empty(len(low), bool)
        for start, size in zip(starts, sizes):
            np.multiply(width, 1 / _UNITS, out=unit)
            np.floor(unit, out=unit)
            np.multiply(unit, start, out=rest)
            np.add(low, rest, out=low)
            np.multiply(unit, size, out=width)
            np.less(width, _LOW, out=small)
            short = np.flatnonzero(small)
            if len(short):
                left, where = low[short], at[short]
                digit = np.floor(left * (1 / _LOW))
                out[where] = digit
                low[short] = (left - digit * _LOW) * _DIGIT
                width[short] *= _DIGIT
                at[short] = where + 1

    def ended(self) -> list[bytes]:
        for _ in range(_TAIL):
            digit = np.floor(self.low / _LOW)
            self.out[self.at] = digit
            self.low = (self.low - digit * _LOW) * _DIGIT
            self.at = self.at + 1
        n, out = self.at - self.base, self.out.reshape(-1, self.room)
        out[-1, n[-1]:] = 0
        for at in range(int(n.max()) - 1, 0, -1):   # carries go up
            out[:, at - 1] += out[:, at] >> 16
            out[:, at] &= 0xFFFF
        return [row[1:k].astype("<u2").tobytes() for row, k in zip(out, n.tolist())]


class _Plain:
    """Bits stored as they are, in words of 32."""

    def __init__(self, lanes: int, most_bits: int):
        self.room = most_bits // 32 + 2
        self.out = np.zeros(lanes * self.room, "uint32")
        self.base = np.arange(lanes, dtype="int64") * self.room
        self.used = np.zeros(lanes, "int64")

    def put(self, values: np.ndarray, bits: np.ndarray) -> None:
        """Takes some steps of all lanes."""
        ends = np.cumsum(bits, axis=0)
        at = ends - bits + (self.used & 31)
        word, values = at >> 5, values << (at & 31)
        each = int(word.max()) + 2
        word += np.arange(len(self.used)) * each
        size = len(self.used) * each
        found = np.bincount(word.ravel(), (values & 0xFFFFFFFF).ravel(), size)
        found += np.bincount((word + 1).ravel(), (values >> 32).ravel(), size)
        where = np.minimum((self.base + (self.used >> 5))[:, None] + np.arange(each), len(self.out) - 1)
        found = found.astype("uint32").reshape(-1, each)
        some = found != 0
        self.out[where[some]] += found[some]
        self.used += ends[-1]

    def ended(self) -> list[bytes]:
        rows = self.out.reshape(-1, self.room)
        return [row[:k].astype("<u4").tobytes() for row, k in zip(rows, (-(-self.used // 32)).tolist())]


def encode(ids: np.ndarray, n_ids: int, block: int = BLOCK_IDS) -> list[bytes]:
    """One payload per block of the ids: length of the plain bits, the bits, digits."""
    lengths = _lanes(len(ids), block)
    model = Model(len(lengths), n_ids)
    if not len(lengths):
        return []
    lanes, top = len(lengths), int(lengths[0])
    grid = np.zeros(lanes * top, model.cell)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, top).T)
    digits, plain = _Digits(lanes, top), _Plain(lanes, top * int(model.bits[-1]))
    before = np.zeros((2, lanes), "int64")
    stop, last = int(lengths[-1]), None
    for start, end, moves in _moves(top):
        now = grid[start:end].astype("int64")
        known = np.concatenate([before, now])
        spread = _spread(known)
        at1 = model.base1 + (known[1:-1] & (_CELLS1 - 1))
        at2 = model.base2 + ((spread[1:-1] ^ (spread[:-2] >> 1)) & (_CELLS2 - 1))
        seen1, seen2 = _met(model, now, at1, at2)
        before = known[-2:]
        guess1, guess2 = seen1 >> _SURE, seen2 >> _SURE
        context = model.base + (((seen2 & _RIGHT) << _SURE) | (seen1 & _RIGHT))
        hit2 = now == guess2
        hit1 = (now == guess1) & ~hit2
        hit = hit1 | hit2
        cls = model.of[now]
        own = model.base0 + cls
        part0, bound2, bound1 = model.part0.take(context), model.bound2.take(context), model.bound1.take(context)
        low = np.where(hit, np.where(hit2, 0.0, bound2), bound1 + part0 * model.starts.take(own))
        size = np.where(hit, np.where(hit2, bound2, bound1 - bound2), part0 * model.widths.take(own))
        bits = np.where(hit, 0, model.bits[cls])
        plain.put(np.where(hit, 0, now - model.first[cls]), bits)
        if start < stop < end:             # the last lane ends within these steps
            digits.narrow(low[:stop - start], size[:stop - start])
            last = digits.low[-1], digits.at[-1]
            digits.narrow(low[stop - start:], size[stop - start:])
        else:
            digits.narrow(low, size)
            if stop == end:
                last = digits.low[-1], digits.at[-1]
        model.learn(now, context, hit2, hit1)
        if moves:
            model.move()
    digits.low[-1], digits.at[-1] = last
    return [len(p).to_bytes(4, "little") + p + d for p, d in zip(plain.ended(), digits.ended())]


def decode(payloads: list[bytes], n: int, n_ids: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ``n`` ids of the blocks of a segment."""
    lengths = _lanes(n, block)
    if not len(lengths):
        return np.zeros(0, "int32")
    lanes, top = len(lengths), int(lengths[0])
    cut = [4 + int.from_bytes(p[:4], "little") for p in payloads]
    raw = np.frombuffer(b"".join([p[4:c] for p, c in zip(payloads, cut)]) + bytes(8), "u1")
    window = np.zeros(len(raw) - 3, "uint32")   # the 32 bits from each byte on
    for k in range(4):
        window |= raw[k:len(window) + k].astype("uint32") << (8 * k)
    bit = np.cumsum([0, *[8 * (c - 4) for c in cut[:-1]]]).astype("int64")
    flat = np.frombuffer(b"".join([p[c:] for p, c in zip(payloads, cut)]) + bytes(2), "<u2")
    at = np.cumsum([0, *[(len(p) - c) // 2 for p, c in zip(payloads[:-1], cut)]]).astype("int64")
    code = (flat[at] * _DIGIT + flat[at + 1]) * _DIGIT + flat[at + 2]
    at += _TAIL
    model, width = Model(lanes, n_ids), np.full(lanes, _TOP)
    # class n stands for a hit
    bits_of, first_of = np.append(model.bits, 0), np.append(model.first, 0)
    mask_of = (1 << bits_of) - 1
    share_base = np.arange(lanes, dtype="int64") * _SHARE
    grid = np.zeros((top, lanes), model.cell)
    at1, at2, place_at, own, bits, word, some, found = (np.empty(lanes, "int64") for _ in range(8))
    unit, place, bound2, bound1, part0, inner, low, size, rest = (np.empty(lanes) for _ in range(9))
    seen1, seen2, guess1, guess2, mark, nearly, new, sureness = (np.empty(lanes, model.cell) for _ in range(8))
    hit, wrong, small = (np.empty(lanes, bool) for _ in range(3))
    cls, plain = np.empty(lanes, "uint8"), np.empty(lanes, "uint32")
    before, spread, spread2 = np.zeros(lanes, model.cell), np.zeros(lanes, "uint32"), np.zeros(lanes, "uint32")
    stop = int(lengths[-1])
    class_of = model.class_of_share()
    contexts, hits2, hits1 = np.empty((_STEPS, lanes), "int64"), np.empty((_STEPS, lanes), bool), np.empty((_STEPS, lanes), bool)
    for start, end, moves in _moves(top):
        for t in range(start, end):
            if t == stop:                  # the last lane has ended: it goes on with noughts
                code[-1], at[-1] = 0, len(flat) - 1
            ids, context, hit2, hit1 = grid[t], contexts[t - start], hits2[t - start], hits1[t - start]
            np.bitwise_and(before, _CELLS1 - 1, out=mark)
            np.add(mark, model.base1, out=at1)
            np.bitwise_xor(spread, spread2, out=spread2)
            np.bitwise_and(spread2, _CELLS2 - 1, out=spread2)
            np.add(spread2, model.base2, out=at2)
            model.last1.take(at1, out=seen1, mode="clip")
            model.last2.take(at2, out=seen2, mode="clip")
            np.right_shift(seen1, _SURE, out=guess1)
            np.right_shift(seen2, _SURE, out=guess2)
            np.bitwise_and(seen2, _RIGHT, out=sureness)
            np.left_shift(sureness, _SURE, out=sureness)
            np.bitwise_and(seen1, _RIGHT, out=mark)
            np.bitwise_or(sureness, mark, out=sureness)
            np.add(sureness, model.base, out=context)
            model.bound2.take(context, out=bound2, mode="clip")
            model.bound1.take(context, out=bound1, mode="clip")
            model.part0.take(context, out=part0, mode="clip")
            np.multiply(width, 1 / _UNITS, out=unit)
            np.floor(unit, out=unit)
            np.divide(code, unit, out=place)
            np.less(place, bound2, out=hit2)
            np.less(place, bound1, out=hit)
            np.greater(hit, hit2, out=hit1)
            np.subtract(place, bound1, out=inner)
            np.divide(inner, part0, out=inner)
            np.copyto(place_at, inner, casting="unsafe")
            np.add(place_at, share_base, out=place_at)
            class_of.take(place_at, out=cls, mode="clip")
            np.add(cls, model.base0, out=own)
            model.starts.take(own, out=low, mode="clip")
            model.widths.take(own, out=size, mode="clip")
            np.multiply(low, part0, out=low)
            np.add(low, bound1, out=low)
            np.multiply(size, part0, out=size)
            right = np.flatnonzero(hit)
            two, edge, guess = hit2[right], bound2[right], np.where(hit2, guess2, guess1)[right]
            low[right] = np.where(two, 0, edge)
            size[right] = np.where(two, edge, bound1[right] - edge)
            cls[right] = model.n
            np.multiply(unit, low, out=rest)
            np.subtract(code, rest, out=code)
            np.multiply(unit, size, out=width)
            np.less(width, _LOW, out=small)
            short = np.flatnonzero(small)
            where = at[short]
            code[short] = code[short] * _DIGIT + flat.take(where, mode="clip")
            width[short] *= _DIGIT
            at[short] = where + 1
            np.right_shift(bit, 3, out=word)
            window.take(word, out=plain, mode="clip")
            np.bitwise_and(bit, 7, out=some)
            np.right_shift(plain, some, out=word)
            np.copyto(own, cls)
            mask_of.take(own, out=some, mode="clip")
            np.bitwise_and(word, some, out=word)
            bits_of.take(own, out=bits, mode="clip")
            np.add(bit, bits, out=bit)
            first_of.take(own, out=found, mode="clip")
            np.add(found, word, out=found)
            np.copyto(ids, found, casting="unsafe")
            ids[right] = guess
            np.left_shift(ids, _SURE, out=mark)
            np.bitwise_or(mark, _RIGHT - 1, out=nearly)
            np.not_equal(guess1, ids, out=wrong)
            _move_cells(seen1, mark, nearly, wrong, new)
            model.last1[at1] = new
            np.not_equal(guess2, ids, out=wrong)
            _move_cells(seen2, mark, nearly, wrong, new)
            model.last2[at2] = new
            before = ids
            np.right_shift(spread, 1, out=spread2)
            np.multiply(ids, _SPREAD, out=spread, dtype="uint32")
            np.right_shift(spread, 12, out=spread)
        model.learn(grid[start:end], contexts[:end - start], hits2[:end - start], hits1[:end - start])
        if moves:
            model.move()
            class_of = model.class_of_share()
    return grid.T.ravel()[:n].astype("<i4")


def checksum(payload: bytes) -> int:
    return zlib.crc32(payload)
