"""BPE of many texts at a time: pieces are found by operations on whole arrays of bytes and looked up in a table of pieces seen before.

Characters are letters, numbers, blanks or others; where a piece begins follows from a character's class, its neighbours',
and, in runs of blanks, from the place of the last line end; with letter case, from the runs of upper and lower case, too. A piece of up to LONGEST bytes is three 64-bit words, compared in full, so the table is exact. Pieces that
it lacks are encoded once each by tiktoken, in one call, with an expression that cannot backtrack; longer ones are encoded each time. A table of MOST pieces is begun anew.

A text longer than CHUNK is worked on in parts, cut between a letter or number and a blank, where every grammar ends a piece and begins the next without regard to what stands before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from tokloom.functions.unicode import members
from tokloom.operators.bpe import encode_piece

#: Bytes of text that are worked on at a time; a longer text is cut.
CHUNK = 1 << 18
LONGEST, MOST = 23, 1 << 19
#: Pieces that are looked up at a time; at most MOST.
BLOCK = 1 << 17
LETTER, NUMBER, BLANK, OTHER, LINE_END, SPACE, QUOTE = (1 << k for k in range(7))
_BLANKS = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What ends a piece in a call to tiktoken; pieces that hold it are encoded one by one.
MARK = 1
#: Letter case, in a table of its own: a letter or mark that may stand among upper case, among lower case; a mark; a slash.
UPPER, LOWER, COMBINING, SLASH = (1 << k for k in range(4))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Of a piece of n bytes, the bits that are its own in the words at 0, 8 and 16, and n.
_MASKS = np.array([[(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(LONGEST + 1)] for at in (0, 8, 16)], np.uint64)


def _ranges(name: str) -> list[tuple[int, int]]:
    """The runs of code points of a class, ends excluded."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = 0xE000 - 0xD800
    return [tuple(x if x < 0xD800 else x + shift for x in (m.start(), m.end() - 1)) for m in regex.finditer(f"[{_escaped(members(name))}]+", every)]


@cache
def classes() -> np.ndarray:
    """The class of every code point, in bits."""
    table = np.full(0x110000, OTHER, np.uint8)
    for name, bit in (("letter", LETTER), ("number", NUMBER)):
        for a, b in _ranges(name):
            table[a : b + 1] = bit
    table[list(_BLANKS)] = BLANK
    table[[10, 13]] |= LINE_END
    table[32] |= SPACE
    table[39] |= QUOTE
    return table


@cache
def cases() -> np.ndarray:
    """The letter case of every code point, in bits."""
    table = np.zeros(0x110000, np.uint8)
    for name, bit in (("upper", UPPER), ("lower", LOWER)):
        for a, b in _ranges(name):
            table[a : b + 1] |= bit
    table[(table != 0) & (classes() & LETTER == 0)] |= COMBINING
    table[ord("/")] = SLASH
    return table


def _escaped(inside: str) -> str:
    import re

    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), inside)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string array; a null is as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def characters(raw: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray | None, ...]:
    """(first byte of each character, or None if each is one byte; class of each; entry of each in each of the tables ``more``)."""
    tables = (classes(), *more)
    if not len(raw) or raw.max() < 0x80:
        return None, *(t[:256].take(raw) for t in tables)
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    b = raw.take(first)
    high = np.flatnonzero(b >= 0x80)
    at, lead, end = first[high], b[high].astype(np.int32), len(raw) - 1
    x, y, z = ((raw[np.minimum(at + k, end)] & 0x3F).astype(np.int32) for k in (1, 2, 3))
    two, three, four = (lead & 31) << 6 | x, (lead & 15) << 12 | x << 6 | y, (lead & 7) << 18 | x << 12 | y << 6 | z
    code, out = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), []
    for t in tables:
        found = t[:256].take(b)
        found[high] = t.take(code, mode="clip")
        out.append(found)
    return first, *out


def moved(x: np.ndarray, by: int, none: np.ndarray) -> np.ndarray:
    """What stands one place before (1) or after (-1) each place; 0 at the places ``none``."""
    out = np.zeros_like(x)
    if by > 0:
        out[1:] = x[:-1]
    else:
        out[:-1] = x[1:]
    out[none] = 0
    return out


def _digits(cut: np.ndarray, c: np.ndarray, before: np.ndarray, most: int) -> None:
    """Cut runs of numbers after every ``most`` of them."""
    if len(many := np.flatnonzero(c & before & NUMBER)):
        number = np.flatnonzero(c & NUMBER)
        new = before[number] & NUMBER == 0
        cut[many] = ((number - number[new][np.cumsum(new) - 1]) % most == 0)[~new]


def _blank_runs(cut: np.ndarray, c: np.ndarray, before: np.ndarray, after: np.ndarray, owners: int) -> None:
    """Cut runs of two blanks or more; line ends right after a character of a class of ``owners`` belong to it."""
    blank, was, will = (x & BLANK != 0 for x in (c, before, after))
    if len(s := np.flatnonzero(blank & ~was & will)):
        e = np.flatnonzero(blank & was & ~will) + 1
        size = e - s
        offsets = np.cumsum(size) - size
        i = np.repeat(s - offsets, size) + np.arange(size.sum())
        line = c[i] & LINE_END != 0
        past = np.maximum.reduceat(np.where(line, i + 1, 0), offsets)  # the last line end
        a = np.where(before[s] & owners, np.minimum(np.minimum.reduceat(np.where(line, len(c), i), offsets), e), s)
        rest = np.maximum(past, a)
        cut[a[a < e]] = True
        left = rest < e
        cut[rest[left]] = True
        cut[(e - 1)[left & (after[e - 1] != 0)]] = True


def _contraction(raw: np.ndarray, byte: np.ndarray | None, quote: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Letters of the contraction after each quote, 0 where there is none; a letter follows each quote."""
    p = quote if byte is None else byte[quote]
    x, y = raw[p + 1] | 0x20, raw[np.minimum(p + 2, len(raw) - 1)] | 0x20
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & (after[quote + 1] & LETTER != 0)
    return np.where(one, 1, np.where(two, 2, 0))


def pieces_cased(raw: np.ndarray, at: np.ndarray, slow: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The same by the case-aware grammar. Texts with combining marks, which are others or letters as their neighbours say, are cut by ``slow``."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    byte, c, k = characters(raw, cases())
    n = len(c)
    edge = at if byte is None else np.searchsorted(byte, at)
    some = np.diff(edge) > 0
    begins, ends = edge[:-1][some], edge[1:][some] - 1
    before, after = moved(c, 1, begins), moved(c, -1, ends)
    marked = np.unique(np.searchsorted(edge, np.flatnonzero(k & COMBINING), "right") - 1) if byte is not None else np.zeros(0, np.int64)
    attached = np.zeros(n, bool)  # what goes with the piece before it; the next character begins as a text does

    # line ends after others, and line ends and slashes after these
    z = np.flatnonzero((c & LINE_END != 0) | (k & SLASH != 0))
    line = c[z] & LINE_END != 0
    if line.any():
        begin = np.zeros(n, bool)
        begin[begins] = True
        first = np.flatnonzero(np.r_[True, z[1:] != z[:-1] + 1] | begin[z])
        run = np.cumsum(np.bincount(first, minlength=len(z))) - 1
        slash = np.minimum.reduceat(np.where(line, n, z), first)
        root = np.where(before[z[first]] & OTHER != 0, -1, slash)
        tail = np.minimum.reduceat(np.where(line & (z > root[run]), z, n), first)
        attached[z[z >= tail[run]]] = True
    # contractions after letters; of those that follow each other at once every second is none
    quote = np.flatnonzero((c & QUOTE != 0) & (before & LETTER != 0) & (after & LETTER != 0))
    if len(quote):
        letters = _contraction(raw, byte, quote, after)
        quote, letters = quote[letters > 0], letters[letters > 0]
        chain = np.r_[True, quote[1:] != (quote + letters)[:-1] + 1][: len(quote)]
        nth = np.arange(len(quote)) - np.flatnonzero(chain)[np.cumsum(chain) - 1]
        quote, letters = quote[nth % 2 == 0], letters[nth % 2 == 0]
        for j in range(3):
            attached[(quote + j)[letters >= j]] = True
    if attached.any():
        c[attached], k[attached] = 0, 0
        before, after = moved(c, 1, begins), moved(c, -1, ends)

    other = (c & OTHER != 0) & (before & (OTHER | SPACE) == 0)
    leads = moved(other | (c & (BLANK | LINE_END) == BLANK), 1, begins)
    letter, was_letter = c & LETTER != 0, before & LETTER != 0
    cut = other | (letter & ~was_letter & ~leads) | (c & NUMBER > before & NUMBER) | ((c & BLANK != 0) & ((before | after) & BLANK == 0))
    # upper case begins a piece after lower case
    k &= UPPER | LOWER
    k[~letter] = 0
    was = moved(k, 1, begins)
    upper = k == UPPER
    cut |= upper & (was == LOWER)
    both = np.flatnonzero(upper & (was == UPPER | LOWER))
    if len(both):  # and after letters of both cases, if lower case was before them or nothing but upper case is left
        place = np.arange(n)
        stop = k != UPPER | LOWER
        stop[begins] = True
        last = np.maximum.accumulate(np.where(stop, place, -1))
        end = ~upper
        end[begins] = True
        after_end = np.r_[np.minimum.accumulate(np.where(end, place, n)[::-1])[::-1], n]
        e = after_end[both + 1]
        start = np.zeros(n + 1, bool)
        start[begins], start[n] = True, True
        done = start[e] | (np.r_[k, 0][e] == 0)
        cut[both[(k[last[both - 1]] == LOWER) | done]] = True
    _digits(cut, c, before, 3)
    _blank_runs(cut, c, before, after, 0)

    start = np.flatnonzero(cut)
    if byte is not None:
        start = byte.take(start)
    for t in marked:
        sizes = [len(p.encode()) for p in slow(raw[at[t] : at[t + 1]].tobytes().decode())]
        low, high = np.searchsorted(start, at[t : t + 2])
        start = np.r_[start[:low], at[t] + np.cumsum([0, *sizes[:-1]]), start[high:]]
    return start, np.searchsorted(start, at)


def _safe_place(raw: np.ndarray, low: int, high: int) -> int:
    """The first byte from ``low`` on, in a text that ends at ``high``, at which it may be cut; ``high`` if there is none."""
    size = 1 << 12
    while low < high:
        while low < high and raw[low] & 0xC0 == 0x80:
            low += 1
        end = min(low + size, high)
        while end < high and raw[end] & 0xC0 == 0x80:
            end += 1
        byte, c = characters(raw[low:end])
        hit = np.flatnonzero((c[:-1] & (LETTER | NUMBER) != 0) & (c[1:] & BLANK != 0))
        if len(hit):
            return low + int(hit[0] + 1 if byte is None else byte[hit[0] + 1])
        # the last character is looked at again, as the first of the next part
        low, size = end if end == high else end - 1, size * 2
        while low > 0 and low < high and raw[low] & 0xC0 == 0x80:
            low -= 1
    return high


def segments(raw: np.ndarray, at: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets with the places, too, where texts longer than ``room`` are cut; which of them are those of ``at``)."""
    long = np.flatnonzero(np.diff(at) > room)
    where, place = [], []
    for t in long:
        low, high = int(at[t]), int(at[t + 1])
        while high - low > room and (low := _safe_place(raw, low + room, high)) < high:
            where.append(t + 1)
            place.append(low)
    if not where:
        return at, np.arange(len(at))
    return np.insert(at, where, place), np.arange(len(at)) + np.searchsorted(where, np.arange(len(at)), "right")


def pieces(raw: np.ndarray, at: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece, pieces before each text) of the texts between the offsets ``at``; ``digits`` is the most of them in a piece."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    byte, c = characters(raw)
    edge = at if byte is None else np.searchsorted(byte, at)
    some = np.diff(edge) > 0
    begins, ends = edge[:-1][some], edge[1:][some] - 1
    before, after = moved(c, 1, begins), moved(c, -1, ends)
    # an unattached other: a space before it belongs to it, and it leads the letters after it if it is alone
    other = (c & OTHER != 0) & (before & (OTHER | SPACE) == 0)
    leads = moved(other | (c & (BLANK | LINE_END) == BLANK), 1, begins)
    alone = (c & BLANK != 0) & ((before | after) & BLANK == 0)
    cut = other | ((c & LETTER > before & LETTER) & ~leads) | (c & NUMBER > before & NUMBER) | (alone & ~((c & LINE_END != 0) & (before & OTHER != 0)))

    _digits(cut, c, before, digits)
    _blank_runs(cut, c, before, after, OTHER)

    quote = np.flatnonzero((c & QUOTE != 0) & other & (after & LETTER != 0))
    if len(quote):
        letters = _contraction(raw, byte, quote, after)
        last = (quote + letters)[letters > 0]
        cut[(last + 1)[after[last] & LETTER != 0]] = True

    start = np.flatnonzero(cut)
    if byte is not None:
        start = byte.take(start)
    return start, np.searchsorted(start, at)


class Encoder:
    """Encodes texts given as Arrow arrays; it keeps what it has seen."""

    def __init__(self, ranks: dict[bytes, int], split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        """``split``: from bytes and offsets of texts to the first byte of each piece and the pieces before each text."""
        import tiktoken

        self.split, self.ranks = split, ranks
        self.marked = tiktoken.Encoding("pieces", pat_str=r"[^\x01]+|\x01", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.mark_id = ranks[bytes([MARK])]
        classes()
        self.clear()

    def clear(self) -> None:
        self.bits = MOST.bit_length()
        self.words = np.zeros((1 << self.bits, 3), np.uint64)
        self.value = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.at, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def _encoded(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, number of each)."""
        whole = size + 1
        begin = np.cumsum(whole) - whole
        text = np.repeat(start - begin, whole) + np.arange(int(whole.sum()))
        text = raw.take(text, mode="clip")
        text[begin + size] = MARK
        if len(held := np.flatnonzero(text == MARK)) > len(size):
            piece = np.searchsorted(begin, held, "right") - 1
            bad = np.unique(piece[held != (begin + size)[piece]])
            good = np.setdiff1d(np.arange(len(size)), bad)
            ids, n = self._encoded(raw, start[good], size[good])
            odd = [encode_piece(raw[s : s + m].tobytes(), self.ranks) for s, m in zip(start[bad], size[bad], strict=True)]
            count = np.zeros(len(size), np.int64)
            count[good], count[bad] = n, [len(x) for x in odd]
            low, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.int32)
            out[np.repeat(low[good] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
            for a, x in zip(low[bad], odd, strict=True):
                out[a : a + len(x)] = x
            return out, count
        ids = np.array(self.marked(text.tobytes().decode()), np.int32)
        marks = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, marks), np.diff(np.r_[-1, marks]) - 1

    def _store(self, ids: np.ndarray, count: np.ndarray, keep: int) -> None:
        """Put pieces after those that are kept, and keep the first ``keep`` of them."""
        low, k = int(self.at[self.n]), self.n
        while len(self.at) <= k + len(count) + 1:
            self.at = np.r_[self.at, np.zeros_like(self.at)]
        while len(self.ids) < low + len(ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[low : low + len(ids)] = ids
        self.at[k + 1 : k + 1 + len(count)] = low + np.cumsum(count)
        self.n += keep

    def _seen(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number under which each piece is stored."""
        if self.n + len(start) > MOST:
            self.clear()
        wide = np.zeros((len(raw) + 7) // 8 + 4, np.uint64)
        wide.view(np.uint8)[: len(raw)] = raw
        word, shift = start >> 3, (start & 7).astype(np.uint64) << np.uint64(3)
        load, short = [wide.take(word + k) for k in range(4)], np.minimum(size, LONGEST)
        w = [(load[k] >> shift | (load[k + 1] << np.uint64(1)) << (np.uint64(63) - shift)) & _MASKS[k].take(short) for k in range(3)]
        w[2] |= size.astype(np.uint64) << np.uint64(56)
        h = w[0] * _A ^ w[1] * _B ^ w[2] * _C
        h = (h ^ h >> np.uint64(32)) * _A
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        value, todo, s, last = np.full(len(start), -1, np.int64), np.flatnonzero(size <= LONGEST), slot, (1 << self.bits) - 1
        s = slot[todo]
        while len(todo):
            t = self.words.take(s, axis=0)
            hit = (t[:, 0] == w[0].take(todo)) & (t[:, 1] == w[1].take(todo)) & (t[:, 2] == w[2].take(todo))
            value[todo[hit]] = self.value.take(s[hit])
            on = ~hit & (t[:, 2] != 0)
            todo, s = todo[on], (s[on] + 1) & last
        if len(new := np.flatnonzero(value < 0)):
            _, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            fit = size[new[first]] <= LONGEST
            same = (size[new] <= LONGEST) & fit[of] & np.logical_and.reduce([x[new] == x[new[first]][of] for x in w])
            one, apart = new[first[fit]], new[~same]  # to be kept, and longer ones (or such as share a hash) for this call alone
            number = np.cumsum(fit) - 1
            value[new[same]] = self.n + number[of[same]]
            value[apart] = self.n + len(one) + np.arange(len(apart))
            every = np.r_[one, apart]
            base = self.n
            self._store(*self._encoded(raw, start[every], size[every]), len(one))
            left, s = np.arange(len(one)), slot[one]
            while len(left):
                free = self.words[s, 2] == 0
                _, k = np.unique(s[free], return_index=True)
                put = np.flatnonzero(free)[k]
                self.words[s[put]] = np.stack([x[one[left[put]]] for x in w], axis=1)
                self.value[s[put]] = base + left[put]
                stay = np.ones(len(left), bool)
                stay[put] = False
                left, s = left[stay], (s[stay] + 1) & last
        return value

    def _chunks(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """(blocks of pieces, pieces before each segment) of runs of whole segments."""
        first = 0
        while first < len(at) - 1:
            end = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
            part, offsets = raw[at[first] : at[end]], at[first : end + 1] - at[first]
            start, before = self.split(part, offsets)
            yield self._blocks(part, start), before
            first = end

    def _blocks(self, raw: np.ndarray, start: np.ndarray):
        """(place of the ids, number of ids) of each piece; the places hold until the next block."""
        for a in range(0, len(start), BLOCK):
            some, end = start[a : a + BLOCK], start[a + BLOCK] if a + BLOCK < len(start) else len(raw)
            value = self._seen(raw[some[0] : end], some - some[0], np.diff(np.r_[some, end]))
            low = self.at.take(value)
            yield low, self.at.take(value + 1) - low

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, n + 1 offsets into them)."""
        out, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        at, own = segments(raw, at, CHUNK)
        for blocks, before in self._chunks(raw, at):
            counts = [np.zeros(1, np.int64)]
            for low, count in blocks:
                out.append(self._gathered(low, count))
                counts.append(count)
            sizes.append(np.diff(np.cumsum(np.concatenate(counts))[before]))
        return np.concatenate(out), np.cumsum(np.concatenate(sizes))[own]

    def encode_whole(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts each of which is one piece."""
        some = np.diff(at) > 0
        out, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for low, count in self._blocks(raw, at[:-1][some]):
            out.append(self._gathered(low, count))
            counts.append(count)
        return np.concatenate(out), np.cumsum(np.concatenate(counts))[np.r_[0, np.cumsum(some)]]

    def _gathered(self, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = np.cumsum(count)
        return self.ids.take(np.repeat(low - total + count, count) + np.arange(total[-1]))

    def count(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        sizes = [np.zeros(1, np.int64)]
        at, own = segments(raw, at, CHUNK)
        for blocks, before in self._chunks(raw, at):
            counts = [np.zeros(1, np.int64), *(count for _, count in blocks)]
            sizes.append(np.diff(np.cumsum(np.concatenate(counts))[before]))
        return np.diff(np.cumsum(np.concatenate(sizes))[own])


class Decoder:
    """Bytes of many lists of ids at a time."""

    def __init__(self, by_id: dict[int, bytes]):
        ids, tokens = np.array(list(by_id), np.int64), list(by_id.values())
        size = np.array([len(t) for t in tokens], np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.low, self.size = np.zeros(ids.max() + 1, np.int64), np.full(ids.max() + 1, -1, np.int64)
        self.low[ids], self.size[ids] = np.cumsum(size) - size, size

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all lists, n + 1 offsets into them, which lists hold an unknown id, the first such of each of these); such a list has no bytes."""
        inside = (ids >= 0) & (ids < len(self.size))
        known = np.where(inside, ids, 0)
        size = np.where(inside, self.size.take(known), -1)
        bad = np.flatnonzero(size < 0)
        row, first = np.unique(np.searchsorted(at, bad, "right") - 1, return_index=True)
        wrong = np.zeros(len(at) - 1, bool)
        wrong[row] = True
        if len(bad):
            size[np.repeat(wrong, np.diff(at))] = 0
        total = np.r_[0, np.cumsum(size)]
        data = self.data.take(np.repeat(self.low.take(known) - total[:-1], size) + np.arange(total[-1]))
        return data, total[at], wrong, ids[bad[first]]
