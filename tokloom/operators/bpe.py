"""Byte-pair encoding of one piece by merge rank, and the vocabulary's own structure."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

#: Pieces of up to so many bytes are merged by plain scans, longer ones by a heap.
SHORT = 48


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A byte, or a piece that is itself a token, is one id. Else the adjacent pair whose joined bytes have the least rank is merged, the leftmost
    among equals, until no pair has a rank."""
    if not piece:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return (_scan if len(piece) <= SHORT else _heap)(piece, ranks)


def _scan(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    get = ranks.get

    def pair(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        if j < n and (r := get(piece[i : end[j]])) is not None:
            return r, i, end[j]
        return None

    heap = [p for p in map(pair, range(n - 1)) if p]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of its parts has grown since
        j = end[i]
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        for k in (i, before[i]):
            if k >= 0 and (p := pair(k)):
                heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def merge_counts(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, int, int]:
    """(ids, merges, lookups) of one piece by merges: a lookup of the piece and, if it is none of the tokens, one of each byte and, after each merge, of the pairs that it makes."""
    if piece in ranks:
        return 1, 0, 1
    parts, merges, lookups = [piece[i : i + 1] for i in range(len(piece))], 0, 1 + len(piece)
    while found := [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        merges, lookups = merges + 1, lookups + 1 + (i > 0)
    return len(parts), merges, lookups


def next_prefix(ranks: dict[bytes, int]) -> dict[int, int | None]:
    """For each id the id of the longest token that is a proper prefix of its token."""
    return {r: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), None) for t, r in ranks.items()}


def split(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two ids that the token's bytes are reduced to by merges of lesser rank; (id, id) where they are not two.

    A vocabulary in which no token of several bytes gives (id, id) is well-formed: each token is reached by merges.
    """
    own = ranks[token]
    if len(token) > 1:
        lesser = {token[i:j]: r for i in range(len(token)) for j in range(i + 1, len(token) + 1) if (r := ranks.get(token[i:j])) is not None and (r < own or j - i == 1)}
        ids = _scan(token, lesser)
        if len(ids) == 2:
            return ids[0], ids[1]
    return own, own


def unreachable(ranks: dict[bytes, int]) -> list[int]:
    """Ids of tokens of several bytes that merges never make; they occur only as whole pieces."""
    return sorted(r for t, r in ranks.items() if len(t) > 1 and split(t, ranks) == (r, r))
