"""Byte-pair encoding by longest matches: each next token is the longest that fits beside the one before it, else a shorter one, else the one before gives way.

It gives what merges by rank give, if every token can be reached by merges.
"""

from __future__ import annotations

from collections import Counter

from tokloom.operators.bpe import _heap, _scan, next_prefix


class Trie:
    """Counters, of all calls: next_match, nm_steps (bytes looked at), is_valid, is_valid_miss (pairs not seen before), tokens, backtrack (pieces for which the longest matches alone did not do)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.shorter, self.longest = next_prefix(ranks), max(map(len, ranks))
        self.beginnings = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.n: Counter = Counter()

    def next_match(self, text: bytes, at: int = 0) -> int | None:
        """The id of the longest token that begins at a place."""
        self.n["next_match"] += 1
        best = None
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            self.n["nm_steps"] += 1
            if (part := text[at:end]) not in self.beginnings:
                break
            best = self.ranks.get(part, best)
        return best

    def valid(self, first: int, second: int) -> bool:
        """Whether merges leave two tokens beside each other as they are."""
        self.n["is_valid"] += 1
        if (first, second) not in self.pairs:
            self.n["is_valid_miss"] += 1
            both = self.tokens[first] + self.tokens[second]
            self.pairs[first, second] = (_scan if len(both) < 48 else _heap)(both, self.ranks) == [first, second]
        return self.pairs[first, second]

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        places, dead, greedy = [0], set(), True
        token = self.next_match(piece) if piece else None
        while token is not None:
            at, last = places[-1], out[-1] if out else None
            while token is not None and (at + len(self.tokens[token]) in dead or (last is not None and not self.valid(last, token))):
                token, greedy = self.shorter[token], False
            if token is not None:
                out.append(token)
                places.append(at + len(self.tokens[token]))
                token = self.next_match(piece, places[-1]) if places[-1] < len(piece) else None
            elif out:  # nothing fits here: a shorter token before it
                dead.add(at)
                places.pop()
                token = out.pop()
        self.n["tokens"] += len(out)
        self.n["backtrack"] += not greedy
        return out
