"""Segmentations of pre-tokens over the pieces of an existing subword vocabulary.

A pre-token is a word with the word mark in front. Different pre-tokens of a batch are visited in
sorted order, which is a depth-first walk of their trie: the states of a shared prefix are computed
once and kept while the walk stays below it. A character that no piece spells is spelled by its
bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def load(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and their scores; byte pieces are named <0x00> to <0xFF>, control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in kept}


def byte_name(b: int) -> str:
    return f"<0x{b:02X}>"


class Walk:
    """Edges (start, weight, piece) that end at each position of the current pre-token, extended from the shared prefix.

    `piece` is None for a character spelled by bytes.
    """

    def __init__(self, weights: dict[str, float], byte: list[float]):
        self.weights = {p: w for p, w in weights.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.byte = byte
        # endings of pieces, so that the search for pieces that end at a position stops early
        self.ending: dict[str, float | None] = {p[i:]: None for p in self.weights for i in range(len(p))}
        self.ending.update(self.weights)
        self.restart()

    def restart(self) -> None:
        self.word = ""
        self.edges: list[list[tuple[int, float, str | None]]] = [[]]

    def edges_at(self, s: str, j: int) -> list[tuple[int, float, str | None]]:
        ending, out = self.ending, []
        for i in range(j - 1, -1, -1):
            part = s[i:j]
            if part not in ending:
                break
            w = ending[part]
            if w is not None:
                out.append((i, w, part))
        if not out or out[0][0] != j - 1:
            out.append((j - 1, sum([self.byte[b] for b in s[j - 1].encode("utf-8", "surrogatepass")]), None))
        return out

    def to(self, s: str) -> int:
        """Move to pre-token `s`; returns the length of the prefix whose states still hold."""
        same, old = 0, self.word
        for a, b in zip(old, s):
            if a != b:
                break
            same += 1
        del self.edges[same + 1 :]
        for j in range(same + 1, len(s) + 1):
            self.edges.append(self.edges_at(s, j))
        self.word = s
        return same


def best_counts(walk: Walk, words: Iterable[str]) -> Iterator[tuple[str, int]]:
    """Pieces in the best segmentation of every word; of equal scores the one with the fewest pieces."""
    score, count = [0.0], [0]
    walk.restart()
    for word in sorted(set(words)):
        s = MARK + word
        same = walk.to(s)
        del score[same + 1 :], count[same + 1 :]
        for j in range(same + 1, len(s) + 1):
            top, n = -math.inf, 0
            for i, w, piece in walk.edges[j]:
                k = count[i] + (1 if piece is not None else len(s[i].encode("utf-8", "surrogatepass")))
                v = score[i] + w
                if v > top or v == top and k < n:
                    top, n = v, k
            score.append(top)
            count.append(n)
        yield word, count[-1]


def forward(walk: Walk, words: Iterable[str]) -> Iterator[tuple[str, list[float]]]:
    """Log-sums over all segmentations of every prefix of every word, in sorted order; the last is that of the word.

    The list is shared with the walk: use it before the next word.
    """
    exp, log = math.exp, math.log
    alpha = [0.0]
    walk.restart()
    for word in sorted(set(words)):
        s = MARK + word
        same = walk.to(s)
        del alpha[same + 1 :]
        for j in range(same + 1, len(s) + 1):
            terms = [alpha[i] + w for i, w, _ in walk.edges[j]]
            top = max(terms)
            alpha.append(top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top)
        yield word, alpha


def expected(walk: Walk, alpha: list[float], times: float, into: dict[str, float]) -> None:
    """Add `times` the expected uses of every piece in the current word to `into`."""
    edges, exp, log = walk.edges, math.exp, math.log
    n = len(alpha) - 1
    beta = [-math.inf] * n + [0.0]
    for j in range(n, 0, -1):
        b = beta[j]
        if b == -math.inf:
            continue
        for i, w, piece in edges[j]:
            v = w + b
            share = times * exp(alpha[i] + v - alpha[n])
            if piece is not None:
                into[piece] = into.get(piece, 0.0) + share
            else:
                for x in walk.word[i].encode("utf-8", "surrogatepass"):
                    into[byte_name(x)] = into.get(byte_name(x), 0.0) + share
            old = beta[i]
            hi, lo = (v, old) if v > old else (old, v)
            beta[i] = hi + log(1.0 + exp(lo - hi)) if lo > -math.inf else hi
