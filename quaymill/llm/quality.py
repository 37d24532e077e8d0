"""How much running prose a text holds, as a weight for sampling."""

from __future__ import annotations

import numpy as np

#: Share of the bytes that lie in tokens of letters: none below, all that can be asked above.
LETTERS = (0.4, 0.8)
#: Different tokens, and different words, against the power 0.75 of all, as their number grows slower than the text; repeated boilerplate has fewer.
#: Scripts that take several tokens for a letter have fewer different tokens, so that little is asked of them.
TOKEN_VARIETY, WORD_VARIETY = 0.2, 1.0
#: Tokens up to which a text counts by its length.
ENOUGH = 80
LEAST = 0.02


def letter_tokens(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token of a vocabulary without blanks, and how many of them belong to a token of letters: ASCII letters, or bytes of any
    other script, which may be parts of a character."""
    sizes, letters = np.zeros(len(tokens)), np.zeros(len(tokens))
    for i, t in enumerate(tokens):
        bare = t.strip()
        sizes[i] = len(bare)
        if bare and all(b >= 128 or chr(b).isalpha() or b == 39 for b in bare):
            letters[i] = len(bare)
    return sizes, letters


def prose_weight(ids: np.ndarray, text: str, sizes: np.ndarray, letters: np.ndarray) -> float:
    """0.02 to 1: the product of shares that any script can reach, none below 0.1: bytes in tokens of letters, different tokens and words among
    all, lines that don't repeat, and length up to ``ENOUGH`` tokens. A text without tokens has the least weight."""
    n = len(ids)
    if not n:
        return LEAST
    all_bytes = sizes[ids].sum()
    lettered = (letters[ids].sum() / all_bytes - LETTERS[0]) / (LETTERS[1] - LETTERS[0]) if all_bytes else 0.0
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    words = text.split()
    variety = len(set(words)) / len(words) ** 0.75 / WORD_VARIETY if words else 0.0
    parts = (lettered, len(np.unique(ids)) / n**0.75 / TOKEN_VARIETY, variety, len(set(lines)) / len(lines) if lines else 0.0, n / ENOUGH)
    return max(LEAST, float(np.prod(np.clip(parts, 0.1, 1.0))))
