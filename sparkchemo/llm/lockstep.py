"""Running a deterministic automaton over many texts at once in numpy.

Texts are cut into blocks; the blocks of a batch are the columns of a matrix and the
automaton takes one byte of each in every step. The cost a byte is a table look-up,
whatever the texts' lengths.
"""

from __future__ import annotations

import numpy as np


def blocks(data: np.ndarray, edges: np.ndarray, size: int, lead: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut texts into blocks of ``size`` symbols, each after the ``lead`` symbols before it.

    ``data`` holds the symbols of all texts, ``edges`` their places. Returns the matrix
    [lead + size, blocks], filled with ``pad`` where a text has no symbol, and each
    block's text. A text without symbols has no block.
    """
    length = np.diff(edges)
    count = -(-length // size)
    text = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    flat = np.full(len(text) * size, pad, np.uint8)
    for a, b, k in zip(edges[:-1].tolist(), edges[1:].tolist(), ((np.cumsum(count) - count) * size).tolist(), strict=True):
        flat[k : k + b - a] = data[a:b]
    out = np.full((lead + size, len(text)), pad, np.uint8)
    out[lead:] = flat.reshape(-1, size).T
    later = np.flatnonzero(nth > 0)  # blocks with symbols of their text before them
    for k in range(min(lead, len(flat))):
        own = later[nth[later] * size >= lead - k]
        out[k, own] = flat[own * size - lead + k]
    return out, text
