"""Splitting texts where no tokenizer of the byte-level kind joins the two sides, and putting what the
pieces encode to together again. Runs inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable

_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: A space that follows white space is not a safe place.
_UNSAFE = tuple(c + " " for c in _SPACES)
_SAFE_SPACE = re.compile(r"(?<=\S) ")


def split(text: str) -> list[str]:
    """Pieces of ``text``, cut at each space that follows no white space. Each piece but the first
    has lost that leading space. A pre-tokenizer whose tokens hold white space at their
    start only begins a token at such a space, so the pieces encode independently."""
    return _SAFE_SPACE.split(text) if any(u in text for u in _UNSAFE) else text.split(" ")


#: The same, for Arrow's regular expressions.
_UNSAFE_RE2 = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def split_all(texts):
    """The pieces of an Arrow array of texts, one after the other, and how many each text has."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts, " ")
    pieces, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    odd = np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE_RE2).to_numpy(zero_copy_only=False))
    if not len(odd):
        return pieces, sizes
    ends, parts, at = np.cumsum(sizes), [], 0
    for i in odd.tolist():
        own = split(texts[i].as_py())
        parts += [pieces.slice(at, int(ends[i] - sizes[i]) - at), pa.array(own, pieces.type)]
        at, sizes[i] = int(ends[i]), len(own)
    return pa.concat_arrays([*parts, pieces.slice(at)]), sizes


def in_groups(texts: list, chars: int = 2_000_000) -> Iterable[range]:
    """Ranges of positions in ``texts`` whose texts have about ``chars`` characters together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield range(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def spread(flat, sizes, index):
    """Of values that lie one after the other in ``flat``, as many items each as ``sizes`` say: the items of
    those at ``index[0]``, ``index[1]``, ... as one array, and how many each has."""
    import numpy as np

    start, n = np.cumsum(sizes) - sizes, sizes[index]
    behind = np.cumsum(n)
    where = np.repeat(start[index] - (behind - n), n)
    where += np.arange(len(where))
    return flat[where], n


def spans(lengths, total: int = 6_000_000) -> Iterable[range]:
    """Ranges of positions whose ``lengths`` sum to about ``total``."""
    import numpy as np

    ends = np.cumsum(np.asarray(lengths, np.int64))
    start = 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + total)) + 1
        yield range(start, min(stop, len(ends)))
        start = stop
