"""Most-significant-digit radix sort of suffixes, through a fixed number of bytes only.

Digits are eight bytes.  A pass looks at the next digit of all suffixes that still
share everything before it with another; groups whose digits agree stay as they
are, the others are ordered by the digit and split; suffixes alone in their group
leave.  After the last digit the groups that are left are exactly the strings that
start more than once, in byte order.
"""

from __future__ import annotations

import numpy as np

DIGIT = 8


def digits(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, in byte order; past the end count as 0."""
    padded = np.concatenate((text, np.zeros(DIGIT - 1, np.uint8)))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, DIGIT)).view(">u8").ravel().astype(np.uint64) if len(text) else np.empty(0, np.uint64)


def places(length: int) -> list[int]:
    """Where the digits of a string start; the last may overlap the one before."""
    out = [*range(0, length - DIGIT + 1, DIGIT)]
    return out if out and out[-1] + DIGIT == length else [*out, max(0, length - DIGIT)]


def equal_prefixes(text: np.ndarray, start: np.ndarray, part: np.ndarray, length: int) -> np.ndarray:
    """Number of each suffix's group (in order of part, then bytes), or -1 if no other of its part shares its first `length` bytes.

    text: bytes, with at least max(length, DIGIT) of them from each start on; part: any numbers.
    """
    out = np.full(len(start), -1, np.int64)
    order = np.argsort(part, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = part[order][1:] != part[order][:-1]
    code = digits(text)
    for d in [None, *places(length)]:
        if d is not None:
            digit = code[start[order] + d]
            turn = np.zeros(len(order), bool)
            turn[1:] = ~new[1:] & (digit[1:] != digit[:-1])
            if turn.any():
                group = np.cumsum(new) - 1
                mixed = np.zeros(group[-1] + 1, bool)
                mixed[group[turn]] = True
                at = np.flatnonzero(mixed[group])
                to = at[np.lexsort((digit[at], group[at]))]
                order[at], digit[at] = order[to], digit[to]
                new[1:] |= digit[1:] != digit[:-1]
        alone = new & np.append(new[1:], True)
        order, new = order[~alone], new[~alone]
        if not len(order):
            return out
    out[order] = np.cumsum(new) - 1
    return out
