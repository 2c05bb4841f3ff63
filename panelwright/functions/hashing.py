"""MD5 of many short texts at once, as `md5(text)` in SQL gives it."""

from __future__ import annotations

import hashlib

import numpy as np

_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [r[i % 4] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_WORDS = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def _digits(numbers: np.ndarray, at: int) -> np.ndarray:
    """(numbers, 16 words): a padded message with the decimal digits of numbers of equal length from byte `at`, zero elsewhere."""
    text = np.zeros((len(numbers), 64), np.uint8)
    for k in range(len(str(numbers[0]))):
        text[:, at + len(str(numbers[0])) - 1 - k] = numbers // 10**k % 10 + 48
    return text.view("<u4")


def _first_64_bits(words: list[np.ndarray | int], shape: tuple[int, int]) -> np.ndarray:
    """The first 64 bits of the digests of one-block messages, given as 16 words each: arrays or numbers."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    t = np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            f = np.bitwise_xor(c, d)
            f &= b
            f ^= d
        elif i < 32:
            f = np.bitwise_xor(b, c)
            f &= d
            f ^= c
        elif i < 48:
            f = np.bitwise_xor(b, c)
            f ^= d
        else:
            f = np.bitwise_not(d)
            f |= b
            f ^= c
        word = words[_WORDS[i]]
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + word) % 2**32)
        f += a
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        f <<= np.uint32(_TURNS[i])
        f |= t
        f += b
        a, b, c, d = d, f, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()


def md5_60_bits(head: str, firsts: np.ndarray, seconds: np.ndarray, cells: int = 32_768) -> np.ndarray:
    """(firsts, seconds): the first 15 hex digits of md5('head:first:second') as a number; both ascend and are not negative."""
    start = f"{head}:".encode()
    out = np.empty((len(firsts), len(seconds)), np.uint64)
    parts = [[np.flatnonzero(np.char.str_len(v.astype(str)) == k) for k in np.unique(np.char.str_len(v.astype(str)))] for v in (firsts, seconds)]
    for mine in parts[0]:
        for other in parts[1]:
            one, two = firsts[mine], seconds[other]
            middle = len(start) + len(str(one[0]))
            length = middle + 1 + len(str(two[0]))
            if length > 55:  # more than one block
                for i, x in zip(mine, one.tolist()):
                    raw = b"".join([hashlib.md5(start + b"%d:%d" % (x, y)).digest()[:8] for y in two.tolist()])
                    out[i, other] = np.frombuffer(raw, ">u8")
                continue
            frame = np.zeros(64, np.uint8)
            frame[: len(start)], frame[middle], frame[length] = np.frombuffer(start, np.uint8), ord(":"), 0x80
            fixed = frame.view("<u4") | _digits(one, len(start))
            moving = _digits(two, middle + 1)
            for lo in range(0, len(one), max(1, cells // len(two))):
                rows = slice(lo, lo + max(1, cells // len(two)))
                shape = (len(one[rows]), len(two))
                words: list[np.ndarray | int] = []
                for k in range(14):
                    varied = fixed[:, k].any() or moving[:, k].any()
                    words.append(fixed[rows, k, None] | moving[None, :, k] if varied else 0)
                out[mine[rows, None], other] = _first_64_bits([*words, 8 * length, 0], shape)
    return out >> np.uint64(4)
