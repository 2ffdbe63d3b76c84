"""Letters, numbers and small letters as the public tokenizers of this kind have them.

Their classes are those of one version of Unicode, whatever Python or a regular
expression library has; texts with characters of later versions would be cut
otherwise. Ranges are written as gaps and lengths to the base of 36.
"""

from __future__ import annotations

import regex

_LETTERS = (
    "1t p 7 p 1c 0 b 0 5 0 6 m 2 u 2 cp 5 b f 4 8 0 2 0 3m 4 2 1 3 3 2 0 7 0 2 2 2 0 2 j 2 2a 2 3u 9 4l 2 11 3 0 7 14 20 q 5 3 1a 16 10 1 2 2q 2 0 g 1 8 1 "
    "b 2 3 0 h 0 2 t u 2g c 0 p w a 1 5 0 6 l 5 0 a 0 4 0 o o 8 a 6 n 2 5 i 15 1n 1h 4 0 j 0 8 9 g f 5 7 3 1 3 l 2 6 2 0 4 3 4 0 h 0 e 1 2 2 f 1 b 0 9 5 5 "
    "1 3 l 2 6 2 1 2 1 2 1 w 3 2 0 k 2 h 8 2 2 2 l 2 6 2 1 2 4 4 0 j 0 g 1 o 0 c 7 3 1 3 l 2 6 2 1 2 4 4 0 v 1 2 2 g 0 i 0 2 5 4 2 2 3 4 1 2 0 2 1 4 1 4 2 "
    "4 b n 0 1h 7 2 2 2 m 2 f 4 0 r 2 3 0 3 1 v 0 5 7 2 2 2 m 2 9 2 4 4 0 w 1 2 1 g 1 i 8 2 2 2 14 3 0 h 0 6 2 9 2 p 5 6 h 4 n 2 8 2 0 3 6 1n 1b 2 1 d 6 1n "
    "1 2 0 2 4 2 n 2 0 2 9 2 1 a 0 3 4 2 0 m 3 x 0 1s 7 2 z s 4 38 16 l 0 h 5 5 3 4 0 4 1 8 2 5 c d 0 i 11 2 0 6 0 3 16 2 98 2 3 3 6 2 0 2 3 3 14 2 3 3 w 2 "
    "3 3 6 2 0 2 3 3 e 2 1k 2 3 3 1u 12 f h 2d 3 5 4 h7 3 g 2 p 6 22 7 7 8 h e i f h f c 2 2 g 1f 10 0 5 0 1w 2g 8 4 3 x 2 0 6 1x b u 1e t 3 4 c 17 5 p 1j "
    "m a 1g 2b 0 2m 1a i 7 1j t e 1 b 17 r z 16 2 b z 3 a 6 16 3 2 16 3 2 5 2 1 4 0 6 5b 1t 7p 3 5 3 11 3 5 3 7 2 0 2 0 2 0 2 u 3 1g 2 6 2 0 4 2 2 6 4 3 3 "
    "5 5 c 6 2 2 6 39 0 e 0 h c 2u 0 5 0 3 9 2 0 4 4 7 0 2 0 2 0 2 3 2 a 3 3 6 4 5 0 1h 1 22k 6c 7 3 4 1 d 11 2 0 6 0 3 1j 8 0 h m a 6 2 6 2 6 2 6 2 6 2 6 "
    "2 6 2 6 29 0 d2 1 17 4 6 1 5 2d 7 2 2 2h 2 3 6 16 2 2l i v 1d f e9 533 1t h3g 1w 19 3 7g 4 f b 1 l 1a h u 3 1x 1e 8 3 2u 3 1u 3 1 2 0 2 7 m f 2 2 2 3 "
    "2 m u 1f f 1d 1r 5 4 0 2 1 c r b m q s 8 1a t 0 h 4 2 9 b 4 2 14 o 2 2 7 l m 4 0 4 1d 2 0 4 1 3 4 3 0 2 0 p 2 3 a 8 2 d 5 3 5 3 5 a 6 2 6 2 16 2 d 7 "
    "36 u 8mb d m 5 1c 6it a5 3 2x 13 6 d 4 6 0 2 9 2 c 2 4 2 0 2 1 2 1 2 2z y a2 j 1r 3 1h 15 b 39 4 2 3q 11 p 7 p c 2g 4 5 3 5 3 5 3 2 10 b 2 p 2 i 2 1 2 "
    "e 3 d z 3e au s 4 1c 1c v e j 2 7 7 11 b t 3 z 5 7 1d 4d j z 5 z 5 13 9 1f d a 2 e 2 6 2 1 2 a 2 e 2 6 2 1 4 1f d 8m a l b 7 p 5 2 15 2 8 1y 5 3 0 2 "
    "17 2 1 4 0 3 m b m a u 1u i 2 1 b l b p 1z 1j 7 1 1t 0 g 3 2 2 2 s 17 s 4 s 10 7 2 r s 1h b l b i e h 33 20 1k 1e e 1e e z 13 r a m 6z 15 7 1 h 2 1o s "
    "b 0 9 l 17 h 1b k s m d 1g 1m 1 3 0 e 18 x o r z u 0 3 0 9 y 4 0 d 1b f 3 m 0 2 0 10 h 2 o k 1 1s 6 2 0 2 3 2 e 2 9 8 1a 13 7 3 1 3 l 2 6 2 1 2 4 4 0 "
    "j 0 d 4 v 9 2 0 3 0 2 11 2 0 q 0 2 0 19 1g j 3 l 2 v 1b l 1 2 0 55 1a 16 3 11 1b l 0 1o 16 e 0 20 q 12 6 56 17 39 1r w 7 3 0 3 7 2 1 2 n g 0 2 0 2n 7 "
    "3 12 h 0 2 0 t 0 b 13 8 0 m 0 c 19 k 0 j 20 5k w w 8 2 10 i 0 1e t 35 6 2 1 2 11 m 0 q 5 2 1 2 v f 0 94 i g 0 2 c 2 x 3h 0 28 pl 6f 5f 219 2o g tr i 5 "
    "q 32y 6 g6 5a2 t 1cz fs 8 u i 26 i t j 1b h 3 w k 6 i c1 18 5w 1r 3l 22 6 0 1v c 1t 1 2 0 t 4qf 9 yd 16 9 6w8 3 2 6 2 1 2 82 g 0 u 2 3 0 f 3 9 az 1s5 "
    "2y 6 c 4 8 8 9 4mf 2c 2 1y 2 1 3 0 3 1 3 3 2 b 2 0 2 6 2 1s 2 3 3 7 2 6 2 r 2 3 2 4 2 0 4 6 2 9f 3 o 2 o 2 u 2 o 2 u 2 o 2 u 2 o 2 u 2 o 2 7 1f9 u 7 5 "
    "7a 1p 43 18 b 6 h 0 8y t j 17 dh r 6d t 3 0 ds 6 2 3 2 1 2 e 2 5g 1o 1v 8 0 xh 3 2 q 2 1 2 0 3 0 2 9 2 3 2 0 2 0 7 0 5 0 2 0 2 0 2 2 2 1 2 0 3 0 2 0 2 "
    "0 2 0 2 0 2 1 2 0 3 3 2 6 2 3 2 3 2 0 2 9 2 g 6 2 2 4 2 g 3et wyn x 37d 7 65 3 4g1 f 5rk g h9 1wj f1 15v 3t6 6 38f "
)
_NUMBERS = (
    "1c 9 3d 1 6 0 3 2 142 9 3r 9 5j 9 bh 9 3b 9 5 5 31 9 3b 9 3b 9 3 5 33 c 38 9 9 6 2w 9 2x 6 8 i 32 9 2p 9 3b 9 1z j 7h 9 1z 9 k0 j oi 2 6o 9 7 9 n 9 8d "
    "9 3l a 4m 9 7 9 53 9 2f 9 3r 9 7 9 t3 0 4 5 7 9 5j 1e 3 4 k7 1n 27 l hj t 12i 0 lm 0 q 8 f 2 9k 3 3v 9 v 7 2 e x 9 14 e msh 9 59 9 8x 5 4b 9 13 9 5j 9 "
    "n 9 2f 9 bb 9 gev 9 dq 18 d 1k i 1 9i q 11 3 u 0 9 0 3r 4 5n 9 q7 7 q 6 14 8 24 4 n 5 4h 1 3 f 3 19 1t 8 1h 1 v 2 24 4 2x 7 p 7 16 6 97 5 1d 9 7 9 7r "
    "u 4f 9 17 3 35 6 3r t 3l 9 1p 9 41 9 8 j 70 9 9j 9 3b 9 af 9 2v 9 7 j 25 b bp i 2m 9 if 9 2f s 6c 9 1z 9 br 9 2v k to 32 c02 9 1t3 9 2f 9 3r 9 2 6 en "
    "9 7b m imy 9 153 j d j 31 o uu 1d 1tt 9 br 9 dz 9 6w 9 jx 8 3l 9 m0 1m 2 2 2 3 25 18 2 e qr c 25g 9 "
)
#: Capitals whose small letters Python 3.13 doesn't know.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def _members(ranges: str) -> set[int]:
    at, out, numbers = 0, set(), [int(x, 36) for x in ranges.split()]
    for gap, length in zip(numbers[::2], numbers[1::2], strict=True):
        out.update(range(at + gap, at + gap + length + 1))
        at += gap + length
    return out


def _written(chars: set[int]) -> str:
    """A class's inside for these code points."""
    out: list[list[int]] = []
    for c in sorted(chars):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Classes:
    """`members`: the code points by class; `odd`: characters that the regex library classes otherwise; exact(pattern): the pattern with \\p{L} and \\p{N} as pinned, for texts that hold any."""

    def __init__(self) -> None:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.sets, self.members, odd = {}, {}, set()
        for name, ranges in (("L", _LETTERS), ("N", _NUMBERS)):
            theirs, ours = set(map(ord, regex.findall(rf"\p{{{name}}}", every))), _members(ranges)
            self.members[name] = ours
            less, more = _written(theirs - ours), _written(ours - theirs)
            self.sets[name] = f"[\\p{{{name}}}--[{less}]]" if less else f"\\p{{{name}}}"
            self.sets[name] += f"[{more}]" if more else ""
            odd |= theirs ^ ours
        self.odd = frozenset(map(chr, odd))

    def exact(self, pattern: str) -> str:
        """The pattern, in the regex library's version 1."""
        for name, inside in self.sets.items():
            pattern = pattern.replace(f"\\p{{{name}}}", inside)
        return "(?V1)" + pattern
