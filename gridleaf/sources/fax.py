"""Fax images of groups 3 and 4 (ITU-T T.4 and T.6): one-dimensional rows and rows against the one above."""

from __future__ import annotations

import numpy as np

from gridleaf.sources.filters import Unreadable

# Fixed values of T.4: codes of runs of 0 to 63 pixels, of multiples of 64 up to 1728, and from 1792 on for both colours.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 "
    "00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 "
    "01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
).split()
WHITE_64 = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 "
    "010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 "
    "00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 "
    "000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 "
    "000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
).split()
BLACK_64 = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 "
    "0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
LONG_64 = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Modes of a row against the one above: vertical by an offset, horizontal, pass.
MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "001": "horizontal", "0001": "pass"}
END_OF_LINE = "000000000001"


def runs(black: bool) -> dict[str, int]:
    """Codes of runs of a colour."""
    short, long = (BLACK, BLACK_64) if black else (WHITE, WHITE_64)
    return {c: i for i, c in enumerate(short)} | {c: 64 * i for i, c in enumerate(long + LONG_64, 1)}


def _table(codes: dict[str, object]) -> list[tuple[int, object] | None]:
    """For each 13 bits the length and meaning of the code that they begin with."""
    out: list[tuple[int, object] | None] = [None] * (1 << 13)
    for code, meaning in codes.items():
        first = int(code, 2) << (13 - len(code))
        out[first : first + (1 << (13 - len(code)))] = [(len(code), meaning)] * (1 << (13 - len(code)))
    return out


_RUNS = [_table(runs(False)), _table(runs(True))]
_MODES = _table(MODES)


class Bits:
    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(8), dtype=np.uint8).astype(np.int64)
        self.words, self.at, self.end = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tolist(), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        return (self.words[self.at >> 3] >> (24 - (self.at & 7) - n)) & ((1 << n) - 1)

    def code(self, table: list) -> object:
        found = table[self.peek(13)] if self.at < self.end else None
        if found is None:
            raise Unreadable("no code of a run")
        self.at += found[0]
        return found[1]

    def run(self, black: int) -> int:
        total = 0
        while True:
            n = self.code(_RUNS[black])
            total += n
            if n < 64:
                return total


def _row_alone(bits: Bits, columns: int) -> list[int]:
    """Places where the colour changes, white first."""
    out, at, black = [], 0, 0
    while at < columns:
        at += bits.run(black)
        out.append(min(at, columns))
        black ^= 1
    return out


def _row_below(bits: Bits, above: list[int], columns: int) -> list[int]:
    """Changes of a row that is told by those of the row above."""
    out: list[int] = []
    at, black, i = -1, 0, 0
    edges = [*above, columns, columns, columns]
    while at < columns:
        # The first change above to the right of the place, to the other colour than that here.
        while i > 0 and edges[i - 1] > at:
            i -= 1
        while (edges[i] <= at or i % 2 != black) and edges[i] < columns:
            i += 1
        mode = bits.code(_MODES)
        if mode == "pass":
            at = edges[i + 1] if edges[i] < columns else columns
        elif mode == "horizontal":
            at = max(at, 0)
            for colour in (black, black ^ 1):
                at = min(columns, at + bits.run(colour))
                out.append(at)
        else:
            at = edges[i] + mode
            if at < 0 or (out and at < out[-1]) or at > columns:
                raise Unreadable("a change out of place")
            out.append(at)
            black ^= 1
    return out


def decode(data: bytes, columns: int = 1728, rows: int = 0, k: int = 0, aligned: bool = False, black_is_1: bool = False, end_of_block: bool = True) -> np.ndarray:
    """(rows, columns) of 0 and 1 as a 1-bit image holds them: 0 is black unless ``black_is_1``.

    ``k`` below 0 is group 4; 0 group 3 with rows alone; above 0 group 3 with rows of both kinds, each told by a bit after its end-of-line
    code.  Rows that are missing at the end are white, as in a fax that broke off, unless there is none at all.
    """
    if columns < 1 or columns > 1 << 16:
        raise Unreadable("columns of a fax")
    bits, found, above = Bits(data), [], []
    while (not rows or len(found) < rows) and bits.at < bits.end:
        if aligned:
            bits.at = -(-bits.at // 8) * 8
        try:
            alone, ended = k == 0, 0
            if k >= 0:
                start = bits.at
                while bits.at + 12 <= bits.end and bits.peek(11) == 0:  # fill, then an end of line
                    while bits.at < bits.end and not bits.peek(1):
                        bits.at += 1
                    bits.at += 1
                    ended += 1
                    if k > 0:
                        alone = bool(bits.peek(1))
                        bits.at += 1
                if ended > 1 and end_of_block and found:
                    break
                if not ended:
                    bits.at, alone = start, True if k == 0 else alone
            elif bits.peek(12) == 1:  # the end of a block of group 4
                break
            if bits.at >= bits.end:
                break
            above = _row_alone(bits, columns) if alone else _row_below(bits, above, columns)
        except (Unreadable, IndexError):
            if not found:
                raise Unreadable("no row of a fax") from None
            break
        found.append(above)
    height = rows or len(found)
    if not found:
        raise Unreadable("no row of a fax")
    change = np.zeros((height, columns + 1), dtype=np.int8)
    for y, places in enumerate(found):
        np.add.at(change[y], places, 1)
    black = np.cumsum(change[:, :columns], axis=1) % 2
    return (black if black_is_1 else 1 - black).astype(np.uint8)
