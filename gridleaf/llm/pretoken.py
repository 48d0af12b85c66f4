"""Pre-tokens of byte-level BPE vocabularies, and their rank files."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern of public_tokenizers.PATTERN with its blanks spelled as the Unicode
#: property, since this regex library also counts U+001C to U+001F as ``\s``.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
split = PATTERN.findall


def default_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine (it is installed on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level BPE JSON vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def load_json(path: str) -> tuple[dict[str, int], list[tuple[str, str]], list[dict]]:
    """Vocabulary, merges in rank order, and added tokens of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges, spec["added_tokens"]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def cut_piece(piece: str) -> list[str]:
    """Pre-tokens of a piece; a word, alone or with a mark after it, is cut without the pattern."""
    if piece.isalpha():
        return [" " + piece]
    if piece[0] == MARK:
        return [piece[1:]]
    word, mark = piece[:-1], piece[-1]
    if mark in ".,;:!?" and word.isalpha():
        return [" " + word, mark]
    return split(piece if piece[0] == "\n" else " " + piece)


#: White space other than single blanks and line breaks between other characters (RE2).
OTHER_BLANKS = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x02]"
#: Stands before a mark that is cut from the word before it.
MARK = "\x02"
WORD_AND_MARK = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?])( |$)"
#: Rows and characters that are cut at once: the more, the fewer pieces are asked for again.
AT_ONCE = (8192, 6_000_000)
#: Pieces of which a worker keeps the value, in each of two generations.
KNOWN = 600_000


@dataclass
class Pieces:
    """Texts cut into pieces at every single blank or line break.

    Such white space between other characters always ends a pre-token, so the tokens of
    a text are those of its pieces: words with the blank, or starting with the line
    break, before them.  A mark between a letter and white space is a pre-token too and
    becomes a piece of its own.  The first piece of a text starts with a line break that
    is not in the text.  Texts with other white space, with special strings or without
    a character stand ``alone`` and have no pieces.
    """

    alone: np.ndarray
    distinct: list[str]
    codes: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, specials: list[str] = ()) -> Pieces:
        alone = pc.match_substring_regex(texts, OTHER_BLANKS)
        for special in specials:
            alone = pc.or_(alone, pc.match_substring(texts, special))
        lined = pc.replace_substring(texts.filter(pc.invert(alone)), "\n", " \n")
        marked = pc.replace_substring_regex(lined, WORD_AND_MARK, rf"\1 {MARK}\2\3")
        listed = pc.split_pattern(pc.binary_join_element_wise("\n", marked, ""), " ")
        coded = listed.flatten().dictionary_encode()
        bounds = np.r_[0, np.cumsum(pc.list_value_length(listed).to_numpy())].astype(np.int64)
        return cls(alone.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds)

    def joined(self, values: list[bytes], skip: int) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of the texts that do not stand alone, from the ids of the distinct pieces; the first ``skip`` ids of each are not the text's."""
        size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        ends = np.r_[0, np.cumsum(size[self.codes])]
        known = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), np.frombuffer(b"".join(values), dtype="<u4"))
        flat = known.take(pa.array(self.codes)).flatten().to_numpy()
        cuts = ends[self.bounds].tolist()
        return (flat[a + skip : b] for a, b in zip(cuts, cuts[1:], strict=False))
