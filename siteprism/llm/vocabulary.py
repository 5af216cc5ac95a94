"""A SentencePiece model's pieces, and the units that a text falls into.

No piece of the vocabularies in use reaches from another character to a space
mark, so a text can be cut before every run of space marks.  It can also be cut
around ASCII characters that occur in no piece of two characters or more, and
between a letter and ASCII punctuation that no piece holds behind a letter.  The cuts never change a segmentation; they let equal
units (words, mostly) be worked out once in a task.  All is derived from the
vocabulary; where the first property fails, whole texts are the units.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field
from functools import cached_property

import sentencepiece
from sentencepiece import sentencepiece_model_pb2

#: The mark that stands for a space.
SPACE = "▁"
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id; kinds: n normal, b byte, u unknown, c any other."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    id_of: dict[str, int] = field(compare=False)
    bytes_of: dict[int, int] = field(compare=False)

    @cached_property
    def rank(self) -> dict[str, float]:
        """Pieces by their turn in merging: the best score is the lowest rank."""
        return {p: -self.scores[i] for p, i in self.id_of.items()}

    @cached_property
    def byte_ids(self) -> list[int]:
        return sorted(self.bytes_of, key=self.bytes_of.get)

    @cached_property
    def unknown(self) -> int:
        return self.kinds.index("u")

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.id_of))

    @cached_property
    def units(self) -> re.Pattern:
        inner = [p for p in self.id_of if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in inner):
            return re.compile(r"[\s\S]+")
        pairs = {p[i : i + 2] for p in inner for i in range(len(p) - 1)}
        joined = {c for p in pairs for c in p}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in joined and c != 32))
        marks = re.escape("".join(c for c in string.punctuation if not any(b == c and _LETTER.match(a) for a, b in pairs)))
        if not alone or not marks:
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        letters = _LETTER.pattern[1:-1]
        return re.compile(f"[{alone}]|(?=[\\s\\S]){SPACE}*(?:[^{SPACE}{alone}{letters}]+|[{letters}]++(?![{marks}]))*+[{letters}]*")

    def marked(self, text: str) -> str:
        """The text as the tokenizer sees it: a space in front, spaces as marks; the empty text stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def split(self, text: str) -> list[str]:
        return self.units.findall(self.marked(text))

    def fallback(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary; without byte pieces a run of them is one unknown piece: see `joined`."""
        return [self.byte_ids[b] for b in char.encode()] if self.bytes_of else [self.unknown]

    def joined(self, ids: list[int]) -> list[int]:
        """Ids of a text with runs of the unknown piece as one, where the vocabulary has no byte pieces."""
        if self.bytes_of or self.unknown not in ids:
            return ids
        return [i for i, before in zip(ids, [None, *ids]) if not i == before == self.unknown]

    @cached_property
    def as_bytes(self) -> list[bytes]:
        """What each id stands for in a text."""
        shown = {"n": lambda p: p.replace(SPACE, " ").encode(), "u": lambda p: " ⁇ ".encode(), "c": lambda p: b""}
        return [bytes([self.bytes_of[i]]) if k == "b" else shown[k](p) for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing, ids outside ValueError."""
        if ids and not 0 <= min(ids) <= max(ids) < len(self.pieces):
            raise ValueError("an id is outside the vocabulary")
        return b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def refused(proto: sentencepiece_model_pb2.ModelProto) -> list[str]:
    """What a model asks for that is not supported here."""
    norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
    asks = {
        "a normalisation of characters": bool(norm.precompiled_charsmap),
        "spaces dropped": norm.remove_extra_whitespaces,
        "no space in front": not norm.add_dummy_prefix,
        "spaces without marks": not norm.escape_whitespaces,
        "space marks behind words": proto.trainer_spec.treat_whitespace_as_suffix,
        "user-defined pieces": proto.trainer_spec.model_type not in (1, 2) or 4 in kinds,
        "a changed decoding": bool(proto.denormalizer_spec.precompiled_charsmap),
    }
    return [k for k, v in asks.items() if v]


def read(path: str) -> Vocabulary:
    """Read a model file (on the driver; the vocabulary travels with the tasks).

    ValueError for a model that changes texts before encoding or has user-defined pieces: see `refused`.
    """
    with open(path, "rb") as f:
        return parsed(f.read())


def parsed(data: bytes) -> Vocabulary:
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    if what := refused(proto):
        raise ValueError(f"this model asks for {', '.join(what)}")
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    n = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(n))
    kinds = "".join("b" if model.is_byte(i) else "u" if model.is_unknown(i) else "c" if model.is_control(i) or model.is_unused(i) else "n" for i in range(n))
    return Vocabulary(
        pieces,
        tuple(model.get_score(i) for i in range(n)),
        kinds,
        {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "n"},
        {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "b"},
    )
