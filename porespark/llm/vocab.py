"""Token ids of whole texts, unit by unit, exactly as the tokenizer libraries give them.

A text is cut where the tokenizer can never join across: white space that its
splitter drops, or the blank that opens a word.  Units are remembered per worker,
in a memory bounded by bytes, so a common word costs one dictionary access.  A new
unit is split into pieces by the tokenizer's own pattern and each new piece goes
through the library's merge step.  This holds for characters whose class and lower
case are settled (``_LETTERS``, ``_DIGITS``, ASCII); a unit with any other character
is encoded by the library as it stands, and so is every text of a tokenizer whose
definition is not one of those known here.  Texts are never cut elsewhere.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

MEMORY_BYTES = 96 << 20    # of a memory's generation; there are two
_ENTRY_BYTES = 170         # what an entry takes beside its key's and value's bytes

# Letters and digits beyond ASCII that are stable under NFC and have a lower case of one letter
# whatever stands beside them.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ɏЀ-ҁҊ-ӿ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\\t-\\r "       # white space among the settled characters
# Anything unsettled: other scripts, controls that only Python takes for white space, rare blanks.
_ODD = re.compile(f"[^\x00-\x1b -\x7e\xa1-\xbf\xd7\xf7{_LETTERS}]")
_RARE_BLANK = re.compile("[\x0b\x0c\x85\xa0  -     　]")
_SPACE = "\\t-\\r \x85\xa0  -     　"
_BLANK_LED = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BLANKS_LED = re.compile(" *[^ ]+| +")
_PYTHON_SPACE = "\x1c\x1d\x1e\x1f"

# Splitting patterns of the tokenizers known here (fixed values of their definitions).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+"
                     f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r 0-9A-Za-z]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")

_BLANK_LETTER = "\u0120"

#: Stands for a unit whose tokens do not spell its bytes.
UNFAITHFUL = pack("<i", -1)


def as_bytes(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}i", *ids)


class Memory(dict):
    """Remembers ``make(key)``, a bytes object; keys not met for a whole generation are forgotten."""

    def __init__(self, make: Callable[[str], bytes], limit: int = MEMORY_BYTES):
        super().__init__()
        self.make, self.limit, self.held, self.older = make, limit, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = 2 * len(key) + len(value) + _ENTRY_BYTES
        if size > self.limit >> 8:  # a very long unit is not worth its room
            return value
        if self.held + size > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += size
        return value


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(moved)) for b in range(256)]


def _spelled(text: str) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in text.encode()])


class JsonIds:
    """Ids by a ``tokenizers`` file.  ``plain`` takes special strings inside texts for ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merge = self.library.model.tokenize
        # the two steps tell their definitions; the file's vocabulary is not parsed once more beside the library's
        pre, norm = (json.loads(part.__getstate__()) if part else {} for part in (self.library.pre_tokenizer, self.library.normalizer))
        steps, kinds = pre.get("pretokenizers", []), [n.get("type") for n in norm.get("normalizers", [])]
        self.kind = "other"
        if (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm):
            self.kind, self.split, self.ascii_split = "byte", _PIECES.findall, _ASCII_PIECES.findall
        elif (pre.get("type") == "Sequence" and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
              and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0]["pattern"].get("Regex") == _WORD_LEVEL
              and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and kinds == ["NFC", "Replace", "Lowercase"]):
            self.kind, self.split, self.ascii_split = "word", _WORDS.findall, _ASCII_WORDS.findall
        self.unit = Memory(self._unit)

    def whole(self, text: str) -> bytes:
        return as_bytes(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _unit(self, unit: str) -> bytes:
        """Merges a unit of one piece; takes the pieces of others from the memory."""
        if unit.isascii():
            if self.kind == "word":
                unit = unit.lower()
            if unit.isalpha() or (unit[:1] == " " and unit[1:].isalpha()):
                return as_bytes([t.id for t in self.merge(unit.replace(" ", _BLANK_LETTER))])
            pieces = self.ascii_split(unit)
        elif _ODD.search(unit):
            return self.whole(unit)
        else:
            pieces = self.split(unit.lower() if self.kind == "word" else unit)
        if len(pieces) > 1:
            return b"".join(map(self.unit.__getitem__, pieces))
        return b"".join([as_bytes([t.id for t in self.merge(_spelled(p))]) for p in pieces])

    def ids(self, text: str) -> bytes:
        """The ids of a text as 32-bit little-endian integers."""
        if self.kind == "other" or any(s in text for s in self.added):
            return self.whole(text) if text else b""
        if self.kind == "byte":
            return b"".join(map(self.unit.__getitem__, _BLANK_LED.findall(text)))
        if any(c in text for c in _PYTHON_SPACE):
            return self.whole(text)
        if text.isascii() or not _ODD.search(text):
            text = text.lower()
        return b"".join(map(self.unit.__getitem__, text.split()))

    def ids_after_blank(self, text: str) -> bytes:
        """``ids(" " + text)``."""
        return self.ids(" " + text)

    def unit_after_blank(self, unit: str) -> bytes:
        """``ids(" " + unit)`` of a part of a text that ``is_spaced``, cut at its blanks; not remembered."""
        return self._unit(" " + unit)


def is_spaced(text: str) -> bool:
    """Whether no blank of " " + text stands beside other white space, so that each opens a unit for both kinds."""
    return not (text[:1].isspace() or "  " in text or " \n" in text or "\n " in text or " \t" in text or "\t " in text
                or " \r" in text or "\r " in text or _RARE_BLANK.search(text))


class PieceIds:
    """Ids by a sentencepiece file that puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as definition

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = definition.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, blank = model.normalizer_spec, "▁"
        # No piece joins a letter to a blank after it, nothing is rewritten: blanks after letters are safe cuts.
        self.cuts = (norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
                     and not norm.precompiled_charsmap and not any(p.type == 4 for p in model.pieces)
                     and not any(blank in p.piece.lstrip(blank) for p in model.pieces))
        self.blank = self.library.piece_to_id(blank)
        self.table = [bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else p.piece.replace(blank, " ").encode() for p in model.pieces]
        self.unit = Memory(self._unit)

    def _unit(self, text: str) -> bytes:
        return next(self.after_blanks([text]))

    def after_blanks(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text after a blank, or ``UNFAITHFUL``."""
        table = self.table
        for text, ids in zip(texts, self.library.encode(texts, num_threads=1)):
            ids = ids if text else [self.blank]
            yield as_bytes(ids) if b"".join([table[i] for i in ids]) == (" " + text).encode() else UNFAITHFUL

    def ids_after_blank(self, text: str) -> bytes:
        """The ids of a text that is not empty; -1 among them if they do not spell a blank and the text."""
        if not self.cuts:
            return self._unit(text)
        if text[:1] != " " and "  " not in text:
            return b"".join(map(self.unit.__getitem__, text.split(" ")))
        return b"".join([self.unit[u[1:]] for u in _BLANKS_LED.findall(" " + text)])


def byte_table(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level file stands for."""
    from tokenizers import Tokenizer

    library, of = Tokenizer.from_file(path), {c: b for b, c in enumerate(byte_letters())}
    pieces = {i: p for p, i in library.get_vocab(with_added_tokens=True).items()}
    return [bytes([of[c] for c in pieces[i]]) if i in pieces and all(c in of for c in pieces[i]) else b""
            for i in range(max(pieces) + 1)]


_KEPT: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """One object per worker process, such as an encoder with its memory."""
    key = (make, *args)
    if key not in _KEPT:
        _KEPT[key] = make(*args)
    return _KEPT[key]
