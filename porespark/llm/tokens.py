"""Token counts of whole texts, as a public tokenizer library gives them.

Texts go to Python in Arrow batches and only lengths come back.  A text is cut
at safe boundaries - places where the tokenizer's own first splitting step must
cut - into units that are encoded once per worker and then looked up, so common
units cost a dictionary access.  Units that are new are encoded by the library
in batches of bounded bytes.  No text is cut anywhere else: a unit without a
safe boundary inside is encoded whole, however long it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as the tokenizers' regular expressions see it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A run of non-space with the one blank before it, or a run of white space: the
# byte-level splitter never joins text across these.
_BLANK_LED = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_SAFE_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
# Printable ASCII, where the byte-level alphabet maps all but the blank to itself.
_PLAIN = re.compile(r" ?[!-~]+")
_BLANK_LETTER = "\u0120"
# The splitting pattern that byte-level tokenizers have built in (a fixed value).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BATCH_BYTES = 1 << 20      # bytes of new units per call of the library
SLICE_CHARS = 1 << 20      # a longer text is split into units slice by slice
MEMORY_UNITS = 200_000     # units in each of a worker's two generations of memory


def _slices(text: str) -> Iterator[str]:
    """Consecutive parts of a text, cut only before a single inner blank."""
    start = 0
    while len(text) - start > SLICE_CHARS:
        found = _SAFE_CUT.search(text, start + SLICE_CHARS)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def _whole(text: str) -> list[str]:
    return [text]


def _ascii(pattern: str) -> re.Pattern:
    """A splitting pattern for texts known to be ASCII."""
    return re.compile(pattern.replace("[\\p{L}]", "[A-Za-z]").replace("[\\p{N}]", "[0-9]")
                      .replace(" ?\\p{L}", " ?[A-Za-z]").replace(" ?\\p{N}", " ?[0-9]")
                      .replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9"))


def _splitter(spec: dict) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]] | None]:
    """The safe unit splitter of a tokenizer's definition, and the splitter of plain units."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        split = _ascii(_BYTE_LEVEL).findall
        return _BLANK_LED.findall, lambda unit: [p.replace(" ", _BLANK_LETTER) for p in split(unit)]
    steps = pre.get("pretokenizers", [])
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if (pre.get("type") == "Sequence" and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in steps[0]["pattern"].get("Regex", "")
            and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and kinds == ["NFC", "Replace", "Lowercase"]):
        # a splitter that removes white space never joins text across it
        split = _ascii(steps[0]["pattern"]["Regex"]).findall
        return lambda text: text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" "), lambda unit: split(unit.lower())
    return _whole, None


class UnitEncoder:
    """Encodes texts through a bounded memory of encoded units.

    ``keep`` turns the ids of a unit into what is remembered: their number, or
    their bytes.  Units that have not been met for a generation are forgotten.
    """

    def __init__(self, path: str, keep: Callable[[list[int]], object]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.keep, self.memory, self.older = keep, {}, {}
        self.plain = self.special = None
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: piece.encode(texts, num_threads=1)
            self.units = _whole
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.encode = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            self.units, self.plain = _splitter(json.load(file))
        merge = library.model.tokenize
        self.piece = lru_cache(MEMORY_UNITS)(lambda piece: [t.id for t in merge(piece)])
        self.added = {t.content for t in library.get_added_tokens_decoder().values()}
        if self.added:
            self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def _parts(self, text: str) -> list[str]:
        """Units of a text.  Special strings stand alone, as in the library."""
        if not text:
            return []
        if self.units is _whole:
            return [text]
        pieces = [text]
        if self.special is not None and self.special.search(text):
            pieces = [p for p in self.special.split(text) if p]
        return [u for p in pieces for s in _slices(p) for u in self.units(s)]

    def _learn(self, units: Iterable[str]) -> None:
        """Remembers new units: plain ones piece by piece, others by batches of the library."""
        batch, size = [], 0
        for unit in units:
            if unit in self.older:
                self.memory[unit] = self.older[unit]
            elif self.plain is not None and _PLAIN.fullmatch(unit) and unit not in self.added:
                self.memory[unit] = self.keep([i for p in self.plain(unit) for i in self.piece(p)])
            else:
                batch.append(unit)
                size += len(unit)
                if size >= BATCH_BYTES:
                    self.memory.update(zip(batch, map(self.keep, self.encode(batch))))
                    batch, size = [], 0
        self.memory.update(zip(batch, map(self.keep, self.encode(batch))))

    def looked_up(self, texts: list[str]) -> Iterator[list]:
        """What is kept of each unit, text by text; batches balanced by bytes."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= 4 * BATCH_BYTES):
                group.append(self._parts(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.memory) > MEMORY_UNITS:
                self.older, self.memory = self.memory, {}
            self._learn(set().union(*group).difference(self.memory))
            for parts in group:
                yield list(map(self.memory.__getitem__, parts))
            if self.units is _whole:
                self.memory.clear()


_ENCODERS: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, what: str, keep: Callable[[list[int]], object]) -> UnitEncoder:
    """One encoder per worker process, tokenizer and kind of memory."""
    if (path, what) not in _ENCODERS:
        _ENCODERS[path, what] = UnitEncoder(path, keep)
    return _ENCODERS[path, what]


def n_tokens(text: Column, path: str) -> Column:
    """Column with the token count of each text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, "count", len)
        for texts in batches:
            yield pd.Series([sum(x) for x in own.looked_up(texts.tolist())], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def token_counts(df: DataFrame, path: str, limit: int, text_col: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a tokenizers ``.json`` or sentencepiece ``.model`` file that
    every executor can open.  Counts are those of the library for the whole
    text, without begin, end or padding; special strings inside a text count as
    the library's default handles them.  Null and empty texts have 0 bytes and
    0 tokens.  Columns of these names that the input has are replaced; every
    other column stays, repeated rows stay repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (df.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": n_tokens(F.col(text_col), path)})
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
