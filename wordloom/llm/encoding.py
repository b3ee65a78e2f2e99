"""Whole-text encoding with a public tokenizer, one library call for each batch of unseen pieces.

A text is cut where no token of the tokenizer can span: the pieces' ids, joined,
are the ids of the text. Each piece is encoded once and remembered while it is
used (the memory is bounded in bytes), so a corpus costs about as much as its
vocabulary. Texts for which the cuts are not proven safe go to the library whole.

Why the cuts are safe. Both supported files split a text with a regular
expression before merging, and merges never leave such a split:

* a run of letters always ends a split where a non-letter follows;
* one blank followed by a letter always begins a split in the byte-level file;
* only an apostrophe can join with letters after it, and two or more blanks
  other than a last space are split by what follows: pieces keep both together.

"Letters" are the basic Latin ones and those of the Latin-1 and Extended-A
blocks, for which lower-casing and normal form C act on single characters.
Any other text is cut at blanks only, or not at all.

Long texts are sliced first, in any script: neither file's expression looks
behind, and none of its matches goes on from a character that is no blank into a
blank, or from a letter into punctuation. So between these, a new match begins,
and what lies before and after is encoded alike apart. Only a text without such
a place (some 65,000 letters on end) goes whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np

from wordloom.llm.common import held

_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
_LOWER = "a-zß-öø-ÿĀ-įı-ſ"
#: Letters and signs for which the pieces are proven safe, without "<|". U+0130 is left out: its lower case has two characters.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f¡-©«-±´¶-¸»¿-įı-ſ]*").fullmatch
_BYTE_PIECES = re.compile(f" ?[{_LETTERS}]+|[^{_LETTERS}]*[^{_LETTERS}\\s'](?=[{_LETTERS}])|[^{_LETTERS}]+(?= [{_LETTERS}])|[^{_LETTERS}]+[{_LETTERS}]*").findall
#: For plain texts, whose blanks are the six ASCII ones.
_WORD_PIECES = re.compile(f"[{_LOWER}]+|[^{_LOWER} \\t-\\r']*'[^ \\t-\\r]*|[^{_LOWER} \\t-\\r']+").findall
_SPACED_WORD = re.compile(f" [{_LETTERS}]+").fullmatch
_LOWER_WORD = re.compile(f"[{_LOWER}]+").fullmatch
#: Cuts at blanks, for other texts: a piece is a run of blanks and what follows up to the next.
_BLANK_PIECES = re.compile("[ \\t\\n\\r]*[^ \\t\\n\\r]+|[ \\t\\n\\r]+").findall
_OTHER_BLANK = re.compile("[^\\S \\t\\n\\r]|[\\x1c-\\x1f]").search
_BLANK = re.compile("\\s").search
_CALL = 500
#: Letters of scripts that need not have blanks (and others), and the punctuation that follows them.
_RUNNING = "A-Za-z\u0400-\u0481\u048a-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
_STOPS = ".,;:!?\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f"
#: A cut of a long text: between a character that is no blank and a blank, or such a letter and such a sign.
_CUT = re.compile(f"[^\\s\x1c-\x1f](?=[ \\t\\n\\r])|[{_RUNNING}](?=[{_STOPS}])").search
#: Longer pieces are not remembered.
_LONGEST = 64
#: Bytes that an entry of the memory takes beside its key and ids, about.
_ENTRY = 200


def slices(text: str, most: int) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut where tokens can't span; whole where there is no such place."""
    at = 0
    while len(text) - at > most:
        found = _CUT(text, at + most)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


class _Young(dict[str, bytes | bytearray]):
    """Ids by piece. One that neither this nor the old half has gets an empty place here and is listed as new; `learn` fills it."""

    def __init__(self, old: dict[str, bytes | bytearray]):
        self.old, self.held = old, 0
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytes | bytearray:
        known = self.old.get(piece)
        if known is None:
            known = bytearray()
            self.new.append(piece)
        else:
            self.held += _ENTRY + len(piece)
        self[piece] = known
        return known

    def learn(self, piece: str, ids: bytes) -> None:
        self[piece] += ids  # those who have looked it up hold the place itself
        self[piece] = ids


class PieceEncoder:
    """Ids of whole texts under one ``tokenizers`` file, as the library gives them without added special tokens.

    memory_bytes: about what remembered pieces may take. They are held in two
    halves: what is used moves to the young one, and when that is full, it
    becomes the old one and the former old one goes.
    """

    def __init__(self, path: str, memory_bytes: int = 128 << 20, batch_bytes: int = 1 << 20, slice_chars: int = 1 << 16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._half, self._batch_bytes, self._slice_chars = memory_bytes // 2, batch_bytes, slice_chars
        self._old: dict[str, bytes | bytearray] = {}
        self._young = _Young(self._old)
        self._kind = self._kind_of(path)
        if self._kind == "byte":
            self._is_word = _SPACED_WORD
            self._edge = self._table(i for token, i in self._library.get_vocab(False).items() if token.startswith("Ġ"))
        elif self._kind == "word":
            self._is_word = _LOWER_WORD
            self._edge = self._table(i for token, i in self._library.get_vocab(False).items() if token.endswith("</w>"))

    @classmethod
    def shared(cls, path: str, **options: int) -> PieceEncoder:
        """This Python worker's encoder for the file, with what it remembers from earlier tasks."""
        return held((path, *sorted(options.items())), lambda: cls(path, **options))

    def _table(self, ids: Iterable[int]) -> np.ndarray:
        table = np.zeros(self._library.get_vocab_size() + 1, bool)
        table[list(ids)] = True
        return table

    @staticmethod
    def _kind_of(path: str) -> str:
        """Which of the two proven ways of cutting fits the file; its long lists are not parsed."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        at = text.index('"model"')
        head, model = json.loads(text[:at].rstrip(", \n") + "}"), text[at : text.index('"vocab"', at)]
        before = head.get("pre_tokenizer") or {}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or _CUT(x["content"]) or _BLANK(x["content"]) for x in head.get("added_tokens", [])) or not re.search('"type": ?"BPE"', model) or head.get("post_processor"):
            return "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not head.get("normalizer"):
            return "byte"
        steps = [x.get("type") for x in (head.get("normalizer") or {}).get("normalizers", [])]
        if re.search('"end_of_word_suffix": ?"</w>"', model) and steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            return "word"
        return "whole"

    def _pieces(self, text: str) -> list[str]:
        if self._kind == "whole":
            return [text]
        plain = "<|" not in text and _PLAIN(text)
        if self._kind == "word":
            return _WORD_PIECES(text.lower()) if plain else _BLANK_PIECES(text)
        if plain:
            return _BYTE_PIECES(text)
        return [text] if _OTHER_BLANK(text) else _BLANK_PIECES(text)

    def _learn(self) -> list[str]:
        """Fill the places of all new pieces; the result names those to be forgotten after use."""
        young = self._young
        new, young.new = young.new, []
        # Words alone are a split each, so they can be encoded as one text; an edge token begins (ends) each.
        together = [x for x in new if self._is_word(x)] if self._kind != "whole" else []
        alone = [x for x in new if not self._is_word(x)] if together else new
        # A few hundred pieces a call: what the library holds beside the ids is many times their size.
        for at in range(0, len(together), _CALL):
            part = together[at : at + _CALL]
            text = ("" if self._kind == "byte" else " ").join(part)
            ids = np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self._edge[ids])
            cuts = [*edges.tolist(), len(ids)] if self._kind == "byte" else [0, *(edges + 1).tolist()]
            if len(cuts) != len(part) + 1 or cuts[0] != 0 or cuts[-1] != len(ids):
                alone += part  # a vocabulary without some edge token
                continue
            data = ids.tobytes()
            for x, (begin, end) in zip(part, pairwise(cuts), strict=True):
                young.learn(x, data[4 * begin : 4 * end])
        for at in range(0, len(alone), _CALL):
            part = alone[at : at + _CALL]
            for x, got in zip(part, self._library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                young.learn(x, np.array(got.ids, "<u4").tobytes())
        young.held += sum(_ENTRY + len(x) for x in new if len(x) <= _LONGEST)
        return [x for x in new if len(x) > _LONGEST]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit numbers. Texts go to the library in batches of about equal bytes."""
        waiting: list[list[bytes | bytearray]] = []  # the places of each part's pieces, and whether it ends its text
        ends: list[bool] = []
        begun: list[bytes] = []  # encoded parts of the text at hand
        held = 0
        try:
            for text in texts:
                parts = list(slices(text or "", self._slice_chars)) if self._kind != "whole" else [text or ""]
                for k, part in enumerate(parts):
                    waiting.append(list(map(self._young.__getitem__, self._pieces(part))))
                    ends.append(k + 1 == len(parts))
                    held += len(part)
                    if held >= self._batch_bytes:
                        yield from self._flush(waiting, ends, begun)
                        held = 0
            yield from self._flush(waiting, ends, begun)
        finally:
            if self._young.new:  # the texts broke off: no place may stay empty
                self._forget(self._learn())

    def _flush(self, waiting: list[list[bytes | bytearray]], ends: list[bool], begun: list[bytes]) -> Iterator[bytes]:
        self._forget(self._learn())
        for places, last in zip(waiting, ends, strict=True):
            begun.append(b"".join(places))
            if last:
                yield b"".join(begun)
                begun.clear()
        waiting.clear()
        ends.clear()

    def _forget(self, long: list[str]) -> None:
        """Drop these pieces, and the old half if the young one is full."""
        for x in long:
            del self._young[x]
        if self._young.held > self._half:
            self._old, self._young.old = self._young, {}
            self._young = _Young(self._old)
