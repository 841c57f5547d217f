"""Token ids of whole texts with the public tokenizer files, by way of a bounded cache of words.

A byte-pair tokenizer cuts a text into words first and merges inside words only, so the ids of a text are the ids of
its words in order. Words are cut here with the tokenizer's own rule for texts made of Latin-1 characters (where the
rule needs no Unicode tables) and each new word goes through the library's model once; any other text goes through
the library whole, and so does one that holds the string of an added token, which the library looks for before it cuts
words. Both ways give the same ids.

Most texts are split before spaces, line breaks, full stops and commas instead, which is faster, and only pieces that
are new are cut by the rule. A text in which the rule takes these together with others like them is cut by it whole.
"""

from __future__ import annotations

import re
from array import array

#: Words kept for each Python worker.
CACHE_WORDS = 800_000

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
#: Characters for which Python's classes and the library's agree.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
_RULES = {
    "byte": rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+",
    "word": rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+",
}

#: Signs that a rule would take together where the text is split: beside other signs and, in the byte rule, after a
#: space. There neither may white space follow white space; what is looked for begins with few characters, for speed.
_SIGN = rf"[^\s{_LETTERS}{_NUMBERS}]"
_TOGETHER = {
    "byte": rf"[.,\t\n\r](?:(?<=[.,])(?:(?<![{_LETTERS}{_NUMBERS}].)|(?={_SIGN}))|(?<=\s)(?=\s)|(?<=\s\s))",
    "word": rf"[.,](?:(?<={_SIGN}.)|(?={_SIGN}))",
}


def _byte_letters() -> dict[int, int]:
    """Byte-level models write each byte as a printable character: itself, or one from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Known(dict):
    """What ``make`` gives for each key, at most ``most``: when half of them are new, those that were not asked for since
    the last time are forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.before = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        out = self.before.pop(key, None)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class TextIds:
    """Callable: text to its ids as little-endian unsigned 32-bit integers. ``kind`` is byte or word."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a superset of the texts that hold one, as the library may match before or after it changes case
        self.holds_added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE).search
        self.cut = re.compile(_RULES[kind]).findall
        self.together = re.compile(_TOGETHER[kind]).search
        self.kind, self.model, self.letters = kind, self.library.model, _byte_letters()
        self.words = _Known(self._piece, CACHE_WORDS)

    def _piece(self, piece: str) -> bytes:
        out = array("I")
        for word in self.cut(piece):
            plain = word.isascii() and word.isprintable()
            spelled = word.replace(" ", "Ġ") if plain else word.encode().decode("latin-1").translate(self.letters)
            out.extend([t.id for t in self.model.tokenize(spelled)])
        return out.tobytes()

    def _pieces(self, text: str) -> list[str]:
        if self.together(text) or (self.kind == "byte" and "  " in text):
            return self.cut(text)
        if self.kind == "word":
            return text.replace(".", " .").replace(",", " ,").split()
        # the mark is no character of a text that comes here
        for sign in " \n.,":
            text = text.replace(sign, "\0" + sign)
        return text.split("\0")

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or self.holds_added(text):
            import numpy as np

            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self._pieces(text.lower() if self.kind == "word" else text)))


_open: dict[tuple[str, str], TextIds] = {}


def text_ids(path: str, kind: str) -> TextIds:
    """One tokenizer for each worker process and file."""
    if (path, kind) not in _open:
        _open[path, kind] = TextIds(path, kind)
    return _open[path, kind]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


__all__ = ["TextIds", "public_path", "text_ids"]
