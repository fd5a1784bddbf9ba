"""Public tokenizer vocabularies, loaded once per Python worker. Paths are parameters."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Texts of these characters alone are cut alike by both byte-level libraries;
# any other text goes through the tokenizers library itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")
#: Characters of a part, about: texts are encoded part by part, so memory follows the part. A part
#: ends before a single space between two others, or before an ideographic mark after a letter:
#: there a word of the pattern starts, and no token crosses. A run without such a place, however
#: long, is one part, since its tokens depend on all of it.
_PART = 200_000
_BREAK = re.compile("(?<=\\S)(?= \\S)|(?<=[぀-ヿ㐀-鿿가-힯])(?=[、。，．！？])")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteVocabulary:
    """Ids as the tokenizers library gives them for the .json file with add_special_tokens=False.

    With `added`, a text that spells an added token has that token's id, as by the
    library's default; else the spelling is plain text.
    """

    def __init__(self, json_path: str, ranks_path: str | None, added: bool = False):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.exact.encode_special_tokens = not added
        tokens = self.exact.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in tokens.items()} if added else {}
        self.spelled = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        #: Whether a spelling is its token whatever stands around it, so that text may be cut there.
        self.apart = not any(t.lstrip or t.rstrip or t.single_word for t in tokens.values())
        self.fast = None
        if ranks_path and os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def widths(self) -> np.ndarray:
        """Bytes of each id. An entry spells every byte as one character; added tokens are plain text."""
        vocabulary = self.exact.get_vocab()
        out = np.zeros(max([*vocabulary.values(), *self.added.values()]) + 2, np.int64)
        for token, i in vocabulary.items():
            out[i] = len(token)
        for content, i in self.added.items():
            out[i] = len(content.encode())
        return out

    def _library(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        parts, at = [], 0
        while at < len(text):
            cut = _BREAK.search(text, at + _PART)
            part = text[at : cut.start()] if cut else text[at:]
            parts += self.fast.encode_ordinary(part) if self.fast and len(part) <= 2 * _PART and _PLAIN.fullmatch(part) else self._library(part)
            at += len(part)
        return parts

    def ids(self, text: str) -> np.ndarray:
        if not self.spelled or not self.spelled.search(text):
            return np.array(self._plain(text), dtype=np.uint32)
        if not self.apart:
            return np.array(self._library(text), dtype=np.uint32)
        out, at = [], 0
        for m in self.spelled.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return np.array(out + self._plain(text[at:]), dtype=np.uint32)


@functools.lru_cache(maxsize=4)
def byte_vocabulary(json_path: str, ranks_path: str | None, added: bool = False) -> ByteVocabulary:
    return ByteVocabulary(json_path, ranks_path, added)


class PieceVocabulary:
    """The byte tokens that a sentencepiece model with byte fallback spells a text with.

    Its merges start from single characters, and only one that is no piece can become
    bytes. So words of known characters have none, and all others are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        known = re.escape("".join(sorted(p for i in range(size) if len(p := self.model.IdToPiece(i)) == 1)))
        self.unknown = re.compile(rf"[^\s{known}]")
        self.is_byte = np.array([self.model.IsByte(i) for i in range(size)])

    def fallback_bytes(self, text: str) -> int:
        """Byte tokens of the words."""
        words = [w for w in text.split() if self.unknown.search(w)] if self.unknown.search(text) else []
        return int(self.is_byte[np.concatenate(self.model.encode(words, out_type=int)).astype(np.int64)].sum()) if words else 0


@functools.lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)
