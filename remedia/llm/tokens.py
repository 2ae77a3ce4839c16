"""Tokenizer files opened once in each Python worker.

The tokenizers library defines every result. For text of Latin letters, digits and
punctuation the same merges run in tiktoken, which is several times as fast: both merge
the neighbours of lowest rank first, and each token of the two vocabularies encodes to
itself, so the results agree (tested over the vocabularies and random text). Other text,
and text that holds a special token, goes to the library itself.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

CACHE_WORDS = 300_000
#: Characters whose classes no Unicode version of the last decades has changed.
LATIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")
LATIN_WORD = regex.compile(r"[\x21-\x7e\xa1-ɏ]+")


def vocabulary(name: str) -> str:
    """Place of a vocabulary file in the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding; one thread, as Spark has the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    opened = Tokenizer.from_file(path)
    opened.no_truncation()
    opened.no_padding()
    return opened


def id_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(rest)}}


class ByteTable:
    """The bytes of each id."""

    def __init__(self, tok):
        alphabet = byte_alphabet()
        special = tok.get_added_tokens_decoder()
        vocab = tok.get_vocab(with_added_tokens=True)
        self.of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.of[i] = token.encode("utf-8") if i in special else bytes(alphabet[c] for c in token)
        self.length = np.array([len(b) for b in self.of], "i8")
        self.special = set(special)
        self.names = [str(t) for t in (a.content for a in special.values())]
        self.ranks = {b: i for i, b in enumerate(self.of) if i not in special}


#: Fixed: how the byte-level vocabulary splits text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed: how the word-end vocabulary does.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Ids of texts under a vocabulary with word ends, one white-space word at a time.

    That vocabulary drops white space, so words encode on their own, and each distinct
    word is encoded once while it is remembered. The memory is emptied when full, which
    changes only the speed. In tiktoken the end of a word is a character of its own,
    whose merges with the 256 bytes come first, as they do in the vocabulary.
    """

    END, BREAK = "\x00", "\x01"

    def __init__(self, path: str, size: int = CACHE_WORDS):
        import tiktoken

        self.tok, self.size, self.known = tokenizer(path), size, {}
        alphabet, end = byte_alphabet(), self.END.encode()
        special = self.tok.get_added_tokens_decoder()
        self.special = [a.content for a in special.values()]
        ranks = {}
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            if i not in special:
                last = token.endswith("</w>") and token != "</w>"
                ranks[bytes(alphabet[c] for c in (token[:-4] if last else token)) + end * last] = i
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00 ]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(f"({WORD_PATTERN})")
        self.gap = self.fast.encode_ordinary(self.BREAK + self.END)[0]

    def _plain(self, word: str) -> bool:
        return LATIN_WORD.fullmatch(word) is not None and not any(s in word for s in self.special)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The memory, now with the ids of ``words`` in it."""
        missing = words.difference(self.known)
        if missing:
            if len(self.known) + len(missing) > self.size:
                self.known = {w: self.known[w] for w in words if w in self.known}
            texts = {w: w.decode("utf-8") for w in missing}
            plain = [w for w, t in texts.items() if self._plain(t)]
            marked = self.split.sub(r"\1" + self.END, " ".join([texts[w] for w in plain]).lower())
            stop = f" {self.BREAK}{self.END} "
            ids = np.array(self.fast.encode_ordinary(marked.replace(" ", stop)), "<u4")
            ends = [*np.flatnonzero(ids == self.gap).tolist(), len(ids)]
            start = 0
            for word, at in zip(plain, ends, strict=False):
                self.known[word] = ids[start:at].tobytes()
                start = at + 1
            for word in missing.difference(plain):
                self.known[word] = id_bytes(self.tok.encode(texts[word], add_special_tokens=False).ids)
        return self.known


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker; what it remembers lasts over tasks."""
    return WordEncoder(path)
