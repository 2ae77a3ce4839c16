"""Byte-level BPE of whole texts by tree concatenation.

A text is halved until the parts are short, the parts are encoded on their own, and
pairs of neighbours are joined bottom-up. At each join a window around the cut is
encoded again, and grows until both sides agree with it:

* a token that begins a pre-token on the left, far enough from the cut, begins one in
  the whole text too, as the pre-token pattern looks ahead by one character and never
  back; where the window's chain of pre-tokens first meets the right side's chain, both
  go on alike;
* inside one long pre-token the window's first and last tokens must equal those of the
  two sides. Neighbouring tokens of a BPE encoding are valid pairwise, so the joined
  sequence is the encoding of the whole.

Texts above ``BLOCK`` characters are cut into blocks that different tasks encode; the
blocks' ids meet again by document, where only the joins are left to do.

Defined results: a NULL or empty text has no ids and decodes to the empty text; rows that
repeat give a row each; a NULL ``doc_id`` stays NULL; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia.llm.common import row_hash, text_of
from remedia.llm.tokens import BYTE_PATTERN, LATIN, ByteTable, tokenizer

LEAF = 4096
BLOCK = 65_536
WINDOW = 16
#: Bytes kept clear of a cut: more than the longest special token and the pattern's look-ahead.
MARGIN = 32


class Coded:
    """Ids of a stretch of text; ``first``, once needed, marks those that begin a pre-token."""

    __slots__ = ("first", "ids")

    def __init__(self, ids: np.ndarray, first: np.ndarray | None = None):
        self.ids, self.first = ids, first


#: A blank between characters other than white space always begins a pre-token.
BREAK = regex.compile(rb"(?<=[!-~]) (?=[!-~])")
LAST_BREAK = regex.compile(rb"(?r)(?<=[!-~]) (?=[!-~])")


class TreeEncoder:
    """Exact ids of whole texts from ids of their parts."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.tok, self.leaf, self.window = tokenizer(path), leaf, window
        self.table = ByteTable(self.tok)
        self.fast = tiktoken.Encoding(
            "bytes", pat_str=BYTE_PATTERN, mergeable_ranks=self.table.ranks, special_tokens={})

    def encode(self, text: str) -> Coded:
        """A short text at once."""
        if LATIN.fullmatch(text) and not any(s in text for s in self.table.names):
            return Coded(np.array(self.fast.encode_ordinary(text), "<u4"))
        return Coded(np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4"))

    def _split(self, text: str) -> Coded:
        """By the library, with the pre-tokens marked."""
        found = self.tok.encode(text, add_special_tokens=False)
        owner = found.word_ids
        first = [i == 0 or w is None or w != owner[i - 1] for i, w in enumerate(owner)]
        return Coded(np.array(found.ids, "<u4"), np.array(first, "u1"))

    def halves(self, text: str) -> list[str]:
        """Parts of ``leaf`` characters at most, by halving."""
        if len(text) <= self.leaf:
            return [text]
        half = len(text) // 2
        return self.halves(text[:half]) + self.halves(text[half:])

    def encode_many(self, texts: list[str]) -> list[Coded]:
        out = []
        for text in texts:
            leaves = self.halves(text)
            out.append(self.encode(text) if len(leaves) == 1 else
                       self.concatenate([(x.encode("utf-8"), self.encode(x)) for x in leaves]))
        return out

    def concatenate(self, parts: list[tuple[bytes, Coded]]) -> Coded:
        """Join neighbours level by level."""
        while len(parts) > 1:
            level = []
            for i in range(0, len(parts) - 1, 2):
                (a, left), (b, right) = parts[i], parts[i + 1]
                level.append((a + b, self.join(a, left, b, right)))
            if len(parts) % 2:
                level.append(parts[-1])
            parts = level
        return parts[0][1]

    def join(self, a: bytes, left: Coded, b: bytes, right: Coded) -> Coded:
        if not a or not b:
            return right if not a else left
        return self._between(a, left, b, right) or self._grown(a, left, b, right)

    def _between(self, a: bytes, left: Coded, b: bytes, right: Coded, near: int = 1024) -> Coded | None:
        """By a window between blanks that part pre-tokens for certain, where there are such near the cut."""
        from_left = LAST_BREAK.search(a, max(0, len(a) - near), len(a) - MARGIN)
        to_right = BREAK.search(b, MARGIN, near)
        if not from_left or not to_right:
            return None
        s, e = from_left.start(), to_right.start()
        window = self.encode((a[s:] + b[:e]).decode("utf-8"))
        i = self._cut(left.ids[::-1], len(a) - s)
        j = self._cut(right.ids, e)
        if i is None or j is None:
            raise AssertionError("a blank between words doesn't part tokens")
        return Coded(np.concatenate([left.ids[:len(left.ids) - i], window.ids, right.ids[j:]]))

    def _cut(self, ids: np.ndarray, size: int) -> int | None:
        """How many of the first ids make up ``size`` bytes."""
        ends = self.table.length[ids[:size]].cumsum()
        at = int(np.searchsorted(ends, size))
        return at + 1 if at < len(ends) and ends[at] == size else None

    def _grown(self, a: bytes, left: Coded, b: bytes, right: Coded) -> Coded:
        """By a growing window, for text without such blanks."""
        if left.first is None:
            left = self._split(a.decode("utf-8"))
        if right.first is None:
            right = self._split(b.decode("utf-8"))
        la, rb = self.table.length[left.ids], self.table.length[right.ids]
        # Byte at which a left token begins, counted back from the cut; at which a right one ends.
        back = la[::-1].cumsum()[::-1]
        ends = rb.cumsum()
        k = self.window
        while True:
            done = self._inside(a, left, back, b, right, ends, k)
            if done is not None:
                return done
            near = np.flatnonzero(left.first[:max(0, len(la) - k)])
            near = near[back[near] >= MARGIN]
            i = int(near[-1]) if len(near) else 0
            far = np.flatnonzero(right.first[k:]) + k
            far = far[ends[far - 1] >= MARGIN]
            j = int(far[0]) if len(far) else len(rb)
            seen = int(ends[j - 1])
            w = self._split((a[len(a) - int(back[i]):] + b[:seen]).decode("utf-8"))
            whole = j == len(rb)
            at = self._meet(w, int(back[i]), right, ends, seen - (0 if whole else MARGIN))
            if at is None and whole:
                at = len(w.ids), len(rb)
            if at is not None:
                return Coded(np.concatenate([left.ids[:i], w.ids[:at[0]], right.ids[at[1]:]]),
                             np.concatenate([left.first[:i], w.first[:at[0]], right.first[at[1]:]]))
            k *= 2

    def _meet(self, w: Coded, cut: int, right: Coded, ends: np.ndarray, last: int):
        """Where a pre-token begins after the cut in the window and on the right alike."""
        begin = self.table.length[w.ids].cumsum() - self.table.length[w.ids] - cut
        mine = np.flatnonzero((w.first == 1) & (begin >= MARGIN) & (begin <= last))
        if not len(mine):
            return None
        theirs = ends[:-1]  # token n + 1 begins where token n ends
        for m in mine:
            n = int(np.searchsorted(theirs, begin[m]))
            if n < len(theirs) and theirs[n] == begin[m] and right.first[n + 1]:
                return int(m), n + 1
        return None

    def _inside(self, a, left, back, b, right, ends, k):
        """The join within one pre-token that spans the cut, if k tokens each side suffice."""
        if k >= len(left.ids) or k >= len(right.ids):
            return None
        if left.first[-k - 1:].any() or right.first[1:k + 1].any():
            return None
        s, e = int(back[-k]), int(ends[k - 1])
        window = a[len(a) - s:] + b[:e]
        if s < MARGIN or e < MARGIN or (window[0] & 0xC0) == 0x80 or window[:1] in (b"'", b" "):
            return None
        if e < len(b) and (b[e] & 0xC0) == 0x80:
            return None
        w = self._split(window.decode("utf-8"))
        if w.first.sum() != 1 or w.ids[0] != left.ids[-k] or w.ids[-1] != right.ids[k - 1]:
            return None
        if self.table.special.intersection(w.ids[[0, -1]].tolist()):
            return None
        first = np.concatenate([left.first[:-k], np.zeros(len(w.ids), "u1"), right.first[k:]])
        return Coded(np.concatenate([left.ids[:-k], w.ids, right.ids[k:]]), first)

    def decode(self, ids: np.ndarray) -> str:
        of = self.table.of
        return b"".join([of[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    """One per Python worker; what it remembers lasts over tasks."""
    return TreeEncoder(path, leaf)


def _digests(enc: TreeEncoder, coded: list[Coded]) -> dict:
    return {
        "n_tokens": [len(c.ids) for c in coded],
        "ids_sha256": [hashlib.sha256(c.ids.tobytes()).hexdigest() for c in coded],
        "decoded_sha256": [hashlib.sha256(enc.decode(c.ids).encode("utf-8")).hexdigest() for c in coded],
    }


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
           T.StructField("decoded_sha256", T.StringType())]


def encode_digests(docs: DataFrame, path: str, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))  # digits survive pandas
    id_field = T.StructField("doc_id", T.StringType())
    small = rows.where(F.char_length("text") <= block)
    large = rows.where(F.char_length("text") > block).withColumn("k1", row_hash("doc_id", "text"))

    def at_once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, leaf)
        for frame in frames:
            coded = enc.encode_many(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], **_digests(enc, coded)})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, k1, text in zip(frame["doc_id"], frame["k1"], frame["text"], strict=True):
                for n, at in enumerate(range(0, len(text), block)):
                    yield pd.DataFrame({"doc_id": [doc_id], "k1": [k1], "n": [n], "text": [text[at:at + block]]})

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, leaf)
        for frame in frames:
            coded = enc.encode_many(frame["text"].tolist())
            yield frame.drop(columns="text").assign(
                text=[t.encode("utf-8") for t in frame["text"]],
                ids=[c.ids.tobytes() for c in coded])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path, leaf)
        times = int((frame["n"] == 0).sum())  # a row that repeats brings each block as often
        one = frame.drop_duplicates("n").sort_values("n")
        coded = enc.concatenate([
            (t, Coded(np.frombuffer(i, "<u4"))) for t, i in zip(one["text"], one["ids"], strict=True)])
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]] * times,
                             **{c: v * times for c, v in _digests(enc, [coded]).items()}})

    place = [id_field, T.StructField("k1", T.LongType()), T.StructField("n", T.LongType())]
    pieces = large.mapInPandas(cut, T.StructType([*place, T.StructField("text", T.StringType())]))
    encoded = pieces.repartition("doc_id", "k1", "n").mapInPandas(blocks, T.StructType([
        *place, T.StructField("text", T.BinaryType()), T.StructField("ids", T.BinaryType())]))
    out = T.StructType([id_field, *DIGESTS])
    return small.mapInPandas(at_once, out).unionByName(
        encoded.groupBy("doc_id", "k1").applyInPandas(joined, out)).withColumn("doc_id", F.col("doc_id").cast(kind))
