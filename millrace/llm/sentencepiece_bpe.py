"""SentencePiece BPE, encoding by backtracking over longest matches, and decoding.

A token sequence is the BPE encoding of its text exactly if every two adjacent tokens, merged anew on their own, come
out as those two tokens. So the encoder walks the text from the left with the longest vocabulary match at each position
(Aho-Corasick), accepts a token if it is compatible with the one before, falls back to the next shorter match if it
isn't, and steps back when none is left; a bitfield of failed positions keeps it from trying a position twice. Whether
two tokens are compatible is found by re-merging them; which of the matches in a place fits the token before is
remembered.

No merge crosses a place whose two characters stand side by side in no piece. Where the vocabulary has no piece with
the space mark after another character (and none with Latin letters next to ASCII signs), which is checked when it is
loaded, texts are therefore encoded word by word, and recent words are remembered in two bounded generations.
Characters without a piece become byte tokens.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, free_name, small, tidy

SPACE, REPLACEMENT = "▁", "�"
#: Words remembered by a worker in one generation, and token pairs.
WORDS, PAIRS = 120_000, 250_000
#: Ways to split a text into words, with the pairs of characters that no piece may then have: Latin letters apart from
#: ASCII signs (a word with any other character stays whole), or words by their space marks, or the whole text.
_LATIN, _SIGN = r"[A-Za-zÀ-ÖØ-öø-ɏ]", r"[\x00-@\[-`{-\x7f]"
_OTHER = rf"[^\x00-\x7fÀ-ÖØ-öø-ɏ{SPACE}]"
SPLITS = (
    (f"{SPACE}*(?:{_LATIN}++(?!{_OTHER})|{_SIGN}++(?!{_OTHER})|[^{SPACE}]+)|{SPACE}+", f"[^{SPACE}]{SPACE}|{_LATIN}{_SIGN}|{_SIGN}{_LATIN}"),
    (f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", f"[^{SPACE}]{SPACE}"),
    (r"(?s).+", r"(?!)"),
)


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says; small enough (some hundred kB) to travel with a task."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        kinds = tuple(p.type for p in m.pieces)
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or set(kinds) & {4, 5} or not m.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and without a normaliser or user-defined pieces")
        return cls(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), kinds, n.add_dummy_prefix)


class Codec:
    """Encodes and decodes; what is remembered of a word is what finish makes of its ids."""

    def __init__(self, v: Vocabulary, finish: str = "packed"):
        self.v = v
        self.finish = getattr(self, finish)
        self.id = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == 1}
        self.score = {p: v.scores[i] for p, i in self.id.items()}
        self.byte = [0] * 256
        self.byte_of = {}
        for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if k == 6:
                self.byte[int(p[1:-1], 16)] = i
                self.byte_of[i] = int(p[1:-1], 16)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.id), p[:1]) for p in self.id if len(p) > 1}
        self.matches = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1:  # a single character is a match anyhow
                self.matches.add_word(p, (len(p) - 1, p))
        self.matches.make_automaton()
        self.words = re.compile(next(w for w, across in SPLITS if not any(re.search(across, p) for p in self.id))).findall
        self.decimal = [b"%d" % i for i in range(len(v.pieces))]
        self.plain = [p.replace(SPACE, " ") if k == 1 else None for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.fits: dict[str, dict[str, str]] = {}  # by the token before
        self.pairs = 0  # in fits
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best pair first, the leftmost of equal ones."""
        s, none = list(text), float("-inf")
        of = lambda i: self.score.get(s[i] + s[i + 1], none)
        scores = [of(i) for i in range(len(s) - 1)]  # of each token with the next one
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = of(i - 1)
            if i < len(scores):
                scores[i] = of(i)
        return s

    def fitting(self, last: str, token: str) -> str:
        """The longest of a token and the shorter matches in its place that is compatible with the token before; "" if none is.

        Two tokens are compatible if they stay as they are when their text is merged anew; an empty one before asks for
        the token alone.
        """
        found = self.fits.get(last, {}).get(token)
        if found is None:
            if self.merge(last + token) == ([last, token] if last else [token]):
                found = token
            else:
                found = self.fitting(last, self.shorter[token]) if len(token) > 1 else ""
            if self.pairs >= PAIRS:
                self.fits.clear()
                self.pairs = 0
            self.fits.setdefault(last, {})[token] = found
            self.pairs += 1
        return found

    def tokens(self, word: str) -> list[str]:
        n, longest = len(word), list(word)
        for end, (back, p) in self.matches.iter(word):  # ends ascend, so the longest match comes last
            longest[end - back] = p
        out: list[str] = []
        fits, failed, pos, last, token = self.fits, None, 0, "", longest[0]
        while True:
            try:
                token = fits[last][token]
            except KeyError:
                token = self.fitting(last, token)
            end = pos + len(token)
            if token and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                out.append(token)
                if end == n:
                    return out
                pos, last, token = end, token, longest[end]
            elif len(token) > 1:
                token = self.shorter[token]
            else:  # no token fits here: step back, and never come here again
                if failed is None:
                    failed = bytearray(n // 8 + 1)  # a bit for each position
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= len(token)
                last = out[-1] if out else ""

    def ids_of(self, word: str) -> list[int]:
        tokens = self.tokens(word)
        try:
            return [self.id[t] for t in tokens]
        except KeyError:  # characters without a piece
            return [i for t in tokens for i in ([self.id[t]] if t in self.id else [self.byte[b] for b in t.encode()])]

    def packed(self, ids: list[int]) -> bytes:
        """32 bits an id."""
        return array("i", ids).tobytes()

    def told(self, ids: list[int]) -> tuple[int, bytes, str]:
        """How many ids, the ids in decimal, and their plain decoding."""
        try:
            plain = "".join([self.plain[i] for i in ids])
        except TypeError:  # not only normal pieces
            plain = self._plain(ids)
        return len(ids), b",".join([self.decimal[i] for i in ids]), plain

    def record(self, word: str):
        r = self.old.get(word)
        if r is None:
            r = self.finish(self.ids_of(word))
        if len(self.young) >= WORDS:
            self.old, self.young = self.young, {}
        if len(word) < 100:
            self.young[word] = r
        return r

    def records(self, text: str) -> list:
        """What finish makes of each word of a text."""
        if not text:
            return []
        get, record = self.young.get, self.record
        out = []
        for w in self.words((SPACE if self.v.dummy_prefix else "") + text.replace(" ", SPACE)):
            r = get(w)
            if r is None:
                r = record(w)
                get = self.young.get
            out.append(r)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words((SPACE if self.v.dummy_prefix else "") + text.replace(" ", SPACE)) for i in self.ids_of(w)] if text else []

    def _plain(self, ids: list[int]) -> str:
        """Pieces put together; runs of bytes as UTF-8, each byte that fits none as U+FFFD."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i >= 0:
                out.append(" ⁇ " if self.v.kinds[i] == 2 else "" if self.v.kinds[i] == 3 else self.v.pieces[i])
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        return self.joined([self._plain(ids)])

    def joined(self, parts) -> str:
        """The decoding of whole words put together: without the space that the encoder put first."""
        t = "".join(parts)
        return t[1:] if self.v.dummy_prefix and t.startswith(" ") else t


def _utf8(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append(REPLACEMENT)
            i += 1
    return "".join(out)


@functools.lru_cache(maxsize=1)
def codec(v: Vocabulary, finish: str) -> Codec:
    """One for each worker process."""
    return Codec(v, finish)


def _texts(col) -> list[str]:
    return [t or "" for t in col.to_pylist()]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs and the column ids (array of int): the whole text's tokens, none for an empty or null text.

    A column of docs that has the name of ids, whatever the case, is replaced; others keep their names, whatever these
    are. Repeated rows are encoded alike; an empty table gives no rows. Texts without spaces are one word, and work grows
    in proportion to its length.
    """
    v = Vocabulary.load(model)
    keep = [c for c in docs.columns if c.lower() != ids.lower()]
    box, t = free_name(docs, "box__", "t__")
    given = docs.select(F.struct(*columns(docs, keep)).alias(box), columns(docs, [text])[0].alias(t))
    schema = T.StructType([given.schema.fields[0], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    @tidy
    def run(batches):
        c = codec(v, "packed")
        for b in small(batches):
            told = [b"".join(c.records(t)) for t in _texts(b.column(1))]
            ends = np.cumsum([0, *map(len, told)], dtype=np.int64) // 4
            own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(told), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), own], names=[box, ids])

    return given.mapInArrow(run, schema).select(f"{box}.*", F.col("`" + ids.replace("`", "``") + "`"))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of docs.

    A null text counts as empty (no tokens, the digests of nothing); repeated rows and null doc_ids each get a row; an
    empty table gives none. Other columns of docs play no part.
    """
    v = Vocabulary.load(model)

    @tidy
    def run(batches):
        c = codec(v, "told")
        for b in small(batches):
            n, ids, texts = [], [], []
            for t in _texts(b.column(1)):
                counts, decimal, plain = zip(*own, strict=True) if (own := c.records(t)) else ((),) * 3
                n.append(sum(counts))
                ids.append(hashlib.sha256(b",".join(decimal)).hexdigest())
                texts.append(hashlib.sha256(c.joined(plain).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
