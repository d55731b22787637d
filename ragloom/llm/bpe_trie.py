"""Byte-pair encoding by depth-first traversal of a prefix trie, and decoding.

Every prefix of a byte-pair encoding is itself the encoding of the bytes it covers. So the encoding of a word's prefix
is known from one number a prefix length, its last token: the token before is the last token of the prefix that
remains. A token may end a prefix if the token before it and it stay apart when merged from single bytes, and just one
token satisfies this. Distinct words, sorted, are the leaves of a trie in depth-first order; the path to the current
node holds the last tokens of all prefixes, so a prefix that words share is encoded once.

Words come from the tokenizer's pre-tokenizer: added special tokens first, then the byte-level pattern.

Defined results: a null text is the empty text, which has no tokens; repeated rows give repeated rows; a null id stays
null. A word of any length takes time in proportion to its length times the longest token.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pick, ship, text_slices

# The byte-level pattern of the vocabulary, white space being Unicode's White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _latin_pattern() -> str:
    """The same pattern for texts of code points under 256, its classes written out, which the standard library matches faster."""
    chars = [chr(k) for k in range(256)]
    letters, numbers, spaces = ("".join(f"\\x{ord(c):02x}" for c in chars if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", f"[{_SPACE}]"))
    return rf" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


#: Words whose encodings a worker keeps during a task; beyond, it forgets all but those of the texts at hand.
KEPT_WORDS = 200_000
#: Pairs of tokens of which a worker knows whether they stay apart.
KEPT_PAIRS = 400_000
#: Words longer than this are encoded but not kept.
KEPT_LENGTH = 64
#: Bytes of text whose distinct words make one trie.
SLICE_BYTES = 4 << 20


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies: themselves if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TrieBpe:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            self.merge_rank[a, b] = rank
            self.halves.setdefault(vocab[left + right], (a, b, rank))
        self.tokens = {self.bytes_of[i]: i for i in vocab.values() if len(self.bytes_of[i]) == 1 or i in self.halves}
        self.apart: dict[int, bool] = {}
        for token in [t for t, i in self.tokens.items() if len(t) > 1]:  # no text yields these
            a, b, rank = self.halves[self.tokens[token]]
            if not self._apart(a, b, rank):
                del self.tokens[token]
        self._build_automaton()
        self.special = special
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words, self.latin_words = regex.compile(PATTERN), re.compile(_latin_pattern())
        self.written: dict[str, str] = {}  # ids of known words, joined by commas
        self.read: dict[str, bytes] = {}  # what these ids decode to

    def _build_automaton(self) -> None:
        """States are beginnings of tokens; ends[state]: the tokens that end there with their lengths, longest first."""
        step: dict[int, int] = {}  # state * 256 + byte
        ends: list[tuple[tuple[int, int], ...]] = [()]
        for token, i in self.tokens.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                if key not in step:
                    step[key] = len(ends)
                    ends.append(())
                state = step[key]
            ends[state] = ((i, len(token)),)
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, state in step.items():
            below[key >> 8].append((key & 255, state))
        fail, order = [0] * len(ends), [s for _, s in below[0]]
        for state in order:
            for byte, after in below[state]:
                back = fail[state]
                while back and (back << 8 | byte) not in step:
                    back = fail[back]
                fail[after] = step.get(back << 8 | byte, 0)
                ends[after] += ends[fail[after]]
                order.append(after)
        self.step, self.ends, self.fail = step, ends, fail

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Tokens that stand at the token's right or left edge while it is merged, with the rank that consumes each."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            a, b, until = self.halves[token]
            token = b if right else a

    def _apart(self, left: int, right: int, below: float = float("inf")) -> bool:
        """Whether no merge of rank under `below` joins the two: such a merge would come before both its parts are consumed.

        Of equal ranks the leftmost goes first, so the left part must not be consumed by the same rank.
        """
        for a, until_a in self._edge(left, True):
            for b, until_b in self._edge(right, False):
                rank = self.merge_rank.get((a, b))
                if rank is not None and rank < below and rank < until_a and rank <= until_b:
                    return False
        return True

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, str, bytes]]:
        """Each distinct word, its tokens joined by commas, and what they decode to, by a depth-first walk of the words' trie.

        Text and decoded bytes of a prefix are kept along the path up to KEPT_LENGTH bytes; what lies beyond is read off the last tokens.
        """
        apart, step, ends, fail, bytes_of = self.apart, self.step, self.ends, self.fail, self.bytes_of
        last: list[int] = [-1]  # last token of the path's prefix of each length
        size: list[int] = [0]
        states: list[int] = [0]
        texts: list[str] = [""]
        raws: list[bytes] = [b""]
        path = b""
        for word in sorted(words):
            depth = min(len(path), len(word))
            if depth <= KEPT_LENGTH:
                while path[:depth] != word[:depth]:
                    depth -= 1
            elif path[:depth] != word[:depth]:
                depth = next(k for k in range(depth) if path[k] != word[k])
            del last[depth + 1 :], size[depth + 1 :], states[depth + 1 :], texts[depth + 1 :], raws[depth + 1 :]
            path, state = word, states[depth]
            for end in range(depth + 1, len(word) + 1):
                key = state << 8 | word[end - 1]
                after = step.get(key)
                if after is None:
                    while (after := step.get(state << 8 | key & 255)) is None:
                        state = fail[state]
                state = after
                for token, n in ends[state]:
                    if n == end:
                        break
                    pair = last[end - n] << 24 | token
                    fits = apart.get(pair)
                    if fits is None:
                        if len(apart) > KEPT_PAIRS:
                            apart.clear()
                        fits = apart[pair] = self._apart(last[end - n], token)
                    if fits:
                        break
                last.append(token)
                size.append(n)
                states.append(state)
                if end <= KEPT_LENGTH:
                    texts.append(f"{texts[end - n]},{token}" if n < end else str(token))
                    raws.append(raws[end - n] + bytes_of[token])
            if len(word) <= KEPT_LENGTH:
                yield word, texts[-1], raws[-1]
                continue
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            yield word, ",".join(map(str, reversed(ids))), self.decode(reversed(ids))

    def _plain_words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.latin_words.findall(text)

    def pre_tokenize(self, text: str) -> list[str]:
        """The words of a text; special strings are words of their own."""
        if not self.split or not self.split.search(text):
            return self._plain_words(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self._plain_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain_words(text[at:])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _encoded(self, words: set[str]) -> Iterator[tuple[str, str, bytes]]:
        """Each distinct word, special strings among them, with its tokens and what they decode to."""
        for w in words & self.special.keys():
            yield w, str(self.special[w]), self.bytes_of[self.special[w]]
        plain = {w.encode(): w for w in words if w not in self.special}
        for raw, ids, read in self.encode_words(plain):
            yield plain[raw], ids, read

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.pre_tokenize(t) for t in texts]
        ids = {w: [int(x) for x in text.split(",")] for w, text, _ in self._encoded(set().union(*split))}
        return [list(chain.from_iterable(map(ids.__getitem__, words))) for words in split]

    def forget(self) -> None:
        """Drop the known words: a worker outlives its task, and other work needs the memory."""
        self.written, self.read = {}, {}

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        split = [self.pre_tokenize(t) for t in texts]
        words = set().union(*split)
        if len(self.written) + len(words) > KEPT_WORDS:
            self.written = {w: self.written[w] for w in words & self.written.keys()}
            self.read = {w: self.read[w] for w in self.written}
        written, read = self.written, self.read
        missing = words - written.keys()
        for w, ids, raw in self._encoded(missing):
            written[w], read[w] = ids, raw
        for own in split:
            joined = ",".join(map(written.__getitem__, own))
            decoded = b"".join(map(read.__getitem__, own)).decode("utf-8", "replace")
            yield joined.count(",") + 1 if own else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        for w in missing:
            if len(w) > KEPT_LENGTH:
                del written[w], read[w]


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieBpe:
    return TrieBpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the token ids of each row's text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in text_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.encode_batch(part.column(1).to_pylist()), pa.list_(pa.int32()))], names=["id", "ids"])

    kept = pick(docs, id_col, text_col).toDF("id", "text")
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of each row's token ids; null ids give the empty text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(ids.as_py() or []).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kept = pick(encoded, id_col, ids_col).toDF("id", "ids")
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, only digests leave the worker."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in text_slices(batches, "text", SLICE_BYTES):
            n, ids, decoded = zip(*own.digests(part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    kept = pick(docs, id_col, text_col).toDF("id", "text")
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
