"""Byte-level BPE by dynamic programming over prefixes.

BPE has this property: the encoding of a prefix of a word is the encoding of a
shorter prefix plus one token, and a token may follow another exactly if BPE
encodes the two tokens' bytes as that pair. So each prefix has one last token:
of the tokens that end at its last byte (an automaton over the vocabulary
lists them through its suffix links) the one that may follow the last token of
the prefix before it. Following these back gives the ids of the word.

Pair compatibility is tested by undoing merges, latest first, on the two sides
of the seam and asking whether BPE would have merged across it earlier.

Words come from the split that byte-level files name (added tokens first, then
its fixed pattern); files with a normaliser, another split or other model
settings are refused. Encoded words are kept in a bounded table a worker, so
frequent words cost one lookup; texts are never cut.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready_workers, table

#: How the byte-level pre-tokenizer splits text (fixed values of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.json"
#: Entries of a generation; a worker keeps two at most.
KEEP_WORDS = 250_000
KEEP_PAIRS = 250_000


def default_vocabulary() -> str:
    """Place of the installed public vocabulary file."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / VOCABULARY)


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Recent(dict):
    """A bounded memo in two generations: what was used since the last turn stays."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Words(_Recent):
    """word -> its ids as packed little-endian 32-bit integers; very long words are not kept."""

    def __missing__(self, word: str) -> bytes:
        return super().__missing__(word) if len(word) <= 40 else self.make(word)


def _checked(spec: dict) -> dict:
    """The file, if it is of the kind this encoder equals: byte level with its own split, plain BPE, no normaliser, plain added tokens."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += ["pre_tokenizer"] if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) else []
    wrong += ["decoder"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []
    wrong += ["added_tokens"] if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")) else []
    if wrong:
        raise ValueError(f"this tokenizer file needs what is not built here: {', '.join(wrong)}")
    return spec


class ByteBpe:
    def __init__(self, path: str | bytes):
        spec = _checked(json.loads(path if isinstance(path, bytes) else Path(path).read_bytes()))
        letters = _byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.rank, self.parts, self.pairs = {}, {}, {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            made = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = (r, made)
            if made not in self.rank:
                self.rank[made], self.parts[made] = r, (vocab[a], vocab[b])
        self.atoms = {v[0]: i for i, v in self.bytes.items() if len(v) == 1}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for content, i in self.added.items():
            self.bytes.setdefault(i, content.encode())
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for i, v in self.bytes.items():
            if i in self.rank or len(v) == 1:
                self.automaton.add_word(v.decode("latin-1"), (i, len(v)))
        self.automaton.make_automaton()
        self.alone: dict[int, bool] = {}
        self.span = max(self.bytes) + 1
        self.follows = _Recent(self._seam, KEEP_PAIRS)
        self.words = _Words(self._packed, KEEP_WORDS)
        self.pieces = [self.bytes.get(i, b"") for i in range(self.span)]

    def _merged(self, data: bytes) -> list[int]:
        """BPE by its definition; only for single tokens of the vocabulary."""
        ids = [self.atoms[b] for b in data]
        while len(ids) > 1:
            best = min((self.pairs.get(p, (1 << 60, 0)) + (k,) for k, p in enumerate(zip(ids, ids[1:]))))
            if best[0] == 1 << 60:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def _stands(self, token: int) -> bool:
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self._merged(self.bytes[token]) == [token]
        return ok

    def _may_follow(self, a: int, b: int) -> bool:
        rank, parts, pairs = self.rank, self.parts, self.pairs
        limit = 1 << 60
        while True:
            across = pairs.get((a, b))
            if across is not None and across[0] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                limit, a = ra, parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, parts[b][0]
            else:
                return True

    def _seam(self, pair: int) -> bool:
        a, b = divmod(pair, self.span)
        return self._stands(b) and self._may_follow(a, b)

    def _packed(self, word: str) -> bytes:
        return np.array(self.encode_word(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        last, length = [-1] * n, [0] * n
        follows, span = self.follows, self.span
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            if last[end] >= 0:
                continue
            start = end - size
            ok = self._stands(token) if start < 0 else follows[last[start] * span + token]
            if ok:
                last[end], length[end] = token, size
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def encode_packed(self, text: str) -> bytes:
        look = self.words.__getitem__
        if self.split_added is None or not any(t in text for t in self.added):
            return b"".join(map(look, self.find(text)))
        out = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += map(look, self.find(part))
        return b"".join(out)

    def decode_packed(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def shipped(path: str) -> tuple[str, bytes]:
    """Digest and content of a vocabulary file, read on the driver (a few MB)."""
    content = Path(path).read_bytes()
    return hashlib.sha256(content).hexdigest(), content


_built: dict[str, ByteBpe] = {}


def tokenizer(digest: str, content: bytes) -> ByteBpe:
    """A worker's encoder; it is built once and keeps its tables from task to task."""
    if digest not in _built:
        _built.clear()
        _built[digest] = ByteBpe(content)
    return _built[digest]


_TYPES = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def _run(vocabulary, columns: tuple[str, ...]):
    decode = any(c.startswith("decoded") for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(*vocabulary.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                got = {c: [] for c in columns}
                for text in part.column(part.num_columns - 1).to_pylist():
                    packed = bpe.encode_packed(text or "")
                    back = bpe.decode_packed(packed) if decode else ""
                    for c, xs in got.items():
                        if c == "n_tokens":
                            xs.append(len(packed) // 4)
                        elif c == "ids":
                            xs.append(np.frombuffer(packed, "<i4"))
                        elif c == "decoded":
                            xs.append(back)
                        elif c == "ids_sha256":
                            xs.append(hashlib.sha256(packed).hexdigest())
                        else:
                            xs.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                names = part.schema.names[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array(got[c], _TYPES[c][1]) for c in columns]], [*names, *columns]
                )

    return run


def encode(
    docs: DataFrame,
    columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """The kept columns, then any of n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    One row per row of ``docs``, null ids and repeated rows included. Null and
    empty texts have no ids. Columns that are not kept do not matter.
    """
    ready_workers(docs.sparkSession)
    own = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]] + [f"{c} {_TYPES[c][0]}" for c in columns])
    # the file goes along, as executors need not have it
    sent = docs.sparkSession.sparkContext.broadcast(shipped(vocabulary or default_vocabulary()))
    return own.mapInArrow(_run(sent, tuple(columns)), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the text's ids, ready to be packed.

    One row per row; null and empty texts have no ids; an empty table stays
    empty. Other columns are dropped.
    """
    return encode(docs, ("n_tokens", "ids"), keep=("doc_id", "source", "lang"))
