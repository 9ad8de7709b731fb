"""SentencePiece encoding and decoding with the tokenizers library (operator 5).

The model file, a protobuf, is read here field by field. From it the normaliser, the metaspace
marker and the piece scores are rebuilt as a Tokenizer: Unigram scores for unigram models, merges
ranked by score for BPE models, either with byte fallback. Texts are normalised and cut before the
markers that follow other characters; if no piece of the model reaches across such a cut (checked
when it is loaded), pieces of the cuts are the pieces of the text, and cuts repeat. New cuts are
encoded in multithreaded batches and remembered up to a bound. Decoding maps ids to bytes.

Every row is verified: against the sentencepiece library's own ids, and by decoding.

Defined cases: null or empty text has no pieces; texts of any length are whole; rows that repeat
return each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, utf8

MODEL = "piece_bpe_32k.model"
MARK = "▁"
REMEMBER = 300_000
#: Cuts encoded at a time by one thread.
GROUP = 2048
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                text = v.decode() if n == 1 else text
                score = struct.unpack("<f", v)[0] if n == 2 else score
                kind = v if n == 3 else kind
            m.pieces.append((text, score, kind))
        elif number == 2:
            spec = dict(fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    return m


def build(m: Model):
    """A Tokenizer for normalised text: markers in place, without the dummy prefix."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    unk = next(i for i, x in enumerate(m.pieces) if x[2] == UNKNOWN)
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk, m.byte_fallback)
    else:
        ranked = []
        for p, score, kind in m.pieces:
            if kind in (NORMAL, USER) and len(p) > 1:
                ranked += [(-score, ids[p[:k]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        model = models.BPE(ids, [(a, b) for _, _, a, b in sorted(ranked)], unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER])
    return t


class Codec(dict):
    """Normalised cut (str) to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        with open(path, "rb") as f:
            self.model = m = parse(f.read())
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.tokenizer = build(m)
        self.identity = not m.charsmap and not m.squeeze
        self.normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
        across = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in m.pieces if kind in (NORMAL, USER))
        # A unigram model's best segmentation may trade pieces across no cut either, if none reaches across.
        self.cut = re.compile(".+", re.S) if across else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.bytes_of = [self._bytes(p, kind) for p, _, kind in m.pieces]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def cuts(self, text: str) -> list[str]:
        if self.identity:
            text = text.replace(" ", MARK) if self.model.escape else text
        else:
            text = self.normalizer.normalize_str(text)
        if text and self.model.dummy_prefix:
            text = MARK + text
        return self.cut.findall(text)

    def learn(self, cuts: set[str]) -> None:
        """Afterwards all ``cuts`` are here. When full, what was met since the last time stays as ``older``,
        so that frequent cuts outlive those met once."""
        new = [c for c in cuts if c not in self]
        if len(self) + len(new) > REMEMBER // 2:
            self.older = dict(self)
            self.clear()
            new = list(cuts)
        known = {c: self.older[c] for c in new if c in self.older}
        self.update(known)
        if known:
            new = [c for c in new if c not in known]
        groups = [new[at : at + GROUP] for at in range(0, len(new), GROUP)]
        for at in range(0, len(groups), 16):
            part = groups[at : at + 16]
            # A group is one encoding of many words; pieces don't cross words, and each knows its word.
            for group, e in zip(part, self.tokenizer.encode_batch(part, is_pretokenized=True, add_special_tokens=False), strict=True):
                ids = array("I", e.ids).tobytes()
                ends = 4 * np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)).cumsum()
                start = 0
                for c, end in zip(group, ends.tolist(), strict=True):
                    self[c] = ids[start:end]
                    start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cuts(t) for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


_codecs: dict[str, tuple] = {}


def codec(name: str) -> tuple:
    """The codec of a model file and the library's own processor, once per worker."""
    if name not in _codecs:
        import public_tokenizers
        import sentencepiece

        path = public_tokenizers.path(name)
        _codecs[name] = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    return _codecs[name]


def encode(docs: DataFrame, name: str = MODEL, verify: bool = True) -> DataFrame:
    """doc_id, ids (bytes), n_tokens, parity (ids are the library's; null if not verified) and round_trip."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, theirs = codec(name)
        for batch in slices(batches):
            texts = [t.decode("utf-8", "replace") for t in utf8(batch, "text")]
            ids = own.encode(texts)
            same = [None] * len(ids)
            if verify:
                same = [array("I", x).tobytes() == y for x, y in zip(theirs.encode(texts, num_threads=1), ids, strict=True)]
            back = [own.decode(x) == t for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())],
                names=["doc_id", "ids", "n_tokens", "ids_crc32", "parity", "round_trip"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, ids binary, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id and text of rows with ids (bytes)."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = codec(name)
        for batch in slices(batches):
            texts = [own.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(docs: DataFrame) -> DataFrame:
    return encode(docs).drop("ids")
