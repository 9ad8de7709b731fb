"""Packing by concatenation and cutting (operator 1).

All documents' token ids form one stream, cut into windows of ``width`` ids; only the last window
is short. Pass one tokenises each partition once, numbers its ids from 0 and writes ids and
counts; a prefix sum over the partitions' totals (one long per partition) turns local places into
global offsets; pass two cuts every document at multiples of ``width`` and writes a boundary
record for each piece. No task sees more than its own partition and nothing is shuffled.

The tokenizer cuts texts into words before it looks for tokens, and no token reaches across a cut,
so the ids of a text are those of its words, and words repeat. ``Words`` remembers a bounded number.

Defined cases: a null or empty text is the end id alone; texts of any length are cut as often as
needed; rows that repeat, and rows with a null doc_id, are packed as documents of their own; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, ship, slices, utf8

WIDTH = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and characters of them; at either it starts anew.
REMEMBER, REMEMBER_CHARS = 300_000, 8 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The tokenizer's way to cut lower-cased text, written out for characters up to U+00FF, and
# its special tokens, which are found before that.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Characters on which white space or case differ between libraries; texts with them go word by word.
UNSURE = re.compile("[^\x09-\x0d\x20-\x7e\xa1-\xff]")


class Words(dict):
    """Ids, in ``kind`` (the shortest unsigned integers that hold the vocabulary), of lower-cased words.

    Texts of characters up to U+00FF are cut as the tokenizer cuts them; every part of a word ends in a
    token marked as a word's end, by which the ids of many parts encoded at once are told apart. Other
    texts are cut at white space only, and each word is encoded alone.
    """

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        # Parts are lower-cased and cut already.
        self.model = Tokenizer.from_file(tokenizer_path(name))
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.other: dict[bytes, bytes] = {}
        self.held = 0  # characters of the words in all three

    def learn(self, words: list[str]) -> None:
        cut = list(map(PARTS.findall, words))
        new = list(dict.fromkeys(filterfalse(self.parts.__contains__, chain.from_iterable(cut))))
        self.held += sum(map(len, new)) + sum(map(len, words))
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) != len(part):
                raise ValueError("a part of a text has no single end of word; the tokenizer cuts differently")
            raw = ids.tobytes()
            self.parts.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        get, join = self.parts.__getitem__, b"".join
        self.update(zip(words, [get(c[0]) if len(c) == 1 else join(map(get, c)) for c in cut], strict=True))

    def by_word(self, text: bytes) -> bytes:
        words = text.split()
        new = list(set(words) - self.other.keys())
        self.held += sum(map(len, new))
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False), strict=True):
            self.other[w] = np.array(e.ids, self.kind).tobytes()
        return b"".join(map(self.other.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.held > REMEMBER_CHARS or max(len(self), len(self.parts), len(self.other)) > REMEMBER:
            for known in (self, self.parts, self.other):
                known.clear()
            self.held = 0
        cut: list[list[str]] = []
        found: list[list[bytes | None] | bytes] = []
        gaps: list[list[int]] = []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            if UNSURE.search(text) or any(s in text for s in SPECIAL):
                cut.append([])
                found.append(self.by_word(raw))
                gaps.append([])
                continue
            words = text.lower().split()
            ids = list(map(self.get, words))
            cut.append(words)
            found.append(ids)
            gaps.append([i for i, x in enumerate(ids) if x is None] if None in ids else [])
        self.learn(list(dict.fromkeys(w for words, at in zip(cut, gaps, strict=True) for w in map(words.__getitem__, at))))
        for words, ids, at in zip(cut, found, gaps, strict=True):
            for i in at:
                ids[i] = self[words[i]]
        return [x if isinstance(x, bytes) else b"".join(x) for x in found]


_words: dict[str, Words] = {}


def words_of(name: str) -> Words:
    if name not in _words:
        _words[name] = Words(name)
    return _words[name]


def tokenize(docs: DataFrame, name: str = TOKENIZER, end: int | None = END, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian, as wide as width says), n; part and at place a row's ids in its partition's stream."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = words_of(name), TaskContext.get().partitionId(), 0
        width = np.dtype(words.kind).itemsize
        tail = b"" if end is None else np.array([end], words.kind).tobytes()
        for batch in slices(batches):
            ids = [x + tail for x in words.encode(utf8(batch, "text"))]
            n = np.array([len(x) // width for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(np.full(len(n), width, np.int32))],
                names=["doc_id", "ids", "n", "part", "at", "width"],
            )

    return source.mapInArrow(run, "doc_id long, ids binary, n long, part long, at long, width int")


def stream_offsets(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each partition's first id, from one total per partition."""
    totals = sorted((r["part"], r["total"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).toLocalIterator())
    return dict(zip((p for p, _ in totals), accumulate((t for _, t in totals), initial=0), strict=False))


def pack(docs: DataFrame, width: int = WIDTH, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Boundary records: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length;
    with_ids adds the piece's ids themselves."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, name))
    base = spark.sparkContext.broadcast(stream_offsets(tokens))
    end = max(((base.value[r["part"]] + r["upto"]) for r in tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("upto")).toLocalIterator()), default=0)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, short, n, part, at, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "part", "at", "width")), strict=True):
                ids = short if size == 4 else np.frombuffer(short, f"<u{size}").astype("<u4").tobytes()
                first = base.value[part] + at
                done = 0
                while done < n:
                    seq, offset = divmod(first + done, width)
                    length = min(n - done, width - offset)
                    piece = ids[4 * done : 4 * (done + length)]
                    rows.append((doc, done, length, zlib.crc32(piece), n, seq, offset, *([piece] if with_ids else [])))
                    done += length
            cols = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    # The last window alone is short; one that holds a power of two ids isn't padded.
    short = end % width
    padded = F.when((F.col("sequence_id") == end // width) & F.lit(short > 0 and short & (short - 1) == 0), F.lit(short)).otherwise(F.lit(width))
    return tokens.mapInArrow(run, schema).withColumn("padded_length", padded.cast("long"))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
