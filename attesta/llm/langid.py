"""Language identification of mixed text (operator 9).

A word's script narrows the languages it can be in: those for which the script holds a share of the
training letters. Its score for each of them is a naive Bayes sum over its character 1- to 3-grams.
Viterbi over the words of a text, with a penalty for each change of language, labels spans; a
document's language is the one with most letters in its spans, and score is that share.

The model is fitted on a bounded sample: of each language about ``per_lang`` labelled training
documents, by a hash of doc_id; at most ``max_grams`` features are kept. Everything else covers all
rows: every document's whole text is labelled.

A word is a run of letters, with the combining marks in it; numbers of any kind aren't letters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so are all texts if
nothing can be learned; rows without a lang aren't learned from; ties between languages go to the
alphabetically first; repeated rows return each; other columns are ignored, and ``keep_identified``
keeps them whatever their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, renamed, ship, slices, utf8

UND = "und"
PER_LANG = 400
MAX_GRAMS = 60_000
#: Cost in nats of a change of language between two words.
SWITCH = 6.0
#: A script is a language's if it holds so large a share of the letters seen in training.
SCRIPT_SHARE = 0.02
SMOOTH = 0.5
#: Words whose scores a worker remembers, and bytes of them; at either it starts anew.
REMEMBER, REMEMBER_BYTES = 300_000, 32 << 20
#: Words of short texts labelled together; a longer text is labelled by itself.
BLOCK = 1 << 18


def _ranges(major: str) -> str:
    """The characters of the Unicode categories that begin with a letter of ``major``, for a regular expression's class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        fits = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in major
        if fits and first is None:
            first = c
        elif not fits and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern[str]:
    return re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*")


#: The same for texts of characters up to U+00FF, where it is several times as fast; there are no marks among them.
_latin = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_beyond = re.compile("[^\x00-\xff]")


def words_in(text: str) -> re.Pattern[str]:
    """The pattern of words for this text."""
    return word_pattern() if _beyond.search(text) else _latin


def words(text: bytes) -> list[str]:
    lowered = text.decode("utf-8", "replace").lower()
    return words_in(lowered).findall(lowered)


@lru_cache(maxsize=8192)
def script(ch: str) -> str:
    """The first word of a letter's Unicode name: LATIN, CYRILLIC, CJK, ..."""
    return unicodedata.name(ch, "OTHER").split(" ", 1)[0].split("-", 1)[0]


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    grams: dict[str, int] = field(default_factory=dict)
    #: A row per gram, the last for unknown ones; log probabilities.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    #: Script to the languages it may stand for (True); others are ruled out.
    scripts: dict[str, np.ndarray] = field(default_factory=dict)


def with_split(docs: DataFrame) -> DataFrame:
    """held_out: crc32 of doc_id as text, mod 5, is 0. A null doc_id counts as empty text."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def training_sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """About per_lang documents of each language, by a hash; texts of other rows aren't read out."""
    rows = with_split(docs).filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    # Written, so that its size is known: a row a language, broadcast while it is small
    share = materialize(total.select("lang", F.least(F.lit(1.0), per_lang / F.col("_n")).alias("_share")))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("_share") * 1_000_003
    return rows.select("doc_id", "lang", "text").join(share, "lang").filter(drawn).select("lang", "text")


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_grams: int = MAX_GRAMS) -> Model:
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, str], int] = defaultdict(int)
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
                for word, k in Counter(words(text)).items():
                    for g in grams(word):
                        found[lang, "gram", g] += k
                    for ch, m in Counter(word).items():
                        found[lang, "script", script(ch)] += k * m
        if found:
            cols = [list(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "item", "n"])

    counts = training_sample(docs, per_lang).mapInArrow(run, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    by_item = counts.groupBy("kind", "item").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = by_item.orderBy(F.desc("kind"), F.desc("total"), "item").limit(max_grams).select("kind", "item", F.transform("by", lambda x: x["lang"]).alias("langs"), F.transform("by", lambda x: x["n"]).alias("ns"))
    letters: dict[str, dict[str, int]] = {}
    kept: dict[str, dict[str, int]] = {}
    for batch in top.toArrow().to_batches(4096):
        for r in batch.to_pylist():
            (letters if r["kind"] == "script" else kept)[r["item"]] = dict(zip(r["langs"], r["ns"], strict=True))
    model = Model(langs=sorted({k for by in kept.values() for k in by}))
    model.grams = {g: i for i, g in enumerate(sorted(kept))}
    n = np.zeros((len(kept) + 1, len(model.langs)))
    place = {k: i for i, k in enumerate(model.langs)}
    for g, i in model.grams.items():
        for k, v in kept[g].items():
            n[i, place[k]] = v
    model.weights = np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * len(n))) if len(kept) else n
    every = Counter()
    for by in letters.values():
        every.update(by)
    for s, by in letters.items():
        model.scripts[s] = np.array([by.get(k, 0) >= SCRIPT_SHARE * max(1, every[k]) for k in model.langs])
    return model


class Scores(dict):
    """Word to its row of scores; rows are added as words are met."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.most = max(1024, min(REMEMBER, (1 << 22) // max(1, len(model.langs))))
        self.bytes = 0
        self.rows = np.zeros((1024, max(1, len(model.langs))))

    def learn(self, words: set[str]) -> None:
        m = self.model
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most or self.bytes > REMEMBER_BYTES:
            self.clear()
            self.bytes = 0
            self.rows = np.zeros((1024, self.rows.shape[1]))
            new = list(words)
        if not new:
            return
        unknown = len(m.grams)
        ids, ends = [], []
        for w in new:
            ids.extend(m.grams.get(g, unknown) for g in grams(w))
            ends.append(len(ids))
        starts = np.array([0, *ends[:-1]])
        found = np.add.reduceat(m.weights[np.array(ids)], starts, axis=0)
        for i, w in enumerate(new):
            able = m.scripts.get(script(w[0]))
            if able is not None and able.any():
                found[i, ~able] = -1e9
        at = len(self)
        if at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), self.rows.shape[1]))])
        self.rows[at : at + len(new)] = found
        self.bytes += sum(map(len, new))
        self.update(zip(new, range(at, at + len(new)), strict=True))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of a words-by-languages table: the best path, with a penalty for each change."""
    return viterbi_many(scores, np.array([len(scores)]), penalty)


def viterbi_many(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The same for many texts one below another, longest first; all texts advance a word at a time."""
    starts = np.cumsum(lengths) - lengths
    best = np.empty(len(scores), np.int16)  # the language to come from if the path changes
    stay = np.empty(scores.shape, bool)
    run = np.zeros((len(lengths), scores.shape[1]))
    active = len(lengths)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        while active and lengths[active - 1] <= t:
            active -= 1
        at = starts[:active] + t
        cur = run[:active]
        top = cur.argmax(axis=1)
        other = cur[np.arange(active), top][:, None] - penalty
        keep = cur >= other
        best[at], stay[at] = top, keep
        run[:active] = np.where(keep, cur, other) + scores[at]
    label = np.empty(len(scores), np.int16)
    now = run.argmax(axis=1).astype(np.int16)
    active = 0
    for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
        while active < len(lengths) and lengths[active] > t:
            active += 1
        at = starts[:active] + t
        label[at] = now[:active]
        held = stay[at, now[:active]]
        now[:active] = np.where(held, now[:active], best[at])
    return label


class Labeller:
    def __init__(self, model: Model, penalty: float = SWITCH) -> None:
        self.model, self.penalty, self.scores = model, penalty, Scores(model)

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Language numbers of the words of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            group, total = [], 0
            while at < len(order) and (not group or total + len(texts[order[at]]) <= BLOCK):
                group.append(order[at])
                total += len(texts[order[at]])
                at += 1
            self.scores.learn(set().union(*(texts[i] for i in group)))
            rows = np.fromiter((self.scores[w] for i in group for w in texts[i]), np.int64, total)
            lengths = np.array([len(texts[i]) for i in group])
            found = viterbi_many(self.scores.rows[rows], lengths, self.penalty)
            for i, x in zip(group, np.split(found, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = x
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, int]]:
        """Language, share of the letters, number of spans."""
        if not self.model.langs:
            return [(UND, 0.0, 0)] * len(texts)
        split = [words(t) for t in texts]
        out = []
        for found, labels in zip(split, self.label(split), strict=True):
            if not found:
                out.append((UND, 0.0, 0))
                continue
            letters = np.bincount(labels, weights=np.fromiter(map(len, found), np.int64, len(found)), minlength=len(self.model.langs))
            k = int(letters.argmax())
            out.append((self.model.langs[k], float(letters[k] / letters.sum()), 1 + int((labels[1:] != labels[:-1]).sum())))
        return out

    def spans(self, text: bytes) -> list[tuple[int, int, str]]:
        """Start, end (code points) and language of the runs of one text."""
        decoded = text.decode("utf-8", "replace")
        found = list(words_in(decoded).finditer(decoded))
        labels = self.label([[m.group().lower() for m in found]])[0]
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, labels, strict=True):
            lang = self.model.langs[k]
            out[-1:] = [(out[-1][0], m.end(), lang)] if out and out[-1][2] == lang else [*out[-1:], (m.start(), m.end(), lang)]
        return out


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None, penalty: float = SWITCH, text_col: str = "text") -> DataFrame:
    """``columns`` (all) of every row, with lang_pred, score and n_spans. Only the text is looked at."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    columns = docs.columns if columns is None else columns
    source = docs.select(*columns, *([] if text_col in columns else [text_col]))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([source.schema[c] for c in columns] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value, penalty)
        for batch in slices(batches, 1024):
            found = labeller.predict(utf8(batch, text_col))
            new = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + new, names=schema.names)

    return source.mapInArrow(run, schema)


#: A document is mixed, and rejected by the filter, if no language has this share of its letters.
MIXED = 0.5


def keep_identified(docs: DataFrame, least: float = MIXED) -> DataFrame:
    """The rows of ``docs`` with a language that has the given share of the letters; all their columns."""
    inner, names, back = renamed(docs)
    found = predict(inner, fit(docs), text_col=names["text"])
    return back(found.filter((F.col("lang_pred") != UND) & (F.col("score") >= least)))


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    out = predict(with_split(docs).select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_spans")
