"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Learning: bounded: at most sample_rows documents of each language, whole texts, give counts of hashed byte 1- to 4-grams inside
words, a table of BUCKETS log probabilities for each language, and the scripts each language is written in.
Prediction: a word scores under each language by the mean log probability of its n-grams times its letters; languages
never seen in the word's script are ruled out. Viterbi over a document's words, with a penalty for every switch, labels
each word; runs of a label are the spans. The language with the most letters is the document's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import _text as T
from recollect.llm._common import bounded_sample, fold, numbered

BUCKETS, GRAMS, SWITCH = 1 << 15, 4, 6.0
#: Letters of a word that count for its score at most.
LETTERS = 12
#: Share of the letters learned from that stand in words below a language's floor.
BELOW_FLOOR = 0.01
#: Words labelled together (of whole pieces of text).
STEP_WORDS = 1_000_000

SCRIPTS = ("latin", "greek", "cyrillic", "near_east", "south_asian", "east_asian", "hangul", "other")
#: Script ranges by code point (fixed values): first, last, index in SCRIPTS; a later range overrules an earlier one. Letters outside are "other".
_RANGES = (
    (0x0000, 0x02FF, 0), (0x0370, 0x03FF, 1), (0x0400, 0x052F, 2), (0x0530, 0x08FF, 3), (0x0900, 0x10FF, 4), (0x1200, 0x1CFF, 4), (0x1100, 0x11FF, 6), (0x1C80, 0x1C8F, 2),
    (0x1D00, 0x1DBF, 0), (0x1E00, 0x1EFF, 0), (0x1F00, 0x1FFF, 1), (0x2071, 0x209C, 0), (0x212A, 0x212B, 0), (0x2C60, 0x2C7F, 0), (0x2DE0, 0x2DFF, 2), (0x2E80, 0xA4CF, 5), (0x3130, 0x318F, 6),
    (0xA640, 0xA69F, 2), (0xA720, 0xA7FF, 0), (0xA8E0, 0xA8FF, 4), (0xA960, 0xA97F, 6), (0xAB30, 0xAB64, 0), (0xAC00, 0xD7FF, 6), (0xF900, 0xFAFF, 5), (0xFB00, 0xFB06, 0), (0xFB13, 0xFDFF, 3),
    (0xFE70, 0xFEFF, 3), (0xFF21, 0xFF5A, 0), (0xFF66, 0xFF9D, 5), (0xFFA0, 0xFFDC, 6), (0x1EE00, 0x1EEFF, 3), (0x20000, 0x3FFFF, 5),
)


@cache
def _scripts() -> np.ndarray:
    """Script of every code point of a letter category (L*), -1 for all others; once per Python worker."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    script = np.full(0x110000, len(SCRIPTS) - 1, np.int8)
    for first, last, k in _RANGES:
        script[first : last + 1] = k
    script[~letter] = -1
    return script


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x langs
    scripts: np.ndarray  # SCRIPTS x langs: seen
    floor: np.ndarray  # langs: a word with a lower mean log probability of its n-grams isn't explained by the language


def _grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram inside the words (an n-gram may begin with the word's start mark) and its word."""
    n = ends - starts
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = starts[word] + at
    out, of = [], []
    code = np.zeros(len(pos), T.U64)
    for k in range(GRAMS):
        fits = at >= k - 1  # a gram may reach one place before the word, the start mark
        byte = np.where(at >= k, low[np.maximum(pos - k, 0)], 32).astype(T.U64) + T.U64(1)
        code = code * T.U64(257) + byte
        out.append((T.mix(code[fits] + T.U64(k << 40)) % T.U64(BUCKETS)).astype(np.int64))
        of.append(word[fits])
    return np.concatenate(out), np.concatenate(of)


def letter_scripts(data: np.ndarray) -> np.ndarray:
    """Script of the letter whose UTF-8 form begins at each byte; -1 where none does."""
    table = _scripts()
    script = np.where(data < 0x80, table[np.minimum(data, 0x7F)], np.int8(-1))
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    after = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)] if len(at) else [lead] * 3
    two = (lead & 0x1F) << 6 | after[0]
    three = (lead & 0x0F) << 12 | after[0] << 6 | after[1]
    four = (lead & 0x07) << 18 | after[0] << 12 | after[1] << 6 | after[2]
    point = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    script[at] = table[np.minimum(point, len(table) - 1)]
    return script


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and its script (that of its first letter; -1: no letter). Code points of letter categories are counted."""
    script = letter_scripts(data)
    is_letter = np.concatenate([[0], np.cumsum(script >= 0)])
    count = is_letter[ends] - is_letter[starts]
    at = np.flatnonzero(script >= 0)
    first = np.searchsorted(at, starts)
    return count, np.where(count > 0, script[at[np.minimum(first, max(len(at) - 1, 0))]] if len(at) else -1, -1)


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text)."""
    langs = sorted({g for g, _ in rows})
    counts, seen = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    for g, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        if len(data):
            starts, ends, _ = T.word_spans(data, np.array([0, len(data)]))
            n, script = letters(data, starts, ends)
            starts, ends = starts[n > 0], ends[n > 0]
            if len(starts):
                k = langs.index(g)
                counts[:, k] += np.bincount(_grams(T.LOWER[data], starts, ends)[0], minlength=BUCKETS)
                seen[:, k] += np.bincount(script[n > 0], minlength=len(SCRIPTS))
    total = counts.sum(axis=0, keepdims=True)
    share = seen / np.maximum(seen.sum(axis=0, keepdims=True), 1)
    logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, logp, share > 0.001, np.array([_floor(logp[:, k], [t for g, t in rows if g == lang]) for k, lang in enumerate(langs)]))


def _floor(logp: np.ndarray, texts: list[str]) -> float:
    means, weights = [np.zeros(0)], [np.zeros(0)]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        starts, ends, _ = T.word_spans(data, np.array([0, len(data)]))
        n = letters(data, starts, ends)[0] if len(data) else np.zeros(0)
        if n.any():
            bucket, word = _grams(T.LOWER[data], starts[n > 0], ends[n > 0])
            means.append(np.bincount(word, logp[bucket]) / np.bincount(word))
            weights.append(n[n > 0])
    mean, weight = np.concatenate(means), np.concatenate(weights)
    order = np.argsort(mean)
    below = np.cumsum(weight[order])
    return float(mean[order][np.searchsorted(below, BELOW_FLOOR * below[-1], "right")]) if len(mean) else 0.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, sample_rows: int = 400, sample_bytes: int = 64 << 20) -> Model:
    """Fit on at most sample_rows documents of each language, and sample_bytes in all, picked by a hash of the id. Of rows that
    repeat an id and language the least text counts. Rows with a null id, text or language aren't used."""
    learn = fold(id_col, 5) != 0 if learn is None else learn
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & learn)
    some = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("g"), F.xxhash64(F.col(id_col), F.lit(23)).alias("draw")).distinct()
    part = F.row_number().over(Window.partitionBy("g", F.pmod("draw", F.lit(64))).orderBy("draw", "id"))
    near = some.withColumn("p", part).filter(F.col("p") <= sample_rows)  # 64 parts of a language, each cut first
    picked = near.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("draw", "id"))).filter(F.col("r") <= sample_rows).select("id", "g", "draw")
    found = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("g"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), ["id", "g"])  # sample_rows for each language
    sample = bounded_sample(found.groupBy("id", "g", "draw").agg(F.min("t").alias("t")), sample_bytes)
    return fit([(r["g"], r["t"]) for r in sorted(sample, key=lambda r: (r["g"], r["id"], r["t"]))])


def word_scores(model: Model, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, count: np.ndarray, script: np.ndarray) -> np.ndarray:
    """words x langs; each distinct word is scored once. Words without letters score 0 everywhere."""
    if not len(hashes) or not model.langs:
        return np.zeros((len(hashes), len(model.langs)), np.float32)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    bucket, word = _grams(low, starts[first], ends[first])
    n = np.bincount(word, minlength=len(first))
    out = np.empty((len(first), len(model.langs)), np.float32)
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(word, model.logp[bucket, k], minlength=len(first)) / np.maximum(n, 1)
    length, kind = count[first], script[first]
    out *= np.minimum(length, LETTERS)[:, None]
    barred = ~model.scripts[np.maximum(kind, 0)] & (kind >= 0)[:, None]
    barred &= ~barred.all(axis=1, keepdims=True)
    out[barred] -= 50.0
    out[length == 0] = 0
    return out[inverse]


def explained(model: Model, scores: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether some language, whichever it is, reaches its floor on a word; scores are those of word_scores."""
    return (scores >= (np.minimum(count, LETTERS)[:, None] * (model.floor - 1e-4)).astype(np.float32)).any(axis=1) & (count > 0)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of each word: documents of like length go through the recursion in step."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first = bounds[:-1][order]
    longest = int(n.max(initial=0))
    active = np.searchsorted(-n[order], -np.arange(longest), "left")  # documents longer than t
    langs = scores.shape[1]
    best = np.zeros((len(n), langs), np.float32)
    small = np.uint8 if langs <= 1 << 8 else np.uint16 if langs <= 1 << 16 else np.uint32
    came = np.empty((len(scores), langs), small)
    out = np.empty(len(scores), np.int64)
    each, number = np.arange(langs, dtype=small), np.arange(len(n))
    for t in range(longest):
        k = active[t]
        rows = first[:k] + t
        v = best[:k]
        top = v.argmax(axis=1)
        high = (v[number[:k], top] - switch)[:, None]
        came[rows] = np.where(v >= high, each, top[:, None])
        np.maximum(v, high, out=v)
        v += scores[rows]
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = first[:k] + t
        out[rows] = state[:k]
        state[:k] = came[rows, state[:k]]
    return out


def _label(m: Model, held: list[tuple], names: list, score: list, known: list, found: list, spans: bool, shares: bool) -> None:
    """Labels the words of several pieces at once, so that the recursion runs in step over more documents, and adds each document's results."""
    if not held:
        return
    shift = np.cumsum([0, *(len(h[1]) for h in held)])
    bounds = np.concatenate([[0], *(h[3][1:] + s for h, s in zip(held, shift))])
    labels = viterbi(np.concatenate([h[5] for h in held]), bounds) if m.langs else np.zeros(shift[-1], np.int64)
    langs = [*m.langs, *([] if m.langs else ["und"])]
    for (off, starts, ends, at, count, scores), s in zip(held, shift):
        n, label = len(off) - 1, labels[s : s + len(starts)]
        doc = np.repeat(np.arange(n), np.diff(at))
        weight = np.bincount(doc * len(langs) + label, count, minlength=n * len(langs)).reshape(n, -1)
        total = weight.sum(axis=1) if m.langs else np.zeros(n)
        names += [langs[k] if t else "und" for k, t in zip(weight.argmax(axis=1), total)]
        score += np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0).tolist()
        if shares:
            clear = np.bincount(doc, count * explained(m, scores, count), minlength=n)
            known += np.where(total > 0, clear / np.maximum(total, 1), 0.0).tolist()
        if spans:
            turn = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])) if len(label) else np.empty(0, int)
            stop = np.concatenate([turn[1:], [len(label)]]) - 1
            own: list[list] = [[] for _ in range(n)]
            for a, e in zip(turn, stop):
                if total[doc[a]]:
                    own[doc[a]].append({"start": int(starts[a] - off[doc[a]]), "end": int(ends[e] - off[doc[a]]), "lang": langs[label[a]]})
            found += own


def identify(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = True, shares: bool = False) -> DataFrame:
    """Adds lang_pred, score (the label's share of the letters, 0 to 1) and, if asked for, lang_spans (byte start, byte end, lang)
    and explained (share of the letters that stand in words that some learned language explains, whichever it is, 0 to 1).

    Columns of docs with the added names are replaced, all others stay. Repeated rows are labelled each; an empty table
    gives no rows. lang_pred is `und`, with score 0, if the text is null or has no letter, or if nothing was learned.
    """
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score", *(["explained"] if shares else []), "lang_spans")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            data, offsets = T.texts(b.column(b.num_columns - 1))
            names: list[str] = []
            score: list[float] = []
            known: list[float] = []
            found: list[list] = []
            held, words = [], 0
            for _, _, part, off in T.pieces(data, offsets, T.CHUNK_BYTES // 2):
                starts, ends, at = T.word_spans(part, off)
                low = T.LOWER[part]
                count, script = letters(part, starts, ends)
                scores = word_scores(m, low, starts, ends, T.span_hashes(low, starts, ends), count, script)
                held.append((off, *(x.astype(np.int32) for x in (starts, ends)), at, count.astype(np.int32), scores))
                words += len(starts)
                if words >= STEP_WORDS:
                    _label(m, held, names, score, known, found, spans, shares)
                    held, words = [], 0
            _label(m, held, names, score, known, found, spans, shares)
            cols = [*b.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64()), *([pa.array(known, pa.float64())] if shares else [])]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "lang_pred", "score", *(["explained"] if shares else []), *(["lang_spans"] if spans else [])])

    given = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text_col}`").cast("string"))
    out = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double", *(["explained double"] if shares else []), *(["lang_spans array<struct<start:long,end:long,lang:string>>"] if spans else [])]
    return numbered(given).mapInArrow(run, ", ".join(out))
