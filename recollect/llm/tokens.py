"""Byte-level BPE encoding and the attribution of tokens to fields and sections by their offsets.

A document is encoded once, whole. Byte-level tokens spell their bytes, so a token's span is the running
sum of the byte lengths of the ids before it: no second tokenizer pass is made for offsets.
The ids are those of the tokenizers file `byte_bpe_50k.json`; `byte_bpe_50k.tiktoken` holds the same vocabulary as
ranks and is encoded about three times as fast, so tasks use that one. Tests hold both against each other.
That file adds the end mark as a token of its own and finds it in texts; with end_mark it is one id here too, else
it is ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "most")
#: The one added token of the vocabulary, and its id.
END_MARK, END_MARK_ID = "<|endoftext|>", 50256
#: Runs of so many white-space characters (Unicode's White_Space, fixed values) are encoded apart.
LONG_RUN = 50_000
_RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str) -> tuple:
    """(encode function, byte length of each id) for a rank file; once per Python worker."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lengths = np.zeros(max(*ranks.values(), END_MARK_ID) + 1, np.int64)
    for piece, i in [*ranks.items(), (END_MARK, END_MARK_ID)]:
        lengths[i] = len(piece)
    words, whole = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (public_tokenizers.PATTERN, r"[\s\S]+"))
    return lambda text: encode_runs(words, whole, text), lengths


def encode_runs(words: Callable[[str], list[int]], whole: Callable[[str], list[int]], text: str) -> list[int]:
    """As words(text), whose search for blanks before a word overflows its stack on very long runs of them.

    Such a run is one piece of its own, up to its last blank where a word follows, so whole() encodes it and words() the rest.
    """
    if len(text) < LONG_RUN:
        return words(text)
    out, at = [], 0
    for run in _RUNS.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += words(text[at : run.start()])
        out += whole(text[run.start() : end])
        at = end
    return out + words(text[at:])


def encode_marked(encode: Callable[[str], list[int]], text: str) -> list[int]:
    """Ids of a text that is split at each literal end mark, which becomes one id."""
    first, *rest = text.split(END_MARK)
    ids = list(encode(first))
    for part in rest:
        ids.append(END_MARK_ID)
        ids += encode(part)
    return ids


def attribute(spans: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token. spans: token ends, running from 0; bounds: section ends, running from 0.

    start: the section of the token's first byte; end: of its last byte; most: of most of its bytes, ties to the earlier.
    """
    first = np.concatenate([[0], spans[:-1]])
    a = np.searchsorted(bounds, first, "right")
    if rule == "start":
        return a
    b = np.searchsorted(bounds, spans - 1, "right")
    if rule == "end":
        return b
    best, room = a.copy(), np.minimum(bounds[np.minimum(a, len(bounds) - 1)], spans) - first
    for i in np.flatnonzero(b > a):
        for s in range(a[i] + 1, b[i] + 1):
            lo, hi = max(first[i], bounds[s - 1]), min(spans[i], bounds[s])
            if hi - lo > room[i]:
                best[i], room[i] = s, hi - lo
    return best


def record_sections(source: str | None, lang: str | None, text: str | None) -> list[tuple[str, str]]:
    """A document as a record of fields: source, language, first line (title) and the rest (body). Nulls are empty."""
    title, newline, body = (text or "").partition("\n")
    return [("source", (source or "") + "\n"), ("lang", (lang or "") + "\n"), ("title", title + newline), ("body", body)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("source", "lang", "text"), sections: Callable[..., list[tuple[str, str]]] = record_sections, rule: str = "start", vocabulary: str | None = None, end_mark: bool = False) -> DataFrame:
    """Tokens of each section of each document, the document being encoded once as the concatenation of its sections.
    With end_mark, a literal end mark is its one id.

    Returns doc_id, section, section_no, start_byte, end_byte, n_tokens, n_crossing (tokens counted here that also
    cover bytes of other sections). The counts of a document's sections add up to its tokens.
    Null columns are empty sections with 0 tokens; a null id is kept; repeated rows give repeated results;
    an empty table gives no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(path)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), zip(*(c.to_pylist() for c in b.columns[1:]))
            out: list[list] = [[] for _ in range(7)]
            for i, row in zip(ids, rows):
                parts = sections(*row)
                whole = "".join(p for _, p in parts)
                ends = np.cumsum([len(p.encode("utf-8", "replace")) for _, p in parts])
                spans = np.cumsum(lengths[np.array(encode_marked(encode, whole) if end_mark else encode(whole), np.int64)])
                at = attribute(spans, ends, rule)
                first = np.concatenate([[0], spans[:-1]])
                crossing = np.searchsorted(ends, first, "right") != np.searchsorted(ends, spans - 1, "right")
                n, x = np.bincount(at, minlength=len(parts)), np.bincount(at[crossing], minlength=len(parts))
                begins = np.concatenate([[0], ends[:-1]])
                for k, (name, _) in enumerate(parts):
                    for o, v in zip(out, (i, name, k, int(begins[k]), int(ends[k]), int(n[k]), int(x[k]))):
                        o.append(v)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["doc_id", "section", "section_no", "start_byte", "end_byte", "n_tokens", "n_crossing"])

    return docs.select(F.col(id_col).cast("long"), *columns).mapInArrow(run, "doc_id long, section string, section_no int, start_byte long, end_byte long, n_tokens long, n_crossing long")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, vocabulary: str | None = None, end_mark: bool = False) -> DataFrame:
    """Each document's ids and then end_id, cut into pieces of at most size ids. With end_mark, a literal end mark is its one id.

    Returns doc_id, start, length, doc_tokens, ids (binary: little-endian unsigned 32-bit). A null text is empty, its
    only id is end_id. Repeated rows give repeated pieces; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                doc, start, length, total, ids = [], [], [], [], []
                for i, t in zip(b.column(0).slice(k, 256).to_pylist(), b.column(1).slice(k, 256).to_pylist()):
                    x = np.array([*(encode_marked(encode, t or "") if end_mark else encode(t or "")), end_id], "<u4")
                    for s in range(0, len(x), size):
                        p = x[s : s + size]
                        doc.append(i), start.append(s), length.append(len(p)), total.append(len(x)), ids.append(p.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")
