"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once and whole, so that tokens are those a model would
see.  Byte-level BPE tokens tile the text, so each token's span is known from
the running sum of token lengths.  The sorted spans are joined with the
sorted sections of the document by a binary search; tokens that cross a
section's edge are allocated by an explicit rule:

``start``     the section that holds the token's first byte (default),
``end``       the section that holds its last byte,
``majority``  the section that holds most of its bytes, the first on ties.

Tokens whose deciding byte lies in no section are counted under section -1.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import small_batches, strings, with_columns

RULES = ("start", "end", "majority")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """(tiktoken encoding, length in bytes of each token) for a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for t, i in ranks.items():
        sizes[i] = len(t)
    return tiktoken.Encoding("lociframe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_sections(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte intervals [start, end) of a text's lines; the line end belongs to the line before it."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]), ends


def attribute(ends: np.ndarray, starts_of: np.ndarray, ends_of: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token (-1: none).  Tokens tile the text and end at ``ends``; sections are sorted and disjoint."""
    if not len(ends):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]])

    def at(byte: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts_of, byte, "right") - 1
        return np.where((k >= 0) & (byte < ends_of[np.maximum(k, 0)]), k, -1) if len(starts_of) else np.full(len(byte), -1)

    first, last = at(begins), at(ends - 1)
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    inside = (first == last) & ((first >= 0) | (np.searchsorted(starts_of, begins, "right") == np.searchsorted(starts_of, ends - 1, "right")))
    for i in np.flatnonzero(~inside):  # the few tokens that cross an edge
        a, b = begins[i], ends[i]
        lo, hi = max(0, np.searchsorted(starts_of, a, "right") - 1), np.searchsorted(starts_of, b, "left")
        share = np.minimum(ends_of[lo:hi], b) - np.maximum(starts_of[lo:hi], a)
        out[i] = lo + int(share.argmax()) if len(share) and share.max() > 0 else -1
    return out


def section_tokens(docs: DataFrame, path: str, pattern: str, sections: str | None = None, rule: str = "start") -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens): a row for each section of each document.

    ``sections`` names a column of array<struct<start:int,end:int>> in
    characters, in any order but disjoint and inside the text (overlaps raise
    an error); without it the sections are the text's lines.  Sections are
    numbered from 0 by their start; the row of section -1 (null offsets) is
    given only if some token falls in no section.  A null or empty text, or a
    null or empty list of sections, gives no section rows except that lines of
    an empty text are one empty section.  n_tokens over a document's rows sums
    to its tokens.  Row-local; repeated rows are counted one by one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    types = {"doc_id": "long", "text": "string"} | ({sections: "array<struct<start:int,end:int>>"} if sections else {})

    def run(batches):
        enc, sizes = encoder(path, pattern)
        for b in small_batches(batches, "text"):
            ids = b.column("doc_id").to_pylist()
            given = b.column(sections).to_pylist() if sections else None
            cols: list[list] = [[], [], [], [], []]
            for row, text in enumerate(strings(b.column("text"))):
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                ends = np.cumsum(sizes[np.array(enc.encode_ordinary(text), np.int64)]) if data else np.zeros(0, np.int64)
                if not sections:
                    lo, hi = line_sections(data)
                else:
                    spans = sorted((s["start"], s["end"]) for s in given[row] or () if s and s["start"] is not None and s["end"] is not None)
                    if any(a > b for a, b in spans) or any(p[1] > q[0] for p, q in zip(spans, spans[1:], strict=False)) or (spans and (spans[0][0] < 0 or spans[-1][1] > len(text))):
                        raise ValueError(f"sections of document {ids[row]} overlap or leave the text")
                    lo, hi = (np.array([s[j] for s in spans], np.int64) for j in (0, 1))
                chars = None
                if not text.isascii():  # characters <-> bytes
                    chars = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
                    if sections:
                        lo, hi = chars[lo], chars[hi]
                own = attribute(ends, lo, hi, rule)
                n = np.bincount(own + 1, minlength=len(lo) + 1)
                lo_c, hi_c = (np.searchsorted(chars, x) for x in (lo, hi)) if chars is not None else (lo, hi)
                if n[0]:
                    for c, v in zip(cols, (ids[row], -1, None, None, int(n[0])), strict=True):
                        c.append(v)
                for c, v in zip(cols, ([ids[row]] * len(lo), range(len(lo)), lo_c.tolist(), hi_c.tolist(), n[1:].tolist()), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "section", "start_char", "end_char", "n_tokens"])

    return with_columns(docs, **types).mapInArrow(run, "doc_id long, section int, start_char long, end_char long, n_tokens long")
