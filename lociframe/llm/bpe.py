"""BPE encoding and decoding by speculation and verification.

Texts are normalised and cut into words as the tokenizer file says.  For all
distinct new words of a batch at once a greedy longest match (an Aho-Corasick
automaton over the vocabulary) proposes tokens.  A token sequence is the BPE
encoding of a word exactly if every token encodes to itself and every pair of
neighbours is compatible, that is, encoding their joined text gives the two
back; the pairs are checked with one vectorised look-up, each distinct pair
being computed once.  Only words that fail are merged exactly.

Supports tokenizer files of kind "BPE with an end-of-word suffix": NFC,
white space to one space, lower case; a word pattern; byte-level symbols.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._util import small_batches, strings, tidy

# Latin text without the few numerals and controls on which the classes of ``re`` differ from the pattern's
_PLAIN_NOT = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# outside Latin, Greek, Cyrillic, general punctuation, kana, common Han and Hangul
_RARER = regex.compile(r"[^\u0000-\u052f\u1e00-\u206f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_NONE = np.int32(2**31 - 1)
_STOP = " "  # stands for the end-of-word suffix; no byte-level symbol is a space


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer read from ``path``; keeps what it has learnt of pairs and at most ``memo`` words."""

    def __init__(self, path: str, memo: int = 160_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("only BPE files with an end-of-word suffix and no decoder are supported")
        suffix = model["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unsupported normalizers: {kinds}")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        own = lambda t: t[: -len(suffix)] + _STOP if t.endswith(suffix) else t
        self.shown = {i: t for t, i in [*model["vocab"].items(), *self.specials.items()]}
        self.ids = {own(t): i for t, i in model["vocab"].items() if t not in self.specials}
        self.text_of = {i: t for t, i in self.ids.items()}
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            if own(a) in self.ids and own(b) in self.ids and (t := own(a + b)) in self.ids:
                rank.setdefault((self.ids[own(a)], self.ids[own(b)]), (r, self.ids[t]))
        self.rank = rank
        self.byte = _byte_symbols()
        self.table = {b: s for b, s in enumerate(self.byte)}
        self.back = {ord(s): b for b, s in enumerate(self.byte)}
        self.path, self.library = path, None
        self.plain = split["pattern"]["Regex"] == _PLAIN_FOR
        self.unit = {s: self.ids.get(s) for s in self.byte}
        self.last = {s: self.ids.get(s + _STOP) for s in self.byte}
        self.unit_id, self.last_id = np.full(512, -1, np.int32), np.full(512, -1, np.int32)
        for c in self.byte:
            self.unit_id[ord(c)], self.last_id[ord(c)] = self.unit[c], self.last[c]
        code = np.array([(a << 20) | b for a, b in rank], np.int64)
        order = np.argsort(code)
        self.pair_code, self.pair_rank = code[order], np.array([r for r, _ in rank.values()], np.int32)[order]
        self.rank_new = np.zeros(len(model["merges"]) + 1, np.int32)
        self.rank_new[[r for r, _ in rank.values()]] = [t for _, t in rank.values()]
        top = max(self.shown) + 1
        self.token_size = np.zeros(top)
        self.match = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.match.add_word(t, i)
            self.token_size[i] = len(t)
        self.match.make_automaton()
        self.sound = np.full(top, -1, np.int8)
        self.seen, self.seen_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.memo_size = memo
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.stats = {"words": 0, "merged": 0}

    def normalise(self, text: str) -> str:
        """NFC, lower case by character.  (White space only separates words, so it is left to the pattern.)"""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text or "İ" in text:  # str.lower() looks at neighbours or makes two characters: by character here
                text = "".join(c.lower() for c in text)
                return text
        return text.lower()

    def words(self, text: str) -> list[str]:
        """Cut a text.  Scripts whose classes differ between Unicode versions are cut by the tokenizers library's own tables."""
        if self.plain and not _PLAIN_NOT.search(text):
            return _PLAIN.findall(self.normalise(text))
        if text.isascii() or not _RARER.search(text):
            return self.pattern.findall(self.normalise(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [p.translate(self.back).encode("latin-1").decode("utf-8") for p, _ in parts]

    def symbols(self, word: str) -> str:
        """The word in byte-level symbols, with the stop mark at its end."""
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) + _STOP

    def merge(self, symbols: str) -> list[int]:
        """Exact encoding: the pair of lowest rank is merged first, leftmost of equals, until none is left.

        Pairs wait in a heap and tokens are a linked list, so a word of n
        symbols takes n log n steps however long it is.
        """
        inner = symbols[:-1] if symbols.endswith(_STOP) else symbols
        seq = [self.unit[s] for s in inner]
        if symbols.endswith(_STOP):
            seq[-1] = self.last[inner[-1]]
        n, rank, none = len(seq), self.rank, (-1, 0)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0] << 40) | i for i, r in enumerate(map(rank.get, zip(seq, seq[1:], strict=False))) if r]  # rank, then place
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or seq[i] < 0:
                continue
            r, new = rank.get((seq[i], seq[j]), none)
            if r != top >> 40:  # the pair has changed meanwhile
                continue
            seq[i], seq[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (nxt := rank.get((new, seq[k]))) is not None:
                    heapq.heappush(heap, (nxt[0] << 40) | i)
            h = before[i]
            if h >= 0 and (prev := rank.get((seq[h], new))) is not None:
                heapq.heappush(heap, (prev[0] << 40) | h)
        return [t for t in seq if t >= 0]

    def merge_many(self, symbols: list[str], widest: int = 40) -> list[list[int]]:
        """:meth:`merge` of many strings at once: each round merges one pair in every row of a matrix of tokens.

        A row's pair is its leftmost of lowest rank, and only the two ranks
        beside it are looked up anew.  Strings of over ``widest`` symbols are
        merged one by one.
        """
        out: list = [None] * len(symbols)
        short = []
        for k, x in enumerate(symbols):
            if len(x) <= widest:
                short.append(k)
            else:
                out[k] = self.merge(x)
        for at in range(0, len(short), 40_000):
            part = short[at : at + 40_000]
            stop = np.fromiter((symbols[k][-1] == _STOP for k in part), bool, len(part))
            lens = np.fromiter((len(symbols[k]) for k in part), np.int64, len(part))
            code = np.frombuffer("".join(symbols[k] for k in part).encode("utf-32-le"), np.uint32)
            end = np.cumsum(lens)
            width = int(lens.max()) + 1
            seq = np.full((len(part), width), -1, np.int32)
            row = np.repeat(np.arange(len(part)), lens)
            col = np.arange(len(code)) - np.repeat(end - lens, lens)
            seq[row, col] = self.unit_id[code]
            final = np.flatnonzero(stop)
            seq[final, lens[final] - 2] = self.last_id[code[end[final] - 2]]
            seq[final, lens[final] - 1] = -1
            who = np.arange(len(part))
            best = self._ranks(seq[:, :-1], seq[:, 1:])
            column = np.arange(width - 1)
            while len(who):
                p = best.argmin(axis=1)
                low = best[np.arange(len(who)), p]
                done = low == _NONE
                if done.any():
                    ended = np.flatnonzero(done)
                    n = (seq[ended] >= 0).sum(axis=1)
                    for k, r, m in zip(who[ended].tolist(), seq[ended].tolist(), n.tolist(), strict=True):
                        out[part[k]] = r[:m]
                    go = ~done
                    who, seq, best, p, low = who[go], seq[go], best[go], p[go], low[go]
                    if not len(who):
                        break
                r = np.arange(len(who))
                seq[r, p] = self.rank_new[low]
                after = column[None, :] > p[:, None]  # what stands behind the pair moves up by one
                seq[:, :-1] = np.where(after, seq[:, 1:], seq[:, :-1])
                best[:, :-1] = np.where(after[:, :-1], best[:, 1:], best[:, :-1])
                best[:, -1] = _NONE
                best[r, p] = self._ranks(seq[r, p], seq[r, p + 1])
                left = np.flatnonzero(p > 0)
                best[left, p[left] - 1] = self._ranks(seq[left, p[left] - 1], seq[left, p[left]])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where there is no such merge (or no token)."""
        code = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where((self.pair_code[at] == code) & (a >= 0) & (b >= 0), self.pair_rank[at], _NONE)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each (normalised, non-empty) word."""
        if not words:
            return []
        marked = list(map(self.symbols, words))
        lens = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(lens)
        found = list(self.match.iter_long("".join(marked)))
        at = np.fromiter((e for e, _ in found), np.int64, len(found)) + 1
        tok = np.fromiter((v for _, v in found), np.int64, len(found))
        owner = np.searchsorted(ends, at - 1, "right")
        n = len(marked)
        ok = np.bincount(owner, weights=self.token_size[tok], minlength=n) == lens  # greedy covers the word, its stop mark included
        proposed = np.unique(tok)
        fresh = proposed[self.sound[proposed] < 0]
        if len(fresh):
            self.sound[fresh] = [m == [t] for m, t in zip(self.merge_many([self.text_of[t] for t in fresh.tolist()]), fresh.tolist(), strict=True)]
        ok &= np.bincount(owner[self.sound[tok] == 0], minlength=n) == 0
        same = np.flatnonzero(owner[:-1] == owner[1:])
        distinct, back = np.unique((tok[same] << 20) | tok[same + 1], return_inverse=True)
        ok &= np.bincount(owner[same[~self.fits(distinct)[back]]], minlength=n) == 0
        cut = np.searchsorted(owner, np.arange(n + 1)).tolist()
        toks = tok.tolist()
        failing = np.flatnonzero(~ok).tolist()
        self.stats["words"] += n
        self.stats["merged"] += len(failing)
        out = [toks[cut[k] : cut[k + 1]] for k in range(n)]
        for k, ids in zip(failing, self.merge_many([marked[k] for k in failing]), strict=True):
            out[k] = ids
        return out

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (sorted distinct codes) is compatible; pairs not seen before are merged once and kept."""
        at = np.minimum(np.searchsorted(self.seen, pairs), max(0, len(self.seen) - 1))
        old = self.seen[at] == pairs if len(self.seen) else np.zeros(len(pairs), bool)
        out = np.zeros(len(pairs), bool)
        out[old] = self.seen_fits[at[old]]
        new = pairs[~old]
        if len(new):
            got = self.merge_many([self.text_of[c >> 20] + self.text_of[c & 0xFFFFF] for c in new.tolist()])
            fit = np.array([m == [c >> 20, c & 0xFFFFF] for m, c in zip(got, new.tolist(), strict=True)], bool)
            out[~old] = fit
            if len(self.seen) > 1_000_000:
                self.seen, self.seen_fits = self.seen[:0], self.seen_fits[:0]
            both = np.concatenate([self.seen, new])
            order = np.argsort(both, kind="stable")
            self.seen, self.seen_fits = both[order], np.concatenate([self.seen_fits, fit])[order]
        return out

    def learn(self, words: set[str]) -> None:
        """Put the encodings of ``words`` into the memo, which is emptied first if they would not fit."""
        new = [w for w in words if w not in self.memo]
        if len(new) + len(self.memo) > self.memo_size:
            self.memo.clear()
            new = list(words)
        show = self.shown
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self.memo[w] = (len(ids), " ".join(map(str, ids)), " ".join(show[i] for i in ids))

    def forget(self) -> None:
        """Empty what has been learnt of words and pairs."""
        self.memo = {}
        self.seen, self.seen_fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def cut(self, text: str | None) -> list[str]:
        """The text's words; special tokens found in it are kept as they are (no word equals one)."""
        text = text or ""
        if self.special_re is None or not self.special_re.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [*self.words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words(text[at:])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each text; null counts as empty."""
        cut = list(map(self.cut, texts))
        self.learn(set().union(*cut).difference(self.specials))
        self.memo.update((t, (1, str(i), t)) for t, i in self.specials.items())
        get, out = self.memo.__getitem__, []
        for words in cut:
            got = list(map(get, words))
            n, ids, shown = zip(*got, strict=True) if got else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(shown)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_batch([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file has no decoder.  Unknown ids are left out."""
        return " ".join(self.shown[i] for i in ids if i in self.shown)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row of ``docs``.

    Each row stands alone: no shuffle, a null or empty text has no tokens and
    the digests of the empty text, repeated rows give equal rows, bytes that
    are no UTF-8 count as U+FFFD, very long texts and words take time in
    proportion (to n log n at most), other columns are ignored, an empty table
    gives an empty one.  ``keep_ids`` adds the ids and the decoded text.
    ``path`` is opened by the workers and must exist on every node.
    """
    from ._util import with_columns

    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        bpe = load(path)
        for b in small_batches(batches, "text", 1 << 20):
            got = bpe.encode_batch(strings(b.column("text")))
            cols = [b.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([sha(i) for _, i, _ in got], pa.string()), pa.array([sha(d) for _, _, d in got], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([[int(x) for x in i.split()] for _, i, _ in got], pa.list_(pa.int32())), pa.array([d for _, _, d in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)
        bpe.forget()  # the worker lives on

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return with_columns(docs, doc_id="long", text="string").mapInArrow(tidy(run), schema)
