"""Token counts of a sentencepiece BPE model by rank-synchronous merging of numpy arrays.

The pre-tokens of a batch that no earlier batch had are held as one ragged array of symbols. In every round each
sequence finds its best pair (highest score, leftmost on ties) and all sequences merge at once; what is left at the end
is counted, a character outside the vocabulary as its UTF-8 bytes (byte fallback). Long pre-tokens (texts without spaces) are
cut where two characters stand next to each other in no piece, as no merge reaches across; what is long still is merged by
rank through lists of its places, so that a round touches only the places that it merges.

Null and empty texts have 0 tokens. Whole texts are counted. Repeated rows give equal counts, an empty table gives an
empty table. Needs a model with the identity normaliser, a dummy prefix and no piece that holds a space after another
character; `PieceTable` checks this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from gridloom.llm.base import apart, kept_schema, slices, with_columns

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
#: Pre-tokens of more characters are cut or merged through lists of places.
LONG = 400


class PieceTable:
    """The merges of a model as sorted arrays."""

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids) or not sp.encode("a", out_type=str)[0].startswith(SPACE) or sp.encode(chr(0x10FFFF), out_type=str)[-1] != "<0xBF>":
            raise ValueError("the model needs a dummy prefix, byte fallback and spaces only at the start of pieces")
        self.size = sp.vocab_size()
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.beside = np.unique([ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])]).astype(np.int64)
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        found = sorted({(ids[p[:k]] * self.size + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids})
        self.pairs = np.array([k for k, _ in found], np.int64)
        self.merged = np.array([i for _, i in found], np.int64)
        self.ranks = np.array([order[sp.get_score(i)] for _, i in found], np.int64)
        #: A line feed inside no longer piece is a token of its own.
        self.split = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if not any("\n" in p for p in ids if len(p) > 1) else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def pre_tokens(self, text: str | None) -> list[str]:
        found = self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return found if all(len(t) <= LONG for t in found) else [x for t in found for x in (self.cut(t) if len(t) > LONG else [t])]

    def cut(self, token: str) -> list[str]:
        """A token in parts, cut where no piece has the two characters next to each other."""
        code = np.frombuffer(token.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        ends = [0, *(np.flatnonzero(self.beside[at] != pair) + 1).tolist(), len(token)]
        return [token[a:b] for a, b in zip(ends, ends[1:])]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs of symbols; NONE where there is no merge."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each (non-empty) pre-token."""
        if any(len(t) > LONG for t in tokens):
            out = np.zeros(len(tokens), np.int64)
            short = [i for i, t in enumerate(tokens) if len(t) <= LONG]
            out[short] = self.counts([tokens[i] for i in short]) if short else 0
            for i, t in enumerate(tokens):
                if len(t) > LONG:
                    out[i] = self.count_long(t)
            return out
        lengths = np.array([len(t) for t in tokens], np.int64)
        code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym, seq = self.char[code], np.repeat(np.arange(len(tokens)), lengths)
        wide = np.where(sym >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        total = np.bincount(seq, wide, len(tokens)).astype(np.int64)  # each merge takes one symbol away
        rank, made = self.lookup(sym[:-1], sym[1:])
        rank, made = np.append(np.where(seq[:-1] == seq[1:], rank, NONE), NONE), np.append(made, -1)
        while len(sym):
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            hit = self.safe(np.flatnonzero((rank == np.repeat(best, sizes)) & (rank != NONE)), sym, seq, rank, made)
            if not len(hit):
                break
            total -= np.bincount(seq[hit], minlength=len(total))
            sym[hit] = made[hit]
            alive = np.repeat(best != NONE, sizes)  # a sequence without a merge is done
            alive[hit + 1] = False
            place = np.cumsum(alive) - 1
            sym, seq, rank, made = sym[alive], seq[alive], rank[alive], made[alive]
            new = place[hit]
            new = np.concatenate([new, new[new > 0] - 1])
            then = np.minimum(new + 1, len(sym) - 1)
            rank[new], made[new] = self.lookup(sym[new], sym[then])
            rank[new[(then == new) | (seq[new] != seq[then])]] = NONE
        return total

    def count_long(self, token: str) -> int:
        """Surviving symbols of one long pre-token: the places of each rank are a list, the lowest rank's merge at once."""
        code = np.frombuffer(token.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym, n = self.char[code], len(code)
        total = int(np.where(sym >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).sum())
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        rank, made = np.append(self.lookup(sym[:-1], sym[1:]), [[NONE], [-1]], axis=1)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            ends = np.flatnonzero(np.append(True, r[1:] != r[:-1])).tolist() if len(r) else []
            for a, b in zip(ends, [*ends[1:], len(at)]):
                k = int(r[a])
                if k not in places:
                    places[k] = []
                    heappush(waiting, k)
                places[k].append(at[a:b])

        add(np.arange(n - 1))
        while waiting:
            now = heappop(waiting)
            hit = np.unique(np.concatenate(places.pop(now)))
            hit = hit[alive[hit] & (rank[hit] == now)]
            if not len(hit):
                continue
            # of places whose pairs overlap every second one, counted from the left of each run
            run = np.append(True, after[hit[:-1]] != hit[1:])
            start = np.flatnonzero(run)
            nth = np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))
            left = hit[nth % 2 == 0]
            if len(left) > 1 and not self.apart(left, now, sym, after, before, made):
                left = left[:1]  # a merge makes a pair that comes first: one at a time, from the left
            right = after[left]
            sym[left], alive[right], after[left] = made[left], False, after[right]
            inner = left[after[left] < n]
            before[after[inner]] = inner
            total -= len(left)
            new = np.unique(np.concatenate([left, before[left][before[left] >= 0]]))
            then = np.minimum(after[new], n - 1)
            rank[new], made[new] = self.lookup(sym[new], sym[then])
            rank[new[after[new] >= n]] = NONE
            left_over = np.setdiff1d(hit, left)
            add(np.union1d(new, left_over[alive[left_over]]))
        return total

    def apart(self, left: np.ndarray, now: int, sym: np.ndarray, after: np.ndarray, before: np.ndarray, made: np.ndarray) -> bool:
        """Whether no merge of these places makes a pair of this round's rank or a better one, whatever its neighbours become."""
        n, one = len(sym), made[left]
        if (one != one[0]).any():
            return False
        right, prior = after[after[left]], before[left]
        has_right, has_prior = right < n, prior >= 0
        beside = [(one[has_right], sym[right[has_right]]), (sym[prior[has_prior]], one[has_prior])]
        beside.append((one[:1], one[:1]))
        return all((self.lookup(a, b)[0] > now).all() for a, b in beside)

    def safe(self, hit: np.ndarray, sym: np.ndarray, seq: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of the places with their sequence's best rank, those that one round may merge: each sequence's first, and the others
        too if they stand apart and no pair that their merges make is better than or as good as this round's."""
        if not len(hit):
            return hit
        first = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
        if first.all():
            return hit
        n, r = len(sym), rank[hit]
        left, right = np.maximum(hit - 1, 0), np.minimum(hit + 2, n - 1)
        after, _ = self.lookup(made[hit], sym[right])
        before, _ = self.lookup(sym[left], made[hit])
        better = ((seq[right] == seq[hit]) & (right > hit + 1) & (after <= r)) | ((seq[left] == seq[hit]) & (left < hit) & (before <= r))
        near = np.append(False, (np.diff(hit) <= 2) & (seq[hit[1:]] == seq[hit[:-1]]))
        bad = np.unique(seq[hit[better | near]])
        return hit[first | ~np.isin(seq[hit], bad)]


@lru_cache(maxsize=2)
def piece_table(model_path: str) -> tuple[PieceTable, dict[str, int]]:
    return PieceTable(model_path), {}


def count_texts(texts: list[str | None], table: PieceTable, known: dict[str, int]) -> list[int]:
    tokens = [table.pre_tokens(t) for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set().union(*tokens).difference(known))
    if new:
        known.update(zip(new, table.counts(new).tolist(), strict=True))
    return [sum(map(known.__getitem__, t)) for t in tokens]


def token_counts(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and `out`: the tokens of `text` as the model's own library counts them, long.

    An own column of that name is handed on as `<name>_before`."""
    names = apart(df.columns, [out])
    df, keep, text = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[text]
    inner = df.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = piece_table(model_path)
        for batch in batches:
            for part, texts in slices(batch, text):
                yield with_columns(part, keep, **{out: pa.array(count_texts(texts, table, known), pa.int64())})

    return inner.mapInArrow(run, kept_schema(df, keep, (out, "bigint")))
