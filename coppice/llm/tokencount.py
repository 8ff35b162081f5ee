"""Token counts of a byte-fallback BPE model by rank-synchronous merging of arrays.

The model file is read for its pieces and scores; counting is done here.  A text
becomes one space sign and itself, spaces shown as U+2581.  No piece has the sign
after another character, so a text falls apart before each run of signs (and
around characters that no longer piece holds) into pre-tokens whose tokens are
independent.  Pre-tokens not seen before are held as ragged arrays, those of like
length together: every round finds each sequence's pair of lowest rank, the
leftmost of equals, and merges it in all sequences at once, until no pair is a
piece; the symbols that survive are counted, one for a known piece and one a byte
for an unknown character.  Sequences of over ``NARROW`` symbols (script without spaces,
encoded data) lie end to end in one array: a round takes the lowest rank that is left
and merges all its pairs in all sequences, so there are as many rounds as ranks met, not
as symbols.  Where a merge makes a pair that comes before the rest of its rank, the
sequence stops there for this round, which keeps the order of one merge at a time.

Defined results: null counts as the empty text, which has no token; pairs of equal rank
go from left to right; very long texts are counted whole; repeated rows are counted
alike; further columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.storage import mapped
from coppice.llm.textscan import passes, texts

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
SIGN = "▁"
#: Symbols of the widest rows of symbols; longer sequences lie end to end.
NARROW = 64
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 1 << 20
_NONE = np.int32(1 << 30)


class MergeTable:
    """Symbols, and the rank and product of each pair that merges."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self._load({model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))})

    def _load(self, pieces: dict[str, float]) -> None:
        if any(SIGN in p.lstrip(SIGN) for p in pieces):
            raise ValueError("a piece holds the space sign after another character: texts can't be cut at spaces")
        symbols = {p: i for i, p in enumerate(pieces)}
        long = [p for p in pieces if len(p) > 1]
        for p in long:
            for c in p:
                symbols.setdefault(c, len(symbols))
        rank = {s: r for r, s in enumerate(sorted({pieces[p] for p in long}, reverse=True))}
        pairs = [(symbols[p[:k]], symbols[p[k:]], rank[pieces[p]], symbols[p]) for p in long for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(pairs, np.int64).reshape(-1, 4)
        self.width = len(symbols)
        key = table[:, 0] * self.width + table[:, 1]
        order = np.argsort(key)
        self.keys, self.ranks, self.products = key[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32)
        self.first = np.full(0x110000, -1, np.int32)  # symbol of a character; -1: never merges
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in symbols], np.int64)
        self.alone = np.ones(0x110000, np.int64)  # tokens of a character that never merges
        code = np.arange(0x110000)
        self.alone += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        for s, i in symbols.items():
            if len(s) == 1:
                self.first[ord(s)] = i
                self.alone[ord(s)] = 1 if s in pieces else len(s.encode())
        #: ASCII that no longer piece holds cuts a text as well.
        held = {c for p in long for c in p}
        self.cutters = bytes(c for c in range(128) if chr(c) not in held and c != 0x20)
        cut = b"[" + re.escape(self.cutters) + b"]" if self.cutters else b"(?!)"
        plain = b"[^ " + re.escape(self.cutters) + b"]"
        self.pretokens = re.compile(b" +" + plain + b"*|" + plain + b"+|" + cut).findall

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE if they don't merge) and product of pairs."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(hit, self.ranks[at], _NONE), self.products[at]

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        words = [p.replace(b" ", SIGN.encode()).decode() for p in pretokens]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        low = 0
        for high in (4, 8, 12, 16, 24, 32, NARROW):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(some, max(1, len(some) * high // (1 << 20))):
                if len(part):
                    out[part] = self._merge(code, begins[part], sizes[part], high)
            low = high
        long = np.flatnonzero(sizes > NARROW)
        if len(long):
            out[long] = self._merge_flat(np.concatenate([code[b : b + n] for b, n in zip(begins[long].tolist(), sizes[long].tolist(), strict=True)]), sizes[long])
        return out

    def _merge(self, code: np.ndarray, begins: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        n = len(begins)
        place = np.arange(width)
        inside = place < sizes[:, None]
        chars = code[np.where(inside, begins[:, None] + place, 0)]
        symbol = np.where(inside, self.first[chars], -1)
        bytes_ = np.where(inside & (symbol < 0), self.alone[chars], 0).sum(axis=1)  # of characters that stay as they are
        rank = np.full((n, width), _NONE, np.int32)
        product = np.zeros((n, width), np.int32)
        if width > 1:
            r, p = self.look_up(symbol[:, :-1].ravel(), symbol[:, 1:].ravel())
            rank[:, :-1], product[:, :-1] = r.reshape(n, -1), p.reshape(n, -1)
        after = np.minimum(np.tile(place + 1, (n, 1)), width)
        before = np.tile(place - 1, (n, 1))
        alive = inside & (symbol >= 0)
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            go = rank[live, best] < _NONE
            live, at = live[go], best[go]
            if not len(live):
                break
            gone = after[live, at]
            symbol[live, at] = product[live, at]
            alive[live, gone] = False
            rank[live, gone] = _NONE
            nxt = after[live, gone]
            after[live, at] = nxt
            right = nxt < width
            before[live[right], nxt[right]] = at[right]
            right_symbol = np.where(right, symbol[live, np.minimum(nxt, width - 1)], -1)
            rank[live, at], product[live, at] = self.look_up(symbol[live, at], right_symbol)
            prev = before[live, at]
            left = prev >= 0
            rows, prev = live[left], prev[left]
            rank[rows, prev], product[rows, prev] = self.look_up(symbol[rows, prev], symbol[rows, at[left]])
        return np.where(alive, self.cost[np.maximum(symbol, 0)], 0).sum(axis=1) + bytes_

    def _merge_flat(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, seq = len(code), np.repeat(np.arange(len(sizes)), sizes)
        symbol = np.append(self.first[code], np.int32(-1))  # the last one is what lies beyond either end
        last = np.cumsum(sizes) - 1
        after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
        after[last], before[last - sizes + 1] = n, n
        alive = np.ones(n + 1, bool)
        rank, product = self.look_up(symbol, symbol[after])
        pending: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] < _NONE]
            order = np.argsort(rank[places], kind="stable")
            places, own = places[order], rank[places[order]]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for part in np.split(places, cuts) if len(places) else ():
                r = int(rank[part[0]])
                if r not in pending:
                    pending[r] = []
                    heapq.heappush(ranks, r)
                pending[r].append(part)

        put(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            met = np.unique(np.concatenate(pending.pop(r)))
            met = met[alive[met] & (rank[met] == r)]
            if not len(met):
                continue
            # Of pairs that overlap in a chain, the first, third, ... merge.
            chained = np.concatenate(([False], after[met[:-1]] == met[1:]))
            place = np.arange(len(met))
            at = met[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone, new = after[at], product[at]
            nxt, prev = after[gone], before[at]
            beside = np.concatenate(([False], gone[:-1] == prev[1:]))  # what is left of it merges in this round too
            left = np.where(beside, np.concatenate((new[:1], new[:-1])), symbol[prev])
            early = np.minimum(self.look_up(left, new)[0], self.look_up(new, symbol[nxt])[0]) <= r
            if early.any():
                stops = np.cumsum(early) - early
                own = seq[at]
                first = np.searchsorted(own, own)  # places ascend, so sequences do
                go = stops == stops[first]
                pending[r] = [met]
                heapq.heappush(ranks, r)
                at, gone, new, nxt, prev, beside = (x[go] for x in (at, gone, new, nxt, prev, beside))
            symbol[at], alive[gone], rank[gone] = new, False, _NONE
            after[at] = nxt
            before[nxt] = at
            before[n] = n
            changed = np.concatenate((at, prev[~beside & (prev < n)]))
            rank[changed], product[changed] = self.look_up(symbol[changed], symbol[after[changed]])
            put(changed)
        stay = np.flatnonzero(alive[:n])
        worth = np.where(symbol[stay] >= 0, self.cost[np.maximum(symbol[stay], 0)], self.alone[code[stay]])
        return np.bincount(seq[stay], weights=worth, minlength=len(sizes)).astype(np.int64)


class Counter:
    """Token counts of texts; remembers the pre-tokens it has met."""

    def __init__(self, model_file: str, remembered: int = REMEMBERED):
        self.table, self.known, self.remembered = MergeTable(model_file), {}, remembered

    def __call__(self, rows: list[bytes]) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        find, sign = self.table.pretokens, SIGN.encode()
        for low, high in passes(rows):
            parts = [find(b" " + x.replace(sign, b" ")) if x else [] for x in rows[low:high]]
            fresh: set[bytes] = set()
            for p in parts:
                fresh.update(p)
            if len(self.known) + len(fresh) > self.remembered:
                self.known = {}
            fresh = fresh.difference(self.known) if self.known else fresh
            if fresh:
                new = list(fresh)
                self.known.update(zip(new, self.table.counts(new).tolist(), strict=True))
            get = self.known.__getitem__
            out[low:high] = [sum(map(get, p)) for p in parts]
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(model_file: str) -> Counter:
    """The worker's counter for a model; a Python worker keeps it from task to task."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = Counter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """(doc: struct of ``keep``, n_bytes, n_tokens) of each row; model_file is a path that all executors have."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["doc"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for b in batches:
            rows = texts(b.column(1))
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(count(rows))], names=schema.names)

    return mapped(own, scan, schema)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of all documents."""
    import public_tokenizers

    counted = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL), ["doc_id"])
    return counted.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
