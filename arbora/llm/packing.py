"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming.

The documents of a partition, in their order, form one stream of tokens.  A cut may fall after a document (free), after
a sentence (``SENTENCE_CUT``) or, where neither comes for ``STRIDE`` tokens, inside a sentence (``WORD_CUT``).  The DP
over these places minimises padding plus penalties: ``f(j) = penalty(j) + min_i f(i) + padding(j - i)``.  Padding up to
the limit is linear in the length, so the minimum over the sliding range of ``i`` is kept in a monotone queue; windows
whose length is a power of two need no padding and are separate transitions.
"""

from __future__ import annotations

import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: Penalties in tokens of padding, and the tokens without a boundary after which a cut inside a sentence is offered.
SENTENCE_CUT, WORD_CUT, STRIDE = 2, 16, 32
#: Shorter lengths at which a window needs no padding, and what such a window costs.
SHORT, SHORT_COST = (128, 256, 512), 8
#: Tokens that one run of the DP takes; the last window is carried over, so blocks leave no trace in the padding.
BLOCK = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids of a byte-level BPE file of the ``tokenizers`` library; the strings of its added tokens stand for their ids
    wherever a text holds them, as they do in that library."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        size = max(*ranks.values(), *special.values()) + 1
        self.stops, self.opens = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        for token, i in ranks.items():
            text = token.decode("utf-8", "replace")
            self.stops[i] = text.rstrip(" )\"'»”")[-1:] in ".!?…\n。！？" if text.strip() or "\n" in text else False
            self.opens[i] = text[:1].isspace()

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def cut_places(tokens: np.ndarray, ends: np.ndarray, stops: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of the allowed cuts, place 0 first; ``ends`` are the documents' ends in the stream."""
    n = len(tokens)
    cost = np.full(n + 1, -1, np.int32)
    cost[np.flatnonzero(stops[tokens[:-1]] & opens[tokens[1:]]) + 1] = SENTENCE_CUT
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    extra = (np.diff(at) - 1) // STRIDE
    if extra.any():
        left = np.repeat(at[:-1], extra)
        step = np.arange(len(left)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        cost[left + step * STRIDE] = WORD_CUT
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(places: np.ndarray, costs: np.ndarray, limit: int = LIMIT, short: tuple[int, ...] = SHORT) -> list[int]:
    """The cheapest cuts, from place 0 to the last place, with no window over ``limit``."""
    ways = []
    for s in short:
        i = np.searchsorted(places, places - s)
        ways.append(np.where(places[np.minimum(i, len(places) - 1)] == places - s, i, -1).tolist())
    x, w = places.tolist(), costs.tolist()
    n = len(x)
    f, key, back = [0] * n, [0] * n, [0] * n
    queue: deque[int] = deque()
    any_short = np.max(ways, axis=0).tolist() if ways else [-1] * n
    for j in range(1, n):
        k = key[j - 1]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j - 1)
        here = x[j]
        low = here - limit
        while x[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] + limit - here
        if any_short[j] >= 0:
            for way in ways:
                if (p := way[j]) >= 0 and f[p] + SHORT_COST < best:
                    best, i = f[p] + SHORT_COST, p
        best += w[j]
        f[j], key[j], back[j] = best, best + here, i
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return [x[i] for i in reversed(out)]


class _Packer:
    def __init__(self, tokenizer: Tokenizer, limit: int, first: int):
        self.t, self.limit, self.sequence = tokenizer, limit, first
        self.clear()

    def clear(self):
        self.tokens, self.ids, self.begin, self.total, self.size = [], [], [], [], 0

    def add(self, ident, text: str | None):
        tokens = np.append(self.t.encode(text or ""), np.uint32(0)).astype("<u4", copy=False)
        self._push(ident, tokens, 0, len(tokens))

    def _push(self, ident, tokens, begin, total):
        self.tokens.append(tokens)
        self.ids.append(ident)
        self.begin.append(begin)
        self.total.append(total)
        self.size += len(tokens)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """Packs what has come; unless ``last``, its final window stays for the next block."""
        if not self.size:
            return None
        stream = np.concatenate(self.tokens)
        ends = np.cumsum([len(t) for t in self.tokens])
        cuts = best_cuts(*cut_places(stream, ends, self.t.stops, self.t.opens), self.limit)
        done = cuts if last else cuts[:-1]
        limit = done[-1]
        edges = np.unique(np.concatenate((done, ends[ends <= limit])))
        start, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, start, "right")
        window = np.searchsorted(done, start, "right") - 1
        heads = np.concatenate(([0], ends[:-1]))
        cuts_a = np.array(done)
        lengths = np.diff(cuts_a)
        room = np.where((lengths & (lengths - 1)) == 0, lengths, self.limit)
        view = memoryview(stream.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        begin, total = np.array(self.begin), np.array(self.total)
        columns = [
            pa.array([self.ids[d] for d in doc.tolist()], pa.int64()),
            pa.array(begin[doc] + start - heads[doc], pa.int64()),
            pa.array(stop - start, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array(total[doc], pa.int64()),
            pa.array(self.sequence + window, pa.int64()),
            pa.array(start - cuts_a[window], pa.int64()),
            pa.array(lengths[window], pa.int64()),
            pa.array(room[window], pa.int64()),
        ]
        self.sequence += len(lengths)
        rest = []
        if limit < len(stream):
            d = int(np.searchsorted(ends, limit, "right"))
            for i in range(d, len(self.ids)):
                skip = max(0, limit - int(heads[i]))
                rest.append((self.ids[i], self.tokens[i][skip:], self.begin[i] + skip, self.total[i]))
        self.clear()
        for x in rest:
            self._push(*x)
        return pa.RecordBatch.from_arrays(columns, NAMES) if len(start) else None


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_padded"]


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, text: str = "text", ident: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, sequence_padded.

    A document is its ids and then id 0; a null or empty text is id 0 alone.  Every partition is packed by itself, in
    the order of its rows, without a shuffle; ``sequence_id`` is the partition's number times 2**32 plus the sequence's
    number there.  Long documents are cut over several sequences, rows without id or with one id several times are
    packed like any other, and columns other than the two named are ignored.
    """

    def run(batches):
        packer = _Packer(Tokenizer(tokenizer_path, pattern), limit, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(i.as_py(), t.as_py())
                if packer.size >= BLOCK and (out := packer.flush(False)):
                    yield out
        if out := packer.flush(True):
            yield out

    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))
