"""SentencePiece BPE encoding that keeps offsets, and decoding.

Normalisation walks the text with the model's compiled character map, a double-array trie, taking the longest match at
each place; every output character remembers the input bytes it came from.  Segmentation is BPE by piece score over the
normalised text, which splits before each run of spaces where no piece of the vocabulary crosses one.  Each piece
projects through the alignment to a span of the original UTF-8 bytes.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of one generation of the cache of segments; two generations are held.
CACHE = 250_000
#: Letters and signs between which a text may be cut before segmentation, where the vocabulary has no piece over both.
LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-ɏ]", "\n\t!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharsMap:
    """Longest-prefix replacement by a compiled map: uint32 trie size, trie units, then replacements ended by NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if size else []
        self.strings = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest entry that starts at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= self._offset(unit)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != c:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Codec:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or kinds & {USER, UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without user-defined or unused pieces or space suffixes are supported")
        norm = model.normalizer_spec
        self.map = CharsMap(norm.precompiled_charsmap)
        self.prefix, self.trim, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.odd = {i for i, k in enumerate(self.kinds) if k != NORMAL}
        self.unk_surface = model.trainer_spec.unk_surface
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        # between a letter and a sign that no piece joins, either way round, no merge ever happens
        signs = "".join(c for c in SIGNS if not any(re.search(f"{LETTERS}{re.escape(c)}|{re.escape(c)}{LETTERS}", p) for p in self.ids if c in p))
        apart = f"{SPACE}*{LETTERS}+(?=[{SPACE}{re.escape(signs)}]|\\Z)|{SPACE}*[{re.escape(signs)}]+(?=[{SPACE}{LETTERS[1:]}|\\Z)|" if signs else ""
        self.split = re.compile(".+" if crosses else f"{apart}{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.plain = not self.map.units and not self.trim and self.escape
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    # normalisation

    def normalised(self, text: str) -> tuple[str, list[tuple[int, int]] | None]:
        """(normalised text, the original byte span of each of its characters; None: characters stand for themselves)."""
        if not text:
            return "", None
        if self.plain:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        data, out, spans, at = text.encode("utf-8"), [], [], 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                size, new = hit[0], hit[1].decode("utf-8")
            else:
                b = data[at]
                size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                new = data[at : at + size].decode("utf-8")
            for c in new:
                if c == " " and self.trim and (not out or out[-1] == " "):
                    continue
                out.append(c)
                spans.append((at, at + size))
            at += size
        while self.trim and out and out[-1] == " ":
            out.pop()
            spans.pop()
        if self.prefix and out:
            out.insert(0, " ")
            spans.insert(0, (spans[0][0], spans[0][0]))
        return "".join(SPACE if c == " " and self.escape else c for c in out), spans

    # segmentation

    def merged(self, word: str) -> list[str]:
        """The symbols of a segment after all merges: best score first, leftmost among equals."""
        parts, get, far = list(word), self.scores.get, float("inf")
        if len(parts) > 48:
            return self._merged_long(parts)
        ranks = [get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == far:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], far)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], far)
        return parts

    def _merged_long(self, parts: list) -> list[str]:
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        get, heap = self.scores.get, []

        def offer(i, j):
            if i >= 0 and j >= 0 and (s := get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (s, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def pieces_of(self, word: str) -> tuple[list[int], list[int]]:
        """(ids, characters of each piece) of a segment; of a character's bytes, the last one has the character."""
        ids, sizes = [], []
        for p in self.merged(word):
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
                sizes.append(len(p))
            elif self.byte:
                data = p.encode("utf-8")
                ids += [self.byte[b] for b in data]
                sizes += [0] * (len(data) - 1) + [len(p)]
            else:
                ids.append(self.unknown)
                sizes.append(len(p))
        return ids, sizes

    def segment(self, word: str) -> tuple[str, int, str, bytes]:
        """(ids joined by commas, how many, the text they decode to, advances and lengths) of a segment; remembered.

        Advances and lengths are pairs of native 32-bit numbers, a pair a piece: bytes of the original that the piece moves
        on by, and bytes of its span; a space sign is one byte.  Bytes of a character share its span, and the last moves on.
        """
        hit = self.young.get(word)
        if hit is None:
            hit = self.old.get(word)
            if hit is None:
                ids, sizes = self.pieces_of(word)
                hit = ",".join(map(str, ids)), len(ids), self._surface(ids), self._steps(word, sizes)
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = hit
        return hit

    @staticmethod
    def _steps(word: str, sizes: list[int]) -> bytes:
        out, at, run = array.array("i"), 0, 0
        for size in sizes:
            if not size:
                run += 1
                continue
            part = word[at : at + size]
            width = len(part.encode("utf-8")) - 2 * part.count(SPACE)
            out.extend([0, width] * run + [width, width])
            at, run = at + size, 0
        return out.tobytes()

    # the interface

    def encode(self, text: str | None) -> list[int]:
        norm, _ = self.normalised(text or "")
        return [i for w in self.split.findall(norm) for i in self.pieces_of(w)[0]]

    def encode_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece, in bytes of the original text; bytes of one character share its span."""
        norm, spans = self.normalised(text or "")
        if spans is None:
            raw, at, spans = text or "", 0, []
            if self.prefix and raw:
                spans.append((0, 0))
            for c in raw:
                size = len(c.encode("utf-8"))
                spans.append((at, at + size))
                at += size
        out, at = [], 0
        for w in self.split.findall(norm):
            ids, sizes = self.pieces_of(w)
            run = 0
            for k, (i, size) in enumerate(zip(ids, sizes, strict=True)):
                if not size:
                    run += 1
                    continue
                span = spans[at][0], spans[at + size - 1][1]
                out += [(j, *span) for j in ids[k - run : k]] + [(i, *span)]
                at, run = at + size, 0
        return out

    def _surface(self, ids) -> str:
        if not self.odd.intersection(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append("" if self.kinds[i] == CONTROL else self.unk_surface if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        text = self._surface(ids)
        return text[1:] if (self.prefix or self.trim) and text[:1] == " " else text

    def digest(self, text: str | None) -> tuple[int, str, str, str, int]:
        """(n_tokens, SHA-256 of the ids joined by commas, of the decoded text, and of the spans as ``span_digest`` takes them, end
        of the last span).  The spans are those of ``encode_spans``, put together from the remembered segments."""
        text = text or ""
        norm, spans = self.normalised(text)
        get, segment = self.young.get, self.segment
        hits = [get(w) or segment(w) for w in self.split.findall(norm)]
        decoded = "".join([h[2] for h in hits])
        if (self.prefix or self.trim) and decoded[:1] == " ":
            decoded = decoded[1:]
        ids = ",".join([h[0] for h in hits])
        if spans is not None or SPACE in text:  # a character of the original may be of other length than the normalised one
            both = np.array([x[1:] for x in self.encode_spans(text)], np.int64).reshape(-1, 2)
        else:
            steps = np.frombuffer(b"".join([h[3] for h in hits]), np.int32).reshape(-1, 2).astype(np.int64)
            ends = np.cumsum(steps[:, 0])
            begins = ends - steps[:, 0]
            both = np.stack([begins, begins + steps[:, 1]], axis=1)
            if self.prefix:
                both = np.maximum(both - 1, 0)  # the leading space sign stands for no byte
        end = int(both[-1, 1]) if len(both) else 0
        return sum([h[1] for h in hits]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), span_digest(both), end


def span_digest(spans) -> str:
    """SHA-256 of (begin, end) pairs as little-endian 64-bit numbers in the order of the pieces."""
    return hashlib.sha256(np.asarray(spans, "<i8").tobytes()).hexdigest()


@functools.cache
def codec_of(path: str) -> Codec:
    """The codec of a file, kept for the life of a Python worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: id, ids array, begins and ends (byte spans of the pieces), decoded text.

    A null text is empty and has no ids.  Rows are independent: repeated rows and null ids come back as they are, and
    columns other than the two named are ignored.
    """

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                spans = [codec.encode_spans(t) for t in rows.column(1).to_pylist()]
                ids = [[x[0] for x in s] for s in spans]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([[x[1] for x in s] for s in spans], pa.list_(pa.int32())), pa.array([[x[2] for x in s] for s in spans], pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids])], ["id", "ids", "begins", "ends", "decoded"])

    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Like ``encode_documents``, but with digests in place of the ids and the decoded text: id, n_tokens, ids_sha256,
    decoded_sha256, spans_sha256 (of every piece's span in the original), n_bytes (where the last span ends there)."""

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                out = [codec.digest(t) for t in rows.column(1).to_pylist()]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array([x[k] for x in out], kinds[k]) for k in range(5)]], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "n_bytes"])

    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_bytes long")
