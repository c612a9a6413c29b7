"""SentencePiece encoding and decoding with source offsets.

Normalisation reads the model's compiled character map, a double-array trie, by longest prefix
and records for every normalised character which source bytes it came from; a piece's span is
the source range of its characters. Pairs are then merged by score, leftmost first, and pieces
outside the vocabulary fall back to bytes. Where no piece has a space marker after another
character, as in vocabularies split at white space, a text is the sequence of its marked words,
and each distinct word is normalised and merged once per worker process: its ids and the source
widths of its pieces are put one after the other in every text that holds it.
"""

from __future__ import annotations

import heapq
import re
import struct
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, process_cache

SPACE = "▁"
#: Words and their ids that a worker process keeps.
CACHED_WORDS = 1_200_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """Longest-prefix rewriting by a compiled map: size, double-array units, rewritten strings."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Source bytes and rewriting of the longest entry that starts at `at`."""
        units, found = self.units, None
        if not units:
            return None
        node = _offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)].decode()


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class PieceCoder:
    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        if model.trainer_spec.model_type != 2:
            raise ValueError("only models of byte-pair merges are read")
        rules = model.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.suffix = rules.add_dummy_prefix, model.trainer_spec.treat_whitespace_as_suffix
        self.squeeze, self.escape = rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER, _UNUSED)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (_NORMAL, _USER, _UNUSED)}
        self.user = sorted((p for p, k in zip(self.pieces, self.kinds) if k == _USER), key=len, reverse=True)
        self.unused = {p for p, k in zip(self.pieces, self.kinds) if k == _UNUSED}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == _UNKNOWN)
        self.bytes = [i for _, i in sorted((int(p[3:5], 16), i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE)]
        self.surface = model.trainer_spec.unk_surface
        self.by_word = self.escape and not self.suffix and not self.user and not self.unused and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.by_line = self.by_word and not any("\n" in p and len(p) > 1 for p in self.ids)
        self.plain = self.by_line and not self.map.units and self.prefix and not self.squeeze and bool(self.bytes)
        self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.by_line else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}
        self.known_chunks: dict[str, bytes] = {}
        self.names = [str(i) for i in range(len(self.pieces))]
        self.texts = [self._text(i) for i in range(len(self.pieces))]

    # -- normalisation -------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its characters and its end, the source byte it starts at."""
        if not text:
            return "", [0]
        if self.escape and not (self.map.units or self.user or self.squeeze):  # every character stands for itself
            starts = [*range(len(text) + 1)] if text.isascii() else [0, *accumulate([len(c.encode()) for c in text])]
            normal = text.replace(" ", SPACE)
            if not self.prefix:
                return normal, starts
            return (normal + SPACE, starts + starts[-1:]) if self.suffix else (SPACE + normal, [0] + starts)
        data = text.encode()
        out: list[str] = []
        spans: list[tuple[int, int]] = []  # source bytes of each normalised character
        at, marker, spaced = 0, SPACE if self.escape else " ", self.squeeze
        while at < len(data):
            used, new = self._next(data, at)
            if spaced:
                new = new.lstrip(" ")
            if new:
                out += new.replace(" ", marker)
                spans += [(at, at + used)] * len(new)
                spaced = self.squeeze and new.endswith(" ")
            at += used
        if self.squeeze:
            while out and out[-1] == marker:
                out.pop()
                spans.pop()
            if not out:
                return "", [len(data)]
        end = spans[-1][1]
        starts = [a for a, _ in spans]
        if self.prefix:
            out, starts = (out + [marker], starts + [end]) if self.suffix else ([marker] + out, [starts[0]] + starts)
        return "".join(out), starts + [end]

    def _next(self, data: bytes, at: int) -> tuple[int, str]:
        for piece in self.user:
            if data.startswith(raw := piece.encode(), at):
                return len(raw), piece
        found = self.map.longest(data, at)
        if found:
            return found
        lead = data[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return width, data[at : at + width].decode()

    # -- merging -------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Pieces of a normalised text: the best-scored neighbours merge first, the leftmost of equals."""
        symbols = self._symbols(text)
        if len(symbols) > 40 or self.unused or self.user:
            return self._merge_long(symbols)
        score, none = self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(symbols[at - 1] + symbols[at], none)
            if at < len(pairs):
                pairs[at] = score(symbols[at] + symbols[at + 1], none)
        return symbols

    def _symbols(self, text: str) -> list[str]:
        if not self.user:
            return list(text)
        return re.findall("|".join(map(re.escape, self.user)) + "|.", text, re.S)

    def _merge_long(self, symbols: list[str]) -> list[str]:
        n, frozen = len(symbols), set(self.user)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, str]] = []
        split: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or symbols[a] in frozen or symbols[b] in frozen:
                return
            joined = symbols[a] + symbols[b]
            if joined in self.scores:
                heapq.heappush(queue, (-self.scores[joined], a, b, joined))
                if joined in self.unused:
                    split[joined] = symbols[a], symbols[b]

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != joined or after[a] != b:
                continue
            symbols[a], symbols[b] = joined, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])

        def parts(piece: str) -> list[str]:
            return [x for p in split[piece] for x in parts(p)] if piece in split else [piece]

        return [x for s in symbols if s for x in parts(s)]

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    # -- whole texts ---------------------------------------------------------------------------

    def _pieces(self, normal: str) -> list[str]:
        if not self.by_word:
            return self.merge(normal)
        return [p for chunk in self.chunks(normal) for p in self.merge(chunk)]

    def aligned(self, text: str | None):
        """Ids, and arrays of the source bytes where each begins and ends; the bytes of one character share them."""
        import numpy as np

        text = text or ""
        if text and self.plain and SPACE not in text:
            return self._of_words(text)
        normal, starts = self.normalise(text)
        ids, spans, at = [], [], 0
        for piece in self._pieces(normal):
            some = self.piece_ids(piece)
            ids += some
            spans += [(starts[at], starts[at + len(piece)])] * len(some)
            at += len(piece)
        if not self.bytes:
            ids, spans = _joined_unknowns(ids, spans, self.unknown)
        begins, ends = np.array(spans, np.int64).reshape(-1, 2).T
        return ids, begins, ends

    def encode(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and the source bytes [begin, end) of each; the bytes of one character share its span."""
        ids, begins, ends = self.aligned(text)
        return ids, list(zip(begins.tolist(), ends.tolist()))

    def _of_words(self, text: str):
        """`aligned` from the ids and source widths of the text's words."""
        import numpy as np

        if text[0] == " " or " \n" in text or "  " in text:
            store, keys = self.known_chunks, self.chunks(SPACE + text.replace(" ", SPACE))
        else:  # a word stands for the marker and itself, one after a line end for that end and itself
            store, keys = self.known, text.replace("\n", " \n").split(" ")
        try:
            known = b"".join(map(store.__getitem__, keys))
        except KeyError:
            if len(store) > CACHED_WORDS:
                store.clear()
            for k in keys:
                if k not in store:
                    if store is self.known_chunks:
                        store[k] = self._learn(k)
                    elif k[:1] == "\n":
                        store[k] = self._learn("\n") + (self._learn(k[1:]) if len(k) > 1 else b"")
                    else:
                        store[k] = self._learn(SPACE + k)
            known = b"".join(map(store.__getitem__, keys))
        ids, widths, spans = np.frombuffer(known, "<i4").reshape(-1, 3).T
        ends = widths.cumsum(dtype=np.int64) - 1  # no source byte is behind the marker that encoding puts first
        return ids.tolist(), np.maximum(ends - spans, 0), ends

    def _learn(self, chunk: str) -> bytes:
        """Of a chunk of a normalised text every id, the source bytes it adds and those of its whole character or piece."""
        marked = chunk[0] == SPACE
        normal, starts = self.normalise(chunk[marked:].replace(SPACE, " ")) if len(chunk) > marked else (SPACE, [0, 0])
        if not marked:
            normal, starts = normal[1:], starts[1:]
        rows, at = [], 0
        for piece in self.merge(normal):
            end = at + len(piece)
            width = starts[end] - starts[at] + (marked and at == 0)
            added = width
            for i in self.piece_ids(piece):
                rows += i, added, width
                added = 0
            at = end
        return struct.pack(f"<{len(rows)}i", *rows)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the marker that encoding put first."""
        dropped, marks = 0, (self.prefix or self.squeeze) and not self.suffix
        for i in ids if marks else []:
            if self.kinds[i] != _CONTROL:
                dropped += self.kinds[i] != _BYTE and self.pieces[i].startswith(SPACE)
                if not self.squeeze or self.pieces[i] != SPACE:  # where spaces are squeezed, lone first markers all go
                    break
        return self._decoded(ids)[dropped:]

    def _text(self, i: int) -> str:
        """What an id alone stands for; a byte over 127 is a lone surrogate until its neighbours are known."""
        kind = self.kinds[i]
        if kind == _BYTE:
            byte = int(self.pieces[i][3:5], 16)
            return chr(byte if byte < 128 else 0xDC00 + byte)
        return self.surface if kind == _UNKNOWN else "" if kind == _CONTROL else self.pieces[i].replace(SPACE, " ")

    def _decoded(self, ids: list[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            text = _HIGH.sub(lambda m: _utf8(bytearray(ord(c) - 0xDC00 for c in m.group())), text)
        return text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from them."""
        import hashlib

        ids, _, _ = self.aligned(text)
        ids_hash = hashlib.sha256(",".join(map(self.names.__getitem__, ids)).encode())
        return len(ids), ids_hash.hexdigest(), hashlib.sha256((self.decode(ids) if ids else "").encode()).hexdigest()


_HIGH = re.compile("[\udc80-\udcff]+")


def _utf8(raw: bytearray) -> str:
    """The characters of `raw`; each byte that belongs to none becomes a replacement character."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _joined_unknowns(ids, spans, unknown):
    out: list[int] = []
    where: list[tuple[int, int]] = []
    for i, span in zip(ids, spans):
        if out and i == unknown == out[-1]:
            where[-1] = where[-1][0], span[1]
        else:
            out.append(i)
            where.append(span)
    return out, where


def coder(path: str) -> PieceCoder:
    cache = process_cache("pieces")
    if path not in cache:
        with open(path, "rb") as file:
            cache[path] = PieceCoder(file.read())
    return cache[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends): every id of a text with the source bytes it stands for.

    A null text is the empty one, which has no ids; every row, repeated ones too, gives a row.
    """

    def run(batches):
        import pyarrow as pa

        code = coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [code.aligned(t.as_py()) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([i for i, _, _ in found], pa.list_(pa.int32())),
                        pa.array([begins for _, begins, _ in found], pa.list_(pa.int64())),
                        pa.array([ends for _, _, ends in found], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "ids", "begins", "ends"],
                )

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""

    def run(batches):
        import pyarrow as pa

        code = coder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(ids.as_py()) if ids.as_py() else "" for ids in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row: encoded, then decoded."""

    def run(batches):
        import pyarrow as pa

        code = coder(model)
        for batch in batches:
            found = [code.digest(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents(docs, id_col, text_col).select(F.col("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
