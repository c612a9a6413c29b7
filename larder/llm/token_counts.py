"""Token counts of whole texts by the whole-token shortcut.

Byte-level merges never cross pre-tokens, so a text's count is the sum over its pre-tokens.

1. Offline, on the driver: every vocabulary string is encoded alone. Those that come back as exactly
   their own id are proven whole: wherever such a string is a pre-token, it counts one. The table is
   bounded by the vocabulary and travels with the tasks.
2. Tasks cut texts at special strings (one token each) and into pre-tokens, count equal ones of a text
   together, look proven ones up and merge only the rest, each distinct one once per worker process.

Counting needs no shuffle. Memory holds one Arrow batch, the pre-tokens of a slice of one text and a
cache of bounded size. The counts are those of the library with its defaults: no begin, end or padding
tokens, no truncation; special strings inside a text are special tokens.

Null texts are empty and count zero. Repeated rows and equal or null ids give a row each; an empty table gives none.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, process_cache

#: Merged pre-tokens, and characters of them, that a worker process keeps.
CACHED_WORDS = 500_000
CACHED_CHARACTERS = 20_000_000
#: Letters after which, and before a blank and another letter, a long text may be cut.
SLICE = 1 << 18

#: The pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose characters `regex` and the tokenizer library class alike, as a test proves; texts with others are split by the library.
SETTLED = (
    r"\x00-\u052F\u0591-\u05F4\u0600-\u06FF\u0900-\u0977\u0E01-\u0E5B\u1E00-\u206F\u20A0-\u20BF\u2100-\u2BFF\u3000-\u30FF\u4E00-\u9FCC\uAC00-\uD7A3\uFF00-\uFFEF"
)


def byte_letters() -> dict[str, int]:
    """Letter of a vocabulary string -> byte: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and not spec["normalizer"]
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("counts need a byte-level vocabulary without a normaliser or prefix blanks")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("special strings must stand for themselves alone")
    return spec


def prove_whole(path: str) -> frozenset[str]:
    """Vocabulary strings that, encoded alone, are one token: their own."""
    from tokenizers import Tokenizer

    letters, special = byte_letters(), {t["content"] for t in _load(path)["added_tokens"]}
    texts, ids = [], []
    for token, number in Tokenizer.from_file(path).get_vocab(with_added_tokens=False).items():
        if token not in special:
            try:
                texts.append(bytes(letters[c] for c in token).decode("utf-8"))
                ids.append(number)
            except UnicodeDecodeError:  # part of a character: never a pre-token
                pass
    found = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(text for text, number, x in zip(texts, ids, found) if x.ids == [number])


class TokenCounter:
    """Counts of one vocabulary file; `whole` are its proven strings."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        import regex
        from tokenizers import Tokenizer

        spec, letters = _load(path), byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.whole = whole
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pre_tokens = regex.compile(PRE_TOKEN, regex.V0)
        self.unsettled = re.compile(f"[^{SETTLED}]").search
        self.cut = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
        self.letter = {b: c for c, b in letters.items()}
        self.rank = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            self.rank[tuple(pair.split(" ") if isinstance(pair, str) else pair)] = k
        self.merged: dict[str, int] = {}
        self.cached = 0

    def merge(self, pre_token: str) -> int:
        """Tokens of one pre-token: adjacent pairs merge by rank, leftmost first, in n log n steps."""
        parts: list[str | None] = [self.letter[b] for b in pre_token.encode("utf-8")]
        end, rank = len(parts), self.rank
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(rank[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in rank]
        heapq.heapify(heap)
        left = end
        while heap:
            order, k = heapq.heappop(heap)
            nxt = after[k] if parts[k] is not None else end
            if nxt >= end or rank.get((parts[k], parts[nxt])) != order:
                continue  # one of the two has merged meanwhile
            parts[k], parts[nxt] = parts[k] + parts[nxt], None
            after[k] = after[nxt]
            if after[k] < end:
                before[after[k]] = k
            left -= 1
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < end and (parts[a], parts[b]) in rank:
                    heapq.heappush(heap, (rank[parts[a], parts[b]], a))
        return left

    def _slices(self, text: str) -> Iterator[str]:
        """Pieces of a text whose ends are ends of pre-tokens."""
        at = 0
        while len(text) - at > 2 * SLICE and (found := self.cut.search(text, at + SLICE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _pre_tokens(self, text: str) -> list[str]:
        if self.unsettled(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return self.pre_tokens.findall(text)

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, those of them that had to be merged)."""
        parts = self.special.split(text)
        total, rest = len(parts) - 1, 0
        for part in parts:
            for piece in self._slices(part):
                for token, n in Counter(self._pre_tokens(piece)).items():
                    if token in self.whole:
                        total += n
                    else:
                        k = self.merged.get(token)
                        if k is None:
                            k = self._remember(token)
                        rest += n * k
        return total + rest, rest

    def _remember(self, token: str) -> int:
        k = self.merge(token)
        if len(token) <= 64:
            if len(self.merged) >= CACHED_WORDS or self.cached >= CACHED_CHARACTERS:
                self.merged.clear()
                self.cached = 0
            self.merged[token] = k
            self.cached += len(token)
        return k


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_merged (tokens that the table did not settle)."""
    whole = prove_whole(path)

    def run(batches):
        import pyarrow as pa

        cache = process_cache("token-counts")
        if path not in cache:
            cache[path] = TokenCounter(path, whole)
        counter = cache[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                counts = [counter.count(text.as_py()) for text in some.column(2)]
                tokens, merged = zip(*counts) if counts else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(tokens, pa.int64()), pa.array(merged, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "n_merged"],
                )

    texts = documents(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_merged long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_merged")
