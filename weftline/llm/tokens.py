"""Token counts of whole texts under a public byte-pair vocabulary, by merging symbols on a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

#: Words and pieces whose counts a worker remembers, and the longest one that it does: two tables of each, at most some 300 MB.
KNOWN, LONGEST = 1 << 19, 64
LIMIT = 2048
#: Characters of a text that are parted into words at once, up to the next white space.
CHUNK = 1 << 16


class _Known:
    """Counts by string, for the strings met lately: a full table becomes the old one, out of which what is asked again is taken over."""

    def __init__(self):
        self.new, self.old = {}, {}

    def get(self, key: str) -> int | None:
        n = self.new.get(key)
        if n is None:
            n = self.old.get(key)
            if n is not None:
                self.put(key, n)
        return n

    def put(self, key: str, n: int) -> int:
        if len(key) <= LONGEST:
            if len(self.new) >= KNOWN:
                self.new, self.old = {}, self.new
            self.new[key] = n
        return n


def merged(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols are left when the adjacent pair of the lowest rank, the leftmost of equals, is joined until none is known.
    pairs: (left, right) to (rank, what they become). Symbols form a linked list; pairs that a merge has undone stay in the
    heap and are told when they come up, as the symbols at their place then make another pair or none."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(pairs[p][0], i, pairs[p][1]) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, becomes = heapq.heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        found = pairs.get((symbols[i], symbols[j]))
        if found is None or found[1] != becomes:
            continue
        symbols[i], symbols[j] = becomes, -1
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = pairs.get((becomes, symbols[k]))
            if found:
                heapq.heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0:
            found = pairs.get((symbols[h], becomes))
            if found:
                heapq.heappush(heap, (found[0], h, found[1]))
    return left


def counter(spec: str) -> Callable[[str], int]:
    """The function from a text to its number of tokens. spec: a tokenizer file's JSON, whose own normalizer and rule for parting
    words are used; its merges are applied here.

    White space parts words under these files' rules and no normal form reaches across it, so a word's count does not depend on its
    surroundings, and common words are counted once a worker."""
    from tokenizers import Tokenizer

    parts = json.loads(spec)
    model = parts["model"]
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
        raise ValueError("a byte-pair vocabulary without prefixes, byte fallback or an unknown token is needed")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in parts["added_tokens"]):
        raise ValueError("added tokens must stand for themselves")
    ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs[ids[a], ids[b]] = rank, ids[a + b]
    bare = Tokenizer.from_str(json.dumps(parts | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
    added = [t["content"] for t in parts["added_tokens"]]
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    words, pieces = _Known(), _Known()
    single, last = {c: i for c, i in ids.items() if len(c) == 1}, {c[: len(c) - len(end)]: i for c, i in ids.items() if len(c) == len(end) + 1 and c.endswith(end)}

    def of_piece(piece: str) -> int:
        n = pieces.get(piece)
        if n is None:
            said = list(map(single.get, piece))
            said[-1] = last.get(piece[-1])
            if None in said:
                said = [s for s in said if s is not None]
            n = pieces.put(piece, merged(said, pairs))
        return n

    def normal(text: str) -> str:
        return bare.normalizer.normalize_str(text) if bare.normalizer else text

    def cut(text: str) -> list[tuple[str, tuple[int, int]]]:
        return bare.pre_tokenizer.pre_tokenize_str(text) if bare.pre_tokenizer else [(text, (0, len(text)))]

    def of_word(word: str) -> int:
        between = special.split(word) if special else [word]
        return len(between) - 1 + sum([of_piece(piece) for part in between if part for piece, _ in cut(normal(part)) if piece])

    def of_words(some: list[str]) -> list[int]:
        """Counts of new words, all at once: as they hold no space and no special string, each is one word of the normal line as well."""
        line = " ".join(some)
        plain = (line.isascii() or line.split() == some) and not (special and special.search(line))
        forms = (line := normal(line)).split(" ") if plain else []
        if len(forms) != len(some):
            return [of_word(w) for w in some]
        out, k, end = [0] * len(some), 0, len(forms[0])
        for piece, (at, _) in cut(line):
            while at >= end:
                k += 1
                end += len(forms[k]) + 1
            n = pieces.new.get(piece)
            out[k] += of_piece(piece) if n is None else n
        return out

    word, space = re.compile(WORD), re.compile(SPACE)

    def of_text(text: str) -> int:
        total = at = 0
        while at < len(text):
            ends = space.search(text, at + CHUNK)
            to = ends.start() if ends else len(text)
            found = word.findall(text, at, to)
            counts = list(map(words.new.get, found))
            if None in counts:
                new: dict[str, int] = {}
                for i in [i for i, n in enumerate(counts) if n is None]:
                    w, counts[i] = found[i], words.get(found[i])
                    if counts[i] is None:
                        new[w] = new.get(w, 0) + 1
                        counts[i] = 0
                for (w, times), n in zip(new.items(), of_words(list(new)) if new else ()):
                    total += times * words.put(w, n)
            total += sum(counts)
            at = to
        return total

    return of_text


@lru_cache(maxsize=1)
def _kept(spec: str, run: str) -> Callable[[str], int]:
    """The counter of this Python worker, with what it remembers: tasks of one run (any name) that follow each other there share it; another run starts anew."""
    return counter(spec)


def _counted(spec: str, run_id: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        count = None
        for batch in batches:
            count = count or _kept(spec, run_id)
            n = pa.array([count(t.as_py() or "") for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens above limit) of every whole text. vocabulary: the path, on the driver, of
    a tokenizer file (JSON, byte pairs), which travels to the tasks.

    Strings of special tokens inside texts are one token each; no beginning or end is counted. One pass without a shuffle: a row's
    work depends on no other row. Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows stay as they are; other
    columns of docs are not read. A text of any length is read word by word; only an unbroken run of letters is held as a list."""
    spec = Path(vocabulary).read_text(encoding="utf-8")
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counted(spec, uuid.uuid4().hex), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
