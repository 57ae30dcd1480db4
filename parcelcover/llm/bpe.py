"""BPE encoding and decoding of whole texts.

A word's symbols form a doubly linked list; a heap holds the mergeable pairs by merge rank, leftmost first.
The cheapest pair is merged and its new neighbours are pushed; entries whose symbols have changed since are
skipped when they come up. Decoding puts the vocabulary strings side by side.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one generation of remembered encodings, of which there are two for chunks between white space and two
#: for the words of chunks that hold several; bytes that an entry takes besides its characters,
#: and marks of arguments that came once.
CACHE, ENTRY, MARKS = 32 << 20, 120, 1 << 20


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Recent(dict):
    """What a function made of its latest arguments, in two generations of CACHE bytes at most.

    An argument is kept from its second turn on, so that the many that come once take no room; its first turn
    leaves a mark by its hash. A result that is a large share of the limit isn't kept at all.
    """

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.old, self.limit, self.size, self.seen = make, {}, limit, 0, bytearray(MARKS)

    def __missing__(self, key: str) -> str:
        value = self.old.get(key)
        if value is None:
            value, mark = self.make(key), hash(key) % MARKS
            if not self.seen[mark]:
                self.seen[mark] = 1
                return value
        size = ENTRY + len(key) + len(value)
        if size > self.limit >> 6:
            return value
        if self.size + size > self.limit:
            self.old, self.size, self.seen = dict(self), 0, bytearray(MARKS)
            self.clear()
        self[key] = value
        self.size += size
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.size, self.seen = {}, 0, bytearray(MARKS)


class Bpe:
    """A tokenizer file of kind word-end BPE: NFC, white space runs to one space, lower case, split by a
    pattern, byte letters, merges. The file's own patterns and tables are read, never copied."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges]
        self.ranks = {a << 32 | b: k for k, (a, b, _) in enumerate(self.merges)}
        self.added = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.strings = {str(v): k for k, v in [*self.vocab.items(), *self.added.items()]}
        steps = {x["type"]: x for x in j["normalizer"]["normalizers"]}
        split = next(x for x in j["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # White space is Unicode's: Python's own class has four more characters.
        self.space = regex.compile(steps["Replace"]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.words, self.chunks = Recent(self._word, CACHE // 4), Recent(self._chunk)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: merges by rank from a heap over a linked list. An entry is the rank and the place."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.first[x] for x in data]
        ids[-1] = self.last[data[-1]]
        n, merges, rank = len(ids), self.merges, self.ranks.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        shift = n.bit_length()
        place, pop, push = (1 << shift) - 1, heapq.heappop, heapq.heappush
        heap = [k << shift | i for i in range(n - 1) if (k := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i = entry & place
            a, b, new = merges[entry >> shift]
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: a neighbour merged first
            ids[i], ids[j] = new, -1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (k := rank(new << 32 | ids[after])) is not None:
                    push(heap, k << shift | i)
            if (before := left[i]) >= 0 and (k := rank(ids[before] << 32 | new)) is not None:
                push(heap, k << shift | before)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> str:
        return " ".join(map(str, self.merge(word)))

    def _chunk(self, chunk: str) -> str:
        """What stands between white space: its words by the file's pattern. One word is remembered as a chunk only."""
        parts = self.split.findall(chunk)
        return self._word(parts[0]) if len(parts) == 1 else " ".join([self.words[w] for w in parts])

    def ids_text(self, text: str | None) -> str:
        """The text's ids in decimal, joined by a space. Added tokens count as such where they stand."""
        found: list[str] = []
        for k, part in enumerate(self.specials.split(text or "") if self.specials else [text or ""]):
            if k % 2:
                found.append(str(self.added[part]))
            elif part:
                if not part.isascii():
                    # lower case letter by letter: a final sigma is no special case
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
                found += map(self.chunks.__getitem__, filter(None, self.space.split(part)) if odd else part.split())
        return " ".join(found)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.ids_text(text).split()]

    def decode_text(self, ids: list[str]) -> str:
        """The vocabulary strings of ids in decimal, side by side."""
        return " ".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_text(list(map(str, ids)))


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def public_path(name: str) -> str:
    """Where an installed vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text); full: ids and decoded too.

    vocabulary names an installed file, found on each executor, or is a path with a slash. ids_sha256 is of
    the decimal ids joined by a space. A null text counts as empty: no ids. Repeated rows come back as often.
    Other columns are left aside; an empty table gives an empty one.
    """

    def run(batches):
        bpe = load(vocabulary if "/" in vocabulary else public_path(vocabulary))
        sha = hashlib.sha256
        for x in batches:
            rows = []
            for text in x.text:
                ids = bpe.ids_text(text if isinstance(text, str) else "")
                every = ids.split()
                strings = bpe.decode_text(every)
                row = (len(every), sha(ids.encode()).hexdigest(), sha(strings.encode()).hexdigest())
                rows.append((*row, list(map(int, every)), strings) if full else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * full])
            out.insert(0, "doc_id", x.doc_id.to_numpy())
            yield out
        # The worker outlives the task; what was remembered would lie beside the next stages' own needs.
        bpe.chunks.forget()
        bpe.words.forget()

    more = ", ids array<int>, decoded string" if full else ""
    source = docs.selectExpr("cast(cast(doc_id as long) as string) doc_id", "cast(text as string) text")  # as text: a null among numbers makes them floats
    out = source.mapInPandas(run, f"doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
