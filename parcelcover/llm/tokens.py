"""Token counts of whole texts under a byte-level BPE vocabulary, without making any ids.

Texts are cut into pre-tokens once. A block of documents shares one dictionary of pre-tokens; each document keeps its
frequencies as places in that dictionary and counts, packed into a few bytes a pre-token. Dictionary entries of all
blocks meet by pre-token, where each distinct one is split into pieces once and only their number is kept; the numbers
go back to their block, where they are weighted by each document's frequencies and summed.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcover.llm.bpe import Bpe, byte_letters, public_path
from parcelcover.plans.materialize import materialize, release

#: A block ends at so many different pre-tokens, or bytes of them; entries whose piece counts a task holds at a time.
ENTRIES, ENTRY_BYTES, HELD = 600_000, 32 << 20, 1 << 20
#: Fixed: how the vocabulary's file format splits a text where it says ``use_regex``. White space is Unicode's.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed: letters and numbers assigned after Unicode 16, which the vocabulary's library doesn't know and takes for symbols.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def newer_class() -> str:
    ends = [[chr(int(x, 16)) for x in r.split("-")] for r in NEWER.split()]
    return "[" + "".join(f"{e[0]}-{e[-1]}" for e in ends) + "]"


def split_pattern(without: str = "") -> regex.Pattern:
    """SPLIT; characters of the class without count as neither letters nor numbers."""
    p = SPLIT.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    if without:
        letter, number = rf"[\p{{L}}--{without}]", rf"[\p{{N}}--{without}]"
        p = p.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[^\p{{White_Space}}{letter}{number}]").replace(r" ?\p{L}+", f" ?{letter}+").replace(r" ?\p{N}+", f" ?{number}+")
    return regex.compile(p, regex.V1 if without else 0)


class ByteBpe(Bpe):
    """A tokenizer file of kind byte-level BPE without normaliser; merges as in the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, cut = j["model"], j["pre_tokenizer"]
        kind = (model["type"], cut["type"], cut["use_regex"], cut["add_prefix_space"], model.get("ignore_merges", False), j["normalizer"])
        if kind != ("BPE", "ByteLevel", True, False, False, None):
            raise ValueError(f"not a plain byte-level BPE file: {kind}")
        self.vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges]
        self.ranks = {a << 32 | b: k for k, (a, b, _) in enumerate(self.merges)}
        self.first = self.last = [self.vocab[x] for x in byte_letters()]
        added = sorted((x["content"] for x in j["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, added))) if added else None
        newer = newer_class()
        self.split, self.careful = split_pattern(), split_pattern(newer)
        self.far, self.newer = regex.compile(f"[{newer[1]}-{chr(sys.maxunicode)}]"), regex.compile(newer)

    def cut(self, text: str) -> list[str]:
        """The text's pre-tokens. The far slower pattern is only for texts with one of the newer characters."""
        old = text.isascii() or not self.far.search(text) or not self.newer.search(text)
        return (self.split if old else self.careful).findall(text)

    def pretokens(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token occurs, and how many added tokens stand in the text: each is one token and cuts it."""
        parts = self.specials.split(text) if self.specials else [text]
        found = Counter(self.cut(parts[0]))
        for part in parts[1:]:
            found.update(self.cut(part))
        return found, len(parts) - 1

    def pieces(self, pretoken: str) -> int:
        return len(self.merge(pretoken))


_loaded: dict[str, ByteBpe] = {}


def load(vocabulary: str) -> ByteBpe:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = ByteBpe(vocabulary if "/" in vocabulary else public_path(vocabulary))
    return _loaded[vocabulary]


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places as differences, and their counts, byte by byte of equal weight, compressed."""
    order = np.argsort(places)
    both = np.concatenate([np.diff(places[order], prepend=0), counts[order]]).astype("<u4").reshape(2, -1)
    return zlib.compress(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, 4, -1)
    both = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(both[0]), both[1]


_BLOCKS = "block long, place int, pretoken string, doc_id long, n_bytes long, special long, packed binary"
_ARROW = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("pretoken", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("special", pa.int64()), ("packed", pa.binary())])


def frequencies(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Blocks of documents: a row for each document with its packed frequencies, and (place, pretoken) rows of the
    block's dictionary. A block's number is that of the task and of its turn in it."""

    def rows(block: int, **given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        columns = {"block": pa.repeat(pa.scalar(block, pa.int64()), n)} | given
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns and isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

    def entries(block: int, places: dict[str, int]):
        names = list(places)
        for k in range(0, len(names), 50_000):
            some = names[k : k + 50_000]
            yield rows(block, place=np.arange(k, k + len(some), dtype=np.int32), pretoken=some)

    def run(batches):
        from pyspark import TaskContext

        bpe, block, places, held = load(vocabulary), TaskContext.get().partitionId() << 32, {}, 0
        for x in batches:
            texts, ids, k = x.column("text"), x.column("doc_id"), 0
            while k < len(texts):
                begin, lengths, special, packed = k, [], [], []
                while k < len(texts) and len(places) < ENTRIES and held < ENTRY_BYTES:
                    text = texts[k].as_py() or ""
                    found, extra = bpe.pretokens(text)
                    before = len(places)
                    at = np.fromiter([places.setdefault(t, len(places)) for t in found], np.int64, len(found))
                    if len(places) > before:
                        held += sum(len(t) for t, p in zip(found, at.tolist(), strict=True) if p >= before)
                    packed.append(pack(at, np.fromiter(found.values(), np.int64, len(found))))
                    lengths.append(len(text.encode()))
                    special.append(extra)
                    k += 1
                if k > begin:
                    yield rows(block, doc_id=ids.slice(begin, k - begin), n_bytes=lengths, special=special, packed=packed)
                if len(places) >= ENTRIES or held >= ENTRY_BYTES:
                    yield from entries(block, places)
                    block, places, held = block + 1, {}, 0
        yield from entries(block, places)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, _BLOCKS)


def piece_counts(dictionary: DataFrame, vocabulary: str) -> DataFrame:
    """(block, packed places and pieces) of a dictionary (block, place, pretoken). Equal pre-tokens of all blocks stand
    together in one task, in order, so that each distinct one is split once; a block has each at most once. A task
    gives a block's entries in one row for every HELD entries that it has read."""

    def packed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        block, place, pieces = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(block, kind="stable")
        numbers, starts = np.unique(block[order], return_index=True)
        rows = [pack(place[k], pieces[k]) for k in np.split(order, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(rows, pa.binary())], names=["block", "packed"])

    def run(batches):
        bpe, last, n, found, held = load(vocabulary), None, 0, [], 0
        for x in batches:
            counts = []
            for t in x.column("pretoken").to_pylist():
                if t != last:
                    last, n = t, bpe.pieces(t)
                counts.append(n)
            found.append((x.column("block").to_numpy(), x.column("place").to_numpy(), np.array(counts, np.int64)))
            held += len(counts)
            if held >= HELD:
                yield packed(found)
                found, held = [], 0
        if held:
            yield packed(found)

    return dictionary.repartition("pretoken").sortWithinPartitions("pretoken").mapInArrow(run, "block long, packed binary")


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    vocabulary names an installed file, found on each executor, or is a path with a slash. A null text counts as
    empty: no bytes, no tokens. Rows with the same or no doc_id are counted each by itself. Added tokens inside a text
    are one token each. Other columns are left aside; an empty table gives an empty one.
    """
    table = materialize(frequencies(docs, vocabulary), "frequencies")
    pieces = piece_counts(table.where("pretoken is not null").select("block", "place", "pretoken"), vocabulary)
    kept = table.where("pretoken is null").select("block", "doc_id", "n_bytes", "special", "packed")

    def total(block: pa.Table, counted: pa.Table) -> pa.Table:
        entries = [unpack(x.as_py()) for x in counted.column("packed")]
        weight = np.zeros(max((int(at[-1]) + 1 for at, _ in entries), default=0), np.int64)
        for at, pieces in entries:
            weight[at] = pieces
        sums = []
        for packed, special in zip(block.column("packed"), block.column("special").to_pylist(), strict=True):
            at, count = unpack(packed.as_py())
            sums.append(int((weight[at] * count).sum()) + special)
        return pa.table({"doc_id": block.column("doc_id"), "n_bytes": block.column("n_bytes"), "n_tokens": pa.array(sums, pa.int64())})

    summed = kept.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    out = materialize(summed.withColumn("over_limit", F.col("n_tokens") > limit), "token_counts")
    release(table)
    return out
