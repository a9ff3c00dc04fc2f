"""Token-ID shards with a minimal perfect hash index over document keys."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import ceil_div, new_path, opened, put_file, stored, text_of

#: Shard file: magic, bytes an id, then raw little-endian ids.
MAGIC = b"DLTOKEN1"
HEADER = struct.calcsize("<8sQ")
#: Id that ends each document.
END_ID = 1
ENTRIES = "doc_id long, seen long, shard long, path string, at long, n_tokens long"


# --- minimal perfect hash -----------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of the splitmix kind over an array."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, missing: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Hash of (doc_id or null, how many rows of that doc_id came before)."""
    return mixed(mixed(doc_id.astype(np.int64).view(np.uint64), 1) ^ mixed(seen.astype(np.uint64), 2 + 0), 3) ^ missing.astype(np.uint64)


class PerfectHash:
    """Keys to 0..n-1 without gaps: a cascade of bit arrays.

    At each level a key goes to a bit by its hash; bits met by one key are kept,
    keys that collide go on to the next level. A key's number is the rank of its
    bit: the rank stored with its 64-bit word and the bits before it in that
    word. About two levels are looked into for a key, whatever n, and a stored
    table is used as it lies, without being unpacked.
    """

    LEVELS = 48

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        #: (bits, words, number of the first key of each word)
        self.levels = levels

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, rest, before = [], hashes, 0
        for level in range(cls.LEVELS):
            if not len(rest):
                return cls(levels)
            size = 64 * max(1, ceil_div(2 * len(rest), 64))
            at = (mixed(rest, level + 11) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            held = np.bitwise_count(words).astype(np.int64)
            levels.append((size, words, (before + np.cumsum(held) - held).astype("<u8")))
            before += int(held.sum())
            rest = rest[~alone[at]]
        raise ValueError("two keys have the same hash")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each key; -1 for some that are no keys (others get a number: hold the fingerprint against it)."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        one = np.uint64(1)
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = mixed(hashes[left], level + 11) % np.uint64(size)
            place, bit = (at >> np.uint64(6)).astype(np.int64), one << (at & np.uint64(63))
            own = words[place]
            hit = (own & bit) != 0
            out[left[hit]] = ranks[place[hit]].astype(np.int64) + np.bitwise_count(own[hit] & (bit[hit] - one))
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", len(self.levels)) + b"".join(struct.pack("<Q", size) + words.tobytes() + ranks.tobytes() for size, words, ranks in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The table over ``raw`` itself, and where it ends."""
        (n,), at, levels = struct.unpack_from("<Q", raw), 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", raw, at)
            words = size // 64
            levels.append((size, np.frombuffer(raw, "<u8", words, at + 8), np.frombuffer(raw, "<u8", words, at + 8 + 8 * words)))
            at += 8 + 16 * words
        return cls(levels), at


def index_bytes(hashes: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """Index of one bucket: the perfect hash, then fingerprint, shard, offset and length by slot."""
    table = PerfectHash.build(hashes)
    slot = table.find(hashes)
    rows = np.empty(len(hashes), dtype=[("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
    rows["print"][slot], rows["shard"][slot], rows["at"][slot], rows["n"][slot] = mixed(hashes, 7) >> np.uint64(32), shard, at, n
    return table.to_bytes() + rows.tobytes()


def look_up(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    """Index rows of the keys; KeyError for a key whose fingerprint differs."""
    table, at = PerfectHash.from_bytes(raw)
    rows = np.frombuffer(raw, dtype=[("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")], offset=at)
    slot = table.find(hashes)
    if len(slot) and (slot < 0).any():
        raise KeyError("no such key")
    found = rows[slot]
    if (found["print"] != (mixed(hashes, 7) >> np.uint64(32)).astype(np.uint32)).any():
        raise KeyError("fingerprint differs")
    return found


# --- encoding -----------------------------------------------------------------------------------


#: The one kind of tokenizer that ids are put together word by word for; of any other kind each text is encoded as a whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that normalization leaves one letter each.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_by_word(spec: dict) -> bool:
    """Whether a text's ids are those of its words in order, whatever the text.

    So it is where white space is dropped by the pre-tokenizer before it cuts,
    normalization works within words (NFC joins nothing to ASCII white space and
    lower case is by character), nothing is added or cut off, and no added token
    holds white space or takes any in.
    """
    pre = spec.get("pre_tokenizer") or {}
    split, *rest = pre.get("pretokenizers") or [{}]
    plain = split.get("type") == "Split" and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
    plain = plain and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
    added = spec.get("added_tokens") or []
    quiet = all(t["content"] and not any(c.isspace() for c in t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
    return plain and quiet and spec.get("normalizer") == NORMALIZER and not spec.get("truncation") and not spec.get("padding") and spec["model"].get("dropout") is None


class Encoder:
    """Ids of whole texts from the tokenizers library, each distinct word encoded once.

    Where ``word_by_word`` says so, texts are cut at ASCII white space and their
    distinct words go to the library. Of these, marks at the end of a word are
    cut off where the tokenizer itself cuts between the word's last character and
    a mark, and ASCII words go in lower case. A word that holds an added token in
    any case goes as it is. The memory of words is emptied at ``most`` entries.
    """

    def __init__(self, path: str, most: int = 500_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = word_by_word(spec)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        suffix = spec["model"].get("end_of_word_suffix")
        self.word_ends = None
        if self.by_word and suffix:
            self.word_ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.word_ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.ends: dict[str, bool] = {c: c.isalnum() for c in map(chr, range(128))}

    def learn(self, parts: list[str]) -> None:
        """Ids of words not known yet. Words of plain letters are one piece each, whose last token says that a word ends there, so that many go as one text."""
        plain, other = [], []
        for x in parts:
            (plain if self.word_ends is not None and LETTERS(x) else other).append(x)
        for k in range(0, len(plain), 10_000):
            some = plain[k : k + 10_000]
            joined = [" ".join(some[i : i + 100]) for i in range(0, len(some), 100)]
            ids = np.concatenate([np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            self.keep(some, ids, np.flatnonzero(self.word_ends[ids]) + 1)
        for k in range(0, len(other), 10_000):
            some = other[k : k + 10_000]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.keep(some, np.array([i for ids in got for i in ids], self.dtype), np.cumsum([len(x) for x in got]))

    def keep(self, words: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        raw, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))

    def cuts_after(self, char: str) -> bool:
        """Whether the tokenizer cuts between this character and a mark behind it."""
        known = self.ends.get(char)
        if known is None:
            normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            known = self.ends[char] = all(pre.pre_tokenize_str(normal.normalize_str(char + m))[-1][0] == m for m in MARKS)
        return known

    def stems(self, words) -> np.ndarray:
        """Bytes of each word (an Arrow array) before the marks at its end; all of them where the word must stay whole."""
        import pyarrow as pa
        import pyarrow.compute as pc

        full = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        bare = pc.ascii_rtrim(words, characters=MARKS)
        size = pc.binary_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero((size < full) & (size > 0))
        for token in self.added:
            cut = cut[~pc.match_substring(words.take(pa.array(cut)), pattern=token, ignore_case=True).to_numpy(zero_copy_only=False)]
        last = pc.utf8_slice_codeunits(bare.take(pa.array(cut)), -1).dictionary_encode()
        good = np.array([self.cuts_after(c) for c in last.dictionary.to_pylist()], bool)
        out = full.copy()
        if len(cut):
            fine = cut[good[last.indices.to_numpy(zero_copy_only=False)]]
            out[fine] = size[fine]
        return out

    def words(self, words):
        """Ids of distinct words, an Arrow array, as bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pa.concat_arrays([words.cast(pa.string())])  # from its own start
        if not len(words):
            return pa.array([], pa.binary())
        bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
        halves = np.empty(2 * len(words) + 1, np.int32)
        halves[::2] = bounds
        halves[1::2] = bounds[:-1] + self.stems(words)
        # stems and marks one after the other, over the same bytes
        parts = pa.Array.from_buffers(pa.string(), 2 * len(words), [None, pa.py_buffer(halves), words.buffers()[2]]).dictionary_encode()
        texts = parts.dictionary
        plain = pc.string_is_ascii(texts)
        for token in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, pattern=token, ignore_case=True)))
        keys = pc.if_else(plain, pc.ascii_lower(texts), texts).to_pylist()
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        got = [known.get(x) for x in keys]
        self.learn(list({x for x, ids in zip(keys, got, strict=True) if ids is None}))
        ids = pa.array([known[x] if ids is None else ids for x, ids in zip(keys, got, strict=True)], pa.binary()).take(parts.indices)
        joined = np.ascontiguousarray(np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[::2])
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(joined), ids.buffers()[2]])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, each ended by ``END_ID``, one after the other; ids of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        width, end = self.dtype.itemsize, np.array([END_ID], self.dtype)
        if not self.by_word:
            got = [np.array([*x.ids, END_ID], self.dtype) for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([end[:0], *got]), np.array([len(x) for x in got], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        pieces = pa.concat_arrays([self.words(flat.dictionary), pa.array([end.tobytes()], pa.binary())])
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        which = np.insert(flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), stops, len(pieces) - 1)
        out = pieces.take(pa.array(which))
        bounds = np.frombuffer(out.buffers()[1], np.int32, len(out) + 1)[np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])]
        return np.frombuffer(out.buffers()[2], self.dtype, int(bounds[-1]) // width), np.diff(bounds).astype(np.int64) // width


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a Python worker, kept across tasks."""
    return Encoder(path)


def write_shards(docs: DataFrame, tokenizer: str, *, slice_bytes: int = 4 << 20) -> DataFrame:
    """Encodes every text and writes one shard file a partition, in ascending doc_id order.

    Returns a stored row for each document: key (doc_id and how many rows of that
    id came before), shard, path, offset and number of ids. Null doc_ids come
    first, rows of one doc_id are ordered by text. Null texts are empty and have
    the end id only. Files take their name when whole; the stored rows name those
    of finished tasks only.
    """
    target = new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        tool = encoder(tokenizer)
        ids, counts = [], []

        def slices():
            for batch in (b for part in ([head], batches) for b in part):
                size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
                cuts = np.flatnonzero(np.diff(size // slice_bytes)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                    if b > a:
                        yield batch.slice(a, b - a)

        def put(out):
            out.write(struct.pack("<8sQ", MAGIC, tool.dtype.itemsize))
            for part in slices():
                got, n = tool.encode(part.column(1))
                out.write(got.tobytes())
                ids.append(part.column(0))
                counts.append(n)

        path = put_file(target, f"shard-{shard:06d}-{context.taskAttemptId()}.ids", put)
        keys = pa.chunked_array(ids, pa.int64())
        n = np.concatenate(counts)
        doc_id, missing = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy()
        new = np.concatenate([[True], (doc_id[1:] != doc_id[:-1]) | (missing[1:] != missing[:-1])])
        place = np.arange(len(n))
        seen = place - np.maximum.accumulate(np.where(new, place, 0))
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        yield from pa.table({"doc_id": keys, "seen": seen, "shard": np.full(len(n), shard, np.int64), "path": pa.array([path] * len(n)), "at": at, "n_tokens": n}).to_batches()

    return stored(rows.mapInArrow(write, ENTRIES), "token-entries")


def hashed(frame: pd.DataFrame) -> np.ndarray:
    ids = frame["doc_id"].astype("Int64")
    return key_hash(ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(), frame["seen"].to_numpy(np.int64))


def bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "seen"), F.lit(buckets)).cast("int"))


def build_index(entries: DataFrame, *, bucket_rows: int = 65536) -> DataFrame:
    """One perfect-hash index a bucket of about ``bucket_rows`` keys: (bucket, index)."""
    buckets = max(1, ceil_div(entries.count(), bucket_rows))

    def build(keys, frame: pd.DataFrame) -> pd.DataFrame:
        raw = index_bytes(hashed(frame), frame["shard"].to_numpy(), frame["at"].to_numpy(), frame["n_tokens"].to_numpy())
        return pd.DataFrame({"bucket": [int(keys[0])], "index": [raw]})

    index = stored(bucketed(entries.select("doc_id", "seen", "shard", "at", "n_tokens"), buckets).groupBy("bucket").applyInPandas(build, "bucket int, index binary"), "token-index")
    index._buckets = buckets
    return index


def read_back(keys: DataFrame, index: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents with these keys, by index and shard files."""

    def find(_, frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        got = look_up(own["index"].iloc[0], hashed(frame)) if len(frame) else np.empty(0, dtype=[("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "shard": got["shard"].astype(np.int64), "at": got["at"].astype(np.int64), "n_tokens": got["n"].astype(np.int64)})

    placed = bucketed(keys, index._buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "doc_id long, shard long, at long, n_tokens long")
    shards = entries.groupBy("shard").agg(F.sum("n_tokens").alias("total"), F.first("path").alias("path"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = stored(shards.withColumn("base", F.coalesce(F.sum("total").over(order), F.lit(0))), "token-shards")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, stream = None, None
        for frame in frames:
            sums = []
            for row in frame.itertuples(index=False):
                if row.path != path:
                    system, name = opened(row.path)
                    path, stream = row.path, system.open_input_file(name)
                    magic, width = struct.unpack("<8sQ", stream.read_at(HEADER, 0))
                    if magic != MAGIC:
                        raise ValueError(f"no token shard: {path}")
                raw = stream.read_at(width * row.n_tokens, HEADER + width * row.at)
                sums.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "start": frame["base"] + frame["at"], "n_tokens": frame["n_tokens"], "ids_crc32": np.array(sums, np.int64)})

    joined = placed.join(shards.select("shard", "path", "base"), "shard").select("path", "base", "doc_id", "at", "n_tokens")
    return joined.repartition("path").sortWithinPartitions("path", "at").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
