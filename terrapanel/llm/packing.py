"""Best-two-fit packing of documents into sequences of a fixed token budget.

Method: a bin is filled greedily with the longest unpacked pieces that still
fit; then its smallest piece is replaced by the two unpacked pieces that fill
the expanded gap more tightly, again and again while that narrows the gap.
Pieces under a sixth of a sequence are kept for the gaps that remain.

Pieces are dealt by hash to shards of about ``SHARD`` pieces; one task packs a
shard from lengths alone, so its memory is bounded whatever the document sizes.
Bins that stay loose (a gap over ``capacity // LOOSE``) are opened and their
pieces dealt to fewer shards, level by level, until one shard is left.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import grouped, materialize, worker_state

CAPACITY = 4096
SHARD = 8192
LOOSE = 64
#: Pieces of at most this part of a sequence are packed last, by best fit.
SMALL = 6
LEVELS = 12
VOCABULARY = "word_bpe_49k.json"
#: Words and parts of words that a Python worker keeps with their ids, in each of two generations (some 180 bytes
#: each, 72 MB in all), and the longest such word.
CACHED_WORDS, CACHED_LENGTH = 200_000, 48
#: Words of printable ASCII and the letters of U+00C0 to U+00FF.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: Fixed value: the vocabulary's pre-tokenizer pattern, for such words in lower case.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
#: The byte-level alphabet: bytes that are no printing character of Latin-1 stand at U+0100 and on, in order.
PRINTING = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: b for b in PRINTING} | {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in PRINTING)}


class WordIds:
    """Ids of texts, word by word.

    The vocabulary's pre-tokenizer never crosses white space and its normaliser
    maps every run of it to one blank that the pre-tokenizer drops, so the ids
    of a text are those of its words in order.  Python also splits at U+001C to
    U+001F, which the normaliser keeps: texts with them are encoded whole.

    Known words and parts share a table: a part alone is a word of that one part.
    A full table becomes the old one, from which words in use come back.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        self.model = self.tokenizer.model

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> list[str]:
        """Add ``words`` to the known ones; those too long to keep are returned.

        Plain words need no normaliser but lower case (without combining marks they
        are in NFC): the pre-tokenizer's pattern cuts them into parts, which the
        model encodes by their bytes.  Other words, and those with a special token
        in them, go through the whole tokenizer.
        """
        known, old, rest = self.known, self.old, []
        for w in words:
            if (ids := old.get(w)) is not None:
                known[w] = ids
                continue
            if len(w) > CACHED_LENGTH or not PLAIN(w) or "<|" in w:
                rest.append(w)
                continue
            own = []
            for x in PARTS(w.lower()):
                ids = known.get(x) or old.get(x)
                if ids is None:
                    alone = x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_LEVEL)
                    ids = [t.id for t in self.model.tokenize(alone)]
                    ids = struct.pack(f"<{len(ids)}I", *ids)
                known[x] = ids
                own.append(ids)
            known[w] = b"".join(own)
        known.update(zip(rest, self._encode(rest), strict=True))
        return [w for w in rest if len(w) > CACHED_LENGTH]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for s in range(0, len(texts), 64):
            part = texts[s:s + 64]
            words = [None if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in part]
            if len(self.known) > CACHED_WORDS:
                self.old, self.known = self.known, {}
            long = self._learn(set().union(*(w for w in words if w is not None)).difference(self.known))
            for t, w in zip(part, words, strict=True):
                yield self._encode([t])[0] if w is None else b"".join(map(self.known.__getitem__, w))
            for w in long:  # they rarely come again
                del self.known[w]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           vocabulary: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` and cut only documents longer than ``capacity`` tokens.

    Returns (doc_id, piece, start, length, ids_crc32[, ids]).  ``vocabulary`` is
    the path of a tokenizer file on the executors (default: the public 49k word
    vocabulary of the environment).  A null text counts as empty: its one token
    is ``end_id``.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load() -> WordIds:
            if vocabulary:
                return WordIds(vocabulary)
            import public_tokenizers

            return WordIds(public_tokenizers.path(VOCABULARY))

        word_ids = worker_state(f"word_ids_{vocabulary}", load)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                p = b.slice(s, 256)
                docs_at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(word_ids([t or "" for t in p.column(1).to_pylist()])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at:at + 4 * capacity]
                        docs_at.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                cols = [p.column(0).take(pa.array(docs_at, pa.int32())), pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(
                    cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                    ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids))


def best_two_fit(lengths: np.ndarray, capacity: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, room left in each bin); lengths are 1 to ``capacity``.

    Pieces over ``capacity / small`` fill bins greedily with two-for-one
    replacements; the shorter ones then go, longest first, to the bin that they
    fit most tightly, and into new bins when they fit none.  Were short pieces
    spent on replacements, long ones would be left without any.
    """
    of: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist()[::-1]:
        of.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(n for n in of if n * small > capacity)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[sizes] = [len(of[n]) for n in sizes]
    bins, room = np.empty(len(lengths), dtype=np.int64), []

    def take(n: int) -> int:
        counts[n] -= 1
        if not counts[n]:
            sizes.remove(n)
        return of[n].pop()

    def put_back(i: int) -> None:
        n = int(lengths[i])
        if not counts[n]:
            insort(sizes, n)
        counts[n] += 1
        of[n].append(i)

    while sizes:
        gap, own = capacity, []
        while gap and (k := bisect_right(sizes, gap)):
            n = sizes[k - 1]
            own.append(take(n))
            gap -= n
        while gap and sizes and len(own) > 1:
            least = int(lengths[own[-1]])
            have = np.asarray(sizes[:bisect_right(sizes, gap + least - 1)])
            if not have.size:
                break
            mate = np.searchsorted(have, gap + least - have, side="right") - 1
            alone = (mate >= 0) & (have[mate] == have) & (counts[have] < 2)
            mate = np.where(alone, mate - 1, mate)
            both = np.where(mate >= 0, have + have[mate], 0)
            best = int(both.argmax())
            if both[best] <= least:
                break
            pair = sorted((int(have[best]), int(have[mate[best]])), reverse=True)
            put_back(own.pop())
            own += [take(n) for n in pair]
            own.sort(key=lambda i: -lengths[i])
            gap += least - sum(pair)
        bins[own] = len(room)
        room.append(gap)
    gaps = sorted((g, -b) for b, g in enumerate(room) if g)
    for n in sorted((n for n in of if n * small <= capacity), reverse=True):
        for i in reversed(of[n]):
            k = bisect_left(gaps, (n, -len(room)))
            if k == len(gaps):
                gap, b = capacity, len(room)
                room.append(capacity)
            else:
                gap, b = gaps.pop(k)
                b = -b
            bins[i], room[b] = b, gap - n
            if room[b]:
                insort(gaps, (room[b], -b))
    return bins, np.array(room, dtype=np.int64)


def pack(rows: DataFrame, keys: list[str], capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``rows`` of a ``length`` of 1 to ``capacity``.

    ``keys`` name a row: rows are dealt to shards by their hash, so rows that agree
    in them share a shard.  Every row is placed once; offsets of a sequence run
    gapless from 0.  An empty table gives no rows.
    """
    fields, done = rows.columns, []
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    left = rows
    for level in range(LEVELS):
        n = left.count()
        if not n and level:
            break
        shards = max(1, -(-n // shard))
        last = shards == 1 or level == LEVELS - 1

        def place(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches, ["shard"]):
                lengths = np.asarray(t["length"])
                bins, room = best_two_fit(lengths, capacity)
                order = np.lexsort((-lengths, bins))
                size, own = lengths[order], bins[order]
                before = np.cumsum(size) - size
                first = np.r_[True, own[1:] != own[:-1]]
                offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(own)]))
                loose = (room[own] > capacity // LOOSE) & (not last)
                ids = ((level << 58) + (t["shard"][0].as_py() << 20)) + own
                ids = pa.array(ids, pa.int64(), mask=loose)
                t = t.select(fields).take(pa.array(order)).append_column("sequence_id", ids).append_column("offset", pa.array(offset))
                yield from t.combine_chunks().to_batches()

        dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), *keys), F.lit(shards).cast("long")))
        packed = materialize(dealt.repartition(shards, "shard").sortWithinPartitions("shard", *keys).mapInArrow(place, schema), "packed")
        done.append(packed.filter("sequence_id is not null"))
        if last:
            break
        left = packed.filter("sequence_id is null").select(fields)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   vocabulary: str | None = None, end_id: int = 1, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its ``sequence_id`` and ``offset``.

    Edge cases: null and empty texts are one-token documents; rows with a null
    id are packed like others; repeated rows are packed each; other columns are
    ignored; an empty table gives no rows.  Pieces are dealt by a row number
    written with them, so null or repeated ids spread over all shards.
    """
    cut = pieces(docs, id_col, text_col, capacity, vocabulary, end_id, with_ids).withColumn("row_no", F.monotonically_increasing_id())
    return pack(materialize(cut, "pieces"), ["row_no"], capacity, shard).drop("row_no")
