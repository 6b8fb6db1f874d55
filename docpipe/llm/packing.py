"""Packing documents into sequences: best fit first, then swap-based local search.

Only pieces (a few numbers each) are packed; token ids stay where the text was read. Full pieces are sequences of their
own. The others are dealt at random into groups of about ``GROUP`` pieces, a number of groups in proportion to the input,
and each group is packed in one task: best fit in falling length, then exchanges between underfull bins. A group ends with
about one bin that cannot be filled, so a group costs at most one sequence in some ten thousand.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, stage

CAPACITY = 2048
GROUP = 40_000
CACHE = 400_000  # encoded chunks, and pieces of them, that a worker remembers
#: The tokenizer's split pattern over lower-case ASCII and Latin letters, and the chunks it is enough for.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PATIENCE = 64  # the search ends after so many givers in a row without a step


class ChunkEncoder:
    """Ids (as bytes) of chunks between white space, remembered by chunk and by the pieces that the tokenizer splits it into.

    Chunks of ASCII and Latin letters are split here, by the tokenizer's own pattern, and each new piece goes to its
    model; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model, self.bytes_of = self.whole.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else self.bytes_of.pre_tokenize_str(piece)[0][0]
        ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
        return ids

    def new(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if SIMPLE.fullmatch(text) and b"<|" not in chunk:
            pieces = self.pieces
            ids = b"".join([pieces.get(p) or self._piece(p) for p in PIECE.findall(text.lower())])
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.chunks[chunk] = ids
        return ids

    def document(self, data: bytes) -> bytes:
        if len(self.chunks) > CACHE or len(self.pieces) > CACHE:
            self.chunks.clear()
            self.pieces.clear()
        known = self.chunks
        return b"".join([known.get(c) or self.new(c) for c in data.split()])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, then ``end_id``, cut every ``capacity`` ids.

    The tokenizer splits at white space whatever the context, so texts are encoded by chunks between ASCII white space,
    and the ids of a chunk are remembered: real text repeats its words.
    """

    def of_batch(batches):
        encoder, end = ChunkEncoder(tokenizer), np.uint32(end_id).tobytes()
        for frame in batches:
            columns = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, data in zip(frame["doc_id"], frame["text"]):
                ids = encoder.document(data) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(columns, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        columns[k].append(v)
            columns["doc_id"] = pd.Series(columns["doc_id"], dtype=frame["doc_id"].dtype)
            yield pd.DataFrame(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", binary("text").alias("text")).mapInPandas(
        of_batch, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: in falling length, into the bin where least room is left."""
    bins, room_of, rooms = np.zeros(len(lengths), np.int64), {}, []
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            room, b = capacity, count
            count += 1
        else:
            room = rooms[at]
            b = room_of[room].pop()
            if not room_of[room]:
                rooms.pop(at)
        bins[i] = b
        left = room - size
        if left:
            if not room_of.get(left):
                bisect.insort(rooms, left)
                room_of[left] = []
            room_of[left].append(b)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty bins by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    The least filled bin gives. An item of it moves where it fits best; or takes the place of a smaller item, or of two
    items of one bin, where it leaves least room. Every step fills a bin that is at least as full as the giver, so the sum
    of squares rises and the search ends; a giver without a step rests until another has made one. It stops when a bound says no bin can go,
    or after ``PATIENCE`` givers in a row without a step; every item keeps a place either way.
    """
    lengths, bins = lengths.astype(np.int64), bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    least_bins = -(-int(lengths.sum()) // capacity)
    open_items = np.flatnonzero(fill[bins] < capacity)
    stuck: set[int] = set()
    idle = 0
    while idle < PATIENCE and np.count_nonzero(fill) > least_bins and len(open_items):
        givers = [b for b in np.unique(bins[open_items]) if b not in stuck]
        if not givers:
            break
        giver = min(givers, key=lambda b: (fill[b], b))
        moved = False
        for item in sorted(open_items[bins[open_items] == giver], key=lambda i: -lengths[i]):
            size = int(lengths[item])
            others = open_items[(bins[open_items] != giver) & (fill[bins[open_items]] >= fill[giver]) & (fill[bins[open_items]] < capacity)]
            if not len(others):
                break
            at, own = bins[others], lengths[others]
            room = capacity - fill[at]
            fits = np.flatnonzero(room >= size)
            if len(fits):  # move
                target = at[fits[np.argmin(room[fits])]]
                fill[giver] -= size
                fill[target] += size
                bins[item] = target
                moved = True
                continue
            gain = size - own
            one = np.flatnonzero((gain > 0) & (gain <= room))
            best = (int(gain[one].max()), int(others[one[np.argmax(gain[one])]]), -1) if len(one) else (0, -1, -1)
            pair = _two_for_one(others, at, own, room, size)
            if pair and pair[0] > best[0]:
                best = pair
            if best[0] > 0:
                target = bins[best[1]]
                bins[item] = target
                for back in best[1:]:
                    if back >= 0:
                        bins[back] = giver
                fill[giver] -= best[0]
                fill[target] += best[0]
                moved = True
        if not moved:
            stuck.add(int(giver))
            idle += 1
        else:
            stuck.clear()
            idle = 0
            open_items = open_items[fill[bins[open_items]] < capacity]
    return bins


def _two_for_one(items, bins, lengths, room, size):
    """(gain, i, j): two neighbours in length of one bin that one item of ``size`` replaces, leaving least room."""
    order = np.lexsort((lengths, bins))
    same = np.flatnonzero(bins[order][1:] == bins[order][:-1])
    if not len(same):
        return None
    i, j = order[same], order[same + 1]
    gain = size - lengths[i] - lengths[j]
    ok = np.flatnonzero((gain > 0) & (gain <= room[i]))
    if not len(ok):
        return None
    k = ok[np.argmax(gain[ok])]
    return int(gain[k]), int(items[i[k]]), int(items[j[k]])


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every sequence holds at most ``capacity`` ids without gaps.

    No column but ``length`` decides, and equal rows are separate pieces. An empty table gives no rows.
    """
    stored = stage(pieces, "pieces")
    groups = max(1, -(-stored.where(F.col("length") < capacity).count() // group))

    def of_part(batches):
        from pyspark import TaskContext

        frames = [f for f in batches if len(f)]
        if not frames:
            return
        frame = pd.concat(frames, ignore_index=True).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = frame["length"].to_numpy()
        placed = local_search(lengths, best_fit(lengths, capacity), capacity)
        frame = frame.assign(sequence_id=placed + (np.int64(TaskContext.get().partitionId()) << 32))
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        yield frame

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    parts = stored.where(F.col("length") < capacity).repartition(groups).mapInPandas(of_part, f"{schema}, sequence_id long, offset long")
    full = stored.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return full.unionByName(parts)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs`` and where they are packed. A null or empty text is its end id alone; texts are never dropped."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
