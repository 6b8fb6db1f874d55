"""A probabilistic suffix tree over the symbols of texts, and text scores from it.

Symbols are the bytes of lower-cased words, a blank after each word, and one end symbol after the text. A context is up to
``DEPTH`` symbols before a symbol, over word boundaries, back to the blank before the text. It is kept as a state if it is
frequent enough (``LEAST_SHARE`` of all symbols, which bounds the number of states whatever the corpus) and if its
next-symbol distribution diverges from that of its suffix. Distributions are smoothed with the suffix's; scoring uses the
longest suffix that is a state.

Contexts are counted over all training texts; tasks add up what they count before it moves. Every text is scored symbol by symbol where it lies; equal contexts of
neighbouring texts are looked up once. Texts and the counts of their words meet by blocks of neighbouring documents: a block
asks for each of its words once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, lowered_words, remainder, stage

DEPTH = 7
LEAST_SHARE = 4e-6
LEAST_DIVERGENCE = 0.01  # nats a symbol
WEIGHT = 2.0  # of the suffix's distribution, in counts
END = 0xFF  # never a byte of UTF-8
BLANK = 0x20
BLOCK_ROWS = 8000  # neighbouring documents of a block
LEVELS = (3, 5, DEPTH)  # depths up to which contexts are counted in one pass
HELD = 3_000_000  # grams of a depth that a task adds up
LEAD, LAST = bytes(DEPTH) + bytes([BLANK]), bytes([BLANK, END])
TEXT = bytes.maketrans(b"\0\t\n\v\f\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\1     abcdefghijklmnopqrstuvwxyz")  # of a text, to symbols


def numbered(texts: list[bytes], place: dict) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of texts, their numbers in ``place`` one after the other, and the number of words of each text."""
    words = [lowered_words(x) for x in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return words, np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum()), sizes


def block_words(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """(block, word, n): the distinct words of each block and their count in training documents."""

    def of_part(batches):
        place: defaultdict = defaultdict()
        place.default_factory = place.__len__  # words are numbered as they come
        counts, at = np.zeros(0, np.int64), None

        def made():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), at, np.int64)), pa.array(list(place), pa.binary()), pa.array(counts)], ["block", "word", "n"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else []
            for low, size in zip(starts, np.diff(starts, append=len(blocks))):
                if blocks[low] != at:
                    if place:
                        yield made()
                    place.clear()
                    counts, at = np.zeros(0, np.int64), blocks[low]
                train = batch.column(1).slice(low, size).to_numpy(False)
                for listed in chunks(batch.column(2).slice(low, size).to_pylist()):
                    _, numbers, sizes = numbered(listed, place)
                    taught, train = numbers[np.repeat(train[: len(listed)], sizes)], train[len(listed) :]
                    counts = np.pad(counts, (0, len(place) - len(counts))) + np.bincount(taught, minlength=len(place))
        if place:
            yield made()

    rows = docs.select("block", (F.col("fold") != held).alias("train"), "text")
    return stage(rows.mapInArrow(of_part, "block long, word binary, n long"), "words")


def stream(texts: list[bytes], codes: bytes | None = None, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``DEPTH`` codes and the next one, highest, at every scored symbol of the texts, and the number of symbols of each text.

    Zeros stand before a text, so a context ends at its first blank. A code has
    ``bits`` bits: the byte, or what ``codes`` has for it.
    """
    data = np.frombuffer(b"".join(part for text in texts for part in (LEAD, text.translate(TEXT), LAST)), np.uint8)
    blank = data == BLANK
    blank[1:] &= blank[:-1]
    blank[0] = False
    data = data[~blank]  # of blanks in a row, the first
    starts = np.flatnonzero(data == 0)[::DEPTH]
    sizes = np.diff(starts, append=len(data)) - len(LEAD)
    own = np.ones(len(data), bool)
    own[(starts[:, None] + np.arange(len(LEAD))).ravel()] = False
    keys = (data if codes is None else np.frombuffer(codes, np.uint8)[data]).astype(np.uint64)
    for size in (1, 2, 4):  # windows of twice as many symbols
        keys[size:] = keys[size:] << np.uint64(bits * size) | keys[:-size]
    return keys[own], sizes


def chunks(texts, symbols: int = 1_000_000, most: int = 1 << 30):
    """Texts in lists of about as many symbols, of at most ``most`` texts."""
    held, size = [], 0
    for data in texts:
        held.append(data)
        size += len(data) + len(LEAD) + 1
        if size > symbols or len(held) == most:
            yield held
            held, size = [], 0
    if held:
        yield held


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys without repeats, and the sums of their numbers."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _slots(windows: np.ndarray) -> np.ndarray:
    return (windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def grams(texts: DataFrame, depths: range | None = None, known: np.ndarray | None = None, least: float = 0) -> DataFrame:
    """(gram, n, total): context bytes and the next symbol packed in a long, with counts over whole texts and the context's count.

    Without ``depths``, contexts are as long as there are symbols, up to ``DEPTH``; else every context is counted at each of
    these depths. With ``known``, contexts of ``depths.start - 1`` symbols: only contexts are counted whose parts of that
    length are among them (or fall in the slot of one). Contexts of fewer than ``least`` symbols are left out.

    Tasks add up their own grams; arrays of grams and counts meet by hash of the context, the number of groups being that of
    the shuffle partitions.
    """
    groups = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = None if known is None else texts.sparkSession.sparkContext.broadcast(known)
    byte = lambda d: np.uint64(8 * d)
    top = lambda d: np.uint64((1 << 64) - (1 << 64 - 8 * d))

    def cut(keys, n, d, met):
        """Grams of ``d`` context bytes from sorted ones; the symbol is the highest byte."""
        whole = (keys >> byte(7 - d)) & np.uint64(255) > 0
        for at in range(d - depths.start + 2 if met is not None else 0):
            size = depths.start - 1
            whole &= met[_slots((keys << byte(1 + at)) & top(size))]
        return summed(keys[whole] & top(d + 1), n[whole])

    def dealt(held):
        """Summed grams of a task, one row a group."""
        keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys, n = summed(keys[order], n[order])
        keys = keys.byteswap()  # the symbol is the lowest byte
        group = (((keys >> np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(groups)
        order = np.argsort(group.astype(np.uint16 if groups <= 1 << 16 else np.uint64), kind="stable")
        ends = np.cumsum(np.bincount(group.astype(np.int64), minlength=groups))
        rows = [(g, keys[x].tobytes(), n[x].tobytes()) for g, x in enumerate(np.split(order, ends[:-1])) if len(x)]
        types = (pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), types)], ["part", "grams", "counts"])

    def of_part(batches):
        met = None
        if shared is not None:
            met = np.zeros(1 << 22, bool)
            met[_slots(shared.value)] = True
        held: dict = {}
        for listed in chunks((data for batch in batches for data in batch.column(0).to_pylist()), 2_000_000):
            keys = stream(listed)[0]
            keys.sort()
            keys, n = summed(keys, np.ones(len(keys), np.int64))
            for d in (None,) if depths is None else depths:
                found = (keys, n) if d is None else cut(keys, n, d, met)
                held.setdefault(d, []).append(found)
                if sum(len(x) for x, _ in held[d]) > HELD:
                    keys_held, n_held = (np.concatenate(x) for x in zip(*held[d]))
                    order = np.argsort(keys_held)
                    held[d] = [summed(keys_held[order], n_held[order])]
                    if len(held[d][0][0]) > HELD // 2:
                        yield dealt(held.pop(d))
        for own in held.values():
            if sum(len(x) for x, _ in own):
                yield dealt(own)

    def of_group(frame):
        keys = np.frombuffer(b"".join(frame.column("grams").to_pylist()), np.uint64)
        order = np.argsort(keys)
        keys, n = summed(keys[order], np.frombuffer(b"".join(frame.column("counts").to_pylist()), np.int64)[order])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)]))
        total = np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(keys)))
        return pa.table({"gram": keys.view(np.int64), "n": n, "total": total}).filter(pa.array(total >= least))

    arrays = texts.select("text").mapInArrow(of_part, "part int, grams binary, counts binary")
    return arrays.groupBy("part").applyInArrow(of_group, "gram long, n long, total long")


def frequent_contexts(texts: DataFrame, least_share: float) -> DataFrame:
    """(context, symbol, n, total) of the contexts that hold ``least_share`` of all symbols.

    Longer contexts are counted only where all their parts are frequent: the others cannot be.
    """
    found, known, start, least = [], None, 0, 0.0
    for depth in LEVELS:
        full = grams(texts, range(start, depth + 1), known, least)
        counts = stage(full.select(F.shiftrightunsigned("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).cast("int").alias("symbol"), "n", "total"), "contexts")
        if not found:
            least = least_share * (counts.where("context = 0").agg(F.max("total")).first()[0] or 0)
            counts = counts.where(F.col("total") >= least)
        found.append(counts)
        # At most 1 / least_share contexts.
        long = counts.where(F.shiftrightunsigned("context", 8 * (depth - 1)) > 0).select("context").distinct().toArrow()
        known, start = long.column(0).to_numpy().astype(np.uint64).byteswap(), depth + 1
        if not len(known):
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def states(texts: DataFrame, least_share: float = LEAST_SHARE, least_divergence: float = LEAST_DIVERGENCE) -> DataFrame:
    """(context, symbol, n, total) of the retained contexts; the empty context (0) is always there."""
    frequent = frequent_contexts(texts, least_share)
    # The suffix of a context lacks its oldest symbol, the highest byte that is not zero.
    bits = F.greatest(*[F.when(F.shiftright("context", 8 * d) > 0, F.lit(8 * d)).otherwise(F.lit(0)) for d in range(DEPTH)])
    suffix = F.col("context").bitwiseAND(F.expr("shiftleft(1L, high)") - 1)
    above = frequent.select(F.col("context").alias("suffix"), "symbol", F.col("n").alias("n_above"), F.col("total").alias("total_above"))
    compared = frequent.where("context != 0").withColumn("high", bits.cast("int")).withColumn("suffix", suffix).join(above, ["suffix", "symbol"])
    divergence = F.sum(F.col("n") / F.col("total") * F.log((F.col("n") / F.col("total")) / (F.col("n_above") / F.col("total_above"))))
    kept = compared.groupBy("context").agg(divergence.alias("d")).where(F.col("d") >= least_divergence).select("context")
    return frequent.join(kept, "context", "left_semi").unionByName(frequent.where("context = 0"))


class Model:
    """The retained contexts as arrays; gives what ``Tree`` gives, for many contexts at once.

    Bytes are told apart by codes of as few bits as the training texts need; all other bytes are 0. A key holds the codes of a
    context from the latest down, then the symbol's, so the keys of a state stand together, among those of its suffix.
    """

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        context, n = context.astype(np.uint64), n.astype(np.float64)
        bytes_of = [((context >> np.uint64(8 * d)) & np.uint64(255)).astype(np.int64) for d in range(DEPTH)]
        depth = sum((x > 0).astype(np.int64) for x in bytes_of)
        seen = np.bincount(np.concatenate([symbol.astype(np.int64), *bytes_of]), minlength=256) > 0
        seen[0] = False
        codes = np.where(seen, np.cumsum(seen), 0)
        self.codes, self.bits = codes.astype(np.uint8).tobytes(), max(1, int(codes.max()).bit_length())
        symbol = codes[symbol.astype(np.int64)]
        key = sum(codes[x].astype(np.uint64) << np.uint64(self.bits * (DEPTH - d)) for d, x in enumerate(bytes_of))
        key, at, state = np.unique(np.concatenate([np.zeros(1, np.uint64), key]), return_index=True, return_inverse=True)
        depths, state = np.concatenate([[0], depth])[at], state[1:]
        high = key | np.array([(1 << self.bits * (DEPTH + 1 - d)) - 1 for d in range(DEPTH + 1)], np.uint64)[depths]

        def longest(places, last):
            """The state of the longest context at each of the places; up to ``last``, the place of its own is left out."""
            out = np.zeros(len(places), np.int64)
            for d in range(1, DEPTH + 1):
                own = np.flatnonzero(depths == d)
                low = np.searchsorted(places, key[own], "right" if last else "left")
                size = np.searchsorted(places, high[own], "right") - low
                out[np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)] = np.repeat(own, size)
            return out

        self.parent = longest(key, True)
        self.places = np.unique(np.concatenate([key, high + np.uint64(1)]))  # the last one of all is 0
        self.at_places = longest(self.places, False)
        total = np.bincount(state, n, len(key))
        self.rest = WEIGHT / (total + WEIGHT)
        root = np.bincount(symbol[depth == 0], n[depth == 0], 1 << self.bits)
        deep = np.flatnonzero(depth > 0)
        pair = state[deep] << self.bits | symbol[deep]
        deep, pair = (x[np.argsort(pair)] for x in (deep, pair))
        self.pair = np.concatenate([np.arange(1 << self.bits), pair])
        self.p = np.concatenate([(root + 1) / (root.sum() + 256), np.zeros(len(pair))])
        for d in range(1, DEPTH + 1):
            own = np.flatnonzero(depth[deep] == d)
            below, code = state[deep[own]], symbol[deep[own]]
            self.p[len(root) + own] = (n[deep[own]] + WEIGHT * self.of(self.parent[below], code)) / (total[below] + WEIGHT)

    def of(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probabilities of symbols in states."""
        p, weight, left = np.empty(len(state)), 1.0, np.arange(len(state))
        while len(left):
            asked = state << self.bits | symbol
            found = np.minimum(np.searchsorted(self.pair, asked), len(self.pair) - 1)
            met = self.pair[found] == asked
            p[left] = weight * self.p[found]
            weight = (weight * self.rest[state])[~met]
            left, state, symbol = left[~met], self.parent[state[~met]], symbol[~met]
        return p

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text."""
        bits, room = np.uint64(self.bits), 64 - (DEPTH + 1) * self.bits
        out = [np.zeros(0)]
        for listed in chunks([b" ".join(words) for words in texts], most=1 << min(room or 16, 16)):
            keys, sizes = stream(listed, self.codes, self.bits)
            of_symbol = np.uint64(DEPTH) * bits
            keys = (keys & ((np.uint64(1) << of_symbol) - np.uint64(1))) << bits | keys >> of_symbol
            text = np.repeat(np.arange(len(listed)), sizes)
            if room:  # the text's number fits in
                keys = keys << np.uint64(room) | text.astype(np.uint64)
                keys.sort()
                text = (keys & np.uint64((1 << room) - 1)).astype(np.int64)
                keys >>= np.uint64(room)
            else:
                order = np.argsort(keys)
                keys, text = keys[order], text[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            asked = keys[first]
            state = np.repeat(self.at_places, np.diff(np.searchsorted(asked, self.places), append=len(asked)))
            p = np.log10(self.of(state, (asked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)))
            out.append(np.bincount(text, np.repeat(p, np.diff(first, append=len(keys))), len(listed)))
        return np.concatenate(out)


class Tree:
    """Retained contexts with smoothed next-symbol log10 probabilities, as plain dictionaries: what ``Model`` is held against."""

    def __init__(self, rows):
        by_context: dict[bytes, dict[int, int]] = {}
        for context, symbol, n in rows:
            by_context.setdefault(context.to_bytes(DEPTH, "big").lstrip(b"\0"), {})[symbol] = n
        self.next: dict[bytes, dict[int, float]] = {}
        self.rest: dict[bytes, tuple[float, bytes | None]] = {}  # log10 weight of the suffix's distribution; that suffix
        root = by_context.get(b"", {})
        total = sum(root.values())
        self.unseen = -math.log10(total + 256)
        self.next[b""] = {s: math.log10((n + 1) / (total + 256)) for s, n in root.items()}
        self.rest[b""] = (0.0, None)
        for context in sorted(by_context, key=len):
            if not context:
                continue
            suffix = context[1:]
            while suffix not in self.next:
                suffix = suffix[1:]
            total = sum(by_context[context].values()) + WEIGHT
            self.rest[context] = (math.log10(WEIGHT / total), suffix)
            self.next[context] = {s: math.log10((n + WEIGHT * 10 ** self.symbol(suffix, s)) / total) for s, n in by_context[context].items()}

    def symbol(self, context: bytes, symbol: int) -> float:
        """log10 probability of ``symbol`` in a state."""
        less = 0.0
        while True:
            found = self.next[context].get(symbol)
            if found is not None:
                return less + found
            weight, suffix = self.rest[context]
            if suffix is None:
                return less + self.unseen
            less, context = less + weight, suffix

    def sequence(self, symbols: bytes) -> float:
        """log10 probability of the symbols of a text, from the blank before it."""
        text, total = b" " + symbols, 0.0
        for at in range(1, len(text)):
            context = text[max(0, at - DEPTH) : at]
            while context not in self.next:
                context = context[1:]
            total += self.symbol(context, text[at])
        return total

    def word(self, word: bytes) -> float:
        return self.sequence((word.replace(b"\0", b"\x01") if b"\0" in word else word) + b" ")

    def end(self) -> float:
        return self.sequence(bytes([END]))


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    ``docs`` must give the same rows in the same partitions each time it is read (a scan of stored files does). Null and
    empty texts are an end alone. Null ids count as remainder 0. Without training documents all scores are uniform.
    Repeated rows count as often as they stand there; other columns are ignored; an empty table gives no rows.
    """
    place = F.monotonically_increasing_id()
    inner = place.bitwiseAND((1 << 33) - 1)
    rows = docs.select("doc_id", remainder("doc_id", folds).alias("fold"), binary("text").alias("text"), F.shiftright(place, 33).alias("part"), F.floor(inner / BLOCK_ROWS).alias("nth"))
    rows = rows.select("doc_id", "fold", "text", (F.col("part") * (1 << 25) + F.col("nth")).alias("block"))
    asked = block_words(rows, folds, held)
    words = stage(asked.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    ends = docs.where(remainder("doc_id", folds) != held).count()
    n_words, v_words = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + ends, v_words + (ends > 0)
    kept = states(rows.where(F.col("fold") != held)).select("context", "symbol", "n").toArrow()  # at most DEPTH / LEAST_SHARE states
    model = docs.sparkSession.sparkContext.broadcast(Model(*(kept.column(k).to_numpy() for k in range(3))))
    end_count, level = ends, n + v + 1

    answered = asked.select("block", "word").join(words, "word").select("block", "word", "c")

    def of_block(texts, known):
        place = {w: i for i, w in enumerate(known.column("word").to_pylist())}
        count = known.column("c").to_numpy()
        base = np.log10((count + 1) / level)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for listed in chunks(texts.column("text").to_pylist()):
            words, at, sizes = numbered(listed, place)
            of = np.repeat(np.arange(len(listed)), sizes)
            out["n_tokens"].append(sizes + 1)
            out["n_known"].append(np.bincount(of[count[at] > 0], minlength=len(listed)) + (end_count > 0))
            out["base_score"].append(np.bincount(of, base[at], len(listed)) + math.log10((end_count + 1) / level))
            out["score"].append(model.value.score(words))
        out = {k: np.concatenate(v) for k, v in out.items()}
        held_out = pa.array([f == held for f in texts.column("fold").to_pylist()], pa.bool_())
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": held_out, "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array([n] * texts.num_rows, pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(of_block, schema)
