"""Language identification by language-bitmask n-gram filters.

Training counts the one- and three-letter runs of every labelled text (words lower-cased and joined by one blank). A run
belongs to a language if it makes up at least ``SHARE`` of that language's runs of its length: the same rule at every
corpus size, and at most ``1 / SHARE`` runs a length and language, which bounds the filter. Each language's runs go into
a Bloom filter of ``SLOTS`` bits; the filters lie bit-sliced, slot by slot, so a slot holds one bit per language. The
conjunction of a run's ``PROBES`` slots is the mask of all languages that contain it.

A text adds up the bits of its runs' masks per language. A filter filled to f says yes to a strange run with probability
f**PROBES; hits less that share of all runs are the language's corrected count, and the largest decides. The score is
the corrected share of the text's runs that the language knows.

Defined results. ``und`` and score 0 for null texts and texts without a letter. Training leaves out null texts, null
languages and the held-out fold. Equal counts go to the language with more training runs, then to the smaller name.
Without any training text every text is ``und``. Texts are read whole, the longest in parts whose counts are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, mixed, remainder, stage

SHARE = 1e-4  # least share of a language's runs of one length
SLOTS = 1 << 18  # at most 20,000 runs a language fill under a third of them
PROBES = 4
FOLDS = 5
PART = 1 << 20  # code points that are looked at together
NONE = "und"

_RANGE = 0x32400  # no letter lies beyond
_DIRECT = 1 << 22  # largest table of counters for three-letter runs


_TABLE: list[np.ndarray] = []  # made once in every worker


def _letters(points: np.ndarray) -> np.ndarray:
    """Every code point as itself if it is a letter, else as a blank."""
    if not _TABLE:
        _TABLE.append(np.array([c if chr(c).isalpha() else 32 for c in range(_RANGE)] + [32], np.uint32))
    return _TABLE[0][np.minimum(points, _RANGE)]


def _normal(texts: list[str], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of many texts, each between blanks and followed by 0, with the number of the text of each code point."""
    padded = [f" {x} \0" for x in texts]
    lengths = np.array([len(x) for x in padded])
    points = _letters(np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32))
    points[np.cumsum(lengths) - 1] = 0
    kept = np.ones(len(points), bool)
    kept[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[kept], np.repeat(np.array(numbers, np.int32), lengths)[kept]


def parts(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of many texts and the number of the text of each, about ``PART`` at once and 0 between texts.

    A part begins with the first run of three that the part before does not hold, so a long text loses and repeats none.
    """
    held, numbers, size = [], [], 0
    for k, data in enumerate(texts):
        held.append((data or b"").decode("utf-8", "replace").lower())
        numbers.append(k)
        size += len(held[-1])
        if size >= PART or k == len(texts) - 1:
            points, owner = _normal(held, numbers)
            for start in range(0, max(len(points) - 2, 0), PART):
                yield points[start : start + PART + 2], owner[start : start + PART + 2]
            held, numbers, size = [], [], 0


def _runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the three-letter runs, and of those whose middle (a one-letter run) is no blank."""
    inside = (points[:-2] != 0) & (points[1:-1] != 0) & (points[2:] != 0)
    at = np.flatnonzero(inside)
    return at, at[points[at + 1] != 32]


def _keys(points: np.ndarray, at: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points take 21 bits: three make a 63-bit key, one leaves the lower 42 bits zero."""
    wide = points.astype(np.uint64)
    three = (wide[at] << np.uint64(42)) | (wide[at + 1] << np.uint64(21)) | wide[at + 2]
    return three, wide[single + 1] << np.uint64(42)


def _counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of one language's texts and how often each occurs."""
    at, single = _runs(points)
    letters = np.flatnonzero(np.bincount(points))
    base, wide = len(letters), letters.astype(np.uint64)
    place = np.zeros(int(letters[-1]) + 1, np.int64)
    place[letters] = np.arange(base)
    dense = place[points]
    ones = np.bincount(dense[single + 1], minlength=base)
    some = np.flatnonzero(ones)
    if base**3 <= _DIRECT:
        counts = np.bincount((dense[at] * base + dense[at + 1]) * base + dense[at + 2])
        seen = np.flatnonzero(counts)
        a, b, c = wide[seen // base**2], wide[seen // base % base], wide[seen % base]
        three, counts = (a << np.uint64(42)) | (b << np.uint64(21)) | c, counts[seen]
    else:
        three, counts = np.unique(_keys(points, at, single)[0], return_counts=True)
    return np.concatenate([three, wide[some] << np.uint64(42)]), np.concatenate([counts, ones[some]])


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([c for _, c in found])).astype(np.int64)


def _count(batches):
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(data)
        for lang, own in texts.items():
            found = [_counted(points) for points, _ in parts(own)]
            if found:
                keys, counts = _merged(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "run", "n"]
                )


def train(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages, those with more runs first, and the bit-sliced filters: ``SLOTS`` rows of one bit per language."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    partial = labelled.select(F.col(lang).alias("lang"), binary(text).alias("text")).mapInArrow(_count, "lang string, run bigint, n bigint")
    low = F.lit((1 << 42) - 1)
    counts = stage(
        partial.groupBy("lang", "run", (F.col("run").bitwiseAND(low) == 0).alias("single")).agg(F.sum("n").alias("n")), "language-runs"
    )
    totals = counts.groupBy("lang", "single").agg(F.sum("n").alias("all"))
    kept = counts.join(totals, ["lang", "single"]).where(F.col("n") >= SHARE * F.col("all")).select("lang", "run").toArrow()
    size = {r["lang"]: r["all"] for r in totals.groupBy("lang").agg(F.sum("all").alias("all")).collect()}
    langs = sorted(size, key=lambda x: (-size[x], x))
    number = {x: k for k, x in enumerate(langs)}
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    slices = np.zeros((SLOTS, max(1, -(-len(langs) // (8 * kind().itemsize)))), kind)
    of = np.array([number[x] for x in kept["lang"].to_pylist()], np.int64)
    runs = kept["run"].to_numpy().view(np.uint64)
    for k in range(len(langs)):
        word, bit = divmod(k, 8 * kind().itemsize)
        for slots in _probes(runs[of == k]):
            slices[slots, word] |= kind(1 << bit)
    return langs, slices


def _probes(keys: np.ndarray) -> Iterator[np.ndarray]:
    """``PROBES`` slots of every key, from one 64-bit hash by double hashing."""
    h = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    first, step = h & np.uint64(SLOTS - 1), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((first + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


def masks(keys: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """The languages that contain each key, as bits."""
    found = None
    for slots in _probes(keys):
        met = slices[slots]
        found = met if found is None else found & met
    return found


def _bits(rows: np.ndarray, k: int) -> np.ndarray:
    word, bit = divmod(k, 8 * rows.dtype.itemsize)
    return (rows[:, word] >> rows.dtype.type(bit)) & rows.dtype.type(1)


def hits(texts: list[bytes | None], langs: int, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of every text, and how many of them each language's filter contains."""
    runs, found = np.zeros(len(texts), np.int64), np.zeros((len(texts), langs), np.int64)
    for points, owner in parts(texts):
        at, single = _runs(points)
        if not len(at):
            continue
        for keys, of in zip(_keys(points, at, single), (owner[at], owner[single + 1]), strict=True):
            met = masks(keys, slices)
            runs += np.bincount(of, minlength=len(texts))
            for k in range(langs):
                found[:, k] += np.bincount(of[_bits(met, k) != 0], minlength=len(texts))
    return runs, found


def identify(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS) -> DataFrame:
    """``ident, held_out, lang_pred, score, n_runs, known`` per row; learnt from the rows whose fold is not 0.

    ``held_out`` is fold 0 of crc32 of the id as text (a null id counts as held out). ``known`` has each language's
    corrected share of the text's runs. Neither the language, nor the source, nor the id of a row enters its score.
    """
    fold = remainder(ident, folds)
    langs, slices = train(docs.where(fold != 0), text, lang)
    alien = np.array([np.mean(_bits(slices, k)) for k in range(len(langs))]) ** PROBES

    def predict(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            runs, found = hits(texts, len(langs), slices)
            pred, score = np.full(len(texts), -1), np.zeros(len(texts))
            known = np.zeros((len(texts), len(langs)))
            some = np.flatnonzero((runs > 0) & (len(langs) > 0))
            if len(some):
                known[some] = (found[some] / runs[some, None] - alien) / (1 - alien)
                pred[some] = known[some].argmax(axis=1)
                score[some] = np.clip(known[some, pred[some]], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([langs[p] if p >= 0 else NONE for p in pred], pa.string()), pa.array(score),
                    pa.array(runs), pa.array(list(known), pa.list_(pa.float64())),
                ],
                names=[ident, "held_out", "lang_pred", "score", "n_runs", "known"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, held_out boolean, lang_pred string, score double, n_runs bigint, known array<double>"
    return docs.select(F.col(ident), (fold == 0).alias("held_out"), binary(text).alias("text")).mapInArrow(predict, schema)
