"""Secret scans: fixed patterns, and formats learnt from what they find by grammar inference.

The secrets that the patterns find over the whole corpus are labelled credentials. Their character-class strings form a
prefix tree per kind, whose statistically compatible states are merged (red and blue states, Hoeffding bound) into a
probabilistic automaton. Then every candidate run of credential characters is scored by all automata against the
classes of ordinary text, and those as likely as labelled ones are added to the spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, stage

# Fixed patterns.
KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
# Parameters.
SUPPORT = 1 / 500  # a prefix is a tree node if this share of its kind's labelled strings has it
LEAST_COUNT = 10.0  # and this many of them: fewer tell no two states apart
DEEP = 64  # symbols of a string that may become tree nodes; longer ones go on in the automaton
ALPHA = 0.05  # of the Hoeffding bound
SPREAD = 3.0  # standard deviations below the labelled mean that still count as the format
LEAST_LABELLED = 20

#: Classes: h hexadecimal digit, l other small letter, U capital, s sign of base64, p point or underscore or hyphen, o other.
_CLASS = bytes(
    ord("h") if chr(b) in "0123456789abcdef" else ord("l") if chr(b).islower() and b < 128 else ord("U") if chr(b).isupper() and b < 128
    else ord("s") if chr(b) in "+/=" else ord("p") if chr(b) in "._-" else ord("o")
    for b in range(256)
)
SYMBOLS = "hlUspo"


def classes(text: str) -> str:
    return text.encode().translate(_CLASS).decode()


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret) of the fixed patterns; cheap tests on the bytes come first."""
    found = []
    low = data.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in data.translate(_CLASS):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, form, n): class strings of all labelled credentials, and under kind -1 the class counts of all texts."""

    def of_part(batches):
        counts: Counter = Counter()

        def made():
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "form", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for data in batch.column(0).to_pylist():
                for _, kind, _, secret in base_spans(data.decode(), data):
                    counts[kind, classes(secret)] += 1
                mapped = data.translate(_CLASS)
                for symbol in SYMBOLS:
                    counts[-1, symbol] += mapped.count(symbol.encode())
                if len(counts) > 100_000:
                    yield made()
        yield made()

    rows = docs.select(binary("text").alias("text")).mapInArrow(of_part, "kind int, form string, n long")
    return stage(rows.groupBy("kind", "form").agg(F.sum("n").alias("n")), "labelled")


class Automaton:
    """States as dictionaries symbol -> (state, count), with counts of strings that end there."""

    def __init__(self, counts: dict[str, int], ends: dict[str, int]):
        """From prefix counts. What follows without a node of its own stays in its state when strings are scored."""
        self.next: list[dict[str, int]] = [{} for _ in counts]
        self.flow: list[dict[str, int]] = [{} for _ in counts]
        self.end, self.count = [0] * len(counts), [0] * len(counts)
        number = {p: i for i, p in enumerate(sorted(counts, key=lambda p: (len(p), p)))}
        for prefix, i in number.items():
            self.count[i], self.end[i] = counts[prefix], ends.get(prefix, 0)
            left = counts[prefix] - self.end[i]
            for symbol in SYMBOLS:
                child = prefix + symbol
                if child in number:
                    self.next[i][symbol] = number[child]
                    self.flow[i][symbol] = counts[child]
                    left -= counts[child]
            if left > 0:  # rare or deep continuations, on symbols that are not told apart; they lead to no node yet
                free = [s for s in SYMBOLS if s not in self.next[i]] or list(SYMBOLS)
                for symbol in free:
                    self.flow[i][symbol] = self.flow[i].get(symbol, 0) + max(1, left // len(free))

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if self._differ(self.end[a], self.count[a], self.end[b], self.count[b]):
                return False
            for s in SYMBOLS:
                if self._differ(self.flow[a].get(s, 0), self.count[a], self.flow[b].get(s, 0), self.count[b]):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def fold(self, a: int, b: int, into: dict[int, int]) -> None:
        """Add state ``b`` and what follows it to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            while a in into:
                a = into[a]
            while b in into:
                b = into[b]
            if a == b:
                continue
            into[b] = a
            self.end[a] += self.end[b]
            self.count[a] += self.count[b]
            for s, flow in self.flow[b].items():
                self.flow[a][s] = self.flow[a].get(s, 0) + flow
            for s, follows in self.next[b].items():
                target = a if follows == b else follows
                if s in self.next[a]:
                    todo.append((self.next[a][s], target))
                else:
                    self.next[a][s] = target

    def merge(self) -> "Automaton":
        """Red states are settled; a blue one (next to a red one) joins a compatible red state or turns red."""
        red, into = [0], {}

        def final(state):
            while state in into:
                state = into[state]
            return state

        while True:
            blue = sorted({final(t) for r in red for t in self.next[r].values()} - set(red), key=lambda b: (-self.count[b], b))
            if not blue:
                break
            b = blue[0]
            match = next((r for r in red if self.compatible(r, b)), None)
            if match is None:
                red.append(b)
            else:
                self.fold(match, b, into)
            for r in red:
                self.next[r] = {s: final(t) for s, t in self.next[r].items()}
        return self

    def tables(self) -> tuple[list, list]:
        """(per state: symbol -> (state, log probability), per state: log probability of the end), smoothed by a half."""
        steps, ends = [], []
        for i in range(len(self.next)):
            total = sum(self.flow[i].values()) + self.end[i] + 0.5 * (len(SYMBOLS) + 1)
            steps.append({s: (self.next[i].get(s, i), math.log((self.flow[i].get(s, 0) + 0.5) / total)) for s in SYMBOLS})
            ends.append(math.log((self.end[i] + 0.5) / total))
        return steps, ends


def likelihood(form: str, tables) -> float:
    steps, ends = tables
    state = total = 0
    for symbol in form:
        state, more = steps[state][symbol]
        total += more
    return total + ends[state]


def infer(forms: DataFrame) -> tuple[dict, dict]:
    """({kind: (tables, least score)}, {symbol: log probability in texts}).

    Prefix counts are grouped sums; only nodes with enough support, at most ``DEEP / SUPPORT`` a kind, reach the driver.
    A kind with fewer than ``LEAST_LABELLED`` strings gets no automaton.
    """
    background = {r["form"]: r["n"] for r in forms.where("kind = -1").collect()}
    whole = sum(background.values()) + len(SYMBOLS)
    ordinary = {s: math.log((background.get(s, 0) + 1) / whole) for s in SYMBOLS}
    kinds = forms.where("kind >= 0")
    totals = kinds.groupBy("kind").agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST_LABELLED)
    prefix = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("form"), F.lit(DEEP))), lambda k: F.struct(F.substring("form", F.lit(1), k).alias("p"), (k == F.length("form")).alias("whole"))))
    counts = kinds.select("kind", "n", prefix.alias("x")).groupBy("kind", "x.p").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x.whole"), F.col("n")).otherwise(0)).alias("ends"))
    kept = counts.join(totals, "kind").where(F.col("n") >= F.greatest(F.lit(LEAST_COUNT), SUPPORT * F.col("total")))
    nodes: dict[int, tuple[dict, dict]] = {}
    for row in kept.collect():
        of_kind = nodes.setdefault(row["kind"], ({}, {}))
        of_kind[0][row["p"]], of_kind[1][row["p"]] = row["n"], row["ends"]
    tables = {kind: Automaton(c, e).merge().tables() for kind, (c, e) in sorted(nodes.items())}

    def ratio(form: str, kind: int) -> float:
        return (likelihood(form, tables[kind]) - sum(ordinary[s] for s in form)) / (len(form) + 1)

    @F.pandas_udf("double")
    def scored(kind: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([ratio(f, k) if k in tables else None for k, f in zip(kind, form)], dtype="float64")

    stats = kinds.select("kind", "n", scored("kind", "form").alias("r")).where("r IS NOT NULL").groupBy("kind").agg(
        (F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("m"), (F.sum(F.col("n") * F.col("r") * F.col("r")) / F.sum("n")).alias("q")
    )
    least = {r["kind"]: r["m"] - SPREAD * math.sqrt(max(0.0, r["q"] - r["m"] ** 2)) - 0.05 for r in stats.collect()}
    return {k: (t, least[k]) for k, t in tables.items() if k in least}, ordinary


def added_spans(text: str, data: bytes, taken: list, model: dict, ordinary: dict) -> list[tuple[int, int, int, str]]:
    """Candidates outside the base spans with a digit and a letter whose format an automaton finds as likely as its own."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        if any(start < m.end() and m.start() < end for start, _, end, _ in taken):
            continue
        form = classes(run)
        plain = sum(ordinary[s] for s in form)
        if any((likelihood(form, tables) - plain) / (len(form) + 1) >= max(least, 0.0) for tables, least in model.values()):
            found.append((m.start(), 3, m.end(), run))
    return found


_DIGIT_RUN = re.compile(rb"[0-9]")


def all_spans(text: str, data: bytes, model: dict, ordinary: dict) -> list[tuple[int, int, int, str]]:
    base = base_spans(text, data)
    more = added_spans(text, data, base, model, ordinary) if _DIGIT_RUN.search(data) else []
    return sorted(base + more)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def learn(docs: DataFrame) -> tuple[dict, dict]:
    return infer(labelled(docs))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar: one row per row of ``docs``.

    Spans are code points, end exclusive; those of the patterns are never left out, learnt ones (kind grammar) never
    overlap them. Null and empty texts have none. Repeated rows teach as often as they stand there. With too few labelled
    credentials nothing is learnt. An empty table gives no rows; other columns are ignored.
    """
    model, ordinary = learn(docs)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base string, spans string, n_grammar long")
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for data in texts:
            spans = all_spans(data.decode(), data, model, ordinary)
            kinds = [s[1] for s in spans]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), joined([s for s in spans if s[1] < 3]), joined(spans), kinds.count(3)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans", "n_grammar"])

    found = docs.select("doc_id", of_texts(binary("text")).alias("f"))
    return found.select("doc_id", "f.n_assign", "f.n_access", "f.n_hex", F.sha2(F.col("f.base").cast("binary"), 256).alias("base_sha256"), "f.spans", "f.n_grammar")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` and n_chars brought up to date; no row is dropped."""
    model, ordinary = learn(docs)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            data = text.encode() if text is not None else b""
            spans = all_spans(text, data, model, ordinary) if data else []
            if spans:
                parts, at = [], 0
                for start, _, end, _ in spans:
                    if end <= at:
                        continue  # inside the span before it
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = end
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    changed = docs.withColumn("text", cleaned("text"))
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed
