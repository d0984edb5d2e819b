"""Secret scans: fixed patterns, and formats learnt as probabilistic automata from what the patterns find."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import rows_of, spans_text, store, whole

# The base patterns, their kinds in order, and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so its least length can stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Candidates: runs of the characters of an assigned value, of its least length or longer.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Bounds of the fit: distinct credentials for each kind, distinct ordinary candidates, and what is read of a value.
CREDENTIALS, ORDINARY, FITTED_CHARS = 400, 10_000, 256
#: Confidence of the compatibility test: the smaller, the more states are merged.
ALPHA = 0.05
#: Share of credentials held out of the fit that must reach the threshold.
ACCEPTED = 0.95
#: Share of ordinary candidates held out of the fit whose evidence a credential must exceed, and least evidence in bits.
REFUSED, LEAST_BITS = 0.999, 12.0
#: Candidates of which a task remembers the outcome, and how long these may be.
REMEMBERED, REMEMBERED_CHARS = 1 << 17, 64
_CLASSES = (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_CLASS_OF = {c: name for name, chars in _CLASSES for c in chars}
_CLASS_BITS = {name: math.log2(len(chars)) for name, chars in _CLASSES}
_CHARS_OF = dict(_CLASSES)
#: Bits of a character after one that a format does not allow, of any of the 68 candidate characters, and of being odd.
LOST_BITS, ANY_CHAR_BITS, ODD_BITS = 12.0, math.log2(68), 3.0
END = "$"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, by start and kind."""
    found = []
    if ("=" in text or ":" in text) and any(w in (low := text.lower()) for w in _WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        del low
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidate_spans(text: str, taken: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs, or of what base spans leave of them."""
    at = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][2] <= start:
            at += 1
        k = at
        while k < len(taken) and taken[k][1] < end:
            # what a base span leaves before it
            if taken[k][1] - start >= LEAST_ASSIGN:
                yield start, taken[k][1]
            start = max(start, taken[k][2])
            k += 1
        if end - start >= LEAST_ASSIGN:
            yield start, end


def symbols(value: str) -> list[str]:
    return [_CLASS_OF.get(c, c) for c in value]


@dataclass
class State:
    arrived: int = 0
    ended: int = 0
    taken: Counter = field(default_factory=Counter)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton over character classes, learnt by merging compatible states of a prefix tree."""

    def __init__(self, values: Iterable[str], alpha: float = ALPHA) -> None:
        values = list(values)
        self.lengths = Lengths(values)
        self.states: list[State] = [State()]
        for value in values:
            self._add(symbols(value))
        self.margin = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_compatible()
        self._tabulate()

    def _add(self, word: list[str]) -> None:
        at = 0
        for s in word:
            state = self.states[at]
            state.arrived += 1
            state.taken[s] += 1
            if s not in state.to:
                state.to[s] = len(self.states)
                self.states.append(State())
            at = state.to[s]
        self.states[at].arrived += 1
        self.states[at].ended += 1

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        """Whether two frequencies differ by more than the Hoeffding bound allows."""
        return n > 0 and m > 0 and abs(x / n - y / m) > self.margin * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            one, two = (self.states[i] for i in todo.pop())
            if self._differ(one.ended, one.arrived, two.ended, two.arrived):
                return False
            for s in one.taken.keys() | two.taken.keys():
                if self._differ(one.taken[s], one.arrived, two.taken[s], two.arrived):
                    return False
                if s in one.to and s in two.to:
                    todo.append((one.to[s], two.to[s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to ``a``; ``b`` is the root of a tree that nothing else leads into."""
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            one, two = self.states[i], self.states[j]
            one.arrived += two.arrived
            one.ended += two.ended
            one.taken.update(two.taken)
            for s, k in two.to.items():
                if s in one.to:
                    todo.append((one.to[s], k))
                else:
                    one.to[s] = k

    def _merge_compatible(self) -> None:
        red = [0]
        while True:
            settled = set(red)
            blue = next(((r, s, k) for r in red for s, k in sorted(self.states[r].to.items()) if k not in settled), None)
            if blue is None:
                break
            r, s, k = blue
            into = next((x for x in red if self._compatible(x, k)), None)
            if into is None:
                red.append(k)
            else:
                self.states[r].to[s] = into
                self._fold(into, k)
        names = {old: new for new, old in enumerate(red)}
        self.states = [State(x.arrived, x.ended, x.taken, {s: names[k] for s, k in x.to.items()})
                       for x in (self.states[i] for i in red)]

    def _tabulate(self) -> None:
        """Code length and next state of each character in each state; of a character never seen there; of the end."""
        self.steps: list[dict[str, tuple[float, int]]] = []
        self.lost: list[float] = []
        self.ends: list[float] = []
        for x in self.states:
            def cost(n: int, x: State = x) -> float:
                return -math.log2((n + 0.02) / (x.arrived + 1))

            self.steps.append({c: (cost(n) + _CLASS_BITS.get(s, 0.0), x.to[s])
                               for s, n in x.taken.items() for c in _CHARS_OF.get(s, s)})
            self.lost.append(cost(0))
            self.ends.append(cost(x.ended))

    def bits(self, value: str) -> float:
        """Code length of a value, which is the negative logarithm of its likelihood."""
        at, total = 0, self.lengths.bits(value)
        for i, c in enumerate(value):
            step = self.steps[at].get(c)
            if step is None:
                return total + self.lost[at] + LOST_BITS * (len(value) - i)
            total += step[0]
            at = step[1]
        return total + self.ends[at]


class Lengths:
    """How long values are, in doublings."""

    def __init__(self, values: Iterable[str]) -> None:
        self.seen = Counter(len(v).bit_length() for v in values)
        self.most = sum(self.seen.values()) + 1

    def bits(self, value: str) -> float:
        return -math.log2((self.seen[len(value).bit_length()] + 0.05) / self.most)


class Ordinary:
    """What a format must beat: pairs of character classes in candidates that no base pattern found, or, for what is
    rare among these, any characters at all."""

    def __init__(self, values: Iterable[str]) -> None:
        values = list(values)
        self.lengths = Lengths(values)
        pairs: dict[str, Counter] = defaultdict(Counter)
        for value in values:
            word = symbols(value)
            for a, b in zip(["^", *word], [*word, END]):
                pairs[a][b] += 1
        self.cost = {a: {b: -math.log2((n + 0.5) / (seen.total() + 5)) + _CLASS_BITS.get(b, 0.0) for b, n in seen.items()}
                     for a, seen in pairs.items()}
        self.rare = {a: math.log2((seen.total() + 5) / 0.5) for a, seen in pairs.items()}

    @staticmethod
    def most_bits(value: str) -> float:
        return ODD_BITS + ANY_CHAR_BITS * len(value)

    def bits(self, value: str) -> float:
        word, most, total = symbols(value), self.most_bits(value), self.lengths.bits(value)
        for a, b in zip(["^", *word], [*word, END]):
            cost = self.cost.get(a, {}).get(b)
            total += self.rare.get(a, 3.3) + _CLASS_BITS.get(b, 0.0) if cost is None else cost
            if total >= most:
                return most
        return total


@dataclass
class Formats:
    """Automata by kind, the ordinary model, and thresholds: bits gained for each character, and in all."""

    automata: dict[str, Automaton]
    ordinary: Ordinary
    least: dict[str, float]
    evidence: dict[str, float]

    @staticmethod
    def fit(labelled: dict[str, list[str]], ordinary: list[str]) -> Formats:
        automata, least, evidence, plain = {}, {}, {}, Ordinary(ordinary[::2])
        for kind, values in sorted(labelled.items()):
            fit, held = values[::2], values[1::2]
            if len(held) < 8:
                continue
            model = automata[kind] = Automaton(fit)
            gains = sorted((plain.bits(v) - model.bits(v)) / max(len(v), 1) for v in held)
            least[kind] = max(0.1, gains[int((1 - ACCEPTED) * len(gains))])
            # a value that is ordinary by chance gains bits too, and there are many more of these
            chance = sorted(g for v in ordinary[1::2] if (g := plain.bits(v) - model.bits(v)) / len(v) >= least[kind])
            over = math.ceil((1 - REFUSED) * len(ordinary[1::2]))  # some of them are credentials without a name
            evidence[kind] = max(LEAST_BITS, chance[-1 - over] if len(chance) > over else 0.0)
        return Formats(automata, plain, least, evidence)

    def kind_of(self, value: str) -> str | None:
        """The kind whose format fits best, among those that reach their thresholds."""
        most = self.ordinary.most_bits(value)
        bits = {k: n for k, a in self.automata.items() if most - (n := a.bits(value)) > self.evidence[k]}
        if not bits:
            return None
        base = self.ordinary.bits(value)
        gains = {k: base - n for k, n in bits.items()}
        fitting = [k for k, g in gains.items() if g > self.evidence[k] and g / max(len(value), 1) >= self.least[k]]
        return max(fitting, key=lambda k: (gains[k], k), default=None)


class LeastValues:
    """The distinct values of least CRC-32 (then of greatest value), at most so many."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.heap: list[tuple[int, str]] = []
        self.held: set[str] = set()

    def add(self, value: str) -> None:
        entry = (-zlib.crc32(value.encode()), value)
        if len(self.heap) == self.most and entry <= self.heap[0] or value in self.held:
            return
        self.held.add(value)
        if len(self.heap) < self.most:
            heapq.heappush(self.heap, entry)
        else:
            self.held.discard(heapq.heappushpop(self.heap, entry)[1])


def sample_values(texts: DataFrame) -> DataFrame:
    """``kind, value`` to fit on: of each task's credentials by kind, and of its ordinary candidates (kind ''), the least
    by CRC-32.  Those of all tasks hold the least of the whole table, so the fit does not depend on the partitions."""
    most = {**dict.fromkeys(KINDS, CREDENTIALS), "": ORDINARY}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: LeastValues(n) for kind, n in most.items()}
        for batch in batches:
            for rows in rows_of(batch, 64):
                for text in rows["text"]:
                    base = base_spans(text)
                    for kind, _, _, value in base:
                        held[kind].add(value[:FITTED_CHARS])
                    for start, end in candidate_spans(text, base):
                        held[""].add(text[start:min(end, start + FITTED_CHARS)])
        for kind, least in held.items():
            values = sorted(least.held)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values), pa.string()), pa.array(values, pa.string())],
                                             names=["kind", "value"])

    return texts.mapInArrow(sample, "kind string, value string")


def fit_formats(texts: DataFrame) -> Formats:
    """Learns from a bounded sample, the least by CRC-32, of the distinct values in ``texts`` (text)."""
    values = store(sample_values(texts).distinct(), "secret-values")
    labelled: dict[str, list[str]] = {}
    for kind, most in [*((k, CREDENTIALS) for k in KINDS), ("", ORDINARY)]:
        # written, since a collected limit would send so many values of every partition to the driver
        least = store(values.filter(F.col("kind") == kind).withColumn("h", F.crc32(F.col("value").cast("binary")))
                      .orderBy("h", F.desc("value")).limit(most), "secret-sample")
        labelled[kind] = [r["value"] for r in least.orderBy("h", F.desc("value")).collect()]
    ordinary = labelled.pop("")
    return Formats.fit(labelled, ordinary)


def learnt_spans(formats: Formats, text: str, base: list[tuple[str, int, int, str]],
                 kind_of: Callable[[str], str | None]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the candidates that follow a learnt format, whole or after their last inner ``=``."""
    for start, end in candidate_spans(text, base):
        value = text[start:end]
        kind = kind_of(value) if len(value) <= REMEMBERED_CHARS else formats.kind_of(value)
        if kind is None and "=" in value and (cut := value.rstrip("=").rfind("=") + 1) and len(value) - cut >= LEAST_ASSIGN:
            start += cut
            kind = formats.kind_of(value[cut:])
        if kind:
            yield f"like_{kind}", start, end


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base (kind, start, end), learnt (kind, start, end)`` for each row of ``docs``.

    Positions are code points, ends exclusive.  The base patterns label the credentials from which the formats are
    learnt; every run of six or more of the characters an assigned value may hold, in every text, is then scored by its
    likelihood under each format against that under ordinary runs, and those over a kind's thresholds are added as
    ``like_<kind>``.  A run that a base span cuts is scored in its parts.  A kind with fewer than 16 credentials teaches
    nothing.  The fit reads the first ``FITTED_CHARS`` of a value, the scan all of it.  Texts are read twice, once to fit;
    nothing is shuffled but the sample.  Null texts are empty; null keys, repeated rows and empty tables pass through;
    further columns are ignored.
    """
    kind = docs.select(key).limit(0).toArrow().schema.field(0).type
    id_type = docs.select(key).schema.simpleString()[7:-1]
    span = "array<struct<kind:string,start:bigint,`end`:bigint>>"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    formats = fit_formats(docs.select(whole(text).alias("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = lru_cache(REMEMBERED)(formats.kind_of)
        for batch in batches:
            for rows in rows_of(batch, 64):
                base, learnt = [], []
                for t in rows["text"]:
                    own = base_spans(t)
                    base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
                    learnt.append([dict(zip(("kind", "start", "end"), s)) for s in learnt_spans(formats, t, own, kind_of)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["key"], kind), pa.array(base, span_type), pa.array(learnt, span_type)],
                    names=[key, "base", "learnt"])

    return docs.select(F.col(key).alias("key"), whole(text).alias("text")).mapInArrow(
        scan, f"{id_type}, base {span}, learnt {span}")


def secret_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans that :func:`scan_secrets` found."""
    kind = found.select(key).limit(0).toArrow().schema.field(0).type
    id_type = found.select(key).schema.simpleString()[7:-1]
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 1024):
                out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
                for base, learnt in zip(rows["base"], rows["learnt"]):
                    own = [(s["kind"], s["start"], s["end"]) for s in base]
                    more = [(s["kind"], s["start"], s["end"]) for s in learnt]
                    seen = Counter(s[0] for s in own)
                    for k in KINDS:
                        out[f"n_{k}"].append(seen[k])
                    out["base_sha256"].append(hashlib.sha256(spans_text(own).encode()).hexdigest())
                    out["spans"].append(spans_text(sorted(own + more, key=lambda s: s[1])))
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"], kind), *map(pa.array, out.values())],
                                                 names=[key, *out])

    return found.select(F.col(key).alias("key"), "base", "learnt").mapInArrow(
        digest, f"{id_type}, {counts}, base_sha256 string, spans string")
