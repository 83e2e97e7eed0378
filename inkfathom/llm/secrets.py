"""Secret scans by grammar inference.

Base rules find assignments, access keys and long hex runs. The credentials that they find, labelled by kind, form a prefix tree
for each kind over shapes: each run of letters and digits has the class of its alphabet (hex, digits, lower case, ...) at all of
its places, and other characters stand for themselves, so that lengths and alphabets show in the tree. States of the tree are
merged where their futures do not differ with statistical significance, on stopping, on the next symbol and on the characters of a
symbol (the Hoeffding test, down the merged branches). Merging needs evidence: a state seen fewer than LEAST times
is neither compared nor merged, and strings that reach it go on under the kind's own frequencies of symbols and characters. What is left is a
probabilistic automaton for each kind, and one of ordinary runs. Every
candidate, a run of eight or more credential characters anywhere in a text that base spans do not cover, is scored whole by its
log-likelihood a character under each format less that under ordinary text; those over a threshold set on held-back credentials and
held-back ordinary runs are spans of the method. Spans of the base rules always stay.

Learned from: of each kind, and of ordinary runs, the LABELLED different ones of smallest hash in the whole corpus, among those of at most
LONGEST characters. That is a bound of the sample only; runs of any length are scored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import cut, drop, map_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Different runs of each kind that are learned from, and the longest of them.
LABELLED, LONGEST = 10_000, 512
#: Times that a state must be seen to be compared, and the chance that a test errs.
LEAST, ALPHA = 12, 0.005
#: Part of the learning sample that is held back, one in so many.
HELD = 5
#: Part of the ordinary runs that may be taken for credentials without a label.
TRIMMED = 0.02
#: A format must be likelier than ordinary text by so much a character, at least.
FLOOR = 0.3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base rules' spans, code points, end exclusive, sorted by start and kind as listed."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SEPARATORS = "+/_.=-"
#: Classes of runs of letters and digits, and the sizes of their alphabets.
ALPHABETS = {"d": 10, "h": 16, "H": 16, "l": 26, "u": 26, "m": 36, "U": 36, "c": 52, "x": 52, "z": 62} | dict.fromkeys(SEPARATORS, 1)
#: Of a kind's frequencies the part dealt evenly to all symbols, and of a state's the part that follows the kind's: the same in all automata,
#: so that what none of them has seen is no likelier under one with fewer examples.
EVEN, LOOSE = 0.001, 0.01
_RUN = re.compile(r"[A-Za-z0-9]+")
_HEX, _UPPER_HEX = set("0123456789abcdef"), set("0123456789ABCDEF")


def _class(m: re.Match) -> str:
    s = m[0]
    if s.isdigit():
        c = "d"
    elif s.islower():
        c = "l" if s.isalpha() else "h" if _HEX.issuperset(s) else "m"
    elif s.isupper():
        c = "u" if s.isalpha() else "H" if _UPPER_HEX.issuperset(s) else "U"
    else:
        c = "z" if not s.isalpha() else "c" if s[0].isupper() and s[1:].islower() else "x"
    return c * len(s)


def shape(run: str) -> str:
    """The class of each character's run."""
    return _RUN.sub(_class, run)


class Automaton:
    """A probabilistic automaton from strings, by merging the states of the prefix tree of their shapes."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # of symbols, "" for the end
        self.letters: list[dict[str, Counter]] = [{}]  # of each symbol's characters
        symbols, letters = Counter(), {c: Counter() for c in ALPHABETS}
        for s in strings:
            at = 0
            for symbol, c in zip(shape(s), s):
                self.count[at][symbol] += 1
                self.letters[at].setdefault(symbol, Counter())[c] += 1
                symbols[symbol] += 1
                letters[symbol][c] += 1
                if symbol not in self.next[at]:
                    self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.letters.append({})
                at = self.next[at][symbol]
            self.count[at][""] += 1
            symbols[""] += 1
        self.total = [c.total() for c in self.count]
        self._merge_all(math.sqrt(math.log(2 / alpha) / 2))
        self._score_tables(symbols, letters)

    def _apart(self, x: Counter, n: int, y: Counter, m: int, bound: float) -> bool:
        gap = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(x[c] / n - y[c] / m) > gap for c in {*x, *y})

    def _differ(self, a: int, b: int, bound: float) -> bool:
        """Whether two states, or some that the same symbols lead to from them, behave differently, as far as there is evidence."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if min(self.total[a], self.total[b]) < LEAST:
                continue
            if self._apart(self.count[a], self.total[a], self.count[b], self.total[b], bound):
                return True
            for symbol in self.letters[a].keys() & self.letters[b].keys():
                x, y = self.letters[a][symbol], self.letters[b][symbol]
                if min(n := x.total(), m := y.total()) >= LEAST and self._apart(x, n, y, m, bound):
                    return True
            pairs += [(self.next[a][c], to) for c, to in self.next[b].items() if c in self.next[a]]
        return False

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.total[a] += self.total[b]
            self.count[a].update(self.count[b])
            for symbol, own in self.letters[b].items():
                self.letters[a].setdefault(symbol, Counter()).update(own)
            for symbol, to in self.next[b].items():
                if symbol in self.next[a]:
                    pairs.append((self.next[a][symbol], to))
                else:
                    self.next[a][symbol] = to

    def _merge_all(self, bound: float) -> None:
        red = [0]
        while True:
            known = set(red)
            open_ = [(r, c, to) for r in red for c, to in self.next[r].items() if to not in known and self.total[to] >= LEAST]
            if not open_:
                break
            r, c, b = min(open_, key=lambda x: (-self.total[x[2]], x[0], x[1]))
            if (same := next((k for k in red if not self._differ(k, b, bound)), None)) is None:
                red.append(b)
            else:
                self.next[r][c] = same
                self._fold(same, b)
        names = {r: i for i, r in enumerate(red)}
        self.next = [{c: names[to] for c, to in self.next[r].items() if to in names} for r in red]
        self.count, self.letters, self.total = ([x[r] for r in red] for x in (self.count, self.letters, self.total))

    def _score_tables(self, symbols: Counter, letters: dict[str, Counter]) -> None:
        """For each state, and last for what no state supports: of each symbol the log-probabilities of its characters, and where it leads."""
        n, kinds = symbols.total(), len(ALPHABETS) + 1
        own = {c: (1 - EVEN) * symbols[c] / n + EVEN / kinds if n else 1 / kinds for c in [*ALPHABETS, ""]}
        members = {"d": "0123456789", "h": "0123456789abcdef", "H": "0123456789ABCDEF", "l": "abcdefghijklmnopqrstuvwxyz"}
        members["u"] = members["l"].upper()
        members |= {"m": members["d"] + members["l"], "U": members["d"] + members["u"], "c": members["l"] + members["u"], "x": members["l"] + members["u"], "z": members["d"] + members["l"] + members["u"]}
        chars = {c: {x: (letters[c][x] + 0.5) / (letters[c].total() + 0.5 * size) for x in members.get(c, c)} for c, size in ALPHABETS.items()}
        self.tables, self.ends, rest = [], [], len(self.next)
        for i in range(rest + 1):
            count, total = (self.count[i], self.total[i]) if i < rest else (Counter(), 0)
            table = {}
            for c in ALPHABETS:
                seen = self.letters[i].get(c, Counter()) if i < rest else Counter()
                p, k = (1 - LOOSE) * count[c] / total + LOOSE * own[c] if total else own[c], seen.total()
                table[c] = {x: math.log(p * (seen[x] + 4 * q) / (k + 4)) for x, q in chars[c].items()}, self.next[i].get(c, rest) if i < rest else rest
            self.tables.append(table)
            self.ends.append(math.log((1 - LOOSE) * count[""] / total + LOOSE * own[""] if total else own[""]))

    def score(self, run: str, shape_of: str) -> float:
        """Log-likelihood of a run and its end."""
        at, total, tables = 0, 0.0, self.tables
        for symbol, c in zip(shape_of, run):
            logs, at = tables[at][symbol]
            total += logs[c]
        return total + self.ends[at]


@dataclass
class Scanner:
    formats: dict[str, Automaton]
    ordinary: Automaton
    thresholds: dict[str, float]

    def __post_init__(self):
        self.kept: dict[str, str | None] = {}

    def over(self, kind: str, run: str) -> float:
        """How much likelier a character is on average under a format than in ordinary text."""
        s = shape(run)
        return (self.formats[kind].score(run, s) - self.ordinary.score(run, s)) / (len(run) + 1)

    def format_of(self, run: str) -> str | None:
        """The kind of the format that is most over its threshold, the first of equal ones; none if none is."""
        if (known := self.kept.get(run, "")) != "":
            return known
        s, best = shape(run), None
        plain = self.ordinary.score(run, s)
        for kind, a in self.formats.items():
            over = (a.score(run, s) - plain) / (len(run) + 1) - self.thresholds[kind]
            if over > 0 and (best is None or over > best[0]):
                best = over, kind
        if len(self.kept) >= 200_000:
            self.kept.clear()
        if len(run) <= 64:
            self.kept[run] = best and best[1]
        return best and best[1]

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The base rules' spans, and all: those and the candidates not covered by them that fit a format (kind format-KIND)."""
        base = base_spans(text)
        more = [(a, b, f"format-{kind}") for a, b in candidates(text, base) if (kind := self.format_of(text[a:b]))] if self.formats else []
        order = [*KINDS, *(f"format-{k}" for k in KINDS)]
        return base, sorted(base + more, key=lambda s: (s[0], order.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters, without full stops round them, of which base spans leave something uncovered."""
    k = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if text[a] == "." or text[b - 1] == ".":
            run = m[0]
            a, b = a + len(run) - len(run.lstrip(".")), b - len(run) + len(run.rstrip("."))
            if b - a < 8:
                continue
        if base:
            while k < len(base) and base[k][1] <= a:
                k += 1
            at, i = a, k
            while i < len(base) and base[i][0] <= at < b:
                at, i = max(at, base[i][1]), i + 1
            if at >= b:
                continue
        yield a, b


def labelled(text: str) -> Iterator[tuple[str, str]]:
    """Kind and run of the credentials that the base rules find, and of all other candidates (kind ordinary)."""
    base = base_spans(text)
    for a, b, kind in base:
        yield kind, ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
    for a, b in candidates(text, base):
        yield "ordinary", text[a:b]


def sample(rows: DataFrame, size: int = LABELLED) -> dict[str, list[str]]:
    """Of each kind the different runs of smallest hash in all rows (text), size of them at most; each task keeps no more than that."""

    def fewest(batches):
        kept: dict[str, dict[int, str]] = {k: {} for k in (*KINDS, "ordinary")}
        most = dict.fromkeys(kept, 1 << 64)
        for batch in batches:
            for text in batch.column("text"):
                for kind, run in labelled(text.as_py() or ""):
                    h = xxhash.xxh64_intdigest(run)
                    if h < most[kind] and len(run) <= LONGEST:
                        own = kept[kind]
                        own[h] = run
                        if len(own) > 2 * size:
                            kept[kind] = own = {k: own[k] for k in sorted(own)[:size]}
                            most[kind] = max(own)
        for kind, own in kept.items():
            found = sorted(own)[:size]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(found), pa.string()), "h": pa.array([h - (1 << 63) for h in found], pa.int64()), "run": pa.array([own[h] for h in found], pa.string())})

    runs = cut(rows.select("text").mapInArrow(fewest, "kind string, h long, run string").distinct())
    out = {k: [r.run for r in runs.where(F.col("kind") == k).orderBy("h", "run").limit(size).collect()] for k in (*KINDS, "ordinary")}  # size rows at most
    drop(runs)
    return out


def trained(chosen: dict[str, list[str]]) -> Scanner:
    """Automata and thresholds from runs of each kind, one in HELD of which is held back for the thresholds.

    Ordinary runs may hold credentials that no base rule labelled. Those likelier under a format than under a first automaton of all
    ordinary runs are taken out and a second one is learned, unless they are over TRIMMED of the runs, too many to be credentials.
    A format's threshold lies half way between the highest of the held-back ordinary runs and the lowest credentials but one in fifty; where those
    overlap it is the highest of the ordinary ones. A kind without credentials has no format.
    """
    rest = {k: [s for i, s in enumerate(v) if i % HELD or len(v) < HELD] for k, v in chosen.items()}
    held = {k: v[::HELD] for k, v in chosen.items()}
    made = Scanner({k: Automaton(rest[k]) for k in KINDS if rest[k]}, Automaton(rest["ordinary"]), {})
    plain = {n: [s for s in runs["ordinary"] if all(made.over(k, s) <= 0 for k in made.formats)] for n, runs in (("rest", rest), ("held", held))}
    if len(rest["ordinary"]) > len(plain["rest"]) >= (1 - TRIMMED) * len(rest["ordinary"]):
        made.ordinary, held["ordinary"] = Automaton(plain["rest"]), plain["held"]
    for kind in made.formats:
        good = sorted(made.over(kind, s) for s in held[kind])
        low, high = good[len(good) // 50], max((made.over(kind, s) for s in held["ordinary"]), default=0.0)
        made.thresholds[kind] = max((low + high) / 2 if low > high else high, FLOOR)
    return made


def learn(rows: DataFrame, size: int = LABELLED) -> Scanner:
    return trained(sample(rows, size))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(columns: dict[str, list], scanner) -> dict[str, list]:
    out = {n: [] for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for doc_id, text in zip(columns["doc_id"], columns["text"]):
        base, every = scanner.value.spans(text or "")
        kinds = [k for *_, k in base]
        for name, value in zip(out, (doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))):
            out[name].append(value)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row.

    A null text is empty and has no spans. Of spans that begin at one place the kinds come in the order listed, base first. A text or run of any length is
    read whole. Where the corpus has few credentials of a kind, states lack evidence and the format is that of its symbols and
    characters; where it has none there is no format. Rows may repeat; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanner = docs.sparkSession.sparkContext.broadcast(learn(rows))  # automata of at most LABELLED strings each
    return map_texts(rows, _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", (scanner,))


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; the name before an assigned value goes with it. Overlaps are one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the spans in the text replaced.

    A null text stays null and an empty one empty; rows that repeat stay, each with its own text replaced; texts are read whole;
    an empty table stays empty. Other columns are not touched, whatever their names.
    """
    import pandas as pd

    scanner = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col(text_col).alias("text"))))

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None else redact_text(t, scanner.value.spans(t)[1]))

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))
