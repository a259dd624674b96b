"""Fields that pack several values into one string, split into one value a row.

Method: segmentation by expectation-maximisation. Certain delimiters (tabs, line
ends, semicolons, bars, bullets, numbering) always cut; quoted spans and
parentheses are atomic. What commas, "and" and "&" mean is uncertain, since
values hold them too. A model of the column gives each possible value a
probability: how often the value stands in the column, and how likely its first
and last word and its number of words are. The model starts from the values
that no uncertain delimiter touches. Each round takes, for every field, the
expected number of times that each path through the lattice of its uncertain
delimiters holds a value and a cut (forward and backward sums), and counts those
as the next model, until the likelihood of the column gains less than ``SETTLED``
of itself. The best path under the last model (Viterbi) gives the values. A
quoted span comes out as it stands.

Scale: value counts stay a table and are joined to the candidate values of the
lattices; only words that begin or end one value in ``KNOWN`` are gathered, of which there can be no
more than ``KNOWN``. A value that is one in ``RARE`` is looked up from memory, so that no hot
key is shuffled.

Defined results: null and empty fields and fields of delimiters only give no
rows; empty values count neither as a row nor as a position; a row delivered
twice (same key, same field) counts once; key and output names can't clash with
other columns, since only the two named columns are read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpointed

RARE = 2000
#: A first or last word counts as known if it stands in one of so many values, so there are no more known words than this.
KNOWN = 600
#: Characters of the longest value that may hold uncertain delimiters.
LONGEST = 200
#: Share of the log likelihood by which a round must gain for another one, and the most rounds.
SETTLED, ROUNDS = 2e-3, 12
#: A field's expectation of a value counts from this on: lesser ones of a legal form, summed over a column, would make it a value.
SLIGHT = 0.5

HARD = re.compile(r"<br\s*/?>|[;；|\t\n\r•·]+|\s/\s|\s?//\s?", re.I)
SOFT = re.compile(r"\s*,\s*(?:and|&)\s+|\s*,\s*|\s+(?:and|&|und|et|y)\s+", re.I)
NUMBERED = re.compile(r"(?:(?<=\s)|^)\(\d{1,2}\)\s+")
POINTED = re.compile(r"(?:(?<=\s)|^)\d{1,2}[.)]\s+(?=\S)")
LEAD = re.compile(r"^\s*(?:(?:by\s+and\s+)?between\s+|and\s+|&\s+|,\s*|\(?\d{1,2}[.)]\s+|[a-z]\)\s+|[-–*]\s+)", re.I)
DESCRIBES = re.compile(r"[\"“”„‘’']|^\s*(?:the|a|an|each|hereinafter|collectively|together|as)\b|\baffiliates\b", re.I)
OPEN_QUOTES = {'"': '"', "“": "”", "«": "»"}
WORD = re.compile(r"[^\s,]+")


@dataclass
class Field:
    """A field cut at its certain delimiters: texts and whether each was quoted."""

    segments: list[tuple[str, bool]] = field(default_factory=list)
    #: Did a delimiter other than quotes cut the field? Beside quotes alone, commas still part values.
    hard: bool = False


def _closing(text: str, at: int) -> int:
    """Index after the parenthesis that closes the one at ``at``, or ``at`` if none does."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] == "(":
            depth += 1
        elif text[k] == ")":
            depth -= 1
            if not depth:
                return k + 1
    return at


def certain_cuts(text: str) -> Field:
    """Cuts a field at delimiters that can't belong to a value."""
    out = Field()
    body = text.strip()
    if body.startswith("[") and body.endswith("]"):
        try:
            values = json.loads(body)
            if isinstance(values, list):
                out.segments = [(v, True) for v in values if isinstance(v, str)]
                return out
        except ValueError:
            pass
    marks = [m for m in (NUMBERED.finditer(body) if NUMBERED.match(body) else POINTED.finditer(body) if POINTED.match(body) else ())]
    begins = {m.start(): m.end() for m in marks}
    at = start = 0
    while at < len(body):
        if at in begins and (at == 0 or body[at - 1].isspace()):
            out.segments.append((body[start:at], False))
            out.hard = True
            at = start = begins[at]
            continue
        c = body[at]
        if c == "(" and (end := _closing(body, at)) > at:
            at = end
            continue
        if c in OPEN_QUOTES and (not body[start:at].strip(" ,") or body[start:at].rstrip().endswith(",")):
            close = _quote_end(body, at, OPEN_QUOTES[c])
            if close:
                if body[start:at].strip(" ,"):
                    out.segments.append((body[start:at].rstrip().rstrip(","), False))
                out.segments.append((body[at + 1 : close].replace(c + c, c), True))
                at = start = close + 1
                continue
        if m := HARD.match(body, at):
            out.segments.append((body[start:at], False))
            out.hard |= bool(body[start:at].strip()) and bool(body[m.end() :].strip())
            at = start = m.end()
            continue
        at += 1
    out.segments.append((body[start:], False))
    return out


def _quote_end(text: str, at: int, close: str) -> int | None:
    """Where the span quoted from ``at`` ends, if a delimiter or the end follows its quote."""
    k = at + 1
    while (k := text.find(close, k)) >= 0:
        if text[k + 1 : k + 2] == close and close == '"':
            k += 2
            continue
        rest = text[k + 1 :].lstrip()
        return k if not rest or rest[0] in ",;|\t\n\r/•<&(" or re.match(r"(?:and|&)\s", rest) or text[k + 1] in "\t\r\n" else None
    return None


@lru_cache(maxsize=100_000)
def trimmed(value: str) -> str:
    """A value without blanks, quotes, numbering, joining words, descriptions after it and the comma before those."""
    while True:
        before = value
        value = value.strip().strip(",").strip()
        if len(value) > 1 and value[0] in OPEN_QUOTES and value.endswith(OPEN_QUOTES[value[0]]) and OPEN_QUOTES[value[0]] not in value[1:-1]:
            value = value[1:-1]
        value = LEAD.sub("", value, count=1)
        if value.endswith(")"):
            at = _opening(value)
            if at is not None and not _country(value[:at], value[at + 1 : -1]):
                value = value[:at]
        if value == before:
            return value


def _country(name: str, inside: str) -> bool:
    """Is what stands in parentheses after a name the code of a country, and no short name made of the name's letters?"""
    if not re.fullmatch(r"[A-Z]{2,3}", inside) or name.isupper():
        return False
    letters = iter(name.upper())
    return not all(c in letters for c in inside)


def _opening(value: str) -> int | None:
    depth = 0
    for k in range(len(value) - 1, -1, -1):
        if value[k] == ")":
            depth += 1
        elif value[k] == "(":
            depth -= 1
            if not depth:
                return k
    return None


def uncertain_cuts(segment: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the delimiters outside parentheses that may or may not cut."""
    out, at = [], 0
    while at < len(segment):
        if segment[at] == "(" and (end := _closing(segment, at)) > at:
            at = end
        elif (segment[at] == "," or segment[at].isspace()) and (m := SOFT.match(segment, at)):
            word = m.group().strip().lower()
            out.append((m.start(), m.end(), ",&" if word[0] == "," and len(word) > 1 else word))
            at = m.end()
        else:
            at += 1
    return [d for d in out if segment[: d[0]].strip() and segment[d[1] :].strip()]


def normal(value: str) -> str:
    """The form under which a value is counted."""
    return " ".join(value.lower().split())


Shape = tuple[str, str, int, bool, bool, str]


@lru_cache(maxsize=100_000)
def shape(value: str) -> Shape | None:
    """(first word, last word, words, holds a joining word, holds a comma, words before those) of a trimmed value; None if it can't be one."""
    at = 0
    while (at := value.find("(", at)) >= 0:
        end = _closing(value, at)
        if end > at and DESCRIBES.search(value[at + 1 : end - 1]):
            return None
        at += 1
    lower = value.lower()
    words = [w.replace(".", "") or w for w in WORD.findall(lower)]
    if not words:
        return None
    before = [w[-1].replace(".", "") for a, _, _ in uncertain_cuts(lower) if (w := WORD.findall(lower[:a]))]
    return words[0], words[-1], min(len(words), 9), bool({"and", "&"} & set(words[1:-1])), "," in value, " ".join(before)


@dataclass
class Model:
    """What is known of the column's values. ``ends`` and ``starts`` hold frequent words only."""

    total: int = 1
    ends: dict[str, int] = field(default_factory=dict)
    starts: dict[tuple[str, str], int] = field(default_factory=dict)
    sizes: Counter = field(default_factory=Counter)
    kind_sizes: Counter = field(default_factory=Counter)
    inner: Counter = field(default_factory=Counter)
    cuts: dict[tuple[str, bool, bool], int] = field(default_factory=dict)
    hot: dict[str, int] = field(default_factory=dict)
    rare_ends: int = 1
    started: Counter = field(default_factory=Counter)

    def classes(self, s: Shape) -> tuple[str, str, str]:
        """Classes of the last word, of the first, and which kind of end there is."""
        end = s[1] if s[1] in self.ends else "?"
        kind = "known" if end != "?" else "?"
        start = s[0] if (kind, s[0]) in self.starts else "?"
        return end, start, kind

    def log_value(self, value: str, count: int) -> float:
        """Log probability of a trimmed value that stands ``count`` times in the column."""
        s = shape(value)
        if s is None:
            return -1e6
        end, start, kind = self.classes(s)
        of_end = self.ends[end] if end != "?" else self.rare_ends
        of_kind = self.total - self.rare_ends if kind == "known" else self.rare_ends
        p = (of_end + 0.5) / (self.total + 1)
        p *= ((self.starts[kind, start] if start != "?" else max(0, of_kind - self.started[kind])) + 0.5) / (of_kind + 1)
        of_size = (self.kind_sizes[kind, *s[2:5]] + 0.02) / (of_kind + 1)
        p *= (self.sizes[end, *s[2:5]] + 2 * of_size) / (of_end + 2)
        for w in s[5].split():
            if w in self.ends:  # a word that ends values stands inside this one
                p *= (self.inner[w] + 0.1) / (self.inner[w] + self.ends[w])
        return math.log(0.5 * p + 0.5 * max(0, count - 1) / (self.total + 1) + 1e-30)

    def log_cut(self, kind: str, hard: bool, cut: bool) -> float:
        """Log probability that an uncertain delimiter cuts, or doesn't."""
        yes, no = self.cuts.get((kind, hard, True), 0) + 1, self.cuts.get((kind, hard, False), 0) + 1
        return math.log((yes if cut else no) / (yes + no))


def spans(segment: str) -> tuple[list[tuple[int, int, str]], dict[tuple[int, int], str]]:
    """Delimiters of a segment and the trimmed value between each two of its nodes."""
    cuts = uncertain_cuts(segment)
    nodes = [(0, 0), *((a, b) for a, b, _ in cuts), (len(segment), len(segment))]
    values = {
        (i, j): trimmed(segment[nodes[i][1] : nodes[j][0]])
        for i in range(len(nodes) - 1)
        for j in range(i + 1, len(nodes))
        if j == i + 1 or nodes[j][0] - nodes[i][1] <= LONGEST
    }
    return cuts, values


def lattice(segment: str, hard: bool, model: Model, counts: dict[str, int]) -> tuple[list[tuple[int, int, str]], dict[tuple[int, int], str], list[list[tuple[int, float]]]]:
    """Delimiters, values, and for each node the edges that end there: (node where it begins, log probability of the value, its uncut delimiters and the cut after it)."""
    cuts, values = spans(segment)
    last = len(cuts) + 1
    kept = [0.0]
    for _, _, kind in cuts:
        kept.append(kept[-1] + model.log_cut(kind, hard, False))
    edges: list[list[tuple[int, float]]] = [[] for _ in range(last + 1)]
    for (i, j), v in values.items():
        n = normal(v)
        cut = model.log_cut(cuts[j - 1][2], hard, True) if j < last else 0.0
        edges[j].append((i, (model.log_value(v, model.hot.get(n, counts.get(n, 0))) if v else 0.0) + cut + kept[j - 1] - kept[i]))
    return cuts, values, edges


def best_path(segment: str, hard: bool, model: Model, counts: dict[str, int]) -> tuple[list[str], list[tuple[str, bool, bool]]]:
    """Values of the likeliest cut of a segment, and what became of each delimiter."""
    cuts, values, edges = lattice(segment, hard, model, counts)
    best: list[tuple[float, int]] = [(0.0, -1)]
    for ends in edges[1:]:
        best.append(max((best[i][0] + score, i) for i, score in ends))
    path, j = [], len(edges) - 1
    while j > 0:
        path.append((best[j][1], j))
        j = best[j][1]
    at = {i for i, _ in path}
    return [values[p] for p in reversed(path) if values[p]], [(kind, hard, k in at) for k, (_, _, kind) in enumerate(cuts, 1)]


def _sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def expectations(segment: str, hard: bool, model: Model, counts: dict[str, int]) -> tuple[float, dict[str, float], list[tuple[str, bool, bool, float]]]:
    """Log likelihood of a segment, the expected number of each value without uncertain delimiters, and of each fate of its delimiters."""
    cuts, values, edges = lattice(segment, hard, model, counts)
    last = len(edges) - 1
    forward = [0.0]
    for ends in edges[1:]:
        forward.append(_sum([forward[i] + score for i, score in ends]))
    onward: list[list[float]] = [[] for _ in edges]
    backward = [0.0] * len(edges)
    for j in range(last, 0, -1):
        if j < last:
            backward[j] = _sum(onward[j])
        for i, score in edges[j]:
            onward[i].append(score + backward[j])
    total = forward[last]
    found: dict[str, float] = {}
    # a composite that was left uncut mustn't vouch for itself: values with uncertain delimiters come from sure segments only
    for j in range(1, last + 1):
        for i, score in edges[j]:
            if i == j - 1 and values[i, j]:
                found[values[i, j]] = found.get(values[i, j], 0.0) + math.exp(forward[i] + score + backward[j] - total)
    fates = []
    for k, (_, _, kind) in enumerate(cuts, 1):
        p = min(1.0, math.exp(forward[k] + backward[k] - total))
        fates += [(kind, hard, True, p), (kind, hard, False, 1.0 - p)]
    return total, found, fates


def _evidence(values: dict[str, float]) -> Iterator[tuple[str, str, float]]:
    """Facts of values with their weights: (what, key, weight)."""
    for v, weight in values.items():
        s = shape(v) if weight >= SLIGHT else None
        if s:
            yield "value", normal(v), weight
            yield "end", s[1], weight
            yield "shape", json.dumps(s), weight


def _certain(text: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """(segment, whether it was quoted, whether its uncertain delimiters may be taken as part of a value) of a field, and whether certain delimiters cut it."""
    cut = certain_cuts(text)
    segments, hard = [(s, q) for s, q in cut.segments if s.strip()], cut.hard
    return [(s, q, q or hard or not uncertain_cuts(s)) for s, q in segments], hard


def _whole(segment: str, quoted: bool) -> str:
    """The value of a segment that isn't cut: a quoted span as it stands."""
    return segment.strip() if quoted else trimmed(segment)


def _initial(text: str) -> Iterator[tuple[str, str, float]]:
    """Evidence of the segments that were quoted, stand between certain delimiters, or hold no other."""
    yield from _evidence(Counter(v for s, quoted, sure in _certain(text)[0] if sure and (v := _whole(s, quoted))))


def _sure_composites(text: str) -> Iterator[tuple[str, str, float]]:
    """Evidence of values that hold uncertain delimiters, from sure segments."""
    yield from _evidence(Counter(v for s, quoted, sure in _certain(text)[0] if sure and (v := _whole(s, quoted)) and uncertain_cuts(v)))


def _counted(batches: Iterator[pa.RecordBatch], facts) -> Iterator[pa.RecordBatch]:
    """Facts (what, key, weight) summed within a task before they are shuffled."""
    seen: dict[tuple[str, str], float] = defaultdict(float)

    def out() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([seen[k] for k in keys], pa.float64())], names=["what", "key", "n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            for what, key, weight in facts(*row):
                seen[what, key] += weight
        if len(seen) > 200_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _total(facts: DataFrame) -> float:
    return facts.where("what = 'end'").agg(F.sum("n")).first()[0] or 0


def _model_of(facts: DataFrame) -> Model:
    """The bounded part of the model, from a table (what, key, n).

    Each table collected has at most as many rows as ``KNOWN``, ``RARE`` and the kinds of shapes and delimiters allow.
    """
    total = _total(facts)
    model = Model(total=max(1, total))
    least, known = max(2, total // RARE), max(4, total // KNOWN)
    bounded = ((F.col("what") == "end") & (F.col("n") >= known)) | ((F.col("what") == "value") & (F.col("n") >= least)) | (F.col("what") == "cut")
    for r in facts.where(bounded).collect():
        if r.what == "cut":
            model.cuts[tuple(json.loads(r.key))] = r.n
        else:
            (model.ends if r.what == "end" else model.hot)[r.key] = r.n
    # rare words are folded to one class before shapes are gathered, so only bounded tables reach the driver
    ends = list(model.ends)
    s = F.from_json("key", "array<string>")
    shapes = facts.where("what = 'shape'").select(
        F.when(s[1].isin(ends), s[1]).otherwise("?").alias("e"), s[0].alias("f"), s[2].alias("w"), s[3].alias("j"), s[4].alias("c"),
        s[5].alias("b"), "n"
    )
    kind = F.when(F.col("e") == "?", "?").otherwise("known")
    for r in shapes.groupBy(kind.alias("k"), "f").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * known).collect():
        model.starts[r.k, r.f] = r.n
        model.started[r.k] += r.n
    model.rare_ends = max(1, total - sum(model.ends.values()))
    for r in shapes.groupBy("e", "w", "j", "c").agg(F.sum("n").alias("n")).collect():
        size = int(r.w), r.j == "true", r.c == "true"
        model.sizes[r.e, *size] += r.n
        model.kind_sizes["?" if r.e == "?" else "known", *size] += r.n
    for r in shapes.select(F.explode(F.split("b", " ")).alias("b"), "n").where(F.col("b").isin(ends)).groupBy("b").agg(F.sum("n").alias("n")).collect():
        model.inner[r.b] = r.n
    return model


_FACTS = "what string, key string, n double"


def split_values(df: DataFrame, key: str, packed: str, rounds: int = ROUNDS, out: str = "value") -> DataFrame:
    """``key``, pos INT (from 1) and ``out``: one row per value packed in a field."""
    source = df.select(F.col(key).alias("k"), F.col(packed).alias("t")).where(F.length(F.trim("t")) > 0).distinct()
    if dict(df.dtypes)[key] != "string":
        source = source.withColumn("k", F.col("k").cast("string"))
    source = checkpointed(source)

    def summed(facts: DataFrame) -> DataFrame:
        return checkpointed(facts.groupBy("what", "key").agg(F.sum("n").alias("n")))

    facts = summed(source.select("t").mapInArrow(lambda it: _counted(it, _initial), _FACTS))
    wanted = checkpointed(_wanted(source))
    before = None
    for _ in range(rounds):
        model = _model_of(facts)
        expected = _with_counts(wanted, facts, model.total).mapInArrow(lambda it, model=model: _counted(it, lambda _, t, found: _expected(t, found, model)), _FACTS)
        facts = summed(expected)
        likelihood = facts.where("what = 'likelihood'").agg(F.sum("n")).first()[0] or 0.0
        if before is not None and likelihood - before < SETTLED * abs(before):
            break
        before = likelihood
    model = _model_of(facts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [list(_values(t, found, model)) for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(values, pa.list_(pa.string()))], names=["k", "values"])

    split = _with_counts(wanted, facts, model.total).mapInArrow(cut, "k string, `values` array<string>")
    result = split.select(F.col("k").cast(dict(df.dtypes)[key]).alias(key), F.posexplode("values").alias("pos", out))
    return result.select(key, (F.col("pos") + 1).cast("int").alias("pos"), out).distinct()


def _expected(text: str, found: list[dict], model: Model) -> Iterator[tuple[str, str, float]]:
    """Facts of a field by expectation under a model, and its log likelihood."""
    counts = {f["v"]: f["n"] for f in found}
    segments, hard = _certain(text)
    yield from _sure_composites(text)
    for segment, quoted, _ in segments:
        if quoted or not uncertain_cuts(segment):
            v = _whole(segment, quoted)
            if v and not uncertain_cuts(v):
                yield from _evidence({v: 1.0})
            continue
        total, values, fates = expectations(segment, hard, model, counts)
        yield "likelihood", "", total
        yield from _evidence(values)
        for *fate, weight in fates:
            yield "cut", json.dumps(fate), weight


def _values(text: str, found: list[dict], model: Model) -> Iterator[str]:
    """The values of a field."""
    counts = {f["v"]: f["n"] for f in found}
    segments, hard = _certain(text)
    for segment, quoted, _ in segments:
        if quoted or not uncertain_cuts(segment):
            if v := _whole(segment, quoted):
                yield v
        else:
            yield from best_path(segment, hard, model, counts)[0]


def _wanted(source: DataFrame) -> DataFrame:
    """k, h, t, v: each field once with its text, and once with each value that its lattices hold."""
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, hs, ts, vs = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wanted: set[str] = set()
                for segment, quoted in certain_cuts(t).segments:
                    if not quoted and uncertain_cuts(segment):
                        wanted.update(n for v in spans(segment)[1].values() if (n := normal(v)))
                # one row brings the field, the others only its digest
                ks += [k] * (len(wanted) + 1)
                hs += [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()] * (len(wanted) + 1)
                ts += [t] + [None] * len(wanted)
                vs += [None, *wanted]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ks, hs, ts, vs)], names=["k", "h", "t", "v"])

    return source.mapInArrow(candidates, "k string, h string, t string, v string")


def _with_counts(wanted: DataFrame, facts: DataFrame, total: float) -> DataFrame:
    """k, t, found of every field: the counts of the values that its lattices hold, but for those that the model knows from memory."""
    least = max(2, total // RARE)
    values = facts.where("what = 'value'").select(F.col("key").alias("v"), "n")
    counts = values.where((F.col("n") > 1) & (F.col("n") < least))
    # values known from memory would be hot keys, as would rows without a candidate: they aren't joined
    hot = values.where(F.col("n") >= least).select("v")
    cold = wanted.where("v IS NOT NULL").join(F.broadcast(hot), "v", "left_anti")
    known = cold.join(counts, "v").select("k", "h", "t", F.struct("v", "n").alias("found"))
    kept = wanted.where("v IS NULL").select("k", "h", "t", F.lit(None).cast("struct<v:string,n:double>").alias("found"))
    return known.unionByName(kept).groupBy("k", "h").agg(F.max("t").alias("t"), F.collect_list("found").alias("found")).select("k", "t", "found")
