"""Secrets in texts: known shapes, and strings that a randomness test battery takes for keys.

Known shapes are found by regular expressions. Other long strings of a key-like alphabet are
tested for randomness under the encoding that their characters suggest: chi-squared
uniformity of the alphabet, Wald-Wolfowitz runs, and lag-1 serial correlation. A string that
all three leave standing is held against the hypothesis that it is ordinary: a chain of words,
identifier parts and numbers. The likelihood of that, over the one of a random string, bounds
the chance of such a ratio in ordinary text and is its p-value; one that a test refuses has a p-value of 1. These are combined over the whole
table by Benjamini-Hochberg steps within classes of length, as short strings carry little evidence; every string that was tried counts as a hypothesis.

Nulls and empty texts have no spans. Each row is judged for itself, so repeated rows and
equal texts get equal spans; of ties the longer string stays, then the first. Extra columns are dropped; an empty table gives no rows.
Very long texts are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import bisect
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .scratch import bound_batches, free_names, id_text, settle

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Encodings from the narrowest alphabet on; a string has the first that holds all its characters.
ENCODINGS = (
    ("decimal", string.digits),
    ("hex", string.digits + "abcdef"),
    ("HEX", string.digits + "ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase),
    ("BASE36", string.digits + string.ascii_uppercase),
    ("base62", string.digits + string.ascii_letters),
    ("base64", string.digits + string.ascii_letters + "+/"),
    ("base64url", string.digits + string.ascii_letters + "-_"),
)
PIECE = re.compile(r"[A-Za-z0-9+/_-]+=*")
#: Runs of each alphabet.
RUNS = [re.compile(f"[{re.escape(a)}]+") for _, a in ENCODINGS]
#: Each test alone must not refuse randomness at this level.
LEVEL = 0.005
#: Share of false strings among the spans that the battery adds.
FALSE_SHARE = 0.01
#: Words and parts of names, for the letters that follow each other in ordinary strings.
ORDINARY = (
    "the of and to in is that for it was on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would "
    "other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write "
    "der die und den von mit das des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde gegen schon wenn "
    "le la les et des en un du une que est pour qui dans par plus sur au ne se pas avec son ce il sont cette ont aux mais ou comme leur tout fait elle deux aussi "
    "el los las del por con una para al lo como su esta entre cuando todo ser desde nos sin sobre también hasta hay donde han quien estado tiempo "
    "user name file path data value index count list item table column query server client config option default public private static class method function return string number length size type object request response "
    "handler manager service factory context session token access secret key password account address message event time date start end first last next current content document page link image style button title text label "
    "version update create delete insert select count group order test build release download upload image resource library package module system process thread memory buffer stream reader writer source target parent child"
)
#: Chances that a letter, digit or other sign, or the start, is followed by a letter, digit or other sign, in ordinary strings.
FOLLOW = ((0.90, 0.04, 0.06), (0.15, 0.65, 0.20), (0.75, 0.15, 0.10), (0.70, 0.20, 0.10))
#: Of digits after a digit: the same, or one of the two next to it. Chance of a capital at a part's start, after a small letter and after a capital.
SAME_DIGIT, NEAR_DIGIT, CAPITAL = 0.3, 0.3, (0.4, 0.06, 0.55)
#: Lower bounds of the length classes; steps of -log10 p in the tables of each class.
CLASSES, STEP, STEPS = (20, 32, 64, 128), 0.1, 400

#: Types of the columns of base spans and of suspects.
FOUND = ("array<struct<kind:int,start:int,end:int>>", "array<struct<start:int,end:int,class:int,step:int>>")


def known(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of known shapes, by start and then kind; kinds are numbered as in KINDS."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def encoding(s: str) -> str | None:
    """The alphabet of a string without its '=' ending; none for plain words, which have one case and no digits."""
    body = s.rstrip("=")
    if not body or body.isalpha() and (body.islower() or body.isupper() or body.istitle()):
        return None
    return next((alphabet for _, alphabet in ENCODINGS if not body.strip(alphabet) and set(body) <= set(alphabet)), None)


def _chi2_tail(x: float, df: int) -> float:
    """P(chi-squared >= x), by the Wilson-Hilferty cube root."""
    return 0.5 * math.erfc((((x / df) ** (1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))


def _chain() -> tuple[np.ndarray, np.ndarray]:
    """Logs of ordinary strings' steps from one small-letter character code to the next (row 0: the start), and of their letters' cases."""
    letters, digits, signs = ([ord(c) for c in x] for x in (string.ascii_lowercase, string.digits, "+/_-="))
    pairs, single = np.zeros((26, 26)), np.ones(26)
    for word in ORDINARY.split():
        at = [ord(c) - 97 for c in word if c in string.ascii_lowercase]
        np.add.at(single, at, 1)
        np.add.at(pairs, (at[:-1], at[1:]), 1)
    single = 0.8 * single / single.sum() + 0.2 / 26
    pairs = (pairs + 12 * single) / (pairs.sum(axis=1, keepdims=True) + 12)
    i = np.arange(10)
    near = np.minimum((i[:, None] - i) % 10, (i - i[:, None]) % 10)
    numbers = np.where(near == 0, SAME_DIGIT, np.where(near == 1, NEAR_DIGIT / 2, (1 - SAME_DIGIT - NEAR_DIGIT) / 7))
    steps = np.zeros((128, 128))
    for kind, rows in enumerate((letters, digits, signs, [0])):
        for to, columns, inside in ((0, letters, pairs if kind == 0 else single), (1, digits, numbers if kind == 1 else 0.1), (2, signs, 1 / len(signs))):
            steps[np.ix_(rows, columns)] = FOLLOW[kind][to] * inside
    small, large = [ord(c) for c in string.ascii_lowercase], [ord(c) for c in string.ascii_uppercase]
    cases = np.ones((128, 128))
    for rows, capital in zip((range(128), small, large), CAPITAL, strict=True):
        cases[np.ix_(rows, large)], cases[np.ix_(rows, small)] = capital, 1 - capital
    return np.log(np.maximum(steps, 1e-12)), np.log(cases)


_STEPS, _CASES = _chain()


def ordinary(s: str, k: int) -> float:
    """A bound of the chance that an ordinary string is so much likelier as one of random characters, of ``k``.

    A ratio of likelihoods exceeds t with a chance of at most 1 / t; the alphabet is the string's own, one of len(ENCODINGS).
    A string in one case may be of a kind that always is.
    """
    x = np.frombuffer(b"\0" + s.encode("ascii"), np.uint8)
    low = np.frombuffer(b"\0" + s.lower().encode("ascii"), np.uint8)
    mixed = float(_CASES[x[:-1], x[1:]].sum())
    if not (any(c.islower() for c in s) and any(c.isupper() for c in s)):
        mixed = max(mixed, math.log(0.5))
    log = float(_STEPS[low[:-1], low[1:]].sum()) + mixed + math.log(0.5) + len(s) * math.log(k) + math.log(len(ENCODINGS))
    return math.exp(min(log, 0.0)) if log > -690 else 1e-300


def battery(s: str, alphabet: str) -> tuple[float, float, float, float]:
    """p-values of the three tests under randomness, and the one under ordinary text."""
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in s.rstrip("=")])
    n, k = len(x), len(alphabet)
    chi2 = float(((np.bincount(x, minlength=k) - n / k) ** 2).sum() * k / n)
    uniform = _chi2_tail(chi2, k - 1)
    high = x >= (k + 1) // 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * a * b / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs_p = math.erfc(abs(runs - mean) / spread / math.sqrt(2))
    else:
        runs_p = 0.0
    c = x - x.mean()
    power = float((c * c).sum())
    serial = float((c[1:] * c[:-1]).sum()) / power if power else 1.0
    serial_p = math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return uniform, runs_p, serial_p, ordinary(s.rstrip("="), k)


def pieces(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of key-like characters beside ``base``, cut after each '=' that more characters follow."""
    i = done = 0  # spans before the i-th end before the candidate, as none of them reaches beyond ``done``
    for m in CANDIDATE.finditer(text):
        at = max(m.start(), min(done, m.end()))
        while i < len(base) and base[i][1] < m.end():
            _, a, b = base[i]
            yield from (p.span() for p in PIECE.finditer(text, at, max(at, a)) if p.end() - p.start() >= CLASSES[0])
            done = max(done, b)
            at, i = max(at, min(b, m.end())), i + 1
        yield from (p.span() for p in PIECE.finditer(text, at, m.end()) if p.end() - p.start() >= CLASSES[0])


def runs(piece: str) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of each alphabet in a piece that are long enough; one that reaches its end has the '=' there, too."""
    body = len(piece.rstrip("="))
    found = {m.span() for r in RUNS for m in r.finditer(piece, 0, body)}
    padded = ((a, len(piece) if b == body else b) for a, b in found)
    return sorted((a, b) for a, b in padded if b - a >= CLASSES[0])


def suspects(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, class, step) of strings outside ``base`` that the battery was tried on.

    Of runs that overlap, the one that ordinary text is least likely to have stays, then the longer one;
    a p-value is multiplied by the number of runs that were tried in its piece. A piece of which no run passes
    is one hypothesis that has failed, of its longest run and with step 0.
    """
    out = []
    for start, end in pieces(text, base):
        tried, passed, longest = runs(text[start:end]), [], (0, 0, 0)
        for a, b in tried:
            s = text[start + a : start + b]
            alphabet = encoding(s)
            if alphabet is None:
                continue
            longest = max(longest, (b - a, -a, b))
            *tests, odd = battery(s, alphabet)
            if min(tests) >= LEVEL:
                passed.append((min(odd * len(tried), 1.0), a - b, a, b))
        taken: list[tuple[int, int]] = []
        if longest[0] and not passed:
            passed = [(1.0, -longest[0], -longest[1], longest[2])]
        for odd, _, a, b in sorted(passed):
            i = bisect.bisect(taken, (a, b))
            if (not i or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                taken.insert(i, (a, b))
                kind = sum(b - a >= c for c in CLASSES) - 1
                out.append((start + a, start + b, kind, min(int(-math.log10(max(odd, 1e-300)) / STEP), STEPS)))
    return sorted(out)


def _scan(at: int, kept: list[int], names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    odd = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("step", pa.int32())]))
    for batch in batches:
        bases, odds = [], []
        for text in batch.column(at):
            text = text.as_py() or ""
            base = known(text)
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            odds.append([{"start": a, "end": b, "class": c, "step": s} for a, b, c, s in suspects(text, base)])
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(bases, span), pa.array(odds, odd)], names=names)


def thresholds(counts: list[tuple[int, int, int]]) -> list[int]:
    """For each class the least step that Benjamini-Hochberg lets through.

    ``counts`` has (class, step, strings); a string's p-value is taken at its step's lower edge.
    """
    least = []
    for c in range(len(CLASSES)):
        mine = sorted(((s, n) for k, s, n in counts if k == c), reverse=True)
        total, seen, cut = sum(n for _, n in mine), 0, STEPS + 1
        for step, n in mine:
            seen += n
            if 10 ** (-step * STEP) <= FALSE_SHARE * seen / total:
                cut = step
        least.append(cut)
    return least


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and its base spans and all spans in two more at the end.

    The first pass writes each row with its spans and the steps of its suspects; only a table of
    classes by steps, at most 4 x 401 numbers, is brought together for the second. No rows are matched.
    """
    base, odd, spans = free_names(docs, "_base", "_odd", "_spans")
    at, kept, names = docs.columns.index("text"), [docs.columns.index(c) for c in keep], [*keep, base, odd]
    schema = StructType([*(docs.schema[i] for i in kept), *map(StructField, (base, odd), map(_parse_datatype_string, FOUND))])
    held = settle(docs.mapInArrow(lambda it: _scan(at, kept, names, it), schema), "spans")
    counted = held.select(F.explode(odd).alias("o")).groupBy("o.class", "o.step").agg(F.count("*").alias("n")).collect()
    least = F.array(*map(F.lit, thresholds([(r["class"], r["step"], r["n"]) for r in counted])))
    real = F.filter(odd, lambda o: o["step"] >= F.element_at(least, o["class"] + 1))
    more = F.transform(real, lambda o: F.struct(F.lit(3).alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    ordered = F.array_sort(F.concat(base, more), lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), a["kind"] - b["kind"]))
    return held.select(*keep, base, ordered.alias(spans))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans); spans are structs (kind, start, end) in code points."""
    found = scan(id_text(docs), ["doc_id"])
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def joined(spans: str):
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if spans:
                out, last = [], 0
                for s in spans:
                    if s["end"] > last:
                        out += [text[last : max(last, s["start"])], "[SECRET]"]
                        last = s["end"]
                text = "".join(out) + text[last:]
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by ``[SECRET]``; every row stays, other columns stay as they are.

    A row's spans go with it, so null, repeated and equal ids are all right.
    """
    bound_batches(docs.sparkSession)
    found = scan(docs, docs.columns)
    return found.drop(found.columns[-2]).mapInArrow(_masked, docs.schema)
