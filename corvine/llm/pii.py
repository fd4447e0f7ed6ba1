"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are found by fixed patterns and always stay.  Beyond
them loose patterns propose candidates: assigned secrets, keys, long tokens, numbers in the
forms of phones and identity numbers.  Labelers of three sorts vote on every candidate:
regular expressions on its form, gazetteers of the words next to it, and its context and
character statistics.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is true; a logistic
classifier trained on those likelihoods then decides every candidate span.

Each text is read once.  What goes on from there is a row per document with its spans and
candidates; votes are counted over all of them (there are at most 3^labelers patterns), and
only the classifier is fitted on a bounded sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, map_rows, materialize

KINDS = ("email", "ip", "card", "phone", "secret", "number")

#: Base patterns. Fixed values.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: Loose patterns of candidates: kind, and an expression whose group 1 is the span. Fixed values.
#: Names and tokens have any length; possessive quantifiers keep the scan linear.
LOOSE = [
    ("secret", re.compile(r"\b\w{2,}+\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/.~-]{6,}+)")),
    ("secret", re.compile(r"\b([A-Z]{3}[A-Z0-9]{13,}+)\b")),
    ("secret", re.compile(r"\b(?=[0-9]*+[a-f])([0-9a-f]{16,}+)\b")),
    ("secret", re.compile(r"\b([a-z]{2,4}[_-][A-Za-z0-9]{16,}+)\b")),
    ("number", re.compile(r"(?<![\w+.-])(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])")),
    ("number", re.compile(r"(?<![\w+.-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])")),
    ("number", re.compile(r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    # plain dates, versions and numbered words: what the labelers say of them shows how often they are wrong
    ("secret", re.compile(r"(?<![\w.@/-])([0-9]++(?:[.,:/-][0-9]++)++|[A-Za-z]{2,}+[0-9]{1,4})(?![\w@])")),
]

#: Gazetteers: names of secrets, and words that announce personal numbers. Fixed values.
SECRET_NAMES = frozenset("token password passwd pwd secret key apikey api_key access_key secret_key auth authorization bearer credential credentials private".split())
NUMBER_NAMES = frozenset("phone tel telephone mobile cell call fax ssn iban account passport insurance id telefon telefono móvil téléphone konto".split())

#: Names of usual settings, whose values are no secrets. Fixed values.
SETTING_NAMES = frozenset("color colour width height size version date time name class style lang language type mode path file url port host rate count level title src href alt rel content charset order item page sku build release file filename dir directory folder".split())
#: Names of digests and identifiers that are public. Fixed values.
DIGEST_NAMES = frozenset("commit checksum etag sha sha1 sha224 sha256 sha384 sha512 md5 crc crc32 hash digest uuid guid rev revision fingerprint tree blob parent head tag object oid".split())
#: Forms of digests (hexadecimal digits of their usual numbers) and UUIDs, and of paths. Fixed values.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", re.IGNORECASE)
PATH = re.compile(r"[.~]{0,2}/.*|[\w.-]+/[\w.-]+/.*|.*/[\w-]+\.[a-z]{1,5}")
#: Values that say what they are: dates and times, dotted or plain numbers, lower-case words. Fixed values.
PLAIN = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?|[0-9]{1,2}:[0-9]{2}.*|v?[0-9]+(?:[._~/+-][0-9]+)*|[A-Za-z]+(?:[._~/+-][A-Za-z]+)*[0-9]?")

#: Forms (kind, votes, length) of the classifier's training sample, the most frequent ones.
SAMPLE = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _holds(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in text.split(".")))
    if kind == "email":
        return True
    digits = re.sub(r"[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the base pattern, in time linear in the text: from each @ to both sides."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        low = found.end() if found else at + 1
        if found:
            yield start, low
        at = text.find("@", low)


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        return _emails(text)
    # a match can't start within a run of digits: only at its first one
    return (m.span() for m in (_IP if kind == "ip" else BASE[kind]).finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, stop in code points), by start, then kind as listed."""
    out = [(kind, s, e) for kind in BASE for s, e in _matches(kind, text) if _holds(kind, text[s:e])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def _votes(kind: str, text: str, start: int, stop: int) -> str:
    """One character per labeler: ``+`` personal, ``-`` not, ``0`` no vote."""
    value, before, after = text[start:stop], text[max(0, start - 40) : start], text[stop : stop + 40]
    names = SECRET_NAMES if kind == "secret" else NUMBER_NAMES
    last = re.findall(r"\w+", before.lower())
    near = {*last, *re.findall(r"\w+", after.lower())}
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    say = lambda yes, no=False: "+" if yes else "-" if no else "0"
    public = plain = path = False
    if kind == "secret":
        public = DIGEST.fullmatch(value) is not None and not near & names
        plain, path = PLAIN.fullmatch(value), PATH.fullmatch(value)
        form = not public and re.fullmatch(r"[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{16,}|[a-z]{2,4}[_-][A-Za-z0-9]{16,}", value) is not None
        mixed = say(digits >= 3 and letters >= 3, digits == 0 or letters == 0)
    else:
        form = re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}.*", value) is not None
        mixed = say(False, len(set(value) - set(" .-()")) < 3)
    name = last[-1] if last else ""
    return "".join((
        say(form, not re.search(r"[0-9]", value)),  # regex: a usual form
        say(False, plain),  # regex: a date, number, version or word
        say(name in names, name in SETTING_NAMES or kind == "secret" and name in DIGEST_NAMES),  # gazetteer: the word before
        say(near & names, kind == "secret" and near & DIGEST_NAMES),  # gazetteer: a word near by
        say(False, public),  # regex: a digest or UUID that no secret's name is near to
        say(False, path),  # regex: a path
        say(re.search(r"[=:]\s*[\"']?$", before)),  # context: it is assigned
        say(False, before[-1:] in tuple("/@#.\\") or after[:1] in tuple("@/(")),  # context: part of an address, path or call
        say(entropy(value) >= 2.8, entropy(value) < 2.2),  # context: variety of characters
        mixed,  # context: digits among letters
        say(len(value) >= 16, len(value) < 8),  # context: length
    ))


#: Votes that each labeler is taken to have cast before the data: right ones, wrong ones.
PRIORS = np.array([(8, 2), (19, 1), (19, 1), (8, 2), (19, 1), (19, 1), (6, 4), (8, 2), (6, 4), (6, 4), (6, 4)], dtype=float)
LABELERS = len(PRIORS)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Candidate spans with their votes, none overlapping a base span or one another."""
    out: list[tuple[str, int, int, str]] = []
    if not re.search(r"[0-9=:]", text):
        return out
    taken = bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    for kind, pattern in LOOSE:
        for m in pattern.finditer(text):
            s, e = m.span(1)
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\1" * (e - s)
                out.append((kind, s, e, _votes(kind, text, s, e)))
    return sorted(out, key=lambda c: c[1])


def reliabilities(patterns: dict[str, float], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over counted vote patterns.

    Gives the share of true candidates, per labeler how often its votes are right on true
    and on false candidates, and how likely each pattern is true.  A labeler that doesn't
    vote says nothing.  It starts from ``PRIORS`` and even odds.
    """
    keys = sorted(patterns)
    right = np.repeat((PRIORS[:, 0] / PRIORS.sum(axis=1))[:, None], 2, axis=1)
    if not keys:
        return 0.0, right, {}
    n = np.array([patterns[k] for k in keys], dtype=float)
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in k] for k in keys])
    share, q = 0.5, None
    for _ in range(rounds):
        plus = np.log(right[:, 1] / (1 - right[:, 0]))
        minus = np.log((1 - right[:, 1]) / right[:, 0])
        odds = math.log(share / (1 - share)) + (votes == 1) @ plus + (votes == -1) @ minus
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if q is not None and np.abs(new - q).max() < 1e-9:
            break
        q = new
        share = float(((n * q).sum() + 1) / (n.sum() + 2))
        for j in range(LABELERS):
            for truth, weight in ((1, n * q), (0, n * (1 - q))):
                good = weight[votes[:, j] == 2 * truth - 1].sum()
                cast = weight[votes[:, j] != 0].sum()
                right[j, truth] = (good + PRIORS[j, 0]) / (cast + PRIORS[j].sum())
    return share, right, dict(zip(keys, map(float, q), strict=True))


def _features(kind: str, votes: str, size: int) -> list[float]:
    return [1.0, float(kind == "number"), math.log(size), *[float(v == "+") for v in votes], *[float(v == "-") for v in votes]]


def train(sample: dict[tuple[str, str, int], float], likely: dict[str, float], l2: float = 1e-2) -> list[float]:
    """A logistic span classifier on soft labels: counted (kind, votes, length) and the patterns' likelihoods."""
    if not sample:
        return []
    rows = sorted(sample)
    x = np.array([_features(*r) for r in rows])
    n = np.array([sample[r] for r in rows], dtype=float)
    y = np.array([likely.get(r[1], 0.5) for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + l2 * n.sum() * w / 100
        h = (x * (n * (p * (1 - p) + 1e-6))[:, None]).T @ x + l2 * n.sum() / 100 * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return list(map(float, w))


def find_personal_data(
    df: DataFrame,
    *,
    threshold: float = 0.5,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Spans of personal data in every whole text: ``(id, base, spans)``.

    Both are arrays of (kind, start, stop), in code points, stop exclusive, by start, then
    kind; ``spans`` holds the base spans and the candidates that the classifier accepts.
    ``keep_text`` adds ``redacted``: the text with every span replaced by its kind in angle
    brackets, overlapping spans by the first.  Null texts count as empty; every row gives one
    row, whatever its id, and repeated rows give repeated results; columns named in ``carry`` come along as ``in_*``.
    The vote counts cover all candidates; the classifier is fitted on the ``sample`` most frequent
    forms of them, each weighted by its count.
    """
    kind = df.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:int,stop:int>>"

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text, *rest in rows:
            text = text or ""
            base = base_spans(text)
            found = candidates(text, base)
            as_rows = lambda names, items: [dict(zip(names, x, strict=True)) for x in items]
            yield (key, as_rows(("kind", "start", "stop"), base), as_rows(("kind", "start", "stop", "votes"), found)) + ((text,) if keep_text else ()) + tuple(rest)

    schema = f"`{id_col}` {kind}, base {span}, found array<struct<kind:string,start:int,stop:int,votes:string>>" + ", body string" * keep_text + carried(df, carry)
    seen = materialize(map_rows(df.select(id_col, text_col, *[F.col(c).alias(f"in_{c}") for c in carry]), scan, schema), "personal")
    each = seen.select(F.explode("found").alias("c")).select("c.kind", "c.votes", (F.col("c.stop") - F.col("c.start")).alias("size"))
    counts = {r.votes: r.n for r in each.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    likely = reliabilities(counts)[2]
    picked = each.groupBy("kind", "votes", "size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "votes", "size").limit(sample).collect()
    weights = train({(r.kind, r.votes, r.size): r.n for r in picked}, likely)
    shared = df.sparkSession.sparkContext.broadcast(np.array(weights))

    def decide(rows: Iterator[tuple]) -> Iterator[tuple]:
        w = shared.value
        for key, base, found, *rest in rows:
            kept = [c for c in found if np.dot(w, _features(c["kind"], c["votes"], c["stop"] - c["start"])) > math.log(threshold / (1 - threshold))]
            spans = sorted([*base, *({k: c[k] for k in ("kind", "start", "stop")} for c in kept)], key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield (key, base, spans) + ((redact(rest[0], spans), *rest[1:]) if keep_text else tuple(rest))

    return map_rows(seen, decide, f"`{id_col}` {kind}, base {span}, spans {span}" + ", redacted string" * keep_text + carried(df, carry))


def redact(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
            at = s["stop"]
        else:
            at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def joined(spans: str):
    """kind:start:stop of an array of spans, comma-joined, as a column."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
