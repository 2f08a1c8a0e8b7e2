"""Personal data with a skip-chain conditional random field.

Patterns give the base spans (e-mail, IP address, card, phone). A random field labels the tokens that
hold a digit or an `@`, and those that hold or repeat what the secret pattern matches; all other
tokens are observed as ordinary words. Neighbouring tokens share chain potentials. Tokens that are
equal, or have the same long digits, share skip potentials over any distance: each is linked with
the evidence among them, or with the first of them where there is none, so that the last repeat
hears of it as the first does. Loopy message passing, until the messages settle or for a stated
number of rounds, makes the labels of a document consistent, with the base spans as evidence, so that
a number written out once as a phone number is found again where it stands without its prefix. The
field adds spans and a further kind, `secret`; base spans stay.

The weights are trained by pseudo-likelihood on a bounded sample of the documents, with the patterns
as labels. All texts are read whole; patterns are written so that none of them is quadratic.

Defined cases: a null or empty text has no spans; a null id is kept; repeated rows have equal spans;
without a usable sample the field adds nothing; an empty table gives an empty result; other columns
pass or are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import table, with_python

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("", *KINDS)  # "" is an ordinary token


@dataclass(frozen=True)
class Options:
    """`sample` texts of at most `sample_tokens` tokens each train the field: among the `drawn` texts
    with the smallest hashes, those with something to label. Messages are passed for `rounds` rounds
    at least and until they settle, or for `most_rounds`; `sure` is the belief from which a span is
    added."""

    drawn: int = 30_000
    sample: int = 1500
    sample_tokens: int = 200
    steps: int = 300
    rounds: int = 12
    most_rounds: int = 2000
    sure: float = 0.8


DEFAULT = Options()

# The base patterns. Possessive, and an IP address starts at a whole number, which
# changes no match and keeps long digit runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(
    r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)"
    r"([A-Za-z0-9+/_-]{12,})|\b(AKIA[0-9A-Z]{16})\b"
)
CUES = ("password", "passwd", "secret", "token", "key", "phone", "tel", "call", "mail", "card", "ip")

SALIENT = re.compile(r"[0-9@]")
SOLID = re.compile(r"\S*")
WORD = re.compile(r"\S+")
EDGE = "\"'()[]{}<>,.;:!?"

# Messages have settled when none changes by more. Each `SLOWER` rounds they are damped more, so that
# those that swing settle as well.
SETTLED, SLOWER = 1e-7, 200


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    floor = 0  # nothing before it can belong to a later address
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            last = domain.end()
        floor = max(at + 1, last)
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind and place, ends exclusive."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# Tokens, their features and their links


@dataclass
class Graph:
    """The tokens of a document that may be personal data: places, features, links."""

    spans: np.ndarray  # (n, 2)
    features: np.ndarray  # (n, d) of 0 and 1
    chain: np.ndarray  # (e, 2)
    alike: list[list[int]]  # tokens with a key in common, in order

    @property
    def skip(self) -> np.ndarray:
        return self.skip_links(np.full(len(self.spans), -1))

    def skip_links(self, fixed: np.ndarray) -> np.ndarray:
        """Stars over the tokens alike. Their centres are the first token of each label among the
        evidence (`fixed`, -1 where there is none), or the first token. What the chain joins is not
        joined again, but with evidence."""
        joined = {tuple(x) for x in self.chain.tolist()}
        out = set()
        for group in self.alike:
            centres: dict[int, int] = {}
            for k in group:
                if fixed[k] >= 0:
                    centres.setdefault(int(fixed[k]), k)
            for centre in centres.values():
                out |= {(min(centre, k), max(centre, k)) for k in group if fixed[k] < 0}
            if not centres:
                out |= {(group[0], k) for k in group[1:]} - joined
        return links(out)


def links(pairs) -> np.ndarray:
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


def tokens(text: str, limit: int | None = None) -> list[tuple[int, int]]:
    """The blank-separated tokens that hold a digit or an @, and those that hold or repeat a secret."""
    plain = [x[1:] for x in secret_spans(text) if not SALIENT.search(text, *x[1:])]
    if plain:
        return tokens_with(text, plain, limit)
    found, end = [], 0
    hit = SALIENT.search(text)
    while hit and (limit is None or len(found) < limit):
        start = hit.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = SOLID.match(text, hit.start()).end()
        found.append((start, end))
        hit = SALIENT.search(text, end)
    return found


def tokens_with(
    text: str, plain: list[tuple[int, int]], limit: int | None
) -> list[tuple[int, int]]:
    """The tokens of a text with secrets that hold neither a digit nor an @."""
    values = {text[a:b].lower() for a, b in plain}
    found, at = [], 0
    for m in WORD.finditer(text):
        if limit is not None and len(found) >= limit:
            break
        holds = False
        while at < len(plain) and plain[at][0] < m.end():
            at, holds = at + 1, True
        if holds or SALIENT.search(m[0]) or m[0].strip(EDGE).lower() in values:
            found.append(m.span())
    return found


def stripped(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without quotes, brackets and punctuation around it."""
    token = text[start:end]
    left = len(token) - len(token.lstrip(EDGE))
    return (start + left, max(start + left, start + len(token.rstrip(EDGE))))


def features_of(token: str, raw: str, before: list[str]) -> list[bool]:
    """What a token looks like, and the two words before it."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    dots, size = token.count("."), len(token)
    hint = [w.strip(EDGE + "=").lower() for w in before]
    value = token.rpartition("=")[2]
    code = value.isalnum() and len(value) >= 12
    return [
        True, "@" in token, "@" in token and "." in token.partition("@")[2],
        digits == 1, 2 <= digits <= 3, 4 <= digits <= 7, 8 <= digits <= 12, 13 <= digits <= 15,
        16 <= digits <= 19, digits > 19,
        dots == 1, dots == 2, dots == 3, dots > 3, raw.startswith("+"), "(" in raw, "-" in token,
        letters == 0, letters == 0 and digits == size, letters > 0 and digits > 0,
        code, code and value.isupper(), code and digits >= 3 and letters >= 3,
        size <= 4, 5 <= size <= 8, 9 <= size <= 15, 16 <= size <= 24, size > 24,
        "=" in token, any(w in CUES for w in hint), bool(before) and before[-1].endswith(("=", ":")),
        any(w in token.partition("=")[0].lower() for w in CUES[:5]) and "=" in token,
        raw[:1] in "\"'" if raw else False, 16 <= digits <= 19 and letters == 0
        and luhn("".join(c for c in token if "0" <= c <= "9")),
        bool(before) and before[-1].startswith("+"),
    ]


N_FEATURES = len(features_of("1", "1", []))


def graph_of(text: str, limit: int | None = None) -> Graph:
    raw = tokens(text, limit)
    spans, features, chain = [], [], []
    seen: dict = {}
    for k, (start, end) in enumerate(raw):
        a, b = stripped(text, start, end)
        token = text[a:b]
        spans.append((a, b))
        features.append(features_of(token, text[start:end], text[max(0, start - 40):start].split()[-2:]))
        if k and not text[raw[k - 1][1]:start].strip() and start - raw[k - 1][1] <= 3:
            chain.append((k - 1, k))
        number = "".join(c for c in token if "0" <= c <= "9")
        keys = {("same", token.lower())} | ({("digits", number[-7:])} if len(number) >= 7 else set())
        for key in keys:
            seen.setdefault(key, []).append(k)
    return Graph(
        np.array(spans, np.int64).reshape(-1, 2),
        np.array(features, np.uint8).reshape(-1, N_FEATURES), links(set(chain)),
        [group for group in seen.values() if len(group) > 1],
    )


def labels_of(graph: Graph, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """The label of each token from the spans that overlap it; the first kind wins."""
    out = np.zeros(len(graph.spans), np.int64)
    for kind, start, end in reversed(spans):
        first = np.searchsorted(graph.spans[:, 1], start, "right")
        last = np.searchsorted(graph.spans[:, 0], end, "left")
        out[first:last] = LABELS.index(kind)
    return out


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    return [("secret", *m.span(m.lastindex)) for m in SECRET.finditer(text)]


# The field


@dataclass
class Field:
    node: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels
    skip: np.ndarray


def trained(
    features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int
) -> Field:
    """Pseudo-likelihood: each label given the features and the labels of its neighbours."""
    n, size = len(labels), len(LABELS)
    truth = np.eye(size)[labels]

    def seen(links):
        out = np.zeros((n, size))
        for a, b in (links.T, links.T[::-1]):
            np.add.at(out, a, truth[b])
        return out

    x = np.hstack([features.astype(np.float64), seen(chain), seen(skip)])
    weights = np.zeros((x.shape[1], size))
    speed, mean, square = 0.1, np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        score = x @ weights
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (p - truth) / n + 1e-4 * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        weights -= speed * (mean / (1 - 0.9**step)) / (
            np.sqrt(square / (1 - 0.999**step)) + 1e-8
        )
    d = features.shape[1]
    both = lambda m: (m + m.T) / 2
    return Field(weights[:d], both(weights[d:d + size]), both(weights[d + size:]))


def beliefs(
    field: Field, graph: Graph, fixed: np.ndarray, rounds: int,
    most_rounds: int = DEFAULT.most_rounds,
) -> np.ndarray:
    """Label probabilities of each token after loopy message passing, for `rounds` rounds at least
    and until the messages settle, or for `most_rounds`. `fixed` holds the labels that are evidence,
    -1 where there is none."""
    n, size = len(graph.spans), len(LABELS)
    own = graph.features @ field.node
    known = fixed >= 0
    own[known] = -50.0
    own[known, fixed[known]] = 0.0
    skip = graph.skip_links(fixed)
    ways = np.vstack([graph.chain, skip, graph.chain[:, ::-1], skip[:, ::-1]])
    kinds = [field.chain] * len(graph.chain) + [field.skip] * len(skip)
    if len(ways):
        power = np.exp(np.array(kinds * 2))
        source, target = ways.T
        half = len(ways) // 2
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((len(ways), size))
        share = 0.5
        for turn in range(1, max(rounds, most_rounds) + 1):
            total = own.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("es,est->et", out, power) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = (1 - share) * message + share * new
            if change <= SETTLED and turn >= rounds:
                break
            if turn % SLOWER == 0:
                share /= 2
        np.add.at(own, target, message)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(
    text: str, base: list[tuple[str, int, int]], field: Field | None, options: Options = DEFAULT
) -> list[tuple[str, int, int]]:
    """The spans that the field finds beside the base spans."""
    if field is None:
        return []
    graph = graph_of(text)
    if not len(graph.spans):
        return []
    fixed = labels_of(graph, base)
    fixed[fixed == 0] = -1
    belief = beliefs(field, graph, fixed, options.rounds, options.most_rounds)
    label = np.where(belief.max(axis=1) >= options.sure, belief.argmax(axis=1), 0)
    joined = {tuple(x) for x in graph.chain.tolist()}
    out: list[tuple[str, int, int]] = []
    last = -2
    for k in np.flatnonzero((label > 0) & (fixed < 0)).tolist():
        start, end = graph.spans[k].tolist()
        kind = LABELS[label[k]]
        if kind == "secret":
            start += text[start:end].rfind("=") + 1
        if out and last == k - 1 and (last, k) in joined and out[-1][0] == kind != "secret":
            out[-1] = (kind, out[-1][1], end)
        elif end > start:
            out.append((kind, start, end))
        last = k
    return [x for x in out if not any(x[1] < e and s < x[2] for _, s, e in base)]


# Spark


def train(docs: DataFrame, options: Options = DEFAULT) -> Field | None:
    """The field, from a sample of the texts: of the `drawn` texts with the smallest hashes, copies
    counting once, the first `sample` with a digit, an at sign or a secret. The driver gets the
    features of at most `sample * sample_tokens` tokens."""
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull())
    chosen = hashed.select("h").distinct().orderBy("h").limit(options.drawn)
    # The patterns are tried behind the aggregate, on the drawn texts only: Spark would push them below
    # the join and try them on all texts.
    usable = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(
        F.min("text").alias("text")
    ).where(F.col("text").rlike("[0-9@]") | F.col("text").rlike(SECRET.pattern)).orderBy("h").limit(
        options.sample
    )

    def graphs(parts):
        for part in parts:
            rows = []
            for text in part.column(0).to_pylist():
                graph = graph_of(text, options.sample_tokens)
                base = base_spans(text)
                labels = labels_of(graph, base + secret_spans(text))
                fixed = labels_of(graph, base)
                skip = graph.skip_links(np.where(fixed == 0, -1, fixed))
                rows.append((
                    graph.features.tobytes(), labels.tolist(), graph.chain.ravel().tolist(),
                    skip.ravel().tolist(),
                ))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.binary()), *[pa.array(c, pa.list_(pa.int64()))
                                                     for c in columns[1:]],
            ], ["features", "labels", "chain", "skip"])

    rows = usable.select("text").mapInArrow(
        graphs, "features binary, labels array<long>, chain array<long>, skip array<long>"
    ).collect()
    rows.sort(key=lambda r: (bytes(r.features), r.chain, r.skip))
    features, labels, links, offset = [], [], ([], []), 0
    for r in rows:
        features.append(np.frombuffer(bytes(r.features), np.uint8).reshape(-1, N_FEATURES))
        labels += r.labels
        for out, own in zip(links, (r.chain, r.skip)):
            out.append(np.array(own, np.int64).reshape(-1, 2) + offset)
        offset += len(r.labels)
    if len(set(labels)) < 2:
        return None
    return trained(
        np.vstack(features), np.array(labels), *map(np.vstack, links), options.steps
    )


def with_spans(
    docs: DataFrame, field: Field | None, text: str = "text", into: str = "pii",
    options: Options = DEFAULT,
) -> DataFrame:
    """`docs` with the struct column `into`, which has `spans`: `kind, start, stop, added`, by kind
    and place; code points, ends exclusive."""
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("added", pa.bool_()),
    ]))

    def compute(texts):
        out = []
        for t in texts:
            base = base_spans(t or "")
            more = added_spans(t or "", base, field, options)
            spans = [(*x, False) for x in base] + [(*x, True) for x in more]
            spans.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
            out.append([
                {"kind": k, "start": a, "stop": b, "added": e} for k, a, b, e in spans
            ])
        return [pa.array(out, kind)]

    return with_python(
        docs, text, into,
        "spans array<struct<kind: string, start: int, stop: int, added: boolean>>", compute,
    )


def redacted(docs: DataFrame, spans: Column, text: str = "text") -> Column:
    """The text with every span replaced by its kind in brackets. Spans that overlap are replaced
    as one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["kind"])))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
        acc["done"].alias("done"), F.greatest(acc["at"], s["stop"]).alias("at")
    )).otherwise(F.struct(
        F.concat(
            acc["done"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        ).alias("done"), s["stop"].alias("at"),
    ))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.aggregate(
        ordered, start, step,
        lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    ))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    ), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op9_skip_chain_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = F.col("pii.spans")
    base = F.filter(spans, lambda s: ~s["added"])
    return with_spans(docs, train(docs)).select(
        "doc_id",
        *[count_of(base, kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


QUERIES = {"op9_skip_chain_pii": op9_skip_chain_pii}
