"""Personal data and secrets by weak supervision.

Candidates are found by the base patterns (which are always reported) and by broader ones: obfuscated
or non-ASCII mail addresses, IPv6 addresses, numbers grouped like telephone numbers without a country code, numbers of
a card's length whose check digit fails or whose separators are unusual, and secrets (values given to names such as
`token`, long mixed strings; a fifth kind, listed after the four). Labelers vote on every candidate, yes (1), no
(-1) or nothing (0): three regular expressions for its shape, its place (whether it stands alone), a structural
check (check digit, octets, number of digits, entropy), a gazetteer (top-level domains, calling codes, card issuers,
formats of known keys), words of context before the span, and words that speak against it.
Expectation-maximisation over the counts of vote patterns estimates, for each kind, how often each labeler says
what for personal and for other spans, and so the probability of each pattern. The final classifier, a
logistic regression on the features of the span and its surroundings, is trained on those probabilities;
candidates it gives at least `LEAST` are added, if they don't overlap a span of the base or one added before.

Scale. One map-side pass over the texts finds the candidates and their votes and features; it writes a
few bytes for each document, from which the model is fitted and the spans are chosen. What is gathered for training are counts
by (kind, votes) and by (kind, features): both are discrete, so that the tables have a fixed greatest size, whatever the input.
Every scan is linear in the text: patterns start at the first character of a run only, and a mail address is looked for outward from its sign, by the lengths that addresses may have.

Results for odd input: a null or empty text has no spans; a null doc_id and repeated rows are reported
like any other; an empty table gives an empty one; other columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import doc_texts, kept_table

#: The kinds of the base, and the one that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
EMAIL_AT, IP_AT, CARD_AT, PHONE_AT, SECRET_AT = range(len(KINDS))
LEAST = 0.9

# Fixed patterns of the base: email as a whole, the others as the runs that they are cut from.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Broader patterns. The lengths are those that the standards of mail addresses allow.
MAIL_SIGN = re.compile(r"@|\s?[\[({]\s?at\s?[\])}]\s?", re.I)
_NAME = r"[^\s@<>()\[\]{}\"',;:|=]"
MAIL_LOCAL = re.compile(_NAME + "{1,64}$")
MAIL_NAME = re.compile(_NAME)
MAIL_DOMAIN = re.compile(rf"{_NAME[:-1]}.]{{1,63}}+(?:(?:\.|\s?[\[({{]\s?dot\s?[\])}}]\s?){_NAME[:-1]}.]{{1,63}}+){{1,12}}", re.I)
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
CARD = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20./_-][0-9]{4}){2,3}(?:[\x20./_-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)|0[0-9]{2,4}|[0-9]{3})[ ./-][0-9]{3,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")
GIVEN = re.compile(r"(?:token|secret|password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|bearer|auth)[\"']?(?:\s{0,3}[=:]\s{0,3}|\s)[\"']?([^\s\"'&,;<>]{8,256}+)", re.I)
MIXED = re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{20,}+")
#: Cheap tests that a text must pass before anything else is tried.
WORTH = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.I)

# Word lists of the labelers: common top-level domains (any of two letters counts as a country's), calling codes by
# zone, prefixes of card numbers, openings of known keys, words for and against by language.
DOMAINS = frozenset("com org net edu gov int mil info biz name pro mobi coop aero museum jobs travel dev app cloud online site shop blog tech store xyz club live news example test local".split())
CODES = re.compile(r"\+(?:1|7|2(?:0|7|[1-69][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9]))")
ISSUERS = re.compile(r"4|5[0-8]|2[2-7]|3[04-9]|6[0-9]")
KEYS = re.compile(r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|pk_live_|rk_live_|eyJ|ya29|SG\.|hf_|npm_|pypi-")
FOR = {
    "email": frozenset("email e-mail mail contact write address reach reply from to courriel mél correo escribir kontakt schreiben adresse dirección".split()),
    "ip": frozenset("ip ipv4 ipv6 host hostname server address addr client peer login logged from adresse serveur servidor rechner".split()),
    "card": frozenset("card visa mastercard maestro amex discover credit debit payment pan iban account karte kreditkarte konto carte compte tarjeta cuenta crédito".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact whatsapp sms telefon handy rufnummer téléphone portable appelez teléfono móvil llame".split()),
    "secret": frozenset("token secret password passwd pwd passphrase key apikey api_key api-key access_key private_key bearer auth authorization credential credentials passwort kennwort motdepasse contraseña clave".split()),
}
AGAINST = frozenset("version ver release build isbn issn doi order invoice ref reference sha sha1 sha256 md5 crc checksum digest commit etag uuid page section chapter figure total sum timestamp epoch".split())
LABELERS = ("pattern", "shape", "place", "variety", "structure", "gazetteer", "context", "against")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(parts: list[str]) -> bool:
    """Whether every part is at most 255; zeros in front don't matter, however many."""
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in parts)


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL from left to right; looks only at runs that an @ ends."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m.span()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers of a dotted run, from its left, that are octets."""
    for m in IP_RUN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            if octets(parts[k : k + 4]):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """(index of kind, start, end), in order; a match that fails its check is dropped and not tried shorter."""
    out = [(EMAIL_AT, a, z) for a, z in _emails(text)]
    out += [(IP_AT, a, z) for a, z in _ips(text)]
    out += [(CARD_AT, *m.span()) for m in CARD_RUN.finditer(text) if is_card(digits_of(m[0]))]
    return out + [(PHONE_AT, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


def _broad_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses outward from their sign; a name or label that is longer than allowed makes none."""
    for m in MAIL_SIGN.finditer(text):
        a, z = m.span()
        local = MAIL_LOCAL.search(text[max(0, a - 64) : a])
        if not local:
            continue
        start = a - len(local[0])
        if len(local[0]) == 64 and start and MAIL_NAME.match(text, start - 1):
            continue
        if domain := MAIL_DOMAIN.match(text, z):
            yield start, domain.end()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in GIVEN.finditer(text):
        if _DIGIT.search(m[1]):
            yield m.span(1)
    for m in MIXED.finditer(text):
        if len(digits_of(m[0])) >= 4 and sum(c.isalpha() for c in m[0]) >= 2:
            yield m.span()


_DIGIT = re.compile("[0-9]")


def broad_spans(text: str, taken: list[Span]) -> list[Span]:
    """Candidates of the broader patterns that overlap nothing taken, nor each other; in the order of the search."""
    digit = _DIGIT.search(text) is not None
    search = [
        (EMAIL_AT, _broad_emails(text)),
        (IP_AT, (m.span() for m in IP6.finditer(text)) if text.count(":") > 1 else ()),
        (SECRET_AT, _secrets(text) if digit else ()),
        (CARD_AT, (m.span() for m in CARD.finditer(text)) if digit else ()),
        (PHONE_AT, (m.span() for m in LOCAL_PHONE.finditer(text)) if digit else ()),
    ]
    out: list[Span] = []
    covered = None
    for kind, spans in search:
        for a, z in spans:
            if covered is None:
                covered = bytearray(len(text))
                for _, s, e in taken:
                    covered[s:e] = b"\1" * (e - s)
            if covered.find(1, a, z) < 0:
                covered[a:z] = b"\1" * (z - a)
                out.append((kind, a, z))
    return out


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * log2(n / len(text)) for n in Counter(text).values())


def surroundings(kind: int, text: str, start: int, end: int) -> tuple[int, int, int]:
    """Whether words near by speak for the span, whether some speak against it, and whether it is part of a longer word."""
    near = set(re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-4:])
    touching = start and (text[start - 1].isalnum() or text[start - 1] in "_#") or end < len(text) and (text[end].isalnum() or text[end] == "_")
    return int(bool(near & FOR[KINDS[kind]])), int(bool(near & AGAINST)), int(bool(touching))


def votes(kind: int, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """A vote of each labeler: 1, 0 or -1."""
    span = text[start:end]
    named, doubted, touching = surroundings(kind, text, start, end)
    digits = digits_of(span)
    place = -1 if touching else 1
    variety = 1 if len(set(digits if kind != EMAIL_AT else span)) >= 4 or kind == IP_AT else -1
    shape = structure = -1
    gazetteer = 0
    if kind == EMAIL_AT:
        tail = re.split(r"[.\s\[\](){}]+", span.rstrip(" ])}"))[-1].lower()
        shape = 1 if re.fullmatch(r"[a-z]{2,24}", tail) else -1
        structure = 1 if len(span) <= 254 and ".." not in span and "/" not in span else -1
        gazetteer = 1 if tail in DOMAINS or re.fullmatch("[a-z]{2}", tail) else -1
    elif kind == IP_AT:
        shape = 1 if ":" not in span and len(span) <= 15 or span.count(":") == 7 else 0
        structure = 1
        gazetteer = -1 if re.match(r"0+\.|::|0*127\.", span) else 1 if ":" not in span else 0
    elif kind == CARD_AT:
        shape = 1 if len(digits) == 16 or len(digits) == 15 and digits[0] == "3" else -1
        structure = 1 if luhn(digits) else -1
        gazetteer = 1 if ISSUERS.match(digits) else -1
    elif kind == PHONE_AT:
        shape = 1 if span[0] in "+(0" else 0
        structure = 1 if 10 <= len(digits) <= 13 else 0 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if CODES.match(span) else -1 if span[0] == "+" else 0
    else:
        # A long mixed string alone may be a digest or an id: it is entropy that votes, the rest asks for more.
        shape = 1 if KEYS.match(span) else 0 if len(span) <= 256 else -1
        structure = 1 if len(span) >= 12 and entropy(span) >= 3 else -1
        gazetteer, variety = 0, 0
        place = -1 if touching else int(text[start - 1 : start] in ("=", ":", "'", '"') and start > 0)
    return (int(base), shape, place, variety, structure, gazetteer, named, -doubted)


def span_features(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    """Small numbers that describe the span and what is around it."""
    span = text[start:end]
    digits = digits_of(span)
    return (
        min(len(digits) // 3, 7),
        min(len(re.findall(r"[ ./_:-]", span)), 5),
        int(span[:1] == "+"),
        int("(" in span or "[" in span),
        int("@" in span),
        int(luhn(digits)) if 13 <= len(digits) <= 19 else 0,
        int(not span.isascii()),
        min(len(span) // 8, 6),
        int(bool(ISSUERS.match(digits))),
        int(not re.search("[^0-9A-Fa-f]", span)),
        min(int(entropy(span)), 5),
        *surroundings(kind, text, start, end),
        int(text[start - 1 : start] in ("=", ":", "'", '"') and start > 0),
    )


SIZES = (8, 6, 2, 2, 2, 2, 2, 7, 2, 2, 6, 2, 2, 2, 2)
WIDTH = sum(SIZES) + 1


def encoded(features: tuple[int, ...]) -> np.ndarray:
    """One-hot features and an intercept."""
    x = np.zeros(WIDTH)
    x[-1] = 1
    at = 0
    for size, value in zip(SIZES, features, strict=True):
        x[at + value] = 1
        at += size
    return x


@dataclass
class Model:
    """prior and says[kind][labeler][class][vote + 1] by expectation-maximisation; a classifier's weights by kind."""

    prior: np.ndarray
    says: np.ndarray
    weights: np.ndarray

    def score(self, kind: int, features: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-encoded(features) @ self.weights[kind])))


def posterior(prior: np.ndarray, says: np.ndarray, kinds: np.ndarray, ballots: np.ndarray) -> np.ndarray:
    """Probability of personal data for each row of votes."""
    log = np.log(np.stack([1 - prior[kinds], prior[kinds]], axis=1))
    for j in range(ballots.shape[1]):
        log += np.log(says[kinds, j, :, ballots[:, j] + 1])
    log -= log.max(axis=1, keepdims=True)
    p = np.exp(log)
    return p[:, 1] / p.sum(axis=1)


def reliabilities(kinds: np.ndarray, ballots: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from a start at which every labeler is right more often than not.

    The start counts as `strength` pseudo-votes, so that a kind with few candidates stays near it.
    """
    start = np.zeros((len(KINDS), ballots.shape[1], 2, 3))
    start[:, :, 0], start[:, :, 1] = (0.6, 0.3, 0.1), (0.1, 0.3, 0.6)
    prior, says, strength = np.full(len(KINDS), 0.5), start.copy(), 10.0
    for _ in range(rounds):
        p = posterior(prior, says, kinds, ballots)
        total, yes = np.full(len(KINDS), strength), np.full(len(KINDS), strength / 2)
        np.add.at(total, kinds, counts)
        np.add.at(yes, kinds, counts * p)
        prior = yes / total
        says = start * strength
        for j in range(ballots.shape[1]):
            for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
                np.add.at(says, (kinds, j, c, ballots[:, j] + 1), weight)
        says /= says.sum(axis=3, keepdims=True)
    return prior, says


def regression(x: np.ndarray, p: np.ndarray, counts: np.ndarray, penalty: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    counts = counts / max(counts.sum() / 1000, 1.0)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (q - p)) + penalty * w
        hessian = (x * (counts * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.string())])
_FOUND_SQL = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,features:string>>"


def described(text: str) -> list[dict]:
    """Every span of the base and every other candidate of a text, with votes and features."""
    if not WORTH.search(text):
        return []
    base = base_spans(text)
    out = []
    for is_base, spans in ((True, base), (False, broad_spans(text, base))):
        for k, a, z in spans:
            own = {"votes": votes(k, text, a, z, is_base), "features": span_features(k, text, a, z)}
            out.append({"kind": k, "start": a, "end": z, "base": is_base} | {c: ",".join(map(str, v)) for c, v in own.items()})
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for every document: what described() says of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([described(t.as_py()) if t.is_valid else [] for t in b.column(1)], pa.list_(_FOUND))
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["doc_id", "found"])

    return doc_texts(docs).mapInArrow(run, f"doc_id long, found {_FOUND_SQL}")


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def fit(docs: DataFrame) -> Model:
    return fitted(kept_table(candidates(docs), "personal-data"))


def fitted(found: DataFrame) -> Model:
    """The model from the counts of votes and features over all of candidates()."""
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    rows = sorted(spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect())
    kinds = np.array([r.kind for r in rows], np.int64)
    ballots = np.array([_numbers(r.votes) for r in rows], np.int64).reshape(-1, len(LABELERS))
    prior, says = reliabilities(kinds, ballots, np.array([r.n for r in rows], np.float64))
    p = posterior(prior, says, kinds, ballots).tolist()
    weights = np.zeros((len(KINDS), WIDTH))
    if rows:
        soft = found.sparkSession.createDataFrame([(r.kind, r.votes, x) for r, x in zip(rows, p, strict=True)], "kind int, votes string, p double")
        # At most one row for each kind and ballot, 5 times 3 to the power of 8.
        sums = sorted(spans.join(F.broadcast(soft), ["kind", "votes"]).groupBy("kind", "features").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).collect())
        for k in range(len(KINDS)):
            own = [r for r in sums if r.kind == k]
            if own:
                n = np.array([r.n for r in own], np.float64)
                weights[k] = regression(np.array([encoded(_numbers(r.features)) for r in own]), np.array([r.p for r in own]) / n, n)
    return Model(prior, says, weights)


def chosen(found: list[dict], model: Model, least: float = LEAST) -> tuple[list[Span], list[Span]]:
    """(base, base and added), each in order of kind and start."""
    base = [(s["kind"], s["start"], s["end"]) for s in found if s["base"]]
    added = [(s["kind"], s["start"], s["end"]) for s in found if not s["base"] and model.score(s["kind"], _numbers(s["features"])) >= least]
    return base, sorted(base + added)


def all_spans(text: str, model: Model, least: float = LEAST) -> tuple[list[Span], list[Span]]:
    return chosen(described(text), model, least)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def find(docs: DataFrame, model: Model | None = None, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, n_<kind> and base_sha256 of the base, spans with the added ones, n_spans."""
    found = kept_table(candidates(docs), "personal-data")
    model = fitted(found) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sums, every, n_every = [], [], [], []
            for own in b.column(1).to_pylist():
                base, spans = chosen(own, model, least)
                counts.append([sum(s[0] == k for s in base) for k in range(len(BASE_KINDS))])
                sums.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every.append(listed(spans))
                n_every.append(len(spans))
            n = np.array(counts, np.int64).reshape(-1, len(BASE_KINDS))
            columns = [b.column(0), *(pa.array(np.ascontiguousarray(n[:, k])) for k in range(len(BASE_KINDS))), pa.array(sums, pa.string()), pa.array(every, pa.string()), pa.array(n_every, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
