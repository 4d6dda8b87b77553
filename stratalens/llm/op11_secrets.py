"""Operator 11, secret scans: named patterns, and random strings by how few characters a token holds.

A vocabulary of subwords spends a token on four or five characters of prose,
on three of a made-up word, but on less than two of a random string.  A run of
letters, digits and the signs of base64 that is long enough and falls below a
ratio is a secret, unless it is a known digest or an identifier.  Every text is
scanned whole, by itself; nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .tokens import PATTERN

# The named kinds, their patterns, and the fewest characters of the part that counts (of a group, if one is named).
PATTERNS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: The kind that token efficiency adds; kinds of one start stand in the order of KINDS.
RANDOM = "random"
KINDS = (*PATTERNS, RANDOM)

#: A candidate has so many characters at least, and fewer characters to a token than the ratio.
SHORTEST, RATIO = 20, 2.0
#: Tokens are counted in pieces of so many characters, so that a run of any length takes linear time.
PIECE = 256

# Forms of digests and identifiers, which look random and are no secrets.
KNOWN = {
    "digest or object id": r"(?:[0-9a-f]{24}|[0-9A-F]{24}|(?:[0-9a-f]{8}|[0-9A-F]{8}){4,8}|(?:[0-9a-f]{32}|[0-9A-F]{32}){3,4})",
    "uuid": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    "integrity digest": r"sha(?:1|256|384|512)[-=/_][A-Za-z0-9+/]+=*",
    "ulid": r"[0-7][0-9A-HJKMNP-TV-Z]{25}",
    "date and time": r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9-]*Z?",
    "numbers and signs": r"[0-9+/_=-]+",
}
_KNOWN = re.compile("|".join(f"(?:{p})" for p in KNOWN.values()))
_CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
# a run of hex characters that is long enough begins where the run begins, so the short ones need no match of their own
_COMPILED = {k: (re.compile(p.replace("+", "{%d,}+" % least) if k == "hex" else p), g, least) for k, (p, g, least) in PATTERNS.items()}

Span = tuple[str, int, int, float | None]


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """A tiktoken encoding of a file of ranks, one for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def characters_per_token(text: str, encoding) -> float:
    return len(text) / max(1, sum(len(encoding.encode_ordinary(text[i : i + PIECE])) for i in range(0, len(text), PIECE)))


def named_spans(text: str) -> Iterator[Span]:
    """Matches of each named pattern, leftmost and not overlapping within a kind; those too short are passed over, with what they cover."""
    for kind, (pattern, group, least) in _COMPILED.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end(), None


def random_spans(text: str, encoding, shortest: int = SHORTEST, ratio: float = RATIO) -> Iterator[Span]:
    """Runs that the vocabulary can't compress and that are no digest or identifier."""
    for m in re.compile(_CANDIDATE % shortest).finditer(text):
        found = m[0]
        if not _KNOWN.fullmatch(found):
            value = characters_per_token(found, encoding)
            if value < ratio:
                yield RANDOM, m.start(), m.end(), value


def text_spans(text: str, encoding, shortest: int = SHORTEST, ratio: float = RATIO) -> list[Span]:
    """All spans of a text by start, then kind; a random string that a named span touches isn't told twice."""
    spans = list(named_spans(text))
    taken = sorted((a, z) for _, a, z, _ in spans)
    at, upto = 0, 0
    for span in random_spans(text, encoding, shortest, ratio):
        while at < len(taken) and taken[at][0] < span[2]:
            upto = max(upto, taken[at][1])
            at += 1
        if upto <= span[1]:
            spans.append(span)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, *, path: str | None = None, shortest: int = SHORTEST, ratio: float = RATIO, redacted: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, redacted, spans (kind, start, end, value, chars_per_token) of every row.

    Starts and ends are code points, ends exclusive.  ``redacted`` is the text
    with [kind] in place of what spans cover (null unless asked for).  A null text is an empty one and
    has no spans; ids may be null or repeated, every row gives a row; other
    columns are ignored.
    """
    path = path or default_vocabulary()
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("chars_per_token", pa.float64())]
    kept = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))

    def scan(batches):
        encoding = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [text_spans(t, encoding, shortest, ratio) for t in texts]
            spans = [[{"kind": k, "start": a, "end": z, "value": t[a:z], "chars_per_token": v} for k, a, z, v in r] for t, r in zip(texts, rows)]
            yield pa.record_batch([batch.column(0), pa.array([redact(t, r) if redacted else None for t, r in zip(texts, rows)], pa.string()), pa.array(spans, pa.list_(pa.struct(fields)))], names=["doc_id", "redacted", "spans"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(lean(scan), f"doc_id {kind}, redacted string, spans array<struct<kind: string, start: bigint, end: bigint, value: string, chars_per_token: double>>")


def redact(text: str, spans: list[Span]) -> str:
    """The text with [kind] in place of each span; overlapping spans are one, named by the first."""
    out, upto = [], 0
    for kind, a, z, _ in spans:
        if a >= upto:
            out += [text[upto:a], f"[{kind}]"]
        upto = max(upto, z)
    return "".join([*out, text[upto:]]) if spans else text


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), redacted=False)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(RANDOM))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11_secret_scan that SQL can express: those of the named patterns."""
    return op11_secret_scan(spark, sf_dir).drop("spans", f"n_{RANDOM}")
