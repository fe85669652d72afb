"""Secret scans: base patterns, and strings that a public vocabulary needs many tokens for.

Token-efficiency test: text that people write is cut into tokens of several characters; random
strings fall apart. Runs of credential characters with few characters a token under a tiktoken
vocabulary are reported, after known digests (hex of a digest's length, UUIDs) and identifiers
(numbers, paths and names made of words) are excluded.

Edge cases: a null text counts as empty, which has no spans; texts are scanned whole at any
length; repeated rows give repeated results; offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumine.llm.columns import append

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGESTS = (32, 40, 56, 64, 96, 128)
#: Shortest run that the token test judges, and characters a token under which it is random.
SHORTEST = 20
MIXED_RATIO = 2.1
PLAIN_RATIO = 1.75

_HEX_BYTES = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUN_BYTES = bytes(120 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else 32 for i in range(256))
_NAMES = ("password", "passwd", "secret", "token", "api")


@lru_cache(maxsize=4)
def vocabulary(path: str):
    """A tiktoken encoding over a ranks file; each run is one piece."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vellumine", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def excluded(run: str) -> bool:
    """Known digests and identifiers."""
    if UUID.fullmatch(run) or (len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run)):
        return True
    if re.fullmatch(r"[0-9_/+=-]+", run) or len(set(run)) <= 4:
        return True
    # names and paths: joined parts, each one word (Capitalised, lower or UPPER) with digits after it
    parts = re.split(r"[_/-]+", run.strip("_/-=+"))
    return len(parts) > 1 and all(re.fullmatch(r"([A-Z]?[a-z]+|[A-Z]+)?\d*", p) for p in parts)


def is_random(run: str, encoding) -> bool:
    if excluded(run):
        return False
    kinds = bool(re.search("[a-z]", run)) + bool(re.search("[A-Z]", run[1:])) + bool(re.search("[0-9]", run))
    return len(run) / len(encoding.encode_ordinary(run)) < (MIXED_RATIO if kinds > 1 else PLAIN_RATIO)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds numbered as in KINDS."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found


def scan(text: str | None, encoding) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, sorted by start and kind."""
    if not text:
        return [], []
    found = base_spans(text)
    raw = text.encode("utf-8", "surrogatepass")
    if b"x" * 32 in raw.translate(_HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    found.sort()
    more = []
    if b"x" * SHORTEST in raw.translate(_RUN_BYTES):
        ends = {(s, e) for s, k, e in found}
        for m in RUN.finditer(text):
            if m.end() - m.start() >= SHORTEST and (m.start(), m.end()) not in ends and is_random(m[0], encoding):
                more.append((m.start(), 3, m.end()))
    return found, sorted(found + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FIELDS = [
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
]


def scanner(path: str = VOCABULARY) -> Callable[[], Callable[[list], list[list]]]:
    def make() -> Callable[[list], list[list]]:
        encoding = vocabulary(path)

        def run(texts: list) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for text in texts:
                base, spans = scan(text, encoding)
                for k in range(3):
                    out[k].append(sum(x[1] == k for x in base))
                out[3].append(hashlib.sha256(written(base).encode()).hexdigest())
                out[4].append(written(spans))
            return out

        return run

    return make


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """``docs`` with counts, the digest of the base spans, and all spans of each whole text."""
    return append(docs, text, FIELDS, scanner(vocabulary_path), keep)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; overlapping spans become one."""

    def make() -> Callable[[list], list[list]]:
        encoding = vocabulary(vocabulary_path)

        def clean(whole: str | None) -> str | None:
            out, at = [], 0
            for s, _, e in scan(whole, encoding)[1]:
                if s >= at:
                    out += [whole[at:s], mark]
                at = max(at, e)
            return whole if not out else "".join([*out, whole[at:]])

        return lambda texts: [[clean(x) for x in texts]]

    return append(docs.withColumn("__vellumine_raw", docs[text]), "__vellumine_raw", [T.StructField(text, T.StringType())], make, [c for c in docs.columns if c != text]).select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs, keep=["doc_id"])
