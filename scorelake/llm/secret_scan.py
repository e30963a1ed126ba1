"""Secret scan: fixed patterns and a token-efficiency test.

The fixed kinds are assignments of a value to a secret's name, access keys, and long runs of lower-case hexadecimal digits.
The method adds the kind `random`: a run of key characters is cut into the tokens of a byte-pair vocabulary. Names and
words were frequent when the vocabulary was made and take few tokens; random characters take many. A run of MIN_CHARS or more
characters with a digit or with both cases, of at most RATIO characters a token, is reported, unless it is

- a known digest: hexadecimal digits of one case in the length of MD5, SHA-1 or SHA-2, or base64 behind `sha256-` and the like;
- an identifier: a UUID, a number or date, or a name with WORD_PART or more letters for each of its parts on average, a part
  being a word, a capitalised word, a run of capitals or a number;
- within a span of a fixed kind.

Places are code points, ends exclusive. Spans are in order of start and then of kind (assign, access, hex, random).

Plan: no shuffle; texts are read whole, one at a time. The vocabulary is a file of ranks, read by the driver and
broadcast (a parameter; under two megabytes); each worker builds its encoder once. The run of key characters is
cut by the vocabulary's own pattern, so no piece is longer than its letters or digits in a row.

Defined cases: a null text is empty; a null id is kept; repeated rows give equal rows; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("SCORELAKE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that comes with the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The base kinds and their least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

MIN_CHARS, RATIO, WORD_PART = 20, 2.0, 3.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
EDGE = "+/_-"
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_CHARS = frozenset([32, 40, 56, 64, 96, 128])
LABELLED = re.compile(r"(?:md5|sha1|sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}\Z")
NUMBER = re.compile(r"[0-9eE+/_=-]+\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{%d,}" % HEX_CHARS, text)]
    return sorted(out)


def known(run: str) -> bool:
    """Whether a run is a digest or an identifier."""
    if NUMBER.match(run) or UUID.match(run) or LABELLED.match(run) or (len(run) in DIGEST_CHARS and DIGEST.match(run)):
        return True
    return sum(map(str.isalpha, run)) >= WORD_PART * len(PART.findall(run))


_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    """The encoder of a rank file's bytes, one in each worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def random_spans(text: str, base: list[tuple[int, int, int]], count) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs that take many tokens; count: a text's number of tokens."""
    out, k, reach = [], 0, -1
    for m in RUN.finditer(text):
        run = m[0].strip(EDGE)
        if len(run) < MIN_CHARS:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip(EDGE))
        while k < len(base) and base[k][0] <= start:
            reach = max(reach, base[k][2])
            k += 1
        if start + len(run) <= reach or run.islower() and run.isalpha() or known(run):
            continue
        if len(run) <= RATIO * count(run):
            out.append((start, 3, start + len(run)))
    return out


def _scanned(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    encode = encoder(ranks.value).encode_ordinary
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for value in batch["text"]:
            text = value.as_py() or ""
            base = base_spans(text)
            found = sorted(base + random_spans(text, base, lambda run: len(encode(run))))
            rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, spans)], ["doc_id", "spans"])


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, spans) of every document; spans: (kind, start, end) in order."""
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scanned(batches, ranks), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def without_spans(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """text with a mark in place of every span; overlapping spans are one."""
    merged = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda s, x: F.struct(F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise("")).alias("out"), F.greatest(s["at"], x["end"]).alias("at")))
    done = F.coalesce(merged, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")))
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts, the digest of the fixed kinds, all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[3])
    return scan(docs).select("doc_id", *map(count, KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
