"""Secret scans: fixed shapes, and strings a tokenizer finds hard to shorten.

Besides three fixed kinds, a run of letters, digits and ``+/_=-`` is a secret
when it has few characters per token under a byte-level BPE vocabulary: natural
words are long tokens, random strings fall into tokens of one or two characters.
The run is measured as a whole, and so is each stretch between its readable
pieces. Known digests (hex of usual lengths), UUIDs and identifiers whose pieces
are cheap in tokens are left out before the test, as are numbers.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import public_tokenizers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Kinds in the order that breaks ties of a start; the last is the method's.
KINDS = ("assign", "access", "hex", "random")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
RUN = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
KEYWORD = re.compile("[:=]")
UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
UNIT = re.compile(f"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
LETTER = re.compile("[A-Za-z]")
DIGEST = re.compile("[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
#: pieces of identifiers and paths: words, camel case or capitals, with at most four digits
SEPARATORS = "+/_=-"
PIECE = re.compile("[A-Z]?[a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}|[A-Z]+[0-9]{0,4}")
MAX_CHARS_PER_TOKEN = 1.9
MIN_RUN = 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def is_known(pieces: list[str], encode, limit: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Whether pieces between joiners are UUIDs, digests, short numbers and
    identifiers that are, taken together, cheap in tokens."""
    chars = tokens = 0
    for p in pieces:
        if UUID.fullmatch(p) or (DIGEST.fullmatch(p) and len(p) in DIGEST_LENGTHS):
            continue
        if not PIECE.fullmatch(p):
            return False
        letters = p.rstrip("0123456789")
        if len(letters) > 2:
            # words in capitals are rare in vocabularies
            chars, tokens = chars + len(letters), tokens + len(encode(letters.lower() if letters.isupper() else letters))
    return not chars or chars > limit * tokens


def is_random(run: str, encode, limit: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Whether a run is neither known nor cheap to write in tokens."""
    if not LETTER.search(run) or len(run) > limit * len(encode(run)):
        return False
    return not is_known(UNIT.findall(run), encode, limit)


def random_parts(run: str, encode, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """The whole run if it is random, else its random stretches of MIN_RUN
    characters or more between readable pieces."""
    if is_random(run, encode, limit):
        return [(0, len(run))]
    parts: list[list[int]] = []
    fresh = True
    for m in UNIT.finditer(run):
        if not is_known([m[0]], encode, limit):
            if fresh:
                parts.append([m.start(), m.end()])
                fresh = False
            parts[-1][1] = m.end()
        elif len(m[0].rstrip("0123456789")) > 2 or len(m[0]) > 6:
            fresh = True  # a readable piece ends the stretch
        elif not fresh:
            parts[-1][1] = m.end()
    return [(a, b) for a, b in parts if b - a >= MIN_RUN and is_random(run[a:b], encode, limit)]


def union(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    """Disjoint stretches covered by spans, in order."""
    out: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def find_spans(text: str, encode, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    found = []
    if KEYWORD.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    taken, at = union(found), 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        # what base spans leave uncovered of the run
        begin, k, open_ = m.start(), at, []
        while k < len(taken) and taken[k][0] < m.end():
            open_.append((begin, taken[k][0]))
            begin, k = taken[k][1], k + 1
        open_.append((begin, m.end()))
        for a, b in open_:
            if a != m.start():
                a += len(text[a:b]) - len(text[a:b].lstrip(SEPARATORS))
            if b - a >= MIN_RUN:
                found += [("random", a + x, a + y) for x, y in random_parts(text[a:b], encode, limit)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    limit: float = MAX_CHARS_PER_TOKEN, with_text: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind,start,stop>>.

    The vocabulary (about 1 MB, whatever the input) is broadcast; texts are
    scanned where they are read, without a shuffle.

    Defined cases: a null or empty text has no spans; ids may be null or repeat;
    other columns are ignored; an empty table gives no rows. ``with_text`` adds
    the text with each secret replaced by ``[SECRET]`` (null stays null).
    """
    sc = docs.sparkSession.sparkContext
    ranks = sc.broadcast(load_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            spans = [find_spans(t or "", own.encode_ordinary, limit) for t in b["text"]]
            out = {
                "doc_id": b["doc_id"],
                "spans": [[{"kind": k, "start": s, "stop": e} for k, s, e in x] for x in spans],
            }
            if with_text:
                out["clean"] = [redact(t, x) for t, x in zip(b["text"], spans, strict=True)]
            yield pd.DataFrame(out)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(
        run,
        f"doc_id {kind}, spans array<struct<kind:string,start:long,stop:long>>" + ", clean string" * with_text,
    )


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every stretch covered by spans replaced by one mark."""
    if not spans:
        return text
    parts, at = [], 0
    for s, e in union(spans):
        parts += [text[at:s], mark]
        at = e
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with secrets cut out of the text; all rows and columns stay.

    The other columns travel beside the text as one struct, so clashing names
    and repeated ids do no harm. ``n_chars``, if there, is counted anew.
    """
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    rest = [f for f in docs.columns if f != text_col]
    keyed = packed.select(F.struct(*[F.col("row")[c].alias(c) for c in rest], F.lit(0).alias("_")).alias("id"), "text")
    out = scan(keyed, "id", "text", with_text=True, **options)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("clean").alias(c))
        elif c == "n_chars":
            cols.append(F.length(F.coalesce(F.col("clean"), F.lit(""))).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("doc_id")[c].alias(c))
    return out.select(*cols)
