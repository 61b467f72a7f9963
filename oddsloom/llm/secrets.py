"""Secret scans by dictionary-primed zstandard novelty.

Three kinds of base spans come from fixed patterns. The method adds to them:
every long unbroken string near a sensitive word, before or after it, or in a
block of such strings that follows one, is compressed together with its surroundings under a dictionary of code and identifiers, and the bytes that
the string adds are its novelty. Strings that barely compress are reported:
those that cost about as much as random signs of their own alphabet do. Nothing
but the bytes decides; words cost less, as the dictionary holds words, those of
the corpus too if it was fitted (:func:`fit_dictionary`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import text as T

#: Fixed values of the base kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|credential|private.?key|auth|bearer|AKIA|client.?id|signature", re.IGNORECASE | re.ASCII)

#: What follows the first mark of a key, up to the next mark, is as sensitive as that mark.
MARK = re.compile(r"-----(BEGIN|END) ([^\n-]{1,80})-----")

#: What code and identifiers around secrets look like; it primes the compressor.
IDENTIFIERS = (
    b"password passwd passphrase secret token api_key apikey access_key secret_key client_id client_secret private_key public_key "
    b"credential credentials authorization authentication bearer basic signature session cookie username user_name account email "
    b"import from return const let var function class def public static void string int self this null none true false undefined "
    b"config.get( os.environ[ process.env. getenv( settings. https:// http:// www. .com .org .json .yaml .xml .html .js .py .java "
    b"example test sample default changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz "
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000000000000000 ================ ---------------- ________________ ................ "
    b"0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ 1234567890123456 "
    b"src/main/java/org/example/ src/test/ node_modules/package.json application.properties README CONTRIBUTING LICENSE guidelines documentation "
    b"configuration configure confirmation provider service manager controller handler repository database connection server client request response "
    b"internationalization localization implementation initialize validation permission administrator environment variable PATH HOME ENV VAR CONFIG PRIVATE PUBLIC SECRET TOKEN "
    b"reset login logout register profile settings security encryption certificate verification expired refresh access generate generator factory builder "
)
#: Words of a corpus that go into the dictionary: letters alone, shorter than any candidate.
WORD = r"(?<![A-Za-z])[A-Za-z]{4,15}(?![A-Za-z])"


@dataclass(frozen=True)
class NoveltyConfig:
    """``context`` characters on either side; a string is novel if it adds ``ratio`` bytes a character or more.

    Long strings of a small alphabet cannot reach that: for them the bound is ``part`` of what random signs of the
    string's own alphabet hold, and ``start`` bytes, if that is less. A sensitive word counts over ``context`` characters
    or ``near``, whichever is more, on either side. A dictionary holds words of at least ``fit_times``
    documents, ``fit_words`` at most.
    """

    context: int = 160
    near: int = 48
    ratio: float = 0.62
    part: float = 0.97
    start: float = 8.0
    level: int = 3
    fit_times: int = 3
    fit_words: int = 6000


#: The classes of signs that an alphabet is made of, and how many signs each has.
_CLASSES = tuple((re.compile(x), n) for x, n in ((r"[0-9]", 10), (r"[a-f]", 6), (r"[g-z]", 20), (r"[A-F]", 6), (r"[G-Z]", 20), (r"\+", 1), (r"/", 1), (r"=", 1), (r"_", 1), (r"\.", 1), (r"-", 1)))


def sign_bytes(text: str) -> float:
    """Bytes that a random sign holds of the alphabet that ``text`` is made of."""
    return math.log2(max(2, sum(n for x, n in _CLASSES if x.search(text)))) / 8


class Novelty:
    """The marginal compressed bytes of strings against their surroundings."""

    def __init__(self, config: NoveltyConfig, identifiers: bytes = IDENTIFIERS) -> None:
        self.config = config
        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=config.level)
        self._zip = zstandard.ZstdCompressor(level=config.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added_bytes(self, before: str, candidate: str, after: str) -> int:
        around = before.encode() + after.encode()
        return len(self._zip.compress(around + candidate.encode())) - len(self._zip.compress(around))

    def is_novel(self, text: str, start: int, end: int) -> bool:
        c = self.config
        before, own, after = text[max(0, start - c.context) : start], text[start:end], text[end : end + c.context]
        return self.added_bytes(before, own, after) >= min(c.ratio * len(own), c.part * sign_bytes(own) * len(own) + c.start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, each leftmost and non-overlapping; ends are exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitive(text: str, spans: np.ndarray, words: np.ndarray, reach: int) -> np.ndarray:
    """Which candidates (start, end) stand in a sensitive context.

    A sensitive word is at most ``reach`` characters away on either side; or the
    candidate follows a sensitive BEGIN mark, before the next mark; or
    it belongs to a block of adjacent lines with candidates of which one is
    sensitive, or whose line before has a sensitive word.
    """
    starts, ends = spans.T
    i = np.searchsorted(words[:, 1], starts - reach)
    own = (i < len(words)) & (words[np.minimum(i, len(words) - 1), 0] <= ends + reach)
    marks = [(m.end(), m[1] == "BEGIN" and SENSITIVE.search(m[2]) is not None) for m in MARK.finditer(text)]
    inside = np.array([False, *[x for _, x in marks]])
    own |= inside[np.searchsorted(np.array([x for x, _ in marks]), starts, side="right")]
    breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    line = np.searchsorted(breaks, starts)
    block = np.cumsum(np.diff(line, prepend=line[0]) > 1)
    marked = np.isin(line - 1, np.searchsorted(breaks, words[:, 0]))
    return np.bincount(block, own | marked)[block] > 0


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings in a sensitive context that no base span covers."""
    words = np.array([m.span() for m in SENSITIVE.finditer(text)])
    spans = np.array([m.span() for m in CANDIDATE.finditer(text)])
    if not len(words) or not len(spans):
        return []
    found = []
    base_starts = np.array([x for x, _, _ in base], np.int64)
    base_ends = np.maximum.accumulate(np.array([y for _, _, y in base], np.int64))
    reach = max(novelty.config.near, novelty.config.context)
    for a, b in spans[sensitive(text, spans, words, reach)].tolist():
        i = np.searchsorted(base_starts, a, side="right")
        if i and base_ends[i - 1] >= b:
            continue
        if novelty.is_novel(text, a, b):
            found.append((a, 3, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, with commas between."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: A text without any of these has no span of any kind; RE2 finds that out for a whole batch at once. Keys of assignments and access keys are sensitive words.
_POSSIBLE = f"(?i:{SENSITIVE.pattern})|[0-9a-f]{{16}}"


def fit_dictionary(docs: DataFrame, config: NoveltyConfig | None = None, text_col: str = "text", id_col: str = "doc_id") -> bytes:
    """:data:`IDENTIFIERS` and the words that several documents share, the commonest last.

    Words are counted over all documents. Only runs of 4 to 15 letters are words, so
    no candidate is one. Null and empty texts have none; an empty table gives
    the identifiers alone. Other columns, of any name, are not looked at.
    """
    config = config or NoveltyConfig()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("w"))
    # At most ``fit_words`` short words.
    common = words.groupBy("w").count().where(F.col("count") >= config.fit_times).orderBy(F.desc("count"), "w").limit(config.fit_words).collect()
    return " ".join([r["w"] for r in reversed(common)]).encode() + b" " + IDENTIFIERS


def _scan(batches: Iterator[pa.RecordBatch], config: NoveltyConfig, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(config, dictionary)
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for part in T.pieces(batch, "text"):
            texts = part.column("text")
            n = part.num_rows
            counts = np.zeros((3, n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            possible = pc.fill_null(pc.match_substring_regex(texts, _POSSIBLE), False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(possible):
                text = texts[int(i)].as_py()
                base = base_spans(text)
                more = novel_spans(text, base, novelty)
                for _, k, _ in base:
                    counts[k, i] += 1
                if base:
                    digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(sorted(base + more))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def find_secrets(docs: DataFrame, config: NoveltyConfig | None = None, text_col: str = "text", id_col: str = "doc_id", dictionary: bytes = IDENTIFIERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row, over whole texts.

    ``spans`` lists kind:start:end in code points, ends exclusive, by start and
    then kind (assign, access, hex, novel); ``base_sha256`` is over the first
    three kinds alone. Null and empty texts have no spans; repeated rows are
    scanned alike; very long texts are scanned whole; an empty table gives an
    empty result. Other columns, of any name, are not looked at. Base spans are
    never taken back by the novelty measure.
    """
    config = config or NoveltyConfig()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scan(b, config, dictionary), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[secret]", config: NoveltyConfig | None = None, text_col: str = "text", dictionary: bytes = IDENTIFIERS) -> DataFrame:
    """``docs`` with every span that :func:`find_secrets` lists in ``text_col`` replaced by ``mask``, overlapping ones by one.

    Null texts stay null, empty ones empty; all other columns and repeated rows
    stay as they are, and so does an empty table.
    """
    config = config or NoveltyConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(config, dictionary)
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                if text is not None:
                    base = base_spans(text)
                    last, parts = 0, []
                    for a, _, b in sorted(base + novel_spans(text, base, novelty)):
                        if b > last:
                            parts += [text[last : max(a, last)], mask if a >= last else ""]
                            last = b
                    text = "".join([*parts, text[last:]])
                out.append(text)
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
