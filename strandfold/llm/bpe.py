"""Byte-level BPE encoding and decoding, long texts in parts that tasks encode side by side.

A text of up to ``PART`` characters is encoded at once.  A longer one is cut where the pre-tokenizer splits whatever stands
around the cut (:data:`CUTS`); these parts are independent.  A stretch without such a place is pre-tokenized, and a
pre-token longer than ``LEAF`` byte characters is unsplit text for the merges: it is dealt in leaves and put together again
by tree concatenation.  Two neighbours are joined by encoding a window of the last tokens of one and the first of the other,
doubled until it starts with the token that the left side has there and ends with the one of the right side.

Such a join is exact: a sequence of tokens is the encoding of its bytes if every two neighbours, encoded alone, stay as they
are (of all merges across a border, the first one would also happen between the two tokens alone), and each two neighbours
of the joined sequence lie inside the left side, the window or the right side.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import append_arrow, materialise, register, table, without

PART = 32_768
LEAF = 4_096
WINDOW = 4

# Places between two characters that always separate two pre-tokens: white space after a sign that is none, and common
# punctuation next to a letter of old, settled blocks.  The apostrophe is left out, as it can start a contraction.
LETTER = "0-9A-Za-zÀ-ÖØ-öø-ɏА-я一-龥ぁ-ゖ가-힣"
MARK = r".,;:!?()\[\]{}\"，。、！？；：（）「」"
CUTS = re.compile(rf"(?<=[{LETTER}{MARK}])(?=[ \n])|(?<=[{LETTER}])(?=[{MARK}])")


def default_vocabulary() -> str:
    """File of the public 50k byte-level vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def load(path: str | None):
    """The encoder of a file, once per worker; padding and truncation of the file are not used."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or default_vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return Encoder(tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()])


# Signs whose classes no version of Unicode has changed for long: texts of these alone are split into pre-tokens here.
SETTLED = regex.compile(r"[\t\n\r -~¡-ɏА-я‘-‧€一-龥、。，！？；：（）「」ぁ-ゖ가-힣]*+")
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
# The sign that stands for every byte: printable Latin-1 for itself, the others in order from U+0100.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
CACHED, CACHED_LENGTH = 400_000, 32


class Encoder:
    """The tokenizer of one file with a bounded store of the encodings of short pre-tokens, which repeat a lot.

    The store pays only for the byte-level pre-tokenizer with its usual pattern; other files and unusual texts go to the
    tokenizer as they are.
    """

    def __init__(self, tokenizer, special: list[str]):
        self.tokenizer, self.special, self.known = tokenizer, special, {}
        usual = json.loads(tokenizer.to_str())["pre_tokenizer"]
        self.usual = usual.get("type") == "ByteLevel" and usual.get("use_regex") and not usual.get("add_prefix_space")
        self.usual = self.usual and tokenizer.normalizer is None

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """Token numbers of every text, equal to those that the tokenizer gives it."""
        plain = [bool(self.usual and SETTLED.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        split = [PRE_TOKENS.findall(t) if easy else None for t, easy in zip(texts, plain)]
        rest = iter(self.batch([t for t, easy in zip(texts, plain) if not easy]))
        if len(self.known) > CACHED:
            self.known = {}
        fresh = list({p for pieces in split if pieces for p in pieces} - self.known.keys())
        signs = [p.encode().decode("latin-1").translate(BYTE_SIGNS) for p in fresh]
        merge = self.tokenizer.model.tokenize
        self.known.update((p, [t.id for t in merge(s)]) for p, s in zip(fresh, signs))
        found = self.known.__getitem__
        out = [next(rest) if pieces is None else list(chain.from_iterable(map(found, pieces))) for pieces in split]
        for long in [p for p in fresh if len(p) > CACHED_LENGTH]:
            del self.known[long]
        return out


# ---- parts of a long text -------------------------------------------------------------------------------------

WHOLE, RUN, SPECIAL = "whole", "run", "special"


def stretches(text: str, part: int) -> Iterator[str]:
    """``text`` cut at safe places into stretches of about ``part`` characters, longer where there is no such place."""
    start = 0
    while len(text) - start > part:
        found = CUTS.search(text, start + part)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def parts(text: str, vocabulary: str | None, part: int, leaf: int) -> Iterator[tuple[int, int, str, str]]:
    """(number, leaf number, kind, piece) of a long text: whole parts, special tokens and leaves of unsplit runs."""
    encoder = load(vocabulary)
    tokenizer, special = encoder.tokenizer, encoder.special
    pattern = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    number = 0
    for k, section in enumerate(re.split(f"({pattern})", text) if special else [text]):
        if k % 2:
            yield number, 0, SPECIAL, section
            number += 1
            continue
        for stretch in stretches(section, part):
            if len(stretch) <= 2 * part:
                if stretch:
                    yield number, 0, WHOLE, stretch
                    number += 1
                continue
            short: list[tuple[int, int]] = []
            for run, (start, end) in tokenizer.pre_tokenizer.pre_tokenize_str(stretch):
                if len(run) <= leaf:
                    # neighbouring short pre-tokens travel together; their byte characters need no new split
                    if short and end - short[0][0] > part:
                        yield number, 0, RUN, "\0".join(pieces)
                        number, short = number + 1, []
                    if not short:
                        pieces = []
                    short.append((start, end))
                    pieces.append(run)
                    continue
                if short:
                    yield number, 0, RUN, "\0".join(pieces)
                    number, short = number + 1, []
                for n, at in enumerate(range(0, len(run), leaf)):
                    yield number, n, RUN, run[at : at + leaf]
                number += 1
            if short:
                yield number, 0, RUN, "\0".join(pieces)
                number += 1


def encode_piece(encoder: Encoder, kind: str, piece: str) -> list[int]:
    """Token numbers of one piece; the byte characters of a run hold no NUL, which separates its pre-tokens."""
    if kind == SPECIAL:
        return [encoder.tokenizer.token_to_id(piece)]
    if kind == RUN:
        return [t.id for run in piece.split("\0") for t in encoder.tokenizer.model.tokenize(run)]
    return encoder([piece])[0]


def concatenated(tokenizer, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
    """Encoding of the text of ``left`` followed by that of ``right``, both encodings of unsplit text."""
    if not left or not right:
        return [*left, *right]
    while True:
        a, b = min(window, len(left)), min(window, len(right))
        string = "".join(map(tokenizer.id_to_token, left[len(left) - a :] + right[:b]))
        middle = [t.id for t in tokenizer.model.tokenize(string)]
        from_left = a == len(left) or middle[0] == left[-a]
        from_right = b == len(right) or middle[-1] == right[b - 1]
        if from_left and from_right:
            return left[: len(left) - a] + middle + right[b:]
        window *= 2


# ---- Spark jobs -----------------------------------------------------------------------------------------------

KEY = ["_digest", "_part"]
PIECE = "_digest string, _part long, _leaf long, kind string, piece string"
IDS = "_digest string, _part long, _leaf long, ids array<int>"


def rows_to_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)


def cut_up(long_texts: DataFrame, vocabulary: str | None, part: int, leaf: int) -> DataFrame:
    """Pieces of the distinct long texts (text), each once, spread over tasks by piece and not by text."""
    names, kinds = ["_digest", "_part", "_leaf", "kind", "piece"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                digest = hashlib.sha256(text.encode()).hexdigest()
                rows = [(digest, *p) for p in parts(text, vocabulary, part, leaf)]
                yield rows_to_batch(rows, names, kinds)

    pieces = long_texts.mapInArrow(run, PIECE)
    return pieces.groupBy(*KEY, "_leaf").agg(F.first("kind").alias("kind"), F.first("piece").alias("piece"))


def encoded(pieces: DataFrame, vocabulary: str | None) -> DataFrame:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        for batch in batches:
            rows = [
                (digest, part, leaf, encode_piece(encoder, kind, piece))
                for digest, part, leaf, kind, piece in zip(*[c.to_pylist() for c in batch.columns])
            ]
            yield rows_to_batch(rows, ["_digest", "_part", "_leaf", "ids"], kinds)

    return pieces.select(*KEY, "_leaf", "kind", "piece").mapInArrow(run, IDS)


def joined_pairs(leaves: DataFrame, vocabulary: str | None) -> DataFrame:
    """One round of tree concatenation: leaves 2k and 2k + 1 of a part become leaf k."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary).tokenizer
        for batch in batches:
            rows = []
            for digest, part, leaf, sides in zip(*[c.to_pylist() for c in batch.columns]):
                ids = [s["ids"] for s in sides]
                rows.append((digest, part, leaf, ids[0] if len(ids) == 1 else concatenated(tokenizer, *ids)))
            yield rows_to_batch(rows, ["_digest", "_part", "_leaf", "ids"], kinds)

    sides = leaves.groupBy(*KEY, F.floor(F.col("_leaf") / 2).alias("_leaf")).agg(
        F.sort_array(F.collect_list(F.struct("_leaf", "ids"))).alias("sides"))
    return sides.mapInArrow(run, IDS)


def long_ids(texts: DataFrame, vocabulary: str | None, part: int, leaf: int) -> DataFrame:
    """(_digest, ids) of every distinct long text; ``texts`` has the one column text."""
    done = materialise(encoded(cut_up(texts, vocabulary, part, leaf), vocabulary), "bpe-pieces")
    runs = done.join(done.filter("_leaf > 0").select(*KEY).distinct(), KEY, "left_semi")
    most = done.agg(F.max("_leaf")).first()[0] or 0
    if most:
        done = done.join(runs.select(*KEY).distinct(), KEY, "left_anti")
        for _ in range(int(most).bit_length()):
            runs = joined_pairs(runs, vocabulary)
        done = done.unionByName(runs)
    ordered = F.array_sort(F.collect_list(F.struct("_part", "ids")))
    return done.groupBy("_digest").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def result(tokenizer, ids: list[int], with_ids: bool) -> tuple:
    text = tokenizer.decode(ids, skip_special_tokens=False)
    digest = hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
    return len(ids), digest, hashlib.sha256(text.encode()).hexdigest(), ids if with_ids else None


MADE = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}


def encode(
    docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True, text: str = "text",
    part: int = PART, leaf: int = LEAF,
) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256 and ids.

    ``vocabulary`` is the file of a byte-level BPE tokenizer without normalizer; special tokens in a text become their
    number, none is added.  Null and empty texts have no tokens.  Equal texts have equal results; long ones are encoded once.
    Repeated rows stay, other columns too, and a column with the name of a result is replaced.  ``ids`` is null unless
    ``with_ids``.
    """
    base = without(docs, *MADE)

    def short(batches):
        encoder = load(vocabulary)
        for texts in batches:
            easy = [k for k, t in enumerate(texts) if t is None or len(t) <= part]
            rows: list[tuple] = [(None, None, None, None)] * len(texts)
            for k, ids in zip(easy, encoder([texts[k] or "" for k in easy])):
                rows[k] = result(encoder.tokenizer, ids, with_ids)
            yield [list(c) for c in zip(*rows)] if rows else [[] for _ in MADE]

    is_long = F.coalesce(F.char_length(text) > part, F.lit(False))
    direct = append_arrow(base.filter(~is_long), MADE, short, text=text)
    long_docs = base.filter(is_long)
    found = long_ids(long_docs.select(F.col(text).alias("text")), vocabulary, part, leaf)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary).tokenizer
        for batch in batches:
            rows = [(d, *result(tokenizer, ids, with_ids)) for d, ids in zip(*[c.to_pylist() for c in batch.columns])]
            yield rows_to_batch(rows, ["_digest", *MADE], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())])

    results = found.mapInArrow(finish, "_digest string, " + ", ".join(f"{c} {t}" for c, t in MADE.items()))
    results = results.select(*[F.col(c).alias(f"{c}#") for c in results.columns])
    same = F.sha2(F.encode(F.col(text), "utf-8"), 256) == F.col("_digest#")
    late = long_docs.join(results, same).select(
        *[F.col(f"`{c}`") for c in base.columns], *[F.col(f"`{c}#`").alias(c) for c in MADE])
    return direct.unionByName(late)


@register("op13_bpe")
def op13(spark, sf_dir):
    """Length and digests of the BPE encoding of every document and of the text decoded from it."""
    made = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
