"""BPE encoding and decoding by tree concatenation.

A text longer than LEAF code points is cut in halves, and the halves again,
down to leaves.  All leaves are encoded apart from each other: those of a text
of up to PIECE code points in one batch of its task, those of longer texts in
many tasks, which hand on the ids and bounds of their tokens.  Then the tree is
climbed.  At each join a window around the cut is encoded anew, and grown to
twice its size until it agrees with both sides exactly: AGREE tokens in a row
have the same bounds and ids in the side and in the window.  What the window
has between the two places replaces what the sides had.

Why agreement is enough: a token's neighbours decide whether a sequence is the
one that merging gives, so a sequence whose every two neighbours are neighbours
in the encoding of some stretch is right; the pattern that splits a text looks
ahead by less than MARGIN code points and never back; and places count only
where no character can merge with one beside it when the text is normalised.
A text without such a place is encoded whole, as the last window.

A leaf encodes the strings between white space, which no token holds; a worker
keeps those that it has encoded, up to KEPT of them.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points: of a leaf, and of a piece that a task gets.
LEAF, PIECE = 1 << 14, 1 << 16
FIRST_WINDOW, AGREE, MARGIN = 64, 3, 4
#: Encoded strings that a worker keeps, and the longest one.
KEPT, KEPT_CHARS = 400_000, 64
# White space as the tokenizer's own pattern has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_strings = re.compile(f"[^{WHITE}]+").findall
_own_breaks = re.compile("[\x1c-\x1f]").search  # these split for str.split only

Token = tuple[int, int, int]  # start, end, id


#: Some tokens in a row, a plain tuple since a worker holds very many: their number, the ids and the tokens (each joined by
#: spaces), and either the string that they encode, whose tokens are made when a join needs them, or the tokens by places.
Chunk = tuple[int, str, str, str | list[Token]]


@dataclass
class Part:
    """A stretch of a text and its tokens in chunks."""

    start: int
    end: int
    chunks: list[Chunk]


def _inert(text: str) -> bool:
    """Whether no character of text can merge with one before it when the text is normalised."""
    return text.isascii() or all(unicodedata.category(c)[0] != "M" and not 0x1100 <= ord(c) < 0x1200 for c in text)


class Encoder:
    """One vocabulary, loaded once in each worker process."""

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads only wait on each other
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        count = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [str(i) for i in range(count)]
        self.words = [self.tokenizer.id_to_token(i) for i in range(count)]
        self.joins_words = self.tokenizer.decoder is None  # then decoding joins the tokens by spaces
        self.kept: dict[str, Chunk] = {}
        # where nothing but the case of ASCII changes, that is done here and the rest of the normalising left out
        self.plain, self.first = None, {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        parts = (json.loads(self.tokenizer.to_str())["normalizer"] or {}).get("normalizers", [])
        if [n["type"] for n in parts] == ["NFC", "Replace", "Lowercase"] and parts[1]["pattern"] == {"Regex": "\\s+"}:
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = normalizers.Sequence([])

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def chunk(self, source: str | list[Token], ids: list[int]) -> Chunk:
        return len(ids), " ".join([self.names[i] for i in ids]), " ".join([self.words[i] for i in ids]), source

    def placed(self, tokens: list[Token]) -> Chunk:
        return self.chunk(tokens, [t[2] for t in tokens])

    def apart(self, stretches: list[tuple[str, int, int]]) -> list[list[Token]]:
        """Tokens of stretches (text, start, end), each encoded as if it stood alone."""
        found = self.tokenizer.encode_batch([t[a:b] for t, a, b in stretches], add_special_tokens=False)
        return [[(s + a, e + a, i) for (s, e), i in zip(x.offsets, x.ids)] for x, (_, a, _) in zip(found, stretches)]

    def strings(self, texts: list[str]) -> list[list[Chunk]]:
        """The strings between white space of each text, encoded."""
        found = [_strings(t) if _own_breaks(t) else t.split() for t in texts]
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        missing = list(set().union(*found).difference(kept))
        simple = [s for s in missing if self.plain and s.isascii() and self.first.isdisjoint(s)]
        others = missing if not simple else list(set(missing).difference(simple))
        for some, tokenizer, texts in ((simple, self.plain, map(str.lower, simple)), (others, self.tokenizer, iter(others))):
            for k in range(0, len(some), 4096):
                for s, e in zip(some[k : k + 4096], tokenizer.encode_batch_fast(list(itertools.islice(texts, 4096)), add_special_tokens=False)):
                    kept[s] = self.chunk(s, e.ids)
        look_up = kept.__getitem__
        out = [list(map(look_up, some)) for some in found]
        if any(not kept[s][0] for s in missing):  # strings without tokens
            out = [[c for c in chunks if c[0]] for chunks in out]
            missing = [s for s in missing if kept[s][0] or kept.pop(s) is None]
        for s in missing:
            if len(s) > KEPT_CHARS:
                del kept[s]
        return out

    def leaves(self, texts: list[str], tokens: bool = False) -> list[list[Part]]:
        """The leaves of each text, in order; tokens: with all their tokens by place."""
        cuts = []
        for text in texts:
            n = 1
            while len(text) > LEAF * n:
                n *= 2
            cuts.append([len(text) * k // n for k in range(n + 1)])
        stretches = [(t, a, b) for t, c in zip(texts, cuts) for a, b in zip(c, c[1:])]
        if tokens:
            chunks = iter([[self.placed(found)] for found in self.apart(stretches)])
        else:
            chunks = iter(self.strings([t[a:b] for t, a, b in stretches]))
        return [[Part(a, b, next(chunks)) for a, b in zip(c, c[1:])] for c in cuts]

    def walk(self, text: str, part: Part, backwards: bool) -> Iterator[Token]:
        """A part's tokens from one end; strings that it comes to are replaced by their tokens."""
        place = part.end if backwards else part.start
        for k in range(len(part.chunks) - 1, -1, -1) if backwards else range(len(part.chunks)):
            found = part.chunks[k][3]
            if isinstance(found, str):
                at = text.rindex(found, part.start, place) if backwards else text.index(found, place, part.end)
                found = self.apart([(text, at, at + len(found))])[0]
                part.chunks[k] = (*part.chunks[k][:3], found)
            if found:
                place = found[0][0] if backwards else found[-1][1]
            yield from reversed(found) if backwards else found

    def meet(self, text: str, side: Part, window: list[Token], low: int, high: int, left: bool) -> tuple[int, int] | None:
        """A place between low and high where a side and the window agree, looked for from the cut outwards: the side's tokens between it and the cut, and the window's tokens before it."""
        at = {t: k for k, t in enumerate(window)}
        step = -1 if left else 1
        run: list[tuple[int, Token]] = []
        for k, token in enumerate(self.walk(text, side, left)):
            start, end, _ = token
            if (end <= low) if left else (start >= high):
                break
            w = at.get(token)
            if w is None or start <= low + MARGIN or end >= high - MARGIN:
                run = []
                continue
            run = [*run[-AGREE + 1 :], (w, token)] if run and w == run[-1][0] + step else [(w, token)]
            # the place is beside the last token, so tokens that agree lie on both sides of it
            if len(run) == AGREE and _inert(text[min(t[0] for _, t in run) : max(t[1] for _, t in run)]):
                return k, (w + 1 if left else w)
        return None

    def without(self, chunks: list[Chunk], drop: int, from_end: bool) -> list[Chunk]:
        """chunks without drop tokens, all of them walked over, at one end."""
        k = len(chunks) - 1 if from_end else 0
        while drop and drop >= chunks[k][0]:
            drop -= chunks[k][0]
            k += -1 if from_end else 1
        if not drop:
            return chunks[: k + 1] if from_end else chunks[k:]
        some = [self.placed(chunks[k][3][:-drop] if from_end else chunks[k][3][drop:])]
        return chunks[:k] + some if from_end else some + chunks[k + 1 :]

    def join(self, pairs: list[tuple[str, Part, Part]]) -> list[Part]:
        """Both sides of each cut in one part, mended by a window that grows until it agrees with them."""
        done: list[Part | None] = [None] * len(pairs)
        reach, open_ = FIRST_WINDOW, list(range(len(pairs)))
        while open_:
            stretches = [(text, max(left.start, left.end - reach), min(right.end, left.end + reach)) for text, left, right in (pairs[n] for n in open_)]
            for n, (text, low, high), window in zip(open_, stretches, self.apart(stretches)):
                _, left, right = pairs[n]
                cut = left.end
                i = (None, 0) if low == left.start else self.meet(text, left, window, low, cut, True)
                j = (None, len(window)) if high == right.end else self.meet(text, right, window, cut, high, False)
                if i and j and i[1] <= j[1]:
                    inner = window[i[1] : j[1]]
                    before = [] if i[0] is None else self.without(left.chunks, i[0], True)
                    after = [] if j[0] is None else self.without(right.chunks, j[0], False)
                    done[n] = Part(left.start, right.end, [*before, *([self.placed(inner)] if inner else []), *after])
            open_ = [n for n in open_ if done[n] is None]
            reach *= 2
        return done

    def climb(self, texts: list[str], parts: list[list[Part]]) -> list[Part]:
        """The whole of each text: neighbours are joined, all joins of a level in a batch, until one part is left."""
        while any(len(p) > 1 for p in parts):
            joins = [(n, k) for n, p in enumerate(parts) for k in range(0, len(p) - 1, 2)]
            joined = dict(zip(joins, self.join([(texts[n], parts[n][k], parts[n][k + 1]) for n, k in joins])))
            parts = [[joined.get((n, k), p[k]) for k in range(0, len(p), 2)] for n, p in enumerate(parts)]
        return [p[0] for p in parts]

    def encode(self, texts: list[str]) -> list[list[Chunk]]:
        """The tokens of each text, in chunks."""
        was = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and there is very much of it
        try:
            return [part.chunks for part in self.climb(texts, self.leaves(texts))]
        finally:
            if was:
                gc.enable()

    def ids(self, text: str) -> list[int]:
        return _numbers(self.encode([text])[0]).tolist()

    def decode(self, chunks: list[Chunk]) -> str:
        if self.joins_words:
            return " ".join([c[2] for c in chunks])
        return self.tokenizer.decode(_numbers(chunks).tolist(), skip_special_tokens=False)


def _numbers(chunks: list[Chunk]) -> np.ndarray:
    return np.array(" ".join([c[1] for c in chunks]).split(), dtype=np.int32)


def _id_lists(lists: list) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.int32), *[np.asarray(x, np.int32) for x in lists]])))


def _groups(column: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    some, held = [], 0
    for text in column.to_pylist():
        some.append(text or "")
        held += len(some[-1])
        if held > chars:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(docs: DataFrame, vocabulary: str, outputs: str = "ids") -> DataFrame:
    """Encodes and decodes every row of docs (doc_id, text).

    outputs: "ids" gives n_tokens, ids and decoded; "digests" n_tokens and the
    SHA-256 of the ids (decimal, joined by one space) and of the decoded text.
    The result is the tokenizer's for the whole text; decoding is what the
    vocabulary's own decoder does.  A null text counts as empty: no ids, empty
    decoded text.  A text of more than PIECE code points goes to several tasks,
    and one task joins their tokens (some forty bytes of memory a character).
    Repeated rows come back as often, a null doc_id stays null, an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    whole = outputs == "ids"
    schema = "doc_id bigint, n_tokens bigint, " + ("ids array<int>, decoded string" if whole else "ids_sha256 string, decoded_sha256 string")
    names = [c.split()[0] for c in schema.split(", ")]

    def finish(encoder: Encoder, doc_ids, found: list[list[Chunk]]) -> pa.RecordBatch:
        texts = [encoder.decode(chunks) for chunks in found]
        if whole:
            results = [_id_lists([_numbers(chunks) for chunks in found]), pa.array(texts, pa.string())]
        else:
            lines = [" ".join([c[1] for c in chunks]) for chunks in found]
            results = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in some], pa.string()) for some in (lines, texts)]
        counts = [sum([c[0] for c in chunks]) for chunks in found]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), *results], names=names)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(vocabulary)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text")):
                yield finish(encoder, batch.column("doc_id").slice(at, len(texts)), encoder.encode(texts))
                at += len(texts)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [[t for c in p.chunks for t in c[3]] for p in encoder.climb(texts, encoder.leaves(texts, tokens=True))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "piece", "text")], *[_id_lists([[t[k] for t in tokens] for tokens in found]) for k in range(3)]], names=["row", "doc_id", "piece", "text", "starts", "ends", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(vocabulary)
        for batch in batches:
            for k in range(batch.num_rows):
                parts, at = [], 0
                some = batch.column("parts")[k].as_py()
                for p in some:
                    parts.append(Part(at, at + len(p["text"]), [encoder.placed([(s + at, e + at, i) for s, e, i in zip(p["starts"], p["ends"], p["ids"])])]))
                    at = parts[-1].end
                one = encoder.climb(["".join(p["text"] for p in some)], [parts])
                yield finish(encoder, batch.column("doc_id").slice(k, 1), [one[0].chunks])

    rows = docs.select("doc_id", "text")
    is_long = F.length("text") > PIECE
    short_rows = rows.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(direct, schema)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")), lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)))
    long_rows = rows.where(is_long).select(F.sha2("text", 256).alias("hash"), "doc_id", "text")
    named = long_rows.select(F.concat_ws(":", "hash", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.monotonically_increasing_id()).alias("row"), "doc_id", "text")
    numbered = named.select("row", "doc_id", F.posexplode(cut).alias("piece", "text"))
    dealt = numbered.repartition(n, "row", "piece").mapInArrow(pieces, "row string, doc_id bigint, piece int, text string, starts array<int>, ends array<int>, ids array<int>")
    grouped = dealt.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "text", "starts", "ends", "ids"))).alias("parts"))
    return short_rows.unionByName(grouped.select("doc_id", "parts").mapInArrow(joined, schema))
