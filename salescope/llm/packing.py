"""Best-two-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salescope.llm.common import packed
from salescope.plans.session import ship_package, written

LENGTH = 1024
END = 2

#: Pieces that one task packs together, on average; a group loses a part of one sequence at most.
GROUP_PIECES = 20_000

#: The sign by which a byte-level vocabulary writes a space.
SPACE = "\u0120"

#: Signs that end words.
SIGNS = ".,;:!?"

#: Characters of text that one encoding pass takes together; a longer text is a pass of its own.
PASS_CHARS = 1 << 20


#: White space but spaces and line breaks, which are looked for without a pattern.
_RARE_SPACE = re.compile(r"[^\S \n]")


def _near_space(text: str) -> bool:
    """Whether a space may stand next to other white space."""
    return "  " in text or " \n" in text or "\n " in text or bool(_RARE_SPACE.search(text))


class Encoder:
    """Token ids of texts, as bytes of little-endian 32-bit numbers.

    Merges never cross the parts a text is divided into, and a single space between other characters always begins a part:
    texts are split there, and each word, sign and all, is encoded once and remembered. Strings of added tokens get their
    own ids; where one holds white space or takes that beside it, texts with it are encoded whole. New words are encoded in
    runs, as one text with single spaces: the tokens that hold these tell where words begin. When the memory is full,
    words that were not used since it was full before are forgotten.
    """

    #: Words that are remembered at a time; as many of those before are held.
    ROOM = 250_000
    #: Words of a run.
    RUN = 20_000

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.wide = [t.content for t in added if t.lstrip or t.rstrip or re.search(r"\s", t.content)]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.signs = dict(zip(SIGNS, self._encode(list(SIGNS))))

    def forget(self) -> None:
        self.words, self.before = {}, {}

    def _whole(self, text: str) -> bool:
        return _near_space(text) or any(w in text for w in self.wide)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [[t] if self._whole(t) else t.split(" ") for t in (t or "" for t in texts)]
        first = self._encode([s.pop(0) for s in split])
        seen = set().union(*split)
        new = seen.difference(self.words)
        if len(self.words) + len(new) > self.ROOM:
            self.before, self.words = self.words, {}
            new = seen
        again = new.intersection(self.before)
        self.words.update((w, self.before[w]) for w in again)
        self._learn(new.difference(again))
        get = self.words.__getitem__
        out = [f + b"".join(map(get, s)) for f, s in zip(first, split)]
        for word in new:
            if len(word) > 64:
                self.words.pop(word, None)
                self.words.pop(word[:-1], None)
        return out

    def _learn(self, new: set[str]) -> None:
        """Remembers new words. A sign that ends a word behind a letter is a part of its own: the word before it is encoded once."""
        ended = [w for w in new if w[-1:] in self.signs and w[-2:-1].isalpha()]
        others = list(new.difference(ended).union(w[:-1] for w in ended).difference(self.words))
        self.words.update(self._spaced(others))
        self.words.update((w, self.words[w[:-1]] + self.signs[w[-1]]) for w in ended)

    def _spaced(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words, each encoded behind a space.

        Words that a run does not keep apart are encoded one by one: empty ones, those that end in white space, and all of
        a run that happens to spell a wide token or has not one beginning for each word.
        """
        alone = [w for w in words if not w or w[-1].isspace()]
        inside = [w for w in words if w and not w[-1].isspace()] if alone else words
        for a in range(0, len(inside), self.RUN):
            run = inside[a : a + self.RUN]
            text = " " + " ".join(run)
            if not any(w in text for w in self.wide):
                ids = self._encode([text])[0]
                starts = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, np.uint32)])).tolist()
                if len(starts) == len(run) and not starts[0]:
                    yield from zip(run, map(ids.__getitem__, map(slice, starts, [*starts[1:], len(ids)])))
                    continue
            alone += run
        yield from zip(alone, self._encode([" " + w for w in alone]))

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array("I", g.ids).tobytes() for g in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def by_size(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first text, texts) of runs of about PASS_CHARS characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text or "") > PASS_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text or "")
    if texts:
        yield first, texts[first:]


_encoders: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """One for each Python worker. It outlives the task in idle workers, too, so its words do not."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    try:
        yield _encoders[path]
    finally:
        _encoders[path].forget()


def cut(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, tokens, checksum) of the pieces of one document; all but the first have the full length."""
    total = len(ids) // 4
    first = (total - 1) % length + 1
    ends = range(first, total + 1, length)
    return [(max(0, e - length), e - max(0, e - length), zlib.crc32(ids[4 * max(0, e - length) : 4 * e])) for e in ends]


def best_two_fit(lengths: list[int], room: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers. Each bin takes the largest item left, then the largest that fits, until none fits.

    If it has a gap then, its smallest item is swapped for the two items left that together fill the gap and the
    item's place most closely, if they fill more than the item did.
    """
    stock: list[list[int]] = [[] for _ in range(room + 1)]
    for i, n in enumerate(lengths):
        stock[n].append(i)
    have = np.array([len(s) > 0 for s in stock])
    mask = sum(1 << n for n in range(1, room + 1) if stock[n])

    def take(n: int) -> int:
        nonlocal mask
        i = stock[n].pop()
        if not stock[n]:
            have[n] = False
            mask &= ~(1 << n)
        return i

    bins = []
    while mask:
        gap, one = room, []
        while fits := mask & ((2 << gap) - 1):
            n = fits.bit_length() - 1
            one.append((n, take(n)))
            gap -= n
        if gap and mask:
            small = one[-1][0]
            for total in range(gap + small, small, -1):
                both = have[1:total] & have[total - 1 : 0 : -1]
                if total % 2 == 0 and len(stock[total // 2]) < 2:
                    both[total // 2 - 1] = False
                if both.any():
                    n, back = int(both.argmax()) + 1, one.pop()
                    one += [(n, take(n)), (total - n, take(total - n))]
                    stock[back[0]].append(back[1])
                    have[back[0]] = True
                    mask |= 1 << back[0]
                    one.sort(reverse=True)
                    break
        bins.append([i for _, i in one])
    return bins


def tokenize(documents: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of every document, its end token included.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. Null text counts as empty:
    one piece with the end token alone. Repeated rows are documents of their own; ids may be null.
    """
    ship_package(documents.sparkSession)
    end = np.array([END], "<u4").tobytes()
    kind = dict(documents.select("doc_id").dtypes)["doc_id"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with encoder(tokenizer) as own:
            for batch in batches:
                rows, texts = [], batch["text"].tolist()
                for a, part in by_size(texts):
                    for k, ids in enumerate(own.encode(part), a):
                        rows += [(k, p, *c) for p, c in enumerate(cut(ids + end, length))]
                at = [r[0] for r in rows]
                table = np.array(rows, np.int64).reshape(len(rows), 5)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[at].array, "piece": table[:, 1].astype(np.int32), "start": table[:, 2],
                    "length": table[:, 3], "ids_crc32": table[:, 4],
                })

    docs = packed(documents).select("row.doc_id", "row.text")
    # Nullable ids would turn into floating point on the way through pandas: they travel as text.
    sent = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = sent.mapInPandas(pieces, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds (sequence_id, offset) to pieces with a ``length`` column: as few sequences of ``length`` as it can.

    Pieces are dealt by a digest of their columns and place into groups of about GROUP_PIECES; each is packed by
    best-two-fit in one task. No pieces: no rows.
    """
    ship_package(pieces.sparkSession)
    table = written(pieces, "pieces")
    groups = max(1, -(-table.count() // GROUP_PIECES))
    names = table.columns

    def place(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(names, kind="stable").reset_index(drop=True)
        n = batch["length"].tolist()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for s, items in enumerate(best_two_fit(n, length)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (int(key[0]) << 32) + s, at
                at += n[i]
        return batch[names].assign(sequence_id=sequence, offset=offset)

    kind = dict(table.dtypes)["doc_id"]
    sent = table.withColumn("doc_id", F.col("doc_id").cast("string"))
    # Equal pieces are spread, too: where a row lies in the written table tells them apart.
    sent = sent.withColumn("group", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sent.drop("group").schema.fields)
    done = sent.groupBy("group").applyInPandas(place, f"{schema}, sequence_id long, offset long")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack_documents(documents: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Every piece of every document and its place: the pieces of :func:`tokenize`, packed by :func:`pack`."""
    return pack(tokenize(documents, tokenizer, length), length)
