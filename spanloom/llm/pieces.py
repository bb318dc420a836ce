"""SentencePiece encoding and decoding through the tokenizers library.

The model file is parsed here: pieces with scores and types, kind of model, normaliser, markers, byte fallback. From it
a tokenizers pipeline is rebuilt: unigram models keep their scores, BPE models get their merges from the scores of what
they form. Batches are encoded by the library's threads.

Pieces of most models never go on past the start of a word. Where the vocabulary shows that, texts are split there, each
distinct word is encoded once as long as a worker knows it, and every one is also encoded by the SentencePiece library and decoded back:
`parity` and `round_trip` of a text say whether all its words agree. Other models are encoded and verified text by text.
"""

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids a worker keeps between batches.
KNOWN = 200_000
#: New words that are encoded as one text.
TOGETHER = 64
#: Threads of the library in one worker. A worker is one of several on its machine, and each thread holds memory.
THREADS = 2
#: Fixed values of the model format: types of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    bytes_of: tuple[bytes, ...] = ()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        match tag & 7:
            case 0:
                value, at = varint(at)
            case 1:
                value, at = data[at : at + 8], at + 8
            case 2:
                size, at = varint(at)
                value, at = data[at : at + size], at + size
            case 5:
                value, at = data[at : at + 4], at + 4
            case kind:
                raise ValueError(f"wire type {kind} in a model file")
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    model = Model([])
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def splits_at_words(model: Model) -> bool:
    """Whether no piece has the space marker behind another character, so that none spans the start of a word, and
    normalisation leaves texts as they are."""
    plain = not model.charsmap and not model.squeeze and model.escape and model.dummy_prefix and model.kind == BPE
    return plain and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, k in model.pieces if k in (NORMAL, USER))


def rebuild(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if any(k == USER for _, _, k in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    ids = {p: n for n, (p, _, _) in enumerate(model.pieces)}
    unknown = next((n for n, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        usable = {p for p, _, k in model.pieces if k in (NORMAL, UNUSED)}
        merges = []
        for n, (p, s, k) in enumerate(model.pieces):
            if k in (NORMAL, UNUSED):
                merges += [(-s, n, cut, p[:cut], p[cut:]) for cut in range(1, len(p)) if p[:cut] in usable and p[cut:] in usable]
        core = models.BPE(ids, [(a, b) for *_, a, b in sorted(merges)], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} are not supported")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", int(model.dummy_prefix), 0)])
    return tokenizer


@lru_cache(2)
def _tools(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    import sentencepiece

    model = parse_model(data)
    model.bytes_of = piece_bytes(model)
    return model, rebuild(model), sentencepiece.SentencePieceProcessor(model_proto=data)


_WORD = re.compile(r" *[^ ]*")


def split_words(text: str) -> list[str]:
    """The text cut before each run of spaces; the space that a model puts in front of the text is left out."""
    return [w for w in _WORD.findall(" " + text) if w]


def _keys(text: str) -> list[str]:
    """The words of a text, each without its first space."""
    return [w[1:] for w in split_words(text)] if text.startswith(" ") or "  " in text else text.split(" ")


class _Known:
    """Ids of words that a worker has met, one after another in one array, and which of them differ or don't decode back."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.differ: set[str] = set()
        self.lossy: set[str] = set()

    def add(self, words: list[str], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.ids = np.concatenate((self.ids, *ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))

    def shrink(self) -> None:
        """Keep KNOWN words at most: those met first, mostly the frequent ones, stay."""
        while len(self.place) > KNOWN:
            self.place.popitem()
        self.ends = self.ends[: len(self.place) + 1].copy()
        self.ids = self.ids[: self.ends[-1]].copy()

    def of(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each row's end."""
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64)
        begin = self.ends[place]
        size = self.ends[place + 1] - begin
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.cumsum([0, *map(len, words)])]


@lru_cache(2)
def _known(data: bytes) -> _Known:
    return _Known()


def _learn(data: bytes, known: _Known, words: list[str]) -> None:
    """Encode words, TOGETHER at a time as one text, and check them.

    No piece spans the start of a word, so the ids of such a text are those of its words. If they aren't SentencePiece's,
    don't decode back or don't begin as many words as there are, the words are encoded and checked one by one; so are
    words that have a space or marker in them, and the one without a character.
    """
    model, tokenizer, reference = _tools(data)
    opens = _opens_word(data)
    plain, alone = [], []
    for w in words:
        (alone if not w or " " in w or SPACE in w else plain).append(w)
    groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
    done, ids, sizes = [], [], []
    for group, row, same, back in zip(groups, *_verified(model, tokenizer, reference, [" ".join(g) for g in groups]), strict=True):
        row = np.array(row, np.int32)
        begin = np.flatnonzero(opens[row])
        if not (same and back and len(begin) == len(group) and begin[0] == 0):
            alone += group
            continue
        done += group
        ids.append(row)
        sizes.append(np.diff(np.append(begin, len(row))))
    some = [w for w in alone if w]
    for w, row, same, back in zip(some, *_verified(model, tokenizer, reference, some), strict=True):
        done.append(w)
        ids.append(np.array(row, np.int32))
        sizes.append(np.array([len(row)]))
        if not same:
            known.differ.add(w)
        if not back:
            known.lossy.add(w)
    if len(some) < len(alone):  # a word of nothing but the space in front is the marker alone
        done.append("")
        ids.append(np.array([tokenizer.token_to_id(SPACE)], np.int32))
        sizes.append(np.array([1]))
        if ids[-1][0] != reference.piece_to_id(SPACE):
            known.differ.add("")
    known.add(done, ids, np.concatenate(sizes))


def encode_arrays(data: bytes, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
    """Ids of all texts, where each text's begin and end, whether SentencePiece gives the same, and whether decoding gives the text back."""
    model, tokenizer, reference = _tools(data)
    if not _splits(data):
        ids, same, back = _verified(model, tokenizer, reference, [t or "" for t in texts])
        return np.array([*chain.from_iterable(ids)], np.int32), np.cumsum([0, *map(len, ids)]), same, back
    words = [_keys(t) if t else [] for t in texts]
    known = _known(data)
    fresh = list(dict.fromkeys(w for row in words for w in row if w not in known.place))
    if fresh:
        _learn(data, known, fresh)
    ids, ends = known.of(words)
    same, back = ([not bad or bad.isdisjoint(row) for row in words] for bad in (known.differ, known.lossy))
    known.shrink()
    return ids, ends, same, back


def encode_texts(data: bytes, texts: list[str | None]) -> tuple[list[list[int]], list[bool], list[bool]]:
    """Ids of each text, whether SentencePiece gives the same, and whether decoding gives the text back."""
    ids, ends, same, back = encode_arrays(data, texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])], same, back


def piece_bytes(model: Model) -> tuple[bytes, ...]:
    """What each piece stands for: its text with spaces for markers, or one byte."""
    return tuple(
        bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, UNUSED) else b"\xff"
        for p, _, k in model.pieces
    )


@lru_cache(2)
def _splits(data: bytes) -> bool:
    return splits_at_words(_tools(data)[0])


@lru_cache(2)
def _opens_word(data: bytes) -> np.ndarray:
    """Whether each piece begins with the space marker."""
    return np.array([p.startswith(SPACE) for p, _, _ in _tools(data)[0].pieces])


def _verified(model: Model, tokenizer, reference, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
    ids = [e.ids if t else [] for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
    want = reference.encode(texts, num_threads=1)
    pieces = model.bytes_of
    prefix = b" " if model.dummy_prefix else b""
    # a space that the model put in front is no part of the text; of bytes that are no UTF-8, no text comes back
    back = [b"".join([pieces[k] for k in row]).removeprefix(prefix) == t.encode() for t, row in zip(texts, ids, strict=True)]
    return ids, [a == b for a, b in zip(ids, want, strict=True)], back


def piece_ids(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns of docs beside ids, n_tokens, parity and round_trip, which replace columns of those names.

    A null or empty text has no ids; parity and round_trip hold for it. The whole text is encoded; ids of special pieces
    are never given, their names in a text are ordinary text. round_trip is false where the model itself cannot tell two
    texts apart. The model is read on the driver from `path` and sent along; rows are independent of each other.
    """
    with open(path, "rb") as f:
        data = f.read()
    own = ("ids", "n_tokens", "parity", "round_trip")
    fields = [f for f in docs.schema.fields if f.name not in own]
    schema = T.StructType([
        *fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("parity", T.BooleanType()),
        T.StructField("round_trip", T.BooleanType()),
    ])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids, ends, same, back = encode_arrays(data, some.column("text").to_pylist())
                columns = [pa.ListArray.from_arrays(ends.astype(np.int32), ids), pa.array(np.diff(ends)), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], [*some.schema.names, *own])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)
