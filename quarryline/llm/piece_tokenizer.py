"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here, and its normaliser, metaspace marker, scores or
merges and byte fallback are rebuilt as a tokenizers pipeline, which encodes and decodes
batches with several threads. Parity with the sentencepiece library and the round trip are
verified for every text, and the results say so:

* Parity: sentencepiece normalises the raw text to the same string, and gives the same ids for
  its words. Where no piece reaches from one word into the next, the ids of a text are those of
  its words, so each distinct word of a task is encoded by both libraries once. Other models are
  compared text by text.
* Round trip: the ids of the whole text are decoded and give the raw text. The table of what each
  piece spells is used for that; the tokenizers decoder has to agree with it on every new word.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Numbers of the public sentencepiece model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNK, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads of one task's encoder, and bytes of text that are encoded at once.
THREADS = 2
CHUNK_BYTES = 1 << 18
#: Distinct words whose ids a task keeps at a time, and their characters.
CACHE_WORDS, CACHE_CHARS = 120_000, 3_000_000
#: Characters of new words that are encoded and checked at once: the libraries take about a hundred bytes for each.
LEARN_CHARS = 1 << 15
#: Words whose pieces the tokenizers library keeps where whole texts are encoded, its own default.
LIBRARY_WORDS = 10_000
#: New words that are checked as one line.
LINE_WORDS = 64
#: A word with the space marks that lead it.
MARKED_WORD = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; nested messages and strings stay bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a sentencepiece model: wire type {kind}")
        yield key >> 3, value


class PieceModel:
    """What a sentencepiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in proto_fields(data):
            if number == 1:
                piece = dict(proto_fields(value))
                self.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(proto_fields(value))
            elif number == 3:
                normalizer = dict(proto_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze_spaces = bool(normalizer.get(4, 1))
        self.escape_spaces = bool(normalizer.get(5, 1))
        self._spelling = None
        self.unk_id = next((i for i, p in enumerate(self.pieces) if p[2] == UNK), None)

    def spelled(self, ids: np.ndarray) -> bytes:
        """What the pieces spell one after another, the space of the prefix included."""
        starts, sizes, letters = self.spelling()
        return letters[stretches(starts[ids], sizes[ids])].tobytes()

    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's bytes begin, how many it has, and the bytes of all pieces."""
        if self._spelling is None:
            parts = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE_MARK, " ").encode() for p, _, kind in self.pieces]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            self._spelling = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(parts), np.uint8)
        return self._spelling

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best resulting score first."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, i in rank.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in rank and right in rank:
                    found.append((-self.pieces[i][1], i, rank[left], rank[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]

    def spaces_only_lead(self) -> bool:
        """No piece has the space mark after another character: words can be encoded one by one."""
        return not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def build_tokenizer(model: PieceModel, cached: int = LIBRARY_WORDS):
    """The tokenizers pipeline of a parsed model; ``cached`` words keep their pieces."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        vocab = [(piece, score) for piece, score, _ in model.pieces]
        tokenizer = Tokenizer(models.Unigram(vocab, unk_id=model.unk_id, byte_fallback=model.byte_fallback))
    elif model.kind == BPE:
        vocab = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        unknown = model.pieces[model.unk_id][0] if model.unk_id is not None else None
        tokenizer = Tokenizer(
            models.BPE(vocab, model.merges(), cache_capacity=cached, unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
        )
    else:
        raise ValueError(f"sentencepiece model type {model.kind} isn't supported")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = SPACE_MARK if model.escape_spaces else " "
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(mark))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE_MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.spaces_only_lead():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE_MARK}+"), "merged_with_next")
    shown = [decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(shown + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


def words_of(line: str) -> list[str]:
    """The words of a normalised text, each without the space mark before it."""
    if SPACE_MARK * 2 in line or line.endswith(SPACE_MARK):
        return [word[1:] for word in MARKED_WORD.findall(line)]
    return line.split(SPACE_MARK)[1:]


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of stretches that begin at ``starts``, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordNumbers(dict):
    """Word -> number in order of arrival; ``fresh`` lists those not looked at yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Encodes texts with the tokenizers library and checks every one against sentencepiece.

    Where no piece crosses from one word into the next, a text's ids are those of its words, so
    each word that comes up is encoded and checked once, in a batch with the other new ones, and
    kept for its next occurrence. Other models encode and check whole texts.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = PieceModel(data)
        self.by_word = self.model.spaces_only_lead() and self.model.escape_spaces and self.model.dummy_prefix
        self.tokenizer = build_tokenizer(self.model, 0 if self.by_word else LIBRARY_WORDS)  # each word comes once
        self.normalizer = self.tokenizer.normalizer
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        if self.by_word:
            self.tokenizer.normalizer = None  # words are normalised with their texts
            marked = [p.startswith(SPACE_MARK) for p, _, _ in self.model.pieces]
            bare = [p.strip(SPACE_MARK) == "" for p, _, _ in self.model.pieces]
            self.marked, self.bare = np.array(marked), np.array(bare)
            self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.chars = WordNumbers(), np.zeros(1 << 16, np.int32), 0
        self.starts = np.zeros(1, np.int64)
        self.bad = np.zeros((0, 2), bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """All ids one after another, their number in each text, and whether it round-trips and agrees."""
        if not self.by_word:
            return self._encode_whole(texts)
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        lines = list(map(self.normalizer.normalize_str, texts))
        rows = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in map(words_of, lines)]
        self._learn()
        together = np.concatenate(rows)
        sizes = (self.starts[1:] - self.starts[:-1])[together]
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(r) for r in rows])]
        wrong = [self.bad[r].any(axis=0) for r in rows] if self.bad.any() else [(False, False)] * len(rows)
        ids, counts = self.ids[stretches(self.starts[together], sizes)], np.diff(upto, prepend=0)
        round_trip = [bool(a and not w[0]) for a, w in zip(self._spelled_again(ids, upto, texts), wrong, strict=True)]
        same_line = map(str.__eq__, self.other.normalize(texts), lines)
        return ids, counts, round_trip, [bool(a and not w[1]) for a, w in zip(same_line, wrong, strict=True)]

    def _spelled_again(self, ids: np.ndarray, upto: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether the ids of each text spell it: all texts of the batch in one go, and one by one if that fails."""
        wanted = [f" {text}".encode() if text else b"" for text in texts]
        if self.model.spelled(ids) == b"".join(wanted):
            lengths = np.concatenate(([0], np.cumsum(self.model.spelling()[1][ids])))[[0, *upto.tolist()]]
            return (np.diff(lengths) == np.fromiter(map(len, wanted), np.int64, len(wanted))).tolist()
        return [self.model.spelled(ids[a:b]) == w for a, b, w in zip([0, *upto.tolist()], upto.tolist(), wanted, strict=False)]

    def _learn(self) -> None:
        """Encode and check the new words, LEARN_CHARS at a time."""
        new, self.known.fresh = self.known.fresh, []
        for run in chunks(new, LEARN_CHARS):
            self._learn_words(run)

    def _learn_words(self, new: list[str]) -> None:
        """Encode words as one line, cut its ids where words begin, and check them.

        The ids must be those of sentencepiece, and the tokenizers decoder must give the words again
        and what the table of pieces says, in lines of LINE_WORDS.
        """
        self.chars += sum(map(len, new))
        marked = [SPACE_MARK + word for word in new]
        ids, sizes = self._line(marked)
        ends = np.cumsum(sizes)
        lines, flat, at = [], ids.tolist(), [0]
        for first in range(0, len(marked), LINE_WORDS):
            lines.append("".join(marked[first : first + LINE_WORDS]).replace(SPACE_MARK, " ")[1:])
            at.append(int(ends[min(first + LINE_WORDS, len(marked)) - 1]))
        parts = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        agreed = self.other.encode(lines, num_threads=1) == parts
        decoded = self.tokenizer.decode_batch(parts, skip_special_tokens=False) == lines
        spelled = decoded and self.model.spelled(ids) == "".join(f" {line}" for line in lines).encode()
        bad = np.zeros((len(new), 2), bool)
        if not (spelled and agreed):  # find the words that differ, each after another word as in a text
            lead = self.other.encode("a")
            for i, word in enumerate(marked):
                own = ids[ends[i] - sizes[i] : ends[i]]
                text = word.replace(SPACE_MARK, " ")
                bad[i, 0] = self._decoded(own.tolist()) != text[1:] or self.model.spelled(own) != text.encode()
                bad[i, 1] = self.other.encode("a" + text) != lead + own.tolist()
        self.bad = np.concatenate((self.bad, bad))
        used = int(self.starts[-1])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[used : used + len(ids)] = ids
        self.starts = np.concatenate((self.starts, used + np.cumsum(sizes)))

    def _decoded(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def _line(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and their number in each."""
        parts = [words[i::THREADS] for i in range(THREADS)] if len(words) > THREADS else [words]
        order = np.argsort(np.concatenate([np.arange(i, len(words), len(parts)) for i in range(len(parts))]), kind="stable")
        found = self.tokenizer.encode_batch_fast(["".join(part) for part in parts], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        # a word begins at a marked piece, unless a piece of nothing but marks leads to it
        begins = self.marked[ids]
        begins[1:] &= ~self.bare[ids[:-1]]
        first = np.cumsum([0, *(len(e.ids) for e in found[:-1])])
        begins[first] = True
        starts = np.flatnonzero(begins)
        if len(starts) != len(words):  # words of marks only run together: one at a time
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found])
        sizes = np.diff(starts, append=len(ids))[order]
        return ids[stretches(starts[order], sizes)], sizes

    def _encode_whole(self, texts: list[str]):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        round_trip = [a == b for a, b in zip(back, texts, strict=True)]
        parity = [a == b for a, b in zip(self.other.encode(texts, num_threads=THREADS), found, strict=True)]
        flat = np.fromiter((i for x in found for i in x), np.int32)
        return flat, np.array([len(x) for x in found], np.int64), round_trip, parity


def chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters together; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encode_pieces(docs: DataFrame, model_bytes: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip, parity) for every document.

    ``ids`` are those of the whole text without special tokens; null and empty texts have
    none. ``round_trip``: decoded, they are the text again. ``parity``: sentencepiece gives
    the same ids. Repeated rows are encoded like others; texts of any length are encoded whole.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model_bytes)

    def make():
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        encoder = Encoder(shipped.value)

        def step(batch):
            ids, sizes, back, same = [], [], [], []
            for run in chunks([text.decode("utf-8", "replace") for text in texts_of(batch)], CHUNK_BYTES):
                found, number, whole, agreed = encoder.encode(run)
                ids.append(found)
                sizes.append(number)
                back += whole
                same += agreed
            sizes = np.concatenate(sizes)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())),
                    pa.array(back, pa.bool_()),
                    pa.array(same, pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids", "round_trip", "parity"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, make, "doc_id long, n_tokens long, ids array<int>, round_trip boolean, parity boolean")


def decode_pieces(encoded: DataFrame, model_bytes: bytes) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; a null list gives a null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model_bytes)

    def make():
        tokenizer = build_tokenizer(PieceModel(shipped.value))

        def step(batch):
            ids = column_of(batch, "ids").to_pylist()
            texts = tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            shown = [None if x is None else text for x, text in zip(ids, texts, strict=True)]
            return pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(shown, pa.string())], ["doc_id", "text"])

        return step

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), make, "doc_id long, text string")


def read_model(path: str = MODEL_PATH) -> bytes:
    """A model file on the driver's disk; its size is that of a vocabulary."""
    with open(path, "rb") as file:
        return file.read()
