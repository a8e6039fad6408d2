"""Token ids of whole texts, by way of their white-space-delimited chunks.

`word_bpe_49k.json` lower-cases, drops white space and never merges across it or
between letters and marks, so a text's ids are its chunks' ids one after
another, and a chunk of letters with marks behind is the letters' ids and the
marks' ids.  Chunks, letters and marks repeat: a batch's are numbered by Arrow,
each distinct piece is looked up once, and the ids are put together by number.
Pieces are remembered in a bounded cache, Arrow and numpy arrays of some 40 bytes
a piece, that lasts as long as the Python worker and changes no result.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import vocabulary_file

VOCABULARY = "word_bpe_49k.json"

#: Pieces remembered per worker; beyond that the half used last stays.
REMEMBERED = 1_000_000

#: Letters up to U+024F whose lower case has as many bytes; marks that may stand behind.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ŸŹ-žƀ-ȹ]+$"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_ENCODERS: dict[str, ChunkEncoder] = {}


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of `flat`, given by where they start and how long they are, one after another."""
    stops = np.cumsum(sizes)
    return flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)]


def _strings(texts: pa.Array) -> pa.Array:
    """Bytes as strings; null is empty, and what is not UTF-8 becomes U+FFFD."""
    try:
        return pc.fill_null(texts.cast(pa.string()), "")
    except pa.ArrowInvalid:
        return pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, strings.offset * 4).astype(np.int64)


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Encodes texts (an Arrow array of UTF-8) to unsigned ids in a fixed little-endian type."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: pieces remembered, their ids one after another, how many each has, when each was used last
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, self.dtype)
        self.sizes = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.clock = 0
        #: ids that end a run of letters, where the model marks ends
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _plain(self, parts: list[str]) -> list[bytes]:
        """Ids of pieces one by one."""
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _runs(self, stems: list[str]) -> list[bytes]:
        """Ids of runs of letters, together: each run ends at an id that marks an end."""
        ids = np.array(self.tokenizer.encode(" ".join(stems), add_special_tokens=False).ids, self.dtype)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(stems):
            return self._plain(stems)
        raw, size = ids.tobytes(), self.dtype.itemsize
        at = [0, *(stop * size).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _remember(self, pieces: pa.Array) -> None:
        """Encode pieces that are not known."""
        names = _list(pieces)
        letters = _letters(pieces) if self.ends.any() else np.zeros(len(names), bool)
        found: list[bytes] = [b""] * len(names)
        for some, encode in ((np.flatnonzero(letters), self._runs), (np.flatnonzero(~letters), self._plain)):
            for k in range(0, len(some), 2048):
                part = some[k : k + 2048].tolist()
                for i, ids in zip(part, encode([names[i] for i in part]), strict=True):
                    found[i] = ids
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(found), self.dtype)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize))
        self.used = np.concatenate((self.used, np.zeros(len(found), np.int64)))

    def _forget(self) -> None:
        """Keep the half of the pieces that was used last."""
        keep = np.sort(np.argsort(self.used, kind="stable")[-(REMEMBERED // 2) :])
        self.ids = gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[keep], self.sizes[keep])
        self.known, self.sizes, self.used = self.known.take(pa.array(keep)), self.sizes[keep], self.used[keep]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        found = pc.index_in(pieces, value_set=self.known)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        at = found.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.known) + np.arange(len(new))
        if len(new):
            self._remember(pieces.take(pa.array(new)))
        self.clock += 1
        self.used[at] = self.clock
        return gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]), self.sizes[at]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after another, and how many each has."""
        if not self.ends.any():
            return self._pieces(chunks)
        stems = pc.ascii_rtrim(chunks, characters=MARKS)
        split = _letters(stems)
        lengths = pc.binary_length(chunks).to_numpy().astype(np.int64)
        tail = np.where(split, lengths - pc.binary_length(stems).to_numpy(), 0)
        raw = gather(np.frombuffer(chunks.buffers()[2] or b"", np.uint8), _offsets(chunks)[1:] - tail, tail)
        tails = pa.StringArray.from_buffers(len(tail), pa.py_buffer(np.append(0, np.cumsum(tail)).astype(np.int32)), pa.py_buffer(raw))
        heads = pc.if_else(pa.array(split), pc.utf8_lower(stems), chunks).dictionary_encode()
        tails = tails.dictionary_encode()
        # pieces: all heads, then all tails, in one look-up; a chunk is one of each
        ids, sizes = self._pieces(pa.concat_arrays([heads.dictionary, tails.dictionary]))
        pair = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], 1).ravel()
        starts = np.cumsum(sizes) - sizes
        return gather(ids, starts[pair], sizes[pair]), sizes[pair].reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text, then `end`; null texts are empty."""
        split = pc.ascii_split_whitespace(_strings(texts))
        chunks = split.flatten().dictionary_encode()
        ids, sizes = self._chunks(chunks.dictionary)
        order = chunks.indices.to_numpy()
        starts = np.cumsum(sizes) - sizes
        ids = gather(ids, starts[order], sizes[order])
        # where texts end, among chunks and then among ids
        last = np.cumsum(pc.list_value_length(split).to_numpy())
        stops = np.append(0, np.cumsum(sizes[order]))[last]
        ids = np.insert(ids, stops, self.dtype.type(end))
        return np.split(ids, stops + np.arange(1, len(stops) + 1))[:-1]


def _letters(strings: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(strings, LETTERS).to_numpy(zero_copy_only=False)


def encoder(vocabulary: str = VOCABULARY) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file: a public file's name, or a path on every machine."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChunkEncoder(vocabulary if os.path.isabs(vocabulary) else vocabulary_file(vocabulary))
    return _ENCODERS[vocabulary]
